"""Language-model scoring: a bigram model in Elias-Fano tries, one for each shard of words."""

from __future__ import annotations

import os
import tempfile
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from xxhash import xxh3_64_intdigest

from .common import materialise, shuffle_partitions, small_batches, table
from .trie import Trie, quantised, restored

#: Stands for the end of a text, and before its first word.  No word is empty or holds a space.
END, START = xxh3_64_intdigest(b""), xxh3_64_intdigest(b" ")
#: How many counts the smaller model weighs under the larger one.
WEIGHT = 50.0
#: A word with more than this share of all tokens is hot; so there are at most as many hot words.
HOT = 1 / 16_384


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def _counts(docs: DataFrame) -> DataFrame:
    """(word, count) over the texts to learn from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def flush() -> pa.RecordBatch:
            word = np.fromiter(map(xxh3_64_intdigest, found), dtype=np.uint64, count=len(found)).view(np.int64)
            out = pa.RecordBatch.from_arrays([pa.array(word), pa.array(np.fromiter(found.values(), dtype=np.int64, count=len(found)))], names=["word", "count"])
            found.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.update(_words(text))
                found[b""] += 1
            if len(found) > 1_000_000:
                yield flush()
        if found:
            yield flush()

    return docs.where("learn").select("t").mapInArrow(run, "word long, count long").groupBy("word").agg(F.sum("count").alias("count"))


def _dealt(docs: DataFrame, hot: np.ndarray, shards: int) -> DataFrame:
    """Every token with the word before it, packed by shard and chunk of texts, and a row for each chunk with its texts'
    ``uids`` and ``ids``: (shard, chunk, uids, ids, data).

    A word's tokens go to one shard; a hot word's are dealt by the word before, so that no shard gets many more.
    """
    shared = docs.sparkSession.sparkContext.broadcast(hot)
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, waiting, held = shared.value, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            sizes = [len(h) for *_, h in waiting]
            word = np.concatenate([h for *_, h in waiting])
            before = np.r_[np.uint64(START), word[:-1]]
            before[np.r_[0, np.cumsum(sizes)[:-1]]] = START
            doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
            is_hot, _ = _hot(common, word)
            with np.errstate(over="ignore"):
                spread = np.where(is_hot, (word ^ (before * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93), word)
            to = (spread >> np.uint64(13)) % np.uint64(shards)
            by = np.lexsort((word, to))
            word, before, doc, to = word[by], before[by], doc[by], to[by]
            ends = np.searchsorted(to, np.arange(shards + 1, dtype=np.uint64))
            chunk, learned = (task << 32) + len(made), np.packbits(np.array([x for *_, x, _ in waiting], dtype=bool)).tobytes()
            made.append(chunk)
            some = np.flatnonzero(np.diff(ends))
            packs = [_with_learned(learned, _packed(word[ends[k] : ends[k + 1]], before[ends[k] : ends[k + 1]], doc[ends[k] : ends[k + 1]], common)) for k in some.tolist()]
            for k, pack in zip(some.tolist(), packs, strict=True):
                yield row(k, chunk, None, None, pack)
            yield row(chunk % shards, chunk, [u for u, *_ in waiting], [i for _, i, _, _ in waiting], None)
            waiting.clear()

        def row(shard: int, chunk: int, uids: list | None, ids: list | None, data: bytes | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([chunk], pa.int64()), pa.array([uids], pa.list_(pa.int64())), pa.array([ids], pa.list_(id_type)), pa.array([data], pa.binary())], names=["shard", "chunk", "uids", "ids", "data"])

        made, task = [], TaskContext.get().partitionId()
        id_type = None
        for batch in batches:
            id_type = batch.schema.field("id").type
            for uid, id, learn, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                words = _words(text)
                h = np.empty(len(words) + 1, dtype=np.uint64)
                h[:-1] = np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
                h[-1] = END
                waiting.append((uid, id, learn, h))
                held += len(h)
            if held > 1_500_000:
                yield from flush()
                held = 0
        if waiting:
            yield from flush()

    return docs.select("uid", "id", "learn", "t").mapInArrow(run, f"shard int, chunk long, uids array<long>, ids array<{kind}>, data binary")


def _with_learned(learned: bytes, tokens: bytes) -> bytes:
    """Bits of which of the chunk's texts are learned from, and the tokens."""
    return np.array([len(learned)], "<i8").tobytes() + learned + tokens


def _answer(times: np.ndarray, counts: np.ndarray, doc: np.ndarray, value: np.ndarray) -> bytes:
    """What a shard says of the tokens of a pack: of each word how often it stands there and its count, of each token
    its text and its value, quantised.  A few bytes for a token, however many shards there are."""
    head = np.array([len(times), len(doc)], "<i8").tobytes()
    return zstandard.compress(head + b"".join(_planes(x) for x in (times.astype("<u4"), counts.astype("<u8"), doc.astype("<u4"), value.astype("<u2"))), 3)


def _answered(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(count of its word, text, value) of each token."""
    raw, at, out = zstandard.decompress(data), 16, []
    words, n = np.frombuffer(raw, "<i8", 2).tolist()
    for size, kind in ((words, "<u4"), (words, "<u8"), (n, "<u4"), (n, "<u2")):
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, size * width, at).reshape(width, size).T).view(kind).ravel())
        at += size * width
    return np.repeat(out[1], out[0]).astype(np.int64), out[2].astype(np.int64), restored(out[3])


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _hot(common: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(common):
        return np.zeros(len(word), dtype=bool), np.zeros(len(word), dtype=np.int64)
    k = np.minimum(np.searchsorted(common, word), len(common) - 1)
    return common[k] == word, k


def _packed(word: np.ndarray, before: np.ndarray, doc: np.ndarray, common: np.ndarray) -> bytes:
    """Sorted by word: the words, how often each; of each token its text, and the word before, as a number if it is hot."""
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    times = np.diff(np.r_[first, len(word)])
    is_hot, k = _hot(common, before)
    known = np.where(is_hot, k, 65_535).astype("<u2")
    other = before[~is_hot].astype("<u8")
    parts = [word[first].astype("<u8").tobytes(), times.astype("<i4").tobytes(), doc.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), known.view(np.uint8).reshape(-1, 2).T.tobytes(), other.tobytes()]
    head = np.array([len(first), len(word), len(other)], dtype="<i8").tobytes()
    return zstandard.compress(head + b"".join(parts), 1)


def _unpacked(data: bytes, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, the word before, text) of each token."""
    raw = zstandard.decompress(data)
    words, n, others = np.frombuffer(raw, "<i8", 3).tolist()
    at = 24
    first = np.frombuffer(raw, "<u8", words, at)
    at += 8 * words
    times = np.frombuffer(raw, "<i4", words, at)
    at += 4 * words
    doc = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, at).reshape(4, n).T).view("<i4").ravel()
    at += 4 * n
    known = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 2 * n, at).reshape(2, n).T).view("<u2").ravel()
    at += 2 * n
    before = np.empty(n, dtype=np.uint64)
    is_other = known == 65_535
    before[is_other] = np.frombuffer(raw, "<u8", others, at)
    if len(common):
        before[~is_other] = common[known[~is_other]]
    return np.repeat(first, times), before, doc


def score(docs: DataFrame, learn: Column, *, weight: float = WEIGHT, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores every whole text with a bigram model of the texts where ``learn`` holds.

    Returns per row ``id, learned, n_tokens, n_known, train_tokens, base_score, score``.  Tokens are the words (ASCII
    letters in lower case) and an end.  base: log10((c + 0.5) / (N + 0.5 (V + 1))) summed over tokens.  score: the
    same as the smaller model P1 of a larger one, P(w | v) = (c(vw) + weight P1(w)) / (c(v) + weight), v being the word
    before or the start of the text, its logarithms quantised in steps of 1/4096: of the larger model's counts as shares of the word's and of all tokens',
    which do not grow with the corpus.

    One shuffle brings all tokens of a word, learned from or not, to one shard, together with the word before.  The
    shard builds its trie (words, their contexts) in a file, maps it, and looks up its tokens; what it has to say of a
    text is added up by text.  Nothing that grows with the corpus is collected or broadcast: of words, only those with
    over 1/16384 of all tokens are, at most 16384.

    Null and empty texts have the end only.  Null ids: ``learn`` decides, null counting as true.  Repeated rows are
    scored each and learned from each.  Nothing to learn from: counts are 0.  Empty table: no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id).alias("id"), F.coalesce(learn, F.lit(True)).alias("learn"), F.col(text).cast("binary").alias("t"))
    unigrams = materialise(_counts(own))
    total, kinds = unigrams.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    hot_rows = unigrams.where(F.col("count") > total * HOT).collect()  # at most 1 / HOT rows
    hot = np.array(sorted((int(np.int64(r["word"]).view(np.uint64)), r["count"]) for r in hot_rows), dtype=np.uint64).reshape(-1, 2)
    common, hot_counts = hot[:, 0].copy(), hot[:, 1].astype(np.int64)
    shared = spark.sparkContext.broadcast((common, hot_counts))
    shards = max(12, shuffle_partitions(spark))
    whole = np.log10(total + 0.5 * (kinds + 1))
    kind, id_type = own.schema["id"].dataType.simpleString(), to_arrow_type(own.schema["id"].dataType)

    def whole_counts(words: np.ndarray, sums: np.ndarray) -> np.ndarray:
        is_hot, k = _hot(shared.value[0], words)
        return np.where(is_hot, shared.value[1][k] if len(shared.value[1]) else 0, sums).astype(np.int64)

    def small(counts: np.ndarray) -> np.ndarray:
        return 10.0 ** (np.log10(counts + 0.5) - whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine: dict[int, list] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                if batch.column(4)[k].is_valid:
                    mine.setdefault(batch.column(0)[k].as_py(), []).append((batch.column(1)[k].as_py(), batch.column(4)[k].as_py()))
                else:
                    yield batch.slice(k, 1).select([1, 2, 3, 4])
        common = shared.value[0]
        while mine:
            _, packs = mine.popitem()
            word, before = [], []  # of the tokens to learn from
            for _, pack in packs:
                w, v, d, learned = _opened(pack, common)
                word.append(w[learned[d]])
                before.append(v[learned[d]])
            trie = _trie(np.concatenate(word), np.concatenate(before), whole_counts, lambda c, of: np.log10((c + weight * small(of)) / (of + weight)), lambda c: np.log10((c + weight) / (total + weight)))
            del word, before
            for chunk, pack in packs:
                w, v, d, _ = _opened(pack, common)
                first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
                times = np.diff(np.r_[first, len(w)])
                at = trie.find(w[first])
                counts = np.where(at >= 0, trie.counts[at] if len(trie.counts) else 0, whole_counts(w[first], np.zeros(len(first), np.int64)))
                pair = trie.pairs(np.repeat(at, times), v)
                unseen = np.log10(weight * small(counts) / (counts + weight))
                value = np.where(pair >= 0, trie.value[pair] if len(trie.value) else 0, np.repeat(quantised(unseen), times))
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.nulls(1, pa.list_(pa.int64())), pa.nulls(1, pa.list_(id_type)), pa.array([_answer(times, counts, d, value)], pa.binary())], names=["chunk", "uids", "ids", "data"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of each text of the chunks."""
        now, sums, ids = None, None, None

        def done() -> Iterator[pa.RecordBatch]:
            if ids is not None:
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(x) for x in (sums[0].astype(np.int64), sums[1].astype(np.int64), sums[2], sums[3])]], names=["id", "n", "known", "base", "score"])

        for batch in batches:
            for k in range(batch.num_rows):
                if batch.column(0)[k].as_py() != now:
                    yield from done()
                    now, ids = batch.column(0)[k].as_py(), batch.column(2)[k].values
                    sums = np.zeros((4, len(ids)))
                else:
                    count, doc, value = _answered(batch.column(3)[k].as_py())
                    for row, x in zip(sums, (np.ones(len(doc)), count > 0, np.log10(count + 0.5), value), strict=True):
                        row += np.bincount(doc, weights=x, minlength=len(row))
        yield from done()

    told = _dealt(own, common, shards).repartition(shards, "shard").mapInArrow(run, f"chunk long, uids array<long>, ids array<{kind}>, data binary")
    parts = told.repartition(shards, "chunk").sortWithinPartitions("chunk", F.col("data").isNotNull()).mapInArrow(add, f"id {kind}, n long, known long, base double, score double")
    whole_base = float(whole)
    return parts.select(
        F.col("id").alias(id), F.col("n").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("base") - F.col("n") * F.lit(whole_base)).alias("base_score"), "score",
    )


def _opened(pack: bytes, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, the word before, text) of each token, and which texts are learned from."""
    size = int(np.frombuffer(pack, "<i8", 1)[0])
    return *_unpacked(pack[8 + size :], common), np.unpackbits(np.frombuffer(pack, np.uint8, size, 8)).astype(bool)


def _trie(word: np.ndarray, before: np.ndarray, word_count, pair_value, context_value) -> Trie:
    """Counts the pairs, writes the trie to a file of the task's own and opens it there."""
    by = np.lexsort((before, word))
    word, before = word[by], before[by]
    first = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (before[1:] != before[:-1])]) if len(word) else np.zeros(0, np.int64)
    count = np.diff(np.r_[first, len(word)]).astype(np.int64)
    built = Trie.build(word[first], before[first], count, word_count, pair_value, context_value)
    handle, path = tempfile.mkstemp(suffix=".trie")
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(built.tobytes())
        return Trie.open(path)
    finally:
        os.unlink(path)  # the map keeps it until it is closed


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    scored = score(table(spark, sf_dir, "documents").select("doc_id", "text"), ~held)
    return scored.withColumn("held_out", held)
