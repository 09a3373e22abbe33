"""Quality classifier: supervised subword embeddings trained by stochastic gradient descent."""

from __future__ import annotations

import re
import tempfile
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, table

WORDS = re.compile(r"[^\x20\x09-\x0D]+")

#: Words of more characters are hashed as arrays and kept in no lexicon.
LONG = 64

#: The buckets of the end of a text, which every text has once, and of a word that follows itself.
END, SAME = 0, 1


@dataclass(frozen=True)
class Shape:
    """Parameters of the features and of the training.  A pair of words counts ``pair`` times, beside the many n-grams of
    their characters."""

    buckets: int = 1 << 18
    min_n: int = 3
    max_n: int = 5
    pair: int = 5
    dim: int = 8
    epochs: int = 6
    rate: float = 0.8
    seed: int = 11


def subwords(word: str, shape: Shape) -> list[int]:
    """Buckets of the whole word and of its character n-grams, one by one: the rule that the arrays below follow."""
    marked, n = f"<{word}>", shape.buckets - 2
    grams = [marked[i : i + k] for k in range(shape.min_n, shape.max_n + 1) for i in range(len(marked) - k + 1)]
    return [2 + zlib.crc32(g.encode("utf-8", "surrogatepass")) % n for g in (word, *grams)]


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1).astype(np.uint32)
    return out


_CRC = _crc_table()


def _grams(data: bytes, shape: Shape, most: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: (buckets, first characters) of the n-grams of UTF-8 ``data`` that start at its first ``most``
    characters; all grow by a character at a time."""
    data = np.frombuffer(data, dtype=np.uint8)
    begin = np.flatnonzero((data & 0xC0) != 0x80)
    size = np.diff(np.r_[begin, len(data)])
    crc = np.full(min(len(begin), most or len(begin)), 0xFFFFFFFF, dtype=np.uint32)
    for k in range(min(shape.max_n, len(begin))):
        crc = crc[: len(begin) - k]
        first, bytes_of = begin[k : k + len(crc)], size[k : k + len(crc)]
        for j in range(int(bytes_of.max())):
            on = np.flatnonzero(bytes_of > j) if j else slice(None)
            crc[on] = _CRC[(crc[on] ^ data[first[on] + j]) & 0xFF] ^ (crc[on] >> 8)
        if k + 1 >= shape.min_n:
            yield 2 + (crc ^ np.uint32(0xFFFFFFFF)).astype(np.int64) % (shape.buckets - 2), np.arange(len(crc))


def streamed_subwords(word: str, shape: Shape, most: int = 1 << 18) -> Iterator[np.ndarray]:
    """The buckets of ``subwords`` by portions, for words of any length."""
    marked = f"<{word}>"
    yield np.array([2 + zlib.crc32(word.encode("utf-8", "surrogatepass")) % (shape.buckets - 2)])
    for at in range(0, len(marked), most):
        for found, _ in _grams(marked[at : at + most + shape.max_n - 1].encode("utf-8", "surrogatepass"), shape, most):
            yield found


def all_subwords(words: list[str], shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the words; buckets of all ``subwords`` of all of them, and to which word each belongs)."""
    whole = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), dtype=np.int64, count=len(words))
    found, owner = [2 + whole % (shape.buckets - 2)], [np.arange(len(words))]
    sizes = np.array([len(w) + 2 for w in words], dtype=np.int64)
    of, left = np.repeat(np.arange(len(words)), sizes), np.repeat(np.cumsum(sizes), sizes) - np.arange(sizes.sum())
    for k, (buckets, first) in enumerate(_grams("".join(f"<{w}>" for w in words).encode("utf-8", "surrogatepass"), shape), shape.min_n):
        inside = left[first] >= k  # not over the word's end
        found.append(buckets[inside])
        owner.append(of[first[inside]])
    return whole, np.concatenate(found), np.concatenate(owner)


class Lexicon(dict):
    """Word -> place in arrays of what is kept of each word: its hash, and how many n-grams it has and their values'
    sum (for training: the n-grams).  It is emptied when it holds too many.  A long word gets a place, but no entry."""

    def __init__(self, shape: Shape, value: np.ndarray | None = None, most: int = 400_000):
        self.shape, self.value, self.most = shape, value, most
        self.hashes, self.sums, self.counts = np.zeros(1024, np.uint64), np.zeros(1024), np.zeros(1024, np.int64)
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.size, self.grams = 0, []

    def places(self, words: list[str]) -> np.ndarray:
        new = [w for w in dict.fromkeys(words) if len(w) <= LONG and w not in self]
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            hashes, found, owner = all_subwords(some, self.shape)
            counts = np.bincount(owner, minlength=len(some))
            self.update(zip(some, range(self.size, self.size + len(some)), strict=True))
            if self.value is None:
                by = np.argsort(owner, kind="stable")
                self.grams += np.split(found[by].astype(np.int32), np.cumsum(counts)[:-1])
                self._add(hashes, counts, np.zeros(len(some)))
            else:
                self._add(hashes, counts, np.bincount(owner, weights=self.value[found], minlength=len(some)))
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))

    def __missing__(self, word: str) -> int:  # a long one
        total, n, kept = 0.0, 0, []
        for found in streamed_subwords(word, self.shape):
            n += len(found)
            if self.value is None:
                kept.append(found.astype(np.int32))
            else:
                total += float(self.value[found].sum(dtype=np.float64))
        if self.value is None:
            self.grams.append(np.concatenate(kept))
        self._add(*(np.array([x]) for x in (zlib.crc32(word.encode("utf-8", "surrogatepass")), n, total)))
        return self.size - 1

    def _add(self, hashes: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> None:
        end = self.size + len(hashes)
        while end > len(self.counts):
            self.hashes, self.sums, self.counts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.hashes, self.sums, self.counts))
        self.hashes[self.size : end], self.counts[self.size : end], self.sums[self.size : end] = hashes, counts, sums
        self.size = end


def split(text: str | None) -> list[str]:
    return WORDS.findall(text or "")


def pairs(first: np.ndarray, second: np.ndarray, shape: Shape) -> np.ndarray:
    """Buckets of pairs of neighbouring words, from the words' hashes.  All pairs of a word with itself share one bucket:
    what a repetition tells doesn't hang on the word, and most repeated words are met once only."""
    with np.errstate(over="ignore"):
        mixed = (first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + second.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
    return np.where(first == second, SAME, 2 + ((mixed >> np.uint64(24)) % np.uint64(shape.buckets - 2)).astype(np.int64))


@dataclass(frozen=True)
class Model:
    """What scoring needs: each bucket's vector, already multiplied with the difference of the output's two rows."""

    shape: Shape
    value: np.ndarray
    bias: float

    def scores(self, texts: Iterable[str | None], words: Lexicon) -> np.ndarray:
        found = [words.places(split(text)) for text in texts]
        if not found:
            return np.zeros(0)
        place, doc = np.concatenate(found), np.repeat(np.arange(len(found)), [len(x) for x in found])
        near = np.flatnonzero(doc[1:] == doc[:-1])
        h, where = words.hashes[place], doc[near]
        add = lambda at, x: np.bincount(at, weights=x, minlength=len(found))  # noqa: E731  one after the other, so that equal texts get equal sums
        total = float(self.value[END]) + add(doc, words.sums[place]) + self.shape.pair * add(where, self.value[pairs(h[near], h[near + 1], self.shape)])
        n = 1 + add(doc, words.counts[place]) + self.shape.pair * np.bincount(where, minlength=len(found))
        if words.size > words.most:
            words.reset()
        return 1.0 / (1.0 + np.exp(-np.clip(total / n + self.bias, -40, 40)))


def _summed(ids: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, at = np.unique(ids, return_inverse=True)
    return unique, np.bincount(at, weights=times, minlength=len(unique)).astype(np.int64)


def features(text: str | None, words: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a text, rising, and how often it has each.  ``words`` is one without values."""
    if words.size > words.most:
        words.reset()
    place = words.places(split(text))
    h = words.hashes[place]
    once, times = np.unique(place, return_counts=True)
    ids, count = _summed(np.append(pairs(h[:-1], h[1:], words.shape), END), np.append(np.full(max(0, len(h) - 1), words.shape.pair), 1))
    for at in range(0, len(once), 16_384):  # some words at a time, so that a long text takes no more memory than the buckets
        grams = [words.grams[k] for k in once[at : at + 16_384].tolist()]
        ids, count = _summed(np.concatenate([ids, *grams]), np.concatenate([count, np.repeat(times[at : at + 16_384], [len(g) for g in grams])]))
    return ids, count


def train(rows: Iterable[tuple[np.ndarray, np.ndarray, int]], shape: Shape = Shape()) -> Model:
    """Averages of learned vectors, a softmax of two outputs, and plain gradient steps, one document at a time.

    ``rows``: buckets, how often each, label.  They are kept in a scratch file of the task, not in memory."""
    rng = np.random.default_rng(shape.seed)
    ends, labels = [0], []
    with tempfile.TemporaryFile() as scratch:
        for unique, count, label in rows:
            scratch.write(np.stack([unique.astype("<i4").view("<f4"), (count / count.sum()).astype("<f4")]).tobytes())
            ends.append(ends[-1] + len(unique))
            labels.append(int(label))
        scratch.flush()
        kept = np.memmap(scratch, dtype="<f4", mode="r", shape=(2 * ends[-1],)) if labels else None
        vectors = rng.uniform(-1 / shape.dim, 1 / shape.dim, (shape.buckets, shape.dim)).astype(np.float32)
        output, bias = np.zeros((shape.dim, 2), dtype=np.float32), np.zeros(2, dtype=np.float32)
        steps, step = max(1, shape.epochs * len(labels)), 0
        for _ in range(shape.epochs):
            for i in rng.permutation(len(labels)):
                unique, share = kept[2 * ends[i] : 2 * ends[i + 1]].reshape(2, -1)
                unique = unique.view("<i4")
                rate = shape.rate * (1 - step / steps)
                step += 1
                mine = vectors[unique]
                hidden = share @ mine
                raw = hidden @ output + bias
                p = np.exp(raw - raw.max())
                p /= p.sum()
                p[labels[i]] -= 1.0
                down = output @ p
                output -= rate * np.outer(hidden, p)
                bias -= 0.1 * rate * p
                vectors[unique] = mine - rate * len(unique) ** 0.5 * share[:, None] * down[None, :]
    return Model(shape, vectors @ (output[:, 1] - output[:, 0]), float(bias[1] - bias[0]))


def labelled_sample(docs: DataFrame, labels: DataFrame, *, most: int, id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """(id, text, __label) of at most ``most`` labelled rows, those of the smallest hashes of their ids, from the rows not
    held out.  An id with both labels counts as 0; of several texts of an id the one of the smallest hash is taken."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(id).isNotNull() & ~held_out(F.col(id))).groupBy(id).agg(F.min(F.col(label).cast("int")).alias("__label"))
    picked = known.orderBy(F.xxhash64(id), id).limit(most)  # a bounded table, whatever there is
    ours = docs.select(id, text).join(F.broadcast(picked), id)
    return ours.groupBy(id, "__label").agg(F.min_by(text, F.struct(F.xxhash64(text), text)).alias(text)).select(id, text, "__label")


def held_out(id):
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, most: int = 3_000, shape: Shape = Shape(), id: str = "doc_id", text: str = "text") -> Model:
    """Trains on a sample of at most ``most`` labelled documents.  Without any, every text scores about 0.5.

    Tasks turn the sample's texts into buckets; one task, not the driver, trains on those in the order of ids.  What
    comes to the driver is a number for each bucket.
    """
    sample = labelled_sample(docs, labels, most=most, id=id, text=text)
    small_batches(docs.sparkSession)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Lexicon(shape)
        for batch in batches:
            for key, body, label in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                unique, count = features(body, words)
                yield pa.RecordBatch.from_arrays([pa.array([key], batch.schema.field(0).type), pa.array([label], pa.int32()), pa.array([unique.astype("<i4").tobytes()]), pa.array([count.astype("<i4").tobytes()])], names=["id", "label", "buckets", "times"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((np.frombuffer(u, "<i4"), np.frombuffer(t, "<i4"), label) for batch in batches for label, u, t in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True))
        model = train(rows, shape)
        yield pa.RecordBatch.from_arrays([pa.array([model.value.astype("<f4").tobytes()]), pa.array([model.bias])], names=["value", "bias"])

    kind = sample.schema[id].dataType.simpleString()
    coded = sample.mapInArrow(seen, f"id {kind}, label int, buckets binary, times binary")
    row = coded.repartition(1).sortWithinPartitions("id").mapInArrow(learn, "value binary, bias double").first()  # of a bounded sample
    if row is None:
        return train([], shape)
    return Model(shape, np.frombuffer(row["value"], "<f4"), row["bias"])


def with_score(docs: DataFrame, model: Model, *, text: str = "text", score: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` with a column ``score``, the probability of label 1.

    Null and empty texts score as the text of no words; long texts count whole; repeated rows score alike.  A column
    of that name must not be there already.
    """
    if score in docs.columns:
        raise ValueError(f"there is a column {score} already")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a table of fixed size
    small_batches(docs.sparkSession)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = shared.value
        words = Lexicon(here.shape, here.value)
        for batch in batches:
            found = pa.array(here.scores(batch.column(place).to_pylist(), words), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, score])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())]))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = with_score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
