"""N-gram Jaccard join: rare-first prefixes, length, positional and suffix filters, each pair verified once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window
from xxhash import xxh3_64_intdigest

from .common import BROADCAST_ROWS, materialise, shuffle_partitions, small_batches, swept, table, written
from .graph import TOGETHER, components, together

#: Words of a shingle, and the threshold as a fraction: shingles in both over shingles in either.
WORDS, OVER, UNDER = 5, 75, 100
#: Counters of the sketch by which shingles are ordered, each kept as one byte (2 to the power of COUNTER_BITS), and bits of the filter of needed documents.
COUNTER_BITS, FILTER_BITS = 24, 1 << 24
COUNTERS = 1 << COUNTER_BITS
#: Lists of a bucket are taken whole where that makes at most so many pairs for each row, after trying so many; else by
#: stars, in so many turns, of which the last takes all lists whole.
FEW, TRIED, TURNS = 8, 4096, 3
#: Sets of a list that are held against the others in a turn of stars; of a set's pairs, those met in most lists are tried.
LEADS = 8
#: Least shingles of a set by which it is told into which star of a list it may belong.
SIGNS = 8
#: Pairs of one set that are verified in one task.
SHARE = 256
#: Slices of the sketch, and to which power of 2 packs of tasks are put together at once.
SLICES, FAN_BITS = 16, 6
#: Sets, and shingles of all of them, of a block in which links are counted at once.
BLOCK_SETS, BLOCK_SHINGLES = 256, 1 << 17

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingles(text: bytes | None) -> np.ndarray:
    """The set of 64-bit hashes of a text's shingles, sorted.  A text of fewer words has one of all its words; without
    words the set is empty.  Two different shingles of a corpus of n share a hash with a chance of n² / 2⁶⁵."""
    words = (text or b"").lower().split()  # of bytes: ASCII letters and ASCII white space only
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        h = np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=n)
        size = min(n, WORDS)
        out = h[: n - size + 1].copy()
        for k in range(1, size):
            out = _mixed(out * _MIX + h[k : n - size + 1 + k])
        return np.unique(_mixed(out + np.uint64(size)))


def class_of(found: np.ndarray) -> int:
    """A set's name: 64 bits of its hash, as a signed number."""
    return int.from_bytes(blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)


def least_overlap(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The shared shingles that sets of these sizes need: i with 100 i >= 75 (n + m - i)."""
    return -(-OVER * (n + m) // (OVER + UNDER))


def prefix_size(n: int) -> int:
    return n - -(-OVER * n // UNDER) + 1


def _parts(found: np.ndarray) -> np.ndarray:
    """How many shingles of a set fall into each of some parts of all shingles, a power of 2 of them, so many that a part
    holds two to four; 255 stands for that and more."""
    bits = max(0, len(found).bit_length() - 2)
    return np.minimum(np.bincount((found >> np.uint64(8)).astype(np.int64) & ((1 << bits) - 1), minlength=1 << bits), 255).astype(np.uint8)


def _may_share(x: np.ndarray, y: np.ndarray) -> int:
    """More than sets of these parts can share, or as much: in no part more than the smaller has.  The finer is folded."""
    x, y = x.astype(np.int64), y.astype(np.int64)
    while len(x) > len(y):
        x = x.reshape(2, -1).sum(0)
    while len(y) > len(x):
        y = y.reshape(2, -1).sum(0)
    if max(x.max(), y.max()) >= 255:
        return int(1 << 62)
    return int(np.minimum(x, y).sum())


def _binary(docs: DataFrame, id: str, text: str) -> DataFrame:
    return docs.select(F.col(id).alias("id"), F.col(text).cast("binary").alias("t"), F.xxhash64(text).alias("h"))


def _counter(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def _members(docs: DataFrame) -> DataFrame:
    """(id, h, n, cls, parts) of each document, and rows of counts of shingles (slice, task, counts), from one pass."""
    kind = docs.schema["id"].dataType.simpleString()
    names = ["id", "h", "n", "cls", "parts", "slice", "task", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen, idtype = np.zeros(COUNTERS, dtype=np.int32), set(), None
        for batch in batches:
            idtype = batch.schema.field("id").type
            ns, classes, parts, fresh = [], [], [], []
            for text in batch.column(1).to_pylist():
                found = shingles(text)
                ns.append(len(found))
                classes.append(name := class_of(found) if len(found) else None)
                parts.append(_parts(found).tobytes() if len(found) else None)
                if name is not None and name not in seen:
                    seen.add(name)
                    fresh.append(found)
            if fresh:
                places, times = np.unique(_counter(np.concatenate(fresh)), return_counts=True)
                counts[places] += times.astype(np.int32)
            n = len(ns)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(ns, pa.int64()), pa.array(classes, pa.int64()), pa.array(parts, pa.binary()), *[pa.nulls(n, pa.int32())] * 2, pa.nulls(n, pa.binary())], names=names)
        if seen:
            packs, task = [zstandard.compress(x.tobytes(), 1) for x in np.split(counts, SLICES)], TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.nulls(SLICES, idtype), *[pa.nulls(SLICES, pa.int64())] * 3, pa.nulls(SLICES, pa.binary()), pa.array(range(SLICES), pa.int32()), pa.array([task] * SLICES, pa.int32()), pa.array(packs, pa.binary())], names=names)

    return docs.mapInArrow(run, f"id {kind}, h long, n long, cls long, parts binary, slice int, task int, counts binary")


def _merged(rows: DataFrame, add) -> DataFrame:
    """Of (slice, task, data) one row for each slice: packs of equal size are put together by ``add``, those of up to
    ``FAN`` tasks first, so that no task takes one from every task there was."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for k, task, packed in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                mine = np.frombuffer(zstandard.decompress(packed), dtype=np.uint8)
                total[k, task] = add(total[k, task], mine) if (k, task) in total else mine
        for (k, task), x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([task], pa.int32()), pa.array([zstandard.compress(x.tobytes(), 1)])], names=["slice", "task", "data"])

    shape, n = "slice int, task int, data binary", shuffle_partitions(rows.sparkSession)
    some = rows.select("slice", F.shiftright("task", FAN_BITS).alias("task"), "data").repartition(n, "slice", "task").mapInArrow(run, shape)
    return some.select("slice", F.lit(0).alias("task"), "data").repartition(n, "slice").mapInArrow(run, shape)


def _sketch(rows: DataFrame) -> np.ndarray:
    """Of each counter the sum of all tasks, by its logarithm in one byte; its size is fixed."""
    add = lambda x, y: (x.view(np.int32) + np.minimum(y.view(np.int32), np.iinfo(np.int32).max - x.view(np.int32))).view(np.uint8)
    out = np.zeros((SLICES, COUNTERS // SLICES), dtype=np.uint8)
    for row in _merged(rows.select("slice", "task", F.col("counts").alias("data")), add).toLocalIterator():  # as many rows as slices
        out[row["slice"]] = np.minimum(8 * np.log2(1 + np.frombuffer(zstandard.decompress(row["data"]), dtype=np.int32)), 255)
    return out.ravel()


def _signs(found: np.ndarray) -> np.ndarray:
    """The least shingle of each of ``SIGNS`` classes of shingles, 16 bits of it: alike in two sets about as often as they
    share shingles."""
    of, out = (found >> np.uint64(3)).astype(np.int64) % SIGNS, np.zeros(SIGNS, dtype=np.uint16)
    at, first = np.unique(of, return_index=True)  # sets are sorted
    out[at] = (_mixed(found[first]) >> np.uint64(24)).astype(np.uint16)
    return out


def _lists(docs: DataFrame, sketch: np.ndarray) -> DataFrame:
    """(sh, cls, n, pos) of every shingle that stands in two prefixes at least, and pairs (a, b) with how many lists have
    them: of each list the stars of the sets that show the same sign.

    A task packs its postings by the bucket of their shingle; sets that it has met before add none.  A bucket's task
    sorts them and drops the shingles of one set.
    """
    spark = docs.sparkSession
    shared, buckets = spark.sparkContext.broadcast(sketch), 2 * shuffle_partitions(spark)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen, waiting, held = shared.value, set(), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            if not waiting:
                return
            sizes = [len(s) for s, *_ in waiting]
            sh = np.concatenate([s for s, *_ in waiting])
            of = np.repeat(np.arange(len(waiting), dtype=np.int32), sizes)
            pos = np.concatenate([np.arange(k, dtype=np.int32) for k in sizes])
            cls, n = np.array([c for _, c, *_ in waiting], dtype=np.int64), np.array([k for _, _, k, _ in waiting], dtype=np.int32)
            sign = np.stack([x for *_, x in waiting])[of, (sh % np.uint64(SIGNS)).astype(np.int64)]
            to = _bucket(sh, buckets)
            by = np.lexsort((sh, to))
            ends = np.searchsorted(to[by], np.arange(buckets + 1))
            for k in range(buckets):
                if (mine := by[ends[k] : ends[k + 1]]).size:
                    data = _packed(sh[mine], of[mine], pos[mine], sign[mine], cls, n)
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([data], pa.binary())], names=["bucket", "data"])
            waiting.clear()

        for batch in batches:
            for text in batch.column(1).to_pylist():
                found = shingles(text)
                if not len(found) or (name := class_of(found)) in seen:
                    continue
                seen.add(name)
                rare = np.lexsort((found, order[_counter(found)]))[: prefix_size(len(found))]
                waiting.append((found[rare], name, len(found), _signs(found)))
                held += len(rare)
            if held > 1 << 21:
                yield from flush()
                held = 0
        yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for mine in _by_bucket(batches):
            sh, cls, n, pos, sign = (np.concatenate(x) for x in zip(*map(_unpacked, mine), strict=True))
            by = np.lexsort((cls, sh))
            sh, cls, n, pos, sign = sh[by], cls[by], n[by], pos[by], sign[by]
            again = np.zeros(len(sh), dtype=bool)  # what several tasks found of one set
            again[1:] = (sh[1:] == sh[:-1]) & (cls[1:] == cls[:-1])
            many = ~again
            sh, cls, n, pos, sign = (x[many] for x in (sh, cls, n, pos, sign))
            same = sh[1:] == sh[:-1]
            many = np.zeros(len(sh), dtype=bool)
            many[1:] |= same
            many[:-1] |= same
            sh, cls, n, pos, sign = (x[many] for x in (sh, cls, n, pos, sign))
            for at in range(0, len(sh), 100_000):
                some, none = slice(at, at + 100_000), pa.nulls(min(100_000, len(sh) - at), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(sh[some].view(np.int64)), pa.array(cls[some]), pa.array(n[some]), pa.array(pos[some]), none, none, none], names=names)
            a, b, times = _starred(sh, sign, cls, n, pos)
            if len(a):
                none, none4 = pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int32())
                yield pa.RecordBatch.from_arrays([none, none, none4, none4, pa.array(a), pa.array(b), pa.array(times)], names=names)

    names = ["sh", "cls", "n", "pos", "a", "b", "times"]
    packs = docs.mapInArrow(emit, "bucket int, data binary").repartition(shuffle_partitions(spark), "bucket")
    return packs.mapInArrow(meet, "sh long, cls long, n int, pos int, a long, b long, times long")


def _bucket(sh: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of shingles."""
    return ((sh >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """The packs of each bucket (the first column) of a task."""
    packs: dict[int, list[bytes]] = {}
    for batch in batches:
        for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            packs.setdefault(k, []).append(data)
    while packs:
        yield packs.popitem()[1]


def _planes(x: np.ndarray) -> bytes:
    """All first bytes of the numbers, then all second ones: what is often zero lies together."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _packed(sh: np.ndarray, of: np.ndarray, pos: np.ndarray, sign: np.ndarray, cls: np.ndarray, n: np.ndarray) -> bytes:
    """Postings sorted by shingle, as steps from one to the next; the sets (cls, n) that they are of stand once."""
    here, place = np.unique(of, return_inverse=True)
    step = np.diff(sh, prepend=np.uint64(0))
    head = np.array([len(sh), len(here)], dtype="<i8").tobytes()
    return zstandard.compress(head + b"".join([_planes(step), _planes(place.astype("<u4")), _planes(pos.astype("<u4")), sign.astype("<u2").tobytes(), cls[here].tobytes(), _planes(n[here].astype("<u4"))]), 3)


def _unpacked(data: bytes) -> tuple[np.ndarray, ...]:
    raw, at = zstandard.decompress(data), 16
    size, sets = np.frombuffer(raw, "<i8", 2).tolist()

    def next_planes(count: int, kind: str) -> np.ndarray:
        nonlocal at
        width = np.dtype(kind).itemsize
        out = np.ascontiguousarray(np.frombuffer(raw, np.uint8, count * width, at).reshape(width, count).T).view(kind).ravel()
        at += count * width
        return out

    sh, place, pos = np.cumsum(next_planes(size, "<u8"), dtype=np.uint64), next_planes(size, "<u4"), next_planes(size, "<u4")
    sign = np.frombuffer(raw, "<u2", size, at)
    cls = np.frombuffer(raw, "<i8", sets, at := at + 2 * size)
    at += 8 * sets
    n = next_planes(sets, "<u4").astype(np.int32)
    return sh, cls[place], n[place], pos.astype(np.int32), sign


def _near(n: np.ndarray, p: np.ndarray, m: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Which pairs of sets of sizes n and m, that share a shingle at places p and q of their prefixes, pass the length
    filter and the positional one.  Two sets that link meet in the list of the first shingle that they share too, where
    all others that they share stand after it in both; so that is asked for in every list."""
    n, p, m, q = (x.astype(np.int64) for x in (n, p, m, q))
    room = 1 + np.minimum(n - p - 1, m - q - 1)
    return (UNDER * np.minimum(n, m) >= OVER * np.maximum(n, m)) & (room >= least_overlap(n, m))


def _prefixes(postings: DataFrame) -> DataFrame:
    """A row for each set: (cls, n, sh, pos), its shared shingles and their places."""
    both = postings.groupBy("cls").agg(F.first("n").alias("n"), F.collect_list(F.struct("sh", "pos")).alias("x"))
    return written(both.select("cls", "n", F.transform("x", lambda y: y["sh"]).alias("sh"), F.transform("x", lambda y: y["pos"]).alias("pos")), "prefixes")


def _candidates(prefixes: DataFrame, comps: DataFrame, turn: int, last: bool) -> DataFrame:
    """Pairs (a, b) of different components and how many stars of lists have them (0: of lists taken whole), and a row per
    bucket with whether pairs are ``left``.

    Sets take their components along (a join of sets, not of shingles), their shingles are packed by bucket, and each
    bucket's task forms the lists.  In a list of one component there is nothing to do.  Of the others all pairs of
    different components are made, if they are few beside the rows or this is the ``last`` turn; else those of some sets of
    a list and each range of sizes with the others, which ``turn`` chooses, and some are left.
    """
    spark = prefixes.sparkSession
    buckets = 2 * shuffle_partitions(spark)
    labelled = prefixes.join(F.broadcast(comps) if comps.count() <= BROADCAST_ROWS else comps, prefixes["cls"] == comps["node"], "left").select("cls", F.coalesce("comp", "cls").alias("comp"), "n", "sh", "pos")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(3).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            if not sizes.sum():
                continue
            sh, pos = (batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in (3, 4))
            cls, comp, n = (np.repeat(batch.column(k).to_numpy(zero_copy_only=False), sizes) for k in (0, 1, 2))
            to = _bucket(sh.view(np.uint64), buckets)
            by = np.argsort(to, kind="stable")
            ends = np.searchsorted(to[by], np.arange(buckets + 1))
            for k in range(buckets):
                if (mine := by[ends[k] : ends[k + 1]]).size:
                    data = np.array([len(mine)], "<i8").tobytes() + b"".join(x[mine].tobytes() for x in (sh, cls, comp, n.astype(np.int32), pos.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zstandard.compress(data, 1)], pa.binary())], names=["bucket", "data"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for mine in _by_bucket(batches):
            parts = []
            for raw in map(zstandard.decompress, mine):
                (size,) = np.frombuffer(raw, "<i8", 1).tolist()
                parts.append([np.frombuffer(raw, t, size, 8 + at * size) for t, at in ((np.uint64, 0), (np.int64, 8), (np.int64, 16), (np.int32, 24), (np.int32, 28))])
            sh, cls, comp, n, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
            by = np.lexsort((cls, n, sh))
            sh, cls, comp, n, pos = (x[by] for x in (sh, cls, comp, n, pos))
            begin = np.flatnonzero(np.r_[True, sh[1:] != sh[:-1]])
            mixed = np.minimum.reduceat(comp, begin) != np.maximum.reduceat(comp, begin)
            on = np.repeat(mixed, np.diff(np.r_[begin, len(sh)]))
            rows = [x[on] for x in (sh, comp, cls, n, pos)]
            if last:
                all4 = _counted_pairs(rows)
            elif (pairs := _whole(rows)) is not None:
                all4 = _no_need(*pairs, 0)
            else:
                sh, comp, cls, n, pos = rows
                span = np.floor(np.log(n.astype(float)) * 3 + turn / 3).astype(np.int64)
                with np.errstate(over="ignore"):
                    rank = _mixed(cls.view(np.uint64) + np.uint64(turn) * _MIX)
                all4 = _no_need(*_starred(sh, span, cls, n, pos, rank, comp, LEADS))
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.array([1], pa.int32())], names=["to", "data", "left"])
            if not len(all4):
                continue
            a, b = (all4[:, k].astype(np.uint64) for k in (0, 1))
            with np.errstate(over="ignore"):
                to = (_mixed(a * _MIX + b) % np.uint64(parts_of)).astype(np.int64)
            by = np.argsort(to, kind="stable")
            all4 = all4[by]
            ends = np.searchsorted(to[by], np.arange(parts_of + 1))
            some = np.flatnonzero(np.diff(ends))
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([zstandard.compress(all4[ends[k] : ends[k + 1]].tobytes(), 1) for k in some.tolist()], pa.binary()), pa.nulls(len(some), pa.int32())], names=["to", "data", "left"])

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        for batch in batches:
            for data, left in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if data is None:
                    yield pa.RecordBatch.from_arrays([*[pa.nulls(1, pa.int64())] * 3, pa.array([left], pa.int32())], names=["a", "b", "times", "left"])
                else:
                    kept.append(np.frombuffer(zstandard.decompress(data), dtype=np.int64).reshape(-1, 4))
                    if sum(map(len, kept[1:])) > 1 << 20:
                        kept = [_summed_pairs(kept)]
        if kept:
            a, b, times, need = _summed_pairs(kept).T
            on = (need == 0) | ((times & 0xFFFFFFFF) >= need) & (times >> 32 > 0)
            yield _pair_rows(a[on], b[on], np.where(need > 0, 0, times)[on])

    parts_of = shuffle_partitions(spark)
    packs = labelled.mapInArrow(emit, "bucket int, data binary").repartition(parts_of, "bucket").mapInArrow(meet, "to int, data binary, left int")
    return packs.repartition(parts_of, "to").mapInArrow(once, "a long, b long, times long, left int")


def _summed_pairs(rows: list[np.ndarray]) -> np.ndarray:
    """(a, b, times) with each pair once, and what else the rows say of their pairs, which is the same in all."""
    x = np.concatenate(rows)
    if not len(x):
        return x
    x = x[np.lexsort((x[:, 1], x[:, 0]))]
    first = np.flatnonzero(np.r_[True, (x[1:, :2] != x[:-1, :2]).any(1)])
    return np.column_stack([x[first, :2], np.add.reduceat(x[:, 2], first), x[first, 3:]])


def _pair_rows(a: np.ndarray, b: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(times), pa.nulls(len(a), pa.int32())], names=["a", "b", "times", "left"])


def _no_need(a: np.ndarray, b: np.ndarray, times: np.ndarray | int) -> np.ndarray:
    """Rows as of ``_counted_pairs``, of pairs of which not all lists are seen."""
    return np.column_stack([a, b, np.broadcast_to(times, len(a)), np.zeros(len(a), np.int64)])


def _whole(rows: list[np.ndarray], anyhow: bool = False) -> tuple[np.ndarray, np.ndarray] | None:
    """All pairs of the lists, each once; or, if they are many beside the rows and needn't be made ``anyhow``, None."""
    if not anyhow and _width(rows)[1].sum() > TRIED * len(rows[0]):
        return None
    made, fresh = np.zeros(0, np.int64), []
    sets, place = np.unique(rows[2], return_inverse=True)
    for x, y in _crossed(rows):
        x, y = place[x], place[y]
        fresh.append(np.unique(np.minimum(x, y) * len(sets) + np.maximum(x, y)))
        if sum(map(len, fresh)) > 1 << 21:
            made, fresh = np.unique(np.concatenate([made, *fresh])), []
            if not anyhow and len(made) > FEW * len(rows[0]):
                return None
    made = np.unique(np.concatenate([made, *fresh]))
    if not anyhow and len(made) > FEW * len(rows[0]):
        return None
    return (sets[made // len(sets)], sets[made % len(sets)]) if len(sets) else (rows[2], rows[2])


def _starred(sh: np.ndarray, group: np.ndarray, cls: np.ndarray, n: np.ndarray, pos: np.ndarray, rank: np.ndarray | None = None, comp: np.ndarray | None = None, leads: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each list, and each group in it, the pairs of its first ``leads`` sets (by ``rank``, then ``cls``) with those
    after them, or with those of other components; and how often each pair was met."""
    by = np.lexsort((cls, cls if rank is None else rank, group, sh))
    sh, group, cls, n, pos = (x[by] for x in (sh, group, cls, n, pos))
    names = cls if comp is None else comp[by]
    first = np.flatnonzero(np.r_[True, (sh[1:] != sh[:-1]) | (group[1:] != group[:-1])]) if len(sh) else np.zeros(0, np.int64)
    start = np.repeat(first, np.diff(np.r_[first, len(sh)]))
    found = []
    for k in range(leads):
        own = np.flatnonzero(np.arange(len(sh)) - start > k)
        lead = start[own] + k
        keep = (names[own] != names[lead]) & _near(n[own], pos[own], n[lead], pos[lead])
        both, times = np.unique(np.stack([cls[lead][keep], cls[own][keep]], axis=1), axis=0, return_counts=True)
        found.append(np.column_stack([both, times]))
    a, b, times = _summed_pairs(found).T
    return a, b, times


def _width(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which rows can be the smaller set of a pair, by their place, and how many rows after each are in its list and
    not too large.  Rows are sorted by list and size."""
    sh, _, _, n, pos = rows
    size = n.astype(np.int64)
    small = np.flatnonzero(size - pos >= least_overlap(size, size))
    lists = np.cumsum(np.r_[0, sh[1:] != sh[:-1]]) if len(sh) else np.zeros(0, np.int64)
    key = (lists << 32) + size
    return small, np.searchsorted(key, (lists[small] << 32) + UNDER * size[small] // OVER, side="right") - small - 1


def _crossed(rows: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs of rows of one list and different components that pass the filters; rows are sorted by list and
    size."""
    _, comp, _, n, pos = rows
    small, width = _width(rows)
    for ends in _portions(width, 1 << 20):
        own, wide = small[slice(*ends)], width[slice(*ends)]
        x = np.repeat(own, wide)
        if not len(x):
            continue
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(wide) - wide, wide)
        keep = (comp[x] != comp[y]) & _near(n[x], pos[x], n[y], pos[y])
        if keep.any():
            yield x[keep], y[keep]


def _counted_pairs(rows: list[np.ndarray]) -> np.ndarray:
    """(a, b, count, need) of all pairs of the lists whose sets are of different components and whose sizes allow a link.

    ``count`` is how many lists both stand in, and 2^32 for each of those where the positional filter lets them pass.
    ``need`` is how many shingles of their prefixes linked sets share at least: of the two prefixes, what one set has
    after the one that ends first is all that they can share besides.
    """
    sh, comp, cls, n, pos = rows
    sets, index, place = np.unique(cls, return_index=True, return_inverse=True)
    size = n.astype(np.int64)
    key = (np.cumsum(np.r_[0, sh[1:] != sh[:-1]]) << 32 if len(sh) else np.zeros(0, np.int64)) + size
    width = np.searchsorted(key, key - size + UNDER * size // OVER, side="right") - np.arange(len(key)) - 1
    done, fresh = [np.zeros((0, 3), np.int64)], 0
    for begin, end in _portions(width, 1 << 20):
        wide = width[begin:end]
        x = np.repeat(np.arange(begin, end), wide)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(wide) - wide, wide)
        apart = comp[x] != comp[y]
        x, y = x[apart], y[apart]
        times = 1 + (_near(n[x], pos[x], n[y], pos[y]).astype(np.int64) << 32)
        x, y = place[x], place[y]
        done.append(_summed_pairs([np.column_stack([np.minimum(x, y), np.maximum(x, y), times])]))
        fresh += len(done[-1])
        if fresh > 1 << 21:
            done, fresh = [_summed_pairs(done)], 0
    x, y, count = _summed_pairs(done).T
    n, m = size[index][x], size[index][y]
    long = np.maximum(n, m)
    need = np.maximum(1, least_overlap(n, m) - (long - prefix_size(long)))
    return np.column_stack([sets[x], sets[y], count, need])


def _portions(width: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    total, at = np.r_[0, np.cumsum(width)], 0
    while at < len(width):
        end = max(at + 1, int(np.searchsorted(total, total[at] + most, side="right")) - 1)
        yield at, end
        at = end


def _needed(ids: DataFrame) -> np.ndarray:
    """A filter of fixed size that holds all of the ids: tasks fill one each, which are joined bit by bit."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
        for batch in batches:
            for h in _spots(batch.column(0).to_numpy(zero_copy_only=False)):
                np.bitwise_or.at(bits, h >> 3, (1 << (h & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([zstandard.compress(bits.tobytes(), 1)], pa.binary())], names=["slice", "task", "data"])

    filled = _merged(ids.mapInArrow(fill, "slice int, task int, data binary"), np.bitwise_or)
    found = filled.first()
    return np.frombuffer(zstandard.decompress(found["data"]), dtype=np.uint8) if found else np.zeros(FILTER_BITS // 8, dtype=np.uint8)


def _spots(hashes: np.ndarray) -> list[np.ndarray]:
    h = hashes.astype(np.int64).view(np.uint64)
    return [((h >> np.uint64(s)) % np.uint64(FILTER_BITS)).astype(np.int64) for s in (0, 20, 40)]


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cls, set) of the wanted documents (id, cls), from the texts.  Which texts to look at is told by the filter; the
    few that it lets through besides go in the join."""
    shared = docs.sparkSession.sparkContext.broadcast(_needed(wanted.select(F.xxhash64("id"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = shared.value, set()
        for batch in batches:
            on = np.ones(batch.num_rows, dtype=bool)
            for h in _spots(batch.column(1).to_numpy(zero_copy_only=False)):
                on &= (bits[h >> 3] >> (h & 7).astype(np.uint8) & 1).astype(bool)
            for text in batch.column(2).filter(pa.array(on)).to_pylist():
                found = shingles(text)
                if len(found) and (name := class_of(found)) not in seen:
                    seen.add(name)
                    yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([found.tobytes()], pa.binary())], names=["cls", "set"])

    found = docs.select("id", F.xxhash64("id").alias("h"), "t").mapInArrow(run, "cls long, set binary")
    return found.join(wanted.select("cls").distinct(), "cls", "left_semi").dropDuplicates(["cls"])


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, kept: list[DataFrame]) -> DataFrame:
    """The pairs (a, b) that link.  ``kept``: tables of sets looked up before, to which this adds one if it needs more.  The suffix filter comes first: sets dealt into parts by hash share no more in a part
    than the smaller share has.  The rest are looked up and intersected."""
    info = classes.select("cls", "n", "parts", "rep")
    both = pairs.join(info.select(F.col("cls").alias("a"), F.col("n"), F.col("parts").alias("x"), F.col("rep").alias("ra")), "a").join(info.select(F.col("cls").alias("b"), F.col("n").alias("m"), F.col("parts").alias("y"), F.col("rep").alias("rb")), "b")
    kind = classes.schema["rep"].dataType.simpleString()

    def suffix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, m = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            most = [_may_share(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            yield batch.filter(pa.array(np.array(most) >= least_overlap(n, m))).select([0, 1, 6, 7])

    left = materialise(both.select("a", "b", "n", "m", "x", "y", "ra", "rb").mapInArrow(suffix, f"a long, b long, ra {kind}, rb {kind}"))
    wanted = left.select(F.col("ra").alias("id"), F.col("a").alias("cls")).unionByName(left.select(F.col("rb").alias("id"), F.col("b").alias("cls"))).distinct()
    for before in kept:
        wanted = wanted.join(before.select("cls"), "cls", "left_anti")
    wanted = materialise(wanted.select("id", "cls"))
    if not wanted.isEmpty():
        kept.append(written(_sets(docs, wanted), "sets"))
    sets = reduce(DataFrame.unionByName, kept)

    # Pairs meet by their first set, which stands before its others; where it has many, in several tasks.
    counted = left.groupBy("a").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares"))
    dealt = left.select("a", "b").join(counted, "a").withColumn("share", F.pmod(F.xxhash64("b"), F.col("shares")).cast("int"))
    firsts = counted.join(sets, counted["a"] == sets["cls"]).select("a", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(None).cast("long").alias("b"), "set")
    others = dealt.join(sets, dealt["b"] == sets["cls"]).select("a", "share", "b", "set")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = None
        for batch in batches:
            on = []
            for b, data in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                y = np.frombuffer(data, np.uint64)
                if b is None:
                    x = y
                    on.append(False)
                else:
                    k = np.minimum(np.searchsorted(x, y), len(x) - 1)
                    shared = int((x[k] == y).sum())
                    on.append(UNDER * shared >= OVER * (len(x) + len(y) - shared))
            yield batch.filter(pa.array(on, pa.bool_())).select([0, 2])

    rows = firsts.unionByName(others).repartition(shuffle_partitions(docs.sparkSession), "a", "share").sortWithinPartitions("a", "share", F.col("b").asc_nulls_first())
    return materialise(rows.mapInArrow(check, "a long, b long"))


def _overlaps(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of ``xs`` shares with each of ``ys``: products of matrices, some columns at a time."""
    vocabulary = np.intersect1d(np.concatenate(xs), np.concatenate(ys))
    out, width = np.zeros((len(xs), len(ys)), dtype=np.int64), max(1, (1 << 21) // max(len(xs), len(ys)))
    if not len(vocabulary):
        return out

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        row, found = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
        k = np.minimum(np.searchsorted(vocabulary, found), len(vocabulary) - 1)
        on = vocabulary[k] == found
        by = np.argsort(k[on], kind="stable")
        return row[on][by], k[on][by]

    sides = [(len(xs), *places(xs)), (len(ys), *places(ys))]
    for at in range(0, len(vocabulary), width):
        dense = []
        for n, row, k in sides:
            a, b = np.searchsorted(k, (at, at + width))
            some = np.zeros((n, min(width, len(vocabulary) - at)), dtype=np.float32)  # exact: at most 2^21 ones are added
            some[row[a:b], k[a:b] - at] = 1
            dense.append(some)
        out += (dense[0] @ dense[1].T).astype(np.int64)
    return out


def _linked(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """For each set of ``xs``, how many of ``ys`` reach the threshold with it."""
    shared = _overlaps(xs, ys)
    n, m = (np.array([len(s) for s in sets]) for sets in (xs, ys))
    return (UNDER * shared >= OVER * (n[:, None] + m[None, :] - shared)).sum(1)


def _block(names: list[int], sets: list[np.ndarray]) -> bytes:
    vocabulary, codes = np.unique(np.concatenate(sets), return_inverse=True)
    head = np.array([len(sets), len(vocabulary)], dtype="<i8")
    parts = (head, np.array(names, dtype="<i8"), np.array([len(s) for s in sets], dtype="<i8"), vocabulary.astype("<u8"), codes.astype("<u4"))
    return zstandard.compress(b"".join(x.tobytes() for x in parts), 1)


def _unblock(data: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
    raw = zstandard.decompress(data)
    n, m = np.frombuffer(raw, "<i8", 2).tolist()
    names, sizes = np.frombuffer(raw, "<i8", n, 16), np.frombuffer(raw, "<i8", n, 16 + 8 * n)
    vocabulary = np.frombuffer(raw, "<u8", m, 16 + 16 * n)
    return names, np.split(vocabulary[np.frombuffer(raw, "<u4", offset=16 + 16 * n + 8 * m)], np.cumsum(sizes)[:-1])


def _counted(comps: DataFrame, classes: DataFrame, kept: list[DataFrame]) -> DataFrame:
    """(cls, n_links) of every class of a component: how many other classes of it reach the threshold with it.

    No link leaves a component, so all pairs of one are all that there is to see.  They never become rows: classes are
    dealt by component and size into blocks, each block is held against itself and against those of its component of
    which the sizes allow a link, and what is kept is a count for each class.
    """
    spark = comps.sparkSession
    most, room = BLOCK_SETS, BLOCK_SHINGLES
    own = comps.select(F.col("node").alias("cls"), "comp").join(classes.select("cls", "n"), "cls")
    loaded = reduce(DataFrame.unionByName, kept).join(own, "cls").select("comp", "cls", "n", "set")
    dealt = loaded.repartitionByRange(shuffle_partitions(spark), "comp", "n", "cls").sortWithinPartitions("comp", "n", "cls")

    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, first = TaskContext.get().partitionId() << 32, 0, None
        now, names, sets, held, parts = None, [], [], 0, 0

        def close(ended: bool) -> Iterator[pa.RecordBatch]:
            nonlocal made, held, parts
            n = len(names)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(_linked(sets, sets) - 1), *[pa.nulls(n, pa.int64())] * 4, pa.nulls(n, pa.binary())], names=["cls", "links", "comp", "block", "lo", "hi", "data"])
            if not (ended and parts == 0 and now != first):  # else the component has this block only
                row = [None, None, now, part + made, len(sets[0]), len(sets[-1])]
                yield pa.RecordBatch.from_arrays([*[pa.array([x], pa.int64()) for x in row], pa.array([_block(names, sets)], pa.binary())], names=["cls", "links", "comp", "block", "lo", "hi", "data"])
            made, held, parts = made + 1, 0, parts + 1
            names.clear()
            sets.clear()

        for batch in batches:
            for comp, name, data in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
                found = np.frombuffer(data, np.uint64)
                if names and (comp != now or len(names) == most or held + len(found) > room):
                    yield from close(comp != now)
                if comp != now:
                    first, now, parts = comp if now is None else first, comp, 0
                names.append(name)
                sets.append(found)
                held += len(found)
        if names:
            yield from close(False)

    made = materialise(dealt.mapInArrow(form, "cls long, links long, comp long, block long, lo long, hi long, data binary"))
    blocks = made.where("data IS NOT NULL").select("comp", "block", "lo", "hi", "data")
    one, other = (blocks.select("comp", *[F.col(c).alias(f"{c}{k}") for c in ("block", "lo", "hi")]) for k in (1, 2))
    pairs = one.join(other, "comp").where(f"block1 <> block2 AND {UNDER} * hi1 >= {OVER} * lo2 AND {UNDER} * hi2 >= {OVER} * lo1")
    against = pairs.select("block1", F.col("block2").alias("block")).join(blocks.select("block", "data"), "block").select("block1", F.lit(1).alias("k"), "data")
    rows = blocks.select(F.col("block").alias("block1"), F.lit(0).alias("k"), "data").unionByName(against)

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, sets, total = None, None, None

        def done() -> Iterator[pa.RecordBatch]:
            if names is not None and total.any():
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(total)], names=["cls", "links"])

        for batch in batches:
            for k, data in zip(batch.column(1), batch.column(2), strict=True):  # a block, then those it is held against
                if not k.as_py():
                    yield from done()
                    names, sets = _unblock(data.as_py())
                    total = np.zeros(len(names), dtype=np.int64)
                else:
                    total += _linked(sets, _unblock(data.as_py())[1])
        yield from done()

    across = rows.repartition(shuffle_partitions(spark), "block1").sortWithinPartitions("block1", "k").mapInArrow(hold, "cls long, links long")
    return made.where("cls IS NOT NULL").select("cls", "links").unionByName(across).groupBy("cls").agg(F.sum("links").alias("n_links"))


def join(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id, n_shingles, component_id, n_links``, and ``__text``, the text's hash, and ``__comp``,
    which tells components apart where rows share an id (null without shingles).

    Documents link when their sets of shingles of five words (ASCII letters in lower case) have a Jaccard similarity of
    0.75 or more; ``component_id`` is the smallest id that links reach.  Equal sets are one class, which is all that
    the join sees.  ``n_links`` counts the other classes that link to a document's class, all of them: components are found
    from as few pairs as will do, then the links within each are counted, without a row for each.

    Candidates come from prefixes: sets in the order of a sketch of their shingles' counts, rarest first, and so short
    that two linked sets share a shingle of their prefixes.  To keep large groups of near copies from making all their
    pairs, a list's sets are first held against one or a few of them (stars), by turns with another choice; then against
    every set that is in another component still, so that no link between components is missed.

    Null and empty texts, and texts without words: no shingles, a component each by its own id.  Null ids: rows of
    their own, but none is a component's smallest unless all are null.  Repeated rows and ids are kept.  Empty table:
    no rows.  Very long texts count whole.
    """
    members, classes, comps, kept = _components(docs, id, text)
    return _result(members, classes, comps, _counted(comps, classes, kept) if kept else None, id)


def _components(docs: DataFrame, id: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame, list[DataFrame]]:
    """(members, classes, components of the classes that link, tables with at least those classes' sets)."""
    spark = docs.sparkSession
    small_batches(spark)
    own = _binary(docs, id, text)
    first = written(_members(own), "members")
    members = first.where("slice IS NULL").select("id", "h", "n", "cls", "parts")
    classes = materialise(members.where("cls IS NOT NULL").groupBy("cls").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("parts").alias("parts")))
    lists = written(_lists(own, _sketch(first.where("slice IS NOT NULL"))), "lists")
    prefixes = _prefixes(lists.where("sh IS NOT NULL").select("sh", "cls", "n", "pos"))

    pairs = materialise(_wanted(lists.where("a IS NOT NULL")))
    tried, kept, left = pairs, [], 1
    comps = spark.createDataFrame([], "node long, comp long")
    for turn in range(1, TURNS + 2):
        if not pairs.isEmpty():
            comps = _joined(comps, _verified(own, classes, pairs, kept))
        swept(spark)
        if not left:
            break
        made = written(_candidates(prefixes, comps, turn, turn == TURNS), "candidates")
        left = made.agg(F.sum("left")).first()[0]
        pairs = materialise(_wanted(made.where("a IS NOT NULL")).join(tried, ["a", "b"], "left_anti"))
        swept(spark)
        tried = tried.unionByName(pairs)
    return members, classes, comps, kept


def _wanted(made: DataFrame) -> DataFrame:
    """(a, b) of pairs (a, b, times): of those of stars, each set's two most frequent, which is enough to go on with, as
    lists whose sets aren't of one component then are seen again; of the others all."""
    most = Window.partitionBy("b").orderBy(F.desc("times"), "a")
    stars = made.where("times > 0").groupBy("a", "b").agg(F.sum("times").alias("times")).withColumn("k", F.row_number().over(most)).where("k <= 2")
    both = stars.select("a", "b").unionByName(made.where("times = 0").select("a", "b"))
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    """(node, comp) with the new links (a, b): components are found of what the old ones and new sets make, so that many
    links between two components are one.  Few of both are put together in one task."""
    both = links.select("a", "b").unionByName(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")))
    if both.count() <= TOGETHER:
        return together(both)
    one, other = (comps.select(F.col("node").alias(c), F.col("comp").alias(f"c{c}")) for c in ("a", "b"))
    ends = links.join(one, "a", "left").join(other, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    found = components(ends.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    up = found.select(F.col("node").alias("was"), F.col("comp").alias("now"))
    moved = comps.join(up, comps["comp"] == up["was"], "left").select("node", F.coalesce("now", "comp").alias("comp"))
    return materialise(moved.unionByName(found.join(comps.select("node"), "node", "left_anti")))


def _result(members: DataFrame, classes: DataFrame, comps: DataFrame, counts: DataFrame | None, id: str) -> DataFrame:
    ends = counts if counts is not None else classes.select("cls", F.lit(0).cast("long").alias("n_links")).limit(0)
    named = classes.join(comps, classes["cls"] == comps["node"], "left").select("cls", "rep", F.coalesce("comp", "cls").alias("comp"))
    lowest = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    placed = materialise(named.join(lowest, "comp").join(ends, "cls", "left").select("cls", "comp", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links")))
    return members.join(placed, "cls", "left").select(F.col("id").alias(id), F.col("h").alias("__text"), F.col("comp").alias("__comp"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def keep_one(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that stand for their groups: of each component the row with the
    smallest id (then the smallest hash of its text, nulls last), of rows that repeat it one.

    Most texts aren't moved for this: a filter of fixed size tells which rows may have to go, and only those are joined
    with the list of rows.
    """
    members, classes, comps, _ = _components(docs, id, text)
    found = _result(members, classes, comps, None, id).select(F.col(id).alias("id"), "__text", F.coalesce("__comp", F.xxhash64(id, "__text")).alias("comp"))
    keys = found.groupBy("id", "__text", "comp").agg(F.count("*").alias("times"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "__text")
    best = keys.groupBy(F.col("comp").alias("comp2")).agg(F.min(order).alias("best"))
    ruled = keys.join(best, F.col("comp") == F.col("comp2"))
    keep = F.col("id").eqNullSafe(F.col("best.id")) & F.col("__text").eqNullSafe(F.col("best.__text"))
    rules = materialise(ruled.select(F.xxhash64("id", "__text").alias("__key"), keep.alias("__keep"), F.col("times").alias("__times")).where("NOT __keep OR __times > 1"))
    shared = docs.sparkSession.sparkContext.broadcast(_needed(rules.select("__key")))
    keyed = docs.withColumn("__key", F.xxhash64(id, F.xxhash64(text)))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            on = np.ones(batch.num_rows, dtype=bool)
            for h in _spots(batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)):
                on &= (bits[h >> 3] >> (h & 7).astype(np.uint8) & 1).astype(bool)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(on)], names=[*batch.schema.names, "__maybe"])

    all_rows = keyed.mapInArrow(marked, T.StructType([*keyed.schema.fields, T.StructField("__maybe", T.BooleanType())]))
    clear = all_rows.where("NOT __maybe").select(*docs.columns)
    rest = all_rows.where("__maybe").join(rules, "__key", "left").where("coalesce(__keep, true)")
    once = rest.where("__times > 1").dropDuplicates(["__key"]).select(*docs.columns)
    return clear.unionByName(rest.where("coalesce(__times, 1) = 1").select(*docs.columns)).unionByName(once)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents")).drop("__text", "__comp")
