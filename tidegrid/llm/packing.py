"""Best-fit packing: patterns of few documents fitted to the histogram of lengths, then the residual."""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, materialise, shuffle_partitions, small_batches, table
from .tokens import Encoder

#: Second lengths that are tried beside each first one, and steps of the fit.
PARTNERS, STEPS = 12, 300


def patterns(counts: np.ndarray) -> np.ndarray:
    """Rows of up to three lengths (0: none) that fill a sequence exactly.  ``counts``: of each length from 0 up to a
    whole sequence."""
    size = len(counts) - 1
    there = np.flatnonzero(counts)
    out = []
    for a in there[::-1].tolist():
        rest = size - a
        if rest == 0:
            out.append((a, 0, 0))
            continue
        if rest <= a and counts[rest]:
            out.append((a, rest, 0))
        low, high = np.searchsorted(there, (rest + 1) // 2), np.searchsorted(there, min(a, rest - 1), side="right")
        for b in there[np.unique(np.linspace(low, high - 1, PARTNERS).astype(int))].tolist() if high > low else []:
            if counts[rest - b] and rest - b <= b:
                out.append((a, b, rest - b))
    return np.array(out, dtype=np.int64).reshape(-1, 3)


def fit(columns: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Non-negative repeats of the patterns whose sum of lengths comes nearest to the histogram by least squares, by
    accelerated gradient steps onto the non-negative numbers."""
    used = columns > 0
    flat = columns.ravel()

    def total(x: np.ndarray) -> np.ndarray:
        out = np.bincount(flat, weights=np.repeat(x, 3), minlength=len(counts))
        out[0] = 0
        return out

    target = counts.astype(float)
    x = y = np.zeros(len(columns))
    share = np.maximum(np.bincount(flat, weights=np.repeat(used.sum(1), 3), minlength=len(counts)), 1)
    step = 1.0 / np.maximum((share[columns] * used).sum(1), 1)  # one for each pattern, by how crowded its lengths are
    pace = 1.0
    for _ in range(STEPS):
        gap = total(y) - target
        new = np.maximum(0.0, y - step * (gap[columns] * used).sum(1))
        faster = (1 + (1 + 4 * pace * pace) ** 0.5) / 2
        y = np.maximum(0.0, new + (pace - 1) / faster * (new - x))
        x, pace = new, faster
    return x


@dataclass(frozen=True)
class Plan:
    """Which ranks of each length go where.  Row k: the ranks from ``start[k]`` on of its length go to the sequences
    from ``base[k]`` on, ``each[k]`` to a sequence, at ``offset[k]`` and after.  ``key`` orders them by length and
    rank.  Its size depends on the capacity, not on the number of documents."""

    key: np.ndarray
    start: np.ndarray
    base: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    length: np.ndarray
    sequences: int

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(self.key, (lengths << 50) + ranks, side="right") - 1
        gone = ranks - self.start[k]
        return self.base[k] + gone // self.each[k], self.offset[k] + gone % self.each[k] * lengths


def plan(counts: np.ndarray) -> Plan:
    """Packs a histogram of lengths, from 0 to a whole sequence."""
    size, left = len(counts) - 1, counts.astype(np.int64).copy()
    left[0] = 0
    chosen: list[tuple[dict[int, int], int]] = []
    columns = patterns(left)
    if len(columns):
        x = fit(columns, left)
        for p in np.argsort(-x, kind="stable"):
            if x[p] < 0.5:
                break
            want: dict[int, int] = {}
            for length in columns[p].tolist():
                if length:
                    want[length] = want.get(length, 0) + 1
            n = min(round(float(x[p])), *(int(left[k]) // m for k, m in want.items()))
            if n > 0:
                chosen.append((want, n))
                for k, m in want.items():
                    left[k] -= m * n
    there = np.flatnonzero(left).tolist()
    while there:
        want, gap, taken = {}, size, len(there)
        while gap > 0 and (taken := bisect_right(there, gap, 0, taken)):
            length = there[taken - 1]
            m = min(gap // length, int(left[length]))
            want[length], gap, taken = m, gap - m * length, taken - 1
        n = min(int(left[k]) // m for k, m in want.items())
        chosen.append((want, n))
        for k, m in want.items():
            left[k] -= m * n
            if not left[k]:
                there.remove(k)
    next_rank, rows, base = np.zeros(size + 1, dtype=np.int64), [], 0
    for want, n in chosen:
        at = 0
        for k, m in want.items():
            rows.append((k, int(next_rank[k]), base, m, at))
            next_rank[k] += m * n
            at += m * k
        base += n
    t = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return Plan((t[:, 0] << 50) + t[:, 1], t[:, 1], t[:, 2], t[:, 3], t[:, 4], t[:, 0], base)


def pieces(docs: DataFrame, tokenizer: str, *, end: int, size: int, spaces: bool, keep_ids: bool, id: str, text: str) -> DataFrame:
    """``id, h, piece, start, length, ids_crc32`` (and ``ids``) of the pieces of every whole text."""
    small_batches(docs.sparkSession)
    own = docs.select(F.col(id).alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer, spaces=spaces)
        for batch in batches:
            ends, crcs, kept = [], [], []
            for ids in encoder.ids(batch.column(2).to_pylist()):
                whole = np.append(ids.astype("<u4"), np.uint32(end))
                n = len(whole)
                stops = list(range((n - 1) % size + 1, n + 1, size))
                parts = [whole[a:b].tobytes() for a, b in zip([0, *stops], stops)]
                ends.append(stops)
                crcs.append([zlib.crc32(x) for x in parts])
                kept.append(parts if keep_ids else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ends, pa.list_(pa.int64())), pa.array(crcs, pa.list_(pa.int64())), pa.array(kept, pa.list_(pa.binary()))], names=["id", "h", "ends", "crcs", "kept"])

    kind = own.schema["id"].dataType.simpleString()
    coded = own.mapInArrow(encode, f"id {kind}, h long, ends array<long>, crcs array<long>, kept array<binary>")
    each = materialise(coded).select("id", "h", "ends", F.posexplode(F.arrays_zip("ends", "crcs", *["kept"] * keep_ids)).alias("piece", "p"))
    start = F.when(F.col("piece") == 0, F.lit(0)).otherwise(F.element_at("ends", F.greatest(F.col("piece"), F.lit(1))))
    return each.select("id", "h", "piece", start.cast("long").alias("start"), (F.col("p.ends") - start).cast("long").alias("length"), F.col("p.crcs").alias("ids_crc32"), *[F.col("p.kept").alias("ids")] * keep_ids)


def pack(docs: DataFrame, tokenizer: str, *, end: int = 0, size: int = 2048, spaces: bool = True, keep_ids: bool = False, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Packs whole texts into sequences of at most ``size`` tokens.

    Returns a row per piece: ``id, piece, start, length, ids_crc32, sequence_id, offset``, with ``keep_ids`` also its
    ids as little-endian unsigned 32-bit integers.  A text over ``size`` tokens is cut into whole sequences, its first
    piece being the shorter one.

    Only the histogram of lengths, of ``size`` numbers, comes to the driver, where the packing is planned.  A piece
    finds its place by its rank among those of its length; ranks are counted in buckets, so that a length that a third
    of all pieces have is counted by many tasks.

    Null and empty texts: the end id alone.  Null ids are kept.  Repeated rows are packed each.  Empty table: no rows.
    """
    spark = docs.sparkSession
    buckets = max(64, shuffle_partitions(spark))
    cut = pieces(docs, tokenizer, end=end, size=size, spaces=spaces, keep_ids=keep_ids, id=id, text=text)
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("id", "h", "piece"), F.lit(buckets)).cast("int"))
    sizes = materialise(cut.groupBy("length", "bucket").agg(F.count("*").alias("n")))
    counts = np.zeros(size + 1, dtype=np.int64)
    for row in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most one row for each length
        counts[row["length"]] = row["n"]
    shared = spark.sparkContext.broadcast(plan(counts))
    line = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(line), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy("id", "h", "piece")
    ranked = cut.withColumn("row", F.row_number().over(within))
    ranked = ranked.join(F.broadcast(before) if sizes.count() <= BROADCAST_ROWS else before, ["length", "bucket"])
    ranked = ranked.select("id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("row") - 1).alias("rank"), *["ids"] * keep_ids)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            length, rank = (batch.column(names.index(x)).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("length", "rank"))
            sequence, offset = shared.value.place(length, rank) if len(rank) else (length, rank)
            kept = [k for k, x in enumerate(names) if x != "rank"]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in kept], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*[names[k] for k in kept], "sequence_id", "offset"])

    kind = ranked.schema["id"].dataType.simpleString()
    rows = ranked.mapInArrow(placed, f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids + ", sequence_id long, offset long")
    return rows.withColumnRenamed("id", id)


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
