"""Token ids in a content-addressed store: chunks by rolling hash, recipes per document, Merkle manifests."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, shared_path, shuffle_partitions, small_batches, table, with_prefix
from .tokens import Encoder

#: Ids under which the rolling hash looks, the least and the most ids of a chunk, and the mask whose zeros end one.
WINDOW, LEAST, MOST, MASK = 16, 64, 2048, np.uint64(255 << 40)
#: Nodes under one node of the manifest.
FAN = 1024


def digest(data: bytes) -> bytes:
    return blake2b(data, digest_size=16).digest()


def rolling(ids: np.ndarray) -> np.ndarray:
    """At each id a hash of the ``WINDOW`` ids that end there, by doubling the span."""
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    span, factor = 1, np.uint64(0xD6E8FEB86659FD93)
    while span < WINDOW:
        longer = h.copy()
        longer[span:] += h[:-span] * factor
        h, factor, span = longer, factor * factor, span * 2
    return h


def cuts(ids: np.ndarray) -> list[int]:
    """The ends of the chunks of one document."""
    return cuts_of(ids, [len(ids)])[0]


def cuts_of(ids: np.ndarray, sizes: list[int]) -> list[list[int]]:
    """The ends of the chunks of each of some documents, whose ids stand one after the other.  The hash of fewer than
    ``WINDOW`` ids differs beside other documents, but ends no chunk, as those are longer."""
    with np.errstate(over="ignore"):
        marks = np.flatnonzero((rolling(ids) & MASK) == 0) + 1
    ends = np.cumsum(sizes)
    edge = np.searchsorted(marks, np.r_[0, ends], side="right")
    return [_cuts(n, (marks[edge[k] : edge[k + 1]] - (end - n)).tolist()) for k, (n, end) in enumerate(zip(sizes, ends.tolist(), strict=True))]


def _cuts(n: int, marks: list[int]) -> list[int]:
    if n <= LEAST:
        return [n] if n else []
    ends, last = [], 0
    for end in [*marks, n]:
        while end - last > MOST:
            last += MOST
            ends.append(last)
        if end - last >= LEAST or end == n and end > last:
            ends.append(end)
            last = end
    return ends


def merkle(leaves: list[bytes]) -> bytes:
    """The root over leaves in order; an odd one out goes up as it is."""
    if not leaves:
        return digest(b"")
    while len(leaves) > 1:
        leaves = [digest(b"\x01" + b"".join(leaves[i : i + 2])) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0]


def packed(parts: list[bytes], width: int) -> bytes:
    """Ids of many chunks, their bytes sorted by significance, compressed."""
    flat = np.frombuffer(b"".join(parts), dtype=np.uint8).reshape(-1, width)
    return zstandard.compress(np.ascontiguousarray(flat.T).tobytes(), 3)


def unpacked(data: bytes, lengths: list[int], width: int) -> list[bytes]:
    flat = np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(width, -1).T).tobytes()
    ends = (np.cumsum(lengths) * width).tolist()
    return [flat[end - n * width : end] for n, end in zip(lengths, ends, strict=True)]


@lru_cache(maxsize=1)
def _powers() -> np.ndarray:
    """x^(2^k) modulo the polynomial of crc32, bits reversed."""
    out = [np.uint32(1 << 30)]
    for _ in range(63):
        out.append(times(out[-1:], out[-1:])[0])
    return np.array(out, dtype=np.uint32)


def times(a, b) -> np.ndarray:
    """Products of polynomials modulo that of crc32."""
    a, b = np.asarray(a, dtype=np.uint32), np.asarray(b, dtype=np.uint32).copy()
    out = np.zeros(np.broadcast(a, b).shape, dtype=np.uint32)
    for k in range(31, -1, -1):
        out ^= np.where(a >> np.uint32(k) & np.uint32(1), b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return out


def joined_crc(crcs: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """crc32 of each run of parts put together.  ``starts``: where each run begins; ``sizes`` in bytes."""
    total = np.cumsum(sizes)
    run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(crcs))))
    ends = total[np.append(starts[1:], len(crcs)) - 1]
    bits = (ends[run] - total).astype(np.uint64) * np.uint64(8)
    moved, powers = crcs.astype(np.uint32), _powers()
    for k in range(int(bits.max()).bit_length() if len(bits) else 0):
        on = np.flatnonzero(bits >> np.uint64(k) & np.uint64(1))
        moved[on] = times(powers[k], moved[on])
    return np.bitwise_xor.reduceat(moved, starts) if len(starts) else moved


@dataclass(frozen=True)
class Store:
    """Where a store lies.  ``chunks``: bucket, digests, lengths, packed, where a bucket is the digests' first two bytes
    dealt over the number of buckets and each digest stands once.  ``recipes``: id, ordinal, start, n_tokens, digests,
    root, in ascending order of ids.  ``manifest``: level, node, digest, rows; the highest level has the one root."""

    chunks: str
    recipes: str
    manifest: str
    width: int


def _tree(leaves: DataFrame) -> Iterator[DataFrame]:
    """The levels of the manifest over (node, digest, rows), each node over ``FAN`` of the level below."""
    level = 0
    while True:
        here = materialise(leaves.withColumn("level", F.lit(level)))
        yield here
        if here.limit(2).count() <= 1:
            return
        under = F.sort_array(F.collect_list(F.struct("node", "digest", "rows")))
        leaves = here.groupBy(F.expr(f"node div {FAN}").alias("node")).agg(under.alias("u")).select(
            "node", F.unhex(F.substring(F.sha2(F.unhex(F.array_join(F.transform("u.digest", lambda d: F.hex(d)), "")), 256), 1, 32)).alias("digest"), F.aggregate("u.rows", F.lit(0).cast("long"), lambda s, x: s + x).alias("rows")
        )
        level += 1


def _manifest(recipes: DataFrame) -> Iterator[DataFrame]:
    return _tree(recipes.select(F.col("ordinal").alias("node"), F.col("root").alias("digest"), F.lit(1).cast("long").alias("rows")))


def write(docs: DataFrame, tokenizer: str, *, end: int, spaces: bool = False, id: str = "doc_id", text: str = "text") -> Store:
    """Encodes every whole text, adds the id ``end``, and stores the ids under a new path of the shared folder.

    The texts are encoded once, into a staging table of recipes and of chunks new to their task, packed by bucket.  The
    packs are then dealt by bucket, where chunks that several tasks met are dropped.

    Null and empty texts: the end id alone.  Null ids come last; rows that share an id stand in the order of their
    texts' hashes.  Repeated rows each have a recipe, their chunks are stored once.  Empty table: an empty store.
    """
    spark = docs.sparkSession
    small_batches(spark)
    buckets = shuffle_partitions(spark)
    width = 4 if Encoder.of(tokenizer, spaces=spaces).wide else 2
    own = docs.select(F.col(id).alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    fields = [("id", own.schema["id"].dataType.simpleString()), ("h", "long"), ("n", "long"), ("bucket", "int"), ("digests", "array<binary>"), ("lengths", "array<int>"), ("packed", "binary"), ("root", "binary")]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer, spaces=spaces)
        last = np.array([end], dtype=encoder.dtype).tobytes()
        seen: set[bytes] = set()
        waiting: dict[int, list[tuple[bytes, bytes]]] = {}
        held = 0
        kind = None

        def flush() -> Iterator[pa.RecordBatch]:
            for bucket, found in waiting.items():
                yield pa.RecordBatch.from_arrays([
                    pa.nulls(1, kind), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([bucket], pa.int32()), pa.array([[d for d, _ in found]], pa.list_(pa.binary())),
                    pa.array([[len(x) // width for _, x in found]], pa.list_(pa.int32())), pa.array([packed([x for _, x in found], width)], pa.binary()), pa.nulls(1, pa.binary()),
                ], names=[k for k, _ in fields])
            waiting.clear()

        for batch in batches:
            kind = batch.schema.field("id").type
            ns, recipes, roots = [], [], []
            raws = [raw + last for raw in encoder.raw(batch.column(2).to_pylist())]
            sizes = [len(raw) // width for raw in raws]
            for raw, size, stops in zip(raws, sizes, cuts_of(np.frombuffer(b"".join(raws), dtype=encoder.dtype), sizes), strict=True):
                at, recipe = 0, []
                for stop in stops:
                    chunk = raw[at * width : stop * width]
                    at = stop
                    recipe.append(name := digest(chunk))
                    if name not in seen:
                        seen.add(name)
                        waiting.setdefault(int.from_bytes(name[:2], "big") % buckets, []).append((name, chunk))
                        held += len(chunk)
                ns.append(size)
                recipes.append(recipe)
                roots.append(merkle(recipe))
            n = len(ns)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(ns, pa.int64()), pa.nulls(n, pa.int32()), pa.array(recipes, pa.list_(pa.binary())), pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.binary()), pa.array(roots, pa.binary()),
            ], names=[k for k, _ in fields])
            if held > 48 << 20:
                yield from flush()
                held = 0
        yield from flush()

    schema = ", ".join(f"{k} {v}" for k, v in fields)
    staging, store = shared_path(spark, "tokens-staging"), shared_path(spark, "tokens")
    own.mapInArrow(encode, schema).write.parquet(staging, compression="zstd")
    staged = spark.read.schema(schema).parquet(staging)

    block = pa.schema([("bucket", pa.int32()), ("digests", pa.list_(pa.binary())), ("lengths", pa.list_(pa.int32())), ("packed", pa.binary())])

    def unique(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for row in batch.to_pylist():
                fresh = [(d, n, x) for d, n, x in zip(row["digests"], row["lengths"], unpacked(row["packed"], row["lengths"], width), strict=True) if d not in seen]
                if len(fresh) == len(row["digests"]):
                    seen.update(row["digests"])
                    yield pa.RecordBatch.from_pylist([row], schema=block)
                elif fresh:
                    seen.update(d for d, _, _ in fresh)
                    yield pa.RecordBatch.from_pylist([{"bucket": row["bucket"], "digests": [d for d, _, _ in fresh], "lengths": [n for _, n, _ in fresh], "packed": packed([x for *_, x in fresh], width)}], schema=block)

    chunks = "bucket int, digests array<binary>, lengths array<int>, packed binary"
    staged.where("bucket IS NOT NULL").select("bucket", "digests", "lengths", "packed").repartition(buckets, "bucket").mapInArrow(unique, chunks).write.parquet(f"{store}/chunks", compression="none")
    order = [F.col("id").asc_nulls_last(), F.col("h")]
    placed = with_prefix(staged.where("bucket IS NULL").select("id", "h", "n", "digests", "root"), order, {"start": F.col("n"), "ordinal": F.lit(1).cast("long")})
    placed.select("id", "ordinal", "start", F.col("n").alias("n_tokens"), "digests", "root").write.parquet(f"{store}/recipes", compression="zstd")
    recipes = spark.read.parquet(f"{store}/recipes")
    for level in _manifest(recipes):
        level.write.mode("append").parquet(f"{store}/manifest")
    removed(spark, staging)
    return Store(f"{store}/chunks", f"{store}/recipes", f"{store}/manifest", width)


def removed(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def read(spark: SparkSession, store: Store) -> DataFrame:
    """Rebuilds each document from the files: ``id, start, n_tokens, ids_crc32, sound``.

    Every stored chunk is unpacked and hashed against its digest.  A document's crc is put together from those of its
    chunks, so the ids themselves don't move again.  ``sound``: all of its chunks are there and whole, their lengths
    add up, its root is the one over its chunks, and the manifest over all roots is the one that was written.
    """
    width = store.width
    dtype = f"<u{width}"

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                parts = unpacked(row["packed"], row["lengths"], width)
                good = [digest(x) == d for d, x in zip(row["digests"], parts, strict=True)]
                crcs = [zlib.crc32(np.frombuffer(x, dtype).astype("<u4").tobytes()) for x in parts]
                yield pa.RecordBatch.from_arrays([pa.array(row["digests"], pa.binary()), pa.array(row["lengths"], pa.int64()), pa.array(crcs, pa.int64()), pa.array(good, pa.bool_())], names=["digest", "size", "crc", "good"])

    chunks = spark.read.parquet(store.chunks).select("digests", "lengths", "packed").mapInArrow(checked, "digest binary, size long, crc long, good boolean")
    recipes = spark.read.parquet(store.recipes)
    steps = recipes.select("ordinal", F.posexplode("digests").alias("pos", "digest"))
    parts = steps.join(chunks, "digest", "left").groupBy("ordinal").agg(F.sort_array(F.collect_list(F.struct("pos", "size", "crc", "good"))).alias("parts"))
    kind = recipes.schema["id"].dataType.simpleString()

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
            count = column("parts").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = column("parts").flatten()
            size, crcs = (flat.field(k).fill_null(0).to_numpy(zero_copy_only=False) for k in (1, 2))
            good = flat.field(3).fill_null(False).to_numpy(zero_copy_only=False)
            has = np.flatnonzero(count)  # the others have lost their recipe
            starts = (np.cumsum(count) - count)[has]
            crc, whole_size, bad = (np.zeros(len(count), dtype=np.int64) for _ in range(3))
            if len(has):
                crc[has] = joined_crc(crcs.astype(np.uint32), 4 * size.astype(np.int64), starts)
                whole_size[has], bad[has] = np.add.reduceat(size, starts), np.add.reduceat(~good, starts, dtype=np.int64)
            roots = [merkle(x or []) == r for x, r in zip(column("digests").to_pylist(), column("root").to_pylist(), strict=True)]
            sound = (bad == 0) & (whole_size == column("n_tokens").to_numpy(zero_copy_only=False)) & np.array(roots, dtype=bool)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(batch.schema.get_field_index("n_tokens")), pa.array(crc), pa.array(sound)], names=["id", "start", "n_tokens", "ids_crc32", "sound"])

    whole = intact(spark, store)
    rows = recipes.select("id", "start", "n_tokens", "digests", "root", "ordinal").join(parts, "ordinal", "left").select("id", "start", "n_tokens", "digests", "root", "parts")
    return rows.mapInArrow(rebuilt, f"id {kind}, start long, n_tokens long, ids_crc32 long, sound boolean").withColumn("sound", F.col("sound") & F.lit(whole))


def intact(spark: SparkSession, store: Store) -> bool:
    """Whether the manifest's root is the one over the recipes' roots."""
    kept = spark.read.parquet(store.manifest)
    *_, top = _manifest(spark.read.parquet(store.recipes))
    return top.exceptAll(kept.select(top.columns)).isEmpty()


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    store = write(docs, public_tokenizers.path("word_bpe_49k.json"), end=2)
    return read(spark, store).withColumnRenamed("id", "doc_id")
