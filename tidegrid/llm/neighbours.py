"""Approximate nearest neighbours: multiprobe p-stable hashing with exact reranking."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, table


@dataclass(frozen=True)
class Hashing:
    """``tables`` hash tables of ``hashes`` projections each, cut into cells of ``width``; a query visits ``probes``
    buckets of each table.  ``block``: vectors that meet in one task as a matrix."""

    tables: int = 6
    hashes: int = 2
    width: float = 1.0
    probes: int = 6
    seed: int = 5
    block: int = 4096

    def lines(self, dim: int) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        return rng.normal(size=(self.tables * self.hashes, dim)), rng.uniform(0, self.width, self.tables * self.hashes)

    def cells(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each vector, table and projection: the cell, and how far into it (0 to 1) the vector lies."""
        a, b = self.lines(vectors.shape[1])
        raw = ((vectors @ a.T + b) / self.width).reshape(len(vectors), self.tables, self.hashes)
        cell = np.floor(raw)
        return cell.astype(np.int64), raw - cell

    @staticmethod
    def bucket(cell: np.ndarray) -> np.ndarray:
        """One number for the cells of a table's projections (last axis)."""
        out = np.zeros(cell.shape[:-1], dtype=np.int64)
        for k in range(cell.shape[-1]):
            out = out * 65_537 + cell[..., k] + 32_768
        return out

    def visits(self, vectors: np.ndarray) -> np.ndarray:
        """Buckets to visit, [vector, table, probe]: the own one, then neighbours in the order of their estimated
        success, which falls with the squared distance to the walls that the step passes."""
        cell, into = self.cells(vectors)
        steps = np.array(list(itertools.product((0, -1, 1), repeat=self.hashes)))
        wall = np.where(steps == 0, 0.0, np.where(steps < 0, into[:, :, None, :], 1 - into[:, :, None, :])) ** 2
        first = np.argsort(wall.sum(-1), axis=-1, kind="stable")[..., : self.probes]
        return self.bucket(cell[:, :, None, :] + steps[first])


def _lifted(vectors: np.ndarray, largest: float, query: bool) -> np.ndarray:
    """For inner products: candidates on a unit sphere of one more dimension, queries scaled to length 1, so that the
    nearest point is the one of the largest inner product."""
    if query:
        return np.hstack([vectors / np.linalg.norm(vectors, axis=1, keepdims=True), np.zeros((len(vectors), 1))])
    scaled = vectors / largest
    return np.hstack([scaled, np.sqrt(np.maximum(0.0, 1 - (scaled**2).sum(1, keepdims=True)))])


def _usable(vectors: DataFrame, vector: str) -> DataFrame:
    x = F.col(vector)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return vectors.where(x.isNotNull() & (F.size(x) > 0)).where(~F.coalesce(bad, F.lit(True))).where(F.exists(x, lambda v: v != 0))


def _blocks(rows: DataFrame, by: list[str], size: int, name: str, into: str) -> tuple[DataFrame, DataFrame]:
    """Deals the rows of each bucket over blocks of about ``size``; also the number of blocks of each bucket."""
    counts = rows.groupBy(*by).agg(F.ceil(F.count("*") / size).cast("int").alias(into))
    return rows.join(counts, by).withColumn(name, F.pmod(F.xxhash64("cls"), F.col(into)).cast("int")).drop(into), counts


def _meet(base: DataFrame, asking: DataFrame, keep: int, block: int) -> DataFrame:
    """Scores of the ``keep`` best of each block for each query that visits its bucket: (q, c, score)."""
    by = ["tab", "bucket"]
    base, base_n = _blocks(base, by, block, "i", "ni")
    asking, asking_n = _blocks(asking, by, block, "j", "nj")
    base = base.join(asking_n, by).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nj") - 1))).select(*by, "i", "j", F.col("cls"), "vector")
    asking = asking.join(base_n, by).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("ni") - 1))).select(*by, "i", "j", F.col("cls"), "vector")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"q": [], "c": [], "score": []})
        a = np.stack(left["vector"].to_numpy()).astype(np.float64)
        q = np.stack(right["vector"].to_numpy()).astype(np.float64)
        n = min(keep, len(a))
        rough = q @ a.T
        least = np.partition(rough, len(a) - n, axis=1)[:, len(a) - n]
        slack = 1e-12 * len(a[0]) * (np.abs(q) @ np.abs(a).max(0)) + 1e-300  # more than the product's last bits
        least = np.nan_to_num(least - slack, nan=-np.inf, neginf=-np.inf)
        names, parts = left["cls"].to_numpy(), []
        for at in range(0, len(q), 256):
            rows, found = np.nonzero(rough[at : at + 256] >= least[at : at + 256, None])  # all that tie with the last one
            exact = np.concatenate([np.cumsum(q[at + rows[k : k + 65_536]] * a[found[k : k + 65_536]], axis=1)[:, -1] for k in range(0, len(rows), 65_536)])  # in order, so alike wherever two vectors meet
            by = np.lexsort((names[found], -exact, rows))
            first = np.searchsorted(rows[by], np.arange(rows.max() + 1))
            by = by[np.arange(len(by)) - first[rows[by]] < n]
            parts.append(pd.DataFrame({"q": right["cls"].to_numpy()[at + rows[by]], "c": names[found[by]], "score": exact[by]}))
        return pd.concat(parts)

    keys = [*by, "i", "j"]
    return base.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInPandas(run, "q long, c long, score double")


def search(vectors: DataFrame, is_query: Column, *, k: int = 20, id: str = "vec_id", vector: str = "embedding", how: Hashing = Hashing()) -> DataFrame:
    """The ``k`` nearest found by inner product of every row where ``is_query`` holds, among all other rows.

    Returns ``query_id, rank, vec_id, score``, nearest first, ties to the smaller id.  Equal vectors are searched as
    one: each stands with its ``k + 1`` smallest ids, which is all that a result can show of it, so groups of copies
    cost no more than one vector.  A query whose buckets held fewer than ``k`` others is compared with all rows, in
    blocks.

    Vectors that are null, empty, zero, of another length than most, or hold null or non-finite components take no
    part, nor do rows with a null id.  A repeated id stands once for each different vector.  Empty table: no rows.
    Extra columns are not read.
    """
    spark = vectors.sparkSession
    rows = _usable(vectors.where(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks")), "vector")
    sizes = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if sizes is None:
        return empty
    rows = rows.where(F.size("vector") == sizes["n"])
    first = Window.partitionBy("vector").orderBy("id")
    few = rows.dropDuplicates(["id", "vector"]).withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= k + 1)
    asked = rows.where("asks").select("vector").distinct().withColumn("asked", F.lit(True))
    classes = materialise(
        few.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")).join(asked, "vector", "left").select(F.element_at("ids", 1).alias("cls"), "vector", "ids", F.coalesce("asked", F.lit(False)).alias("asked"))
    )
    largest = classes.agg(F.max(F.aggregate("vector", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))).first()[0] ** 0.5

    def placed(query: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for one in batches:
                if not len(one):
                    continue
                x = _lifted(np.stack(one["vector"].to_numpy()).astype(np.float64), largest, query)
                where = how.visits(x) if query else how.bucket(how.cells(x)[0])[:, :, None]
                n, tables, probes = where.shape
                again = np.repeat(np.arange(n), tables * probes)
                yield pd.DataFrame({"tab": np.tile(np.repeat(np.arange(tables), probes), n), "bucket": where.ravel(), "cls": one["cls"].to_numpy()[again], "vector": one["vector"].to_numpy()[again]})

        return run

    shape = "tab int, bucket long, cls long, vector array<double>"
    wide = classes.select("cls", "vector", "asked")
    base = wide.select("cls", "vector").mapInPandas(placed(False), shape)
    asking = wide.where("asked").select("cls", "vector").mapInPandas(placed(True), shape)
    found = materialise(_best(_meet(base, asking, k + 1, how.block), k))

    # Of a query class: itself counts through its copies only, so one more than k is enough for any of its members.
    ids = classes.select(F.col("cls").alias("c"), "ids", F.size("ids").alias("n"))
    have = found.join(ids, "c").groupBy("q").agg(F.sum("n").alias("have"))
    short = materialise(wide.where("asked").join(have, wide["cls"] == have["q"], "left").where(F.coalesce("have", F.lit(0)) < k + 1).select("cls", "vector")).toDF("cls", "vector")
    if not short.isEmpty():
        everywhere = [F.lit(0).alias("tab"), F.lit(0).cast("long").alias("bucket"), "cls", "vector"]
        whole = _best(_meet(wide.select(*everywhere), short.select(*everywhere), k + 1, how.block), k)
        found = materialise(found.join(short, found["q"] == short["cls"], "left_anti").unionByName(whole))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    listed = found.join(ids, "c").select("q", "score", F.explode("ids").alias("vec_id")).withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= k + 1)
    asks = rows.where("asks").select("id", "vector").distinct().join(classes.select("cls", "vector"), "vector").select(F.col("id").alias("query_id"), F.col("cls").alias("q"))
    mine = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return asks.join(listed, "q").where("query_id <> vec_id").withColumn("rank", F.row_number().over(mine)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _best(pairs: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), "c")
    return pairs.groupBy("q", "c").agg(F.max("score").alias("score")).withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= k + 1).drop("__n")


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
