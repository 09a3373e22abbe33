"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, join_checked, materialise, table, unit, with_prefix


def _targets(per: DataFrame, source: str, weights: tuple[float, ...], cap: float) -> tuple[DataFrame, int]:
    """Adds ``__target`` to the table of sources: shares by weight, none above ``cap`` times its source's size.

    A source is full when its share at the common level (size for one unit of weight) passes its cap.  The level that
    uses up the total is reached by raising it as sources fill; each pass sums the sources to one row.
    """
    ranked = with_prefix(per, [F.col(source).asc_nulls_last()], {"__rank": F.lit(1).cast("long")})
    weigh = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__rank") % len(weights) + 1).cast("int"))
    ranked = materialise(ranked.select(source, "__source_size", weigh.alias("__weight")))
    limit = F.col("__source_size") * F.lit(float(cap))
    rows, total, weight = ranked.agg(F.count("*"), F.sum("__source_size"), F.sum("__weight")).first()
    level, full = (total / weight if rows and weight else 0.0), 0
    while rows:
        above = limit < F.col("__weight") * F.lit(float(level))
        n, used, left = ranked.agg(F.count(F.when(above, 1)), F.sum(F.when(above, limit)), F.sum(F.when(~above, F.col("__weight")))).first()
        if n == full or not left:
            break
        full, level = n, (total - (used or 0.0)) / left
    return ranked.select(source, "__source_size", F.least(limit, F.col("__weight") * F.lit(float(level))).alias("__target")), rows


def plan_mix(
    docs: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0, seed: int = 17, id: str = "doc_id", text: str = "text", source: str = "source"
) -> DataFrame:
    """One row per document with how often a mix takes it.

    Returns ``id, size, source_size, target, copies, taken`` (and ``source``).  Sources by code point, null last, weigh
    ``weights`` in turn.  A source's repetition rate is its target over its size; each document is taken floor(rate)
    times, and once more with probability equal to the fraction, by a seeded hash of its id and text.

    Null text: size 0.  Null source: a source of its own, the last.  Null id: hashed by its text alone.  Repeated rows
    are each taken, alike.  A source without words: target 0, nothing taken.  Empty table: no rows.  Other columns are
    not read.
    """
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    sized = materialise(docs.select(F.col(id), F.col(source), size.alias("size"), F.xxhash64(F.col(text)).alias("__text")))
    per = sized.groupBy(source).agg(F.sum("size").alias("__source_size"))
    targets, rows = _targets(per, source, weights, cap)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(0.0)
    more = unit(F.lit(seed), F.col(id), F.col("__text")) < rate - F.floor(rate)
    mixed = join_checked(sized, targets, source, rows).withColumnsRenamed({"__source_size": "source_size", "__target": "target"})
    return mixed.withColumn("copies", F.floor(rate).cast("long") + more.cast("long")).select(
        id, source, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "__text"
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed rows: every row of ``docs``, with all its columns, as often as the plan takes it.

    The plan is found again from the row itself, by its source's rate, so texts are not shuffled.
    """
    id, text, source, seed = (options.get(k, v) for k, v in (("id", "doc_id"), ("text", "text"), ("source", "source"), ("seed", 17)))
    plan = plan_mix(docs, **options)
    rates = materialise(plan.groupBy(source).agg(F.max("source_size").alias("__size"), F.max("target").alias("__target")).withColumnRenamed(source, "__name"))
    cap = float(options.get("cap", 3.0))
    rate = F.when(F.col("__size") > 0, F.least(F.col("__target") / F.col("__size"), F.lit(cap))).otherwise(0.0)
    more = unit(F.lit(seed), F.col(id), F.xxhash64(F.col(text))) < rate - F.floor(rate)
    named = rates.withColumnRenamed("__name", source)
    joined = join_checked(docs, named, source, rates.count())
    copies = F.floor(rate).cast("int") + more.cast("int")
    return joined.withColumn("__copies", copies).where("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*[docs[c] for c in docs.columns])


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")
