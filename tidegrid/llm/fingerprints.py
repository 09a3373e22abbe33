"""Document fingerprints by consistent weighted sampling of term frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, materialise, shuffle_partitions, table

#: Samples in a fingerprint, and the hexadecimal digits of each.
SAMPLES, DIGITS = 32, 6
_TERM = (1 << 4 * DIGITS) - 1


def _half(x: Column) -> Column:
    """The lower 32 bits as a number inside (0, 1)."""
    return (x.bitwiseAND(F.lit(0xFFFFFFFF)).cast("double") + 0.5) * F.lit(2.0**-32)


def _sample(term: Column, weight: Column, j: int) -> Column:
    """Sample ``j`` of one term (a hash) and its weight as one number, whose minimum over a document's terms is the
    document's sample: ln a in its upper bits, in its lower ones what is compared, a hash of the term and its step t.

    r and c are gamma(2, 1), b uniform, all from the term alone; t = floor(ln w / r + b), a = c / exp(r (t - b) + r).
    A weight of 0 has no logarithm and so gives no sample.
    """
    one, two, three = (F.xxhash64(term, F.lit(3 * j + i)) for i in range(3))
    r = -F.ln(_half(one) * _half(F.shiftrightunsigned(one, 32)))
    c = -F.ln(_half(two) * _half(F.shiftrightunsigned(two, 32)))
    b = _half(three)
    t = F.floor(F.ln(weight) / r + b)
    rank = F.ln(c) - r * (t - b + 1)
    return F.floor((rank + 64) * F.lit(2.0**31)) * (_TERM + 1) + F.xxhash64(term, t, F.lit(j)).bitwiseAND(F.lit(_TERM))


def signatures(terms: DataFrame, key: list[str], term: str, weights: dict[str, Column], samples: int = SAMPLES) -> DataFrame:
    """Per key and named weight the fingerprint of all terms, of fixed length.  Without terms of any weight: all f."""
    every = terms.groupBy(*key).agg(*[F.min(_sample(F.col(term), w, j)).alias(f"{name}_{j}") for j in range(samples) for name, w in weights.items()])
    digits = lambda x: F.lpad(F.lower(F.hex(F.coalesce(x.bitwiseAND(F.lit(_TERM)), F.lit(_TERM)))), DIGITS, "0")
    return every.select(*key, *[F.concat(*[digits(F.col(f"{name}_{j}")) for j in range(samples)]).alias(name) for name in weights])


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of samples in which two fingerprints agree: an estimate of the sum of the smaller weights of all terms
    over the sum of the larger ones."""
    same = [(F.substring(a, 1 + DIGITS * j, DIGITS) == F.substring(b, 1 + DIGITS * j, DIGITS)).cast("double") for j in range(samples)]
    return sum(same[1:], same[0]) / samples


def fingerprint(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, fingerprint`` of each text, its terms being words and their weights how often they stand.

    Null text: as empty; empty texts share one fingerprint.  Rows that repeat an id with another text each have their
    own row; fully repeated rows one between them.  Null ids are kept.  Empty table: no rows.
    """
    own = docs.select(F.col(id).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"), F.coalesce(F.col(text), F.lit("")).alias("t")).dropDuplicates(["id", "h"])
    words = own.select("id", "h", F.explode_outer(F.regexp_extract_all("t", F.lit(WORD), F.lit(0))).alias("w"))
    counted = words.groupBy("id", "h", F.xxhash64("w").alias("term"), F.col("w").isNull().alias("none")).count()
    weight = F.when(F.col("none"), F.lit(0.0)).otherwise(F.col("count").cast("double"))
    return signatures(counted, ["id", "h"], "term", {"fingerprint": weight}).select(F.col("id").alias(id), "fingerprint")


def compare_edited(docs: DataFrame, *, id: str = "doc_id", text: str = "text", part: int = 4) -> DataFrame:
    """Fingerprints of each text and of its edited text, in which the last 1/``part`` of the code points gives way to the
    first as many of the next document (by ascending id; after the last comes the first).

    Returns ``id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    The texts are dealt once, by ranges of ids, and stay there: within a range the next text is the following row, and
    the first row of each range is added to the end of the one before.  Counting terms and sampling need no further
    shuffle, since a document's words are where the document is.

    Null text: as empty.  Null ids come last, as one another's neighbours.  Ties of ids stand in the order of their
    texts' hashes; repeated rows are each other's next.  A single row is its own next.  Ids are numbers.  Empty table:
    no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    own = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    bounds = own.agg(F.percentile_approx("id", [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0] or []  # as many numbers as ranges
    bounds = sorted(set(bounds))
    place = F.when(F.col("id").isNull(), len(bounds) + 1).otherwise(F.size(F.filter(F.array(*[F.lit(b) for b in bounds]).cast("array<double>"), lambda x: x < F.col("id")))) if bounds else F.lit(0)
    ranged = own.withColumn("range", place.cast("int"))

    ends = ranged.groupBy("range").agg(F.count("*").alias("rows"), F.min_by("t", F.struct(F.col("id").isNull().cast("int").alias("n"), "id", "h")).alias("first"))
    ends = materialise(ends)
    line = Window.orderBy("range")  # one row for each range
    total = ends.agg(F.sum("rows")).first()[0] or 0
    after = ends.select("range", F.coalesce(F.sum("rows").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.coalesce(F.lead("first").over(line), F.first("first").over(line)).alias("t"))
    tails = after.select(F.lit(None).cast(own.schema["id"].dataType).alias("id"), "t", F.lit(0).cast("long").alias("h"), "range", F.lit(1).alias("tail"))
    dealt = ranged.withColumn("tail", F.lit(0)).unionByName(tails).repartition(n, "range")

    order = Window.partitionBy("range").orderBy("tail", F.col("id").isNull(), "id", "h")
    length, cut = F.length("t"), F.floor(F.length("t") / F.lit(part)).cast("int")
    rows = dealt.select("range", "id", "t", "tail", F.row_number().over(order).alias("row"), F.lead("t").over(order).alias("next")).where("tail = 0")
    rows = rows.select("range", "row", "id", "t", length.alias("n_chars"), F.concat(F.substring("t", F.lit(1), length - cut), F.substring("next", F.lit(1), cut)).alias("e"), F.substring("t", F.lit(1), length - cut).alias("kept"))
    shared = F.length(F.regexp_extract("kept", r"(?s)^.*[\x20\x09-\x0D]", 0))  # whole words that both texts begin with
    parts = F.array(
        F.struct(F.substring("t", F.lit(1), shared).alias("x"), F.lit(1).alias("a"), F.lit(1).alias("b")),
        F.struct(F.substring("t", shared + 1, F.col("n_chars")).alias("x"), F.lit(1).alias("a"), F.lit(0).alias("b")),
        F.struct(F.substring("e", shared + 1, F.length("e")).alias("x"), F.lit(0).alias("a"), F.lit(1).alias("b")),
    )
    pieces = rows.select("range", "row", F.explode(parts).alias("p"))
    words = pieces.select("range", "row", "p.a", "p.b", F.explode(F.regexp_extract_all("p.x", F.lit(WORD), F.lit(0))).alias("w"))
    counted = words.select("range", "row", F.xxhash64("w").alias("term"), "a", "b").groupBy("range", "row", "term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    prints = signatures(counted, ["range", "row"], "term", {"fingerprint": F.col("a").cast("double"), "edited_fingerprint": F.col("b").cast("double")})

    facts = rows.select("range", "row", "id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2("e", 256).alias("edited_sha256"))
    none = F.lit("f" * DIGITS * SAMPLES)
    both = facts.join(prints, ["range", "row"], "left").join(F.broadcast(after.select("range", "before")), "range")  # a row for each range
    both = materialise(both.select("id", "n_chars", "edited_sha256", F.coalesce("fingerprint", none).alias("fingerprint"), F.coalesce("edited_fingerprint", none).alias("edited_fingerprint"), (F.col("before") + F.col("row") - 1).alias("at")))
    following = both.select(F.pmod(F.col("at") - 1, F.lit(total if total else 1)).alias("at"), F.col("fingerprint").alias("next_fingerprint"))
    return both.join(following, "at").select(
        F.col("id").alias(id), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(table(spark, sf_dir, "documents"))
