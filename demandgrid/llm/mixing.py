"""Mixing sources to target weights by capped water-filling, in DataFrame operations alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandgrid.llm.shared import ROW_BYTES, WORD, checked_broadcast, written


def word_count(text: str = "text") -> Column:
    """Number of words of a text; null counts 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def water_filled(sources: DataFrame, weights: Sequence[int] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """Adds ``target`` to one row per source (source, source_size).

    Sources in code-point order, null last, weigh ``weights`` in turn and share the sum of all sizes. A target stops at
    ``max_epochs`` times its source's size; what lies above is shared again by weight among the others. Sorted by
    size per weight, the clamped sources are a prefix, so prefix sums find the level in one pass over the sources.
    The two windows without a partition hold one row per source. All sizes 0: all targets 0; no rows: no rows.
    """
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weighted = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")))
    capped = weighted.withColumn("cap", F.col("source_size") * max_epochs)
    by_level = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, onwards = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double")
        / F.sum("weight").over(onwards)
    )
    filled = capped.withColumns({"place": F.row_number().over(by_level), "level": level})
    free = F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct("place", "level"))
    first_free = F.min(free).over(everything)
    return filled.withColumn("free", first_free).select(
        "source", "source_size",
        F.when(F.col("free").isNull() | (F.col("place") < F.col("free.place")), F.col("cap").cast("double"))
        .otherwise(F.col("free.level") * F.col("weight")).alias("target"),
    )


def mix(
    docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_epochs: int = 3, seed: int = 17, per_bucket: int = 1000
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken): how often the mix takes each document.

    Every document of a source is taken floor(target / source size) times. For the fraction left, the source's
    documents are lined up by a seeded hash of their id, and those lying at least half below the missing words are taken
    once more; so the source's words differ from the target by half a document at most. The line is a prefix sum
    on two levels: over hash buckets of about ``per_bucket`` documents each, then within a bucket, so a source with
    a third of all rows is spread like any other. Other columns of ``docs``, whatever their names, are not read.

    Null texts and empty texts have size 0 and are taken as often as their source's whole epochs, with 0 words, never once more.
    A null source is a source of its own, a null doc_id hashes as the word null. Repeated rows are separate documents;
    which of several identical rows gets the extra copy cannot be told apart. An empty table gives no rows.
    """
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    sized = written(
        docs.select(
            "doc_id", "source", word_count().alias("size"),
            F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long").alias("spot"),
        ),
        "mix-sizes",
    )
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    targets = water_filled(per_source.select("source", "source_size"), weights, max_epochs).withColumnRenamed("source", "s")
    plan = (
        per_source.select("source", F.ceil(F.col("n") / per_bucket).alias("buckets"))
        .join(targets, F.col("source").eqNullSafe(F.col("s"))).drop("s")
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("missing", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    plan = written(plan, "mix-plan").withColumnRenamed("source", "s")
    bucket = F.floor(F.col("spot") * F.col("buckets") / F.lit(float(1 << 32)))
    placed = sized.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("bucket", bucket)
    in_line = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
        .select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("words").over(in_line), F.lit(0)).alias("start"))
    )
    in_bucket = Window.partitionBy("source", "bucket").orderBy("spot", F.col("doc_id").asc_nulls_last(), "size")
    start = F.col("start") + F.coalesce(F.sum("size").over(in_bucket.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (
        placed.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
        .withColumn("copies", F.col("whole") + F.when((F.col("size") > 0) & (start + F.col("size") / 2 <= F.col("missing")), 1).otherwise(0))
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
    )


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents themselves: each row of ``docs`` as often as ``mix`` takes it, with the columns of ``docs``.

    A null id is replaced by a hash of source and text while mixing. Rows that repeat an id share its copies evenly.
    """
    own, number = (f"__{name}_{'_'.join(docs.columns)}" for name in ("node", "copies"))  # longer than any name in docs
    node = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("source", "text"))
    mixed = mix(docs.select(node.alias("doc_id"), "source", "text"), **options)
    copies = written(mixed.groupBy("doc_id").agg(F.round(F.avg("copies")).cast("int").alias("copies")), "mix-copies")
    taken = docs.withColumn(own, node).join(checked_broadcast(copies.toDF(own, number), ROW_BYTES * copies.count()), own).where(F.col(number) > 0)
    return taken.withColumn(number, F.explode(F.sequence(F.lit(1), F.col(number)))).select(docs.columns)


OP10_SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) AS spot
  FROM documents),
per_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n,
         [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, 3 * source_size AS cap, row_number() OVER by_level AS place,
         CAST((SELECT sum(source_size) FROM per_source) - coalesce(sum(3 * source_size) OVER (by_level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
         / sum(weight) OVER (by_level ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM per_source WINDOW by_level AS (ORDER BY 3 * source_size / weight, source NULLS LAST)),
free AS (SELECT min(place) AS place, min_by(level, place) AS level FROM levels WHERE level * weight < cap),
plan AS (
  SELECT source, source_size, n,
         CASE WHEN f.place IS NULL OR l.place < f.place THEN CAST(cap AS DOUBLE) ELSE f.level * weight END AS target
  FROM levels l CROSS JOIN free f),
placed AS (
  SELECT s.doc_id, s.size, p.source_size, p.target,
         CASE WHEN p.source_size > 0 THEN floor(p.target / p.source_size) ELSE 0 END AS whole,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.spot, s.doc_id NULLS LAST, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN start + size / 2 <= target - whole * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM placed"""


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    """Nulls, empty and long texts, ties, repeated rows and empty tables: see :func:`mix`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
