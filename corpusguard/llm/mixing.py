"""Time-varying curriculum over sources (operator 2), in DataFrame functions only.

Sources share the budget by weight, no source beyond CAP times its words (water
filling). Each source's weight schedule is integrated over training time and
scaled to its target, so the source's running word count, inverted through that
integral, is the moment at which a document is trained on. Running counts come
from a two-level prefix sum over hash buckets: no window holds more than a
bucket, so a source with a third of all rows is dealt like any other.

The windows over sources see one row for each source.

Defined results: a null or blank text has size 0, is taken as 0 words and has no
position; null sources are one source, last in order; rows with a null or a
repeated doc_id count each, ties in the shuffled order fall to doc_id; an empty
table gives an empty mix; further columns are ignored by plan() and kept by stage().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusguard.llm.common import row_ids, save

CAP = 3
BUCKET_BITS = 12
#: Weight at the start and at the end of training by class of source (weights 1, 2, 3); straight in between.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
_BREAK = r"[\x20\x09-\x0D]+"


def sizes(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source and the number of words of each text, with the columns carry."""
    words = F.size(F.array_remove(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), _BREAK), ""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words.cast("long").alias("size"), *carry)


def targets(sized: DataFrame) -> DataFrame:
    """source, source_size, target, slot: the words each source owes the mix; a row per source."""
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("slot", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3)
    s = s.withColumn("weight", (F.col("slot") + 1).cast("double")).withColumn("cap", (CAP * F.col("source_size")).cast("double"))
    order = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    s = s.withColumn("open", F.col("cap") > F.col("level") * F.col("weight"))
    level = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)["level"]
    return s.withColumn("level", level).select("source", "source_size", F.when(F.col("open"), F.col("level") * F.col("weight")).otherwise(F.col("cap")).alias("target"), "slot")


def moment(share: Column, slot: Column) -> Column:
    """Training time in [0, 1] by which a source has given this share of its words: the inverse of the integrated schedule."""
    def of(start: float, end: float) -> Column:
        half = (start + end) / 2
        return 2 * half * share / (start + F.sqrt(start * start + 2 * (end - start) * half * share))

    out = F.lit(None).cast("double")
    for k, (start, end) in enumerate(SCHEDULES):
        out = F.when(slot == k, of(start, end)).otherwise(out)
    return out


def plan(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken, position: a row per document.

    Copies go through the source in one shuffled order, pass after pass; the budget
    ends inside one document of each source, of which only the first words are taken.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    d = save(sizes(docs, carry).withColumn("key", key), "sizes")
    t = targets(d)
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    # The first BUCKET_BITS bits of the key order as the key does.
    d = d.withColumn("bucket", F.substring("key", 1, BUCKET_BITS // 4))
    totals = d.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    ahead = totals.withColumn("ahead", F.sum("words").over(Window.partitionBy("source").orderBy("bucket")) - F.col("words")).drop("words")
    ahead = ahead.join(t.withColumnRenamed("source", "_s"), same("source", "_s")).drop("_s")
    ahead = ahead.withColumnsRenamed({"source": "_s", "bucket": "_b"})
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", *carry).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("inside", F.sum("size").over(within) - F.col("size"))
    d = d.join(ahead, (F.col("bucket") == F.col("_b")) & same("source", "_s"))
    d = d.withColumn("offset", F.col("ahead") + F.col("inside")).withColumn("budget", F.round("target").cast("long"))
    passes = F.expr("CASE WHEN source_size > 0 THEN budget DIV source_size ELSE 0 END")
    rest = F.col("budget") - passes * F.col("source_size")
    taken = F.col("size") * passes + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("offset")))
    d = d.withColumn("taken", taken.cast("long"))
    position = F.when(F.col("taken") > 0, moment(F.col("offset") / F.col("budget"), F.col("slot")))
    return d.select("doc_id", "size", "source_size", "target", "taken", position.alias("position"), "source", "offset", "budget", "slot", *carry)


def schedule(planned: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, copy, words, position and the columns carry: a row per copy, range-sorted by position."""
    full = F.expr("CASE WHEN taken > 0 THEN sequence(0L, (taken - 1) DIV size) ELSE array() END")
    d = planned.select("*", F.explode(full).alias("copy"))
    share = (F.col("offset") + F.col("copy") * F.col("source_size")) / F.col("budget")
    d = d.select("doc_id", "copy", F.least(F.col("size"), F.col("taken") - F.col("copy") * F.col("size")).alias("words"), moment(share, F.col("slot")).alias("position"), *carry)
    place = ("position", "doc_id", *carry, "copy")
    return d.repartitionByRange(*place).sortWithinPartitions(*place)


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, position: a row per document, by the copies of the mix as it was written.

    taken sums the words of a document's copies, position is that of its first one.
    """
    row = ("_cg_row",)
    planned = save(plan(row_ids(docs), row), "plan")
    order = save(schedule(planned, row), "order")
    given = order.groupBy(F.col("_cg_row").alias("_r")).agg(F.sum("words").alias("taken"), F.min("position").alias("position"))
    out = planned.drop("taken", "position").hint("merge").join(given.hint("merge"), F.col("_cg_row") == F.col("_r"), "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), "position")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in training order, each as often as the mix takes it.

    A document that the budget cuts is given whole, so texts stay as they were.
    """
    rows, row = row_ids(docs), ("_cg_row",)
    order = schedule(plan(rows, row), row).select(F.col("_cg_row"), F.col("position").alias("_cg_position"), F.col("copy").alias("_cg_copy"))
    out = rows.hint("merge").join(order.hint("merge"), "_cg_row")
    place = ("_cg_position", "doc_id", "_cg_row", "_cg_copy")
    return out.repartitionByRange(*place).sortWithinPartitions(*place).select(*docs.columns)


#: The same mix in SQL: the level of the water is found by the same sums in the same order.
_SQL = """
WITH d AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS slot FROM s
), c AS (
  SELECT *, CAST(slot + 1 AS DOUBLE) AS weight, CAST(3 * source_size AS DOUBLE) AS cap FROM w
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c
), f AS (
  SELECT arg_min(level, cap / weight) AS water FROM l WHERE cap > level * weight
), t AS (
  SELECT source, source_size, slot, CASE WHEN cap > level * weight THEN water * weight ELSE cap END AS target FROM l, f
), o AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.slot, CAST(round(t.target) AS BIGINT) AS budget,
    CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - d.size AS off
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), p AS (
  SELECT *, size * (budget // greatest(source_size, 1)) + greatest(0, least(size, budget % greatest(source_size, 1) - off)) AS taken FROM o
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(taken AS BIGINT) AS taken,
  CASE WHEN taken > 0 THEN CASE slot
    WHEN 0 THEN 2.0::DOUBLE * (off::DOUBLE / budget) / (1.5::DOUBLE + sqrt(2.25::DOUBLE - 2.0::DOUBLE * (off::DOUBLE / budget)))
    WHEN 1 THEN 2.0::DOUBLE * (off::DOUBLE / budget) / (1.0::DOUBLE + sqrt(1.0::DOUBLE + 0.0::DOUBLE * (off::DOUBLE / budget)))
    ELSE 2.0::DOUBLE * (off::DOUBLE / budget) / (0.5::DOUBLE + sqrt(0.25::DOUBLE + 2.0::DOUBLE * (off::DOUBLE / budget))) END END AS position
FROM p
"""

QUERIES = {"op2_curriculum_mixing": op2}
ORACLE = {"op2_curriculum_mixing": _SQL}
