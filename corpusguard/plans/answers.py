"""Queries over questions, structured answers and prompts, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusguard.functions.dialect import CHECK, SPARK
from corpusguard.functions.sqlrun import chain, run
from corpusguard.operators import query as Q
from corpusguard.operators import structured as S
from corpusguard.plans.detection import _docs, spliced_sql

LABELS = ["Program", "Training Duration", "Contact"]


def label_value_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = run(spliced_sql(SPARK), "SELECT * FROM spliced", documents=_docs(spark, sf_dir))
    p = d.select("doc_id", S.pairs(F.col("text"), LABELS).alias("v")).where(F.size("v") > 0)
    return p.select("doc_id", *[F.element_at("v", F.lit(k)).alias(k.lower().replace(" ", "_")) for k in LABELS])


_VALUE = "trim(regexp_extract(text, '{0}\\s*:((?s:.*?))(?:$|Program\\s*:|Training Duration\\s*:|Contact\\s*:)', 1), ' -:;' || chr(10) || chr(9))"
_PAIRS = chain(spliced_sql(CHECK), "SELECT doc_id, " + ", ".join(f"{_VALUE.format(k)} AS {k.lower().replace(' ', '_')}" for k in LABELS) + " FROM spliced WHERE regexp_matches(text, 'Program\\s*:')")


def query_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    k = Q.keywords(F.col("text"))
    return b.select("item_id", F.size(k).cast("long").alias("n_keywords"), F.md5(F.array_join(k, " ")).alias("keywords"))


_KEYWORDS = """WITH w AS (SELECT item_id, unnest(regexp_extract_all(text, '[가-힣A-Za-z0-9]+')) AS w, unnest(range(len(regexp_extract_all(text, '[가-힣A-Za-z0-9]+')))) AS i FROM benchmark), f AS (SELECT item_id, w, min(i) AS i FROM w WHERE length(w) >= 2 GROUP BY item_id, w)
    SELECT item_id, count(*) AS n_keywords, md5(string_agg(w, ' ' ORDER BY i)) AS keywords FROM f GROUP BY item_id"""


def query_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of the benchmark texts, one for each."""
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    p = Q.profile(b.select(F.col("item_id").cast("long").alias("query_id"), "text"))
    return p.select("query_id", F.size("keywords").alias("n_keywords"), F.array_join("fields", ",").alias("fields"), F.array_join("compare_entities", ",").alias("entities"), "is_compare", "is_summary", "exact_lookup", Q.use_rag(F.col("text"), F.lit(0.5), F.lit(1.0)).alias("rag"))


def prompt_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).where("doc_id < 300").select((F.col("doc_id") % 10).alias("query_id"), F.concat(F.lit("q"), (F.col("doc_id") % 10).cast("string")).alias("question"), F.col("doc_id").alias("rank"), "source", F.substring("text", 1, 80).alias("text"))
    return S.prompts(d).select("query_id", F.md5("prompt").alias("prompt"))


_PROMPTS = "SELECT doc_id % 10 AS query_id, md5('Answer from the context only.' || chr(10) || chr(10) || string_agg('[' || doc_id || '] source=' || source || chr(10) || substring(text, 1, 80), chr(10) || chr(10) ORDER BY doc_id) || chr(10) || chr(10) || 'Question: q' || (doc_id % 10)) AS prompt FROM documents WHERE doc_id < 300 GROUP BY doc_id % 10"

QUERIES: dict = {
    "label_value_pairs": (label_value_pairs, _PAIRS),
    "query_keywords": (query_keywords, _KEYWORDS),
    "query_profile": (query_profile, None),
    "prompt_assembly": (prompt_assembly, _PROMPTS),
}
