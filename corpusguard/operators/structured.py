"""Answers without a model: label and value pairs, candidates, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters taken off the ends of a value.
_EDGES = " -:\n\t;"


def pairs(text: Column, labels: list[str]) -> Column:
    """Map of label to value: a value runs from its label and colon to the next label; the first value of a label counts."""
    some = "|".join(sorted(labels, key=len, reverse=True))
    cut = F.split(F.regexp_replace(text, rf"({some})\s*:", "\u0001$1\u0002"), "\u0001")
    entries = F.transform(F.filter(cut, lambda x: x.contains("\u0002")), lambda x: F.struct(F.split_part(x, F.lit("\u0002"), F.lit(1)).alias("k"), F.trim(F.split_part(x, F.lit("\u0002"), F.lit(2)), F.lit(_EDGES)).alias("v")))
    entries = F.filter(entries, lambda e: F.length(e["v"]) > 0)
    firsts = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, F.lit(1), i), lambda o: o["k"] == e["k"]))
    return F.map_from_entries(firsts)


def rows(chunks: DataFrame, labels: list[str]) -> DataFrame:
    """chunk_id, values, raw_text: table rows whole, other texts by the line, where a label occurs."""
    lines = F.when(F.col("block_type") == "table_row", F.array("text")).otherwise(F.filter(F.split("text", "\n"), lambda x: x.contains(":")))
    d = chunks.select("chunk_id", F.explode(lines).alias("raw_text"))
    return d.withColumn("values", pairs(F.col("raw_text"), labels)).where(F.size("values") > 0)


def score(candidates: DataFrame) -> DataFrame:
    """Score of candidates (entities, fields, title, raw_text, values, block_type) for a question; -1 where terms exist and none hits."""
    hit = F.size(F.filter("entities", lambda e: F.lower("raw_text").contains(F.lower(e))))
    titled = F.size(F.filter("entities", lambda e: F.lower(F.coalesce("title", F.lit(""))).contains(F.lower(e))))
    exact = F.exists("entities", lambda e: F.lower(e) == F.lower(F.coalesce("title", F.lit(""))))
    got = F.size(F.filter("fields", lambda f: F.map_contains_key("values", f)))
    block = F.when(F.col("block_type") == "table_row", 35).when(F.col("block_type") == "text_section", 15).otherwise(10)
    total = F.when(exact, 240).otherwise(0) + 100 * titled + 45 * hit + 35 * got + F.when((F.size("fields") > 0) & (got == F.size("fields")), 80).otherwise(0) + block + F.when(F.length(F.coalesce("title", F.lit(""))) > 0, 10).otherwise(0)
    terms = F.size("entities") + F.size("fields")
    return candidates.withColumn("score", F.when((terms > 0) & (hit + titled + got == 0), -1).otherwise(total))


def best(scored: DataFrame) -> DataFrame:
    """The best candidate of each question: most fields, then score; distinct by chunk and values."""
    d = scored.where("score > 0").withColumn("_v", F.array_sort(F.map_entries("values"))).dropDuplicates(["query_id", "chunk_id", "_v"])
    w = Window.partitionBy("query_id").orderBy(F.desc(F.size("values")), F.desc("score"), "chunk_id")
    return d.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_v")


def format_fields(values: Column, fields: Column) -> Column:
    return F.array_join(F.transform(F.filter(fields, lambda f: F.map_contains_key(values, f)), lambda f: F.concat(f, F.lit(": "), F.element_at(values, f))), "\n")


def prompts(contexts: DataFrame) -> DataFrame:
    """query_id, prompt: the question over its numbered context texts (query_id, question, rank, source, text)."""
    items = F.sort_array(F.collect_list(F.struct("rank", "source", "text")))
    g = contexts.groupBy("query_id", "question").agg(items.alias("items"))
    body = F.array_join(F.transform("items", lambda x: F.concat(F.lit("["), x["rank"].cast("string"), F.lit("] source="), x["source"], F.lit("\n"), x["text"])), "\n\n")
    return g.select("query_id", F.concat(F.lit("Answer from the context only.\n\n"), body, F.lit("\n\nQuestion: "), F.col("question")).alias("prompt"))
