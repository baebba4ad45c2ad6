"""Ingestion policy: language, document-context rules, routing and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusguard.functions.dialect import Dialect
from corpusguard.functions.sqlrun import Steps, run
from corpusguard.operators.detector import PROFILES

#: Action of each level, and multiplier of flagged results.
ACTIONS = {"low": "index", "medium": "review", "high": "quarantine", "critical": "quarantine"}
FLAGGED_MULTIPLIER = 0.85
OVERRIDE = 0.37
LEVELS = ("low", "medium", "high", "critical")
_RANK = "CASE risk_level WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END"


def language(text: str, d: Dialect) -> str:
    """ko, en, mixed or unknown by the scripts that occur."""
    ko, en = d.has(text, "[가-힣]"), d.has(text, "[a-zA-Z]")
    return f"CASE WHEN {ko} AND {en} THEN 'mixed' WHEN {ko} THEN 'ko' WHEN {en} THEN 'en' ELSE 'unknown' END"


def context_steps(source: str = "scored", doc: str = "doc_id", order: str = "ordinal", profile: str = "balanced") -> Steps:
    """adjusted: source after the rules that look at the neighbours and the whole document; only low chunks change.

    order: what puts a document's chunks in sequence.
    """
    t = PROFILES[profile][1]
    n = "(n_refusal + n_explicit)"
    w, o = f"(PARTITION BY {doc})", f"(PARTITION BY {doc} ORDER BY {order})"
    r, i, s = "refusal_inducing_score", "instructionality_score", "outlier_score"
    near = lambda e: f"greatest(coalesce(lag({e}) OVER {o}, 0), coalesce(lead({e}) OVER {o}, 0))"
    far = " OR ".join(f"abs({f}({c}) OVER {o} - {c}) >= 0.10" for f in ("lag", "lead") for c in (r, i))
    rules = [
        (f"{n} >= 1 AND {r} >= 0.11 AND {s} >= 0.16 AND doc_patterns >= 0.25", "document_refusal_density_support"),
        (f"{r} >= 0.10 AND near_refusal >= 0.11 AND greatest({s}, near_outlier) >= 0.16 AND ({n} >= 1 OR near_patterns >= 1)", "adjacent_refusal_consistency"),
        (f"abrupt AND greatest({r}, near_refusal) >= 0.11 AND greatest({s}, near_outlier) >= 0.17 AND doc_risk >= 0.18", "adjacent_abrupt_shift_support"),
        (f"{r} >= 0.09 AND {s} >= 0.15 AND doc_refusal >= 0.34 AND doc_risk >= 0.18", "document_level_aggregate_support"),
    ]
    raised = f"greatest(adjusted_risk, {OVERRIDE}E0)"
    level = f"CASE WHEN {raised} >= {t['critical_risk']} THEN 'critical' WHEN {raised} >= {t['high_risk']} THEN 'high' WHEN {raised} >= {t['medium_risk']} THEN 'medium' ELSE 'low' END"
    return [
        ("c_near", f"SELECT *, {near(r)} AS near_refusal, {near(n)} AS near_patterns, {near(s)} AS near_outlier, coalesce({far}, false) AS abrupt, avg(CASE WHEN {r} >= 0.11 THEN 1.0E0 ELSE 0.0E0 END) OVER {w} AS doc_refusal, avg(CASE WHEN {n} >= 1 THEN 1.0E0 ELSE 0.0E0 END) OVER {w} AS doc_patterns, max(adjusted_risk) OVER {w} AS doc_risk FROM {source}"),
        ("c_rule", f"SELECT *, CASE WHEN risk_level <> 'low' THEN NULL {' '.join(f'WHEN {c} THEN {chr(39)}{k}{chr(39)}' for c, k in rules)} END AS context_rule FROM c_near"),
        ("adjusted", f"SELECT *, CASE WHEN context_rule IS NULL THEN adjusted_risk ELSE {raised} END AS final_risk, CASE WHEN context_rule IS NULL THEN risk_level ELSE {level} END AS final_level, CONCAT_WS(',', CASE WHEN triggered_rules = '' THEN NULL ELSE triggered_rules END, context_rule) AS final_rules FROM c_rule"),
        ("routed", "SELECT *, CASE final_level " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ACTIONS.items()) + " ELSE 'index' END AS action FROM adjusted"),
    ]


def adjust(scored: DataFrame, doc: str = "doc_id", order: str = "ordinal", profile: str = "balanced") -> DataFrame:
    return run(context_steps("scored_in", doc, order, profile), "SELECT * FROM routed", scored_in=scored)


def split_routes(routed: DataFrame) -> dict[str, DataFrame]:
    """index (review included), flagged and quarantined chunks."""
    return {"index": routed.where("action <> 'quarantine'"), "flagged": routed.where("action = 'review'"), "quarantined": routed.where("action = 'quarantine'")}


def document_summary(routed: DataFrame, domain: str = "domain", doc: str = "doc_id") -> DataFrame:
    """Counts by level and action and the highest level, per document and (doc null) per domain."""
    counts = [F.count_if(F.col("final_level") == v).alias(v) for v in LEVELS]
    actions = [F.count_if(F.col("action") == a).alias(n) for a, n in (("review", "review_required"), ("quarantine", "quarantined"))]
    g = routed.rollup(domain, doc).agg(F.count("*").alias("total_chunks"), *counts, *actions, F.grouping_id().alias("_g")).where("_g < 3")
    highest = F.when(F.col("critical") > 0, "critical").when(F.col("high") > 0, "high").when(F.col("medium") > 0, "medium").otherwise("low")
    return g.withColumn("highest_risk", highest).drop("_g")


def top_rules(routed: DataFrame, k: int = 12, rules: str = "final_rules") -> DataFrame:
    """rule, count: the most frequent triggered rules."""
    r = routed.where(F.length(rules) > 0).select(F.explode(F.split(rules, ",")).alias("rule"))
    return r.groupBy("rule").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "rule").limit(k)


def filter_results(results: DataFrame, chunks: DataFrame, excluded: DataFrame | None = None, include_flagged: bool = False, include_quarantined: bool = False) -> DataFrame:
    """results (chunk_id, score) with drop_reason and the penalised score; what is not dropped has a null reason.

    Reasons in order: excluded at run time, quarantined, flagged.
    """
    r = results.join(chunks.select("chunk_id", "action"), "chunk_id", "left")
    if excluded is not None:
        r = r.join(excluded.select("chunk_id", F.lit(True).alias("_x")).distinct(), "chunk_id", "left")
    else:
        r = r.withColumn("_x", F.lit(None).cast("boolean"))
    reason = F.when(F.col("_x"), "runtime_excluded")
    if not include_quarantined:
        reason = reason.when(F.col("action") == "quarantine", "quarantined")
    if not include_flagged:
        reason = reason.when(F.col("action") == "review", "flagged")
    score = F.when(F.col("action") == "review", F.col("score") * FLAGGED_MULTIPLIER).otherwise(F.col("score"))
    return r.withColumn("drop_reason", reason).withColumn("final_score", score).drop("_x")


def rank_of(level: str = "risk_level") -> str:
    return _RANK.replace("risk_level", level)


def chunk_order() -> Window:
    """The sequence of stored chunks: page, block, sub-block, then the id as text."""
    return Window.partitionBy("source").orderBy(F.coalesce("page", F.lit(-1)), F.coalesce("block_index", F.lit(10**6)), F.coalesce("sub_block_index", F.lit(0)), "chunk_id")
