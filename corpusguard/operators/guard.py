"""The query-time guard: query risk, access policy, decision, exclusions, removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusguard.functions import fixed
from corpusguard.functions.dialect import SPARK, Dialect
from corpusguard.functions.sqlrun import Steps, run
from corpusguard.operators.detector import clamp, feature_steps, matched, r4, raw, sat, score_steps

#: Weights and thresholds of the balanced guard.
WEIGHTS = {"query": 0.24, "interaction": 0.36, "context": 0.24, "rbac": 0.16}
LEVELS = {"critical": 0.86, "high": 0.68, "medium": 0.36}
HIGH_FLOOR, MEDIUM_FLOOR, QUERY_ONLY = 0.72, 0.38, 0.28
REMOVE = {"high": 0.48, "critical": 0.42, "medium": 0.14}
BLOCK_QUERY, BLOCK_RBAC = 0.78, 0.68
MIN_SAFE, MIN_RATIO = 2, 0.40
CHUNK_LIMIT = 3


def query_steps(d: Dialect, source: str) -> Steps:
    """query_scored: source (text, domain) with the risk of each text as a query."""
    counted = ", ".join(f"{d.array(*[d.count('text', p, s) for _, _, _, p, s in rules])} AS {c}" for c, rules in (("cj", fixed.JAILBREAK_RULES), ("cs", fixed.SENSITIVE_RULES), ("cp", fixed.PRIVILEGE_RULES)))
    j, s, p = sat(raw(d, "cj", fixed.JAILBREAK_RULES), 2.2), sat(raw(d, "cs", fixed.SENSITIVE_RULES), 2.8), sat(raw(d, "cp", fixed.PRIVILEGE_RULES), 2.0)
    return [
        *feature_steps(d, source), *score_steps(d, with_stats=False),
        ("q_counts", f"SELECT *, {counted} FROM scored"),
        ("query_scored", f"SELECT *, {r4(clamp(f'0.18E0 * instructionality_score + 0.10E0 * refusal_inducing_score + 0.30E0 * {j} + 0.24E0 * {s} + 0.18E0 * {p}'))} AS query_risk, {r4(j)} AS jailbreak_score, {r4(s)} AS sensitive_score, {r4(p)} AS privilege_score, {r4(clamp(f'0.8E0 * greatest({s}, {p}) + 0.2E0 * instructionality_score'))} AS detail_score, {matched(d, 'cj', fixed.JAILBREAK_RULES)} + {matched(d, 'cs', fixed.SENSITIVE_RULES)} + {matched(d, 'cp', fixed.PRIVILEGE_RULES)} AS query_rules FROM q_counts"),
    ]


def query_risk(queries: DataFrame) -> DataFrame:
    q = queries if "domain" in queries.columns else queries.withColumn("domain", F.lit(""))
    return run(query_steps(SPARK, "query_in"), "SELECT * FROM query_scored", query_in=q)


def _analysed(texts: DataFrame) -> DataFrame:
    """texts (domain, text, plain) with the detector's scores of text and restriction_raw, the weighted hits of restriction rules in plain."""
    counted = SPARK.array(*[SPARK.count("plain", p, s) for _, _, _, p, s in fixed.RESTRICTION_RULES])
    steps = [*feature_steps(SPARK, "guard_texts"), *score_steps(SPARK, with_stats=False), ("limited", f"SELECT *, {counted} AS cx FROM scored")]
    return run(steps, f"SELECT *, {raw(SPARK, 'cx', fixed.RESTRICTION_RULES)} AS restriction_raw FROM limited", guard_texts=texts)


def _saturated(x: Column, point: float) -> Column:
    return F.when(x <= 0, 0.0).otherwise(x / (x + point))


def _unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def _four(x: Column) -> Column:
    return F.floor(x * 10000 + 0.5) / 10000.0


def chunk_interaction(pairs: DataFrame) -> DataFrame:
    """pairs with what a query makes of each retrieved chunk: signals, interaction_boost, reasons, runtime_chunk_risk.

    pairs: query_id, chunk_id, query, text, the query's detail_score, jailbreak_score,
    sensitive_score and privilege_score, and if known refusal_inducing_score,
    instructionality_score, adjusted_risk and base_risk of the chunk (null or missing: 0).
    Chunks without text are left out. Both analyses, of the text and of query and text, are
    projections of the row: nothing is exchanged.
    """
    known = {f"known_{c}": (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in pairs.columns else F.lit(0.0)) for c in ("refusal_inducing_score", "instructionality_score", "adjusted_risk", "base_risk")}
    p = pairs.where(F.col("text") != "").withColumns(known).drop(*[c[6:] for c in known])
    have = [x for x in p.columns if x != "text"]
    p = _analysed(p.withColumns({"domain": F.lit(""), "plain": F.col("text")})).select(
        *have, F.col("text").alias("_text"), F.col("refusal_inducing_score").alias("_r"), F.col("instructionality_score").alias("_i"), _saturated(F.col("restriction_raw"), 1.8).alias("_x"),
    )
    p = _analysed(p.withColumns({"text": F.concat_ws("\n", F.coalesce("query", F.lit("")), "_text"), "domain": F.lit(""), "plain": F.lit("")}))
    p = p.select(*have, F.col("_text").alias("text"), "_r", "_i", "_x", F.col("adjusted_risk").alias("combined_risk"))
    c = F.col
    detail, jail, sensitive, privilege, limit = c("detail_score"), c("jailbreak_score"), c("sensitive_score"), c("privilege_score"), c("_x")
    p = p.withColumns({"restriction_signal": F.greatest("known_refusal_inducing_score", "_r"), "instruction_signal": F.greatest("known_instructionality_score", "_i"), "precomputed_risk": F.greatest("known_adjusted_risk", "known_base_risk")})
    restriction, instruction, before = c("restriction_signal"), c("instruction_signal"), c("precomputed_risk")
    # Weights and thresholds of the interaction.
    boost = 0.34 * detail * restriction + 0.24 * jail * F.greatest(instruction, c("combined_risk")) + 0.22 * sensitive * restriction + 0.20 * privilege * F.greatest(restriction, before)
    why = {
        "detail_request_x_restriction": (detail > 0) & (restriction >= 0.08),
        "query_override_x_instructionality": (jail > 0) & (instruction >= 0.12),
        "sensitive_query_x_refusal": (sensitive > 0) & (restriction >= 0.08),
        "privilege_query_x_sensitive_context": (privilege > 0) & (((before >= 0.12) & (F.greatest(restriction, instruction) >= 0.06)) | (limit >= 0.18)),
        "context_restriction_pattern": limit >= 0.22,
    }
    p = p.withColumns({"boost": boost, "reasons": F.array_compact(F.array(*[F.when(x, F.lit(k)) for k, x in why.items()]))})
    risk = _unit(0.48 * c("combined_risk") + 0.18 * before + 0.14 * restriction + 0.10 * instruction + 0.10 * c("boost"))
    risk = _four(_unit(risk + 0.10 * limit + 0.08 * _unit(F.size("reasons") / 3.0)))
    return p.withColumns({"runtime_chunk_risk": risk, "interaction_boost": _four(c("boost")), "restriction_pattern_score": _four(limit)}).drop("boost", "_x", "_r", "_i", *known)


def context_set(chunks: DataFrame) -> DataFrame:
    """query_id, interaction_risk, context_risk and the rules of each: the chunks of a query one by one, and read together.

    chunks: output of chunk_interaction with rank, and source and block_index (nulls: never
    adjacent). A query's chunks are what its retrieval cut, so their texts fit one row; a
    query without chunks has no row. One exchange by query serves windows and sums.
    """
    w = Window.partitionBy("query_id").orderBy("rank", "chunk_id")
    by_refusal = Window.partitionBy("query_id").orderBy(F.desc("restriction_signal"), "chunk_id")
    r, high = F.col("restriction_signal"), 0.14
    near = (F.col("source") != "") & (F.lag("source").over(w) == F.col("source")) & (F.abs(F.lag("block_index").over(w) - F.col("block_index")) <= 1) & (F.greatest(F.lag(r).over(w), r) >= high)
    risk = F.col("runtime_chunk_risk")
    by_risk = Window.partitionBy("query_id").orderBy(F.desc(risk), "chunk_id")
    c = chunks.withColumns({"_near": near, "_n": F.row_number().over(by_refusal), "_m": F.row_number().over(by_risk)})
    g = c.groupBy("query_id").agg(
        F.first("query").alias("query"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "text"))), lambda x: x["text"]), "\n").alias("plain"),
        F.sum(F.when(F.col("_n") <= 3, r)).alias("worst"), F.count_if(r >= high).alias("risky"), F.count("*").alias("n"), F.count_if("_near").alias("pairs"),
        F.max(risk).alias("top"), F.avg(F.when(F.col("_m") <= 2, risk)).alias("two"), F.avg(F.when(risk >= 0.42, 1.0).otherwise(0.0)).alias("ratio"),
    )
    x = _analysed(g.withColumns({"text": F.concat_ws("\n", F.coalesce("query", F.lit("")), "plain"), "domain": F.lit("")}))
    # Weights and thresholds of the set.
    x = x.withColumns({
        "aggregate_refusal_pressure": _unit(F.col("worst") / 0.65), "risky_chunk_count_score": _unit(F.col("risky") / F.least(F.lit(3), F.col("n"))),
        "adjacent_shift_score": _unit(F.col("pairs") / 2.0), "context_pattern_score": _saturated(F.col("restriction_raw"), 2.4),
    })
    score = 0.32 * F.col("adjusted_risk") + 0.18 * F.col("risky_chunk_count_score") + 0.18 * F.col("aggregate_refusal_pressure") + 0.12 * F.col("adjacent_shift_score") + 0.20 * F.col("context_pattern_score")
    interaction = F.array_compact(F.array(F.when(F.col("top") >= 0.45, F.lit("high_risk_chunk_query_interaction")), F.when(F.col("ratio") >= 0.34, F.lit("multi_chunk_query_interaction"))))
    rules = {"aggregate_refusal_pressure": ("aggregate_refusal_pressure", 0.28), "adjacent_context_shift": ("adjacent_shift_score", 0.5), "context_restriction_pattern_cluster": ("context_pattern_score", 0.24)}
    said = F.array_compact(F.array(*[F.when(F.col(k) >= v, F.lit(name)) for name, (k, v) in rules.items()]))
    alone = _four(_unit(0.55 * F.col("top") + 0.25 * F.col("two") + 0.20 * F.col("ratio")))
    return x.select("query_id", alone.alias("interaction_risk"), interaction.alias("interaction_rules"), _four(_unit(score)).alias("context_risk"), said.alias("context_rules"))


#: Names of levels, marks of departments (in a file's name, in its path), roles and ranks that may see more.
LEVEL_NAMES = {"public": ("public", "open"), "internal": ("internal", "inhouse"), "restricted": ("restricted", "sensitive"), "confidential": ("confidential", "secret")}
DEPT_MARKS = (("security", ("sec-",), ("보안",)), ("it", ("it-", "vpn"), ("원격접속",)), ("hr", ("hr-",), ("인사",)), ("finance", ("fin-",), ("경비", "급여")))
DEPT_LEVELS = {"security": "restricted", "it": "internal", "hr": "internal", "finance": "internal"}
PRIVILEGED_ROLES = ("admin", "security_admin", "system", "it_admin", "security", "owner")
PRIVILEGED_RANKS = ("director", "head", "executive", "manager")


def _among(e: str, values: tuple[str, ...]) -> str:
    return f"({e} IN ({', '.join(f"'{v}'" for v in values)}))" if values else "false"


def policy_sql(path: str, dept: str = "''", level: str = "''") -> tuple[str, str]:
    """owner_dept and security_level of a chunk: as its columns say, else by its path; null counts as empty.

    The level's SQL reads the column owner_dept.
    """
    low = f"lower(coalesce({path}, ''))"
    name, own, said = f"regexp_replace({low}, '^.*/', '')", f"lower(trim(coalesce({dept}, '')))", f"lower(trim(coalesce({level}, '')))"
    found = " ".join(f"WHEN {' OR '.join([*(f"instr({name}, '{w}') > 0" for w in names), *(f"instr({low}, '{w}') > 0" for w in paths)])} THEN '{k}'" for k, names, paths in DEPT_MARKS)
    known = " ".join(f"WHEN {_among(said, names)} THEN '{k}'" for k, names in LEVEL_NAMES.items())
    by = "CASE owner_dept " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in DEPT_LEVELS.items()) + " ELSE 'public' END"
    return f"CASE WHEN {own} <> '' THEN {own} {found} ELSE 'general' END", f"CASE {known} WHEN {said} IN ('', 'unknown') THEN {by} ELSE {said} END"


def rbac_sql(role: str, dept: str, rank: str = "''", levels: tuple[str, ...] = (), depts: tuple[str, ...] = ()) -> str:
    """Severity of showing a chunk to a user who asks a query; 0 for who may see it, and where the query asks for nothing special.

    Reads owner_dept, security_level, sensitive_score, privilege_score, detail_score; levels and depts are open to all.
    """
    role, dept, rank = (f"lower(coalesce({x}, ''))" for x in (role, dept, rank))
    free = [
        _among(role, PRIVILEGED_ROLES), "security_level = 'public'", f"(security_level IN ('internal', 'restricted', 'confidential') AND {dept} <> '' AND {dept} = owner_dept)",
        f"({_among(rank, PRIVILEGED_RANKS)} AND owner_dept IN ({dept}, 'general'))", _among("security_level", levels), _among("owner_dept", depts),
    ]
    detailed = "greatest(privilege_score, detail_score) >= 0.16E0"
    by_level = f"CASE WHEN security_level IN ('restricted', 'confidential') AND greatest(sensitive_score, privilege_score) >= 0.18E0 THEN 0.72E0 WHEN security_level = 'internal' AND {detailed} THEN 0.46E0 ELSE 0.0E0 END"
    across = f"CASE WHEN {dept} <> '' AND owner_dept NOT IN ('general', {dept}) AND {detailed} THEN 0.42E0 ELSE 0.0E0 END"
    return f"CASE WHEN {' OR '.join(free)} THEN 0.0E0 ELSE greatest({by_level}, {across}) END"


def decision_steps(source: str) -> Steps:
    """decided: source (query_risk, interaction_risk, context_risk, rbac_risk, attempts, hotspots) with risk, level and action."""
    q, i, c, r = "query_risk", "interaction_risk", "context_risk", "rbac_risk"
    base = f"({WEIGHTS['query']}E0 * {q} + {WEIGHTS['interaction']}E0 * {i} + {WEIGHTS['context']}E0 * {c} + {WEIGHTS['rbac']}E0 * {r})"
    floor = f"greatest({base}, CASE WHEN {q} >= 0.55 AND {i} >= 0.58 THEN {HIGH_FLOOR}E0 ELSE 0.0E0 END, CASE WHEN {r} >= 0.60 THEN {HIGH_FLOOR}E0 WHEN {r} >= 0.34 AND {i} >= 0.34 THEN {MEDIUM_FLOOR}E0 ELSE 0.0E0 END, CASE WHEN {i} >= 0.34 AND {c} >= 0.34 THEN {MEDIUM_FLOOR}E0 ELSE 0.0E0 END)"
    level = "CASE " + " ".join(f"WHEN risk >= {v} THEN '{k}'" for k, v in LEVELS.items()) + " ELSE 'low' END"
    return [
        ("g_risk", f"SELECT *, {r4(clamp(f'CASE WHEN {q} >= 0.45 AND {i} < 0.20 AND {c} < 0.20 AND {r} < 0.20 THEN least({floor}, {QUERY_ONLY}E0) ELSE {floor} END'))} AS risk FROM {source}"),
        ("g_level", f"SELECT *, {level} AS runtime_level FROM g_risk"),
        ("decided", "SELECT *, CASE runtime_level WHEN 'low' THEN 'allow' WHEN 'medium' THEN CASE WHEN attempts >= 1 AND hotspots > 0 THEN 'remove' ELSE 'requery' END ELSE 'remove' END AS runtime_action FROM g_level"),
    ]


def decide(rows: DataFrame) -> DataFrame:
    return run(decision_steps("guard_in"), "SELECT * FROM decided", guard_in=rows)


def requery_exclusions(chunks: DataFrame, limit: int = CHUNK_LIMIT, least: float = 0.24) -> DataFrame:
    """query_id, chunk_id, source of the worst chunks of a query, limit at most, and whether the source has two of them.

    chunks: query_id, chunk_id, source, chunk_risk, rbac_risk, pattern_score, n_reasons.
    """
    score = F.col("chunk_risk") + 0.10 * F.col("rbac_risk") + 0.06 * F.col("pattern_score") + 0.04 * F.least("n_reasons", F.lit(3))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "chunk_id")
    c = chunks.where(F.col("chunk_risk") >= least).withColumn("score", score).withColumn("_n", F.row_number().over(w))
    n = F.count("*").over(Window.partitionBy("query_id", "source"))
    return c.withColumn("source_excluded", n >= 2).where(F.col("_n") <= limit).drop("_n")


def remove_chunks(chunks: DataFrame) -> DataFrame:
    """chunks with removed, and per query whether what is left is usable, else block or fallback.

    chunks: query_id, chunk_id, chunk_risk, runtime_level, query_risk, rbac_risk.
    """
    limit = F.lit(9.0)
    for k, v in REMOVE.items():
        limit = F.when(F.col("runtime_level") == k, v).otherwise(limit)
    c = chunks.withColumn("removed", F.col("chunk_risk") >= limit)
    w = Window.partitionBy("query_id")
    left, total = F.count_if(~F.col("removed")).over(w), F.count("*").over(w)
    usable = (left >= MIN_SAFE) & (left >= MIN_RATIO * total)
    block = (F.col("runtime_level") == "critical") | (F.col("query_risk") >= BLOCK_QUERY) | (F.col("rbac_risk") >= BLOCK_RBAC)
    return c.withColumn("outcome", F.when(usable, "remove").when(block, "block").otherwise("fallback"))
