"""The three-signal detector: rule scores, structural outlier score, risk and level.

One projection: the two halves that the shift score compares are handled as an
array of texts inside the row, so scoring never shuffles; the only exchange is the
per-domain statistics and their join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from corpusguard.functions import fixed
from corpusguard.functions.dialect import SPARK, Dialect
from corpusguard.functions.sqlrun import Steps, run

#: Thresholds of the profiles.
BALANCED = {
    "instruction_high": 0.62, "instruction_medium": 0.42, "refusal_high": 0.62, "refusal_medium": 0.42, "refusal_extreme": 0.82,
    "outlier_moderate": 0.35, "outlier_high": 0.58, "medium_risk": 0.35, "medium_floor": 0.37,
    "cluster_refusal_medium": 0.14, "cluster_refusal_low": 0.11, "cluster_outlier_medium": 0.17, "cluster_outlier_support": 0.20,
    "strong_pair_outlier_support": 0.17, "high_risk": 0.64, "critical_risk": 0.86, "high_floor": 0.72, "critical_floor": 0.90,
}
PROFILES = {
    "balanced": ((0.35, 0.40, 0.25), BALANCED),
    "strict": ((0.32, 0.43, 0.25), BALANCED | {"medium_risk": 0.32, "high_risk": 0.60, "critical_risk": 0.82, "medium_floor": 0.35, "high_floor": 0.68, "critical_floor": 0.88, "cluster_refusal_low": 0.10, "cluster_refusal_medium": 0.13, "cluster_outlier_medium": 0.16, "cluster_outlier_support": 0.18}),
    "research": ((0.33, 0.42, 0.25), BALANCED | {"medium_risk": 0.34, "high_risk": 0.62, "critical_risk": 0.84, "medium_floor": 0.36, "high_floor": 0.70, "critical_floor": 0.89, "cluster_refusal_low": 0.10, "cluster_refusal_medium": 0.12, "cluster_outlier_medium": 0.15, "cluster_outlier_support": 0.18}),
}
#: Refusal rules that count as strong.
STRONG = ("detailed_info_restricted_ko", "security_reason_no_detail_ko", "internal_sensitive_ko", "unsafe_restricted_ko", "limited_response_en", "security_reason_no_detail_en", "limited_detail_en")
TOKEN = r"[A-Za-z0-9가-힣]+"
SENTENCE = r"[.!?。！？\n]+"
BULLET = r"^\s*(?:[-*•]|\d+[.)])\s+"
MIDSTREAM = r"^.{40,}?(?:\bquestion\s*:|\binstruction\s*:|\bresponse\s*:|\buser\s*:|\bassistant\s*:|질문\s*:|지시\s*:|응답\s*:|사용자\s*:|어시스턴트\s*:)"
SHIFT = (
    r"(?:however|but|instead|regardless of the question|for any user request|그러나|하지만|대신|질문과 상관없이|어떤 질문이 와도).{0,80}?"
    r"(?:ignore|refuse|decline|cannot help|do not answer|respond with|무시|거부|거절|답하지 마|도와줄 수 없)"
)
STATS = ("char_length", "avg_sentence_length", "modal_ratio", "policy_density", "punctuation_density")


def clamp(e: str) -> str:
    return f"greatest(0.0E0, least(1.0E0, {e}))"


def sat(raw: str, point: float) -> str:
    return f"(CASE WHEN {raw} <= 0 THEN 0.0E0 ELSE {raw} / ({raw} + {point}E0) END)"


def r4(e: str) -> str:
    return f"(floor(({e}) * 10000 + 0.5E0) / 10000.0E0)"


def terms(d: Dialect, lowered: str, words: tuple[str, ...]) -> str:
    return d.occurrences(lowered, words, "hits")


def counts(d: Dialect, x: str, rules: tuple) -> str:
    return d.when_held("hits", d.array(*[d.count(x, p, dotall, "hits") for _, _, _, p, dotall in rules]), f"array_repeat(0, {len(rules)})")


def raw(d: Dialect, column: str, rules: tuple) -> str:
    """Weights of the rules times their counts, two at most."""
    return d.when_held("hits", d.dot(column, [w for _, w, *_ in rules]), "0.0E0")


def raw_of_text(d: Dialect, x: str, rules: tuple) -> str:
    return raw(d, counts(d, x, rules), rules)


def names(d: Dialect, column: str, rules: tuple) -> str:
    return d.filter(d.array(*[f"CASE WHEN {d.at(column, i)} > 0 THEN '{n}' END" for i, (n, *_) in enumerate(rules)]), "x", "x IS NOT NULL")


def matched(d: Dialect, column: str, rules: tuple, only: tuple[str, ...] | None = None) -> str:
    """How many of the rules (or of those named) have a match."""
    return d.when_held("hits", d.positive(column, [i for i, (n, *_) in enumerate(rules) if only is None or n in only], len(rules)), "0")


def tokens(d: Dialect, x: str) -> str:
    return d.every(f"lower({x})", TOKEN)


def lines(d: Dialect, x: str) -> str:
    return d.filter(d.transform(d.split(x, r"\r\n|[\n\r]"), "q", d.strip("q")), "q", "q <> ''")


def sentences(d: Dialect, x: str) -> str:
    return d.filter(d.transform(d.split(x, SENTENCE), "q", d.strip("q")), "q", "q <> ''")


def markers(d: Dialect, x: str) -> str:
    return "(" + " + ".join(d.count(x, m, hits="hits") for m in fixed.PROMPT_MARKERS) + ")"


def ratio(a: str, b: str) -> str:
    return f"(CASE WHEN {b} = 0 THEN 0.0E0 ELSE CAST({a} AS DOUBLE) / {b} END)"


def pressure(d: Dialect, x: str) -> str:
    """Raw parts of the semantic pressure of one half, the column x, with its lower case in low_x."""
    return d.struct(
        i=raw_of_text(d, x, fixed.INSTRUCTION_RULES), r=raw_of_text(d, x, fixed.REFUSAL_RULES), e=raw_of_text(d, x, fixed.EXPLICIT_RULES), n=d.size(tokens(d, x)), l=f"greatest(1, {d.size(lines(d, x))})",
        m=markers(d, x), b=d.count(x, BULLET), p=terms(d, f"low_{x}", fixed.POLICY_TERMS), o=terms(d, f"low_{x}", fixed.MODAL_TERMS),
    )


def _half(d: Dialect, side: str) -> dict[str, str]:
    """refusal, policy, format and pressure of a half from its raw parts."""
    s = f"{side}."
    refusal = clamp(f"0.75E0 * {sat(s + 'r', 4.5)} + 0.25E0 * {sat(s + 'e', 2.0)}")
    policy = clamp(f"{ratio(s + 'p', s + 'n')} / 0.05E0")
    modal = clamp(f"{ratio(s + 'o', s + 'n')} / 0.08E0")
    form = clamp(f"0.65E0 * {clamp(f'CAST({s}m AS DOUBLE) / {s}l / 0.12E0')} + 0.35E0 * {clamp(f'CAST({s}b AS DOUBLE) / {s}l / 0.30E0')}")
    return {"refusal": refusal, "policy": policy, "form": form, "pressure": clamp(f"0.30E0 * {sat(s + 'i', 5.0)} + 0.38E0 * {refusal} + 0.14E0 * {policy} + 0.10E0 * {form} + 0.08E0 * {modal}")}


def feature_steps(d: Dialect, source: str) -> Steps:
    """features: every column of source (which has text and domain) with the raw features of its text."""
    mid = "greatest(1, CAST(floor(length(text) / 2) AS INT))"
    space = f"CASE WHEN instr(reverse(substring(text, 1, {mid} + 80)), ' ') = 0 THEN -1 ELSE length(substring(text, 1, {mid} + 80)) - instr(reverse(substring(text, 1, {mid} + 80)), ' ') END"
    half = d.div("n_sentences", "2")
    # A word holds no space and no sentence end, so a half has none that its text has not.
    rules = [p for group in (fixed.INSTRUCTION_RULES, fixed.REFUSAL_RULES, fixed.EXPLICIT_RULES) for _, _, _, p, _ in group] + [*fixed.PROMPT_MARKERS, MIDSTREAM, SHIFT]
    held = [("f_low", f"SELECT *, {d.words_held('text', 'low', rules, fixed.MODAL_TERMS + fixed.POLICY_TERMS)} AS hits FROM f_lower")] if d is SPARK else []
    return [
        ("f_parts", f"SELECT *, lower(text) AS low, {tokens(d, 'text')} AS toks, {lines(d, 'text')} AS lns, {sentences(d, 'text')} AS sents FROM {source}"),
        ("f_mid", f"SELECT *, {d.size('toks')} AS n_tokens, {d.size('lns')} AS n_lines, {d.size('sents')} AS n_sentences, {mid} AS mid, {space} AS sp FROM f_parts"),
        ("f_cut", "SELECT *, CAST(CASE WHEN sp >= greatest(1, mid - 80) THEN sp ELSE mid END AS INT) AS cut FROM f_mid"),
        ("f_half", f"""SELECT *, CASE WHEN n_sentences >= 4 THEN {d.join(d.part('sents', '1', f'CAST({half} AS INT)'), "' '")} ELSE {d.strip('substring(text, 1, cut)')} END AS front,
            CASE WHEN n_sentences >= 4 THEN {d.join(d.part('sents', f'CAST({half} + 1 AS INT)', 'CAST(n_sentences AS INT)'), "' '")} ELSE {d.strip('substring(text, cut + 1, length(text))')} END AS back FROM f_cut"""),
        ("f_lower" if held else "f_low", "SELECT *, lower(front) AS low_front, lower(back) AS low_back FROM f_half"),
        *held,
        ("f_counts", f"""SELECT *, {counts(d, 'text', fixed.INSTRUCTION_RULES)} AS ci, {counts(d, 'text', fixed.REFUSAL_RULES)} AS cr, {counts(d, 'text', fixed.EXPLICIT_RULES)} AS ce,
            {terms(d, 'low', fixed.MODAL_TERMS)} AS modal_count, {terms(d, 'low', fixed.POLICY_TERMS)} AS policy_count, {markers(d, 'text')} AS marker_count, {d.count('text', BULLET)} AS bullet_count,
            CASE WHEN {d.has('text', MIDSTREAM, True, 'hits')} THEN 1 ELSE 0 END AS midstream, CASE WHEN {d.has('text', SHIFT, True, 'hits')} THEN 1 ELSE 0 END AS discourse,
            {pressure(d, 'front')} AS pf, {pressure(d, 'back')} AS pb, {d.transform('lns', 'q', d.replace('lower(q)', chr(92) + 's+', "' '"))} AS nlns, {d.pairs('toks')} AS bigrams FROM f_low"""),
        ("features", f"""SELECT *, CAST(length(text) AS DOUBLE) AS char_length, CAST(n_tokens AS DOUBLE) / greatest(1, n_sentences) AS avg_sentence_length, {ratio('modal_count', 'n_tokens')} AS modal_ratio, {ratio('policy_count', 'n_tokens')} AS policy_density,
            CAST(length({d.replace('text', kept_class(d), "''")}) AS DOUBLE) / greatest(1, length(text)) AS punctuation_density,
            CAST(marker_count AS DOUBLE) / greatest(1, n_lines) AS marker_density, CAST(bullet_count AS DOUBLE) / greatest(1, n_lines) AS bullet_density,
            CASE WHEN n_tokens = 0 THEN 0.0E0 ELSE greatest(1 - CAST({d.distinct('toks')} AS DOUBLE) / n_tokens, CASE WHEN n_lines > 0 THEN 1 - CAST({d.distinct('nlns')} AS DOUBLE) / n_lines ELSE 0.0E0 END, CASE WHEN n_tokens > 1 THEN 1 - CAST({d.distinct('bigrams')} AS DOUBLE) / (n_tokens - 1) ELSE 0.0E0 END) END AS repetition_ratio,
            CASE WHEN midstream + discourse = 2 THEN 1.0E0 WHEN midstream + discourse = 1 THEN 0.65E0 ELSE 0.0E0 END AS flow_shift FROM f_counts"""),
    ]


def kept_class(d: Dialect) -> str:
    """Characters that are no punctuation: letters, digits, underscore, white space."""
    return r"[\p{L}\p{N}_\s\x{00A0}]+" if d is SPARK else r"[\p{L}\p{N}_\s\x{0B}\x{00A0}]"


def stat_steps(source: str = "features", by: str = "domain") -> Steps:
    """stats: mean and population deviation of five features per domain; a flat or single feature has deviation 1."""
    cols = ", ".join(f"avg({c}) AS {c}_mean, CASE WHEN count(*) < 2 OR stddev_pop({c}) <= 1E-9 THEN 1.0E0 ELSE stddev_pop({c}) END AS {c}_std" for c in STATS)
    return [("stats", f"SELECT {by} AS stat_domain, {cols} FROM {source} GROUP BY {by}")]


def score_steps(d: Dialect, profile: str = "balanced", with_stats: bool = True, weights: tuple[float, float, float] | None = None) -> Steps:
    """scored: features with the three scores, base and adjusted risk, level and rules; needs features (and stats)."""
    (wi, wr, wo), t = PROFILES[profile]
    wi, wr, wo = (max(0.0, w) for w in weights or (wi, wr, wo))
    total = wi + wr + wo
    wi, wr, wo = (wi / total, wr / total, wo / total) if total > 0 else PROFILES[profile][0]
    z = lambda c, two: clamp(f"{'abs' if two else ''}(({c} - {c}_mean) / {c}_std) / 3")
    if with_stats:
        length, sentence, modal, policy, punct = (z(c, k < 2) for k, c in enumerate(STATS))
        source = "features JOIN stats ON domain = stat_domain"
    else:
        length = f"(CASE WHEN char_length < 80 THEN {clamp('(80 - char_length) / 80')} ELSE {clamp('(char_length - 1800) / 1800')} END)"
        sentence = f"(CASE WHEN avg_sentence_length < 4 THEN {clamp('(4 - avg_sentence_length) / 4')} ELSE {clamp('(avg_sentence_length - 35) / 35')} END)"
        modal, policy, punct = clamp("modal_ratio / 0.08E0"), clamp("policy_density / 0.05E0"), clamp("greatest(0.0E0, punctuation_density - 0.18E0) / 0.18E0")
        source = "features"
    f, b = ({k: f"{h}.{k}" for k in ("refusal", "policy", "form", "pressure")} for h in ("hf", "hb"))
    delta = {k: f"greatest(0.0E0, {b[k]} - {f[k]})" for k in f}
    late = "(CASE WHEN pf.m = 0 AND pb.m > 0 THEN 1.0E0 ELSE 0.0E0 END)"
    shift = clamp(f"0.42E0 * {delta['pressure']} + 0.26E0 * {delta['refusal']} + 0.14E0 * {delta['policy']} + 0.10E0 * {delta['form']} + 0.08E0 * {late}")
    feats = {
        "length_deviation": length, "sentence_length_deviation": sentence, "modal_ratio": modal, "policy_term_density": policy, "prompt_marker_density": clamp("marker_density / 0.12E0"),
        "instruction_format_density": clamp("bullet_density / 0.30E0"), "flow_shift": "flow_shift", "semantic_shift": "semantic_shift", "punctuation_density": punct, "repetition": clamp("repetition_ratio / 0.35E0"), "perplexity": "0.0E0",
    }
    outlier = clamp(" + ".join(f"{w}E0 * fs_{k}" for k, w in fixed.OUTLIER_WEIGHTS.items()))
    risk = _risk_steps(t)
    return [
        ("s_half", f"SELECT *, {d.struct(**_half(d, 'pf'))} AS hf, {d.struct(**_half(d, 'pb'))} AS hb FROM {source}"),
        ("s_shift", f"SELECT *, CASE WHEN front = '' OR back = '' THEN 0.0E0 WHEN {f['pressure']} <= 0.12E0 AND {b['pressure']} >= 0.42E0 THEN greatest({shift}, 0.58E0) ELSE {shift} END AS semantic_shift FROM s_half"),
        ("s_feats", "SELECT *, " + ", ".join(f"{e} AS fs_{k}" for k, e in feats.items()) + " FROM s_shift"),
        ("s_scores", f"""SELECT *, {r4(clamp(f"0.55E0 * {sat(raw(d, 'ci', fixed.INSTRUCTION_RULES), 6.0)} + 0.15E0 * {clamp('marker_density / 0.15E0')} + 0.10E0 * {clamp('bullet_density / 0.30E0')} + 0.10E0 * {clamp('modal_ratio / 0.06E0')} + 0.10E0 * {clamp('policy_density / 0.05E0')}"))} AS instructionality_score,
            {r4(clamp(f"0.52E0 * {sat(raw(d, 'cr', fixed.REFUSAL_RULES), 5.5)} + 0.28E0 * {sat(raw(d, 'ce', fixed.EXPLICIT_RULES), 2.5)} + 0.12E0 * {clamp('policy_density / 0.05E0')} + 0.08E0 * {clamp('modal_ratio / 0.08E0')}"))} AS refusal_inducing_score,
            {r4(outlier)} AS outlier_score, {matched(d, 'ci', fixed.INSTRUCTION_RULES)} AS n_instruction, {matched(d, 'cr', fixed.REFUSAL_RULES)} AS n_refusal, {matched(d, 'ce', fixed.EXPLICIT_RULES)} AS n_explicit,
            {matched(d, 'cr', fixed.REFUSAL_RULES, STRONG)} AS n_strong FROM s_feats"""),
        ("s_base", f"SELECT *, {r4(f'{wi}E0 * instructionality_score + {wr}E0 * refusal_inducing_score + {wo}E0 * outlier_score')} AS base_risk FROM s_scores"),
        *risk,
    ]


def _risk_steps(t: dict[str, float]) -> Steps:
    i, r, o, n = "instructionality_score", "refusal_inducing_score", "outlier_score", "(n_refusal + n_explicit)"
    g1 = [
        (f"n_explicit > 0 AND {r} >= {t['refusal_extreme']}", t["critical_floor"], "explicit_high_risk_refusal_escalation"),
        (f"n_explicit >= 2 AND ({r} >= {t['medium_risk']} OR {i} >= {t['instruction_medium']}E0 * 0.7E0 OR {o} >= {t['outlier_moderate']}E0 * 0.8E0)", t["high_floor"], "multiple_explicit_high_risk_patterns"),
        (f"n_explicit > 0 AND {r} >= {t['refusal_medium']} AND ({o} >= {t['outlier_moderate']} OR {i} >= {t['instruction_medium']})", t["high_floor"], "explicit_pattern_with_supporting_signals"),
    ]
    g2 = [
        (f"{n} >= 3 AND {r} >= {t['cluster_refusal_medium']} AND {o} >= {t['cluster_outlier_medium']}", t["medium_floor"], "refusal_pattern_cluster_medium"),
        (f"{n} >= 2 AND {r} >= {t['cluster_refusal_low']} AND {o} >= {t['cluster_outlier_support']}", t["medium_floor"], "refusal_pattern_pair_with_outlier"),
        (f"n_strong >= 2 AND {r} >= {t['cluster_refusal_low']}E0 * 0.9E0 AND {o} >= {t['strong_pair_outlier_support']}", t["medium_floor"], "strong_refusal_pair_medium"),
    ]
    rule = lambda g: "CASE " + " ".join(f"WHEN {c} THEN '{k}'" for c, _, k in g) + " END"
    floor = lambda g: "CASE " + " ".join(f"WHEN {c} THEN {v}E0" for c, v, _ in g) + " ELSE 0.0E0 END"
    both = f"{i} >= {t['instruction_high']} AND {r} >= {t['refusal_high']}"
    d4 = f"{i} >= {t['instruction_high']} AND {r} < {t['refusal_medium']} AND {o} < {t['outlier_moderate']}"
    d5 = f"{r} >= {t['refusal_high']} AND {i} < {t['instruction_medium']} AND {o} < {t['outlier_moderate']}"
    d6 = f"{o} >= {t['outlier_high']} AND ({i} >= {t['instruction_medium']} OR {r} >= {t['refusal_medium']})"
    return [
        ("r_1", f"""SELECT *, {rule(g1)} AS rule_1, {rule(g2)} AS rule_2, CASE WHEN {both} AND {o} >= {t['outlier_moderate']} THEN 'multi_signal_high_risk' WHEN {both} THEN 'dual_signal_instruction_refusal' END AS rule_3,
            CASE WHEN {d4} THEN 'instruction_only_dampening' END AS rule_4, CASE WHEN {d5} THEN 'refusal_only_dampening' END AS rule_5, CASE WHEN {d6} THEN 'outlier_supporting_signal' END AS rule_6,
            greatest(base_risk, {floor(g1)}, {floor(g2)}, CASE WHEN {both} AND {o} >= {t['outlier_moderate']} THEN greatest({t['high_floor']}E0, base_risk + 0.18E0) WHEN {both} THEN base_risk + 0.08E0 ELSE 0.0E0 END) AS risk_a FROM s_base"""),
        ("r_2", "SELECT *, least(risk_a, CASE WHEN rule_4 IS NOT NULL THEN greatest(0.0E0, base_risk - 0.12E0) ELSE 9.0E0 END, CASE WHEN rule_5 IS NOT NULL THEN greatest(0.0E0, base_risk - 0.10E0) ELSE 9.0E0 END) AS risk_b FROM r_1"),
        ("r_3", f"SELECT *, {clamp('CASE WHEN rule_6 IS NOT NULL THEN greatest(risk_b, base_risk + 0.08E0) ELSE risk_b END')} AS risk_c FROM r_2"),
        ("scored", f"SELECT *, {r4('risk_c')} AS adjusted_risk, CASE WHEN risk_c >= {t['critical_risk']} THEN 'critical' WHEN risk_c >= {t['high_risk']} THEN 'high' WHEN risk_c >= {t['medium_risk']} THEN 'medium' ELSE 'low' END AS risk_level, CONCAT_WS(',', rule_1, rule_2, rule_3, rule_4, rule_5, rule_6) AS triggered_rules FROM r_3"),
    ]


def score_chunks(chunks: DataFrame, profile: str = "balanced", stats: DataFrame | None = None, with_stats: bool = True) -> DataFrame:
    """chunks (domain, text and any others) with features, scores, risk and level.

    stats: the statistics to compare with (corpus_stats); by default the chunks' own.
    """
    inputs = {"chunk_in": chunks} | ({"stats": stats} if stats is not None else {})
    steps = feature_steps(SPARK, "chunk_in") + (stat_steps() if with_stats and stats is None else []) + score_steps(SPARK, profile, with_stats)
    return run(steps, "SELECT * FROM scored", **inputs)


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """stat_domain and the mean and deviation of the five features per domain."""
    return run(feature_steps(SPARK, "chunk_in") + stat_steps(), "SELECT * FROM stats", chunk_in=chunks)
