"""Learned decision lists for quality (operator 7), in DataFrame functions only.

Sequential covering grows one conjunction of thresholds after another on two
thirds of the labelled rows, prunes it on the rest and keeps it while it stays
precise. Every growth step is one aggregation into a histogram of
(feature, threshold, label), so the driver sees a few hundred counts whatever
the input. The list becomes one ordered CASE expression.

Defined results: a null or blank text has no words and fails the base rule;
repeated labels of a doc_id count once (lowest quality); labels that are null or
belong to no document are unused; rows with a null or a repeated doc_id are judged
each by its own text; without usable labels the list is empty and
only the base rule decides; further columns of documents pass through untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusguard.llm.common import row_ids, save

_BREAK = r"[\x20\x09-\x0D]+"
_SPACE = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
#: Features of a list and their thresholds, on fixed grids.
_RATIOS = tuple(round(0.02 * i, 2) for i in range(1, 50))
_RATES = tuple(round(0.05 * 1.2**i, 4) for i in range(30))
GRIDS = {
    "symbol_rate": _RATES,
    "repeat_share": _RATIOS,
    "dup_line_share": _RATIOS,
    "upper_share": _RATIOS,
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c >= self.threshold if self.above else c < self.threshold


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out


def measures(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Word, symbol, line and repetition counts of whole texts, and the features of the lists."""
    d = docs.select(*carry, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t"))
    d = d.withColumn("_w", F.array_remove(F.split("_t", _BREAK), ""))
    d = d.withColumn("n_words", F.size("_w").cast("long"))
    hashed = "transform(sequence(0, n_words - 3), i -> named_struct('h', xxhash64(get(_w, int(i)), get(_w, int(i + 1)), get(_w, int(i + 2))), 'i', int(i)))"
    d = d.withColumn("_s", F.expr(f"CASE WHEN n_words >= 3 THEN sort_array({hashed}) ELSE array() END"))
    # Equal hashes are confirmed on the words.
    alike = " AND ".join(f"get(_w, get(_s, j).i + {k}) = get(_w, get(_s, j + 1).i + {k})" for k in range(3))
    same = f"get(_s, j).h = get(_s, j + 1).h AND {alike}"
    d = d.withColumn("_p", F.expr(f"CASE WHEN size(_s) >= 2 THEN transform(sequence(0, size(_s) - 2), j -> {same}) ELSE array(false) END"))
    d = d.withColumn("_d", F.expr("CASE WHEN array_contains(_p, true) THEN sort_array(filter(transform(_s, (x, j) -> CASE WHEN get(_p, j) OR get(_p, j - 1) THEN x.i END), x -> x IS NOT NULL)) ELSE array() END"))
    d = d.withColumn("_n", F.expr("slice(_d, 2, greatest(size(_d), 1))"))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.length(F.translate(x, _SPACE, "")) > 0)
    d = d.withColumn("_l", lines)
    out = d.select(
        *carry,
        "n_words",
        F.length(F.translate("_t", _SPACE, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.expr("aggregate(zip_with(_d, _n, (a, b) -> least(3L, coalesce(bigint(b - a), 3L))), 0L, (s, x) -> s + x)").alias("n_repeat_words"),
        F.size("_l").alias("_lines"),
        (F.length("_t") - F.length(F.translate("_t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).alias("_upper"),
    )
    share = lambda a, b: a / F.greatest(b, F.lit(1))
    return out.select(
        *carry, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share(F.col("n_symbols"), F.col("n_words")).alias("symbol_rate"),
        share(F.col("n_repeat_words"), F.col("n_words")).alias("repeat_share"),
        share(F.col("n_dup_lines"), F.col("_lines")).alias("dup_line_share"),
        share(F.col("_upper"), F.col("word_chars")).alias("upper_share"),
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
    )


def _counts(rows: DataFrame) -> dict[str, list[tuple[int, int]]]:
    """For each feature the (bad, good) rows in each interval of its grid."""
    bins = [F.expr(f"named_struct('f', '{f}', 'b', size(filter(array({', '.join(f'{x}D' for x in g)}), x -> {f} >= x)))") for f, g in GRIDS.items()]
    got = rows.select("quality", F.explode(F.array(*bins)).alias("x")).groupBy("x.f", "x.b").agg(F.sum(1 - F.col("quality")).alias("bad"), F.sum("quality").alias("good")).collect()
    out = {f: [(0, 0)] * (len(g) + 1) for f, g in GRIDS.items()}
    for r in got:
        out[r.f][r.b] = (int(r.bad), int(r.good))
    return out


def _best(counts: dict[str, list[tuple[int, int]]]) -> tuple[Condition, int, int] | None:
    """The condition of highest gain of information about bad rows, of equal ones the middle threshold: (condition, bad, good) it leaves."""
    from math import log2

    found: list[tuple[float, Condition, int, int]] = []
    for f, h in counts.items():
        bad, good = sum(x for x, _ in h), sum(x for _, x in h)
        if not bad:
            return None
        below = (0, 0)
        for i, x in enumerate(GRIDS[f]):
            below = (below[0] + h[i][0], below[1] + h[i][1])
            for above, (p, n) in ((True, (bad - below[0], good - below[1])), (False, below)):
                gain = p * (log2(p / (p + n)) - log2(bad / (bad + good))) if p else 0.0
                if gain > 1e-9:
                    found.append((round(gain, 6), Condition(f, above, x), p, n))
    if not found:
        return None
    top = max(x[0] for x in found)
    first = next(x[1] for x in found if x[0] == top)
    even = [x for x in found if x[0] == top and (x[1].feature, x[1].above) == (first.feature, first.above)]
    return even[len(even) // 2][1:]


def learn(labelled: DataFrame, most_rules: int = 8, most_conditions: int = 3, precision: float = 0.9, least: int = 5) -> list[Rule]:
    """An ordered list of rules that reject; labelled: the features, quality (0 or 1) and doc_id."""
    third = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 0
    grow, prune = labelled.where(~third), labelled.where(third)
    rules: list[Rule] = []
    rest = F.lit(True)
    for _ in range(most_rules):
        conditions: list[Condition] = []
        while len(conditions) < most_conditions:
            best = _best(_counts(grow.where(rest & Rule(tuple(conditions)).column())))
            if best is None:
                break
            conditions.append(best[0])
            if not best[2]:
                break
        if not conditions:
            break
        heads = [Rule(tuple(conditions[: k + 1])) for k in range(len(conditions))]
        sums = [F.coalesce(F.sum(F.when(r.column(), w)), F.lit(0)) for r in heads for w in (1 - F.col("quality"), F.col("quality"))]
        got = [int(x) for x in prune.where(rest).agg(*sums).first()]
        worth = [((p - n) / (p + n) if p + n else -1.0, p, n) for p, n in zip(got[::2], got[1::2], strict=True)]
        k = max(range(len(heads)), key=lambda i: (worth[i][0], -i))
        if worth[k][1] < least or worth[k][1] < precision * (worth[k][1] + worth[k][2]):
            break
        rules.append(heads[k])
        rest = rest & ~heads[k].column()
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1; 0 if none does."""
    out = F.lit(0)
    for i, r in reversed(list(enumerate(rules, 1))):
        out = F.when(r.column(), i).otherwise(out)
    return out


def quality(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry, the measures, base_failed, rule and kept of every document."""
    m = save(measures(docs, carry), "measures")
    truth = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    rules = learn(save(m.join(truth, "doc_id").select("doc_id", "quality", *GRIDS), "labelled"))
    return m.withColumn("rule", verdict(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs that are kept, each judged by its own text, whatever its doc_id."""
    rows = row_ids(docs)
    kept = quality(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"), ("doc_id", "_cg_row")).where("kept").select("_cg_row")
    return rows.join(kept, "_cg_row", "left_semi").select(*docs.columns)


QUERIES = {"op7_decision_lists": op7}
ORACLE: dict[str, str] = {}
