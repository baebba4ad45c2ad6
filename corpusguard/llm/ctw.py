"""Context-tree weighting over bytes (operator 1).

Each byte is eight binary decisions; for each decision a tree over the preceding
DEPTH bytes holds Krichevsky-Trofimov counts, and every node halves its weight
between its own estimate and its children's product. The counts and the weights
are Spark aggregations by (context, decision), level by level; texts meet the
model through blocks: a block of documents sends its distinct n-grams and words
once, and gets back one number for each of them.

A text is its lower-cased words with one space between them, after a start mark and
before an end mark, so the probabilities of all texts add up to one. Where a context was never seen, the
mixture ends at the deepest one that was.

Defined results: a null text is empty and scores its end mark; rows with equal
doc_id are scored each; a null doc_id counts as training; without training rows
every decision costs one bit; other columns are ignored. bits_per_byte is the code
length of the words so joined, by their bytes and the end mark.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from corpusguard.llm.common import _LOWER, _WS, blocks, release, save, slices, words

DEPTH = 5
BLOCK_BYTES = 32 << 20
_START, _END = 0xFE, 0xFF
_END_WORD = np.uint64(0x5EED0FE4D)
_GRAM, _WORD = 0, 1


def canonical(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows as their lower-cased words with one space between, and the new offsets."""
    _, starts, woffs = words(data, offs)
    space = _WS[data]
    keep = ~space
    inner = np.ones(len(starts), bool)
    inner[woffs[:-1][woffs[:-1] < len(starts)]] = False
    keep[starts[inner] - 1] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    return np.where(space, np.uint8(0x20), _LOWER[data])[keep], at[offs]


def grams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The DEPTH + 1 bytes that end at each byte and at the end mark of each row, and the rows' offsets."""
    rows = len(offs) - 1
    pad = DEPTH + 1
    b = np.full(len(data) + pad * rows, _START, np.uint8)
    at = np.arange(len(data)) + np.repeat(np.arange(rows) * pad + DEPTH, np.diff(offs))
    b[at] = data
    ends = offs[1:] + np.arange(rows) * pad + DEPTH
    b[ends] = _END
    key = np.zeros(len(b) - DEPTH, np.uint64)
    for j in range(pad):
        key = (key << np.uint64(8)) | b[j : j + len(key)]
    wanted = np.ones(len(b), bool)
    wanted[: len(b)].reshape(-1)[(ends[:, None] - np.diff(offs)[:, None] - DEPTH + np.arange(DEPTH)).ravel()] = False
    return key[np.flatnonzero(wanted) - DEPTH], offs + np.arange(rows + 1)


def row_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of each row with its end token, and the rows' offsets."""
    h, _, woffs = words(data, offs)
    rows = len(offs) - 1
    out = np.full(len(h) + rows, _END_WORD)
    out[np.arange(len(h)) + np.repeat(np.arange(rows), np.diff(woffs))] = h
    return out, woffs + np.arange(rows + 1)


def _tally(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    uniq, where = np.unique(key, return_inverse=True)
    return uniq, np.bincount(where, n, len(uniq)).astype(np.int64)


class Tally:
    """Distinct keys and how often training rows have them, merged as slices come: no more is held than about twice the distinct keys."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, key: np.ndarray, train: np.ndarray) -> None:
        seen, n = np.unique(key[train], return_counts=True)
        other = np.unique(key[~train])
        self.parts.append(_tally(np.concatenate([seen, other]), np.concatenate([n, np.zeros(len(other), np.int64)])))
        while len(self.parts) > 1 and 2 * len(self.parts[-1][0]) > len(self.parts[-2][0]):
            self._join()

    def _join(self) -> None:
        (b, n), (a, m) = self.parts.pop(), self.parts.pop()
        if len(a) < len(b):
            a, m, b, n = b, n, a, m
        # The keys of both are sorted, so the fewer ones go into their places among the others.
        at = np.searchsorted(a, b)
        held = a[np.minimum(at, len(a) - 1)] == b if len(a) else np.zeros(len(b), bool)
        m[at[held]] += n[held]
        at = at[~held]
        self.parts.append((np.insert(a, at, b[~held]), np.insert(m, at, n[~held])))

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        while len(self.parts) > 1:
            self._join()
        return self.parts[0] if self.parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _count(table):
    """The distinct n-grams and words of a block and how often its training rows have them."""
    parts = {_GRAM: Tally(), _WORD: Tally()}
    train = ~table.column("held_out").to_numpy()
    for i, j, data, offs in slices(table.column("text")):
        for kind, (key, o) in ((_GRAM, grams(*canonical(data, offs))), (_WORD, row_words(data, offs))):
            parts[kind].add(key, np.repeat(train[i:j], np.diff(o)))
    out = []
    block = table.column("block")[0].as_py()
    for kind, found in parts.items():
        key, n = found.result()
        out.append(pa.table({"kind": pa.array(np.full(len(key), kind, np.int32)), "key": key.view(np.int64), "block": pa.array(np.full(len(key), block, np.int32)), "n": n}))
    del parts, found, key, n
    release()
    return pa.concat_tables(out)


class Lookup:
    """Vectorised open addressing from 64-bit keys to their places."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys, np.uint64(0))
        self.bits = max(4, int(2 * len(keys)).bit_length() + 1)
        self.slots = np.full(1 << self.bits, len(keys), np.int32)
        todo = np.arange(len(keys), dtype=np.int32)
        at = self._hash(keys)
        while len(todo):
            free = self.slots[at] == len(keys)
            self.slots[at[free]] = todo[free]
            lost = self.slots[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def _hash(self, keys):
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, the number of keys where there is none."""
        none = len(self.keys) - 1
        at = self._hash(keys)
        out = self.slots[at]
        todo = np.flatnonzero((out != none) & (self.keys[out] != keys))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            out[todo] = self.slots[at[todo]]
            todo = todo[(out[todo] != none) & (self.keys[out[todo]] != keys[todo])]
        return out


def _score(total_words: int, distinct_words: int):
    def run(texts, model):
        if not texts.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "held_out": pa.array([], pa.bool_()), "n_tokens": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()), "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64()), "n_bytes": pa.array([], pa.int64())})
        kind, key = model.column("kind").to_numpy(), model.column("key").to_numpy().view(np.uint64)
        value = model.column("value").to_numpy()
        is_gram = kind == _GRAM
        find, logs = Lookup(key[is_gram]), np.append(value[is_gram], np.nan)
        train = ~texts.column("held_out").to_numpy()
        # Words that no other block has were not sent back: their count is the block's own.
        seen = Tally()
        for i, j, data, offs in slices(texts.column("text")):
            h, o = row_words(data, offs)
            seen.add(h, np.repeat(train[i:j], np.diff(o)))
        own, count = seen.result()
        word = Lookup(own)
        count[word(key[~is_gram])] = value[~is_gram].astype(np.int64)
        cost = np.log10((count + 0.1) / (total_words + 0.1 * (distinct_words + 1)))
        got: list[list[np.ndarray]] = [[], [], [], [], []]
        for _, _, data, offs in slices(texts.column("text")):
            h, o = row_words(data, offs)
            at = word(h)
            c, co = canonical(data, offs)
            k, ko = grams(c, co)
            for out, x in zip(got, (np.diff(o), np.add.reduceat((count[at] > 0).astype(np.int64), o[:-1]), np.add.reduceat(cost[at], o[:-1]), np.add.reduceat(logs[find(k)], ko[:-1]), np.diff(co)), strict=True):
                out.append(x)
        n, known, base, score, size = (np.concatenate(x) for x in got)
        del find, logs, word, count, cost, own, seen, at, c, co, k, ko, h, o, data, offs
        release()
        return pa.table({"doc_id": texts.column("doc_id"), "held_out": texts.column("held_out"), "n_tokens": n, "n_known": known, "base_score": base, "score": score, "n_bytes": size})

    return run


def _lgamma(x: str) -> str:
    """SQL of log gamma for x >= 0.5: Stirling's series seven steps up."""
    z = f"({x} + 7D)"
    down = " * ".join(f"({x} + {i}D)" for i in range(7))
    return f"(({z} - 0.5D) * ln({z}) - {z} + 0.9189385332046727D + 1 / (12 * {z}) - 1 / (360 * {z} * {z} * {z}) - ln({down}))"


#: Log probability of a zeros and b ones under the Krichevsky-Trofimov estimate.
_KT = f"{_lgamma('(a + 0.5D)')} + {_lgamma('(b + 0.5D)')} - 1.1447298858494002D - {_lgamma('(a + b + 1D)')}"


def tree(counts: DataFrame) -> DataFrame:
    """key, log10p: the model's log10 probability of the last byte of each n-gram after the others.

    counts: key and total; n-grams of held-out rows take part with total 0.
    """
    bits = "posexplode(array(128, 64, 32, 16, 8, 4, 2, 1)) AS (i, m)"
    steps = counts.selectExpr("key", "total", bits).selectExpr(
        "key", "shiftright(key, 8) AS context", "shiftleft(1, i) | shiftright(CAST(key & 255 AS INT), 8 - i) AS node", "CASE WHEN (key & m) <> 0 THEN 1 ELSE 0 END AS bit", "total"
    )
    level = steps.groupBy("context", "node").agg(F.sum(F.expr("CASE WHEN bit = 0 THEN total ELSE 0 END")).alias("a"), F.sum(F.expr("total * bit")).alias("b"))
    # Levels are kept as counts and, above the leaves, the product below; estimates and weights follow from them.
    levels = [save(level, "level")]
    weighted = levels[0].selectExpr("*", f"{_KT} AS pw")
    for depth in range(DEPTH - 1, -1, -1):
        level = weighted.groupBy(F.expr(f"context & {(1 << 8 * depth) - 1}L").alias("context"), "node").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("pw").alias("below"))
        levels.append(save(level, "level"))
        weighted = levels[-1].selectExpr("*", f"{_KT} AS pe").selectExpr("context", "node", "a", "b", "greatest(pe, below) + ln(1 + exp(-abs(pe - below))) - 0.6931471805599453D AS pw")

    def owned(t: DataFrame) -> DataFrame:
        """The share of a node's weight that its own estimate holds; all of it at the leaves."""
        if "below" not in t.columns:
            return t.selectExpr("*", "1D AS own")
        return t.selectExpr("*", f"{_KT} AS pe").selectExpr("*", "1 / (1 + exp(least(below - pe, 700D))) AS own").drop("pe", "below")

    one = "(b + 0.5D) / (a + b + 1)"
    down = owned(levels.pop()).selectExpr("context", "node", f"{one} AS p", f"own * {one} AS mixed", "1 - own AS rest")
    for depth in range(1, DEPTH + 1):
        up = down.selectExpr("context AS _c", "node AS _n", "p AS _p", "mixed AS _m", "rest AS _r")
        level = owned(levels.pop())
        if depth > 2:
            # Written levels are far smaller than their rows in memory, so none that grows may be broadcast; the two above hold 65,280 nodes at most.
            level, up = level.hint("merge"), up.hint("merge")
        j = level.join(up, (F.expr(f"context & {(1 << 8 * (depth - 1)) - 1}L") == F.col("_c")) & (F.col("node") == F.col("_n")))
        seen = "a + b > 0"
        down = j.selectExpr("context", "node", f"CASE WHEN {seen} THEN _m + _r * {one} ELSE _p END AS p", f"_m + _r * own * {one} AS mixed", "_r * (1 - own) AS rest")
    leaves = down.selectExpr("context AS _c", "node AS _n", "p")
    j = steps.select("key", "context", "node", "bit").hint("merge").join(leaves.hint("merge"), (F.col("context") == F.col("_c")) & (F.col("node") == F.col("_n")))
    return j.groupBy("key").agg(F.sum(F.expr("log10(CASE WHEN bit = 1 THEN p ELSE 1 - p END)")).alias("log10p"))


def code_lengths(docs: DataFrame, held_out, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Scores of all rows by a model of those for which held_out (a Column) is false."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    size = d.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = blocks(size, block_bytes)
    d = d.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))
    seen = d.groupBy("block").applyInArrow(_count, "kind int, key long, block int, n long")
    by_key = Window.partitionBy("kind", "key")
    seen = seen.withColumns({"total": F.sum("n").over(by_key), "first": F.row_number().over(by_key.orderBy("block")) == 1})
    facts = Observation()
    seen = seen.observe(facts, F.coalesce(F.sum(F.when(F.col("kind") == _WORD, F.col("n"))), F.lit(0)).alias("words"), F.count_if((F.col("kind") == _WORD) & F.col("first") & (F.col("total") > 0)).alias("distinct"))
    seen = save(seen.where((F.col("kind") == _GRAM) | (F.col("n") != F.col("total"))).drop("n"), "seen")
    model = tree(save(seen.where((F.col("kind") == _GRAM) & F.col("first")).select("key", "total"), "grams"))
    # One value a row: an n-gram's log probability, a word's count.
    grams_back = seen.where(F.col("kind") == _GRAM).select("block", "key").hint("merge").join(model, "key")
    words_back = seen.where(F.col("kind") == _WORD).select("block", "kind", "key", F.col("total").cast("double").alias("value"))
    back = grams_back.select("block", F.lit(_GRAM).alias("kind"), "key", F.col("log10p").alias("value")).union(words_back)
    known = facts.get
    out = d.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_score(known["words"], known["distinct"]), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long")
    return out.withColumn("train_tokens", F.lit(known["words"]).cast("long")).withColumn("bits_per_byte", -F.col("score") * 3.321928094887362 / (F.col("n_bytes") + 1))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = code_lengths(spark.read.parquet(f"{sf_dir}/documents.parquet"), F.crc32(F.col("doc_id").cast("string")) % 10 == 0)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


QUERIES = {"op1_context_tree_weighting": op1}
ORACLE: dict[str, str] = {}
