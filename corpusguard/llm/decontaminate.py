"""Benchmark decontamination by edit distance (operator 9).

A passage of any length holds a benchmark item if a quarter of the item's words
in edits turn one into the other. Windows that share too few word q-grams with the
item cannot (q-gram lemma) and are left out; the rest, as many words as the item
each, walk through random CGK embeddings, which turn few edits into few differing
coordinates; windows that agree with the item on a sample of coordinates in one of
many repetitions are widened by the edits allowed, and the nearest passage within
is found by the exact edit distance.

Defined results: null or blank texts and items match nothing; an item of fewer
than four words must occur word for word; a document shorter than the item is one
window; repeated items and repeated rows are reported each; rows with a null doc_id
or item_id have no name to report and are left out of leaks(), while stage() judges
every row by its own text; other columns are ignored, whatever their names. Items
are sent to the executors one block of bounded size after another, so a benchmark
of any size is compared whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusguard.llm.common import mix, row_ids, save, slices, words

ITEM_BLOCK = 4 << 20
WALKS, SAMPLES, TAKEN = 8, 6, 3
_SCHEMA = "doc_id long, item_id long, start_word long, n_words long, distance long"
_PAD = np.uint64(0)
_B = np.uint64(0x9E3779B97F4A7C15)


def _grams(h: np.ndarray, q: int) -> np.ndarray:
    m = max(0, len(h) - q + 1)
    g = h[:m].copy()
    for j in range(1, q):
        g = g * _B + h[j : j + m]
    return mix(g)


def embed(w: np.ndarray, walk: int) -> np.ndarray:
    """CGK: rows x 3L symbols; each step repeats or leaves the symbol it stands on, as its random bit says."""
    n, size = w.shape
    padded = np.concatenate([w, np.full((n, 1), _PAD)], 1)
    at, rows = np.zeros(n, np.int64), np.arange(n)
    out = np.empty((n, 3 * size), np.uint64)
    for j in range(3 * size):
        out[:, j] = symbol = padded[rows, at]
        bit = mix(symbol ^ np.uint64((walk << 32) + j + 1)) >> np.uint64(63)
        at = np.minimum(at + bit.astype(np.int64), size)
    return out


def _keys(w: np.ndarray) -> np.ndarray:
    """rows x (walks * samples) keys of sampled coordinates."""
    n, size = w.shape
    out = np.empty((n, WALKS * SAMPLES), np.uint64)
    rng = np.random.default_rng(size)
    for walk in range(WALKS):
        y = embed(w, walk)
        for s in range(SAMPLES):
            key = np.zeros(n, np.uint64)
            for c in rng.choice(3 * size, min(TAKEN, 3 * size), replace=False):
                key = mix(key + y[:, c])
            out[:, walk * SAMPLES + s] = key
    return out


def edit_distance(item: np.ndarray, w: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Word edit distance of item to each row of w, of which the first lens words count."""
    n, m = w.shape
    cols = np.arange(m + 1)
    row = np.broadcast_to(cols, (n, m + 1)).astype(np.int32)
    for i, x in enumerate(item, 1):
        new = np.empty_like(row)
        new[:, 0] = i
        np.minimum(row[:, 1:] + 1, row[:, :-1] + (w != x), out=new[:, 1:])
        row = np.minimum.accumulate(new - cols, axis=1) + cols
    return row[np.arange(n), lens]


def nearest_inside(item: np.ndarray, w: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distance, end) of the passage nearest to item in the first lens words of each row of w."""
    n, m = w.shape
    cols = np.arange(m + 1)
    row = np.zeros((n, m + 1), np.int32)
    for i, x in enumerate(item, 1):
        new = np.empty_like(row)
        new[:, 0] = i
        np.minimum(row[:, 1:] + 1, row[:, :-1] + (w != x), out=new[:, 1:])
        row = np.minimum.accumulate(new - cols, axis=1) + cols
    row = np.where(cols > lens[:, None], len(item) + 1, row)
    end = row.argmin(1)
    return row[np.arange(n), end], end


class Items:
    """Word hashes of benchmark items with their q-grams, edits allowed and LSH keys."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids = np.array(ids, np.int64)
        self.words = []
        for _, _, data, offs in slices(pa.array(texts, pa.string()), 1 << 40):
            h, _, wo = words(data, offs)
            self.words = [h[a:b] for a, b in zip(wo[:-1], wo[1:], strict=True)]
        self.size = np.array([len(x) for x in self.words], np.int64)
        self.edits = self.size // 4
        self.q = np.minimum(3, np.maximum(1, self.size // (self.edits + 1)))
        self.least = np.maximum(1, self.size - self.q + 1 - self.edits * self.q)
        self.keys = {i: _keys(x[None])[0] for i, x in enumerate(self.words) if len(x)}
        self.postings = {}
        for q in (1, 2, 3):
            own = np.flatnonzero((self.q == q) & (self.size > 0))
            if len(own):
                g = [_grams(self.words[i], q) for i in own]
                key, item, at = np.concatenate(g), np.repeat(own, [len(x) for x in g]), np.concatenate([np.arange(len(x)) for x in g])
                order = np.argsort(key, kind="stable")
                uniq, first = np.unique(key[order], return_index=True)
                bloom = np.zeros(1 << 20, bool)
                bloom[uniq & np.uint64((1 << 20) - 1)] = True
                self.postings[q] = uniq, np.append(first, len(key)), item[order], at[order], bloom

    def find(self, h: np.ndarray, woffs: np.ndarray):
        """(row, item, first word, words, distance) of the best passage of each row that holds an item."""
        rows = np.repeat(np.arange(len(woffs) - 1), np.diff(woffs))
        for q, (uniq, first, items, offs, bloom) in self.postings.items():
            g = _grams(h, q)
            pos = np.flatnonzero(bloom[g & np.uint64((1 << 20) - 1)])
            k = np.minimum(np.searchsorted(uniq, g[pos]), len(uniq) - 1)
            ok = (uniq[k] == g[pos]) & (pos + q <= woffs[1:][rows[pos]])
            pos, k = pos[ok], k[ok]
            n = first[k + 1] - first[k]
            if not n.sum():
                continue
            pos = np.repeat(pos, n)
            post = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[k], n)
            pair, start = rows[pos] * len(self.ids) + items[post], pos - offs[post]
            order = np.lexsort((pos, pair))
            pair, pos, start = pair[order], pos[order], start[order]
            it = pair % len(self.ids)
            last = np.minimum(np.arange(len(pair)) + self.least[it] - 1, len(pair) - 1)
            dense = (np.arange(len(pair)) + self.least[it] <= len(pair)) & (pair[last] == pair) & (pos[last] - pos < self.size[it] + self.edits[it])
            cover = np.zeros(len(pair) + 1, np.int64)
            np.add.at(cover, np.flatnonzero(dense), 1)
            np.add.at(cover, last[dense] + 1, -1)
            near = np.cumsum(cover[:-1]) > 0
            yield from self._windows(h, woffs, np.unique(np.stack([pair[near], start[near]], 1), axis=0))

    def _windows(self, h, woffs, found):
        for pair in np.unique(found[:, 0]):
            row, i = divmod(int(pair), len(self.ids))
            size, e, lo, hi = int(self.size[i]), int(self.edits[i]), int(woffs[row]), int(woffs[row + 1])
            s = found[found[:, 0] == pair, 1]
            s = np.unique(np.clip((s[:, None] + np.arange(-e, e + 1)).ravel(), lo, max(lo, hi - size)))
            best = None
            for c in range(0, len(s), 4096):
                at = s[c : c + 4096]
                idx = at[:, None] + np.arange(size)
                w = np.where(idx < hi, h[np.minimum(idx, hi - 1)], _PAD)
                hit = (_keys(w) == self.keys[i]).any(1)
                if hit.any():
                    a, z = np.maximum(at[hit] - e, lo), np.minimum(at[hit] + size + e, hi)
                    wide = h[np.minimum(a[:, None] + np.arange(size + 2 * e), hi - 1)]
                    d, end = nearest_inside(self.words[i], wide, z - a)
                    b = int(np.argmin(d))
                    if d[b] <= e and (best is None or d[b] < best[2]):
                        best = int(a[b]), int(end[b]), int(d[b])
            if best:
                a, n, d = best
                back, k = h[a : a + n][::-1], np.arange(n + 1)
                lengths = edit_distance(self.words[i][::-1], np.broadcast_to(back, (n + 1, n)), k)
                n = int(np.argmin(lengths))
                yield row, i, a + len(back) - n - lo, n, d


def _scan(items):
    def run(batches):
        known = items.value
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, _, data, offs in slices(batch.column(1)):
                h, _, woffs = words(data, offs)
                got = list(known.find(h, woffs))
                if got:
                    r, it, start, n, d = (np.array(x, np.int64) for x in zip(*got, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i + r]), pa.array(known.ids[it]), pa.array(start), pa.array(n), pa.array(d)], ["doc_id", "item_id", "start_word", "n_words", "distance"])

    return run


def item_blocks(bench: DataFrame):
    """Items of bounded total length at a time, in order of item_id."""
    held, size = ([], []), 0
    rows = bench.where("item_id is not null").select(F.col("item_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))).orderBy(*range(1, 3))
    for i, text in rows.toLocalIterator():
        if held[0] and size + len(text) > ITEM_BLOCK:
            yield Items(*held)
            held, size = ([], []), 0
        held[0].append(i)
        held[1].append(text)
        size += len(text)
    if held[0]:
        yield Items(*held)


def leaks(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """doc_id, item_id, start_word, n_words, distance: the best passage of each document that holds an item."""
    spark = docs.sparkSession
    d = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found, last = [], None
    for items in item_blocks(bench):
        if last is not None:
            # Only one block is held by the executors at a time.
            found.append(save(d.mapInArrow(_scan(last), _SCHEMA), "leaks"))
            last.destroy()
        last = spark.sparkContext.broadcast(items)
    out = d.mapInArrow(_scan(last), _SCHEMA) if last is not None else spark.createDataFrame([], _SCHEMA)
    for x in found:
        out = out.union(x)
    return out


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item, all columns as they were."""
    rows = row_ids(docs)
    found = leaks(rows.select(F.col("_cg_row").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id").alias("_cg_row")).distinct()
    return rows.join(found, "_cg_row", "left_anti").select(*docs.columns)


QUERIES = {"op9_cgk_decontamination": op9}
ORACLE: dict[str, str] = {}
