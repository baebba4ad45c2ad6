"""Shared pieces of the training-data operators.

Texts reach Python as Arrow batches and are handled as flat byte arrays in
slices of about a megabyte, so a worker's memory follows the slice and its
longest document, never the partition. A null text counts as empty everywhere.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 1 << 20

_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_own = ""
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse modulo 2^64."""
    global _pow, _inv
    if len(_pow) < n:
        m = 1 << (n - 1).bit_length()
        steps = np.full(m, _BASE)
        steps[0] = 1
        _pow = np.multiply.accumulate(steps)
        steps[1:] = _INVERSE
        _inv = np.multiply.accumulate(steps)
    return _pow[:n], _inv[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words (splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    d = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return d, o


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows of up to limit bytes, one row at least."""
    data, offs = text_buffers(column)
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each lower-cased word, byte where it starts, word offsets of the rows)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    solid = ~_WS[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    at = offs[:-1][offs[:-1] < n]
    first[at] = solid[at]
    starts = np.flatnonzero(first)
    woffs = np.searchsorted(starts, offs)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, woffs
    p, q = powers(n)
    value = _TABLE[_LOWER[data]] * p
    value *= solid
    return mix(np.add.reduceat(value, starts) * q[starts]), starts, woffs


def shingles(h: np.ndarray, woffs: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """k-word shingle hashes of all rows and the rows' offsets in them.

    A row with fewer words has its whole sequence as one shingle, a row without words none.
    """
    lens = np.diff(woffs)
    counts = np.where(lens >= k, lens - k + 1, np.minimum(lens, 1))
    soffs = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(soffs[-1], np.uint64)
    m = len(h) - k + 1
    if m > 0:
        g = h[:m].copy()
        for j in range(1, k):
            g *= _BASE
            g += h[j : j + m]
        rows = np.repeat(np.arange(len(lens)), lens)[:m]
        ok = np.arange(m) + k <= woffs[1:][rows]
        out[(soffs[:-1][rows] + np.arange(m) - woffs[:-1][rows])[ok]] = mix(g[ok])
    for r in np.flatnonzero((lens > 0) & (lens < k)):
        g = np.uint64(len(h[woffs[r] : woffs[r + 1]]))
        with np.errstate(over="ignore"):
            for x in h[woffs[r] : woffs[r + 1]]:
                g = mix(g * _BASE + x)
        out[soffs[r]] = g
    return out, soffs


def distinct(h: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row and the new offsets."""
    parts = [np.unique(h[a:b]) for a, b in zip(offs[:-1], offs[1:], strict=True)]
    return (np.concatenate(parts) if parts else h), np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)


def root(spark: SparkSession) -> str:
    """The shared folder of the cluster; where none is set, an own one in local mode (tests) and an error elsewhere."""
    global _own
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = _own = _own or "file://" + tempfile.mkdtemp(prefix="corpusguard-")
    return folder.rstrip("/")


@contextlib.contextmanager
def shuffle_cleanup(spark: SparkSession):
    """Within it, an execution drops its shuffle files when it ends."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def release() -> None:
    """Give freed memory of a Python worker back to the system, as workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it again; cuts the lineage."""
    spark = df.sparkSession
    path = f"{root(spark)}/corpusguard/{name}-{uuid.uuid4().hex}"
    with shuffle_cleanup(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_ids(docs: DataFrame) -> DataFrame:
    """docs with _cg_row, another number for each row and the same one whenever the rows are read.

    A scan of files numbers its rows alike each time; anything else is written first.
    """
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    if any(not line.lstrip(" +-:").startswith(("Relation", "Project", "Filter", "LocalRelation")) for line in plan.strip().split("\n")):
        docs = save(docs, "rows")
    return docs.withColumn("_cg_row", F.monotonically_increasing_id())


def blocks(total: int, each: int, least: int = 1) -> int:
    return max(least, -(-int(total) // each))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): smallest node reachable, for each node of edges (a, b).

    Alternates large-star and small-star; a star is one window over the edges of a
    node, which spills, and every round is written to the shared folder.
    """
    spark = edges.sparkSession
    around = F.min("b").over(Window.partitionBy("a"))
    e = save(edges.where("a != b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        e = both.withColumn("m", F.least("a", around)).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Each neighbour of a, and a itself, goes to the smallest of them.
        links = e.withColumn("m", around).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("k"), "a", "m")
        e = save(links.select(F.col("k").alias("a"), F.col("m").alias("b")).union(links.where("k != a").select("a", F.col("m").alias("b"))).distinct(), "edges")
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    stars = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def whole_groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Tables that hold whole runs of equal values of a column that the rows are sorted by."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(column).to_numpy()
        cut = int(np.searchsorted(key, key[-1], "left"))
        if held and held[-1].column(column)[-1].as_py() != key[0]:
            yield pa.Table.from_batches(held)
            held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)
