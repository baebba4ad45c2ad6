"""Size-tiered compaction into versioned shards (operator 8), in DataFrame functions only.

An append deals the documents, in a shuffled but fixed order, into arrivals of
about ARRIVAL_BYTES and writes each as one small immutable shard. A shard's tier
follows from its bytes: each tier is FANOUT times the one before, and from
target_bytes on a shard is full. A compaction plans on the manifest alone: it
merges every FANOUT runs of a tier, oldest first, and the merged ones of the next
tiers, until no open tier has FANOUT runs; then it rewrites each run that grows
once, into its last shard. Each step ends in a manifest, named by a pointer file
that is written aside and renamed without overwriting: a reader sees the version
before or after, and of two writers of one version the second fails.

Older versions stay readable until vacuum(), which keeps the newest ones that it
is told to and every file younger than its retention.

Defined results: a null text has 0 bytes; a document longer than an arrival makes its
arrival larger; repeated rows and null doc_ids are kept, each; an empty append
commits an empty version; columns of the documents keep their names and values,
whatever they are (the store's own begin with _cg_, which documents may not use).
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusguard.llm.common import blocks, root, save, shuffle_cleanup

ARRIVAL_BYTES, FANOUT = 8 << 20, 4
TARGET_BYTES = 64 << 20
#: Rounds in which a compaction rewrites its runs, so that it exchanges a part of the rows at a time.
TURNS = 4
_MANIFEST = "_cg_shard string, _cg_level int, _cg_first long, _cg_last long, _cg_docs long, _cg_bytes long, _cg_path string"
_OWN = ("_cg_bytes", "_cg_arrival", "_cg_level", "_cg_shard")


def arrivals(docs: DataFrame, each: int = ARRIVAL_BYTES, first: int = 0) -> DataFrame:
    """docs with _cg_bytes and _cg_arrival: as many arrivals as hold about each bytes, dealt by hash of doc_id.

    The one pass before it counts bytes; no row is moved to be placed.
    """
    size = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long")
    total = docs.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    key = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")
    return docs.withColumn("_cg_bytes", size).withColumn("_cg_arrival", F.shiftright(key * blocks(total, each), 32) + first)


def level_of(size: Column, target: int = TARGET_BYTES) -> Column:
    """Tier of a shard of so many bytes: 0 below target / FANOUT, one more for each FANOUT times; full ones have tier 2 and more."""
    return F.greatest(F.lit(0), F.floor(F.log(float(FANOUT), F.greatest(size, F.lit(1)) * float(FANOUT * FANOUT) / target + 1e-9))).cast("int")


def merge_plan(manifest: DataFrame, target: int = TARGET_BYTES) -> DataFrame:
    """_cg_first and _cg_to of the runs that grow: the first arrival of the shard that each run ends in."""
    runs = manifest.select("_cg_first", F.col("_cg_first").alias("_cg_to"), "_cg_bytes")
    while True:
        shards = runs.groupBy("_cg_to").agg(F.sum("_cg_bytes").alias("size")).withColumn("level", level_of(F.col("size"), target)).where(F.col("size") < target)
        by = Window.partitionBy("level")
        shards = shards.withColumn("n", F.count("*").over(by)).withColumn("group", F.floor((F.row_number().over(by.orderBy("_cg_to")) - 1) / FANOUT))
        shards = shards.where((F.col("group") + 1) * FANOUT <= F.col("n"))
        moved = shards.select(F.col("_cg_to").alias("_cg_was"), F.min("_cg_to").over(Window.partitionBy("level", "group")).alias("_cg_now"))
        moved = save(moved, "merges")
        if moved.isEmpty():
            return runs.withColumn("n", F.count("*").over(Window.partitionBy("_cg_to"))).where("n > 1").select("_cg_first", "_cg_to")
        runs = save(runs.join(moved, F.col("_cg_to") == F.col("_cg_was"), "left").select("_cg_first", F.coalesce("_cg_now", "_cg_to").alias("_cg_to"), "_cg_bytes"), "runs")


class Store:
    """Shards under one folder and the manifests that say which of them count."""

    def __init__(self, spark: SparkSession, folder: str, target_bytes: int = TARGET_BYTES):
        self.spark, self.folder, self.target = spark, folder.rstrip("/"), target_bytes
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path = path
        self._fs = path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        at = self._path(f"{self.folder}/manifests")
        if not self._fs.exists(at):
            return []
        return sorted(int(f.getPath().getName()[1:]) for f in self._fs.listStatus(at) if f.getPath().getName().startswith("v"))

    def version(self) -> int:
        return max(self._versions(), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        v = self.version() if version is None else version
        if not v:
            return self.spark.createDataFrame([], _MANIFEST)
        lines = self.spark.read.text(f"{self.folder}/manifests/v{v:08d}").first()[0]
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.folder}/{lines}")

    def _commit(self, manifest: DataFrame, version: int) -> None:
        """Write the manifest aside, then give it the version by a rename that never overwrites."""
        name = uuid.uuid4().hex
        manifest.coalesce(1).write.parquet(f"{self.folder}/lines/{name}")
        aside = self._path(f"{self.folder}/manifests/.{name}")
        out = self._fs.create(aside, False)
        out.write(f"lines/{name}\n".encode())
        out.close()
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        once = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        context = hadoop.FileContext.getFileContext(aside.toUri() if aside.toUri().getScheme() else self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(self._fs.makeQualified(aside), self._fs.makeQualified(self._path(f"{self.folder}/manifests/v{version:08d}")), once)
        except Exception as e:
            self._fs.delete(aside, False)
            raise RuntimeError(f"version {version} was committed by another writer") from e

    def _write(self, rows: DataFrame) -> DataFrame:
        """Write rows, one file for each _cg_arrival group named by _cg_to, and return their lines of the manifest."""
        path = f"{self.folder}/data/{uuid.uuid4().hex}"
        with shuffle_cleanup(self.spark):
            rows.repartition("_cg_to").withColumn("_cg_dir", F.col("_cg_to")).write.partitionBy("_cg_dir").option("compression", "zstd").parquet(path)
        own = self.spark.read.schema(rows.schema).parquet(path)
        lines = own.groupBy("_cg_to").agg(F.min("_cg_arrival").alias("_cg_first"), F.max("_cg_arrival").alias("_cg_last"), F.count("*").alias("_cg_docs"), F.sum("_cg_bytes").alias("_cg_bytes"))
        lines = lines.withColumn("_cg_level", level_of(F.col("_cg_bytes"), self.target))
        shard = F.format_string("t%d-%08d-%08d", "_cg_level", "_cg_first", "_cg_last")
        return lines.withColumn("_cg_shard", shard).withColumn("_cg_path", F.concat(F.lit(f"{path}/_cg_dir="), F.col("_cg_to").cast("string"))).select("_cg_shard", "_cg_level", "_cg_first", "_cg_last", "_cg_docs", "_cg_bytes", "_cg_path")

    def _rows(self, lines: DataFrame) -> DataFrame | None:
        """The rows of the shards of a manifest, with the line's columns: a write's folder is read once, only what the lines name."""
        batches = [r[0] for r in lines.select(F.regexp_extract("_cg_path", "(.*)/_cg_dir=[^/]*$", 1)).distinct().toLocalIterator()]
        out = None
        for path in batches:
            mine = lines.where(F.col("_cg_path").startswith(f"{path}/")).select(F.regexp_extract("_cg_path", "_cg_dir=([0-9]+)$", 1).cast("long").alias("_cg_dir"), "_cg_shard", "_cg_level", *(c for c in lines.columns if c == "_cg_to"))
            rows = self.spark.read.parquet(path).withColumn("_cg_dir", F.col("_cg_dir").cast("long")).drop("_cg_to").join(mine, "_cg_dir").drop("_cg_dir")
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out

    def append(self, docs: DataFrame, each: int = ARRIVAL_BYTES) -> int:
        """Commit the documents as new small shards; returns the version."""
        v, old = self.version(), self.manifest()
        first = old.agg(F.coalesce(F.max("_cg_last") + 1, F.lit(0))).first()[0]
        new = arrivals(docs, each, int(first)).withColumn("_cg_to", F.col("_cg_arrival"))
        self._commit(old.unionByName(self._write(new)), v + 1)
        return v + 1

    def compact(self) -> int:
        """Merge runs of a size until no open tier has FANOUT of them, and commit; returns the version."""
        v, old = self.version(), self.manifest()
        grow = save(merge_plan(old, self.target), "plan")
        if grow.isEmpty():
            return v
        stay, lines = old.join(grow.select("_cg_first"), "_cg_first", "left_anti"), old.join(grow, "_cg_first")
        turns = grow.select("_cg_to").distinct().withColumn("_cg_turn", F.pmod(F.row_number().over(Window.orderBy("_cg_to")), F.lit(TURNS)))
        lines = save(lines.join(turns, "_cg_to"), "merged")
        for turn in range(TURNS):
            rows = self._rows(lines.where(F.col("_cg_turn") == turn))
            if rows is not None:
                stay = stay.unionByName(self._write(rows.drop("_cg_shard", "_cg_level")))
        self._commit(stay, v + 1)
        return v + 1

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version's shards, with _cg_shard, _cg_level, _cg_arrival and _cg_bytes; None if it has none."""
        return self._rows(self.manifest(version))

    def vacuum(self, keep: int = 2, retention_s: float = 7 * 86400) -> None:
        """Delete shards that none of the newest keep versions names and that are older than retention_s."""
        live: set[str] = set()
        for v in self._versions()[-keep:]:
            live |= {r[0].rsplit("/", 2)[-2] + "/" + r[0].rsplit("/", 1)[-1] for r in self.manifest(v).select("_cg_path").toLocalIterator()}
        old = (time.time() - retention_s) * 1000
        for batch in self._fs.listStatus(self._path(f"{self.folder}/data")):
            for shard in self._fs.listStatus(batch.getPath()):
                name = shard.getPath().getName()
                if name.startswith("_cg_dir=") and f"{batch.getPath().getName()}/{name}" not in live and shard.getModificationTime() <= old:
                    self._fs.delete(shard.getPath(), True)


def shard(docs: DataFrame, folder: str | None = None, each: int = ARRIVAL_BYTES) -> DataFrame:
    """Append the documents to a store, compact it, and return the committed rows."""
    spark = docs.sparkSession
    store = Store(spark, folder or f"{root(spark)}/corpusguard/shards-{uuid.uuid4().hex}")
    store.append(docs, each)
    store.compact()
    out = store.read()
    if out is None:
        out = docs.limit(0).withColumn("_cg_bytes", F.lit(0).cast("long")).withColumn("_cg_arrival", F.lit(0).cast("long")).withColumn("_cg_level", F.lit(0)).withColumn("_cg_shard", F.lit(""))
    return out


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.col("_cg_bytes").alias("n_bytes"), F.col("_cg_arrival").alias("arrival"), F.col("_cg_level").cast("int").alias("tier"), F.col("_cg_shard").alias("shard"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The committed rows with the shard they are in as _cg_shard."""
    return shard(docs)


def _sql_round(k: int) -> str:
    """One round of merges in SQL."""
    level = f"greatest(0, CAST(floor(ln(greatest(size, 1) * {float(FANOUT * FANOUT)} / {TARGET_BYTES} + 1e-9) / ln({FANOUT}.0)) AS INT))"
    return f"""z{k} AS (SELECT root, CAST(sum(n_bytes) AS BIGINT) AS size FROM r{k} GROUP BY root),
    l{k} AS (SELECT root, {level} AS level FROM z{k} WHERE size < {TARGET_BYTES}),
    g{k} AS (SELECT root, level, (row_number() OVER (PARTITION BY level ORDER BY root) - 1) // {FANOUT} AS grp, count(*) OVER (PARTITION BY level) AS n FROM l{k}),
    m{k} AS (SELECT root AS was, min(root) OVER (PARTITION BY level, grp) AS now FROM g{k} WHERE (grp + 1) * {FANOUT} <= n),
    r{k + 1} AS (SELECT arrival, n_bytes, coalesce(now, root) AS root FROM r{k} LEFT JOIN m{k} ON root = was)"""


#: Rounds of merges, enough for a million arrivals of one size.
_ROUNDS = 10
_SQL = f"""
WITH n AS (
  SELECT greatest(1, (sum(strlen(coalesce(text, ''))) + {ARRIVAL_BYTES} - 1) // {ARRIVAL_BYTES}) AS total FROM documents
), a AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, CAST((CAST('0x' || substring(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) * total) >> 32 AS BIGINT) AS arrival FROM documents, n
), r0 AS (
  SELECT arrival, sum(n_bytes) AS n_bytes, arrival AS root FROM a GROUP BY arrival
), {", ".join(_sql_round(k) for k in range(_ROUNDS))}, s AS (
  SELECT root, min(arrival) AS a0, max(arrival) AS a1, CAST(sum(n_bytes) AS BIGINT) AS size FROM r{_ROUNDS} GROUP BY root
), t AS (
  SELECT *, greatest(0, CAST(floor(ln(greatest(size, 1) * {float(FANOUT * FANOUT)} / {TARGET_BYTES} + 1e-9) / ln({FANOUT}.0)) AS INT)) AS tier FROM s
)
SELECT a.doc_id, a.n_bytes, a.arrival, CAST(t.tier AS INTEGER) AS tier, printf('t%d-%08d-%08d', t.tier, t.a0, t.a1) AS shard FROM a JOIN r{_ROUNDS} r ON a.arrival = r.arrival JOIN t ON r.root = t.root
"""

QUERIES = {"op8_tiered_compaction": op8}
ORACLE = {"op8_tiered_compaction": _SQL}
