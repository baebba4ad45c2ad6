"""Run a chain of named SELECTs over DataFrames."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import DataFrame

Steps = list[tuple[str, str]]


def chain(steps: Steps, last: str) -> str:
    """The steps as one query with common table expressions."""
    return "WITH " + ",\n".join(f"{name} AS ({sql})" for name, sql in steps) + f"\n{last}"


def run(steps: Steps, last: str, **inputs: DataFrame) -> DataFrame:
    """The last SELECT over the steps, with inputs as tables of the given names.

    Global views, as a stream's batches belong to a session of their own.
    """
    spark = next(iter(inputs.values())).sparkSession
    names = []
    for name, df in inputs.items():
        view = f"cg_{name}_{uuid.uuid4().hex[:12]}"
        df.createOrReplaceGlobalTempView(view)
        names.append((name, f"SELECT * FROM global_temp.{view}"))
    out = spark.sql(chain([*names, *steps], last))
    for name, sql in names:
        spark.catalog.dropGlobalTempView(sql.rsplit(".", 1)[1])
    return out


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written once to spark.checkpoint.dir and read again, for what several branches of a query read; df itself if no such folder is set."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df
    path = f"{folder.rstrip('/')}/corpusguard/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of input for each core below which a table's files may be too few to keep all cores busy.
FEW_BYTES = 32 << 20


#: Tasks for each core that a scan with much work a row should have, and the least bytes of one.
TASKS, LEAST_BYTES = 4, 8 << 20


def _bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


@contextlib.contextmanager
def even_scan(df: DataFrame):
    """Within it, scans of a table like df are split so finely that a last task leaves few cores idle; finer splits that are set stay."""
    spark, key = df.sparkSession, "spark.sql.files.maxPartitionBytes"
    before = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    most = max(LEAST_BYTES, _bytes(df) // (TASKS * spark.sparkContext.defaultParallelism))
    if most >= before:
        yield
        return
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, str(before))


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores if it is small, as a small file is one task; a larger table keeps its scan and is never moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if _bytes(df) < cores * FEW_BYTES else df
