"""Files as blocks, query sets, captured results, and the tables a run leaves."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusguard.operators.chunking import section_blocks, strip

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_BLOCKS = "source string, file_name string, domain string, file_type string, block_index int, block_type string, block_num int, table_index int, row_index int, text string"
#: Stems of files that hold questions, not documents.
SKIP = r"(?i)questions?|질문|문제"


def scan(spark: SparkSession, root: str, suffixes: tuple[str, ...] = ("txt", "docx", "hwpx")) -> DataFrame:
    """path, source (relative), file_name, domain (first folder or default), file_type, modified, content of the documents under root."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").load(root)
    base = re.sub(r"^[a-z]+:/+", "/", root).rstrip("/")
    source = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/+", "/"), "^" + re.escape(base) + "/", "")
    parts = F.split(source, "/")
    d = d.select("path", source.alias("source"), F.element_at(parts, -1).alias("file_name"), F.when(F.size(parts) > 1, F.element_at(parts, 1)).otherwise("default").alias("domain"), F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1)).alias("file_type"), F.col("modificationTime").alias("modified"), "content")
    return d.where(~F.regexp_extract("file_name", r"^(.*?)(?:\.[^.]*)?$", 1).rlike(SKIP))


def decode_text(content: Column) -> Column:
    """Bytes as UTF-8, a leading mark removed and invalid bytes replaced."""
    return strip(F.regexp_replace(F.make_valid_utf8(content.cast("string")), "^\ufeff", ""))


def _paragraphs(data: bytes) -> list[tuple[str, int | None, int | None, int | None, str]]:
    """(block_type, block_num, table_index, row_index, text) of a docx: non-empty paragraphs numbered with empty ones, then table rows."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_W}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t")).strip()
    out = [("paragraph", i, None, None, text(p)) for i, p in enumerate(body.findall(f"{_W}p"), 1) if text(p)]
    for k, table in enumerate(body.findall(f"{_W}tbl"), 1):
        out += [("table_row", None, k, i, " | ".join(text(c) or "-" for c in row.findall(f"{_W}tc"))) for i, row in enumerate(table.findall(f"{_W}tr"))]
    return out


def _hwpx(data: bytes) -> list[tuple[str, int | None, int | None, int | None, str]]:
    z = zipfile.ZipFile(io.BytesIO(data))
    texts = [t.strip() for n in sorted(z.namelist()) if n.endswith(".xml") for t in ElementTree.fromstring(z.read(n)).itertext() if t.strip()]
    return [("hwpx_xml", None, None, None, "\n".join(texts))] if texts else []


def _parse(frames):
    readers = {"docx": _paragraphs, "hwpx": _hwpx}
    for f in frames:
        rows = []
        for r in f.itertuples():
            try:
                blocks = readers[r.file_type](bytes(r.content))
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, AttributeError):
                blocks = []
            rows += [(r.source, r.file_name, r.domain, r.file_type, i, *b) for i, b in enumerate(blocks)]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _BLOCKS.split(", ")]).astype(object).where(lambda x: x.notna(), None)


def blocks(files: DataFrame) -> DataFrame:
    """Blocks of scanned files: sections of text files, paragraphs and rows of docx, the text of hwpx; unreadable files have none."""
    keys = ["source", "file_name", "domain", "file_type"]
    t = section_blocks(files.where("file_type = 'txt'").select(*keys, decode_text(F.col("content")).alias("text")), keys)
    t = t.select(*keys, F.col("block_index").cast("int").alias("block_index"), "block_type", "block_num", F.lit(None).cast("int").alias("table_index"), F.lit(None).cast("int").alias("row_index"), "text")
    return t.unionByName(files.where("file_type in ('docx', 'hwpx')").select(*keys, "content").mapInPandas(_parse, _BLOCKS))


def query_set(spark: SparkSession, path: str) -> DataFrame:
    """query_type, pos (from 1), id, topic, text of a JSON file of arrays by type."""
    q = spark.read.json(path, multiLine=True, schema="benign array<struct<id: int, topic: string, text: string>>, attack array<struct<id: int, topic: string, text: string>>")
    parts = [q.select(F.lit(k).alias("query_type"), F.posexplode(k).alias("p", "x")).select("query_type", (F.col("p") + 1).alias("pos"), "x.*") for k in ("benign", "attack")]
    return parts[0].unionByName(parts[1])


def results(spark: SparkSession, root: str) -> DataFrame:
    """mode, query_type, query_idx, raw of captured outputs named mode_x_type_NN.txt, and the parts of the report."""
    r = spark.read.text(root, wholetext=True, pathGlobFilter="mode_*.txt").select("value", F.col("_metadata.file_name").alias("file"))
    name = lambda k: F.regexp_extract("file", r"^mode_([ab])_(benign|attack)_(\d+)\.txt$", k)
    part = lambda t: strip(F.regexp_extract("value", rf"(?s)=== {t} ===\n(.*?)(?=\n=== |\z)", 1))
    field = lambda k: F.nullif(F.regexp_extract("value", rf"(?m)^{k}=(.*)$", 1), F.lit(""))
    return r.select("file", name(1).alias("mode"), name(2).alias("query_type"), name(3).cast("int").alias("query_idx"), part("(?:RAG|General LLM) Response").alias("response"), part("Final (?:Rerank )?Results").alias("final"), field("route").alias("route"), field("runtime_action").alias("runtime_action"), field("runtime_adjusted_risk").cast("double").alias("runtime_adjusted_risk"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """file_name, key, value of a markdown manifest: '## file' headings over '- key: value' lines."""
    text = spark.read.text(path, wholetext=True)
    parts = text.select(F.explode(F.slice(F.split("value", r"(?m)^## "), 2, 1 << 20)).alias("p"))
    lines = parts.select(F.trim(F.split_part("p", F.lit("\n"), F.lit(1))).alias("file_name"), F.explode(F.regexp_extract_all("p", F.lit(r"(?m)^- ([^\n]+)$"), F.lit(1))).alias("l"))
    return lines.where(F.col("l").contains(":")).select("file_name", F.trim(F.regexp_extract("l", r"^([^:]+):", 1)).alias("key"), F.trim(F.regexp_extract("l", r"^[^:]+:(.*)$", 1)).alias("value"))


def write_run(routed: DataFrame, stats: DataFrame, summary: DataFrame, root: str) -> None:
    """The tables of an ingestion: chunks by domain, review and quarantine as JSON lines, statistics and summary."""
    routed.where("action <> 'quarantine'").write.partitionBy("domain").mode("overwrite").parquet(f"{root}/chunks")
    for name, action in (("review", "review"), ("quarantine", "quarantine")):
        routed.where(F.col("action") == action).write.mode("overwrite").json(f"{root}/{name}")
    stats.write.mode("overwrite").json(f"{root}/stats")
    summary.write.mode("overwrite").json(f"{root}/summary")


def is_stale(files: DataFrame, index: DataFrame) -> DataFrame:
    """One row: whether a document is newer than the oldest part of the index (both with modified)."""
    return files.agg(F.max("modified").alias("d")).crossJoin(index.agg(F.min("modified").alias("i"))).select(F.coalesce(F.col("d") > F.col("i"), F.lit(True)).alias("stale"))


def index_folder(domain: Column) -> Column:
    """Folder of a domain's index: its ASCII letters and digits, and twelve digits of its SHA-1."""
    stub = F.regexp_replace(F.regexp_replace(domain, r"[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")
    return F.concat(F.when(stub == "", "domain").otherwise(stub), F.lit("__"), F.substring(F.sha1(domain), 1, 12))
