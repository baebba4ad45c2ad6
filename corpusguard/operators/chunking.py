"""Chunking: overlapping windows, blank-line sections, clause sections, tables.

Column `len - overlap` windows start at multiples of size - overlap, so the loop of
a cutter is a sequence; nothing here shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusguard.functions.dialect import Dialect
from corpusguard.functions.sqlrun import Steps

SIZE, OVERLAP = 500, 120
#: Block types kept whole up to twice the chunk size.
WHOLE_TYPES = ("table", "table_row", "text_section", "clause_section")
#: Block types that may be cut at clause headings, and words of policy documents.
SPLITTABLE_TYPES = ("page_text", "paragraph", "doc_text", "hwp_text", "hwpx_xml", "text_section")
POLICY_WORDS = ("규정", "지침", "세칙", "학칙", "방침", "절차", "기준", "규칙")
CLAUSE = r"(?:제\s*\d+\s*(?:장|절|조)(?:\s*\([^)]+\))?|부칙|별표\s*\d*|별지\s*\d*)"
SUBCLAUSE = r"^(?:\(?\d+\)?[.)]?|[가-힣A-Za-z][.)])\s+"
TITLE_FIELDS = ("교과목명", "프로그램명", "사업명")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_block_text(c: Column) -> Column:
    """Line ends as LF, at most one blank line in a row, no outer white space."""
    return strip(F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), "\n{3,}", "\n\n"))


def windows(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Array of (piece, start, end) of the stripped text; blank pieces are left out."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    t, step = strip(text), size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length(t) - overlap - 1, F.lit(0)), F.lit(step))
    cut = F.transform(starts, lambda s: F.struct(strip(F.substring(t, s + 1, F.lit(size))).alias("piece"), s.alias("start"), F.least(s + size, F.length(t)).alias("end")))
    return F.filter(cut, lambda w: F.length(w["piece"]) > 0)


def chunk_windows(docs: DataFrame, keys: list[str], size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """keys, ordinal, start, end, text: a row per window of each text."""
    d = docs.select(*keys, F.posexplode(windows(F.coalesce("text", F.lit("")), size, overlap)).alias("ordinal", "w"))
    return d.select(*keys, "ordinal", F.col("w.start").alias("start"), F.col("w.end").alias("end"), F.col("w.piece").alias("text"))


def chunk_sql(d: Dialect, source: str, size: int = SIZE, overlap: int = OVERLAP) -> Steps:
    """chunks(doc_id, domain, ordinal, start, end_, text) of source(doc_id, source, text), as SQL."""
    step = size - overlap
    if d.string == "STRING":
        seq = f"sequence(0, greatest(length(t) - {overlap + 1}, 0), {step})"
    else:
        seq = f"range(0, greatest(length(t) - {overlap + 1}, 0) + 1, {step})"
    return [
        ("chunk_text", f"SELECT doc_id, source AS domain, {d.strip('text')} AS t FROM {source}"),
        ("chunk_starts", d.explode(seq, "s", "s", "chunk_text", "doc_id, domain, t")),
        ("chunks", f"SELECT doc_id, domain, CAST({d.div('s', str(step))} AS BIGINT) AS ordinal, CAST(s AS BIGINT) AS start, CAST(least(s + {size}, length(t)) AS BIGINT) AS end_, {d.strip(f'substring(t, CAST(s + 1 AS INT), {size})')} AS text FROM chunk_starts WHERE length({d.strip(f'substring(t, CAST(s + 1 AS INT), {size})')}) > 0"),
    ]


def sections(text: Column) -> Column:
    """Blank-line sections of a text, stripped, blank ones left out."""
    return F.filter(F.transform(F.split(F.regexp_replace(text, "\r\n?", "\n"), r"\n\s*\n"), strip), lambda x: F.length(x) > 0)


def section_blocks(docs: DataFrame, keys: list[str]) -> DataFrame:
    """text_section blocks; numbered from 1 if a text has more than one, otherwise without a number."""
    d = docs.select(*keys, sections(F.col("text")).alias("_s"))
    d = d.select(*keys, F.size("_s").alias("_n"), F.posexplode("_s").alias("block_index", "text"))
    number = F.when(F.col("_n") > 1, F.col("block_index") + 1).cast("int")
    return d.select(*keys, "block_index", F.lit("text_section").alias("block_type"), number.alias("block_num"), "text", entity_title(F.col("text")).alias("entity_title"))


def entity_title(text: Column) -> Column:
    """Title in the first three lines: the value of a title field, a numbered heading, or a short first line."""
    lines = F.slice(F.filter(F.transform(F.split(text, "\n"), strip), lambda x: F.length(x) > 0), 1, 3)
    fields = "|".join(TITLE_FIELDS)
    value = F.element_at(F.filter(F.transform(lines, lambda x: strip(F.regexp_extract(x, rf"^(?:{fields})\s*:\s*(.+)$", 1))), lambda x: F.length(x) > 0), 1)
    numbered = F.element_at(F.filter(F.transform(lines, lambda x: strip(F.regexp_extract(x, r"^\d+\.\s*(.+)$", 1))), lambda x: F.length(x) > 0), 1)
    first = F.get(lines, F.lit(0))
    return F.coalesce(F.try_element_at(F.array(value), F.lit(1)), numbered, F.when((F.length(first) <= 40) & ~first.contains(":"), first))


def is_policy(path: Column, text: Column) -> Column:
    stem = F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)
    named = F.lit(False)
    for w in POLICY_WORDS:
        named = named | stem.contains(w)
    return named | strip(text).rlike("^" + CLAUSE) | text.rlike(r"제\s*\d+\s*조")


def clause_title(text: Column) -> Column:
    first = F.get(F.filter(F.transform(F.split(text, "\n"), strip), lambda x: F.length(x) > 0), F.lit(0))
    return F.when(first.rlike("^" + CLAUSE), F.substring(first, 1, 120))


def clause_sections(text: Column) -> Column:
    """Sections that start at clause headings; a text without two of them is cut at blank lines."""
    lined = F.when(text.contains("\n"), text).otherwise(F.regexp_replace(text, f"(?=(?:{CLAUSE}))", "\n"))
    cut = F.filter(F.transform(F.split(F.regexp_replace(lined, rf"(?m)(?=^\s*{CLAUSE})", "\u0001"), "\u0001"), strip), lambda x: F.length(x) > 0)
    return F.when(F.size(cut) > 1, cut).otherwise(sections(text))


def split_long(section: Column, size: int = SIZE) -> Column:
    """A section over twice the size, folded line by line: a part ends at a blank or sub-clause line once it has size characters."""
    lines = F.split(section, "\n")
    start = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("parts"))

    def step(s, x):
        flush = (F.length(s["cur"]) >= size) & ((F.length(strip(x)) == 0) | x.rlike(SUBCLAUSE))
        grown = F.when(F.length(s["cur"]) == 0, x).otherwise(F.concat(s["cur"], F.lit("\n"), x))
        return F.struct(F.when(flush, x).otherwise(grown).alias("cur"), F.when(flush, F.array_append(s["parts"], strip(s["cur"]))).otherwise(s["parts"]).alias("parts"))

    parts = F.aggregate(lines, start, step, lambda s: F.filter(F.array_append(s["parts"], strip(s["cur"])), lambda x: F.length(x) > 0))
    return F.when((F.length(section) > 2 * size) & (F.size(parts) > 1), parts).otherwise(F.array(section))


def split_blocks(blocks: DataFrame, path: str = "source", size: int = SIZE) -> DataFrame:
    """Splittable blocks of policy documents as clause sections with sub_block_index from 1 and clause_title; others as they are."""
    cut = F.col("block_type").isin(*SPLITTABLE_TYPES) & is_policy(F.col(path), F.col("text"))
    parts = F.flatten(F.transform(clause_sections(F.col("text")), lambda s: split_long(s, size)))
    many = cut & (F.size(parts) > 1)
    pieces = F.when(many, F.transform(parts, lambda x, i: F.struct((i + 1).cast("int").alias("i"), x.alias("t")))).otherwise(F.array(F.struct(F.lit(None).cast("int").alias("i"), F.col("text").alias("t"))))
    keep = [c for c in blocks.columns if c not in ("text", "block_type")]
    b = blocks.select(*keep, "block_type", many.alias("_many"), F.explode(pieces).alias("_p"))
    return b.select(*keep, F.when(F.col("_many"), "clause_section").otherwise(F.col("block_type")).alias("block_type"), F.col("_p.t").alias("text"), F.col("_p.i").alias("sub_block_index"), F.when(F.col("_many"), clause_title(F.col("_p.t"))).alias("clause_title"))


def chunk_blocks(blocks: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of blocks (source, block_index, block_type, text and optional page, table_index, sub_block_index, clause_title).

    Each chunk starts from the text under a prefix line; short blocks of the whole
    types stay whole, others are cut into windows. chunk_id counts per source.
    """
    def opt(name: str) -> Column:
        return F.col(name).cast("string") if name in blocks.columns else F.lit(None).cast("string")

    prefix = F.concat(F.lit("[SOURCE="), "source", F.lit("] [BLOCK="), "block_type", F.lit("]"),
        *[F.coalesce(F.concat(F.lit(f" [{tag}="), opt(c), F.lit("]")), F.lit("")) for tag, c in (("PAGE", "page"), ("TABLE", "table_index"), ("CLAUSE", "clause_title"))], F.lit("\n"))
    full = F.concat(prefix, normalize_block_text(F.col("text")))
    whole = F.col("block_type").isin(*WHOLE_TYPES) & (F.length(full) <= 2 * size)
    pieces = F.when(whole, F.array(F.struct(full.alias("piece"), F.lit(0).alias("start"), F.length(full).alias("end")))).otherwise(windows(full, size, overlap))
    keep = [c for c in blocks.columns if c != "text"]
    d = blocks.where(F.length(strip(F.col("text"))) > 0).select(*keep, F.posexplode(pieces).alias("_w", "_p"))
    sub = F.coalesce(F.col("sub_block_index"), F.lit(0)) if "sub_block_index" in blocks.columns else F.lit(0)
    order = Window.partitionBy("source").orderBy("block_index", sub, "_w")
    n = F.row_number().over(order) - 1
    return d.select(*keep, n.alias("chunk_ordinal"), F.concat("source", F.lit("::chunk_"), n.cast("string")).alias("chunk_id"), F.col("_p.piece").alias("text"), F.col("_p.start").alias("start"), F.col("_p.end").alias("end"))


def chunk_content(text: Column) -> Column:
    """The text without its prefix line."""
    return strip(F.regexp_replace(text, r"^\[SOURCE=[^\n]*\n", ""))


def table_blocks(tables: DataFrame, keys: list[str]) -> DataFrame:
    """A table block and a row block per data row of tables with rows array<array<string>>; the first row names the cells."""
    rows = F.filter(F.transform("rows", lambda r: F.transform(r, lambda c: strip(F.coalesce(c, F.lit(""))))), lambda r: F.exists(r, lambda c: F.length(c) > 0))
    dash = lambda r: F.array_join(F.transform(r, lambda c: F.when(F.length(c) == 0, "-").otherwise(c)), " | ")
    named = lambda r, h: F.array_join(F.filter(F.zip_with(h, r, lambda k, v: F.when((F.length(k) > 0) & (F.length(v) > 0), F.concat(k, F.lit(": "), v))), lambda x: x.isNotNull()), "; ")
    t = tables.select(*keys, rows.alias("r")).withColumn("h", F.get("r", F.lit(0))).withColumn("data", F.expr("slice(r, 2, greatest(size(r) - 1, 0))")).where(F.size("r") > 0)
    body = F.concat_ws("\n", F.transform("r", dash), F.lit("[TABLE ROWS]"), F.filter(F.transform("data", lambda r: named(r, F.col("h"))), lambda x: F.length(x) > 0))
    table = t.select(*keys, F.lit("table").alias("block_type"), F.lit(None).cast("int").alias("row_index"), body.alias("text"), F.lit(None).cast("string").alias("entity_title"))
    e = t.select(*keys, "h", F.posexplode("data").alias("i", "r"))
    titled = F.element_at(F.array_append(F.array(F.lit(None).cast("string")), F.get(F.reverse(F.filter(F.zip_with("h", "r", lambda k, v: F.when(k.isin(*TITLE_FIELDS), v)), lambda x: x.isNotNull())), F.lit(0))), -1)
    row = e.select(*keys, F.lit("table_row").alias("block_type"), (F.col("i") + 1).alias("row_index"), F.concat_ws("\n", F.format_string("[ROW %d]", F.col("i") + 1), dash(F.col("r")), named(F.col("r"), F.col("h"))).alias("text"), titled.alias("entity_title"))
    return table.unionByName(row)
