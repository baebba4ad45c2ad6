"""Question analysis over a table of questions: keywords, fields, hints, flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusguard.functions import fixed

_WORD = r"[가-힣A-Za-z0-9]"


def _any(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def _alternatives(words) -> str:
    return "|".join(w.replace("(", r"\(").replace(")", r"\)").replace("/", r"\/").replace(".", r"\.") for w in words)


def among(x: Column, words) -> Column:
    """x is one of the words; one expression for any number of them."""
    return x.rlike(rf"\A(?:{_alternatives(words)})\z")


def normalize(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_keyword(token: Column) -> Column:
    """The token without quotes and without the first listed particle it ends with."""
    t = F.regexp_replace(token, "^[\"'“”‘’]+|[\"'“”‘’]+$", "")
    return F.regexp_replace(t, f"^(.{{2,}}?)(?:{_alternatives(fixed.KOREAN_PARTICLES)})$", "$1")


def keywords(text: Column) -> Column:
    """Distinct normalised tokens of two characters or more, in order."""
    found = F.regexp_extract_all(text, F.lit(f"({_WORD}+)"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, normalize_keyword), lambda x: F.length(x) >= 2))


def quoted(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit('"([^"]+)"'), F.lit(1))


def alias_in(text: Column, alias: str) -> Column:
    """The alias occurs as a word, with a particle at most after it."""
    return text.rlike(rf"(?<![가-힣A-Za-z0-9]){_alternatives([alias])}(?:{_alternatives(fixed.KOREAN_PARTICLES)})?(?=$|[\s,.!?])")


def canonical_label(label: Column) -> Column:
    """The field an alias stands for, the first listed one if two have it."""
    out = label
    for field, aliases in reversed(fixed.FIELD_ALIASES.items()):
        out = F.when(label.isin(field, *aliases), field).otherwise(out)
    return out


def requested_fields(text: Column) -> Column:
    hits = []
    for field, aliases in fixed.FIELD_ALIASES.items():
        hit = F.lit(False)
        for a in dict.fromkeys((field, *aliases)):
            hit = hit | alias_in(text, a)
        hits.append(F.when(hit, field))
    return F.array_compact(F.array(*hits))


_JOINT = r"(?iU)\s*(?:와|과|및|,|/|&|\bvs\b)\s*"
_NONE = "array<string>"


def generic_terms() -> list[str]:
    """Words that name no subject: those common in questions, and all labels of fields."""
    return list(dict.fromkeys([*fixed.COMMON_QUERY_TOKENS, *(w for f, aliases in fixed.FIELD_ALIASES.items() for w in (f, *aliases))]))


def _titles(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"([가-힣A-Za-z0-9\-\(\)\s]{{2,}}?(?:{_alternatives(fixed.DOCUMENT_SUFFIXES)}))"), F.lit(1))


def _named_parts(text: Column) -> Column:
    """What a hint names, cut at joining words; the titles in a part stand for it."""
    parts = F.filter(F.transform(F.split(text, _JOINT), lambda x: normalize_keyword(normalize(x))), lambda x: F.length(x) >= 2)
    inner = F.flatten(F.transform(parts, lambda x: F.when(F.size(_titles(x)) > 0, F.transform(_titles(x), normalize)).otherwise(F.array(x))))
    return F.when(text == "", F.array().cast(_NONE)).when(F.size(inner) > 0, inner).otherwise(F.array(text))


def document_hints(text: Column) -> Column:
    """Titles named in a question: what stands before the word for document, and what ends with a document suffix."""
    before = F.transform(F.regexp_extract_all(text, F.lit(r"([가-힣A-Za-z0-9\s]+?)\s*문서"), F.lit(1)), normalize)
    named = F.transform(_titles(text), lambda x: F.trim(F.regexp_replace(normalize(x), "(?:기준으로|기준|바탕으로|함께 보고|함께)$", "")))
    hints = F.transform(F.flatten(F.transform(F.concat(before, named), _named_parts)), normalize_keyword)
    return F.array_distinct(F.filter(hints, lambda x: (F.length(x) >= 2) & ~among(x, generic_terms())))


def _compared_before_fields(text: Column, fields: Column) -> Column:
    """The subjects joined before the first label of a requested field, if there are two or more."""
    labels = F.array(*[F.struct(F.lit(f).alias("f"), F.lit(a).alias("a")) for f, aliases in fixed.FIELD_ALIASES.items() for a in dict.fromkeys((f, *aliases))])
    places = F.transform(F.filter(labels, lambda x: F.array_contains(fields, x["f"]) & (F.position(x["a"], text) > 1)), lambda x: F.position(x["a"], text) - 1)
    head = F.substring(text, F.lit(1), F.coalesce(F.array_min(places), F.length(text)))
    head = F.trim(F.regexp_replace(F.trim(F.regexp_replace(head, "(?:각각|비교|차이|다른지).*$", "")), r"\s*관련 문서.*$", ""))
    parts = F.transform(F.split(head, r"(?iU)\s*(?:와|과|및|/|&|\bvs\b)\s*"), lambda x: normalize_keyword(normalize(x)))
    parts = F.array_distinct(F.filter(parts, lambda x: (x != "") & ~among(x, generic_terms()) & (F.length(x) <= 40) & (F.size(F.split(x, " ")) <= 5)))
    return F.when(F.size(parts) >= 2, parts).otherwise(F.array().cast(_NONE))


def profile(queries: DataFrame) -> DataFrame:
    """query_id, text and the profile of each question; a null text is an empty one."""
    t = F.col("normalized")
    q = queries.withColumn("normalized", normalize(F.coalesce("text", F.lit("")))).withColumns({
        "keywords": keywords(t), "quoted": F.filter(F.transform(quoted(t), lambda x: normalize_keyword(normalize(x))), lambda x: x != ""), "fields": requested_fields(t), "hints": document_hints(t),
        "is_summary": _any(t, fixed.SUMMARY_KEYWORDS), "is_compare": _any(t, fixed.COMPARE_KEYWORDS), "is_procedure": _any(t, fixed.PROCEDURE_KEYWORDS), "is_synthesis": _any(t, fixed.SYNTHESIS_KEYWORDS), "is_info": _any(t, fixed.INFO_KEYWORDS),
    })
    compared = F.when(F.size("quoted") >= 2, F.slice("quoted", 1, 2)).when(F.size("hints") >= 2, F.slice("hints", 1, 2)).otherwise(_compared_before_fields(t, F.col("fields")))
    q = q.withColumn("compare_entities", compared)
    q = q.withColumns({"is_compare": F.col("is_compare") | (F.size("compare_entities") >= 2), "is_multi_document": F.size("hints") >= 2})
    words = F.filter("keywords", lambda x: ~among(x, generic_terms()) & ~F.array_contains("hints", x))
    q = q.withColumn("entity_terms", F.when((F.size("quoted") > 0) & ~F.col("is_compare"), F.col("quoted")).otherwise(F.array_distinct(F.concat("compare_entities", words))))
    return q.withColumn("exact_lookup", (F.size("fields") > 0) & ~F.col("is_summary") & ~F.col("is_compare") & ~F.col("is_procedure") & ~F.col("is_synthesis") & ~F.col("is_multi_document"))


#: Greetings, and the least score of the best vector hit.
GREETINGS = ("안녕", "안녕하세요", "반가워", "고마워", "감사", "hello", "hi")
MIN_DENSE = 0.45


def use_rag(text: Column, dense_top: Column, sparse_top: Column) -> Column:
    """Whether a question goes to retrieval: no greeting, and a vector hit that is near enough or else any lexical hit."""
    return ~_any(F.lower(text), GREETINGS) & ((F.coalesce(dense_top, F.lit(0.0)) >= MIN_DENSE) | (F.coalesce(sparse_top, F.lit(0.0)) > 0))
