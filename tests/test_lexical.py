"""Coverage, bonus and exact candidates against sums written out for each pair."""

import pytest
from pyspark.sql import functions as F

from corpusguard.operators import lexical as L
from corpusguard.operators import query as Q

QUESTIONS = [
    (1, '"봄학기 장학금" 신청 절차를 알려줘'),
    (2, "휴학 규정과 복학 규정 비교"),
    (3, "vpn 반출 승인 기준"),
    (4, "hello workshop schedule"),
    (5, ""),
    (6, None),
    (7, "승인 절차"),
]
CHUNKS = [
    (1, "HR-001_봄학기_장학금.txt", "봄학기 장학금 신청 절차는 다음과 같다", "장학금", None, "table_row"),
    (2, "docs/휴학-규정.md", "휴학 및 복학 규정 안내", "휴학", "제1조 복학", "clause_section"),
    (3, "vpn_반출.txt", "노트북 반출 승인 절차와 신청서", None, None, "text_section"),
    (4, "x.txt", "Hello, the  work\nshop is in May", "", "Schedule", "table"),
    (5, "hello", "", None, None, None),
    (6, None, None, None, None, "text"),
    (7, "x.txt", "승인", "절차", None, None),
]
CHUNK_SCHEMA = "chunk_id long, source string, text string, entity_title string, clause_title string, block_type string"


def by_hand(terms, question, chunk):
    """bonus and exact points of one pair, place by place."""
    squeeze = lambda s: "".join((s or "").lower().split())
    _, source, text, entity, clause, kind = chunk
    stem = (source or "").split("/")[-1].rsplit(".", 1)[0]
    name = stem[7:] if stem.startswith("HR-001_") else stem
    title, body, path, heading, part = squeeze(name.replace("_", " ").replace("-", " ")), squeeze(text), squeeze(source), squeeze(entity), squeeze(clause)
    role = {r: {t for t, _, have in terms if have & r} for r in (1, 2, 4, 8)}
    at = lambda t, *places: any(squeeze(t) in p for p in places)
    points = entity_hits = title_hits = hint_hits = field_hits = 0
    for t in role[8]:
        points += 190 if at(t, title) else 170 if at(t, heading) else 120 if at(t, body) else 0
    for t in role[1]:
        p = 125 if at(t, title) else 95 if at(t, heading) else 88 if at(t, part) else 50 if at(t, body) else 28 if at(t, path) else 0
        points, entity_hits, title_hits = points + p, entity_hits + (p > 28), title_hits + (p == 125)
    for t in role[2]:
        p = 130 if at(t, title, path) else 90 if at(t, body, heading, part) else 0
        points, hint_hits = points + p, hint_hits + (p > 0)
    for t in role[4]:
        p = 20 if at(t, heading, part) else 14 if at(t, body) else 0
        points, field_hits = points + p, field_hits + (p > 0)
    said = " ".join((question["normalized"] or "").lower().split())
    points += 240 if title and title in squeeze(said) else 0
    tag = stem.split("_")[0].split("-")[0].lower() if "_" in stem else ""
    words = "".join(c if "a" <= c <= "z" else " " for c in said).split()
    points += 145 if tag and tag in words else 0
    everywhere = (title, heading, part, body, path)
    subjects = {t for t in role[1] | role[2] if at(t, *everywhere)}
    fields = {t for t in role[4] if at(t, *everywhere)}
    titled = {t for t in role[1] | role[2] | role[4] if at(t, title, heading, part)}
    both = bool(subjects and fields)
    points += 35 * (entity_hits >= 2) + (40 * min(title_hits, 2) if field_hits else 0) + 45 * (0 < field_hits == len(role[4])) + 55 * (entity_hits >= 2 and field_hits > 0)
    points += (48 + 10 * min(len(subjects), len(fields)) + 18 * bool(titled)) if both else 0
    points += 24 * (question["is_compare"] and entity_hits > 0)
    if question["is_procedure"]:
        points -= 22 * bool(fields and not subjects) + 10 * (len(role[1]) >= 3 and entity_hits == 1)
    points += {"table_row": 32, "text_section": 16, "clause_section": 28, "table": 8}.get(kind, 0)
    points -= 25 * bool((role[1] or role[2]) and not subjects and not hint_hits)
    n = lambda place, *roles: sum(at(t, place) for r in roles for t in role[r])
    a, b, c, d, e = n(title, 1, 2, 8), n(heading, 1, 8), n(part, 1, 2, 8), n(body, 1, 2), n(path, 2)
    if not (question["quoted"] or question["entity_terms"] or question["hints"]) or not (a + b + c + d + e + len(fields)):
        return points, None
    x = 22 + 52 * a + 34 * b + 30 * c + 18 * d + 20 * e + 8 * len(fields) + {"table_row": 16, "text_section": 10, "clause_section": 14}.get(kind, 0)
    x += 18 * (a > 0 and b + c + d > 0) + 16 * (a + b + c >= 2) + (22 + 8 * min(len(subjects), len(fields)) if both else 0) + 10 * (question["is_compare"] and d > 0)
    if question["is_procedure"] and fields:
        x += 14 * bool(titled) - 16 * (not subjects and d <= 1)
    return points, x


@pytest.fixture(scope="module")
def asked(spark):
    return L.coverage_terms(Q.profile(spark.createDataFrame(QUESTIONS, "query_id long, text string")))


def test_terms_of_questions(asked):
    got = {r.query_id: r for r in asked.collect()}
    role = lambda i, bit: {t.term for t in got[i].terms if t.role & bit}
    assert got[1].quoted == ["봄학기 장학금"] and role(1, L.QUOTED) == {"봄학기 장학금"} and role(1, L.ENTITY) == {"봄학기 장학금", "봄학기", "장학금"}
    assert {"신청", "절차"} <= role(1, L.FIELD) and got[1].is_procedure
    assert got[2].hints == ["휴학 규정", "복학 규정"] and got[2].compare_entities == ["휴학 규정", "복학 규정"] and got[2].is_compare and got[2].is_multi_document
    assert role(4, L.ENTITY) == {"hello", "workshop", "schedule"} and not got[5].terms and not got[6].terms
    assert role(7, L.FIELD) == {"승인", "절차"} and not role(7, L.ENTITY)


def test_bonus_against_sums_by_hand(spark, asked):
    pairs = L.bonus(L.matches(spark.createDataFrame(CHUNKS, CHUNK_SCHEMA), asked)).collect()
    questions, chunks = {r.query_id: r for r in asked.collect()}, {c[0]: c for c in CHUNKS}
    assert len(pairs) == len(QUESTIONS) * len(CHUNKS)
    for p in pairs:
        q = questions[p.query_id]
        assert (p.bonus, p.exact) == by_hand([(t.term, t.compact, t.role) for t in q.terms], q.asDict(), chunks[p.chunk_id]), (p.query_id, p.chunk_id)
    assert any(p.exact for p in pairs) and any(p.bonus < 0 for p in pairs) and any(p.bonus > 500 for p in pairs)


def test_source_coverage_counts_terms_once(spark, asked):
    chunks = spark.createDataFrame([(1, "s", "hello"), (2, "s", "hello workshop"), (3, "t", "none")], "chunk_id long, source string, text string")
    got = L.source_coverage(L.matches(chunks, asked.where("query_id = 4"))).collect()
    assert [(r.source, r.entity_coverage, r.field_coverage, r.combined) for r in got] == [("s", 2, 0, False)]


def test_coverage_by_source_equals_that_of_all_pairs(spark, asked):
    rows = [(1, "the-s_hello.txt", "hello"), (2, "the-s_hello.txt", "hello workshop"), (3, "t", "none"), (4, None, "work shop"), (5, "u", None), (6, "u", "workshop fee")]
    chunks = spark.createDataFrame(rows, "chunk_id long, source string, text string").repartition(3)
    got, want = L.coverage_by_source(chunks, asked), L.source_coverage(L.matches(chunks, asked))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and want.count() == 3
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_search_keeps_exact_candidates_of_each_source(spark):
    rows = [(i, f"s{i % 3}", "alpha " * (i % 7) + "beta gamma") for i in range(300)]
    chunks = spark.createDataFrame(rows, "chunk_id long, source string, text string")
    asked = spark.createDataFrame([(1, "alpha delta")], "query_id long, text string")
    got = L.sparse_search(chunks, asked, k=10)
    assert got.count() == 30
    exact = got.where("retrieval_type = 'sparse_exact'").groupBy("source").count().collect()
    assert all(r["count"] <= 4 for r in exact)
    none = L.sparse_search(chunks, asked, policy=lambda r: r.where(F.col("source") != "s0"))
    assert none.where("source = 's0'").count() == 0
    assert L.sparse_search(chunks.limit(0), asked).count() == 0


def test_repeated_keys_and_clashing_columns_do_not_break(spark, asked):
    c = spark.createDataFrame([CHUNKS[0], CHUNKS[0]], CHUNK_SCHEMA).withColumns({"terms": F.lit(1), "_body": F.lit("x"), "query_id": F.lit(9)})
    assert L.matches(c, asked).count() == 2 * len(QUESTIONS)
