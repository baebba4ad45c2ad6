"""The search in batches against lists cut from all pairs, and the scan against plain search in texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusguard.operators import lexical as L
from corpusguard.operators import pairscan
from corpusguard.operators import query as Q
from corpusguard.operators import retrieval as R

ASKED = [(1, '"봄학기 장학금" 신청 절차를 알려줘'), (2, "휴학 규정과 복학 규정 비교"), (3, "vpn 반출 승인 기준"), (4, "hello workshop fee 2024 hello"), (5, ""), (6, None), (4, "shop work"), (None, "hello 승인")]
PARTS = ["봄학기 장학금", "신청", "절차", "휴학", "휴학 규정", "vpn", "반출 승인", "hello", "work　shop", "shop", "fee", "2024", "Hello2024", "x😀y", "승인절차", "é", "\n"]


@pytest.fixture(scope="module")
def chunks(spark):
    rng = random.Random(7)
    rows = []
    for i in range(240):
        text = None if i % 41 == 0 else " ".join(rng.choices(PARTS, k=rng.randrange(9)))
        source = None if i % 37 == 0 else f"HR-00{i % 3}_{rng.choice(('봄학기', 'vpn', 'hello', 's'))}.txt"
        rows.append((i, source, text, rng.choice((None, "장학금", "fee")), rng.choice((None, "제1조 복학", "Work shop")), rng.choice((None, "table_row", "text_section", "clause_section", "table"))))
    rows += [(7, "t.txt", "hello hello fee", None, None, None), (7, "u.txt", "hello", "fee", None, "table"), (8, "t.txt", None, None, None, None), (None, "v.txt", "hello workshop", None, None, None)]
    return spark.createDataFrame(rows, "chunk_id long, source string, text string, entity_title string, clause_title string, block_type string").repartition(6, "source", "text")


def lists(chunks, queries, k, idf, per_source=4):
    """The search's rows from all pairs, ranked one question after another."""
    raw = R.bm25(chunks, queries, idf=idf, distinct_query_tokens=idf == "plus1")
    pairs = L.bonus(L.matches(chunks, L.coverage_terms(Q.profile(queries)))).join(raw.withColumnRenamed("score", "raw"), ["query_id", "chunk_id"], "left").collect()
    out = []
    for q in {p.query_id for p in pairs}:
        mine = [p for p in pairs if p.query_id == q]
        best = lambda rows: sorted(rows, key=lambda x: (-round(x[0], 9), x[1] is not None, x[1] or 0))
        sparse = best([(p.bonus + (p.raw or 0), p.chunk_id, p.source, "sparse") for p in mine])[: max(5 * k, 24)]
        top, of, exact = {s[1] for s in sparse[:k]}, {}, []
        for x in best([(p.exact + 0.45 * min(p.raw or 0, 80), p.chunk_id, p.source, "sparse_exact") for p in mine if p.exact is not None]):
            of[x[2]] = of.get(x[2], 0) + (x[0] > 0 and x[1] not in top)
            if x[0] > 0 and x[1] not in top and of[x[2]] <= per_source:
                exact.append(x)
        both = sorted(sparse + exact[: 2 * k], key=lambda x: (-round(x[0], 9), x[3], x[1] is not None, x[1] or 0))[: max(3 * k, 24)]
        out += [(q, x[1], x[3], round(x[0], 6), i) for i, x in enumerate(both, 1)]
    return sorted(map(repr, out))


@pytest.mark.parametrize(("k", "idf"), [(2, "plus1"), (9, "okapi")])
def test_search_equals_lists_of_all_pairs(spark, chunks, k, idf, monkeypatch):
    monkeypatch.setattr(pairscan, "_PAIRS", 100)
    queries = spark.createDataFrame(ASKED, "query_id long, text string")
    got = L.sparse_search(chunks, queries, k=k, idf=idf).collect()
    got = sorted(repr((r.query_id, r.chunk_id, r.retrieval_type, round(r.score, 6), r["rank"])) for r in got)
    assert got == lists(chunks, queries, k, idf)


def test_search_makes_no_row_for_each_pair(spark, chunks, monkeypatch):
    monkeypatch.setattr(L, "QUERY_BLOCK", 3)
    queries = spark.createDataFrame([(i, "hello fee") for i in range(7)], "query_id long, text string")
    got = L.sparse_search(chunks, queries)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert got.select("query_id").distinct().count() == 7
    assert L.sparse_search(chunks, queries.limit(0)).count() == 0


def test_rows_of_a_task_are_few_among_ties(spark):
    rows = spark.range(3000).select(F.col("id").alias("chunk_id"), F.concat(F.lit("s"), F.col("id") % 5).alias("source"), F.lit("hello fee").alias("text")).coalesce(1)
    asked = spark.createDataFrame([(1, "hello workshop")], "query_id long, text string")
    cut = L._scored(rows, asked, 10, "chunk_id", "plus1", 4, 50)
    kinds = {r.retrieval_type: r["count"] for r in cut.groupBy("retrieval_type").count().collect()}
    assert kinds["sparse"] == 50 and 30 <= kinds["sparse_exact"] <= 5 * 14
    assert [r.chunk_id for r in L.sparse_search(rows, asked).where("retrieval_type = 'sparse'").orderBy("rank").limit(10).collect()] == list(range(10))


def test_slices_are_bounded_by_characters_and_by_terms(monkeypatch):
    monkeypatch.setattr(pairscan, "_CHARS", 10)
    texts = ["", "abc", "", "abcdefghijkl", "a", ""]
    assert [(c.start, c.stop) for c in pairscan._cuts(texts, 1)] == [(0, 4), (4, 6)]
    assert [(c.start, c.stop) for c in pairscan._cuts(texts, pairscan._CELLS // 2)] == [(0, 2), (2, 4), (4, 6)]
    assert len([*pairscan._cuts(texts, pairscan._CELLS * 2)]) == 6 and not [*pairscan._cuts([], 1)]


@pytest.mark.parametrize("table", [pairscan._TABLE, 0])
def test_scan_finds_what_plain_search_finds(table, monkeypatch):
    monkeypatch.setattr(pairscan, "_TABLE", table)
    rng = random.Random(3)
    some = lambda n, of: "".join(rng.choices(of, k=n))
    texts = [some(rng.randrange(60), "abé1 2가나다　\n\0😀") for _ in range(80)]
    terms, tokens = sorted({some(rng.randrange(1, 4), "abé12가나😀") for _ in range(60)} | {"aba", "ab"}), sorted({some(rng.randrange(1, 4), x) for x in ("ab", "12", "가나") for _ in range(12)})
    held, chunk, token, times, length = pairscan.Words(terms, tokens).scan(texts)
    for i, t in enumerate(texts):
        assert [x in re.sub(r"\s", "", t) for x in terms] == held[i].tolist()
        runs = re.findall("[가-힣]+|[a-z]+|[0-9]+", t)
        runs += 2 * [r[j : j + 2] for r in runs if r[0] >= "가" for j in range(len(r) - 1)]
        assert length[i] == len(runs)
        assert {tokens[a]: n for a, n in zip(token[chunk == i], times[chunk == i], strict=True)} == {x: runs.count(x) for x in tokens if x in runs}
    alone = pairscan.Words([], tokens).scan(texts)
    assert all((a == b).all() for a, b in zip(alone[1:], (chunk, token, times, length), strict=True))
