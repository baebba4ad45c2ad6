"""Every operator on nulls, blanks, ties, repeats, empty tables and clashing columns, and against plain brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusguard.llm import chaining, common, ctw, decontaminate, ftrl, licenses, minhash, mixing, rindex, rules, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, bucket string, copy boolean, block int, component int, rule string, position double, key string"


def lower_words(t):
    return WORD.findall((t or "").translate(LOWER))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    vocabulary = ["".join(r.choice(["th", "er", "an", "é", "on", "st", "ou"]) for _ in range(r.randint(1, 4))) for _ in range(400)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    base = text(120)
    near = base.split()
    near[60] = "changed"
    passage = text(70)
    out = [(0, base), (1, " ".join(near)), (2, base.upper()), (3, None), (4, ""), (5, " \n\t"), (6, "one two"), (7, "one two"), (8, text(60) + "\n" + passage), (9, passage + " " + text(30))]
    out += [(10, "line a b\nline a b\n" + text(55)), (11, "x$ " * 60), (12, "WOW!! " * 80), (13, text(3000)), (14, text(80) + "\nReleased under the MIT License.")]
    out += [(20 + k, text(r.randint(1, 200))) for k in range(30)] + [(50 + k, " ".join(w + "$$" for w in text(90).split())) for k in range(36)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    full = [(i, t, "en", ["b", "a", None][i % 3], len(t or ""), 1, "q", True, 1, 2, "r", 0.5, "k") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def held(n):
    return F.crc32(F.col("doc_id").cast("string")) % n == 0


def test_minhash(docs, rows, empty):
    got = {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}
    sets = {}
    for i, t in rows:
        w = lower_words(t)
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}
    assert minhash.near_duplicates(empty).count() == 0
    assert minhash.keep_one(docs).columns == docs.columns


def test_minhash_across_tiles(spark, monkeypatch):
    """Documents of one template, few of them near copies, in buckets of many tiles."""
    monkeypatch.setattr(minhash, "TILE", 8)
    monkeypatch.setattr(minhash, "SMALL", 4)
    r = random.Random(11)
    core = [f"core{k}" for k in range(163)]
    texts = [core + [f"own{i}x{k}" for k in range(29)] for i in range(160)]
    for k in range(40):
        texts[2 * k + 1] = texts[2 * k][:-26] + texts[2 * k + 1][-26:]
    r.shuffle(texts)
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    parent = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if len(sets[a] & sets[b]) >= 0.75 * len(sets[a] | sets[b]):
                x, y = parent[a], parent[b]
                parent = [min(x, y) if p in (x, y) else p for p in parent]
    assert len(set(parent)) == 120
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    assert [got[i] for i in range(len(texts))] == parent


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (3, 1), (20, 3)], "a long, b long")
    assert {(r.node, r.component) for r in common.components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (20, 1), (8, 8), (9, 8)}


def test_run_length_index(docs, rows, empty):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rindex.dedup(docs).collect()}
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - 49):
            first.setdefault(b[s : s + 50], i)
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, int)
        for s in range(len(b) - 49):
            if first[b[s : s + 50]] < i:
                gone[s : s + 50] = 1
        runs = int((np.diff(np.concatenate([[0], gone])) == 1).sum())
        assert got[i] == (len(b), int(gone.sum()), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())
    assert rindex.dedup(empty).count() == 0


def test_index_classes_and_anchors():
    r = random.Random(1)
    texts = list({bytes(r.choice(b"ab") for _ in range(r.randint(1, 90))) for _ in range(60)} | {b"a" * 84, b"a" * 70, b"b" + b"a" * 60})
    got = rindex.RunLengthIndex(texts).classes()
    number = {}
    for k, t in enumerate(texts):
        for s in range(rindex._STRIDE):
            if s + 50 <= len(t):
                assert number.setdefault(t[s : s + 50], got[k, s]) == got[k, s]
            else:
                assert got[k, s] == -1
    assert len(set(number.values())) == len(number)
    data = np.frombuffer(bytes(r.choice(b"ab") for _ in range(400)), np.uint8)
    key = rindex._grams(data)
    assert {s + int(np.argmin(key[s : s + 35])) for s in range(351)} <= set(rindex.anchors(data, np.array([0, 400])).tolist())


def test_suffix_order_and_chunks_of_bounded_size(monkeypatch):
    """Against sorted(); a chunk of surroundings holds little more than CHUNK rows, however large the batches are."""
    rng = random.Random(5)
    texts = [bytes(rng.choices(range(256) if k % 2 else b"ab", k=rng.randrange(0, 85))) for k in range(60)]
    t, n = np.zeros((60, rindex._STRIDE), np.int64), np.array([len(x) for x in texts])
    for k, x in enumerate(texts):
        t[k, : len(x)] = np.frombuffer(x, np.uint8) + np.int64(1)
    want = sorted((bytes_after, k, i) for k, x in enumerate(texts) for i in range(len(x) + 1) for bytes_after in [x[i:]])
    assert rindex._suffixes(t, n).tolist() == [k * rindex._STRIDE + i for _, k, i in want]
    chunks = []
    monkeypatch.setattr(rindex, "_remove", lambda table, known: (chunks.append(table.num_rows) or [], None))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(70_000))], ["anchor"])
    assert list(rindex._shards([batch])) == []
    assert sum(chunks) == 70_000 and max(chunks) <= rindex.CHUNK + rindex._PART


def test_chaining(docs, rows, empty):
    got = chaining.passages(docs).collect()
    assert {(8, 9), (9, 8)} & {(r.doc_id, r.ref_id) for r in got} and (1, 0) in {(r.doc_id, r.ref_id) for r in got}
    texts = {i: lower_words(t) for i, t in rows}
    for r in got:
        a, b = texts[r.doc_id][r.start_word : r.start_word + r.n_words], texts[r.ref_id][r.ref_start : r.ref_start + r.ref_words]
        assert len(a) == r.n_words and len(b) == r.ref_words and (r.edits or a == b) and min(len(a), len(b)) >= 50
    assert chaining.passages(empty).count() == 0


def test_chain_against_brute_force():
    r, k, gap = random.Random(2), chaining.SEED, chaining.GAP
    for _ in range(40):
        pts = sorted(zip(r.sample(range(90), 14), r.sample(range(90), 14), strict=True))
        x, y = np.array(pts).T
        chains = chaining.chain(x, y)
        assert sorted(np.concatenate(chains).tolist()) == list(range(14))
        for links in chains:
            assert (np.diff(x[links]) > 0).all() and (np.diff(y[links]) > 0).all()
        # Of equally good places to come from, any may be taken: the least and the most that gives.
        bounds = []
        for choose in (min, max):
            best: list[float] = []
            for j, (a, b) in enumerate(pts):
                before = [(round(best[i] - gap * (a - c + b - d), 9), min(k, a - c, b - d)) for i, (c, d) in enumerate(pts[:j]) if c < a and d < b]
                value = max((v for v, _ in before), default=0)
                best.append(max(k, value + choose((g for v, g in before if v == value), default=0) * (1 + 2 * gap)))
            bounds.append(max(best))
        steps = np.minimum(k, np.minimum(np.diff(x[chains[0]]), np.diff(y[chains[0]]))) * (1 + 2 * gap) - gap * (np.diff(x[chains[0]]) + np.diff(y[chains[0]]))
        assert bounds[0] - 1e-6 <= k + steps.sum() <= bounds[1] + 1e-6


def test_chaining_recall(spark):
    """Passages of 60 words with up to a quarter of edits, a passage whose pieces others hold, a large class of near copies."""
    r = random.Random(1)
    text = lambda n: [f"w{r.randrange(20000)}" for _ in range(n)]
    rows, wanted = [], {}
    for rate in (0, 0.1, 0.2, 0.25):
        for mode in ("replaced", "mixed"):
            for _ in range(12):
                p = text(60)
                q = [[w] for w in p]
                for k in r.sample(range(60), int(rate * 60)):
                    new = f"z{r.random()}"
                    q[k] = [new] if mode == "replaced" else r.choice([[], [p[k], new], [new]])
                i = len(rows)
                rows += [(i, " ".join(text(80) + p + text(80))), (i + 1, " ".join(text(100) + sum(q, []) + text(60)))]
                wanted.setdefault(rate, []).append((i + 1, i))
    pieces = [text(45) for _ in range(3)]
    both = sum(pieces, [])[:100]
    i = len(rows)
    rows += [(i, " ".join(text(50) + both + text(50))), (i + 1, " ".join(text(70) + both + text(50)))]
    for p in pieces:
        rows += [(s * (10000 + len(rows) + k), " ".join(text(50) + p + text(50))) for s in (-1, 1) for k in range(12)]
    hot, first = text(120), len(rows) + 50000
    rows += [(first + k, " ".join(text(30) + [f"y{r.random()}" if r.random() < 0.08 else w for w in hot] + text(30))) for k in range(60)]
    got = {(x.doc_id, x.ref_id) for x in chaining.passages(spark.createDataFrame(rows * 2, "doc_id long, text string")).collect()}
    for rate, pairs in wanted.items():
        assert sum(p in got for p in pairs) >= 0.9 * len(pairs), rate
    assert (i + 1, i) in got
    group = {k: k for k in range(first, first + 60)}

    def find(k):
        while group[k] != k:
            k = group[k]
        return k

    for a, b in got:
        if a >= first and b >= first:
            group[find(a)] = find(b)
    assert len({find(k) for k in group}) == 1
    assert not [p for p in got if p[0] < first and p not in sum(wanted.values(), [(i + 1, i)])]


def test_repeated_and_null_ids(spark):
    """Versions of one doc_id and rows without one, in the operators that name rows by doc_id."""
    r = random.Random(4)
    text = lambda n: " ".join(f"v{r.randrange(500)}" for _ in range(n))
    a, b = text(120), text(120)
    rows = [(1, a), (2, b), (2, a), (2, a), (None, b), (None, text(60)), (3, text(80) + " " + b)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    by = {}
    for x in rindex.dedup(docs).collect():
        by.setdefault(x.doc_id, []).append((x.n_removed, x.n_bytes))
    assert by[1] == [(0, len(a))] and sorted(by[2]) == sorted([(0, len(b)), (len(a), len(a)), (len(a), len(a))])
    assert by[3][0][0] >= len(b) and None not in by
    plan = mixing.plan(docs).collect()
    assert len(plan) == 7 and abs(sum(x.taken for x in plan) - plan[0].target) <= 1
    assert mixing.stage(spark, docs, "").count() == 7
    scored = ctw.code_lengths(docs, held(10)).collect()
    assert len(scored) == 7 and all(x.score < 0 for x in scored)
    bench = spark.createDataFrame([(1, " ".join(b.split()[10:50]))], "item_id long, text string")
    assert {x.doc_id for x in decontaminate.leaks(docs, bench).collect()} == {2, 3}


def test_context_tree(docs, rows, empty):
    got = {r.doc_id: r for r in ctw.code_lengths(docs, held(10)).collect()}
    train = {i: zlib.crc32(str(i).encode()) % 10 != 0 for i, _ in rows}
    words = {i: [*lower_words(t), None] for i, t in rows}
    c = Counter(w for i, ws in words.items() if train[i] for w in ws)
    n, v = sum(c.values()), len(c)
    depth, nodes = ctw.DEPTH, {}

    def steps(i):
        b = [0xFE] * depth + list(" ".join(words[i][:-1]).encode()) + [0xFF]
        for p in range(depth, len(b)):
            for k in range(8):
                yield tuple(b[p - depth : p]), 1 << k | b[p] >> 8 - k, b[p] >> 7 - k & 1

    for i in words:
        if train[i]:
            for ctx, node, bit in steps(i):
                for d in range(depth + 1):
                    nodes.setdefault((ctx[depth - d :], node), [0, 0])[bit] += 1
    kids = {}
    for ctx, node in nodes:
        if ctx:
            kids.setdefault((ctx[1:], node), []).append((ctx, node))
    g, weight, own = math.lgamma, {}, {}
    for k in sorted(nodes, key=lambda k: -len(k[0])):
        a, b = nodes[k]
        e = g(a + 0.5) + g(b + 0.5) - 2 * g(0.5) - g(a + b + 1)
        s = sum(weight[x] for x in kids.get(k, [])) if len(k[0]) < depth else e
        own[k] = 1.0 if len(k[0]) == depth else 1 / (1 + math.exp(min(700, s - e)))
        weight[k] = e if len(k[0]) == depth else max(e, s) + math.log1p(math.exp(-abs(e - s))) - math.log(2)
    for i, ws in words.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not train[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
        total = 0.0
        for ctx, node, bit in steps(i) if len(ws) < 300 else ():
            acc, rest, p = 0.0, 1.0, 0.5
            for d in range(depth + 1):
                k = (ctx[depth - d :], node)
                if k not in nodes:
                    break
                a, b = nodes[k]
                kt = (b + 0.5) / (a + b + 1)
                p, acc, rest = acc + rest * kt, acc + rest * own[k] * kt, rest * (1 - own[k])
            total += math.log10(p if bit else 1 - p)
        assert len(ws) >= 300 or r.score == pytest.approx(total, rel=1e-6)
    assert ctw.code_lengths(empty, held(10)).count() == 0


def test_context_tree_broadcasts_no_growing_level(spark):
    key = F.col("id") * 7919 + 97
    plan = ctw.tree(spark.range(300).select(key.alias("key"), F.lit(1).cast("long").alias("total")))._jdf.queryExecution().executedPlan().toString()
    # Six joins down the tree; only the levels of at most 255 and 65,280 nodes may be sent to the driver.
    assert plan.count("SortMergeJoin") >= 4 and plan.count("BroadcastHashJoin") <= 2


def test_mixing(docs, empty, rows):
    got = mixing.plan(docs).collect()
    by = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        s = by.setdefault(r.source, [0, 0, r.target, r.source_size])
        s[0] += r.taken
        s[1] += r.size
    assert all(abs(t - target) <= 0.5 and n == size for t, n, target, size in by.values())
    assert sum(x[2] for x in by.values()) == pytest.approx(sum(len(WORD.findall(t or "")) for _, t in rows))
    copies = mixing.schedule(mixing.plan(docs)).collect()
    assert sum(r.words for r in copies) == sum(r.taken for r in got) and all(0 <= r.position <= 1 for r in copies)
    assert mixing.stage(None, docs, "").columns == docs.columns
    assert mixing.plan(empty).count() == 0


def test_mix_is_read_from_its_copies(spark, monkeypatch, tmp_path):
    """The query counts the copies that the schedule puts in order; it does not pass them by."""
    texts = [(k, "a", "w " * (k % 5)) for k in range(40)] + [(k, "b", "w " * 30) for k in range(40, 50)] + [(None, None, "x y"), (7, "a", "w w w")]
    spark.createDataFrame(texts, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size)
    got, planned = sorted(mixing.op2(spark, str(tmp_path)).collect(), key=key), sorted(mixing.plan(d).collect(), key=key)
    assert [tuple(r) for r in got] == [tuple(r)[: len(got[0])] for r in planned] and len(got) == 52
    as_before = mixing.schedule
    monkeypatch.setattr(mixing, "schedule", lambda planned, carry=(): as_before(planned, carry).where("copy = 0"))
    firsts = sorted(mixing.op2(spark, str(tmp_path)).collect(), key=key)
    assert [r.taken for r in firsts] == [min(r.size, r.taken) for r in got] != [r.taken for r in got]


def test_rules(spark, docs, rows, empty):
    labels = spark.createDataFrame([(i, 0 if i >= 50 else 1, 0) for i in range(8, 86)] + [(8, None, 0), (999, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in rules.quality(docs, labels).collect()}
    for i, t in rows:
        w = WORD.findall(t or "")
        tri = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        n = Counter(tri)
        again = {k for j, x in enumerate(tri) if n[x] > 1 for k in (j, j + 1, j + 2)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(again))
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w)) and not (r.kept and r.base_failed)
    assert not any(got[i].kept for i in range(50, 86)) and got[13].kept
    assert rules.quality(empty, labels).count() == 0
    assert rules.quality(docs, labels.limit(0)).where("kept").count() > 0


def test_ftrl(spark, docs, empty):
    labels = spark.createDataFrame([(i, 0 if i >= 50 else 1) for i in range(8, 86)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in ftrl.score(docs, ftrl.fit(docs, labels, held(5))).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and np.mean([got[i] < 0.3 for i in range(50, 86)]) > 0.9
    assert set(r.score for r in ftrl.score(docs, ftrl.fit(docs, labels.limit(0), held(5))).collect()) == {0.5}
    assert ftrl.score(empty, np.zeros(ftrl.BUCKETS + 2, np.float32)).count() == 0


def test_decontamination(spark, docs, rows, empty):
    item = rows[8][1].split("\n")[1].split()[:40]
    edited = item[:10] + ["zzz"] + item[11:30] + item[31:]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(edited)), (3, None), (4, ""), (5, "one two"), (5, "nothing here matches any text at all")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.leaks(docs, bench).collect()}
    assert got[8, 1] == got[9, 1] == 0 and 0 < got[8, 2] <= 10 and got[6, 5] == got[7, 5] == 0
    assert {d for d, _ in got} == {6, 7, 8, 9}
    assert decontaminate.leaks(empty, bench).count() == 0 and decontaminate.leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.edit_distance(np.array([1, 2, 3], np.uint64), np.array([[1, 3, 0]], np.uint64), np.array([2])).tolist() == [1]


def test_decontamination_of_shorter_and_longer_passages(spark):
    r = random.Random(3)
    item = [f"i{k}" for k in range(20)]
    around = lambda x: " ".join([f"a{r.random()}" for _ in range(30)] + x + [f"b{r.random()}" for _ in range(30)])
    cut, more = [item[:p] + item[p + 4 :] for p in range(6, 12)], [item[:p] + ["w", "x", "y", "z"] + item[p:] for p in range(8, 13)]
    docs = spark.createDataFrame(list(enumerate(around(x) for x in [*cut, *more, item[:7] + item[14:]])), "doc_id long, text string")
    got = {x.doc_id: x for x in decontaminate.leaks(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    assert set(got) == set(range(11))
    assert {(x.start_word, x.n_words, x.distance) for i, x in got.items()} == {(30, 16, 4), (30, 24, 4)}


def test_licences(docs, empty, spark):
    assert [(r.doc_id, r.license, r.n_matches) for r in licenses.scan(docs).collect()] == [(14, "MIT", 1)]
    for x in licenses.SENTENCES.values():
        assert re.search(licenses._ANCHOR, x) and re.search(licenses._WORDS, x)
    s = licenses.SENTENCES
    say = lambda *ids: ".\n".join(s[i].capitalize() for i in ids) + "."
    lines = lambda t: re.sub(r"(.{50,70}) ", r"\1\n", t)
    texts = {
        "MIT": "MIT License\n\nCopyright (c) 2020 Foo Bar\n\n" + lines(s[10] + ":\n\n") + lines(say(11, 12, 13)),
        "Apache-2.0": "Copyright 2020 Foo\n\n" + lines(s[14]) + ".\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\n" + lines(say(16, 17)),
        "GPL-3.0-or-later": "Foo, a program.\nCopyright (C) 2020 Foo\n\n" + lines(s[18]) + ".\n\n" + lines(s[24].capitalize()) + ".  See the\nGNU General Public License for more details.\n",
        "BSD-3-Clause": "Copyright (c) 2020, Foo\nAll rights reserved.\n\n" + lines(s[29]) + ":\n\n1. " + lines(s[30]) + ".\n\n2. " + lines(s[31]) + ".\n\n3. " + lines(s[32]) + ".\n\n" + lines(s[33]) + ".",
        "ISC": "Copyright (c) 2020 Foo\n\n" + lines(say(34)) + "\n\n" + lines(say(35)),
        "LGPL-2.1-or-later": lines(say(22, 25, 28)), "AGPL-3.0-or-later": lines(say(20, 24, 27)), "Unlicense": lines(say(37, 38)), "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0.",
        "LicenseRef-all-rights-reserved": "Some text.\nAll rights reserved.",
    }
    got = {}
    for r in licenses.scan(spark.createDataFrame([(k, t) for k, t in enumerate(texts.values())], "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    assert {name: name in got.get(k, ()) for k, name in enumerate(texts)} == dict.fromkeys(texts, True)
    assert got[0] == {"MIT"} and got[2] == {"GPL-3.0-or-later"}
    both = "Released under the MIT License. Released under the MIT License.\n" + lines(s[18]) + "."
    assert {(r.license, r.n_matches) for r in licenses.scan(spark.createDataFrame([(None, both)], "doc_id long, text string")).collect()} == {("GPL-3.0-or-later", 1), ("MIT", 2)}
    assert licenses.scan(empty).count() == 0


def test_sharding(docs, empty, tmp_path):
    store = sharding.Store(docs.sparkSession, f"file://{tmp_path}/s", 16000)
    store.append(docs, 2000)
    store.append(docs.unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long"))), 2000)
    before, n = store.manifest().count(), 2 * docs.count() + 1
    assert store.compact() == 3 and store.manifest().count() < before
    back = store.read()
    assert back.count() == n and back.where("text is null").count() == 2 and set(docs.columns) <= set(back.columns)
    assert store.read(2).count() == n and store.read(1).count() == docs.count()
    with pytest.raises(RuntimeError):
        sharding.Store(docs.sparkSession, f"file://{tmp_path}/s")._commit(store.manifest(), 3)
    store.vacuum(keep=1, retention_s=0)
    assert store.read().count() == n and store.compact() == 3
    assert sharding.shard(empty).count() == 0


def test_compaction_rewrites_in_turns(docs, tmp_path):
    """The runs that grow are exchanged a part at a time; each is rewritten once and no row is lost."""
    store = sharding.Store(docs.sparkSession, f"file://{tmp_path}/s", 4000)
    store.append(docs, 500)
    store.compact()
    lines = store.manifest().collect()
    folders = {x._cg_path.rsplit("/", 2)[-2] for x in lines if x._cg_last > x._cg_first}
    assert len(folders) == min(sharding.TURNS, sum(x._cg_last > x._cg_first for x in lines)) > 1
    assert sum(x._cg_docs for x in lines) == store.read().count() == docs.count()


def test_size_tiers(spark):
    """Uneven runs reach the target, equal small ones cascade, full ones are left alone."""
    sizes = [10] * 20 + [3] + [70] + [500]
    manifest = spark.createDataFrame([(f"s{k}", 0, k, k, 1, b, "") for k, b in enumerate(sizes)], sharding._MANIFEST)
    got = {r._cg_first: r._cg_to for r in sharding.merge_plan(manifest, 160).collect()}
    shards = {}
    for k, b in enumerate(sizes):
        shards[got.get(k, k)] = shards.get(got.get(k, k), 0) + b
    assert 22 not in got and shards[22] == 500
    tiers = Counter(0 if b < 40 else 1 for b in shards.values() if b < 160)
    assert max(tiers.values(), default=0) < sharding.FANOUT and sum(shards.values()) == sum(sizes) and max(b for k, b in shards.items() if k != 22) >= 160


@pytest.mark.parametrize("module", [mixing, sharding, licenses])
def test_oracles(spark, module):
    folder = "/root/testdata/sf0.001"
    for name, sql in module.ORACLE.items():
        con = duckdb.connect()
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
        want = con.sql(sql).df()
        got = module.QUERIES[name](spark, folder).toPandas()
        cols = sorted(got.columns)
        assert sorted(want.columns) == cols
        key = lambda f: f[cols].sort_values(cols).reset_index(drop=True)
        for c in cols:
            a, b = key(got)[c], key(want)[c]
            assert np.allclose(a, b, equal_nan=True) if a.dtype.kind == "f" else a.tolist() == b.tolist()
