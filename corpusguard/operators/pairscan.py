"""Scores of all pairs of chunks and questions in Arrow batches, with rows for the best only.

The same points as lexical.bonus and the same BM25 as retrieval.bm25, which stay the forms
that tests compare with. A chunk is read once: one trie finds which terms it holds anywhere
and which tokens it has. Pairs are sums over those in numpy, and a task keeps of a question
only what can still be in its lists.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of one scan, texts times terms of it and of the names a task remembers, pairs of one sum, entries of a trie's table, titles that a task remembers.
_CHARS, _CELLS, _PAIRS, _TABLE, _NAMES = 1 << 16, 1 << 25, 1 << 16, 1 << 25, 4096
LATIN, DIGIT, HANGUL, BLANK = 1, 2, 3, 4


def _kinds() -> np.ndarray:
    """The kind of each code point: what tokens are runs of, and what (?U)\\s matches."""
    kind = np.zeros(0x110000, np.uint8)
    kind[ord("a") : ord("z") + 1], kind[ord("0") : ord("9") + 1], kind[ord("가") : ord("힣") + 1] = LATIN, DIGIT, HANGUL
    kind[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = BLANK
    return kind


class Words:
    """Terms, looked for anywhere in a text without its blanks, and tokens, counted as whole runs, in one trie."""

    def __init__(self, terms: list[str], tokens: list[str]):
        self.n_terms, self.n_tokens, self.kind = len(terms), len(tokens), _kinds()
        code = {c: i for i, c in enumerate(sorted({c for w in (*terms, *tokens) for c in w}), 1)}
        self.width = len(code) + 1
        self.char = np.zeros(0x110000, np.uint8 if self.width < 256 else np.int32)
        self.char[[ord(c) for c in code]] = list(code.values())
        step, n = {}, 1

        def end(word: str) -> int:
            nonlocal n
            if not word:  # a node that nothing leads to
                n += 1
                return n - 1
            at = 0
            for c in word:
                k = at * self.width + code[c]
                if k not in step:
                    step[k], n = n, n + 1
                at = step[k]
            return at

        term_ends, token_ends = [end(w) for w in terms], [end(w) for w in tokens]
        # Nodes are numbered anew: the root, the ends of the terms in their order, the others.
        number = np.full(n, -1, np.int64)
        number[[0, *term_ends]] = np.arange(len(terms) + 1)
        number[number < 0] = np.arange(len(terms) + 1, n)
        self.token = np.full(n, -1, np.int32)
        self.token[number[token_ends]] = np.arange(len(tokens))
        keys = np.fromiter(step.keys(), np.int64, len(step))
        keys, to = number[keys // self.width] * self.width + keys % self.width, number[np.fromiter(step.values(), np.int64, len(step))].astype(np.int32)
        self.table = None
        if n * self.width <= _TABLE:
            self.table = np.zeros(n * self.width, np.int32)
            self.table[keys] = to
        else:
            order = np.argsort(keys)
            self.keys, self.to = keys[order], to[order]

    def _next(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table.take(state * np.int32(self.width) + char)
        k = state.astype(np.int64) * self.width + char
        i = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where(self.keys[i] == k, self.to[i], 0).astype(np.int32)

    def scan(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of lower-cased texts: which terms each holds; text, token and count of the tokens found; the number of each text's tokens."""
        n = len(texts)
        codes = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le"), np.uint32)
        length = np.fromiter(map(len, texts), np.int64, n) + 1
        of, kind, char = np.repeat(np.arange(n, dtype=np.int32), length), self.kind[codes], self.char[codes]
        char[np.cumsum(length) - 1] = 0
        start = np.concatenate(([0], np.flatnonzero(kind[1:] != kind[:-1]) + 1))
        size = np.diff(start, append=len(codes))
        run = (kind[start] > 0) & (kind[start] < BLANK)
        start, size = start[run], size[run]
        count = np.bincount(of[start], minlength=n)
        run_size = np.zeros(len(codes), np.int32)
        run_size[start] = size
        hangul = (kind[start] == HANGUL) & (size > 1)
        pair = None
        if hangul.any():
            # Bigrams of Hangul runs count twice each, as in retrieval.tokens.
            count = count + np.bincount(of[start[hangul]], weights=2 * (size[hangul] - 1), minlength=n).astype(np.int64)
            pair = np.append((kind[1:] == HANGUL) & (kind[:-1] == HANGUL), False)
        solid = np.flatnonzero(kind != BLANK)
        char, of, run_size = char.take(solid), of.take(solid), run_size.take(solid)
        pair = None if pair is None else pair.take(solid)
        held, found = np.zeros((n, self.n_terms), np.bool_), []

        def tokens(at: np.ndarray, state: np.ndarray, times: int) -> None:
            t = self.token[state]
            at, t = at[t >= 0], t[t >= 0]
            found.extend([of[at].astype(np.int64) * self.n_tokens + t] * times)

        first = char > 0
        if not self.n_terms:
            first &= (run_size > 0) if pair is None else (run_size > 0) | pair
        at, depth = np.flatnonzero(first).astype(np.int32 if len(char) < 1 << 31 else np.int64), 1
        state = self._next(np.zeros(len(at), np.int32), char[at]) if len(at) else at
        while len(at):
            live = np.flatnonzero(state)
            at, state = at.take(live), state.take(live)
            hit = np.flatnonzero(state <= self.n_terms)
            held[of.take(at.take(hit)), state.take(hit) - 1] = True
            whole = np.flatnonzero(run_size.take(at) == depth)
            tokens(at.take(whole), state.take(whole), 1)
            if depth == 2 and pair is not None:
                both = pair[at]
                tokens(at[both], state[both], 2)
            if len(at):
                state = self._next(state, char.take(at + depth))
            depth += 1
        flat, times = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return held, flat // max(1, self.n_tokens), flat % max(1, self.n_tokens), times, count


def _cuts(texts: list[str], n_terms: int):
    """Slices of about _CHARS characters, and of _CELLS texts times terms at most."""
    begin = chars = 0
    most = max(1, _CELLS // max(1, n_terms))
    for i, t in enumerate(texts):
        chars += len(t)
        if chars >= _CHARS or i + 1 - begin >= most:
            yield slice(begin, i + 1)
            begin, chars = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


_ENTRIES = [T.StructField("_tokens", T.BinaryType()), T.StructField("_n", T.LongType()), T.StructField("_length", T.LongType()), T.StructField("_lengths", T.LongType())]


def features(places: DataFrame, terms: list[str], tokens: list[str]) -> DataFrame:
    """places with _held, a bit for each term, and _tokens, (token, count, length of the chunk) of each token found, in place of the lower-cased text _body.

    _n, _length, _lengths: what the row adds to the number of chunks, to the sum of lengths and to their number.
    """
    names = [c for c in places.columns if c != "_body"]
    schema = T.StructType([*(places.schema[c] for c in names), T.StructField("_held", T.BinaryType()), *_ENTRIES])

    def run(batches):
        words = Words(terms, tokens)
        for batch in batches:
            texts = batch.column("_body").to_pylist()
            for cut in _cuts([t or "" for t in texts], len(terms)):
                some = texts[cut]
                held, chunk, token, times, length = words.scan([t or "" for t in some])
                entries = np.stack((token, times, length[chunk]), 1).astype("<i4")
                at = np.searchsorted(chunk, np.arange(len(some) + 1))
                here = pa.array([int(t is not None) for t in some], pa.int64())
                out = [batch.column(c).slice(cut.start, len(some)) for c in names]
                out += [pa.array([r.tobytes() for r in np.packbits(held, axis=1)], pa.binary()), pa.array([entries[at[i] : at[i + 1]].tobytes() for i in range(len(some))], pa.binary())]
                yield pa.RecordBatch.from_arrays([*out, pa.array([1] * len(some), pa.int64()), pa.array(length, pa.int64()), here], schema.names)

    return places.mapInArrow(run, schema)


def joined(rows: DataFrame, key: str) -> DataFrame:
    """The token entries of rows that share their key as those of chunks: rows of one key and length are one chunk, as in retrieval.postings."""
    schema = T.StructType([rows.schema[key], *_ENTRIES])

    def run(batches):
        now, lengths, out = None, {}, []

        def row():
            entries = [(t, n, length) for (length, _), c in lengths.items() for t, n in c.items()]
            known = [length for length, there in lengths if there]
            return (now[0], np.array(entries, "<i4").tobytes(), len(lengths), sum(known), len(known))

        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(arrow)], schema.names)

        arrow = None
        for batch in batches:
            arrow = arrow or [batch.schema.field(key), *(pa.field(f.name, pa.binary() if f.name == "_tokens" else pa.int64()) for f in _ENTRIES)]
            for k, entries, length, there in zip(*(batch.column(c).to_pylist() for c in (key, "_tokens", "_length", "_lengths")), strict=True):
                if now is not None and now[0] != k:
                    out.append(row())
                    lengths = {}
                now = (k,)
                c = lengths.setdefault((length, there), Counter())
                for t, n, _ in np.frombuffer(entries, "<i4").reshape(-1, 3).tolist():
                    c[t] += n
            if len(out) > 1000:
                yield batch_of(out)
                out = []
        if now is not None:
            yield batch_of([*out, row()])

    return rows.select(key, "_tokens", "_length", "_lengths").repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


def counts(entries: DataFrame, n_tokens: int) -> tuple[int, float, np.ndarray]:
    """The number of chunks, their mean length, and in how many of them each token is."""

    def run(batches):
        total, df = np.zeros(3, np.int64), np.zeros(n_tokens, np.int64)
        for b in batches:
            total += [sum(b.column(c).to_pylist()) for c in ("_n", "_length", "_lengths")]
            df += np.bincount(np.frombuffer(b"".join(b.column("_tokens").to_pylist()), "<i4")[::3], minlength=n_tokens)
        yield pa.RecordBatch.from_arrays([*(pa.array([int(x)], pa.int64()) for x in total), pa.array([df.tobytes()], pa.binary())], ["n", "length", "lengths", "df"])

    n = length = lengths = 0
    df = np.zeros(n_tokens, np.int64)
    for r in entries.select(*(f.name for f in _ENTRIES)).mapInArrow(run, "n long, length long, lengths long, df binary").toLocalIterator():
        n, length, lengths, df = n + r["n"], length + r["length"], lengths + r["lengths"], df + np.frombuffer(r["df"], np.int64)
    return n, length / lengths if lengths else 0.0, df


class Sums:
    """Counts over a question's terms by role and place, several of them in the bits of one word.

    fields: name to a function of (role, place) that gives what one term adds; asked: for
    each question its (term, role).
    """

    def __init__(self, asked: list[list[tuple[int, int]]], fields: dict):
        roles = sorted({r for q in asked for _, r in q})
        adds = {r: {f: np.array([add(r, place) for place in range(32)], np.int64) for f, add in fields.items()} for r in roles}
        times = [Counter(r for _, r in q) for q in asked]
        self.words, self.at = 0, {}
        used = 63
        for f in fields:
            bits = max((sum(n * int(adds[r][f].max()) for r, n in c.items()) for c in times), default=0).bit_length()
            if bits:
                if used + bits > 62:
                    self.words, used = self.words + 1, 0
                self.at[f] = (self.words - 1, used, (1 << bits) - 1)
                used += bits
        self.parts = []
        for r in roles:
            rows = np.unique([t for q in asked for t, role in q if role == r])
            table = np.zeros((self.words, 32), np.int64)
            for f, (w, shift, _) in self.at.items():
                table[w] += adds[r][f] << shift
            self.parts.append((rows, table, [np.searchsorted(rows, [t for t, role in q if role == r]) for q in asked]))
        self.n = len(asked)

    def __call__(self, place: np.ndarray):
        """The field by name, questions by chunks; place: terms by chunks."""
        total = np.zeros((self.words, self.n, place.shape[1]), np.int64)
        for rows, table, of in self.parts:
            here = place[rows]
            for w in range(self.words):
                add = table[w][here]
                for q, terms in enumerate(of):
                    if len(terms):
                        total[w, q] += add[terms].sum(0)

        def field(name: str):
            if name not in self.at:
                return np.zeros((1, 1), np.int64)
            w, shift, mask = self.at[name]
            return (total[w] >> shift) & mask

        return field


def rounded(x: np.ndarray) -> np.ndarray:
    return np.sign(x) * np.floor(np.abs(x) * 1e9 + 0.5) / 1e9


def _order(keys: pa.Array) -> np.ndarray:
    """The place of each key in Spark's order."""
    out = np.empty(len(keys), np.int64)
    out[pc.array_sort_indices(keys, null_placement="at_start").to_numpy()] = np.arange(len(keys))
    return out


def _nth(group_changes: np.ndarray) -> np.ndarray:
    """The place of each row in its run, from where runs begin."""
    at = np.arange(len(group_changes))
    return at - np.maximum.accumulate(np.where(group_changes, at, 0))


def _begins(*columns: np.ndarray) -> np.ndarray:
    out = np.zeros(len(columns[0]), np.bool_)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


class _Best:
    """Of the pairs seen in a task, those that can be in a question's lists.

    sparse: the best length of a question. exact: up to k of them leave, being among the best
    of sparse, then per_source of a source and 2k of a question stay; so the best k +
    per_source of a source are enough, and of those nothing behind 3k that are among the best
    per_source of their source.
    """

    def __init__(self, n: int, k: int, per_source: int, length: int):
        self.k, self.per_source, self.length = k, per_source, length
        self.least = [np.full(n, -np.inf), np.full(n, -np.inf)]
        self.rows, self.chunks = None, None

    def add(self, chunks: list[pa.Array], raw: np.ndarray, scores: list[np.ndarray]) -> None:
        """chunks: key and source; scores: sparse and exact, questions by chunks, exact minus infinity where there is none."""
        before = 0 if self.chunks is None else len(self.chunks[0])
        parts = [] if self.rows is None else [self.rows]
        for kind, score in enumerate(scores):
            r = rounded(score)
            q, c = np.nonzero((r >= self.least[kind][:, None]) & np.isfinite(score))
            parts.append((q, c + before, np.full(len(q), kind), raw[q, c], score[q, c], r[q, c]))
        self.chunks = chunks if self.chunks is None else [pa.concat_arrays([a, b]) for a, b in zip(self.chunks, chunks, strict=True)]
        self._cut([np.concatenate(x) for x in zip(*parts, strict=True)])

    def _cut(self, rows: list[np.ndarray]) -> None:
        key, source = _order(self.chunks[0]), self.chunks[1].dictionary_encode(null_encoding="encode").indices.to_numpy()
        kept = []
        for kind in (0, 1):
            q, c, _, _, _, r = x = [y[rows[2] == kind] for y in rows]
            if kind == 0:
                o = np.lexsort((key[c], -r, q))
                o = o[_nth(_begins(q[o])) < self.length]
                last = self.length - 1
                full = np.arange(len(o))[_nth(_begins(q[o])) == last]
            else:
                o = np.lexsort((key[c], -r, source[c], q))
                nth = _nth(_begins(q[o], source[c[o]]))
                o, nth = o[nth < self.k + self.per_source], nth[nth < self.k + self.per_source]
                again = np.lexsort((key[c[o]], -r[o], q[o]))
                o, counted = o[again], nth[again] < self.per_source
                sure = np.cumsum(counted) - counted
                first = _begins(q[o])
                sure = sure - np.maximum.accumulate(np.where(first, sure, 0))
                o, counted, sure = o[sure < 3 * self.k], counted[sure < 3 * self.k], sure[sure < 3 * self.k]
                full = np.flatnonzero(counted & (sure == 3 * self.k - 1))
            self.least[kind][q[o[full]]] = r[o[full]]
            kept.append([y[o] for y in x])
        rows = [np.concatenate(x) for x in zip(*kept, strict=True)]
        used, rows[1] = np.unique(rows[1], return_inverse=True)
        self.rows, self.chunks = tuple(rows), [a.take(pa.array(used)) for a in self.chunks]


def best(rows: DataFrame, key: str, asked: dict, fields: dict, places: dict[str, int], points, idf: np.ndarray, avgdl: float, k: int, per_source: int, length: int, near) -> DataFrame:
    """query_id, key, source, raw_score, retrieval_type, _group, score, _order: of each task the pairs that can be in a list; _order is the score as it is ranked.

    rows: features with the columns of names in places (body apart, as _held). points:
    function of fields, questions and the chunks' own that gives bonus and exact points.
    asked: query_id, terms, tokens, each question's terms and tokens, and its flags.
    near: BM25's part of a token's count and the chunk's length by the mean one.
    """
    names = [c for c in places if c != "_body"]
    schema = T.StructType([
        T.StructField("query_id", asked["query_type"]), rows.schema[key], rows.schema["source"], T.StructField("raw_score", T.DoubleType()), T.StructField("retrieval_type", T.StringType()),
        T.StructField("_group", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("_order", T.DoubleType()),
    ])
    terms, n = asked["terms"], len(asked["query_id"])
    blank = [i for i, t in enumerate(terms) if not t]

    def run(batches):
        if not n:
            return
        words, sums = Words(terms, []), Sums(asked["of"], fields)
        seen, named, tagged = {}, {}, {}
        out, step = _Best(n, k, per_source, length), max(16, _PAIRS // n)
        own = [np.array(x, np.int64) for x in asked["tokens"]]

        def titled(sets: list[tuple]) -> np.ndarray:
            """Places by terms of the chunks' names, texts of the same names once."""
            new = [s for s in dict.fromkeys(sets) if s not in seen]
            if (len(seen) + len(new)) * len(terms) > _CELLS:
                seen.clear()
                new = list(dict.fromkeys(sets))
            if new:
                flat = [t for s in new for t in s]
                held = words.scan(flat)[0] if terms else np.zeros((len(flat), 0), np.bool_)
                held = held.reshape(len(new), len(names), len(terms))
                for s, h in zip(new, held, strict=True):
                    seen[s] = sum((h[i] * np.uint8(places[c]) for i, c in enumerate(names)), np.zeros(len(terms), np.uint8))
            return np.stack([seen[s] for s in sets], 1)

        def by_text(cache: dict, texts: list[str], test) -> np.ndarray:
            if len(cache) > _NAMES:
                cache.clear()
            for t in dict.fromkeys(texts):
                if t not in cache:
                    cache[t] = test(t)
            return np.stack([cache[t] for t in texts], 1)

        def is_named(title: str) -> np.ndarray:
            return np.array([title != "" and title in t for t in asked["compact"]])

        def is_tagged(tag: str) -> np.ndarray:
            alone = re.compile(rf"(?<![a-z]){re.escape(tag)}(?![a-z])")
            return np.array([tag != "" and tag in t and alone.search(t) is not None for t in asked["text"]])

        for whole in batches:
            for begin in range(0, whole.num_rows, step):
                b = whole.slice(begin, step)
                m = b.num_rows
                col = {c: b.column(c).to_pylist() for c in (*names, "_tag", "block_type", "_held", "_tokens")}
                bits = np.frombuffer(b"".join(col["_held"]), np.uint8).reshape(m, -1)
                body = np.unpackbits(bits, axis=1, count=len(terms)) if len(terms) else np.zeros((m, 0), np.uint8)
                place = titled(list(zip(*(col[c] for c in names), strict=True))) | (np.ascontiguousarray(body.T) * np.uint8(places["_body"]))
                place[blank] = sum(places.values())
                entries = np.frombuffer(b"".join(col["_tokens"]), "<i4").reshape(-1, 3)
                chunk = np.repeat(np.arange(m), [len(x) // 12 for x in col["_tokens"]])
                part = np.zeros((len(idf), m))
                np.add.at(part, (entries[:, 0], chunk), idf[entries[:, 0]] * near(entries[:, 1].astype(np.float64), entries[:, 2] / max(avgdl, 1e-9)))
                raw = np.stack([part[t].sum(0) for t in own])
                bonus, exact = points(sums(place), asked, by_text(named, col["_title"], is_named), by_text(tagged, col["_tag"], is_tagged), col["block_type"])
                exact = exact + 0.45 * np.minimum(raw, 80.0)
                out.add([b.column(key), b.column("source")], raw, [raw + bonus, np.where(exact > 0, exact, -np.inf)])
        if out.rows is not None:
            q, c, kind, raw, score, r = out.rows
            for begin in range(0, len(q), 10000):
                s = slice(begin, begin + 10000)
                keys, sources = (a.take(pa.array(c[s])) for a in out.chunks)
                exact = pa.array(kind[s] == 1)
                group = pc.if_else(exact, sources.cast(pa.string()), pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays([
                    asked["query_id"].take(pa.array(q[s])), keys, sources, pa.array(raw[s]), pc.if_else(exact, "sparse_exact", "sparse"), group, pa.array(score[s]), pa.array(r[s]),
                ], schema.names)

    return rows.mapInArrow(run, schema)


def together(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def repeated(chunks: DataFrame, key: str) -> DataFrame:
    """_k: keys that several rows have, and null if a row has it."""
    return chunks.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_c")).where("_c > 1 OR _k IS NULL").select("_k")
