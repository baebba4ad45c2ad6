"""The detector's features of texts, measured in Arrow batches.

The same columns as detector.feature_steps, which stays the form that SQL checks: a
text is cut once, and a rule is tried only where a word that each of its matches
holds is in the text.
"""

from __future__ import annotations

import bisect
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpusguard.functions import fixed
from corpusguard.functions.dialect import _SPACES, main_word, needed
from corpusguard.operators import chunking, detector

_OUTER = _SPACES.encode().decode("unicode_escape")
_LINE, _SENTENCE = re.compile(r"\r\n|[\n\r]"), re.compile(detector.SENTENCE)
_TOKEN, _BLANK = re.compile(detector.TOKEN), re.compile(r"[ \t\n\x0b\f\r]+")
_MARK = re.compile(r"[^\w \t\n\x0b\f\r\xa0]")
_PLAIN = bytes(c for c in range(128) if not _MARK.match(chr(c)))
_FLAGS = re.I | re.M
_BULLET = re.compile(detector.BULLET, _FLAGS)
_GROUPS = (fixed.INSTRUCTION_RULES, fixed.REFUSAL_RULES, fixed.EXPLICIT_RULES)


def _rule(pattern: str, dotall: bool = False):
    return re.compile(pattern, _FLAGS | (re.S if dotall else 0)), frozenset(needed(pattern))


_RULES = [[(*_rule(p, dotall), w) for _, w, _, p, dotall in group] for group in _GROUPS]
_MARKERS = [_rule(m) for m in fixed.PROMPT_MARKERS]
_MIDSTREAM, _SHIFT = _rule(detector.MIDSTREAM, True), _rule(detector.SHIFT, True)
_MODAL = frozenset(map(main_word, fixed.MODAL_TERMS))
_POLICY = frozenset(map(main_word, fixed.POLICY_TERMS))
_WORDS = sorted(_MODAL | _POLICY | _MIDSTREAM[1] | _SHIFT[1] | {w for _, words in _MARKERS for w in words} | {w for group in _RULES for _, words, _ in group for w in words})
if not all(words for group in (*_RULES, _MARKERS, [_MIDSTREAM, _SHIFT]) for words in (r[1] for r in group)):
    raise ValueError("a rule without a word that its matches hold")
#: Tokens seen that hold no word.
_bare: set[str] = set()
_MOST_BARE = 1 << 18

_HALF = pa.struct([("i", pa.float64()), ("r", pa.float64()), ("e", pa.float64()), ("n", pa.int64()), ("l", pa.int64()), ("m", pa.int32()), ("b", pa.int32()), ("p", pa.int64()), ("o", pa.int64())])
_INTS = {"n_tokens": pa.int64(), "n_lines": pa.int64(), "n_sentences": pa.int64(), "modal_count": pa.int64(), "policy_count": pa.int64(), "marker_count": pa.int32(), "bullet_count": pa.int32(), "midstream": pa.int32(), "discourse": pa.int32(), "n_chars": pa.int64(), "n_marks": pa.int64()}
_SCHEMA = (
    "hits array<string>, ci array<int>, cr array<int>, ce array<int>, front string, back string, repetition_ratio double, "
    + ", ".join(f"{k} {'bigint' if t == pa.int64() else 'int'}" for k, t in _INTS.items())
    + ", pf struct<i: double, r: double, e: double, n: bigint, l: bigint, m: int, b: int, p: bigint, o: bigint>, pb struct<i: double, r: double, e: double, n: bigint, l: bigint, m: int, b: int, p: bigint, o: bigint>"
)
#: Chunks in one batch of windows.
_ROWS = 4096
_NO_HALF = (0.0, 0.0, 0.0, 0, 1, 0, 0, 0, 0)


def _held(text: str, toks: set[str]) -> list[str]:
    """The words that the text holds; each lies within a token."""
    if not text.isascii() and ("İ" in text or "ı" in text or "ſ" in text):
        return _WORDS  # rules match these letters with others than their lower case
    new = toks - _bare
    joined = " ".join(new)
    words = [w for w in _WORDS if w in joined]
    if len(_bare) >= _MOST_BARE:
        _bare.clear()
    _bare.update(t for t in new if not any(w in t for w in words)) if words else _bare.update(new)
    return words


def _count(x: str, rule, held: frozenset[str]) -> int:
    return 0 if held.isdisjoint(rule[1]) else sum(1 for _ in rule[0].finditer(x))


def _occurrences(low: str, terms: tuple[str, ...]) -> int:
    return sum(low.count(w) for w in terms)


def _bullets(x: str) -> int:
    for q in x.split("\n"):
        c = q.lstrip()[:1]
        if c and (c in "-*•" or c.isdecimal()):
            return sum(1 for _ in _BULLET.finditer(x))
    return 0


def _one_space(q: str) -> str:
    return _BLANK.sub(" ", q) if "  " in q or "\t" in q or "\x0b" in q or "\f" in q else q


def _lines(x: str) -> list[str]:
    if "\n" not in x and "\r" not in x:
        return [y] if (y := x.strip(_OUTER)) else []
    return [y for q in _LINE.split(x) if (y := q.strip(_OUTER))]


def _half(x: str, held: frozenset[str]) -> tuple:
    """Raw parts of the pressure of a half; its tokens and lines are counted only where something is divided by them."""
    b = _bullets(x)
    if not held:
        return (0.0, 0.0, 0.0, 0, max(1, len(_lines(x))), 0, b, 0, 0) if b else _NO_HALF
    low = x.lower()
    if len(held) < len(_WORDS):
        # A match of the half holds a word that the half holds.
        held = frozenset(w for w in held if w in low)
    raw = []
    for group in _RULES:
        s = 0.0
        for rule in group:
            s += min(_count(x, rule, held), 2) * rule[2]
        raw.append(s)
    m = sum(_count(x, rule, held) for rule in _MARKERS)
    p = _occurrences(low, fixed.POLICY_TERMS) if not held.isdisjoint(_POLICY) else 0
    o = _occurrences(low, fixed.MODAL_TERMS) if not held.isdisjoint(_MODAL) else 0
    return (*raw, len(_TOKEN.findall(low)) if p or o else 0, max(1, len(_lines(x))) if m or b else 1, m, b, p, o)


def _cut(text: str, sents: list[str]) -> tuple[str, str]:
    n = len(sents)
    if n >= 4:
        return " ".join(sents[: n // 2]), " ".join(sents[n // 2 :])
    mid = max(1, len(text) // 2)
    sp = text.rfind(" ", 0, mid + 80)
    cut = sp if sp >= max(1, mid - 80) else mid
    return text[:cut].strip(_OUTER), text[cut:].strip(_OUTER)


def _repetition(toks: list[str], distinct: int, lines: list[str]) -> float:
    n = len(toks)
    if not n:
        return 0.0
    out = 1 - distinct / n
    if len(lines) > 1:
        out = max(out, 1 - len({_one_space(q.lower()) for q in lines}) / len(lines))
    if n > 1:
        out = max(out, 1 - len(set(zip(toks, toks[1:]))) / (n - 1))  # noqa: B905
    return out


def _marks(text: str) -> int:
    """Characters that are no letters, digits, underscores or white space."""
    return len(text.encode().translate(None, _PLAIN)) if text.isascii() else len(_MARK.findall(text))


def _windows(batches):
    """Windows of the texts of doc_id, domain, text, as chunking.chunk_sql makes them."""
    step = chunking.SIZE - chunking.OVERLAP
    for batch in batches:
        rows: list[list] = [[], [], [], [], []]

        def out():
            names = ["ordinal", "start", "end_"]
            return pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(rows[0], pa.int64())) for c in ("doc_id", "domain")], *[pa.array(v, pa.int64()) for v in rows[1:4]], pa.array(rows[4], pa.string())], ["doc_id", "domain", *names, "text"])  # noqa: B023

        for i, text in enumerate(batch.column("text")):
            t = (text.as_py() or "").strip(_OUTER)
            for k, s in enumerate(range(0, max(len(t) - chunking.OVERLAP - 1, 0) + 1, step)):
                if piece := t[s : s + chunking.SIZE].strip(_OUTER):
                    for v, x in zip(rows, (i, k, s, min(s + chunking.SIZE, len(t)), piece), strict=True):
                        v.append(x)
                if len(rows[0]) >= _ROWS:
                    yield out()
                    rows = [[], [], [], [], []]
        if rows[0]:
            yield out()


#: Kinds of characters, for those below U+FFFF.
_TOK, _SIGN, _STOP, _LINE_END, _SOLID, _GAP, _DIGIT, _DASH, _ALNUM, _POINT, _ODD = (1 << k for k in range(11))
#: Rows that are measured at once; a row's number and 56 bits of a hash make a key.
_AT_ONCE = 256
_BASE, _INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_tables: list[np.ndarray] = []
#: Hashes of tokens seen, each at the place that its upper bits name, and which of them hold a word.
_SEEN_BITS = 19
_seen, _holds = np.zeros(1 << _SEEN_BITS, np.uint64), np.zeros(1 << _SEEN_BITS, bool)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """Kind of each character and a number for its lower case; odd ones have another length in lower case, or one that hangs on the rest."""
    if not _tables:
        kind, low = np.zeros(1 << 16, np.uint16), np.arange(1 << 16, dtype=np.uint64)
        for c in range(1 << 16):
            x = chr(c)
            y = x.lower()
            odd = c == 0xFFFF or len(y) != 1 or x in "Σıſ" or (c > 127 and y < "\x80")
            if len(y) == 1:
                low[c] = ord(y)
            flags = (_TOKEN.match(x), _MARK.match(x), _SENTENCE.match(x), x in "\n\r", x not in _OUTER, _BLANK.match(x), x.isdecimal(), x in "-*•", x.isalnum(), x in ".)", odd)
            kind[c] = sum(1 << k for k, f in enumerate(flags) if f)
        _tables.extend([kind, _mix(low + np.uint64(1)) | np.uint64(1)])
    return _tables[0], _tables[1]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, n at least."""
    if len(_tables) < 4 or len(_tables[2]) < n:
        steps = np.full(1 << max(17, n.bit_length()), _BASE)
        steps[0] = 1
        up = np.multiply.accumulate(steps)
        steps[1:] = _INVERSE
        _tables[2:] = [up, np.multiply.accumulate(steps)]
    return _tables[2], _tables[3]


def _hashes(value: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hash of the values from each start to the next; zeros count for nothing at the end."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    p, q = _powers(len(value))
    return _mix(np.add.reduceat(value * p[: len(value)], starts) * q[starts])


def _distinct(row: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """How many different hashes each of n rows has."""
    key = np.sort(row.astype(np.uint64) << np.uint64(56) | h >> np.uint64(8))
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    return np.bincount((key[first] >> np.uint64(56)).astype(np.int64), minlength=n)


def _stretches(at: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last of the places at between two breaks."""
    cut = np.searchsorted(at, np.flatnonzero(breaks))
    lo, hi = np.concatenate([[0], cut]), np.append(cut, len(at))
    some = hi > lo
    return at[lo[some]], at[hi[some] - 1]


def _holding(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, joined: str) -> np.ndarray:
    """Which of the tokens hold a word."""
    at = (h >> np.uint64(64 - _SEEN_BITS)).view(np.int64)
    holds = _holds[at]
    new = np.flatnonzero(_seen[at] != h)
    if len(new):
        uniq, first, back = np.unique(h[new], return_index=True, return_inverse=True)
        first = new[first]
        every = " ".join([joined[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]).lower()
        after = np.cumsum(ends[first] - starts[first] + 1).tolist()
        found = np.zeros(len(uniq), bool)
        for w in _WORDS:
            p = every.find(w)
            while p >= 0:
                k = bisect.bisect_right(after, p)
                found[k] = True
                p = every.find(w, after[k])
        holds[new] = found[back]
        at, first = np.unique(uniq >> np.uint64(64 - _SEEN_BITS), return_index=True)
        _seen[at.view(np.int64)], _holds[at.view(np.int64)] = uniq[first], found[first]
    return holds


def _at_once(texts: list[str]) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray, list[str], list[str]]:
    """Of up to _AT_ONCE texts: which may hold a word, a bullet or an odd character; of the others, counts, repetition and the halves' first characters.

    Tokens, pairs of them and lines are told apart by hashes of 56 bits.
    """
    n = len(texts)
    kinds, values = _kinds()
    joined = "\n".join(texts) + "\n"
    cp = np.minimum(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), 0xFFFF).astype(np.uint16)
    size = np.array([len(x) for x in texts])
    row = np.repeat(np.arange(n, dtype=np.int32), size + 1)
    kind, value = kinds[cp], values[cp]
    has = lambda k: kind & k != 0
    count = lambda at: np.bincount(row[at], minlength=n)
    other = ~has(_ALNUM)
    slow = np.zeros(n, bool)
    slow[row[has(_ODD)]] = True
    # A number with a point before anything but a letter or digit may begin a bullet, of a half too; so may a dash (below).
    slow[row[:-2][has(_DIGIT)[:-2] & has(_POINT)[1:-1] & other[2:]]] = True

    tok = has(_TOK)
    # Texts end in a line end, so each token ends before the last character.
    edge = np.flatnonzero(np.concatenate([tok[:1], tok[1:] != tok[:-1]]))
    starts, ends = edge[::2], edge[1::2]
    trow, h = row[starts], _hashes(np.where(tok, value, np.uint64(0)), starts)
    n_tokens, tokens = count(starts), _distinct(trow, h, n)
    both = trow[1:] == trow[:-1]
    pairs = _distinct(trow[1:][both], _mix(h[:-1] * _BASE + h[1:])[both], n)
    slow[trow[_holding(h, starts, ends, joined)]] = True

    solid, stop = has(_SOLID), has(_STOP)
    first, last = _stretches(np.flatnonzero(solid), has(_LINE_END))
    n_lines = count(first)
    # Lines are compared only in texts that have several.
    lines, several = n_lines, n_lines > 1
    if several.any():
        use = several[row]
        place = np.cumsum(use, dtype=np.int32) - 1
        kept = several[row[first]]
        first, last, gaps, line = place[first[kept]], place[last[kept]], has(_GAP)[use], value[use]
        inside = np.zeros(len(line) + 1, np.int8)
        inside[first] = 1
        inside[last + 1] -= 1
        inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
        blank = inside & gaps
        keep = inside.copy()
        keep[1:] &= ~(blank[1:] & blank[:-1])
        lines = _distinct(row[use][first], _hashes(np.where(blank, values[0x20], line)[keep], np.cumsum(keep)[first] - 1), n)

    begin, _ = _stretches(np.flatnonzero(solid & ~stop), stop)
    n_sentences = count(begin)
    offs = np.cumsum(n_sentences) - n_sentences
    for i in np.flatnonzero(has(_DASH)[:-1] & other[1:]).tolist():
        # In a text that is halved between sentences only where a line or a sentence begins.
        j = i - 1
        while j >= 0 and joined[j] not in "\n\r" and (joined[j].isspace() or joined[j] in _OUTER):
            j -= 1
        if j < 0 or kind[j] & (_STOP | _LINE_END) or n_sentences[row[i]] < 4:
            slow[row[i]] = True
    fronts, backs = [], []
    for i, (k, o) in enumerate(zip(n_sentences.tolist(), offs.tolist(), strict=True)):
        if k >= 4:
            front, back = joined[begin[o]], joined[begin[o + k // 2]]
        else:
            front, back = (x[:1] for x in _cut(texts[i], []))
        fronts.append(front)
        backs.append(back)

    of = lambda x, y: 1 - x / np.maximum(y, 1)
    repeated = np.where(n_tokens > 0, of(tokens, n_tokens), 0.0)
    repeated = np.where((n_tokens > 0) & (n_lines > 1), np.maximum(repeated, of(lines, n_lines)), repeated)
    repeated = np.where(n_tokens > 1, np.maximum(repeated, of(pairs, n_tokens - 1)), repeated)
    return slow, {"n_tokens": n_tokens, "n_lines": n_lines, "n_sentences": n_sentences, "n_chars": size, "n_marks": count(has(_SIGN))}, repeated, fronts, backs


def _measured(batches):
    for batch in batches:
        n = batch.num_rows
        ints = {k: np.zeros(n, np.int64) for k in _INTS}
        counts = [np.zeros((n, len(group)), np.int32) for group in _RULES]
        hits, fronts, backs, repeated = [[] for _ in range(n)], [], [], np.zeros(n)
        halves = [[np.full(n, v) for v in _NO_HALF] for _ in range(2)]
        texts = [x or "" for x in batch.column("text").to_pylist()]
        todo: list[int] = []
        for lo in range(0, n, _AT_ONCE):
            some = texts[lo : lo + _AT_ONCE]
            slow, found, again, front, back = _at_once(some)
            for k, v in found.items():
                ints[k][lo : lo + len(some)] = v
            repeated[lo : lo + len(some)] = again
            fronts += front
            backs += back
            todo += (np.flatnonzero(slow) + lo).tolist()
        for i in todo:
            text = texts[i]
            low = text.lower()
            toks, lines = _TOKEN.findall(low), _lines(text)
            sents = [y for q in _SENTENCE.split(text) if (y := q.strip(_OUTER))]
            distinct = set(toks)
            words = _held(text, distinct)
            held = frozenset(words)
            front, back = _cut(text, sents)
            row = {"n_tokens": len(toks), "n_lines": len(lines), "n_sentences": len(sents), "n_chars": len(text), "n_marks": _marks(text), "bullet_count": _bullets(text)}
            if held:
                for out, group in zip(counts, _RULES, strict=True):
                    for k, rule in enumerate(group):
                        if not held.isdisjoint(rule[1]):
                            out[i, k] = _count(text, rule, held)
                row |= {"marker_count": sum(_count(text, rule, held) for rule in _MARKERS), "midstream": not held.isdisjoint(_MIDSTREAM[1]) and _MIDSTREAM[0].search(text) is not None, "discourse": not held.isdisjoint(_SHIFT[1]) and _SHIFT[0].search(text) is not None}
                row |= {"modal_count": _occurrences(low, fixed.MODAL_TERMS) if not held.isdisjoint(_MODAL) else 0, "policy_count": _occurrences(low, fixed.POLICY_TERMS) if not held.isdisjoint(_POLICY) else 0}
            for k, v in row.items():
                ints[k][i] = v
            hits[i] = words
            fronts[i], backs[i] = front[:1], back[:1]
            repeated[i] = _repetition(toks, len(distinct), lines)
            for half, x in zip(halves, (front, back), strict=True):
                for out, v in zip(half, _half(x, held), strict=True):
                    out[i] = v
        lists = [pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * c.shape[1]), pa.array(c.ravel())) for c in counts]
        structs = [pa.StructArray.from_arrays([pa.array(v).cast(f.type) for v, f in zip(h, _HALF, strict=True)], fields=list(_HALF)) for h in halves]
        got = [pa.array(hits, pa.list_(pa.string())), *lists, pa.array(fronts, pa.string()), pa.array(backs, pa.string()), pa.array(repeated, pa.float64()), *[pa.array(v).cast(_INTS[k]) for k, v in ints.items()], *structs]
        yield pa.RecordBatch.from_arrays([*batch.columns, *got], [*batch.schema.names, "hits", "ci", "cr", "ce", "front", "back", "repetition_ratio", *_INTS, "pf", "pb"])


def window_features(docs: DataFrame, text: bool = False) -> DataFrame:
    """features of the windows of documents (doc_id, source, text): chunking.chunk_sql and features in one pass."""
    d = docs.selectExpr("doc_id", "source AS domain", "text")
    schema = T.StructType([*d.schema.fields[:2], *T.StructType.fromDDL("ordinal bigint, start bigint, end_ bigint, text string, " + _SCHEMA).fields])
    return _features(d.mapInArrow(lambda batches: _measured(_windows(batches)), schema), text)


def features(chunks: DataFrame, text: bool = False) -> DataFrame:
    """chunks (domain, text and any others) with the raw features of their texts; of a half, front and back keep the first character.

    A null text counts as empty; text: whether the texts stay.
    """
    schema = T.StructType([*chunks.schema.fields, *T.StructType.fromDDL(_SCHEMA).fields])
    return _features(chunks.mapInArrow(_measured, schema), text)


def _features(d: DataFrame, text: bool) -> DataFrame:
    if not text:
        d = d.drop("text")
    ratio = detector.ratio
    return d.selectExpr(
        "*", "CAST(n_chars AS DOUBLE) AS char_length", "CAST(n_tokens AS DOUBLE) / greatest(1, n_sentences) AS avg_sentence_length", f"{ratio('modal_count', 'n_tokens')} AS modal_ratio", f"{ratio('policy_count', 'n_tokens')} AS policy_density",
        "CAST(n_marks AS DOUBLE) / greatest(1, n_chars) AS punctuation_density", "CAST(marker_count AS DOUBLE) / greatest(1, n_lines) AS marker_density", "CAST(bullet_count AS DOUBLE) / greatest(1, n_lines) AS bullet_density",
        "CASE WHEN midstream + discourse = 2 THEN 1.0E0 WHEN midstream + discourse = 1 THEN 0.65E0 ELSE 0.0E0 END AS flow_shift",
    ).drop("n_chars", "n_marks")
