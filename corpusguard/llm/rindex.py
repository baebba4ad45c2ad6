"""Repeated byte strings by a run-length index (operator 4).

Every MATCH-byte window has one anchor, the smallest hashed K-gram in it. Only the
surroundings of anchors that two documents share can hold repeated windows. Equal
surroundings of an anchor are one form: where a smaller document has the same form,
all of its windows repeat there, and no text is looked at. A window that two forms
share reaches SIDE bytes beyond the anchor on one side at least, so of the first
holders of forms only those are looked at that agree with another form on a side;
they are dealt by anchor, and all forms that hold a window meet in one shard. A shard builds the Burrows-Wheeler transform
of the forms as runs with the text positions of run ends, and streams each form
backwards through it: the matching length with the preceding suffix grows by one
inside a run, and is compared afresh from a sampled run end at its head. Suffixes
that match over MATCH bytes form a class; the smallest document of a class keeps
its bytes.

Defined results: a null text is empty; a text under MATCH bytes loses nothing; rows
with one doc_id are one document's versions, each judged by its own text, and never
match each other; a null doc_id is left out; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusguard.llm.common import _TABLE, mix, powers, save, slices

MATCH, K = 50, 16
AROUND = MATCH - K
CHUNK = 24_000
SIDE = AROUND // 2
_STRIDE = 96
#: Windows whose anchors are looked for at once, and bits that hold a place among them.
_BLOCK, _PLACE_BITS = 1 << 14, 15
#: Rows by which a chunk grows.
_PART = 512
_SEED = "anchor long, doc_id long, place long, form long, more long"


def anchors(data: np.ndarray, offs: np.ndarray, key: np.ndarray | None = None) -> np.ndarray:
    """Bytes at which the anchors of the windows of the rows start, ascending; windows never cross rows.

    The smallest key of a window is found by the key's upper bits, with the place below them, so the first of equal ones counts.
    """
    n = len(data) - MATCH + 1
    span = AROUND + 1
    if n < 1:
        return np.zeros(0, np.int64)
    key = _grams(data) if key is None else key
    inside = np.ones(n, bool)
    # The last MATCH - 1 bytes of a row start no window.
    late = offs[1:, None] - np.arange(1, MATCH)
    inside[late[(late >= offs[:-1, None]) & (late < n)]] = False
    hit = np.zeros(len(key), bool)
    places = np.arange(_BLOCK + span - 1, dtype=np.uint64)
    low_bits = np.uint64((1 << _PLACE_BITS) - 1)
    for s in range(0, n, _BLOCK):
        e = min(s + _BLOCK, n)
        m = key[s : e + span - 1] & ~low_bits
        m |= places[: len(m)]
        width = 1
        while 2 * width <= span:
            m = np.minimum(m[: len(m) - width], m[width:])
            width *= 2
        m = np.minimum(m[: e - s], m[span - width : span - width + e - s])[inside[s:e]]
        hit[(m & low_bits).view(np.int64) + s] = True
    return np.flatnonzero(hit)


def _grams(data: np.ndarray) -> np.ndarray:
    b = data.astype(np.uint64)
    two = b[:-1] << np.uint64(8) | b[1:]
    four = two[:-2] << np.uint64(16) | two[2:]
    eight = four[:-4] << np.uint64(32) | four[4:]
    return mix(mix(eight[:-8]) + eight[8:])


def _seeds(batches):
    for batch in batches:
        ids, versions = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for i, j, data, offs in slices(batch.column(2)):
            key = _grams(data) if len(data) >= MATCH else None
            at = anchors(data, offs, key)
            if not len(at):
                continue
            row = np.searchsorted(offs, at, "right") - 1
            start, end = np.maximum(at - AROUND, offs[row]), np.minimum(at + MATCH, offs[row + 1])
            p, q = powers(len(data))
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[data] * p)])
            of = lambda a, b: mix((total[b] - total[a]) * q[a] + (b - a).astype(np.uint64))  # noqa: B023, E731
            pos = at - offs[row]
            # 15 bits of what follows and of what precedes, none where the text ends before SIDE bytes; the version below.
            after = np.where(end - at >= K + SIDE, of(at, np.minimum(at + K + SIDE, len(data))) >> np.uint64(49) | np.uint64(1 << 15), np.uint64(0))
            before = np.where(pos >= SIDE, of(np.maximum(at - SIDE, 0), at) >> np.uint64(49) | np.uint64(1 << 15), np.uint64(0))
            more = after << np.uint64(48) | before << np.uint64(32) | versions[i:j][row].view(np.uint32).astype(np.uint64)
            cols = key[at] >> np.uint64(16), ids[i:j][row], pos << 6 | end - at, of(start, end), more
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in cols], ["anchor", "doc_id", "place", "form", "more"])


def _surroundings(batches):
    for batch in batches:
        hits = batch.column("hits")
        ho = hits.offsets.to_numpy() - hits.offsets[0].as_py()
        values = hits.flatten()
        pos, anchor = values.field("pos").to_numpy(), values.field("anchor").to_numpy()
        ids, versions = batch.column("doc_id").to_numpy(), batch.column("version").to_numpy()
        for i, j, data, offs in slices(batch.column("text")):
            p, a = pos[ho[i] : ho[j]].astype(np.int64), anchor[ho[i] : ho[j]]
            row = np.repeat(np.arange(j - i), np.diff(ho[i : j + 1]))
            start = np.maximum(0, p - AROUND)
            lens = np.minimum(p + MATCH, np.diff(offs)[row]) - start
            ends = np.cumsum(lens)
            at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lens, lens) + np.repeat(offs[row] + start, lens)
            around = pa.Array.from_buffers(pa.large_binary(), len(p), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[at]))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(ids[i:j][row]), pa.array(versions[i:j][row]), pa.array(start.astype(np.int32)), around], ["anchor", "doc_id", "version", "start", "bytes"])


def _sorted_by(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Stable order of keys of so many bits, and their ranks from 1 on; in one word with their places where both fit, as that sorts faster."""
    shift = len(key).bit_length()
    if bits + shift <= 64:
        key = np.sort(key << np.uint64(shift) | np.arange(len(key), dtype=np.uint64))
        order = (key & np.uint64((1 << shift) - 1)).view(np.int64)
        key >>= np.uint64(shift)
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
    rank = np.empty(len(key), np.uint64)
    rank[order] = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]]))
    return order, rank


def _suffixes(t: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places of t, whose rows hold n symbols and an end mark of 0, by the suffixes that start there; equal ones by row."""
    places = np.flatnonzero(np.arange(_STRIDE) <= n[:, None])
    left = np.repeat(np.cumsum(n + 1), n + 1) - np.arange(len(places))
    symbols = np.unique(t)
    code = np.searchsorted(symbols, t.ravel()[places]).astype(np.uint64)
    # Symbols that fit into a word beside a place are compared at once, then twice as many in each round.
    each = int(len(symbols) - 1).bit_length()
    width = max(1, (64 - len(places).bit_length()) // max(1, each))
    shifted = lambda x, k: np.where(left > k, np.append(x[k:], np.zeros(min(k, len(x)), x.dtype)), x.dtype.type(0))
    key = code.copy()
    for k in range(1, width):
        key = key << np.uint64(each) | shifted(code, k)
    order, rank = _sorted_by(key, each * width)
    while width < n.max(initial=0) + 1:
        bits = int(rank.max(initial=0)).bit_length()
        order, rank = _sorted_by(rank << np.uint64(bits) | shifted(rank, width), 2 * bits)
        width *= 2
    return places[order]


class RunLengthIndex:
    """Runs of the Burrows-Wheeler transform of texts, with the text positions of run ends."""

    def __init__(self, texts: list[bytes]):
        self.n = np.array([len(x) for x in texts])
        t = np.zeros((len(texts), _STRIDE), np.uint8)
        flat = np.frombuffer(b"".join(texts), np.uint8)
        cols = np.arange(len(flat)) - np.repeat(np.cumsum(self.n) - self.n, self.n)
        t[np.repeat(np.arange(len(texts)), self.n), cols] = flat + 1
        self.text = t
        self.sa = _suffixes(t, self.n)
        before = np.where(self.sa % _STRIDE, t.ravel()[self.sa - 1], 0)
        head = np.ones(len(self.sa), bool)
        head[1:] = before[1:] != before[:-1]
        #: The run that each rank stands in.
        self.run = np.cumsum(head, dtype=np.int32) - 1
        self.start = np.flatnonzero(head)
        self.symbol = before[self.start]
        lens = np.diff(np.append(self.start, len(self.sa)))
        order = np.argsort(self.symbol, kind="stable")
        self.to = np.empty(len(order), np.int64)
        self.to[order] = np.cumsum(lens[order]) - lens[order]
        #: Text position of the last suffix of each run, and the previous run of the same symbol.
        self.end_sample = self.sa[self.start + lens - 1]
        self.previous = np.full(len(order), -1)
        same = np.flatnonzero(self.symbol[order][1:] == self.symbol[order][:-1])
        self.previous[order[same + 1]] = order[same]
        # Where each text's end mark stands: the ranks of the end marks, in order of texts.
        ends = np.flatnonzero(self.sa % _STRIDE == self.n[self.sa // _STRIDE])
        self.first = np.empty(len(texts), np.int64)
        self.first[self.sa[ends] // _STRIDE] = ends
        del self.sa

    def classes(self) -> np.ndarray:
        """texts x _STRIDE: a number for each place, equal where the next MATCH bytes are; -1 where there are fewer."""
        total = int((self.n + 1).sum())
        match = np.zeros(total, np.int16)
        rank = np.full(self.text.shape, -1)
        r, length = self.first.copy(), np.zeros(len(self.n), np.int64)
        flat = self.text.ravel()
        row = np.arange(len(self.n))
        for step in range(1, int(self.n.max(initial=0)) + 1):
            live = row[self.n[row] >= step]
            at = r[live]
            run = self.run[at]
            is_head = at == self.start[run]
            new = self.to[run] + at - self.start[run]
            grown = np.minimum(length[live] + 1, MATCH)
            place = live * _STRIDE + self.n[live] - step
            before = self.previous[run[is_head]]
            grown[is_head] = _common(flat, place[is_head], np.where(before >= 0, self.end_sample[before] - 1, -1))
            match[new], rank[live, self.n[live] - step] = grown, new
            r[live], length[live], row = new, grown, live
        number = np.cumsum(match < MATCH)
        out = np.where(rank >= 0, number[rank], -1)
        out[np.arange(_STRIDE) + MATCH > self.n[:, None]] = -1
        return out


def _common(flat: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common bytes, at most MATCH, of the suffixes at places a and b of the texts; 0 where b is -1."""
    out = np.zeros(len(a), np.int64)
    todo = np.flatnonzero(b >= 0)
    for i in range(MATCH):
        x = flat[a[todo] + i]
        todo = todo[(x > 0) & (x == flat[b[todo] + i])]
        if not len(todo):
            break
        out[todo] = i + 1
    return out


def _parts(batch: pa.RecordBatch):
    """Slices of a batch, so that a chunk is little larger than CHUNK."""
    return [batch.slice(lo, _PART) for lo in range(0, batch.num_rows, _PART)]


def _shards(batches):
    """(doc_id, start, end) of removed bytes from surroundings sorted by anchor and document."""
    held: list[pa.Table] = []
    rows = 0
    known: tuple[np.ndarray, np.ndarray, list[bytes]] | None = None
    for part in (part for batch in batches for part in _parts(batch)):
        held.append(pa.Table.from_batches([part]))
        rows += part.num_rows
        if rows >= CHUNK:
            table = pa.concat_tables(held)
            key = table.column("anchor").to_numpy()
            cut = int(np.searchsorted(key != key[-1], False)) if key[0] == key[-1] else int(np.flatnonzero(key != key[-1])[-1]) + 1
            cut = cut or len(key)
            out, known = _remove(table.slice(0, cut), known)
            held, rows = [table.slice(cut)], len(key) - cut
            yield from out
    if rows:
        yield from _remove(pa.concat_tables(held), known)[0]


def _remove(table: pa.Table, known):
    """Removed bytes of a chunk, and the surroundings of its last anchor for the next one.

    Documents come in ascending order within an anchor, so what is carried over
    holds the smallest document of every window so far.
    """
    anchor, doc, version, start = (table.column(c).to_numpy() for c in ("anchor", "doc_id", "version", "start"))
    texts = table.column("bytes").to_pylist()
    if known is not None and known[0][0] == anchor[0]:
        carried = len(known[2])
        anchor, doc, texts = np.concatenate([known[0], anchor]), np.concatenate([known[1], doc]), known[2] + texts
        start, version = (np.concatenate([np.full(carried, -1, x.dtype), x]) for x in (start, version))
    index: dict[bytes, int] = {}
    where = np.array([index.setdefault(x, len(index)) for x in texts])
    low = np.full(len(index), np.iinfo(np.int64).max)
    np.minimum.at(low, where, doc)
    # Surroundings that their anchor has in one form only are a class by themselves; the others are indexed.
    forms = np.unique(np.stack([where, anchor]), axis=1) if len(set(where.tolist())) > 1 else np.stack([where[:1], anchor[:1]])
    _, back, number = np.unique(forms[1], return_inverse=True, return_counts=True)
    several = np.unique(forms[0][number[back] > 1])
    listed = list(index)
    size = np.array([len(x) for x in listed])
    got = np.where(np.arange(_STRIDE) + MATCH <= size[:, None], np.arange(len(listed))[:, None], -1)
    if len(several):
        classes = RunLengthIndex([listed[k] for k in several]).classes()
        got[several] = np.where(classes >= 0, classes + len(listed), -1)
    ok = got >= 0
    least = np.full(got.max(initial=0) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, got[ok], np.repeat(low, ok.sum(1)))
    out = []
    for a in range(0, len(where), 1 << 14):
        w, d, v, s = (x[a : a + (1 << 14)] for x in (where, doc, version, start))
        gone = np.zeros((len(w), _STRIDE + 2), np.int8)
        g = got[w]
        gone[:, 1:-1] = (g >= 0) & (least[g] < d[:, None]) & (s >= 0)[:, None]
        edge = np.diff(gone, axis=1)
        r, c = np.nonzero(edge == 1)
        _, e = np.nonzero(edge == -1)
        if len(r):
            out.append(pa.RecordBatch.from_arrays([pa.array(d[r]), pa.array(v[r]), pa.array((s[r] + c).astype(np.int32)), pa.array((s[r] + e - 1 + MATCH).astype(np.int32))], ["doc_id", "version", "start", "end"]))
    keep = np.flatnonzero(anchor == anchor[-1])
    firsts = {}
    for i in keep:
        firsts.setdefault(where[i], i)
    i = np.array(list(firsts.values()))
    return out, (anchor[i], doc[i], [texts[x] for x in i])


def _cut(batches):
    for batch in batches:
        spans = batch.column("spans")
        so = spans.offsets.to_numpy() - spans.offsets[0].as_py()
        values = spans.flatten()
        first, last = values.field("start").to_numpy(), values.field("end").to_numpy()
        size, removed, runs, digest = [], [], [], []
        for i, j, data, offs in slices(batch.column("text")):
            for r in range(i, j):
                b = data[offs[r - i] : offs[r - i + 1]]
                s, e = first[so[r] : so[r + 1]], last[so[r] : so[r + 1]]
                gone = np.cumsum(np.bincount(s, minlength=len(b) + 1) - np.bincount(e, minlength=len(b) + 1))[:-1] > 0
                size.append(len(b))
                removed.append(int(gone.sum()))
                runs.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
                digest.append(hashlib.sha256(b[~gone].tobytes()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def shared_anchors(docs: DataFrame) -> DataFrame:
    """doc_id, version, pos, room, anchor, first: places of anchors that two documents hold.

    first is the smallest document with the same form. Places without a smaller one are
    kept where another form of the anchor agrees on a side.
    """
    by, form = Window.partitionBy("anchor"), Window.partitionBy("anchor", "form").orderBy("doc_id")
    d = docs.mapInArrow(_seeds, _SEED).repartition("anchor").withColumn("first", F.min("doc_id").over(form))
    d = d.withColumns({"low": F.min("doc_id").over(by), "high": F.max("doc_id").over(by), "several": F.min("form").over(by) != F.max("form").over(by)})
    d = d.where("low < high and (first < doc_id or several)")
    for side, shift in (("after", 48), ("before", 32)):
        d = d.withColumn(side, F.expr(f"CAST(shiftrightunsigned(more, {shift}) & 65535 AS INT)"))
        same = Window.partitionBy("anchor", side)
        d = d.withColumn(f"{side}_shared", (F.col(side) != 0) & (F.min("form").over(same) != F.max("form").over(same)))
    d = d.where("first < doc_id or after_shared or before_shared")
    return d.selectExpr("doc_id", "CAST(shiftright(shiftleft(more, 32), 32) AS INT) AS version", "CAST(shiftright(place, 6) AS INT) AS pos", "CAST(place & 63 AS INT) AS room", "anchor", "first")


def removed_spans(docs: DataFrame) -> DataFrame:
    """doc_id, version, start, end: bytes of texts that repeat in a document with a smaller doc_id; spans may overlap."""
    shared = save(shared_anchors(docs), "anchors")
    whole = shared.where(f"first < doc_id and least(pos, {AROUND}) + room >= {MATCH}").selectExpr("doc_id", "version", f"greatest(0, pos - {AROUND}) AS start", "pos + room AS end")
    hits = shared.where("first = doc_id").groupBy("doc_id", "version").agg(F.collect_list(F.struct("pos", "anchor")).alias("hits"))
    around = docs.hint("merge").join(hits.hint("merge"), ["doc_id", "version"]).mapInArrow(_surroundings, "anchor long, doc_id long, version int, start int, bytes binary")
    around = around.repartition("anchor").sortWithinPartitions("anchor", "doc_id")
    return whole.union(around.mapInArrow(_shards, "doc_id long, version int, start int, end int"))


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row per row of docs."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.hash(text).alias("version"), text.alias("text"))
    spans = save(removed_spans(d), "spans")
    spans = spans.groupBy("doc_id", "version").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return d.hint("merge").join(spans.hint("merge"), ["doc_id", "version"], "left").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op4_run_length_index": op4}
ORACLE: dict[str, str] = {}
