"""Circulant MinHash near-duplicates (operator 6).

One bijection of 32-bit words scatters the shingles; a second one, applied after
a circular shift by k, gives coordinate k of the signature. Bands of coordinates
gather candidates, an estimate from the signatures thins them, and a join with
the whole texts confirms every link on full shingle sets. Buckets too large for one
task are compared tile by tile, then block by block between the components left.

Defined results: a null or blank text has an empty set and is its own component;
a text with fewer words than a shingle is one shingle of all its words; rows with
equal sets are one class, compared once; repeated doc_ids count as one document
with either text; other columns are ignored; a null doc_id row is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusguard.llm.common import components, distinct, mix, save, shingles, slices, whole_groups, words

#: All coordinates estimate, four bits of each; the first BANDS * ROWS make the bands.
COORDINATES, ROWS, BANDS = 512, 4, 32
_MASK = (1 << 64) - 1
TILE = 2048
#: Bytes of shingle sets in one part of a block.
ROOM = 32 << 20
SMALL = 24
OUTSIDE = 3
EVERY = 1 << 30
_SIGNATURE = "doc_id long, n_shingles long, class_key binary, sketch binary, bands array<long>"


def signatures(uniq: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Circulant MinHash: rows x COORDINATES minima; every row of offs must have a shingle."""
    x = (mix(uniq) >> np.uint64(32)).astype(np.uint32)
    sig = np.empty((len(offs) - 1, COORDINATES), np.uint32)
    v, t = np.empty_like(x), np.empty_like(x)
    for k in range(COORDINATES):
        np.subtract(x, np.uint32(k), out=v)
        for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
            np.right_shift(v, np.uint32(shift), out=t)
            np.bitwise_xor(v, t, out=v)
            np.multiply(v, np.uint32(factor), out=v)
        np.right_shift(v, np.uint32(16), out=t)
        np.bitwise_xor(v, t, out=v)
        sig[:, k] = np.minimum.reduceat(v, offs[:-1])
    return sig


def _sign(batches):
    for batch in batches:
        ids = batch.column(0)
        for i, j, data, offs in slices(batch.column(1), 1 << 19):
            h, _, woffs = words(data, offs)
            uniq, uo = distinct(*shingles(h, woffs))
            n = np.diff(uo)
            some = np.flatnonzero(n)
            keys, sketch, bands = [b""] * (j - i), [b""] * (j - i), [[]] * (j - i)
            if len(some):
                sig = signatures(uniq, np.concatenate([uo[:-1][some], uo[-1:]]))
                folded = np.zeros((len(some), BANDS), np.uint64)
                for r in range(ROWS):
                    folded = mix(folded + sig[:, r : BANDS * ROWS : ROWS].astype(np.uint64) + np.uint64(1))
                folded = folded.astype(np.int64).tolist()
                low = (sig & np.uint32(15)).astype(np.uint8)
                low = low[:, ::2] << 4 | low[:, 1::2]
                cs = np.cumsum(uniq), np.cumsum(mix(uniq))
                for row, r in enumerate(some):
                    a, b = uo[r], uo[r + 1] - 1
                    keys[r] = b"".join((int(c[b]) - (int(c[a - 1]) if a else 0) & _MASK).to_bytes(8, "little") for c in cs) + int(n[r]).to_bytes(4, "little")
                    sketch[r], bands[r] = low[row].tobytes(), folded[row]
            yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sketch, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "class_key", "sketch", "bands"])


def _tiles(nearest: int):
    """Candidate pairs of the tiles of buckets, sorted by bucket, by estimated similarity.

    With nearest 0, a tile of up to SMALL members gives all its likely pairs and a
    larger one the heaviest spanning forest of them, as only reachability counts.
    Otherwise rows carry component labels, and a larger tile gives the nearest of
    each member in other components.
    """

    def run(batches):
        for table in whole_groups(batches, "bucket"):
            bucket, ids, size = (table.column(c).to_numpy() for c in ("bucket", "doc_id", "n_shingles"))
            label = table.column("component").to_numpy() if nearest else None
            band, marks = table.column("band").to_numpy(), _marks(table)
            packed = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(ids), -1)
            sketch = np.concatenate([packed >> 4, packed & 15], axis=1)
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(ids)]])
            twos = starts[ends - starts == 2] if not nearest else starts[:0]
            agree = ((sketch[twos] == sketch[twos + 1]).sum(1) >= LEAST) & _sizes_allow(size[twos], size[twos + 1])
            met = (marks[twos] == marks[twos + 1]) & (marks[twos] != 0)
            agree &= met.argmax(1) == band[twos]
            found = [(ids[twos][agree], ids[twos + 1][agree])]
            for lo, hi in zip(starts, ends, strict=True):
                if hi - lo > (SMALL if nearest else 2):
                    est = _likely(sketch[lo:hi], size[lo:hi], marks[lo:hi, : band[lo]])
                    if nearest:
                        a, b = _outside(est, label[lo:hi], nearest)
                    else:
                        a, b = np.nonzero(np.triu(est)) if hi - lo <= SMALL else _forest(est)
                    found.append((ids[lo:hi][a], ids[lo:hi][b]))
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    return run


def _sizes_allow(m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can be similar enough at all."""
    return 100 * np.minimum(m, n) >= 75 * np.maximum(m, n)


def _marks(table: pa.Table) -> np.ndarray:
    """members x BANDS: the bucket of each member in each band, 0 where it shares none."""
    lists = table.column("marks").combine_chunks()
    rows = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    out = np.zeros((len(lists), BANDS), np.int32)
    values = lists.flatten()
    out[rows, values.field("band").to_numpy()] = values.field("mark").to_numpy()
    return out


def _likely(s: np.ndarray, size: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    """Agreeing coordinates of each two members of a tile, 0 where they are no likely pair or have met in an earlier band."""
    n = len(s)
    est = np.zeros((n, n), np.uint16)
    step = max(1, (1 << 22) // (n * COORDINATES))
    for a in range(0, n, step):
        est[a : a + step] = (s[a : a + step, None, :] == s[None]).sum(2, dtype=np.uint16)
    np.fill_diagonal(est, 0)
    for m in earlier.T:
        est[(m[:, None] == m) & (m != 0)] = 0
    est[(est < LEAST) | ~_sizes_allow(size[:, None], size)] = 0
    return est


def _forest(est: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The heaviest spanning forest of the likely pairs, grown from the first member of each tree."""
    n = len(est)
    best, via = np.zeros(n, np.int16), np.full(n, -1)
    a, b = [], []
    for _ in range(n):
        j = int(np.argmax(best))
        if best[j] > 0:
            a.append(int(via[j]))
            b.append(j)
        else:
            j = int(np.argmax(best == 0))
        best[j] = -1
        better = (best >= 0) & (est[j] > best)
        best[better], via[better] = est[j][better], j
    return np.array(a, np.int64), np.array(b, np.int64)


def _outside(est: np.ndarray, label: np.ndarray, nearest: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest likely partners of each member that have another label."""
    est = np.where(label[:, None] == label, np.uint16(0), est)
    if nearest >= len(est):
        return np.nonzero(est)
    both = np.argpartition(COORDINATES - est, nearest, axis=1)[:, :nearest]
    a, b = np.repeat(np.arange(len(est)), nearest), both.ravel()
    keep = est[a, b] > 0
    return a[keep], b[keep]


#: Agreeing coordinates of the sketch that make a pair worth its exact check. A pair
#: at 0.75 agrees in 392 of them, by chance in one of 16 where it differs; this is
#: more than four standard deviations fewer, a similarity of 0.66.
LEAST = 350


def _verify(batches):
    for batch in batches:
        n = batch.num_rows
        size = [0, 0]
        keep = np.zeros(n, bool)
        left = list(_sets(batch.column("text_a")))
        for r, right in enumerate(_sets(batch.column("text_b"))):
            size = len(left[r]), len(right)
            left[r], mine = None, left[r]
            common = len(np.intersect1d(mine, right, assume_unique=True))
            keep[r] = common > 0 and 100 * common >= 75 * (size[0] + size[1] - common)
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], ["a", "b"])


def _sets(column):
    for i, j, data, offs in slices(column):
        h, _, woffs = words(data, offs)
        uniq, uo = distinct(*shingles(h, woffs))
        for r in range(j - i):
            yield uniq[uo[r] : uo[r + 1]]


def _shingle_sets(batches):
    for batch in batches:
        sets = pa.array([x.tobytes() for x in _sets(batch.column("text"))], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sets], ["doc_id", "shingles"])


def _differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coordinates in which packed sketches x (rows of 64-bit words) differ from y."""
    d = x ^ y
    d |= d >> np.uint64(1)
    d |= d >> np.uint64(2)
    return np.bitwise_count(d & np.uint64(0x1111111111111111)).sum(1, dtype=np.int64)


def _block_links(batches):
    """Links between the two sides of each block; rows come sorted by block. Every likely
    pair of two components, of two tiles, that shares no bucket of an earlier band is
    checked on its full sets, unless the links found in the block join its ends already."""
    for table in whole_groups(batches, "block"):
        block, ids, part, tile, band = (table.column(c).to_numpy() for c in ("block", "doc_id", "part", "tile", "band"))
        label, own = table.column("component").to_numpy().copy(), table.column("own").to_numpy(zero_copy_only=False)
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(len(ids), -1)
        marks = table.column("marks").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        size = np.array([len(x) for x in sets])
        cuts = np.flatnonzero(np.diff(block)) + 1
        found: list[list[int]] = [[], []]
        for lo, hi in zip(np.append(0, cuts), np.append(cuts, len(ids)), strict=True):
            left = np.arange(lo, hi)
            right = left
            if not own[lo]:
                left, right = left[part[lo:hi] == part[lo:hi].min()], left[part[lo:hi] == part[lo:hi].max()]
                if left[0] == right[0]:
                    continue
            for j in right:
                i = left[(label[left] != label[j]) & (tile[left] != tile[j]) & _sizes_allow(size[left], size[j])]
                if own[lo]:
                    i = i[i < j]
                i = i[~(marks[i, : band[lo]] == marks[j, : band[lo]]).any(1)]
                apart = _differing(sketch[i], sketch[j])
                likely = apart <= COORDINATES - LEAST
                for k in i[likely][np.argsort(apart[likely], kind="stable")]:
                    if label[k] == label[j]:
                        continue
                    common = len(np.intersect1d(sets[k], sets[j], assume_unique=True))
                    if 100 * common >= 75 * (size[k] + size[j] - common):
                        found[0].append(min(ids[k], ids[j]))
                        found[1].append(max(ids[k], ids[j]))
                        inside = label[lo:hi]
                        inside[inside == label[k]] = label[j]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["a", "b"])


def _across(docs: DataFrame, reps: DataFrame, huge: DataFrame, groups: DataFrame) -> DataFrame:
    """The links between the tiles of huge buckets that groups still lacks.

    The largest component of a bucket needs no comparison within itself: it and the
    other members are dealt to parts, and each part of the others meets every part.
    """
    ids = huge.select("doc_id").distinct()
    texts = docs.join(ids.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    sets = texts.mapInArrow(_shingle_sets, "doc_id long, shingles binary")
    marks = F.transform("bands", lambda x: F.hash(x)).alias("marks")
    held = save(reps.select("doc_id", "n_shingles", "sketch", marks).hint("merge").join(sets.hint("merge"), "doc_id"), "sets")
    named = huge.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    named = named.join(held.select("doc_id", "n_shingles"), "doc_id")
    counts = named.groupBy("band", "hash", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size"))
    stats = counts.groupBy("band", "hash").agg(F.max(F.struct("n", "size", "component")).alias("main"), F.sum("n").alias("n"), F.sum("size").alias("size"))
    parts = lambda n, size: F.ceil(F.greatest(n / TILE, 8 * size / ROOM)).cast("long")
    main = F.col("main")
    stats = stats.where(F.col("n") > main["n"]).select("band", "hash", main["component"].alias("largest"), parts(main["n"], main["size"]).alias("mains"), parts(F.col("n") - main["n"], F.col("size") - main["size"]).alias("others"))
    dealt = F.xxhash64("doc_id")
    is_main = F.col("component") == F.col("largest")
    placed = named.drop("n_shingles").join(stats, ["band", "hash"]).withColumn("part", F.when(is_main, F.pmod(dealt, "mains")).otherwise(F.col("mains") + F.pmod(dealt, "others")))
    met = F.sequence(F.when(is_main, F.col("mains")).otherwise(F.lit(0)), F.col("mains") + F.col("others") - 1)
    placed = placed.select("doc_id", "component", F.col("band").cast("byte").alias("band"), "hash", "tile", "part", met.alias("met")).join(held.drop("n_shingles").hint("merge"), "doc_id")
    blocks = placed.withColumn("with", F.explode("met")).withColumn("block", F.xxhash64("band", "hash", F.least("part", "with"), F.greatest("part", "with")))
    blocks = blocks.select("block", "doc_id", "part", "tile", "band", "component", (F.col("part") == F.col("with")).alias("own"), "sketch", "marks", "shingles")
    return blocks.repartition("block").sortWithinPartitions("block", "doc_id").mapInArrow(_block_links, "a long, b long").distinct()


def _candidates(members: DataFrame, nearest: int = 0) -> DataFrame:
    columns = ["bucket", "doc_id", "n_shingles", "sketch", "band", "marks", *(["component"] if nearest else [])]
    return members.select(*columns).repartition("bucket").sortWithinPartitions("bucket", "doc_id").mapInArrow(_tiles(nearest), "a long, b long").distinct()


def _links(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose full shingle sets are similar enough.

    The merge hints keep one plan at every size: texts move by key, never by broadcast.
    """
    needed = pairs.select(F.col("a").alias("doc_id")).distinct().union(pairs.select("b").distinct()).distinct()
    texts = docs.join(needed.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    texts = save(texts, "texts").hint("merge")
    left, right = (texts.select(F.col("doc_id").alias(k), F.col("text").alias(f"text_{k}")) for k in ("a", "b"))
    return pairs.hint("merge").join(left, "a").hint("merge").join(right, "b").mapInArrow(_verify, "a long, b long")


def _joined(groups: DataFrame, found: DataFrame) -> DataFrame:
    """groups with the links found since."""
    return save(components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).where("a <> b").union(found)), "groups")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per document."""
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = save(docs.mapInArrow(_sign, _SIGNATURE), "signatures")
    classes = save(signed.where("n_shingles > 0").groupBy("class_key").agg(F.min("doc_id").alias("rep")), "classes")
    reps = signed.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    rows = reps.select("doc_id", F.posexplode("bands").alias("band", "hash"))
    shared = rows.groupBy("band", "hash").agg(F.count("*").alias("members")).where("members > 1")
    tiled = rows.join(shared, ["band", "hash"]).withColumn("tile", F.pmod(F.xxhash64("doc_id", "band"), F.ceil(F.col("members") / TILE)))
    members = tiled.select("doc_id", F.struct(F.xxhash64("band", "hash", "tile").alias("bucket"), F.col("band").cast("byte").alias("band"), "members").alias("in"))
    members = members.groupBy("doc_id").agg(F.collect_list("in").alias("all")).join(reps.select("doc_id", "n_shingles", "sketch"), "doc_id")
    marks = F.transform("all", lambda x: F.named_struct(F.lit("band"), x["band"], F.lit("mark"), F.hash(x["bucket"])))
    members = save(members.select("doc_id", "n_shingles", "sketch", marks.alias("marks"), F.inline("all")), "members")
    pairs = save(_candidates(members), "pairs")
    links = save(_links(docs, pairs), "links")
    # What large tiles left out: likely pairs whose ends the links so far do not
    # connect; first the nearest of each member, then all that are left.
    large = members.where(F.col("members") > SMALL)
    groups = save(components(links), "groups")
    for nearest in (OUTSIDE, EVERY):
        named = large.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        named = named.withColumn("component", F.coalesce("component", "doc_id"))
        more = save(_candidates(named, nearest).join(pairs, ["a", "b"], "left_anti"), "pairs")
        found = save(_links(docs, more), "links")
        if not found.isEmpty():
            groups = _joined(groups, found)
        pairs = pairs.union(more)
    # What the tiles left out: pairs of one bucket that no tile holds together.
    if not members.where(F.col("members") > TILE).isEmpty():
        found = save(_across(docs, reps, tiled.where(F.col("members") > TILE).select("doc_id", "band", "hash", "tile"), groups), "links")
        if not found.isEmpty():
            groups = _joined(groups, found)
    rep = signed.select("doc_id", "n_shingles", "class_key").join(classes, "class_key", "left")
    out = rep.join(groups.select(F.col("node").alias("rep"), "component"), "rep", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id")).withColumn("kept", F.expr("doc_id = component_id"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents of docs that stand for their group, all columns as they were."""
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("_kept"))
    return docs.join(kept, docs["doc_id"] == kept["_kept"], "left_semi")


QUERIES = {"op6_circulant_minhash": op6}
ORACLE: dict[str, str] = {}
__all__ = ["near_duplicates", "keep_one", "signatures"]
