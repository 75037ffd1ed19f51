"""MinHash near-dedup with circulant permutations, banding and exact Jaccard verification.

Sets are the distinct SHINGLE-word shingles of a text (a shorter text's whole word sequence is one). A signature has
COORDS coordinates, all made from two permutations of the 32-bit universe: the first is applied once, the second is
read at COORDS circular shifts. Coordinates are banded by ROWS, and texts that share a band are candidates: at a
similarity of 0.75 a pair misses all 32 bands of 4 with probability 5e-6, at 0.8 with 5e-8.

Equal sets form a class first, and classes stand for their members. Candidates are never expanded into all pairs:
1. Star rounds: each bucket (band and value) has a pivot; each text is compared with one pivot of its buckets, on the
   full sets; confirmed links are united; other pivots follow in the next round for buckets still in several
   components. A pivot's members are compared in slices, in a stream that holds one set besides the pivot's.
2. The rest, exactly: texts joined by buckets still in several components form clusters. All members of a cluster that
   are in different components are compared on their full sets in blocks of BLOCK by BLOCK, as bit sets; or, where that
   makes fewer pairs (a chain of many small buckets), those of each of its buckets. Only confirmed links leave a task,
   at most one for each component.
   So a link is lost only where its two texts are already in one component.

Joins that a large class, bucket or cluster would draw into one task are made by joined_back, which deals its rows evenly.

Null text is empty; an empty set is linked with nothing. Rows that share an id count as one document, whose links are
united. A row with a null id is linked with nothing, has no component and is kept. Ids must be integers. Extra columns
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, joined_back, read_table, stored

SHINGLE, COORDS, ROWS = 5, 128, 4
NUMERATOR, DENOMINATOR = 75, 100
STAR_ROUNDS = 1
BLOCK, VOCABULARY = 512, 1 << 15
SLICES = 64
_U64, _U32 = np.uint64, np.uint32


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U64(31))) * _U64(0x9E3779B97F4A7C15)
    return h ^ (h >> _U64(29))


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    h = word_hashes(text)
    if not h.size:
        return h
    n = min(k, h.size)
    out = np.full(h.size - n + 1, n, np.uint64)
    for i in range(n):
        out = _mix64(out * _U64(0xD6E8FEB86659FD93) + h[i:h.size - n + 1 + i])
    return np.unique(out)


def _sigma(x: np.ndarray) -> np.ndarray:
    """First permutation of 0 .. 2**32 - 1."""
    x = (x ^ (x >> _U32(15))) * _U32(0x2C1B3C6D)
    x = (x ^ (x >> _U32(12))) * _U32(0x297A2D39)
    return x ^ (x >> _U32(15))


def _pi(x: np.ndarray) -> np.ndarray:
    """Second permutation of 0 .. 2**32 - 1; works in place."""
    x ^= x >> _U32(16)
    x *= _U32(0x85EBCA6B)
    x ^= x >> _U32(13)
    x *= _U32(0xC2B2AE35)
    x ^= x >> _U32(16)
    return x


def signature(items: np.ndarray, coords: int = COORDS) -> np.ndarray:
    """Coordinate k is the least pi(sigma(v) + k mod 2**32) over the set."""
    moved = _sigma((items ^ (items >> _U64(32))).astype(np.uint32))
    shifts, out = np.arange(coords, dtype=np.uint32)[:, None], np.full(coords, 0xFFFFFFFF, np.uint32)
    for i in range(0, moved.size, 1024):
        out = np.minimum(out, _pi(moved[None, i:i + 1024] + shifts).min(axis=1))
    return out


def band_keys(signatures: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """(n, coords) uint32 -> (n, bands) int64 keys that also tell the bands apart."""
    n, coords = signatures.shape
    s = signatures.reshape(n, coords // rows, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, coords // rows + 1, dtype=np.uint64), s.shape[:2]) * _U64(0xA0761D6478BD642F)
    for r in range(rows):
        key = _mix64(key * _U64(0xD6E8FEB86659FD93) + s[:, :, r])
    return key.view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> bool:
    """Exact: denominator * |a & b| >= numerator * |a | b| for sorted distinct arrays."""
    low, high = sorted((a.size, b.size))
    if denominator * low < numerator * high:
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, b.size - 1)] == a).sum())
    return denominator * both >= numerator * (a.size + b.size - both)


def _sets(batches: Iterator[pa.RecordBatch], shingle: int, coords: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Per text the size of its set, a digest that names it, and its band keys (the signature itself is not kept)."""
    import xxhash

    for batch in batches:
        sizes, digests, bands = [], [], []
        for text in batch.column("_text").to_pylist():
            s = shingles(text, shingle)
            sizes.append(s.size)
            digests.append(xxhash.xxh3_128_digest(s.tobytes()) if s.size else None)
            bands.append(band_keys(signature(s, coords)[None, :], rows).tobytes() if s.size else None)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.binary())], ["id", "n", "digest", "bands"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keys = np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.int64).reshape(batch.num_rows, -1)
            ids = np.repeat(batch.column("id").to_numpy(zero_copy_only=False), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel(), pa.int64()), pa.array(ids, pa.int64())], ["band", "id"])


def _verified(texts: DataFrame, pairs: DataFrame, shingle: int, numerator: int, denominator: int) -> DataFrame:
    """Of pairs (id, head), those whose full sets are similar. texts: (id, _text), ids may repeat."""
    slices = F.lit(SLICES)
    members = pairs.select("id", "head", F.pmod(F.xxhash64("id"), slices).cast("int").alias("slice"), F.lit(1).alias("kind"))
    pivots = members.select(F.col("head").alias("id"), "head", "slice", F.lit(0).alias("kind")).distinct()
    dealt = texts.join(members.unionByName(pivots), "id").repartition("head", "slice").sortWithinPartitions("head", "slice", "kind", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pivot = None, []
        for batch in batches:
            out: list[tuple[int, int]] = []
            for i, head, part, kind, text in zip(*(batch.column(c).to_pylist() for c in ("id", "head", "slice", "kind", "_text")), strict=True):
                s = shingles(text, shingle)
                if (head, part) != at:
                    at, pivot = (head, part), []
                if kind == 0:
                    pivot.append(s)
                elif s.size and any(p.size and similar(s, p, numerator, denominator) for p in pivot):
                    out.append((i, head))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["id", "head"])

    return dealt.select("id", "head", "slice", "kind", "_text").mapInArrow(run, "id long, head long")


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) for the ids in edges (id, head): comp is the smallest id reachable.

    Every id points to its smallest neighbour or itself, pointers are followed twice, and the edges are contracted to
    the ids pointed to; what is left shrinks from round to round until no edge is.
    """
    left = checkpointed(edges.filter("id <> head").select(F.greatest("id", "head").alias("a"), F.least("id", "head").alias("b")).distinct())
    label = None
    while True:
        point = left.select(F.col("a").alias("id"), F.col("b").alias("low")).union(left.select("b", "b")).groupBy("id").agg(F.min("low").alias("low"))
        for _ in range(2):
            point = point.join(point.select(F.col("id").alias("_to"), F.col("low").alias("_low")), F.col("low") == F.col("_to")).select("id", F.col("_low").alias("low"))
        point = checkpointed(point)
        to = point.select(F.col("id").alias("_to"), F.col("low").alias("_low"))
        if label is None:
            label = point.withColumnRenamed("low", "comp")
        else:
            label = checkpointed(label.join(to, F.col("comp") == F.col("_to"), "left").select("id", F.coalesce("_low", "comp").alias("comp")))
        moved = left.join(to, F.col("a") == F.col("_to")).select(F.col("_low").alias("p"), "b").join(to, F.col("b") == F.col("_to")).select("p", F.col("_low").alias("q"))
        left = checkpointed(moved.filter("p <> q").select(F.greatest("p", "q").alias("a"), F.least("p", "q").alias("b")).distinct())
        if not left.limit(1).count():
            return label


def overlaps(left: list[np.ndarray], right: list[np.ndarray], width: int = VOCABULARY) -> np.ndarray:
    """Sizes of the intersections of all left with all right sets: bit sets over the items that two sets or more hold,
    width items at a time."""
    every = left + right
    items = np.concatenate(every) if every else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(every)), [x.size for x in every])
    known, back, times = np.unique(items, return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1
    shared = times[back] > 1
    owner, at = owner[shared], number[back][shared]
    out = np.zeros((len(left), len(right)), np.int32)
    for begin in range(0, int(number[-1]) + 1 if number.size else 0, width):
        here = (at >= begin) & (at < begin + width)
        bits = np.zeros((len(every), width), bool)
        bits[owner[here], at[here] - begin] = True
        packed = np.packbits(bits, axis=1).view(np.uint64)
        for i in range(len(left)):
            out[i] += np.bitwise_count(packed[i] & packed[len(left):]).sum(axis=1, dtype=np.int32)
    return out


def _cross_links(rows: DataFrame, block: int, shingle: int, numerator: int, denominator: int) -> DataFrame:
    """rows (kind, group, n, id, comp, _text), n the group's rows: confirmed links (id, head) that unite its components.

    A group of k blocks goes to its block pairs (i, j), i <= j, so every pair of its members meets once; all pairs
    of a block pair are measured on their full sets, and only links that unite something leave the task.
    """
    cut = rows.withColumn("_k", F.ceil(F.col("n") / block).cast("int")).withColumn("_c", F.pmod(F.xxhash64("id"), F.col("_k")).cast("int"))
    others = cut.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    placed = others.select("kind", "group", F.least("_c", "_o").alias("i"), F.greatest("_c", "_o").alias("j"), "_c", "id", "comp", "_text")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        i, j = key[2].as_py(), key[3].as_py()
        own, ids, comps = (table[c].to_numpy() for c in ("_c", "id", "comp"))
        sets = [shingles(t, shingle) for t in table["_text"].to_pylist()]
        sizes, lead = np.array([x.size for x in sets]), {}

        def top(c: int) -> int:
            while lead.get(c, c) != c:
                c = lead[c]
            return c

        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        both = overlaps([sets[x] for x in left], [sets[x] for x in right])
        union = sizes[left][:, None] + sizes[right][None, :] - both
        linked = (denominator * both >= numerator * union) & (union > 0) & (comps[left][:, None] != comps[right][None, :])
        a, b = [], []
        for x, y in np.argwhere(linked):
            x, y = left[x], right[y]
            p, q = top(int(comps[x])), top(int(comps[y]))
            if p != q:
                lead[max(p, q)] = min(p, q)
                a.append(max(ids[x], ids[y]))
                b.append(min(ids[x], ids[y]))
        return pa.table({"id": pa.array(a, pa.int64()), "head": pa.array(b, pa.int64())})

    return placed.groupBy("kind", "group", "i", "j").applyInArrow(compare, "id long, head long")


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    coords: int = COORDS,
    rows: int = ROWS,
    numerator: int = NUMERATOR,
    denominator: int = DENOMINATOR,
    star_rounds: int = STAR_ROUNDS,
) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("_text"))
    every = stored(texts.mapInArrow(lambda it: _sets(it, shingle, coords, rows), "id long, n long, digest binary, bands binary"))
    sets = every.filter("n > 0 AND id IS NOT NULL")
    classes = checkpointed(sets.groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("k")))
    member = checkpointed(joined_back(sets.select("id", "digest"), classes, ["digest"], "k", "id").select("id", "rep").distinct())
    # sets of one id that fall in different classes are united through the id
    same_id = member.groupBy("id").agg(F.min("rep").alias("head"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    nodes = sets.join(classes, (sets.digest == classes.digest) & (sets.id == classes.rep)).select(sets.id, "bands").dropDuplicates(["id", "bands"])
    bands = nodes.mapInArrow(_bands, "band long, id long")
    full = checkpointed(bands.groupBy("band").agg(F.min("id").alias("head"), F.max("id").alias("_last"), F.count(F.lit(1)).alias("k")).filter("head <> _last"))
    buckets = checkpointed(joined_back(bands, full, ["band"], "k", "id").filter("head IS NOT NULL").select("band", "id", "head"))
    involved = buckets.select("id").distinct()
    held = stored(texts.join(involved, "id", "left_semi"))
    # one candidate per text and round: the smallest pivot among its buckets
    pairs = buckets.filter("id <> head").groupBy("id").agg(F.min("head").alias("head"))
    links = checkpointed(_verified(held, pairs, shingle, numerator, denominator))
    tried = 1
    while True:
        label = components(links)
        here = buckets.join(label, "id", "left").select("band", "id", F.coalesce("comp", "id").alias("comp"))
        # components of a bucket, not rows, decide whether it is still open
        open_bands = here.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("band")
        still = checkpointed(here.join(open_bands, "band"))
        if tried >= star_rounds or not still.limit(1).count():
            break
        draw = F.xxhash64(F.lit(tried), F.col("comp"))
        pivot = still.groupBy("band").agg(F.min(F.struct(draw.alias("d"), F.col("comp"), F.col("id"))).alias("p")).select("band", F.col("p.id").alias("head"), F.col("p.comp").alias("head_comp"))
        pairs = still.join(pivot, "band").filter("comp <> head_comp").groupBy("id").agg(F.min("head").alias("head"))
        links = checkpointed(links.unionByName(_verified(held, pairs, shingle, numerator, denominator)))
        tried += 1
    if still.limit(1).count():
        # texts joined by open buckets form clusters; each text is sent once to each block pair of its groups
        heads = still.groupBy("band").agg(F.min("id").alias("head"))
        cluster = components(checkpointed(still.select("band", "id").join(heads, "band").select("id", "head").distinct())).withColumnRenamed("comp", "cluster")
        placed = checkpointed(still.select("band", "id", "comp").distinct().join(cluster, "id"))
        together = placed.select("cluster", "id").distinct().groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
        apart = placed.groupBy("cluster", "band").agg(F.count(F.lit(1)).cast("double").alias("b")).groupBy("cluster").agg(F.sum(F.col("b") * F.col("b")).alias("pairs"))
        fewer = checkpointed(together.join(apart, "cluster").select("cluster", "n", (F.col("pairs") < F.col("n").cast("double") * F.col("n")).alias("kind")))
        told = joined_back(placed, fewer, ["cluster"], "n", "id").select("kind", F.when(F.col("kind"), F.col("band")).otherwise(F.col("cluster")).alias("group"), "id", "comp").distinct()
        sizes = checkpointed(told.groupBy("kind", "group").agg(F.count(F.lit(1)).alias("n")))
        members = joined_back(told, sizes, ["kind", "group"], "n", "id").join(held, "id")
        more = _cross_links(members, BLOCK, shingle, numerator, denominator)
        label = components(checkpointed(links.unionByName(more)))
    united = checkpointed(same_id.select("id", "head"))
    if united.limit(1).count():
        across = member.join(united, "id").select(F.col("rep").alias("id"), "head").union(united)
        label = components(checkpointed(label.select("id", F.col("comp").alias("head")).unionByName(across)))
    placed = joined_back(every.select("id", "n", "digest"), classes, ["digest"], "k", "id").select("id", "n", F.coalesce("rep", "id").alias("rep"))
    # a class's representative is in label once, its members meet it by joined_back as well
    found = checkpointed(label.join(classes.select(F.col("rep").alias("id"), "k").groupBy("id").agg(F.sum("k").alias("k")), "id"))
    out = joined_back(placed, found.withColumnRenamed("id", "rep"), ["rep"], "k", "id")
    known = F.col("id").isNotNull()
    comp = F.when(known, F.coalesce("comp", "rep"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), comp.alias("component_id"), (~known | F.col("id").eqNullSafe(comp)).alias("kept"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op5_minhash_near_dedup": op5_minhash_near_dedup}
ORACLE_SQL: dict[str, str] = {}
