"""Seeded shuffles of all predictions against the references, without moving a text once for each shuffle.

The rows are numbered by id. In shuffle k the prediction whose md5 of "seed|k|id" comes n-th meets the n-th reference.
Chunks of predictions send their ids, sorted and packed, to the buckets of the md5's first bits; a bucket ranks what it
gets and answers with ranks. Then each chunk meets each block of references once, with the list of its pairs in it: a
text is moved once for each block (or chunk) of the other side, whatever the number of shuffles. Ids must be integers.
"""

from __future__ import annotations

import hashlib
import math
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.grams import packed, unpacked

CHUNK_BYTES, BLOCK_BYTES, BUCKET_ROWS = 16 << 20, 16 << 20, 1 << 20
_SIGN = np.uint64(1 << 63)


def draws(ids: list[int], k: int, seed: int) -> np.ndarray:
    """The md5 of each id in shuffle k as two numbers, the high one first."""
    return np.frombuffer(b"".join(hashlib.md5(f"{seed}|{k}|{i}".encode()).digest() for i in ids), ">u8").reshape(-1, 2).astype(np.uint64)


def mean_overlaps(rows: DataFrame, shuffles: int, seed: int, chunk_bytes: int = CHUNK_BYTES, block_bytes: int = BLOCK_BYTES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """rows (id, row_id in the order of id from 0, p and r: different tokens joined by spaces) -> (k, s), the mean share
    of a prediction's tokens that its reference in shuffle k has. rows should be checkpointed."""
    length = lambda c: F.coalesce(F.sum(F.octet_length(c)), F.lit(0)).alias(c)
    volume = rows.agg(F.count(F.lit(1)).alias("n"), length("p"), length("r")).first()
    n = volume["n"]
    per_chunk, per_block = (max(1, n * most // max(1, volume[c])) for c, most in (("p", chunk_bytes), ("r", block_bytes)))
    chunks, blocks = -(-n // per_chunk), -(-n // per_block)
    log2 = max(0, math.ceil(math.log2(max(1, n * shuffles) / bucket_rows)))
    of_chunk = F.expr(f"row_id div {per_chunk}").cast("int").alias("chunk")
    of_block = F.expr(f"row_id div {per_block}").cast("int").alias("block")

    def buckets(ids: list[int], k: int) -> np.ndarray:
        high = draws(ids, k, seed)[:, 0]
        return (high >> np.uint64(64 - log2)).astype(np.int64) if log2 else np.zeros(len(ids), np.int64)

    def ask(table: pa.Table) -> pa.Table:
        table = table.sort_by("row_id")
        ids, sent = table["id"].to_pylist(), [[] for _ in range(1 << log2)]
        keys = table["id"].to_numpy().view(np.uint64) ^ _SIGN
        for k in range(1, shuffles + 1):
            bucket = buckets(ids, k)
            by = np.argsort(bucket, kind="stable")
            for b, own in enumerate(np.split(by, np.searchsorted(bucket[by], np.arange(1, 1 << log2)))):
                sent[b].append(packed(keys[own]))
        return pa.table({"bucket": pa.array(range(1 << log2), pa.int32()), "chunk": pa.array([table["chunk"][0].as_py()] * (1 << log2), pa.int32()), "ids": pa.array(sent, pa.list_(pa.binary()))})

    def rank(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        sent, told, counts = table["ids"].to_pylist(), [[] for _ in range(table.num_rows)], []
        for k in range(1, shuffles + 1):
            parts = [unpacked(s[k - 1]) for s in sent]
            ids = (np.concatenate(parts) ^ _SIGN).view(np.int64)
            drawn = draws(ids.tolist(), k, seed)
            place = np.empty(ids.size, "<u4")
            place[np.lexsort((drawn[:, 1], drawn[:, 0]))] = np.arange(ids.size)  # stable: equal ids stay in the order of rows
            counts.append(ids.size)
            for out, part in zip(told, np.split(place, np.cumsum([p.size for p in parts])[:-1]), strict=True):
                out.append(part.tobytes())
        return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "ranks": pa.array(told, pa.list_(pa.binary())), "counts": pa.array([counts] * table.num_rows, pa.list_(pa.int64()))})

    def meet(table: pa.Table, told: pa.Table) -> pa.Table:
        table, told = table.sort_by("row_id"), told.sort_by("bucket")
        ids, ranks = table["id"].to_pylist(), told["ranks"].to_pylist()
        counts = np.array(told["counts"].to_pylist(), np.int64).reshape(-1, shuffles)
        before = np.cumsum(counts, axis=0) - counts
        to = np.empty((len(ids), shuffles), np.int64)
        for k in range(1, shuffles + 1):
            bucket = buckets(ids, k)
            by = np.argsort(bucket, kind="stable")
            to[by, k - 1] = np.frombuffer(b"".join(r[k - 1] for r in ranks), "<u4") + before[bucket[by], k - 1]
        at, k = (a.ravel() for a in np.indices(to.shape))
        block, place = np.divmod(to.ravel(), per_block)
        by = np.argsort(block, kind="stable")
        some, cuts = np.unique(block[by], return_index=True)
        cut = lambda a, kind: pa.array([x.tobytes() for x in np.split(a[by].astype(kind), cuts[1:])], pa.binary())
        return pa.table({"chunk": pa.array([table["chunk"][0].as_py()] * some.size, pa.int32()), "block": pa.array(some, pa.int32()), "at": cut(at, "<u4"), "k": cut(k, "<u2"), "place": cut(place, "<u4")})

    def overlaps(left: pa.Table, right: pa.Table) -> pa.Table:
        left, is_list = left.sort_by("row_id"), pc.is_valid(right["at"])
        pairs, refs = right.filter(is_list), right.filter(pc.invert(is_list)).sort_by("ref_row")
        at, k, place = (np.frombuffer(b"".join(pairs[c].to_pylist()), kind).tolist() for c, kind in (("at", "<u4"), ("k", "<u2"), ("place", "<u4")))
        words = [tuple(map(sys.intern, r.split())) for r in refs["r"].to_pylist()]
        preds, now, own = left["p"].to_pylist(), -1, set()
        sums = [0.0] * shuffles
        for a, j, to in zip(at, k, place, strict=True):
            if a != now:
                now, own = a, set(preds[a].split())
            if own:
                sums[j] += len(own.intersection(words[to])) / len(own)
        return pa.table({"k": pa.array(range(1, shuffles + 1), pa.int32()), "s": pa.array(sums, pa.float64()), "c": pa.array(np.bincount(k, minlength=shuffles) if k else [0] * shuffles, pa.int64())})

    ids = rows.select(of_chunk, F.col("id").cast("long").alias("id"), "row_id")
    asked = ids.groupBy("chunk").applyInArrow(ask, "bucket int, chunk int, ids array<binary>")
    ranks = asked.groupBy("bucket").applyInArrow(rank, "chunk int, bucket int, ranks array<binary>, counts array<long>")
    met = ids.groupBy("chunk").cogroup(ranks.groupBy("chunk")).applyInArrow(meet, "chunk int, block int, at binary, k binary, place binary")
    all_of = lambda many, name: F.explode(F.sequence(F.lit(0), F.lit(max(0, many - 1)))).alias(name)
    preds = rows.select(of_chunk, all_of(blocks, "block"), "row_id", "p")
    refs = rows.select(all_of(chunks, "chunk"), of_block, F.col("row_id").alias("ref_row"), "r").unionByName(met, allowMissingColumns=True)
    parts = preds.groupBy("chunk", "block").cogroup(refs.groupBy("chunk", "block")).applyInArrow(overlaps, "k int, s double, c long")
    return parts.groupBy("k").agg((F.sum("s") / F.sum("c")).alias("s"))
