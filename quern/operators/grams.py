"""Counts of n-grams within rows, and in how many references of a group each of them occurs.

A row's n-grams are counted where the row is and never become rows. They are named by 64-bit hashes. Rows are dealt into
chunks of about CHUNK_BYTES of text; each chunk asks once for each of its different n-grams, sorted and packed, and the
segments of the hash space, one for SEGMENT_BYTES of text, add up the references of all chunks and answer in that order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import text
from quern.operators.joins import small
from quern.session import checkpointed

CHUNK_BYTES, SEGMENT_BYTES = 2 << 20, 4 << 20
_U = np.uint64
_ODD, _STEP = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _STEP
    h = (h ^ (h >> _U(29))) * _ODD
    return h ^ (h >> _U(32))


def _side(texts: pa.Array, salts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, n - 1, key) of all n-grams of texts of space-joined tokens, and each row's number of tokens."""
    import xxhash

    lists = pc.split_pattern(texts, " ")
    row = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy(zero_copy_only=False))
    coded = lists.flatten().dictionary_encode()
    names = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], _U)
    full = np.array([w != "" for w in coded.dictionary.to_pylist()], bool)
    at = coded.indices.to_numpy(zero_copy_only=False)
    if at.size:
        row, at = row[full[at]], at[full[at]]
    tokens = names[at] if at.size else np.zeros(0, _U)
    lengths = np.bincount(row, minlength=len(texts))
    left = np.cumsum(lengths)[row] - np.arange(row.size)  # tokens from here to the row's end
    out, h = [], tokens
    for n in range(1, min(most, row.size) + 1):
        if n > 1:
            h = _mix(h[:-1]) * _ODD + tokens[n - 1:]
        whole = left[: h.size] >= n
        rows = row[: h.size][whole]
        out.append((rows, np.full(rows.size, n - 1), _mix((h[whole] ^ salts[rows]) + _U(n * int(_STEP) % (1 << 64)))))
    cols = [np.concatenate(c) for c in zip(*out, strict=True)] or [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U)]
    return *cols, lengths


def counted(table: pa.Table, most: int) -> dict[str, np.ndarray]:
    """Different n-grams of each row (row, n, key) with their numbers in pred and ref (p, r); lp, lr: tokens of each row."""
    salts = _mix(table["salt"].to_numpy().view(_U))
    sides = [_side(table[c].combine_chunks(), salts, most) for c in ("_p", "_r")]
    row, n, key = (np.concatenate([s[k] for s in sides]) for k in range(3))
    is_pred = np.arange(row.size) < sides[0][0].size
    by = np.lexsort((key, row))
    row, n, key, is_pred = row[by], n[by], key[by], is_pred[by]
    edge = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (key[1:] != key[:-1])])) if row.size else np.zeros(0, np.int64)
    p = np.add.reduceat(is_pred.astype(np.int64), edge) if edge.size else edge
    return {"row": row[edge], "n": n[edge], "key": key[edge], "p": p, "r": np.diff(np.append(edge, row.size)) - p, "lp": sides[0][3], "lr": sides[1][3]}


def packed(keys: np.ndarray) -> bytes:
    """Sorted keys by their distances, in as many bytes each as the largest needs; the first byte tells how many."""
    apart = np.diff(keys, prepend=_U(0)).astype("<u8")
    width = max(1, (int(apart.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + apart.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    wide = np.zeros(((len(data) - 1) // data[0], 8), np.uint8)
    wide[:, :data[0]] = np.frombuffer(data, np.uint8, offset=1).reshape(-1, data[0])
    return np.cumsum(wide.view("<u8").ravel(), dtype=_U)


def scored(pairs: DataFrame, by: str | None, most: int, chunk_bytes: int = CHUNK_BYTES, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Per row: by, id, cider, lp and lr (tokens), and lists over n of hit (clipped matches) and tf (n-grams of pred)."""
    joined = lambda c: F.array_join(text.metric_tokens(F.col(c)), " ")
    keys = [by] if by else []
    rows = pairs.select("id", *keys, joined("pred").alias("_p"), joined("ref").alias("_r"), (F.xxhash64(F.col(by).cast("string")) if by else F.lit(0).cast("long")).alias("salt"))
    rows = checkpointed(rows)
    volume = rows.agg(F.coalesce(F.sum(F.octet_length("_p") + F.octet_length("_r")), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    chunks = max(1, -(-volume["b"] // chunk_bytes))
    log2 = max(0, int(volume["b"] // segment_bytes).bit_length())
    if by:
        rows = rows.join(small(rows.groupBy(by).agg(F.count(F.lit(1)).alias("_N"))), by)
    else:
        rows = rows.withColumn("_N", F.lit(volume["n"]).cast("long"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)))

    def ask(table: pa.Table) -> pa.Table:
        got = counted(table, most)
        keys, of = np.unique(got["key"], return_inverse=True)
        docs = np.bincount(of, weights=got["r"] > 0, minlength=keys.size).astype("<u4")
        cuts = np.searchsorted(keys >> _U(64 - log2), np.arange((1 << log2) + 1, dtype=_U)) if log2 else np.array([0, keys.size])
        some = np.flatnonzero(np.diff(cuts))
        cut = lambda a, pack: pa.array([pack(a[cuts[s]:cuts[s + 1]]) for s in some], pa.binary())
        return pa.table({"segment": pa.array(some, pa.int32()), "chunk": pa.array([table["chunk"][0].as_py()] * some.size, pa.int64()), "keys": cut(keys, packed), "docs": cut(docs, bytes)})

    def answer(table: pa.Table) -> pa.Table:
        asked = [unpacked(k) for k in table["keys"].to_pylist()]
        keys, of = np.unique(np.concatenate(asked), return_inverse=True)
        df = np.bincount(of, weights=np.concatenate([np.frombuffer(d, "<u4") for d in table["docs"].to_pylist()]), minlength=keys.size).astype("<u4")[of]
        ends = np.cumsum([a.size for a in asked])
        return pa.table({"segment": table["segment"], "chunk": table["chunk"], "df": pa.array([df[e - a.size:e].tobytes() for e, a in zip(ends, asked, strict=True)], pa.binary())})

    def finish(table: pa.Table, told: pa.Table) -> pa.Table:
        got = counted(table, most)
        _, of = np.unique(got["key"], return_inverse=True)
        df = np.frombuffer(b"".join(d for _, d in sorted(zip(told["segment"].to_pylist(), told["df"].to_pylist(), strict=True))), "<u4")[of]
        idf = np.log((table["_N"].to_numpy()[got["row"]] + 1) / (df + 1.0))
        a, b = got["p"] * idf, got["r"] * idf
        place, size = got["row"] * most + got["n"], table.num_rows * most
        total = lambda w: np.bincount(place, weights=w, minlength=size)
        part = total(a * b) / ((np.sqrt(total(a * a)) + 1e-10) * (np.sqrt(total(b * b)) + 1e-10))
        lists = lambda w: pa.array(total(w).astype(np.int64).reshape(-1, most).tolist(), pa.list_(pa.int64()))
        own = [table[k] for k in ("id", *keys)]
        made = [pa.array(part.reshape(-1, most).sum(axis=1) / most * 10), pa.array(got["lp"], pa.int64()), pa.array(got["lr"], pa.int64()), lists(np.minimum(got["p"], got["r"])), lists(got["p"])]
        return pa.table([*own, *made], names=["id", *keys, "cider", "lp", "lr", "hit", "tf"])

    asked = rows.select("chunk", "_p", "_r", "salt").groupBy("chunk").applyInArrow(ask, "segment int, chunk long, keys binary, docs binary")
    answers = asked.groupBy("segment").applyInArrow(answer, "segment int, chunk long, df binary")
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in ("id", *keys))
    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, f"{kinds}, cider double, lp long, lr long, hit array<long>, tf array<long>")
