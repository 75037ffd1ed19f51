"""Nearest rows by cosine, for a stated query set against all rows, by an index of pivots.

The index is fitted on PIVOTS rows drawn by the hash of their ids. Every row is filed under its nearest pivot and the
ring its angle to the pivot falls in, and written once in that order. Angles are distances on the sphere: a row in the
ring from lo to hi of pivot p is at least max(angle(q, p) - hi, lo - angle(q, p)) away from a query q. A ring in which no
row can be as near as what q has found is passed over, so the result is that of comparing all pairs, whatever the data;
only the work shrinks, and not at all where vectors have no neighbourhoods.

Queries go to the tasks in blocks of at most BLOCK_BYTES, one block and one pass over the index at a time, and rows stay
where they are. A task sends on one row for each query that found something at least as near as the nearest pivot.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import checkpointed

PIVOTS, RINGS = 256, 64
BLOCK_BYTES = 64 << 20
#: Rows and queries that are compared at a time.
TILE_ROWS, TILE_QUERIES = 512, 2048
#: Similarities are rounded to so many digits, and equal ones are settled by the smaller id.
DIGITS = 9


def _units(vectors: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of length one; those without length stay zero, and are similar to nothing."""
    m = np.array(vectors.to_pylist(), dtype=float)
    m = m.reshape(len(vectors), m.size // max(1, len(vectors)))
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


@dataclass
class Index:
    """rows: id, label, v, pivot (-1: without length) and ring, in the order of pivot and ring."""

    rows: DataFrame
    pivots: np.ndarray
    pivot_ids: list
    pivot_labels: list
    compared: Accumulator


def build(rows: DataFrame, id_col: str, label_col: str, vector_col: str) -> Index:
    sc = rows.sparkSession.sparkContext
    named = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")).filter("v IS NOT NULL")
    drawn = named.filter(F.exists("v", lambda x: x != 0)).orderBy(F.xxhash64("id"), "id").limit(PIVOTS).collect()
    pivots = _units(pa.array([r["v"] for r in drawn], pa.list_(pa.float64()))) if drawn else np.zeros((0, 0))
    shared = sc.broadcast(pivots)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pivot, ring = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows, np.int32)
            if len(shared.value) and batch.num_rows:
                m = _units(batch.column("v"))
                near = m @ shared.value.T
                long = m.any(axis=1)
                pivot[long] = near[long].argmax(axis=1)
                ring[long] = np.minimum(_angles(near[long].max(axis=1)) * (RINGS / np.pi), RINGS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot), pa.array(ring)], [*batch.schema.names, "pivot", "ring"])

    kinds = {f.name: f.dataType.simpleString() for f in named.schema}
    filed = named.mapInArrow(file, f"id {kinds['id']}, label {kinds['label']}, v {kinds['v']}, pivot int, ring int")
    order = ["pivot", "ring", F.xxhash64("id")]  # a hot vector's rows are dealt by their ids
    return Index(checkpointed(filed.repartitionByRange(*order).sortWithinPartitions("pivot", "ring")), pivots, [r["id"] for r in drawn], [r["label"] for r in drawn], sc.accumulator(0))


class _Search:
    """What one task knows of a block of queries: the best row of each so far."""

    def __init__(self, index_pivots: np.ndarray, pivot_ids: list, pivot_labels: list, queries: dict, own: bool) -> None:
        self.own, self.units, self.ids, self.labels = own, queries["units"], queries["ids"], queries["labels"]
        self.at: dict = {}
        for i, q in enumerate(self.ids):
            self.at.setdefault(q, []).append(i)
        self.codes = {label: i for i, label in enumerate(dict.fromkeys(x for x in self.labels if x is not None))}
        self.label_codes = np.array([self.codes.get(x, -3) for x in self.labels])
        self.compared = 0
        self.best, self.found = np.full(len(self.ids), -2.0), [None] * len(self.ids)
        self.angles = np.zeros((len(self.ids), len(index_pivots)))
        for a in range(0, len(self.ids) if len(index_pivots) else 0, TILE_QUERIES):
            part = slice(a, a + TILE_QUERIES)
            near = self.units[part] @ index_pivots.T
            self.angles[part] = _angles(near)
            # pivots are rows too: what a query finds is no farther than the nearest of them
            self.best[part] = self._allowed(np.round(near, DIGITS), part, pivot_ids, pivot_labels).max(axis=1, initial=-2.0)
        self.free = ~self.units.any(axis=1)  # angles say nothing of queries without length

    def _allowed(self, sims: np.ndarray, part: slice, ids: list, labels: list) -> np.ndarray:
        """Similarities, -2 for the query's own id and for labels that do not count. A null label is like no other."""
        other = np.array([self.codes.get(x, -1) if x is not None else -2 for x in labels])
        same = self.label_codes[part, None] == other[None]
        sims = np.where(same == self.own, sims, -2.0)
        low, high = part.start, part.start + len(sims)
        for j, i in ((j, i) for j, x in enumerate(ids) for i in self.at.get(x, ()) if low <= i < high):
            sims[i - low, j] = -2.0
        return sims

    def look(self, pivot: int, ring: int, ids: list, labels: list, rows: np.ndarray) -> None:
        """Compare rows of one ring, in the order of their ids, with the queries that may find something in it."""
        if pivot < 0:
            open_ = self.best <= 0
        else:
            low, high = ring * np.pi / RINGS, (ring + 1) * np.pi / RINGS
            apart = np.maximum(np.maximum(self.angles[:, pivot] - high, low - self.angles[:, pivot]), 0)
            open_ = np.cos(apart) >= self.best - 10.0 ** (1 - DIGITS)
        at = np.flatnonzero(open_ | self.free)
        self.compared += len(at) * len(rows)
        for a in range(0, len(at), TILE_QUERIES):
            some = at[a : a + TILE_QUERIES]
            part = slice(int(some[0]), int(some[-1]) + 1)
            sims = np.full((part.stop - part.start, len(rows)), -2.0)
            sims[some - part.start] = np.round(self.units[some] @ rows.T, DIGITS)
            sims = self._allowed(sims, part, ids, labels)[some - part.start]
            first = sims.argmax(axis=1)
            top = sims[np.arange(len(some)), first]
            for q, j, s in zip(*(x[top >= np.maximum(self.best[some], -1.5)] for x in (some, first, top)), strict=True):
                if s > self.best[q] or self.found[q] is None or ids[j] < self.found[q]:
                    self.best[q], self.found[q] = s, ids[j]


def _search(index: Index, queries: DataFrame, own: bool) -> DataFrame:
    """(id, nearest, similarity) over all blocks; own: among the rows with the query's label, else among the others."""
    spark = queries.sparkSession
    width = max(1, index.pivots.shape[1])
    blocks = max(1, -(-queries.count() * width * 8 // BLOCK_BYTES))
    dealt = queries.withColumn("_block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    kind = index.rows.schema["id"].dataType.simpleString()
    out = None
    for block in range(blocks):
        # BLOCK_BYTES of vectors, a bound that holds whatever the tables' size
        told = dealt.filter(F.col("_block") == block).select("id", "label", "v").toArrow()
        held = {"units": _units(told["v"]), "ids": told["id"].to_pylist(), "labels": told["label"].to_pylist()}
        shared = spark.sparkContext.broadcast((index.pivots, index.pivot_ids, index.pivot_labels, held, own))
        compared = index.compared

        def run(batches: Iterator[pa.RecordBatch], shared=shared, compared=compared) -> Iterator[pa.RecordBatch]:
            search, kind = None, None
            for batch in batches:
                search, kind = search or _Search(*shared.value), batch.column("id").type
                if not batch.num_rows or not len(search.ids):
                    continue
                ids, labels = batch.column("id").to_pylist(), batch.column("label").to_pylist()
                place = batch.column("pivot").to_numpy().astype(np.int64) * RINGS + batch.column("ring").to_numpy()
                units = _units(batch.column("v"))
                order = sorted(range(len(ids)), key=lambda i: (place[i], ids[i] is None, ids[i]))
                edges = [0, *(np.flatnonzero(np.diff(place[order])) + 1).tolist(), len(order)]
                for a, b in zip(edges, edges[1:], strict=False):
                    for c in range(a, b, TILE_ROWS):
                        these = order[c : min(b, c + TILE_ROWS)]
                        p = int(place[these[0]])
                        search.look(p // RINGS, p % RINGS, [ids[i] for i in these], [labels[i] for i in these], units[these])
            if search:
                compared.add(search.compared)
                got = [(search.ids[i], x, float(search.best[i])) for i, x in enumerate(search.found) if x is not None]
                cols = list(zip(*got, strict=True)) or [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], kind), pa.array(cols[1], kind), pa.array(cols[2], pa.float64())], ["id", "nearest", "similarity"])

        found = index.rows.mapInArrow(run, f"id {kind}, nearest {kind}, similarity double")
        out = found if out is None else out.unionByName(found)
    top = out.groupBy("id").agg(F.max("similarity").alias("similarity"), F.min(F.struct(-F.col("similarity"), "nearest")).alias("t"))
    return top.select("id", "t.nearest", "similarity")


def nearest(queries: DataFrame, rows: DataFrame, id_col: str, label_col: str, vector_col: str, fallback: bool = False, index: Index | None = None) -> DataFrame:
    """Per query: id, nearest (the row of another label and id with the greatest cosine, the smallest id on a tie),
    similarity and masked. A query whose label all rows share has no result, or with fallback the nearest row of its own
    label (another id), and is marked. Null labels differ from all others; rows without a vector or an id are passed
    over; vectors without length have similarity 0 to everything. index.compared counts the pairs that were compared,
    once the result has been made.
    """
    index = index or build(rows.filter(F.col(id_col).isNotNull()), id_col, label_col, vector_col)
    asked = queries.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")).filter("v IS NOT NULL AND id IS NOT NULL")
    out = _search(index, asked, False).withColumn("masked", F.lit(False))
    if fallback:
        out = checkpointed(out)
        out = out.unionByName(_search(index, asked.join(out.select("id"), "id", "left_anti"), True).withColumn("masked", F.lit(True)))
    return out.withColumnRenamed("id", id_col)
