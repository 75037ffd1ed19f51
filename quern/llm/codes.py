"""Vector codes: product quantisation learnt on weighted distinct parts.

Components become integers, floor(scale * x). Each vector is cut into equal consecutive parts; the equal parts of one
position become one row with a weight, the number of vectors that have it. Lloyd's rounds run over these distinct rows:
a row goes to the nearest entry of its position's codebook (squared Euclidean distance, ties to the lower index), and
an entry becomes the floor of its rows' weighted mean. Finally the codes and distances of the distinct rows are joined
back to the vectors. All of it is integer arithmetic, so results do not depend on how the rows are dealt.

What meets in one task: the codebooks (parts * entries * width numbers, a parameter's size) are sent to the tasks, and
sums of the same size come back from each; a part that a third of all vectors share is one weighted row, and is joined
back by a broadcast of the hot rows.

Rows whose vector is null or holds null, NaN or infinite components are dropped. Equal ids are vectors of their own;
where the first codebook has to choose between them, the smaller vector goes first, and null ids go last. With fewer
vectors than entries the codebooks are shorter. No vectors give no rows. Vectors must have one length, a multiple of
the number of parts, and components below 2^18 in size, or the job fails and says so. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import joined_back, read_table, stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: The largest component for which no sum of squares over up to 2^8 components of a part leaves 63 bits.
LARGEST = float(1 << 18)
#: Rows of a part that are compared with a codebook at a time.
SLICE = 4096


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """(row, id, label, q): the kept vectors as integers, each row with a number of its own; written once."""
    c = F.col(vector_col)
    finite = c.isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    bounded = lambda x: F.when(F.abs(x) < LARGEST, F.floor(x.cast("double") * scale)).otherwise(F.raise_error(F.lit("a component is too large")).cast("long"))
    rows = vectors.filter(F.coalesce(finite, F.lit(False)))
    return stored(rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.transform(c, bounded).alias("q")))


def weighted_parts(vectors: DataFrame, parts: int, width: int) -> tuple[DataFrame, DataFrame]:
    """(row, part, v) for every part of every vector, and (part, v, n) for the distinct ones."""
    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.slice("q", p * width + 1, F.lit(width)))
    every = vectors.select("row", F.posexplode(cut).alias("part", "v"))
    return every, stored(every.groupBy("part", "v").agg(F.count(F.lit(1)).alias("n")))


def nearest_entries(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry and the squared distance to it, for each point; the first of equally near ones."""
    code, error = np.empty(len(points), np.int64), np.empty(len(points), np.int64)
    for a in range(0, len(points), SLICE):
        d = ((points[a : a + SLICE, None, :] - book[None]) ** 2).sum(axis=2)
        code[a : a + SLICE] = d.argmin(axis=1)
        error[a : a + SLICE] = d.min(axis=1)
    return code, error


def _coded(batch: pa.RecordBatch, books: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, places in the batch, points, codes, errors) for each part in the batch."""
    part = batch.column("part").to_numpy(zero_copy_only=False)
    points = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)
    for p in np.unique(part):
        at = np.flatnonzero(part == p)
        yield int(p), at, points[at], *nearest_entries(points[at], books[p])


def next_codebooks(distinct: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: each entry becomes the floor of the weighted mean of its parts; entries without parts stay."""
    shared = distinct.sparkSession.sparkContext.broadcast(books)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = np.zeros(shared.value.shape, np.int64), np.zeros(shared.value.shape[:2], np.int64)
        for batch in batches:
            n = batch.column("n").to_numpy(zero_copy_only=False)
            for p, at, points, code, _ in _coded(batch, shared.value):
                np.add.at(total[p], code, points * n[at, None])
                np.add.at(weight[p], code, n[at])
        part, entry = np.nonzero(weight)
        if len(part):
            yield pa.RecordBatch.from_pydict({"part": part, "entry": entry, "n": weight[part, entry], "sums": list(total[part, entry])})

    told = distinct.mapInArrow(sums, "part long, entry long, n long, sums array<long>")
    # a row for each entry's component from each task; as many numbers as the codebooks have come to the driver
    flat = told.select("part", "entry", "n", F.posexplode("sums").alias("at", "s")).groupBy("part", "entry", "at").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    out = books.copy()
    for r in flat.collect():
        out[r["part"], r["entry"], r["at"]] = r["s"] // r["n"]
    shared.unpersist()
    return out


def vector_codes(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, np.ndarray]:
    """(id, label, codes, error) for each kept vector, codes an array in part order; and the codebooks, indexed by part,
    entry and place in the part. What read_back() makes of codes and codebooks is `error` away from the integers."""
    kept = whole_vectors(vectors, id_col, vector_col, label_col, scale)
    first = kept.orderBy(F.asc_nulls_last("id"), "q").select("q").limit(entries).collect()
    lengths = kept.agg(F.min(F.size("q")).alias("a"), F.max(F.size("q")).alias("b")).first()
    if lengths["a"] is not None and (lengths["a"] != lengths["b"] or lengths["a"] % parts or not 0 < lengths["a"] <= parts << 8):
        raise ValueError(f"vectors of {lengths['a']} to {lengths['b']} components can't be cut into {parts} equal parts")
    width = (lengths["a"] or parts) // parts
    books = np.array([r["q"] for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    every, distinct = weighted_parts(kept, parts, width)
    for _ in range(rounds if len(first) else 0):
        books = next_codebooks(distinct, books)
    shared = kept.sparkSession.sparkContext.broadcast(books)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = np.empty(batch.num_rows, np.int64), np.empty(batch.num_rows, np.int64)
            for _, at, _, c, e in _coded(batch, shared.value):
                code[at], error[at] = c, e
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("part", "v", "n")), pa.array(code), pa.array(error)], ["part", "v", "n", "entry", "distance"])

    coded = stored(distinct.select("part", "v", "n").mapInArrow(assign, "part int, v array<long>, n long, entry long, distance long"))
    found = joined_back(every, coded, ["part", "v"], "n", "row")
    codes = F.transform(F.array_sort(F.collect_list(F.struct("part", "entry"))), lambda x: x["entry"])
    told = found.groupBy("row").agg(codes.alias("codes"), F.sum("distance").alias("error"))
    return kept.select("row", "id", "label").join(told, "row").drop("row"), books


def read_back(codes: list[int], books: np.ndarray) -> list[int]:
    """The integers that stand for a vector with these codes."""
    return [int(x) for p, c in enumerate(codes) for x in books[p, c]]


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    told, books = vector_codes(read_table(spark, sf_dir, "embeddings"))
    told = stored(told)
    labels = stored(told.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")))
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    rows = joined_back(told, labels, ["label"], "n", "id")
    return rows.select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op13_vector_codes": op13_vector_codes}


def _rounds_sql() -> str:
    """Each round: the nearest entries of the distinct parts (a), and the codebook that follows from them (b)."""
    out = []
    for k in range(ROUNDS + 1):
        out.append(f"""
        a{k} AS MATERIALIZED (
            SELECT d.part, d.v, d.n, min({{'e': list_sum(list_transform(list_zip(d.v, b.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT, 'c': b.entry}}) AS best
            FROM d JOIN b{k} b USING (part) GROUP BY ALL
        )""")
        if k < ROUNDS:
            out.append(f"""
        s{k} AS (
            SELECT part, best.c AS entry, j, sum(v[j + 1] * n)::BIGINT AS s, sum(n)::BIGINT AS n
            FROM a{k}, (SELECT unnest(range((SELECT max(len(v)) FROM d))) AS j) GROUP BY ALL
        ), m{k} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY j) AS v FROM s{k} GROUP BY ALL),
        b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM b{k} b LEFT JOIN m{k} m USING (part, entry))""")
    return ",".join(out)


ORACLE_SQL = {
    "op13_vector_codes": f"""
        WITH kept AS MATERIALIZED (
            SELECT vec_id, label, row_number() OVER () AS row, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q
            FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), p AS MATERIALIZED (SELECT row, part, q[part * (len(q) // {PARTS}) + 1 : (part + 1) * (len(q) // {PARTS})] AS v FROM kept, (SELECT unnest(range({PARTS})) AS part)),
        d AS MATERIALIZED (SELECT part, v, count(*) AS n FROM p GROUP BY ALL),
        f AS (SELECT row, row_number() OVER (ORDER BY vec_id, q) - 1 AS entry FROM kept QUALIFY entry < {ENTRIES}),
        b0 AS (SELECT part, entry, v FROM f JOIN p USING (row)), {_rounds_sql()},
        told AS (
            SELECT row, string_agg(printf('%02x', best.c), '' ORDER BY part) AS code, sum(best.e)::BIGINT AS error
            FROM p JOIN a{ROUNDS} USING (part, v) GROUP BY row
        ), books AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, j)) AS digest FROM (SELECT part, entry, unnest(v) AS x, unnest(range(len(v))) AS j FROM b{ROUNDS}))
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT digest FROM books) AS codebooks_sha256
        FROM kept JOIN told USING (row)"""
}
