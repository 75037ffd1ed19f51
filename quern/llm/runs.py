"""Periodic runs of words by the runs theorem.

A run is a stretch of words with smallest period q, long enough (max(least, times * q) words), that no neighbouring word
extends. Every run holds, under one of the two orders of the alphabet, a Lyndon root: the longest Lyndon word that
starts at one of its first q places. The longest Lyndon words are read off the inverse suffix array, as the distance
to the next smaller value, and under the opposite order to the next greater one. Each root is extended to the right and
the left by longest common extensions, which are range minima of the LCP array, answered by a sparse table; the roots
that reach a run's length give the run, once for each.

All documents of a slice are worked on together in whole arrays: a suffix array by doubling in which every word also
carries its document, so that no comparison leaves a document. Extension to the left needs the arrays of the reversed
words; they are made for documents that have a root long enough only. A slice has SLICE_WORDS words, or one longer
document; its tables hold at most some 3 * log2(words of its longest document) numbers a word, whatever the number of
rows. Rows are worked on where they are: nothing is shuffled, and copies or a hot source make no difference.

Null text has no words. A null id counts as empty text in the hash of periodised() (crc32 0), and rows with it are
answered like others. Repeated rows give repeated rows, an empty table none; other columns are ignored. A very long
text is a slice of its own.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

LEAST, TIMES = 6, 4
SLICE_WORDS = 1 << 17
RESULT = "doc_id {}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_words long, n_dropped long"


class Suffixes:
    """Suffix order of several documents that lie one after the other: symbols, and the place where each one's document ends."""

    def __init__(self, symbols: np.ndarray, ends: np.ndarray) -> None:
        n = len(symbols)
        self.n = n
        places = np.arange(n)
        # a document's own end is part of the key, so that suffixes of different documents never compare as equal
        key = ends * (int(symbols.max(initial=0)) + 1) + symbols
        self.order = np.argsort(key, kind="stable")
        first = np.r_[True, np.diff(key[self.order]) != 0]
        heads = np.maximum.accumulate(np.where(first, places, 0))
        self.rank = np.empty(n, np.int64)  # the first place of the suffix's group in the order
        self.rank[self.order] = heads
        lcp = np.zeros(n, np.int64)
        levels = []  # ranks by the first 1, 2, 4, ... words, as far as anything was undecided by them
        tied, step = _tied(first), 1
        while len(tied):
            levels.append(self.rank.copy())
            at = self.order[tied]
            after = np.where(at + step < ends[at], self.rank[np.minimum(at + step, n - 1)] + 1, 0)
            both = self.rank[at] * (n + 2) + after
            by = np.argsort(both, kind="stable")
            self.order[tied] = at[by]
            both = both[by]
            fresh = np.r_[True, np.diff(both) != 0]
            split = tied[fresh & ~first[tied]]
            lcp[split] = len(levels)  # for now: the round in which the neighbours came apart
            first[split] = True
            heads = np.maximum.accumulate(np.where(fresh, tied, 0))
            self.rank[self.order[tied]] = heads
            tied = tied[_tied_of(first, tied)]
            step *= 2
        self._measure(lcp, levels, ends)

    def _measure(self, lcp: np.ndarray, levels: list[np.ndarray], ends: np.ndarray) -> None:
        """lcp: from rounds to lengths. Neighbours that came apart in round k share 2^(k-1) words and under 2^k."""
        rounds, self.lcp = lcp, np.zeros(self.n, np.int64)
        for k in range(len(levels), 0, -1):
            at = np.flatnonzero(rounds >= k)
            a, b = self.order[at - 1] + self.lcp[at], self.order[at] + self.lcp[at]
            inside = np.maximum(a, b) < self.n
            same = np.zeros(len(at), bool)
            a, b = a[inside], b[inside]
            same[inside] = (levels[k - 1][a] == levels[k - 1][b]) & self._room(a, b, ends, 1 << (k - 1))
            self.lcp[at[same]] += 1 << (k - 1)
        self.table = sparse_minima(self.lcp, int(np.diff(np.flatnonzero(np.r_[True, np.diff(ends) != 0, True])).max(initial=1)))

    @staticmethod
    def _room(a: np.ndarray, b: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
        """Whether both have as many words left. Suffixes that are shorter are alone in their group, or end alike."""
        return np.maximum(a + width - ends[a], b + width - ends[b]) <= 0

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of words that the suffixes at a and b (two places of one document) have in common."""
        low, high = np.minimum(self.rank[a], self.rank[b]) + 1, np.maximum(self.rank[a], self.rank[b])
        return range_minimum(self.table, low, high)


def _tied(first: np.ndarray) -> np.ndarray:
    """Places in the order that share their group with another."""
    alone = first & np.r_[first[1:], True]
    return np.flatnonzero(~alone)


def _tied_of(first: np.ndarray, places: np.ndarray) -> np.ndarray:
    after = np.minimum(places + 1, len(first) - 1)
    last = (places + 1 == len(first)) | first[after]
    return ~(first[places] & last)


def sparse_minima(values: np.ndarray, longest: int) -> list[np.ndarray]:
    """table[k][i] = the smallest of 2^k values from i on, for ranges of up to `longest`."""
    table = [values]
    while 1 << len(table) <= longest:
        half, last = 1 << (len(table) - 1), table[-1]
        table.append(np.minimum(last, np.r_[last[half:], last[-1:].repeat(min(half, len(last)))]))
    return table


def range_minimum(table: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Smallest value of table's array from low to high, both included."""
    k = np.frexp((high - low + 1).astype(float))[1] - 1
    out = np.empty(len(low), np.int64)
    for level in np.unique(k):
        at = np.flatnonzero(k == level)
        out[at] = np.minimum(table[level][low[at]], table[level][high[at] - (1 << level) + 1])
    return out


def next_smaller(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each place the next one of its document with a smaller value, or the document's end. Most are a few places
    off and are found by looking; the rest go down a sparse table of minima."""
    n = len(values)
    at, to = np.arange(n), np.arange(1, n + 1)
    padded = np.r_[values, -1]
    for _ in range(4):
        on = (to[at] < ends[at]) & (padded[to[at]] > values[at])
        at = at[on]
        to[at] += 1
    if len(at):
        longest = int((ends[at] - at).max())
        table = sparse_minima(values, longest)
        for k in range(len(table) - 1, -1, -1):
            inside = to[at] + (1 << k) <= ends[at]
            free = np.zeros(len(at), bool)
            free[inside] = table[k][to[at[inside]]] > values[at[inside]]
            to[at[free]] += 1 << k
    return to


def lyndon_roots(forward: Suffixes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the longest Lyndon word that starts at each place, under either order; a document's end counts
    as the smallest word under the one order and as the greatest under the other."""
    starts = np.arange(forward.n)
    both = [next_smaller(v, ends) - starts for v in (forward.rank, forward.n - 1 - forward.rank)]
    return np.r_[starts, starts], np.r_[both[0], both[1]]


def runs_of(symbols: np.ndarray, ends: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of documents that lie one after the other, by start, then period."""
    none = np.zeros(0, np.int64)
    if not len(symbols):
        return none, none, none
    forward = Suffixes(symbols, ends)
    start, period = lyndon_roots(forward, ends)
    after = start + period
    some = after < ends[start]
    start, period, after = start[some], period[some], after[some]
    some = symbols[start] == symbols[after]  # else nothing follows the root
    start, period, after = start[some], period[some], after[some]
    right = forward.common(start, after)
    # a run's first root leaves under one period of it to the left
    some = right + period + period - 1 >= np.maximum(least, times * period)
    start, period, right = start[some], period[some], right[some]
    if not len(start):
        return none, none, none
    left = _to_the_left(symbols, ends, start, start + period)
    begin, length = start - left, left + period + right
    some = length >= np.maximum(least, times * period)
    found = np.unique(np.stack([begin[some], period[some], length[some]], axis=1), axis=0)
    return found[:, 0], found[:, 2], found[:, 1]


def _to_the_left(symbols: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words before a equal those before b, within the document of both: suffixes of the reversed words."""
    whole = np.unique(ends)
    begins = np.r_[0, whole[:-1]]
    wanted = np.searchsorted(whole, np.unique(ends[a]))
    sizes = whole[wanted] - begins[wanted]
    moved = np.cumsum(sizes) - sizes  # where these documents begin when only they are laid out
    owner = np.repeat(np.arange(len(wanted)), sizes)
    within = np.arange(sizes.sum()) - moved[owner]
    turned = symbols[whole[wanted][owner] - 1 - within]
    back = Suffixes(turned, (moved + sizes)[owner])
    doc = np.searchsorted(whole[wanted], ends[a])
    mirror = lambda x: moved[doc] + whole[wanted][doc] - x  # noqa: E731  # the word before x, in the reversed document
    out, inside = np.zeros(len(a), np.int64), a > begins[wanted][doc]
    out[inside] = back.common(mirror(a)[inside], mirror(b)[inside])
    return out


def periodised(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which original word stands at each place, for the ids whose text is made periodic from some word on."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    return np.where(places < a, places, a + (places - a) % p)


def _told(docs: list[tuple[object, list[bytes]]], least: int, times: int) -> list[tuple]:
    sizes = np.array([len(words) for _, words in docs], np.int64)
    ends_of = np.cumsum(sizes)
    names: dict[bytes, int] = {}
    symbols = np.fromiter((names.setdefault(w, len(names)) for _, words in docs for w in words), np.int64, int(sizes.sum()))
    ends = np.repeat(ends_of, sizes)
    start, length, period = runs_of(symbols, ends, least, times)
    # words that a run holds after its first period, as sums of +1 where such a stretch begins and -1 where it ends
    over = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(over, start + period, 1)
    np.add.at(over, start + length, -1)
    dropped = np.cumsum(over)[:-1] > 0
    bounds = np.searchsorted(start, np.r_[0, ends_of])
    out = []
    for (doc_id, words), size, end, x, y in zip(docs, sizes.tolist(), ends_of.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        gone = dropped[end - size : end]
        kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if y > x else words
        runs = list(zip((start[x:y] - (end - size)).tolist(), length[x:y].tolist(), period[x:y].tolist(), strict=True))
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        listed = "".join(f"{s},{m},{p}\n" for s, m, p in runs)
        out.append((doc_id, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest(), size, int(gone.sum())))
    return out


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES, remap: Callable[[object, int], np.ndarray | None] | None = None) -> DataFrame:
    """Per row: doc_id, the number of runs, the longest one, digests of all runs and of the text without repetition, words
    and dropped words. remap(id, number of words) may name the word that stands at each place instead of the text's own."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text"))
    id_type = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in batches:
            ids = batch.column("doc_id")
            schema = schema or pa.schema([("doc_id", ids.type), *((c, pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()), ("n_words", pa.int64()), ("n_dropped", pa.int64())])

            def answer(held: list[tuple[object, list[bytes]]], schema: pa.Schema = schema) -> pa.RecordBatch:
                cols = zip(*_told(held, least, times), strict=True)
                return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

            held, size = [], 0
            for doc_id, text in zip(ids.to_pylist(), batch.column("_text"), strict=True):
                words = text.as_py().split()  # at the six ASCII white spaces
                other = remap(doc_id, len(words)) if remap else None
                if other is not None:
                    words = [words[i] for i in other.tolist()]
                if held and size + len(words) > SLICE_WORDS:
                    yield answer(held)
                    held, size = [], 0
                held.append((doc_id, words))
                size += len(words)
            if held:
                yield answer(held)

    return slim.mapInArrow(run, RESULT.format(id_type))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(read_table(spark, sf_dir, "documents"), remap=periodised)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op12_periodic_runs": op12_periodic_runs}

_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"

#: Equal words at distance q in unbroken lines are stretches of period q; of one stretch's periods the smallest counts.
ORACLE_SQL = {
    "op12_periodic_runs": rf"""
        WITH t AS (
            SELECT row_number() OVER () AS row, doc_id, CASE WHEN doc_id IS NULL THEN 0 ELSE {_CRC.format('doc_id::VARCHAR')} END AS h,
                   list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
            FROM documents
        ), s AS (SELECT *, len(w) AS n, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM t),
        d AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN 1 + (n - a) // (3 + (h // 10) % 8) END AS p FROM s),
        e AS MATERIALIZED (SELECT row, n, unnest(range(n)) AS i, a, p, unnest(w) AS own, w FROM d),
        x AS MATERIALIZED (SELECT row, n, i, CASE WHEN p IS NULL OR i < a THEN own ELSE w[1 + a + (i - a) % p] END AS word FROM e),
        j AS (SELECT u.row, u.i, v.i - u.i AS q FROM x u JOIN x v ON u.row = v.row AND u.word = v.word AND v.i > u.i AND {TIMES} * (v.i - u.i) <= u.n),
        g AS (SELECT row, q, i, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS line FROM j),
        r AS (
            SELECT row, start, length, min(q) AS period
            FROM (SELECT row, q, min(i) AS start, count(*) + q AS length FROM g GROUP BY row, q, line HAVING count(*) + q >= greatest({LEAST}, {TIMES} * q))
            GROUP BY row, start, length
        ), runs AS MATERIALIZED (
            SELECT row, count(*) AS n_runs, min({{'l': -length, 's': start, 'p': period}}) AS best,
                   string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed
            FROM r GROUP BY row
        ), gone AS (SELECT DISTINCT row, unnest(range(start + period, start + length)) AS i FROM r),
        kept AS (SELECT x.row, string_agg(word, ' ' ORDER BY x.i) AS text, count(*) AS n_kept FROM x ANTI JOIN gone ON x.row = gone.row AND x.i = gone.i GROUP BY x.row)
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, -best.l AS length, best.p AS period, 1000 * -best.l // best.p AS exponent_milli,
               sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256, n AS n_words, n - coalesce(n_kept, 0) AS n_dropped
        FROM d LEFT JOIN runs ON d.row = runs.row LEFT JOIN kept ON d.row = kept.row"""
}
