"""LM scoring: a log-frequency Bloom filter holds quantised n-gram counts, cut by hash into segments that are probed in place.

Documents are dealt into chunks of CHUNK_BYTES of text. Each chunk sends its distinct n-grams (words and pairs of
adjacent words), hashed, with their counts in its training rows, to the segments of the n-gram space; there is one
segment for SEGMENT_BYTES of text, so a segment has the same size at every size of input.

Training: a segment adds up the counts of all chunks and stores each n-gram with count c in its filter under the levels
1 .. 1 + floor(log2 c), pairs seen once as well. The filter has BITS_PER_ENTRY bits for each of its measured entries,
so that a probe of an absent entry hits with probability 0.012. The model is a table with a row for each segment: the
filter's bits, which are all that is left of the pairs, and the exact counts of its words, told apart by 80 bits of
hash, which serve base_score. It grows with the text, so the n-grams meet it in the segments and it is not broadcast.

Scoring: each n-gram of a chunk is looked up by probing level after level until a probe misses or the segment's highest
level is reached; the count is read back as the mean count of its level under a 1/c^2 law, and the levels return to the chunk.
P(w | v) = LAMBDA * c(v w) / c(v) + (1 - LAMBDA) * P1(w), P1(w) = (c(w) + ALPHA) / (N + ALPHA * (V + 1)); c(v w) is held
to min(c(v), c(w)), as false positives could exceed it. A history without count leaves P1 alone. As counts are
quantised, the probabilities after a history sum to about one, not to one. score is the sum of log10 P over the text's
words and its end, base_score the same with P1 of exact counts.

A word that every chunk holds is one entry of each chunk in its segment, never a row of each occurrence.

Null or empty text is the end alone. A null id counts as empty text when rows are held out. Repeated rows are scored
and counted each, and dealt evenly like others. With no training rows all counts are 0. Extra columns are ignored. A very
long text is scored whole, in a chunk that is as much larger. The input should be a table, or another plan whose rows
come in one order, as rows are dealt by their places.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import crc_mod, read_table

ALPHA, LAMBDA, MIN_PAIR = 0.1, 0.2, 1
BITS_PER_ENTRY = 10
SEGMENT_BITS = 6  # log2 of the least number of segments
SEGMENT_BYTES = 8 << 20  # text of a segment
PROBES = 4
CHUNK_BYTES = 8 << 20
MOST_PARTITIONS = 20_000
_U = np.uint64


def tokens_of(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z, then the end, which is the empty word."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), b""]


def encoded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes], int]:
    """Word numbers of all texts in a row, tokens of each text, the words by number, and the number of the end."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.cast(pa.binary()).to_pylist()
    end = pc.index(coded.dictionary, "").as_py()
    if end < 0:
        end = len(words)
        words.append(b"")
    numbers = coded.indices.to_numpy(zero_copy_only=False)
    word = numbers != end  # white space at an edge leaves an empty piece
    if not len(lists):
        return np.zeros(0, np.int32), np.zeros(0, np.int64), words, end
    cuts = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
    sizes = np.add.reduceat(word.astype(np.int64), np.concatenate([[0], cuts[:-1]])) + 1
    out = np.full(int(sizes.sum()), end, np.int32)
    inner = np.ones(out.size, bool)
    inner[np.cumsum(sizes) - 1] = False
    out[inner] = numbers[word]
    return out, sizes, words, end


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def segment_bits_for(volume: int) -> int:
    """log2 of the number of segments for so many bytes of text."""
    return min(32, max(SEGMENT_BITS, (volume // SEGMENT_BYTES).bit_length()))


def word_digests(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64 bits of each word's hash, which hold the segment and stand for the word in pairs, and 16 more."""
    import xxhash

    raw = np.frombuffer(b"".join([xxhash.xxh3_128_digest(w)[:10] for w in words]), np.uint8).reshape(-1, 10)
    return tuple(np.ascontiguousarray(raw[:, a:b]).view(t).ravel().astype(u) for a, b, t, u in ((0, 8, ">u8", np.uint64), (8, 10, ">u2", np.uint16)))


def pair_keys(h: np.ndarray, numbers: np.ndarray, end: int, segment_bits: int) -> np.ndarray:
    """For each token its key together with the token before: segment and 32 bits. A text's first word follows an end.
    h: hashes by number."""
    of = h[numbers]
    before = np.empty_like(of)
    before[:1], before[1:] = h[end], of[:-1]
    before *= _U(0xD6E8FEB86659FD93)
    before += of
    key = _mix(before)
    return (key >> _U(64 - segment_bits)) << _U(32) | key & _U(0xFFFFFFFF)


def levels(counts: np.ndarray) -> np.ndarray:
    return (np.floor(np.log2(np.maximum(counts, 1))) + 1).astype(np.int64)


def _level_mean(j: int) -> float:
    """Level j holds the counts 2**(j-1) .. 2**j - 1."""
    c = np.arange(2 ** (j - 1), 2**j, dtype=float) if j <= 12 else np.array([2.0 ** (j - 1) * 2 * np.log(2)])
    return float((1 / c).sum() / (1 / c**2).sum())


LEVEL_MEAN = np.array([0.0] + [_level_mean(j) for j in range(1, 65)])


class LogFrequencyFilter:
    """Bits of one segment hold its n-grams under (key, level); top is the highest level stored."""

    def __init__(self, bits: np.ndarray, top: int):
        self.bits, self.top = bits, top

    @staticmethod
    def places(keys: np.ndarray, level: int, size: int) -> Iterator[np.ndarray]:
        a = _mix(keys + np.asarray(level).astype(np.uint64) * _U(0x9E3779B97F4A7C15))
        b = (a >> _U(32)) | _U(1)
        for i in range(PROBES):
            yield ((a + _U(i) * b) % _U(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, counts: np.ndarray) -> LogFrequencyFilter:
        tops = levels(counts)
        out, top = np.zeros(8 * max(8, -(-BITS_PER_ENTRY * int(tops.sum()) // 8)), bool), int(tops.max(initial=0))
        for j in range(1, top + 1):
            keys, tops = keys[tops >= j], tops[tops >= j]
            for p in cls.places(keys, j, out.size):
                out[p] = True
        return cls(np.packbits(out, bitorder="little"), top)

    def level(self, keys: np.ndarray) -> np.ndarray:
        """Highest level whose probes, and those of all levels below, hit; 0 if level 1 misses."""
        found, left = np.zeros(keys.size, np.uint8), np.arange(keys.size)
        bits = np.unpackbits(self.bits, bitorder="little").view(bool)
        for j in range(1, self.top + 1):
            hit = np.ones(left.size, bool)
            for p in self.places(keys[left], j, bits.size):
                hit &= bits[p]
            left = left[hit]
            found[left] = j
        return found


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted 32-bit numbers: bytes of a step, the first number, the steps."""
    if not values.size:
        return b""
    steps = np.diff(values).astype("<u4")
    width = max(1, -(-int(steps.max(initial=0)).bit_length() // 8))
    return bytes([width]) + int(values[0]).to_bytes(4, "little") + steps.view(np.uint8).reshape(-1, 4)[:, :width].tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    width = data[0]
    steps = np.zeros((1 + (len(data) - 5) // width, 4), np.uint8)
    steps[0] = np.frombuffer(data, np.uint8, 4, 1)
    steps[1:, :width] = np.frombuffer(data, np.uint8, offset=5).reshape(-1, width)
    return np.cumsum(steps.view("<u4").ravel(), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """A byte for each count; those of 255 or more follow in full."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<u8").tobytes()


def unpack_counts(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<u8", offset=n)
    return out


def _cuts(segments: np.ndarray, present: np.ndarray) -> list[slice]:
    """Where each present segment lies in sorted segment numbers."""
    return [slice(a, b) for a, b in zip(np.searchsorted(segments, present).tolist(), np.searchsorted(segments, present, "right").tolist(), strict=True)]


def _arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in map(str.split, ddl.split(", "))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.table([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


SENT = "_chunk int, segment int, words binary, rests binary, times binary, pairs binary, counts binary"
MODEL = "segment int, bits binary, top int, words binary, rests binary, times binary, n long, v long"
TOLD = "_chunk int, segment int, times binary, word_levels binary, pair_levels binary"


def _send(table: pa.Table, segment_bits: int) -> pa.Table:
    """A chunk's distinct words and pairs by segment, each with its count in training rows."""
    numbers, sizes, words, end = encoded(table["_text"].combine_chunks())
    h, more = word_digests(words)
    trained = np.repeat(~table["held_out"].to_numpy(), sizes)
    times = np.bincount(numbers[trained], minlength=len(words))
    keys = pair_keys(h, numbers, end, segment_bits)
    pairs, (known, n) = np.unique(keys), np.unique(keys[trained], return_counts=True)
    counts = np.zeros(pairs.size, np.int64)
    counts[np.searchsorted(pairs, known)] = n
    order = np.lexsort((more, h))
    h, more, times = h[order], more[order], times[order]
    rests = np.concatenate([(h & _U(0xFFFFFFFF)).astype("<u4").view(np.uint8).reshape(-1, 4), more.astype("<u2").view(np.uint8).reshape(-1, 2)], axis=1)
    tops, lows = h >> _U(32), pairs & _U(0xFFFFFFFF)
    of_words, of_pairs = h >> _U(64 - segment_bits), pairs >> _U(32)
    present = np.union1d(of_words, of_pairs)
    chunk, rows = table["_chunk"][0].as_py(), []
    for s, w, p in zip(present.tolist(), _cuts(of_words, present), _cuts(of_pairs, present), strict=True):
        rows.append((chunk, s, pack_sorted(tops[w]), rests[w].tobytes(), pack_counts(times[w]), pack_sorted(lows[p]), pack_counts(counts[p])))
    return _batch(rows, _arrow_schema(SENT))


def _keys(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All chunks' words (64 bits and 16 more) and pairs in a segment, and where each chunk's begin."""
    tops, lows = ([unpack_sorted(x) for x in table[c].to_pylist()] for c in ("words", "pairs"))
    rests = np.frombuffer(b"".join(table["rests"].to_pylist()), np.uint8).reshape(-1, 6)
    h = np.concatenate(tops) << _U(32) | np.ascontiguousarray(rests[:, :4]).view("<u4").ravel()
    more = np.ascontiguousarray(rests[:, 4:]).view("<u2").ravel()
    return h, more, np.concatenate(lows), *(np.cumsum([0, *(x.size for x in parts)]) for parts in (tops, lows))


def _word_keys(h: np.ndarray) -> np.ndarray:
    return _mix(h + _U(0xA0761D6478BD642F))


def _train(table: pa.Table, min_pair: int) -> pa.Table:
    """A segment of the model, from all chunks' counts in training rows."""
    h, more, pairs, words_at, pairs_at = _keys(table)
    times, counts = (np.concatenate([unpack_counts(x, int(n)) for x, n in zip(table[c].to_pylist(), np.diff(at), strict=True)]) for c, at in (("times", words_at), ("counts", pairs_at)))
    h, more, times = h[times > 0], more[times > 0], times[times > 0]
    order = np.lexsort((more, h))
    new = np.ones(order.size, bool)
    new[1:] = (h[order[1:]] != h[order[:-1]]) | (more[order[1:]] != more[order[:-1]])
    first, exact = _summed(order, new, times)
    h, more = h[first], more[first]
    pairs, counts = pairs[counts > 0], counts[counts > 0]
    order = np.argsort(pairs, kind="stable")
    new = np.ones(order.size, bool)
    new[1:] = pairs[order[1:]] != pairs[order[:-1]]
    first, n = _summed(order, new, counts)
    often = n >= max(1, min_pair)
    model = LogFrequencyFilter.build(np.concatenate([_word_keys(h), pairs[first][often]]), np.concatenate([exact, n[often]]))
    rests = np.concatenate([(h & _U(0xFFFFFFFF)).astype("<u4").view(np.uint8).reshape(-1, 4), more.astype("<u2").view(np.uint8).reshape(-1, 2)], axis=1)
    row = (table["segment"][0].as_py(), model.bits.tobytes(), model.top, pack_sorted(h >> _U(32)), rests.tobytes(), pack_counts(exact), int(exact.sum()), int(exact.size))
    return _batch([row], _arrow_schema(MODEL))


def _summed(order: np.ndarray, new: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted entries: the first of each run (new marks it), and the sum of n in it."""
    first = np.flatnonzero(new)
    return order[first], np.add.reduceat(n[order], first) if first.size else n[:0]


def _known(h: np.ndarray, more: np.ndarray, words: np.ndarray, rest: np.ndarray, exact: np.ndarray) -> np.ndarray:
    """Exact counts of the words (h, more); words and rest are the model's, sorted."""
    out, left = np.zeros(h.size, np.int64), np.arange(h.size)
    at = np.searchsorted(words, h)
    while left.size:  # once, unless several words have the same 64 bits
        left = left[at[left] < words.size]
        left = left[words[at[left]] == h[left]]
        hit = rest[at[left]] == more[left]
        out[left[hit]] = exact[at[left[hit]]]
        left = left[~hit]
        at[left] += 1
    return out


def _probe(table: pa.Table, model: pa.Table) -> pa.Table:
    """The levels of all chunks' n-grams in a segment, by probing the model's filter, and exact counts of words."""
    if not table.num_rows or not model.num_rows:
        return _batch([], _arrow_schema(TOLD))
    h, more, pairs, words_at, pairs_at = _keys(table)
    (row,) = model.to_pylist()
    of = LogFrequencyFilter(np.frombuffer(row["bits"], np.uint8), row["top"])
    rests = np.frombuffer(row["rests"], np.uint8).reshape(-1, 6)
    words = unpack_sorted(row["words"]) << _U(32) | np.ascontiguousarray(rests[:, :4]).view("<u4").ravel()
    told = _known(h, more, words, np.ascontiguousarray(rests[:, 4:]).view("<u2").ravel(), unpack_counts(row["times"], words.size))
    of_words, of_pairs = of.level(_word_keys(h)), of.level(pairs)
    rows = []
    for i, c in enumerate(table["_chunk"].to_pylist()):
        w, p = slice(words_at[i], words_at[i + 1]), slice(pairs_at[i], pairs_at[i + 1])
        rows.append((c, row["segment"], pack_counts(told[w]), of_words[w].tobytes(), of_pairs[p].tobytes()))
    return _batch(rows, _arrow_schema(TOLD))


def n_grams(docs: DataFrame, segment_bits: int) -> DataFrame:
    """Dealt rows (_chunk, _text, held_out) -> their distinct n-grams by segment, dealt by segment."""
    sent = docs.groupBy("_chunk").applyInArrow(lambda table: _send(table, segment_bits), SENT)
    return sent.repartition(min(1 << segment_bits, MOST_PARTITIONS), "segment")


def train(sent: DataFrame, segment_bits: int, min_pair: int = MIN_PAIR) -> DataFrame:
    """The model: a row for each segment, with the filter's bits, the exact counts of its words, and their sums."""
    return sent.groupBy("segment").applyInArrow(lambda table: _train(table, min_pair), MODEL).repartition(min(1 << segment_bits, MOST_PARTITIONS), "segment")


def score(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    held_out_mod: int = 10,
    min_pair: int = MIN_PAIR,
    weight: float = LAMBDA,
    alpha: float = ALPHA,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), (crc_mod(F.col(id_col), held_out_mod) == 0).alias("held_out"))
    volume = int(base.agg(F.sum(F.octet_length("_text")).alias("b")).first()["b"] or 0)
    segment_bits = segment_bits_for(volume)
    chunks = max(spark.sparkContext.defaultParallelism, -(-volume // chunk_bytes))
    # by row, so that rows that repeat are dealt evenly too; beyond MOST_PARTITIONS a partition has several chunks
    row = F.monotonically_increasing_id()
    dealt = base.withColumn("_chunk", F.pmod(F.xxhash64(row), F.lit(chunks)).cast("int")).repartition(min(chunks, MOST_PARTITIONS), "_chunk")
    # all columns of dealt, of sent and of the model, so that their exchanges are used again
    sent = n_grams(dealt, segment_bits)
    model = train(sent, segment_bits, min_pair)
    answers = sent.groupBy("segment").cogroup(model.groupBy("segment")).applyInArrow(_probe, TOLD).repartition(min(chunks, MOST_PARTITIONS), "_chunk")
    # one row; the key is false for all rows
    every = sum((F.count(c) for c in model.columns[1:]), F.count(model.columns[0]))
    totals = model.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_all"), F.coalesce(F.sum("v"), F.lit(0)).alias("v_all"), (every < 0).alias("_one"))
    told = answers.join(F.broadcast(totals), F.isnull("_chunk") == F.col("_one")).drop("_one")
    schema = dealt.select("doc_id", "held_out").withColumns({"n_tokens": F.lit(0).cast("long"), "n_known": F.lit(0).cast("long"), "train_tokens": F.lit(0).cast("long"), "base_score": F.lit(0.0), "score": F.lit(0.0)}).schema

    def rate(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _batch([], to_arrow_schema(schema))
        right = right.sort_by("segment")
        n_all, v_all = right["n_all"][0].as_py(), right["v_all"][0].as_py()
        space = float(n_all) + alpha * (v_all + 1)
        numbers, sizes, words, end = encoded(left["_text"].combine_chunks())
        h, more = word_digests(words)
        place = np.lexsort((more, h))  # the words as they were sent
        exact, level = np.zeros(len(words), np.int64), np.zeros(len(words), np.uint8)
        of_words = right["word_levels"].to_pylist()
        exact[place] = np.concatenate([unpack_counts(t, len(k)) for t, k in zip(right["times"].to_pylist(), of_words, strict=True)])
        level[place] = np.frombuffer(b"".join(of_words), np.uint8)
        base_log = np.log10((exact + alpha) / space)
        uni = np.minimum(LEVEL_MEAN[level], n_all)
        keys, back = np.unique(pair_keys(h, numbers, end, segment_bits), return_inverse=True)
        found = np.frombuffer(b"".join(right["pair_levels"].to_pylist()), np.uint8)
        if found.size != keys.size:
            raise ValueError(f"{keys.size} keys and {found.size} levels")
        both = LEVEL_MEAN[found[back]]
        of = uni[numbers]
        before = np.concatenate([uni[[end]], of[:-1]])
        np.minimum(both, before, out=both)
        np.minimum(both, of, out=both)
        lam = np.where(before > 0, weight, 0.0)
        p = lam * both / np.maximum(before, 1) + (1 - lam) * (of + alpha) / space
        at = np.cumsum(sizes) - sizes
        n = left.num_rows
        return pa.table({
            "doc_id": left["doc_id"],
            "held_out": left["held_out"],
            "n_tokens": pa.array(sizes, pa.int64()),
            "n_known": pa.array(np.add.reduceat((exact[numbers] > 0).astype(np.int64), at), pa.int64()),
            "train_tokens": pa.array(np.full(n, n_all), pa.int64()),
            "base_score": pa.array(np.add.reduceat(base_log[numbers], at), pa.float64()),
            "score": pa.array(np.add.reduceat(np.log10(p), at), pa.float64()),
        })

    return dealt.groupBy("_chunk").cogroup(told.groupBy("_chunk")).applyInArrow(rate, schema)


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_lm_score": op1_lm_score}
ORACLE_SQL: dict[str, str] = {}
