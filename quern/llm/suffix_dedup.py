"""Suffix-array dedup: column-wise construction over many documents.

Every byte covered by a string of LENGTH bytes that also starts in a document with a smaller id is removed.

A string of LENGTH bytes is filed under the least hash of the GRAM-byte strings in it, so equal strings are filed
under one key. A document's consecutive strings with one key form a segment (MOST_STRINGS strings at most). Keys that
occur in one document only are left out. Up to SLICES_MOST * 2**BITMAP_LOG2 * BYTES_PER_BIT bytes of text, keys are
counted over all documents and held in bitmaps; a false hit only costs work. The key space is worked off in slices, one
for each 2**BITMAP_LOG2 bits that the text asks for (a bit for BYTES_PER_BIT bytes), so a broadcast has a fixed bound.
Larger collections of documents have no bitmaps: a row for each segment meets the counts of its key by joins, and the
shared ones return to their documents, which moves more but has no bound to reach. Both give the same result.

A segment is filed with its places (document and offset), so that what it loses needs no join. Keys found in HOT
documents or more (a passage that a share of all rows holds) are worked apart: their strings are filed one by one under
a hash of their own bytes, without places and combined within each task; the smallest document of each is then joined
to its places, a join that splits skewed keys. So no task gathers more than HOT documents' places.

The segments of a task's keys, equal ones counted once with their smallest document, are a collection of strings. For
it the Burrows-Wheeler transform and the common prefixes are built column by column: round j inserts suffix j of every
string at the place that the symbol counts of the present transform give, and its common prefixes with both
neighbours, each one more than the least common prefix between the places of the shorter suffixes. The columns are
read and written from front to back, as sequential files would be; as a collection has a bounded number of strings of
at most LENGTH + MOST_STRINGS - 1 bytes, they are arrays in memory, and no machine-local file is used. Strings of
LENGTH bytes are equal where neighbouring suffixes share LENGTH symbols; the smallest document of each such run decides
what all places of its segments lose.

Null text is empty; texts below LENGTH bytes keep all. Rows with a null id neither remove nor lose anything. Rows with
one id and equal text are cut alike; rows with one id never remove from each other. Ids must be integers. Extra columns
are ignored.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, joined_back, read_table, stored

LENGTH, GRAM, MOST_STRINGS = 50, 28, 64
#: A bitmap has as many bits as its expected entries ask for, and 2**BITMAP_LOG2 at most.
#: Every slice reads all text twice, so there are as few as broadcasts of 128 MiB allow: one up to 8 GiB of text.
BITMAP_LOG2, IDS_LOG2, BITS_PER_ID, BYTES_PER_BIT, SLICES_MOST = 30, 28, 16, 8, 4
SEGMENT_BITS = 10
HOT = 1 << 16
FLUSH = 1_000_000
FILED_BYTES, FLUSHED_ROWS = 8 << 20, 50_000  # text whose segments are put together, and rows sent on, at a time
STRETCH = 1 << 16  # bytes whose keys are computed at a time
COLLECTION = 1_000  # strings: the columns then stay in a core's cache
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def string_keys(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """For each string of `length` bytes its key: the least mixed hash of the grams in it."""
    if data.size < length:
        return np.zeros(0, np.uint64)
    h, done, size = None, 0, 1
    power = data.astype(np.uint64) + _U(1)  # hashes of strings of `size` bytes
    while True:  # put the gram together from powers of two
        if gram & size:
            tail = power[done:]
            h = tail if h is None else h[: tail.size] * _U(pow(_BASE, size, 1 << 64)) + tail[: h.size]
            done += size
        if size * 2 > gram:
            break
        power = power[:-size] * _U(pow(_BASE, size, 1 << 64)) + power[size:]
        size *= 2
    low, span, width = _mix(h[: data.size - gram + 1]), 1, length - gram + 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[: low.size - (width - span)], low[width - span:]) if width > span else low
    return _mix(low * _U(_BASE))  # least hashes are small numbers; spread them over the key space again


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts, and where each text begins and the last one ends."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int32)
    texts = texts.cast(pa.binary())
    _, offsets, data = texts.buffers()
    return np.frombuffer(data or b"", np.uint8), np.frombuffer(offsets, np.int32, len(texts) + 1, 4 * texts.offset)


def runs_in(data: np.ndarray, at: np.ndarray, length: int, gram: int, most: int = MOST_STRINGS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of strings with one key, none longer than most: keys, first string's position, position after the last.

    Worked off in stretches of a fixed number of bytes, whatever the texts' lengths; no run leaves its text.
    """
    end = int(at[-1])
    for begin in range(int(at[0]), end - length + 1, STRETCH):
        keys = string_keys(data[begin:min(begin + STRETCH + length - 1, end)], length, gram)
        ends = at[np.searchsorted(at, begin, "right"):np.searchsorted(at, begin + keys.size + length, "left")].astype(np.int64)
        over = (ends[:, None] - np.arange(1, length)).ravel() - begin  # strings that would leave their text
        torn = np.zeros(keys.size, bool)
        torn[over[(over >= 0) & (over < keys.size)]] = True
        edge = np.flatnonzero((keys[1:] != keys[:-1]) | (torn[1:] != torn[:-1])) + 1
        starts, stops = np.concatenate([[0], edge]), np.concatenate([edge, [keys.size]])
        whole = ~torn[starts]
        starts, stops = starts[whole], stops[whole]
        if not starts.size:
            continue
        if (stops - starts).max() > most:
            pieces = -(-(stops - starts) // most)
            nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first, last = np.repeat(starts, pieces) + nth * most, np.repeat(stops, pieces)
            starts, stops = first, np.minimum(first + most, last)
        yield keys[starts], starts + begin, stops + begin


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def in_slice(keys: np.ndarray, part: int, parts_log2: int) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are in a slice of the key space, and these keys without the bits that name it."""
    if not parts_log2:
        return np.ones(keys.size, bool), keys
    here = keys >> _U(64 - parts_log2) == _U(part)
    return here, keys[here] << _U(parts_log2)


def _count_keys(batches: Iterator[pa.RecordBatch], first: np.ndarray, length: int, gram: int, id_log2: int, part: int, parts_log2: int) -> Iterator[pa.RecordBatch]:
    """Documents per key, summed within the task: per segment of the key space the low 32 of 42 key bits."""
    held: list[np.ndarray] = []
    docs: list[np.ndarray] = []
    n = rows = 0

    def flush() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        keys, doc = np.concatenate(held), np.concatenate(docs)
        held.clear()
        docs.clear()
        order = np.argsort(keys, kind="stable")  # a key's documents stay in order
        keys, doc = keys[order], doc[order]
        once = np.ones(keys.size, bool)
        once[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
        keys, counts = np.unique(keys[once], return_counts=True)
        cuts = np.searchsorted(keys >> _U(32), np.arange((1 << SEGMENT_BITS) + 1, dtype=np.uint64))
        some = np.flatnonzero(np.diff(cuts))
        low, counts = (keys & _U(0xFFFFFFFF)).astype(np.uint32), counts.astype(np.uint32)
        parts = [(low[cuts[s]:cuts[s + 1]], counts[cuts[s]:cuts[s + 1]]) for s in some]
        yield pa.RecordBatch.from_pydict({
            "segment": pa.array(some, pa.int32()),
            "once": pa.array([k[c == 1].tobytes() for k, c in parts], pa.binary()),
            "more": pa.array([k[c > 1].tobytes() for k, c in parts], pa.binary()),
            "counts": pa.array([c[c > 1].tobytes() for k, c in parts], pa.binary()),
        })

    for batch in batches:
        batch = batch.filter(_among(batch, first, id_log2))
        data, at = bytes_of(batch.column("_text"))
        for keys, starts, _ in runs_in(data, at, length, gram):
            here, keys = in_slice(keys, part, parts_log2)
            held.append(keys >> _U(64 - 32 - SEGMENT_BITS))
            docs.append(rows + np.searchsorted(at, starts[here], "right"))
            n += keys.size
            if n >= FLUSH:  # a text cut in two by this counts twice: a false hit
                yield from flush()
                n = 0
        rows += batch.num_rows
    yield from flush()


def _among(batch: pa.RecordBatch, bits: np.ndarray, log2: int) -> pa.Array:
    """Which rows' ids may be in an id bitmap."""
    return pa.array(_probe(bits, batch.column("_place").to_numpy().view(np.uint64), log2))


def bits_for(entries: float, most: int = BITMAP_LOG2) -> int:
    """log2 of a bitmap's bits: at least a byte for each segment."""
    return min(most, max(SEGMENT_BITS + 3, int(np.ceil(np.log2(max(entries, 1))))))


def id_bitmap(ids: DataFrame, log2: int) -> bytes:
    """Bitmap of ids (column id) under their hash; its size is fixed, and a false hit must do no harm."""
    size = (1 << log2) >> SEGMENT_BITS
    at = F.shiftrightunsigned(F.xxhash64("id"), 64 - log2)
    placed = ids.select(F.shiftright(at, log2 - SEGMENT_BITS).cast("int").alias("segment"), at.bitwiseAND(size - 1).cast("int").alias("bit")).distinct()

    def build(key: tuple, table: pa.Table) -> pa.Table:
        bits = np.zeros(size, bool)
        bits[table["bit"].to_numpy()] = True
        return pa.table({"segment": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros((1 << log2) // 8, np.uint8)
    for row in placed.groupBy("segment").applyInArrow(build, "segment int, bits binary").toLocalIterator():
        out[row["segment"] * size // 8:(row["segment"] + 1) * size // 8] = np.frombuffer(row["bits"], np.uint8)
    return out.tobytes()


def key_bitmaps(docs: DataFrame, first, length: int, gram: int, hot: int, log2: int, id_log2: int, part: int, parts_log2: int) -> tuple[bytearray, bytearray]:
    """Bitmaps over the top bits of a slice's keys: found in two documents or more; found in hot documents or more."""
    hot_log2 = hot_bits(log2)
    counted = docs.select("_text", "_place").mapInArrow(lambda it: _count_keys(it, np.frombuffer(first.value, np.uint8), length, gram, id_log2, part, parts_log2), "segment int, once binary, more binary, counts binary")

    def build(key: tuple, table: pa.Table) -> pa.Table:
        once, more, counts = (b"".join(table[c].to_pylist()) for c in ("once", "more", "counts"))
        keys = np.frombuffer(once + more, np.uint32)
        n = np.concatenate([np.ones(len(once) // 4, np.int64), np.frombuffer(counts, np.uint32).astype(np.int64)])
        keys, back = np.unique(keys, return_inverse=True)
        n = np.bincount(back, weights=n, minlength=keys.size)
        out = []
        for least, width in ((2, log2), (hot, hot_log2)):
            bits = np.zeros(1 << width - SEGMENT_BITS, bool)
            bits[keys[n >= least] >> np.uint32(32 - width + SEGMENT_BITS)] = True
            out.append(np.packbits(bits, bitorder="little").tobytes())
        return pa.table({"segment": pa.array([key[0].as_py()], pa.int32()), "shared": pa.array(out[:1], pa.binary()), "hot": pa.array(out[1:], pa.binary())})

    bitmaps = [bytearray((1 << width) // 8) for width in (log2, hot_log2)]
    shared, many = (np.frombuffer(b, np.uint8) for b in bitmaps)  # no second copy of them in the driver
    for row in counted.groupBy("segment").applyInArrow(build, "segment int, shared binary, hot binary").toLocalIterator():
        for whole, part in ((shared, row["shared"]), (many, row["hot"])):
            whole[row["segment"] * len(part):(row["segment"] + 1) * len(part)] = np.frombuffer(part, np.uint8)
    return tuple(bitmaps)


def hot_bits(log2: int) -> int:
    return max(SEGMENT_BITS + 3, log2 - 5)


def _probe(bits: np.ndarray, keys: np.ndarray, log2: int) -> np.ndarray:
    at = (keys >> _U(64 - log2)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


class Collection:
    """Burrows-Wheeler transform and common prefixes of a collection of byte strings, built column by column."""

    def __init__(self, strings: list[bytes]):
        self.n = n = len(strings)
        lengths = np.fromiter(map(len, strings), np.int64, n)
        most = int(lengths.max(initial=0))
        # right-aligned matrix of symbols; 0 stands for the end, and no UTF-8 byte reaches 0xFF
        flat = np.frombuffer(b"".join(strings), np.uint8)
        columns = np.zeros((most + 1, n), np.uint8)
        nth = np.arange(flat.size) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        columns[(np.repeat(lengths, lengths) - nth - 1), np.repeat(np.arange(n), lengths)] = flat + np.uint8(1)
        # tag: owner * 256 + size of the suffix
        bwt, lcp, tag = columns[0].copy(), np.zeros(n, np.uint8), np.arange(n, dtype=np.int64) << 8
        place = np.arange(n)  # of each unfinished string's newest suffix
        who = np.arange(n)
        for j in range(1, most + 1):
            go = bwt[place] > 0  # strings with a symbol left
            place, who = place[go], who[go]
            if not who.size:
                break
            order = np.argsort(bwt, kind="stable")
            ended = bwt.size - int(np.count_nonzero(bwt))
            rank = np.empty(order.size, np.int64)
            rank[order] = np.arange(order.size)
            # all suffixes of the next state stand behind the n empty ones, in the order of (symbol, place)
            new = rank[place] - ended + n
            by = np.argsort(new)
            new, place, who = new[by], place[by], who[by]
            grown = order[ended:]
            low = np.append(lcp, np.uint8(0))
            before = self._common(bwt, low, grown, new - n, -1)
            after = self._common(bwt, low, grown, new - n, 1)
            old = np.ones(bwt.size + new.size, bool)
            old[new] = False
            bwt, lcp, tag = (self._insert(old, new, a, b) for a, b in ((bwt, columns[j][who]), (lcp, before), (tag, (who << 8) + j)))
            follow = new + 1 < lcp.size
            lcp[new[follow] + 1] = after[follow]
            place = new
        self.bwt, self.lcp, self.owner, self.size = bwt, lcp, tag >> 8, tag & 255

    @staticmethod
    def _insert(old: np.ndarray, new: np.ndarray, column: np.ndarray, values: np.ndarray) -> np.ndarray:
        out = np.empty(old.size, column.dtype)
        out[old], out[new] = column, values
        return out

    @staticmethod
    def _common(bwt: np.ndarray, low: np.ndarray, grown: np.ndarray, i: np.ndarray, step: int) -> np.ndarray:
        """Common prefix of the suffix grown[i] + its symbol with its neighbour: 0 for another symbol."""
        j = i + step
        inside = (j >= 0) & (j < grown.size)
        out = np.zeros(i.size, np.uint8)
        a, b = grown[i[inside]], grown[j[inside]]
        same = bwt[a] == bwt[b]
        a, b = np.minimum(a, b)[same], np.maximum(a, b)[same]
        if a.size:
            pairs = np.empty(2 * a.size, np.int64)
            pairs[::2], pairs[1::2] = a + 1, b + 1
            out[np.flatnonzero(inside)[same]] = np.minimum.reduceat(low, pairs)[::2] + 1
        return out

    def smallest(self, docs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each string of `length` symbols: its owner, offset from the owner's end (its suffix's size) and the
        smallest docs[owner] among its equals."""
        run = np.cumsum(self.lcp < length) - 1
        long = np.flatnonzero(self.size >= length)
        run, owner = run[long], self.owner[long]
        if not long.size:
            return owner, self.size[long], docs[:0]
        edge = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        least = np.minimum.reduceat(docs[owner], edge)
        return owner, self.size[long], np.repeat(least, np.diff(np.append(edge, run.size)))


def _solve(pieces: list[bytes], docs: list[int], length: int) -> list[list[tuple[int, int, int]]]:
    """Segments and their smallest documents -> per segment [(offset, strings, smallest document that holds them)]."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in pieces]
    if not pieces:
        return out
    owner, size, least = Collection(pieces).smallest(np.array(docs, np.int64), length)
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    offset = lengths[owner] - size
    by = np.lexsort((offset, owner))
    owner, offset, least = owner[by], offset[by], least[by]
    edge = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (least[1:] != least[:-1])])) if owner.size else np.zeros(0, np.int64)
    count = np.diff(np.append(edge, owner.size))
    for o, f, n, d in zip(owner[edge].tolist(), offset[edge].tolist(), count.tolist(), least[edge].tolist(), strict=True):
        out[o].append((f, n, d))
    return out


_PLACE = struct.Struct("<qqi")  # id, hash of the text, offset
_ID_OF_PLACE = struct.Struct("<q12x")
_RANGE = struct.Struct("<ii")
LOST = "id long, _hash long, lost binary"  # lost: pairs of 32-bit start and end


#: (row, key, start, end) of a batch's shared segments, hot ones or others; positions in the bytes of its texts.
Hits = Callable[[pa.RecordBatch, bool], Iterator[tuple[int, int, int, int]]]


def hits_by_bitmap(bits: Callable[[], tuple[np.ndarray, np.ndarray]], log2: int, length: int, gram: int, part: int, parts_log2: int) -> Hits:
    def hits(batch: pa.RecordBatch, hot: bool) -> Iterator[tuple[int, int, int, int]]:
        shared, many = bits()
        data, at = bytes_of(batch.column("_text"))
        for keys, starts, stops in runs_in(data, at, length, gram):
            here, keys = in_slice(keys, part, parts_log2)
            keep = _probe(shared, keys, log2)
            keep[keep] = _probe(many, keys[keep], hot_bits(log2)) == hot
            starts, stops = starts[here][keep], stops[here][keep]
            yield from zip((np.searchsorted(at, starts, "right") - 1).tolist(), keys[keep].view(np.int64).tolist(), starts.tolist(), stops.tolist(), strict=True)

    return hits


def hits_by_column(batch: pa.RecordBatch, hot: bool) -> Iterator[tuple[int, int, int, int]]:
    """From column found: the shared segments of each text."""
    begins = bytes_of(batch.column("_text"))[1].tolist()
    for row, found in enumerate(batch.column("found").to_pylist()):
        for x in found:
            if x["hot"] == hot:
                yield row, x["key"], begins[row] + x["at"], begins[row] + x["at"] + x["strings"]


def _listed(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """A row (key, id, _hash, at, strings) for each segment."""
    for whole in batches:
        for batch in _parts(whole, FILED_BYTES):
            data, at = bytes_of(batch.column("_text"))
            for keys, starts, stops in runs_in(data, at, length, gram):
                rows = np.searchsorted(at, starts, "right") - 1
                cols = (keys.view(np.int64), batch.column("id").to_numpy()[rows], batch.column("_hash").to_numpy()[rows], (starts - at[rows]).astype(np.int32), (stops - starts).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "id", "_hash", "at", "strings"])


def with_shared_segments(docs: DataFrame, length: int, gram: int, hot: int) -> DataFrame:
    """docs (id, _text, _hash) with a column found, its segments whose key another document has; docs without are left out."""
    listed = docs.mapInArrow(lambda it: _listed(it, length, gram), "key long, id long, _hash long, at int, strings int")
    counts = listed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("_lo"), F.max("id").alias("_hi")).filter("_lo < _hi")
    counts = checkpointed(counts.select("key", "n", (F.col("n") >= hot).alias("hot")))
    shared = joined_back(listed, counts, ["key"], "n", "id").filter(F.col("hot").isNotNull())
    found = shared.groupBy("id", "_hash").agg(F.collect_list(F.struct("key", "at", "strings", "hot")).alias("found"))
    return stored(docs.join(found, ["id", "_hash"]).select("id", "_text", "_hash", "found"))


def _file(batches: Iterator[pa.RecordBatch], hits: Hits, length: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, piece, places) of the segments whose key is shared and not hot, equal ones of a batch put together."""
    for whole in batches:
        for batch in _parts(whole, FILED_BYTES):
            ids, hashes = batch.column("id").to_pylist(), batch.column("_hash").to_pylist()
            data, at = bytes_of(batch.column("_text"))
            view, begins, filed = memoryview(data), at.tolist(), {}
            for row, key, a, b in hits(batch, False):
                place = _PLACE.pack(ids[row], hashes[row], a - begins[row])
                at_key = (key, bytes(view[a:b + length - 1]))
                if at_key in filed:
                    filed[at_key] += place
                else:
                    filed[at_key] = bytearray(place)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in filed], pa.int64()), pa.array([p for _, p in filed], pa.binary()), pa.array(map(bytes, filed.values()), pa.binary())], ["key", "piece", "places"])


def _parts(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of text, one row at least."""
    at = bytes_of(batch.column("_text"))[1]
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(at, int(at[begin]) + most, "right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


def _lost(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Filed rows in the order of key and piece -> what each place loses."""
    open_key: list[list] = []  # [piece, places] of the key being read
    group: list[list] = []  # of whole keys with several pieces
    lost: tuple[list[int], list[int], list[bytes]] = ([], [], [])

    def lose(places: bytes, runs: list[tuple[int, int, int]]) -> None:
        for i, h, at in _PLACE.iter_unpack(places):
            gone = b"".join([_RANGE.pack(at + offset, at + offset + strings + length - 1) for offset, strings, least in runs if least < i])
            if gone:
                for column, x in zip(lost, (i, h, gone), strict=True):
                    column.append(x)

    def smallest(places: bytes) -> int:
        return min(_ID_OF_PLACE.iter_unpack(places))[0]

    def close_key() -> None:
        if len(open_key) > 1:
            group.extend(open_key)
        elif open_key and len(open_key[0][1]) > _PLACE.size:
            # one text under this key: the collection would hold a single string
            piece, places = open_key[0]
            lose(places, [(0, len(piece) - length + 1, smallest(places))])
        open_key.clear()

    def solve() -> None:
        solved = _solve([p for p, _ in group], [smallest(places) for _, places in group], length)
        for (_, places), runs in zip(group, solved, strict=True):
            lose(places, runs)
        group.clear()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(lost, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["id", "_hash", "lost"])
        for column in lost:
            column.clear()
        return out

    now = None
    for batch in batches:
        for key, piece, places in zip(*(batch.column(c).to_pylist() for c in ("key", "piece", "places")), strict=True):
            if key != now:
                close_key()
                now = key
                if len(group) >= COLLECTION:
                    solve()
                if len(lost[0]) >= FLUSHED_ROWS:
                    yield flush()
            if open_key and open_key[-1][0] == piece:
                open_key[-1][1] += places
            else:
                open_key.append([piece, bytearray(places)])
    close_key()
    solve()
    yield flush()


def _hot_lost(docs: DataFrame, hits: Hits, only: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], length: int) -> DataFrame:
    """What documents lose by the strings of hot keys: each string is filed under its own hash, without places."""

    def cut(batches: Iterator[pa.RecordBatch], places: bool) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in only(batches):
            ids, hashes = batch.column("id").to_pylist(), batch.column("_hash").to_pylist()
            data, at = bytes_of(batch.column("_text"))
            view, begins = memoryview(data), at.tolist()
            rows: list[tuple] = []
            best: dict[bytes, int] = {}
            for row, _, a, b in hits(batch, True):
                for i in range(a, b):
                    piece = bytes(view[i:i + length])
                    if places:
                        rows.append((xxhash.xxh3_64_intdigest(piece, 7) - (1 << 63), xxhash.xxh3_64_intdigest(piece) - (1 << 63), ids[row], hashes[row], i - begins[row]))
                    else:
                        best[piece] = min(ids[row], best.get(piece, ids[row]))
            if places:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*rows, strict=True)) or [()] * 5], ["key", "seg", "id", "_hash", "at"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_64_intdigest(p, 7) - (1 << 63) for p in best], pa.int64()), pa.array(list(best), pa.binary()), pa.array(list(best.values()), pa.int64())], ["key", "piece", "least"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each string the smallest document; strings of one key that differ go through a collection, like others."""
        import xxhash

        group: dict[bytes, int] = {}
        now, out = None, []

        def close() -> None:
            for piece, runs in zip(group, _solve(list(group), list(group.values()), length) if len(group) > 1 else [[(0, 1, least)] for least in group.values()], strict=True):
                out.append((now, xxhash.xxh3_64_intdigest(piece) - (1 << 63), runs[0][2]))
            group.clear()

        for batch in batches:
            for key, piece, least in zip(*(batch.column(c).to_pylist() for c in ("key", "piece", "least")), strict=True):
                if key != now:
                    close()
                    now = key
                group[piece] = min(least, group.get(piece, least))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*out, strict=True)) or [()] * 3], ["key", "seg", "least"])
            out.clear()
        close()
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*out, strict=True)) or [()] * 3], ["key", "seg", "least"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("at").to_numpy()
            both = np.stack([at, at + length], axis=1).astype("<i4")
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("_hash"), pa.array([x.tobytes() for x in both], pa.binary())], ["id", "_hash", "lost"])

    strings = docs.mapInArrow(lambda it: cut(it, False), "key long, piece binary, least long").repartition("key").sortWithinPartitions("key", "piece")
    least = strings.mapInArrow(solve, "key long, seg long, least long")
    places = docs.mapInArrow(lambda it: cut(it, True), "key long, seg long, id long, _hash long, at long")
    return places.join(least, ["key", "seg"]).filter("least < id").select("id", "_hash", "at").mapInArrow(pack, LOST)


def removed_ranges(docs: DataFrame, length: int, gram: int, hot: int, log2: int, id_log2: int, parts_log2: int | None = 0) -> DataFrame:
    """docs (id, _text, _hash, _place) -> (id, _hash, ranges): merged byte ranges to remove, end exclusive. Without
    parts_log2 shared keys are found by joins, else by bitmaps.

    Of equal texts only the one with the smallest id is searched, as the others lose all of their bytes to it and
    never decide what a third text loses.
    """
    spark = docs.sparkSession
    whole = checkpointed(docs.filter(F.octet_length("_text") >= length).select("id", "_hash", F.unhex(F.sha2(F.col("_text").cast("binary"), 256)).alias("sha"), F.octet_length("_text").alias("n")))
    groups = whole.groupBy("sha").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("k"))

    def all_of_it(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("_hash"), pa.array([np.array([0, n], "<i4").tobytes() for n in batch.column("n").to_pylist()], pa.binary())], ["id", "_hash", "lost"])

    groups = checkpointed(groups)
    copies = joined_back(whole, groups, ["sha"], "k", "id").filter("id > first").select("id", "_hash", "n")
    found = [copies.mapInArrow(all_of_it, LOST)]
    plain = lambda batches: batches

    def searched(docs: DataFrame, hits: Hits, only: Callable, any_hot: bool) -> DataFrame:
        filed = docs.mapInArrow(lambda it: _file(only(it), hits, length), "key long, piece binary, places binary")
        out = filed.repartition("key").sortWithinPartitions("key", "piece").mapInArrow(lambda it: _lost(it, length), LOST)
        return out.unionByName(_hot_lost(docs, hits, only, length)) if any_hot else out

    if parts_log2 is None:
        firsts = groups.select(F.col("first").alias("id")).distinct()
        segments = with_shared_segments(docs.join(firsts, "id", "left_semi"), length, gram, hot)
        any_hot = bool(segments.filter(F.exists("found", lambda x: x["hot"])).limit(1).count())
        found.append(searched(segments, hits_by_column, plain, any_hot))
    else:
        # which ids those are is held in a bitmap; a false hit searches a copy too
        first = spark.sparkContext.broadcast(id_bitmap(groups.select(F.col("first").alias("id")), id_log2))

        def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(_among(batch, np.frombuffer(first.value, np.uint8), id_log2))

        for part in range(1 << parts_log2):
            bitmaps = key_bitmaps(docs, first, length, gram, hot, log2, id_log2, part, parts_log2)
            shared, many = (spark.sparkContext.broadcast(b) for b in bitmaps)

            def bits(shared=shared, many=many) -> tuple[np.ndarray, np.ndarray]:
                return np.frombuffer(shared.value, np.uint8), np.frombuffer(many.value, np.uint8)

            hits = searched(docs, hits_by_bitmap(bits, log2, length, gram, part, parts_log2), only, any(bitmaps[1]))
            found.append(checkpointed(hits) if parts_log2 else hits)
    lost = functools.reduce(DataFrame.unionByName, found).groupBy("id", "_hash").agg(F.collect_list("lost").alias("lost"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [merged_ranges(np.frombuffer(b"".join(parts), "<i4").reshape(-1, 2)).tobytes() for parts in batch.column("lost").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("_hash"), pa.array(out, pa.binary())], ["id", "_hash", "ranges"])

    return lost.mapInArrow(merge, "id long, _hash long, ranges binary")


def merged_ranges(ranges: np.ndarray) -> np.ndarray:
    """Rows of start and end -> the same bytes as sorted ranges that neither overlap nor touch."""
    if len(ranges) < 2:
        return ranges
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    reach = np.maximum.accumulate(ranges[:, 1])
    begins = np.flatnonzero(np.concatenate([[True], ranges[1:, 0] > reach[:-1]]))
    return np.stack([ranges[begins, 0], reach[np.append(begins[1:], len(ranges)) - 1]], axis=1).astype("<i4")


def bitmap_bits(text_bytes: int, bitmap_log2: int) -> tuple[int, int | None]:
    """log2 of a key bitmap's bits, and of the slices of the key space: None where they are too many for bitmaps."""
    wanted = bits_for(text_bytes / BYTES_PER_BIT, 64)
    log2 = min(wanted, bitmap_log2)
    return log2, wanted - log2 if wanted - log2 < SLICES_MOST.bit_length() else None


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT, bitmap_log2: int = BITMAP_LOG2) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, spans (removed runs as byte ranges), kept (the remaining bytes)."""
    if not gram <= length <= 250 - MOST_STRINGS:
        raise ValueError(f"length must be from {gram} to {250 - MOST_STRINGS}")  # prefixes are held in columns of one byte
    if bitmap_log2 < SEGMENT_BITS + 3:
        raise ValueError(f"bitmap_log2 must be at least {SEGMENT_BITS + 3}: a byte for each segment")
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_hash")).withColumn("_place", F.xxhash64("id"))
    volume = slim.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length("_text")), F.lit(0)).alias("bytes")).first()
    id_log2 = bits_for(BITS_PER_ID * volume["rows"], min(bitmap_log2, IDS_LOG2))
    key_log2, parts_log2 = bitmap_bits(volume["bytes"], bitmap_log2)
    ranges = checkpointed(removed_ranges(slim.filter("id IS NOT NULL"), length, gram, hot, key_log2, id_log2, parts_log2))
    # only texts that may lose something are shuffled to meet their ranges
    losing = spark.sparkContext.broadcast(id_bitmap(ranges.select("id"), id_log2))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"

    def split(batches: Iterator[pa.RecordBatch], lose: bool) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(losing.value, np.uint8)
        for batch in batches:
            held = _among(batch, bits, id_log2)
            yield batch.filter(held if lose else pa.compute.invert(held))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, spans, kept = [], [], [], []
            told = batch.column("ranges").to_pylist() if "ranges" in batch.schema.names else [None] * batch.num_rows
            for text, got in zip(batch.column("_text").to_pylist(), told, strict=True):
                data = _raw(text)
                gone = np.frombuffer(got or b"", "<i4").reshape(-1, 2).tolist()
                edges = [0, *(x for r in gone for x in r), len(data)]
                sizes.append(len(data))
                removed.append(sum(b - a for a, b in gone))
                spans.append([{"start": a, "end": b} for a, b in gone])
                kept.append(b"".join(data[edges[i]:edges[i + 1]] for i in range(0, len(edges), 2)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    whole = slim.mapInArrow(lambda it: cut(split(it, False)), schema)
    shape = "id long, _text string, _hash long, _place long"
    cut_down = slim.mapInArrow(lambda it: split(it, True), shape).join(ranges, ["id", "_hash"], "left").select("id", "_text", "ranges").mapInArrow(cut, schema)
    return whole.unionByName(cut_down)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op3_suffix_dedup": op3_suffix_dedup}
ORACLE_SQL: dict[str, str] = {}
