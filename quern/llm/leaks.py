"""Benchmark decontamination: one Aho-Corasick automaton over the normalised test questions and answers.

A window is `window` consecutive words of an item (an item of fewer words, but not none, is one window). The windows,
each between spaces, are the automaton's patterns; every document is normalised the same way and scanned once. A match
at a character of the normalised text gives word numbers, and those give character offsets in the original text.

A benchmark is dealt into blocks of items with at most automaton_bytes of pattern text (one item at least). The items
of one block at a time are read, broadcast and made an automaton, in one pass over the documents each; what the passes
but the last find is stored, and the last one unites it. So neither the driver nor a task holds more than two blocks'
items and one automaton, however large the benchmark; a benchmark of one block is one pass without a shuffle.

Null text has no words; an item or document without words matches nothing. Repeated rows give repeated rows. Item
ids repeated in the benchmark count once; the words of an item with a null id are hit, but it is not among the items. A
very long text is scanned once, whole. Extra columns, of either table and of any name, are ignored unless named in carry.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import checkpointed, joined_back, read_table, stored

WINDOW = 10
AUTOMATON_BYTES = 4 << 20
#: Words are runs of ASCII letters and digits and of anything beyond ASCII; the rest of ASCII separates.
_SEPARATORS = bytes(range(0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80))
_LOWER_AND_SPLIT = bytes(
    x + 32 if 65 <= x <= 90 else 32 if x in _SEPARATORS and not 65 <= x <= 90 else x for x in range(256)
)
_WORD = re.compile(rb"[^ ]+")


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER_AND_SPLIT).split()


def named(items: set) -> list[str]:
    """Item ids as text, sorted; a null id has no name."""
    return sorted(str(i) for i in items if i is not None)


def item_windows(text: str | None, window: int) -> list[str]:
    words = [w.decode("latin-1") for w in words_of(text)]
    if not words:
        return []
    return [f" {' '.join(words[i:i + window])} " for i in range(max(1, len(words) - window + 1))]


def united_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching ranges, end exclusive, made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class Automaton:
    """Patterns are byte strings held as latin-1 text, so that offsets are byte offsets."""

    def __init__(self, items: list[tuple[object, str | None]], window: int):
        import ahocorasick

        self.machine, self.items = ahocorasick.Automaton(), {}
        for item, text in items:
            for p in item_windows(text, window):
                self.items.setdefault(p, set()).add(item)
        for p in self.items:
            self.machine.add_word(p, p)
        if self.items:
            self.machine.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set]:
        """Number of words, hit word ranges (merged, end exclusive) and the items that occur."""
        words = words_of(text)
        if not words or not self.items:
            return len(words), [], set()
        flat = b" " + b" ".join(words) + b" "
        found, ranges, spaces, seen = set(), [], 0, 0
        for end, p in self.machine.iter(flat.decode("latin-1")):
            spaces += flat.count(b" ", seen, end + 1)  # matches come in the order of their ends
            seen = end + 1
            found |= self.items[p]
            ranges.append((spaces - p.count(" "), spaces - 1))
        return len(words), united_ranges(ranges), found


def _char_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as code point offsets of the original text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = [m.span() for m in _WORD.finditer(raw.translate(_LOWER_AND_SPLIT))]
    begun = np.concatenate([[0], np.cumsum(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80)])  # code points before a byte
    return [(int(begun[words[a][0]]), int(begun[words[b - 1][1]])) for a, b in ranges]


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[list[tuple[object, str]]]:
    """Items in blocks of at most `most` bytes of text (one item at least); one block is held at a time."""
    block: list[tuple[object, str]] = []
    size = 0
    for row in benchmark.select(id_col, text_col).toLocalIterator():
        n = len((row[1] or "").encode("utf-8", "surrogatepass"))
        if block and size + n > most:
            yield block
            block, size = [], 0
        size += n
        block.append((row[0], row[1]))
    yield block


class _Scanner:
    """Word counts, hit word ranges and items of a batch's texts."""

    def __init__(self, shared, window: int):
        self.machine = Automaton(shared.value, window)

    def __call__(self, texts: pa.Array) -> Iterator[tuple[str | None, int, list[tuple[int, int]], set]]:
        for text in texts.to_pylist():
            yield text, *self.machine.scan(text)


def leak_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    automaton_bytes: int = AUTOMATON_BYTES,
    carry: list[str] | None = None,
) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, items (list of the ids as text, sorted), spans (hit code point ranges), carry
    (a struct of the columns it names)."""
    spark = docs.sparkSession
    carried = F.struct(*(F.col(f"`{c}`") for c in carry)) if carry else F.lit(None).cast("int")
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), carried.alias("carry"))
    word_ranges, names = "array<struct<start:int,end:int>>", "array<string>"
    found = "_hash string, _n int, _ranges array<struct<start:int,end:int>>, _items array<string>"

    def hits(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
        scanner = _Scanner(shared, window)
        for batch in batches:
            rows = [(h, n, [{"start": a, "end": b} for a, b in ranges], named(ids)) for h, (_, n, ranges, ids) in zip(batch.column("_hash").to_pylist(), scanner(batch.column("_text")), strict=True) if ranges]
            types = [pa.string(), pa.int32(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 4, types, strict=True)], ["_hash", "_n", "_ranges", "_items"])

    # windows repeat each word `window` times, so a block's pattern text is at most `window` times the item text
    blocks = benchmark_blocks(benchmark, item_col, item_text_col, max(1, automaton_bytes // (window + 1)))
    block, earlier = next(blocks), None
    for following in blocks:
        shared = spark.sparkContext.broadcast(block)
        part = stored(slim.select(F.sha2(F.col("_text").cast("binary"), 256).alias("_hash"), "_text").mapInArrow(lambda it, shared=shared: hits(it, shared), found))
        shared.destroy()
        earlier, block = part if earlier is None else earlier.unionByName(part), following
    shared = spark.sparkContext.broadcast(block)
    if earlier is None:
        slim = slim.withColumns({"_ranges": F.lit(None).cast(word_ranges), "_items": F.lit(None).cast(names)})
    else:
        united = earlier.groupBy("_hash").agg(F.flatten(F.collect_set("_ranges")).alias("_ranges"), F.array_distinct(F.flatten(F.collect_set("_items"))).alias("_items"), F.count(F.lit(1)).alias("_copies"))
        keyed = slim.withColumn("_hash", F.sha2(F.col("_text").cast("binary"), 256))
        slim = joined_back(keyed, checkpointed(united), ["_hash"], "_copies", "doc_id").drop("_hash", "_copies")
    slim = slim.select("doc_id", "_text", "carry", "_ranges", "_items")
    schema = slim.select("doc_id", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.array(F.lit("")).alias("items"), F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"))).alias("spans"), "carry").schema
    arrow = to_arrow_schema(schema, timestamp_utc=True)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _Scanner(shared, window)
        for batch in batches:
            counts, all_hits, items, spans = [], [], [], []
            for (text, n, ranges, ids), more, others in zip(scanner(batch.column("_text")), batch.column("_ranges").to_pylist(), batch.column("_items").to_pylist(), strict=True):
                merged = united_ranges(ranges + [(r["start"], r["end"]) for r in more or []])
                counts.append(n)
                all_hits.append(sum(b - a for a, b in merged))
                items.append(sorted({*named(ids), *(others or [])}))
                spans.append([{"start": a, "end": b} for a, b in _char_spans(text, merged)] if merged else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(arrow.field("doc_id").type), pa.array(counts, pa.int64()), pa.array(all_hits, pa.int64()), pa.array(items, arrow.field("items").type), pa.array(spans, arrow.field("spans").type), batch.column("carry").cast(arrow.field("carry").type)],
                schema=arrow,
            )

    return slim.mapInArrow(scan, schema)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leak_hits(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op6_decontaminate": op6_decontaminate}
_WORDS = "list_filter(regexp_split_to_array(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
ORACLE_SQL = {
    "op6_decontaminate": f"""
        WITH item AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark),
        win AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i + 1:i + 10], ' ') AS p
            FROM item, unnest(range(greatest(len(w) - 9, 1))) AS u(i) WHERE len(w) > 0
        ),
        doc AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
        pos AS (SELECT doc_id, w, unnest(range(len(w))) AS i FROM doc),
        lens AS (SELECT DISTINCT n FROM win),
        occ AS (
            SELECT pos.doc_id, pos.i, win.n, win.item_id FROM pos
            JOIN lens ON pos.i + lens.n <= len(pos.w)
            JOIN win ON win.n = lens.n AND win.p = array_to_string(pos.w[pos.i + 1:pos.i + lens.n], ' ')
        ),
        hit AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM occ, unnest(range(n)) AS u(k) GROUP BY doc_id),
        its AS (
            SELECT doc_id, count(s) AS n_items, string_agg(s, ',' ORDER BY s) AS items
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM occ) GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)""",
}
