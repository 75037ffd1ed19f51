"""Exact dedup by deterministic block naming; DataFrame functions only.

Texts are cut into blocks of a fixed number of characters. Equal blocks get one integer name: rows are brought
together and sorted by their content, and every block takes the smallest block id of its run. Then adjacent names are
paired and the pairs named the same way, level by level, until each document has a single name. Names come from
comparing contents, never from a hash, so two documents share (levels, name) exactly when their texts are equal.

The HOT_KEYS most frequent contents are dealt over SALTS tasks first; the smallest block of each content and task,
HOT_KEYS * SALTS at most, is then named by its content in a second step. Any other content has less than one in
HOT_KEYS of the rows. So a third of all rows may be one text. Hashes only decide where rows are sent, not what they
are called.

Null text counts as empty. Repeated rows are members of one group like any other copies and one of them is kept.
Rows with a null id are members too, and are kept only where a group has no other. An empty table gives an empty
result. Other columns of the input are ignored, whatever their names. The input should be a table, or another plan
whose rows come in one order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, checkpointed, joined_back, read_table

BLOCK_CHARS = 2048
HOT_KEYS, HOT_ROWS = 999, 64
SALTS = 256


def _named(rows: DataFrame, key: Column, keep: list[str]) -> DataFrame:
    """keep and _name: the smallest _id among the rows with an equal key."""
    keyed = rows.withColumn("_key", key)
    often = keyed.groupBy(F.xxhash64("_key").alias("_hash")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= HOT_ROWS)
    hot = [r["_hash"] for r in often.orderBy(F.desc("_n"), "_hash").limit(HOT_KEYS).collect()]
    salt = F.when(F.xxhash64("_key").isin(hot), F.pmod(F.xxhash64("_id"), F.lit(SALTS))) if hot else F.lit(None).cast("long")
    salted = keyed.withColumn("_salt", salt)
    local = salted.withColumn("_local", F.min("_id").over(Window.partitionBy("_key", "_salt")))
    stands = F.when(F.col("_salt").isNotNull() & (F.col("_id") == F.col("_local")), F.col("_key"))
    named = checkpointed(local.select(*keep, F.col("_local").alias("_name"), stands.alias("_stands")))
    if not hot:
        return named.drop("_stands")
    apart = named.filter(F.col("_stands").isNotNull()).select(F.col("_name").alias("_from"), "_stands")
    first = apart.groupBy("_stands").agg(F.min("_from").alias("_to"))
    again = apart.join(first, "_stands").filter("_from <> _to").select("_from", "_to")  # HOT_KEYS * SALTS rows at most
    return named.join(F.broadcast(again), F.col("_name") == F.col("_from"), "left").select(*keep, F.coalesce("_to", "_name").alias("_name"))


def name_documents(docs: DataFrame, text: Column, carry: list[Column], block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per input row: _row (unique long), carry, _levels and _name; equal (_levels, _name) means equal texts."""
    wide = docs.select(*carry, text.alias("_text"), F.monotonically_increasing_id().alias("_row"))
    carried = [c for c in wide.columns if c not in ("_text", "_row")]
    cut = F.when(F.length("_text") <= block_chars, F.array("_text")).otherwise(F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0)))
    blocks = wide.select(*carried, "_row", cut.alias("_cut")).select(*carried, "_row", F.size("_cut").alias("_n"), F.posexplode("_cut").alias("_pos", "_block"))
    # a document's first block carries what goes with the document
    blocks = blocks.select(*(F.when(F.col("_pos") == 0, F.col(c)).alias(c) for c in carried), "_row", "_n", "_pos", "_block", F.monotonically_increasing_id().alias("_id"))
    rest = [*carried, "_row", "_n", "_pos", "_id"]
    named = _named(blocks, F.col("_block"), rest)
    most = named.agg(F.max("_n").alias("m")).first()["m"] or 1
    pick = lambda level: named.filter("_n = 1").select("_row", *carried, F.lit(level).alias("_levels"), "_name")
    done, level = pick(0), 0
    while most > 1:
        level, most = level + 1, -(-most // 2)
        odd = F.col("_pos") % 2 == 1
        pairs = (
            named.filter("_n > 1")
            .groupBy("_row", F.floor(F.col("_pos") / 2).cast("int").alias("_pos"))
            .agg(
                *(F.max(c).alias(c) for c in carried),
                F.ceil(F.first("_n") / 2).cast("int").alias("_n"),
                F.min("_id").alias("_id"),
                F.max(F.when(~odd, F.col("_name"))).alias("_a"),
                F.coalesce(F.max(F.when(odd, F.col("_name"))), F.lit(-1)).alias("_b"),
            )
        )
        named = _named(pairs, F.struct("_a", "_b"), rest)
        done = done.unionByName(pick(level))
    return done


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, carry: list[str] | None = None) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept and text_sha256 of the normalised text (A-Z lower-cased), carry (a
    struct of the columns it names, of kept rows only)."""
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    ids = [F.col(id_col).alias("_doc"), F.sha2(norm.cast("binary"), 256).alias("_sha")]
    named = name_documents(docs, norm, ids, block_chars)
    groups = checkpointed(named.groupBy("_levels", "_name").agg(F.max(F.struct("_doc", "_row")).alias("_best"), F.count(F.lit(1)).alias("group_size")))
    out = joined_back(named, groups, ["_levels", "_name"], "group_size", "_row").select(
        F.col("_doc").alias("doc_id"),
        F.col("_best._doc").alias("keep_id"),
        "group_size",
        (F.col("_row") == F.col("_best._row")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )
    if not carry:
        return out
    rows = docs.select(F.col(id_col).alias("_doc"), F.sha2(norm.cast("binary"), 256).alias("_text_sha"), F.struct(*(F.col(f"`{c}`") for c in carry)).alias("carry"))
    # a kept row is known by its id and text; any of its repetitions may stand for it
    one = out.filter("kept").join(rows, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_sha256") == F.col("_text_sha")))
    return one.dropDuplicates(["doc_id", "text_sha256"]).drop("_doc", "_text_sha")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op2_exact_dedup": op2_exact_dedup}

ORACLE_SQL = {
    "op2_exact_dedup": """
        WITH n AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
            FROM documents
        )
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM n""",
}
