"""Secret scans over an incremental blob ledger.

Every text is a blob named by the sha256 of its UTF-8 bytes. A ledger row says of a blob which rules, each at its
version, have been scanned for, and what they found; so the ledger is a set of (blob, rule version) pairs, written one
row for each blob and scan. A scan content-addresses the given versions, finds for each blob the rules whose present
version the ledger does not have (all rules of a new blob; one, if one rule has changed), scans one copy of each such
blob for these, appends to the ledger, and joins what the ledger then holds for the present rules back to every path
of the blob. Findings of older versions of a rule no longer count. Without a ledger path the ledger begins empty in the
checkpoint folder.

Which copy of a blob is scanned is decided on ids and digests alone, so a text held by a third of all rows is
scanned once; its findings are broadcast to its copies, which no task gathers.

Null text is the empty blob. Repeated rows give repeated rows. Rows with a null id are scanned and answered like
others. Extra columns are ignored. A blob is scanned whole; every rule takes time in proportion to it.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, ensure_checkpoint_dir, joined_back, read_table


@dataclass(frozen=True)
class Rule:
    """version changes with the rule, so that old ledger rows no longer count; least: length of the tested group."""

    kind: str
    version: int
    pattern: str
    least: int = 1
    group: int = 0
    fold: bool = False


#: The three base kinds come first, in this order.
RULES = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", 24),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", 2, r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]+"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----"),
)
FINDING = "array<struct<kind:string,start:long,end:long>>"
LEDGER = "blob binary, rules array<string>, findings array<struct<rule:string,start:long,end:long>>"


def find(text: str, rules: tuple[Rule, ...] = RULES, compiled: list[re.Pattern] | None = None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, sorted by start, then by the rules' order, then by end."""
    compiled = compiled or compile_rules(rules)
    out = []
    for i, (rule, regex) in enumerate(zip(rules, compiled, strict=True)):
        for m in regex.finditer(text):
            if len(m[rule.group]) >= rule.least:
                out.append((m.start(), i, m.end()))
    return [(rules[i].kind, a, b) for a, i, b in sorted(out)]


def compile_rules(rules: tuple[Rule, ...]) -> list[re.Pattern]:
    return [re.compile(r.pattern, re.A | (re.I if r.fold else 0)) for r in rules]


def rule_version(rule: Rule) -> str:
    return f"{rule.kind}@{rule.version}"


def _scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, rules, _text) -> ledger rows: each blob is scanned for its own rules."""
    kind = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = {rule_version(r): (r, c) for r, c in zip(rules, compile_rules(rules), strict=True)}
        version = {r.kind: v for v, (r, _) in compiled.items()}
        for batch in batches:
            found = []
            for text, wanted in zip(batch.column("_text").to_pylist(), batch.column("rules").to_pylist(), strict=True):
                some = [compiled[v] for v in wanted]
                found.append([{"rule": version[k], "start": a, "end": b} for k, a, b in find(text, tuple(r for r, _ in some), [c for _, c in some])])
            yield pa.RecordBatch.from_arrays([batch.column("blob"), batch.column("rules"), pa.array(found, kind)], ["blob", "rules", "findings"])

    return blobs.select("blob", "rules", "_text").mapInArrow(scan, LEDGER)


def ledger_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, ledger_path: str | None = None) -> DataFrame:
    """Per row: doc_id, blob, findings (array of kind, start, end). What is new is appended to the ledger at ledger_path."""
    spark = docs.sparkSession
    if not ledger_path:
        ensure_checkpoint_dir(spark)
        ledger_path = f"{spark.sparkContext.getCheckpointDir()}/ledger-{uuid.uuid4().hex}"
    text = F.coalesce(F.col(text_col), F.lit(""))
    paths = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("blob"))
    blobs = checkpointed(paths.groupBy("blob").agg(F.min("doc_id").alias("_doc"), F.count(F.lit(1)).alias("n")))
    present = F.array(*(F.lit(rule_version(r)) for r in rules))
    unseen = blobs.select("blob", "_doc", present.alias("rules"))
    if _exists(spark, ledger_path):
        known = spark.read.schema(LEDGER).parquet(ledger_path).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list(F.array_intersect("rules", present)))).alias("_known"))
        unseen = unseen.join(known, "blob", "left").withColumn("rules", F.array_except("rules", F.coalesce("_known", F.array().cast("array<string>")))).filter(F.size("rules") > 0)
    wanted = unseen.select(F.col("blob").alias("_blob"), "_doc", "rules")
    same = (F.col("blob") == F.col("_blob")) & F.col("doc_id").eqNullSafe(F.col("_doc"))
    # rows that repeat a blob's id are scanned again and say the same
    _scan_blobs(paths.join(wanted, same), rules).write.mode("append").parquet(ledger_path)
    rank = F.create_map(*(F.lit(x) for i, r in enumerate(rules) for x in (rule_version(r), i)))
    kinds = F.create_map(*(F.lit(x) for r in rules for x in (rule_version(r), r.kind)))
    told = spark.read.schema(LEDGER).parquet(ledger_path).select("blob", F.filter("findings", lambda x: F.array_contains(present, x["rule"])).alias("f")).filter(F.size("f") > 0)
    ordered = F.array_sort(F.array_distinct(F.transform(F.flatten(F.collect_list("f")), lambda x: F.struct(x["start"].alias("start"), F.try_element_at(rank, x["rule"]).alias("rank"), x["end"].alias("end"), x["rule"].alias("rule")))))
    findings = told.groupBy("blob").agg(ordered.alias("f")).select("blob", F.transform("f", lambda x: F.struct(F.try_element_at(kinds, x["rule"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("findings"))
    every = checkpointed(findings.join(blobs.select("blob", "n"), "blob"))
    out = joined_back(paths.select("doc_id", "blob"), every, ["blob"], "n", "doc_id")
    return out.select("doc_id", F.lower(F.hex("blob")).alias("blob"), F.coalesce("findings", F.array().cast(FINDING)).alias("findings"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _joined(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ledger_scan(read_table(spark, sf_dir, "documents"))
    base = ("assign", "access", "hex")
    count = lambda k: F.size(F.filter("findings", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *(count(k) for k in base),
        F.sha2(_joined(F.filter("findings", lambda x: x["kind"].isin(*base))).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("findings")).alias("spans"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op4_secret_scan": op4_secret_scan}
ORACLE_SQL: dict[str, str] = {}
