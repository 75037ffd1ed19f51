"""Sources and sinks: delimited text, JSON, file listings, workbooks by conversion, partitioned and split writes."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.text import flat_name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Header row, quoted multi-line cells; empty cells stay empty text, as nothing here tells them from missing."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", None).csv(path)


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document {split: [ids]} as rows (split, sample_id)."""
    doc = spark.read.schema("train array<string>, val array<string>, test array<string>").option("multiLine", True).json(path)
    return doc.select(F.expr("stack(3, 'train', train, 'val', val, 'test', test) AS (split, ids)")).select("split", F.explode("ids").alias("sample_id"))


def write_splits(splits: DataFrame, path: str) -> None:
    """(split, sample_id) as one JSON document per split, ids in order. Splits hold sample ids only."""
    splits.groupBy("split").agg(F.array_sort(F.collect_list("sample_id")).alias("ids")).write.mode("overwrite").json(path)


def write_split_document(splits: DataFrame, path: str) -> None:
    """(split, sample_id) as the one JSON document {split: [ids]} that read_splits() reads, ids in order."""
    splits.groupBy().pivot("split", ["train", "val", "test"]).agg(F.array_sort(F.collect_list("sample_id"))).write.mode("overwrite").json(path)


def read_vocabulary(spark: SparkSession, path: str, blacklist: list[str], most: int = 60) -> DataFrame:
    """count TAB lemma TAB surfaces, as rows (at, count, lemma, surfaces): comments, blanks and blacklisted lemmas out, the
    first `most` in the order of the file. A vocabulary file is a short list and is read as one text."""
    whole = spark.read.option("wholetext", True).text(path)
    lines = whole.select(F.posexplode(F.split("value", "\r?\n")).alias("at", "line")).filter((F.btrim("line") != "") & ~F.startswith("line", F.lit("#")))
    cells = lines.withColumn("c", F.split("line", "\t")).filter(F.size("c") >= 2)
    rows = cells.select("at", F.col("c")[0].try_cast("long").alias("count"), F.btrim(F.col("c")[1]).alias("lemma"), F.coalesce(F.get("c", F.lit(2)), F.lit("")).alias("surfaces"))
    return rows.filter(~F.col("lemma").isin(blacklist) if blacklist else F.lit(True)).orderBy("at").limit(most)


def surface_set(vocabulary: DataFrame, column: str = "surfaces") -> DataFrame:
    """The distinct surfaces of comma-separated cells, lower-cased."""
    return vocabulary.select(F.explode(F.split(column, ",")).alias("s")).select(F.lower(F.btrim("s")).alias("surface")).distinct()


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    """Session number and date (dd-MM-yyyy), header skipped; rows without either are left out."""
    rows = read_csv(spark, path, "n string, written string")
    known = rows.select(F.btrim("n").try_cast("int").alias("n"), F.try_to_date(F.btrim("written"), "dd-MM-yyyy").alias("session_date"))
    return known.dropna()


def read_lookup(spark: SparkSession, paths: list[str], schema: str, key: str) -> DataFrame:
    """Several files of results as one lookup: one row for each key, the last file's, and its last row's."""
    place = {path: i for i, path in enumerate(paths)}
    parts = [read_csv(spark, path, schema).withColumns({"_file": F.lit(i), "_at": F.monotonically_increasing_id()}) for path, i in place.items()]
    rows = functools.reduce(DataFrame.unionByName, parts)
    last = rows.groupBy(key).agg(F.max_by(F.struct(*(c for c in rows.columns if not c.startswith("_") and c != key)), F.struct("_file", "_at")).alias("_l"))
    return last.select(key, "_l.*")


def list_images(spark: SparkSession, root: str, pattern: str = "*.bmp") -> DataFrame:
    """Paths and sizes below root; the content column is pruned and never read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "length", "modificationTime")


def read_labelled(spark: SparkSession, glob: str, schema: str, root: str) -> DataFrame:
    """CSV files below root with a label: the file's folder relative to root."""
    rows = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).csv(glob)
    path = F.col("_metadata.file_path")
    return rows.select("*", F.regexp_extract(path, ".*" + root.strip("/") + "/(.*)/[^/]*$", 1).alias("file"))


def workbook_rows(spark: SparkSession, sheets: dict[str, list[tuple]], columns: list[str], known: dict[str, str]) -> DataFrame:
    """Sheets of a workbook read elsewhere (name -> rows): unknown names are skipped, rows padded and cut to columns."""
    out, width = None, len(columns)
    for name, rows in sheets.items():
        attribute = known.get(name.strip().lower())
        if attribute is None:
            continue
        cells = [tuple(None if x is None else str(x) for x in (tuple(r) + (None,) * width)[:width]) for r in rows]
        part = spark.createDataFrame(cells, T.StructType([T.StructField(c, T.StringType()) for c in columns])).withColumn("attribute", F.lit(attribute))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def codebook_keys(codes: DataFrame) -> DataFrame:
    """dairy TN_302 is also found as TN302 and 302."""
    return codes.select(F.explode(F.array("dairy", F.replace("dairy", F.lit("_"), F.lit("")), F.substring("dairy", 4, 10))).alias("key"), "code").distinct()


def write_by_attribute(df: DataFrame, path: str, column: str = "attribute") -> None:
    """One folder per attribute, blanks as underscores."""
    df.withColumn("attribute_slug", F.replace(F.col(column), F.lit(" "), F.lit("_"))).write.mode("overwrite").partitionBy("attribute_slug").parquet(path)


def write_kept_and_dropped(df: DataFrame, path: str, reason: str = "drop_reason") -> None:
    """One pass, two outcomes: partitions by the reason, 'kept' where it is null."""
    df.withColumn("outcome", F.coalesce(reason, F.lit("kept"))).write.mode("overwrite").partitionBy("outcome").parquet(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Columns in a fixed order, header, quotes doubled within quotes."""
    df.select(*columns).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON document per row; nulls are written, so that every document has all keys."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def deliverable(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The columns of a deliverable: name in df -> name in the file."""
    return df.select(*(F.col(old).alias(new) for old, new in columns.items()))


def rewrite_in_place(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame]) -> None:
    """Write the changed table beside path, then swap. At every moment the table or its former state is at path or at
    path.old, and a swap that broke off is put right first; a table is never overwritten while it is read."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    here, new, old = jvm(path), jvm(path + ".new"), jvm(path + ".old")
    fs = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(here) and fs.exists(old):
        fs.rename(old, here)
    fs.delete(old, True)
    change(spark.read.parquet(path)).write.mode("overwrite").parquet(path + ".new")
    if not (fs.rename(here, old) and fs.rename(new, here)):
        raise OSError(f"could not put {path}.new in the place of {path}")
    fs.delete(old, True)


def name_clashes(df: DataFrame, path_col: str) -> DataFrame:
    """Flat names (folders joined by __) that more than one path would take."""
    return df.groupBy(flat_name(F.col(path_col)).alias("flat")).agg(F.count_distinct(path_col).alias("n")).filter("n > 1")


def assert_unique_names(df: DataFrame, path_col: str) -> None:
    clashes = [r["flat"] for r in name_clashes(df, path_col).orderBy("flat").limit(5).collect()]
    if clashes:
        raise ValueError(f"several paths take one name: {', '.join(clashes)}")


def missing_uploads(local: DataFrame, target: DataFrame, name: str, size: str) -> DataFrame:
    """(name, size, why) of the local files that the target listing does not have whole: absent, or of another size. Of
    a name that the target lists twice any listing of the right size will do."""
    there = target.groupBy(F.col(name).alias("_name")).agg(F.collect_set(size).alias("_sizes"))
    met = local.join(there, F.col(name) == F.col("_name"), "left")
    why = F.when(F.col("_sizes").isNull(), "absent").when(~F.array_contains("_sizes", F.col(size)), "size")
    return met.select(name, size, why.alias("why")).filter("why IS NOT NULL")


def report(title: str, tables: dict[str, DataFrame], most: int = 50) -> str:
    """A text report: each table's first `most` rows, aligned, and a line that says how many more there are. Tables are
    to be aggregates; no more than most + 1 of their rows come to the driver."""
    out = [title, "=" * len(title)]
    for name, df in tables.items():
        rows = [[("" if v is None else str(v)) for v in row] for row in df.limit(most + 1).collect()]
        shown = [df.columns, *rows[:most]]
        widths = [max(len(r[i]) for r in shown) for i in range(len(df.columns))]
        out += ["", name, "-" * len(name), *("  ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip() for r in shown)]
        if len(rows) > most:
            out.append(f"... and {df.count() - most} more")
    return "\n".join(out) + "\n"


def write_lines(lines: DataFrame, path: str) -> None:
    """(section, at, line) of a report as one text file below path: each section's name, then its lines in order. A
    report is aggregates; its lines are few."""
    sections = lines.select("section", F.lit(-1).cast("long").alias("at"), F.concat(F.lit("\n## "), "section").alias("line")).distinct()
    lines.unionByName(sections).coalesce(1).sortWithinPartitions("section", "at").select("line").write.mode("overwrite").text(path)


def write_texts(spark: SparkSession, texts: DataFrame, path: str, name_col: str, text_col: str) -> None:
    """One folder for each name with its text as a single file, such as prompts in Markdown."""
    texts.select(F.col(name_col).alias("name"), F.col(text_col).alias("value")).repartition("name").write.mode("overwrite").partitionBy("name").option("lineSep", "\n").text(path)
