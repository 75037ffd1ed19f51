"""Short notes made of the tables: one for each document, of a kind that some rule looks for. Tables and SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import fixed
from quern.functions.text import SPACES
from quern.sources.io import table

#: {} stands for the document's source.
NOTES = [
    "", "   ", "n/a", "N/A ", "na.", "non penalizzo {}", "Non valuto", "---", " ..;", "x", "?", "ok", "Bella", "buono.", "10", "0,8", "1 2 3", "1 2 3 4",
    "10 mm", "Valutazione alle 13:40", "al primo tentativo di {} il test", "si e' chiuso il test", "Peccato!", "non lo so", "ho dovuto sputarla",
    "Forse buono?", "sembra {}", "ma {}", "intenso", "non so come", "non so dire {}", "il voto troppo alto", "{} bello e strano", "!!!", "un po' di {} 3 %",
    "xe bon  comunque", "sa di {} ☃ …", "non-descritto {}", "crosta sottile {}", "macchie, fini! {}",
]
ATTRIBUTES = ["Profumo", "Aroma", "Sapore", "Texture", "Spessore della Crosta", "Struttura della Pasta", "Colore della Pasta"]
#: An opening for each attribute; some documents have another, which fits one attribute or none.
OPENINGS = ["Note olfattive di ", "Note di ", "Al palato, ", "Texture dalla ", "Crosta con ", "Pasta con ", "Pasta dal colore "]
OTHERS = ["", "", "", "Altro: ", "Note aromatiche "]


def quoted(values: list[str]) -> str:
    return "[" + ", ".join("'{}'".format(v.replace("'", "''")) for v in values) + "]"


def alternation(patterns: list[str]) -> str:
    """Patterns as one of the oracle's dialect, without case."""
    return ("(?i)" + "|".join(f"(?:{p})" for p in patterns)).replace("'", "''")


NOTES_SQL = f"notes AS (SELECT doc_id, lang, replace({quoted(NOTES)}[doc_id % {len(NOTES)} + 1], '{{}}', source) AS line FROM documents)"
#: Captions: an opening and the whole text in one line, by attribute.
CAPTIONS_SQL = f"""captions AS (
    SELECT doc_id, {quoted(ATTRIBUTES)}[doc_id % {len(ATTRIBUTES)} + 1] AS attribute,
           coalesce(nullif({quoted(OTHERS)}[doc_id % {len(OTHERS)} + 1], ''), {quoted(OPENINGS)}[doc_id % {len(OPENINGS)} + 1]) || lower(trim(regexp_replace(coalesce(text, ''), '{fixed.SPACE}+', ' ', 'g'), ' ')) || CASE WHEN doc_id % 3 = 0 THEN '.' ELSE '' END AS caption FROM documents)"""


def pick(values: list[str]):
    return F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % len(values) + 1).cast("int"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.replace(pick(NOTES), F.lit("{}"), F.col("source")).alias("line"))


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.lower(F.btrim(F.regexp_replace(F.coalesce("text", F.lit("")), SPACES, " ")))
    stop = F.when(F.col("doc_id") % 3 == 0, ".").otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", pick(ATTRIBUTES).alias("attribute"), F.concat(F.coalesce(F.nullif(pick(OTHERS), F.lit("")), pick(OPENINGS)), words, stop).alias("caption"))
