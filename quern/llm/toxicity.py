"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols (insult, threat, target, negation, report, clause end, other). Three transducers over symbols are
composed into one deterministic machine: negation rewrites what follows it within NEG_SCOPE words, reported speech
rewrites what follows a report verb in the clause, and target marks what shares a clause with a second person, before or
after it. The machine is run over each clause; each matched pattern adds its word's weight, times the weight of its
output symbol, to the clause's score, and a logistic model turns the clauses' scores, their sum and the heaviest one,
into the text's score. A targeted pattern weighs at least as much as a plain one, that at least as much as a reported
one, and that at least as much as a negated one: each lies in a range of its own (RANGES), in which its value is fitted.

The lexicon is learned: word beginnings (and whole words) whose lower confidence bound of the log odds of the label is
high. An entry that toxic texts mostly have before a second person is a threat, any other an insult. The threat verbs
that are given besides weigh as much as the median entry, less the more clean texts have them. Lexicon and weights are
fitted on at most FIT_ROWS labelled rows, drawn by a hash of the id from those whose crc32 remainder is not held out:
FOLDS lexicons are learned, each without one fold of the rows, which it then measures, so that every row counts for both.
The rows' texts bound the lexicon. Every row is scored, whole. Only the text enters a score.

Null and empty texts get the score of a text without any match; a very long text is read once, clause by clause. Without
labelled rows, or with one class alone, all rows get the smoothed share of label 1. Rows labelled twice count by their
larger label; null labels, and labels other than 0 and 1, do not count. Of rows that share an id one text, the least, is
fitted on, and of near copies one row, with a weight. Repeated rows are scored each. Extra columns are ignored unless named in carry, which may name any column.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import crc_mod, read_table

FIT_ROWS = 20_000
FOLDS = 5
NEG_SCOPE = 3
THRESHOLD = 0.7
#: A toxic row counts so often in the logistic fit: missing it is worse than rejecting a clean one.
MISS_COST = 2.0
PREFIXES = range(3, 11)
#: Python holds so many counts, remembered words and rows at once, whatever a batch has; beyond that it hands on or begins anew.
HELD_COUNTS, HELD_WORDS, HELD_ROWS = 100_000, 60_000, 64
#: The least bound of an entry's log odds, and the toxic documents that have it.
LEAST_BOUND, LEAST_TOXIC = 2.5, 3
#: Toxic documents a lexicon entry must have for each clean one.
PRECISE = 3

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, STOP = "o", "i", "h", "y", "n", "r", "."
#: Function words of the grammar, in four languages.
TARGETS = "you your yours yourself ye u du dich dir dein deine ihr euch euer tu te toi vous votre vos ti tú usted ustedes vosotros".split()
NEGATIONS = "not never nobody isn aren wasn don doesn nicht kein keine keinen niemals nie jamais pas aucun nunca jamás ningún tampoco".split()
REPORTS = "said says say saying called calls wrote writes quoted claims claimed alleged reported sagte sagt schrieb nannte dit disait écrit appelle dijo dice llamó escribió".split()
THREATS = "kill killing murder hurt destroy beat stab shoot burn töten umbringen schlagen tuer frapper matar golpear".split()

_TOKEN = re.compile(r"[^\W\d_]+|[.!?;\n]")


@dataclass(frozen=True)
class Transducer:
    """Deterministic: arcs maps (state, input) to (next state, output); an input without an arc passes unchanged."""

    start: object
    arcs: dict[tuple[object, str], tuple[object, str]]
    states: frozenset

    def step(self, state: object, symbol: str) -> tuple[object, str]:
        return self.arcs.get((state, symbol), (state, symbol))


def compose(a: Transducer, b: Transducer, alphabet: str) -> Transducer:
    """What a writes is read by b; only reachable pairs of states are built."""
    start, arcs, todo = (a.start, b.start), {}, [(a.start, b.start)]
    seen = {start}
    while todo:
        p, q = state = todo.pop()
        for symbol in alphabet:
            p2, middle = a.step(p, symbol)
            q2, out = b.step(q, middle)
            arcs[state, symbol] = ((p2, q2), out)
            if (p2, q2) not in seen:
                seen.add((p2, q2))
                todo.append((p2, q2))
    return Transducer(start, arcs, frozenset(seen))


def negation(scope: int = NEG_SCOPE) -> Transducer:
    """State k > 0: k words of scope are left. Outputs I and H for a negated insult or threat."""
    arcs: dict = {}
    for k in range(scope + 1):
        for s in (OTHER, TARGET, REPORT, INSULT, THREAT):
            arcs[k, s] = (max(0, k - 1), s.upper() if k and s in (INSULT, THREAT) else s)
        arcs[k, NEGATION], arcs[k, STOP] = (scope, OTHER), (0, STOP)
    return Transducer(0, arcs, frozenset(range(scope + 1)))


def reported() -> Transducer:
    """After a report verb, up to the clause's end: j and k for what was i and h. What is negated stays so."""
    arcs = {(0, REPORT): (1, OTHER), (1, REPORT): (1, OTHER), (1, STOP): (0, STOP), (1, INSULT): (1, "j"), (1, THREAT): (1, "k")}
    return Transducer(0, arcs, frozenset({0, 1}))


def target() -> Transducer:
    """After a second person in the clause: a for an insult, b for a threat. The first second person comes out as y,
    which makes what came before it in the clause a and b."""
    arcs = {(0, TARGET): (1, TARGET), (1, TARGET): (1, OTHER), (1, STOP): (0, STOP), (1, INSULT): (1, "a"), (1, THREAT): (1, "b")}
    return Transducer(0, arcs, frozenset({0, 1}))


ALPHABET = OTHER + INSULT + THREAT + TARGET + NEGATION + REPORT + STOP
AIMED = {INSULT: "a", THREAT: "b"}
UNKNOWN = (OTHER, 0.0)
#: Output symbols that score: targeted, plain, reported and negated insults, then threats.
SCORED = "aijIbhkH"
#: Between which values the weight of a targeted, reported and negated pattern is fitted; a plain one has 1.
RANGES = {"target": (1.25, 1.5, 2.0), "reported": (0.45, 0.6, 0.8), "negated": (0.1, 0.25, 0.4)}
#: Between these scores of a text's heaviest clause the effect is a straight line.
KNOTS = (3.0, 5.0)
#: A threat without a target weighs less than an insult without one.
UNAIMED_THREAT = 0.5


def symbol_weights(target: float, reported: float, negated: float) -> list[float]:
    """By output symbol, in the order of SCORED."""
    return [target, 1.0, reported, negated, target, UNAIMED_THREAT, UNAIMED_THREAT * reported, UNAIMED_THREAT * negated]


def grammar(parts: tuple[Transducer, ...] | None = None) -> Transducer:
    first, *rest = parts or (negation(), reported(), target())
    for other in rest:
        first = compose(first, other, ALPHABET)
    return first


class Lexicon(dict):
    """word -> (symbol, weight), from the learned beginnings (key 'abc') and words (key '=abc'); remembers the last words
    it met, held of them at most."""

    def __init__(self, entries: dict[str, tuple[str, float]], held: int = HELD_WORDS):
        super().__init__()
        self.entries, self.held = entries, held
        self.fixed = {w: (s, 1.0) for s, ws in ((REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS)) for w in ws}
        self.fixed |= {c: (STOP, 0.0) for c in ".!?;\n"}

    def __missing__(self, word: str) -> tuple[str, float]:
        out = self.entries.get("=" + word) or self.fixed.get(word)
        if not out:
            found = [x for n in PREFIXES if n <= len(word) and (x := self.entries.get(word[:n]))]
            out = max(found, key=lambda x: x[1], default=UNKNOWN)
        if len(self) >= self.held:
            self.clear()
        self[word] = out
        return out


def clauses(text: str | None, lexicon: Lexicon, machine: Transducer) -> list[list[float]]:
    """Per clause with a match: sums of weights by output symbol, in the order of SCORED."""
    symbols = [lexicon[w] for w in _TOKEN.findall((text or "").lower())]
    if not any(s in (INSULT, THREAT) for s, _ in symbols):
        return []
    out, now, state = [], {}, machine.start
    for symbol, weight in [*symbols, (STOP, 0.0)]:
        state, got = machine.step(state, symbol)
        if got in SCORED:
            now[got] = now.get(got, 0.0) + weight
        elif got == TARGET:
            for plain, aimed in AIMED.items():
                if plain in now:
                    now[aimed] = now.get(aimed, 0.0) + now.pop(plain)
        elif got == STOP and now:
            out.append([now.get(s, 0.0) for s in SCORED])
            now = {}
    return out


def features(total: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Of the sum of a text's clause scores the logarithm, and of the heaviest score what lies in each step of KNOTS, so
    that its effect need not be a straight line. All of them grow with each score."""
    steps = [np.clip(most - a, 0, b - a) for a, b in itertools.pairwise((0.0, *KNOTS, np.inf))]
    return np.column_stack([np.log1p(total), *steps])


def _rows(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """The rows' values, of which HELD_ROWS are Python's at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, HELD_ROWS):
            some = batch.slice(at, HELD_ROWS)
            yield from zip(*(some.column(c).to_pylist() for c in columns), strict=True)


def _parts(words: set[str]) -> Iterator[str]:
    """Each word and each beginning once: of sorted words, those that share a beginning follow each other."""
    before = ""
    for word in sorted(words):
        yield "=" + word
        for n in PREFIXES:
            if n > len(word):
                break
            if (part := word[:n]) != before[:n]:
                yield part
        before = word


def _beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weights of the documents per beginning, fold and label, and of toxic ones that have it before a second person.
    Whenever HELD_COUNTS are held they are handed on, in the middle of a text too; Spark sums them up."""
    aims, kinds = set(TARGETS), ("clean", "toxic", "aimed")
    seen: dict[tuple[int, int], dict[str, float]] = defaultdict(dict)
    held = 0

    def counted() -> Iterator[pa.RecordBatch]:
        for (fold, kind), counts in seen.items():
            told = {c: np.zeros(len(counts)) for c in kinds} | {kinds[kind]: np.fromiter(counts.values(), float, len(counts))}
            yield pa.RecordBatch.from_pydict({"part": pa.array(counts, pa.string()), "fold": np.full(len(counts), fold, np.int64)} | told)
        seen.clear()

    for text, label, fold, weight in _rows(batches, "_text", "_label", "_fold", "_weight"):
        tokens = _TOKEN.findall((text or "").lower())
        words = {w for w in tokens if w.isalpha()}
        before = {w for w, *rest in zip(tokens, tokens[1:] + [""], tokens[2:] + ["", ""], strict=False) if w in words and aims.intersection(rest)} if label else set()
        for kind, some in ((label, words), (2, before)):
            counts = seen[fold, kind]
            for part in _parts(some):
                if part in counts:
                    counts[part] += weight
                    continue
                counts[part] = weight
                held += 1
                if held >= HELD_COUNTS:
                    yield from counted()
                    counts, held = seen[fold, kind], 0
    yield from counted()


def _least_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the least hash of a text's runs of five words, which near copies mostly share and other texts do not."""
    for batch in batches:
        least = []
        for (text,) in _rows([batch], "_text"):
            words = (text or "").lower().encode().split()
            least.append(min(int.from_bytes(hashlib.blake2b(b" ".join(words[i : i + 5]), digest_size=7).digest()) for i in range(max(1, len(words) - 4))))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_draw", "_label", "_text")), pa.array(least, pa.int64())], ["_draw", "_label", "_text", "_least"])


def log_odds_bound(toxic: Column, clean: Column, n_toxic: int, n_clean: int) -> Column:
    """Lower bound of the log odds ratio, one standard error below the estimate."""
    a, b, c, d = toxic + 0.5, n_toxic - toxic + 0.5, clean + 0.5, n_clean - clean + 0.5
    return F.log(a / b) - F.log(c / d) - F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)


def learn_lexicons(sample: DataFrame, seen: dict[tuple[int, int], float]) -> list[dict[str, tuple[str, float]]]:
    """A lexicon without each fold in turn, and last the one of all rows. seen: weights by fold and label."""
    parts = sample.select("_text", "_label", "_fold", "_weight").mapInArrow(_beginnings, "part string, fold long, clean double, toxic double, aimed double").groupBy("part", "fold").agg(*(F.sum(c).alias(c) for c in ("clean", "toxic", "aimed")))
    rows = lambda label, without: sum(n for (f, k), n in seen.items() if k == label and f != without)
    without = lambda c, k: F.sum(F.when(F.col("fold") != k, F.col(c)).otherwise(0))
    counted = parts.groupBy("part").agg(*(without(c, k).alias(f"{c}{k}") for k in range(FOLDS + 1) for c in ("clean", "toxic", "aimed")))
    bound = lambda k: log_odds_bound(F.col(f"toxic{k}"), F.col(f"clean{k}"), rows(1, k), rows(0, k))
    is_entry = lambda k: (F.col(f"toxic{k}") >= LEAST_TOXIC) & (bound(k) >= LEAST_BOUND) & (F.col(f"toxic{k}") >= PRECISE * F.col(f"clean{k}"))
    symbol = lambda k: F.when(2 * F.col(f"aimed{k}") > F.col(f"toxic{k}"), THREAT).otherwise(INSULT)
    folds = [k for k in range(FOLDS + 1) if rows(1, k) and rows(0, k)]
    each = F.filter(F.array(*(F.when(is_entry(k), F.struct(F.lit(k).alias("k"), symbol(k).alias("s"), bound(k).alias("w"))) for k in folds)), lambda x: x.isNotNull())
    given = {"=" + w for w in THREATS}
    told = counted.withColumn("entries", each).filter((F.size("entries") > 0) | F.col("part").isin(*given))
    out: list[dict[str, tuple[str, float]]] = [{} for _ in range(FOLDS + 1)]
    shares: list[dict[str, float]] = [{} for _ in range(FOLDS + 1)]
    for r in told.collect():  # beginnings that LEAST_TOXIC of the sample's toxic texts share
        for e in r["entries"]:
            out[e["k"]][r["part"]] = (e["s"], e["w"])
        if r["part"] in given:
            for k in folds:
                shares[k][r["part"]] = (r[f"toxic{k}"] + 2) / (r[f"toxic{k}"] + r[f"clean{k}"] * rows(1, k) / rows(0, k) + 2)
    # where all of a class is in one fold, that fold too is measured by the lexicon of all
    out = [x if k in folds else out[FOLDS] for k, x in enumerate(out)]
    shares = [x if k in folds else shares[FOLDS] for k, x in enumerate(shares)]
    for k, entries in enumerate(out):
        usual = float(np.median([w for _, w in entries.values()])) if entries else 0.0
        for word in given if usual else ():
            entries.setdefault(word, (THREAT, usual * shares[k].get(word, 1.0)))
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, often: np.ndarray, ridge: float = 0.004, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Newton steps; the last coefficient is the intercept. Features only ever add: negative weights are dropped. Also
    the loss."""
    use, cost = np.ones(x.shape[1], bool), np.where(y > 0, MISS_COST, 1.0) * often
    while True:
        z = np.column_stack([x[:, use], np.ones(len(x))])
        w = np.zeros(z.shape[1])
        penalty = np.full(z.shape[1], ridge * len(x) / 100)
        penalty[-1] = 1e-6
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            h = (z * (cost * p * (1 - p))[:, None]).T @ z + np.diag(penalty)
            step = np.linalg.solve(h, z.T @ (cost * (y - p)) - penalty * w)
            w += np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-8:
                break
        negative = w[:-1] < 0
        if not negative.any():
            out = np.zeros(x.shape[1] + 1)
            out[:-1][use], out[-1] = w[:-1], w[-1]
            p = np.clip(1 / (1 + np.exp(-np.clip(z @ w, -30, 30))), 1e-12, 1 - 1e-12)
            return out, float(-(cost * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() + 0.5 * (penalty * w * w).sum())
        use[np.flatnonzero(use)[negative]] = False


def fit_weights(found: list[list[list[float]]], y: np.ndarray, often: np.ndarray) -> tuple[list[float], list[float]]:
    """(weights by output symbol, logistic weights) with the least loss, of all values in RANGES."""
    held = np.array([c for clauses_ in found for c in clauses_]).reshape(-1, len(SCORED))
    row = np.repeat(np.arange(len(found)), [len(c) for c in found])
    best = None
    for values in itertools.product(*RANGES.values()):
        by_symbol = symbol_weights(*values)
        scores = held @ np.array(by_symbol)
        total, most = np.zeros(len(found)), np.zeros(len(found))
        np.add.at(total, row, scores)
        np.maximum.at(most, row, scores)
        w, loss = fit_logistic(features(total, most), y, often)
        if best is None or loss < best[0]:
            best = loss, by_symbol, w.tolist()
    return best[1], best[2]


@dataclass
class Model:
    """lexicon: beginning -> (symbol, weight); by_symbol: weights of the output symbols; weights: of the logistic model."""

    lexicon: dict[str, tuple[str, float]]
    by_symbol: list[float]
    weights: list[float]
    share: float

    def score(self, text: str | None, lexicon: Lexicon, machine: Transducer) -> float:
        if not self.weights:
            return self.share
        scores = [sum(a * b for a, b in zip(c, self.by_symbol, strict=True)) for c in clauses(text, lexicon, machine)]
        z = features(np.array([sum(scores)]), np.array([max(scores, default=0.0)]))[0] @ np.array(self.weights[:-1]) + self.weights[-1]
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "toxic", held_out: tuple[int, int] = (3, 1), fit_rows: int = FIT_ROWS) -> Model:
    mod, left_out = held_out
    wanted = (
        labels.filter(F.col(label_col).cast("int").isin(0, 1) & F.col(label_id_col).isNotNull() & (crc_mod(F.col(label_id_col), mod) != left_out))
        .groupBy(F.col(label_id_col).alias("_id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("_label"))
        .withColumn("_draw", F.md5(F.concat(F.lit("toxicity|"), F.col("_id").cast("string"))))
        .orderBy("_draw", "_id")
        .limit(fit_rows)
    )
    # fit_rows ids bound this broadcast, and one text for each id the sample
    joined = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(wanted), "_id")
    texts = joined.groupBy("_id", "_label", "_draw").agg(F.min(F.struct(F.col("_text").isNull(), "_text")).getField("_text").alias("_text"))
    marked = texts.mapInArrow(_least_shingles, "_draw string, _label int, _text string, _least long")
    # rows that are copies of each other, whole or nearly, are one witness, which their number makes a little weightier
    usual = (F.avg("_label") >= 0.5).cast("int").alias("_label")
    weight = (1 + F.log2(F.count(F.lit(1)))).alias("_weight")
    sample = marked.groupBy("_least").agg(F.min_by(F.struct("_text", "_draw"), "_draw").alias("s"), usual, weight).select("s.*", "_label", "_weight").withColumn("_fold", F.pmod(F.xxhash64("_draw"), F.lit(FOLDS)).cast("long"))
    sample = sample.persist()
    try:
        seen = {(r["_fold"], r["_label"]): r["n"] for r in sample.groupBy("_fold", "_label").agg(F.sum("_weight").alias("n")).collect()}
        toxic, clean = (sum(n for (_, label), n in seen.items() if label == k) for k in (1, 0))
        share = (toxic + 0.5) / (toxic + clean + 1)
        if not toxic or not clean:
            return Model({}, [], [], share)
        lexicons = learn_lexicons(sample, seen)
        shared = sample.sparkSession.sparkContext.broadcast(lexicons)

        def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine, known = grammar(), [Lexicon(x, HELD_WORDS // (FOLDS + 1)) for x in shared.value]
            for batch in batches:
                x = [clauses(t, known[f], machine) for t, f in _rows([batch], "_text", "_fold")]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.list_(pa.float64()))), batch.column("_label"), batch.column("_weight")], ["x", "y", "w"])

        rows = sample.select("_text", "_label", "_fold", "_weight").mapInArrow(measured, "x array<array<double>>, y int, w double").collect()
        by_symbol, weights = fit_weights([r["x"] for r in rows], np.array([r["y"] for r in rows]), np.array([r["w"] for r in rows]))
        return Model(lexicons[FOLDS], by_symbol, weights, share)
    finally:
        sample.unpersist()


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, score, predicted (score >= threshold), carry (a struct of the columns it names)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    carried = F.struct(*(F.col(f"`{c}`") for c in carry)) if carry else F.lit(None).cast("int")
    inside = bool(carry) and text_col in carry  # then the text goes through Python once
    text = F.lit(None).cast("string") if inside else F.col(text_col)
    slim = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"), carried.alias("carry"))
    schema = slim.select("doc_id", F.lit(0.0).alias("score"), "carry").schema
    arrow = to_arrow_schema(schema, timestamp_utc=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        lexicon, machine = Lexicon(m.lexicon), grammar()
        for batch in batches:
            texts = batch.column("carry").field(text_col) if inside else batch.column("_text")
            scores = [m.score(t, lexicon, machine) for (t,) in _rows([pa.RecordBatch.from_arrays([texts], ["_text"])], "_text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(arrow.field("doc_id").type), pa.array(scores, pa.float64()), batch.column("carry").cast(arrow.field("carry").type)], schema=arrow)

    scored = slim.mapInArrow(run, schema)
    return scored.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "carry")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs, read_table(spark, sf_dir, "labels"))
    held = (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out")
    return score_texts(docs, model).select("doc_id", held, "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op10_toxicity": op10_toxicity}
ORACLE_SQL: dict[str, str] = {}
