"""Brute-force versions of what SQL cannot say, and the cases that every operator and stage has to stand."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from quern.llm import chat, exact_dedup, leaks, lm, mixing, near_dedup, secrets, suffix_dedup, toxicity, wrapper

SF = "/root/testdata/sf0.001"
CLASHING = ["_id", "_text", "_key", "_name", "_hash", "_place", "blob", "digest", "rep", "score", "predicted", "carry", "n_hit", "kept", "size", "taken", "id", "n", "band", "_host", "_row", "_chunk", "_label"]
LONG = " ".join(f"long{i % 977} text{i}" for i in range(60_000))  # 900 KB


def lower(t):
    return (t or "").encode().lower()


@pytest.fixture(scope="module")
def hard(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, extra columns with clashing names."""
    texts = [None, "", " ", "same text here to be found again", "SAME text here to be found again", LONG, LONG + " more", "token = abcdef123", "\x00\x1f control", "eyJ" * 20_000, "x" * 3000]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 == 0 else "s") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], rows[0], (None, "same text here to be found again", None, None), (None, None, "en", "s")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(*r, 7, *(f"{c} of {r[0]}" for c in CLASHING)) for r in rows], schema).repartition(5)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, None if i == 4 else 3 if i == 5 else i % 2, "x") for i in range(9)] + [(3, 0, 1, "y"), (None, 1, 1, "z")], "doc_id long, quality int, toxic int, _label string")


def test_every_operator_on_hard_rows(spark, hard, labels):
    rows = hard.select("doc_id", "text").collect()
    n = len(rows)
    scored = lm.score(hard).collect()
    assert len(scored) == n and all(r.n_tokens == len(lm.tokens_of(t)) for r in scored for t in [next(x.text for x in rows if x.doc_id == r.doc_id)] if r.doc_id is not None)
    groups = Counter(lower(r.text) for r in rows)
    exact = exact_dedup.exact_groups(hard, block_chars=512).collect()
    assert len(exact) == n and sum(r.kept for r in exact) == len(groups) and sorted(r.group_size for r in exact) == sorted(groups[lower(r.text)] for r in rows)
    cut = suffix_dedup.remove_repeats(hard).collect()
    assert len(cut) == n and next(r for r in cut if r.doc_id == 6).n_removed == len(LONG) and all(r.n_removed == 0 for r in cut if r.doc_id is None)
    found = secrets.ledger_scan(hard).collect()
    assert len(found) == n and sum(len(r.findings) for r in found) == 1
    near = near_dedup.near_groups(hard).collect()
    assert len(near) == n and all(r.kept and r.component_id is None for r in near if r.doc_id is None)
    assert {r.doc_id: r.component_id for r in near if r.doc_id in (3, 4, 5, 6)} == {3: 3, 4: 3, 5: 5, 6: 5}
    bench = spark.createDataFrame([(1, "text here to be found"), (1, "text here to be found"), (2, None), (None, "control")], "item_id long, text string")
    hits = leaks.leak_hits(hard, bench, carry=hard.columns).collect()
    assert len(hits) == n and sum(r.n_hit > 0 for r in hits) == 6 and all(r.carry["_text"].startswith("_text of") for r in hits)
    model = toxicity.fit(hard, labels)
    assert toxicity.score_texts(hard, model, carry=hard.columns).count() == n
    mixed = mixing.mix(hard).collect()
    assert len(mixed) == n and all(r.taken <= 3 * r["size"] for r in mixed)


def test_every_operator_on_empty_tables(spark, hard, labels):
    none, no_bench = hard.limit(0), spark.createDataFrame([], "item_id long, text string")
    assert lm.score(none).count() == exact_dedup.exact_groups(none).count() == suffix_dedup.remove_repeats(none).count() == 0
    assert secrets.ledger_scan(none).count() == near_dedup.near_groups(none).count() == leaks.leak_hits(none, no_bench).count() == 0
    assert leaks.leak_hits(hard, no_bench).filter("n_hit > 0").count() == 0
    assert toxicity.score_texts(hard, toxicity.fit(none, labels.limit(0))).filter("predicted = 1").count() == 0
    assert mixing.mix(none).count() == 0
    assert wrapper.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert chat.digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_stages_on_hard_and_empty_rows(spark, hard):
    import corpus_pipeline as cp

    for docs in (hard, hard.limit(0)):
        kept = docs
        for _, stage in cp.STAGES[:-1]:
            kept = stage(spark, kept, SF)
            assert kept.columns == docs.columns
            kept = spark.createDataFrame(kept.collect(), docs.schema)
        assert all(r["_id"] == f"_id of {r.doc_id}" for r in kept.collect())
        assert cp.STAGES[-1][1](spark, kept, SF).count() == kept.count()
    assert kept.count() == 0


def test_pages_repeated_and_clashing(spark):
    row = (1, "http://h/", "<article><p>a</article>")
    table = spark.createDataFrame([(*row, "x"), (*row, "x"), (2, None, None, None), (None, "", "", "")], "page_id long, url string, html string, blocks string")
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in wrapper.extract(table).collect()) == [("1", "a", 1), ("1", "a", 1), ("2", "", 0), ("None", "", 0)]


def test_chat_mask_and_ties(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, None, "system", None), (None, 1, None, "x"), (2, 5, "assistant", "z" * 200_000)]
    table = spark.createDataFrame([(*r, "t", 0) for r in rows], "conv_id long, turn long, role string, text string, _text string, n_turns int")
    got = {r.conv_id: r for r in chat.digests(table).collect()}
    turns = [("system", ""), ("user", "a"), ("user", "b"), ("assistant", rows[2][3]), ("assistant", rows[2][3])]
    assert got[1].n_turns == 5 and got[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256((rows[2][3] * 2).encode()).hexdigest() and got[1].loss_chars == 2 * len(rows[2][3])
    assert got[1].formatted_chars == len(chat.format_conversation(turns)[0]) and not got[1].valid
    assert got[None].n_turns == 1 and got[2].loss_chars == 200_000
    # a mask that is off is seen: what is read is what stands under it
    back = chat.Playback(chat.Reader(chat.CHAT))
    whole, spans, _ = chat.format_conversation([("user", "u"), ("assistant", "abc")])
    assert [t for _, t in back.feed(whole)] == ["u", "abc"]
    assert list(back.learned(spans)) == ["abc"] and list(back.learned([(a + 1, b) for a, b in spans])) == ["bc"]
    with pytest.raises(ValueError):
        broken = chat.Playback(chat.Reader(chat.CHAT))
        list(broken.feed(whole[:-8]))
        broken.drop()
        broken.close()


def plain_secrets(text):
    out = []
    for i, (kind, pattern, least, group) in enumerate([("assign", r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 1), ("access", r"AKIA[A-Z0-9]+", 20, 0), ("hex", r"[0-9a-f]+", 24, 0)]):
        out += [(m.start(), i, m.end(), kind) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


def test_secrets_against_brute_force(spark):
    rng = random.Random(3)
    bits = ["password", "Token", "API_KEY", "apikey", "secret", " ", "=", ":", '"', "'", "AKIA", "ABCDEFGHIJ0123456789", "deadbeef", "0123456789abcdef", "é", "\n", "/", "-", "x", "eyJabcdefgh.eyJabcdefgh.sig", "ghp_" + "a" * 36]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(900 + i, t) for i, t in enumerate(texts[:40])], "doc_id long, text string")
    for r in secrets.ledger_scan(docs).collect():
        text = texts[r.doc_id if r.doc_id < 900 else r.doc_id - 900]
        assert [f"{f.kind}:{f.start}:{f.end}" for f in r.findings if f.kind in ("assign", "access", "hex")] == plain_secrets(text)
    assert sum(len(plain_secrets(t)) for t in texts) > 100


def test_ledger_of_blob_and_rule_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "ledger")
    scanned = []
    real = secrets._scan_blobs

    def watched(blobs, rules):
        scanned.append(sorted(tuple(r.rules) for r in blobs.select("rules").collect()))
        return real(blobs, rules)

    monkeypatch.setattr(secrets, "_scan_blobs", watched)
    one = spark.createDataFrame([(1, "AKIA" + "A" * 16), (2, "AKIA" + "A" * 16), (3, "none")], "doc_id long, text string")
    two = one.union(spark.createDataFrame([(4, "token=abcdef"), (5, "none")], one.schema))
    first = {r.doc_id: len(r.findings) for r in secrets.ledger_scan(one, ledger_path=path).collect()}
    second = {r.doc_id: len(r.findings) for r in secrets.ledger_scan(two, ledger_path=path).collect()}
    assert first == {1: 1, 2: 1, 3: 0} and second == {1: 1, 2: 1, 3: 0, 4: 1, 5: 0}
    assert len(scanned[0]) == 2 and len(scanned[1]) == 1  # each new blob once, old ones not again
    changed = tuple(secrets.Rule("access", 2, r"AKIA[A-Z0-9]{8}", 12) if r.kind == "access" else r for r in secrets.RULES)
    third = {r.doc_id: [(f.kind, f.end - f.start) for f in r.findings] for r in secrets.ledger_scan(two, rules=changed, ledger_path=path).collect()}
    assert third[1] == [("access", 12)] and third[4] == [("assign", 12)]
    assert scanned[2] == [("access@2",)] * 3  # only the changed rule, on all three blobs
    secrets.ledger_scan(two, rules=changed, ledger_path=path).collect()
    assert scanned[3] == []


def test_leaks_against_brute_force(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    words = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    items = {r.item_id: words(r.text) for r in bench.collect()}
    windows = defaultdict(set)
    for i, w in items.items():
        for k in range(max(1, len(w) - 9)) if w else ():
            windows[tuple(w[k : k + 10])].add(i)
    sizes = {len(w) for w in windows}
    want = {}
    for r in docs.collect():
        w, hit, ids = words(r.text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    ids |= windows[tuple(w[k : k + n])]
        want[r.doc_id] = (len(w), len(hit), sorted(map(str, ids)))
    for limit in (leaks.AUTOMATON_BYTES, 20_000):  # one block, and many
        got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in leaks.leak_hits(docs, bench, automaton_bytes=limit).collect()}
        assert got == want
    assert any(h for _, h, _ in want.values())


@pytest.fixture(scope="module")
def toxic_model(spark):
    return toxicity.fit(*(spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels")))


def test_toxicity_on_held_out_rows(spark, toxic_model):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score_texts(docs, toxic_model)
    held = scored.join(labels, "doc_id").filter("crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 1").select("predicted", "toxic").collect()
    caught = Counter((r.toxic, r.predicted) for r in held)
    # of the 144 toxic rows eight hold nothing but ordinary words
    assert caught[1, 1] / (caught[1, 1] + caught[1, 0]) >= 0.9 and caught[0, 1] / (caught[0, 0] + caught[0, 1]) < 0.01


def test_transducers_by_hand():
    lexicon = toxicity.Lexicon({"idiot": ("i", 2.0), "=fool": ("i", 1.0), "=kill": ("h", 3.0)})
    machine = toxicity.grammar()
    said = lambda t: [{s: round(v, 3) for s, v in zip(toxicity.SCORED, c, strict=True) if v} for c in toxicity.clauses(t, lexicon, machine)]
    assert said("An idiot. You idiot!") == [{"i": 2.0}, {"a": 2.0}] and said("idiot that you are, idiot, you") == [{"a": 4.0}]
    assert said("You are not an idiot") == [{"I": 2.0}] and said("They said you idiot. A fool") == [{"j": 2.0}, {"i": 1.0}]
    assert said("He said you are not an idiot") == [{"I": 2.0}] and said("I will not kill you") == [{"H": 3.0}]
    assert said("I will kill you") == [{"b": 3.0}] and said("you, I kill") == [{"b": 3.0}] and said("kill it") == [{"h": 3.0}] and said("a quiet walk") == []


def test_the_grammar_decides(toxic_model):
    """A target adds, report and negation take away, and without its transducer a text is predicted otherwise."""
    m, whole = toxic_model, toxicity.grammar()
    lexicon = toxicity.Lexicon(m.lexicon)
    score = lambda t, machine=whole: m.score(t, lexicon, machine)
    words = [w.strip("=") for w, (s, _) in m.lexicon.items() if s == toxicity.INSULT]
    assert len(words) > 50
    for w in words:
        assert score(f"you {w}") >= score(w) >= score(f"they said {w}") >= score(f"not {w}") >= score("")
        assert score(f"{w} you") == score(f"you {w}")
    assert score("I will kill you") > score("kill it") and score("I will kill you") > score("they said I will kill you") > score("I will not kill you")
    without = {"negation": (toxicity.reported(), toxicity.target()), "report": (toxicity.negation(), toxicity.target()), "target": (toxicity.negation(), toxicity.reported())}
    texts = {"negation": "you are not a {}", "report": "she said you are a {}", "target": "you are a {}"}
    for name, parts in without.items():
        other = toxicity.grammar(parts)
        assert any((score(texts[name].format(w)) >= toxicity.THRESHOLD) != (score(texts[name].format(w), other) >= toxicity.THRESHOLD) for w in words), name


def test_threats_are_learnt(spark):
    """A word that toxic texts have before a second person is a threat; copies of one text are one witness."""
    rows = [(i, (f"w{i} v{i * 7} grobble you q{i}" if i % 4 == 0 else f"w{i} v{i * 7} snarf q{i}" if i % 4 == 1 else f"w{i} v{i * 7} kill q{i}"), int(i % 4 < 2)) for i in range(400)]
    rows += [(1000 + i, "one curious sentence that is here many times over", 1) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    m = toxicity.fit(df.drop("toxic"), df.drop("text"))
    assert m.lexicon["=grobble"][0] == toxicity.THREAT and m.lexicon["=snarf"][0] == toxicity.INSULT
    assert m.lexicon["=kill"][1] < 0.5 * m.lexicon["=murder"][1]  # clean texts have it
    assert m.lexicon["=snarf"][1] > m.lexicon.get("=curious", ("", 0.0))[1]


def test_toxicity_counts_in_bounded_memory():
    """Counts are handed on as they grow, in the middle of a long text too, and sum up to those of a plain count."""
    word = lambda i: "".join(chr(97 + int(c)) for c in str(i * 7919 % 10**6).zfill(6))
    texts = [" ".join(word(k) for k in range(250 * i, 250 * i + 300)) + " snarf you. Shared SHARED sha" for i in range(160)]
    texts += [None, "", " ".join(word(k) for k in range(10**5, 10**5 + 20_000))]
    rows = [(t, i % 2, i % 3, 1.0 + i % 4) for i, t in enumerate(texts)]
    batch = pa.RecordBatch.from_pydict({"_text": [r[0] for r in rows], "_label": [r[1] for r in rows], "_fold": [r[2] for r in rows], "_weight": [r[3] for r in rows]})
    tracemalloc.start()
    try:
        largest = max(b.num_rows for b in toxicity._beginnings(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 50e6
    assert largest <= toxicity.HELD_COUNTS
    plain = Counter()
    for text, label, fold, weight in rows:
        tokens = re.findall(r"[a-z]+|[.]", (text or "").lower())
        words = {w for w in tokens if w != "."}
        before = {w for i, w in enumerate(tokens) if label and w != "." and "you" in tokens[i + 1 : i + 3]}
        for kind, some in (("toxic" if label else "clean", words), ("aimed", before)):
            for part in {"=" + w for w in some} | {w[:n] for w in some for n in range(3, 11) if len(w) >= n}:
                plain[part, fold, kind] += weight
    told = Counter()
    for b in toxicity._beginnings(iter([batch])):
        for r in b.to_pylist():
            for kind in ("clean", "toxic", "aimed"):
                told[r["part"], r["fold"], kind] += r[kind]
    assert {k: v for k, v in told.items() if v} == dict(plain)
    lexicon = toxicity.Lexicon({"snar": ("i", 2.0)}, held=100)
    machine = toxicity.grammar()
    assert len(toxicity.clauses(texts[0], lexicon, machine)) == 1 and len(lexicon) <= 100


def mixed_targets(sizes):
    """source -> target by the contract, with plain numbers."""
    total = sum(sizes.values())
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be"))))}
    out, open_ones = {}, set(sizes)
    while open_ones:
        left = total - sum(out.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_ones) for s in open_ones}
        over = {s for s in open_ones if share[s] > 3 * sizes[s]}
        if not over:
            return out | share
        out |= {s: 3 * sizes[s] for s in over}
        open_ones -= over
    return out


def test_pipeline_against_plain_stages(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    lexicon, machine = toxicity.Lexicon(model.lexicon), toxicity.grammar()
    rows = {r.doc_id: r for r in docs.collect() if model.score(r.text, lexicon, machine) < toxicity.THRESHOLD}
    best = {}
    for i, r in rows.items():
        best[lower(r.text)] = max(i, best.get(lower(r.text), i))
    rows = {i: rows[i] for i in best.values()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, r in rows.items() for w in [lower(r.text).split()]}
    lead = {i: i for i in rows}

    def top(i):
        while lead[i] != i:
            i = lead[i]
        return i

    ids = sorted(rows)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                lead[y] = x
    rows = {i: r for i, r in rows.items() if top(i) == i}
    hits = {r.doc_id for r in leaks.leak_hits(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).filter("n_hit > 0").collect()}  # held to brute force above
    rows = {i: r for i, r in rows.items() if i not in hits}
    mix = {r.doc_id: r for r in cp.run(spark, SF).collect()}
    assert set(mix) == set(rows)
    sizes = Counter()
    for i, r in rows.items():
        assert mix[i]["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        sizes[r.source] += mix[i]["size"]
    targets, taken = mixed_targets(sizes), Counter()
    for i, r in mix.items():
        assert r.target == pytest.approx(targets[rows[i].source]) and r.source_size == sizes[rows[i].source] and 0 <= r.taken <= 3 * r["size"]
        taken[rows[i].source] += r.taken
    longest = max(r["size"] for r in mix.values())
    assert all(abs(taken[s] - t) <= max(3 * longest, 0.02 * t) for s, t in targets.items())


def test_mixing_ties_and_reruns(spark):
    rows = [(i // 2, "a b c" if i % 2 else None, None if i % 4 == 0 else "s") for i in range(40)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one, two = (sorted(map(tuple, mixing.mix(d).select("doc_id", "size", "taken").collect())) for d in (docs, docs.repartition(7)))
    assert one == two and len(one) == 80


def test_known_probability_of_score(spark):
    """Words of one count each: P of every word follows from the formula with counts that need no quantising."""
    import math

    docs = spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id long, text string")
    assert all(zlib.crc32(str(i).encode()) % 10 for i in (1, 2))
    n, v = 6, 5
    p1 = lambda c: (c + 0.1) / (n + 0.1 * (v + 1))
    end = lm.LEVEL_MEAN[2]  # two ends: level 2 stands for 2 and 3
    want = math.log10(0.2 * 1 / end + 0.8 * p1(1)) + math.log10(0.2 * 1 / 1 + 0.8 * p1(1)) + math.log10(0.2 * 1 / 1 + 0.8 * p1(end))
    assert all(r.score == pytest.approx(want) for r in lm.score(docs).collect())


@pytest.mark.parametrize("how", [{"bitmap_log2": 16}, {"bitmap_log2": 14}, {"bitmap_log2": 13, "hot": 4}, {"hot": 4}])
def test_suffix_dedup_in_slices_by_joins_and_hot(spark, how):
    """Bitmaps in slices, joins in their place, and strings of hot keys: each against brute force."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")  # 2.5 MB ask for 2**19 bits
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs, **how).collect()}
    first, total = {}, 0
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        b = (r.text or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first.setdefault(b[k : k + 50], r.doc_id) < r.doc_id:
                gone[k : k + 50] = b"\1" * 50
        assert bytes(got[r.doc_id].kept) == bytes(x for x, g in zip(b, gone) if not g) and got[r.doc_id].n_removed == sum(gone)
        total += sum(gone)
    assert total > 0


def test_suffix_dedup_refuses_bitmaps_without_room(spark):
    with pytest.raises(ValueError, match="bitmap_log2"):
        suffix_dedup.remove_repeats(spark.createDataFrame([(1, "a")], "doc_id long, text string"), bitmap_log2=12)


def test_pages_against_a_plain_extraction(spark):
    from plain_html import plain_text

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = Counter((r.page_id, r.text, r.n_chars) for r in wrapper.extract(pages).collect())
    assert got == Counter((r.page_id, t, len(t)) for r in pages.collect() for t in [plain_text(r.html)]) and len(got) == 250


def test_texts_of_several_gigabytes_are_read_in_one_slice():
    """A slice of the key space costs two more passes over all text."""
    bits = lambda gib: suffix_dedup.bitmap_bits(gib << 30, suffix_dedup.BITMAP_LOG2)
    assert bits(6)[1] == bits(8)[1] == 0 and bits(32)[1] == 2 and bits(33)[1] is None


def test_long_sibling_lists_are_aligned_best():
    """A section at the front of the page that the skeleton has at its end must not drag all others behind it."""
    n = 400
    pairs = "".join(f"<p class='a{i}'>x</p><div class='b{i}'><ul><li>y</li></ul></div>" for i in range(n))
    page, skeleton = wrapper.parse(f"<body><p class='late'>z</p>{pairs}</body>"), wrapper.parse(f"<body>{pairs}<p class='late'>z</p></body>")
    wrapper.number(skeleton)
    wrapper.align(page, skeleton)
    assert [k.name for k in page.kids[0].kids[1:]] == [k.name for k in skeleton.kids[0].kids[:-1]] and page.kids[0].kids[0].name < -1


def test_long_lists_give_what_held_tables_give():
    rng = random.Random(4)
    for _ in range(60):
        kinds = ["<p>t</p>", "<div><p>t</p></div>", "<div><p>t</p><ul><li>u</li></ul></div>", "<div><ul><li>u</li></ul><p>v</p><ol><li>w</li></ol></div>", "<table><tr><td>c</td></tr></table>", "<h2>h</h2>", "<section><div><p>t</p></div><p>q</p></section>"]
        a, b = (wrapper.parse("<body>" + "".join(rng.choices(kinds, k=rng.randrange(1, 60))) + "</body>").kids[0] for _ in range(2))
        known = wrapper.shaped(a, {})
        wrapper.shaped(b, known)
        memo = {}
        wrapper.match(a, b, memo)
        worth = lambda m, n: memo[m.shape, n.shape][0] if m.kids and n.kids else 1  # noqa: E731, B023
        assert wrapper._long_mapping(a.runs, b.runs, worth) == wrapper._held_mapping(a.runs, b.runs, worth)


def test_no_block_of_the_given_pages_is_constant(spark):
    """Why the template half leaves nothing out there: no node has one text on even a half of a host's pages."""
    hosts = defaultdict(list)
    for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("url", "html").collect():
        hosts[re.sub(r"^[a-z]+://([^/?#]*).*", r"\1", r.url)].append(r.html)
    large = [pages for pages in hosts.values() if len(set(pages)) >= wrapper.TEMPLATE_PAGES]
    assert len(large) > 50
    for pages in sorted(large, key=len)[:12]:
        skeleton = wrapper.parse(pages[0])
        wrapper.number(skeleton)
        texts, holding = defaultdict(Counter), Counter()
        for html in set(pages):
            tree = wrapper.parse(html)
            wrapper.align(tree, skeleton)
            found = {(b[0], b[1]) for b in wrapper.Cut(tree, False).blocks}
            holding.update({node for node, _ in found})
            for node, text in found:
                texts[node][text] += 1
        assert max(max(c.values()) / holding[node] for node, c in texts.items() if holding[node] >= wrapper.TEMPLATE_PAGES) < 0.5


def test_decontamination_of_nameless_items_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), (2, "one two three"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "ALPHA beta gamma delta epsilon zeta eta theta iota kappa", "x", 1), (7, "two three", "y", 2), (7, "two three", "y", 2), (8, None, None, None)], "item_id long, text string, _text string, doc_id long")
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in leaks.leak_hits(docs, bench).collect()}
    assert got == {1: (11, 10, []), 2: (3, 2, ["7"]), 3: (0, 0, [])}
    blocks = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in leaks.leak_hits(docs, bench, automaton_bytes=1).collect()}
    assert blocks == got


def test_repeated_rows_are_dealt_evenly(spark):
    rows = [(5, "the same row again and again")] * 600 + [(None, "no id and the same text")] * 600 + [(i, f"text {i}") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = lm.score(df, chunk_bytes=500).collect()
    whole = lm.score(df).collect()
    told = lambda rs: Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9), round(r.score, 9)) for r in rs)
    assert told(got) == told(whole) and sum(told(got).values()) == 1300
