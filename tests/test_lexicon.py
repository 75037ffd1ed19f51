"""The vocabulary of lemmas against a plain version over whole groups."""

import random
from collections import Counter

from pyspark.sql import functions as F

from quern.functions import fixed
from quern.operators import lexicon, vocab


def restored(token, known):
    for end, put in (("ita", "ità"), ("it", "ità")):
        if token.endswith(end):
            return token[: -len(end)] + put if token[: -len(end)] + put in known else token
    return token


def merged(counts):
    """stem -> leading stem, over a whole vocabulary in the order of first appearance."""
    lead = {s: s for s in counts}

    def join(a, b):
        a, b = lead[a], lead[b]
        win, lose = (a, b) if counts[a] >= counts[b] else (b, a)
        for s in lead:
            if lead[s] == lose:
                lead[s] = win

    for s in counts:
        if s not in fixed.STEMS and lead[s] == s:
            for other in vocab.inflection_candidates(s):
                if other in lead and lead[other] != lead[s]:
                    join(s, other)
                    break
    stumps = {}
    for s in counts:
        if s not in fixed.STEMS and len(s) > 3 and s[-1] in "oaie":
            stumps.setdefault(s[:-1], []).append(s)
    for group in stumps.values():
        first, *rest = sorted(group, key=lambda s: (-counts[lead[s]], s))
        for s in rest:
            if lead[s] != lead[first]:
                join(s, first)
    return lead


def plain(rows):
    """group -> (lemma rows, bigram rows), in order."""
    out = {}
    for group in {g for _, g, _ in rows}:
        texts = [t for _, g, t in sorted(rows, key=lambda r: r[0]) if g == group]
        known = {w for t in texts for w in t}
        forms = [[restored(w, known) for w in t] for t in texts]
        stem = lambda f: fixed.STEMS.get(f, f)
        flat = [(f, stem(f)) for t in forms for f in t if f not in fixed.STOP and stem(f) not in fixed.STOP]
        stems = Counter(s for _, s in flat)
        lead = merged(dict(stems))
        lemmas, seen = Counter(lead[s] for _, s in flat), {}
        for f, s in flat:
            seen.setdefault(lead[s], Counter())[f] += 1
        pairs = Counter()
        for t in forms:
            for a, b in zip(t, t[1:]):
                if stem(a) not in fixed.STOP and stem(b) not in fixed.STOP:
                    pairs[f"{stem(a)} {stem(b)}"] += 1
        # most_common keeps the order of first appearance on ties
        out[group] = [(w, n, [f for f, _ in seen[w].most_common()]) for w, n in lemmas.most_common()], pairs.most_common()
    return out


def test_lemma_vocabulary_against_a_plain_version(spark):
    rng = random.Random(8)
    words = [a + b for a in ("spess", "zon", "buon", "sottil", "latt", "crost", "ross", "gran", "tagli", "intens", "umid") for b in ("o", "a", "i", "e", "", "io", "ita", "it", "ità")]
    words += list(fixed.STEMS)[:40] + fixed.STOP + ["intensità", "intensita", "intensit", "umidità"]
    rows = [(i, rng.choice(["x", "y", None]), [rng.choice(words) for _ in range(rng.choice([0, 1, 2, 9, 15]))]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, g string, t array<string>").repartition(5)
    entries = lexicon.dictionary(lexicon.word_table(df, F.col("t"), "g", "doc_id"), "g")
    lemmas = lexicon.surfaces(entries, "g", "lemma").collect()
    pairs = lexicon.stem_bigrams(df, F.col("t"), "g", "doc_id", entries).collect()
    for group, (want, bigrams) in plain(rows).items():
        # merging may put a lemma's name before its own first appearance, so ties are in order of the first form
        mine = sorted((r for r in lemmas if r.g == group), key=lambda r: (-r.n, r.first_at))
        assert [(r.lemma, r.n, list(r.surfaces)) for r in mine] == want
        assert [(r.bigram, r.n) for r in sorted((r for r in pairs if r.g == group), key=lambda r: (-r.n, r.first_at))] == bigrams
    assert sum(len(r.surfaces) > 1 for r in lemmas) > 20


def test_hot_words_and_empty_rows(spark):
    rows = spark.createDataFrame([(i, "x", ["intensit", "lunga", f"w{i}"]) for i in range(3000)] + [(3000, "x", ["intensità"]), (3001, "x", []), (3002, "x", None)], "doc_id long, g string, t array<string>")
    entries = lexicon.dictionary(lexicon.word_table(rows, F.col("t"), "g", "doc_id"), "g")
    top = lexicon.surfaces(entries, "g", "lemma").orderBy(F.desc("n")).first()
    assert (top.lemma, top.n, top.surfaces) == ("intensità", 3001, ["intensità"])
    pairs = lexicon.stem_bigrams(rows, F.col("t"), "g", "doc_id", entries)
    assert pairs.orderBy(F.desc("n")).first().n == 3000 and pairs.count() == 3001
    none = rows.limit(0)
    assert lexicon.stem_bigrams(none, F.col("t"), "g", "doc_id", lexicon.dictionary(lexicon.word_table(none, F.col("t"), "g", "doc_id"), "g")).count() == 0
