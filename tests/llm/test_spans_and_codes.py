"""Personal data, periodic runs and vector codes against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quern.llm import codes, privacy, runs

from test_cases import CLASHING, hard  # noqa: F401

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# personal data


def plain_matches(text):
    """kind -> [(start, end, value or None)], by the plain patterns; value None: a match that fails."""
    out = {}
    for kind, pattern in privacy.KINDS.items():
        found = []
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(d) if i % 2 == 0 else sum(map(int, str(2 * int(d)))) for i, d in enumerate(reversed(digits))) % 10 == 0
            fits = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else None, "card": 13 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]
            if kind == "card" and not 13 <= len(digits) <= 19:
                continue
            found.append((m.start(), m.end(), (digits if kind in ("card", "phone") else m[0].translate(LOWER)) if fits else None))
        out[kind] = found
    return out


def plain_findings(texts, reach=privacy.REACH, k=privacy.GENERALISE_K):
    words = [[(m.start(), m.end(), m[0].translate(LOWER)) for m in re.finditer(r"[^\W_]+", t) if len(m[0]) >= privacy.TERM and re.search(r"[^\W\d_]", m[0])] for t in texts]
    matches = [plain_matches(t) for t in texts]
    near, n_c, n_t = defaultdict(set), defaultdict(set), Counter(w for ws in words for w in {x[2] for x in ws})
    for row, (found, ws) in enumerate(zip(matches, words, strict=True)):
        for kind, spans in found.items():
            for i, (a, b, value) in enumerate(spans):
                if value is None:
                    continue
                n_c[kind, value].add(row)
                low, high = spans[i - 1][1] if i else -1, spans[i + 1][0] if i + 1 < len(spans) else math.inf
                near[kind, value] |= {(row, t) for s, e, t in ws if (e < a and s >= a - reach and s > low) or (s > b and e <= b + reach and e < high)}
    action = defaultdict(dict)
    for c, pairs in near.items():
        n_ct = Counter(t for _, t in pairs)
        for row, t in pairs:
            if n_t[t] <= n_ct[t]:
                action[row][t] = "removed"
            elif math.log(len(texts) * n_ct[t] / (len(n_c[c]) * n_t[t])) >= (1 - 1 / k) * math.log(len(texts) / len(n_c[c])) - 1e-12:
                action[row].setdefault(t, "generalised")
    out = []
    for row, (found, ws) in enumerate(zip(matches, words, strict=True)):
        base = [(kind, a, b) for kind, spans in found.items() for a, b, v in spans if v is not None]
        added = [(action[row][t], s, e) for s, e, t in ws if t in action[row] and not any(a < e and b > s for _, a, b in base)]
        order = [*privacy.KINDS, "generalised", "removed"]
        out.append(sorted(base + added, key=lambda x: (order.index(x[0]), x[1])))
    return out


TRICKY = [
    "a@b.c%x@d.e and z..q@-.- é@x.y @a.b a@b a@b.c.",
    "1.2.3.4.5.6.7.8.9 256.1.1.1 001.02.000.255 1.2.3 99999999999999999999.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111111111 x4111111111111111y 4111  111111111111",
    "+49 (30) 123-45-67 +1.......2 +12345678901234567 ++4912345678 +4930 1234567-",
    "call+4930123456\nnow\n+4930123456 İstanbul ẞ ＡＢＣ née@x.org \U0001f600smile",
]


def test_matches_by_linear_patterns(spark):
    rng = random.Random(3)
    pieces = ["a", "Z", "9", "@", ".", "-", " ", "+", "(", "12", "4111111111111111", "255", "x@y.z", "\n", "é", "_", "%"]
    texts = TRICKY + ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: [(f.kind, f.start, f.end) for f in r.findings if f.kind in privacy.KINDS] for r in privacy.findings(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == [(k, a, b) for k, spans in plain_matches(t).items() for a, b, v in spans if v is not None], t


def test_disclosing_terms_against_brute_force(spark):
    rng = random.Random(4)
    common, rare = [f"wort{i}" for i in range(12)], [f"Rar{i}x" for i in range(400)]
    things = ["boss@corp.org", "+49 30 1234567", "4111111111111111", "10.0.0.1", "only@one.net"]
    texts = []
    for i in range(150):
        words = [rng.choice(common if rng.random() < 0.8 else rare) for _ in range(rng.randint(0, 40))]
        if i % 3 == 0:
            words.insert(rng.randint(0, len(words)), rng.choice(things))
            words.insert(rng.randint(0, len(words)), "Zorblax")
        texts.append(rng.choice([" ", ", ", "\n"]).join(words))
    texts += texts[:5] + TRICKY
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: [(f.kind, f.start, f.end) for f in r.findings] for r in privacy.findings(df, k=3).collect()}
    want = plain_findings(texts, k=3)
    assert [got[i] for i in range(len(texts))] == want
    kinds = Counter(k for spans in want for k, _, _ in spans)
    assert kinds["removed"] and kinds["generalised"] and all(not s for s, t in zip(want, texts, strict=True) if not re.search(r"[0-9@]", t))
    # fewer words fall when less may be revealed before a term counts as telling
    strict = {r.doc_id: len(r.findings) for r in privacy.findings(df, k=64).collect()}
    assert sum(strict.values()) < sum(map(len, want))


def test_sanitised_text(spark):
    rows = [(0, "Write to Grumbald via a@b.co or 4111111111111111 now"), (1, "now write to or via him"), (2, "+4912345678901234"), (3, None)]
    got = {r.doc_id: r for r in privacy.sanitised(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].text == "Write to  via [email] or [card] now" and {f.kind for f in got[0].findings} == {"email", "card", "removed"}
    assert (got[1].text, got[2].text, got[3].text) == (rows[1][1], "+4912345678901234", "")
    both = privacy.sanitised(spark.createDataFrame([(0, "+4111111111111111")], "doc_id long, text string")).first()  # 16 digits: a card, no phone
    assert both.text == "+[card]"


def test_privacy_on_hard_and_empty_rows(spark, hard):  # noqa: F811
    rows = hard.select("doc_id", "text").collect()
    found = privacy.findings(hard).collect()
    assert len(found) == len(rows) and sorted(map(str, (r.doc_id for r in found))) == sorted(map(str, (r.doc_id for r in rows)))
    assert all(f.kind not in privacy.KINDS for r in found for f in r.findings)
    assert privacy.findings(hard.limit(0)).count() == privacy.sanitised(hard.limit(0)).count() == 0
    one = "x@y.zz " * 3
    long = spark.createDataFrame([(1, one), (1, one), (None, one), (2, "a" * 300_000 + "@" + "b." * 50_000 + "c"), (3, "7" * 200_000), (4, "+" + "(" * 200_000), (5, "m@n.op " * 2000)], "doc_id long, text string")
    got = Counter((str(r.doc_id), sum(f.kind == "email" for f in r.findings), len(r.findings)) for r in privacy.findings(long).collect())
    assert got == {("1", 3, 3): 2, ("None", 3, 3): 1, ("2", 1, 1): 1, ("3", 0, 0): 1, ("4", 0, 0): 1, ("5", 2000, 2000): 1}


# runs


def plain_runs(w, least=runs.LEAST, times=runs.TIMES):
    out = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in out.items())


def test_runs_against_brute_force():
    rng = random.Random(5)
    for _ in range(400):
        docs = []
        for _ in range(rng.randint(0, 5)):
            n, k = rng.choice([0, 1, 2, 7, 20, 60]), rng.choice([1, 2, 2, 3, 6])
            w = [rng.randrange(k) for _ in range(n)]
            if n and rng.random() < 0.5:
                a, p = rng.randrange(n), 1 + rng.randrange(max(1, n // 3))
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            docs.append(w)
        ends_of = np.cumsum([len(w) for w in docs]).astype(np.int64)
        symbols, ends = np.array([x for w in docs for x in w], np.int64), np.repeat(ends_of, [len(w) for w in docs])
        least, times = rng.choice([(6, 4), (2, 2), (4, 3)])
        found = list(zip(*(x.tolist() for x in runs.runs_of(symbols, ends, least, times)), strict=True))
        want = [(s + e - len(w), n, q) for w, e in zip(docs, ends_of.tolist(), strict=True) for s, n, q in plain_runs(w, least, times)]
        assert found == sorted(want, key=lambda r: (r[0], r[2]))


def test_common_prefixes_and_lyndon_roots():
    rng = random.Random(6)
    w = [rng.randrange(2) for _ in range(200)] + [0] * 40
    forward = runs.Suffixes(np.array(w), np.full(len(w), len(w)))
    for _ in range(300):
        a, b = rng.sample(range(len(w)), 2)
        same = next((i for i in range(len(w)) if max(a, b) + i >= len(w) or w[a + i] != w[b + i]))
        assert forward.common(np.array([a]), np.array([b])).tolist() == [same]
    start, length = runs.lyndon_roots(forward, np.full(len(w), len(w)))
    for i, n in list(zip(start.tolist(), length.tolist(), strict=True))[: len(w)]:
        assert all(w[i : i + n] < w[j : i + n] for j in range(i + 1, i + n))  # a Lyndon word
        longer = w[i : i + n + 1]
        assert i + n == len(w) or any(longer >= longer[j:] for j in range(1, n + 1))  # and no longer one begins here


def test_run_rows_against_brute_force(spark, hard):  # noqa: F811
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 80)))) for i in range(200)] + [(i, "la " * 9 + "x") for i in range(200, 240)] + [(None, "a b c d e f g h i j k l m n o p"), (7, None), (7, None)]
    want = Counter()
    for doc_id, text in rows:
        w = (text or "").split()
        n, h = len(w), zlib.crc32(str(doc_id).encode() if doc_id is not None else b"")
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = plain_runs(w)
        gone = {i for s, m, q in found for i in range(s + q, s + m)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        want[doc_id, len(found), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in sorted(found, key=lambda r: (r[0], r[2])))), sha(" ".join(x for i, x in enumerate(w) if i not in gone))] += 1
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter(tuple(r[c] for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) for r in runs.periodic_runs(table, remap=runs.periodised).collect())
    assert got == want and any(r[1] for r in want)
    assert runs.periodic_runs(hard).count() == hard.count() and runs.periodic_runs(hard.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "a b " * 200_000), (2, " ".join(map(str, range(300_000)))), (3, "z")], "doc_id long, text string")
    assert {r.doc_id: (r.n_runs, r.start, r.length, r.period) for r in runs.periodic_runs(long).collect()} == {1: (1, 0, 400_000, 2), 2: (0, None, None, None), 3: (0, None, None, None)}


def test_white_space_is_ascii(spark):
    text = "a\x0bb\x0cc d e\x1cf\x85g"
    (r,) = runs.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert r.n_words == len(re.findall(r"[^\x20\x09-\x0D]+", text)) == 3


# vector codes


def plain_codes(rows, parts, entries, rounds, scale):
    kept = [(i, label, [math.floor(scale * x) for x in v]) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][2]) // parts if kept else 0
    first = sorted(kept, key=lambda r: (r[0] is None, r[0], r[2]))[:entries]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, _, v in first] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            held = defaultdict(list)
            for _, _, v in kept:
                held[near(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(held[i]) for c in zip(*held[i], strict=True)] if i in held else e for i, e in enumerate(books[p])]
    out = [(i, label, *zip(*(near(cut(v, p), books[p]) for p in range(parts)), strict=True)) for i, label, v in kept]
    return [(i, label, tuple(c), sum(e)) for i, label, e, c in out], books


@pytest.mark.parametrize("n", [0, 3, 300])
def test_codes_against_plain_lloyd(spark, n):
    rng = random.Random(n)
    rows = [(i, [rng.choice([0.0, 0.125, -0.3, 1.7]) if rng.random() < 0.7 else rng.gauss(0, 2) for _ in range(8)], rng.choice([0, 1, None])) for i in range(n)]
    rows += rows[:2] + [(5, r[1], r[2]) for r in rows[7:9]] + [(None, r[1], 3) for r in rows[:1]]
    rows += [(900, None, 1), (901, [1.0] * 7 + [None], 1), (902, [math.nan] * 8, 1), (903, [math.inf] + [0.0] * 7, 1)]
    schema = "vec_id long, embedding array<double>, label int, " + ", ".join(f"`{c}` string" for c in [*CLASHING, "q", "row", "v", "part", "entry"])
    table = spark.createDataFrame([(*r, *("x",) * (len(CLASHING) + 5)) for r in rows], schema).repartition(4)
    told, books = codes.vector_codes(table, parts=4, entries=16, rounds=2, scale=256)
    want, plain = plain_codes(rows, 4, 16, 2, 256)
    assert books.tolist() == plain
    assert Counter((r.id, r.label, tuple(r.codes), r.error) for r in told.collect()) == Counter(want)
    if n:
        near = min(told.collect(), key=lambda r: r.error)
        assert len(codes.read_back(near.codes, books)) == 8


def test_vectors_that_cannot_be_cut(spark):
    for rows in ([(1, [1.0] * 5, 0)], [(1, [1.0] * 4, 0), (2, [1.0] * 8, 0)], [(1, [], 0)]):
        with pytest.raises(ValueError):
            codes.vector_codes(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), parts=4)
    with pytest.raises(Exception, match="too large"):
        codes.vector_codes(spark.createDataFrame([(1, [1e9] * 4, 0)], "vec_id long, embedding array<double>, label int"), parts=4)


@pytest.mark.parametrize("name", ["op11_pii", "op12_periodic_runs", "op13_vector_codes"])
def test_against_sql(spark, name):
    import duckdb

    from quern.llm import registry

    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    df = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    result = c.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert Counter(tuple(r[x] for x in names) for r in df.collect()) == Counter(result.fetchall())
