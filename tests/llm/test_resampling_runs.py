"""Resampling, periodic runs and sanitising: small tables, brute force, planted terms."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from sentria.llm import importance, periodic_runs, sanitise

SCHEMA = "doc_id long, text string, weight string, kind int, spans int, runs int, score string, _row int"
EXTRA = ("w", 1, 2, 3, "s", 4)
LONG = "a b " * 5000 + " ".join(f"w{k}" for k in range(20_000))


@pytest.fixture(scope="module")
def odd(spark):
    texts = [None, "", " \n\t", "One two three " * 9, "one TWO three " * 9, "x" * 5000, LONG, "Ünï cödé 1-2_3 🙂 " * 3]
    rows = [(k, t, *EXTRA) for k, t in enumerate(texts)] + [(3, texts[3], *EXTRA)] * 3 + [(None, "a a a a a a", *EXTRA)]
    return spark.createDataFrame(rows + [(None, None, *EXTRA)], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# Resampling


def _features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def _resampled(docs, target, percent, min_words):
    bucket = lambda f: zlib.crc32(f.encode()) % importance.BUCKETS
    count = lambda texts: Counter(bucket(f) for t in texts for f in _features(t)[1])
    s, t = count([d[1] for d in docs]), count(target)
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(
        1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))
    )
    rows = []
    for doc_id, text in docs:
        words, features = _features(text)
        name = f"42:{'' if doc_id is None else doc_id}"
        h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
        w = sum(gain(bucket(f)) for f in features)
        rows.append([doc_id, len(words), len(features), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    able = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return sorted(([*r, drawn.get(id(r))] for r in rows), key=repr)


@pytest.mark.parametrize("percent, min_words", [(5, 20), (50, 1), (100, 0), (0, 0)])
def test_resample(spark, odd, percent, min_words):
    target = ["one two", None, "", "cödé 1 2 3", "one two"]
    found = importance.resample(
        odd, spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id int, text string"), percent, 42, min_words
    )
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    columns = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(([*r] for r in found.select(*columns).collect()), key=repr) == _resampled(docs, target, percent, min_words)


def test_resample_of_nothing(spark, odd, none):
    assert importance.resample(none, odd).count() == 0
    assert importance.resample(odd, none).count() == odd.count()


def test_features_cross_stretches():
    text = " ".join(f"w{k % 37}" for k in range(500)).encode()
    whole = Counter(h for _, hs in importance.feature_hashes(text) for h in hs)
    for step in (1, 2, 7, 100):
        parts = list(importance.feature_hashes(text, step))
        assert Counter(h for _, hs in parts for h in hs) == whole and sum(n for n, _ in parts) == 500
    assert whole == Counter(zlib.crc32(f.encode()) for f in _features(text.decode())[1])


def test_rank_over_many_partitions(spark):
    rows = [(k % 97, 30, 1, 0, random.Random(k).randrange(40)) for k in range(3000)]
    scored = spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long").repartition(13)
    found = [r for r in importance.draw(scored, 40).collect() if r["rank"]]
    want = sorted((-r[4], r[0]) for r in rows)[:1200]
    assert [(-r.score, r.doc_id) for r in sorted(found, key=lambda r: r["rank"])] == want
    assert sorted(r["rank"] for r in found) == list(range(1, 1201))


# Periodic runs


def _runs(words, min_length=6, exponent=4):
    n, out = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(min_length, exponent * q):
                out.setdefault((i, j + q), q)
            i = j
    return sorted(((a, b - a, q) for (a, b), q in out.items()), key=lambda r: (r[0], r[2]))


def test_runs_of_all_short_sequences():
    for n in range(13):
        some = [list(w) for w in itertools.product("ab", repeat=n)]
        assert periodic_runs.runs_of(some) == [_runs(w) for w in some]
        assert periodic_runs.runs_of(some, 4, 2) == [_runs(w, 4, 2) for w in some]


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_random_sequences(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(150):
        words = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randrange(80))]
        p = rng.randrange(1, 9)
        words += [rng.randrange(9) for _ in range(p)] * rng.randrange(1, 9) + words[: rng.randrange(9)]
        texts.append(words)
    for bounds in ((6, 4), (1, 3), (20, 2), (9, 5)):
        assert periodic_runs.runs_of(texts, *bounds) == [_runs(w, *bounds) for w in texts]


def test_runs_of_long_and_hot_sequences():
    n = 60_000
    assert periodic_runs.runs_of([["a"] * n, [], ["b", "c"] * n]) == [[(0, n, 1)], [], [(0, 2 * n, 2)]]
    phrase = [x for k in range(8000) for x in ("the", "same", "five", "words", "again", k)]
    assert periodic_runs.runs_of([phrase]) == [[]]


def test_periodic_runs_table(odd, none):
    assert periodic_runs.periodic_runs(none).count() == 0
    rows = periodic_runs.periodic_runs(odd).collect()
    texts = odd.collect()
    assert len(rows) == len(texts)
    want = Counter()
    for r in texts:
        words = (r.text or "").encode().split()
        runs = _runs(words) if len(words) < 1000 else [(0, 10_000, 2)]
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        want[r.doc_id, str(runs), " ".join(w.decode() for k, w in enumerate(words) if k not in gone)] += 1
    assert Counter((r.doc_id, str([tuple(x) for x in r.runs]), r.collapsed) for r in rows) == want


def test_op13(spark, sf_dir):
    found = {r.doc_id: r for r in periodic_runs.op13_periodic_runs(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(docs)
    with_runs = 0
    for d in docs:
        words = (d.text or "").encode().split()
        n, h = len(words), zlib.crc32(str(d.doc_id).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 3000:
            continue
        runs = _runs(words)
        with_runs += bool(runs)
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        r = found[d.doc_id]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *(top or (None,) * 3))
        assert r.exponent_milli == (1000 * top[1] // top[2] if top else None)
        assert r.runs_sha256 == hashlib.sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest()
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        assert r.collapsed_sha256 == hashlib.sha256(kept).hexdigest()
    assert with_runs


# Sanitising


def _planted():
    names = ["Zorina Quill", "zorina QUILL"]
    docs = [
        (k, f"{chr(97 + k) * 4} text {chr(107 + k) * 5}, {names[k % 2]} <zq@mail.example.com> wrote {chr(98 + k) * 4}."
            f"\nLater Quill-Zorina: 10.0.0.{k}, quill@zorina.example.org")
        for k in range(6)
    ]
    # Copies of one text are no evidence for their terms.
    docs += [(20 + k, "Bertram Copy wrote from copy@mail.example.com today") for k in range(30)]
    return docs + [(60 + k, f"text without anything wrote later {k} from today") for k in range(40)]


ODD = (
    "a@b.c_x@d.e 999.1.2.3.4.5.6.7 1.2.3.4.5.6.7.8 000255.0.0.1 256.1.1.1 4111 1111-1111 1111 x 4111111111111112 "
    "4111  1111111111111111 +1 (234) 555-66 +1234567 +12345678( a.b@c a@b..c@d.e @x.y é@f.g ü+1-2-3-4-5-6-7-8-"
)


def _brute(text):
    out = []
    for kind, pattern in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in re.sub("[^0-9]", "", m.group())]
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card":
                twice = sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits)))
                if not 16 <= len(digits) <= 19 or twice % 10:
                    continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_entities_against_brute_force(spark, odd):
    rng = random.Random(7)
    texts = [ODD, None, ""] + ["".join(rng.choices("a1 .-@+x4", k=rng.randrange(200))) for _ in range(300)]
    texts += ["".join(rng.choices(["4111111111111111", "1.2.3.4", "a@b.c", " ", "-", "+44 20", "5", "é"], k=12)) for _ in range(200)]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    for r in sanitise.personal_data(frame).collect():
        assert [tuple(s) for s in r.spans if s.kind != "term"] == _brute(texts[r.doc_id] or ""), texts[r.doc_id]


def test_entities_in_very_long_texts(spark):
    long = "9" * 50_000 + " " + "1 " * 30_000 + "x@" + "y." * 30_000 + "z +" + "1" * 50_000 + " ok@a.b " + "q" * 50_000
    found = sanitise.personal_data(spark.createDataFrame([(1, long)], "doc_id long, text string")).collect()
    assert [tuple(s) for s in found[0].spans] == [(k, a, b) for k, a, b in _brute(long)] and len(found[0].spans) == 2


def test_sanitise_table(spark, odd, none):
    assert sanitise.personal_data(none).count() == 0 and sanitise.sanitise(none).count() == 0
    assert all(not r.spans for r in sanitise.personal_data(odd).collect())
    texts = odd.collect()
    out = sanitise.sanitise(odd)
    assert out.columns == odd.columns
    assert Counter(r.text for r in out.collect()) == Counter(r.text or "" for r in texts)


def test_revealing_terms(spark):
    frame = spark.createDataFrame(_planted() + [(None, _planted()[0][1])] * 2, "doc_id long, text string")
    rows = [r for r in sanitise.personal_data(frame).collect()]
    texts = dict(_planted())
    for r in rows:
        text = texts.get(r.doc_id, texts[0])
        terms = {text[s.start : s.end].lower() for s in r.spans if s.kind == "term"}
        want = {"zorina", "quill", "later"} if r.doc_id is None or r.doc_id < 6 else set()
        # "later" also stands in the plain texts, "text" and "wrote" in all.
        assert terms == want - {"later"}
        assert sum(s.kind == "term" for s in r.spans) == 2 * len(terms)
    assert len(rows) == frame.count()
    out = {r.doc_id: r.text for r in sanitise.sanitise(frame).collect()}
    assert "uill" not in out[0] and "orina" not in out[3].replace("[EMAIL]", "") and out[0].count("[EMAIL]") == 2
    assert out[20] == "Bertram Copy wrote from [EMAIL] today" and out[60] == texts[60]


def test_sanitise_sql_on_planted_terms(spark, tmp_path):
    docs = _planted() + [(200, ODD), (201, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = sanitise.op11_sanitise(spark, str(tmp_path))
    want = duck.execute(sanitise.OP11_SQL)
    names = [c[0] for c in want.description]
    assert sorted(map(repr, map(tuple, found.select(*names).collect()))) == sorted(map(repr, want.fetchall()))
    assert found.where("n_term > 0").count() == 6
