"""Small tables with nulls, empty and long texts, ties, repeated rows, no rows, and clashing columns."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentria.llm import html_text, lm_scoring, quality_model, quality_rules, toxicity
from sentria.llm.components import components
from sentria.llm.decontaminate import contamination
from sentria.llm.jaccard_join import jaccard_components
from sentria.llm.line_dedup import dedup_lines
from sentria.llm.packing import first_fit_decreasing, pack
from sentria.llm.token_files import Codebook, code_lengths, joined_crc, read_tokens, write_tokens

SCHEMA = "doc_id long, text string, lang string, n_words int, score double, drops string, label int"
LONG = " ".join(f"word{k % 977}x{k}" for k in range(30_000))


@pytest.fixture(scope="module")
def odd(spark):
    texts = [None, "", "   \n\t", "same line here\nown", "Same Line Here  \nother\n", "one two three", LONG, LONG, "x" * 5000]
    rows = [(k, t, None, 1, 0.5, "d", 9) for k, t in enumerate(texts)]
    rows += [(3, texts[3], "en", 1, 0.5, "d", 9)] * 2 + [(None, "same line here", None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_line_dedup(odd, none):
    rows = dedup_lines(odd).select("doc_id", "n_lines", "n_dropped", "text", "lang").collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert (by[0].n_lines, by[0].text, by[2].n_lines) == (1, "", 2)
    assert by[3].text == "same line here\nown" and by[3].n_dropped == 0
    assert by[4].text == "other\n" and by[4].n_dropped == 1
    assert by[7].text == "" and by[7].n_dropped == 1 and by[6].n_dropped == 0
    assert [r.text for r in rows if r.doc_id is None] == ["same line here"]
    assert dedup_lines(none).count() == 0


def test_line_dedup_many_lines(spark):
    lines = [f"line number {k}" for k in range(200)]
    a, b = "\n".join(lines[:130]), "\n".join(lines)
    out = {r.doc_id: r for r in dedup_lines(spark.createDataFrame([(5, a), (9, b)], "doc_id long, text string")).collect()}
    assert out[5].n_dropped == 0 and out[9].n_dropped == 130
    assert out[9].text == "\n".join(lines[130:])


def test_packing(odd, none):
    rows = pack(odd, sequence=256, group_docs=4).toPandas()
    assert pack(none).count() == 0
    per_row = odd.count()
    assert (rows["start"] == 0).sum() == per_row
    assert rows["length"].sum() == rows.loc[rows["start"] == 0, "doc_tokens"].sum()
    for _, group in rows.sort_values("offset").groupby("sequence_id"):
        assert (group["offset"].to_numpy() == np.cumsum(group["length"]) - group["length"]).all()
        assert group["length"].sum() <= 256
    assert rows.loc[rows["doc_id"] == 0, "doc_tokens"].tolist() == [1]


MARKED = [
    "hello <|endoftext|> world",
    "A<|endoftext|>B, <|ENDOFTEXT|> <|startoftext|><|endoftext|>x",
    "<|end<|endoftext|>oftext|> e<|endoftext|>\u0301 no mark",
    "<|endoftext|>",
    "<|EndOfText|> only looks like one",
]


def test_added_tokens_are_one_id(spark, monkeypatch):
    from tokenizers import Tokenizer

    from sentria.llm import tokens

    library = Tokenizer.from_file(tokens.default_vocabulary())
    wanted = [library.encode(t, add_special_tokens=False).ids for t in MARKED]
    assert 49407 in wanted[0]
    own = tokens.WordEncoder(tokens.default_vocabulary())
    assert [np.frombuffer(b, "<u4").tolist() for b in own.encode(MARKED)] == wanted
    # The marks outlive a restart of the cache.
    monkeypatch.setattr(tokens, "CACHE_WORDS", 3)
    assert [np.frombuffer(b, "<u4").tolist() for b in own.encode(MARKED[::-1], step=1)] == wanted[::-1]
    crc = [zlib.crc32(np.array([*w, 2], "<u4").tobytes()) for w in wanted]
    docs = spark.createDataFrame(list(enumerate(MARKED)), "doc_id long, text string")
    packed = pack(docs, sequence=256).orderBy("doc_id").collect()
    assert [(r.length, r.ids_crc32) for r in packed] == [(len(w) + 1, c) for w, c in zip(wanted, crc)]
    rows = read_tokens(spark, write_tokens(docs)).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.ids_crc32) for r in rows] == [(len(w) + 1, c) for w, c in zip(wanted, crc)]
    assert [r.start for r in rows] == [sum(len(w) + 1 for w in wanted[:k]) for k in range(len(wanted))]


def test_other_added_tokens_go_to_the_library(tmp_path):
    import json

    from tokenizers import Tokenizer

    from sentria.llm import tokens

    vocabulary = json.load(open(tokens.default_vocabulary()))
    vocabulary["added_tokens"][1] |= {"lstrip": True, "special": False}
    path = tmp_path / "vocabulary.json"
    path.write_text(json.dumps(vocabulary))
    library = Tokenizer.from_file(str(path))
    found = tokens.WordEncoder(str(path)).encode(MARKED)
    assert [np.frombuffer(b, "<u4").tolist() for b in found] == [
        library.encode(t, add_special_tokens=False).ids for t in MARKED
    ]


def test_first_fit_decreasing_is_first_fit():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 100, 200).tolist()
    bins, _ = first_fit_decreasing(sizes, 100)
    free: list[int] = []
    expected = {}
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        at = next((i for i, f in enumerate(free) if f >= sizes[k]), len(free))
        if at == len(free):
            free.append(100)
        free[at] -= sizes[k]
        expected[k] = at
    assert bins == [expected[k] for k in range(len(sizes))]
    assert first_fit_decreasing([], 10) == ([], [])


def test_code_lengths_are_optimal_and_limited():
    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55])
    free, short = code_lengths(counts, 16), code_lengths(counts, 4)
    assert sum(2.0 ** -free) == 1 and free.max() == 9
    assert short.max() == 4 and sum(2.0**-short) <= 1
    assert code_lengths(np.array([7])).tolist() == [1] and len(code_lengths(np.array([]))) == 0


@pytest.mark.parametrize("n", [1, 255, 256, 257, 5000])
def test_codebook_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.05, n), 400)
    used, counts = np.unique(ids, return_counts=True)
    book = Codebook(used, code_lengths(counts))
    assert (book.decode(*book.encode(ids), n) == ids).all()


def test_joined_crc():
    parts = [b"abc", b"", b"x" * 1000]
    assert joined_crc([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(b"".join(parts))


def test_token_files(odd, none, spark, monkeypatch):
    from sentria.llm import token_files

    monkeypatch.setattr(token_files, "BLOCK", 1000)
    rows = read_tokens(spark, write_tokens(odd)).toPandas().sort_values("start")
    assert len(rows) == odd.count()
    assert rows["start"].tolist() == (rows["n_tokens"].cumsum() - rows["n_tokens"]).tolist()
    assert rows["doc_id"].isna().tolist()[0] and rows["doc_id"].dropna().is_monotonic_increasing
    end = zlib.crc32(np.array([2], "<u4").tobytes())
    assert rows.loc[rows["doc_id"].isin([0, 1, 2]), "ids_crc32"].tolist() == [end] * 3
    assert read_tokens(spark, write_tokens(none)).count() == 0


def test_html(spark):
    main = "<h1>T&amp;t</h1><p>One &lt;b&gt;\n two<br>three<p>F<b>o</b>ur"
    page = f"<html><body><nav><a href=/>Home</a></nav><article>{main}</article><footer>&copy; us</footer></body></html>"
    rows = [(1, page, "a", 3), (1, page, "a", 3), (2, None, "b", 0), (3, "", "c", 0), (4, "<p", None, None), (5, "<div>" * 3000 + page, "d", 1)]
    table = spark.createDataFrame(rows, "page_id long, html string, text string, n_chars int")
    out = html_text.extract(table).collect()
    by = {r.page_id: r for r in out}
    assert by[1].text == "T&t One <b> two three Four" and by[1].n_chars == len(by[1].text)
    assert [by[k].text for k in (2, 3, 4)] == [""] * 3 and len(out) == 6
    assert html_text.extract(table.limit(0)).count() == 0


def test_decoding_is_consistent():
    nodes = html_text.parse("<div><p>a</p><div><p>b</p></div></div>")
    rng = np.random.default_rng(0)
    for _ in range(50):
        kept = html_text.decode(nodes, rng.normal(size=len(nodes)))
        assert all(kept[x.parent] for x, k in zip(nodes, kept) if k and x.parent >= 0)


def test_new_layouts_are_read():
    layouts, right = html_text.Layouts(seed=123), 0
    for _ in range(60):
        page = layouts.page()
        nodes = html_text.parse(page)
        right += html_text.texts_of([page], html_text.trained())[0] == html_text.joined(nodes, np.array([x.marked for x in nodes]))
    assert right >= 57


def test_lm(odd, none):
    out = lm_scoring.score_documents(odd, F.col("doc_id") != 6).toPandas()
    assert len(out) == odd.count() and np.isfinite(out["score"]).all()
    assert out.loc[out["doc_id"] == 0, "n_tokens"].tolist() == [1]
    assert out["train_tokens"].nunique() == 1
    assert lm_scoring.score_documents(none, F.lit(True)).count() == 0
    untrained = lm_scoring.score_documents(odd, F.lit(False)).toPandas()
    assert (untrained["train_tokens"] == 0).all() and np.isfinite(untrained["base_score"]).all()


def test_lm_is_a_distribution_over_bits():
    model = lm_scoring.Model()
    batch = lm_scoring.lay_out([b"ab", b"", b"ab"])
    for bit, slots in lm_scoring.bits(batch):
        _, gate, p = lm_scoring.predict(model, bit, slots)
        assert ((0 < p) & (p < 1)).all()
    cost = lm_scoring.word_bits(model, [b"ab", b"", b"ab"])
    assert cost[0] == pytest.approx(cost[2])


def test_lm_repeats():
    asked, hit, p = lm_scoring.repeats([b"a", b"b", b"c", b"a", b"b", b"c", b"a", b"d"])
    assert asked.tolist() == [False, False, False, False, True, True, True, True]
    assert hit.tolist() == [False, False, False, False, True, True, True, False]


def test_lm_repeats_of_several_texts():
    rng = np.random.default_rng(3)
    texts = [[b"%d" % x for x in rng.integers(0, 6, n)] + [b""] for n in (0, 40, 1, 200, 0, 90)]
    text_of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    together = lm_scoring.repeats_of(lm_scoring.first_places(texts), text_of)
    for got, *alone in zip(together, *map(lm_scoring.repeats, texts)):
        assert got.tolist() == np.concatenate(alone).tolist()


def test_lm_head_does_not_reach_the_driver_from_every_task(spark, monkeypatch):
    words = [(b"%d" % k, k % 7, 1 + 200 // (k + 1), -float(k)) for k in range(400)]
    scored = spark.createDataFrame(words, "word binary, c long, total long, score double").repartition(13, "word")
    for size in (30, 220, 1000):
        monkeypatch.setattr(lm_scoring, "HEAD_WORDS", size)
        wanted = sorted(words, key=lambda w: (-w[2], w[0]))[:size]
        group = f"head-{size}"
        spark.sparkContext.setJobGroup(group, "the head")
        # Off by default in Spark; local sessions of this library set it.
        spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "false")
        try:
            head = lm_scoring.head_of(scored)
        finally:
            spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert head.column("word").to_pylist() == [w[0] for w in wanted]
        assert head.column("score").to_pylist() == [w[3] for w in wanted]
        # The rows come from one task; collected as rows, every partition sends a head of its own.
        tracker = spark.sparkContext.statusTracker()
        last = tracker.getJobInfo(max(tracker.getJobIdsForGroup(group)))
        assert tracker.getStageInfo(max(last.stageIds)).numTasks == 1
    assert lm_scoring.head_of(scored.limit(0)).num_rows == 0


def test_lm_tables_pass_the_driver_in_pieces(spark):
    words = spark.createDataFrame([(b"%d" % (k * k), 1 + k % 3) for k in range(3000)], "word binary, c long")
    counts = lm_scoring.gather_counts(words)
    name, pieces = lm_scoring.send(counts)
    chunks = {(r["k"], r["chunk"]) for r in counts.collect()}
    # Before, all chunks were one list in the driver and one broadcast.
    assert len(chunks) > lm_scoring.PIECE and max(len(p.value) for p in pieces) <= lm_scoring.PIECE
    assert {(k, chunk) for p in pieces for k, chunk, _ in p.value} == chunks
    tables = lm_scoring.unpacked((name, pieces))
    bytes_in_all = sum((len(r["word"]) + 1) * r["c"] for r in words.collect())
    assert all(t.sum() == 8 * bytes_in_all for t in tables)


def test_models_without_labels(odd, none, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    weights = quality_model.fit(odd, labels)
    assert {r.score for r in quality_model.score(odd, weights).collect()} == {0.5}
    model = toxicity.fit(odd, labels)
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == odd.count() and all(r.score < 0.3 and r.passages == [] for r in rows)
    assert toxicity.score(none, model).count() == 0 and quality_model.score(none, weights).count() == 0


def test_segments_match_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(40):
        n = 40
        marked = [(k, float(rng.normal())) for k in range(n) if rng.random() < 0.5]
        score = np.full(n, -toxicity.DRIFT)
        for k, s in marked:
            score[k] += s
        best = max((score[a:b].sum() for a in range(n) for b in range(a + 1, n + 1)), default=0)
        found = toxicity.segments(marked)
        assert max((s for *_, s in found), default=0) == pytest.approx(max(best, 0) if best > 0 else 0)
        for a, b, s in found:
            assert score[a:b].sum() == pytest.approx(s)
        assert all(x[1] <= y[0] for x, y in zip(found, found[1:]))


def test_decontamination(spark, odd, none):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    items = spark.createDataFrame(
        [(1, item, "z"), (1, item, "z"), (2, None, None), (3, "", ""), (None, item, ""), (4, "two words", ""), (5, "r r r r r r r r", "")],
        "item_id long, text string, lang string",
    )
    docs = spark.createDataFrame(
        [
            (10, f"before that {item.upper()} after this"),
            (11, item.replace("gamma", "other")),
            (12, item + " x"),
            (13, "Two  Words"),
            (14, None),
            (None, item),
            (15, "q r r r r r r r r q"),
            (16, item),
            (16, item),
        ],
        "doc_id long, text string",
    )
    rows = {(r.doc_id, r.item_id): r for r in contamination(docs, items).collect()}
    assert set(rows) == {(10, 1), (12, 1), (13, 4), (15, 5), (16, 1)}
    assert (rows[10, 1].start, rows[10, 1].length, rows[10, 1].similarity) == (2, 12, 1.0)
    assert contamination(none, items).count() == 0 and contamination(docs, items.limit(0)).count() == 0
    assert contamination(odd, items).count() == 0


def test_decontamination_after_insertions(spark):
    """The best window may start between two alignments; all starts, against brute force."""
    from sentria.llm.decontaminate import SHINGLE

    item = [f"i{k}" for k in range(104)]
    changed = [f"c{k}" for k in range(3)] + item[3:-3] + [f"d{k}" for k in range(3)]
    texts = {1: [f"x{k}" for k in range(200)] + changed[:52] + [f"n{k}" for k in range(6)] + changed[52:] + ["y"] * 90}
    rng = np.random.default_rng(11)
    for k in range(2, 40):
        words = list(item)
        for _ in range(rng.integers(0, 4)):
            at = int(rng.integers(0, len(words)))
            words[at : at + int(rng.integers(0, 4))] = [f"e{rng.integers(0, 999)}" for _ in range(rng.integers(0, 4))]
        texts[k] = [f"x{j}" for j in range(rng.integers(0, 20))] + words + [f"z{j}" for j in range(rng.integers(0, 20))]
    grams = lambda w: [tuple(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)]
    own, wanted = set(grams(item)), {}
    for k, words in texts.items():
        g = grams(words)
        size = min(len(g), len(own))
        shared = [len(own & set(g[at : at + size])) for at in range(len(g) - size + 1)]
        best = max((c / (len(own) + size - c), -at) for at, c in enumerate(shared))
        if best[0] >= 0.8:
            wanted[k] = (round(best[0], 6), -best[1])
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in texts.items()], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    found = {r.doc_id: (r.similarity, r.start) for r in contamination(docs, items).collect()}
    assert found == wanted and wanted[1] == (0.818182, 203)


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (5, 5), (3, 1), (20, 21), (21, 22), (22, 23), (23, 24), (None, 4)]
    out = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7} | {k: 20 for k in range(20, 25)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_jaccard(spark, odd, none):
    rows = {r.doc_id: r for r in jaccard_components(odd).where("doc_id is not null").collect()}
    assert rows[0].n_shingles == 0 and rows[2].component_id == 2 and rows[5].n_shingles == 1
    assert rows[7].component_id == 6 and rows[3].component_id == 3
    lost = jaccard_components(odd).where("doc_id is null").collect()
    assert [r.component_id for r in lost] == [None]
    assert jaccard_components(none).count() == 0


def test_jaccard_rows_that_share_a_doc_id(spark):
    """Two texts under one doc_id, in one family: both keep their links."""
    base = [f"w{k}" for k in range(130)]
    # a and b have a prefix n-gram in common but do not link; 7 is near a, 8 is near b.
    a, b = base[:100], base[45:130] + [f"v{k}" for k in range(15)]
    texts = [(5, a), (5, b), (7, a[:-1] + ["x"]), (8, b[:-1] + ["y"]), (9, a[1:-1])]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in texts], "doc_id long, text string")
    got = [(r.doc_id, r.component_id) for r in jaccard_components(docs).orderBy("doc_id").collect()]
    assert got == [(5, 5), (5, 5), (7, 5), (8, 5), (9, 5)]


def test_jaccard_families_of_many_blocks(spark, monkeypatch):
    """A large group of near copies, cut into blocks, against brute force."""
    from sentria.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    rng = np.random.default_rng(1)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for k in range(150):
        words = list(base[: rng.integers(90, 120)])
        for at in rng.integers(0, len(words), rng.integers(0, 5)):
            words[at] = f"edit{rng.integers(0, 40)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_components(docs).collect()}
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    label = list(range(len(sets)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    assert got == {k: find(k) for k in range(len(sets))}


def test_jaccard_families_only_of_sets_that_may_link(spark, monkeypatch):
    """A chain of documents with half their n-grams in common: none near its neighbour, so none goes on to the blocks."""
    from sentria.llm import jaccard_join

    counted = {}

    def staged(df, name, write=jaccard_join.staged):
        out = write(df, name)
        counted[name] = out.count()
        return out

    monkeypatch.setattr(jaccard_join, "staged", staged)
    passages = [" ".join(f"p{k}w{i}" for i in range(40)) for k in range(31)]
    texts = [f"{passages[k]} {passages[k + 1]}" for k in range(30)] + [passages[3] + " " + passages[4] + " end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_components(docs).collect()}
    assert got == {k: k for k in range(30)} | {30: 3}
    assert counted["families"] == 2


def test_quality_rules(odd, none):
    rows = quality_rules.ledger(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert (by[0].n_words, by[0].word_chars, by[2].n_words, by[5].n_words) == (0, 0, 0, 3)
    assert by[8].failed & quality_rules.BIT["long_words"]
    assert quality_rules.ledger(none).count() == 0


def test_repeated_windows(spark):
    text = "a b c d e f a b c d e g h i"
    row = quality_rules.ledger(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.n_repeat_words == 10


def test_ablations(spark, odd):
    ledger = quality_rules.ledger(odd).cache()
    policy = "v2"
    mask, failed = quality_rules.POLICIES[policy], [r.failed for r in ledger.collect()]
    for r in quality_rules.ablations(ledger, policy).collect():
        bit = quality_rules.BIT[r.rule]
        assert r.n_failed == sum(bool(f & bit) for f in failed)
        assert r.n_only == sum((f & mask) == bit for f in failed)
        assert r.n_kept_without == sum(not f & mask & ~bit for f in failed)


def test_hash_of_kept_text(spark):
    out = dedup_lines(spark.createDataFrame([(1, "é\n")], "doc_id long, text string")).select(F.sha2("text", 256).alias("h"))
    assert out.first().h == hashlib.sha256("é\n".encode()).hexdigest()
