import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from granthika.llm import languages, levels, pages, quality, scans, sitelines

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
CHAPTERS = "chapter_id bigint, content_id string, chapter string, text string, source string, medium string, own_text string"
LINE = "Print this page or listen to it at home"


def chapters(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (7 - len(r))) for r in rows], CHAPTERS)


def test_site_lines(spark):
    rows = [(i, f"c{i}", None, f"first text about {chr(97 + i) * 9} of many words\n  {LINE.upper()}!\n\nshort", "HTTP://Site.example/x" if i % 2 else "https://site.EXAMPLE") for i in range(6)]
    rows += [(10, None, None, LINE, "https://site.example/y"), (11, "c1", None, LINE, None), (12, "c1", None, None, "https://site.example"), (13, "c1", None, LINE, "https://elsewhere.example/"), (14, "c1", None, "", "https://site.example")]
    df = chapters(spark, rows)
    got = sorted((r.chapter_id, r.line_no) for r in sitelines.found(df).collect())
    assert got == [(i, 2) for i in range(6)] + [(10, 1)]
    own = {r.chapter_id: r.own_text for r in sitelines.mark_site_lines(df).select("chapter_id", "own_text").collect()}
    assert own[0] == "first text about aaaaaaaaa of many words\n\nshort" and own[10] == "" and own[11] == LINE and own[12] is None
    assert sitelines.found(df.limit(0)).count() == 0


def test_site_lines_keep_other_columns(spark):
    df = chapters(spark, [(i, f"c{i}", None, f"text {chr(97 + i) * 9}\n{LINE}", "https://s.example/") for i in range(6)])
    for c in ("site_key", "site", "line_key", "k0", "depth", "site_keys_", "contents"):
        df = df.withColumn(c, F.lit("mine"))
    got = sitelines.mark_site_lines(df)
    assert {"site_key", "site", "line_key", "k0", "depth", "contents"} <= set(got.columns)
    assert [r.site_line_nos for r in got.collect()] == [[2]] * 6 and got.first().line_key == "mine"


def _ways(monkeypatch):
    """Few or many chunks, blocks sent to the rows or rows to the blocks."""
    for chunk in (500_000, 6):
        for most in (500_000, -1):
            monkeypatch.setattr(sitelines, "CHUNK_LINES", chunk)
            monkeypatch.setattr(sitelines, "BROADCAST_BLOCKS", most)
            yield chunk, most


def test_site_lines_every_way(spark, monkeypatch):
    """Null and repeated ids are rows like any other, however the work is divided."""
    rows = [(i, f"c{i}", None, f"text {chr(97 + i) * 9}\n{LINE}", "https://s.example/") for i in range(6)]
    rows += [(0, "c9", None, f"{LINE}\nanother text under a used id", "https://s.example/"), (None, "c8", None, f"a\nb\n{LINE}", "https://s.example/"), (None, None, None, LINE, "https://s.example/")]
    df = chapters(spark, rows)
    want = sorted([(i, 2) for i in range(6)] + [(0, 1), (-1, 3), (-1, 1)])
    for way in _ways(monkeypatch):
        assert sorted((-1 if r.chapter_id is None else r.chapter_id, r.line_no) for r in sitelines.found(df).collect()) == want, way
    own = sitelines.mark_site_lines(df).where("chapter_id = 0").select("own_text").collect()
    assert sorted(r.own_text for r in own) == ["another text under a used id", "text aaaaaaaaa"]


def _plain_site_lines(rows):
    """The definition, line by line."""
    at = {}
    contents = {}
    for i, c, text, s in rows:
        contents.setdefault(s, set()).add(c)
        for n, line in enumerate(text.split("\n"), 1):
            k = "".join(x for x in line if x.isalpha()).lower()
            if len(k) >= 15:
                at.setdefault((s, k), []).append((i, n, c))
    return sorted((i, n) for (s, _), hits in at.items() if len({c for _, _, c in hits}) >= max(5, 0.05 * len(contents[s])) for i, n, _ in hits)


def test_site_lines_against_the_definition(spark, monkeypatch):
    rng = np.random.default_rng(6)
    lines = [f"{w} line of some site that many pages show" for w in "alpha beta gamma delta epsilon zeta eta theta".split()]
    rows = []
    for i in range(160):
        c = "hot" if i % 4 == 0 else f"c{rng.integers(0, 60)}"
        at = int(rng.integers(0, 6))
        body = [f"own words {chr(97 + i % 26) * 4} {chr(97 + i // 26) * 7} of this page", *lines[at : at + int(rng.integers(1, 4))], "short", *([lines[6], lines[7]] if i % 3 == 0 else [])]
        rows.append((i, c, "\n".join(body), f"https://s{i % 3}.example/"))
    df = chapters(spark, [(i, c, None, t, s) for i, c, t, s in rows])
    want = _plain_site_lines(rows)
    assert len(want) > 200
    for way in _ways(monkeypatch):
        assert sorted(map(tuple, sitelines.found(df).collect())) == want, way


def test_suffix_array():
    rng = np.random.default_rng(0)
    for n, kinds in ((1, 2), (50, 3), (400, 2), (300, 40)):
        line = rng.integers(0, kinds, n).astype(np.uint64)
        line[-1] = 0
        sa, shared = sitelines.suffix_array(line)
        # A line that doesn't count equals no other.
        told = [(0, int(x)) if x else (1, i) for i, x in enumerate(line)]
        assert sorted(sa) == list(np.flatnonzero(line))
        for i in range(1, len(sa)):
            a, b = told[sa[i - 1] :], told[sa[i] :]
            same = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert shared[i] == same and (same < len(a) or same < len(b))


BLOCK = "alpha beta gamma delta line\nsecond line of this block\nthird line of this block\nfourth line of this block\nlast line of this block"


def test_blocks_are_maximal(spark, monkeypatch):
    df = chapters(spark, [(i, f"c{i}", None, f"body {i} {chr(97 + i) * 9}\n{BLOCK}\nend {i}", "https://s.example/") for i in range(12)])
    assert [(r.depth, r.contents) for r in sitelines.repeated_blocks(sitelines.with_line_keys(df)).collect()] == [(5, 12)]
    # Two blocks that meet: what they share is a block of its own.
    df = df.unionByName(chapters(spark, [(100 + i, f"d{i}", None, "second line of this block\nthird line of this block", "https://s.example/") for i in range(3)]))
    assert sorted((r.depth, r.contents) for r in sitelines.repeated_blocks(sitelines.with_line_keys(df)).collect()) == [(2, 15), (5, 12)]


def test_without_common_prefixes_lines_are_missed(spark, monkeypatch):
    """Lines inside a block go by the block alone: with prefixes cut at one line they stay."""
    df = chapters(spark, [(i, f"c{i}", None, f"body {i} {chr(97 + i) * 9}\n{BLOCK}", "https://s.example/") for i in range(6)])
    assert sitelines.found(df).count() == 30
    whole = sitelines.blocks_of
    monkeypatch.setattr(sitelines, "blocks_of", lambda *a: whole(*a).query("depth == 1"))
    assert sitelines.found(df).count() == 0


PROSE = "The cat sat on the mat and it was happy. When the dog came in, the cat went out to the garden. "
KINDS = {
    1: (PROSE * 2, "prose"), 2: ("\n".join(f"- late coin x {i}" for i in range(10, 30)), "list"), 3: ("Item\tTime\tCost\n" + "\n".join(f"coin\t{i}.5\t{i}%" for i in range(20)), "table"),
    4: ("dsmk tvlb gtlk smbr ghgd cjcr zntx mkbq hgzk gwtw lrfc lbwb ggvl hzdz sgjc szwf " * 2, "junk"), 5: ("few words only", None), 6: (None, None), 7: ("   ", None), 8: ("word " * 20_000, "prose"),
}


def test_text_types(spark):
    common = spark.createDataFrame([("en", w, i) for i, w in enumerate("the a and it was to in on when went out is of".split())], "lang string, word string, word_rank int")
    df = spark.createDataFrame([(k * 100 + j, t) for k, (t, _) in KINDS.items() for j in range(3)], "chapter_id bigint, own_text string")
    got = {r.chapter_id: r.kind for r in quality.text_types(df, common).collect()}
    assert len(got) == 3 * len(KINDS)
    for k, (_, kind) in KINDS.items():
        if k != 8:
            assert got[k * 100] == kind, (k, got[k * 100])
    assert quality.text_types(df.limit(0), common).count() == 0


def test_label_model_learns_accuracy():
    rng = np.random.default_rng(0)
    truth = rng.integers(0, 2, 4000)
    votes = np.stack([np.where(rng.random(4000) < a, truth, 1 - truth) + 1 for a in (0.9, 0.85, 0.8)], 1)
    pats = pd.Series(["".join(map(str, v)) for v in votes])
    model = quality.fit_label_model(sorted(pats.value_counts().items()))
    right = np.mean([int(np.argmax(model[p])) == t for p, t in zip(pats, truth, strict=True)])
    assert right >= 0.88


def test_accuracies_decide_and_not_the_number_of_votes():
    """Two poor functions outvote a good one in a plain count; learned accuracies do not let them."""
    rng = np.random.default_rng(3)
    n = 20_000
    truth = rng.integers(0, 4, n)
    def noisy(a):  # noqa: E306
        return np.where(rng.random(n) < a, truth, rng.integers(0, 4, n)) + 1
    v = np.stack([noisy(0.95), noisy(0.9), noisy(0.25), noisy(0.25), noisy(0.2)], 1)
    counted = pd.Series(["".join(map(str, x)) for x in v]).value_counts()
    def right(rounds):  # noqa: E306
        model = quality.fit_label_model(sorted(counted.items()), rounds=rounds)
        return np.mean([int(np.argmax(model["".join(map(str, x))])) == t for x, t in zip(v, truth, strict=True)])
    assert right(200) > right(0) + 0.02 and right(200) > 0.93


@needs_data
def test_learned_types_differ_from_the_majority(spark):
    """On real pages the learning decides, too: lists whose cells and numbers outvote their entries."""
    base = DATA.replace("sf0.001", "sf0.01")
    marked = sitelines.mark_site_lines(spark.read.parquet(f"{base}/chapters.parquet")).select("chapter_id", "own_text")
    seen = quality.vote_patterns(marked, "own_text", quality.common_word_set(spark.read.parquet(f"{base}/common_words.parquet")), ["chapter_id"]).where("n_words >= 10")
    counts = sorted((r.pattern, r["count"]) for r in seen.groupBy("pattern").count().collect())
    model, plain = quality.fit_label_model(counts), quality.fit_label_model(counts, rounds=0)
    other = [p for p, _ in counts if np.argmax(model[p]) != np.argmax(plain[p])]
    assert other
    trust = quality.accuracies(counts, model)
    names = [(r[0], r[3]) for r in quality.RULES]
    assert trust[names.index(("common_share", "prose"))] > 0.98 > 0.9 > trust[names.index(("cell_share", "table"))]


def corpus(n=300):
    rng = np.random.default_rng(1)
    nouns, verbs = "mirror stream barometer window teacher garden".split(), "watches moves carries follows".split()
    return [" ".join(f"The {rng.choice(nouns)} slowly {rng.choice(verbs)} the small {rng.choice(nouns)} near the well-known river." for _ in range(4)) for _ in range(n)]


def test_scans(spark):
    clean = corpus()
    noisy = "WATER CYCLE AT HOME\nThe rnirror slow-\nly w@tches the srnall bar0meter near the well-\nknown ri-\nver. The strearn rests.\n\nThe tcacher moves.\n- 14 -"
    rows = [(i, "Chapter 3 — Water Cycle at home", t) for i, t in enumerate(clean)] + [(1000, "Chapter 3 — Water Cycle at home", noisy), (1001, None, "The mirror moves.\nPage 3"), (1002, "x", None), (1003, "x", "  "), (1004, "Chapter 3 — Water Cycle at home", "W4TER CYCLE AT H0ME   12\nThe garden moves the window.")]
    df = spark.createDataFrame(rows, "chapter_id bigint, chapter string, own_text string")
    got = {r.chapter_id: r for r in scans.repaired(df).collect()}
    assert sorted(got[1000].noise) == ["glyph", "header", "hyphen", "pageno"]
    assert got[1000].repaired.startswith("The mirror slowly watches the small barometer near the well-known river.") and "\n\nThe teacher moves." in got[1000].repaired
    assert got[1001].noise == ["pageno"] and got[1002].repaired is None and got[1003].noise == [] and got[1004].noise == ["header", "pageno"]
    assert all(not got[i].noise for i in range(len(clean)))
    types = spark.createDataFrame([(1001, "list")], "chapter_id bigint, kind string")
    assert {r.chapter_id for r in scans.found(df, types).collect()} == {1000, 1004}
    assert scans.repaired(df.limit(0)).count() == 0


def test_vectors_decide(spark, monkeypatch):
    """Without vectors, or with random ones, no word is corrected for its letters alone; with them the context chooses among words."""
    rng = np.random.default_rng(5)
    texts = [f"A {rng.choice(['bright', 'small', 'broken'])} lamp shows the heat near our {rng.choice(['oven', 'stove', 'fire'])}." for _ in range(300)]
    texts += [f"My {rng.choice(['dear', 'good', 'little'])} brother will beat every {rng.choice(['carpet', 'drum', 'egg'])} today." for _ in range(300)]
    texts.append("My dear brothcr will beat evcry drum today. My good brothcr will beat evcry egg today.")
    df = spark.createDataFrame([(i, None, t) for i, t in enumerate(texts)], "chapter_id bigint, chapter string, own_text string")
    last = lambda: {r.chapter_id: r for r in scans.repaired(df).where(f"chapter_id = {len(texts) - 1}").collect()}[len(texts) - 1]
    speller = scans.fit_speller(df, "own_text")
    assert np.isfinite(speller.least)
    assert speller.best(["beat", "heat"], ["shows", "the", "near", "our"])[0] == "heat" and speller.best(["heat", "beat"], ["brother", "will", "every", "drum"])[0] == "beat"
    assert speller.best(["heat"], ["brother", "will", "every", "drum"])[1] is False and speller.best(["heat"], [])[1] is False
    got = last()
    assert got.noise == ["glyph"] and got.repaired.startswith("My dear brother will beat every drum")
    for off in (lambda c: (np.zeros((c.size, 24), np.float32),) * 2, lambda c: tuple(rng.normal(0, 1, (2, c.size, 24)).astype(np.float32))):
        monkeypatch.setattr(scans, "skip_gram", off)
        assert last().noise == []


def test_furniture_in_a_stack():
    name = "Chapter 3 — Water Cycle at home"
    speller = scans.Speller({}, [], np.zeros((0, 24)), np.zeros((0, 24)), np.inf)
    text = "\n".join(["Water Cycle at home", "- 4 -", "WATER CYCLE AT HOME", "page 4", "Water Cycle", "The rain falls."])
    assert scans.repair(text, name, speller)[:2] == ("Water Cycle The rain falls.", ["header", "pageno"])


def test_headers_letterspaced_or_misread():
    f = scans.Furniture("Chapter 3 — Water Cycle at home")
    for line in ("W A T E R  C Y C L E  A T  H O M E", "W4T3R CYC1E 4T H0M3", "vvatcr cyclc at borne", "Water Cycle at home"):
        assert f.of(line) == (True, False), line
    assert f.of("W A T E R  C Y C L E  A T  H O M E   1 2")[0] and not f.of("The weather of our home town")[0] and not f.of("S T R E A M S  A N D  R I V E R S")[0]
    long = "Chapter 3 — " + "The Long Way Of Water From The Clouds To The Sea And Back Again Through Rivers Fields And Forests"
    assert scans.Furniture(long).of(" ".join(scans.chapter_name(long).upper())) == (True, False)


def test_skip_gram_puts_like_words_together():
    words = [w for t in corpus() for w in [*t.lower().replace(".", "").split(), None]]
    vocab = sorted({w for w in words if w})
    at = {w: i for i, w in enumerate(vocab)}
    c = np.zeros((len(vocab),) * 2, np.float32)
    for off in (1, 2):
        for a, b in zip(words, words[off:]):
            if a and b:
                c[at[a], at[b]] += 1
                c[at[b], at[a]] += 1
    u, _ = scans.skip_gram(c)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    cos = lambda a, b: float(u[at[a]] @ u[at[b]])
    assert cos("mirror", "stream") > 0.6 > cos("mirror", "watches")


def test_rare_dictionary_words_have_vectors(spark):
    rng = np.random.default_rng(2)
    # More than 2,000 words are more frequent than the misreading, and what it stands for is only 30 times as frequent.
    filler = [a + b + c for a in ("ka", "zo", "wa", "ty", "po", "sa", "ko") for b in ("mo", "ta", "po", "wy", "ko") for c in (x + y for x in "ktzpswmgr" for y in "aoy" + "w" + "s" + "p" + "z")][:2100]
    texts = [" ".join(rng.permutation(filler)) for _ in range(26)]
    texts += [f"The {'rnirror' if i % 31 == 0 else 'mirror'} shows the bright lamp near the window. A bright river passes our old garden." for i in range(620)]
    texts.append("The rnirror moves. A rnirror shows the bright lamp. My rnirror passes.")
    df = spark.createDataFrame([(i, None, t) for i, t in enumerate(texts)], "chapter_id bigint, chapter string, own_text string")
    speller = scans.fit_speller(df, "own_text")
    assert 20 * speller.words["rnirror"] <= speller.words["mirror"] < 100 * speller.words["rnirror"] and sorted(speller.words.values())[-2001] > speller.words["rnirror"]
    assert speller.false_words == {"rnirror": "mirror"}
    got = {r.chapter_id: r for r in scans.repaired(df).collect()}[len(texts) - 1]
    assert got.noise == ["glyph"] and "rnirror" not in got.repaired


def test_pair_counts_and_blocks(spark, monkeypatch):
    texts = [*corpus(20), "mirror mirror mirror", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "own_text string").repartition(3)
    vocab = sorted({scans.bare(w) for t in texts if t for w in t.split()})
    at = {w: i for i, w in enumerate(vocab)}
    want = np.zeros((len(vocab),) * 2)
    for ids in ([at[scans.bare(w)] for w in t.split()] for t in texts if t):
        for off in (1, 2):
            for a, b in zip(ids, ids[off:]):
                want[a, b] += 1
                want[b, a] += 1
    monkeypatch.setattr(scans, "HELD_PAIRS", 7)
    got = scans.co_occurrence(df, "own_text", vocab)
    assert (got.block(0, len(vocab), got.n) == want).all()
    whole = scans.skip_gram(got, rounds=3)
    monkeypatch.setattr(scans, "BLOCK_CELLS", 5 * len(vocab))
    assert all(np.allclose(x, y, atol=1e-4) for x, y in zip(whole, scans.skip_gram(got, rounds=3)))


@needs_data
def test_languages_held_out(spark):
    s = pd.read_parquet(f"{DATA}/lang_samples.parquet")
    rows = list(zip(s.lang, s.text, strict=True))
    train, test = rows[::2], rows[1::2]
    model = languages.ByteTagger(sorted(set(s.lang))).fit(train, steps=350)
    right = [model.langs[int(p.mean(0).argmax())] == g for (g, _), p in zip(test, model.read([languages.clean(t) for _, t in test]), strict=True)]
    assert np.mean(right) >= 0.98
    en, hi, fr = (next(t for g, t in test if g == k) for k in ("en", "hi", "fr"))
    df = spark.createDataFrame([(1, f"{en} {hi}"), (2, None), (3, "  "), (4, fr), (4, fr), (5, en * 400)], "chapter_id bigint, own_text string")
    got = sorted((r.chapter_id, r.lang) for r in languages.document_languages(df, model).collect())
    assert got == [(1, "en"), (1, "hi"), (4, "fr"), (4, "fr"), (5, "en")]
    whole = languages.clean(f"{en} {hi} {hi} " * 40)
    (langs, at_once), (same, sliced) = next(languages.read_languages(model, [whole], True)), languages.read_long(model, whole, 4096)
    assert {k for k, _, _ in langs} == {k for k, _, _ in same} and abs(sum(x[3] for x in sliced) - sum(x[3] for x in at_once)) <= len(whole) // 4096 + 1
    assert all(a[1] == b[0] for a, b in zip(sliced, sliced[1:])) and sliced[-1][1] == len(whole)
    parts = languages.document_languages(df.where("chapter_id = 1"), model, by_passage=True).orderBy("passage").collect()
    assert [p.lang for p in parts] == ["en", "hi"] and all(0.5 < p.confidence <= 1 for p in parts)
    pages_ = df.withColumn("medium", F.expr("case chapter_id when 4 then 'French' when 5 then ' HINDI ' end"))
    types = spark.createDataFrame([(2, "junk")], "chapter_id bigint, kind string")
    samples = spark.read.parquet(f"{DATA}/lang_samples.parquet")
    assert sorted((r.chapter_id, r.lang) for r in languages.found(pages_, types, samples).collect()) == [(1, "en"), (1, "hi"), (5, "en")]


def test_gradient_is_right():
    m = languages.ByteTagger(["a", "b"], hidden=3)
    for n in ("table", "u", "out", "bias"):
        setattr(m, n, getattr(m, n).astype(np.float64))
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 256, (6, languages.STRIDE, 4)), rng.integers(0, 2, (6, 4))
    _, grads = m.gradient(x, y)
    for w, g in zip((m.table, m.u, m.out), grads, strict=False):
        i = tuple(int(k[0]) for k in np.unravel_index([int(np.abs(g).argmax())], g.shape))
        old = w[i]
        w[i] = old + 1e-3
        up = m.gradient(x, y)[0]
        w[i] = old - 1e-3
        down = m.gradient(x, y)[0]
        w[i] = old
        assert abs((up - down) / 2e-3 - g[i]) < 2e-3 * max(1, abs(g[i]) * 20)


@needs_data
def test_levels_held_out(spark):
    s = pd.read_parquet(f"{DATA}/level_samples.parquet")
    rows = list(zip(s.level, s.text, strict=True))
    model = levels.LevelModel(rows[::2])
    reader = levels.Reader(model.words)
    assert np.mean([model.level(reader, t)[0] == g for g, t in rows[1::2]]) >= 0.95
    easy, hard = next(t for g, t in rows if g == 1), next(t for g, t in rows if g == 4)
    stray = hard + " The cat is on the mat. 12 13 14 15"
    df = spark.createDataFrame([(1, easy, "en"), (2, stray, None), (3, None, "en"), (4, "", "en"), (5, "short text", "en"), (6, hard, "fr"), (6, hard, "en")], "doc_id bigint, text string, lang string")
    got = sorted(tuple(r) for r in levels.found(df, spark.read.parquet(f"{DATA}/level_samples.parquet"), spark.read.parquet(f"{DATA}/lang_samples.parquet")).collect())
    assert got == [(1, 1), (2, 4), (6, 4)]


def test_long_texts_are_cut_at_sentences():
    text = ("One two three. " * 50).encode()
    ends, at = [], 0
    while at < len(text):
        at = languages._slice_end(text, at, 100)
        ends.append(at)
    assert ends[-1] == len(text) and all(text[:e].rstrip().endswith(b".") and e % 2 == 0 for e in ends)
    deva = "क".encode() * 50
    assert languages._slice_end(deva, 0, 100) == 99 and languages._slice_end(b"x" * 250, 0, 100) == 100


def test_ranker_learns_from_all_pairs(monkeypatch):
    rng = np.random.default_rng(4)
    of = rng.integers(1, 5, 60).astype(float)
    z = rng.normal(size=(60, 5)) + of[:, None] * np.array([1, 0.5, 0, 0, -0.2])
    d = np.array([z[i] - z[j] for i in range(60) for j in range(60) if of[i] > of[j]])
    want = np.zeros(5)
    for _ in range(20):
        want += 0.5 * ((d / (1 + np.exp(d @ want))[:, None]).mean(0) - 1e-3 * want)
    monkeypatch.setattr(levels, "BLOCK_PAIRS", 100)
    assert np.allclose(levels.rank(z, of, 20, 0.5, 1e-3), want)
    assert (levels.rank(z[:3], np.ones(3), 20, 0.5, 1e-3) == 0).all()


def test_isotonic_is_monotone():
    ends, values = levels.isotonic(np.array([1.0, 2, 3, 4, 5]), np.array([1.0, 3, 2, 2, 4]))
    assert list(values) == sorted(values) and ends[-1] == 5


def test_pages_of_nothing(spark):
    df = spark.createDataFrame([], CHAPTERS)
    assert pages.without_site_lines(df.drop("own_text")).count() == 0
