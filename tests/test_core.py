import json
import math
import os
import shutil
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from granthika.functions import signal as S
from granthika.functions import text as T
from granthika.operators import chunking, grounding, harvest, index, providers, search, telemetry, tfidf
from granthika.plans import catalogue
from granthika.sources import files, rest
from granthika.streaming import operators as streams

REFERENCE = [
    "Green leaves trap sunlight by photosynthesis and make food from water and air",
    "Photosynthesis needs chlorophyll, a green pigment of the leaf",
    "Heat flows from a hot body to a cold body by conduction",
    "Acids turn blue litmus red",
    "A river carries sand to the sea",
]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, t, f"do_{i}", f"Chapter {i}", None, i) for i, t in enumerate(REFERENCE)]
    return spark.createDataFrame(rows, "chunk_id bigint, text string, content_id string, chapter string, section string, page int")


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "request_id int, text string")


def python_tfidf(texts, queries):
    tok = lambda t: [w for w in __import__("re").findall(r"\w+", t.lower()) if len(w) > 2 and w not in T.STOPWORDS]
    n, df = len(texts), {}
    for t in texts:
        for w in set(tok(t)):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log((1 + n) / (1 + d)) + 1 for w, d in df.items() if d <= 0.6 * n}

    def vec(t):
        c = {}
        for w in tok(t):
            if w in idf:
                c[w] = c.get(w, 0) + 1
        v = {w: (1 + math.log(k)) * idf[w] for w, k in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()} if norm else {}

    d = [vec(t) for t in texts]
    return [[round(sum(x * dv.get(w, 0) for w, x in vec(q).items()), 6) for dv in d] for q in queries]


def test_sparse_equals_python(spark, corpus):
    queries = ["What is photosynthesis?", "green leaf food", "cricket rules", "heat heat conduction"]
    want = python_tfidf(REFERENCE, queries)
    got = {(r.request_id, r.chunk_id): r.score for r in search.sparse_topk(corpus, asked(spark, *queries), k=9).collect()}
    assert got == {(i, j): s for i, row in enumerate(want) for j, s in enumerate(row) if s > 0}


def test_ranks_and_ties(spark):
    items = spark.createDataFrame([(i, "alpha beta") for i in range(5)] + [(9, "gamma delta"), (10, "omega sigma"), (11, None), (12, ""), (13, "kappa"), (14, "lambda")], "chunk_id bigint, text string")
    got = [(r.rn, r.chunk_id) for r in search.sparse_topk(items, asked(spark, "alpha"), k=3).orderBy("rn").collect()]
    assert got == [(1, 0), (2, 1), (3, 2)]
    assert search.sparse_topk(items.limit(0), asked(spark, "alpha")).count() == 0


def test_unit_norms_and_dense_ids(spark, corpus):
    c = tfidf.term_counts(corpus, "chunk_id", "text")
    v = tfidf.vocabulary(c, corpus)
    assert all(abs(r.l - 1) < 1e-9 for r in tfidf.postings(c, v, "chunk_id").groupBy("chunk_id").agg(F.sum(F.col("weight") ** 2).alias("l")).collect())
    ids = [(r.term, r.term_id) for r in tfidf.with_ids(v).orderBy("term_id").collect()]
    assert ids == [(t, i) for i, t in enumerate(sorted(t for t, _ in ids))]


@pytest.mark.parametrize(
    ("text", "want"),
    [("What is photosynthesis?", "explain"), ("Mujhe photosynthesis samjhaye, Hindi mein.", "simplify"), ("How is heat transferred?", "answer"), ("EXPLAIN in simple words", "simplify"), ("kya hota hai", "explain"), ("childlike", "answer"), ("a kidney", "simplify")],
)
def test_intents(spark, text, want):
    assert asked(spark, text).select(T.intent(F.col("text"))).first()[0] == want


def test_gate_and_answers(spark, corpus):
    r = asked(spark, "What is photosynthesis?", "Who won the cup", "heat")
    ranked = search.sparse_topk(corpus, r)
    seen = []

    def generate(df):
        seen.append({x.request_id for x in df.select("request_id").collect()})
        return df.withColumn("generated", F.when(F.col("request_id") == 2, "no answer in source").otherwise(F.concat(F.lit("Here's it: "), "first_text", F.lit(" ()"))))

    translate = lambda df: df.withColumn("localized", F.when(~F.col("refused"), F.concat(F.lit("[hi]"), "answer_en")))
    got = {x.request_id: x for x in grounding.answers(r, ranked, corpus, F.lit(0.1), generate, translate, "hi").collect()}
    assert seen == [{0, 2}]
    assert not got[0].refused and got[0].answer_en == REFERENCE[1] and got[0].spoken == "[hi]" + REFERENCE[1] and got[0].citations[0] == "SOURCE do_1 · Chapter 1 ·  (p.1)"
    assert got[1].refused and got[1].citations == [] and got[2].refused and got[2].spoken == grounding.REFUSAL_TEXT
    plain = {x.request_id: x.answer_en for x in grounding.answers(r, ranked, corpus, F.lit(0.1)).collect()}
    assert plain[2] == REFERENCE[2]
    high = grounding.gate(r, ranked, F.lit(0.99)).collect()
    assert all(x.refused for x in high) and {x.request_id: x.best_score for x in high}[1] == 0.0


def test_prompt_holds_sources(spark, corpus):
    r = asked(spark, "photosynthesis")
    p = grounding.prompts(r, grounding.sources(grounding.cited(grounding.relevant(search.sparse_topk(corpus, r), F.lit(0.1)), corpus))).first()
    assert "[1] (SOURCE do_1" in p.system_prompt and "[2] (SOURCE do_0" in p.system_prompt and p.user_prompt.startswith("Request: photosynthesis\n\n")


@pytest.mark.parametrize(("text", "want"), [("NO_ANSWER_IN_SOURCE", True), ("No answer in source.", True), ("", True), ("  \n", True), (None, True), ("Plants. no answer in source", False)])
def test_refusals(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(T.is_refusal(F.col("t"))).first()[0] is want


@pytest.mark.parametrize(("text", "want"), [("Here's an answer: Light.", "Light."), ("Here is why:\nA [] b", "A  b"), ("A (NO_ANSWER_IN_SOURCE)", "A"), ("Hereby: x", "Hereby: x"), ("plain", "plain")])
def test_cleaning(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(T.clean_answer(F.col("t"))).first()[0] == want


@settings(max_examples=15, deadline=None)
@given(st.integers(0, 400), st.integers(1, 60), st.integers(0, 70))
def test_windows_cover_all_words(spark, n, size, overlap):
    words = [f"w{i}" for i in range(n)]
    df = spark.createDataFrame([(1, " ".join(words))], "doc_id int, text string")
    got = [r.chunk_text.split() for r in chunking.chunk(df, max_words=size, overlap=overlap).orderBy("chunk_index").collect()]
    step = max(1, size - overlap)
    assert [w for i, c in enumerate(got) for w in (c if i == 0 else c[max(0, len(c) - (n - (i - 1) * step - size)) :] if (n - (i - 1) * step - size) < len(c) else c)][-1:] == words[-1:]
    assert {w for c in got for w in c} == set(words) and all(len(c) <= size for c in got)
    assert all(c[0] == f"w{i * step}" for i, c in enumerate(got))


def test_words_know_all_white_space(spark):
    df = spark.createDataFrame([("a b c\x1cd　 e\x85f",)], "t string")
    assert df.select(T.words(F.col("t"))).first()[0] == "a b c d e f".split()


def test_sentences_and_units(spark):
    t = 'One. Two!" Three?) चार। last'
    df = spark.createDataFrame([(t,)], "t string")
    assert df.select(T.sentences(F.col("t"))).first()[0] == ["One.", 'Two!"', "Three?)", "चार।", "last"]
    assert spark.createDataFrame([("v1.2 is out. Next one",)], "t string").select(T.translation_units(F.col("t"))).first()[0] == ["v1.2 is out.", "Next one"]


def test_dense_equals_numpy_in_blocks(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(60, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id bigint, embedding array<float>").repartition(3)
    q = df.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    got = {(r.query_id, r.rn): (r.vec_id, r.score) for r in search.dense_topk(df, q, 3, block=2).collect()}
    d = m.astype(float)
    for i in range(0, 60, 10):
        s = np.round(d @ d[i], 6)
        for k, j in enumerate(sorted(range(60), key=lambda j: (-s[j], j))[:3], 1):
            assert got[i, k] == (j, pytest.approx(s[j]))
    assert search.dense_topk(df, q.limit(0)).count() == 0
    with pytest.raises(Exception, match="differ in length"):
        search.dense_topk(df, q.select("query_id", F.slice("embedding", 1, 4).alias("embedding"))).collect()
    with pytest.raises(Exception, match="expected 9"):
        search.checked_dimension(df, 9).collect()


def test_harvest(spark):
    items = spark.createDataFrame(
        [("a", " A ", "http://x/a.PDF", ["B1", "B2"], None, [], ["English"], "cc", "application/pdf"), ("a", "again", "http://x/z.pdf", None, None, None, None, None, None), ("b", "B", "http://x/b.mp4", None, None, None, None, None, "video/mp4"), (None, "n", "http://x/n.pdf", None, None, None, None, None, None), ("c", None, "http://x/c.pdf", None, None, None, None, None, "application/pdf")],
        "identifier string, name string, artifact_url string, board array<string>, grade_level array<string>, subject array<string>, medium array<string>, license string, mime_type string",
    )
    pages = spark.createDataFrame([(1, "a", 1, "x" * 120, "own", "G", "S", "M", "l"), (2, "a", 2, "x" * 119, "own", "G", "S", "M", "l"), (3, "b", 1, "x" * 200, "own", "G", "S", "M", "l"), (4, "a", 3, None, "own", "G", "S", "M", "l")], "chapter_id bigint, content_id string, page int, text string, board string, grade string, subject string, medium string, license string")
    got = harvest.harvest(items, pages).collect()
    assert [(r.chapter_id, r.chapter, r.section, r.board, r.grade, r.subject, r.medium) for r in got] == [(1, "A", "page 1", "B1", "G", "S", "English")]
    c = harvest.counters(items, pages).first()
    assert (c["items"], c.other_type, c.with_text, c.without_text, c.pages) == (3, 1, 1, 1, 1)
    assert harvest.harvest(items, pages, limit=0).count() == 0
    assert [r.identifier for r in harvest.predicates(items, medium="English", mime="application/pdf").collect()] == ["a"]
    assert harvest.predicates(items).count() == 5


def test_correlation_equals_brute_force(spark):
    rng = random.Random(3)
    q = [(i, rng.randrange(3), rng.randrange(100)) for i in range(60)]
    a = [(i, rng.randrange(3), rng.randrange(100)) for i in range(60)]
    at = F.timestamp_seconds("s")
    dq = spark.createDataFrame(q, "request_id int, k int, s int").withColumn("ts", at)
    da = spark.createDataFrame(a, "response_id int, k int, s int").withColumn("ts", at)
    got = {r.request_id: r.response_id for r in telemetry.correlated(dq, da, "k", "ts", 5).collect()}
    want = {}
    for i, k, s in q:
        hits = sorted((t, j) for j, kk, t in a if kk == k and s <= t <= s + 5)
        if hits:
            want[i] = hits[0][1]
    assert got == want


def test_settings_and_routes(spark):
    one = spark.range(1)
    assert one.select(telemetry.key_value(F.lit("a=b=c"))).first()[0] == ("a", "b=c")
    with pytest.raises(Exception, match="not a setting"):
        one.select(telemetry.key_value(F.lit("abc"))).collect()
    m = one.select(telemetry.overlay(F.expr("map('a','1','b','2')"), F.expr("map('b','3')"))).first()[0]
    assert m == {"a": "1", "b": "3"}


def test_signal(spark):
    df = spark.createDataFrame([([0, 16384, -16384, 32767],), ([-32768, 5],), ([0, 0],), ([],)], "s array<smallint>")
    rows = df.select(S.peak(F.col("s")).alias("p"), S.amplified(F.col("s")).alias("g"), S.rms(F.col("s")).alias("r"), S.to_float(F.col("s")).alias("f")).collect()
    assert [r.p for r in rows] == [32767, 32768, 0, 0] and rows[2].g == [0, 0] and rows[3].g == [] and rows[0].g[3] == 32767 and rows[1].g[0] == -32768
    assert rows[0].f[:3] == [0.0, 0.5, -0.5] and rows[3].r == 0.0
    d = spark.range(1).select(S.duration_s(F.lit(32000), F.lit(2), F.lit(1), F.lit(16000)).alias("a"), S.duration_s(F.lit(4), F.lit(2), F.lit(1), F.lit(0)).alias("b")).first()
    assert (d.a, d.b) == (1.0, 2.0)


def test_wav(spark):
    pcm = bytes(range(8)) * 4
    df = spark.createDataFrame([(bytearray(pcm), 16000, 2, 1), (bytearray(pcm), 8000, 2, 2), (None, 1, 2, 1)], "pcm binary, rate int, width int, channels int")
    clips = df.withColumn("clip", files.wav_decoded(files.wav_encoded("pcm", "rate", "width", "channels")))
    got = clips.select("clip").collect()
    assert bytes(got[0].clip.pcm) == pcm and (got[1].clip.sample_rate, got[1].clip.channels) == (8000, 2) and got[2].clip is None
    assert spark.createDataFrame([(bytearray(b"junk"),)], "d binary").select(files.wav_decoded("d").error).first()[0]
    assert files.recorded(clips.limit(1)).count() == 1
    with pytest.raises(Exception, match="mono"):
        files.recorded(clips.where("channels = 2")).collect()


def test_corpus_and_manifest_files(spark, tmp_path):
    raw = {"collection": {"board": "B", "gradeLevel": "7", "subject": "S", "license": "L", "source": "http://s"}, "documents": [{"content_id": "a", "page": 1, "text": "t"}, {"content_id": "b", "page": 2, "text": "u", "board": "own"}]}
    (tmp_path / "c.json").write_text(json.dumps(raw, indent=1))
    got = files.read_corpus(spark, str(tmp_path / "c.json")).orderBy("content_id").collect()
    assert [(r.board, r.grade, r.source, r.license) for r in got] == [("B", "7", "http://s", "L"), ("own", "7", "http://s", "L")]
    assert files.read_manifest(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "m.json").write_text('{"embedder": "e",\n "dim": 3}')
    assert files.read_manifest(spark, str(tmp_path / "m.json")).first().dim == 3
    (tmp_path / "x.jsonl").write_text('{"text": "a", "page": 1}\n\n{"text": "b"}\n')
    assert files.read_chunks(spark, str(tmp_path / "x.jsonl")).count() == 2
    (tmp_path / "bad.jsonl").write_text('{"text": "a"\n')
    with pytest.raises(Exception):
        files.read_chunks(spark, str(tmp_path / "bad.jsonl")).collect()
    with pytest.raises(Exception, match="No chunks"):
        files.build_manifest(spark.createDataFrame([], "content_id string"), "e", "tfidf", 1, 120, 25, "c", 0.1).collect()
    v = files.read_vocabulary(spark, spark.createDataFrame([('{"a": 0, "b": 1}',)], "value string"))
    assert sorted(map(tuple, v.collect())) == [("a", 0), ("b", 1)]
    files.append_log(spark.range(2), str(tmp_path / "log"))
    files.append_log(spark.range(2), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4


def test_html_pages_with_fallback(spark):
    df = spark.createDataFrame([("<p>Hi <b>you</b></p><script>x</script>",), ("<img>",)], "html string")
    assert [r.text for r in files.html_pages(df, "html", lambda c: F.lit("seen")).collect()] == ["Hi you", "seen"]


def fixture_search(filters, size, offset):
    items = [{"identifier": f"i{k}", "name": f"n{k}", "board": "B" if k % 2 else ["B", "C"], "mimeType": "application/pdf"} for k in range(25)]
    return len(items), items[offset : offset + size]


def test_paged_search_source(spark):
    import sys

    # Workers import the transport by name.
    os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(os.path.dirname(__file__)), os.environ.get("PYTHONPATH", "")])
    sys.modules.setdefault("tests.test_core", sys.modules[__name__])
    reader = rest.SearchReader({"transport": f"{__name__}:fixture_search", "pagesize": "10", "limit": "22"})
    pages = reader.partitions()
    assert [(p.offset, p.size) for p in pages] == [(0, 10), (10, 10), (20, 2)]
    rows = [r for p in pages for r in reader.read(p)]
    assert len(rows) == 22 and rows[0][3] == ["B", "C"] and rows[1][3] == ["B"] and rows[0][-1] == "application/pdf"
    spark.dataSource.register(rest.CatalogueSearch)


def run_stream(spark, tmp_path, batches, schema, op):
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = op(src).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).format("parquet").option("path", str(tmp_path / "out")).start()
    q.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def test_stream_sentences_equal_batch(spark, tmp_path):
    batches = [[("a", 0, "Plants make fo", False), ("b", 0, "no end", False)], [("a", 1, "od. They grow! La", False)], [("a", 2, "st", False), ("a", 3, "", True), ("b", 1, None, True)]]
    got = run_stream(spark, tmp_path, batches, "stream_id string, seq int, chunk string, eos boolean", streams.sentences)
    assert sorted(map(tuple, got.collect())) == [("a", 0, "Plants make food."), ("a", 1, "They grow!"), ("a", 2, "Last"), ("b", 0, "no end")]


def test_stream_sentences_reads_long_answers_whole(spark, tmp_path):
    sentences = [f"Sentence {i} tells of rivers." for i in range(5000)]
    answer = json.dumps({"answer_en": " ".join(sentences), "refused": False})
    spark.createDataFrame([(1, answer)], "id bigint, response string").write.parquet(str(tmp_path / "interactions.parquet"))
    got = catalogue.stream_sentences(spark, str(tmp_path)).orderBy("index").collect()
    assert len(answer) > 100_020 and [r.text for r in got] == sentences


def test_stream_frames(spark, tmp_path):
    got = run_stream(spark, tmp_path, [[("s", 0, "BT", False)], [("s", 1, "0\r\nB", False)], [("s", 2, "T1\ndO", False)]], "stream_id string, seq int, chunk string, eos boolean", streams.frames)
    assert sorted(map(tuple, got.collect())) == [("s", 0, "BT0"), ("s", 1, "BT1")]


def test_stream_debounce(spark, tmp_path):
    got = run_stream(spark, tmp_path, [[("k", 0.0, "1"), ("k", 0.05, "0")], [("k", 0.2, "0"), ("k", 0.25, "1"), ("k", 0.5, "1")]], "key string, at double, value string", streams.debounced)
    assert sorted((r.at, r.value) for r in got.collect()) == [(0.0, "1"), (0.2, "0"), (0.5, "1")]


def test_providers_isolate_failures(spark):
    def shout(text):
        if "bad" in text:
            raise RuntimeError("no")
        return text.upper()

    df = spark.createDataFrame([(1, "fine"), (2, "bad")], "id int, text string")
    got = {r.id: (r.out, r.out_error) for r in providers.isolated(df, shout, ["text"], "out").collect()}
    assert got == {1: ("FINE", None), 2: (None, "RuntimeError: no")}
    with pytest.raises(ValueError, match="no provider"):
        providers.make("translate", "nowhere")
    assert providers.make("translate", "none")("a", "en", "hi") == "a"


def test_translation_by_sentence(spark):
    def hi(s, a, b):
        if s.startswith("Two"):
            raise RuntimeError("no")
        return f"[{b}]{s}"

    df = spark.createDataFrame([("One. Two! Three",), (None,)], "answer_en string")
    assert [r.localized for r in providers.translated(hi, "en", "hi")(df).collect()] == ["[hi]One. Two! [hi]Three", None]


def test_console(spark):
    rows = spark.createDataFrame([(1, False, "answer", "x", "y", ["a", "b"]), (2, True, "answer", "no", None, [])], "request_id int, refused boolean, intent string, answer_en string, answer_localized string, citations array<string>")
    assert [r.line for r in providers.console(rows).orderBy("request_id").collect()] == ["[answer] y\n  - a\n  - b", "[refused] no"]


def timed(spark, rows, schema, *stamps):
    df = spark.createDataFrame(rows, schema)
    for c in stamps:
        df = df.withColumn(c, F.timestamp_seconds(c))
    return df


def memory(spark, df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_stream_sessions_and_gauge(spark, tmp_path):
    rows = timed(spark, [("k", 0, 1.0), ("k", 10, 3.0), ("k", 100, 5.0)], "key string, ts int, value double", "ts")
    rows.write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    assert sorted(r.n for r in memory(spark, streams.push_to_talk(src), "sessions_", "complete").collect()) == [1, 2]
    src = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    assert sorted((r.n, r.mean) for r in memory(spark, streams.gauge(src, "60 seconds"), "gauge_", "complete").collect()) == [(1, 5.0), (2, 2.0)]


def test_stream_correlation(spark, tmp_path):
    q = timed(spark, [("A", 1000, 1), ("B", 1005, 2)], "request_kind string, request_ts int, q int", "request_ts")
    a = timed(spark, [("A", 1001, 10), ("B", 1007, 20)], "response_kind string, response_ts int, a int", "response_ts")
    q.write.parquet(str(tmp_path / "q"))
    a.write.parquet(str(tmp_path / "a"))
    got = memory(spark, streams.correlated(spark.readStream.schema(q.schema).parquet(str(tmp_path / "q")), spark.readStream.schema(a.schema).parquet(str(tmp_path / "a"))), "pairs_", "append")
    assert [(r.q, r.a) for r in got.collect()] == [(1, 10)]


def test_stream_rows_of_a_trigger_are_put_in_order(spark, tmp_path):
    """More rows of a key than an Arrow batch holds, in any order."""
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        rows = [("a", 2 * i + j, f"Number {i} " if j == 0 else "is here.", False) for i in range(200) for j in range(2)] + [("a", 400, "", True)]
        random.Random(0).shuffle(rows)
        got = run_stream(spark, tmp_path, [rows], "stream_id string, seq int, chunk string, eos boolean", streams.sentences).orderBy("index").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert [r.text for r in got] == [f"Number {i} is here." for i in range(200)]


def test_ended_streams_leave_no_state(spark, tmp_path):
    schema = "stream_id string, seq int, chunk string, eos boolean, gated boolean, citations array<string>"
    for i in range(10):
        spark.createDataFrame([(f"s{i}", 0, "One. Two", False, False, ["c"]), (f"s{i}", 1, "", True, False, ["c"])], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = []
    query = streams.delivered(streams.answers(src), str(tmp_path / "cp"), lambda df, n: seen.extend(df.collect()))
    query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 0
    assert sorted((r.stream_id, r["index"], r.text_en, tuple(r.citations)) for r in seen) == sorted(x for i in range(10) for x in [(f"s{i}", 0, "One.", ("c",)), (f"s{i}", 1, "Two", ())])


def test_stream_answers_refuse_once(spark, tmp_path):
    schema = "stream_id string, seq int, chunk string, eos boolean, gated boolean, citations array<string>"
    first = [("gate", 0, "Anything. At", False, True, ["c"]), ("lead", 0, "NO_ANSWER_IN", False, False, ["c"]), ("late", 0, "Heat moves. (NO_ANSWER_IN_SOURCE). It is f", False, False, ["c", "d"])]
    second = [("gate", 1, " all.", True, True, ["c"]), ("lead", 1, "_SOURCE. Then more.", True, False, ["c"]), ("late", 1, "ast.", True, False, ["c", "d"])]
    got = run_stream(spark, tmp_path, [first, second], schema, streams.answers).orderBy("stream_id", "index").collect()
    assert [(r.stream_id, r["index"], r.refused, r.citations) for r in got] == [("gate", 0, True, []), ("late", 0, False, ["c", "d"]), ("late", 1, False, []), ("late", 2, False, []), ("lead", 0, True, [])]
    assert [r.text_en for r in got if r.stream_id == "late"][0::2] == ["Heat moves.", "It is fast."]


def test_generated_pieces_become_answers(spark, tmp_path):
    def speak(system, user):
        for w in user.split():
            if w == "bad":
                raise RuntimeError("lost")
            yield w + " "

    prompted = spark.createDataFrame([(1, "s", "Plants grow. They eat light."), (2, "s", "Some bad one.")], "request_id bigint, system_prompt string, user_prompt string")
    rows = sorted(map(tuple, providers.streamed(prompted, speak).collect()))
    assert rows[-1] == ("2", 1, "", True, "RuntimeError: lost") and [r[2] for r in rows if r[0] == "1"] == ["Plants ", "grow. ", "They ", "eat ", "light. ", ""]


def test_embedders(spark):
    providers._REGISTRY.pop(("embed", "tfidf"), None)
    with pytest.raises(RuntimeError):
        providers.choose_embedder()

    @providers.provider("embed", "tfidf")
    def letters():
        def run(texts, most):
            width = max(map(len, texts), default=1) or 1
            tokens, mask = np.zeros((len(texts), width, 3)), np.zeros((len(texts), width))
            for i, t in enumerate(texts):
                for j, c in enumerate(t[:most]):
                    tokens[i, j, ord(c) % 3] = 1
                    mask[i, j] = c != " "
            return tokens, mask
        return run

    with pytest.raises(ValueError):
        providers.choose_embedder("onnx")
    name, run = providers.choose_embedder()
    df = spark.createDataFrame([(1, "abc"), (2, None), (3, "   "), (4, "aaa")], "id int, text string")
    got = {r.id: r.embedding for r in providers.embedded(df, run, backend=name, batch=2).collect()}
    assert got[2] is None and got[3] == [0, 0, 0] and np.allclose(got[1], [3**-0.5] * 3) and sum(x * x for x in got[4]) == pytest.approx(1)
    near = search.dense_topk(providers.embedded(df, run, backend=name).where("embedding is not null").select(F.col("id").alias("vec_id"), "embedding"), providers.embedded(df.where("id = 4"), run, backend=name).select(F.col("id").alias("query_id"), "embedding"), k=1)
    assert [(r.query_id, r.vec_id) for r in near.collect()] == [(4, 4)]
    providers._REGISTRY.pop(("embed", "tfidf"))


def test_dense_search_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(0)
    m = np.round(rng.normal(size=(60, 4)), 1).astype(np.float32)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "vec_id int, embedding array<float>").repartition(3)
    q_ = v.where("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    s = np.round(m[::5].astype(float) @ m.T.astype(float), 6)
    want = sorted((5 * i, r + 1, int(j), float(s[i, j])) for i in range(12) for r, j in enumerate(sorted(range(60), key=lambda j: (-s[i, j], j))[:4]))
    for most, block in ((20_000, 1024), (3, 7)):
        monkeypatch.setattr(search, "BROADCAST_QUERIES", most)
        monkeypatch.setattr(search, "QUERY_BLOCK", block)
        monkeypatch.setattr(search, "VECTOR_BLOCK", block)
        assert sorted(map(tuple, search.dense_topk(v, q_).collect())) == want
    with pytest.raises(Exception, match="length"):
        search.dense_topk(v, spark.createDataFrame([(1, [1.0, 2.0])], "query_id int, embedding array<float>")).collect()
    assert search.dense_topk(v, q_.limit(0)).count() == 0


def test_stored_index(spark, tmp_path):
    texts = ["plants need light and water", "the moon turns round the earth", "water boils with heat", None, "light is fast"]
    c = spark.createDataFrame([(i, t, f"c{i}", "ch", None, None if i == 2 else i, None, "by", 0) for i, t in enumerate(texts)], "chunk_id bigint, text string, content_id string, chapter string, section string, page int, source string, license string, chunk_index int")
    path = str(tmp_path / "index")
    index.build(c, path, "mine", 0.1)
    r = spark.createDataFrame([(1, "light for plants"), (2, "zebra")], "request_id bigint, text string")
    opened = index.Index(spark, path)
    got = opened.passages(opened.search(r)).orderBy("rn").collect()
    assert [(x.request_id, x.chunk_id, x.source, x.page) for x in got] == [(1, 0, "mine", 0), (1, 4, "mine", 4)] and opened.min_score == 0.1
    want = search.sparse_topk(c, r).orderBy("rn").collect()
    assert [(x.chunk_id, x.score) for x in got] == [(x.chunk_id, x.score) for x in want]
    with pytest.raises(Exception, match="No chunks"):
        index.build(c.limit(0), path, "mine", None)
    assert index.Index(spark, path).search(r).count() == 2  # What failed left the old one.
    index.build(c.where("chunk_id < 2"), path, "mine", None)
    assert index.Index(spark, path).search(r).count() == 1 and os.listdir(tmp_path) == ["index"]
    shutil.rmtree(tmp_path / "index" / "vocabulary")
    with pytest.raises(FileNotFoundError, match="vocabulary"):
        index.Index(spark, path)


def test_waiting_for_a_model():
    asked = []
    assert providers.until_ready(lambda: (asked.append(1) or len(asked) > 2, "up"), 5, 0.01) == "up"
    with pytest.raises(TimeoutError, match="down"):
        providers.until_ready(lambda: (False, "down"), 0.02, 0.01)
