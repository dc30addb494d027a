from hypothesis import given, settings
from hypothesis import strategies as st

from granthika.llm import splitting as S


def overlaps(pieces, overlap, limit):
    for (s0, a0, e0), (s1, a1, e1) in zip(pieces, pieces[1:]):
        assert s1 == e0 and a1 == max(0, s1 - min(overlap, limit - 1)) and a1 >= a0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["word", "end.", "a,", "q?\n", "para.\n\n", "line\n", "x"]), max_size=120), st.integers(1, 30), st.integers(0, 35))
def test_limits_overlap_and_round_trip(words, limit, overlap):
    text = " ".join(words)
    n = len(text.split())
    got = S.cut(text, limit, overlap)
    assert got[0][0] == 0 and got[-1][2] == n
    assert all(e - a <= limit for _, a, e in got)
    overlaps(got, overlap, limit)
    own = [w for s, _, e in got for w in text.split()[s:e]]
    assert own == text.split()
    assert all(s - a == min(overlap, limit - 1) for s, a, _ in got[1:])


def test_cuts_at_sentences():
    text = "One two three four. Five six seven eight. Nine ten eleven twelve."
    assert S.cut(text, 5, 0) == [(0, 0, 4), (4, 4, 8), (8, 8, 12)]


def test_pieces(spark):
    chunks = spark.createDataFrame(
        [(1, "c", "a b c d e f", 9, "kept"), (2, "c", "a b", 9, "kept"), (3, None, "a b c d e f", 9, None), (4, "c", None, 1, None), (5, "c", "", 1, None), (1, "c", "a b c d e f", 9, "again")],
        "chunk_id bigint, corpus string, text string, chunk_max_words int, note string",
    )
    manifest = spark.createDataFrame([("c", 3, 1), ("c", 3, 1)], "corpus string, chunk_max_words int, chunk_overlap int")
    got = sorted((r.chunk_id, r.note or "", r.chunk_index, r.text) for r in S.pieces(chunks, manifest).collect())
    for note in ("kept", "again"):
        parts = [x[3].split() for x in got if x[0] == 1 and x[1] == note]
        assert len(parts) == 3 and all(len(p) <= 3 for p in parts) and all(p[-1] == n[0] for p, n in zip(parts, parts[1:]))
        assert parts[0] + [w for p in parts[1:] for w in p[1:]] == list("abcdef")
    assert (2, "kept", 0, "a b") in got and (3, "", 0, "a b c d e f") in got and (5, "", 0, "") in got
    assert not [x for x in got if x[0] == 4]
    assert S.found(chunks.limit(0), manifest).count() == 0
