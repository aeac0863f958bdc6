import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from papyra.operators import chunking as ch

CFG = ch.ChunkConfig(200, 300, 50)


def node(start, level=1, label="x", parent=None):
    return {"level": level, "label": label, "char_start": start, "parent": parent}


def spans(text, contents=(), cfg=CFG):
    return list(ch.cut_document(text, list(contents), "T", cfg))


def test_config_is_checked():
    for bad in ((300, 200, 0), (200, 300, 200)):
        with pytest.raises(ValueError):
            ch.ChunkConfig(*bad)


def test_empty_and_blank():
    assert spans("") == [] and spans(" \n\x1c  ") == []


def test_one_short_segment_is_structural():
    assert spans("  short text \n") == [(2, 12, "T", "structural", 1)]


def test_deepest_then_latest_node_owns_a_start():
    text = "preamble " + "a" * 50
    got = ch.outline(text, [node(9, 1, "one"), node(9, 2, "two", 0), node(9, 2, "three", 0)])
    assert got == [(0, 9, -1, -1), (9, 59, 0, 2)]


def test_roots_do_not_merge_and_siblings_do():
    text = "a" * 40 + "b" * 40 + "c" * 40 + "d" * 40
    assert [x[:2] for x in spans(text, [node(k * 40) for k in range(4)])] == [(0, 40), (40, 80), (80, 120), (120, 160)]
    tree = [node(0, 1, "r"), *[node(1 + k * 39, 2, "s", 0) for k in range(4)]]
    assert (1, 160, "T › r › s", "structural", 4) in spans(text, tree)


def test_breadcrumbs_skip_empty_labels_and_bad_parents():
    assert ch.paths([node(0, label="A"), node(0, label=" ", parent=0), node(0, label="\x15 1", parent=1), node(0, label="B", parent=9)]) == [["A"], ["A"], ["A", "§ 1"], ["B"]]


def test_long_paragraph_is_cut_at_sentences_then_windows():
    text = " ".join("Sentence number %02d is here." % k for k in range(30))
    got = spans(text)
    assert all(k == "mid_paragraph" for *_, k, _ in got) and all(b - a <= 200 for a, b, *_ in got)
    flat = spans("x" * 1000)
    assert [x[:2] for x in flat] == [(p, min(p + 200, 1000)) for p in range(0, 1000, 150)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab. \n😀é"), max_size=900), st.lists(st.integers(0, 900), max_size=5))
def test_offsets_and_limits(text, starts):
    for a, b, _, _, _ in spans(text, [node(s, 1 + k % 3, parent=k - 1 if k % 3 else None) for k, s in enumerate(starts)]):
        assert 0 <= a < b <= len(text) and b - a <= 300 and text[a:b] == text[a:b].strip()


def test_table_form_has_exact_offsets(spark):
    rows = [(1, 1, "t", "Αβγ 😀 first.\n\n" + "x" * 4000 + "\nlast"), (2, 1, None, None), (3, 2, "u", "")]
    df = spark.createDataFrame(rows, "doc_id long, act_id long, title string, text string")
    chunks = ch.chunk_documents(df)
    assert ch.offset_violations(chunks, df).count() == 0
    assert {r.doc_id for r in chunks.collect()} == {1}


def test_outline_and_segments_stay_inside_a_row(spark, tmp_path):
    """No text is shuffled, and both forms of the segments agree, with nodes at one place, beyond the end and before the start."""
    from papyra.plans import corpus, registry

    rows = [(1, "a\n\nb"), (2, None), (3, ""), (4, "Αβγ 😀\nx\n")]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' as lang", "'web' as source").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.contents for r in corpus.contents(spark, str(tmp_path)).collect()}
    assert sorted(got) == [1, 3, 4]
    assert [(x.level, x.label, x.char_start, x.char_end, x.parent, x.pos) for x in got[4]] == [(1, "L0", 0, 0, None, 0), (2, "L1", 6, 6, 0, 1), (3, "L2", 8, 8, 1, 2)]
    for name in ("toc_segments", "chunk_documents_outline"):
        plan = registry.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
    cases = [("abcdef", [node(9), node(-3, 2), node(0, 1), node(3, 1), node(3, 3), node(3, 3)]), ("abc", None), (None, [node(0)]), ("abc", [node(None), node(2, None)])]
    frame = spark.createDataFrame([(k, t, c) for k, (t, c) in enumerate(cases)], "doc_id long, text string, contents array<struct<level:int,label:string,char_start:long,char_end:long,parent:int>>")
    want = [(0, 0, 3, 1), (0, 3, 6, 5), (1, 0, 3, -1), (3, 0, 2, 0), (3, 2, 3, 1)]
    assert sorted(map(tuple, ch.segments(frame).collect())) == want
