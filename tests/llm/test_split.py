import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvellum.llm import split

SCHEMA = "item_kind string, item_id string, text string, item_limit int, version int, piece_no string, n_pieces string"


def greedy(text, limit, overlap):
    """The same cuts, one after the other."""
    words, ends, lines = ([x for x in at if x > overlap] for at in split.boundaries(split.code_points(text)))
    cuts, at = [], None
    while True:
        base, room = (0, limit) if at is None else (at, limit - overlap)
        if base + room >= len(text):
            return [*cuts, len(text)]
        for level, least in ((lines, base + room // 2), (ends, base + room // 2), (words, base)):
            if fits := [x for x in level if least < x <= base + room]:
                at = fits[-1]
                break
        else:
            at = base + room
        cuts.append(at)


def joined(text, ends, overlap):
    begins = [0, *(e - overlap for e in ends[:-1])]
    pieces = [text[a:b] for a, b in zip(begins, ends)]
    return pieces, pieces[0] + "".join(p[overlap:] for p in pieces[1:])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab .!?\nA(é", min_size=1, max_size=300), min_size=1, max_size=6), st.integers(12, 60), st.integers(0, 11))
def test_doubling_equals_the_greedy_walk(texts, limit, overlap):
    for text, ends in zip(texts, split.cut(texts, np.full(len(texts), limit), overlap)):
        pieces, whole = joined(text, list(map(int, ends)), overlap)
        assert whole == text and max(map(len, pieces)) <= limit
        if len(texts) == 1:
            assert list(ends) == greedy(text, limit, overlap)


def test_natural_places_win():
    text = "One two three. Four five six. " * 20
    (ends,) = split.cut([text], np.array([100]), 20)
    assert all(text[e - 2] == "." for e in ends[:-1])


def test_defined_results(spark):
    long = "word " * 30
    rows = [
        ("k", "a", long, 50, 1, "x", "y"), ("k", "a", long, 50, 2, "x", "y"), ("k", "b", None, 50, 1, None, None), ("k", "c", "", 50, 1, None, None),
        ("k", "d", "short", 50, None, None, None), (None, None, long, 50, 1, None, None), ("k", "e", "x" * 500, 50, 1, None, None), ("k", "f", "no limit", None, 1, None, None),
    ]
    out = split.split_oversized(spark.createDataFrame(rows, SCHEMA), 10).collect()
    by = {}
    for r in sorted(out, key=lambda r: (str(r.item_id), r.piece_no)):
        by.setdefault(r.item_id, []).append(r.piece_text)
    assert set(by) == {"a", "c", "d", "e", None} and by["c"] == [""] and by["d"] == ["short"]
    assert by["a"][0] + "".join(p[10:] for p in by["a"][1:]) == long == by[None][0] + "".join(p[10:] for p in by[None][1:])
    assert all(len(p) <= 50 for ps in by.values() for p in ps)


def test_empty_table_and_bad_limit(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert split.split_oversized(empty, 10).count() == 0
    with pytest.raises(Exception, match="overlap"):
        split.split_oversized(spark.createDataFrame([("k", "a", "x" * 20, 5, 1, "", "")], SCHEMA), 10).collect()


def test_found_is_what_is_over_the_limit(spark, tables):
    found = {tuple(r) for r in split.p1_found(spark, tables).collect()}
    rows = split.library_items(spark, tables).where("length(text) > item_limit").select("item_kind", "item_id").distinct()
    assert found == {tuple(r) for r in rows.collect()} and found
