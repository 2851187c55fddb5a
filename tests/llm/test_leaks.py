import re

from corvellum.llm import leaks

DOCS = "doc_id bigint, text string, item_id string, field string"
ITEMS = "item_id string, field string, text string, doc_id string"
PASSAGE = "Why do the authors of Larvimdel argue that the straße index delays each parser"
WORDS = PASSAGE.split()


def run(spark, docs, items):
    made = leaks.leaks(spark.createDataFrame([(*d, "x", "y") for d in docs], DOCS), spark.createDataFrame([(*i, "x") for i in items], ITEMS))
    return {(r.doc_id, r.item_id, r.field): (r.n_windows, r.item_windows) for r in made.collect()}


def given():
    docs = [
        (1, f"Before. {PASSAGE}? After."), (2, " ... ".join(WORDS[:12]).upper()), (3, " ".join(WORDS[:11])), (4, " ".join(WORDS[1:13]) + "!"), (5, None), (6, ""), (7, " ".join([*WORDS[:6], "x", *WORDS[6:]])), (8, "word " * 50000 + PASSAGE), (1, f"Before. {PASSAGE}? After."),
    ]
    items = [("a", "question", PASSAGE), ("a", "ground_truth", None), ("b", "question", PASSAGE), ("c", "question", "too short"), ("d", "question", ""), ("a", "question", PASSAGE), (None, "question", "nothing of this stands in any of the texts that are given here at all")]
    return docs, items


def test_passages_and_edges(spark):
    found = run(spark, *given())
    n = len(re.findall(r"\w+", PASSAGE)) - 11
    assert set(found) == {(d, i, "question") for d in (1, 2, 4, 8) for i in "ab"}
    assert found[1, "a", "question"] == (n, n) == found[8, "b", "question"] and found[2, "a", "question"] == (1, n)


def test_blocks_give_the_same(spark, monkeypatch):
    whole = run(spark, *given())
    monkeypatch.setattr(leaks, "BLOCK_CHARS", 100)
    assert run(spark, *given()) == whole


def test_empty_tables(spark):
    docs, items = given()
    assert run(spark, [], items) == {} and run(spark, docs, []) == {}


def test_every_window_has_the_least_of_its_shingles():
    w = leaks.Words([PASSAGE, "a b", " ".join(map(str, range(40)))])
    first, low = leaks.window_minima(w)
    grams, at = w.grams(leaks.SHINGLE)
    by = dict(zip(at.tolist(), grams.tolist()))
    owner = w.text_of()
    assert first.tolist() == [i for i in range(len(owner) - 11) if owner[i] == owner[i + 11]]
    assert low.tolist() == [min(by[i + k] for k in range(8)) for i in first.tolist()]
