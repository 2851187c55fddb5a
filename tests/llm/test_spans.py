import random

from corvellum.llm import spans

SCHEMA = "rec string, paper_id string, is_page boolean, text string, cls string, seed string"
random.seed(5)
LETTERS = "abcdefghij "


def noise(n):
    return "".join(random.choice(LETTERS) for _ in range(n))


SHARED = noise(160)


def _rows():
    full = f"{noise(300)}{SHARED}{noise(300)}"
    return [
        ("page:p:1", "p", True, full), ("page:q:1", "q", True, f"{noise(100)}{SHARED}"), ("page:p:2", "p", True, SHARED + noise(9)), ("cite:1", "r", False, SHARED), ("cite:2", "s", False, SHARED),
        ("page:q:2", "q", True, noise(200) + "#" + SHARED[:159]), ("page:t:1", "t", True, full), ("page:u:1", "u", None, SHARED), ("page:v:1", "v", True, None), (None, "w", True, SHARED), ("page:x:1", None, True, SHARED), ("page:y:1", "y", True, ""),
        ("page:p:1", "p", True, full),
    ]


ROWS = _rows()


def brute(records, least=160):
    return {tuple(sorted((a[0], b[0]))) for a in records for b in records if a[0] != b[0] and a[1] != b[1] and (a[2] or b[2]) and any(a[3][i : i + least] in b[3] for i in range(len(a[3]) - least + 1))}


def test_pairs_and_edges(spark):
    given = [(*r, "clash", "clash") for r in ROWS]
    known = [r for r in ROWS if r[0] and r[1] and r[3]]
    found = {tuple(r) for r in spans.SharedSpans(spark.createDataFrame(given, SCHEMA)).pairs().collect()}
    assert found == brute(known) and len(found) > 8


def test_hot_seeds_are_paired_by_passages(spark):
    """A shared gram that is shorter than a passage, in many records, links none of them."""
    gram = noise(120)
    given = [(f"page:p{i}:1", f"p{i}", True, noise(80) + gram + noise(80), "", "") for i in range(spans.HOT + 20)]
    long = gram + noise(60)
    given += [("page:a:1", "a", True, noise(50) + long, "", ""), ("page:b:1", "b", True, long + noise(70), "", "")]
    found = {tuple(r) for r in spans.SharedSpans(spark.createDataFrame(given, SCHEMA)).pairs().collect()}
    assert found == {("page:a:1", "page:b:1")}


def test_a_passage_in_very_many_records(spark):
    n = spans.HOT + 20
    given = [(f"page:p{i}:1", f"p{i}", True, noise(30) + SHARED + noise(40), "", "") for i in range(n)]
    given += [("cite:1", "p0", False, SHARED, "", ""), ("cite:2", "z", False, SHARED + "x", "", ""), ("cite:3", "z", False, SHARED[:-1], "", "")]
    found = {tuple(r) for r in spans.SharedSpans(spark.createDataFrame(given, SCHEMA)).pairs().collect()}
    assert found == brute([r[:4] for r in given]) and len(found) == n * (n - 1) // 2 + 2 * n - 1


def test_coverage(spark):
    out = {r.rec: r for r in spans.SharedSpans(spark.createDataFrame([(*r, "", "") for r in ROWS], SCHEMA)).coverage().collect()}
    assert out["cite:1"].shared_chars == 160 and out["cite:1"].shared_share == 1 and out["page:p:1"].shared_chars == out["page:p:1"].n_chars == 760
    assert out["page:q:2"].shared_chars == 0 and out["page:q:1"].shared_chars >= 160 and "page:y:1" not in out


def test_automaton_gives_maximal_spans():
    a = spans.SuffixAutomaton("xxabcdefyyghijkl")
    assert a.spans("abcdef--ghijk-abc", 4) == [(0, 6), (8, 13)]
    assert a.spans("", 4) == [] and spans.SuffixAutomaton("").spans("abc", 1) == []


def test_empty_table(spark):
    assert spans.SharedSpans(spark.createDataFrame([], SCHEMA)).pairs().count() == 0
    assert spans.SharedSpans(spark.createDataFrame([], SCHEMA)).coverage().count() == 0
