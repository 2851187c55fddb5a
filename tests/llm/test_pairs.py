from corvellum.llm import pairs

SCHEMA = "pair_kind string, pair_id string, question string, answer string, declining_is_right boolean, stock string, opening string"
EN = ["How does Larvimdel change the parser compared with Nostrafil, and which measure supports that?", "Why do the authors of Melgonvar argue that the index is large, and what evidence do they give?", "What happens to Kelbrosan when the retriever is frozen and the budget is small?"]
GOOD = ["The parser of {} is faster by 12.5% and this was measured on the larger split.", "Removing the index of {} costs 4.1% and the gap is not closed by the prior.", "The results of {} show that the filter is not needed when the budget is small."]
CASES = [
    ("good", "The index of Larvimdel is smaller and the authors show that it does not hurt.", None), ("short", "42.1%", None), ("yes", "Yes.", None), ("name", "Larvimdel", None), ("list", "It has these parts:\n- the parser\n- the index", None), ("source", "The parser of Larvimdel is faster on the larger split. [p. 4]", None),
    ("null", None, "empty"), ("blank", " ​\n", "empty"), ("filler", "N/A", "empty"), ("bracket", "<answer>", "empty"), ("dots", "...", "empty"),
    ("copy", EN[0].lower(), "copy"), ("copyq", f"Q: {EN[0]}", "copy"), ("restated", EN[0] + " The parser of Nostrafil is slower by 3.4% when it was trained on the same data, and the index was left out.", None),
    ("refusal", "I'm sorry, but I can't help with that. Please try another question.", "refusal"), ("decoy", "I could not find an exact figure for Larvimdel, but the paper still helps. The gap is 4.5% on the larger split.", None),
    ("other", "Die Ergebnisse von Larvimdel zeigen, dass der Index nicht von dem Verfahren abhängt und die Fehlerrate sinkt.", "language"), ("cut", "The parser of Larvimdel is faster by 12.5% and this was measured on the", "truncated"), ("comma", "The parser of Larvimdel is faster, and the index is smaller,", "truncated"),
]


def given(spark):
    rows = [("answer", f"fill{i}", EN[i % 3], GOOD[i % 3].format(f"Larvim{i}"), False) for i in range(90)]
    rows += [("answer", f"de{i}", "Warum ist das Verfahren von Larvimdel nach Ansicht der Autoren entscheidend?", f"Wir zeigen, dass das Verfahren von Larvim{i} nicht von dem Index abhängt und die Fehlerrate sinkt.", False) for i in range(30)]
    rows += [("answer", k, EN[0], a, False) for k, a, _ in CASES]
    rows += [("answer", "right", EN[1], "I do not know.", True), ("answer", "noq", None, "N/A", False), ("answer", None, EN[0], "N/A", False), ("answer", "null", EN[0], None, None), ("answer", "long", EN[0], "The index is large. " * 20000, False)]
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def test_every_defect_and_decoy(spark):
    out = {r.pair_id: r.defect for r in pairs.DefectivePairs(given(spark)).main_defect().collect()}
    assert {k: out.get(k) for k, _, _ in CASES} == {k: d for k, _, d in CASES}
    assert {k: d for k, d in out.items() if k not in {c[0] for c in CASES}} == {}


def test_empty_table(spark):
    assert pairs.DefectivePairs(spark.createDataFrame([], SCHEMA)).main_defect().count() == 0


def test_label_model_learns_which_function_errs():
    """The third function votes at random; the model must follow the other two."""
    counts = {"++0": 40, "+++": 20, "--0": 800, "--+": 130, "00+": 10, "000": 300, "+00": 6, "0+0": 4}
    post = pairs.label_model(counts)
    assert post["++0"] > 0.9 and post["+++"] > 0.9 and post["--+"] < 0.1 and post["--0"] < 0.01 and post["000"] < 0.5
    assert pairs.label_model({}) == {}


def test_right_refusal_keeps_other_defects(spark):
    """Where declining is right, only the refusal is none; what else is wrong remains."""
    rows = [("a", True, "refusal"), ("a", True, "truncated"), ("b", True, "refusal"), ("c", False, "refusal"), ("c", False, "truncated"), ("d", True, "truncated"), ("d", True, "language"), ("d", True, "refusal")]
    made = object.__new__(pairs.DefectivePairs)
    made.labels = lambda: spark.createDataFrame([("answer", *r, 0.9) for r in rows], "pair_kind string, pair_id string, declining_is_right boolean, defect string, posterior double")
    assert {r.pair_id: r.defect for r in made.main_defect().collect()} == {"a": "truncated", "c": "refusal", "d": "language"}
