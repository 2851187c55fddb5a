from pyspark.sql import functions as F

from corvellum.operators import quotes, runs


def test_labels_by_arm(spark):
    labels = spark.createDataFrame([("a", "single_paper", "library"), ("z", "web", "web")], "id string, with_paper string, no_paper string")
    questions = spark.createDataFrame([("a", "q", "factual")], "id string, question string, category string")
    assert {(r.arm, r.expected) for r in runs.labels_by_arm(labels, questions).collect()} == {("with_paper", "single_paper"), ("no_paper", "library")}
    assert runs.configurations(spark).count() == 12


def test_errors_fall_back(spark):
    some = spark.createDataFrame([("a", None), ("b", "boom")], "id string, error string")
    assert [r.id for r in runs.without_errors(some).collect()] == ["a"] and runs.without_errors(some.where("error is not null")).count() == 1


def test_passes_and_usage(spark):
    passes = spark.createDataFrame([("t", 2, 1.0), ("t", 1, 0.5), ("u", 1, None)], "thread_id string, pass_no int, recall double")
    assert {(r.thread_id, r.n_passes, r.first, r.last) for r in runs.first_and_last_pass(passes).collect()} == {("t", 2, 0.5, 1.0), ("u", 1, None, None)}
    rows = spark.sql("select 't' as thread_id, map('a', named_struct('tokens', 3, 'cost_usd', 0.001D), 'b', named_struct('tokens', 4, 'cost_usd', 0.002D), 'c', null) as usage")
    total = runs.usage_totals(runs.usage_rows(rows)).first()
    assert total.tokens == 7 and total.cost_usd == 0.003


def test_answers(spark):
    df = spark.createDataFrame([("  I can't tell. More.",), ("Sure. I can't tell.",), (None,)], "answer string")
    assert [r.y for r in df.select(runs.opens_with(F.col("answer"), ["I can't tell."]).alias("y")).collect()] == [True, False, False]
    rows = spark.createDataFrame([("api_refused", False, 0, 0, 0), ("x", False, 0, 1, 0), ("x", True, 1, 0, 0), ("x", None, 0, 0, 1), ("x", False, 2, 3, 0)], "verdict string, substantive boolean, n_unsupported int, n_verified int, n_unverified int")
    got = rows.select(runs.invents_nothing(F.col("verdict"), F.col("substantive"), F.col("n_unsupported")).alias("a"), runs.support(F.col("substantive"), F.col("n_unsupported"), F.col("n_verified"), F.col("n_unverified")).alias("b")).collect()
    assert [r.a for r in got] == [False, True, False, False, False] and [r.b for r in got] == ["grounded", "grounded", "ungrounded", "partially_grounded", "partially_grounded"]


def test_decoding_and_guards(spark):
    rows = spark.createDataFrame([('{"a": 1, "b": "x", "c": 2}',), ("broken",)], "state string")
    assert [r.state.a for r in runs.decoded(rows, "state", "a int, b string").collect()] == [1, None]
    cites = spark.createDataFrame([("T",), (None,), ("U",)], "paper_title string")
    assert runs.of_open_paper(cites, "T").count() == 2
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "paper_id string")
    one = runs.unknown_ids(ids(*"hgfedcba"), ids("a")).first()
    assert one.n_unknown == 7 and one["first"] == list("bcdef")
    graded = spark.createDataFrame([("a", True), ("b", False)], "id string, kept boolean")
    assert [d.count() for d in runs.split_by_grade(graded)] == [1, 1]


def test_verified_answers(spark):
    pages = spark.createDataFrame([("p", 1, "The gap closes when the budget is large enough for all of them.")], "paper_id string, page int, text string")
    papers = spark.createDataFrame([(t, 1, "p") for t in "tuv"], "thread_id string, rank int, paper_id string")
    answers = spark.createDataFrame([("t", "So <quote>the gap closes when the budget is large</quote> and <quote>nothing of this stands there at all</quote>."), ("u", "No quotes."), ("v", None)], "thread_id string, answer string")
    got = {r.thread_id: r for r in quotes.verified_answers(answers, papers, pages).collect()}
    assert got["t"].answer == 'So "the gap closes when the budget is large" [p. 1] and [unverified].' and (got["t"].n_verified, got["t"].n_unverified) == (1, 1)
    assert got["u"].answer == "No quotes." and got["v"].answer == ""
