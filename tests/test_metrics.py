import pytest
from pyspark.sql import functions as F

from corvellum.operators import corpus, metrics
from corvellum.sources import tables as sources


def test_recall_and_rank(spark):
    df = spark.createDataFrame([(["C", "A", "D", "B", "E"], ["A", "B", "A"]), ([], ["A"]), (["A"], [])], "got array<string>, want array<string>")
    row = df.select(*[metrics.recall_at(F.col("got"), F.col("want"), k).alias(f"r{k}") for k in (1, 2, 3, 4, 5)], metrics.reciprocal_rank(F.col("got"), F.col("want")).alias("rr")).collect()
    assert list(row[0]) == [0, 0.5, 0.5, 1, 1, 0.5] and list(row[1]) == [0] * 6 == list(row[2])


PAIRS = [("single_paper", "single_paper")] * 3 + [("single_paper", "library")] + [("library", "library")] * 3 + [("library", "web")] * 2 + [("web", "web")]


def test_routes(spark):
    rows = spark.createDataFrame([*PAIRS, ("other", "library")], "expected string, predicted string")
    matrix = metrics.confusion(rows)
    got = {(r.expected, r.predicted): r.n for r in matrix.collect()}
    assert len(got) == 16 and got["library", "web"] == 2 and got["direct", "direct"] == 0 and sum(got.values()) == 10
    scores = {r.route: r for r in metrics.route_scores(matrix).collect()}
    assert scores["library"].recall == 0.6 and scores["web"].precision == pytest.approx(0.3333) and scores["direct"].recall is None and scores["direct"].precision is None
    assert metrics.route_accuracy(rows.limit(10)).first().accuracy == 0.7
    assert metrics.misroutes(rows).count() == 4


RUNS = "thread_id string, id string, route string, is_unanswerable boolean, rewrite_count int, recall_at_5 double, latency_ms double, cost_usd double, recall_at_5_first_pass double, recall_at_5_final_pass double, verdict string, refused_by_prefix boolean, refused_by_grounding boolean, answer string"


def runs(spark):
    rows = [
        ("1", "a", "library", False, 1, 0.5, 1000.0, 0.001, 0.0, 0.5, "grounded", False, False, "x"), ("2", "b", "library", False, 2, 0.5, 1400.0, 0.002, 1.0, 0.5, "grounded", False, False, "x"), ("3", "c", "web", False, 0, 0.8, 100.0, None, None, None, "ungrounded", False, False, "x"), ("4", "d", "library", None, 0, 1.0, 200.0, 0.0015, None, None, "strange", None, None, None),
        ("5", "e", "library", True, 3, None, 0.0, None, 1.0, 1.0, None, True, True, "no"), ("6", "f", "library", True, 0, None, None, None, None, None, "api_refused", None, True, "y" * 200), ("7", "g", "library", True, None, None, None, None, None, None, None, False, False, "z"),
    ]
    return spark.createDataFrame(rows, RUNS)


def test_rewrites(spark):
    r = metrics.rewrite_metrics(runs(spark)).first()
    assert (r.n_answerable, r.n_fired, r.trigger_rate, r.recall_when_fired, r.recall_when_not_fired, r.recall_delta, r.latency_when_fired, r.latency_when_not_fired) == (4, 2, 0.5, 0.5, 0.9, -0.4, 1200.0, 150.0)
    w = metrics.within_question(runs(spark)).first()
    assert (w.n_fired, w.mean_first_pass, w.mean_final_pass, w.improved, w.unchanged, w.worsened, w.rescued_from_zero) == (2, 0.5, 0.5, 1, 0, 1, 1)
    assert [x.thread_id for x in metrics.fired_despite_good(runs(spark)).collect()] == ["2"]
    empty = metrics.rewrite_metrics(runs(spark).limit(0)).first()
    assert empty.n_answerable == 0 and empty.trigger_rate is None and metrics.within_question(runs(spark).limit(0)).first().n_fired == 0


def test_verdicts_and_refusals(spark):
    got = {r.verdict: (r.n, r.share) for r in metrics.verdict_shares(runs(spark)).collect()}
    assert got == {"grounded": (2, 0.5), "partially_grounded": (0, 0.0), "ungrounded": (1, 0.25), "api_refused": (1, 0.25), "not_checked": (0, 0.0)}
    r = metrics.refusal_rates(runs(spark)).first()
    assert (r.n, r.prefix_correct, r.prefix_rate, r.grounding_correct, r.grounding_rate) == (3, 1, 0.3333, 2, 0.6667)
    (d,) = metrics.refusal_disagreements(runs(spark)).collect()
    assert d.thread_id == "6" and d.answer == "y" * 160


def test_latency_and_cost(spark):
    got = {r.route: r for r in metrics.latency_and_cost(runs(spark)).collect()}
    assert set(got) == {"library", "web", "all"} and got["library"].n == 6 and got["library"].p50_ms == 1000 and got["library"].p95_ms == 1400
    assert got["library"].median_cost_usd == 0.0015 and got["library"].total_cost_usd == 0.0045 and got["web"].total_cost_usd is None


@pytest.mark.parametrize("n", [1, 2, 11, 21, 31, 100, 399])
def test_nearest_rank(spark, n):
    df = spark.createDataFrame([([float(i) for i in range(n)],)], "x array<double>")
    assert df.select(metrics.nearest_rank(F.col("x"), 0.95).alias("y")).first().y == min(n - 1, round(0.95 * (n - 1)))
    rows = spark.createDataFrame([("web", float(i + 1), 0.0) for i in range(n)], "route string, latency_ms double, cost_usd double")
    assert {r.p95_ms for r in metrics.latency_and_cost(rows).collect()} == {min(n - 1, round(0.95 * (n - 1))) + 1.0}


def test_grades_and_costs(spark):
    df = spark.createDataFrame([("a", True, None), ("b", False, True), ("c", False, False), ("d", None, None)], "id string, relevant boolean, on_topic boolean")
    assert {r.id: (r.kept, r.partial) for r in metrics.kept_after_grading(df).collect()} == {"a": (True, False), "b": (True, True), "c": (False, False), "d": (False, False)}
    cost = spark.sql("select map('route', named_struct('cost_usd', 0.0014D), 'grade', named_struct('cost_usd', 0.003D), 'x', null) as u")
    assert cost.select(metrics.total_cost(F.col("u")).alias("y")).first().y == 0.0044


def test_sample(spark, tables):
    golden = spark.read.parquet(f"{tables}/golden.parquet")
    one, two = ({r.id for r in metrics.stratified_sample(golden, 100).collect()} for _ in range(2))
    assert one == two and {r.id for r in golden.where("category = 'unanswerable'").collect()} <= one and len(one) <= 100


def test_golden_rules(spark):
    rows = [("a", ["p"], "factual"), ("a", ["p"], "factual"), ("b", [], "factual"), ("c", ["p"], "unanswerable"), ("d", None, "unanswerable"), ("e", ["p"], "odd"), ("f", ["p"], None)]
    got = {(r.id, r.violation) for r in tables_violations(spark, rows)}
    assert got == {("a", "repeated id"), ("b", "answerable but expects none"), ("c", "unanswerable but expects papers"), ("e", "unknown category"), ("f", "unknown category")}


def tables_violations(spark, rows):
    return sources.golden_violations(spark.createDataFrame(rows, "id string, expected_paper_ids array<string>, category string"), ["factual", "unanswerable"]).collect()


def test_contexts_and_history(spark):
    hits = spark.createDataFrame([("q", 1, "B", 2, "x"), ("q", 2, "A", 1, "y"), ("q", 3, "B", 5, "z")], "query_id string, rank int, paper_title string, page int, text string")
    assert corpus.contexts(hits).first().context == '<paper title="B">\n[page 2] x\n\n[page 5] z\n</paper>\n\n<paper title="A">\n[page 1] y\n</paper>'
    turns = spark.createDataFrame([("c", i, "user", f"t{i}") for i in range(9)], "conv_id string, turn int, role string, text string")
    assert corpus.last_turns(turns).first().history == "\n".join(f"user: t{i}" for i in range(3, 9))
