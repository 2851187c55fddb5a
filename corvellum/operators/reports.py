"""Reports as Markdown: (line_no, line) rows, made of tables that are small by nature.

Numbers are rounded half to even before they are printed, as metrics are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvellum.operators.metrics import ROUTES


def fixed(value: Column, digits: int) -> Column:
    return F.when(value.isNotNull(), F.format_string(f"%.{digits}f", F.bround(value.cast("double"), digits)))


def _lines(head: list[str], body: DataFrame) -> DataFrame:
    """Fixed lines before a body(place, line)."""
    top = body.sparkSession.createDataFrame(list(enumerate(head, 1 - len(head))), "line_no int, line string")
    numbered = body.select(F.row_number().over(Window.orderBy("place")).alias("line_no"), "line")  # of a report's lines
    return top.unionByName(numbered).withColumn("line_no", F.col("line_no") + len(head))


def row(*cells: str | Column) -> Column:
    parts: list[Column] = []
    for c in cells:
        parts += [F.lit(" | "), F.col(c).cast("string") if isinstance(c, str) else c]
    return F.concat(F.lit("| "), *parts[1:], F.lit(" |"))


def matrix(metrics: DataFrame) -> DataFrame:
    """Configurations(chunking, retrieval, recall_at_1, ..., mrr), the best recall at five first;
    all that equal the best are bold."""
    best = F.max("recall_at_5").over(Window.partitionBy())
    bold = (F.col("recall_at_5") == best) & (best > 0)
    label = F.when(bold, F.concat(F.lit("**"), "chunking", F.lit("**"))).otherwise(F.col("chunking"))
    cells = [fixed(F.col(c), 3) for c in ("recall_at_1", "recall_at_3", "recall_at_5", "recall_at_10", "mrr")]
    body = metrics.select(F.struct(-F.col("recall_at_5"), "chunking", "retrieval").alias("place"), row(label, "retrieval", *cells).alias("line"))
    return _lines(["| Chunking | Retrieval | recall@1 | recall@3 | recall@5 | recall@10 | MRR |", "|---|---|---|---|---|---|---|"], body)


def confusion(matrix: DataFrame) -> DataFrame:
    """A line a route of matrix(expected, predicted, n), hits bold, with the total."""
    at = F.array_position(F.array(*map(F.lit, ROUTES)), F.col("expected"))
    n = {p: F.sum(F.when(F.col("predicted") == p, F.col("n"))) for p in ROUTES}
    cells = [F.when((F.col("expected") == p) & (F.col(p) > 0), F.concat(F.lit("**"), F.col(p).cast("string"), F.lit("**"))).otherwise(F.col(p).cast("string")) for p in ROUTES]
    wide = matrix.groupBy("expected").agg(*[n[p].alias(p) for p in ROUTES], F.sum("n").alias("total"))
    body = wide.select(at.alias("place"), row("expected", *cells, "total").alias("line"))
    return _lines(["| expected \\ predicted | " + " | ".join(ROUTES) + " | total |", "|---" * (len(ROUTES) + 2) + "|"], body)


def per_route(scores: DataFrame) -> DataFrame:
    at = F.array_position(F.array(*map(F.lit, ROUTES)), F.col("route"))
    share = lambda c: F.coalesce(fixed(F.col(c), 3), F.lit("—"))
    body = scores.select(at.alias("place"), row("route", "support", "correct", share("recall"), share("precision")).alias("line"))
    return _lines(["| route | support | correct | recall | precision |", "|---|---|---|---|---|"], body)


def library_index(papers: DataFrame) -> DataFrame:
    """papers(paper_id, paper_title, year, max_page, n_chunks), a line each by title."""
    known = papers.withColumn("paper_title", F.coalesce("paper_title", F.lit("")))
    line = row(F.concat(F.lit("`"), "paper_id", F.lit("`")), F.coalesce(F.col("year").cast("string"), F.lit("—")), "max_page", "n_chunks", "paper_title")
    return known.select(F.struct(F.lower("paper_title"), "paper_id").alias("place"), line.alias("line")).orderBy("place").select("line")


def graph_report(accuracy: DataFrame, rewrites: DataFrame, within: DataFrame, verdicts: DataFrame, refusals: DataFrame) -> DataFrame:
    """How runs went, out of one-row tables of metrics and the shares of the verdicts."""
    percent = lambda c: F.concat(fixed(F.col(c) * 100, 1), F.lit("%"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))

    def lines(df: DataFrame, section: int, *made: Column) -> DataFrame:
        return df.select(F.posexplode(F.array(*made)).alias("pos", "line")).select(F.struct(F.lit(section).alias("a"), F.col("pos").alias("b")).alias("place"), "line")

    parts = [
        lines(accuracy, 0, F.lit("## Route accuracy (end to end)"), F.concat(F.lit("**"), percent("accuracy"), F.lit("** over "), text("n"), F.lit(" runs"))),
        lines(
            rewrites, 1, F.lit("## Rewrite loop"), F.concat(F.lit("- trigger rate: **"), percent("trigger_rate"), F.lit("** ("), text("n_fired"), F.lit("/"), text("n_answerable"), F.lit(" answerable questions)")),
            F.concat(F.lit("- recall@5 when it fired: "), text("recall_when_fired")), F.concat(F.lit("- recall@5 when it did not: "), text("recall_when_not_fired")), F.concat(F.lit("- delta: **"), text("recall_delta"), F.lit("**")),
        ),
        lines(
            within.where("n_fired > 0"), 2, F.lit("### Within-question, first pass vs final pass"), F.concat(F.lit("- improved "), text("improved"), F.lit(", unchanged "), text("unchanged"), F.lit(", worsened "), text("worsened"), F.lit(" (of "), text("n_fired"), F.lit(")")),
            F.concat(F.lit("- rescued from zero recall: "), text("rescued_from_zero")),
        ),
        lines(verdicts.limit(1), 3, F.lit("## Grounding verdicts"), F.lit("| verdict | n | share |"), F.lit("|---|---|---|")),
        verdicts.select(F.struct(F.lit(4).alias("a"), F.array_position(F.array(*map(F.lit, ("grounded", "partially_grounded", "ungrounded", "api_refused", "not_checked"))), F.col("verdict")).cast("int").alias("b")).alias("place"), row("verdict", "n", percent("share")).alias("line")),
        lines(
            refusals.where("n > 0"), 5, F.concat(F.lit("## Refusal correctness on the unanswerable set (n="), text("n"), F.lit(")")),
            row(F.lit("prefix"), F.concat(text("prefix_correct"), F.lit("/"), text("n")), percent("prefix_rate")), row(F.lit("grounding"), F.concat(text("grounding_correct"), F.lit("/"), text("n")), percent("grounding_rate")),
        ),
    ]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.select(F.row_number().over(Window.orderBy("place")).alias("line_no"), "line")


def route_report(accuracy: DataFrame, by_arm: DataFrame, matrix: DataFrame, scores: DataFrame) -> DataFrame:
    """Accuracy in all and by arm, the confusion matrix, the scores of every route."""
    percent = lambda c: F.concat(fixed(F.col(c) * 100, 1), F.lit("%"))
    place = lambda a, b: F.struct(F.lit(a).alias("a"), b.alias("b")).alias("place")
    head = accuracy.select(F.posexplode(F.array(F.lit("## Route accuracy"), F.concat(F.lit("**"), percent("accuracy"), F.lit("** over "), F.col("n").cast("string"), F.lit(" classifications")))).alias("pos", "line")).select(place(0, F.col("pos").cast("int")), "line")
    arms = by_arm.select(place(1, F.when(F.col("arm") == "with_paper", 0).otherwise(1).cast("int")), F.concat(F.lit("- `"), "arm", F.lit("`: "), percent("accuracy"), F.lit(" ("), F.col("n").cast("string"), F.lit(" questions)")).alias("line"))
    tables = [t.select(place(n, F.col("line_no").cast("int")), "line") for n, t in ((2, confusion(matrix)), (3, per_route(scores)))]
    whole = head.unionByName(arms).unionByName(tables[0]).unionByName(tables[1])
    return whole.select(F.row_number().over(Window.orderBy("place")).alias("line_no"), "line")
