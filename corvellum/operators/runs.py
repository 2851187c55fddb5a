"""Rows of evaluation runs: labels by arm, passes, usage, verdicts, decoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvellum.functions import text as T

# The sentences by which a paper's and a library's answer is declined.
PAPER_REFUSAL, LIBRARY_REFUSAL = "That isn't covered in this paper.", "That isn't covered in my library."
ARMS = ("with_paper", "no_paper")


def labels_by_arm(labels: DataFrame, questions: DataFrame) -> DataFrame:
    """(id, arm, expected, question, category) of labels(id, with_paper, no_paper); labels
    without a question are left out."""
    long = labels.unpivot("id", list(ARMS), "arm", "expected")
    return long.join(questions.select("id", "question", "category"), "id")


def configurations(spark: SparkSession, strategies: Sequence[str] = ("fixed", "section", "section_context"), modes: Sequence[str] = ("dense", "bm25", "hybrid", "rerank")) -> DataFrame:
    """Every strategy under every mode: the axes of an evaluation."""
    return spark.createDataFrame([(s, m) for s in strategies for m in modes], "strategy string, mode string")


def without_errors(rows: DataFrame) -> DataFrame:
    """Rows without an error, or all rows if every one has an error."""
    fine = rows.agg(F.count_if(F.col("error").isNull())).scalar()
    return rows.where(F.col("error").isNull() | (fine == 0))


def first_and_last_pass(passes: DataFrame) -> DataFrame:
    """(thread_id, n_passes, first, last) of passes(thread_id, pass_no, recall)."""
    return passes.groupBy("thread_id").agg(F.count("*").alias("n_passes"), F.min_by("recall", "pass_no").alias("first"), F.max_by("recall", "pass_no").alias("last"))


def usage_rows(runs: DataFrame) -> DataFrame:
    """(thread_id, node, ...) of a map of nodes to usage, entries that are none left out."""
    return runs.select("thread_id", F.explode("usage").alias("node", "u")).where("u is not null").select("thread_id", "node", "u.*")


def usage_totals(usage: DataFrame, by: Sequence[str] = ("thread_id",)) -> DataFrame:
    """Sums of every numeric field; entries of repeated passes add up, none overwrites."""
    fields = [n for n, t in usage.dtypes if t in ("int", "bigint", "float", "double") and n not in by]
    return usage.groupBy(*by).agg(*[(F.bround(F.sum(f), 6) if dict(usage.dtypes)[f] in ("float", "double") else F.sum(f)).alias(f) for f in fields])


def opens_with(answer: Column, sentences: Sequence[str]) -> Column:
    """Whether an answer, trimmed, opens with one of the fixed sentences; NULL doesn't."""
    text = T.strip(F.coalesce(answer, F.lit("")))
    found = F.lit(False)
    for s in sentences:
        found = found | text.startswith(s)
    return found


def invents_nothing(verdict: Column, substantive: Column, n_unsupported: Column) -> Column:
    """An answer that claims nothing and has no unsupported claim; not one that the service
    refused.  What is not told counts as substantive."""
    return ~F.coalesce(verdict == "api_refused", F.lit(False)) & ~F.coalesce(substantive, F.lit(True)) & (F.coalesce(n_unsupported, F.lit(0)) == 0)


def refusal(route: Column) -> Column:
    return F.when(route == "single_paper", PAPER_REFUSAL).otherwise(LIBRARY_REFUSAL)


def support(substantive: Column, n_unsupported: Column, n_verified: Column, n_unverified: Column) -> Column:
    """How far an answer is supported by its quotes."""
    return F.when((n_unsupported == 0) & (n_unverified == 0), "grounded").when(substantive & (n_verified == 0), "ungrounded").otherwise("partially_grounded")


def of_open_paper(citations: DataFrame, title: str | Column) -> DataFrame:
    """Citations of the paper that is open; those without a title are of it."""
    return citations.where(F.col("paper_title").isNull() | (F.col("paper_title") == title))


def decoded(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """A JSON column as a struct of the declared fields; others are passed over."""
    return rows.withColumn(column, F.from_json(column, schema))


def split_by_grade(graded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kept and rejected rows of metrics.kept_after_grading; together they are all rows."""
    return graded.where("kept"), graded.where("not kept")


def unknown_ids(wanted: DataFrame, known: DataFrame, key: str = "paper_id") -> DataFrame:
    """How many of the wanted ids are unknown, and the first five of them."""
    rows = wanted.select(key).distinct().join(known.select(key), key, "left_anti")
    first = rows.orderBy(key).limit(5).agg(F.array_sort(F.collect_list(key)).alias("first"))
    return first.crossJoin(rows.agg(F.count("*").alias("n_unknown"))).select("n_unknown", "first")  # a row each


def cost(model: Column, tokens: Sequence[Column], prices: dict[str, Sequence[float]], default: str) -> Column:
    """What a call costs: counts of tokens times the prices a million of a model, a parameter;
    an unknown model costs what `default` does, counts that aren't told are 0."""
    total = F.lit(0.0)
    for k, count in enumerate(tokens):
        table = F.create_map(*[F.lit(x) for name, row in prices.items() for x in (name, float(row[k]))])
        total = total + F.coalesce(count, F.lit(0)) * F.coalesce(F.try_element_at(table, model), F.lit(float(prices[default][k])))
    return F.bround(total / 1e6, 6)


def node_usage(usage: DataFrame, nodes: Sequence[str]) -> DataFrame:
    """The last entry of each node in usage(thread_id, node, seq, ...); entries of repeated
    passes bear the node's name and a number behind it."""
    name = F.lit(None).cast("string")
    for n in nodes:
        name = F.when((F.col("node") == n) | F.col("node").startswith(f"{n}_"), n).otherwise(name)
    rest = [c for c in usage.columns if c not in ("thread_id", "node", "seq")]
    rows = usage.withColumn("node", name).where("node is not null").groupBy("thread_id", "node").agg(F.max_by(F.struct(*rest), "seq").alias("x"))
    return rows.select("thread_id", "node", "x.*")


def traced(state: DataFrame, copied: Sequence[str], counted: Sequence[str]) -> DataFrame:
    """What of a state may leave the process: some fields as they are, of lists the size."""
    return state.select("thread_id", *copied, *[F.size(c).alias(f"n_{c}") for c in counted], F.col("grounding.verdict").alias("grounding_verdict"))


def summaries(state: DataFrame) -> DataFrame:
    """A state as a client sees it, with defaults for what isn't set."""
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return state.select("thread_id", text("question"), "route", text("answer"), F.col("grounding.verdict").alias("verdict"), F.coalesce("rewrite_count", F.lit(0)).alias("rewrite_count"), F.coalesce("citations", F.array().cast(dict(state.dtypes)["citations"])).alias("citations"))


def spans(usage: DataFrame, questions: DataFrame) -> DataFrame:
    """usage(thread_id, node, ...) as spans of a trace; a trace's id comes from its thread and
    question, so that a retried run continues its trace."""
    seed = F.concat_ws(":", "thread_id", F.coalesce("question", F.lit("")))
    return usage.join(questions.select("thread_id", F.left(F.sha2(seed, 256), F.lit(32)).alias("trace_id")), "thread_id").drop("thread_id")
