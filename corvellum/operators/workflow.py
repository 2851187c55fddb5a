"""The steps of a question's way through routing, retrieval and checking, as tables.

What models and people decide comes in as tables: routes, facets, rewrites, grades, claims,
decisions.  Loops are bounded, so they are unrolled: every pass handles the rows that are
still active, and passes are joined by key, never by position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvellum.functions import text as T
from corvellum.session import checkpointed

# What an approval may say, and the keys under which it may stand.
YES = ("approve", "approved", "yes", "y", "true", "ok")
DECISION_KEYS = ("approved", "approve", "decision")
#: Objects within objects that a decision is looked for in; deeper ones count as unclear.
DECISION_DEPTH = 6


def route(forced: Column, classified: Column, paper_open: Column) -> Column:
    """A given route wins, then the classifier's; without either the open paper decides."""
    return F.coalesce(forced, classified, F.when(F.coalesce(paper_open, F.lit(False)), "single_paper").otherwise("library"))


def _opened(said: Column) -> Column:
    """What an object holds under the first of DECISION_KEYS; any other text as it is."""
    keys = F.json_object_keys(said)
    inner = F.lit(None).cast("string")
    for k in reversed(DECISION_KEYS):
        inner = F.when(F.array_contains(keys, k), F.get_json_object(said, f"$.{k}")).otherwise(inner)
    return F.when(said.startswith("{"), T.strip(inner)).otherwise(said)


def is_approved(decision: Column) -> Column:
    """Whether a decision, plain text or JSON, approves; whatever is unclear denies.

    Of an object the first of DECISION_KEYS that it has counts, whatever it holds.
    """
    # Levels are folds over one expression: unrolled, each would copy the one before eight times.
    said = F.aggregate(F.sequence(F.lit(1), F.lit(DECISION_DEPTH)), F.trim(decision), lambda said, _: _opened(said))
    bare = F.lower(T.strip(F.regexp_replace(said, '^"(.*)"$', "$1")))
    return F.coalesce(bare.isin(*YES), F.lit(False))


def approvals(asked: DataFrame, decisions: DataFrame) -> DataFrame:
    """asked(thread_id, ...) with status and effective_route, given decisions(thread_id, seq,
    decision): without one a thread awaits it, else the last one opens the web or leaves the
    question to the library."""
    last = decisions.groupBy("thread_id").agg(F.max_by("decision", "seq").alias("decision"), F.lit(True).alias("decided"))
    rows = asked.join(last, "thread_id", "left")
    status = F.when(F.col("decided").isNull(), "awaiting").when(is_approved(F.col("decision")), "approved").otherwise("denied")
    rows = rows.withColumn("status", status)
    return rows.withColumn("effective_route", F.when(F.col("status") == "approved", "web").when(F.col("status") == "denied", "library")).drop("decision", "decided")


def rewriting(threads: DataFrame, passes: DataFrame, rewrites: DataFrame, least: int = 2, most: int = 2) -> DataFrame:
    """(thread_id, query, rewrite_count, n_kept, is_thin) of threads(thread_id, question).

    passes(thread_id, pass_no, n_kept): what grading leaves in a pass; rewrites(thread_id,
    pass_no, query): what a query is rewritten to before it.  While fewer than `least` remain a
    query is rewritten, `most` times at most; a blank rewrite leaves it as it is.
    """
    kept = lambda n: passes.where(F.col("pass_no") == n).select("thread_id", F.col("n_kept").alias("now"))
    rows = threads.select("thread_id", F.col("question").alias("query"), F.lit(0).alias("rewrite_count")).join(kept(0), "thread_id", "left").withColumn("now", F.coalesce("now", F.lit(0)))
    done = None
    for n in range(1, most + 1):
        rows = checkpointed(rows)
        over = rows.where(F.col("now") >= least)
        done = over if done is None else done.unionByName(over)
        new = rewrites.where(F.col("pass_no") == n).select("thread_id", F.col("query").alias("new"))
        rows = rows.where(F.col("now") < least).drop("now").join(new, "thread_id", "left").join(kept(n), "thread_id", "left")
        query = F.when(F.coalesce(T.strip(F.col("new")) != "", F.lit(False)), F.col("new")).otherwise(F.col("query"))
        rows = rows.select("thread_id", query.alias("query"), F.lit(n).alias("rewrite_count"), F.coalesce("now", F.lit(0)).alias("now"))
    rows = rows if done is None else done.unionByName(rows)
    return rows.select("thread_id", "query", "rewrite_count", F.col("now").alias("n_kept"), ((F.col("rewrite_count") >= most) & (F.col("now") < least)).alias("is_thin"))


def regenerating(answers: DataFrame, refusal: Column, most: int = 2) -> DataFrame:
    """(thread_id, attempt, verdict, answer, is_refused) of answers(thread_id, attempt, verdict,
    answer, ...): what isn't supported is generated anew, and after the last attempt replaced by
    the refusal, an expression over the row.  Attempts that are not needed are left out."""
    over = Window.partitionBy("thread_id").orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1)
    failed = F.col("verdict") == F.lit("ungrounded")
    rows = answers.where(F.col("attempt") <= most).withColumn("before", F.coalesce(F.min(F.coalesce(failed, F.lit(False))).over(over), F.lit(True)))
    last = rows.where("before").groupBy("thread_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "thread_id"]), "attempt").alias("x")).select("thread_id", "x.*")
    refused = F.coalesce(failed & (F.col("attempt") >= most), F.lit(False))
    return last.select("thread_id", "attempt", "verdict", F.when(refused, refusal).otherwise(F.col("answer")).alias("answer"), refused.alias("is_refused"))


def verdict(answer: Column, api_refused: Column, substantive: Column, n_unsupported: Column, n_verified: Column, n_unverified: Column) -> Column:
    """The verdict on an answer: one that a service declined, or that is blank, isn't checked."""
    from corvellum.operators.runs import support

    checked = support(F.coalesce(substantive, F.lit(True)), F.coalesce(n_unsupported, F.lit(0)), n_verified, n_unverified)
    return F.when(F.coalesce(api_refused, F.lit(False)), "api_refused").when(F.coalesce(T.strip(answer), F.lit("")) == "", "not_checked").otherwise(checked)


def with_fallback(first: DataFrame, second: DataFrame, keys: Sequence[str] = ("thread_id",)) -> DataFrame:
    """first(…, answer, api_refused) with the answer of a second generator where the first one
    declined and the second didn't; `used` tells which."""
    other = second.select(*keys, F.col("answer").alias("_answer"), F.col("api_refused").alias("_refused"))
    swap = F.coalesce(F.col("api_refused"), F.lit(False)) & ~F.coalesce(F.col("_refused"), F.lit(True))
    rows = first.join(other, list(keys), "left").withColumn("used", F.when(swap, 2).otherwise(1))
    return rows.withColumn("answer", F.when(swap, F.col("_answer")).otherwise(F.col("answer"))).withColumn("api_refused", F.col("api_refused") & ~swap).drop("_answer", "_refused")


def facets(questions: DataFrame, split: DataFrame, most: int = 4) -> DataFrame:
    """(query_id, list_no, text): the parts a question of several parts is searched by.

    split(query_id, queries): what a splitter makes of it; blank parts don't count, the first
    `most` do, and a question that isn't split, or of one part, is searched as it is.
    """
    rows = questions.select("query_id", "text").join(split.select("query_id", "queries"), "query_id", "left")
    parts = F.slice(F.filter(F.transform(F.coalesce("queries", F.array().cast("array<string>")), T.strip), lambda q: F.coalesce(q != "", F.lit(False))), 1, most)
    parts = F.when(T.is_multi_part(F.col("text")) & (F.size(parts) > 0), parts).otherwise(F.array("text"))
    return rows.select("query_id", F.posexplode(parts).alias("list_no", "text"))


def merged_state(deltas: DataFrame, keys: Sequence[str] = ("thread_id",), order: str = "seq") -> DataFrame:
    """A row a key out of deltas: of every other column the last value that is set."""
    rest = [c for c in deltas.columns if c not in (*keys, order)]
    return deltas.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in rest])


def save_state(deltas: DataFrame, folder: str, step: int) -> None:
    """Keep the deltas of a step; a step that runs again replaces its own."""
    deltas.write.mode("overwrite").parquet(f"{folder}/step={step}")


def resumed_state(spark: SparkSession, folder: str, keys: Sequence[str] = ("thread_id",)) -> DataFrame:
    """The state of every key after all steps saved so far, as a new process finds it."""
    return merged_state(spark.read.parquet(folder).withColumnRenamed("step", "seq"), keys)


def isolated(rows: DataFrame, value: Column, name: str, why: str) -> DataFrame:
    """rows with a value that is computed by a function that gives NULL where it fails, and an
    error in the rows that fail: no row takes the others down."""
    return rows.withColumn(name, value).withColumn("error", F.when(F.col(name).isNull(), F.lit(why)))


def web_results(found: DataFrame, most: int = 5) -> DataFrame:
    """(thread_id, rank, title, url, content) of at most `most` results a thread; a result never
    has a page, so none can pass as a passage of a paper."""
    rank = F.row_number().over(Window.partitionBy("thread_id").orderBy(F.col("score").desc(), "url"))
    rows = found.where("url is not null").withColumn("rank", rank).where(F.col("rank") <= most)
    return rows.select("thread_id", "rank", F.coalesce("title", F.lit("")).alias("title"), "url", F.coalesce("content", F.lit("")).alias("content"))


def web_citations(results: DataFrame) -> DataFrame:
    return results.select("thread_id", F.lit("web").alias("source"), "title", "url", F.lit(False).alias("verified"))


def web_context(results: DataFrame) -> DataFrame:
    """(thread_id, context): a thread's few results, marked as such."""
    block = F.concat(F.lit('<web_result title="'), "title", F.lit('" url="'), "url", F.lit('">\n'), "content", F.lit("\n</web_result>"))
    rows = results.groupBy("thread_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("x"))
    return rows.select("thread_id", F.array_join(F.col("x.b"), "\n\n").alias("context"))


def excerpt(title: Column, page: Column, text: Column) -> Column:
    """A passage as a checker or grader sees it."""
    return F.concat(F.lit('<excerpt paper="'), F.coalesce(title, F.lit("unknown")), F.lit('" page="'), F.coalesce(page.cast("string"), F.lit("?")), F.lit('">\n'), F.coalesce(text, F.lit("")), F.lit("\n</excerpt>"))


def rewrite_inputs(threads: DataFrame, rejected: DataFrame, most: int = 8, chars: int = 400) -> DataFrame:
    """(thread_id, prompt) for threads(thread_id, question, query): the question, the query that
    failed, and the first `most` of rejected(thread_id, rank, paper_title, text, reason), each
    cut to `chars`."""
    line = F.concat(F.lit('- from "'), F.coalesce("paper_title", F.lit("unknown")), F.lit('": '), F.left(F.coalesce("text", F.lit("")), F.lit(chars)), F.lit("\n  rejected: "), F.coalesce("reason", F.lit("no reason recorded")))
    rank = F.row_number().over(Window.partitionBy("thread_id").orderBy("rank"))
    some = rejected.withColumn("n", rank).where(F.col("n") <= most).groupBy("thread_id").agg(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))).alias("x"))
    rows = threads.join(some, "thread_id", "left")
    # The wording of the prompt.
    parts = F.array(
        F.concat(F.lit("Original question: "), "question"),
        F.when(F.col("query") != F.col("question"), F.concat(F.lit("Query that just failed: "), "query")),
        F.when(F.col("x").isNotNull(), F.concat(F.lit("Excerpts retrieval found, and why each was wrong:\n"), F.array_join(F.col("x.line"), "\n"))).otherwise("Retrieval returned nothing at all — the query matched no excerpt."),
        F.lit("Rewrite the query."),
    )
    return rows.select("thread_id", F.array_join(F.array_compact(parts), "\n\n").alias("prompt"))
