"""Metrics of retrieval, routing, rewriting, grounding, latency and cost.

All are aggregates with conditions; rates are NULL where their denominator is 0, rounding
is half to even.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The domains that dense tables list in full.
ROUTES = ("single_paper", "library", "web", "direct")
VERDICTS = ("grounded", "partially_grounded", "ungrounded", "api_refused", "not_checked")
CUTS = (1, 3, 5, 10)


def r(value: Column, digits: int = 4) -> Column:
    return F.bround(value, digits)


def recall_at(retrieved: Column, expected: Column, k: int) -> Column:
    """Share of the distinct expected ids among the first k retrieved; 0 if none expected."""
    wanted = F.array_distinct(expected)
    return F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, F.slice(retrieved, 1, k))) / F.size(wanted)).otherwise(0.0)


def reciprocal_rank(retrieved: Column, expected: Column) -> Column:
    """1 over the first place of an expected id, 0 if there is none."""
    first = F.array_min(F.filter(F.transform(expected, lambda e: F.array_position(retrieved, e)), lambda p: p > 0))
    return F.coalesce(F.lit(1.0) / first, F.lit(0.0))


def retrieved_lists(golden: DataFrame, hits: DataFrame) -> DataFrame:
    """Questions with the distinct papers of their hits(query_id, rank, paper_id) in order."""
    lists = hits.groupBy(F.col("query_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("rank", "paper_id"))).alias("x"))
    found = lists.select("id", F.array_distinct(F.col("x.paper_id")).alias("retrieved"))
    return golden.join(found, "id", "left").withColumn("retrieved", F.coalesce("retrieved", F.array().cast("array<string>")))


def per_question(rows: DataFrame) -> DataFrame:
    """Recall at the cuts and reciprocal rank of rows(id, category, expected_paper_ids, retrieved)."""
    e = F.coalesce("expected_paper_ids", F.array().cast("array<string>"))
    cuts = [recall_at(F.col("retrieved"), e, k).alias(f"recall_at_{k}") for k in CUTS]
    return rows.select("id", "category", (F.size(e) == 0).alias("is_unanswerable"), *cuts, reciprocal_rank(F.col("retrieved"), e).alias("rr"))


def retrieval_summary(questions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Means over the answerable questions, 0 if there are none; with a column refused, the
    share of the unanswerable ones that were declined, of those where that is told."""
    known = F.col("is_unanswerable") == F.lit(False)
    means = [F.coalesce(r(F.avg(F.when(known, F.col(c)))), F.lit(0.0)).alias(n) for c, n in [*((f"recall_at_{k}", f"recall_at_{k}") for k in CUTS), ("rr", "mrr")]]
    declined = [r(F.avg(F.when(~known, F.col("refused").cast("int")))).alias("refusal_rate")] if "refused" in questions.columns else []
    return questions.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(known).alias("n_answerable"), *means, *declined)


def route_accuracy(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    same = F.coalesce((F.col("expected") == F.col("predicted")).cast("int"), F.lit(0))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(r(F.avg(same)), F.lit(0.0)).alias("accuracy"))


def domain(spark: SparkSession, name: str, values: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def confusion(rows: DataFrame) -> DataFrame:
    """Counts of every pair of routes, also of those that never occur."""
    spark = rows.sparkSession
    pairs = [(e, p) for e in ROUTES for p in ROUTES]
    spine = spark.createDataFrame(pairs, "expected string, predicted string")
    counts = rows.groupBy("expected", "predicted").agg(F.count("*").alias("n"))
    return F.broadcast(spine).join(counts, ["expected", "predicted"], "left").select("expected", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def route_scores(matrix: DataFrame) -> DataFrame:
    """Support, hits, recall and precision of each route."""
    hit = F.sum(F.when(F.col("expected") == F.col("predicted"), F.col("n")).otherwise(0))
    a = matrix.groupBy(F.col("expected").alias("route")).agg(F.sum("n").alias("support"), hit.alias("correct"))
    b = matrix.groupBy(F.col("predicted").alias("route")).agg(F.sum("n").alias("n_predicted"))
    ratio = lambda x, y: r(F.try_divide(F.col(x), F.col(y)))
    return a.join(b, "route").select("route", "support", "correct", ratio("correct", "support").alias("recall"), ratio("correct", "n_predicted").alias("precision"))


def rewrite_metrics(rows: DataFrame) -> DataFrame:
    """Answerable questions whose query was rewritten against those where it wasn't."""
    fired, rest = F.col("rewrite_count") > 0, F.col("rewrite_count") == 0
    mean = lambda c, when, d: r(F.avg(F.when(when, F.col(c))), d)
    one = rows.where(~F.coalesce("is_unanswerable", F.lit(False))).withColumn("rewrite_count", F.coalesce("rewrite_count", F.lit(0))).agg(
        F.count("*").alias("n_answerable"), F.count_if(fired).alias("n_fired"), r(F.avg(fired.cast("int"))).alias("trigger_rate"),
        mean("recall_at_5", fired, 4).alias("recall_when_fired"), mean("recall_at_5", rest, 4).alias("recall_when_not_fired"),
        mean("latency_ms", fired, 1).alias("latency_when_fired"), mean("latency_ms", rest, 1).alias("latency_when_not_fired"),
    )
    return one.withColumn("recall_delta", r(F.col("recall_when_fired") - F.col("recall_when_not_fired")))


def _fired(rows: DataFrame) -> DataFrame:
    return rows.where((F.col("rewrite_count") > 0) & ~F.coalesce("is_unanswerable", F.lit(False)))


def within_question(rows: DataFrame) -> DataFrame:
    """Recall of the first and the last pass of the questions that were rewritten."""
    a, b = F.col("recall_at_5_first_pass"), F.col("recall_at_5_final_pass")
    return _fired(rows).where(a.isNotNull() & b.isNotNull()).agg(
        F.count("*").alias("n_fired"), r(F.avg(a)).alias("mean_first_pass"), r(F.avg(b)).alias("mean_final_pass"), r(F.avg(b - a)).alias("mean_delta"),
        F.count_if(b > a).alias("improved"), F.count_if(b == a).alias("unchanged"), F.count_if(b < a).alias("worsened"), F.count_if((a == 0) & (b > 0)).alias("rescued_from_zero"),
    )


def fired_despite_good(rows: DataFrame, least: float = 1.0) -> DataFrame:
    return _fired(rows).where(F.coalesce("recall_at_5_first_pass", F.lit(0.0)) >= least)


def misroutes(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("expected").eqNullSafe(F.col("predicted")))


def verdict_shares(rows: DataFrame) -> DataFrame:
    """Count and share of every verdict; other values don't count towards the total."""
    counts = rows.groupBy("verdict").agg(F.count("*").alias("n"))
    dense = F.broadcast(domain(rows.sparkSession, "verdict", VERDICTS)).join(counts, "verdict", "left").select("verdict", F.coalesce("n", F.lit(0)).alias("n"))
    total = dense.agg(F.sum("n")).scalar()
    return dense.select("verdict", "n", r(F.try_divide(F.col("n"), total)).alias("share"))


def refusal_rates(rows: DataFrame) -> DataFrame:
    """How many unanswerable questions were declined, told in two ways."""
    a, b = (F.coalesce(c, F.lit(False)) for c in ("refused_by_prefix", "refused_by_grounding"))
    return rows.where("is_unanswerable").agg(F.count("*").alias("n"), F.count_if(a).alias("prefix_correct"), r(F.avg(a.cast("int"))).alias("prefix_rate"), F.count_if(b).alias("grounding_correct"), r(F.avg(b.cast("int"))).alias("grounding_rate"))


def refusal_disagreements(rows: DataFrame, most: int = 160) -> DataFrame:
    a, b = (F.coalesce(c, F.lit(False)) for c in ("refused_by_prefix", "refused_by_grounding"))
    return rows.where("is_unanswerable").where(a != b).select("thread_id", "id", a.alias("prefix"), b.alias("grounding"), F.left(F.coalesce("answer", F.lit("")), F.lit(most)).alias("answer"))


def nearest_rank(values: Column, share: float) -> Column:
    """The value at position share * (n - 1), half to even, of an array; not interpolated."""
    ordered = F.array_sort(values)
    at = F.least(F.size(ordered) - 1, F.bround(F.lit(share) * (F.size(ordered) - 1)).cast("int"))
    return F.when(F.size(ordered) > 0, F.element_at(ordered, at + 1))


def latency_and_cost(rows: DataFrame) -> DataFrame:
    """Latency percentiles and costs by route and over all; a latency of 0 is none."""
    timed = F.when(F.col("latency_ms") != 0, F.col("latency_ms"))
    # Positions of percentiles come from counts, so no group's values are gathered.
    grouped = rows.select("route", "latency_ms", "cost_usd").groupingSets([[F.col("route")], []], F.col("route")).agg(
        F.grouping("route").alias("g"), F.count("*").alias("n"), F.median(timed).alias("p50"), F.avg(timed).alias("mean"), F.median("cost_usd").alias("median_cost"), F.sum("cost_usd").alias("total_cost"),
    )
    scoped = rows.where(timed.isNotNull()).select(F.explode(F.array("route", F.lit("all"))).alias("route"), "latency_ms")
    at = F.bround(F.lit(0.95) * (F.col("m") - 1)).cast("bigint") + 1
    tally = scoped.groupBy("route", "latency_ms").agg(F.count("*").alias("c"))
    running = tally.withColumn("upto", F.sum("c").over(Window.partitionBy("route").orderBy("latency_ms"))).withColumn("m", F.sum("c").over(Window.partitionBy("route")))
    p95 = running.where(F.col("upto") >= at).groupBy("route").agg(F.min("latency_ms").alias("p95"))
    named = grouped.select(F.when(F.col("g") == 1, "all").otherwise(F.col("route")).alias("route"), "n", r(F.col("p50"), 2).alias("p50_ms"), r(F.col("mean"), 2).alias("mean_ms"), r(F.col("median_cost"), 6).alias("median_cost_usd"), r(F.col("total_cost"), 4).alias("total_cost_usd"))
    return named.where(F.col("route").isin(*ROUTES, "all")).join(p95.select("route", r(F.col("p95"), 2).alias("p95_ms")), "route", "left")


def kept_after_grading(grades: DataFrame) -> DataFrame:
    """A passage is kept if it is relevant or on topic; only on topic is partial.  A grade that
    says nothing is a rejection, but a passage without a grade (is_graded false) is kept."""
    relevant = F.coalesce("relevant", F.lit(False))
    topic = F.coalesce("on_topic", relevant)
    missing = ~F.coalesce(F.col("is_graded"), F.lit(True)) if "is_graded" in grades.columns else F.lit(False)
    return grades.withColumn("kept", relevant | topic | missing).withColumn("partial", ~relevant & topic)


def grade_passages(passages: DataFrame, grades: DataFrame, keys: Sequence[str]) -> DataFrame:
    """passages with the grades of their keys, and whether they are kept."""
    rows = passages.join(grades.withColumn("is_graded", F.lit(True)), list(keys), "left")
    return kept_after_grading(rows.withColumn("is_graded", F.coalesce("is_graded", F.lit(False))))


def grade_rollup(graded: DataFrame, by: Sequence[str], price_in: float, price_out: float) -> DataFrame:
    """Passages graded, kept and partial, tokens and their cost, at given prices a million."""
    rows = graded.groupBy(*by).agg(F.count("*").alias("n_graded"), F.count_if("kept").alias("n_kept"), F.count_if(F.col("partial") & F.col("kept")).alias("n_partial"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"))
    return rows.withColumn("cost_usd", r((F.col("input_tokens") * price_in + F.col("output_tokens") * price_out) / 1e6, 6))


def _drawn(*keys: str | Column, seed: int) -> Column:
    """An order by hash, the same wherever it is computed."""
    return F.sha2(F.concat_ws(":", *[F.col(k) if isinstance(k, str) else k for k in keys], F.lit(str(seed))), 256)


def stratified_sample(golden: DataFrame, sample: int, seed: int = 7) -> DataFrame:
    """All unanswerable questions and an even share of the other categories, up to `sample`
    rows; who is chosen is decided by a hash, so the choice is the same everywhere."""
    order = [_drawn("id", seed=seed), F.col("id")]
    none = F.col("category") == "unanswerable"
    counts = golden.groupBy().agg(F.count_if(none).alias("n"), F.count_distinct(F.when(~none, F.col("category"))).alias("c")).select(F.greatest(F.lit(sample) - F.col("n"), F.lit(0)).alias("room"), "c")
    share = F.greatest(F.floor(F.col("room") / F.col("c")), F.lit(1))
    each = golden.where(~none).withColumn("n", F.row_number().over(Window.partitionBy("category").orderBy(*order))).where(F.col("n") <= max(sample, 1))
    each = each.crossJoin(F.broadcast(counts)).where(F.col("n") <= share)  # one row of counts
    cut = each.withColumn("n", F.row_number().over(Window.orderBy(*order))).where(F.col("n") <= F.col("room")).select(*golden.columns)  # of a sample's rows
    return golden.where(none).unionByName(cut)


def paper_sample(chunks: DataFrame, papers: int, head: int = 2, more: int = 6, seed: int = 7) -> DataFrame:
    """(paper_id, part, nth, chunk_id): of some papers, drawn by a hash, the first chunks and
    some more drawn from all of theirs, which may be the same ones."""
    ids = chunks.select("paper_id").distinct()
    chosen = ids.orderBy(_drawn("paper_id", seed=seed), "paper_id").limit(papers)
    rows = chunks.join(F.broadcast(chosen), "paper_id", "left_semi").select("paper_id", "chunk_id", "chunk_index")
    nth = lambda *by: F.row_number().over(Window.partitionBy("paper_id").orderBy(*by))
    first = rows.withColumn("nth", nth("chunk_index", "chunk_id")).where(F.col("nth") <= head).withColumn("part", F.lit("head"))
    drawn = rows.withColumn("nth", nth(_drawn("chunk_id", seed=seed), "chunk_id")).where(F.col("nth") <= more).withColumn("part", F.lit("drawn"))
    return first.unionByName(drawn).select("paper_id", "part", "nth", "chunk_id")


def total_cost(usage: Column) -> Column:
    """Sum of the costs in a map of node to usage struct."""
    return F.bround(F.aggregate(F.map_values(usage), F.lit(0.0), lambda s, u: s + F.coalesce(u["cost_usd"], F.lit(0.0))), 6)
