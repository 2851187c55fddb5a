"""Readers and writers; all paths may be local or on a shared file system."""

from __future__ import annotations

import datetime
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvellum.functions import text as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def latest(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """One row a key, the last by the given columns: repeated deliveries count once.

    Rows are reduced before they are shuffled; as they hold texts, Spark aggregates them by
    sorting within tasks, by key only.
    """
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_x")).select(*keys, "_x.*").select(*df.columns)


def library_files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """Files of a folder with the id their content gives them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select(T.content_id(F.col("content")).alias("paper_id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), "path", "length", "modificationTime")


def golden_set(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation questions of a JSON or YAML file, with defaults for what is missing."""
    schema = "id string, question string, ground_truth string, expected_paper_ids array<string>, category string"
    df = yaml_rows(spark, path, schema) if path.endswith((".yaml", ".yml")) else spark.read.schema(schema).option("multiLine", True).json(path)
    return with_defaults(df)


def with_defaults(df: DataFrame) -> DataFrame:
    """Questions as they count when fields are missing."""
    return df.select("id", "question", F.coalesce("ground_truth", F.lit("")).alias("ground_truth"), F.coalesce("expected_paper_ids", F.array().cast("array<string>")).alias("expected_paper_ids"), F.coalesce("category", F.lit("factual")).alias("category"))


def golden_violations(golden: DataFrame, categories: Sequence[str]) -> DataFrame:
    """Rows (id, violation): repeated ids, unknown categories, and expectations that don't
    fit the category: only unanswerable questions expect no paper."""
    none = F.size(F.coalesce("expected_paper_ids", F.array().cast("array<string>"))) == 0
    checks = [
        (~F.coalesce(F.col("category").isin(*categories), F.lit(False)), "unknown category"),
        ((F.col("category") == "unanswerable") & ~none, "unanswerable but expects papers"),
        ((F.col("category") != "unanswerable") & none, "answerable but expects none"),
    ]
    found = golden.select("id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(v)) for c, v in checks]))).alias("violation"))
    repeated = golden.groupBy("id").count().where("count > 1").select("id", F.lit("repeated id").alias("violation"))
    return found.unionByName(repeated)


def route_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels(id, with_paper, no_paper, paper_open, notes) of a JSON or YAML file."""
    schema = "id string, with_paper string, no_paper string, paper_open string, notes string"
    return yaml_rows(spark, path, schema) if path.endswith((".yaml", ".yml")) else spark.read.schema(schema).option("multiLine", True).json(path)


def latest_results(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the newest results file that has configurations; others are passed over."""
    df = spark.read.option("multiLine", True).json(f"{folder}/*.json")
    if "configs" not in df.columns:
        return df.limit(0)
    named = df.where("configs is not null").withColumn("file_name", F.col("_metadata.file_name"))
    return named.join(named.agg(F.max("file_name").alias("file_name")), "file_name").select("file_name", F.explode("configs").alias("config")).select("file_name", "config.*")


def merge_chunks(current: DataFrame, new: DataFrame, keys: Sequence[str] = ("paper_id",)) -> DataFrame:
    """The index after an ingest: all chunks of the given papers are replaced, so a paper
    that now yields fewer leaves no orphans; running it twice changes nothing."""
    return current.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def write_index(df: DataFrame, path: str, files: int | None = None) -> None:
    """Chunks clustered by paper, so filters on a paper touch few files."""
    df = df.repartitionByRange(files, "paper_id", "chunk_index") if files else df.repartitionByRange("paper_id", "chunk_index")
    df.sortWithinPartitions("paper_id", "chunk_index").write.mode("overwrite").parquet(path)


def missing(wanted: DataFrame, cache: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What a memo table doesn't hold yet."""
    return wanted.join(cache.select(*keys), list(keys), "left_anti")


def write_pages(pages: DataFrame, path: str) -> None:
    """Page texts as text files, a folder a paper."""
    pages.select("paper_id", F.col("text").alias("value")).write.mode("overwrite").partitionBy("paper_id").text(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(value, paper_id): the lines of text files in a folder a paper.

    The schema is given, as ids must not be told by their looks: 12e345678901 would pass for a
    number of billions of digits, which Spark writes out, and 007 for 7.
    """
    return spark.read.schema("value string, paper_id string").text(path)


def event_frames(event: Column, payload: Column) -> Column:
    """Server-sent events: name, JSON payload, blank line."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), F.to_json(payload), F.lit("\n\n"))


def write_results(df: DataFrame, folder: str, at: datetime.datetime) -> str:
    """The rows of a report, small by nature, as one JSON file named by a time in UTC."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{at.astimezone(datetime.UTC):%Y%m%dT%H%M%SZ}.json")
    text = json.dumps({"configs": [json.loads(x) for x in df.toJSON().collect()]}, ensure_ascii=False, indent=2)
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(text.encode()))
    out.close()
    return path.toString()


def yaml_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A YAML list of mappings with the declared fields; needs a YAML library on the driver."""
    import yaml  # optional: JSON sources need none

    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    return spark.createDataFrame([json.dumps(r, ensure_ascii=False, default=str) for r in yaml.safe_load(text) or []], "string").select(F.from_json("value", schema).alias("r")).select("r.*")


def markdown(df: DataFrame, order: Sequence[str] = ()) -> str:
    """A report table as Markdown; reports have a row a configuration or route."""
    rows = [r.asDict(recursive=True) for r in (df.orderBy(*order) if order else df).collect()]
    show = lambda v: "–" if v is None else json.dumps(v, ensure_ascii=False) if isinstance(v, dict | list) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(show(r[c]) for c in df.columns) + " |" for r in rows])


def numbered(df: DataFrame, within: Sequence[str], order: Sequence[str], form: str = "d%02d") -> DataFrame:
    """Rows renumbered in order within a group: d01, d02, ..."""
    n = F.row_number().over(Window.partitionBy(*within).orderBy(*order))
    return df.withColumn("number", F.format_string(form, n))
