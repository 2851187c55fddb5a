import json

from pyspark.sql import functions as F

from corvellum.operators import corpus
from corvellum.sources import tables as sources
from corvellum.streaming import ingest

CHUNKS = "chunk_id string, paper_id string, paper_title string, page int, section string, chunk_index int, year int, source_path string, text string"


def chunks(spark):
    rows = [("p:1", "p", "Title", 3, "Method", 1, 0, "p.pdf", "b"), ("p:0", "p", "First", 1, "Intro", 0, 0, "p.pdf", "a"), ("p:2", "p", "Title", 2, "Intro", 2, 0, "p.pdf", "c"), ("q:0", "q", "Other", 1, "", 0, 2020, "q.pdf", "d")]
    return spark.createDataFrame(rows, CHUNKS)


def test_inventory(spark):
    got = {r.paper_id: r for r in corpus.inventory(chunks(spark)).collect()}
    assert (got["p"].paper_title, got["p"].year, got["p"].max_page, got["p"].n_chunks, got["p"].sections) == ("First", None, 3, 3, ["Intro", "Method"])
    assert got["q"].sections == [] and got["q"].year == 2020
    sections = spark.createDataFrame([("p", "Intro", "a"), ("p", "Method", "b")], "paper_id string, section string, section_text string")
    assert corpus.read_paper(sections, "p", "METHOD").first().section_text == "b" and corpus.read_paper(sections, "p").count() == 2 and corpus.read_paper(sections, "z").count() == 0


def test_latest_and_merge(spark):
    df = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 1, None)], "k string, at int, v string")
    assert {tuple(r) for r in sources.latest(df, ["k"], "at").collect()} == {("a", 2, "new"), ("b", 1, None)}
    new = chunks(spark).where("chunk_id = 'p:0'").withColumn("text", F.lit("x"))
    once = sources.merge_chunks(chunks(spark), new)
    twice = sources.merge_chunks(once, new)
    assert {tuple(r) for r in once.collect()} == {tuple(r) for r in twice.collect()} and {r.chunk_id for r in once.collect()} == {"p:0", "q:0"}


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"same")
    (tmp_path / "b.pdf").write_bytes(b"same")
    (tmp_path / "c.txt").write_bytes(b"no")
    rows = sources.library_files(spark, str(tmp_path)).collect()
    assert {r.file_name for r in rows} == {"a.pdf", "b.pdf"} and len({r.paper_id for r in rows}) == 1
    golden = tmp_path / "golden.json"
    golden.write_text(json.dumps([{"id": "a", "question": "q"}, {"id": "b", "question": "r", "category": "comparison", "expected_paper_ids": ["p"], "ground_truth": None}]))
    got = {r.id: r for r in sources.golden_set(spark, str(golden)).collect()}
    assert got["a"].category == "factual" and got["a"].expected_paper_ids == [] and got["b"].ground_truth == ""
    results = tmp_path / "results"
    results.mkdir()
    (results / "20260101.json").write_text(json.dumps({"configs": [{"mode": "bm25", "recall": 0.5}]}))
    (results / "20260102.json").write_text(json.dumps({"configs": [{"mode": "dense", "recall": 0.6}]}))
    (results / "sweep.json").write_text(json.dumps({"rows": [1]}))
    assert [r.mode for r in sources.latest_results(spark, str(results)).collect()] == ["dense"]


def test_sinks(spark, tmp_path):
    sources.write_index(chunks(spark), str(tmp_path / "index"))
    assert spark.read.parquet(str(tmp_path / "index")).count() == 4
    sources.write_pages(chunks(spark), str(tmp_path / "pages"))
    assert (tmp_path / "pages" / "paper_id=p").exists()
    assert sources.markdown(chunks(spark).select("chunk_id", "year").where("chunk_id = 'q:0'")) == "| chunk_id | year |\n|---|---|\n| q:0 | 2020 |"
    frame = chunks(spark).where("chunk_id = 'q:0'").select(sources.event_frames(F.lit("node"), F.struct("chunk_id")).alias("y")).first().y
    assert frame == 'event: node\ndata: {"chunk_id":"q:0"}\n\n'
    assert {r.chunk_id for r in sources.missing(chunks(spark), chunks(spark).where("paper_id = 'p'"), ["chunk_id"]).collect()} == {"q:0"}


def test_pages_keep_their_ids(spark, tmp_path):
    """Ids that look like numbers, even of billions of digits, stay as they are."""
    rows = [("007", "a"), ("007", ""), ("12", "b"), ("1e2", "c"), ("12e345678901", "d"), ("5e999999999", "e"), ("2024-01-02", "f")]
    df = spark.createDataFrame(rows, "paper_id string, text string")
    for k, some in enumerate((df, df.where("paper_id in ('007', '12')"))):
        sources.write_pages(some, str(tmp_path / f"pages{k}"))
        back = sources.read_pages(spark, str(tmp_path / f"pages{k}"))
        assert sorted((r.paper_id, r.value) for r in back.collect()) == sorted(map(tuple, some.collect()))


def test_stream_equals_batch(spark, tmp_path):
    papers = spark.createDataFrame([("p", "P", 2020, "p.pdf"), ("q", "Q", None, "q.pdf")], "paper_id string, title string, year int, path string")
    source, index, state = (str(tmp_path / x) for x in ("source", "index", "state"))

    def arrive(rows):
        df = spark.createDataFrame(rows, "paper_id string, page int, text string").withColumn("parsed_at", F.lit("2025-01-01 00:00:00").cast("timestamp_ntz"))
        df.coalesce(1).write.mode("append").parquet(source)
        ingest.ingest_stream(spark, source, index, state, papers).awaitTermination()
        return {(r.chunk_id, r.text) for r in ingest.read_index(spark, index).collect()}

    assert ingest.read_index(spark, index) is None
    assert arrive([("p", 1, "Introduction\nOne sentence. Another one."), ("q", 1, "Text.")]) == {("p:0", "One sentence. Another one."), ("q:0", "Text.")}
    assert arrive([("p", 1, "Introduction\nOnly this.")]) == {("p:0", "Only this."), ("q:0", "Text.")}
    assert arrive([("p", 1, "Introduction\nOnly this.")]) == {("p:0", "Only this."), ("q:0", "Text.")}


def test_event_windows(spark, tables):
    path = f"{tables}/events.parquet"
    stream = {(r.began, r.event_type): r.n for r in ingest.event_windows(spark, path).collect()}
    batch = spark.read.parquet(path).groupBy(F.date_format("ts", "yyyy-MM-dd HH:00").alias("began"), "event_type").count().collect()
    assert stream == {(r.began, r.event_type): r["count"] for r in batch}
