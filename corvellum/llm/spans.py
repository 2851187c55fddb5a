"""Long exact spans shared between records (problem 3).

Candidates come from seeds: of every run of grams of a text the least hash is kept, so any
passage long enough leaves an equal seed in every record that holds it.  For a record that
serves as reference a suffix automaton is built once, and its candidates are streamed
through it; matching statistics give every maximal span above the threshold, exactly.

The references are sharded by key and go where their candidates are: broadcasting the
automata of all references would send the whole collection to every executor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvellum.llm.codes import code_points, prefix_hash, seeds, slices, span_hash
from corvellum.session import shared_folder, spread

#: Characters of a passage, of a gram, and grams in a run: GRAM + RUN - 1 is the passage.
LEAST, GRAM, RUN = 160, 96, 65
#: A seed of more texts is not paired itself; see hot_links.
HOT = 64
#: Candidates that one automaton serves before another is built elsewhere.
SERVED = 256


class SuffixAutomaton:
    """Automaton of all substrings of a text."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.size = [-1], [0]
        nexts, link, size = self.next, self.link, self.size
        last = 0
        for c in text:
            new = len(nexts)
            nexts.append({})
            link.append(0)
            size.append(size[last] + 1)
            p = last
            while p >= 0 and c not in nexts[p]:
                nexts[p][c] = new
                p = link[p]
            if p >= 0:
                q = nexts[p][c]
                if size[q] != size[p] + 1:
                    copy = len(nexts)
                    nexts.append(nexts[q].copy())
                    link.append(link[q])
                    size.append(size[p] + 1)
                    while p >= 0 and nexts[p].get(c) == q:
                        nexts[p][c] = copy
                        p = link[p]
                    link[q] = link[new] = copy
                    q = copy
                link[new] = q
            last = new

    def spans(self, text: str, least: int) -> list[tuple[int, int]]:
        """Maximal spans (start, end) of text, least or longer, that stand in the reference."""
        nexts, link, size = self.next, self.link, self.size
        state = length = 0
        found: list[tuple[int, int]] = []
        for i, c in enumerate(text):
            if c in nexts[state]:
                state = nexts[state][c]
                length += 1
                continue
            if length >= least:
                found.append((i - length, i))
            while state and c not in nexts[state]:
                state = link[state]
                length = size[state]
            if c in nexts[state]:
                state = nexts[state][c]
                length += 1
            else:
                length = 0
        if length >= least:
            found.append((len(text) - length, len(text)))
        return found


KINDS = "cls bigint, paper bigint, is_page boolean, seeds array<bigint>"


def _seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        found = []
        for i, j in slices(texts):
            prefix, at = prefix_hash(code_points("".join(texts[i:j]))), 0
            for t in texts[i:j]:
                found.append(seeds(prefix, at, at + len(t), GRAM, RUN).astype(np.int64))
                at += len(t)
        ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
        rows = [batch.column(c) for c in ("cls", "paper", "is_page")]
        yield pa.RecordBatch.from_arrays([*rows, pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*found, np.zeros(0, np.int64)])))], ["cls", "paper", "is_page", "seeds"])


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of all passages of LEAST characters that hold one of a record's hot seeds."""
    for batch in batches:
        rows = [batch.column(c) for c in ("cls", "paper", "is_page")]
        found = []
        for text, hot in zip(batch.column("text").to_pylist(), batch.column("hot").to_pylist()):
            prefix = prefix_hash(code_points(text))
            at = np.arange(len(text) - GRAM + 1)
            hit = at[np.isin(span_hash(prefix, at, at + GRAM).astype(np.int64), hot)]
            start = np.unique((hit[:, None] - np.arange(LEAST - GRAM + 1)[None, :]).ravel())
            start = start[(start >= 0) & (start + LEAST <= len(text))]
            found.append(np.unique(span_hash(prefix, start, start + LEAST).astype(np.int64)))
        ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([*rows, pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*found, np.zeros(0, np.int64)])))], ["cls", "paper", "is_page", "seeds"])


def _matched(least: int) -> Callable:
    """Rows come sorted: a reference (doc NULL), then the records to stream through it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, automaton, text_of = None, None, ""
        for batch in batches:
            out: list[tuple] = []
            for ref, doc, text in zip(*(batch.column(c).to_pylist() for c in ("ref", "doc", "text"))):
                if doc is None:
                    of, automaton, text_of = ref, None, text
                    continue
                if of != ref:
                    raise ValueError("a record came before its reference")
                if automaton is None:
                    automaton = SuffixAutomaton(text_of)
                out += [(doc, ref, a, b) for a, b in automaton.spans(text, least)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["doc", "ref", "span_start", "span_end"])

    return run


class SharedSpans:
    """Passages of LEAST characters or more that records of different papers have in common.

    records(rec, paper_id, is_page, text): texts are compared as they are, by code points.
    Records of one text form a class, which is seeded and streamed once.  Pairs of two
    records that are no pages don't count.  Defined results: NULL keys or texts and texts
    under LEAST characters share nothing; repeated rows count once; a NULL is_page is no
    page; other columns are ignored.
    """

    def __init__(self, records: DataFrame):
        self._shared: DataFrame | None = None
        shared_folder(records.sparkSession)  # seeds in common and candidate pairs are checkpointed there
        self.records = records.select(
            "rec", F.xxhash64("paper_id").alias("paper"), F.coalesce("is_page", F.lit(False)).alias("is_page"), "text", F.xxhash64("text").alias("cls")
        ).where(F.col("rec").isNotNull() & F.col("paper_id").isNotNull() & (F.length("text") >= LEAST))
        self.members = self.records.select("rec", "paper", "is_page", "cls").distinct()

    @staticmethod
    def _pairs(rows: DataFrame) -> DataFrame:
        a, b = (rows.select("seed", *(F.col(c).alias(f"{c}_{s}") for c in ("cls", "paper", "is_page"))) for s in "ab")
        both = a.join(b, "seed").where("cls_a < cls_b and paper_a != paper_b and (is_page_a or is_page_b)")
        return both.select("cls_a", "cls_b").distinct()

    def shared(self) -> DataFrame:
        """(seed, n, cls, paper, is_page) of the seeds that occur in several papers; n: their
        classes.  Made once and checkpointed."""
        if self._shared is None:
            rows = self.records.mapInArrow(_seeded, KINDS).select("cls", "paper", "is_page", F.explode("seeds").alias("seed"))
            rows = rows.repartition("seed").dropDuplicates(["seed", "cls", "paper", "is_page"])
            spread = rows.groupBy("seed").agg(F.count("*").alias("n"), F.min("paper").alias("x"), F.max("paper").alias("y"))
            self._shared = rows.join(spread.where("x != y").select("seed", "n"), "seed").checkpoint()
        return self._shared

    def passages(self, seeds: DataFrame) -> DataFrame:
        """(seed, cls, paper, is_page) with the hash of each passage around a seed as seed."""
        held = seeds.groupBy("cls", "paper", "is_page").agg(F.collect_set("seed").alias("hot"))  # of one text
        rows = self.records.select("cls", "paper", "is_page", "text").distinct().join(held, ["cls", "paper", "is_page"])
        return rows.mapInArrow(_passages, KINDS).select("cls", "paper", "is_page", F.explode("seeds").alias("seed")).distinct()

    @staticmethod
    def references(passages: DataFrame) -> DataFrame:
        """(seed, ref): two pages that hold a passage, of different papers if there are such."""
        two = passages.where("is_page").groupBy("seed").agg(F.array(F.min_by("cls", "paper"), F.max_by("cls", "paper")).alias("refs"))
        return two.select("seed", F.explode("refs").alias("ref")).distinct()

    def candidates(self) -> DataFrame:
        """Pairs of classes, of different papers, that share a seed that isn't hot."""
        return self._pairs(self.shared().where(F.col("n") <= HOT)).checkpoint()

    def hot_links(self) -> DataFrame | None:
        """Linked classes (cls_a, cls_b) that share a passage around a hot seed.

        Who holds a passage is verified against its references and not pair by pair, so the
        automata see every holder twice, not once for every other holder.
        """
        hot = self.shared().where(F.col("n") > HOT)
        if hot.isEmpty():  # no need to plan for nothing
            return None
        around = self.passages(hot).checkpoint()
        refs = self.references(around)
        to = around.join(refs, "seed").select("seed", F.col("cls").alias("doc"), "ref")
        found = self.spans(to.select("doc", "ref").where("doc != ref").distinct().checkpoint()).select("doc", "ref").distinct()
        sure = to.join(found, ["doc", "ref"], "left_semi").unionByName(to.where("doc = ref").select("doc", "ref", "seed")).select("seed", F.col("doc").alias("cls")).distinct()
        held = around.join(sure, ["seed", "cls"])
        # Neighbouring passages have the same holders: one passage of each set of holders is enough.
        sign = [F.sum(F.xxhash64("cls", "paper", "is_page", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in (0, 1)]
        one = held.groupBy("seed").agg(F.count("*").alias("n"), *sign).groupBy("n", "s0", "s1").agg(F.min("seed").alias("seed")).select("seed")
        return self._pairs(held.join(one, "seed"))

    def spans(self, directed: DataFrame) -> DataFrame:
        """(doc, ref, span_start, span_end) of directed(doc, ref): the maximal spans of the
        class doc that stand in the class ref."""
        wanted = directed.select(F.explode(F.array("doc", "ref")).alias("cls")).distinct()
        texts = self.records.select("cls", "text").join(wanted, "cls", "left_semi").dropDuplicates(["cls"])
        load = directed.groupBy("ref").agg(F.ceil(F.count("*") / SERVED).alias("shards"))
        shard = F.pmod(F.xxhash64("doc"), F.col("shards")).alias("shard")
        docs = directed.join(load, "ref").select("ref", shard, "doc").join(texts.withColumnRenamed("cls", "doc"), "doc")
        refs = load.select("ref", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shards") - 1)).alias("shard"), F.lit(None).cast("bigint").alias("doc")).join(texts.withColumnRenamed("cls", "ref"), "ref")
        rows = docs.select("ref", "shard", "doc", "text").unionByName(refs.select("ref", "shard", "doc", "text"))
        rows = rows.repartition("ref", "shard").sortWithinPartitions("ref", "shard", F.col("doc").asc_nulls_first())
        return rows.mapInArrow(_matched(LEAST), "doc bigint, ref bigint, span_start int, span_end int")

    def pairs(self) -> DataFrame:
        """(rec_a, rec_b) of all records that share a passage, rec_a < rec_b."""
        links = self.spans(self.candidates().select(F.col("cls_a").alias("doc"), F.col("cls_b").alias("ref"))).select(F.col("doc").alias("cls_a"), F.col("ref").alias("cls_b"))
        if (hot := self.hot_links()) is not None:
            links = links.unionByName(hot)
        links = links.distinct()
        same = self.members.groupBy("cls").agg(F.min("paper").alias("x"), F.max("paper").alias("y")).where("x != y").select(F.col("cls").alias("cls_a"), F.col("cls").alias("cls_b"))
        a, b = (self.members.select(*(F.col(c).alias(f"{c}_{s}") for c in ("cls", "rec", "paper", "is_page"))) for s in "ab")
        both = links.unionByName(same).join(a, "cls_a").join(b, "cls_b").where("rec_a != rec_b and paper_a != paper_b and (is_page_a or is_page_b)")
        return both.select(F.least("rec_a", "rec_b").alias("rec_a"), F.greatest("rec_a", "rec_b").alias("rec_b")).distinct()

    def coverage(self) -> DataFrame:
        """Per record of LEAST characters or more: how much of it pages of other papers hold.

        Each passage around a shared seed has two pages as its references, of different
        papers where there are such; one of them is of another paper than the record's, so
        all of what is shared is found with at most two partners a passage, however many
        records hold it.
        """
        size = self.records.groupBy("cls").agg(F.max(F.length("text")).alias("n_chars"))
        whole = size.select(F.col("cls").alias("doc"), F.col("cls").alias("ref"), F.lit(0).alias("span_start"), F.col("n_chars").alias("span_end"))
        homes = self.members.where("is_page").select(F.col("cls").alias("ref"), F.col("paper").alias("home")).distinct()
        # Two papers tell whether another than one's own holds the reference.
        homes = homes.groupBy("ref").agg(F.min("home").alias("x"), F.max("home").alias("y"))
        around = self.passages(self.shared()).checkpoint()
        directed = around.join(self.references(around), "seed").select(F.col("cls").alias("doc"), "ref").where("doc != ref").distinct().checkpoint()
        held = self.spans(directed).unionByName(whole).join(homes, "ref").join(self.members.withColumnRenamed("cls", "doc"), "doc").where("x != paper or y != paper").select("rec", "doc", "span_start", "span_end").distinct()
        before = Window.partitionBy("rec", "doc").orderBy("span_start", "span_end").rowsBetween(Window.unboundedPreceding, -1)
        new = F.greatest(F.lit(0), F.col("span_end") - F.greatest("span_start", F.coalesce(F.max("span_end").over(before), F.lit(0))))
        covered = held.select("rec", "doc", new.alias("new")).groupBy("rec", F.col("doc").alias("cls")).agg(F.sum("new").alias("shared_chars"))
        rows = self.members.join(size, "cls").join(covered, ["rec", "cls"], "left").withColumn("shared_chars", F.coalesce("shared_chars", F.lit(0)))
        return rows.groupBy("rec").agg(F.max("n_chars").alias("n_chars"), F.max("shared_chars").alias("shared_chars")).withColumn("shared_share", F.round(F.col("shared_chars") / F.col("n_chars"), 4))


def library_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(spark.read.parquet(f"{sf_dir}/paper_pages.parquet").select("paper_id", "page", "text"))
    citations = spark.read.parquet(f"{sf_dir}/citations.parquet")
    return pages.select(F.format_string("page:%s:%d", "paper_id", "page").alias("rec"), "paper_id", F.lit(True).alias("is_page"), "text").unionByName(
        citations.select(F.format_string("cite:%d", "citation_id").alias("rec"), "paper_id", F.lit(False).alias("is_page"), F.col("quote").alias("text"))
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SharedSpans(library_records(spark, sf_dir)).pairs()


def p3_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SharedSpans(library_records(spark, sf_dir)).coverage()
