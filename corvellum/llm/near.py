"""Near-duplicate records with small edits (problem 2).

Every record becomes a set of shingles, the set a SetSketch: m registers, each the
truncated, exponentially spaced minimum of one hash over the set.  Registers of equal
number are banded; sets that agree on a whole band become candidates.  The registers of
a candidate pair give a joint maximum-likelihood estimate of the similarity, pairs that
could reach the threshold are verified on their exact sets.

Records with one and the same set form a class and are sketched and compared once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from corvellum.llm.codes import U64, Words, char_grams, mix64, powers, slices
from corvellum.session import shared_folder, spread

#: Base of the registers' spacing, rate of the exponential law, and the largest register.
BASE, RATE, TOP = 1.01, 20.0, 4095


@dataclass(frozen=True)
class Plan:
    """How one kind of record is shingled and banded.

    A pair of similarity j shares a band with probability 1 - (1 - j**rows)**bands.
    """

    unit: str  # "word" or "char"
    size: int = 3
    threshold: float = 0.6
    rows: int = 5
    bands: int = 64

    @property
    def registers(self) -> int:
        return self.rows * self.bands


CHUNK = Plan("word")
TITLE = Plan("char", rows=6, bands=128)


def shingle_sets(texts: list[str], plan: Plan) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    for i, j in slices(texts):
        if plan.unit == "word":
            w = Words(texts[i:j])
            grams, at = w.grams(plan.size)
            owner = w.text_of()[at]
        else:
            grams, owner = char_grams([" ".join(t.lower().split()) for t in texts[i:j]], plan.size)
        cut = np.searchsorted(owner, np.arange(j - i + 1))
        for a, b in zip(cut[:-1], cut[1:]):
            yield np.unique(grams[a:b])


def class_of(shingles: np.ndarray, salt: int) -> int:
    """Order-free hash of a set; equal sets of one kind of record have equal classes."""
    total = np.sum(mix64(shingles ^ U64(0xA0761D6478BD642F)), dtype=U64) + U64(len(shingles)) + U64(salt << 48)
    return int(mix64(np.array([total]))[0].astype(np.int64))


def registers(shingles: np.ndarray, m: int) -> np.ndarray:
    """SetSketch registers; those of a union are the larger of each pair of registers.

    The minimum is taken over integers first, as the law is monotone: one logarithm a
    register instead of one an element.
    """
    seeds = mix64(np.arange(1, 2 * m + 1, dtype=U64))
    mul, add = (seeds[:m] | U64(1)).astype(np.uint32), seeds[m:].astype(np.uint32)
    low = np.full(m, 0xFFFFFFFF, np.uint32)
    x = (shingles >> U64(32)).astype(np.uint32)
    for k in range(0, len(x), 512):
        block = x[k : k + 512, None] * mul[None, :]
        block += add[None, :]
        np.minimum(low, block.min(axis=0), out=low)
    least = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(least) / np.log(BASE)), 0, TOP).astype(np.uint16)


def band_hashes(regs: np.ndarray, plan: Plan, salt: int) -> np.ndarray:
    rows = regs.reshape(plan.bands, plan.rows).astype(U64) + U64(1)
    h = (rows * powers(0xE7037ED1A0B428DB, plan.rows + 1)[1:]).sum(axis=1, dtype=U64)
    return mix64(h + np.arange(plan.bands, dtype=U64) * U64(0x8EBC6AF09C88C6E3) + U64(salt)).astype(np.int64)


def joint_estimate(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> float:
    """Most likely Jaccard similarity of two sets, given their registers and sizes."""
    greater, less = int((a > b).sum()), int((a < b).sum())
    equal = len(a) - greater - less
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    j = np.linspace(0, min(u / v, v / u), 201)
    law = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)
    p, q = law(u - v * j), law(v - u * j)
    fit = greater * np.log(p) + less * np.log(q) + equal * np.log(np.maximum(1 - p - q, 1e-12))
    return float(j[np.argmax(fit)])


def _classed(plans: dict[str, Plan], banded: bool) -> Callable:
    """Records to their class, and with it either their key or their band hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = np.asarray(batch.column("kind").to_pylist(), object)
            keys = batch.column("key").to_pylist()
            texts = batch.column("text").to_pylist()
            for salt, (kind, plan) in enumerate(sorted(plans.items())):
                rows = np.flatnonzero(kinds == kind)
                sets = [(i, x) for i, x in zip(rows, shingle_sets([texts[i] for i in rows], plan)) if len(x)]
                if not sets:
                    continue
                cls = pa.array([class_of(x, salt) for _, x in sets], pa.int64())
                if banded:
                    bands = np.concatenate([band_hashes(registers(x, plan.registers), plan, salt) for _, x in sets])
                    at = np.arange(0, len(bands) + 1, plan.bands, dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([cls, pa.ListArray.from_arrays(at, pa.array(bands))], ["cls", "bands"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * len(sets)), cls, pa.array([keys[i] for i, _ in sets])], ["kind", "cls", "key"])

    return run


def _verify(plans: dict[str, Plan]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = np.asarray(batch.column("kind").to_pylist(), object)
            ids = [batch.column(c).to_numpy() for c in ("cls_a", "cls_b")]
            sides = [batch.column(c).to_pylist() for c in ("text_a", "text_b")]
            for salt, (kind, plan) in enumerate(sorted(plans.items())):
                rows = np.flatnonzero(kinds == kind)
                # A class occurs in many pairs, once a batch is enough; where rows of a key
                # differ, only the text that makes this class counts.
                new = list({(ids[side][i], sides[side][i]) for side in (0, 1) for i in rows})
                sets = {c: (s, registers(s, plan.registers)) for (c, _), s in zip(new, shingle_sets([t for _, t in new], plan)) if class_of(s, salt) == c}
                slack = 5 * np.sqrt(plan.threshold * (1 - plan.threshold) / plan.registers)
                out = []
                for i in rows:
                    if ids[0][i] not in sets or ids[1][i] not in sets:
                        continue
                    (s, x), (t, y) = sets[ids[0][i]], sets[ids[1][i]]
                    if min(len(s), len(t)) < plan.threshold * max(len(s), len(t)) or joint_estimate(x, y, len(s), len(t)) < plan.threshold - slack:
                        continue
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    if both >= plan.threshold * (len(s) + len(t) - both):
                        out.append((int(ids[0][i]), int(ids[1][i]), both / (len(s) + len(t) - both)))
                if out:
                    a, b, j = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(j, pa.float64())], ["cls_a", "cls_b", "jaccard"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(cls, root) of every end of edges(cls_a, cls_b), an edge of one end being none: the
    least end that it is connected with.

    Large and small stars in turn: every end goes to the least neighbour of its lower ones,
    then to the least of its own.  Rounds grow with the logarithm of the ends, not with the
    length of a chain; each is checkpointed, and nothing but one row reaches the driver.
    """
    lower = edges.where("cls_a != cls_b").select(F.greatest("cls_a", "cls_b").alias("u"), F.least("cls_a", "cls_b").alias("v")).distinct().checkpoint()
    while True:
        several = lower.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
        if several.unionByName(lower.join(lower.select(F.col("v").alias("u")), "u", "left_semi").select("u")).isEmpty():
            roots = lower.select(F.col("v").alias("cls"), F.col("v").alias("root")).distinct()
            return lower.select(F.col("u").alias("cls"), F.col("v").alias("root")).unionByName(roots)
        both = lower.unionByName(lower.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
        large = lower.join(least, "v").select("u", F.col("m").alias("v")).distinct().checkpoint()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        lower = small.where("u != v").distinct().checkpoint()


class NearDuplicates:
    """Groups records(kind, key, text) whose shingle sets reach the plan's threshold.

    Defined results: a NULL kind, key or text and a text with fewer units than a shingle
    take no part; repeated rows of a key count once, and if their texts differ the key
    belongs to the class of each; extra columns are ignored.  Exact copies form one class,
    so a group of copies costs one sketch and no pairs until pairs() is asked to name them.
    A band shared by very many classes is joined by sorting and, if skewed, split by
    adaptive execution; no bucket is gathered into a task and none is capped.
    """

    def __init__(self, records: DataFrame, plans: dict[str, Plan]):
        self.plans = plans
        self.records = records.select("kind", "key", "text").where(
            F.col("kind").isin(*plans) & F.col("key").isNotNull() & F.col("text").isNotNull()
        )
        shared_folder(records.sparkSession)  # candidate pairs are checkpointed there
        self.members = self.records.mapInArrow(_classed(plans, False), "kind string, cls bigint, key string").persist(StorageLevel.DISK_ONLY)

    def candidates(self) -> DataFrame:
        """Pairs of classes that share a band."""
        rows = self.records.mapInArrow(_classed(self.plans, True), "cls bigint, bands array<bigint>").select("cls", F.explode("bands").alias("band"))
        rows = rows.repartition("band").dropDuplicates(["band", "cls"])
        a, b = (rows.select("band", F.col("cls").alias(f"cls_{s}")) for s in "ab")
        return a.join(b, "band").where("cls_a < cls_b").select("cls_a", "cls_b").distinct()

    def links(self) -> DataFrame:
        """(cls_a, cls_b, jaccard) of all pairs of different classes over the threshold."""
        pairs = self.candidates().checkpoint()
        used = pairs.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).distinct()
        keys = self.members.join(used, "cls", "left_semi").groupBy("kind", "cls").agg(F.min("key").alias("key"))
        texts = self.records.join(keys, ["kind", "key"]).select("kind", "cls", "text").distinct()
        a = texts.select("kind", F.col("cls").alias("cls_a"), F.col("text").alias("text_a"))
        b = texts.select(F.col("cls").alias("cls_b"), F.col("text").alias("text_b"))
        return pairs.join(a, "cls_a").join(b, "cls_b").mapInArrow(_verify(self.plans), "cls_a bigint, cls_b bigint, jaccard double").distinct()

    def pairs(self, links: DataFrame | None = None) -> DataFrame:
        """(item_kind, key_a, key_b) of all linked records, key_a < key_b, copies included."""
        links = self.links() if links is None else links
        same = self.members.groupBy("cls").agg(F.count("*").alias("n")).where("n > 1").select(F.col("cls").alias("cls_a"), F.col("cls").alias("cls_b"))
        a = self.members.select("kind", F.col("cls").alias("cls_a"), F.col("key").alias("ka"))
        b = self.members.select(F.col("cls").alias("cls_b"), F.col("key").alias("kb"))
        both = links.select("cls_a", "cls_b").unionByName(same).join(a, "cls_a").join(b, "cls_b")
        return both.where("ka != kb").select(F.col("kind").alias("item_kind"), F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b")).distinct()

    def groups(self, links: DataFrame) -> DataFrame:
        """(cls, root) of every class that is linked, or shares a key whose texts differ."""
        keyed = self.members.groupBy("kind", "key").agg(F.min("cls").alias("cls_a"), F.max("cls").alias("cls_b")).where("cls_a != cls_b").select("kind", "key", "cls_a")
        shared = self.members.join(keyed, ["kind", "key"]).select("cls_a", F.col("cls").alias("cls_b"))
        return components(links.select("cls_a", "cls_b").unionByName(shared))

    def membership(self) -> DataFrame:
        """One row a record: its class, the class's number of records and of linked classes,
        and its group.  Records have one group_id exactly if pairs() connects them."""
        links = self.links().checkpoint()
        ends = links.select(F.explode(F.array("cls_a", "cls_b")).alias("cls"))
        degree = ends.groupBy("cls").agg(F.count("*").alias("n_links"))
        members = self.members.distinct()
        size = members.groupBy("cls").agg(F.count("*").alias("n_copies"))
        return (
            members.join(size, "cls")
            .join(degree, "cls", "left")
            .join(self.groups(links), "cls", "left")
            .select(F.col("kind").alias("item_kind"), F.col("key").alias("item_key"), F.hex("cls").alias("class_id"), "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.hex(F.coalesce("root", "cls")).alias("group_id"))
        )


def library_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk texts and paper titles as records."""
    chunks = spark.read.parquet(f"{sf_dir}/chunks.parquet")
    papers = spark.read.parquet(f"{sf_dir}/papers.parquet")

    def shaped(df: DataFrame, kind: str, key: Column, text: Column) -> DataFrame:
        return spread(df.select(key.alias("key"), text.alias("text"))).select(F.lit(kind).alias("kind"), "key", "text")

    return shaped(chunks, "chunk", F.col("chunk_id"), F.col("text")).unionByName(shaped(papers, "title", F.col("paper_id"), F.col("title")))


def near_duplicates(spark: SparkSession, sf_dir: str) -> NearDuplicates:
    return NearDuplicates(library_records(spark, sf_dir), {"chunk": CHUNK, "title": TITLE})


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, sf_dir).pairs()


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, sf_dir).membership()
