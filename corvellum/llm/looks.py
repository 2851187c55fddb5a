"""Visually identical text with different characters (problem 4).

Arrow's text is copied to numpy arrays of code points.  One gather through a table that is
built from the Unicode database replaces every character by what it looks like: nothing for
invisible ones, several letters for a ligature, base letter and marks for an accented one,
the ordinary form for another width, the Latin letter for a look-alike.  Marks are then put
in canonical order and composed pair by pair, for all texts of a batch at once.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvellum.llm.codes import U64, code_points, prefix_hash, seeds, slices
from corvellum.session import spread

# Letters of Greek and Cyrillic, and the Latin letters of the same shape.
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρυχκ"
GREEK_AS = "ABEZHIKMNOPTYXovpuxk"
CYRILLIC = "АВЕЅІЈКМНОРСТУХЬԌԚԜаеорсухѕіјһԁԛԝӏґ"
CYRILLIC_AS = "ABESIJKMHOPCTYXbGQWaeopcyxsijhdqwlr"
# Marks and fillers without a shape of their own.
SHAPELESS = "͏ᅟᅠ឴឵᠋᠌᠍ㅤﾠ"

#: Seeds of a quote: characters of a gram, and grams in a run; shorter quotes take the next.
LEVELS = ((16, 16), (8, 5))


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """How many characters each code point becomes, where they begin, and all of them;
    the combining classes; the composable pairs, sorted, and what they compose to."""
    twins = dict(zip(GREEK + CYRILLIC, GREEK_AS + CYRILLIC_AS))

    @lru_cache(None)
    def shape(c: str) -> str:
        kind, how = unicodedata.category(c), unicodedata.decomposition(c)
        if kind == "Zs":
            return " "
        if kind == "Cf" or c in SHAPELESS or "︀" <= c <= "️" or kind == "Cc" and not c.isspace():
            return ""
        if c in twins:
            return twins[c]
        if not how or "가" <= c <= "힣":
            return c
        tag, *rest = how.split() if how[0] == "<" else ("", *how.split())
        if tag in ("", "<wide>", "<narrow>") or tag == "<compat>" and "LIGATURE" in unicodedata.name(c, ""):
            return "".join(shape(chr(int(x, 16))) for x in rest)
        return c

    count = np.ones(0x110000, np.int8)
    begin = np.arange(0x110000, dtype=np.int64)
    extra: list[int] = []
    classes = np.zeros(0x110000, np.uint8)
    pairs: dict[int, int] = {}
    for i in [*range(0x32000), *range(0xE0000, 0xE0200)]:
        if 0xD800 <= i < 0xE000:
            continue
        c = chr(i)
        classes[i] = unicodedata.combining(c)
        if (s := shape(c)) != c:
            count[i], begin[i] = len(s), 0x110000 + len(extra)
            extra += map(ord, s)
        how = unicodedata.decomposition(c)
        if how and how[0] != "<" and " " in how and unicodedata.normalize("NFC", c) == c:
            a, b = (int(x, 16) for x in how.split())
            pairs[a << 21 | b] = i
    flat = np.concatenate([np.arange(0x110000), np.array(extra, np.int64)])
    keys = np.array(sorted(pairs), np.int64)
    return count, begin, flat, classes, keys, np.array([pairs[k] for k in keys], np.int64)


def unify(cp: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of several texts in their one form; the text, and the place, each is of."""
    count, begin, flat, classes, keys, values = tables()
    n = count[cp].astype(np.int64)
    source = np.repeat(np.arange(len(cp)), n)
    step = np.arange(len(source)) - np.repeat(np.cumsum(n) - n, n)
    out = flat[begin[cp[source]] + step]
    rank = classes[out]
    if rank.any():
        same = owner[source]
        wrong = (rank[1:] > 0) & (rank[:-1] > rank[1:]) & (same[1:] == same[:-1])
        if wrong.any():  # marks behind one letter go by their class
            run = np.cumsum(rank == 0)
            order = np.lexsort((np.arange(len(out)), rank, run, same))
            out, source, rank = out[order], source[order], rank[order]
        # A mark joins its letter unless one of its own class or higher stands between.
        at = np.flatnonzero(rank > 0)
        gone = np.zeros(len(out), bool)
        letter = np.maximum.accumulate(np.where(rank == 0, np.arange(len(out)), -1))[at]
        kept = {}
        texts = owner[source]
        depth = at - letter
        for d in range(1, int(depth.max()) + 1):
            now = np.flatnonzero((depth == d) & (letter >= 0))
            mark, base = at[now], letter[now]
            fine = texts[mark] == texts[base]
            blocked = np.array([kept.get(b, 0) >= r for b, r in zip(base.tolist(), rank[mark].tolist())], bool) if kept else np.zeros(len(now), bool)
            key = out[base] << 21 | out[mark]
            k = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = (keys[k] == key) & fine & ~blocked
            out[base[hit]] = values[k[hit]]
            gone[mark[hit]] = True
            kept |= dict(zip(base[~hit].tolist(), rank[mark[~hit]].tolist()))
        out, source = out[~gone], source[~gone]
    return out, owner[source], source


def unify_texts(texts: list[str]) -> list[str]:
    """Each text in its one form."""
    result: list[str] = []
    for i, j in slices(texts):
        length = np.fromiter(map(len, texts[i:j]), np.int64, j - i)
        out, owner, _ = unify(code_points("".join(texts[i:j])), np.repeat(np.arange(j - i), length))
        whole = out.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
        cut = np.searchsorted(owner, np.arange(j - i + 1))
        result += [whole[a:b] for a, b in zip(cut[:-1], cut[1:])]
    return result


def _forms(level: int | None, text: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = unify_texts(batch.column(text).to_pylist())
            columns = {name: batch.column(name) for name in batch.schema.names}
            if level is None:
                columns["form"] = pa.array(forms, pa.string())
            else:
                gram, width = LEVELS[level]
                found = []
                for i, j in slices(forms):
                    prefix, at = prefix_hash(code_points("".join(forms[i:j]))), 0
                    for f in forms[i:j]:
                        found.append(seeds(prefix, at, at + len(f), gram, width).astype(np.int64))
                        at += len(f)
                columns.pop(text)
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                columns["seeds"] = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*found, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_pydict(columns)

    return run


def with_form(df: DataFrame, text: str) -> DataFrame:
    """df and a column form: its text in one form, in which texts that look alike are equal.

    Width of letters, digits, signs and blanks, invisible characters, ligatures, composition
    of accents and look-alike letters of Greek and Cyrillic make no difference; case, accents,
    line breaks and compatibility characters of another look (superscripts) do.  Rows whose
    text is NULL are left out; a text of invisible characters only has the empty form; a column
    of the name form is replaced.
    """
    df = df.drop("form")
    kinds = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return df.where(F.col(text).isNotNull()).mapInArrow(_forms(None, text), f"{kinds}, form string")


def _seeded(df: DataFrame, level: int, text: str) -> DataFrame:
    kinds = ", ".join(f"`{n}` {t}" for n, t in df.dtypes if n != text)
    rows = df.mapInArrow(_forms(level, text), f"{kinds}, seeds array<bigint>")
    return rows.select(*[n for n in df.columns if n not in (text, "paper_id")], F.explode("seeds").alias("seed"), "paper_id").withColumn("seed", F.xxhash64("paper_id", "seed"))


def quote_places(citations: DataFrame, pages: DataFrame) -> DataFrame:
    """Where citations(citation_id, paper_id, quote) look the same as a passage of a page
    of pages(paper_id, page, text): (citation_id, page, is_exact).

    A quote is looked up by the rarest of its seeds among its paper's pages, and verified on
    the pages that hold it, so common phrases and large papers cost no more than others.
    Quotes too short for seeds are compared with the pages of their paper directly.
    Defined results: NULL and blank quotes and NULL texts have no place; equal quotes of a
    paper are searched once; repeated rows of pages or citations change nothing; quotes
    across a page end aren't found; other columns are ignored.
    """
    pages = pages.select("paper_id", "page", "text").where("text is not null and paper_id is not null")
    quotes = citations.select("citation_id", "paper_id", "quote").where("quote is not null and paper_id is not null").distinct()
    quotes = quotes.withColumn("q", F.xxhash64("paper_id", "quote"))
    forms = with_form(quotes.groupBy("q", "paper_id", "quote").agg(F.count("*").alias("n")), "quote").where(F.length(F.trim("form")) > 0)
    size = F.length("form")
    lower = [a + b - 1 for a, b in LEVELS]
    level = F.when(size >= lower[0], 0).when(size >= lower[1], 1).otherwise(2)
    forms = forms.withColumn("level", level)
    found = forms.where("level = 2").select("q", "paper_id").join(pages.select("paper_id", "page"), "paper_id").select("q", "page")
    for k in range(len(LEVELS)):
        some = forms.where(F.col("level") == k)
        wanted = _seeded(some.select("q", "paper_id", F.col("form").alias("text")), k, "text").select("q", "seed").repartition("seed")
        papers = some.select("paper_id").distinct()
        there = _seeded(pages.join(papers, "paper_id", "left_semi"), k, "text").select("seed", "page").where("page is not null").repartition("seed")
        spread = there.groupBy("seed").agg(F.count("page").alias("n_pages"))  # of page, so both uses share one exchange
        rarest = wanted.join(spread, "seed", "left").groupBy("q").agg(F.min(F.coalesce("n_pages", F.lit(0))).alias("least"), F.min_by("seed", "n_pages").alias("seed")).where("least > 0").select("q", "seed")
        found = found.unionByName(rarest.join(there, "seed").select("q", "page"))
    asked = found.distinct().join(forms.select("q", "paper_id", "quote", F.col("form").alias("quote_form")), "q")
    seen = asked.join(with_form(pages, "text"), ["paper_id", "page"]).where(F.contains("form", "quote_form"))
    places = seen.groupBy("q", "page").agg(F.max(F.contains("text", "quote")).alias("is_exact"))
    return quotes.select("citation_id", "q").join(places, "q").select("citation_id", "page", "is_exact").distinct()


def p4_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page on which a quote is found again, and whether character by character."""
    pages = spread(spark.read.parquet(f"{sf_dir}/paper_pages.parquet").select("paper_id", "page", "text"))
    return quote_places(spark.read.parquet(f"{sf_dir}/citations.parquet"), pages)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations found by their look on a page, but on none character by character."""
    return p4_places(spark, sf_dir).groupBy("citation_id").agg(F.max("is_exact").alias("exact")).where("not exact").select("citation_id")
