"""Verification of quotes against the pages of the paper they are said to come from.

Quotes and pages are folded (quotes, dashes, case, compatibility forms, white space).  A
paper's source is all its folded pages joined by blanks, so a quote may run over any number of
page ends.  The source is never put together: a page gets the place where it begins in the
source, and the text is dealt into cells of one size, whatever the size of pages and papers.

Exact places come from the rarest of a quote's seeds in its paper, verified on the text.  A
quote that stands nowhere is looked up by pieces of which a similarity of 95 leaves at least
one whole, and aligned where enough of its pieces stand.  No page, word or pair is capped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvellum.functions import text as T
from corvellum.functions.folding import fold, fold_many
from corvellum.functions.rolling import U64, mix64, placed_seeds, slices
from corvellum.session import cleaned, kept, tasks

FUZZY = 95.0
#: Characters of a cell, and how many of the next cell's it repeats for seeds over its end.
CELL, OVER = 2048, 32
#: Pages whose places are summed up at once.
PAGES_SUMMED = 1024
#: Seeds of a quote: characters of a gram, and grams in a run.  Quotes too short for the last
#: are looked up whole.
LEVELS = ((16, 16), (8, 5))
#: Characters of the pieces by which fuzzy matches are looked up, and of those by which passages
#: are told before they are aligned.
PIECE, TELLING = 5, (5, 4)
#: Pieces that have to stand near each other where a similarity of FUZZY leaves as many whole.
HITS = 8
#: Characters of the source and blocks of a paper that are searched for fuzzy matches at once;
#: of a paper of more characters than both allow the blocks are longer.
BLOCK, BLOCKS = 1 << 20, 256
#: Places of pieces that are held at once; those of one quote stay together.
PLACES = 500_000
#: Bits of the map of wanted hashes that goes to every task; its size never depends on data.
MAP_BITS = 25


# --- the source as cells ------------------------------------------------------------------


def placed_pages(pages: DataFrame) -> DataFrame:
    """(paper_id, page, form, n, at): pages(paper_id, page, text), one row a page, folded, with
    the place where each begins in its paper's source; empty pages are left out.

    Places are summed within blocks of pages and then over blocks, so that no task sees all
    pages of a paper, and no text passes through a window.
    """
    forms = pages.where("text is not null and paper_id is not null and page is not null").select("paper_id", "page", fold("text").alias("form")).where("form != ''")
    forms = kept(forms.withColumn("n", F.length("form")))
    block = F.floor(F.col("page") / PAGES_SUMMED).alias("block")
    sizes = forms.select("paper_id", "page", block, (F.col("n") + 1).cast("bigint").alias("room"))
    before = lambda keys, order, c: F.coalesce(F.sum(c).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = sizes.withColumn("within", before(["paper_id", "block"], "page", "room"))
    blocks = sizes.groupBy("paper_id", "block").agg(F.sum("room").alias("room")).select("paper_id", "block", before(["paper_id"], "block", "room").alias("before"))
    places = within.join(blocks, ["paper_id", "block"]).select("paper_id", "page", (F.col("within") + F.col("before")).alias("at"))
    return forms.join(places, ["paper_id", "page"])


def source_cells(placed: DataFrame) -> DataFrame:
    """(paper_id, cell, text): the sources in cells of CELL characters, each followed by the
    first OVER characters of the next."""
    start, end = F.col("at"), F.col("at") + F.col("n") + 1  # with the blank behind the page
    first = F.greatest(F.lit(0), F.floor((start - OVER) / CELL))
    parts = placed.select("paper_id", "at", F.concat("form", F.lit(" ")).alias("form"), F.explode(F.sequence(first, F.floor((end - 1) / CELL))).alias("cell"))
    low = F.greatest(F.lit(0), F.col("cell") * CELL - F.col("at"))
    high = F.col("cell") * CELL + CELL + OVER - F.col("at")
    part = F.substring("form", (low + 1).cast("int"), (high - low).cast("int"))
    rows = parts.select("paper_id", "cell", F.struct("at", part.alias("part")).alias("x")).where("x.part != ''")
    # A cell has at most as many parts as characters.
    return rows.repartition(tasks(placed.sparkSession), "paper_id", "cell").groupBy("paper_id", "cell").agg(F.array_join(F.array_sort(F.collect_list("x")).getField("part"), "").alias("text"))


# --- looking hashes up ----------------------------------------------------------------------


def wanted_map(hashes: DataFrame, bits: int = MAP_BITS) -> np.ndarray:
    """A map of 2**bits bits in which those of all hashes(h) are set.

    Its words, at most 2**(bits - 6), are made by an aggregate; it only spares tasks rows that
    nobody asks for, and lets more of them pass the more hashes there are.
    """
    slot = F.pmod("h", F.lit(1 << bits))
    with cleaned(hashes.sparkSession):
        words = hashes.select(F.floor(slot / 64).cast("int").alias("word"), F.expr(f"shiftleft(1L, CAST(pmod(pmod(h, {1 << bits}), 64) AS INT))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    found = np.zeros(1 << (bits - 6), np.int64)
    found[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return found


def is_wanted(found: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = h.astype(U64) & U64(len(found) * 64 - 1)
    return (found[slot >> U64(6)].view(U64) >> (slot & U64(63))) & U64(1) == 1


def _hashed(value: np.ndarray, paper: np.ndarray, gram: int, width: int) -> np.ndarray:
    return mix64(value ^ paper.view(U64) ^ U64(gram << 56 | width << 48)).view(np.int64)


def _in_cells(kinds: list[tuple[int, int]], wanted) -> Callable:
    """Wanted seeds of cells: (h, at), their places in the source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = wanted.value
        for batch in batches:
            texts, paper, cell = batch.column("text").to_pylist(), batch.column("paper").to_numpy(), batch.column("cell").to_numpy()
            for i, j in slices(texts):
                for gram, width in kinds:
                    value, owner, at = placed_seeds(texts[i:j], gram, width)
                    h = _hashed(value, paper[i + owner], gram, width)
                    hit = np.flatnonzero(is_wanted(found, h))
                    yield pa.RecordBatch.from_arrays([pa.array(h[hit]), pa.array(cell[i + owner[hit]] * CELL + at[hit])], ["h", "at"])

    return run


def _in_quotes(level_of: Callable[[np.ndarray], list[tuple[np.ndarray, int, int, int]]]) -> Callable:
    """Seeds of quotes: (q, h, start), their places in the quote."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms, paper, q = batch.column("form").to_pylist(), batch.column("paper").to_numpy(), batch.column("q")
            size = np.fromiter(map(len, forms), np.int64, len(forms))
            for rows, gram, width, every in level_of(size):
                if len(rows):
                    value, owner, start = placed_seeds([forms[i] for i in rows], gram, width)
                    kept = start % every == 0
                    value, owner, start = value[kept], rows[owner[kept]], start[kept]
                    yield pa.RecordBatch.from_arrays([q.take(pa.array(owner)), pa.array(_hashed(value, paper[owner], gram, width)), pa.array(start)], ["q", "h", "start"])

    return run


def _exact_levels(size: np.ndarray) -> list[tuple[np.ndarray, int, int, int]]:
    least = [a + b - 1 for a, b in LEVELS]
    level = np.select([size >= n for n in least], range(len(LEVELS)), len(LEVELS))
    found = [(np.flatnonzero(level == k), *LEVELS[k], 1) for k in range(len(LEVELS))]
    return found + [(np.flatnonzero(size == n), n, 1, 1) for n in range(1, least[-1])]


def _edits(size):
    """Insertions and deletions that a similarity of FUZZY leaves room for."""
    return (size * (1 - FUZZY / 100) * 2 + 1e-6) // 1


SEEDS = "q bigint, h bigint, start bigint"


def _looked_up(seeds: DataFrame, cells: DataFrame, kinds: list[tuple[int, int]]) -> DataFrame:
    """(h, at) of the seeds' hashes in the cells."""
    sent = cells.sparkSession.sparkContext.broadcast(wanted_map(seeds.select("h")))  # of a fixed size
    return cells.select(F.xxhash64("paper_id").alias("paper"), "cell", "text").mapInArrow(_in_cells(kinds, sent), "h bigint, at bigint")


def _windows(rows: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """rows(paper_id, low, high) with the source between as a column window.

    As many cells as the window has, which is in proportion to its quote.
    """
    asked = rows.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / CELL), F.floor((F.col("high") - 1) / CELL))))
    base = F.col("cell") * CELL
    low, high = F.greatest(F.col("low") - base, F.lit(0)), F.least(F.col("high") - base, F.lit(CELL))
    part = F.substring("text", (low + 1).cast("int"), (high - low).cast("int"))
    parts = asked.join(cells, ["paper_id", "cell"]).select("paper_id", "low", "high", *keys, F.struct("cell", part.alias("part")).alias("x"))
    return parts.groupBy("paper_id", "low", "high", *keys).agg(F.array_join(F.array_sort(F.collect_list("x")).getField("part"), "").alias("window"))


# --- exact places ---------------------------------------------------------------------------


class QuoteSearch:
    """Looks quotes(paper_id, quote) up in the sources of pages(paper_id, page, text).

    Defined results: NULL papers and NULL or blank quotes or texts have no place; equal quotes
    of a paper are searched once; pages have one row each (see tables.latest); other columns
    are ignored.
    """

    def __init__(self, quotes: DataFrame, pages: DataFrame):
        self.pages = pages.select("paper_id", "page", "text")
        asked = quotes.where("paper_id is not null and quote is not null").select("paper_id", "quote").distinct().repartition(tasks(quotes.sparkSession), "quote")
        asked = asked.select(F.xxhash64("paper_id", "quote").alias("q"), "paper_id", F.xxhash64("paper_id").alias("paper"), fold("quote").alias("form")).where("form != ''")
        self.asked = kept(asked.withColumn("m", F.length("form").cast("bigint")))
        self.placed = placed_pages(pages)
        self.cells = kept(source_cells(self.placed))

    def exact(self) -> DataFrame:
        """(q, paper_id, position): every place in the source where a quote stands."""
        seeds = self.asked.select("q", "paper", "form").mapInArrow(_in_quotes(_exact_levels), SEEDS)
        least = [a + b - 1 for a, b in LEVELS]
        sizes = [int(r.m) for r in self.asked.select(F.least("m", F.lit(least[0])).alias("m")).distinct().collect()]  # some dozen
        kinds = {next((kind for kind, n in zip(LEVELS, least) if m >= n), (m, 1)) for m in sizes}  # only what is asked for
        # The filter is what Spark would add to one of both uses, which then shared no exchange.
        hits = _looked_up(seeds, self.cells, sorted(kinds)).where("h is not null and at is not null").repartition("h").distinct()
        counts = hits.groupBy("h").agg(F.count("at").alias("n"))  # of at, so both uses share one exchange
        rarest = seeds.join(counts, "h").groupBy("q").agg(F.min_by(F.struct("h", "start"), F.struct("n", "h", "start")).alias("x")).select("q", "x.*")
        asked = self.asked.select("q", "paper_id", "m", "form")
        maybe = kept(rarest.join(hits, "h").select("q", (F.col("at") - F.col("start")).alias("low")).where("low >= 0"))  # so that hits leave the disk before texts come
        maybe = maybe.join(asked, "q").withColumn("high", F.col("low") + F.col("m"))
        stands = _windows(maybe.select("q", "paper_id", "low", "high"), self.cells, ["q"]).join(asked.select("q", "form"), "q").where("window = form")
        return stands.select("q", "paper_id", F.col("low").alias("position"))

    # --- fuzzy places -----------------------------------------------------------------------

    def fuzzy(self, found: DataFrame) -> DataFrame:
        """(q, paper_id, position, score) of the best alignment, of at least FUZZY, of each
        quote that isn't found; of equal ones the first."""
        left = kept(self.asked.join(found.select("q").distinct(), "q", "left_anti"))
        sizes = kept(self.placed.groupBy("paper_id").agg((F.max(F.col("at") + F.col("n"))).alias("total")))
        left = left.join(sizes, "paper_id").select("q", "paper_id", "form", "total")
        # A paper's cells and quotes meet in units: papers up to a block share one, longer ones
        # have one a block, each with as much of the next as their longest quote may reach into.
        longest = left.groupBy("paper_id").agg(F.max(F.length("form")).alias("longest"))
        span = F.greatest(F.lit(BLOCK // CELL), F.ceil(F.col("total") / (CELL * BLOCKS)))
        parted = F.broadcast(sizes.where(F.col("total") > BLOCK).join(longest, "paper_id", "left").select("paper_id", span.alias("span"), F.ceil(F.coalesce("longest", F.lit(0)) * 2 / CELL).alias("reach")))  # a row a BLOCK of text at most
        units = (sizes.agg(F.sum("total").alias("n")).first().n or 0) // BLOCK + tasks(left.sparkSession)
        unit = F.when(F.col("span").isNull(), F.pmod(F.xxhash64("paper_id"), F.lit(units))).otherwise(F.xxhash64("paper_id")).alias("unit")
        one, count = F.array(F.lit(0).cast("bigint")), tasks(left.sparkSession) * 4
        blocks = lambda low, high: F.explode(F.when(F.col("span").isNull(), one).otherwise(F.sequence(F.floor(low / F.col("span")), F.floor(high / F.col("span"))))).alias("block")
        cells = self.cells.join(parted, "paper_id", "left").select(unit, blocks(F.greatest(F.col("cell") - F.col("reach"), F.lit(0)), F.col("cell")), "paper_id", "cell", "text")
        asked = left.join(parted, "paper_id", "left").select(unit, blocks(F.lit(0), F.floor((F.col("total") - 1) / CELL)), "q", "paper_id", "form", "total")
        met = cells.repartition(count, "unit", "block").groupBy("unit", "block").cogroup(asked.repartition(count, "unit", "block").groupBy("unit", "block"))
        scored = met.applyInArrow(_nearest, "q bigint, paper_id string, position bigint, score double")
        best = F.max_by(F.struct("paper_id", "position", "score"), F.struct("score", -F.col("position")))
        return scored.groupBy("q").agg(best.alias("x")).select("q", "x.*")

    def located(self, found: DataFrame) -> DataFrame:
        """found(q, paper_id, position, ...) with the page a position of the source lies on and
        the place in the page's own text; the blank before a page counts as its first place."""
        span = F.sequence(F.floor(F.greatest(F.col("at") - 1, F.lit(0)) / CELL), F.floor((F.col("at") + F.col("n") - 1) / CELL))
        spans = self.placed.select("paper_id", "page", "at", "n", F.explode(span).alias("cell"))
        on = found.withColumn("cell", F.floor(F.col("position") / CELL)).join(spans, ["paper_id", "cell"]).where("position >= at - 1 and position < at + n")
        local = on.drop("cell", "n").withColumn("local", F.greatest(F.col("position") - F.col("at"), F.lit(0)).cast("int")).drop("at")
        kinds = ", ".join(f"`{n}` {t}" for n, t in local.dtypes if n != "local")
        return local.join(self.pages, ["paper_id", "page"]).select(*local.columns, "text").mapInArrow(_placed_back, f"{kinds}, char_offset int")


def _placed_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").dictionary_encode()
        _, places = fold_many(texts.dictionary.to_pylist())
        at = [int(places[t][k]) for t, k in zip(texts.indices.to_pylist(), batch.column("local").to_pylist())]
        names = [n for n in batch.schema.names if n not in ("text", "local")]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(at, pa.int32())], [*names, "char_offset"])


def _nearest(cells: pa.Table, quotes: pa.Table) -> pa.Table:
    """(q, paper_id, position, score): the best alignment of each of a unit's quotes with the
    source its cells hold, if it is FUZZY at least; of equal ones the first."""
    best: dict[int, tuple[float, int]] = {}
    papers = {p: k for k, p in enumerate(quotes.column("paper_id").unique().to_pylist())}
    held = sorted((papers[p], cell, text) for p, cell, text in zip(*(cells.column(c).to_pylist() for c in ("paper_id", "cell", "text"))) if p in papers)
    paper, cell, texts = (list(x) for x in zip(*held)) if held else ([], [], [])
    bases, parts = {}, {}
    for k, c, text in zip(paper, cell, texts):
        bases.setdefault(k, c * CELL)
        parts.setdefault(k, []).append(text[:CELL])
    sources = {k: "".join(x) for k, x in parts.items()}
    forms, of, total = quotes.column("form").to_pylist(), [papers[p] for p in quotes.column("paper_id").to_pylist()], quotes.column("total").to_pylist()

    def align(i: int, low: int, high: int) -> None:
        low, high, base = max(low, 0), min(high, total[i]), bases[of[i]]
        if low < base or high > base + len(sources[of[i]]) or low >= high:
            return  # in another block, which holds all of it
        window = sources[of[i]][low - base : high - base]
        if len(forms[i]) <= total[i] and not _alike(forms[i], window):
            return
        score, at = partial_ratio(forms[i], window, opens=low == 0, ends=high == total[i])
        if score >= FUZZY:
            best[i] = max(best.get(i, (0.0, 0)), (score, -low - at))

    for i, k in enumerate(of):
        if total[i] < len(forms[i]) and k in bases:  # a shorter source is itself what is looked for
            align(i, 0, total[i])
    for i, low, high in _near_places(forms, of, total, texts, paper, cell):
        align(i, low, high)
    rows = sorted(best)
    score, position = (pa.array([best[i][0] for i in rows], pa.float64()), pa.array([-best[i][1] for i in rows], pa.int64()))
    take = pa.array(rows, pa.int64())
    return pa.table({"q": quotes.column("q").take(take), "paper_id": quotes.column("paper_id").take(take), "position": position, "score": score})


def _alike(form: str, window: str) -> bool:
    """Whether as many pieces of the quote stand in the window as a similarity of FUZZY leaves."""
    most = int(_edits(len(form)))
    for size in TELLING:
        lost = 0
        for i in range(0, len(form) - size + 1, size):
            if form[i : i + size] not in window:
                lost += 1
                if lost > most:
                    return False
    return True


def _near_places(forms: list[str], of: list[int], total: list[int], texts: list[str], paper: list[int], cell: list[int]) -> Iterator[tuple[int, int, int]]:
    """(number of a form, low, high): the passages of the forms' sources, given as cells, in
    which as many of their pieces stand as a similarity of FUZZY must leave whole."""
    size, of, total = np.fromiter(map(len, forms), np.int64, len(forms)), np.array(of, np.int64), np.array(total, np.int64)
    edits = _edits(size).astype(np.int64)
    paper, cell = np.array(paper, np.int64), np.array(cell, np.int64)
    rows = np.flatnonzero(edits > 0)
    if not len(rows) or not texts:
        return
    value, owner, start = placed_seeds([forms[i] for i in rows], PIECE, 1)
    apart = start % PIECE == 0
    start, owner = start[apart], rows[owner[apart]]
    h = _hashed(value[apart], of[owner], PIECE, 1)
    wanted = np.zeros(1 << 16, np.int64)
    np.bitwise_or.at(wanted, (h.astype(U64) & U64((1 << 22) - 1)) >> U64(6), (U64(1) << (h.astype(U64) & U64(63))).view(np.int64))
    found = []
    for i, j in slices(texts):
        value, k, at = placed_seeds(texts[i:j], PIECE, 1)
        g = _hashed(value, paper[i + k], PIECE, 1)
        hit = np.flatnonzero((at < CELL) & is_wanted(wanted, g))
        found.append((g[hit], cell[i + k[hit]] * CELL + at[hit]))
    g, place = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(g, kind="stable")
    g, place = g[order], place[order]
    first = np.searchsorted(g, h)
    count = np.searchsorted(g, h, "right") - first
    # Of pieces some more than there may be edits are enough: those that stand here least.
    order = np.lexsort((count, owner))
    start, owner, first, count = start[order], owner[order], first[order], count[order]
    rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
    least = np.minimum(size // PIECE - edits, HITS)  # at the ends of a source
    use = np.flatnonzero(rank < (edits + least)[owner])
    start, owner, first, count = start[use], owner[use], first[use], count[use]
    # Elsewhere passages are as long as the quote, so half of the edits are insertions.
    inner = least + edits - 2 * np.floor(size * (1 - FUZZY / 100) + 1e-6).astype(np.int64)
    ends = np.flatnonzero(np.diff(owner, append=-1)) + 1  # of quotes
    ends = ends[np.flatnonzero(np.diff(np.cumsum(count)[ends - 1] // PLACES, append=-1))]
    for begin, end in zip([0, *ends[:-1]], ends):
        n = count[begin:end]
        who = np.repeat(owner[begin:end], n)
        at = place[np.repeat(first[begin:end] - (np.cumsum(n) - n), n) + np.arange(len(who))] - np.repeat(start[begin:end], n)
        # Pieces of one passage begin within `edits` characters, thus within one of two rows of
        # bands that are twice as wide and lie half a band apart.
        half = edits[who] + 1
        band = np.concatenate([2 * (at // (2 * half)), 2 * ((at + half) // (2 * half)) + 1])
        key, stand = np.unique((np.concatenate([who, who]) << 40) + (band + (1 << 39)), return_counts=True)
        who, band = key >> 40, (key & ((1 << 40) - 1)) - (1 << 39)
        half = edits[who] + 1
        low = (band >> 1) * 2 * half - (band & 1) * half - edits[who]
        high = low + 2 * half + 2 * edits[who] + size[who]
        ok = stand >= np.where((low <= 0) | (high >= total[who]), least[who], inner[who])
        yield from zip(who[ok].tolist(), low[ok].tolist(), high[ok].tolist())


def _common(a: str, masks: dict[str, int], full: int) -> int:
    """Length of the longest common subsequence of a and the text of the masks, bit-parallel."""
    v = full
    for c in a:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return (v ^ full).bit_count()


def partial_ratio(quote: str, source: str, least: float = FUZZY, opens: bool = True, ends: bool = True) -> tuple[float, int]:
    """The best similarity (0 to 100) of a quote and a passage of its length, and where the
    passage begins: twice the longest common subsequence over both lengths.  Where the source
    opens or ends, shorter passages count too.  Similarities below `least` may come out lower.
    A source shorter than the quote is looked for in the quote, and begins at 0."""
    m = len(quote)
    if not m or not source:
        return 0.0, 0
    if len(source) < m:
        return partial_ratio(source, quote, least)[0], 0
    masks: dict[str, int] = {}
    for i, c in enumerate(quote):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << m) - 1

    def score(s: int, size: int = m) -> float:
        window = source[s : s + size]
        return 200.0 * _common(window, masks, full) / (m + len(window))

    # A passage within the threshold differs in at most `edits` places, so of one piece more
    # than that at least one is intact; windows are tried where pieces stand, and around the
    # best of them.  Where no piece stands the similarity is below the threshold.
    edits = int(_edits(m))
    size = max(1, m // (edits + 1))
    last = len(source) - m
    starts: set[int] = set()
    for i in range(0, m - size + 1, size):
        at = source.find(quote[i : i + size])
        while at >= 0:
            starts.add(min(max(0, at - i), last))
            at = source.find(quote[i : i + size], at + 1)
    if not starts:
        return 0.0, 0
    best, where = max((score(s), -s) for s in starts)
    if best >= least - 15:
        around = range(max(0, -where - edits), min(last, -where + edits) + 1)
        best, where = max((score(s), -s) for s in around)
        for n in range(max(1, m - edits), m):
            if opens:
                best, where = max((best, where), (score(0, n), 0))
            if ends:
                best, where = max((best, where), (score(len(source) - n, n), n - len(source)))
    return best, -where


# --- results --------------------------------------------------------------------------------


def verify_quotes(quotes: DataFrame, pages: DataFrame, fuzzy: bool = True) -> DataFrame:
    """quotes(quote_id, paper_id, quote) with page, char_offset, verified, match_type (exact,
    fuzzy or failed) and position, the place in the paper's folded source.

    The first place counts; blank quotes and papers without text fail.
    """
    quotes = quotes.select("quote_id", "paper_id", F.coalesce("quote", F.lit("")).alias("quote"))
    search = QuoteSearch(quotes, pages)
    found = search.exact().groupBy("q", "paper_id").agg(F.min("position").alias("position")).withColumn("match_type", F.lit("exact"))
    if fuzzy:
        found = kept(found)  # for what is left, and for the result
        found = found.unionByName(kept(search.fuzzy(found).select("q", "paper_id", "position", F.lit("fuzzy").alias("match_type"))))
    places = search.located(found).select("q", "page", "char_offset", "position", "match_type")
    rows = quotes.withColumn("q", F.xxhash64("paper_id", "quote")).join(places, "q", "left")
    return rows.select("quote_id", "paper_id", "quote", "page", "char_offset", "position", F.col("match_type").isNotNull().alias("verified"), F.coalesce("match_type", F.lit("failed")).alias("match_type"))


def exact_places(quotes: DataFrame, pages: DataFrame) -> DataFrame:
    """(quote_id, page, char_offset): first page on which a quote stands character by character.

    What is equal as it stands is equal when folded, so only the folded matches are asked.
    """
    quotes = quotes.select("quote_id", "paper_id", "quote").where("trim(quote) != ''")
    search = QuoteSearch(quotes, pages)
    spans = search.placed.select("paper_id", "page", "at", "n", F.explode(F.sequence(F.floor(F.col("at") / CELL), F.floor((F.col("at") + F.col("n") - 1) / CELL))).alias("cell"))
    on = search.exact().withColumn("cell", F.floor(F.col("position") / CELL)).join(spans, ["paper_id", "cell"]).where("position >= at and position < at + n").select("q", "paper_id", "page").distinct()
    asked = quotes.select("quote_id", "quote", F.xxhash64("paper_id", "quote").alias("q"))
    rows = on.join(search.pages, ["paper_id", "page"]).join(asked, "q").where(F.contains("text", "quote"))
    return rows.groupBy("quote_id").agg(F.min("page").alias("page"), F.min_by(F.expr("instr(text, quote)") - 1, "page").alias("char_offset"))


def first_verified(quotes: DataFrame, papers: DataFrame, pages: DataFrame, fuzzy: bool = True) -> DataFrame:
    """quotes(quote_id, answer_id, quote) verified against an answer's papers(answer_id, rank,
    paper_id) in their order: the first paper that holds a quote, exactly or nearly, is its
    source.  (quote_id, paper_id, page, char_offset, match_type), NULLs and failed if none is."""
    asked = quotes.join(papers.select("answer_id", "rank", "paper_id"), "answer_id").select(F.struct("quote_id", "rank").alias("quote_id"), "paper_id", "quote")
    held = verify_quotes(asked, pages, fuzzy).where("verified").select("quote_id.*", "paper_id", "page", "char_offset", "match_type")
    first = held.groupBy("quote_id").agg(F.min_by(F.struct("paper_id", "page", "char_offset", "match_type"), F.struct("rank", "paper_id")).alias("x")).select("quote_id", "x.*")
    return quotes.select("quote_id").distinct().join(first, "quote_id", "left").withColumn("match_type", F.coalesce("match_type", F.lit("failed")))


def render(quote: Column, page: Column, verified: Column, title: Column | None = None) -> Column:
    """A quote with its place; of one that isn't verified only a mark."""
    place = F.concat(F.lit("p. "), page.cast("string")) if title is None else F.concat_ws(", ", T.short_title(title), F.concat(F.lit("p. "), page.cast("string")))
    return F.when(F.coalesce(verified, F.lit(False)), F.concat(F.lit('"'), quote, F.lit('" ['), place, F.lit("]"))).otherwise("[unverified]")


def quoted(answer: Column) -> Column:
    """The passages an answer marks as quotes, trimmed."""
    return F.transform(F.regexp_extract_all(answer, F.lit("(?s)<quote>(.*?)</quote>"), F.lit(1)), T.strip)


def verified_answers(answers: DataFrame, papers: DataFrame, pages: DataFrame, fuzzy: bool = True) -> DataFrame:
    """answers(thread_id, answer) with every marked quote replaced by the quote and its page, or
    marked as unverified, looked for in the papers(thread_id, rank, paper_id[, title]) of the
    answer in their order: (thread_id, answer, n_verified, n_unverified).

    With titles the place names the paper.
    """
    titled = "title" in papers.columns
    mark = r"(?s)<quote>.*?</quote>"
    answer = F.coalesce("answer", F.lit(""))
    rows = answers.select("thread_id", F.split(answer, mark).alias("parts"), quoted(answer).alias("quotes"))
    asked = rows.select("thread_id", F.posexplode("quotes").alias("n", "quote")).withColumn("quote_id", F.struct("thread_id", "n"))
    ranked = papers.select(F.col("thread_id").alias("answer_id"), "rank", "paper_id")
    placed = asked.join(first_verified(asked.withColumnRenamed("thread_id", "answer_id"), ranked, pages, fuzzy), "quote_id")
    title = None
    if titled:
        placed = placed.join(papers.select("thread_id", "paper_id", F.coalesce("title", F.lit("")).alias("title")), ["thread_id", "paper_id"], "left")
        title = F.col("title")
    verified = F.col("match_type") != "failed"
    texts = placed.select("thread_id", "n", render(F.col("quote"), F.col("page"), verified, title).alias("text"), verified.alias("verified"))
    per = texts.groupBy("thread_id").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("x"), F.count_if("verified").alias("n_verified"), F.count_if(~F.col("verified")).alias("n_unverified"))
    whole = rows.select("thread_id", "parts").join(per, "thread_id", "left")
    both = F.zip_with("parts", F.coalesce(F.col("x.text"), F.array().cast("array<string>")), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return whole.select("thread_id", T.strip(F.array_join(both, "")).alias("answer"), F.coalesce("n_verified", F.lit(0)).alias("n_verified"), F.coalesce("n_unverified", F.lit(0)).alias("n_unverified"))
