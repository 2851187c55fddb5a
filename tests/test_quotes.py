import os
import random

from corvellum.operators import quotes

PAGES = [
    ("p", 1, "The model was trained on many sequences. We observe that the loss falls quickly, and the gap closes. This sentence begins here and"),
    ("p", 2, "continues on the following page — with a “curly” quote in it. Nothing else of note is said about the parser of the second stage."),
    ("p", 3, ""), ("e", 1, None),
]
PHRASE = "nothing else of note is said about the parser"
CASES = [
    ("exact", "p", "Nothing else of note is said about the parser", "exact", 2), ("space", "p", "Nothing  else\nof note is said about the parser", "exact", 2), ("curly", "p", 'with a "curly" quote in it. Nothing else', "exact", 2), ("dash", "p", "following page - with a “curly” quote in", "exact", 2),
    ("cross", "p", "This sentence begins here and continues on the following page", "exact", 1), ("one", "p", "We observe that the loss fells quickly, and the gap", "fuzzy", 1), ("three", "p", "Wa obsarve that tha loss fells quickly, and thx gap", "failed", None), ("invented", "p", "A sentence that stands on no page of this paper at all.", "failed", None),
    ("empty", "p", "", "failed", None), ("blank", "p", "  \n", "failed", None), ("null", "p", None, "failed", None), ("nopaper", "z", PHRASE, "failed", None), ("notext", "e", PHRASE, "failed", None), ("short", "p", "loss falls", "exact", 1),
]


def test_verification(spark):
    asked = spark.createDataFrame([(k, p, q, "x") for k, p, q, *_ in CASES], "quote_id string, paper_id string, quote string, page string")
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "paper_id string, page int, text string, form string")
    got = {r.quote_id: r for r in quotes.verify_quotes(asked, pages).collect()}
    assert {k: (r.match_type, r.page) for k, r in got.items()} == {k: (m, n) for k, _, _, m, n in CASES}
    text = {n: t for p, n, t in PAGES if p == "p"}
    for key in ("exact", "space", "cross", "short"):
        r = got[key]
        assert r.verified and text[r.page][r.char_offset :].lower().startswith(" ".join(r.quote.split()).lower()[:20])


def test_alignment_equals_all_windows():
    random.seed(3)
    text = "".join(random.choice("abcdefgh ") for _ in range(900))
    seen = 0
    for _ in range(60):
        at = random.randrange(700)
        quote = list(text[at : at + random.randint(40, 110)])
        for _ in range(random.randint(0, 6)):
            k = random.randrange(len(quote))
            quote[k : k + random.choice((0, 1))] = random.choice(("x", "", "yz"))
        quote = "".join(quote)
        masks = {}
        for i, c in enumerate(quote):
            masks[c] = masks.get(c, 0) | 1 << i
        full = (1 << len(quote)) - 1
        m = len(quote)
        parts = [*((i, text[i : i + m]) for i in range(len(text) - m + 1)), *((0, text[:n]) for n in range(1, m)), *((len(text) - n, text[-n:]) for n in range(1, m))]
        best = max((200 * quotes._common(x, masks, full) / (m + len(x)), -i) for i, x in parts)
        score, place = quotes.partial_ratio(quote, text)
        if best[0] >= quotes.FUZZY:
            seen += 1
            assert abs(score - best[0]) < 1e-9
        else:
            assert score < quotes.FUZZY
    assert seen > 20


def test_rendering(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a b", 3, True, "T"), ("a b", None, False, "T"), ("c", 1, None, "T")], "q string, p int, v boolean, t string")
    assert [r.y for r in df.select(quotes.render(F.col("q"), F.col("p"), F.col("v"), F.col("t")).alias("y")).collect()] == ['"a b" [T, p. 3]', '[unverified]', '[unverified]']
    answer = spark.createDataFrame([("x <quote> one\ntwo </quote> y <quote>three</quote>",)], "a string")
    assert answer.select(quotes.quoted(F.col("a")).alias("y")).first().y == ["one\ntwo", "three"]


def test_fuzzy_quotes_without_whole_word_pairs(spark):
    """One typo in a few long words leaves no pair of words, but a similarity of 95 or more."""
    page = "An electroencephalographic characterization of counterintuitive representationalisms was then undertaken in several laboratories of note."
    asked = [("two", "electroencephalographic charactarization", "fuzzy"), ("three", "characterization of countarintuitive representationalisms", "fuzzy"), ("middle", "electroencephalographic charxcterization of counterintuitive", "fuzzy"), ("single", "electroencephalogrxphic", "fuzzy"), ("far", "elactroencaphalogrxphic charactarization", "failed"), ("word", "photoluminescencespectra", "failed"), ("tiny", "zq", "failed")]
    quoted = spark.createDataFrame([(k, "p", q) for k, q, _ in asked], "quote_id string, paper_id string, quote string")
    pages = spark.createDataFrame([("p", 1, "Nothing of the kind stands here."), ("p", 2, page)], "paper_id string, page int, text string")
    got = {r.quote_id: (r.match_type, r.page) for r in quotes.verify_quotes(quoted, pages).collect()}
    assert got == {k: (m, 2 if m == "fuzzy" else None) for k, _, m in asked}


def test_pages_left_out_hold_no_fuzzy_match(spark):
    random.seed(5)
    texts = {n: " ".join("".join(random.choice("abcde") for _ in range(random.randint(1, 9))) for _ in range(80)) for n in range(1, 5)}
    asked = []
    for k in range(60):
        n, at = random.randint(1, 4), random.randrange(250)
        quote = list(texts[n][at : at + random.randint(20, 90)])
        for _ in range(random.randint(1, 4)):
            i = random.randrange(len(quote))
            quote[i : i + random.choice((0, 1))] = random.choice(("x", "", "yz"))
        asked.append((str(k), "p", " ".join("".join(quote).split())))
    quoted = spark.createDataFrame(asked, "quote_id string, paper_id string, quote string")
    pages = spark.createDataFrame([("p", n, t) for n, t in texts.items()], "paper_id string, page int, text string")
    got = {r.quote_id: r.verified for r in quotes.verify_quotes(quoted, pages).collect()}
    source = " ".join(texts.values())
    want = {k: quotes.partial_ratio(q, source)[0] >= quotes.FUZZY for k, _, q in asked}
    assert got == want and 10 < sum(want.values()) < 60


def test_quotes_over_many_pages_and_cells(spark):
    """Pages shorter and longer than a cell; quotes over three pages and over several cells."""
    random.seed(9)
    word = lambda: "".join(random.choice("abcdefghijklm") for _ in range(random.randint(1, 8)))
    texts = {n: "  ".join(word() for _ in range(size)) for n, size in enumerate((3, 2, 1, 900, 2, 1500, 4, 4), 1)}
    source = " ".join(" ".join(t.split()) for t in texts.values())
    firsts, at = {}, 0
    for n, t in texts.items():
        firsts[n], at = at, at + len(" ".join(t.split())) + 1
    asked, want = [], {}
    for k, (a, size) in enumerate([(0, 12), (0, 40), (3, 5), (len(source) - 60, 60), *((random.randrange(len(source) - 5000), random.choice((3, 9, 20, 60, 2500, 4900))) for _ in range(40))]):
        q = source[a : a + size].strip()
        asked.append((str(k), "p", q))
        place = source.find(q)
        want[str(k)] = (place, max(n for n in texts if firsts[n] <= place), "exact")
    quoted = spark.createDataFrame(asked, "quote_id string, paper_id string, quote string")
    pages = spark.createDataFrame([*(("p", n, t) for n, t in texts.items()), ("p", 99, " "), ("p", 98, None)], "paper_id string, page int, text string")
    got = {r.quote_id: r for r in quotes.verify_quotes(quoted, pages).collect()}
    assert {k: (r.position, r.page, r.match_type) for k, r in got.items()} == want
    for k, r in got.items():
        begins = "".join(texts[r.page][r.char_offset :].split())[:3]
        assert "".join(asked[int(k)][2].split()).startswith(begins)


def test_a_source_shorter_than_the_quote(spark):
    quoted = spark.createDataFrame([("a", "p", "and then the little page was turned over by the reader"), ("b", "p", "nothing alike in these words at all")], "quote_id string, paper_id string, quote string")
    pages = spark.createDataFrame([("p", 4, "The  Little Page")], "paper_id string, page int, text string")
    got = {r.quote_id: (r.match_type, r.page, r.char_offset) for r in quotes.verify_quotes(quoted, pages).collect()}
    assert got == {"a": ("fuzzy", 4, 0), "b": ("failed", None, None)}


def test_first_paper_in_order_wins(spark):
    pages = spark.createDataFrame([("p", 1, "the gap closes when the budget is large"), ("r", 2, "we see that the gap closes when the budget is largo"), ("s", 3, "the gap closes when the budget is large")], "paper_id string, page int, text string")
    papers = spark.createDataFrame([("x", 1, "q"), ("x", 2, "r"), ("x", 3, "p"), ("y", 1, "s"), ("y", 2, "p"), ("z", 1, "q")], "answer_id string, rank int, paper_id string")
    asked = spark.createDataFrame([(k, k, "the gap closes when the budget is large") for k in "xyzw"], "quote_id string, answer_id string, quote string")
    got = {r.quote_id: (r.paper_id, r.page, r.match_type) for r in quotes.first_verified(asked, papers, pages).collect()}
    assert got == {"x": ("r", 2, "fuzzy"), "y": ("s", 3, "exact"), "z": (None, None, "failed"), "w": (None, None, "failed")}


def test_exact_places_are_unfolded(spark):
    pages = spark.createDataFrame([("p", 1, "The Gap closes."), ("p", 2, "so the gap closes. the gap closes.")], "paper_id string, page int, text string")
    asked = spark.createDataFrame([(1, "p", "the gap closes"), (2, "p", "THE GAP"), (3, "p", " "), (4, "p", None)], "quote_id int, paper_id string, quote string")
    assert [(r.quote_id, r.page, r.char_offset) for r in quotes.exact_places(asked, pages).collect()] == [(1, 2, 3)]


def test_long_quote_over_a_page_end(spark):
    """The rarest gram of a quote may stand over 80 words behind the page end."""
    common = " ".join(f"word{i}" for i in range(150))
    texts = [(1, "This page begins in a way of its own and ends so"), (2, f"{common} unseen finish of it all."), *((n, common) for n in (3, 4, 5))]
    asked = spark.createDataFrame([("q", "p", f"of its own and ends so {common} unseen finish of it")], "quote_id string, paper_id string, quote string")
    pages = spark.createDataFrame([("p", n, t) for n, t in texts], "paper_id string, page int, text string")
    r = quotes.verify_quotes(asked, pages).first()
    assert (r.match_type, r.page) == ("exact", 1)


def test_kept_texts_are_compressed(spark):
    from pyspark.sql import functions as F

    from corvellum.session import kept

    rows = spark.range(2000).select("id", F.repeat(F.lit("the same words again "), 50).alias("text"), F.lit(None).cast("string").alias("none"))
    got = kept(rows.repartition(3, "id"))
    assert got.dtypes == rows.dtypes and got.exceptAll(rows).isEmpty() and got.count() == 2000
    search = quotes.QuoteSearch(spark.createDataFrame([("p", "again")], "paper_id string, quote string"), rows.select(F.lit("p").alias("paper_id"), F.col("id").cast("int").alias("page"), "text"))
    size = sum(os.path.getsize(f.removeprefix("file://")) for f in search.cells.inputFiles())
    assert 0 < size < 2000 * 1000 / 4


def _templated(seed, words):
    random.seed(seed)
    some = ["".join(random.choice("abcdefghijklm") for _ in range(random.randint(4, 11))) for _ in range(14)]
    return lambda n=words: " ".join(random.choice(some) for _ in range(n))


def test_fuzzy_search_shuffles_no_passages(spark):
    """Quotes whose pieces stand all over a long paper: texts and quotes are shuffled, not every
    passage that holds a piece."""
    text = _templated(11, 300)
    pages = spark.createDataFrame([("p", n, text()) for n in range(150)], "paper_id string, page int, text string")
    quoted = spark.createDataFrame([("p", text(12)) for _ in range(60)], "paper_id string, quote string")
    search = quotes.QuoteSearch(quoted, pages)
    found = search.exact().limit(0).localCheckpoint()
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    sizes = lambda: {f.getPath(): f.length() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(manager.getAllFiles())}
    before = sizes()
    search.fuzzy(found).collect()
    assert sum(n for f, n in sizes().items() if f not in before) < 2 * sum(len(r.text) for r in pages.collect())


def test_fuzzy_places_over_blocks(spark, monkeypatch):
    """Papers of several blocks, quotes at the ends of blocks and of the source."""
    monkeypatch.setattr(quotes, "BLOCK", 2 * quotes.CELL)
    text = _templated(12, 700)
    texts = {n: text() for n in range(6)}
    source = " ".join(texts.values())
    random.seed(13)
    asked = []
    for k, at in enumerate([0, len(source) - 90, *(quotes.CELL * random.randint(1, 10) + random.randint(-100, 20) for _ in range(50))]):
        quote = list(source[at : at + random.randint(30, 90)])
        for _ in range(random.randint(1, 5)):
            i = random.randrange(len(quote))
            quote[i : i + random.choice((0, 1))] = random.choice(("x", "", "yz"))
        asked.append((str(k), "p", " ".join("".join(quote).split())))
    quoted = spark.createDataFrame(asked, "quote_id string, paper_id string, quote string")
    pages = spark.createDataFrame([("p", n, t) for n, t in texts.items()], "paper_id string, page int, text string")
    got = {r.quote_id: r for r in quotes.verify_quotes(quoted, pages).collect()}
    want = {k: quotes.partial_ratio(q, source) for k, _, q in asked}
    assert {k: r.position for k, r in got.items() if r.match_type != "exact"} == {k: at if score >= quotes.FUZZY else None for k, (score, at) in want.items() if got[k].match_type != "exact"}
    assert 10 < sum(r.match_type == "fuzzy" for r in got.values()) < 52
