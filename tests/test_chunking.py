from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvellum.operators import chunking, layout

SENTENCES = [f"Sentence number {i} says something about the topic at hand in general." for i in range(31)]
PAGES = [("p", 1, "Introduction\n" + " ".join(SENTENCES)), ("p", 2, "Method\n" + " ".join(SENTENCES) + "\nConclusion\nThe end is here."), ("q", 1, None), ("r", 1, ""), ("s", 1, "No heading here. Just text."), ("s", 2, "1 Introduction\n1 Introduction\nMore. Yet more.")]


def frame(spark):
    return spark.createDataFrame(PAGES, "paper_id string, page int, text string")


def walk(lengths, target, overlap):
    """Packing by the book: a buffer that is flushed and seeded."""
    groups, buf, size = [], [], 0
    for i, n in enumerate(lengths):
        if buf and size + n > target:
            groups.append(buf)
            tail, room = [], 0
            for j in reversed(buf):
                if room + lengths[j] > overlap:
                    break
                tail.insert(0, j)
                room += lengths[j]
            buf, size = tail, room
        buf = [*buf, i]
        size += n
    return [*groups, buf] if buf else groups


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=40), st.integers(20, 100), st.integers(0, 19))
def test_packing(lengths, target, overlap):
    assert [list(range(a, b)) for a, b in chunking.pack(lengths, target, overlap)] == walk(lengths, target, overlap)


def test_section_chunks(spark):
    papers = spark.createDataFrame([("p", "A Title", None, "p.pdf"), ("s", None, 2020, "s.pdf")], "paper_id string, title string, year int, path string")
    rows = [r for r in chunking.chunks(frame(spark), papers).collect() if r.paper_id == "p"]
    rows.sort(key=lambda r: r.chunk_index)
    assert [r.chunk_index for r in rows] == list(range(len(rows))) and [r.chunk_id for r in rows] == [f"p:{i}" for i in range(len(rows))]
    assert {r.section for r in rows} == {"Introduction", "Method", "Conclusion"}
    assert all(len(r.text) < 1600 and r.text[-1] in ".!?" and "Introduction" not in r.text for r in rows)
    intro = [r for r in rows if r.section == "Introduction"]
    assert len(intro) > 1 and all(a.text.split(". ")[-1].rstrip(".") in b.text for a, b in zip(intro, intro[1:]))
    assert rows[0].embed_text.startswith("From 'A Title', section 'Introduction': ") and rows[0].year == 0


def test_headings_carry_over(spark):
    rows = {(r.paper_id, r.page, r.sentence): (r.section, r.section_no) for r in chunking.units(frame(spark)).collect()}
    assert rows["p", 2, SENTENCES[0]][0] == "Method" and rows["s", 1, "Just text."][0] == "" and rows["s", 2, "Yet more."][0] == "1 Introduction"
    assert rows["s", 2, "Yet more."][1] == 1  # the repeated heading begins nothing new
    texts = {(r.paper_id, r.section): r.section_text for r in chunking.section_texts(chunking.units(frame(spark))).collect()}
    assert texts["s", "(no section)"] == "No heading here. Just text." and texts["p", "Conclusion"] == "The end is here."


def test_windows_equal_the_loop(spark):
    sizes = [0, 1, 999, 1000, 1001, 1799, 1800, 1801, 2600, 2601]
    pages = spark.createDataFrame([("p", n, "x" * n) for n in sizes], "paper_id string, page int, text string")
    got = {}
    for r in chunking.fixed_windows(pages).collect():
        got.setdefault(r.page, {})[r.window_no] = len(r.text)
    for n in sizes:
        want, start = {}, 0
        while start < n:
            want[len(want)] = min(1000, n - start)
            if start + 1000 >= n:
                break
            start += 800
        assert got.get(n, {}) == want


BLOCKS = "paper_id string, page int, page_width double, x0 double, y0 double, dir_x double, dir_y double, font_size double, text string"


def blocks(spark):
    rows = []
    for page in (1, 2, 3):
        rows += [("p", page, 595.0, 50.0, 25.0, 1.0, 0.0, 9.0, "Journal of Tests"), ("p", page, 595.0, 290.0, 800.0, 1.0, 0.0, 9.0, str(page))]
        rows += [("p", page, 595.0, x, y, 1.0, 0.0, 10.0, f"c{i} of  page {page}") for i, (x, y) in enumerate([(305.0, 85.0), (50.0, 320.0), (50.0, 85.0), (305.0, 320.0)])]
    rows += [("p", 1, 595.0, 50.0, 50.0, 1.0, 0.0, 16.0, "A Title on\nTwo Lines"), ("p", 1, 595.0, 10.0, 300.0, 0.0, 1.0, 20.0, "stamp"), ("p", 2, 595.0, 50.0, 400.0, 1.0, 0.0, 10.0, "hyphen-\nated"), ("p", 2, 595.0, 50.0, 401.0, 1.0, 0.0, 10.0, " ")]
    return spark.createDataFrame(rows, BLOCKS)


def test_layout(spark):
    pages = {r.page: r.text.split("\n") for r in layout.pages_of(blocks(spark)).collect()}
    assert pages[1] == ["A Title on Two Lines", "c2 of page 1", "c1 of page 1", "c0 of page 1", "c3 of page 1"]
    assert pages[2] == ["c2 of page 2", "c1 of page 2", "hyphenated", "c0 of page 2", "c3 of page 2"]
    assert layout.titles(blocks(spark)).first().title == "A Title on Two Lines"
    full = layout.full_texts(spark.createDataFrame([("p", 2, "b"), ("p", 1, "a")], "paper_id string, page int, text string")).first()
    assert full.full_text == "[PAGE 1]\n\na\n\n[PAGE 2]\n\nb" and full.n_tokens == 6


def test_transcriptions(spark):
    pages = spark.createDataFrame([("p", 1, "a"), ("p", 2, "b"), ("p", 3, "c")], "paper_id string, page int, text string")
    extra = spark.createDataFrame([("p", 1, " $$x$$ "), ("p", 2, "NONE")], "paper_id string, page int, transcription string")
    got = {r.page: r.text for r in layout.with_transcriptions(pages, extra).collect()}
    assert got[1].endswith("]\n$$x$$") and got[2] == "b" and got[3] == "c"
    assert pages.where(F.col("page") > 9).count() == 0
