import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from corvellum.llm import looks

PAIRS = [
    ("ｆｕｌｌ　ｗｉｄｔｈ　１２％", "full width 12%"), ("ﬁlter ﬂow ﬀ", "filter flow ff"), ("é ñ ü", "é ñ ü"), ("zero​ wi­dth⁠", "zero width"), ("a b c　d", "a b c d"), ("p\u0430g\u0435 \u043ef \u039d\u03bft\u0435", "page of Note"), ("ё", "ë"), ("q̣̇", unicodedata.normalize("NFC", "q̣̇")), ("q̣̇", unicodedata.normalize("NFC", "q̣̇")),
]


def test_looks_alike():
    assert looks.unify_texts([a for a, _ in PAIRS]) == [b for _, b in PAIRS]


def test_looks_different():
    for a, b in (("x²", "x2"), ("E", "e"), ("é", "e"), ("α", "a"), ("–", "-"), ("½", "1/2"), ("a\nb", "a b"), ("“a”", '"a"')):
        one, two = looks.unify_texts([a, b])
        assert one != two


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("aeouAȨ̣́̀̈̃ éüñ", max_size=30), max_size=5))
def test_marks_compose_as_the_standard_says(texts):
    assert looks.unify_texts(texts) == [unicodedata.normalize("NFC", t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_the_form_is_stable(texts):
    once = looks.unify_texts(texts)
    assert looks.unify_texts(once) == once


CITES = "citation_id bigint, paper_id string, quote string, form string, seed string"
PAGES = "paper_id string, page int, text string, form string, seed string"


def places(spark, cites, pages):
    made = looks.quote_places(spark.createDataFrame([(*c, "x", "y") for c in cites], CITES), spark.createDataFrame([(*p, "x", "y") for p in pages], PAGES))
    return {tuple(r) for r in made.collect()}


def test_places_and_edges(spark):
    body = "The quadratic parser of Lemnur widens every noisy filter despite the smaller width of its index."
    pages = [("p", 1, body), ("p", 1, body), ("p", 2, body.replace("noisy", "ｎｏｉｓｙ")), ("q", 1, body), ("p", 3, None), (None, 4, body), ("p", 5, "")]
    cites = [
        (1, "p", "every noisy filter despite the smaller"), (2, "p", "every no​isy filter despite the smaller"), (3, "p", "nоisy"), (4, "p", None), (5, "p", "  "), (6, "p", "Every noisy filter despite the smaller"),
        (7, "q", "parser of Lemnur wi­dens"), (8, "z", "every noisy filter"), (9, None, "noisy"), (1, "p", "every noisy filter despite the smaller"), (10, "p", "​​"),
    ]
    assert places(spark, cites, pages) == {(1, 1, True), (1, 2, False), (2, 1, False), (2, 2, False), (3, 1, False), (3, 2, False), (7, 1, False)}


def test_empty_tables(spark):
    assert places(spark, [], []) == set()


def test_columns_of_the_form_are_replaced(spark):
    df = spark.createDataFrame([("ﬁ", "old"), (None, "old")], "text string, form string")
    assert [tuple(r) for r in looks.with_form(df, "text").collect()] == [("ﬁ", "fi")]
