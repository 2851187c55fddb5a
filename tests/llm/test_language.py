from pyspark.sql import functions as F

from corvellum.llm import language

SCHEMA = "doc_id bigint, lang string, text string, language string, confidence string"


def test_spellings(spark):
    given = {"en": ["en"], "EN_GB": ["en"], "de-DE": ["de"], "de_AT": ["de"], "pt-BR": ["pt"], "Français": ["fr"], "SPANISH": ["es"], "it": ["it"], "en+fr": ["en", "fr"], "de; en": ["de", "en"], "fr/it": ["fr", "it"], "es-419": ["es"], None: [], "": [], "und": [], "??": [], "n/a": [], "multi": [], "xx": [], "deu": ["de"], "eng, por": ["en", "pt"]}
    df = spark.createDataFrame([(k,) for k in given], "lang string").withColumn("n", language.named_languages(F.col("lang")))
    assert {r.lang: sorted(r.n) for r in df.collect()} == given


def test_held_out_labels(spark, tables):
    """Dictionaries of one half of the labelled documents tell the other half."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("named", language.named_languages(F.col("lang")))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    made = language.fit(language.sample(docs.where(half)))
    told = language.document_languages(language.segments(docs.where(~half), made))
    top = told.groupBy("doc_id").agg(F.max_by("language", "share").alias("language"))
    rows = top.join(docs.where(~half & (F.size("named") == 1)).select("doc_id", "named"), "doc_id").collect()
    right = sum(r.language == r.named[0] for r in rows)
    assert len(rows) > 300 and right / len(rows) > 0.9  # a part of the labels is wrong


def docs():
    de = "Die Ergebnisse zeigen, dass der Datensatz nicht von der Methode abhängt. "
    en = "The results show that the sampler does not depend on the method. "
    rows = [(i, "de", f"{de}Wir zeigen, dass der Wert {i} von dem Modell nicht erreicht wird. " * 2) for i in range(40)] + [(100 + i, "en", f"{en}We show that the value {i} is not reached by the model. " * 2) for i in range(40)]
    return rows + [(200, "en", de * 4 + en * 4), (201, None, de.upper() * 4), (202, "en", None), (203, "en", ""), (204, "de", "x = 3 + 4\n0.1 | 0.2 | 0.3"), (205, "en", en * 3000), (206, "  ", "Ja."), (200, "en", de * 4 + en * 4)]


def test_segments_and_edges(spark):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in docs()], SCHEMA)
    got = {}
    for r in language.segments(df).collect():
        got.setdefault(r.doc_id, set()).add((r.segment_no, r.language, r.n_words))
    assert {(n, x) for n, x, _ in got[200]} == {(0, "de"), (1, "en")}
    assert {x for _, x, _ in got[201]} == {"de"} and {x for _, x, _ in got[205]} == {"en"}
    assert {x for _, x, _ in got[204]} == {"und"} == {x for _, x, _ in got[206]} and 202 not in got and 203 not in got
    shares = {(r.doc_id, r.language): r.share for r in language.document_languages(language.segments(df.where("doc_id = 205 or doc_id < 200"))).collect()}
    assert shares[205, "en"] == 1


def test_empty_table_and_no_labels(spark):
    assert language.segments(spark.createDataFrame([], SCHEMA)).count() == 0
    unlabelled = spark.createDataFrame([(1, None, "Some words of no known language here.", "", "")], SCHEMA)
    assert all(r.confidence <= 0.5 for r in language.segments(unlabelled).collect())


def test_long_foreign_runs(spark):
    """A foreign passage without marks is told whatever its length, in a run of its own or not."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.sample(docs)
    c = language.Classifier(language.fit(rows))
    bare = {x: " ".join(" ".join("".join(ch if ch.isalpha() else " " for ch in t.lower()).split()) for lang, t in rows if lang == x)[20_000:] for x in ("de", "en")}
    for n in (300, 1000, 3000, 12_000):
        en, de = bare["en"][: 2 * n], bare["de"][:n]
        for mark in (".\n", " "):
            (got,) = language.classify(c, [en + mark + de])
            words = {x: sum(r[2] for r in got if r[3] == c.languages.index(x)) for x in ("de", "en")}
            share = len(de.split()) / len((en + " " + de).split())
            assert abs(words["de"] / sum(r[2] for r in got) - share) < 0.12, (n, mark, words, share)


def test_windows_are_bounded_and_whole():
    for text in ("a" * 1000, "ab " * 500, "", " ", "x_" * 700, "One. Two three.\n" * 3 + "word " * 100, " " * 600 + "z", "b" + " " * 600 + "z"):
        spans = language.windows(text)
        assert all(0 < b - a <= language.WINDOW for a, b in spans)
        assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:]))
        kept = "".join(text[a:b] for a, b in spans)
        assert "".join(kept.split()) == "".join("".join(text[a:b] for a, b in language.sentences(text)).split())


def test_batch_is_told_at_once(monkeypatch):
    """A batch gives what its texts give one by one, by as many array passes as one text."""
    texts = [t for _, _, t, *_ in [(*r, "") for r in docs()] if t is not None] + ["", " ", "x = 3", "Ja."]
    c = language.Classifier(language.fit([(lang, t) for _, lang, t in docs()[:80]]))
    single = [row for t in texts for row in language.classify(c, [t])]
    passes = []
    search = language.np.searchsorted
    monkeypatch.setattr(language.np, "searchsorted", lambda *a, **k: passes.append(1) or search(*a, **k))
    assert list(language.classify(c, texts)) == single and len(passes) == 2
    assert list(language.classify(c, [])) == []
