"""Missing or wrong language labels (problem 8).

A text is written in the language whose dictionary compresses it best.  For every language
a zstandard raw-content dictionary is made of labelled sample texts; each sentence of a
document is compressed with every dictionary, and the smallest result names its language
unless the margin to the next is narrow, in which case the sentence follows its neighbours.
Sentences of one language in a row form a segment, segments add up to the document.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from corvellum.llm.codes import code_points, slices, word_table
from corvellum.session import spread

# The languages, and the spellings of each (ISO 639 codes and names).
LANGUAGES = ("de", "en", "es", "fr", "it", "pt")
SPELLINGS = {
    "de": ("de", "deu", "ger", "german", "deutsch", "allemand", "aleman", "tedesco", "alemao"),
    "en": ("en", "eng", "english", "englisch", "anglais", "ingles", "inglese"),
    "es": ("es", "spa", "esp", "spanish", "espanol", "castellano", "castilian", "spanisch", "espagnol", "spagnolo", "espanhol"),
    "fr": ("fr", "fra", "fre", "french", "francais", "franzosisch", "franzoesisch", "frances", "francese"),
    "it": ("it", "ita", "italian", "italiano", "italienisch", "italien"),
    "pt": ("pt", "por", "ptg", "portuguese", "portugues", "portugiesisch", "portugais", "portoghese", "brazilian"),
}

#: Labelled documents a language's dictionary is made of, at most, and its bytes.
SAMPLE_DOCS, DICT_BYTES = 250, 16_000
#: A sentence goes into a dictionary if the others make it larger by this share.
MARGIN = 0.1
#: Bytes a word that another language must save to be taken for a sentence.  On labelled
#: documents true changes of language save 1.5 to 4, chance under 1.
GAIN = 1.0
#: Code points of a sentence that are told at once, at most; a longer one, such as a list or
#: a passage without marks, is cut at blanks, as it may change its language inside.
WINDOW = 240
#: Share of a document's words that a language must have to be reported.
SHARE = 0.2

_MARK = re.compile("[̀-ͯ]+")
#: A sentence is told only if three words of letters stand in a row.
_TELLING = re.compile(r"(?:[^\W\d_]{2,}[\W\d_]+){2}[^\W\d_]{2,}")
_PAUSE, _SIGN, _BLANKS = re.compile(r"(?s).*\S(?=\s)"), re.compile(r"(?s).*[\W_]"), re.compile(r"\s*")
_CUT = re.compile(r"(?<=[.!?…])[\"')\]]*\s+(?=[^\W\d_a-zß-öø-ÿ]|[\"'(\[¿¡])|\n+")


def plain(text: str) -> str:
    """Case and accents carry no weight: documents lose them."""
    return _MARK.sub("", unicodedata.normalize("NFD", text.casefold()))


def named_languages(label: Column) -> Column:
    """Languages that a label names, in any common spelling; none for NULL or no language.

    A label is cut at everything that isn't a letter; of a code with a region (de-AT) the
    first part is the language, so a part in capitals behind - or _ is a region.
    """
    text = F.lower(F.translate(F.regexp_replace(label, "[-_]([A-Z]{2}|[0-9]{3})(?![A-Za-z])", ""), "áàâãäçéèêëíìîïñóòôõöúùûüÁÀÂÃÄÇÉÈÊËÍÌÎÏÑÓÒÔÕÖÚÙÛÜ", "aaaaaceeeeiiiinooooouuuuAAAAACEEEEIIIINOOOOOUUUU"))
    parts = F.split(text, "[^a-z]+")
    table = F.create_map(*[F.lit(x) for lang, names in SPELLINGS.items() for name in names for x in (name, lang)])
    return F.coalesce(F.array_distinct(F.filter(F.transform(parts, lambda p: F.try_element_at(table, p)), lambda x: x.isNotNull())), F.array().cast("array<string>"))


class Classifier:
    """Sizes of texts under every language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = 3):
        self.languages = sorted(dictionaries)
        self.compressors = []
        for lang in self.languages:
            d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.compressors.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.compressors)))
        for k, c in enumerate(self.compressors):
            compress = c.compress
            out[:, k] = [len(compress(t)) for t in texts]
        return out


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of the sentences, without the blanks between."""
    spans, at = [], 0
    for m in _CUT.finditer(text):
        if m.start() > at:
            spans.append((at, m.start()))
        at = m.end()
    if at < len(text):
        spans.append((at, len(text)))
    return spans


def windows(text: str) -> list[tuple[int, int]]:
    """Spans of the sentences, those over WINDOW cut into parts of about one length: at
    blanks, else at other signs, and inside a word only if it fills a window."""
    spans = []
    for a, b in sentences(text):
        while b - a > WINDOW:
            to = a - (a - b) // -(-(b - a) // WINDOW)
            m = _PAUSE.match(text, a, to + 1) or _SIGN.match(text, a, to)
            end = m.end() if m else to
            spans.append((a, end))
            a = _BLANKS.match(text, end, b).end()
        if a < b:
            spans.append((a, b))
    return spans


def classify(c: Classifier, texts: list[str]) -> Iterator[list[tuple[int, int, int, int, float]]]:
    """Segments (start, end, words, language number or -1, confidence) of each text.

    The text's main language is the one that compresses it best as a whole.  Every sentence,
    or window of a long one, is compressed with all dictionaries; it is of another language
    only if that saves GAIN bytes a word against the main one, and narrower choices are
    rejected.  Sentences without letters enough belong to what stands beside.
    """
    spans = [windows(t) for t in texts]
    telling = [np.array([_TELLING.search(t, a, b) is not None for a, b in s], bool) for t, s in zip(texts, spans)]
    clean = [[x.encode() for x in plain("\n".join(t[a:b] for (a, b), ok in zip(s, k) if ok)).split("\n") if x] for t, s, k in zip(texts, spans, telling)]
    whole = c.sizes([b" ".join(x) for x in clean])
    main = whole.argmin(axis=1)
    sizes = c.sizes([x for xs in clean for x in xs])
    isw = np.zeros(sum(map(len, texts)) + len(texts) + 1, np.int8)
    isw[1:] = word_table()[code_points("\n".join([*texts, ""]))]
    begins = np.flatnonzero(np.diff(isw) == 1)
    first = np.cumsum([0, *(len(t) + 1 for t in texts)])
    # All sentences of the batch at once, as a document alone has few.
    count = np.fromiter(map(len, spans), np.int64, len(spans))
    places = np.array([x for s in spans for x in s], np.int64).reshape(-1, 2) + np.repeat(first[:-1], count)[:, None]
    words = np.searchsorted(begins, places[:, 1]) - np.searchsorted(begins, places[:, 0])
    told = np.concatenate([np.zeros(0, bool), *telling])
    lang, sure = np.full(len(told), -1), np.zeros(len(told))
    if len(sizes):
        row, home = np.arange(len(sizes)), np.repeat(main, count)[told]
        best = sizes.argmin(axis=1)
        gain = sizes[row, home] - sizes[row, best]
        lang[told] = taken = np.where(gain >= GAIN * words[told], best, home)
        size = sizes[row, taken]
        others = sizes.copy()
        others[row, taken] = np.inf
        # Each byte of lead is worth 8 bits of odds; a sixteenth is trusted.
        sure[told] = 1 / (1 + np.exp2(np.clip((size - others.min(axis=1)) / 2, -40, 40)))
    rows = zip(words.tolist(), lang.tolist(), sure.tolist())
    for s in spans:
        out: list[list] = []
        for (a, b), (n, x, p) in zip(s, rows):
            if out and (x == out[-1][3] or x < 0 or out[-1][3] < 0):
                last = out[-1]
                last[1], last[2], last[3] = b, last[2] + n, max(x, last[3])
                last[4] += n * p * (x >= 0)
                last[5] += n * (x >= 0)
            else:
                out.append([a, b, n, x, n * p, n * (x >= 0)])
        yield [(a, b, n, x, float(p / max(1, m))) for a, b, n, x, p, m in out]


def fit(sample: list[tuple[str, str]], rounds: int = 4) -> dict[str, bytes]:
    """Dictionaries out of (language, text) rows, mislabelled and foreign sentences left out.

    Labels are partly wrong and some texts mix languages, so each round reclassifies every
    sentence of the sample, and only those that clearly agree with their label stay.  The
    texts are halved, and a half is judged by the dictionaries of the other: a sentence
    never vouches for itself.  The first dictionaries are small, as the sentences of a
    wrong label must not outweigh the right ones.
    """
    texts = sorted(set(sample), key=lambda r: (xxhash.xxh64_intdigest(r[1]), r))
    rows = [(lang, plain(text[a:b]), k % 2) for k, (lang, text) in enumerate(texts) for a, b in sentences(text) if b - a >= 40]
    keep = np.ones(len(rows), bool)

    def made(size: int, halves: tuple[int, ...]) -> dict[str, bytes]:
        return {lang: " ".join(t for (x, t, h), ok in zip(rows, keep) if ok and x == lang and h in halves).encode()[:size].rjust(16) for lang in LANGUAGES}

    for k in range(rounds):
        size = DICT_BYTES >> (rounds - 1 - k)
        agrees = np.zeros(len(rows), bool)
        for half in (0, 1):
            c = Classifier(made(size, (1 - half,)))
            mine = [i for i, r in enumerate(rows) if r[2] == half]
            sizes = c.sizes([rows[i][1].encode() for i in mine])
            for i, s in zip(mine, sizes):
                own = c.languages.index(rows[i][0])
                agrees[i] = (np.delete(s, own) > s[own] * (1 + MARGIN)).all()
        keep = agrees
    return made(DICT_BYTES, (0, 1))


SEGMENTS = "doc_id bigint, segment_no int, seg_start int, seg_end int, n_words int, language string, confidence double"


def _run(dictionaries: dict[str, bytes]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Classifier(dictionaries)
        names = [*c.languages, "und"]
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for i, j in slices(texts):
                rows = [(ids[k], no, a, b, n, names[x], p) for k, segments in enumerate(classify(c, texts[i:j]), i) for no, (a, b, n, x, p) in enumerate(segments)]
                if rows:
                    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(zip(*rows), kinds)], [f.split()[0] for f in SEGMENTS.split(", ")])

    return run


def sample(documents: DataFrame, per_language: int = SAMPLE_DOCS) -> list[tuple[str, str]]:
    """A bounded sample of documents whose label names one language: (language, text).

    The first per_language documents of each language by a hash of their id, so any row may
    be chosen; at most six times per_language rows reach the driver.
    """
    one = documents.where("text is not null").withColumn("named", named_languages(F.col("lang"))).where(F.size("named") == 1).select(F.col("named")[0].alias("language"), "doc_id", F.xxhash64("doc_id").alias("h"))
    nth = F.row_number().over(Window.partitionBy("language").orderBy("h", "doc_id"))  # cut off before its shuffle
    chosen = one.withColumn("nth", nth).where(F.col("nth") <= per_language).select("language", "doc_id")
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("language", "text").collect()
    return sorted((r.language, r.text) for r in rows)


def segments(documents: DataFrame, dictionaries: dict[str, bytes] | None = None) -> DataFrame:
    """One row for each passage of documents(doc_id, lang, text) in one language.

    Gives its place (code points), words, language and confidence.  Defined results: a NULL
    text has no segments, a text without letters enough (empty, formulas) one segment of
    language und, confidence 0; a blank text none; equal texts get equal rows; without any
    labelled sample every text is told by dictionaries that know nothing, confidence .5 or
    less.  Extra columns are ignored.
    """
    made = fit(sample(documents)) if dictionaries is None else dictionaries
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text is not null").mapInArrow(_run(made), SEGMENTS)


def document_languages(segs: DataFrame) -> DataFrame:
    """Per document and language: words, share of the document's words, confidence."""
    per = segs.groupBy("doc_id", "language").agg(F.sum("n_words").alias("n_words"), (F.sum(F.col("confidence") * F.col("n_words")) / F.greatest(F.sum("n_words"), F.lit(1))).alias("confidence"))
    total = F.sum("n_words").over(Window.partitionBy("doc_id"))
    return per.withColumn("share", F.col("n_words") / F.greatest(total, F.lit(1)))


def p8_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return segments(spread(docs.select("doc_id", "text")), fit(sample(docs)))


def p8_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's languages with their share and a confidence."""
    return document_languages(p8_segments(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of a fifth of a document's words or more that its label doesn't name."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    told = document_languages(p8_segments(spark, sf_dir)).where((F.col("language") != "und") & (F.col("share") >= SHARE))
    labels = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), named_languages(F.col("lang")).alias("named"))
    return told.join(labels, "doc_id").where(~F.array_contains("named", F.col("language"))).select("doc_id", F.col("language").alias("found_lang")).distinct()
