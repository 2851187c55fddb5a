"""Broken prompt and response pairs (problem 5).

For every kind of defect several labelling functions vote for it, against it, or abstain.
No function is trusted as such: an expectation-maximisation label model over the counts of
vote patterns learns how often each errs, and gives every pattern a posterior.  A pair
keeps every label whose posterior exceeds the cutoff.

Votes need only the pair itself, but for two statistics over all pairs: how many questions
an opening sentence answers, and dictionaries of the languages, made of a bounded sample.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from corvellum.llm.language import LANGUAGES, Classifier, fit, plain, sentences

DEFECTS = ("empty", "copy", "refusal", "language", "truncated")
#: Posterior above which a label is kept.  On hand-checked pairs of the test tables the
#: posteriors of patterns lie below .2 or above .9.
CUTOFF = 0.5
#: Questions that one opening sentence must answer to be called a stock phrase.
STOCK = 3
#: Questions per language that the dictionaries are made of, at most.
SAMPLE = 400

# Answers that only fill a field.
FILLERS = frozenset(("", "n a", "na", "none", "null", "nil", "nan", "undefined", "unknown", "todo", "tbd", "tba", "xxx", "answer", "no answer", "answer here", "your answer", "insert answer", "placeholder", "blank", "empty", "no response", "response", "lorem ipsum", "missing", "not available", "not applicable", "ka", "k a", "s o", "nd", "sin respuesta", "keine antwort", "sans reponse", "nessuna risposta", "sem resposta"))
# Function words that tell the languages apart.
FUNCTION_WORDS = {
    "de": "der die das und ist nicht von zu mit den dem des ein eine einen wird wurde werden dass bei für auf als auch sich wie welche warum sind nach aus wenn nur aber oder über durch noch zwar was kann im am ob",
    "en": "the and is of to in that with for on as by are was were which what how why does did do it this from at be or an not each every we when only whether has have there you i",
    "es": "el los las y es que con para por una del se no más como cuál qué cómo cuando según pero también su sus al lo fue sin entre sobre cuánto está son aunque muy ha",
    "fr": "le les et est que avec pour par une des du ne pas plus comme quel quelle comment pourquoi lorsque selon mais aussi sur dans ce cette au aux été sans sont qui on la nous il",
    "it": "il gli e è che con per una del della dei delle non più come quale perché quando secondo ma anche sono nel nella di è stato senza al alla lo da si dal questo i",
    "pt": "o os as e é que com para por uma do da dos das não mais como qual porque quando segundo mas também se no na ao foi sem são em um pelo pela isso à",
}
# Turns of phrase by which an answer is declined.
CUES = re.compile(
    r"\b(?:can ?not|can['’]t|unable|not able|could ?n[o'’]t|could not|wo n['’]?t|won['’]t|decline|declining|rather not|prefer not|(?:do not|don['’]t) (?:know|have)|no idea|not possible|impossible"
    r"|isn['’]t possible|beyond my|outside (?:what|my|the)|(?:not|isn['’]t) covered|no (?:paper|information|answer|reply|data|evidence|basis)|nothing|(?:do|does)(?: not|n['’]t) (?:contain|cover|mention|say|address)|not enough|insufficient|must pass|no comment|refuse"
    r"|as an? (?:assistant|ai|language model)|(?:sorry|apologi[sz]e)"
    r"|kann(?: ich)? .{0,60}nicht|kann keine|nicht beantworten|nicht helfen|weiß (?:ich|es) .{0,20}nicht|weiß ich nicht|keine (?:information|angabe|aussage|antwort|auskunft)\w*|nicht enthalten|möchte ich .{0,30}nicht|nicht äußern|nicht eingehen|steht dazu nichts|dazu nichts|nicht möglich|tut mir leid|bedaure|muss .{0,30}passen|leider"
    r"|je ne (?:peux|sais|dispose|suis|puis|saurais)|ne (?:contiennent|contient|permet|permettent|figure)|n['’]ai pas|pas couvert|pas possible|préfère ne pas|impossible|aucun(?:e)? (?:passage|extrait|information|réponse|article|document)|désolée?|malheureusement"
    r"|no (?:puedo|sé|lo sé|dispongo|contienen|contiene|tengo|es posible|está cubierto|hay)|lo siento|disculpe|prefiero no|ningún (?:pasaje|fragmento|artículo|documento)|lamentablemente|imposible"
    r"|non (?:posso|so|lo so|dispongo|contengono|contiene|ho|è possibile|è coperto)|mi dispiace|preferisco non|nessun(?: passaggio|a informazione)|purtroppo|impossibile"
    r"|não (?:posso|sei|disponho|contêm|contém|tenho|é possível|está coberto|há)|lamento|desculpe|prefiro não|nenhum(?:a)?|infelizmente|impossível)",
    re.I,
)
# Turns of phrase of the advice that may follow.
ADVICE = re.compile(r"\b(?:try|you (?:may|might|can|could)|if you|please|feel free|let me know|bitte|versuchen sie|sie können|wenn sie|essayez|vous pouvez|si vous|veuillez|pruebe|puede|si usted|intente|por favor|provi|prova|può|se vuole|tente|experimente|pode|se quiser)\b", re.I)
# Words that announce more, at whose end no text stops.
DANGLING = frozenset("e.g. i.e. al. fig. figs. sec. eq. tab. cf. vs. bzw. z.b. d.h. vgl. abb. usw.: p.ej. ex.".split())

_WORD = re.compile(r"[^\W_]+")
_INVISIBLE = re.compile("[­​-‏⁠-⁤﻿]")
_SOURCE = re.compile(r"\s*[\[(]\s*(?:p|pp|s|pág|pag|page)\.?\s*\d+(?:\s*[-–]\s*\d+)?\s*[\])]\.?\s*$", re.I)
_ITEM = re.compile(r"\s*(?:[-*•–·]|\d+[.)])\s+\S")
_CLOSED = re.compile(r"[.!?。][\"'”’»)\]]*$")
_PLACE = re.compile(r"^[\[<{(][^\n]{0,40}[\]>})]$")
_KNOWN = {lang: frozenset(words.split()) for lang, words in FUNCTION_WORDS.items()}


def spoken(words: list[str]) -> str | None:
    """The language whose function words stand out in a text, if any does."""
    hits = sorted(((sum(w in known for w in words), lang) for lang, known in _KNOWN.items()), reverse=True)
    (first, lang), (second, _) = hits[:2]
    return lang if first >= 2 and first >= second + max(1, first // 3) else None


class Votes:
    """All votes on one pair: +1 for, -1 against, 0 abstained, in a fixed order per defect."""

    def __init__(self, question: str, answer: str | None, stock: int):
        self.text = _INVISIBLE.sub("", answer or "").strip()
        self.words = _WORD.findall(self.text.casefold())
        self.asked = _WORD.findall(question.casefold())
        self.names = {w for w in _WORD.findall(question)[1:] if len(w) >= 6 and w[0].isupper()}
        self.stock = stock
        self.parts = [self.text[a:b] for a, b in sentences(self.text)]

    def empty(self) -> list[int]:
        filler = " ".join(self.words) in FILLERS
        return [
            1 if not self.words else 0,
            1 if filler and len(self.words) <= 3 else 0,
            1 if _PLACE.match(self.text) and len(self.words) <= 4 and not any(w in self.asked for w in self.words) else 0,
            -1 if self.words and not filler and not _PLACE.match(self.text) else 0,
        ]

    def copy(self) -> list[int]:
        q, a = "".join(self.asked), "".join(self.words)
        left = a.replace(q, "") if q else a
        new = [w for w in self.words if w not in set(self.asked)]
        return [
            1 if len(self.asked) > 3 and q in a and len(left) <= max(12, len(q) // 10) else 0,
            1 if len(self.words) >= 4 and len(new) <= 1 and len(set(self.words)) >= 0.8 * len(set(self.asked)) else 0,
            -1 if len(new) >= 4 else 0,
            -1 if len(set(self.words)) < 0.6 * len(set(self.asked)) else 0,
        ]

    def refusal(self) -> list[int]:
        def content(part: str) -> bool:
            words = _WORD.findall(part)
            if CUES.search(part):
                return False
            return any(c.isdigit() for c in part) or any(w in self.names for w in words) or len(words) > 5 and not ADVICE.search(part)

        cue = bool(self.parts) and CUES.search(self.parts[0]) is not None
        rest = any(content(p) for p in self.parts)
        digits = any(c.isdigit() for c in self.text)
        return [
            1 if cue and not rest and not digits else 0,
            1 if self.stock >= STOCK and len(self.words) >= 3 and not rest and not digits else 0,
            1 if self.parts and all(CUES.search(p) for p in self.parts) and not digits else 0,
            -1 if rest else 0,
            -1 if self.parts and not any(CUES.search(p) for p in self.parts) and self.stock < STOCK else 0,
            -1 if len(self.words) < 3 else 0,
        ]

    def truncated(self) -> list[int]:
        text = self.text
        sourced = _SOURCE.search(text) is not None
        body = _SOURCE.sub("", text).rstrip()
        last = body.rsplit("\n", 1)[-1]
        item = _ITEM.match(last) is not None
        tail = body.rsplit(None, 1)[-1] if body else ""
        closed = _CLOSED.search(body) is not None and not body.endswith(("...", "…"))
        dangling = tail.casefold().lstrip("(") in DANGLING
        short = len(self.words) <= 2 or not re.search(r"[^\W\d_]", text)
        opened = body.count("(") > body.count(")")
        return [
            1 if not closed and not short and not item else 0,
            1 if dangling or body.endswith((",", "(", ";", "-", "…", "...")) and len(self.words) > 2 else 0,
            1 if opened and not item and not short else 0,
            -1 if closed and not dangling and not opened else 0,
            -1 if item and not opened and not body.endswith((",", "(", "…")) else 0,
            -1 if short else 0,
            -1 if sourced and not dangling else 0,
        ]

    def language(self, mine: int, theirs: int, lead: float) -> list[int]:
        """mine, theirs: languages by compression, -1 if narrow; lead: bytes a word."""
        a, q = spoken(self.words), spoken(self.asked)
        enough = len(self.words) >= 4
        return [
            1 if enough and a and q and a != q else 0,
            1 if enough and mine >= 0 and theirs >= 0 and mine != theirs and lead >= 1 else 0,
            -1 if enough and a and a == q else 0,
            -1 if enough and mine >= 0 and mine == theirs else 0,
            -1 if not enough else 0,
        ]


def _by_compression(c: Classifier, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    sizes = c.sizes([plain(t).encode() for t in texts])
    two = np.partition(sizes, 1, axis=1)[:, :2] if len(texts) else np.zeros((0, 2))
    sure = two[:, 1] - two[:, 0] >= np.maximum(2, 0.04 * two[:, 0])
    return np.where(sure, sizes.argmin(axis=1), -1), sizes


def _vote(dictionaries: dict[str, bytes]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Classifier(dictionaries)
        for batch in batches:
            questions, answers, stocks = (batch.column(n).to_pylist() for n in ("question", "answer", "stock"))
            asked, _ = _by_compression(c, questions)
            told, sizes = _by_compression(c, [a or "" for a in answers])
            columns: dict[str, list[str]] = {d: [] for d in DEFECTS}
            for i, (q, a, n) in enumerate(zip(questions, answers, stocks)):
                v = Votes(q, a, n)
                lead = (sizes[i, asked[i]] - sizes[i, told[i]]) / max(1, len(v.words)) if asked[i] >= 0 and told[i] >= 0 else 0.0
                for d in DEFECTS:
                    got = v.language(told[i], asked[i], lead) if d == "language" else getattr(v, d)()
                    columns[d].append("".join("-0+"[x + 1] for x in got))
            yield pa.RecordBatch.from_arrays([batch.column("pair_kind"), batch.column("pair_id"), batch.column("declining_is_right"), *(pa.array(columns[d], pa.string()) for d in DEFECTS)], ["pair_kind", "pair_id", "declining_is_right", *DEFECTS])

    return run


def label_model(counts: dict[str, int], rounds: int = 50) -> dict[str, float]:
    """Posterior of every vote pattern, given how many pairs have each.

    Every function's rates of voting for, against and not at all, with and without the
    defect, are learned; they start at what a function is written for, and weak priors keep
    a function that never erred in few pairs from being taken for infallible.  Abstaining
    says nothing by itself: a pair on which all abstain keeps the prior.
    """
    if not counts:
        return {}
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], float)
    votes = np.array([["-0+".index(v) for v in p] for p in patterns])  # 0 against, 1 none, 2 for
    rate = np.empty((2, votes.shape[1], 3))
    rate[1], rate[0] = (0.04, 0.46, 0.5), (0.5, 0.49, 0.01)
    start = rate.copy()
    prior = 0.05
    post = np.zeros(len(patterns))
    for _ in range(rounds):
        like = [np.where(votes != 1, np.log(rate[y][np.arange(votes.shape[1]), votes]), 0).sum(axis=1) for y in (0, 1)]
        post = 1 / (1 + np.exp(np.clip(like[0] + np.log(1 - prior) - like[1] - np.log(prior), -500, 500)))
        for y, weight in ((1, n * post), (0, n * (1 - post))):
            for v in range(3):
                rate[y, :, v] = ((votes == v) * weight[:, None]).sum(axis=0)
            strength = 10 + 0.02 * weight.sum()
            rate[y] = (rate[y] + strength * start[y]) / (weight.sum() + strength)
        prior = float(np.clip((n * post).sum() / n.sum(), 1e-4, 0.5))
    return dict(zip(patterns, map(float, post)))


def pattern_counts(voted: DataFrame) -> dict[str, dict[str, int]]:
    """Pairs per vote pattern of each defect; there are at most 3**7 patterns of one."""
    stacked = "stack({}, {}) as (defect, votes)".format(len(DEFECTS), ", ".join(f"'{d}', `{d}`" for d in DEFECTS))
    rows = voted.selectExpr(stacked).groupBy("defect", "votes").count().collect()
    counts: dict[str, dict[str, int]] = {d: {} for d in DEFECTS}
    for r in rows:
        counts[r.defect][r.votes] = r["count"]
    return counts


def sample_dictionaries(pairs: DataFrame, per_language: int = SAMPLE) -> dict[str, bytes]:
    """Language dictionaries of a bounded sample of questions and answers, told by their
    function words: the first per_language texts of each language by a hash."""
    words = {lang: sorted(w for w in known if sum(w in k for k in _KNOWN.values()) == 1) for lang, known in _KNOWN.items()}
    texts = pairs.select(F.explode(F.array("question", "answer")).alias("text")).where("text is not null").distinct()
    tokens = texts.select("text", F.split(F.lower("text"), r"[^\p{L}]+").alias("w"))
    score = [F.struct(F.size(F.array_intersect("w", F.array(*map(F.lit, words[x])))).alias("n"), F.lit(x).alias("l")) for x in LANGUAGES]
    best = tokens.select("text", F.array_sort(F.array(*score)).alias("s")).where("s[5].n >= 4 and s[4].n <= 1").select("text", F.col("s")[5]["l"].alias("language"))
    nth = F.row_number().over(Window.partitionBy("language").orderBy(F.xxhash64("text"), "text"))  # cut off before its shuffle
    chosen = best.withColumn("nth", nth).where(F.col("nth") <= per_language)
    return fit([(r.language, r.text) for r in chosen.collect()])


def _opening(answer: F.Column) -> F.Column:
    """Hash of an answer's first sentence, letters only."""
    first = F.regexp_extract(F.trim(answer), r"(?s)^(.*?[.!?](?=\s|$)|.*)", 1)
    return F.xxhash64(F.regexp_replace(F.lower(first), r"[^\p{L}]+", " "))


class DefectivePairs:
    """Labels pairs(pair_kind, pair_id, question, answer, declining_is_right).

    Defined results: pairs with a NULL question or key are left out; a NULL answer is empty;
    repeated rows of a key count once (the greatest answer, should they differ); other
    columns are ignored; an empty table gives no labels.
    """

    def __init__(self, pairs: DataFrame):
        rows = pairs.where("question is not null and pair_id is not null").groupBy("pair_kind", "pair_id").agg(F.max(F.struct("answer", "question", F.coalesce("declining_is_right", F.lit(False)).alias("declining_is_right"))).alias("x")).select("pair_kind", "pair_id", "x.*")
        rows = rows.withColumn("opening", _opening(F.col("answer")))
        stock = rows.groupBy("opening").agg(F.count_distinct(F.xxhash64("question")).alias("stock")).where(F.col("stock") >= STOCK)
        rows = rows.join(stock, "opening", "left").withColumn("stock", F.coalesce("stock", F.lit(0)).cast("int"))
        made = sample_dictionaries(rows)
        kinds = ", ".join(f"{d} string" for d in DEFECTS)
        self.voted = rows.select("pair_kind", "pair_id", "declining_is_right", "question", "answer", "stock").mapInArrow(_vote(made), f"pair_kind string, pair_id string, declining_is_right boolean, {kinds}").persist(StorageLevel.DISK_ONLY)
        self.posteriors = {d: label_model(c) for d, c in pattern_counts(self.voted).items()}

    def labels(self) -> DataFrame:
        """(pair_kind, pair_id, defect, posterior) of every label over the cutoff."""
        spark = self.voted.sparkSession
        rows = [(d, p, x) for d, got in self.posteriors.items() for p, x in got.items() if x > CUTOFF]
        table = F.broadcast(spark.createDataFrame(rows, "defect string, votes string, posterior double"))  # at most 5 * 3**7 rows
        stacked = "stack({}, {}) as (defect, votes)".format(len(DEFECTS), ", ".join(f"'{d}', `{d}`" for d in DEFECTS))
        long = self.voted.selectExpr("pair_kind", "pair_id", "declining_is_right", stacked)
        return long.join(table, ["defect", "votes"]).select("pair_kind", "pair_id", "declining_is_right", "defect", "posterior")

    def main_defect(self) -> DataFrame:
        """The one defect of a pair, the first of DEFECTS it is labelled with; declining is
        none where it is right, and leaves what else is wrong with the answer."""
        rank = F.array_position(F.array(*map(F.lit, DEFECTS)), F.col("defect"))
        wrong = self.labels().where("not (declining_is_right and defect = 'refusal')")
        return wrong.groupBy("pair_kind", "pair_id").agg(F.min_by("defect", rank).alias("defect"))


def library_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = F.coalesce(F.col("category") == "unanswerable", F.lit(False)).alias("declining_is_right")
    rows = spark.read.parquet(f"{sf_dir}/route_rows.parquet").select(F.lit("answer").alias("pair_kind"), F.col("thread_id").alias("pair_id"), "question", "answer", right)
    golden = spark.read.parquet(f"{sf_dir}/golden.parquet").select(F.lit("ground_truth").alias("pair_kind"), F.col("id").alias("pair_id"), "question", F.col("ground_truth").alias("answer"), right)
    return rows.unionByName(golden)


def p5_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every label of every pair, with its posterior."""
    return DefectivePairs(library_pairs(spark, sf_dir)).labels().drop("declining_is_right")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DefectivePairs(library_pairs(spark, sf_dir)).main_defect()
