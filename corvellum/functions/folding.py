"""The comparable form of texts: quotes, dashes and dots unified, compatibility forms and case
folded character by character, white space collapsed, with the place each character is from.

Texts of an Arrow batch are one array of code points.  A flat table gives every code point its
expansion, so folding is a gather; which blanks stay is a mask over the whole array.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corvellum.functions.rolling import code_points, slices

# Quotes, dashes and dots that count as one.
UNIFIED = {"‘": "'", "’": "'", "‚": "'", "′": "'", "“": '"', "”": '"', "„": '"', "″": '"', "‒": "-", "–": "-", "—": "-", "−": "-", "…": "..."}
#: No code point from here on changes when folded.
_ASSIGNED = 0x32400


@lru_cache(1)
def _expansions() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each code point how many it becomes and where they begin; all of them; blanks."""
    size = np.ones(0x110000, np.int64)
    begin = np.arange(0x110000)
    blank = np.zeros(0x110000, bool)
    more: list[int] = []
    for code in range(_ASSIGNED):
        char = chr(code)
        blank[code] = char.isspace()
        form = unicodedata.normalize("NFKC", UNIFIED.get(char, char)).casefold()
        if form != char:
            size[code], begin[code] = len(form), 0x110000 + len(more)
            more.extend(map(ord, form))
    flat = np.concatenate([np.arange(0x110000), np.array(more, np.int64)])
    return size, begin, flat, blank


def fold_many(texts: Sequence[str]) -> tuple[list[str], list[np.ndarray]]:
    """Each text's comparable form, and the place in the text each of its characters is from.

    Characters are folded one by one, so combining marks are not composed.
    """
    size, begin, flat, blank = _expansions()
    forms: list[str] = []
    places: list[np.ndarray] = []
    for i, j in slices(texts):
        cp = code_points("".join(texts[i:j]))
        length = np.fromiter(map(len, texts[i:j]), np.int64, j - i)
        owner = np.repeat(np.arange(j - i), length)
        grown = size[cp]
        source = np.repeat(np.arange(len(cp)), grown)
        out = flat[begin[cp[source]] + np.arange(len(source)) - np.repeat(np.cumsum(grown) - grown, grown)]
        of = owner[source]
        is_blank = blank[out]
        out = np.where(is_blank, 32, out)
        # Of a run of blanks the first stays, if letters of the same text stand on both sides.
        letters = np.concatenate([[0], np.cumsum(~is_blank)])
        ends = np.searchsorted(of, np.arange(j - i + 1))
        before = letters[:-1] > letters[ends[of]]
        after = letters[ends[of + 1]] > letters[1:]
        opens = np.ones(len(out), bool)
        opens[1:] = ~is_blank[:-1]
        kept = np.flatnonzero(~is_blank | (opens & before & after))
        whole = out[kept].astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
        cut = np.searchsorted(of[kept], np.arange(j - i + 1))
        first = np.cumsum(length) - length
        for k, (a, b) in enumerate(zip(cut[:-1], cut[1:])):
            forms.append(whole[a:b])
            places.append(source[kept[a:b]] - first[k])
    return forms, places


@F.pandas_udf(StringType())
def fold(text: pd.Series) -> pd.Series:
    """The comparable form of a text; NULL for NULL."""
    there = text.notna()
    forms, _ = fold_many(text[there].tolist())
    return pd.Series(forms, index=text.index[there], dtype=object).reindex(text.index).where(there, None)
