"""Scalar text functions as Columns; Unicode letters and digits count wherever a class of characters is meant."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WORD = r"[\p{L}\p{N}_]+"
ALNUM = r"[\p{L}\p{N}]"
BLANK = r"[\s\x0B\x1C-\x1F\x85\xA0  -     　]"
BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"
# fixed values: thresholds and patterns of the published rules
SYMBOLS_ONLY = r"^[^\p{L}\p{N}_\s]{3,}$"
SEPARATOR = r"^\s*[-_=*#]{5,}\s*$"
PAGE_MARK = r"(?i)^Page\s+\d+\s+of\s+\d+$"
RUN_AT_START, RUN = r"(?i)^(.)\1{4,}", r"(.)\1{4,}"
ZERO_WIDTH = r"[​‌‍⁠﻿]"
MOJIBAKE = ["Â©", "Â®", "â„¢"]
GUJARATI = r"[\x{0A80}-\x{0AFF}]"


#: The characters of BLANK.
BLANKS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def strip(c: Column) -> Column:
    """Without white space at either end; tabs and Unicode spaces included."""
    return F.btrim(c, F.lit(BLANKS))


def split_lines(c: Column) -> Column:
    """Lines without their breaks; a break at the end starts no line, an empty text has none."""
    parts = F.split(c, BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def words(c: Column) -> Column:
    return F.filter(F.split(c, f"{BLANK}+", -1), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def alnum_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(ALNUM))


def noise_reason(line: Column, stripped: bool = False) -> Column:
    """Why a line is noise: the first rule that holds, null if none does."""
    s = line if stripped else strip(line)
    return (
        F.when(s == "", "blank")
        .when(s.rlike(SYMBOLS_ONLY), "symbols")
        .when(s.rlike(RUN_AT_START) | s.rlike(RUN), "run")
        .when(s.rlike(SEPARATOR), "separator")
        .when(s.rlike(PAGE_MARK), "page mark")
        .when(~s.rlike(ALNUM), "no letters")
    )


def is_noise(line: Column, stripped: bool = False) -> Column:
    return noise_reason(line, stripped).isNotNull()


def casefold(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


#: What NFKC may change: all but ASCII and the letters of U+00C0 to U+00FF, which it leaves alone unless a mark follows.
_UNSETTLED = r"[^\x00-\x7F\x{C0}-\x{FF}]"


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(c: Column) -> Column:
    """Unicode NFKC. Spark has no built-in for it, so texts that it may change, and no others, go through an Arrow function."""
    return F.coalesce(_nfkc(F.when(c.rlike(_UNSETTLED), c)), c)


def remove_artifacts(c: Column) -> Column:
    c = F.regexp_replace(c, ZERO_WIDTH, "")
    for bad in MOJIBAKE:
        c = F.replace(c, F.lit(bad), F.lit(""))
    return c


def normalize_whitespace(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(c, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n"))


def clean_line(c: Column, unicode: bool = False) -> Column:
    """Artifacts and outer white space removed; with unicode, after NFKC (which whole texts have behind them before they are cut)."""
    return strip(remove_artifacts(nfkc(c) if unicode else c))


def has_gujarati(c: Column) -> Column:
    return c.rlike(GUJARATI)


def text_score(text: Column) -> Column:
    """How good a reconstruction of a page's text looks; -1e9 for a blank one."""
    s = strip(text)
    lines = F.filter(split_lines(s), lambda x: strip(x) != "")
    one = F.size(F.filter(lines, lambda x: word_count(x) == 1))
    tiny = F.size(F.filter(lines, lambda x: F.length(x) <= 2))
    wide = F.regexp_count(s, F.lit("  "))
    score = alnum_count(s) + F.regexp_count(s, F.lit(WORD)) * 2.0 + F.size(lines) * 3.0 - one * 2.5 - tiny * 4.0 - wide * 0.5
    return F.when(s == "", F.lit(-1e9)).otherwise(score)


def looks_reasonable(text: Column) -> Column:
    s = strip(text)
    return (s != "") & ((alnum_count(s) >= 10) | (F.regexp_count(s, F.lit(WORD)) >= 3) | (F.length(s) >= 20))


def fast_accept(text: Column) -> Column:
    s = strip(text)
    lines = F.size(F.filter(split_lines(s), lambda x: strip(x) != ""))
    return looks_reasonable(s) & (lines <= 6) & (F.regexp_count(s, F.lit(WORD)) >= 5)


def ocr_score(text: Column, confidence: Column) -> Column:
    """Half confidence, the rest by readable and by Gujarati characters; 0 for blank text."""
    n = F.length(F.regexp_replace(text, BLANK, ""))
    guj = F.regexp_count(text, F.lit(GUJARATI))
    readable = guj + F.regexp_count(text, F.lit(r"[A-Za-z]")) + F.regexp_count(text, F.lit(r"\p{Nd}"))
    score = confidence * F.lit(0.5) + readable / n * F.lit(0.35) + guj / n * F.lit(0.15)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)) + F.lit(1e-9), 4))


def ocr_good(text: Column, confidence: Column) -> Column:
    s = strip(text)
    return (s != "") & (F.coalesce(confidence, F.lit(0.0)) >= 0.25) & ((F.length(s) >= 8) | (word_count(s) >= 2))


def sentence_ends(text: Column) -> Column:
    return text.rlike(r"[.!?\n।॥]$")


#: Frequent words by language, for texts of 20 characters and more; only their first 500 are read.
STOP_WORDS = {
    "en": "the of and to in is that it was for on are with as at be this have from or had by but not what all were we when your can said there which".split(),
    "fr": "le la les de des du et est en un une pour que qui dans sur avec pas plus par il au ne se ce sont aux cette mais".split(),
    "de": "der die das und ist in den von zu mit sich des auf für nicht ein eine dem im es auch als an werden aus er hat dass".split(),
    "es": "el la los las de y en que un una por con no es para del se al lo como más su pero sus este entre cuando muy sin".split(),
}


def _among(found: list[str]):
    return lambda w: w.isin(found)


def detect_language(text: Column) -> Column:
    """The language whose frequent words are most among the first 500 characters; "unknown" under 20 characters or without any."""
    s = strip(text)
    ws = words(F.lower(F.regexp_replace(F.substring(s, 1, 500), r"[^\p{L}\s]", " ")))
    scores = [F.struct(F.size(F.filter(ws, _among(v))).alias("n"), F.lit(-i).alias("o"), F.lit(k).alias("lang")) for i, (k, v) in enumerate(STOP_WORDS.items())]
    best = F.array_max(F.array(*scores))
    return F.when((F.length(s) < 20) | (best["n"] == 0), "unknown").otherwise(best["lang"])
