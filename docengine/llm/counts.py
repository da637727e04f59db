"""Token counts of sections, from the offsets of whole documents' tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.llm import words as W
from docengine.llm.store import tune
from docengine.llm.tokens import encoder

UNITS = ("line", "sentence")
_BLANK, _END = np.array([9, 10, 13, 32]), np.frombuffer(b".!?", dtype=np.uint8)
RULES = ("first", "last", "most")


def attribute(start: np.ndarray, size: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token and whether it crosses a boundary.

    Sections are bounds[i]:bounds[i + 1] and tile the text. A token that meets several goes to that of its
    `first` byte, of its `last`, or to the one with `most` of its bytes, the earliest of equals.
    """
    lo = np.searchsorted(bounds, start, side="right") - 1
    hi = np.searchsorted(bounds, start + np.maximum(size, 1) - 1, side="right") - 1
    section = hi.copy() if rule == "last" else lo.copy()
    if rule == "most":
        for i in np.flatnonzero(hi > lo):
            cut = np.clip(bounds[lo[i] : hi[i] + 2], start[i], start[i] + size[i])
            section[i] = lo[i] + int(np.argmax(np.diff(cut)))
    return section, hi > lo


def cuts(raw: np.ndarray, unit: str) -> np.ndarray:
    """Where sections begin but for the first: after line feeds; for sentences also after the white space that follows an end mark."""
    new = raw == 10
    if unit == "sentence":
        new[1:] |= np.isin(raw[1:], _BLANK) & np.isin(raw[:-1], _END)
    after = np.flatnonzero(new) + 1
    return after[after < len(raw)]


def _count(path: str, rule: str, unit: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for frame in frames:
            texts, names = frame["text"].tolist(), frame["doc_id"]
            for lo, hi in W.batches(texts):
                e = enc.encode(texts[lo:hi], offsets=True)
                out: list[tuple] = []
                for d in range(hi - lo):
                    raw = np.frombuffer((texts[lo + d] or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
                    inner = cuts(raw, unit)
                    bounds = np.concatenate([[0], inner, [len(raw)]]).astype(np.int64)
                    a, b = e.first[d], e.first[d + 1]
                    section, crosses = attribute(e.at[a:b], e.size[a:b].astype(np.int64), bounds, rule)
                    n = len(bounds) - 1
                    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[bounds]
                    out.append((
                        np.full(n, lo + d), np.arange(n), chars[:-1], chars[1:], np.bincount(section, minlength=n)[:n], np.bincount(section[crosses], minlength=n)[:n]
                    ))
                cols = [np.concatenate(x) for x in zip(*out)]
                yield pd.DataFrame({"doc_id": names.iloc[cols[0]].to_numpy(), "section": cols[1], "first_char": cols[2], "end_char": cols[3], "n_tokens": cols[4], "n_crossing": cols[5]})

    return run


def by_section(docs: DataFrame, tokenizer: str, unit: str = "sentence", rule: str = "first") -> DataFrame:
    """One row per section (line or sentence) of every document: doc_id, section (from 0), first_char, end_char, n_tokens, n_crossing.

    Each whole text is encoded once (a byte-level vocabulary of the tokenizers library, special
    tokens' strings being ordinary text); its tokens' spans are merged with its sections' spans, both in order,
    so that nothing is shuffled. A line ends after its line feed, a sentence after the white space that follows its end mark as well. A token that meets several sections
    counts in one of them, by `rule` (see `attribute`), so a document's n_tokens add up to those of its whole text;
    n_crossing counts such tokens. A null or empty text is one empty section without tokens. Repeated
    rows and null doc_ids are counted like any others; other columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    tune(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInPandas(_count(tokenizer, rule, unit), "doc_id long, section int, first_char long, end_char long, n_tokens long, n_crossing long")
