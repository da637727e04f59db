"""Naive Bayes support vectors: n-gram indicators scaled by class log-count ratios, hinge loss by dual coordinate descent."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.llm import words as W
from docengine.llm.store import table, tune

#: Hashed n-grams; the model is two arrays of this size, whatever the corpus.
BITS = 17
#: Labelled rows that the linear model is fitted on, at most about so many; the class counts use all labelled rows.
SAMPLE = 20_000
#: And of at most about so many characters together, as the fit is one task's.
SAMPLE_CHARS = 60_000_000
ALPHA, COST, EPOCHS = 1.0, 0.5, 12
_UPPER, _DIGIT, _PUNCT = (np.isin(np.arange(256), x) for x in (range(65, 91), range(48, 58), [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))


def features(texts: list[str | None]) -> list[np.ndarray]:
    """The distinct hashed features of each text: words (case and punctuation kept), word pairs, and one to
    three shapes in a row; a shape has a word's length, case, digits, marks, and whether it repeats the one before."""
    w = W.scan(texts, W.BY_SPACE, lower=False)
    raw = np.frombuffer(w.data, dtype=np.uint8)

    def count(mask: np.ndarray) -> np.ndarray:
        c = np.zeros(len(raw) + 1, dtype=np.int32)
        np.cumsum(mask[raw], out=c[1:])
        return c[w.end] - c[w.start]

    n = w.end - w.start
    upper, digit, punct = count(_UPPER), count(_DIGIT), count(_PUNCT)
    last = raw[np.maximum(w.end - 1, 0)].astype(np.uint64) if len(n) else np.zeros(0, np.uint64)
    ends = np.where(_PUNCT[last.astype(np.int64)] if len(n) else False, last, 0).astype(np.uint64)
    first = raw[w.start] if len(n) else np.zeros(0, np.uint8)
    again = np.zeros(len(n), dtype=np.uint64)
    if len(n) > 1:
        again[1:] = w.hash[1:] == w.hash[:-1]
        # a text's first word follows none, whatever text is read before it
        again[w.first[:-1][np.diff(w.first) > 0]] = 0
    shape = np.minimum(n, 15).astype(np.uint64)
    for part, most in ((upper, 2), (digit, 2), (punct, 3)):
        shape = shape * np.uint64(8) + np.minimum(part, most).astype(np.uint64)
    shape = ((shape * np.uint64(2) + (upper == n)) * np.uint64(2) + _UPPER[first] if len(n) else shape) * np.uint64(2) + again
    shape = W.mix(shape * np.uint64(128) + ends)
    h = w.hash
    fs, at = [h, W.mix(shape + np.uint64(11))], [np.arange(len(n))] * 2
    if len(n) > 1:
        fs += [W.mix(h[:-1] * np.uint64(3) + h[1:]), W.mix(shape[:-1] * np.uint64(5) + shape[1:])]
        at += [np.arange(len(n) - 1)] * 2
    if len(n) > 2:
        fs.append(W.mix(shape[:-2] * np.uint64(25) + shape[1:-1] * np.uint64(7) + shape[2:]))
        at.append(np.arange(len(n) - 2))
    owner = np.repeat(np.arange(len(texts)), np.diff(w.first))
    span = np.concatenate(at)
    key = np.concatenate([np.full(len(x), i) for i, x in enumerate(fs)])
    width = np.array([1, 1, 2, 2, 3])[key]
    inside = owner[span] == owner[np.minimum(span + width - 1, max(len(owner) - 1, 0))] if len(owner) else np.zeros(0, bool)
    idx = (np.concatenate(fs) >> np.uint64(64 - BITS)).astype(np.int64)
    flat = W.distinct((owner[span] << BITS | idx)[inside]) if len(owner) else np.zeros(0, np.int64)
    cut = np.searchsorted(flat, np.arange(len(texts) + 1) << BITS)
    return [(flat[cut[i] : cut[i + 1]] & ((1 << BITS) - 1)).astype(np.int32) for i in range(len(texts))]


def _counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros((2, 1 << BITS), dtype=np.int64)
    for frame in frames:
        texts, y = frame["text"].tolist(), frame["y"].to_numpy()
        for lo, hi in W.batches(texts):
            for i, f in enumerate(features(texts[lo:hi])):
                total[y[lo + i], f] += 1
    at = np.flatnonzero(total.any(axis=0))
    yield pd.DataFrame({"f": at.astype(np.int32), "neg": total[0, at], "pos": total[1, at]})


def _featurise(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Features of the sampled rows; of rows that a task reads more than once, one."""
    seen: set[tuple[int, int, bytes]] = set()
    for frame in frames:
        texts = frame["text"].tolist()
        for lo, hi in W.batches(texts):
            rows = []
            for doc_id, y, f in zip(frame["doc_id"].iloc[lo:hi], frame["y"].iloc[lo:hi], features(texts[lo:hi])):
                mark = (doc_id, y, hashlib.blake2b(f, digest_size=16).digest())
                if mark not in seen:
                    seen.add(mark)
                    rows.append((doc_id, y, f.tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "y", "fs"])


def ratios(neg: np.ndarray, pos: np.ndarray) -> np.ndarray:
    p, q = pos + ALPHA, neg + ALPHA
    return np.log((p / p.sum()) / (q / q.sum()))


def descend(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of the L1-loss support vector machine on x = scale of a row's features, of unit length."""
    w, bias = np.zeros(len(scale)), 0.0
    alpha = np.zeros(len(rows))
    xs = []
    for f in rows:
        v = scale[f]
        norm = np.sqrt(v @ v)
        xs.append(v / norm if norm > 0 else v)
    diag = np.array([x @ x + 1.0 for x in xs])
    rng = np.random.default_rng(7)
    for _ in range(EPOCHS):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            f, x = rows[i], xs[i]
            g = y[i] * (w[f] @ x + bias) - 1
            new = min(max(alpha[i] - g / diag[i], 0.0), COST)
            d = (new - alpha[i]) * y[i]
            if d:
                w[f] += d * x
                bias += d
                alpha[i] = new
                moved = max(moved, abs(d))
        if moved < 1e-3:
            break
    return w, bias


def _platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from margins to probabilities, by Newton steps."""
    a, b = 1.0, 0.0
    t = np.where(y > 0, (np.sum(y > 0) + 1) / (np.sum(y > 0) + 2), 1 / (np.sum(y <= 0) + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([np.sum((p - t) * margin), np.sum(p - t)])
        s = p * (1 - p) + 1e-9
        h = np.array([[np.sum(s * margin**2) + 1e-6, np.sum(s * margin)], [np.sum(s * margin), np.sum(s) + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return max(a, 1e-3), b


def _fit(scale: np.ndarray):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates().sort_values(["doc_id", "y", "fs"], kind="stable")
        rows = [np.frombuffer(b, dtype=np.int32) for b in frame["fs"]]
        y = np.where(frame["y"].to_numpy() > 0, 1.0, -1.0)
        if len(set(y)) < 2:
            return pd.DataFrame({"weights": [np.zeros(len(scale), np.float32).tobytes()], "bias": [0.0], "slope": [1.0], "offset": [4.0 * y[0]]})
        w, bias = descend(rows, y, scale)
        margin = np.array([m for f in rows for m in [w[f] @ scale[f] / max(np.sqrt(scale[f] @ scale[f]), 1e-12) + bias]])
        a, b = _platt(margin, y)
        return pd.DataFrame({"weights": [(w * scale).astype(np.float32).tobytes()], "bias": [bias], "slope": [a], "offset": [b]})

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """A model from the rows of `labels` (doc_id, quality 0 or 1) that have a document.

    Class counts are summed over all of them; the support vectors are found on a sample of about
    `sample` of them, and of SAMPLE_CHARS characters, chosen by a hash of doc_id; rows that are repeated count once there, and their order does not matter. What comes to the driver is 2 ** BITS counts and weights.
    Labels that are null or neither 0 nor 1 are passed over; several labels of a document count
    as their largest. No labels give a score of 0.5 to every text, labels of one class near 1 or near 0.
    """
    tune(docs.sparkSession)
    y = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    known = table(docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).join(y, "doc_id"), "labelled")
    n, chars = known.agg(F.count("*"), F.sum(F.coalesce(F.length("text"), F.lit(0)))).first()
    empty = np.zeros(1 << BITS)
    if not n:
        return {"scale": empty.astype(np.float32), "weights": empty.astype(np.float32), "bias": 0.0, "slope": 1.0, "offset": 0.0}
    got = known.mapInPandas(_counts, "f int, neg long, pos long").groupBy("f").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")).toPandas()
    neg, pos = empty.copy(), empty.copy()
    neg[got["f"]], pos[got["f"]] = got["neg"], got["pos"]
    scale = ratios(neg, pos)
    share = min(1.0, sample / n, SAMPLE_CHARS / max(chars, 1))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    some = chosen.mapInPandas(_featurise, "doc_id long, y int, fs binary")
    fit = some.groupBy(F.lit("all").alias("part")).applyInPandas(_fit(scale), "weights binary, bias double, slope double, offset double").first()
    return {"scale": scale.astype(np.float32), "weights": np.frombuffer(fit.weights, np.float32), **{k: fit[k] for k in ("bias", "slope", "offset")}}


def score(docs: DataFrame, model: dict, threshold: float = 0.3) -> DataFrame:
    """The rows of `docs`, with score (0 to 1, higher: label 1 likelier) and predicted (1 from `threshold` on).

    Only the text is read, whole; null counts as empty, whose score comes from the bias. Columns
    of those names are replaced.
    """
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        m = shared.value
        out, texts = np.empty(len(text)), text.tolist()
        for lo, hi in W.batches(texts):
            for i, f in enumerate(features(texts[lo:hi]), lo):
                v = m["scale"][f]
                margin = m["weights"][f].sum(dtype=np.float64) / max(np.sqrt(v @ v), 1e-12) + m["bias"]
                out[i] = 1 / (1 + np.exp(-np.clip(m["slope"] * margin + m["offset"], -30, 30)))
        return pd.Series(out)

    rest = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    out = docs.select(*rest, scored(F.col("text").cast("string")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(doc_id) -> Column:
    """Whether a row is kept from training: crc32 of doc_id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))
