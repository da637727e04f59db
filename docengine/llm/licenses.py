"""License scans by diagonal voting: word k-gram hashes joined to template positions, voted for by offset."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docengine.llm import words as W
from docengine.llm.licensetexts import BASE, TEMPLATES
from docengine.llm.store import table, tune

#: Words of a gram: for names and other short templates, and for those of LONG words and more.
SHORT_K, LONG_K, LONG = 2, 4, 12
#: Diagonals that differ by at most so much are one alignment with words put in or left out.
NEIGHBOUR = 3
#: The share of a long template's words that has to be found; short ones have to be whole.
SHARE = 0.8


@dataclass(frozen=True)
class Template:
    label: str
    base: bool
    words: tuple[bytes, ...]

    @property
    def k(self) -> int:
        return len(self.words) if self.base else LONG_K if len(self.words) >= LONG else SHORT_K

    @property
    def share(self) -> float:
        return SHARE if len(self.words) >= LONG and not self.base else 1.0

    @property
    def need(self) -> int:
        """Fewest votes of an alignment that can pass: none covers more than k words."""
        return -(-int(np.ceil(self.share * len(self.words))) // self.k)


def _templates(base: dict[str, str], more: dict[str, list[str]]) -> list[Template]:
    out = []
    for label, is_base, text in [(x, True, t) for x, t in sorted(base.items())] + [(x, False, t) for x, ts in sorted(more.items()) for t in ts]:
        w = W.scan([text], W.ALNUM)
        out.append(Template(label, is_base, tuple(w.word(i) for i in range(len(w.hash)))))
        if len(out[-1].words) < 2:
            raise ValueError("a template needs two words at least")
    return out


def _positions(spark: SparkSession, templates: list[Template]) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """(gram, template, tpos) of every template, and the distinct grams by k."""
    rows, grams = [], defaultdict(list)
    for i, t in enumerate(templates):
        h, _ = W.grams(W.scan([b" ".join(t.words).decode()], W.ALNUM), t.k)
        rows += [(int(x), i, j) for j, x in enumerate(h.view(np.int64))]
        grams[t.k].append(h)
    return spark.createDataFrame(rows, "gram long, template int, tpos int"), {k: W.distinct(np.concatenate(h)) for k, h in grams.items()}


def _grams(known: dict[int, np.ndarray]):
    """The rolling grams of every text that occur in a template at all, with their places; the text goes along where there are any."""
    marks = {}
    for k, h in known.items():
        marks[k] = np.zeros(1 << 16, dtype=bool)
        marks[k][h >> np.uint64(48)] = True

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts, rows, names = frame["text"].tolist(), frame["row"], frame["doc_id"]
            for lo, hi in W.batches(texts):
                w = W.scan(texts[lo:hi], W.ALNUM)
                owner, place, gram = [], [], []
                for k, h in known.items():
                    all_, of = W.grams(w, k)
                    at = np.flatnonzero(marks[k][all_ >> np.uint64(48)])
                    at = at[h[np.minimum(np.searchsorted(h, all_[at]), len(h) - 1)] == all_[at]]
                    first = np.searchsorted(of, np.arange(hi - lo))
                    owner.append(of[at])
                    place.append(at - first[of[at]])
                    gram.append(all_[at])
                owner, place, gram = (np.concatenate(x) for x in (owner, place, gram))
                order = np.argsort(owner, kind="stable")
                cut = np.searchsorted(owner[order], np.arange(hi - lo + 1))
                place, gram = place[order].astype(np.int32), gram[order].view(np.int64)
                some = [slice(a, b) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
                yield pd.DataFrame({
                    "row": rows.iloc[lo:hi].to_numpy(), "doc_id": pd.array(names.iloc[lo:hi], dtype="Int64"), "n_words": np.diff(w.first),
                    "text": [t if s.stop > s.start else None for t, s in zip(texts[lo:hi], some)], "pos": [place[s] for s in some], "gram": [gram[s] for s in some],
                })

    return run


def align(have: list[bytes], want: tuple[bytes, ...], k: int) -> int:
    """The most words of `want` that grams on neighbouring diagonals of `have` cover, in order: each gram carries on the best
    alignment that ends before it on a diagonal at most NEIGHBOUR away."""
    at = defaultdict(list)
    for j in range(len(want) - k + 1):
        at[want[j : j + k]].append(j)
    best: dict[int, tuple[int, int]] = {}  # by diagonal: words covered, place of the last gram in `want`
    most = 0
    for i in range(len(have) - k + 1):
        for j in at.get(tuple(have[i : i + k]), ()):
            covered = k
            for d in range(i - j - NEIGHBOUR, i - j + NEIGHBOUR + 1):
                before = best.get(d)
                if before and before[1] < j and before[1] + d < i:
                    covered = max(covered, before[0] + min(k, j - before[1]))
            if covered >= best.get(i - j, (0, 0))[0]:
                best[i - j] = covered, j
            most = max(most, covered)
    return most


def _verify(templates: list[Template]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row, text, spans in zip(frame["row"], frame["text"], frame["spans"]):
                w = W.scan([text], W.ALNUM)
                n = len(w.hash)
                places, labels = set(), defaultdict(float)
                for s in spans:
                    t = templates[s["template"]]
                    lo, hi = max(0, int(s["first"])), min(n, int(s["last"]))
                    have = [w.word(i) for i in range(lo, hi)]
                    if t.base:
                        if tuple(have) == t.words:
                            places.add((lo, t.label))
                        continue
                    share = align(have, t.words, t.k) / len(t.words)
                    if share >= t.share:
                        labels[t.label] = max(labels[t.label], share)
                base = {label for _, label in places}
                best = max([0.0, *labels.values(), *(1.0 for _ in base)])
                if best:
                    at = [p for p, _ in places]
                    out.append((row, len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | set(labels))), best))
            yield pd.DataFrame(out, columns=["row", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]).astype(
                {"row": "int64", "n_base": "int64", "first_word": "Int64", "last_word": "Int64"}
            )

    return run


def scan(docs: DataFrame, base: dict[str, str] = BASE, more: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are runs of letters, digits and non-ASCII characters after A-Z are lower-cased. Base
    phrases count wherever their words stand in a row (n_base, smallest and largest start, labels).
    A template of `more` (names, notices, whole texts) gives its label where an alignment of neighbouring diagonals covers its
    words in order: all of them for a template under LONG words, with at most NEIGHBOUR words put in at a
    place, else a share of SHARE. score is the best share of words found, 1 for a base phrase, 0 for none. Null and
    empty texts have no words, n_base 0, null places, empty labels and score 0; a null doc_id is scanned like any other;
    repeated rows each get their own result. Columns other than doc_id and text are ignored; an empty table gives no rows. Templates need two words at least.

    Python reads each whole text once, for its words and rolling grams; of these only ones that occur in some template leave it, as
    no others can meet the table of template positions in the join (a fixed table, broadcast). What has a hit
    keeps its text for the last check; other texts are not moved. Hits are grouped by row, never by template, so common passages stay spread.
    """
    tune(docs.sparkSession)
    templates = _templates(base, more)
    positions, known = _positions(docs.sparkSession, templates)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    read = table(source.mapInPandas(_grams(known), "row long, doc_id long, n_words long, text string, pos array<int>, gram array<long>"), "grams")
    grams = read.where("text IS NOT NULL").select("row", F.explode(F.arrays_zip("pos", "gram")).alias("g")).select("row", "g.pos", "g.gram")
    hits = grams.join(F.broadcast(positions), "gram").select("row", "template", "pos", "tpos")
    diagonals = (
        hits.withColumn("diagonal", F.col("pos") - F.col("tpos"))
        .groupBy("row", "template", "diagonal")
        .agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.count_distinct("tpos").alias("votes"))
    )
    of = lambda f: F.create_map(*[F.lit(x) for i, t in enumerate(templates) for x in (i, f(t))])[F.col("template")]
    is_base, length = F.col("template") < len(base), of(lambda t: len(t.words))
    exact = diagonals.where(is_base).select("row", "template", F.col("diagonal").alias("first"), (F.col("diagonal") + length).alias("last"))
    by = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by) > NEIGHBOUR).cast("int"), F.lit(0))
    merged = (
        diagonals.where(~is_base)
        .withColumn("apart", apart)
        .withColumn("run", F.sum("apart").over(by))
        .groupBy("row", "template", "run")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("votes").alias("votes"))
        # positions that several diagonals vote for count more than once here, so this drops none that can pass
        .where(F.col("votes") >= of(lambda t: t.need))
        .select("row", "template", F.col("lo").alias("first"), (F.col("hi") + of(lambda t: t.k)).alias("last"))
    )
    spans = exact.unionByName(merged).groupBy("row").agg(F.collect_list(F.struct("template", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))).alias("spans"))
    spans = table(spans, "spans")
    candidates = read.where("text IS NOT NULL").select("row", "text").join(spans, "row")
    found = candidates.mapInPandas(_verify(templates), "row long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
    return read.select("row", "doc_id", "n_words").join(found, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
