"""MinHash near-dedup: universal hash minima, banding, signature and exact verification, components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from docengine.llm import words as W
from docengine.llm.components import components
from docengine.llm.store import among, apart, table, tune

#: Chance that the banding misses a pair exactly at the threshold.
MISS = 1e-6
#: Pivots that a bucket is compared with before what is left of it is listed.
PIVOTS = 2
_BLOCK = 1 << 15


def bands_for(threshold: float, rows: int = 5, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multiply-shift: the upper half of a * x + b over 64 bits is strongly universal for 32-bit x."""
    draw = np.random.default_rng(20240229).integers(0, 2**64, size=(2, n), dtype=np.uint64)
    return draw[0] | np.uint64(1), draw[1]


def minima(hashes: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """(texts, n) minima as uint32; text d has hashes first[d]:first[d + 1], none of them empty."""
    a, b = _family(n)
    out = np.full((n, len(first) - 1), np.iinfo(np.uint64).max, dtype=np.uint64)
    x = hashes >> np.uint64(32)
    scratch = np.empty(_BLOCK, dtype=np.uint64)
    for lo in range(0, len(x), _BLOCK):
        hi = min(lo + _BLOCK, len(x))
        d0 = int(np.searchsorted(first, lo, side="right")) - 1
        d1 = int(np.searchsorted(first, hi, side="left"))
        cuts = np.maximum(first[d0:d1], lo) - lo
        part, s = x[lo:hi], scratch[: hi - lo]
        for i in range(n):
            np.multiply(part, a[i], out=s)
            np.add(s, b[i], out=s)
            np.minimum(out[i, d0:d1], np.minimum.reduceat(s, cuts), out=out[i, d0:d1])
    return (out.T >> np.uint64(32)).astype(np.uint32)


def _shingles(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each text, and where each text's begin."""
    h, owner = W.grams(W.scan(texts, W.BY_SPACE), k)
    cut = np.searchsorted(owner, np.arange(len(texts) + 1))
    parts = [W.distinct(h[cut[i] : cut[i + 1]]) for i in range(len(texts))]
    first = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(p) for p in parts], out=first[1:])
    return (np.concatenate(parts) if parts else h), first


def _marks(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each text's set, whatever its order; 0 for an empty one."""
    full = np.flatnonzero(np.diff(first))
    out = np.zeros((2, len(first) - 1), dtype=np.uint64)
    if len(full):
        for row, salt in zip(out, (0, 0x5851F42D4C957F2D)):
            row[full] = np.add.reduceat(W.mix(h ^ np.uint64(salt)), first[full])
    return out[0], out[1]


def _sign(shingle: int, bands: int, rows: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts, ids = frame["text"].tolist(), frame["id"]
            for lo, hi in W.batches(texts):
                h, first = _shingles(texts[lo:hi], shingle)
                size = np.diff(first)
                full = np.flatnonzero(size)
                sig = np.zeros((hi - lo, bands * rows), dtype=np.uint32)
                one, two = _marks(h, first)
                if len(full):
                    sig[full] = minima(h, np.append(first[full], len(h)), bands * rows)
                keys = np.zeros((hi - lo, bands), dtype=np.uint64)
                for b in range(bands):
                    acc = np.full(hi - lo, b + 1, dtype=np.uint64)
                    for r in range(rows):
                        acc = W.mix(acc * np.uint64(31) + sig[:, b * rows + r])
                    keys[:, b] = acc
                yield pd.DataFrame({
                    "id": ids.iloc[lo:hi].to_numpy(), "n": size, "f1": one.view(np.int64), "f2": two.view(np.int64),
                    "sig": [r.tobytes() for r in sig], "keys": list(keys.view(np.int64)),
                })

    return run


def _sets(shingle: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts, ids = frame["text"].tolist(), frame["id"].to_numpy()
            for lo, hi in W.batches(texts):
                h, first = _shingles(texts[lo:hi], shingle)
                one, two = _marks(h, first)
                yield pd.DataFrame({
                    "id": ids[lo:hi], "items": [h[first[i] : first[i + 1]].view(np.int64) for i in range(hi - lo)], "n": np.diff(first), "f1": one.view(np.int64), "f2": two.view(np.int64),
                })

    return run


@F.pandas_udf(LongType())
def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    """Size of the intersection of two sorted arrays of distinct 64-bit values."""
    out = []
    for x, y in zip(a, b):
        u, v = x.view(np.uint64), y.view(np.uint64)
        if len(u) > len(v):
            u, v = v, u
        at = np.searchsorted(v, u)
        out.append(int(np.count_nonzero(v[np.minimum(at, len(v) - 1)] == u)) if len(v) else 0)
    return pd.Series(out, dtype="int64")


@F.pandas_udf(DoubleType())
def _agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    out = [float(np.mean(np.frombuffer(x, np.uint32) == np.frombuffer(y, np.uint32))) for x, y in zip(a, b)]
    return pd.Series(out, dtype="float64")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, rows: int = 5) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    A document's set is its distinct `shingle`-word shingles (A-Z lower-cased, words split at ASCII
    white space); with fewer words, all of them as one shingle; null, empty and blank texts have an
    empty set and link with nothing. Documents link if 100 * |A & B| >= percent * |A | B|; component_id is the
    smallest doc_id reachable by links, kept is doc_id = component_id. Rows that repeat a doc_id
    are one node, whose set is that of its row with the most shingles (of equals, the larger hash); each row has its own n_shingles; a null doc_id links with nothing, has no component and is kept. Columns other
    than doc_id and text are ignored.

    Documents with equal sets collapse before banding. Candidates of a band's bucket are not
    expanded into pairs: in turn, PIVOTS members of each bucket that share most buckets with others are compared with all of it, links
    are united. Members of buckets that then still hold several components meet by prefixes: with their
    shingles ordered rarest first, the first one that two linked sets share leaves enough shingles
    behind it in both, so only such entries of different components are paired and compared. No link
    between components is lost, whatever a bucket's size; a bucket of one group costs a row per
    member, and copies that are too far apart share no such entry. A pair must pass the length
    bound, the signature bound (five standard errors below the threshold) and the exact sets.
    """
    tune(docs.sparkSession)
    t = percent / 100
    bands = bands_for(t, rows)
    lowest = t - 5 * math.sqrt(t * (1 - t) / (bands * rows))
    source = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    signed = table(
        source.mapInPandas(_sign(shingle, bands, rows), "id long, n long, f1 long, f2 long, sig binary, keys array<long>"),
        "minhash",
    )
    usable = signed.where("id IS NOT NULL AND n > 0")
    of = F.struct("n", "f1", "f2")
    unlike = usable.groupBy("id").agg(F.max(of).alias("own"), F.min(of).alias("low")).where("own <> low")
    unlike = table(unlike.select("id", "own"), "unlike")
    repeats = not unlike.isEmpty()
    if repeats:
        usable = usable.join(unlike, "id", "left").where(F.col("own").isNull() | (of == F.col("own"))).drop("own")
    same = table(usable.groupBy("n", "f1", "f2").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "sets")
    reps = usable.select("id", "n", "keys").join(same.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
    entries = reps.select("id", "n", F.explode("keys").alias("key"))
    counted = entries.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    crowded = table(entries.join(apart(counted, "key"), "key"), "crowded")
    # what a group's copies derive from shares more buckets with them than they do with each other
    crowd = crowded.groupBy("id").agg(F.sum("c").alias("pop"))
    known = table(crowded.select("key", "id", "n").join(crowd, "id"), "members")
    pivots = apart(known.groupBy("key").agg(F.max(F.struct("pop", (-F.col("id")).alias("o"), "id", "n")).alias("p")), "key")
    buckets = table(known.join(pivots, "key").select("key", "id", "n", "pop", F.col("p.id").alias("pid"), F.col("p.n").alias("pn")), "buckets")

    def alike(x: Column, y: Column) -> Column:
        return F.least(x, y) * 100 >= F.greatest(x, y) * percent

    def sets_of(ids: DataFrame) -> DataFrame:
        wanted, schema = among(source, ids), "id long, items array<long>, n long, f1 long, f2 long"
        if not repeats:
            return table(wanted.dropDuplicates(["id"]).mapInPandas(_sets(shingle), schema).select("id", "items"), "items")
        items = wanted.mapInPandas(_sets(shingle), schema).join(unlike, "id", "left").where(F.col("own").isNull() | (of == F.col("own")))
        return table(items.dropDuplicates(["id"]).select("id", "items"), "items")

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()

    def verified(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The pairs compared, and the links among them."""
        pairs = table(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
        if pairs.isEmpty():
            return pairs, pairs
        signs = table(among(usable.select("id", "sig"), ends(pairs)).dropDuplicates(["id"]), "signs")
        near = (
            pairs.join(signs.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
            .join(signs.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a")
            .where(_agreement("sa", "sb") >= lowest)
            .select("a", "b")
        )
        near = table(near, "near")
        sets = sets_of(ends(near))
        both = near.join(sets.select(F.col("id").alias("b"), F.col("items").alias("ib")), "b").join(
            sets.select(F.col("id").alias("a"), F.col("items").alias("ia")), "a"
        )
        common = both.select("a", "b", (F.size("ia") + F.size("ib")).cast("long").alias("total"), _common("ia", "ib").alias("common"))
        return pairs, table(common.where(f"100 * common >= {percent} * (total - common)").select("a", "b"), "links")

    def prefixes(members: DataFrame) -> DataFrame:
        """Shingles of each member, rarest first, as far as a link's first common shingle can lie."""
        items = sets_of(members.select("id"))
        flat = table(items.select("id", F.explode("items").alias("h")), "shingles")
        often = flat.groupBy("h").agg(F.count("*").alias("c")).where("c > 1")
        order = flat.join(often, "h", "left").groupBy("id").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("c", F.lit(1)).alias("c"), "h"))).alias("s"))
        room = F.floor(F.col("n") * (100 - percent) / 100).cast("int") + 1
        placed = members.join(order, "id").select("id", "n", "label", F.posexplode(F.slice("s", F.lit(1), room)).alias("pos", "e"))
        return table(placed.where("e.c > 1").select("id", "n", "label", "pos", F.col("e.h").alias("h")), "prefixes")

    def labelled(links: DataFrame) -> DataFrame:
        """Buckets that still hold several components, with each member's one."""
        c = components(links).select(F.col("node").alias("id"), "component")
        rows_ = buckets.select("key", "id", "n", "pop", "pid").join(c, "id", "left").withColumn("label", F.coalesce("component", "id"))
        first = F.max(F.when(F.col("id") == F.col("pid"), F.col("label"))).alias("first")
        span = rows_.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), first).where("lo < hi")
        many = rows_.drop("pid").join(apart(span, "key"), "key")
        # the most popular member outside the first pivot's component
        other = many.where(F.col("label") != F.col("first")).groupBy("key").agg(F.max(F.struct("pop", "label", "id", "n")).alias("p"))
        return many.join(apart(other, "key"), "key").select("key", "id", "n", "label", F.col("p.id").alias("pid"), F.col("p.n").alias("pn"), F.col("p.label").alias("plabel"))

    def classes(found: DataFrame) -> DataFrame:
        copies = usable.select("id", "n", "f1", "f2").join(same, ["n", "f1", "f2"]).select(F.col("rep").alias("a"), F.col("id").alias("b"))
        members = components(found.union(copies)).select(F.col("node").alias("id"), "component")
        out = signed.select("id", "n").join(members, "id", "left")
        component = F.coalesce("component", "id")
        return out.select(
            F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept")
        )

    done, links = verified(buckets.where(alike(F.col("n"), F.col("pn"))).select(F.col("id").alias("a"), F.col("pid").alias("b")))
    open_ = table(labelled(links), "open")
    if open_.isEmpty():
        return classes(links)
    for _ in range(PIVOTS - 1):
        more = open_.where(F.col("label") != F.col("plabel")).where(alike(F.col("n"), F.col("pn")))
        more = more.select(F.least("id", "pid").alias("a"), F.greatest("id", "pid").alias("b")).distinct().join(done, ["a", "b"], "left_anti")
        again, found = verified(more)
        done, links = done.union(again), links.union(found)
        open_ = table(labelled(links), "open")
        if open_.isEmpty():
            return classes(links)
    entries = prefixes(open_.select("id", "n", "label").distinct())
    x, y = entries.alias("x"), entries.alias("y")
    left = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
    rest = x.join(
        y,
        (F.col("x.h") == F.col("y.h")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.label") != F.col("y.label"))
        & (left * (100 + percent) >= (F.col("x.n") + F.col("y.n")) * percent),
    ).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    _, found = verified(rest)
    return classes(links.union(found))
