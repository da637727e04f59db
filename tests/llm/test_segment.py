"""Sampling against brute force over a short text's segmentations, and encoding and decoding as the library does."""

import math
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from docengine.llm import segment

PATH = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def lat():
    return segment.Lattice(PATH)


def test_model_type(lat):
    assert not segment.is_unigram(lat.model)


def test_distribution_and_inclusion(lat):
    """Over many seeds: the first is drawn by probability, and weights of 1 / inclusion give the whole mass."""
    part = segment.units(lat.model.normalize("the ab"))
    every, _ = lat.sample_all([part], 10**4, np.array([0]))[0]
    p = {tuple(path): math.exp(lp) for path, lp, _ in every}
    assert abs(sum(p.values()) - 1) < 1e-9 and len(p) > 4
    n, k = 4000, 2
    firsts, weight, seen = Counter(), [], Counter()
    for found, bound in lat.sample_all([part] * n, k, np.arange(n)):
        firsts[tuple(found[0][0])] += 1
        weight.append(sum(math.exp(lp) / -math.expm1(-math.exp(min(lp - bound, 700))) for _, lp, _ in found))
        assert len({tuple(path) for path, _, _ in found}) == k and found[0][2] >= found[1][2] >= bound
        seen.update(tuple(path) for path, _, _ in found)
    for path, q in p.items():
        assert abs(firsts[path] / n - q) < 4 * math.sqrt(q * (1 - q) / n) + 1e-3
    assert abs(np.mean(weight) - 1) < 4 * np.std(weight) / math.sqrt(n)
    # pairs without replacement: the chance of being in the sample
    for i, q in p.items():
        exact = q + sum(r * q / (1 - r) for j, r in p.items() if j != i)
        assert abs(seen[i] / n - exact) < 5 * math.sqrt(exact * max(1 - exact, 1e-3) / n) + 1e-3


def test_batch_does_not_matter(lat):
    texts = [segment.units(lat.model.normalize(t)) for t in ("one two three", "", "the  cat\n ünï𐍈", "one two three", "a " * 200)]
    seeds = np.array([5, 6, 7, 5, 9])
    together = segment.Lattice(PATH).sample_all(texts, 3, seeds)
    for t, s, (found, bound) in zip(texts, seeds, together):
        alone, alone_bound = lat.sample_all([t], 3, np.array([s]))[0]
        assert bound == alone_bound and [x[1:] for x in found] == [x[1:] for x in alone]
    assert [x[1:] for x in together[0][0]] == [x[1:] for x in together[3][0]]


def test_forgetting(lat, monkeypatch):
    monkeypatch.setattr(segment, "_KNOWN", 50)
    few = segment.Lattice(PATH)
    for t in ("some words here", "others there " * 20, "some words here"):
        got = few.sample(few.model.normalize(t), 3, 4)
        assert [x[1:] for x in got[0]] == [x[1:] for x in lat.sample(lat.model.normalize(t), 3, 4)[0]]


def test_encode_decode(spark):
    texts = ["the cat sat", "", None, "a  b\n\nc", "ünï𐍈 中文", "x" * 3000, "the cat sat"]
    docs = spark.createDataFrame([(i if i != 3 else None, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    model = segment.lattice(PATH).model
    ids = segment.encode(docs, PATH)
    got = sorted((r.doc_id if r.doc_id is not None else 3, r.ids) for r in ids.collect())
    assert [x for _, x in got] == [model.encode(t or "") for t in texts]
    back = {r.doc_id if r.doc_id is not None else 3: r.text for r in segment.decode(ids, PATH).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert segment.encode(docs.where("false"), PATH).count() == 0
    empty = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert segment.decode(empty, PATH).first().text == ""
