"""Words that a polynomial hash confuses stay apart, and the token cache tells pre-tokens of one hash apart."""

import random

import numpy as np
import public_tokenizers as P
import pytest

from docengine.llm import counts, licenses, minhash, packing, tokenfile, tokens
from docengine.llm import words as W

SWAP = str.maketrans("ab", "ba")


def thue_morse(n):
    s = "a"
    for _ in range(n):
        s += s.translate(SWAP)
    return s, s.translate(SWAP)


@pytest.mark.parametrize("n", [10, 11, 12])
def test_words_apart(n):
    w = W.scan(list(thue_morse(n)), W.BY_SPACE)
    assert w.hash[0] != w.hash[1]


def test_equal_words_equal_hash():
    w = W.scan(["ab abcdefgh abcdefghi x", "abcdefghi", "zz abcdefgh", None], W.BY_SPACE)
    assert w.hash[2] == w.hash[4] and w.hash[1] == w.hash[6] and len(set(w.hash.tolist())) == 5


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("weak", [False, True])
def test_library_ids(file, weak, monkeypatch):
    from tokenizers import Tokenizer

    if weak:  # nearly every pre-token shares its hash with another
        strong = W.hash_lanes
        monkeypatch.setattr(W, "hash_lanes", lambda x: strong(x) & np.uint64(63))
    t = Tokenizer.from_file(P.path(file))
    t.encode_special_tokens = file.startswith("byte")
    rnd = random.Random(2)
    texts = [x for n in (10, 12) for x in thue_morse(n)]
    texts += ["".join(rnd.choice("ab c'é’—ß 1٣\n\t中ñÀ×") for _ in range(rnd.randrange(150))) for _ in range(300)] + [None, "", " "]
    e = tokens.Encoder(P.path(file))
    for _ in range(2):
        r = e.encode(texts)
        for i, x in enumerate(texts):
            assert r.ids[r.first[i] : r.first[i + 1]].tolist() == t.encode(x or "", add_special_tokens=False).ids


def test_operators(spark, tmp_path):
    from tokenizers import Tokenizer

    a, b = thue_morse(10)
    docs = spark.createDataFrame([(1, a), (2, b), (3, f"{a} {b}")], "doc_id long, text string")
    assert [r.component_id for r in minhash.near_duplicates(docs).orderBy("doc_id").collect()] == [1, 2, 3]
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = {1: t.encode(a).ids, 2: t.encode(b).ids, 3: t.encode(f"{a} {b}").ids}
    tokenfile.write(docs, f"file://{tmp_path}/t", P.path("word_bpe_49k.json"), 2)
    assert {r.doc_id: r.ids[:-1] for r in tokenfile.read(spark, f"file://{tmp_path}/t", ids=True).collect()} == want
    packed = packing.pack(docs, P.path("word_bpe_49k.json"), ids=True).collect()
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist()[:-1] for r in packed} == want
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert {r.doc_id: r.n_tokens for r in counts.by_section(docs, P.path("byte_bpe_50k.json")).collect()} == {i: len(t.encode(x).ids) for i, x in ((1, a), (2, b), (3, f"{a} {b}"))}
    assert [r.labels for r in licenses.scan(docs).collect()] == [""] * 3
