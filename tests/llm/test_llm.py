"""Each operator against brute force or an exact round trip on a small fixture with nulls, empty texts, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from docengine.llm import counts, eliasfano, embedding, exact, licenses, minhash, packing, pii, quality, segment, tokenfile

LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(1, 7))) for _ in range(300)]
    base = [[rnd.choice(words) for _ in range(rnd.choice([1, 2, 5, 40, 120]))] for _ in range(25)]
    out = {}
    for i, ws in enumerate(base):
        out[i] = " ".join(ws)
        for j in range(3):
            near = list(ws)
            near[rnd.randrange(len(ws))] = "x" * (j + 1)
            out[100 + 10 * i + j] = " ".join(near)
    out |= {900: "", 901: None, 902: " \n ", 903: out[4], 904: out[4].upper(), 905: "All rights reserved. CC-BY 4.0 General\nPublic License", 906: "word. " * 6000, 907: "ünïcode—’s it's <|endoftext|>"}
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "n", 1) for i, t in texts.items()], "doc_id long, text string, k string, id int")


def links(sets, test):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    names = sorted(sets)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if test(sets[a], sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_minhash(docs, texts):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + 3]) for j in range(max(1, len(w) - 2))} if w else set()
    want = links(sets, lambda a, b: bool(a and b) and 100 * len(a & b) >= 85 * len(a | b))
    got = {r.doc_id: r for r in minhash.near_duplicates(docs, 3, 85).collect()}
    assert {i: got[i].component_id for i in sets} == want
    assert {i: got[i].n_shingles for i in sets} == {i: len(s) for i, s in sets.items()}
    assert minhash.near_duplicates(docs.where("false"), 3, 85).count() == 0


def test_minhash_spread_group(spark):
    """Copies at all distances from a text, around the threshold as well, of which pivots unite only some."""
    rnd = random.Random(8)
    base = [f"w{rnd.randrange(400)}" for _ in range(150)]
    rows, sets = [], {}
    for i in range(240):
        ws = list(base)
        for _ in range(rnd.randrange(16)):
            ws[rnd.randrange(len(ws))] = f"w{rnd.randrange(400)}"
        if i % 3 == 0:
            del ws[: rnd.randrange(20)]
        rows.append((i, " ".join(ws)))
        sets[i] = {tuple(ws[j : j + 3]) for j in range(len(ws) - 2)}
    want = links(sets, lambda a, b: 100 * len(a & b) >= 85 * len(a | b))
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == want and 20 < len(set(want.values())) < 220


def test_embedding(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 8))
    v = np.concatenate([v, v[:20] + 0.02 * rng.normal(size=(20, 8)), v[:5]]).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(200, None), (201, [0.0] * 8), (202, [float("nan")] * 8), (203, [])]
    got = {r.vec_id: r for r in embedding.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    assert [got[i].n_links for i in range(len(v))] == (near.sum(1) - 1).tolist()
    want = links({i: i for i in range(len(v))}, lambda a, b: near[a, b])
    assert {i: got[i].component_id for i in want} == want
    assert all(got[i].n_links == 0 and got[i].kept for i in (200, 201, 202, 203))


def test_exact(docs, texts):
    got = {r.doc_id: r for r in exact.deduplicate(docs, 16, 64).collect()}
    for i, t in texts.items():
        same = [j for j, x in texts.items() if (x or "") == (t or "")]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(same), len(same), i == max(same))
        assert got[i].text_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_licenses(docs, texts):
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    for i, t in texts.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        at = [(j, k) for k, p in licenses.BASE.items() for j in range(len(w)) if w[j : j + len(p.split())] == p.split()]
        assert (got[i].n_words, got[i].n_base, got[i].base_labels) == (len(w), len(at), ",".join(sorted({k for _, k in at})))
        assert got[i].first_word == min((j for j, _ in at), default=None)


def test_tokens(spark, docs, texts, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = {i: t.encode(x or "", add_special_tokens=False).ids for i, x in texts.items()}
    target = f"file://{tmp_path}/tokens"
    tokenfile.write(docs, target, P.path("word_bpe_49k.json"), 2)
    at = 0
    for r in tokenfile.read(spark, target, ids=True).orderBy("doc_id").collect():
        want = [*ids[r.doc_id], 2]
        assert (r.start, r.n_tokens, r.ids, r.ids_crc32) == (at, len(want), want, zlib.crc32(np.array(want, "<u4").tobytes()))
        at += len(want)
    rows = packing.pack(docs, P.path("word_bpe_49k.json"), size=512, part_rows=30).collect()
    full = Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == full[r.sequence_id]
        full[r.sequence_id] += r.length
        want = [*ids[r.doc_id], 1][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
    assert max(full.values()) <= 512 and sum(full.values()) == sum(len(x) + 1 for x in ids.values())
    assert len(full) == packing.lower_bound(np.array([r.length for r in rows]), 512)


def test_counts(docs, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    got = Counter()
    for r in counts.by_section(docs, P.path("byte_bpe_50k.json")).collect():
        got[r.doc_id] += r.n_tokens
    assert {i: got[i] for i in texts} == {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in texts.items()}
    section, crosses = counts.attribute(np.array([0, 3, 6]), np.array([3, 3, 2]), np.array([0, 5, 8]), "most")
    assert section.tolist() == [0, 0, 1] and crosses.tolist() == [False, True, False]


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n in (0, 1, 700):
        v = np.sort(rng.integers(0, 10**6, n))
        r = eliasfano.Reader(eliasfano.encode(v))
        assert r.all().tolist() == v.tolist() == [r.select(i) for i in range(n)]


def test_segment():
    lat = segment.Lattice(P.path("piece_bpe_32k.model"))
    text = "the  cat\n ünï𐍈"
    found, _ = lat.sample(lat.model.normalize(text), 5, 1)
    ids = [tuple(lat.pieces(e)) for e, _, _ in found]
    assert len(set(ids)) == 5 and all(lat.model.decode(list(x)) == text for x in ids)
    assert [g for _, _, g in found] == sorted((g for _, _, g in found), reverse=True)


def test_segment_all():
    """Every segmentation of a short text, by brute force, and those of texts with very long units, repeats and none."""
    lat = segment.Lattice(P.path("piece_bpe_32k.model"))
    ids = {lat.model.id_to_piece(i): i for i in range(3, lat.model.get_piece_size()) if not lat.model.is_byte(i)}
    text = lat.model.normalize("cats ab")

    def ways(rest):
        return [[]] if not rest else [[ids[rest[:j]], *w] for j in range(1, len(rest) + 1) if rest[:j] in ids for w in ways(rest[j:])]

    found, bound = lat.sample(text, 10**4, 3)
    assert sorted(lat.pieces(e) for e, _, _ in found) == sorted(ways(text)) and bound == -np.inf
    assert abs(sum(np.exp(lp) for _, lp, _ in found) - 1) < 1e-9
    for t in ("", "\n\n ", "x" * 5000 + "é𐍈" * 50, "a  b " * 300):
        got, _ = lat.sample(lat.model.normalize(t), 3, 1)
        assert all(lat.model.decode(lat.pieces(e)) == t for e, _, _ in got) and len(got) == (3 if t.strip() else len(got)) and got


def test_segment_table(spark, docs, texts):
    rows = segment.sample(docs, P.path("piece_bpe_32k.model"), k=2, ids=True).collect()
    by, sure = {}, {r.doc_id for r in rows if r.inclusion == 1}
    for r in rows:
        by.setdefault(r.doc_id, set()).add(tuple(r.ids))
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and 0 <= r.inclusion <= 1 and -1e6 < r.log_inclusion <= 0
    assert set(by) == set(texts) and len(rows) == sum(map(len, by.values())) and all(len(by[i]) == 2 for i in set(by) - sure)
    assert segment.sample(docs.where("false"), P.path("piece_bpe_32k.model")).count() == 0


def test_quality():
    good, bad = [np.array([1, 2, i % 7 + 10]) for i in range(40)], [np.array([3, 4, i % 7 + 10]) for i in range(40)]
    pos, neg = (np.bincount(np.concatenate(x), minlength=32) for x in (good, bad))
    w, b = quality.descend(good + bad, np.array([1.0] * 40 + [-1.0] * 40), quality.ratios(neg, pos))
    scale = quality.ratios(neg, pos)
    assert all(w[f] @ scale[f] + b > 0 for f in good) and all(w[f] @ scale[f] + b < 0 for f in bad)


def test_pii(spark):
    rows = [(1, "Mr. John Smith, Mr. Smith: a.b@x.org a.b@x.org 4111 1111 1111 1111 +1 (310) 555-4510"), (2, None), (None, ""), (3, "clean text")]
    got = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    out = got[1].text
    assert not any(x in out for x in ("John", "Smith", "a.b@x.org", "4111", "555-4510"))
    assert re.fullmatch(r"Mr\. (\w+) (\w+), Mr\. \2: (\S+@\S+) \3 \d{4} \d{4} \d{4} \d{4} \+1 \(\d{3}\) \d{3}-\d{4}", out), out
    digits = [int(c) for c in re.search(r"\d{4} \d{4} \d{4} \d{4}", out)[0] if c != " "]
    assert sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0
    assert got[2].text is None and got[None].text == "" and got[3].text == "clean text" and got[3].n_entities == 0


def test_pii_key_words_in_any_case(spark):
    """A secret after a key word in upper or title case is replaced by one of its form, by the same as elsewhere."""
    rows = [(1, 'TOKEN = "9233A8EC77B0D1F4"'), (2, "Token = 9233a8ec77b0d1f4 end"), (3, "PASSWORD: hunter2hunter2"), (4, "token = 9233a8ec77b0d1f4"), (5, 'Api_Key="Zz9-_/+abcd"')]
    got = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(r.n_entities == 1 for r in got.values())
    assert re.fullmatch(r'TOKEN = "[0-9A-F]{16}"', got[1].text) and "9233A8EC" not in got[1].text
    made = re.fullmatch(r"Token = ([0-9a-f]{16}) end", got[2].text)[1]
    assert made != "9233a8ec77b0d1f4" and got[4].text == f"token = {made}"
    assert re.fullmatch(r"PASSWORD: [a-z]{6}\d[a-z]{6}\d", got[3].text) and "hunter2" not in got[3].text
    assert re.fullmatch(r'Api_Key="[A-Z][a-z]\d-_/\+[a-z]{4}"', got[5].text) and "Zz9" not in got[5].text


def test_pii_bare_keys(spark):
    """Keys without a digit, '@', '=' or ':' anywhere in their text pass the first test as well."""
    keys = ["AKIA" + "ABCDEFGHIJKLMNOP", "ghp_" + "aBcDeFgHiJkL" * 3, "sk-" + "abcdefghij" * 2]
    rows = [(i, f"the key {k} was left here") for i, k in enumerate(keys)]
    got = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i].n_entities == 1 and k not in got[i].text and len(got[i].text) == len(rows[i][1]) for i, k in enumerate(keys))
