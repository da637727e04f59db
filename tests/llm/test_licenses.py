"""License scans against plain Python: base phrases exactly, labels by the best alignment over whole texts."""

import random
import re

import pytest

from docengine.llm import licenses
from docengine.llm.licensetexts import BASE, TEMPLATES

LOWER = {c: c + 32 for c in range(65, 91)}


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def brute(t):
    """The contract's columns, and labels by aligning every template with the whole text."""
    w = words(t)
    at = [(j, k) for k, p in BASE.items() for j in range(len(w)) if w[j : j + len(p.split())] == p.split()]
    labels, b = {k: 1.0 for _, k in at}, [x.encode() for x in w]
    for template in licenses._templates({}, TEMPLATES):
        share = licenses.align(b, template.words, template.k) / len(template.words)
        if share >= template.share:
            labels[template.label] = max(labels.get(template.label, 0), share)
    places = [j for j, _ in at]
    base = ",".join(sorted({k for _, k in at}))
    return len(w), len(at), min(places, default=None), max(places, default=None), base, ",".join(sorted(labels)), max(labels.values(), default=0.0)


def texts():
    rnd = random.Random(3)
    filler = lambda n: " ".join(rnd.choice("the of and 2 0 license version under software is this any mit cc by".split()) for _ in range(n))
    out = [None, "", " ", "mit", "cc by cc by", "All rights reserved. ALL RIGHTS\nreserved", "licensed under the popular MIT license", "Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0"]
    out += ["public general license", "mit " * 30 + "license", "mit license " * 300, "the apache software license version 2 0 of it", "general public license " * 2000, "cc\0by", "é" * 50_000 + " cc by"]
    for ts in TEMPLATES.values():
        for t in ts:
            ws = t.split()
            out += [t, f"{filler(20)} {t} {filler(20)}", " ".join(ws[: len(ws) // 2])]
            for changes in (1, 3, 8):
                own = list(ws)
                for _ in range(changes):
                    i = rnd.randrange(len(own))
                    own[i : i + rnd.choice([0, 1])] = [rnd.choice(["xx", "license", "yy zz"])]
                out.append(f"{filler(5)} {' '.join(own)} {filler(5)}")
    return out + [filler(300) for _ in range(10)]


def test_scan(spark):
    rows = [(i if i % 11 else None, t, i, "x") for i, t in enumerate(texts())]
    rows += [(i, *r[1:]) for i, r in enumerate(rows[:40])]  # repeated ids, other texts
    df = spark.createDataFrame(rows, "doc_id long, text string, row long, n_words string")
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in licenses.scan(df).collect()), key=repr)
    want = sorted(((r[0], *brute(r[1])) for r in rows), key=repr)
    assert got == want
    assert licenses.scan(df.where("false")).count() == 0


@pytest.mark.parametrize(
    ("text", "label"),
    [("licensed under the popular MIT license", "mit"), ("Apache License, Version 2.0", "apache-2.0"), ("SPDX-License-Identifier: Apache-2.0", "apache-2.0"), ("under Creative Commons Attribution-ShareAlike 4.0", "cc-by-sa-4.0")],
)
def test_labels(text, label):
    assert label in brute(text)[5].split(",")


def test_insertions_at_any_place():
    """A long text keeps its label with a word put in after every ten, and with one word in twenty another."""
    for template in licenses._templates({}, TEMPLATES):
        if len(template.words) < 40:
            continue
        more = [x for i, w in enumerate(template.words) for x in ([w, b"really"] if i % 10 == 9 else [w])]
        other = [b"xx" if i % 20 == 10 else w for i, w in enumerate(template.words)]
        assert licenses.align(more, template.words, template.k) > len(template.words) - template.k  # an end of under k words has no gram
        assert licenses.align(other, template.words, template.k) >= licenses.SHARE * len(template.words)
