"""Surrogates against plain Python: distinctness, coreference, gender, script, formats, check digits, and odd inputs."""

import re
from collections import defaultdict

import pytest

from docengine.llm import pii


def run(spark, rows, schema="doc_id long, text string"):
    return pii.pseudonymise(spark.createDataFrame(rows, schema))


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def iban(s):
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def test_one_name_under_any_title(spark):
    got = run(spark, [(1, "Mr. John Smith met Dr. John Smith. Later John Smith and Smith left, said JOHN SMITH.")]).first()
    m = re.fullmatch(r"Mr\. (\w+) (\w+) met Dr\. (\w+) (\w+)\. Later (\w+) (\w+) and (\w+) left, said (\w+) (\w+)\.", got.text)
    given, family = {m[i] for i in (1, 3, 5)} | {m[8].title()}, {m[i] for i in (2, 4, 6, 7)} | {m[9].title()}
    assert len(given) == len(family) == 1 and given != family and not {"John", "Smith"} & (given | family) and m[8].isupper()
    assert got.n_entities == 2


def test_gender_script_and_hyphens(spark):
    rows = [(1, "Mrs. Anna Müller-Lüdenscheidt und Frau Anna Müller"), (2, "Herr Karl O'Brien"), (3, "Господин Иван Петров"), (4, "no names of Anna or Иван here")]
    got = {r.doc_id: r.text for r in run(spark, rows).collect()}
    a = re.fullmatch(r"Mrs\. (\w+) (\w+)-(\w+) und Frau (\w+) (\w+)", got[1])
    assert a[1] == a[4] and a[2] == a[5] != a[3] and a[1].endswith(tuple(pii.NAMES["Latin"][2].split()))
    b = re.fullmatch(r"Herr (\w+) O'(\w+)", got[2])
    assert b[1].endswith(tuple(pii.NAMES["Latin"][1].split())) and b[2].endswith(tuple(pii.NAMES["Latin"][3].split()))
    c = re.fullmatch(r"Господин ([Ѐ-ӿ]+) ([Ѐ-ӿ]+)", got[3])
    assert c and "Иван" not in got[3] and "Петров" not in got[3]
    assert got[4] == rows[3][1]  # no title introduces them in this text


@pytest.mark.parametrize("text", ["order 1234567890123 shipped", "card 4111 1111 1111 1112", "version 1.2.3.4 and v 10.0.0.1, Version 2.3.4.5", "GB82 WEST 1234 5698 7654 33", "999.1.1.1", "plain 2024-01-02"])
def test_what_is_no_entity_stays(spark, text):
    got = run(spark, [(1, text)]).first()
    assert got.text == text and got.n_entities == 0


def test_distinct_and_consistent(spark):
    """Many entities in several formats: one surrogate each, no two share one, none is a real one, check digits hold."""
    cards = []
    for i in range(400):
        body = f"4{i:05d}123456789"
        cards.append(next(body + str(d) for d in range(10) if luhn(body + str(d))))
    rows = []
    for i, c in enumerate(cards):
        spaced = " ".join(c[j : j + 4] for j in range(0, 16, 4))
        rows.append((i, f"pay {c} or {spaced} to u{i}@mail{i % 7}.example.com at 10.{i % 200}.3.{i % 9 + 1} call +1 (310) 555-{i:04d} IBAN GB82 WEST 1234 5698 7654 32 Mr. Nam{chr(97 + i // 26)}{chr(97 + i % 26)} Xu{chr(97 + i % 26)}"))
    rows += rows[:50]
    shown = defaultdict(set)
    out = run(spark, rows).collect()
    assert len(out) == len(rows)
    pattern = re.compile(r"pay (\d{16}) or ([\d ]{19}) to (\S+@\S+) at ([\d.]+) call (\+1 \(\d{3}\) \d{3}-\d{4}) IBAN (.*?) Mr\. (\w+) (\w+)")
    old_of = {i: pattern.fullmatch(t).groups() for i, t in rows}
    for r in out:
        new, old = pattern.fullmatch(r.text).groups(), old_of[r.doc_id]
        assert new[0] == new[1].replace(" ", "") and luhn(new[0]) and iban(new[5]) and r.n_entities == 7
        for kind, (a, b) in enumerate(zip(old, new)):
            if kind != 1:
                shown[("name" if kind > 5 else kind, a)].add(b)
    assert all(len(v) == 1 for v in shown.values())
    for kind in {k for k, _ in shown}:
        made = [next(iter(v)) for (k, _), v in shown.items() if k == kind]
        real = {a for k, a in shown if k == kind}
        assert len(set(made)) == len(made) and not set(made) & real


def test_odd_rows(spark):
    long = "word " * 200_000 + "x@y.org " + "a" * 100_000
    rows = [(1, None, 7, "m"), (None, "", 7, "m"), (None, "a.b@c.org", 7, None), (2, long, None, "m"), (2, "a.b@c.org", 7, "m"), (2, "a.b@c.org", 7, "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_entities int, mentions string")
    out = pii.pseudonymise(df)
    assert out.columns == ["doc_id", "text", "mentions", "n_entities"]
    got = out.collect()
    assert len(got) == 6 and sorted(r.n_entities for r in got) == [0, 0, 1, 1, 1, 1]
    texts = {r.text for r in got if r.text and len(r.text) < 100}
    assert len(texts) == 1 and "a.b@c.org" not in texts
    assert [len(r.text) for r in got if r.text and len(r.text) > 100] == [len(long)]
    assert pii.pseudonymise(df.where("false")).count() == 0
    clash = spark.createDataFrame([(1, "a@b.org", "p", "q", "r")], "doc_id long, text string, k string, made string, names string")
    assert pii.pseudonymise(clash).select("k", "made", "names").first() == ("p", "q", "r")


def test_key_decides(spark):
    df = spark.createDataFrame([(1, "mail a.b@c.org")], "doc_id long, text string")
    one, again, other = (pii.pseudonymise(df, k).first().text for k in ("k1", "k1", "k2"))
    assert one == again != other
