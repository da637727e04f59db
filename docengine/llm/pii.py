"""Surrogates for personal data: keyed replacements of the same kind and format, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.llm.store import fresh, table

_NAME = r"\p{Lu}[\p{L}'’-]+"
_MALE = r"Mr|Herrn?|Sr|Señor|Monsieur|Signor|Господин"
_FEMALE = r"Mrs|Ms|Miss|Frau|Sra|Señora|Señorita|Madame|Mme|Mlle|Signora|Госпожа"
#: Patterns by kind; where several match, the first. Each starts where its characters start, so that none is tried inside a run.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}",
    "secret": r"\bAKIA[0-9A-Z]{16}\b|\bghp_[A-Za-z0-9]{36}\b|\bsk-[A-Za-z0-9]{20,}\b|(?<=\b(?i:token|password|passwd|secret|api_key|apikey)\s{0,3}[=:]\s{0,3}[\"']?)[A-Za-z0-9+/_\-]{8,}",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b",
    "phone": r"(?<![\w+])\+?\d{1,3}[ .\-]?\(\d{2,4}\)[ .\-]?\d{3,4}[ .\-]?\d{3,4}\b|(?<![\w(])\(\d{3}\)[ .\-]?\d{3}[ .\-]\d{4}\b|(?<![\w+])\+\d{1,3}(?:[ .\-]?\d{2,4}){2,5}\b|(?<![\w.\-])\d{3}[.\-]\d{3}[.\-]\d{4}\b",
    "ip": r"(?<![\w.])(?<!\b(?i:version|release|ver\.?|v\.?) {0,2})(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)",
    "ssn": r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])",
    "card": r"(?<![\w\-])\d(?:[ \-]?\d){12,18}(?![\w\-])",
    "person": rf"\b(?:{_MALE}|{_FEMALE}|Dr|Prof)\.? {_NAME}(?: {_NAME}){{0,2}}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Cheap test that every text with an entity passes.
_MAYBE = r"[0-9@=:]|AKIA|ghp_|sk-|\b(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Sr|Sra|Señor|Monsieur|Madame|Mme|Mlle|Signor|Господин|Госпожа)"
#: Syllables and endings (male, female, family) of made-up names, by script.
NAMES = {
    "Cyrillic": ("ба ве га до жи ка ле ми но ра со ти", "ан ор ис", "ина ева ара", "енко ский ов"),
    "Greek": ("βα γε δι κα λε μι νο ρα σο τι", "ος ης ας", "ία ήνη ώ", "ίδης όπουλος άκης"),
    "Gujarati": ("કા ગી જે તા દી પા મે રા લી સો", "શ ન ત", "લા ણી ના", "વાલા કર દાસ"),
    "Devanagari": ("का गी जे ता दी पा मे रा ली सो", "श न त", "ला णी ना", "वाला कर दास"),
    "Latin": ("ba do ka le mi no ra se ti vu fa go lu pe ri sa", "n r k", "a ia elle", "son er ley"),
}


def kind(entity: Column) -> Column:
    """Which pattern an entity matched."""
    out = None
    for name, pattern in PATTERNS.items():
        # a look-behind sees nothing before a lone entity, so what only context tells is what is left
        whole = entity.rlike(rf"^(?:{pattern})$")
        out = F.when(whole, name) if out is None else out.when(whole, name)
    return out.otherwise("secret")


def valid(kind_: Column, norm: Column) -> Column:
    """Whether check digits agree; a number whose own do not is none of that kind and stays."""
    return F.when(kind_ == "card", _luhn(norm) == norm).when(kind_ == "iban", _iban(norm, norm) == norm).otherwise(True)


def normal(kind_: Column, part: Column) -> Column:
    """What mentions of one entity share: digits and letters, letters lower-cased where case has no meaning."""
    bare = F.regexp_replace(part, r"[^\p{L}\p{N}]", "")
    return F.when(kind_ == "email", F.lower(part)).when(kind_.isin("ip", "secret"), part).when(kind_.startswith("person"), F.lower(part)).otherwise(bare)


def _stream(key: Column, kind_: Column, value: Column, turn: Column) -> Column:
    """64 numbers from 0 to 255 that follow from the key, the entity and the turn."""
    hex_ = F.sha2(F.concat_ws("\x1f", key, kind_, value, turn.cast("string")), 512)
    return F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.conv(F.substring(hex_, i * 2 + 1, F.lit(2)), 16, 10).cast("int"))


def _alike(value: Column, stream: Column, letters: int = 26) -> Column:
    """Each digit, upper and lower ASCII letter by another of its class; other letters by Latin ones."""

    def one(c: Column, i: Column) -> Column:
        r = F.element_at(stream, (i % 64 + 1).cast("int")) + F.floor(i / 64).cast("int")
        return (
            F.when(c.rlike("[0-9]"), F.when(i == 0, r % 9 + 1).otherwise(r % 10).cast("string"))
            .when(c.rlike("[A-Z]"), F.char(r % letters + 65))
            .when(c.rlike(r"\p{L}"), F.char(r % letters + 97))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(value, "", -1), one), "")


def _digits(value: Column) -> Column:
    return F.transform(F.filter(F.split(value, "", -1), lambda c: c != ""), lambda c: c.cast("int"))


def _luhn(value: Column) -> Column:
    """The digits with their last one made the check digit."""
    body = F.substring(value, F.lit(1), F.length(value) - 1)
    n = F.length(body)
    total = F.aggregate(
        F.transform(_digits(body), lambda d, i: F.when((n - i) % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)), F.lit(0), lambda a, d: a + d
    )
    return F.concat(body, ((10 - total % 10) % 10).cast("string"))


def _iban(value: Column, made: Column) -> Column:
    """Country as it was, the rest made up, check digits by ISO 7064 mod 97."""
    country, rest = F.substring(value, 1, 2), F.substring(made, F.lit(5), F.length(made))
    numbers = F.transform(F.split(F.concat(rest, country, F.lit("00")), "", -1), lambda c: F.when(c.rlike("[A-Z]"), (F.ascii(c) - 55).cast("string")).otherwise(c))
    left = F.aggregate(_digits(F.array_join(numbers, "")), F.lit(0), lambda a, d: (a * 10 + d) % 97)
    return F.concat(country, F.lpad((98 - left).cast("string"), 2, "0"), rest)


def _name(kind_: Column, stream: Column, turn: Column) -> Column:
    """kind_ is person.<male|female|any|family>.<script>, which picks the ending alone; longer names from the third turn on, so they do not run out."""
    at = lambda i: F.element_at(stream, i)
    out = None
    for script, (syllables, male, female, family) in NAMES.items():
        s = F.array(*[F.lit(x) for x in syllables.split()])
        end = {k: F.array(*[F.lit(x) for x in v.split()]) for k, v in (("male", male), ("female", female), ("family", family))}
        pick = lambda a, i: F.element_at(a, (at(i) % F.size(a) + 1).cast("int"))  # noqa: B023, E731
        last = F.when(kind_.contains(".female."), pick(end["female"], 9)).when(kind_.contains(".family."), pick(end["family"], 9)).otherwise(pick(end["male"], 9))
        more = F.when(turn >= 2, F.concat(pick(s, 5), pick(s, 6))).otherwise("")
        name = F.initcap(F.concat(pick(s, 1), pick(s, 2), pick(s, 3), more, last))
        out = F.when(kind_.endswith("." + script), name) if out is None else out.when(kind_.endswith("." + script), name)
    return out


def surrogate(kind_: Column, value: Column, turn: Column, stream: Column) -> Column:
    """stream: a stored column of `_stream`; as an expression it would be worked out again for every letter."""
    made = _alike(value, stream)
    at = lambda i: F.element_at(stream, i)
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    top = F.substring_index(domain, ".", -1)
    host = _alike(F.substring(domain, F.lit(1), F.length(domain) - F.length(top) - 1), F.transform(stream, lambda x: (x * 7 + 3) % 256))
    return (
        F.when(kind_ == "email", F.concat(_alike(local, stream), F.lit("@"), host, F.lit("."), top))
        .when(kind_ == "ip", F.concat_ws(".", at(1) % 222 + 1, at(2), at(3), at(4) % 254 + 1))
        .when(kind_ == "card", _luhn(made))
        .when(kind_ == "iban", _iban(value, made))
        # what is before the last ten digits is a country code
        .when((kind_ == "phone") & (F.length(value) > 10), F.concat(F.substring(value, F.lit(1), F.length(value) - 10), _alike(F.right(value, F.lit(10)), stream)))
        .when((kind_ == "secret") & value.startswith("AKIA"), F.concat(F.lit("AKIA"), F.substring(made, 5, 999)))
        .when((kind_ == "secret") & value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), _alike(value, stream, 6))
        .when(kind_.startswith("person"), _name(kind_, stream, turn))
        .otherwise(made)
    )


def _render(kind_: Column, raw: Column, made: Column) -> Column:
    """`made` in the format of a mention: separators of numbers."""
    keep = F.split(raw, "", -1)
    place = F.transform(keep, lambda c, i: F.size(F.filter(F.slice(keep, F.lit(1), i + 1), lambda x: x.rlike(r"[\p{L}\p{N}]"))))
    shaped = F.array_join(
        F.transform(F.arrays_zip(keep.alias("c"), place.alias("p")), lambda x: F.when(x["c"].rlike(r"[\p{L}\p{N}]"), F.substring(made, x["p"], F.lit(1))).otherwise(x["c"])), ""
    )
    return F.when(kind_.isin("email", "ip", "secret"), made).otherwise(shaped)


def _script(word: Column) -> Column:
    out = F
    for s in NAMES:
        out = out.when(word.rlike(rf"\p{{Is{s}}}"), s)
    return out.otherwise("Latin")


def surrogates(entities: DataFrame, key: str, rounds: int = 60) -> DataFrame:
    """kind, norm, made for each distinct (kind, norm): no two of a kind share one, none is a real entity.

    Made names all count as one kind. A surrogate that collides is drawn anew with the next turn until none does; the
    smallest entity keeps one that several drew. Raises if that takes more than `rounds`.
    """
    space = F.when(F.col("kind").startswith("person"), "person").otherwise(F.col("kind"))
    # a name's role chooses its ending alone
    numbers = _stream(F.lit(key), space, F.col("norm"), F.col("turn"))
    draw = surrogate(F.col("kind"), F.col("norm"), F.col("turn"), F.col("stream"))
    names = table(entities.select("kind", "norm").distinct(), "entities")
    real = names.select(space.alias("space"), F.lower("norm").alias("low")).distinct().withColumn("real", F.lit(True))
    streams = table(names.withColumn("turn", F.lit(0)).withColumn("stream", numbers), "streams")
    drawn = table(streams.select("kind", "norm", "turn", draw.alias("made")), "drawn")
    for _ in range(rounds):
        lowered = drawn.withColumns({"space": space, "low": F.lower("made")})
        owner = table(lowered.groupBy("space", "low").agg(F.min(F.struct("kind", "norm")).alias("owner")), "owners")
        seen = lowered.join(owner, ["space", "low"]).join(real, ["space", "low"], "left")
        bad = F.col("real").isNotNull() | (F.struct("kind", "norm") != F.col("owner"))
        # owners stay with what they have, unless it is real
        checked = table(seen.select("kind", "norm", "turn", "made", F.coalesce(bad, F.lit(False)).alias("bad")), "checked")
        if checked.where("bad").isEmpty():
            return checked.select("kind", "norm", "made")
        again = checked.withColumn("turn", F.col("turn") + F.col("bad").cast("int"))
        streams = table(again.withColumn("stream", numbers), "streams")
        drawn = table(streams.select("kind", "norm", "turn", F.when(F.col("bad"), draw).otherwise(F.col("made")).alias("made")), "drawn")
    raise RuntimeError(f"surrogates still collide after {rounds} rounds")


_RUN = r"[\p{L}\p{M}]+"
#: Letters, and what is between them.
_TOKEN = rf"{_RUN}|[^\p{{L}}\p{{M}}]+"


def _cased(token: Column, made: Column) -> Column:
    return F.when(token.rlike(r"^\p{Lu}{2,}$"), F.upper(made)).otherwise(made)


def _with_names(text: Column, names: Column) -> Column:
    """`text` with every capitalised word that `names` (lower-cased to made) holds replaced."""
    made = lambda t: F.when(t.rlike(r"^\p{Lu}"), F.try_element_at(names, F.lower(t)))
    tokens = F.transform(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), lambda t: F.coalesce(_cased(t, made(t)), t))
    return F.when(names.isNull(), text).otherwise(F.array_join(tokens, ""))


def pseudonymise(docs: DataFrame, key: str = "docengine") -> DataFrame:
    """The rows and columns of `docs`, text with surrogates in place of personal data, and n_entities (detected mentions replaced).

    Kinds: email, phone, ip, card and iban (only with valid check digits, the surrogate's are valid too), ssn, secrets, and names after a title.
    A surrogate follows from `key`, keeps its kind, separators, letter case and length, a name's gender
    and script; mentions of an entity in any format get the same one, distinct entities distinct
    ones, none a real one of the corpus. Names are replaced word by word, and one word is one surrogate wherever it stands: a
    person keeps one name under any title, a family name alone agrees with the full name. Gender is that of most of a
    word's titled mentions; it picks the ending. Names found after a title are replaced without one as well in the same text (not
    counted by n_entities); a name that no title introduces in its text stays.
    Null texts stay null, with 0 mentions, empty ones empty; texts without an entity are returned as they were. Null ids and repeated rows
    are treated like any others. A column called n_entities is replaced.

    Every text is searched once; rows and mentions are stored. Only distinct mentions are moved and drawn for. Texts
    without mentions are not shuffled; the others, told by their SHA-256, meet their replacements by one
    join, which Spark can split where many rows hold one text. A text's mentions are grouped by text, never by entity.
    """
    out = [c for c in docs.columns if c.lower() != "n_entities"]
    k, mentions, made, names = (fresh(x, docs.columns) for x in ("k", "mentions", "made", "names"))
    text = F.col("text").cast("string")
    found = F.when(text.rlike(_MAYBE), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    scanned = table(docs.select(*out, found.alias(mentions)), "scanned")
    has = F.coalesce(F.size(mentions) > 0, F.lit(False))
    hit = scanned.where(has).withColumn(k, F.sha2(text, 256))
    met = table(hit.select(F.col(k).alias("k"), F.explode(F.array_distinct(mentions)).alias("raw")).distinct(), "mentions")
    raws = met.groupBy("raw").agg(F.count("*").alias("often")).withColumn("base", kind(F.col("raw"))).withColumn("norm", normal(F.col("base"), F.col("raw")))
    raws = table(raws.where(valid(F.col("base"), F.col("norm"))), "raws")
    others, persons = raws.where("base <> 'person'"), raws.where("base = 'person'")
    # a person's mention: title, then words; single letters stay
    gender = F.when(F.col("raw").rlike(rf"^(?:{_FEMALE})\b"), "female").when(F.col("raw").rlike(rf"^(?:{_MALE})\b"), "male").otherwise("any")
    tokens = persons.select("raw", "often", gender.alias("gender"), F.posexplode(F.regexp_extract_all("raw", F.lit(_TOKEN), F.lit(0))).alias("pos", "token"))
    is_name = (F.col("pos") > 0) & F.col("token").rlike(rf"^{_RUN}$") & (F.length("token") > 1)
    tokens = table(tokens.withColumn("word", F.when(is_name, F.lower("token"))), "tokens")
    last = tokens.where("word IS NOT NULL").groupBy("raw").agg(F.max("pos").alias("last"))
    roles = tokens.where("word IS NOT NULL").join(last, "raw").select("word", "often", F.when(F.col("pos") == F.col("last"), "family").otherwise(F.col("gender")).alias("role"))
    votes = roles.groupBy("word", "role").agg(F.sum("often").alias("n")).groupBy("word").agg(F.max_by("role", F.struct("n", "role")).alias("role"))
    words = votes.select("word", F.concat_ws(".", F.lit("person"), "role", _script(F.col("word"))).alias("kind"))
    drawn = surrogates(others.select(F.col("base").alias("kind"), "norm").union(words.select("kind", F.col("word").alias("norm"))), key)
    drawn = table(drawn, "surrogates")
    called = drawn.where(F.col("kind").startswith("person")).select(F.col("norm").alias("word"), "made")
    shown = others.join(drawn.select(F.col("kind").alias("base"), "norm", "made"), ["base", "norm"]).select("raw", _render(F.col("base"), F.col("raw"), F.col("made")).alias("made"))
    spelled = tokens.join(called, "word", "left").select("raw", "word", "made", F.struct("pos", F.coalesce(_cased(F.col("token"), F.col("made")), "token").alias("t")).alias("t"))
    people = spelled.groupBy("raw").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda x: x["t"]), "").alias("made"),
        F.collect_set(F.when(F.col("word").isNotNull(), F.struct("word", "made"))).alias("names"),
    )
    pairs = table(shown.withColumn("names", F.lit(None).cast("array<struct<word:string,made:string>>")).unionByName(people), "pairs")
    by_text = met.join(pairs, "raw").groupBy("k").agg(F.collect_list(F.struct("raw", "made")).alias("pairs"), F.array_distinct(F.flatten(F.collect_list("names"))).alias("names"))
    maps = table(
        by_text.select(F.col("k").alias(k), F.map_from_entries("pairs").alias(made), F.when(F.size("names") > 0, F.map_from_entries("names")).alias(names)), "maps"
    )
    gaps = F.transform(F.split(text, ANY, -1), lambda g: _with_names(g, F.col(names)))
    fills = F.concat(F.transform(mentions, lambda m: F.coalesce(F.try_element_at(F.col(made), m), m)), F.array(F.lit("")))
    new = F.when(F.col(made).isNull(), text).otherwise(F.array_join(F.zip_with(gaps, fills, lambda a, b: F.concat(a, b)), ""))
    n = F.coalesce(F.size(F.filter(mentions, lambda m: F.map_contains_key(F.col(made), m))), F.lit(0)).cast("long")
    done = hit.join(maps, k, "left").select(*[new.alias("text") if c == "text" else F.col(c) for c in out], n.alias("n_entities"))
    rest = scanned.where(~has).select(*out, F.lit(0).cast("long").alias("n_entities"))
    return rest.unionByName(done)
