"""PII: surrogate generation, in DataFrame expressions only.

Entities are found in whole texts by one pattern: e-mail addresses, IPv4
addresses, payment cards that pass the Luhn test, phone numbers, social
security numbers, and names after a form of address. Each gets a replacement
of its own type, made from a keyed SHA-512 of its canonical form, so equal
entities get equal surrogates everywhere (coreference):

  e-mail  letters for letters and digits for digits of the local part and the
          first domain label, of the same script, under `.example`; one domain
          stays one domain
  IPv4    four other octets
  card    same length, first digit and spacing, a valid check digit
  phone   same punctuation and country code, other digits
  ssn     same form, in the 9xx range that is never issued
  name    word by word, so that a family name alone is still the same person:
          given names with an ending for the gender of the form of address,
          family names from the same syllables; for other scripts than Latin
          other letters of that script, a last а or я standing for each other

No letter or digit of a replaced part stands where it stood. A person is one
person after any form of address.

Distinctness is checked, not assumed: the distinct entities of the whole table
are grouped by surrogate, and where two share one, or a surrogate is itself an
entity of the table, all but the smallest are made again with the next attempt
number, until no clash is left. The texts themselves are never shuffled for
this: attempt numbers other than 0 are rare, and only those are joined back.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import cut

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
# Forms of address by gender; the neutral ones come last.
MALE = ("Mr", "Herr", "Herrn", "Monsieur", "Señor", "Don", "господин")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mademoiselle", "Señora", "Señorita", "Doña", "госпожа")
NEUTRAL = ("Dr", "Prof", "Mx")
#: The same in capitals, as headings have them.
MALE, FEMALE, NEUTRAL = (tuple(dict.fromkeys((*forms, *(f.upper() for f in forms)))) for forms in (MALE, FEMALE, NEUTRAL))
ADDRESS = "(?=[MHSDPFгГ])(?:" + "|".join(sorted((*MALE, *FEMALE, *NEUTRAL), key=len, reverse=True)) + ")"
# A word of a name: an initial with its point, or letters after a capital, with inner capitals, apostrophes and hyphens.
NAME = r"(?:\p{Lu}\.(?=[ ]\p{Lu})|\p{Lu}\p{M}*(?:['’\-]?\p{L}\p{M}*)+)"
PATTERNS = {
    "email": r"(?<![\p{L}\p{M}0-9._%+\-])[\p{L}\p{M}0-9._%+\-]++@[\p{L}\p{M}0-9\-]++(?:\.[\p{L}\p{M}0-9\-]+)*\.\p{L}{2,}",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .\-]?)?\([0-9]{3}\)[ .\-]?[0-9]{3}[ .\-][0-9]{4}(?![0-9])"
    r"|(?<![0-9+])\+[0-9]{1,3}[ .\-][0-9]{2,4}[ .\-][0-9]{3,4}(?:[ .\-][0-9]{2,4})?(?![0-9])"
    r"|(?<![0-9+.\-])[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4}(?![0-9.\-])"
    r"|(?<![0-9+.\-])0[0-9]{2,4} [0-9]{3,4} [0-9]{3,4}(?![0-9])",
    "ip": rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{4}[ \-][0-9]{4}[ \-][0-9]{4}[ \-][0-9]{4}|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{5}|[0-9]{3}(?:[ \-]?[0-9]){10,16})(?![0-9])",
    "name": rf"(?<!\p{{L}}){ADDRESS}\.? {NAME}(?: {NAME}){{0,3}}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
GATE = rf"[0-9@]|{ADDRESS}\.? \p{{Lu}}"
TYPES = tuple(PATTERNS)

LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Letters of one script and case, and those that stand in for them.
SCRIPTS = (
    (LOWER, LOWER),
    (LOWER.upper(), LOWER.upper()),
    ("0123456789", "0123456789"),
    ("àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœß", "àáâãäåæçèéêëìíîïñòóôõöøùúûüý"),
    ("абвгдежзийклмнопрстуфхцчшщъыьэюяё", "абвгдежзиклмнопрстуфхцчшэюя"),
    ("αβγδεζηθικλμνξοπρστυφχψωςάέήίόύώ", "αβγδεζηθικλμνξοπρστυφχψω"),
)
#: First and last letter of other scripts' runs of letters; a letter of none of them becomes a Latin one.
RANGES = (
    ("Ա", "Ֆ"), ("ա", "ֆ"), ("א", "ת"), ("ب", "غ"), ("ف", "ي"), ("अ", "ह"), ("ক", "ন"), ("ก", "ฮ"), ("ა", "ჰ"),
    ("あ", "ん"), ("ア", "ン"), ("一", "龥"), ("가", "힣"), ("ሀ", "ቆ"),
)
SYLLABLES = [c + v for c in "bdfgklmnprstvz" for v in "aeiou"]


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """Sum of the Luhn test over a string of digits, the last one not doubled."""
    n = F.length(digits)

    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(F.pmod(n - 1 - i, F.lit(2)) == 1, F.pmod(d * 2, F.lit(10)) + F.when(d >= 5, 1).otherwise(0)).otherwise(d)

    return F.aggregate(F.transform(F.split(digits, ""), value), F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0)))


def _valid(digits: Column) -> Column:
    return F.pmod(luhn_sum(digits), F.lit(10)) == 0


def card_of(m: Column) -> Column:
    """The card in a run of groups of digits: the run, or else the first 13 to 19 digits of whole groups that pass the Luhn test."""
    groups = F.split(m, r"[ \-]")
    # A single character parts two groups, so a group starts at the lengths of those before and their number.
    start = lambda i: F.aggregate(F.slice(groups, 1, i), F.lit(1), lambda a, g: a + F.length(g) + 1)
    to = lambda i, j: F.substr(m, start(i), start(j + 1) - start(i) - 1)
    last = F.size(groups) - 1
    runs = F.flatten(F.transform(F.sequence(F.lit(0), last), lambda i: F.transform(F.sequence(i, last), lambda j: to(i, j))))
    inner = F.filter(runs, lambda r: F.length(_digits(r)).between(13, 19) & _valid(_digits(r)))
    return F.when(_valid(_digits(m)), m).otherwise(F.get(inner, F.lit(0)))


def entity_type(m: Column) -> Column:
    """Type of a match; a run of digits without a card that passes the Luhn test has none."""
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS.items()):
        test = m.rlike(f"^(?:{pattern})$")
        kind = F.when(test & card_of(m).isNotNull() if name == "card" else test, F.lit(name)).otherwise(kind)
    return kind


def parts_of(m: Column) -> Column:
    """Array of (kind, canon, raw): what of a match is replaced. canon is equal for one entity."""
    kind, digits = entity_type(m), _digits(m)
    card = card_of(m)
    word = F.regexp_extract(m, r"^([^ .]+)", 1)
    gender = F.when(word.isin(*MALE), "given_m").when(word.isin(*FEMALE), "given_f").otherwise("given_n")
    names = F.split(bare_name(m), " ")

    def part(k: Column, canon: Column, raw: Column) -> Column:
        return F.struct(k.alias("kind"), canon.alias("canon"), raw.alias("raw"))

    named = F.transform(names, lambda w, i: part(F.when(i == F.size(names) - 1, F.lit("family")).otherwise(gender), F.lower(w), w))
    canon = (
        F.when(kind == "card", _digits(card))
        .when(kind == "ssn", digits)
        .when(kind == "phone", _digits(F.regexp_replace(m, r"^\+[0-9]{1,3}", "")))
        .otherwise(F.lower(m))
    )
    none = F.array().cast("array<struct<kind:string,canon:string,raw:string>>")
    return F.when(kind.isNull(), none).when(kind == "name", named).when(kind == "card", F.array(part(kind, canon, card))).otherwise(F.array(part(kind, canon, m)))


def bare_name(m: Column) -> Column:
    return F.regexp_extract(m, rf"^{ADDRESS}\.? (.*)$", 1)


def _number(digest: Column, i: Column) -> Column:
    """The i-th 16-bit number of a hex digest of 128 digits, shifted after every 32."""
    word = F.conv(F.substr(digest, (F.pmod(i, F.lit(32)) * 4 + 1).cast("int"), F.lit(4)), 16, 10).cast("int")
    return word + F.floor(i / 32).cast("int") * 7


def _pick(pool: str, n: Column) -> Column:
    return F.substr(F.lit(pool), (F.pmod(n, F.lit(len(pool))) + 1).cast("int"), F.lit(1))


def _scramble(text: Column, digest: Column, offset: int = 0) -> Column:
    """Each letter or digit by another one of its script and case, never itself; other characters stay."""

    scripts = F.array(*(F.struct(F.lit(m).alias("members"), F.lit(p).alias("pool")) for m, p in SCRIPTS))
    ranges = F.array(*(F.struct(F.lit(ord(a)).alias("first"), F.lit(ord(b) - ord(a) + 1).alias("n")) for a, b in RANGES))

    def one(c: Column, i: Column) -> Column:
        code = F.ascii(c)
        script = F.get(F.filter(scripts, lambda x: F.contains(x["members"], c)), F.lit(0))
        place = F.get(F.filter(ranges, lambda x: (code >= x["first"]) & (code < x["first"] + x["n"])), F.lit(0))
        # Bound once each: an expression that is used twice is computed twice.
        return F.transform(F.array(F.struct(_number(digest, i + offset).alias("n"), script.alias("s"), place.alias("r"), F.position(c, script["pool"]).alias("at"))), lambda v: made(c, v))[0]

    def made(c: Column, v: Column) -> Column:
        n, size = v["n"], F.length(v["s"]["pool"])
        step = F.when(v["at"] > 0, v["at"] + F.pmod(n, size - 1)).otherwise(F.pmod(n, size))  # past the letter itself
        known = F.substr(v["s"]["pool"], F.pmod(step, size) + 1, F.lit(1))
        first, many = v["r"]["first"], v["r"]["n"]
        moved = first + F.pmod(F.ascii(c) - first + 1 + F.pmod(n, many - 1), many)
        foreign = F.decode(F.unhex(F.lpad(F.hex(moved.cast("int")), 4, "0")), "UTF-16BE")
        latin = F.when(c.rlike(r"\p{Lu}"), _pick(LOWER.upper(), n)).when(c.rlike(r"\p{L}"), _pick(LOWER, n)).otherwise(c)
        return F.when(c == "", c).when(v["s"].isNotNull(), known).when(v["r"].isNotNull(), foreign).otherwise(latin)

    return F.concat_ws("", F.transform(F.split(text, ""), one))


def _syllables(digest: Column, n: Column) -> Column:
    pool = F.array(*map(F.lit, SYLLABLES))
    return F.concat_ws("", F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(pool, (F.pmod(_number(digest, i), F.lit(len(SYLLABLES))) + 1).cast("int"))))


def surrogate(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """Canonical form of the replacement; later attempts have room for more."""
    person = F.when(kind.startswith("given"), "given").otherwise(kind)  # the gender only picks the ending
    once = F.array(F.sha2(F.concat_ws("|", F.lit(key), person, canon, attempt.cast("string")), 512))

    def build(digest: Column) -> Column:
        random = F.concat_ws("", F.transform(F.split(canon, ""), lambda c, i: F.pmod(_number(digest, i), F.lit(10)).cast("string")))
        more = F.greatest(attempt - 2, F.lit(0))
        local, domain = F.regexp_extract(canon, "^([^@]*)@", 1), F.regexp_extract(canon, "@(.*)$", 1)
        label = F.regexp_extract(domain, "^([^.]*)", 1)
        place = F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), domain), 512)  # one domain stays one domain
        email = F.concat(_scramble(F.concat(local, F.repeat(F.lit("x"), more)), digest), F.lit("@"), _scramble(label, place), F.lit(".example"))
        body = F.concat(F.substring(canon, 1, 1), F.substr(random, F.lit(2), F.length(canon) - 2))
        card = F.concat(body, F.pmod(-luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))
        lead = lambda i: (F.pmod(_number(digest, F.lit(i)), F.lit(8)) + 2).cast("string")
        phone = F.when(F.length(canon) == 10, F.concat(lead(0), F.substring(random, 2, 2), lead(3), F.substring(random, 5, 6))).otherwise(random)
        ip = F.concat_ws(".", F.transform(F.split(canon, r"\."), lambda c, i: (F.pmod(_number(digest, i), F.lit(254)) + 1).cast("string")))
        word = _syllables(digest, attempt + 3)
        ending = F.when(kind == "given_m", _pick("nrsk", _number(digest, F.lit(31)))).when(kind == "given_f", F.lit("la")).otherwise(F.lit(""))
        last = F.substring(canon, -1, 1)
        ending_of = F.when(last == "а", "я").when(last == "я", "а").otherwise(_scramble(last, digest, 29))  # а and я carry the gender
        foreign = F.concat(_scramble(F.concat(F.substr(canon, F.lit(1), F.length(canon) - 1), F.repeat(last, more)), digest), ending_of)
        name = F.when(canon.rlike(r"^[\p{IsLatin}\-]+$"), F.concat(word, ending)).otherwise(foreign)
        return (
            F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "phone", phone)
            .when(kind == "ssn", F.concat(F.lit("9"), F.substr(random, F.lit(2), F.length(canon) - 1))).otherwise(name)
        )

    return F.transform(once, build)[0]


def formatted(kind: Column, raw: Column, made: Column) -> Column:
    """The replacement in the form that the match had: punctuation, country code and capitals."""
    country = F.when(kind == "phone", F.regexp_extract(raw, r"^(\+[0-9]{1,3})", 1)).otherwise(F.lit(""))
    rest = F.substr(raw, F.length(country) + 1, F.length(raw))
    start = F.struct(F.lit(0).alias("i"), F.lit("").alias("s"))
    placed = F.aggregate(
        F.split(rest, ""),
        start,
        lambda a, c: F.when(
            F.lit("0123456789").contains(c) & (c != ""), F.struct((a["i"] + 1).alias("i"), F.concat(a["s"], F.substr(made, a["i"] + 1, F.lit(1))).alias("s"))
        ).otherwise(F.struct(a["i"].alias("i"), F.concat(a["s"], c).alias("s"))),
        lambda a: a["s"],
    )
    cased = F.concat_ws("", F.transform(F.split(made, ""), lambda c, i: F.when(F.substr(raw, i + 1, F.lit(1)).rlike(r"\p{Lu}"), F.upper(c)).otherwise(c)))
    return F.when(kind.isin("card", "phone", "ssn"), F.concat(country, placed)).when(kind == "ip", made).otherwise(cased)


def matches(text: Column) -> Column:
    """All matches of a text, in order; texts that cannot hold one are passed by."""
    return F.when(text.rlike(GATE), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def clashes(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """(kind, canon, use, attempt) of the entities whose first surrogate, as their mention has it, would not do.

    A given name after different forms of address is one person: `use` is the
    kind that all mentions take, a gendered one if there is any. Surrogates of
    all names are checked together, those of other kinds by kind.
    """
    found = docs.select(F.explode(F.array_distinct(matches(F.col(text_col).cast("string")))).alias("m"))
    parts = cut(found.distinct().select(F.explode(parts_of(F.col("m"))).alias("p")).select("p.kind", "p.canon").distinct())
    person = F.when(F.col("kind").startswith("given"), "given").otherwise(F.col("kind"))
    name = F.col("person").isin("given", "family")
    state = parts.groupBy(person.alias("person"), "canon").agg(F.min("kind").alias("use"))
    state = cut(state.select(F.when(name, "name").otherwise(F.col("person")).alias("pool"), "person", "canon", "use", F.lit(0).alias("attempt")))
    while True:
        made = state.withColumn("made", surrogate(F.col("use"), F.col("canon"), F.col("attempt"), key))
        # Of those that share a surrogate the smallest (earliest attempt first) keeps it.
        order = F.struct("attempt", "canon", "person")
        best = made.groupBy("pool", "made").agg(F.min(order).alias("best"), F.count("*").alias("n")).where("n > 1")
        shared = made.join(best, ["pool", "made"]).where(order != F.col("best")).select("person", "canon")
        own = made.join(state.select("pool", F.col("canon").alias("made")), ["pool", "made"], "left_semi").select("person", "canon")
        again = cut(shared.union(own).distinct().withColumn("again", F.lit(1)))
        if again.isEmpty():
            mentions = parts.withColumn("person", person).join(state.select("person", "canon", "use", "attempt"), ["person", "canon"])
            return mentions.where((F.col("attempt") > 0) | (F.col("use") != F.col("kind"))).select("kind", "canon", "use", "attempt")
        state = cut(state.join(again, ["person", "canon"], "left").select("pool", "person", "canon", "use", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt")))


def is_type(name: str) -> Callable[[Column], Column]:
    return lambda kind: F.coalesce(kind == name, F.lit(False))


def replace_entities(docs: DataFrame, key: str, text_col: str = "text", broadcast_rows: int = 10_000) -> DataFrame:
    """docs' columns with entities of the text replaced, n_entities and n_<type> for each type.

    Texts without entities are unchanged; null stays null. Equal entities get
    equal surrogates in all rows, different ones different surrogates. Rows
    that repeat an id are treated each by itself, and an empty table gives an
    empty result. Columns of docs with the new names give way to them. Very long texts are rewritten whole, in memory linear in the text. `key` is secret: who has
    it can test guesses. Texts are rewritten where they are read; entities that
    need a later attempt are broadcast if they are at most `broadcast_rows`,
    else joined to the ids of the texts that hold them.
    """
    rare = clashes(docs, key, text_col)
    n_rare = rare.limit(broadcast_rows + 1).count()
    new = {"n_entities", *(f"n_{t}" for t in TYPES)}
    own = [c for c in docs.columns if c.lower() not in new]
    # The row travels as one column, so that none of its names can clash with those made here.
    rows = docs.select(F.struct(*(docs[c] for c in own)).alias("row"), docs[text_col].cast("string").alias("text"))
    rows = rows.withColumn("m", matches(F.col("text"))).withColumn("p", F.transform("m", parts_of))
    lookup = F.lit(None).cast("map<string,string>")
    rare = rare.select("kind", "canon", F.concat_ws("|", F.col("attempt").cast("string"), "use").alias("made_with"))
    if n_rare and n_rare <= broadcast_rows:
        known = {f"{r['kind']}:{r['canon']}": r["made_with"] for r in rare.toLocalIterator()}
        lookup = F.from_json(F.lit(json.dumps(known)), "map<string,string>")
    elif n_rare:
        # By the text's digest, so that equal texts share one row and ids may repeat or be null.
        rows = rows.withColumn("sha", F.sha2("text", 256))
        held = rows.where(F.size("m") > 0).select("sha", F.explode(F.flatten("p")).alias("e")).select("sha", "e.kind", "e.canon").distinct()
        entries = F.map_from_entries(F.collect_list(F.struct(F.concat("kind", F.lit(":"), "canon"), "made_with")))
        rows = rows.join(held.join(rare, ["kind", "canon"]).groupBy("sha").agg(entries.alias("known")), "sha", "left")
        lookup = F.col("known")

    def one(p: Column) -> Column:
        found = F.element_at(lookup, F.concat(p["kind"], F.lit(":"), p["canon"]))
        attempt = F.coalesce(F.substring_index(found, "|", 1).cast("int"), F.lit(0))
        kind = F.coalesce(F.substring_index(found, "|", -1), p["kind"])
        return formatted(kind, p["raw"], surrogate(kind, p["canon"], attempt, key))

    def whole(m: Column, parts: Column) -> Column:
        made = F.transform(parts, one)
        title = F.regexp_extract(m, rf"^({ADDRESS}\.? )", 1)
        named = F.get(parts, F.lit(0))["kind"].rlike("^(given|family)")
        one_of = F.get(parts, F.lit(0))
        inside = F.replace(m, one_of["raw"], F.get(made, F.lit(0)))  # a card may be a part of a run of digits
        return F.when(F.size(parts) == 0, m).when(named, F.concat(title, F.concat_ws(" ", made))).when(one_of["kind"] == "card", inside).otherwise(F.get(made, F.lit(0)))

    gaps = F.split("text", ANY, -1)
    pieces = F.zip_with(gaps, F.zip_with("m", "p", whole), lambda g, m: F.concat(g, F.coalesce(m, F.lit(""))))
    first = F.transform("p", lambda p: F.get(p, F.lit(0))["kind"])
    kinds = F.transform(first, lambda k: F.when(k.rlike("^(given|family)"), "name").otherwise(k))
    made = F.when(F.size("m") > 0, F.concat_ws("", pieces)).otherwise(F.col("text"))
    out = rows.withColumn("kinds", kinds).withColumn("made", made)
    counts = [F.size(F.array_remove(F.transform("kinds", is_type(t)), False)).cast("long").alias(f"n_{t}") for t in TYPES]
    total = F.size(F.filter("kinds", lambda k: k.isNotNull())).cast("long").alias("n_entities")
    same = text_col.lower()
    return out.select(*(F.col("made").alias(c) if c.lower() == same else F.col("row")[c].alias(c) for c in own), total, *counts)
