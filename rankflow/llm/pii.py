"""Operator 11: personal data, by DataFrame functions only.

1. Regular expressions propose spans: a scan of a text gives every leftmost match with its place, from the pieces
   between the matches. All repetitions are possessive and runs are only entered at their start, so a scan is
   linear in the text, however long a run of letters or digits is.
2. Checksums and value ranges confirm: Luhn for card numbers, mod-97 for bank accounts, 0-255 for address parts,
   digit counts for phone numbers.
3. Words near a span adjust its score: +CONTEXT_GAIN for a word of its kind, -CONTEXT_LOSS for one of things that
   look alike (orders, versions), and a proposal counts from MIN_SCORE on.

The four base kinds are confirmed by their check alone; their score is told, but they stay whatever it is. To them
the method adds what the base patterns leave out: card numbers next to others or with 13 to 15 digits, phone
numbers inside longer digit runs or in national form, bank accounts and social security numbers.

Every row is judged on its own, and nothing is shuffled. A null text is an empty one and has no span; null and
repeated ids stay rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEAR = 48  # code points looked at on each side, up to the next proposal of the same scan
#: Scores in hundredths, so that sums are exact.
MIN_SCORE = 60
CONTEXT_GAIN, CONTEXT_LOSS = 30, 30
BLOCK = 64

# Kinds in the order of the result; the first four are the base kinds.
KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]
BASE_KINDS = KINDS[:4]

# Lengths of bank account numbers by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE LT LU", 21: "CH HR LI LV", 22: "BG DE GB GE IE ME RS",
    23: "GI IL", 24: "AD CZ ES MD RO SE SK TN", 25: "PT", 26: "IS TR", 27: "FR GR IT MC SM", 28: "AL CY HU LB PL", 31: "MT",
}

# Words that speak for a kind, and words of numbers that only look alike.
CONTEXT = {
    "email": "e-?mail|mail|contact|write to|correo|courriel",
    "ip": "ip|address|host|server|login|client|adresse",
    "card": "card|credit|debit|visa|mastercard|amex|cc|tarjeta|carte|karte|kreditkarte",
    "phone": "phone|tel|telephone|call|mobile|cell|fax|whatsapp|telefon|telefono|handy|appelez",
    "iban": "iban|account|bank|konto|cuenta|compte",
    "ssn": "ssn|social security|social",
}
AGAINST = "isbn|issn|order|invoice|version|serial|sku|tracking|build|release"

# Word boundary between ASCII word signs, as expressions that do not depend on the language of the text.
START, END = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"

LOCAL, LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
# A run is entered at its start, or where the match before ended.
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
DIGITS = r"[0-9](?:[\x20-]?[0-9])++"
NATIONAL = rf"\(?{START}[0-9]{{3}}\)?[ .-][0-9]{{3}}[ .-][0-9]{{4}}{END}"
PHONE = rf"\+[0-9][\x20().0-9-]+[0-9]|{NATIONAL}"
SSN = rf"{START}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{END}"
IBAN = START + "(?:" + "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items()) + ")" + END
#: Card numbers inside a longer run of digits and separators: alone, or in groups of 4-4-4-4 or 4-6-5.
INNER_CARD = (
    rf"{START}(?:[0-9]{{4}}[\x20-][0-9]{{4}}[\x20-][0-9]{{4}}[\x20-][0-9]{{4}}|[0-9]{{4}}[\x20-][0-9]{{6}}[\x20-][0-9]{{5}}|[0-9]{{13,19}}){END}"
)
INNER_PHONE = rf"\+1[\x20.-]?\(?[0-9]{{3}}\)?[\x20.-]{{0,2}}[0-9]{{3}}[\x20.-]?[0-9]{{4}}{END}"


@dataclass(frozen=True)
class Rule:
    """What a scan's matches are: base spans if ``confirm`` holds, else proposals by ``other`` and ``inner``."""

    kind: str
    pattern: str
    score: int
    confirm: Callable[[Column], Column] | None = None
    #: Score of a match that is no base span, before its context; null: no proposal.
    other: Callable[[Column], Column] | None = None
    #: Pattern and score of proposals inside a match that failed.
    inner: str | None = None
    inner_score: Callable[[Column], Column] | None = None


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value evaluated once."""
    return F.transform(F.array(value), body)[0]


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits ends in its Luhn check digit."""
    places = F.split(F.reverse(digits), "")
    worth = F.transform(places, lambda c, i: F.when(i % 2 == 1, F.translate(c, "0123456789", "0246813579")).otherwise(c).cast("int"))
    return F.aggregate(worth, F.lit(0), lambda acc, x: acc + x) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether a bank account number, without spaces, leaves 1 modulo 97 with its letters as 10 to 35."""
    turned = F.concat(F.substr(account, F.lit(5)), F.substring(account, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        value = F.conv(c, 36, 10).cast("int")
        return (rest * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def small_parts(m: Column) -> Column:
    """Every part of a dotted number at most 255, leading zeros allowed."""
    return m.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|(?<=0))(?:\.|$)){4}$")


def card_number(m: Column) -> Column:
    return let(digits_of(m), lambda d: F.length(d).between(16, 19) & F.when(F.length(d) <= 19, luhn(d)).otherwise(False))


def inner_card_score(m: Column) -> Column:
    """Luhn decides; below 16 digits, or without an issuer's first digit, a word nearby is needed."""
    sure = (F.length(digits_of(m)) >= 16) & m.rlike("^[3-6]")
    return F.when(let(digits_of(m), luhn), F.when(sure, 60).otherwise(40))


def phone_digits(m: Column) -> Column:
    return m.startswith("+") & F.length(digits_of(m)).between(8, 15)


def issued_ssn(m: Column) -> Column:
    return ~m.rlike("^(?:000|666|9)") & ~m.rlike("-00-") & ~m.rlike("-0000$")


RULES = [
    Rule("email", EMAIL, 90, confirm=lambda m: F.lit(True)),
    Rule("ip", IP, 70, confirm=small_parts),
    Rule("card", DIGITS, 80, confirm=card_number, inner=INNER_CARD, inner_score=inner_card_score),
    Rule(
        "phone", PHONE, 70, confirm=phone_digits,
        other=lambda m: F.when(~m.startswith("+"), F.lit(40)), inner=INNER_PHONE, inner_score=lambda m: F.lit(80),
    ),
    Rule("iban", IBAN, 90, other=lambda m: F.when(mod97(F.translate(m, " ", "")), F.lit(90))),
    Rule("ssn", SSN, 40, other=lambda m: F.when(issued_ssn(m), F.lit(40))),
]


def running_starts(lengths: Column) -> Column:
    """Where each match starts, from (gap before it, its length); in blocks, so that long lists are not copied over and over."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("starts"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        return F.struct((start + x["size"]).alias("at"), F.concat(acc["starts"], F.array(start)).alias("starts"))

    def carry(acc: Column, block: Column) -> Column:
        moved = F.struct(acc["at"].alias("gap"), block["starts"].alias("starts"))
        return F.struct((acc["at"] + block["at"]).alias("at"), F.concat(acc["blocks"], F.array(moved)).alias("blocks"))

    def blocks(all_lengths: Column) -> Column:
        count = F.ceil(F.size(all_lengths) / F.lit(BLOCK)).cast("int")
        return F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.aggregate(F.slice(all_lengths, b * BLOCK + 1, BLOCK), zero, step))

    none = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<gap:bigint,starts:array<bigint>>>").alias("blocks"))
    folded = F.aggregate(let(lengths, blocks), none, carry)["blocks"]
    return F.flatten(F.transform(folded, lambda b: F.transform(b["starts"], lambda s: s + b["gap"])))


def scan(text: Column, pattern: str) -> Column:
    """Array of (m, start, before, after): every leftmost match, its place in code points and the text around it."""
    shape = "array<struct<m:string,start:bigint,before:string,after:string>>"

    def found(s: Column) -> Column:
        gaps = F.slice(s["gaps"], 1, F.size(s["ms"]))
        lengths = F.zip_with(gaps, s["ms"], lambda g, m: F.struct(F.length(g).cast("long").alias("gap"), F.length(m).cast("long").alias("size")))
        return let(
            running_starts(lengths),
            lambda starts: F.transform(
                s["ms"],
                lambda m, i: F.struct(
                    m.alias("m"), starts[i].alias("start"), F.substring(s["gaps"][i], -NEAR, NEAR).alias("before"), F.substring(s["gaps"][i + 1], 1, NEAR).alias("after")
                ),
            ),
        )

    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("ms"))
    return F.when(text.rlike(pattern), let(parts, found)).otherwise(F.array().cast(shape))


def near(kind: str, before: Column, after: Column) -> Column:
    """What the words around a span add to its score."""
    around = F.concat(before, F.lit(" \n "), after)

    def has(words: str) -> Column:
        return around.rlike(rf"(?i){START}(?:{words}){END}")

    return F.when(has(CONTEXT[kind]), CONTEXT_GAIN).otherwise(0) - F.when(has(AGAINST), CONTEXT_LOSS).otherwise(0)


def span(kind: str, start: Column, m: Column, score: Column, base: Column) -> Column:
    end = start + F.length(m)
    return F.struct(F.lit(KINDS.index(kind)).alias("place"), start.alias("start"), end.alias("end"), F.when(score > 100, 100).otherwise(score).cast("int").alias("score"), base.alias("base"))


def spans_of(text: Column, rule: Rule) -> Column:
    """Array of the spans of one rule: base ones, and added ones that reach MIN_SCORE."""

    def judged(x: Column) -> Column:
        bonus = near(rule.kind, x["before"], x["after"])
        none = F.array().cast("array<struct<place:int,start:bigint,end:bigint,score:int,base:boolean>>")

        def one(score: Column, base: bool) -> Column:
            return F.array(span(rule.kind, x["start"], x["m"], score + bonus, F.lit(base)))

        failed = none
        if rule.inner:
            inside = F.transform(
                scan(x["m"], rule.inner),
                lambda y: span(rule.kind, x["start"] + y["start"], y["m"], rule.inner_score(y["m"]) + bonus, F.lit(False)),
            )
            failed = F.filter(inside, lambda s: F.coalesce(s["score"] >= MIN_SCORE, F.lit(False)))
        if rule.other:
            other = rule.other(x["m"])
            failed = F.when(F.coalesce(other + bonus >= MIN_SCORE, F.lit(False)), one(other, False)).otherwise(failed)
        if rule.confirm is None:
            return failed
        return F.when(rule.confirm(x["m"]), one(F.lit(rule.score), True)).otherwise(failed)

    return F.flatten(F.transform(scan(text, rule.pattern), judged))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): array of (kind, start, end, score, base) by kind as listed in KINDS and then start."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"))
    found = F.concat(*[spans_of(F.col("text"), rule) for rule in RULES])
    kinds = F.array(*[F.lit(k) for k in KINDS])
    named = F.transform(F.array_sort(found), lambda s: F.struct(kinds[s["place"]].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), (s["score"] / 100).alias("score"), s["base"].alias("base")))
    return rows.select("doc_id", named.alias("spans"))


def summary(spans: DataFrame) -> DataFrame:
    """Per row the number of base spans of each base kind, the digest of the base spans and the text of all."""

    def written(part: Column) -> Column:
        return F.array_join(F.transform(part, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["base"])
    counts = [count(k) for k in BASE_KINDS]
    return spans.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))

