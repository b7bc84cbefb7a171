"""Small tables with the odd cases that every operator has to stand."""

import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))]
)
#: Names that operators use inside.
CLASHING = ["id", "row", "fp", "key", "anchor", "count", "score", "rejected", "n", "kept", "a", "b", "vec", "shard"]

SYLLABLES = {"en": ["the", "on", "ing", "wh", "ed", "ha"], "de": ["sch", "ung", "ich", "ver", "zu", "ein"], "fr": ["eau", "oir", "que", "é", "ais", "ou"]}


def words(rng: random.Random, n: int, lang: str = "en") -> list[str]:
    return ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(n)]


def texts(seed: int = 5, n: int = 60) -> list[tuple[str | None, str | None]]:
    """(text, language): prose, exact and near copies, shared passages, nulls, empties, signs, odd white space, one long text."""
    rng = random.Random(seed)
    passage = words(rng, 90)
    out: list[tuple[str | None, str | None]] = []
    for i in range(n):
        lang = rng.choice(["en", "de", "fr"])
        w = words(rng, rng.randrange(3, 160), lang)
        if i % 5 == 0:
            w = w[: len(w) // 2] + passage[: rng.randrange(15, 90)] + w[len(w) // 2 :]
        if i % 7 == 0 and out:
            w = (out[rng.randrange(len(out))][0] or "x").split(" ")
            if i % 2 and len(w) > 3:
                w[rng.randrange(len(w))] = "changed"
        out.append((rng.choice([" ", "  ", "\n", " "]).join(w), lang))
    out += [(None, "en"), (None, None), ("", "de"), ("   \n\t ", "fr"), ("...!? 123", "en"), ("a b", None), ("Ünï çødé 漢字 💥   x", None), ("　tab\x0bline\x0c", "en")]
    out += [(" ".join(["same"] * 200), "en"), (" ".join(words(rng, 6000)), "en"), (("ab" * 400), "en"), ("AbC " * 3, "en"), ("abc " * 3, "en")]
    return out


def documents(spark, rows=None, clashing: bool = True):
    rows = rows if rows is not None else [(i, t, lang, "s", len(t or "")) for i, (t, lang) in enumerate(texts())]
    df = spark.createDataFrame(rows, DOCUMENTS).repartition(3)
    if clashing:
        df = df.select("*", *[F.lit("other").alias(c) for c in CLASHING])
    return df


def odd_documents(spark):
    """The same with null and repeated ids and repeated rows."""
    rows = [(i, t, lang, "s", len(t or "")) for i, (t, lang) in enumerate(texts(9, 30))]
    return documents(spark, [*rows, *rows[:6], (None, rows[0][1], "en", "s", 1), (None, None, None, None, None), (3, "another text of id three", "en", "s", 3)])


def empty_documents(spark):
    return documents(spark, [])
