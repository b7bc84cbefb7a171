"""Operator 11 against Python's regular expressions, and its SQL against it."""

import hashlib
import re
import time

import duckdb
import pyarrow as pa
from llm_data import documents, empty_documents, odd_documents

from rankflow.llm import pii, queries

BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def slow_base(text):
    out = []
    for kind, pattern in BASE:
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15,
            }[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def with_check(body):
    return body + next(c for c in "0123456789" if luhn(body + c))


VISA, AMEX = with_check("453275918273645"), with_check("37828224631000")
GROUPED = " ".join(VISA[i : i + 4] for i in range(0, 16, 4))
TEXTS = [
    "write a.b%c+d@mail-1.example.co.uk, x@y, z@y.z@w.v, a@b.c_d@e.f and a@b.c.d@e.f; 💥é@x.y é.x@ü.y",
    "@@a@b.c@d.e a@b..c a@-.- .@.. _@_._ a@a@a.a",
    "1.2.3.4 256.1.1.1 0.0.0.0 00255.1.01.000 1.2.3.4.5.6.7.8 1.2.3 1..2.3.4 999999999999999999999.1.1.1 1000.2.3.4 .1.2.3.4. é1.2.3.4é",
    f"{VISA} {VISA}", f"{VISA}", f"x{VISA[:4]}-{VISA[4:8]} {VISA[8:12]}-{VISA[12:]}y", f"{VISA}1", f"9{VISA}", f"{VISA}  {VISA}", f"{GROUPED} {GROUPED}", f"order {VISA} {VISA}",
    f"card {AMEX}", f"{AMEX}", f"amex {AMEX[:4]} {AMEX[4:10]} {AMEX[10:]}", f"isbn card {AMEX}", with_check("9" * 17), with_check("4" * 18), "0" * 16, "0" * 20,
    "+1 (663) 555-6869 x", f"+1 (663) 555-6869 {VISA} {VISA}", "+12", "+1 2", "+1-2345678", "+1234567", "+12345678", "+" + "1" * 15, "+" + "1" * 16, "++1 234 567 890 ( ", "+1 (((((((2345678",
    "call (743) 555-3824 now", "(743) 555-3824", "phone: 743-555-3824 order", "tel 743.555.3824+1 743 555 3824", "fax é743 555 3824é",
    "IBAN DE89 3704 0044 0532 0130 00 AND", "DE89370400440532013000", "DE88370400440532013000", "konto GB82WEST12345698765432.", "xDE89370400440532013000", "order no: NO9386011117947",
    "ssn 123-45-6789", "123-45-6789", "ssn 000-45-6789 666-45-6789 912-45-6789 123-00-6789 123-45-0000", "social security: 123-45-6789-1",
    "a\x00b 1.2.3.4\n5.6.7.8 4\n5", "٣٤.1.2.3 １.2.3.4",
]


def rows_of(spark, texts):
    return documents(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_base_spans_and_digest(spark):
    got = by_id(pii.summary(pii.find_spans(rows_of(spark, [*TEXTS, None, ""]))))
    found = 0
    for i, text in enumerate([*TEXTS, None, ""]):
        want = slow_base(text)
        found += len(want)
        written = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got[i].base_sha256 == hashlib.sha256(written.encode()).hexdigest(), (text, got[i].spans, written)
        assert [got[i][f"n_{k}"] for k, _ in BASE] == [sum(w[0] == k for w in want) for k, _ in BASE]
        every = [tuple(s.split(":")) for s in got[i].spans.split(",") if s]
        assert {(k, str(a), str(b)) for k, a, b in want} <= set(every)
        place = [(pii.KINDS.index(k), int(a)) for k, a, _ in every]
        assert place == sorted(place) and all(int(b) <= len(text) for *_, b in every)
        for kind in pii.KINDS:
            ends = [(int(a), int(b)) for k, a, b in every if k == kind]
            assert all(x[1] <= y[0] for x, y in zip(ends, ends[1:]))
    assert found > 30


ADDED = [
    (f"{VISA} {VISA}", [("card", VISA)] * 2),
    (f"pay {GROUPED} {GROUPED}", [("card", GROUPED)] * 2),
    (f"order {VISA} {VISA}", []),
    (f"amex {AMEX}", [("card", AMEX)]),
    (AMEX, []),
    (f"isbn card {AMEX}", []),
    (f"+1 (663) 555-6869 {VISA} {VISA}", [("card", VISA), ("card", VISA), ("phone", "+1 (663) 555-6869")]),
    ("call (743) 555-3824 now", [("phone", "(743) 555-3824")]),
    ("(743) 555-3824", []),
    ("to DE89 3704 0044 0532 0130 00 AND", [("iban", "DE89 3704 0044 0532 0130 00")]),
    ("DE88370400440532013000", []),
    ("my ssn: 123-45-6789", [("ssn", "123-45-6789")]),
    ("123-45-6789", []),
]


def test_added_spans_and_scores(spark):
    got = by_id(pii.find_spans(rows_of(spark, [*[t for t, _ in ADDED], "mail a@b.c", "a@b.c", f"card {VISA}", f"tracking {VISA}"])))
    for i, (text, want) in enumerate(ADDED):
        assert [(s.kind, text[s.start : s.end]) for s in got[i].spans if not s.base] == want, text
    assert [s.score for i in range(len(ADDED), len(got)) for s in got[i].spans] == [1.0, 0.9, 1.0, 0.5]


def test_odd_tables(spark):
    assert pii.summary(pii.find_spans(empty_documents(spark))).count() == 0
    odd = odd_documents(spark)
    got = pii.summary(pii.find_spans(odd))
    assert got.count() == odd.count() and got.where("doc_id is null").count() == 2
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]


def test_many_spans_in_one_text(spark):
    """Places stay right over many blocks, and the time stays far from the square of the number of spans."""
    text = "".join(f"{'é' * (i % 7)}x{i}@m{i % 9}.org 10.0.{i % 300}.1 💥" for i in range(6000))
    row = pii.summary(pii.find_spans(rows_of(spark, [text]))).collect()[0]
    want = slow_base(text)
    assert row.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest() and len(want) > 11_000


UNITS = ["a", "1", "1 ", "a@", "1.", "+1", "+ ", "A1 ", "a@b.", "1-", "(1", "DE89 1"]


def test_long_runs_take_linear_time(spark):
    """Python's own search takes the square of such runs, so it tells the truth for the short ones only."""
    short = [unit * (2000 // len(unit)) for unit in UNITS]
    start = time.perf_counter()
    got = by_id(pii.summary(pii.find_spans(rows_of(spark, [*short, *[unit * (600_000 // len(unit)) for unit in UNITS]]))))
    assert time.perf_counter() - start < 60
    for i, text in enumerate(short):
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in slow_base(text)).encode()).hexdigest(), text[:9]


def test_plan_is_native(spark):
    plan = pii.summary(pii.find_spans(rows_of(spark, TEXTS)))._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_sql_says_the_same(spark):
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": list(range(len(TEXTS) + 2)), "text": [*TEXTS, None, ""]}))
    want = sorted(con.sql(queries.ORACLE["op11_personal_data"]).fetchall())
    assert sorted(tuple(r) for r in pii.summary(pii.find_spans(rows_of(spark, [*TEXTS, None, ""]))).collect()) == want
