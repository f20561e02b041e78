import hashlib
import random
import re

from pyspark.sql import functions as F

from tillstar.llm import personal_data as P
from tillstar.llm.personal_data import digest, find_personal_data, redact

BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(d):
    s = 0
    for k, c in enumerate(reversed(d)):
        v = int(c) * (1 + k % 2)
        s += v - 9 * (v > 9)
    return s % 10 == 0


def ok(kind, v):
    d = re.sub("[^0-9]", "", v)
    return {"email": True, "ip": all(int(x) <= 255 for x in v.split(".")) if kind == "ip" else True,
            "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, rx in BASE for m in re.finditer(rx, text or "") if ok(k, m.group())]


BITS = ["a@b.c", "x.y%z@mail-1.example.com", "@", ".", "..", "a@b", "_d@e.f", "1.2.3.4", "255.255.255.256", "01.002.3.4.5", "4539 1488 0343 6467",
        "4539148803436467", "4539-1488-0343-6468", "+1 (249) 555-6835", "+49", "+1234567890123456", " ", "  ", "-", "é", "😀", "ß1", "\n", "word", "9" * 40, "\x01", "+"]


def test_base_spans_as_plain_regular_expressions(spark):
    rnd = random.Random(3)
    texts = [None, "", "\x01", "1 " * 30000, "a" * 50000, "+1" * 5000, "a.b@c.d" * 2000]
    texts += ["".join(rnd.choice(BITS) for _ in range(rnd.randrange(1, 25))) for _ in range(600)]
    rows = digest(find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        got = [s for s in r.spans.split(",") if s and s.split(":")[0] in dict(BASE)]
        assert got == want, texts[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k, _ in BASE]


def test_checksums_and_context_of_added_kinds(spark):
    texts = ["IBAN GB82 WEST 1234 5698 7654 32 ok", "IBAN GB82 WEST 1234 5698 7654 33 ok", "my ssn is 123-45-6789.",
             "part 123-45-6789.", "call (249) 555-6835 now", "order 249-555-6835"]
    rows = find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    kinds = [[s.kind for s in r.personal_data] for r in sorted(rows, key=lambda r: r.doc_id)]
    assert kinds == [["iban"], [], ["ssn"], [], ["tel"], []]
    assert texts[0][5:32] == "GB82 WEST 1234 5698 7654 32"
    assert (rows[0].personal_data[0].start, rows[0].personal_data[0].end) == (5, 32)


def test_iban_before_capitals_and_digits(spark):
    gb, de = "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"
    texts = {f"IBAN {gb} BIC WESTGB2L": [gb], f"{de} EUR 500": [de], f"{de} {gb} 7": [de, gb], f"{de}.": [de], f"{de}5": [], "DE88370400440532013000 EUR 500": [],
             f"NO9386011117947 KID 12345 {de}": ["NO9386011117947", de]}
    rows = find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        assert [r.text[s.start:s.end] for s in r.personal_data if s.kind == "iban"] == texts[r.text], r.text


def test_redact_keeps_extra_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "é a@b.cc, 1.2.3.4!", "k", 5)], "doc_id long, text string, kind string, start int")
    assert redact(df).collect()[0].text == "é [email], [ip]!"
    assert redact(df).columns == df.columns
    assert find_personal_data(df.limit(0)).count() == 0


def test_many_spans_in_one_text_in_about_linear_time(spark):
    import time

    df = spark.range(1).select(F.lit(1).alias("doc_id"), F.expr("repeat('me@ex.co ', 60000)").alias("text"))
    start = time.time()
    r = P.digest(P.find_personal_data(df)).collect()[0]
    assert r.n_email == 60000 and r.spans.endswith("email:539991:539999") and time.time() - start < 90


def test_context_over_several_short_pieces(spark):
    # the word that names the number stands before other matches, within 40 characters
    texts = ["phone a@b.c 555-123-4567", "phone " + "a@b.c " * 5 + "555-123-4567", "phone " + "a@b.c " * 6 + "x 555-123-4567"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [sum(s.kind == "tel" for s in r.personal_data) for r in P.find_personal_data(df).collect()]
    assert got == [1, 1, 0]


def test_clashing_names(spark):
    names = ["row", "safe", "found", "__safe", "__found", "personal_data", "body"]
    df = spark.createDataFrame([tuple(range(6)) + ("mail x@y.org",)], ", ".join(f"`{n}` {'string' if n == 'body' else 'long'}" for n in names))
    out = P.find_personal_data(df, "body")
    assert out.columns == names
    r = out.collect()[0]
    assert [r[n] for n in names[:5]] == list(range(5)) and r.personal_data[0].kind == "email"
    red = P.redact(df, "body")
    assert red.columns == names and list(red.collect()[0]) == [*range(6), "mail [email]"]
