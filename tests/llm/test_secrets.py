import hashlib
import random
import re

import public_tokenizers

from tillstar.llm import secrets as S

WORDS = S.dictionary(public_tokenizers.path("byte_bpe_50k.json"))


def brute_base(t):
    out = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in re.finditer(
        r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
        r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t) if len(m[2]) >= 8]
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return [x for _, _, x in sorted(out)]


BITS = ["password", "PassWd", "secret", "ſecret", "toKen", "api_key", "APIKEY", "=", ":", " ", "'", '"', "abc", "12345678", "AKIA", "ABCDEF0123456789",
        "0123456789abcdef", "deadbeef" * 4, "é", "😀", "\n", "-", "/", "g", "monkey", "correct.horse"]


def test_base_spans_as_plain_regular_expressions(spark):
    rnd = random.Random(2)
    texts = [None, "", "password=" + "a" * 20000, "f" * 5000, "token " * 3000]
    texts += ["".join(rnd.choice(BITS) for _ in range(rnd.randrange(1, 25))) for _ in range(800)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    rows = S.find_secrets(df).collect()
    assert len(rows) == len(texts)
    for r in rows:
        got = [f"{s.kind}:{s.start}:{s.end}" for s in r.secrets if s.kind != "credential"]
        want = brute_base(texts[r.doc_id] or "")
        assert got == want, texts[r.doc_id]
        row = S.digest_row([(s.start, s.end, s.kind) for s in r.secrets])
        assert row[3] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert r.spans == "x" and r.text == texts[r.doc_id]


def exhaustive(value):
    """Cheapest cut by trying every cut."""
    if not value:
        return 0.0
    import math
    return min(cost + math.log10(5) + exhaustive(value[end:]) for end, cost in S._pieces(value, WORDS, 0))


def test_cheapest_cut_as_trying_every_cut():
    rnd = random.Random(4)
    for v in ["password1", "qwerty12", "aaaaaa", "abcabcabc", "1999-12-31", "P@ssw0rd", "x7Kq", "monkey12"] + [
            "".join(rnd.choice("ab1q!") for _ in range(7)) for _ in range(30)]:
        assert abs(S.log10_guesses(v, WORDS) - exhaustive(v)) < 1e-9


def test_guessable_values_are_no_credentials():
    cost = lambda v: S.log10_guesses(v, WORDS)
    assert cost("password") < cost("P4ssw0rd") < cost("x9$Lq2!vTz") and cost("qwertyuiop") < 7 < S.MIN_LOG10_GUESSES < cost("x9$Lq2!vTz8")
    assert [k for _, _, k in S.spans_of("pwd: x9$Lq2!vTz8#, then", WORDS)] == ["credential"]
    assert S.spans_of("pwd: letmein123", WORDS) == [] and S.spans_of("the secret handshake is known", WORDS) == []


def test_a_name_after_a_name_does_not_hide_the_value():
    for text, value in (("Authorization: Bearer x9$Lq2!vTz8#pQ", "x9$Lq2!vTz8#pQ"), ("auth password: G7#kQ!z9xV$2", "G7#kQ!z9xV$2"),
                        ("pass passphrase: G7#kQ!z9xV$2, then", "G7#kQ!z9xV$2"), ("auth client_secret => 'x9$Lq2!vTz8#pQ'", "x9$Lq2!vTz8#pQ"),
                        ("token secret token bearer private-key: x9$Lq2!vTz8#pQ", "x9$Lq2!vTz8#pQ")):
        at = text.index(value)
        assert S.spans_of(text, WORDS) == [(at, at + len(value), "credential")], text
        assert S._masked(text, S.spans_of(text, WORDS)) == text.replace(value, "[secret]")
    assert S.spans_of("the auth passphrase: letmein123 and " + "secret " * 3000, WORDS) == []


def test_masked_texts_keep_the_rest(spark):
    df = spark.createDataFrame([(1, "é password=abcdefgh12 z", 3), (2, None, 4), (3, "clean", 5)], "doc_id long, text string, secrets int")
    out = S.mask_secrets(df)
    assert out.columns == df.columns
    assert [(r.text, r.secrets) for r in sorted(out.collect(), key=lambda r: r.doc_id)] == [("é [secret] z", 3), (None, 4), ("clean", 5)]
    assert S.mask_secrets(df.limit(0)).count() == 0


def test_guess_cost_of_very_long_values_in_linear_time():
    import time

    words = S.dictionary(S._vocabulary_path(None))
    for value in ("a1~" * 333_333, "ab" * 500_000, "qwertyuiop" * 100_000, "abcdefgh" * 125_000, "x" * 1_000_000):
        start = time.time()
        S.log10_guesses(value, words, S.MIN_LOG10_GUESSES)
        assert time.time() - start < 20
    # without a bound too: one repeat costs what its unit and count cost
    assert S.log10_guesses("a1~" * 4000, words) < S.log10_guesses("a1~" * 40, words) + 2.1


def test_runs_as_by_hand():
    r = S._Runs("aaaa12345qwertyab")
    assert [r.repeat(k, 1) for k in range(4)] == [4] * 4 and r.repeat(0, 2) == 4 and r.repeat(1, 2) == 3
    assert r.count(4) == 8 and r.count(6) == 8
    assert r.walk(9)[0] == 15 and r.walk(12) == (15, 2)  # steps of 2 and 5 code points
    # a letter whose small form is two characters keeps its place
    assert len(S._Runs("İabc").low) == 4
