r"""Operator 7 [native]: personal data spans by pattern, checksum and context.

Regular expressions propose spans, leftmost and non-overlapping for each kind;
validators confirm them (octets of an address, digit counts, Luhn, mod-97); words
nearby raise or lower a span's score.  Built-in column functions only.

Kinds, in the order of the results.  The base kinds are accepted when their validator
holds: ``email``, ``ip``, ``card`` (Luhn), ``phone`` (international).  Added kinds
need a checksum or a context word: ``iban`` (mod-97), ``ssn`` and ``tel`` (national
forms, which count only near words that name them).

Positions are found by putting a mark (U+0001) round each match, splitting at the
marks and adding up the lengths of the pieces; a U+0001 of the text itself is first
turned into U+0002, which no pattern matches.  Patterns start only where a run of
their characters starts and quantifiers that nothing follows are possessive,
which gives the same matches in linear time and without deep recursion.

NULL text counts as empty; empty texts have no spans; ``spans`` is then ''.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, table, unwrapped, whole_rows

MARK, OTHER = "\x01", "\x02"
# Characters on both sides of a span in which context words count.
CONTEXT_CHARS = 40
# Elements of an array that is built one by one.
BLOCK = 256


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str      # as Spark runs it
    gate: str         # a text without a match of this has no span
    score: float      # before context
    words: str        # context words that raise the score
    base: bool = True
    least: float = 0.0  # an added kind's span below this score is dropped


# Characters of an IBAN after its country and check digits, by country (the registry's lengths less 4).
IBAN_REST = {11: "NO", 12: "BE", 14: "DK FI FO GL NL SD FK", 15: "MK SI", 16: "AT BA EE KZ LT LU XK MN", 17: "CH CR HR LI LV",
             18: "BG BH DE GB GE IE ME RS VA", 19: "AE GI IL IQ OM SO TL", 20: "AD CZ ES MD PK RO SA SE SK TN VG",
             21: "LY PT ST", 22: "IS TR", 23: "BI DJ FR GR IT MC SM MR", 24: "AL AZ BY CY DO GT HU LB PL SV NI", 25: "BR EG PS QA UA",
             26: "JO KW MU YE", 27: "MT SC", 28: "LC", 29: "RU"}
_REST = "|".join(rf"(?:{names.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n}}}" for n, names in IBAN_REST.items())
_LISTED = "|".join(" ".join(IBAN_REST.values()).split())

_MAIL = "[A-Za-z0-9._%+-]"
KINDS = (
    Kind("email", rf"(?:(?<!{_MAIL})|\G){_MAIL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.8, "mail|contact|write"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]", 0.6, "ip|address|host|server|login"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "[0-9][0-9 -]{11}", 0.7, "card|visa|credit|pay|cvv|amex"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.7, "phone|tel|call|mobile|fax|cell"),
    # a listed country's IBAN has its fixed length; others go on as far as they can
    Kind("iban", rf"(?<![A-Za-z0-9])(?:(?:{_REST})(?![A-Za-z0-9])|(?!{_LISTED})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}+)", "[A-Z]{2}[0-9]{2}", 0.8,
         "iban|account|bank|transfer", False, 0.5),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]-[0-9]", 0.3, "ssn|social|security", False, 0.5),
    Kind("tel", r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])", "[0-9]{3}", 0.3,
         "phone|tel|call|mobile|fax|cell", False, 0.5),
)
# Words that make a span less likely to be someone's data.
DOUBT = "example|sample|test|version|order|invoice|serial"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Sum of the digits, every second one from the right doubled (less 9 above 9), is a multiple of 10."""
    pairs = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(pairs, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _mod97(value: Column) -> Column:
    """IBAN check: first four characters moved to the end, letters as 10..35, remainder 1."""
    plain = F.regexp_replace(value, " ", "")
    chars = F.split(F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4)), "")
    step = lambda a, c: F.when(c == "", a).when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise(
        (a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(chars, F.lit(0), step) == 1


def _valid(kind: Kind, value: Column) -> Column:
    n = F.length(_digits(value))
    if kind.name == "ip":
        part = lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")
        return F.forall(F.split(value, r"\."), lambda x: (F.length(part(x)) <= 3) & (F.substring(part(x), 1, 3).cast("int") <= 255))
    if kind.name == "card":
        return n.between(13, 19) & _luhn(_digits(value))
    if kind.name == "phone":
        return n.between(9, 15)
    if kind.name == "iban":
        return F.length(F.regexp_replace(value, " ", "")).between(15, 34) & _mod97(value)
    return F.lit(True)


def _bound(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sums_before(numbers: Column) -> Column:
    """Sum of the elements before each one.  In blocks: an array that grows by one element is copied each time."""
    def grown(part: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("before"))
        return F.aggregate(part, zero, lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["before"], F.array(a["sum"])).alias("before")))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / BLOCK).cast("int")),
                         lambda b: grown(F.slice(numbers, b * BLOCK + 1, F.lit(BLOCK))))
    return _bound(blocks, lambda done: _bound(grown(F.transform(done, lambda x: x["sum"]))["before"], lambda base: F.flatten(
        F.transform(done, lambda x, i: F.transform(x["before"], lambda v: v + F.get(base, i))))))


def _spans(kind: Kind, text: Column) -> Column:
    """array<struct<kind, start, end, score>> of the kind's valid spans, in order.  Matches are every
    second piece of the marked text; positions are sums of the pieces' lengths, and a span's
    context is put together from the pieces round it, so nothing walks the text from its start."""
    dtype = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"
    # matches have two characters or more, so this many pieces hold the context
    near, chars = F.lit(CONTEXT_CHARS), CONTEXT_CHARS
    marked = F.split(F.regexp_replace(text, f"({kind.pattern})", f"{MARK}$1{MARK}"), MARK)

    def spans(parts: Column, starts: Column, heads: Column, tails: Column) -> Column:
        def one(i: Column) -> Column:
            before = F.right(F.array_join(F.slice(tails, F.greatest(F.lit(1), i + 1 - chars), F.least(i, near)), ""), near)
            after = F.left(F.array_join(F.slice(heads, i + 2, near), ""), near)

            def scored(around: Column) -> Column:
                score = (F.lit(kind.score) + F.when(around.rlike(rf"\b(?:{kind.words})"), 0.2).otherwise(0.0)
                         - F.when(around.rlike(rf"\b(?:{DOUBT})"), 0.2).otherwise(0.0))
                start = F.get(starts, i)
                return F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), (start + F.length(F.get(parts, i))).alias("end"),
                                F.round(score, 2).alias("score"))

            return _bound(F.lower(F.concat(before, F.lit(" "), after)), scored)

        valid = F.filter(F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2)), lambda i: _valid(kind, F.get(parts, i)))
        found = F.transform(valid, one)
        return (found if kind.base else F.filter(found, lambda s: s["score"] >= kind.least)).cast(dtype)

    def pieces(parts: Column) -> Column:
        starts = _bound(F.transform(parts, lambda p: F.length(p).cast("long")), _sums_before)
        return F.when(F.size(parts) > 2, _bound(starts, lambda at: _bound(F.transform(parts, lambda p: F.left(p, near)), lambda heads: _bound(
            F.transform(parts, lambda p: F.right(p, near)), lambda tails: spans(parts, at, heads, tails))))).otherwise(F.array().cast(dtype))

    return F.when(text.rlike(kind.gate), _bound(marked, pieces)).otherwise(F.array().cast(dtype))


def find_personal_data(docs: DataFrame, text_col: str = "text", out: str = "personal_data") -> DataFrame:
    """``docs`` with ``out``: array<struct<kind, start, end, score>>, by kind as listed,
    then by start; code points, end exclusive.  A column of that name is replaced, others stay as they
    are, whatever their names."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    safe = F.when(text.contains(MARK), F.translate(text, MARK, OTHER)).otherwise(text)
    rows = whole_rows(docs, safe=safe)
    return unwrapped(rows, docs.columns, {out: F.concat(*[_spans(k, F.col("safe")) for k in KINDS])})


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each span of the text replaced by its kind in square brackets
    (of overlapping spans, the one that starts first)."""
    rows = find_personal_data(whole_rows(docs, text=F.col(f"`{text_col}`")), "text", "found").withColumn("found", F.expr(
        "array_sort(transform(found, s -> struct(s.start, s.end, s.kind)))"))
    text = F.coalesce(F.col("text"), F.lit(""))
    first = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("text"))

    def step(a, s):
        gap = F.substring(text, (a["at"] + 1).cast("int"), F.greatest(F.lit(0), (s["start"] - a["at"]).cast("int")))
        return F.when(s["start"] < a["at"], a).otherwise(F.struct(
            s["end"].alias("at"), F.concat(a["text"], gap, F.lit("["), s["kind"], F.lit("]")).alias("text")))

    rest = lambda a: F.concat(a["text"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text)))
    return unwrapped(rows, docs.columns, {text_col: F.when(F.size("found") > 0, F.aggregate("found", first, step, rest)).otherwise(F.col("text"))})


def digest(rows: DataFrame, found: str = "personal_data") -> DataFrame:
    base = [k.name for k in KINDS if k.base]
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    only = lambda name: F.filter(found, lambda s: s["kind"] == name)
    return rows.select(
        "doc_id", *[F.size(only(k)).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(text(F.filter(found, lambda s: s["kind"].isin(base))).cast("binary"), 256).alias("base_sha256"),
        text(F.col(found)).alias("spans"))


def query(spark, sf_dir: str) -> DataFrame:
    return digest(find_personal_data(id_and_text(table(spark, sf_dir, "documents"))))
