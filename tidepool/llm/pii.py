"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score. Built-in functions only.

Base kinds are email, ip, card (Luhn) and phone, leftmost and non-overlapping per kind; a proposal whose validator fails
is dropped and not retried. The method adds the kinds

* iban: country letters, check digits and as many letters or digits as the country's numbers have, with or without single
  blanks between, that pass mod 97;
* id: runs of 6 to 18 digits, plain or with hyphens, that no checksum covers: they count only if a word near them
  says what they are (CONTEXT), and meet no other span.

Each span has a score: what its validator is worth, plus a bonus if a word of CONTEXT stands within BEFORE characters before
it or AFTER characters behind it, whatever other matches lie between. Spans of at least MIN_SCORE are reported; base spans
always reach it.

Positions are found by splitting a text at the matches and summing lengths, in code points; running sums and maxima take
log2(n) steps of one pass each over a text's n matches (``running``), so that no array or string is built up piece by piece.
Patterns are possessive and can begin only where a run begins (or where the last match ended), so that a pass is linear in
the text. A kind's costlier steps run only for texts that have one of its matches.

Null and empty texts have no spans. Rows are independent: repeated rows and ties need no rule. ``spans``
and ``redact`` keep all columns, whatever their names (``spans`` replaces one named as its result).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fresh

KINDS = ("email", "ip", "card", "phone", "iban", "id")
# Length of a country's account numbers (IBAN registry).
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29,
    "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}


def _iban_pattern() -> str:
    """Numbers of each country's length, a single blank allowed before any character, with no letter or digit right before or behind."""
    by_length: dict[int, list[str]] = {}
    for country, n in IBAN_LENGTHS.items():
        by_length.setdefault(n, []).append(country)
    each = "|".join(rf"(?:{'|'.join(codes)})\x20?[0-9]\x20?[0-9](?:\x20?[A-Z0-9]){{{n - 4}}}" for n, codes in sorted(by_length.items()))
    return rf"(?<![A-Za-z0-9])(?=[A-Z][A-Z]\x20?[0-9])(?:{each})(?![A-Za-z0-9])"


PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": _iban_pattern(),
    "id": r"(?<![A-Za-z0-9@.+-])[0-9](?:-?[0-9]){5,17}+(?![A-Za-z0-9@-])",
}
#: Words that speak for a kind when they stand near a span.
CONTEXT = {
    "email": r"e-?mail|mail|contact|correo|courriel",
    "ip": r"\bip\b|address|host|server|adresse",
    "card": r"card|credit|visa|master|amex|tarjeta|carte|karte",
    "phone": r"phone|tel|call|mobile|fax|tel[eé]fono|telefon",
    "iban": r"iban|account|bank|konto|compte|cuenta",
    "id": r"\bssn\b|social security|passport|tax id|national id|driver.?s licen[cs]e|ausweis|passeport|pasaporte|\bdni\b",
}
#: What a confirmed match is worth, and what a context word adds.
WORTH = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.6, "iban": 0.95, "id": 0.2}
BONUS = 0.35
MIN_SCORE = 0.5
BEFORE, AFTER = 40, 20
_SPANS = "array<struct<start:int,kind:int,end:int,score:double>>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(a: Column, op: Callable[[Column, Column], Column]) -> Column:
    """At each place of an array op over all values up to it: in step k every value takes in the one 2**k places before it."""
    steps = F.when(F.size(a) > 1, F.sequence(F.lit(0), F.ceil(F.log2(F.size(a).cast("double"))).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    one = lambda k: F.call_function("shiftleft", F.lit(1), k)
    return F.aggregate(steps, a, lambda v, k: F.transform(v, lambda x, i: F.when(i >= one(k), op(x, F.get(v, i - one(k)))).otherwise(x)))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.when((n - i) % 2 == 1, F.substr(digits, i, F.lit(1)).cast("int") * 2 - F.when(F.substr(digits, i, F.lit(1)).cast("int") > 4, 9).otherwise(0)).otherwise(F.substr(digits, i, F.lit(1)).cast("int")))
    return (n > 0) & (F.aggregate(each, F.lit(0), lambda a, v: a + v) % 10 == 0)


def mod_97(iban: Column) -> Column:
    """Whether an IBAN passes ISO 7064 mod 97: the first four characters go last, letters count as 10 to 35, remainder 1."""
    plain = F.regexp_replace(iban, r"\x20", "")
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))

    def step(a: Column, c: Column) -> Column:
        v = F.when(F.ascii(c) >= 65, F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
        return (a * F.when(v >= 10, 100).otherwise(10) + v) % 97

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(step(a, c))) == 1


def confirmed(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda x: F.length(F.regexp_replace(x, "^0+", "")).between(0, 3) & (F.coalesce(F.right(x, F.lit(3)).cast("int"), F.lit(999)) <= 255))
    if kind == "card":
        return F.length(_digits(m)).between(12, 19) & luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind == "iban":
        return mod_97(m)
    return F.lit(True)


def found(kind: str, text: Column) -> Column:
    """Confirmed spans of a kind: array of struct(start, kind number, end, score), ends exclusive, ascending."""
    pattern, k = PATTERNS[kind], KINDS.index(kind)
    many = -(-max(BEFORE, AFTER) // 3) + 1  # matches of three characters or more, so that no more of them are within reach

    def span(m: Column, gaps: Column, ends: Column, i: Column, hits: Column) -> Column:
        near = lambda j: F.when((j >= 0) & (j < F.size(hits)), F.get(hits, j)).otherwise("")
        gap = lambda j, cut: cut(F.coalesce(F.get(gaps, j), F.lit("")))
        last, first = (lambda g: F.right(g, F.lit(BEFORE))), (lambda g: F.left(g, F.lit(AFTER)))
        around = F.sequence(F.lit(1), F.lit(many))
        before = F.concat(F.array_join(F.transform(F.reverse(around), lambda d: F.when(i >= d, F.concat(gap(i - d, last), near(i - d))).otherwise("")), ""), gap(i, last))
        after = F.concat(gap(i + 1, first), F.array_join(F.transform(around, lambda d: F.when(i + d < F.size(hits), F.concat(near(i + d), gap(i + d + 1, first))).otherwise("")), ""))
        spoken = F.lower(F.right(before, F.lit(BEFORE))).rlike(CONTEXT[kind]) | F.lower(F.left(after, F.lit(AFTER))).rlike(CONTEXT[kind])
        score = F.lit(WORTH[kind]) + F.when(spoken, BONUS).otherwise(0.0)
        end = F.get(ends, i)
        return F.struct((end - F.length(m)).alias("start"), F.lit(k).alias("kind"), end.alias("end"), F.least(score, F.lit(1.0)).alias("score"))

    def placed(x: Column) -> Column:
        hits, gaps = x["hits"], x["gaps"]
        ends = running(F.transform(hits, lambda m, i: F.length(F.get(gaps, i)) + F.length(m)), lambda a, b: a + b)
        return let(ends, lambda e: F.filter(F.transform(hits, lambda m, i: F.when(confirmed(kind, m), span(m, gaps, e, i, hits))), lambda s: s.isNotNull() & (s["score"] >= MIN_SCORE)))

    # the cheap test first: most texts have no match at all
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps"))
    return F.when(text.rlike(pattern), let(both, placed)).otherwise(F.array().cast(_SPANS)).cast(_SPANS)


def _alone(covered: Column, ids: Column) -> Column:
    """covered and those of ids that meet none of them, by start and kind. Only neighbours in that order are looked at: the
    furthest end of a covered span up to an id, and the start of the next covered one."""
    number = KINDS.index("id")

    def kept(x: Column) -> Column:
        taken = lambda s: s["kind"] != number
        reach = running(F.transform(x, lambda s: F.when(taken(s), s["end"]).otherwise(0)), F.greatest)
        ahead = F.reverse(running(F.reverse(F.transform(x, lambda s: F.when(taken(s), s["start"]).otherwise((1 << 31) - 1))), F.least))
        both = F.struct(reach.alias("reach"), ahead.alias("ahead"))
        return let(both, lambda b: F.filter(x, lambda s, i: taken(s) | ((F.get(b["reach"], i) <= s["start"]) & (F.get(b["ahead"], i) >= s["end"]))))

    return F.when(F.size(ids) == 0, F.array_sort(covered)).otherwise(let(F.array_sort(F.concat(covered, ids)), kept))


def spans(docs: DataFrame, text: str = "text", into: str = "pii_spans") -> DataFrame:
    """docs with ``into``: array of struct(start, end, kind, score) by start, then kind as listed."""
    t = F.coalesce(F.col(text), F.lit(""))
    own = {k: fresh([*docs.columns, into], f"_pii_{k}") for k in KINDS}
    each = docs.withColumns({own[k]: found(k, t) for k in KINDS})
    every = _alone(F.concat(*[F.col(own[k]) for k in KINDS[:-1]]), F.col(own["id"]))
    names = F.array(*[F.lit(k) for k in KINDS])
    return each.withColumn(into, F.transform(every, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.element_at(names, s["kind"] + 1).alias("kind"), s["score"].alias("score")))).drop(*own.values())


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs whose text has <KIND> for each personal span; overlapping spans go together, under the kind of the first."""
    of, reach = fresh(docs.columns, "_pii_spans"), fresh(docs.columns, "_pii_reach")
    got = spans(docs, text, of)
    size = 1024  # a slice of the text is cut out of pieces of so many characters
    ends = running(F.transform(of, lambda s: s["end"]), F.greatest)
    got = got.withColumn(reach, F.when(F.size(of) > 0, ends))
    heads = F.filter(F.transform(of, lambda s, i: F.when((i == 0) | (s["start"] >= F.get(F.col(reach), i - 1)), i)), lambda i: i.isNotNull())

    def clean(x: Column) -> Column:
        parts, head = x["parts"], x["heads"]

        def part(a: Column, b: Column) -> Column:
            first = F.floor(a / size).cast("int")
            joined_ = F.array_join(F.slice(parts, first + 1, F.floor(b / size).cast("int") - first + 1), "")
            return F.when(b > a, F.substr(joined_, a % size + 1, b - a)).otherwise("")

        end_of = lambda j: F.get(F.col(reach), F.coalesce(F.get(head, j + 1), F.size(of)) - 1)
        each = F.transform(head, lambda i, j: F.concat(part(F.when(j == 0, 0).otherwise(end_of(j - 1)), F.get(F.col(of), i)["start"]), F.lit("<"), F.upper(F.get(F.col(of), i)["kind"]), F.lit(">")))
        return F.concat(F.array_join(each, ""), part(end_of(F.size(head) - 1), F.length(text)))

    both = F.struct(F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{size}}}"), F.lit(0)).alias("parts"), heads.alias("heads"))
    return got.withColumn(text, F.when(F.size(of) > 0, let(both, clean)).otherwise(F.col(text))).drop(of, reach)


def joined(of: Column) -> Column:
    return F.concat_ws(",", F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = spans(documents(spark, sf_dir, "doc_id", "text")).select("doc_id", "pii_spans")
    base = F.filter(F.col("pii_spans"), lambda s: s["kind"].isin(*KINDS[:4]))
    of = lambda kind: F.filter(F.col("pii_spans"), lambda s: s["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS[:4]]
    return got.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("pii_spans")).alias("spans"))
