import random
import re
import time

from tidepool.llm import pii


def brute(text):
    """Base spans by the patterns' definitions."""
    out = []

    def luhn(d):
        t = 0
        for i, c in enumerate(reversed(d)):
            v = int(c) * (1 + i % 2)
            t += v - 9 * (v > 9)
        return t % 10 == 0

    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(out)]


def got(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = {r["doc_id"]: r["pii_spans"] for r in pii.spans(df).collect()}
    return [[(s["kind"], s["start"], s["end"]) for s in rows[i]] for i in range(len(texts))]


def test_base_spans_equal_brute_force(spark):
    rnd = random.Random(3)
    parts = ["a@b.c", "x.y@mail-1.example.com", "@", ".", "%", "+1 (222) 555-1234", "+49", "4539 1488 0343 6467", "4539148803436467", "123456789012", "1.2.3.4", "255.256.1.1", "10.0.0.255", "0001.2.3.4", "é", "🙂", " ", "\n", "-", "5", "77", "(", "word", "a", "b.c@d.e%f@g.h", "1.2.3.4.5.6.7.8", "300.1.1.1.1", "99999999999.1.1.1"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(500)]
    for t, spans in zip(texts, got(spark, texts), strict=True):
        assert [f"{k}:{a}:{b}" for k, a, b in spans if k in pii.KINDS[:4]] == brute(t), t


def test_checksums_and_context(spark):
    texts = ["IBAN GB82 WEST 1234 5698 7654 32.", "IBAN GB83 WEST 1234 5698 7654 32.", "DE89370400440532013000", "my SSN 123-45-6789 ok", "part 123-45-6789 ok", None, ""]
    spans = got(spark, texts)
    assert [[k for k, *_ in s] for s in spans] == [["iban"], [], ["iban"], ["id"], [], [], []]
    assert spans[0] == [("iban", 5, 32)]


def test_context_on_both_sides_and_past_neighbours(spark):
    near = ["123-45-6789 is my SSN", "SSN: 123-45-6789, 987-65-4321 and 555-44-3333", "x" * 30 + " SSN " + "y" * 40 + " 123-45-6789", "123-45-6789" + " z" * 20 + " SSN", "passport 123456 mail a@1234567.de"]
    assert [[k for k, *_ in s] for s in got(spark, near)] == [["id"], ["id", "id", "id"], [], [], ["id", "email"]]


def mod_97(number):
    n = number.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in n[4:] + n[:4])) % 97 == 1


def test_account_numbers_equal_brute_force(spark):
    rnd = random.Random(6)

    def number(country):
        rest = "".join(rnd.choice("0123456789") for _ in range(pii.IBAN_LENGTHS[country] - 4))
        check = 98 - int("".join(str(int(c, 36)) for c in rest + country + "00")) % 97
        whole = f"{country}{check:02d}{rest}"
        return " ".join(whole[i : i + 4] for i in range(0, len(whole), 4)) if rnd.random() < 0.5 else whole

    for_each = ["".join(rnd.choice([" ", ", ", " PLEASE ", " 2024 ", "x", "Z"]) + (number(rnd.choice(list(pii.IBAN_LENGTHS))) if rnd.random() < 0.7 else "DE00 1234") for _ in range(4)) + rnd.choice(["", " 12 times", "A"]) for _ in range(150)]
    for t, spans in zip(for_each, got(spark, for_each), strict=True):
        want, at = [], 0
        while at < len(t):  # from left to right: the country's number of characters, single blanks left out
            n, k, seen = pii.IBAN_LENGTHS.get(t[at : at + 2], 0), at, 0
            while n and seen < n and k < len(t):
                k += t[k] == " " and k > at + 1
                if k >= len(t) or not (t[k].isdigit() or (t[k].isupper() and t[k].isascii())):
                    break
                k, seen = k + 1, seen + 1
            if n and seen == n and not (at and t[at - 1].isalnum()) and not (k < len(t) and t[k].isalnum()) and t[at + 2 : at + 5].replace(" ", "")[:2].isdigit():
                if mod_97(t[at:k]):
                    want.append((at, k))
                at = k
            else:
                at += 1
        assert [(a, b) for kind, a, b in spans if kind == "iban"] == want, t


def test_many_matches_take_linear_time(spark):
    def seconds(n):
        df = spark.createDataFrame([(1, " ".join(f"user{i}@example.com 10.0.0.{i % 256} ssn 123-45-{i % 9000 + 1000}" for i in range(n)))], "doc_id long, text string")
        began = time.time()
        assert pii.spans(df).selectExpr("size(pii_spans) n").first()["n"] == 3 * n
        middle = time.time()
        assert pii.redact(df).selectExpr("length(text) n").first()["n"] == 22 * n - 1
        return middle - began, time.time() - middle

    seconds(100)  # compiles
    small, large = seconds(10_000), seconds(40_000)
    print("seconds", small, large)
    assert large[0] < 8 * small[0] + 2 and large[1] < 8 * small[1] + 2


def test_overlapping_spans_are_redacted_together(spark):
    text = "mail +1 222 333 4444 5555@example.com now"
    assert got(spark, [text]) == [[("phone", 5, 25), ("email", 21, 37)]]
    df = spark.createDataFrame([(1, text + " é" * 3000 + " 10.0.0.1")], "doc_id long, text string")
    assert pii.redact(df).first()["text"] == "mail <PHONE> now" + " é" * 3000 + " <IP>"


def test_redaction_keeps_other_columns_and_clean_rows(spark):
    df = spark.createDataFrame([(1, "mail a@b.c now", "x"), (2, None, "y"), (3, "clean", "z")], "doc_id long, text string, kind string")
    rows = {r["doc_id"]: r for r in pii.redact(df).collect()}
    assert rows[1]["text"] == "mail <EMAIL> now" and rows[2]["text"] is None and rows[3]["text"] == "clean"
    assert pii.redact(df).columns == df.columns
    assert pii.redact(df.limit(0)).count() == 0


def test_long_runs_are_linear(spark):
    texts = ["a" * 200_000, "1" * 200_000, "1." * 100_000, "a@" * 100_000, "+" * 100_000]
    got(spark, texts)
