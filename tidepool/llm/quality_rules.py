"""Quality rules: repetition counts, and divergence from language references. Built-in functions only.

Base rules fail a text of fewer than 10 words, or with over a fifth of its words in repeated 5-word windows. The method
compares two histograms of a text with those of four languages by Jensen-Shannon distance (square root of the divergence
in bits, 0 to 1): of character classes, and of the language's most common words against all other words. The language is
the one whose common words are the most frequent in the text. Small texts give noisy histograms, so that the limits grow
by NOISE / sqrt(size), and below MIN_CHARS letters and signs or MIN_WORDS words the comparison is left out (the text is
judged by the base rules alone). A text in a language that has no reference (column ``lang``, where there is one) is
likewise judged by the base rules alone.

Everything is counted within the row: one pass over documents, no shuffle. Windows are compared by 64-bit hashes.

Null or empty texts have no words and fail. Rows are independent: repeated rows and ties need no rule. ``measure`` keeps
doc_id and lang only, so that extra columns can't clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, documents

# Shares of the most common words in running text, in thousandths.
COMMON_WORDS = {
    "en": {"the": 62, "of": 31, "and": 28, "to": 26, "a": 22, "in": 20, "is": 10, "that": 10, "it": 9, "for": 9, "was": 8, "on": 7, "with": 7, "as": 7, "be": 6, "by": 6, "are": 5, "this": 5, "at": 5, "not": 5, "from": 4, "have": 4, "or": 4, "an": 4},
    "de": {"der": 35, "die": 33, "und": 30, "in": 19, "den": 14, "zu": 12, "das": 12, "von": 11, "mit": 10, "ist": 10, "sich": 9, "des": 9, "auf": 9, "für": 8, "im": 8, "dem": 8, "nicht": 8, "ein": 8, "eine": 8, "als": 6, "auch": 6, "es": 6, "an": 6, "werden": 4},
    "fr": {"de": 50, "la": 29, "le": 23, "et": 22, "les": 20, "des": 16, "en": 15, "un": 13, "du": 12, "une": 11, "que": 10, "est": 10, "dans": 9, "qui": 9, "pour": 9, "par": 8, "il": 7, "au": 7, "pas": 6, "sur": 6, "ce": 6, "avec": 5, "ne": 5, "plus": 4},
    "es": {"de": 58, "la": 38, "que": 30, "el": 30, "en": 27, "y": 26, "los": 17, "se": 13, "del": 12, "las": 11, "un": 11, "por": 10, "con": 9, "no": 9, "es": 9, "una": 8, "su": 7, "para": 7, "al": 6, "lo": 6, "como": 5, "más": 4, "o": 4, "le": 4},
}
# Character classes, and their shares in running text in thousandths (the last takes what no class takes).
CLASSES = {"digit": r"[^0-9]+", "point": r"[^.,;:!?'\x22()-]+"}  # counted by removing all else; letters and white space come from the words
CLASS_SHARES = {"letter": 800, "digit": 8, "space": 155, "point": 33, "other": 4}

MAX_CLASS_DISTANCE = 0.14
MAX_WORD_DISTANCE = 0.30
NOISE = 1.2
MIN_CHARS = 300
MIN_WORDS = 40
WINDOW = 5


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _is(*words: str) -> Callable[[Column], Column]:
    return lambda x: x.isin(*words)


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words in windows of ``width`` words that are found twice or more, the first included."""

    def count(h: Column, n: Column) -> Column:
        placed = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))  # neighbours when sorted are equal windows

        def twice(s: Column) -> Column:
            # two neighbours with the same hash: both their places, those of a run's inner members twice
            same = F.filter(F.sequence(F.lit(1), F.size(s) - 1), lambda j: F.get(s, j)["h"] == F.get(s, j - 1)["h"])
            return F.array_sort(F.array_distinct(F.flatten(F.transform(same, lambda j: F.array(F.get(s, j)["i"], F.get(s, j - 1)["i"])))))

        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        covered = lambda at: F.aggregate(at, start, lambda a, i: F.struct((i + width).alias("end"), (a["n"] + i + width - F.greatest(i, a["end"])).alias("n")), lambda a: a["n"])
        # most texts repeat no window: for them a hash set is all it takes
        return F.when(F.size(F.array_distinct(h)) == n, F.lit(0)).otherwise(let(F.sort_array(placed), lambda s: covered(twice(s))))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    windows = lambda x: F.slice(F.transform(x, lambda v, i: F.xxhash64(v, *[F.get(x, i + k) for k in range(1, width)])), F.lit(1), F.size(x) - (width - 1))
    return F.when(F.size(words) < width, F.lit(0)).otherwise(let(hashed, lambda x: let(windows(x), lambda h: count(h, F.size(h)))))


def divergence(pairs: Column) -> Column:
    """Jensen-Shannon distance of two histograms that sum to one: array of struct(p, q), shares in the text and in the reference."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    term = lambda x: part(x["p"], (x["p"] + x["q"]) / 2) + part(x["q"], (x["p"] + x["q"]) / 2)
    return F.sqrt(F.greatest(F.aggregate(pairs, F.lit(0.0), lambda a, x: a + term(x)) / 2, F.lit(0.0)))


def measure(docs: DataFrame) -> DataFrame:
    """Counts, distances and verdict of every document."""
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    text = docs.select("doc_id", lang.alias("lang"), F.coalesce("text", F.lit("")).alias("t"))
    words = F.array_remove(F.split("t", SPACE), "")
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    every = sorted({w for shares in COMMON_WORDS.values() for w in shares})
    plain = F.array_remove(F.split(F.lower("t"), r"[^\p{L}]+"), "")
    counted = text.select(
        "doc_id",
        "lang",
        F.length("t").alias("n_chars"),
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).cast("long").alias("n_repeat_words"))).alias("w"),
        (F.length("t") - F.length(F.regexp_replace("t", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        # common words in order, each between blanks of its own, so that counting one is a plain string replacement
        let(plain, lambda p: F.struct(F.size(p).alias("n"), F.length(F.array_join(p, "")).alias("letters"), F.concat(F.lit(" "), F.array_join(F.filter(p, _is(*every)), "  "), F.lit(" ")).alias("hits"))).alias("p"),
        *[F.length(F.regexp_replace("t", other, "")).alias(f"n_{k}") for k, other in CLASSES.items()],
    )
    size = F.length("p.hits")
    flat = counted.select(
        "doc_id",
        "lang",
        "n_chars",
        "w.*",
        "n_symbols",
        "n_dup_lines",
        F.col("p.n").alias("n_plain"),
        F.greatest(F.col("n_chars"), F.lit(1)).cast("double").alias("chars"),
        F.col("p.letters").alias("n_letter"),
        *[f"n_{k}" for k in CLASSES],
        F.array(*[((size - F.length(F.replace(F.col("p.hits"), F.lit(f" {w} "), F.lit("")))) / F.lit(float(len(w) + 2)) / F.greatest(F.col("p.n"), F.lit(1))) for w in every]).alias("word_shares"),
    )
    share_of = lambda ref: F.aggregate(ref, F.lit(0.0), lambda a, r: a + F.get(F.col("word_shares"), r["at"]))
    refs = {code: F.array(*[F.struct(F.lit(every.index(w)).alias("at"), F.lit(q / 1000).alias("q")) for w, q in ref.items()]) for code, ref in COMMON_WORDS.items()}
    by_lang = F.array_max(F.array(*[F.struct(share_of(ref).alias("share"), F.lit(code).alias("lang")) for code, ref in refs.items()]))
    near = flat.withColumn("nearest", by_lang).withColumn("ref", F.element_at(F.create_map(*[x for code, ref in refs.items() for x in (F.lit(code), ref)]), F.col("nearest.lang")))
    shares = [F.col("n_letter") / F.col("chars"), F.col("n_digit") / F.col("chars"), (F.col("n_chars") - F.col("word_chars")) / F.col("chars"), F.col("n_point") / F.col("chars")]
    rest = F.greatest(F.lit(0.0), 1 - (shares[0] + shares[1] + shares[2] + shares[3]))
    total = sum(CLASS_SHARES.values())
    class_hist = F.array(*[F.struct(p.alias("p"), F.lit(q / total).alias("q")) for p, q in zip([*shares, rest], CLASS_SHARES.values(), strict=True)])
    in_ref = F.transform("ref", lambda r: F.struct(F.get(F.col("word_shares"), r["at"]).alias("p"), r["q"].alias("q")))
    others = F.struct(F.greatest(F.lit(0.0), 1 - F.col("nearest.share")).alias("p"), F.aggregate("ref", F.lit(1.0), lambda a, r: a - r["q"]).alias("q"))
    class_distance, word_distance = divergence(class_hist), divergence(F.concat(in_ref, F.array(others)))
    judged = near.select("doc_id", "lang", "n_chars", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_plain", F.col("nearest.lang").alias("nearest"), class_distance.alias("class_distance"), word_distance.alias("word_distance"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    unknown = F.col("lang").isNotNull() & ~F.lower("lang").isin(*COMMON_WORDS)
    classes_fit = (F.col("n_chars") < MIN_CHARS) | (F.col("class_distance") <= MAX_CLASS_DISTANCE + NOISE / F.sqrt(F.col("n_chars")))
    words_fit = (F.col("n_words") < MIN_WORDS) | (F.col("word_distance") <= MAX_WORD_DISTANCE + NOISE / F.sqrt(F.greatest("n_plain", F.lit(1))))
    return judged.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (unknown | (classes_fit & words_fit)))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(documents(spark, sf_dir, "doc_id", "text", "lang")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
