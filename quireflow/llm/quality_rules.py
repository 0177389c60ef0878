"""Quality rules by distribution divergence, native operators only.

Each document's histogram over character classes and over words (26 common ones, and all others as one) is
compared with the histogram of all documents of its language by Jensen-Shannon distance (base 2, so 0 to 1).
Documents of too few characters or words are not judged by it: short texts have wild histograms.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, bound, staged

#: Frequent function words of English, German, French and Spanish.
COMMON_WORDS = (
    "a", "and", "das", "de", "del", "den", "der", "des", "die", "el", "en", "et", "in", "is", "la", "le", "les", "los",
    "of", "que", "that", "the", "to", "und", "von", "y",
)
#: The character classes of the first histogram; ``beyond`` are the characters beyond ASCII.
CHAR_CLASSES = ("lower", "upper", "digit", "space", "symbol", "punctuation", "beyond")
#: Runs of the classes that make up most of any text.  What they leave is short, and the other classes are
#: counted in it.
USUAL = r"[a-z\x20\x09-\x0D\x{80}-\x{10FFFF}]++"


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    #: Least characters for the class histogram, least words for the word histogram.
    min_chars: int = 200
    min_judged_words: int = 200
    max_char_distance: float = 0.30
    max_word_distance: float = 0.24


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def with_repeated_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words inside 3-word windows that occur twice or more, each counted once.

    Windows are hashed to 64 bits; sorted, equal ones are neighbours.  Most texts have none and stop here.  A
    few repeated windows are looked up, many are found by sorting the windows with their positions.  Marked
    positions in order give the covered words as a sum of gaps of three at most.  The steps are columns of
    their own, so that each is evaluated once and sorts run on primitive arrays.
    """
    some = 10**9
    h, k, s, twice = (F.col(f"_{n}") for n in ("hash", "window", "sorted", "twice"))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def marked(z: Column) -> Column:
        same = lambda i, x: F.coalesce(F.get(z, i)["k"] == x["k"], F.lit(False))
        return F.transform(F.filter(z, lambda x, i: same(i - 1, x) | same(i + 1, x)), lambda x: x["i"])

    lookup = F.filter(F.transform(k, lambda x, i: F.when(F.array_contains(twice, x), i)), lambda i: i.isNotNull())
    sorting = F.sort_array(bound(F.array_sort(F.transform(k, lambda x, i: F.struct(x.alias("k"), i.alias("i")))), marked))
    positions = F.when(F.size(twice) <= 16, lookup).otherwise(sorting)
    pairs = F.zip_with(h, F.slice(h, 2, some), lambda x, y: F.xxhash64(x, y))
    windows = F.slice(F.zip_with(pairs, F.slice(h, 3, some), lambda x, y: F.xxhash64(x, y)), F.lit(1), F.greatest(F.lit(0), F.size(h) - 2))
    return (
        df.withColumn("_hash", F.transform("words", lambda w: F.xxhash64(w)))
        .withColumn("_window", windows)
        .withColumn("_sorted", F.sort_array("_window"))
        .withColumn("_twice", F.array_distinct(F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1) == x, F.lit(False)))))
        .withColumn("n_repeat_words", F.when(F.size(twice) == 0, F.lit(0)).otherwise(bound(positions, covered)).cast("long"))
        .drop("_hash", "_window", "_sorted", "_twice")
    )


def count_of(words: Column, word: str) -> Column:
    return F.size(F.filter(words, lambda w: w == word)).cast("double")


def features(docs: DataFrame) -> DataFrame:
    """Counts of every whole text: the rules' inputs and both histograms.  Null texts count as empty."""
    base = docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumns({"words": words_of(F.col("text")), "rest": F.regexp_replace("text", USUAL, "")})
    base = with_repeated_words(base)
    text, words, rest = F.col("text"), F.col("words"), F.col("rest")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    common = F.filter(words, lambda w: w.isin(*COMMON_WORDS))
    counted = base.select(
        "doc_id",
        "lang",
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count(rest, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.length(text).alias("n_chars"),
        F.length(rest).alias("n_rest"),
        F.regexp_count(rest, F.lit("[A-Z]")).alias("upper"),
        F.regexp_count(rest, F.lit("[0-9]")).alias("digit"),
        F.length(F.regexp_replace(text, r"[\x00-\x7F]++", "")).alias("beyond"),
        bound(common, lambda c: F.array(*[count_of(c, v) for v in COMMON_WORDS])).alias("common"),
    )
    classes = (
        F.greatest(F.lit(0), F.col("word_chars") - F.col("n_rest") - F.col("beyond")), F.col("upper"), F.col("digit"), F.col("n_chars") - F.col("word_chars"), F.col("n_symbols"),
        F.col("n_rest") - F.col("upper") - F.col("digit") - F.col("n_symbols"), F.col("beyond"),
    )
    other = F.col("n_words") - total(F.col("common"))
    counted = counted.withColumns({"chars": F.array(*[c.cast("double") for c in classes]), "common": F.concat("common", F.array(other))})
    return counted.drop("n_chars", "n_rest", "upper", "digit", "beyond")


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence of two count arrays; null if either is empty."""

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    def of(a: Column, b: Column) -> Column:
        terms = F.zip_with(a, b, lambda x, y: part(x, (x + y) / 2) + part(y, (x + y) / 2))
        return F.sqrt(F.greatest(F.lit(0.0), total(terms) / 2))

    share = lambda a: bound(total(a), lambda t: F.transform(a, lambda x: x / t))
    return F.when((total(p) > 0) & (total(q) > 0), bound(share(p), lambda a: bound(share(q), lambda b: of(a, b))))


def references(counted: DataFrame) -> DataFrame:
    """One row per language: both histograms summed over all its documents.  A null language is one too."""
    sums = [F.sum(F.col("chars")[i]).alias(f"c{i}") for i in range(len(CHAR_CLASSES))]
    sums += [F.sum(F.col("common")[i]).alias(f"w{i}") for i in range(len(COMMON_WORDS) + 1)]
    return counted.groupBy("lang").agg(*sums).select(
        F.col("lang").alias("ref_lang"),
        F.array(*[F.col(f"c{i}") for i in range(len(CHAR_CLASSES))]).alias("ref_chars"),
        F.array(*[F.col(f"w{i}") for i in range(len(COMMON_WORDS) + 1)]).alias("ref_common"),
    )


def judge(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang): counts, distances, ``base_failed`` and ``kept``.

    Defined results: a null or empty text has no words and fails the base rule; a language's only document
    has distance 0 to its reference; repeated rows are judged alike; texts of any length are judged whole; an
    empty table gives no rows; other columns are ignored.
    """
    counted = staged(features(docs), "rules")
    refs = references(counted)
    # One row per language; where the languages are many, the join is left to the planner.
    if refs.count() <= 1000:
        refs = F.broadcast(refs)
    joined = counted.join(refs, F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
    judged = joined.withColumns({
        "char_distance": F.when(total(F.col("chars")) >= rules.min_chars, js_distance(F.col("chars"), F.col("ref_chars"))),
        "word_distance": F.when(F.col("n_words") >= rules.min_judged_words, js_distance(F.col("common"), F.col("ref_common"))),
        "base_failed": (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")),
    })
    near = (F.coalesce("char_distance", F.lit(0.0)) <= rules.max_char_distance) & (F.coalesce("word_distance", F.lit(0.0)) <= rules.max_word_distance)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & near).alias("kept"), F.round("char_distance", 4).alias("char_distance"), F.round("word_distance", 4).alias("word_distance"),
    )
