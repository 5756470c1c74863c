"""Quality rules: repetition and length counts, and divergence from language references.

A document's histograms of character classes and of common words are compared with
those of its language by the Jensen-Shannon distance.  Short texts have no stable
histogram and are not judged by it.  Everything is built from SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsgauge.llm.shared import col, fresh, word_array, written

# Frequent words of each language with a reference.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "was", "on"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un"],
}
SYMBOLS = "[#*$%&|<>]"
CLASSES = ["lower", "blank", "upper", "digit", "other", "symbol", "mark"]
REPEAT_WINDOW = 5

MIN_CHARS, MIN_WORDS = 200, 100
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.27, 0.27


def _repeat_words(wins: Column) -> Column:
    """The number of words inside windows that occur twice or more, from the hashes of all windows."""
    marked = F.sort_array(F.transform(wins, lambda h, at: F.struct(h.alias("h"), at.alias("at"))))

    def repeated(sorted_wins: Column) -> Column:
        places = F.transform(
            sorted_wins,
            lambda x, at: F.when(
                F.coalesce(F.get(sorted_wins, at - 1)["h"] == x["h"], F.lit(False))
                | F.coalesce(F.get(sorted_wins, at + 1)["h"] == x["h"], F.lit(False)),
                x["at"],
            ),
        )
        return F.sort_array(F.filter(places, lambda at: at.isNotNull()))

    def covered(places: Column) -> Column:
        gaps = F.transform(
            places,
            lambda at, i: F.coalesce(F.least(F.get(places, i + 1) - at, F.lit(REPEAT_WINDOW)), F.lit(REPEAT_WINDOW)),
        )
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda total, gap: total + gap)

    # Binding a value to a lambda computes it once.
    once = lambda value, function: F.get(F.transform(F.array(value), function), F.lit(0))
    count = once(marked, lambda s: once(repeated(s), covered))
    return F.when(F.size(F.array_distinct(wins)) == F.size(wins), F.lit(0).cast("bigint")).otherwise(count)


def _count_in(values: str, wanted: list[str]) -> Column:
    return F.size(F.filter(values, lambda value: value.isin(wanted))).cast("bigint")


def quality_profile(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", name: str = "profile") -> DataFrame:
    """``docs`` with a column ``name`` of counts: words, characters, repeats and the two histograms.

    Words are parted by ASCII blanks; NULL texts have none.  ``chars`` counts the classes lower,
    blank, upper, digit (ASCII), other (not ASCII), symbol, mark (the rest of ASCII).  ``common`` counts the
    common words of the row's language and last all other words; it is NULL for a language without
    a reference.
    """
    t, words, wins, lines, a, b, c, d, e, f, hits = fresh(
        docs.columns, "t", "words", "wins", "lines", "a", "b", "c", "d", "e", "f", "hits"
    )
    step = docs.withColumn(t, F.coalesce(col(text_column), F.lit("")))
    step = step.withColumn(words, word_array(F.col(t)))
    n = F.size(words)
    starts = F.when(n >= REPEAT_WINDOW, F.sequence(F.lit(0), n - REPEAT_WINDOW)).otherwise(F.array().cast("array<int>"))
    step = step.withColumn(
        wins, F.transform(starts, lambda i: F.xxhash64(*[F.get(F.col(words), i + k) for k in range(REPEAT_WINDOW)]))
    )
    step = step.withColumn(lines, F.filter(F.split(t, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]")))
    known = sorted({word for listed in COMMON_WORDS.values() for word in listed})
    cased = known + [word.capitalize() for word in known]
    step = step.withColumn(hits, F.transform(F.filter(words, lambda w: w.isin(cased)), F.lower))
    # Each class is cut out of what the classes before have left.
    for left, cut, pattern in (
        (t, a, "[a-z]+"),
        (a, b, "[\\x20\\x09-\\x0D]+"),
        (b, c, "[A-Z]+"),
        (c, d, "[0-9]+"),
        (d, e, "[^\\x00-\\x7F]+"),
        (e, f, SYMBOLS + "+"),
    ):
        step = step.withColumn(cut, F.regexp_replace(F.col(left), pattern, ""))
    sizes = [F.length(name) for name in (t, a, b, c, d, e, f)]
    chars = [sizes[at] - sizes[at + 1] for at in range(6)] + [sizes[6]]
    common = F.lit(None).cast("array<bigint>")
    for lang, listed in COMMON_WORDS.items():
        counts = [_count_in(hits, [word]) for word in listed]
        all_common = _count_in(hits, listed)
        common = F.when(col(lang_column) == lang, F.array(*counts, (n - all_common).cast("bigint"))).otherwise(common)
    profile = F.struct(
        n.cast("bigint").alias("n_words"),
        F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
        (sizes[5] - sizes[6]).cast("bigint").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        _repeat_words(F.col(wins)).alias("n_repeat_words"),
        F.array(*[x.cast("bigint") for x in chars]).alias("chars"),
        common.alias("common"),
    )
    return step.withColumn(name, profile).drop(t, words, wins, lines, a, b, c, d, e, f, hits)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 10) | (n_repeat_words * 100 > n_words * 20)


def language_references(profiles: DataFrame, lang: str = "lang") -> DataFrame:
    """``lang, chars, common``: the summed histograms of all rows that pass the base rules.

    One row for each language with a list of common words, so at most that many.
    """
    good = profiles.filter(F.col(lang).isin(list(COMMON_WORDS)) & ~base_failed(F.col("n_words"), F.col("n_repeat_words")))
    longest = max(map(len, COMMON_WORDS.values())) + 1
    sums = good.groupBy(F.col(lang).alias("lang")).agg(
        *[F.sum(F.get("chars", F.lit(at))).alias(f"c{at}") for at in range(len(CLASSES))],
        *[F.sum(F.get("common", F.lit(at))).alias(f"w{at}") for at in range(longest)],
    )
    return sums.select(
        "lang",
        F.array(*[F.col(f"c{at}") for at in range(len(CLASSES))]).alias("chars"),
        F.filter(F.array(*[F.col(f"w{at}") for at in range(longest)]), lambda x: x.isNotNull()).alias("common"),
    )


def js_distance(p: Column, q: Column) -> Column:
    """The Jensen-Shannon distance of two histograms of counts: 0 if proportional, 1 if disjoint; NULL if one is empty."""

    def shares(counts: Column) -> Column:
        total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
        return F.transform(counts, lambda x: x / F.nullif(total, F.lit(0.0)))

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)

    terms = F.zip_with(shares(p), shares(q), lambda x, y: F.when(x.isNotNull() & y.isNotNull(), part(x, y) + part(y, x)))
    total = F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)
    # Rounding can make it slightly negative.
    return F.sqrt(F.when(total > 0, total / 2).when(total <= 0, F.lit(0.0)))


def quality_rules(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
    min_chars: int = MIN_CHARS,
    min_words: int = MIN_WORDS,
    max_char_distance: float = MAX_CHAR_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
) -> DataFrame:
    """One row per document: ``id``, the counts, ``char_distance``, ``word_distance``, ``base_failed``, ``kept``.

    A document fails if it has fewer than 10 words, if more than a fifth of its words lie in
    repeated five-word windows, or if a histogram is too far from that of its language.  The references
    are the sums over all documents of a language that pass the base rules.  A text with fewer
    than ``min_chars`` characters or ``min_words`` words is not judged by the respective histogram; nor
    is one whose language is NULL or has no list of common words.  NULL and empty texts have no words and
    fail.  Repeated rows are judged alike.  No rows: no rows.
    """
    profiled = quality_profile(
        docs.select(col(id_column).alias("id"), col(text_column).alias("text"), col(lang_column).alias("lang"))
    )
    rows = written(profiled.select("id", "lang", "profile.*"), "profiles")
    references = language_references(rows).select(
        F.col("lang").alias("lang0"), F.col("chars").alias("ref_chars"), F.col("common").alias("ref_common")
    )
    # At most one row for each list of common words.
    joined = rows.join(F.broadcast(references), F.col("lang") == F.col("lang0"), "left")
    n_chars = F.aggregate("chars", F.lit(0).cast("bigint"), lambda s, x: s + x)
    judged = joined.withColumns(
        {
            "char_distance": F.when(n_chars >= min_chars, js_distance(F.col("chars"), F.col("ref_chars"))),
            "word_distance": F.when(F.col("n_words") >= min_words, js_distance(F.col("common"), F.col("ref_common"))),
            "base_failed": base_failed(F.col("n_words"), F.col("n_repeat_words")),
        }
    )
    near = F.coalesce(F.col("char_distance") <= max_char_distance, F.lit(True)) & F.coalesce(
        F.col("word_distance") <= max_word_distance, F.lit(True)
    )
    return judged.select(
        "id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "char_distance",
        "word_distance",
        "base_failed",
        (~F.col("base_failed") & near).alias("kept"),
    )
