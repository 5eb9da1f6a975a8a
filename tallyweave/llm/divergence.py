"""Quality rules by distribution divergence, with DataFrame functions only.

Each text gives a histogram of character classes and one of common words. Language references
are the mean histograms of all texts that read as that language, taken once over every text
and once more over those near the first mean. A text is kept if the base rules pass and its
Jensen-Shannon distance to its language's reference is within bounds; bounds are wider for
short texts, whose histograms are noisy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, documents, materialize

#: Frequent function words of each language.
COMMON_WORDS = {
    "de": "der die das und zu von mit den dem in ein auf nicht sich im des als eine ist es".split(),
    "en": "the of and to is in that it for with by this be are as at on from was or".split(),
    "es": "el la de que y en los del las un con para su al se por una lo es como".split(),
    "fr": "le la de et les des du un une que qui dans pour par sur avec au est en ce".split(),
}
CLASSES = ("lower", "upper", "space", "point", "digit", "symbol", "other")
#: Bound of the root mean square of the two distances; it grows by NOISE over the square root of the word count.
BOUND, NOISE = 0.155, 0.6
MIN_WORDS = 50


def base_counts(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and, for the
    histograms, ``words`` and ``classes``. Null texts count as texts without words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.withColumn("_t", text)
    df = df.withColumn("words", F.array_remove(F.split("_t", f"[{WHITE}]+"), ""))
    df = df.withColumn("_rest", F.regexp_replace("_t", "[a-zß-öø-ÿ]+", ""))  # the few characters that no later class shares
    df = df.withColumn("_spaces", F.length("_rest") - F.length(F.regexp_replace("_rest", f"[{WHITE}]+", "")))
    gone = lambda pattern: F.length("_rest") - F.length(F.regexp_replace("_rest", pattern, ""))
    df = df.withColumn("n_symbols", gone("[#*$%&|<>]+").cast("long"))
    lines = F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(f"[^{WHITE}]"))
    df = df.withColumn("_lines", lines)
    df = df.withColumn("n_words", F.size("words").cast("long"))
    df = df.withColumn("word_chars", (F.length("_t") - F.col("_spaces")).cast("long"))
    df = df.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    # Windows of three words by 64-bit hash and place, sorted; equal neighbours are repeats.
    windows = F.when(F.size("words") >= 3, F.expr("sort_array(transform(sequence(0, size(words) - 3), i -> struct(xxhash64(words[i], words[i + 1], words[i + 2]) AS h, i AS i)))"))
    df = df.withColumn("_w", windows)
    df = df.withColumn("_p", F.expr("sort_array(transform(filter(_w, (x, j) -> x.h = get(_w, j + 1).h OR x.h = get(_w, j - 1).h), x -> x.i))"))
    df = df.withColumn("n_repeat_words", F.coalesce(F.expr("aggregate(transform(_p, (x, j) -> least(3, coalesce(get(_p, j + 1) - x, 3))), 0L, (a, x) -> a + x)"), F.lit(0)).cast("long"))
    counted = [F.length("_t") - F.length("_rest"), gone(r"\p{Lu}+"), F.col("_spaces"), gone(r"[.,;:!?'\"()\-]+"), gone("[0-9]+"), F.col("n_symbols")]
    df = df.withColumn("_classes", F.array(*[c.cast("double") for c in counted]))
    df = df.withColumn("classes", F.concat("_classes", F.array(F.greatest(F.lit(0.0), F.length("_t") - F.aggregate("_classes", F.lit(0.0), lambda a, x: a + x)))))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.withColumn("base_failed", failed).drop("_t", "_rest", "_spaces", "_lines", "_w", "_p", "_classes")


def _word_counts(df: DataFrame) -> DataFrame:
    """Adds ``language`` (whose common words take the largest share) and ``common``: their counts,
    then that of all other words."""
    every = sorted({w for words in COMMON_WORDS.values() for w in words})
    forms = [w + end for w in every for end in ("", ",", ".")]
    df = df.withColumn("_found", F.concat(F.lit(" "), F.array_join(F.transform(F.filter("words", lambda w: w.isin(forms)), lambda w: F.rtrim(w, F.lit(".,"))), "  "), F.lit(" ")))
    number = {w: i for i, w in enumerate(every)}
    df = df.withColumn("_counts", F.array(*[((F.length("_found") - F.length(F.replace("_found", F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)) for w in every]))
    of = {k: F.array(*[F.get("_counts", F.lit(number[w])) for w in words]) for k, words in COMMON_WORDS.items()}
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    df = df.withColumn("_best", F.greatest(*[F.struct(total(of[k]).alias("n"), F.lit(k).alias("language"), of[k].alias("c")) for k in sorted(COMMON_WORDS)]))
    common = F.concat(F.col("_best.c"), F.array(F.col("n_words") - F.col("_best.n")))
    return df.withColumn("language", F.col("_best.language")).withColumn("common", common).drop("_found", "_counts", "_best", "words")


def _normal(c: Column) -> Column:
    return F.transform(c, lambda x: x / F.greatest(F.aggregate(c, F.lit(0.0), lambda a, y: a + y), F.lit(1.0)))


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the base-2 Jensen-Shannon divergence of two normalised histograms: 0 to 1."""
    part = lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda x, y: (part(x, y) + part(y, x)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)))


def _references(df: DataFrame, used: Column) -> DataFrame:
    """One row for each language: mean normalised histograms over the rows that ``used`` marks."""
    sizes = {"classes": len(CLASSES), "common": len(next(iter(COMMON_WORDS.values()))) + 1}
    means = [F.avg(F.when(used, F.get(k, F.lit(i)))).alias(f"{k}{i}") for k, n in sizes.items() for i in range(n)]
    out = df.groupBy("language").agg(*means)
    return out.select("language", *[F.array(*[F.coalesce(f"{k}{i}", F.lit(0.0)) for i in range(n)]).alias(f"ref_{k}") for k, n in sizes.items()])


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """Every document with the base counts, ``base_failed``, its two distances and ``kept``.

    One pass over the texts; what remains of a row is two small histograms, written once, from
    which the references (a row for each language of ``COMMON_WORDS``, so they are broadcast)
    and the verdicts come. Texts under 50 words fail by the base rules; null and empty texts
    have no words, zero counts and ``kept`` false. Copies get the same verdict. Columns other
    than ``doc_id`` and ``text`` are dropped.
    """
    slim = materialize(_word_counts(base_counts(docs.select("doc_id", "text"))).drop("text").withColumn("classes", _normal(F.col("classes"))).withColumn("common", _normal(F.col("common"))), "divergence")
    long_enough = ~F.col("base_failed")

    def measured(df: DataFrame, used: Column) -> DataFrame:
        refs = _references(df, used)
        out = df.join(F.broadcast(refs), "language", "left")
        return out.withColumn("char_distance", js_distance(F.col("classes"), F.col("ref_classes"))).withColumn("word_distance", js_distance(F.col("common"), F.col("ref_common"))).drop("ref_classes", "ref_common")

    both = F.sqrt((F.col("char_distance") * F.col("char_distance") + F.col("word_distance") * F.col("word_distance")) / 2)
    near = both <= BOUND + NOISE / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
    first = measured(slim, long_enough)
    again = measured(first.withColumn("_used", long_enough & F.coalesce(near, F.lit(False))).drop("char_distance", "word_distance"), F.col("_used"))
    kept = long_enough & F.coalesce(near, F.lit(False))
    return again.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "language", "char_distance", "word_distance")


def op2_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(documents(spark, sf_dir))
