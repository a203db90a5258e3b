"""Quality rules: plain text statistics and a hashed n-gram likelihood ratio.

Words and pairs of neighbouring words are hashed into a fixed number of buckets.
Two multinomials over the buckets are counted, one over the documents labelled
as good and one over the whole corpus.  A document's score is the mean log ratio
of its n-grams' probabilities under both, so it does not depend on length, and
every document below a threshold is rejected.

Everything is built from Spark's own expressions.  The counts are one grouped
aggregate over all documents; the ratios are a vector of fixed size, which
becomes a constant of the scoring expression, so that scoring and filtering
neither shuffle nor join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablepact.llm.common import columns, free, table

#: Buckets of the multinomials; also the most values ever sent to the driver.
BUCKETS = 1 << 16
#: Occurrences added to each bucket, shared between target and rest like the whole
#: corpus, so that n-grams too rare to tell say nothing.
SMOOTHING = 25.0
#: Ratios are kept as whole millionths: sums do not depend on their order.
UNIT = 1_000_000
#: Mean log ratio below which a document is rejected.
THRESHOLD = -0.10
#: Trusted ids (long) broadcast at most; with more, the texts are joined by a shuffle.
BROADCAST_IDS = 1_000_000

_BLANKS = "[\\x20\\x09-\\x0D]+"
_SYMBOLS = "#*$%&|<>"


def word_array(text: Column) -> Column:
    """Runs of characters other than blank, tab and line ends; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _BLANKS), "")


def base_counts(text: Column, words: Column) -> dict[str, Column]:
    """The counts of the plain rules, as expressions over a text and its words."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.translate(whole, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.length(whole) - F.length(F.translate(whole, _SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": repeat_words(words).cast("long"),
    }


def repeat_words(words: Column) -> Column:
    """Words in windows of three that occur twice or more in the text.

    Windows are told apart by 64-bit hashes.  Equal hashes are brought together
    by sorting, and the union of the windows' words is summed up in order.
    """
    windows = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
                          lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))

    def covered(hashes: Column) -> Column:
        sorted_pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        def at_repeats(pairs: Column) -> Column:
            same = F.filter(pairs, lambda p, k: (p["h"] == F.get(pairs, k - 1)["h"])
                            | (p["h"] == F.get(pairs, k + 1)["h"]))
            return F.sort_array(F.transform(same, lambda p: p["i"]))
        def summed(at: Column) -> Column:
            return F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
                               lambda s, i: F.struct((s["n"] + F.least(F.lit(3), i - s["last"])).alias("n"),
                                                     i.alias("last")))["n"]
        return bound(bound(sorted_pairs, at_repeats), summed)

    return bound(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(covered(w)))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: a lambda over an array of one."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def _bucket(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(BUCKETS)).cast("int")


def ngram_counts(docs: DataFrame, flag: str) -> DataFrame:
    """Occurrences of each bucket in the corpus and in the flagged documents."""
    words = word_array(F.col("text"))
    pairs = (docs.select(flag, words.alias("_words"))
             .select(flag, F.explode(F.arrays_zip(F.col("_words").alias("a"), F.slice("_words", 2, F.greatest(
                 F.size("_words"), F.lit(1))).alias("b"))).alias("_g")))
    grams = pairs.select(flag, F.col("_g.a").alias("a"), F.col("_g.b").alias("b")).select(
        flag, F.explode(F.array(_bucket(F.col("a")), F.when(F.col("b").isNotNull(), _bucket(F.col("a"), F.col("b")))))
        .alias("bucket"))
    return (grams.where("bucket is not null").groupBy("bucket")
            .agg(F.count("*").alias("raw"), F.count_if(F.col(flag)).alias("target")))


def log_ratios(counts: DataFrame) -> list[int]:
    """Millionths of the log ratio of each bucket: target over raw, both smoothed.

    All zeros if there is no target or no corpus.
    """
    raw, target = [0] * BUCKETS, [0] * BUCKETS
    for row in counts.collect():  # at most BUCKETS rows
        raw[row["bucket"]], target[row["bucket"]] = row["raw"], row["target"]
    if not sum(target):
        return [0] * BUCKETS
    share = sum(target) / sum(raw)
    return [round(UNIT * math.log((t + SMOOTHING * share) / (r + SMOOTHING) / share))
            for r, t in zip(raw, target, strict=True)]


def with_flag(docs: DataFrame, ids: DataFrame, flag: str, limit: int = BROADCAST_IDS) -> DataFrame:
    """Mark the documents whose id is listed; a null id never is.

    Up to ``limit`` ids are broadcast; more are joined by a shuffle of both sides.
    """
    marked = ids.where("doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn(flag, F.lit(True))
    if marked.limit(limit + 1).count() <= limit:
        marked = F.broadcast(marked)
    return docs.join(marked, "doc_id", "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids whose labels all say 1; null labels say nothing."""
    return (labels.where("quality is not null").groupBy("doc_id")
            .agg(F.min("quality").alias("_least")).where("_least = 1").select("doc_id"))


def fit(docs: DataFrame, labels: DataFrame) -> list[int]:
    """The log ratios of labelled-good against all documents."""
    slim = columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return log_ratios(ngram_counts(with_flag(slim, trusted_ids(labels), "_good"), "_good"))


def mean_ratio(words: Column, ratios: list[int]) -> Column:
    """Mean log ratio of the words and pairs of words; 0 without words."""
    weights = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<bigint>")
    total = F.aggregate(words, F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(None).cast("string").alias("last")),
                        lambda s, w: F.struct(
                            (s["sum"] + F.get(weights, _bucket(w)) + F.coalesce(
                                F.when(s["last"].isNotNull(), F.get(weights, _bucket(s["last"], w))),
                                F.lit(0))).alias("sum"), w.alias("last")))["sum"]
    grams = F.greatest(2 * F.size(words) - 1, F.lit(1))
    return total / grams / F.lit(float(UNIT))


def judged(docs: DataFrame, ratios: list[int], threshold: float = THRESHOLD) -> DataFrame:
    """The documents with the counts of the plain rules, ``score`` and ``kept``.

    A null or empty text has no words and fails the plain rules.  Repeated rows
    are judged alike and all stay; columns of the documents that have a result's
    name are replaced.  Nothing is shuffled.
    """
    words, = free(docs, "_words")
    staged = docs.withColumn(words, word_array(F.col("text")))
    for name, value in base_counts(F.col("text"), F.col(words)).items():
        staged = staged.withColumn(name, value)
    return (staged.withColumn("score", mean_ratio(F.col(words), ratios))
            .withColumn("base_failed", (F.col("n_words") < 50)
                        | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
            .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold)).drop(words))


def passed(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are kept, with their own columns.

    The same verdict as in :func:`judged`, as one condition that splits each text
    once and leaves off at the first rule that fails.
    """
    ratios = fit(docs, labels)
    verdict = bound(word_array(F.col("text")), lambda w: F.when(F.size(w) < 50, False).when(
        100 * repeat_words(w) > 50 * F.size(w), False).otherwise(mean_ratio(w, ratios) >= threshold))
    return docs.where(verdict)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, score and verdict of every document."""
    docs = columns(table(spark, sf_dir, "documents"), "doc_id", "text")
    return judged(docs, fit(docs, table(spark, sf_dir, "labels"))).drop("text")
