"""Document fingerprints by consistent weighted sampling.

The terms of a text are its words, weighted by their number of occurrences.  For
every sample ``k`` each term draws two gamma variables and an offset from its
hash alone; together with the term's weight they give a value and a level, and
the term with the least value is the sample, along with its level.  Two texts
share a sample with the probability of their generalised Jaccard similarity,
the sum of the lesser weights over the sum of the greater ones.

The order of the documents is followed without one task seeing them all: the
texts are ranged by id, and each range also gets the first text of the next.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablepact.llm.common import columns, partitions, slices, table

#: Samples of a fingerprint.
SAMPLES = 64
#: Words whose draws one worker keeps before it starts anew.
CACHE_WORDS = 100_000
#: Terms worked on at once.
BLOCK_TERMS = 8192

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers whose bits all depend on each other."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def draws(hashes: np.ndarray, samples: int = SAMPLES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gamma(2, 1) rates, logs of gamma(2, 1) values and uniform offsets, per term and sample."""
    seeds = hashes[:, None] + np.arange(1, 5 * samples + 1, dtype=np.uint64)[None, :] * _STEP
    u = ((_mixed(seeds) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53
    u = u.reshape(len(hashes), 5, samples)
    rate = -np.log(u[:, 0] * u[:, 1])
    value = np.log(-np.log(u[:, 2] * u[:, 3]))
    return rate, value, u[:, 4]


class Sampler:
    """Fingerprints texts; keeps the draws of words met before."""

    def __init__(self, samples: int = SAMPLES, cache: int = CACHE_WORDS):
        self.samples, self.size = samples, cache
        self.index: dict[bytes, int] = {}
        shape = (cache, samples)
        self.rate, self.value, self.offset = (np.zeros(shape, np.float32) for _ in range(3))
        self.hash = np.zeros(cache, np.uint64)

    def _rows(self, words: list[bytes]) -> np.ndarray:
        """Cache rows of at most BLOCK_TERMS words."""
        new = [w for w in words if w not in self.index]
        if len(self.index) + len(new) > self.size:
            self.index.clear()
            new = words
        if new:
            low = len(self.index)
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in new), np.uint64, len(new))
            for at in range(0, len(new), 512):
                part = slice(low + at, low + min(at + 512, len(new)))
                self.rate[part], self.value[part], self.offset[part] = draws(hashes[at:at + 512], self.samples)
            self.hash[low:low + len(new)] = hashes
            self.index.update(zip(new, range(low, low + len(new)), strict=True))
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def signature(self, text: bytes) -> np.ndarray:
        """The samples as 32-bit hashes of term and level; zeros without a word."""
        weights = Counter(text.split())
        out = np.zeros(self.samples, np.uint64)
        if not weights:
            return out.astype(np.uint32)
        least = np.full(self.samples, np.inf, np.float32)
        column = np.arange(self.samples)
        words = sorted(weights) if len(weights) > BLOCK_TERMS else list(weights)
        for start in range(0, len(words), BLOCK_TERMS):
            block = words[start:start + BLOCK_TERMS]
            rows = self._rows(block)
            logs = np.log(np.fromiter(map(weights.__getitem__, block), np.float32, len(block)))[:, None]
            rate, offset = self.rate[rows], self.offset[rows]
            level = np.floor(logs / rate + offset)
            value = self.value[rows] - rate * (level - offset + np.float32(1))
            best = value.argmin(axis=0)
            found = value[best, column]
            mixed = _mixed(self.hash[rows[best]] ^ (level[best, column].astype(np.int64).view(np.uint64) * _STEP))
            out = np.where(found < least, mixed, out)
            least = np.minimum(found, least)
        return (out >> np.uint64(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal samples, an estimate of the generalised Jaccard similarity."""
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The second half of a text replaced by the beginning of the next one."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def with_following(docs: DataFrame, n: int | None = None) -> DataFrame:
    """``doc_id`` and ``text`` in ranges by id, sorted inside; ``follows`` marks
    copies of the rows that begin the next range, after the range's own.

    Limits of the ranges are quantiles of the ids, one number for each range.
    The last range is followed by the first one.
    """
    spark = docs.sparkSession
    n = n or partitions(spark)
    own = (columns(docs, "doc_id", "text")
           .select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
                   F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf"))).alias("_place")))
    limits = own.approxQuantile("_place", [i / n for i in range(1, n)], 0.1 / n) if n > 1 else []
    splits = sorted({float("-inf"), float("inf"), *(limits or [0.0])})
    ranged = Bucketizer(splits=splits, inputCol="_place", outputCol="_bucket").transform(own)
    ranged = ranged.withColumn("_bucket", F.col("_bucket").cast("int"))
    firsts = sorted((r["_bucket"], r["first"], r["nulls"]) for r in ranged.groupBy("_bucket").agg(
        F.min("_place").alias("first"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).collect())
    before = [(place, firsts[i - 1][0]) for i, (_, place, _) in enumerate(firsts)]
    starts = F.broadcast(spark.createDataFrame(before, "_place double, _before int"))  # one row per range
    target = F.struct(F.col("_bucket").alias("range"), F.lit(False).alias("follows"))
    copy = F.struct(F.col("_before").alias("range"), F.lit(True).alias("follows"))
    spread = (ranged.join(starts, "_place", "left")
              .select("doc_id", "text", F.explode(F.when(F.col("_before").isNull(), F.array(target))
                                                  .otherwise(F.array(target, copy))).alias("_to"))
              .select("doc_id", "text", F.col("_to.range").alias("range"), F.col("_to.follows").alias("follows")))
    return (spread.repartitionById(len(splits) - 1, F.col("range"))
            .sortWithinPartitions("follows", "doc_id", "text").select("doc_id", "text", "follows"))


_PRINTS = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")


def fingerprints(docs: DataFrame, samples: int = SAMPLES, n: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited form, and their likeness.

    A null text is empty; texts without words share the fingerprint of zeros.
    Null ids come first, equal ids follow one another in the order of their
    texts.  An empty table gives no rows; a single document follows itself.
    Other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(samples)
        held = None

        def row(doc_id, text, own, following, next_own):
            changed = edited(text, following)
            other = sampler.signature(changed.encode())
            return (doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), own.tobytes().hex(),
                    other.tobytes().hex(), likeness(own, other), likeness(own, next_own))

        done = False
        for part in slices(batches):
            rows = []
            for doc_id, text, follows in zip(part["doc_id"], part["text"], part["follows"], strict=True):
                if done:
                    break
                own = sampler.signature(text.encode())
                if held:
                    rows.append(row(*held, text, own))
                held = (doc_id, text, own)
                if follows:
                    held, done = None, True
            if rows:
                names = [c.split()[0] for c in _PRINTS.split(", ")]
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)))

    return with_following(docs, n).mapInArrow(run, _PRINTS)


def op6_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents; see :func:`fingerprints`."""
    return fingerprints(table(spark, sf_dir, "documents"))
