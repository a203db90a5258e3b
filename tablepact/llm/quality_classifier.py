"""Quality classifier learned from positive and unlabelled texts.

Documents labelled as good are the trusted positives; all documents together are
the unlabelled web text.  A linear function ``g`` of text features minimises the
non-negative unbiased risk

    prior * E_p[loss(g, 1)] + max(0, E_u[loss(g, -1)] - prior * E_p[loss(g, -1)])

with squared loss.  For squared loss the risk depends on the data only through
the first and second moments of the features of positives and unlabelled texts.
Those are sums, gathered over all documents by one aggregate, and the risk is
then minimised exactly on matrices of fixed size.  The minimiser estimates
``2 P(good | text) - 1``, which gives the score.

The class prior is estimated from the scores: for every set of texts its share
of the unlabelled ones, divided by its share of the positives, is at least the
prior, and the sets above a threshold of the score come closest to it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablepact.llm.common import columns, free, held_out, let_go, table, tidy
from tablepact.llm.quality_rules import trusted_ids, with_flag

#: Buckets of hashed byte trigrams.
BUCKETS = 256
#: Weight of the squared coefficients, against feature variances of 1; and that weight
#: times the number of trusted texts, which is added for few of them.
RIDGE, RIDGE_FEW = 0.1, 200.0
#: Bins of the score in the estimate of the prior, and the least share of positives in a set.
BINS = 400
LEAST_SHARE = 0.2
#: Gradient steps of the non-negative part.
STEPS = 300
#: Score from which a text is taken for good.
CUT = 0.3
#: Bytes worked on at once; longer texts are counted in parts.
BLOCK_BYTES = 1 << 21

#: Classes of bytes whose shares are features.
_CLASSES = ("upper", "lower", "digit", "space", "newline", "stop", "mark", "other", "lead", "follow")


def _byte_classes() -> np.ndarray:
    def of(byte: int) -> str:
        char = chr(byte)
        if byte >= 0x80:
            return "lead" if byte >= 0xC0 else "follow"
        if char.isalpha():
            return "upper" if char.isupper() else "lower"
        if char.isdigit():
            return "digit"
        if char == "\n":
            return "newline"
        if char.isspace():
            return "space"
        if char in ".,;:?'\"":
            return "stop"
        return "mark" if char in "#*$%&|<>!@^~=+_" else "other"
    return np.asarray([_CLASSES.index(of(b)) for b in range(256)], np.int64)


_CLASS_OF = _byte_classes()
#: Trigram shares, class shares, eight summaries, and a constant.
FEATURES = BUCKETS + len(_CLASSES) + 8 + 1
_MIX = np.uint32(0x9E3779B1)


def _counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of trigram buckets and byte classes of texts of bounded total size."""
    rows = len(texts)
    data = np.frombuffer(b"\0\0".join(texts) + b"\0\0", np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, rows)
    # Bytes between texts belong to an extra row that is dropped.
    owner = np.repeat(np.stack([np.arange(rows), np.full(rows, rows)], 1).ravel(),
                      np.stack([sizes, np.full(rows, 2)], 1).ravel())
    wide = data.astype(np.uint32)
    gram = wide.copy()
    gram[:-1] |= wide[1:] << np.uint32(8)
    gram[:-2] |= wide[2:] << np.uint32(16)
    bucket = ((gram * _MIX) >> np.uint32(24)).astype(np.int64)
    grams = np.bincount(owner * BUCKETS + bucket, minlength=(rows + 1) * BUCKETS)
    kinds = np.bincount(owner * len(_CLASSES) + _CLASS_OF[data], minlength=(rows + 1) * len(_CLASSES))
    return (grams[:rows * BUCKETS].reshape(rows, BUCKETS),
            kinds[:rows * len(_CLASSES)].reshape(rows, len(_CLASSES)))


def _variety(text: bytes) -> tuple[float, float]:
    """Share of different words, and of the most frequent one."""
    counts = Counter(text.split())
    total = max(1, counts.total())
    return len(counts) / total, max(counts.values(), default=0) / total


def features(texts: list[bytes]) -> np.ndarray:
    """One row of features per text; an empty text has the constant only."""
    grams = np.zeros((len(texts), BUCKETS))
    kinds = np.zeros((len(texts), len(_CLASSES)))
    start = 0
    while start < len(texts):
        end, size = start, 0
        while end < len(texts) and (end == start or size + len(texts[end]) <= BLOCK_BYTES):
            size += len(texts[end])
            end += 1
        if size > BLOCK_BYTES:  # one long text, in parts; trigrams across them are left out
            text = texts[start]
            for at in range(0, len(text), BLOCK_BYTES):
                g, k = _counts([text[at:at + BLOCK_BYTES]])
                grams[start] += g[0]
                kinds[start] += k[0]
        else:
            grams[start:end], kinds[start:end] = _counts(texts[start:end])
        start = end
    total = np.maximum(kinds.sum(axis=1, keepdims=True), 1)
    share = grams / total
    filled = kinds.sum(axis=1) > 0
    words = kinds[:, [_CLASSES.index("space"), _CLASSES.index("newline")]].sum(axis=1) + 1
    summary = np.stack([
        np.sqrt((share ** 2).sum(axis=1)), share.max(axis=1, initial=0.0),
        np.minimum(np.log1p(total[:, 0]) / 10, 2) * filled,
        np.minimum(total[:, 0] / words / 10, 3) * filled], 1)
    variety = np.asarray([_variety(t) for t in texts]).reshape(-1, 2)
    return np.hstack([np.sqrt(share), np.sqrt(kinds / total), summary, variety, variety ** 2,
                      np.ones((len(texts), 1))])


def _bytes(column: pa.Array) -> list[bytes]:
    return [v or b"" for v in column.to_pylist()]


# --- moments over all documents ----------------------------------------------------

_MOMENT_ROW = "part int, row int, values binary"


def moments(docs: DataFrame, group: str) -> np.ndarray:
    """Sums of ``x x'`` over all texts, over those of group 1 and those of group 2.

    The constant feature makes the sums of ``x`` and the counts part of them.
    Each task adds up its texts; the rows of its matrices are then added by row
    number, so that no task meets more than one row of each.
    """
    @tidy
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, FEATURES, FEATURES))
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                x = features(_bytes(part.column(0)))
                of = np.asarray(part.column(1).to_pylist())
                sums[0] += x.T @ x
                for g in (1, 2):
                    sums[g] += x[of == g].T @ x[of == g]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(3), FEATURES), pa.int32()),
             pa.array(np.tile(np.arange(FEATURES), 3), pa.int32()),
             pa.array([row.tobytes() for matrix in sums for row in matrix], pa.binary())],
            names=["part", "row", "values"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(v) for v in rows["values"])
        return pd.DataFrame({"part": rows["part"][:1], "row": rows["row"][:1], "values": [total.tobytes()]})

    added = (docs.select(F.col("text").cast("binary"), group).mapInArrow(partial, _MOMENT_ROW)
             .groupBy("part", "row").applyInPandas(add, _MOMENT_ROW).collect())  # 3 x FEATURES rows
    out = np.zeros((3, FEATURES, FEATURES))
    for r in added:
        out[r["part"], r["row"]] = np.frombuffer(r["values"])
    return out


# --- risk --------------------------------------------------------------------------

def ridge(unlabelled: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Penalty of each squared coefficient; none of the constant."""
    second = unlabelled / unlabelled[-1, -1]
    weight = RIDGE + RIDGE_FEW / positive[-1, -1]
    out = weight * np.maximum(np.diag(second) - second[-1] ** 2, 1e-8)
    out[-1] = 0
    return out


def ratio_weights(unlabelled: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Coefficients of the density ratio of positives to unlabelled texts.

    The unbiased risk alone has the minimiser ``2 prior ratio(x) - 1`` with this ratio.
    """
    second = unlabelled / unlabelled[-1, -1]
    mean = positive[-1] / positive[-1, -1]
    return np.linalg.solve(second + np.diag(ridge(unlabelled, positive)), mean)


def minimise(unlabelled: np.ndarray, positive: np.ndarray, prior: float) -> np.ndarray:
    """Coefficients of ``g`` with the least non-negative risk found.

    Descent starts from the minimiser of the unbiased risk.  While the risk of
    the negatives is below zero, steps raise it instead of lowering the sum.
    """
    a_u, a_p = unlabelled / unlabelled[-1, -1], positive / positive[-1, -1]
    b_u, b_p = a_u[-1], a_p[-1]
    penalty = ridge(unlabelled, positive)

    def parts(w):
        wu, wp = a_u @ w, a_p @ w
        gain = (1 - 2 * w @ b_p + w @ wp) / 4 * prior
        rest = (1 + 2 * w @ b_u + w @ wu) / 4 - prior * (1 + 2 * w @ b_p + w @ wp) / 4
        return (gain, rest, prior * (wp - b_p) / 2 + penalty * w / 2,
                (b_u + wu) / 2 - prior * (b_p + wp) / 2)

    w = 2 * prior * ratio_weights(unlabelled, positive)
    w[-1] -= 1
    best, least = w, math.inf
    step = 1.0 / (np.linalg.eigvalsh(a_u)[-1] + 1)
    for _ in range(STEPS):
        gain, rest, d_gain, d_rest = parts(w)
        risk = gain + max(0.0, rest) + float(penalty @ w ** 2) / 4
        if not risk < 1e3 * max(1.0, abs(least)):  # the step was too long: again from the best so far, half as far
            if best is w:
                break
            w, step = best, step / 2
            continue
        if risk < least - 1e-12:
            best, least = w, risk
        w = w + step * d_rest if rest < 0 else w - step * (d_gain + d_rest)
    return best


def prior_of(all_counts: np.ndarray, good_counts: np.ndarray) -> float:
    """The class prior from histograms of the ratio, lowest bin first."""
    n_all, n_good = all_counts.sum(), good_counts.sum()
    above_all = all_counts[::-1].cumsum()[::-1] / n_all
    above_good = good_counts[::-1].cumsum()[::-1] / n_good
    usable = above_good >= LEAST_SHARE
    slack = math.sqrt(math.log(2 * BINS) / 2) * (1 / math.sqrt(n_all) + 1 / math.sqrt(n_good))
    upper = (above_all[usable] + slack) / above_good[usable]
    chosen = int(np.argmin(upper))
    return float(min(1.0, max(0.01, (above_all[usable] / above_good[usable])[chosen])))


def linear(text: Column, weights: np.ndarray) -> Column:
    """The linear function of each text's features."""
    @F.pandas_udf("double")
    def apply(texts: pd.Series) -> pd.Series:
        values, raw = [], [bytes(t) if t is not None else b"" for t in texts]
        for start in range(0, len(raw), 512):
            values.append(features(raw[start:start + 512]) @ weights)
        let_go()
        return pd.Series(np.concatenate(values) if values else [], dtype=float)
    return apply(text.cast("binary"))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float] | None:
    """Coefficients and prior, or None without a trusted positive.

    Positives are the documents whose labels all say good and whose id is not
    held out.  Labels that say otherwise are not used.
    """
    good = trusted_ids(labels).where(~held_out(F.col("doc_id")))
    slim = columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    # Trusted texts are halved by their bytes: the prior is read off those whose
    # ratio was not fitted to them.
    half = F.when(F.col("_good"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")) % 2 + 1).otherwise(0)
    grouped = with_flag(slim, good, "_good").select("text", half.cast("int").alias("_half"))
    unlabelled, first, second = moments(grouped, "_half")
    positive = first + second
    if positive[-1, -1] == 0:
        return None
    fitted, held = (first, 2) if first[-1, -1] and second[-1, -1] else (positive, 0)
    ratio = linear(F.col("text"), ratio_weights(unlabelled, fitted))
    measured = F.col("_half") == 2 if held else F.col("_half") > 0
    binned = (grouped.select("_half", ratio.alias("r"))
              .groupBy(F.least(F.greatest(F.floor(F.col("r") * (BINS // 4)), F.lit(0)), F.lit(BINS - 1)).alias("bin"))
              .agg(F.count("*").alias("n"), F.count_if(measured).alias("good")).collect())  # BINS rows at most
    counts = np.zeros((2, BINS))
    for r in binned:
        counts[:, int(r["bin"])] = r["n"], r["good"]
    prior = prior_of(*counts)
    return minimise(unlabelled, positive, prior), prior


def scored(docs: DataFrame, model: tuple[np.ndarray, float] | None, name: str = "score") -> DataFrame:
    """Add the score of each document's text, 0 to 1; a null text is empty.

    Without a model every score is 0.5.  Rows and other columns stay as they
    are; a column of that name is replaced.
    """
    if model is None:
        return docs.withColumn(name, F.lit(0.5))
    value = (linear(F.col("text"), model[0]) + 1) / 2
    return docs.withColumn(name, F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))


def passed(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The documents whose score reaches the cut, with their own columns, whatever their names."""
    score, = free(docs, "_score")
    return scored(docs, fit(docs, labels), score).where(F.col(score) >= cut).drop(score)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and decision for every document; see :func:`scored`."""
    docs = columns(table(spark, sf_dir, "documents"), "doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return (scored(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= CUT).cast("int").alias("predicted")))
