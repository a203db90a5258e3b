"""URL filter: rules on hosts and paths, and a character language model for the rest.

Two variable-order Markov models of characters are learned, one from accepted
and one from rejected addresses.  The probability of a character after its
context is interpolated with that after the shortened context, down to order 0
and a uniform distribution (Witten-Bell weights).  An address is scored by the
log ratio of both models per character, and the threshold is calibrated on the
labelled addresses.  Without labels of one's own, the verdicts of the rules are
the labels.

All of it is grouping and joining of character n-grams.  Addresses are counted
once each; the n-grams of all addresses are combined before they are shuffled.
Log ratios are kept in whole millionths, so sums do not depend on their order.
Sides of joins that grow with the addresses are merged and never broadcast: the
optimiser judges them by compressed files, and knows nothing of the rows an
``explode`` makes of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablepact.llm.common import columns, free, table, written

#: Characters of the longest context.
ORDER = 4
#: Probability of any character below order 0.
UNIFORM = 1 / 1024
#: Log ratios are counted in these parts of 1, thresholds in these parts of 1.
UNIT, STEP = 1_000_000, 100

_START, _END = "\u0002", "\u0003"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The fixed rules of the query.
RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"),
         Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, in ASCII lower case, and path; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.coalesce(F.regexp_extract(rest, "^[^/?#]*", 0), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, _UPPER, _UPPER.lower()), path


def best_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """A struct of name and verdict of the longest rule that fits, else null.

    A rule fits its host and all subdomains if the path starts with its own.
    Of equally long ones the first in the order of names wins.
    """
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), [-ord(c) for c in r.name])):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        chosen = F.when(fits, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))
                        ).otherwise(chosen)
    return chosen


def grams_of(url: Column, order: int = ORDER) -> Column:
    """The n-grams that end at each character of the address and at its end."""
    padded = F.concat(F.lit(_START * order), url, F.lit(_END))
    return F.transform(F.sequence(F.lit(1), F.length(url) + 1), lambda i: F.substr(padded, i, F.lit(order + 1)))


def _merged(df: DataFrame) -> DataFrame:
    """One side of a join of which neither side goes through the driver."""
    return df.hint("merge")


def log_ratios(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """``gram`` and ``ratio``, in millionths, for every n-gram of ``urls``.

    ``urls`` has ``url`` and the numbers of its accepted and rejected
    occurrences, ``good`` and ``bad``.
    """
    counted = (urls.select(F.explode(grams_of(F.col("url"), order)).alias("gram"), "good", "bad")
               .groupBy("gram").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")))
    grams = written(counted, "url-grams")
    wide = grams.select("gram", F.substring("gram", order + 1, 1).alias("char"),
                        *[F.substring("gram", order + 1 - k, k).alias(f"ctx{k}") for k in range(order + 1)])
    for k in range(order + 1):
        if k < order:
            seen = (grams.groupBy(F.substring("gram", order + 1 - k, k).alias(f"ctx{k}"),
                                  F.substring("gram", order + 1, 1).alias("char"))
                    .agg(F.sum("good").alias(f"good{k}"), F.sum("bad").alias(f"bad{k}")))
        else:
            seen = grams.select(F.substring("gram", 1, order).alias(f"ctx{k}"),
                                F.substring("gram", order + 1, 1).alias("char"),
                                F.col("good").alias(f"good{k}"), F.col("bad").alias(f"bad{k}"))
        total = seen.groupBy(f"ctx{k}").agg(*[
            f.alias(f"{c}{k}_{s}") for c in ("good", "bad")
            for s, f in (("n", F.sum(f"{c}{k}")), ("t", F.count_if(F.col(f"{c}{k}") > 0)))])
        if k == 0:  # one row per character of the alphabet at most
            wide = wide.join(F.broadcast(seen.join(F.broadcast(total), "ctx0").drop("ctx0")), "char")
        else:
            wide = wide.join(_merged(seen.join(_merged(total), f"ctx{k}")), [f"ctx{k}", "char"])

    def probability(c: str) -> Column:
        def longer(shorter: Column, k: int) -> Column:
            n, t = F.col(f"{c}{k}_n"), F.col(f"{c}{k}_t")
            return F.when(n > 0, (F.col(f"{c}{k}") + t * shorter) / (n + t)).otherwise(shorter)
        return reduce(longer, range(order + 1), F.lit(UNIFORM))

    ratio = F.round((F.log(probability("good")) - F.log(probability("bad"))) * UNIT).cast("long")
    return wide.select("gram", ratio.alias("ratio"))


def scores(urls: DataFrame, ratios: DataFrame, order: int = ORDER) -> DataFrame:
    """``url`` and ``score``: whole steps of the mean log ratio per character."""
    return (urls.select("url", F.explode(grams_of(F.col("url"), order)).alias("gram"))
            .join(_merged(ratios), "gram").groupBy("url")
            .agg(F.floor(F.sum("ratio") / F.count("*") / F.lit(UNIT // STEP)).cast("long").alias("score")))


def threshold(labelled: DataFrame) -> int | None:
    """The score at which the share of accepted addresses above it exceeds that of
    rejected ones most, half-way down to the next score met; the least of several.
    None if one kind is missing.

    Scores are steps of a bounded logarithm, so there are only so many of them.
    """
    bins = labelled.where("good + bad > 0").groupBy("score").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).collect()
    good, bad = sum(r["good"] for r in bins), sum(r["bad"] for r in bins)
    if not good or not bad:
        return None
    best, most, up_good, up_bad = None, None, 0, 0
    for r in sorted(bins, key=lambda r: -r["score"]):
        up_good, up_bad = up_good + r["good"], up_bad + r["bad"]
        gain = up_good * bad - up_bad * good
        if most is None or gain >= most:
            best, most = r["score"], gain
    below = max((r["score"] for r in bins if r["score"] < best), default=best - 1)
    return (best + below) // 2 + 1


def judged(pages: DataFrame, rules: Sequence[Rule] = RULES, label: str | None = None) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict``, and the method's ``score``.

    ``label`` names a column with ``allow``, ``block`` or null to learn from;
    without it the rules' verdicts are learned.  A null address has no host, no
    path and no score and is allowed; so is everything if there are no accepted
    or no rejected addresses.  Every row stays, also repeated ones; columns of
    these names are replaced.
    """
    host, path = host_and_path(F.col("url"))
    staged = pages.withColumn("host", host).withColumn("path", path)
    fitting, = free(staged, "_rule")
    staged = staged.withColumn(fitting, best_rule(F.col("host"), F.col("path"), rules))
    say = F.col(f"`{label}`") if label else F.col(f"{fitting}.verdict")
    urls = written(staged.where("url is not null").groupBy("url").agg(
        F.count_if(say == "allow").alias("good"), F.count_if(say == "block").alias("bad")), "urls")
    scored = written(scores(urls, log_ratios(urls)).join(_merged(urls), "url"), "url-scores")
    cut = threshold(scored)
    verdict = F.when(F.col("score") < F.lit(cut), "block").otherwise("allow")
    return (staged.drop("score").join(_merged(scored.select("url", "score")), "url", "left")
            .withColumn("rule", F.col(f"{fitting}.rule"))
            .withColumn("verdict", F.coalesce(F.col(f"{fitting}.verdict"), verdict)).drop(fitting))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages; see :func:`judged`."""
    pages = columns(table(spark, sf_dir, "pages"), "page_id", "url")
    return judged(pages).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    levels = range(ORDER + 1)
    ctx = {k: f"substr(gram, {ORDER + 1 - k}, {k})" for k in levels}
    ctes = []
    for k in levels:
        ctes.append(
            f"s{k} AS (SELECT {ctx[k]} AS ctx, substr(gram, {ORDER + 1}, 1) AS c, sum(good) AS g, sum(bad) AS b "
            f"FROM grams GROUP BY ALL)")
        ctes.append(
            f"t{k} AS (SELECT ctx, sum(g) AS gn, count(*) FILTER (WHERE g > 0) AS gt, sum(b) AS bn, "
            f"count(*) FILTER (WHERE b > 0) AS bt FROM s{k} GROUP BY ctx)")

    # Each level is used twice in the next one; named columns keep the text short.
    steps = ["p0 AS (SELECT gram, " + ", ".join(
        f"s{k}.{x}::DOUBLE AS {x}{k}, t{k}.{x}n::DOUBLE AS {x}n{k}, t{k}.{x}t::DOUBLE AS {x}t{k}"
        for k in levels for x in "gb") + " FROM grams " + " ".join(
        f"JOIN s{k} ON s{k}.ctx = {ctx[k]} AND s{k}.c = substr(gram, {ORDER + 1}, 1) JOIN t{k} ON t{k}.ctx = s{k}.ctx"
        for k in levels) + ")"]
    for k in levels:
        before = {x: f"q{x}" if k else repr(UNIFORM) for x in "gb"}
        keep = "* EXCLUDE (qg, qb)" if k else "*"
        steps.append(f"p{k + 1} AS (SELECT {keep}, " + ", ".join(
            f"CASE WHEN {x}n{k} > 0 THEN ({x}{k} + {x}t{k} * {before[x]}) / ({x}n{k} + {x}t{k}) "
            f"ELSE {before[x]} END AS q{x}" for x in "gb") + f" FROM p{k})")
    rules = sorted(RULES, key=lambda r: -len(r.name))
    fits = [(f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')", r)
            for r in rules]
    rule = " ".join(f"WHEN {f} THEN '{r.name}'" for f, r in fits)
    verdict = " ".join(f"WHEN {f} THEN '{r.verdict}'" for f, r in fits)
    return f"""
WITH cut AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0
    THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
parts AS (SELECT page_id, url, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_UPPER.lower()}'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
ruled AS (SELECT *, CASE {rule} END AS rule, CASE {verdict} END AS said FROM parts),
urls AS (SELECT url, count(*) FILTER (WHERE said = 'allow') AS good, count(*) FILTER (WHERE said = 'block') AS bad
    FROM ruled WHERE url IS NOT NULL GROUP BY url),
places AS (SELECT url, good, bad, substr(repeat(chr(2), {ORDER}) || url || chr(3), i, {ORDER + 1}) AS gram
    FROM urls, LATERAL (SELECT unnest(range(1, length(url) + 2)) AS i)),
grams AS (SELECT gram, sum(good) AS good, sum(bad) AS bad FROM places GROUP BY gram),
{", ".join(ctes)},
{", ".join(steps)},
ratios AS (SELECT gram, round((ln(qg) - ln(qb)) * {UNIT})::BIGINT AS ratio FROM p{ORDER + 1}),
scored AS (SELECT url, any_value(good) AS good, any_value(bad) AS bad,
    floor(sum(ratio)::DOUBLE / count(*) / {UNIT // STEP})::BIGINT AS score
    FROM places JOIN ratios USING (gram) GROUP BY url),
bins AS (SELECT score, sum(good) AS good, sum(bad) AS bad FROM scored WHERE good + bad > 0 GROUP BY score),
gains AS (SELECT score, sum(good) OVER above * (SELECT sum(bad) FROM bins)
    - sum(bad) OVER above * (SELECT sum(good) FROM bins) AS gain,
    coalesce(lead(score) OVER above, score - 1) AS below FROM bins
    WINDOW above AS (ORDER BY score DESC)),
chosen AS (SELECT CASE WHEN (SELECT least(sum(good), sum(bad)) FROM bins) > 0
    THEN floor((score + below) / 2.0)::BIGINT + 1 END AS low
    FROM gains ORDER BY gain DESC, score LIMIT 1)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN score < (SELECT low FROM chosen)
    THEN 'block' ELSE 'allow' END) AS verdict FROM ruled LEFT JOIN scored USING (url)"""


SQL = _sql()
