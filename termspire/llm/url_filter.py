"""URL filters: rules of hosts and paths, and a logistic regression on hashed character n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termspire.plans.staging import stage

BUCKETS = 1 << 15
SIZES = (3, 4, 5)
ROUNDS = 40
RATE = 10.0
SMOOTH = 3.0
DECAY = 0.002
# The model is fitted to a small table; more rows than this are refused, not sampled.
MAX_LABELLED = 20_000

_LOWER = "abcdefghijklmnopqrstuvwxyz"
_PATTERN = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """What stands between the first `://` and the next `/`, `?` or `#`, with A-Z in lower case."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PATTERN, 1), F.lit("")), _LOWER.upper(), _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to `?` or `#`."""
    return F.coalesce(F.regexp_extract(url, _PATTERN, 2), F.lit(""))


def _bucket_of(side: str):
    def bucket(gram: Column) -> Column:
        return (F.pmod(F.xxhash64(F.lit(side), gram), F.lit(BUCKETS - 1)) + 1).cast("int")

    return bucket


def _buckets_of(side: str):
    """The buckets of the n-grams of an array of characters.

    Longer n-grams are made of shorter ones and the characters behind them, in linear time.
    """

    def buckets(characters: Column) -> Column:
        grown, found = characters, []
        for size in range(2, max(SIZES) + 1):
            many = F.greatest(F.size(characters) - (size - 1), F.lit(0))
            grown = F.zip_with(
                F.slice(grown, F.lit(1), many),
                F.slice(characters, F.lit(size), many),
                lambda head, tail: F.concat(head, tail),
            )
            if size in SIZES:
                found.append(F.transform(grown, _bucket_of(side)))
        return F.concat(*found)

    return buckets


def grams(host: Column, path: Column) -> Column:
    """Buckets of the distinct character n-grams of host and path; bucket 0 is in every URL.

    Digits of a path count as alike. Borders are marked, so a word at the start of a host differs
    from one within it.
    """
    sides = [
        ("h", F.concat(F.lit("<"), host, F.lit(">"))),
        ("p", F.concat(F.lit("<"), F.regexp_replace(path, "[0-9]+", "0"), F.lit(">"))),
    ]
    found = [F.array(F.lit(0))]
    for side, marked in sides:
        # The characters are bound to a name, so that they are made once.
        split = F.transform(F.array(F.split(marked, "")), _buckets_of(side))
        found.append(F.flatten(split))
    return F.array_distinct(F.concat(*found))


def _margin(buckets: Column, weights: list[float]) -> Column:
    """The weights of a URL's buckets, added up, over the root of their number.

    The weights are one constant of the plan, folded by the optimizer, so scoring joins nothing.
    """
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    total = F.aggregate(buckets, F.lit(0.0), lambda a, b: a + F.get(table, b))
    return total / F.sqrt(F.size(buckets).cast("double"))


def _probability(margin: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def train(labelled: DataFrame, url: str = "url", label: str = "block") -> list[float]:
    """Weights by bucket, by gradient descent over the whole labelled table in each round.

    Each round is one grouping by bucket, and returns at most BUCKETS sums. The step of a bucket is
    divided by the number of URLs that have it, so common and rare ones advance alike. Rows without a label are
    left out, null URLs count as empty; an empty table gives zeros, that is, the verdict allow.
    """
    rows = labelled.where(F.col(label).isNotNull()).select(
        grams(host_of(F.col(url)), path_of(F.col(url))).alias("buckets"), F.col(label).cast("double").alias("y")
    )
    rows = stage(rows, "labelled-urls")
    n = rows.count()
    if n > MAX_LABELLED:
        raise ValueError(f"{n} labelled URLs; the model takes up to {MAX_LABELLED}")
    weights = [0.0] * BUCKETS
    for _ in range(ROUNDS if n else 0):
        wrong = F.col("y") - _probability(_margin(F.col("buckets"), weights))
        share = (wrong / F.sqrt(F.size("buckets").cast("double"))).alias("share")
        steps = (
            rows.select(F.explode("buckets").alias("bucket"), share)
            .groupBy("bucket")
            .agg(F.sum("share").alias("s"), F.count(F.lit(1)).alias("n"))
        )
        weights = [w * (1 - DECAY) for w in weights]
        for bucket, s, urls in steps.collect():
            weights[bucket] += RATE * s / (urls + SMOOTH)
    return [float(f"{w:.9g}") for w in weights]


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls.

    A rule is `host/path`. It fits its host and all subdomains, where the path starts with the
    rule's. Rules are constants of the plan, so this is for lists of up to some hundred.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        name, _, rest = text.partition("/")
        own = (host == name) | host.endswith("." + name)
        fits = own & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def judge(
    pages: DataFrame,
    weights: list[float],
    rules: list[tuple[str, str]],
    key: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """A verdict on every URL; one row per page.

    Returns key, `host`, `path`, `rule` (the longest that fits, or null), `verdict` (`allow` or
    `block`: the rule's, else the model's) and `score` (the model's probability of block). A null or
    empty URL, or one without `://`, has an empty host and path and is judged by the model. Repeated
    rows and null keys stay; other columns are not looked at. Nothing is shuffled or joined.
    """
    parts = pages.select(
        F.col(f"`{key}`").alias("key"), host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path")
    )
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    margin = _margin(grams(F.col("host"), F.col("path")), weights)
    scored = parts.withColumns({"rule": rule, "given": verdict, "margin": margin})
    learned = F.when(F.col("margin") > 0, "block").otherwise("allow")
    return scored.select(
        F.col("key").alias(key),
        "host",
        "path",
        "rule",
        F.coalesce("given", learned).alias("verdict"),
        _probability(F.col("margin")).alias("score"),
    )
