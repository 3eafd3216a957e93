"""Site-relative line dedup: lines that too large a share of a host's pages contain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termspire.plans.skew import frequent_keys, spread_join
from termspire.plans.staging import is_small, stage

RATIO = 0.1
# A line of one page alone is no boilerplate, however few pages the host has.
MIN_PAGES = 2


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _hashes(text: Column) -> Column:
    """The distinct lines of a text by hash, without blank ones."""
    full = F.filter(F.transform(_lines(text), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_distinct(F.transform(full, lambda x: F.xxhash64(x)))


def boilerplate(
    docs: DataFrame,
    host: str = "source",
    text: str = "text",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
) -> DataFrame:
    """(host, pages, lines): per host, by hash, the lines on more than `ratio` of its pages.

    A page is a row, and a line counts once per page. Equal texts of a host are counted as one row of
    a table first, and hashes are added up within tasks before the shuffle, so a hot host, line or copy
    costs a row per task. As each page of n lines adds at most n / pages to the ratios, a host has at
    most (its lines per page) / ratio such lines. Lines on fewer than `min_pages` pages stay.
    """
    value = F.col(f"`{text}`")
    distinct = stage(
        docs.select(F.col(f"`{host}`").alias("host"), F.xxhash64(value).alias("same"), _hashes(value).alias("lines"))
        .groupBy("host", "same")
        .agg(F.first("lines").alias("lines"), F.count(F.lit(1)).alias("rows")),
        "pages",
    )
    pages = distinct.groupBy("host").agg(F.sum("rows").alias("pages"))
    seen = (
        distinct.select("host", "rows", F.explode("lines").alias("line"))
        .groupBy("host", "line")
        .agg(F.sum("rows").alias("n"))
        .where(F.col("n") >= min_pages)
    )
    pages, again = stage(pages, "hosts"), F.col("seen.host").eqNullSafe(F.col("pages.host"))
    few = pages.alias("pages")
    joined = seen.alias("seen").join(F.broadcast(few) if is_small(pages, "host") else few, again)
    common = (
        joined.where(F.col("n") > F.col("pages") * F.lit(ratio))
        .groupBy(F.col("pages.host").alias("host"))
        .agg(F.collect_list("line").alias("lines"))
    )
    return pages.alias("pages").join(
        common.alias("common"), F.col("pages.host").eqNullSafe(F.col("common.host")), "left"
    ).select("pages.host", "pages", F.coalesce("lines", F.array().cast("array<bigint>")).alias("lines"))


def with_boilerplate(docs: DataFrame, found: DataFrame, host: str = "source") -> DataFrame:
    """The documents, with a column `_boilerplate`: the hashes of lines to drop.

    The table of hosts is broadcast if it was counted to be small; else it is joined, and hosts with
    many pages are spread over tasks.
    """
    key = F.struct(F.col(f"`{host}`").alias("host"))
    docs = docs.withColumn("_host", key)
    found = found.select(F.struct("host").alias("_host"), F.col("lines").alias("_boilerplate"), "pages")
    if is_small(found, "_host.host"):
        return docs.join(F.broadcast(found.drop("pages")), "_host").drop("_host")
    total = found.agg(F.sum("pages")).first()[0]
    frequent = frequent_keys(found, "_host", "pages", total)
    return spread_join(docs, found.drop("pages"), "_host", frequent, ["_host"]).drop("_host")


def _kept(text: Column) -> Column:
    stays = lambda x: (F.trim(x) == "") | ~F.array_contains("_boilerplate", F.xxhash64(F.trim(x)))
    return F.filter(_lines(text), stays)


def line_dedup(
    docs: DataFrame,
    key: str = "doc_id",
    host: str = "source",
    text: str = "text",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
) -> DataFrame:
    """Every document without the boilerplate lines of its host; one row per document.

    Returns key, `host`, `n_lines`, `n_dropped`, `text` (the kept lines, joined again). A line is
    compared without the spaces around it; blank lines are never dropped or counted as boilerplate.
    A null text stays null, with 0 lines; an empty one is one blank line. Rows without host are
    one host. Repeated rows are pages of their own. Other columns are not looked at.
    """
    found = stage(boilerplate(docs, host, text, ratio, min_pages), "boilerplate")
    own = docs.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{host}`").alias("host"), F.col(f"`{text}`").alias("text")
    )
    kept = with_boilerplate(own, found, "host").withColumn("kept", _kept(F.col("text")))
    before = F.coalesce(F.size(_lines(F.col("text"))), F.lit(0))
    before = F.when(F.col("text").isNull(), 0).otherwise(before).cast("bigint")
    after = F.when(F.col("text").isNull(), 0).otherwise(F.size("kept")).cast("bigint")
    return kept.select(
        F.col("key").alias(key),
        "host",
        before.alias("n_lines"),
        (before - after).alias("n_dropped"),
        F.when(F.col("text").isNotNull(), F.array_join("kept", "\n")).alias("text"),
    )


def drop_lines(
    docs: DataFrame,
    host: str = "source",
    text: str = "text",
    length: str | None = "n_chars",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
    keep_whole: bool = False,
) -> DataFrame:
    """The documents with all their columns, their boilerplate lines dropped from the text.

    Texts without such lines are unchanged, and so are, with `keep_whole`, those of which nothing else
    but white space would be left. `length`, where the frame has it, becomes the number of
    code points of a text that has changed.
    """
    found = stage(boilerplate(docs, host, text, ratio, min_pages), "boilerplate")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    packed = docs.select(row.alias("row"), F.col(f"`{host}`").alias("host"))
    old = F.col("row").getField(text)
    left = F.when(F.size("_boilerplate") == 0, old).otherwise(F.array_join(_kept(old), "\n"))
    if keep_whole:
        left = F.when(F.trim(left) == "", old).otherwise(left)
    made = with_boilerplate(packed, found, "host").withColumn("left", left)
    columns = []
    for name, kind in docs.dtypes:
        column = F.col("row").getField(name)
        if name == text:
            column = F.col("left")
        elif name == length:
            column = F.when(~F.col("left").eqNullSafe(old), F.length("left")).otherwise(column).cast(kind)
        columns.append(column.alias(name))
    return made.select(columns)
