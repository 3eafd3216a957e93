"""Document fingerprints by winnowing, and the document that follows another."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termspire.plans.staging import is_small, stage

GRAM = 3
WINDOW = 4
PRIME = (1 << 31) - 1
BASE = 1_000_003
PLACES = 1 << 31
# A word of more code points is so many units, as are all words of a text of fewer code points.
LONG = 16
SHORT = 300
# Rows that are brought together to find their successors, and groups of them.
BUCKET_ROWS = 256
BUCKETS_PER_GROUP = 4096
# Ranges of ids of about as many rows each, inside which buckets are of one width.
RANGES = 512


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _points(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def _units(words: Column) -> Column:
    """Words, but the code points of long ones: text without spaces has units too."""
    cut = F.flatten(F.transform(words, lambda w: F.when(F.length(w) > LONG, _points(w)).otherwise(F.array(w))))
    return F.when(F.exists(words, lambda w: F.length(w) > LONG), cut).otherwise(words)


def _small_units(text: Column, words: Column) -> Column:
    """The code points of the words of a short text, of which few words are left when it is edited."""
    none = F.array().cast("array<string>")
    return F.when(F.length(text) < SHORT, _points(F.array_join(words, ""))).otherwise(none)


def _word_hash(word: Column) -> Column:
    """31 bits of the word's MD5, so that other engines can make the same fingerprints."""
    return F.conv(F.substring(F.md5(word.cast("binary")), 1, 8), 16, 10).cast("bigint") % F.lit(PRIME)


def _roll(total: Column, value: Column) -> Column:
    return (total * F.lit(BASE) + value) % F.lit(PRIME)


def _less(one: Column, other: Column) -> Column:
    return F.least(one, other)


def _from(values: Column, shift: int, drop: int) -> Column:
    """The values from place `shift` on, `drop` of them missing in all."""
    return F.slice(values, F.lit(shift + 1), F.size(values) - drop)


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add the picks of a text as `name`, and those by code points as `name`_small (empty in long texts)."""
    df = df.withColumn("_w", _words(F.col(text)))
    df = df.withColumns({"_u": _units(F.col("_w")), "_s": _small_units(F.col(text), F.col("_w"))})
    return with_picks(with_picks(df, "_u", name), "_s", f"{name}_small").drop("_w", "_u", "_s")


def with_picks(df: DataFrame, units: str, picks: str) -> DataFrame:
    """Add the picks of an array of units: for each window of WINDOW hashes the least, the rightmost of ties.

    A pick holds the hash of GRAM units above the place, counted from the end, in one long, so the
    least pick is the rightmost of the least hashes. Minima of 2, then 4 neighbours come from
    shifted arrays. Fewer units than GRAM are one hash; fewer hashes than WINDOW are one window.
    A run of GRAM + WINDOW - 1 units that two texts share always leaves a common hash.
    """
    first = lambda c: _from(F.col(c), 0, 1)
    rolled = F.col("_h")
    for shift in range(1, GRAM):
        rolled = F.zip_with(
            F.slice(rolled, F.lit(1), F.size("_h") - shift), _from(F.col("_h"), shift, shift), _roll
        )
    whole = F.array(F.aggregate("_h", F.lit(0).cast("bigint"), _roll))
    none = F.array().cast("array<bigint>")
    few = lambda column, least, yes, no: F.when(F.size(column) >= least, yes).otherwise(no)
    packed = lambda x, i: x * F.lit(PLACES) + (F.lit(PLACES - 1) - i)
    least = F.col("_p")
    df = df.withColumn("_h", F.transform(units, _word_hash))
    df = df.withColumn("_g", few("_h", GRAM, rolled, F.when(F.size("_h") > 0, whole).otherwise(none)))
    df = df.withColumn("_p", F.transform("_g", packed))
    df = df.withColumn("_q", few("_p", 2, F.zip_with(first("_p"), _from(least, 1, 1), _less), least))
    pairs = F.col("_q")
    fours = F.zip_with(_from(pairs, 0, 2), _from(pairs, 2, 2), _less)
    short = F.when(F.size("_p") > 0, F.array(F.array_min("_p"))).otherwise(none)
    df = df.withColumn(picks, few("_p", WINDOW, F.array_distinct(fours), short))
    return df.drop("_h", "_g", "_p", "_q")


def hashes(name: str) -> Column:
    """The distinct hashes of a fingerprint, of both kinds."""
    return F.array_distinct(F.transform(F.concat(name, f"{name}_small"), lambda p: F.shiftright(p, 31)))


def full_text(name: str) -> Column:
    """A fingerprint as text: its picks, and after a semicolon those by code points, if it has any."""
    small = F.concat(F.lit(";"), as_text(F.col(f"{name}_small")))
    return F.concat(as_text(F.col(name)), F.when(F.size(f"{name}_small") > 0, small).otherwise(""))


def as_text(picks: Column) -> Column:
    """`place:hash` for each pick, in the order of the text."""
    place = lambda p: F.lit(PLACES - 1) - p % F.lit(PLACES)
    return F.array_join(
        F.transform(
            picks, lambda p: F.concat(place(p).cast("string"), F.lit(":"), F.shiftright(p, 31).cast("string"))
        ),
        ",",
    )


def likeness(one: str, other: str) -> Column:
    """Shared hashes over all hashes of two fingerprints; 1 if both are empty."""
    shared = F.size(F.array_intersect(one, other)).cast("double")
    return F.when(
        F.size(one) + F.size(other) > 0, shared / (F.size(one) + F.size(other) - shared)
    ).otherwise(F.lit(1.0))


def in_buckets(rows: DataFrame) -> DataFrame:
    """The rows (id, text) with `mark`, a hash of the text, and `bucket`: numbers that rise with id and mark.

    Percentiles of the ids cut them into ranges of about as many rows; an id that is one of these borders
    is a range of its own, and so are null ids. A range is cut into buckets of BUCKET_ROWS rows on
    average: by equal widths of ids, or by the mark where it has only one id. So an outlying id widens
    the buckets of its own range only, and an id of many rows is in many buckets.
    """
    marked = rows.withColumn("mark", F.md5(F.col("text").cast("binary")))
    shares = [n / RANGES for n in range(RANGES + 1)]
    found = rows.agg(F.percentile_approx("id", shares, 8 * RANGES)).first()[0]
    borders = sorted(set(found or [0]))
    at = F.array(*[F.lit(b).cast("bigint") for b in borders])
    below = F.size(F.filter(at, lambda b: b <= F.col("id")))
    place = F.when(F.col("id").isNull(), 0).otherwise(2 * below + 1 - F.array_contains(at, F.col("id")).cast("int"))
    placed = marked.withColumn("range", place)
    sizes = placed.groupBy("range").agg(F.count(F.lit(1)), F.min("id"), F.max("id")).collect()
    start, starts, lows, widths = 0, {}, {}, {}
    for number, n, low, high in sorted(sizes, key=lambda r: r[0]):
        starts[number] = start
        if low is None or low == high:
            lows[number], widths[number] = 0, -(n // BUCKET_ROWS + 1)
            start -= widths[number]
        else:
            lows[number], widths[number] = low, max(1, (high - low + 1) * BUCKET_ROWS // n)
            start += (high - low) // widths[number] + 1
    table = [Decimal(0)] * (2 * len(borders) + 2)

    def looked_up(values: dict[int, int], kind: str) -> Column:
        filled = [values.get(n, 0) for n in range(len(table))]
        return F.element_at(F.array(*[F.lit(Decimal(v)).cast(kind) for v in filled]), F.col("range") + 1)

    # Ids may lie further apart than a long reaches.
    placed = placed.withColumns(
        {
            "_start": looked_up(starts, "bigint"),
            "_low": looked_up(lows, "decimal(20,0)"),
            "_width": looked_up(widths, "decimal(30,0)"),
            "_top": F.conv(F.substring("mark", 1, 8), 16, 10).cast("bigint"),
        }
    )
    by_mark = F.shiftright(F.col("_top") * (-F.col("_width")).cast("bigint"), 32)
    by_id = F.expr("cast(cast(cast(id as decimal(20,0)) - _low as decimal(30,0)) div _width as bigint)")
    within = F.when(F.col("_width") < 0, by_mark).otherwise(by_id)
    return placed.withColumn("bucket", F.col("_start") + within).select("bucket", "id", "mark", "text")


def successors(rows: DataFrame) -> DataFrame:
    """The rows (id, text) in buckets of neighbours, with each bucket's successor as a last row.

    Columns: bucket, last (false for a row, true for the successor), id, mark, text. Rows follow one another
    by falling id, then falling mark; null ids come last, and after the last row the first comes again.
    One shuffle by bucket brings neighbours together; only the first row of each bucket is moved again.
    """
    placed = in_buckets(rows)
    group = F.floor(F.col("bucket") / F.lit(BUCKETS_PER_GROUP))
    heads = placed.groupBy("bucket").agg(F.max(F.struct("id", "mark")).alias("head")).withColumn("group", group)
    heads = stage(heads, "heads")
    down = Window.partitionBy("group").orderBy(F.desc("bucket"))
    # One row per group, that is, per million rows of the input: the only window without a key.
    tops = heads.groupBy("group").agg(F.max("bucket").alias("top"), F.max_by("head", "bucket").alias("top_head"))
    order = Window.orderBy(F.desc("group"))
    first = Window.orderBy(F.desc("group")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    later = tops.select(
        "group",
        F.coalesce(F.lead("top").over(order), F.first("top").over(first)).alias("top"),
        F.when(F.lead("top").over(order).isNotNull(), F.lead("top_head").over(order))
        .otherwise(F.first("top_head").over(first))
        .alias("top_head"),
    )
    after = (
        heads.withColumn("next", F.lead("bucket").over(down))
        .withColumn("next_head", F.lead("head").over(down))
        .join(F.broadcast(later), "group")
        .select(
            F.col("bucket").alias("for"),
            F.coalesce("next", "top").alias("bucket"),
            F.when(F.col("next").isNotNull(), F.col("next_head")).otherwise(F.col("top_head")).alias("head"),
        )
    )
    after = stage(after, "successors")
    wanted = F.broadcast(after) if is_small(after) else after
    first_row = F.struct(placed["id"], placed["mark"]).eqNullSafe(wanted["head"])
    same = (placed["bucket"] == wanted["bucket"]) & first_row
    last = (
        placed.join(wanted, same)
        .groupBy(F.col("for").alias("bucket"))
        .agg(F.max("text").alias("text"))
        .select("bucket", F.lit(True).alias("last"), F.lit(None).cast("bigint").alias("id"), F.lit("").alias("mark"), "text")
    )
    return placed.select("bucket", F.lit(False).alias("last"), "id", "mark", "text").union(last)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text; one row per document.

    The edited text ends in the start of the next document, by falling key (after the last comes the
    first): the last third of the code points, rounded down, gives way to as many of the next text,
    or all of a shorter one. Units are words, code points in words of more than LONG of them; texts of fewer
    than SHORT code points have a second fingerprint by code points alone, after a semicolon. Returns key, `n_chars`, `edited_sha256`, `fingerprint`,
    `edited_fingerprint`, `near_edited`, `near_next` (shared hashes over all hashes). A null text
    counts as empty; an empty fingerprint is like another empty one by 1, and any other by 0. Rows
    keep their number; of rows with one key, the greater MD5 of the text comes first. Null keys come last.
    Other columns are not looked at. The key must be an integer.
    """
    rows = docs.select(
        F.col(f"`{key}`").cast("bigint").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")
    )
    placed = with_fingerprint(successors(rows).repartition("bucket"), "text", "picks")
    order = Window.partitionBy("bucket").orderBy("last", F.desc_nulls_last("id"), F.desc("mark"))
    placed = placed.withColumn("own", hashes("picks"))
    placed = placed.withColumns(
        {"next_text": F.lead("text").over(order), "next_hashes": F.lead("own").over(order), "n": F.length("text")}
    ).where(~F.col("last"))
    cut = F.floor(F.col("n") / 3).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), F.col("n") - cut), F.substring(F.col("next_text"), F.lit(1), cut)
    )
    placed = placed.withColumn("edited", edited).drop("text", "next_text", "bucket", "last", "mark")
    placed = with_fingerprint(placed, "edited", "edited_picks").withColumn("changed", hashes("edited_picks"))
    return placed.select(
        F.col("id").cast(docs.schema[key].dataType).alias(key),
        F.col("n").cast("bigint").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        full_text("picks").alias("fingerprint"),
        full_text("edited_picks").alias("edited_fingerprint"),
        likeness("own", "changed").alias("near_edited"),
        likeness("own", "next_hashes").alias("near_next"),
    )
