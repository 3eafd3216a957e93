"""Rows that an operator must live with: nulls, empty and long texts, repeats, clashing columns."""

LONG = "The quick brown fox jumps over the lazy dog, and runs away from here. " * 3000

ROWS = [
    (1, "one two three four five six seven eight nine ten eleven"),
    (2, None),
    (3, ""),
    (4, " \n\t "),
    (5, LONG),
    (6, "one two three four five six seven eight nine ten eleven"),
    (6, "one two three four five six seven eight nine ten eleven"),
    (None, "a text without a key, among the others"),
    (None, None),
    (7, "漢字かな交じり文、 Привет мир! ñandú é   x"),
    (8, "12345 !!! ???"),
    (9, "word"),
]
# Names that operators use inside, as columns of the input.
EXTRA = "key row id host lines n same slots bucket last node component text_ _host items spans words".split()


def documents(spark, rows=None):
    """(doc_id, text, lang, source, n_chars) and columns with names that clash."""
    rows = ROWS if rows is None else rows
    made = [
        (k, t, None if n % 4 == 0 else "en", None if n % 5 == 0 else f"s{n % 2}", None if t is None else len(t))
        + tuple(f"x{n}" for _ in EXTRA)
        for n, (k, t) in enumerate(rows)
    ]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    return spark.createDataFrame(made, schema + "".join(f", `{c}` string" for c in EXTRA))


def empty(spark):
    return documents(spark, []).limit(0)
