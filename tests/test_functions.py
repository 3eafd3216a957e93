import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from termspire.functions import crange, hash_bucket, shift_bucket, split_words, strip_accents, tokenize
from termspire.functions.keys import register_sql_functions

TRICKY = {
    "charity.com": ["charity", "com"],
    "1 800 x": ["x"],
    "don't": ["don", "t"],
    "[x]": ["x"],
    " a  b ": ["a", "b"],
    "": [],
    "Éß": ["eß"],
    "漢字 ok": ["漢字", "ok"],
    "café": ["cafe"],
    "x҈y": ["xy"],
    "ΟΔΟΣ": ["οδοσ"],
    "a-b_c|d\\e/f`g\"h": ["a", "b", "c", "d", "e", "f", "g", "h"],
    "tab\tnew\nline\fform\rreturn": ["tab", "new", "line", "form", "return"],
    "Ångström ØRE": ["angstrom", "øre"],
}


def strings(spark, values):
    return spark.createDataFrame(pa.table({"s": pa.array(values, pa.string())}))


def test_tokenize(spark):
    rows = strings(spark, list(TRICKY)).select("s", tokenize(F.col("s")).alias("t")).collect()
    assert {r["s"]: r["t"] for r in rows} == TRICKY


def test_split_words(spark):
    df = strings(spark, [" Don't  stop. "])
    assert df.select(split_words(F.col("s"))).first()[0] == ["Don't", "stop."]
    assert df.select(split_words(F.col("s"), drop_apostrophes=True)).first()[0] == ["Dont", "stop."]


def test_accents_agree_with_duckdb_on_every_code_point(spark):
    codes = [c for c in range(1, 0x110000) if not 0xD800 <= c <= 0xDFFF]
    chars = pa.table({"code": codes, "s": ["a" + chr(c) + "b" for c in codes]})
    expected = duckdb.connect().sql("SELECT code, strip_accents(s) AS plain FROM chars").fetchall()
    got = (
        spark.createDataFrame(chars)
        .select("code", strip_accents(F.col("s")).alias("plain"))
        .toArrow()
        .to_pylist()
    )
    assert {r["code"]: r["plain"] for r in got} == dict(expected)


def test_accents_agree_with_duckdb_on_sequences(spark):
    rng = random.Random(8)
    jamo = [chr(c) for r in ((0x1100, 0x1115), (0x115F, 0x1178), (0x11A6, 0x11C5)) for c in range(*r)]
    pool = jamo * 3 + list("한국가각힣aeÉßn漢 ") + ["e\u0301", "n\u0303", "\u0308", "\u3099", "か", "\u0c46\u0c56"]
    values = sorted({"".join(rng.choices(pool, k=rng.randint(1, 9))) for _ in range(5000)})
    values += ["\u1112\u1161\u11ab\u1100\u116e\u11a8"]
    words = pa.table({"s": values})
    expected = duckdb.connect().sql("SELECT s, strip_accents(s) AS plain FROM words").fetchall()
    got = strings(spark, values).select("s", strip_accents(F.col("s")).alias("plain")).collect()
    assert {r["s"]: r["plain"] for r in got} == dict(expected)


@pytest.mark.parametrize("term, key", [("rica", 11), ("", 0), ("é", 23), ("漢", 2845), ("0x", 4)])
def test_crange(spark, term, key):
    assert strings(spark, [term]).select(crange(F.col("s"))).first()[0] == key


def test_buckets(spark):
    ids = [0, 131_071, 131_072, 16_777_215, 16_777_216, 1 << 40]
    df = spark.createDataFrame(pa.table({"i": pa.array(ids, pa.int64())}))
    shifted = [r[0] for r in df.select(shift_bucket(F.col("i"), 17)).collect()]
    assert shifted == [i >> 17 for i in ids]
    assert all(0 <= r[0] < 40 for r in df.select(hash_bucket(F.col("i"), 40)).collect())


def test_sql_functions(spark):
    register_sql_functions(spark, 17)
    assert tuple(spark.sql("SELECT cr('rica'), p(393217)").first()) == (11, 3)
    strings(spark, list(TRICKY)).createOrReplaceTempView("tricky")
    rows = spark.sql("SELECT s, tokenize(s) AS t FROM tricky").collect()
    assert {r["s"]: r["t"] for r in rows} == TRICKY


def test_sql_tokenize_agrees_with_the_column(spark):
    rng = random.Random(21)
    pools = ["\u1100\u1101\u1112\u1161\u1162\u1175\u11a7\u11a8\u11c2", "가나각하힣", "aÉéß ΣσÀ", " -'1.,", "\u0301\u0308", "漢字"]
    texts = ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(0, 25))) for _ in range(800)] + [None, "", "   "]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    register_sql_functions(spark)
    rows = frame.selectExpr("text", "tokenize(text) AS by_sql").select("by_sql", tokenize(F.col("text")).alias("by_column"))
    assert all(r.by_sql == r.by_column for r in rows.collect())
    assert spark.sql("SELECT tokenize('\u1112\u1161\u11ab\u1100\u1173\u11af')").first()[0] == ["한글"]
