import micro
from termspire.operators.sampling import sample_queries
from termspire.operators.tokens import terms_of_query, token_lists, tokenize_queries
from termspire.plans.staging import new_folder
from termspire.registered.fixtures import SAMPLE_QUERIES
from termspire.sinks import write_csv
from termspire.sources import number_queries, read_query_log, read_query_sample


def texts(spark, values):
    return spark.createDataFrame([(v,) for v in values], "QueryText string")


def test_sample_file_round_trip(spark):
    path = new_folder(spark, "csv")
    awkward = [*SAMPLE_QUERIES, 'say "hi", then', "don't"]
    write_csv(texts(spark, awkward), path)
    back = read_query_sample(spark, path)
    assert sorted(r[0] for r in back.collect()) == sorted(awkward)
    numbered = {r["QueryText"]: r["qno"] for r in number_queries(back).collect()}
    assert [numbered[t] for t in sorted(awkward)] == list(range(len(awkward)))


def test_log_and_sample(spark):
    path = new_folder(spark, "tsv")
    rows = [(str(i), f"query {i % 7}", f"D{i}") for i in range(50)]
    spark.createDataFrame(rows, "a string, b string, c string").write.option("sep", "\t").csv(path)
    log = read_query_log(spark, path)
    assert log.columns == ["QueryID", "QueryText", "DocumentID"]
    drawn = [r[0] for r in sample_queries(log, 3, 37).collect()]
    assert len(set(drawn)) == 3
    assert drawn == [r[0] for r in sample_queries(log.repartition(9), 3, 37).collect()]
    assert drawn != [r[0] for r in sample_queries(log, 3, 17).collect()]
    assert sample_queries(log, 100, 1).count() == 7


def test_tokenising_queries(spark):
    df = number_queries(texts(spark, ["charity.com", "1 800 number"]))
    normal = sorted(map(tuple, tokenize_queries(df).collect()))
    assert normal == [(0, "number"), (1, "charity"), (1, "com")]
    plain = sorted(map(tuple, tokenize_queries(df, mode="whitespace").collect()))
    assert plain == [(0, "1"), (0, "800"), (0, "number"), (1, "charity.com")]
    assert [r[0] for r in terms_of_query(tokenize_queries(df), 0).collect()] == ["number"]
    assert sorted(token_lists(df).collect()[i]["qt"] for i in range(2)) == [["charity", "com"], ["number"]]


def test_literal_queries(spark):
    assert sorted(map(tuple, micro.queries(spark, ["b", "a"], [], ["a"]).collect())) == [
        (0, "a"), (0, "b"), (2, "a"),
    ]
