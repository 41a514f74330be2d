import duckdb
import pytest
from pyspark.sql import functions as F

from judgeloom.functions import text as T
from judgeloom.operators import kernels, metrics
from judgeloom.operators.vote import majority_vote
from judgeloom.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = catalogue.queries()[name](spark, SF)
    got = [tuple(r) for r in df.select(sorted(df.columns)).collect()]
    cur = con.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    want = [tuple(r[names.index(c)] for c in sorted(names)) for r in cur.fetchall()]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_vote_ties_and_invalid(spark):
    rows = [(1, 0, None), (1, 1, "Response B"), (1, 2, "Response A"), (2, 0, None), (2, 1, None), (3, 0, "Response A"), (3, 1, "Response A"), (3, 2, "Response B")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "eval_index long, vote_index int, prediction string, generation_seconds double")
    out = {r["eval_index"]: r for r in majority_vote(df).collect()}
    assert (out[1]["prediction"], out[1]["vote_tied"], out[1]["vote_selected_index"]) == ("Response B", True, 1)
    assert (out[2]["prediction"], out[2]["vote_selected_index"]) == (None, 0)
    assert out[3]["prediction"] == "Response A"


def test_winner_quirks(spark):
    rows = [("Response A beats Response B", "response_a"), ("model-b", "response_b"), ("x: A", "response_a"), ("tie", None), (None, None)]
    df = spark.createDataFrame(rows, "w string, want string").select(T.normalise_winner(F.col("w")).alias("got"), "want")
    assert all(r["got"] == r["want"] for r in df.collect())


def test_weights_add_up():
    assert sum(metrics.WEIGHTS[x] for x in metrics.SECTIONS["Chat"]) == 358
    assert sum(metrics.WEIGHTS[x] for x in metrics.SECTIONS["Chat Hard"]) == 456


def test_kernels():
    assert kernels.balanced(10, 4) == [2, 3, 3, 2]
    for lengths in ([20, 33, 8], [4], [100, 5, 64]):
        counts = kernels.allocate(lengths)
        assert sum(counts) == max(-(-sum(lengths) // 8), sum(-(-n // 16) for n in lengths))
        assert all(-(-n // 16) <= c <= n // 4 for n, c in zip(lengths, counts))
    assert kernels.allocate([3]) is None
    assert kernels.lcs_length("abcbdab", "bdcaba") == 4
    assert kernels.lcs_length("", "a") == 0
