import duckdb
import pytest

from tessella.llm import mixing
from tessella.llm.common import table


def duck_rows(sql, folder=None, **frames):
    con = duckdb.connect()
    for name, frame in frames.items():
        con.register(name, frame)
    if folder:
        con.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    return con.execute(sql)


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_equals_sql(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    got = mixing.op2_mixing(spark, folder)
    want = duck_rows(mixing.mixing_sql(), folder)
    assert got.columns == [c[0] for c in want.description]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want.fetchall(), key=key)


def test_query_meets_its_weights_in_more_blocks_than_documents(spark):
    folder = "/root/testdata/sf0.001"
    got = mixing.op2_mixing(spark, folder, block_tokens=150)
    want = duck_rows(mixing.mixing_sql(block_tokens=150), folder)
    key = lambda r: tuple((x is None, x) for x in r)
    rows = sorted(map(tuple, got.collect()), key=key)
    assert rows == sorted(want.fetchall(), key=key)
    docs = table(spark, folder, "documents").withColumn("tokens", mixing.tokens_of(mixing.F.col("text")))
    assert docs.agg(mixing.F.sum("tokens")).first()[0] / 150 > docs.count()
    longest = {r.source: r.n for r in docs.groupBy("source").agg(mixing.F.max("tokens").alias("n")).collect()}
    for r in mixing.temperature(docs.groupBy("source").agg(mixing.F.sum("tokens").alias("tokens"))).collect():
        assert -1 <= sum(x[2] for x in rows if x[1] == r.source) - r.weight * r.all_tokens <= longest[r.source] + 1


def test_budget_and_blocks(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = mixing.mix(docs, block_tokens=20_000)
    per_source = {r.source: r.n for r in got.groupBy("source").agg(mixing.F.sum(mixing.tokens_of(got["text"])).alias("n")).collect()}
    totals = docs.groupBy("source").agg(mixing.F.sum(mixing.tokens_of(docs["text"])).alias("tokens"))
    weights = {r.source: r for r in mixing.temperature(totals).collect()}
    assert sum(r.weight for r in weights.values()) == pytest.approx(1)
    assert all(r.weight * r.all_tokens / r.tokens <= mixing.MAX_REPEATS + 1e-6 for r in weights.values())
    longest = docs.agg(mixing.F.max(mixing.tokens_of(docs["text"]))).first()[0]
    for s, r in weights.items():
        assert 0 <= per_source[s] - r.weight * r.all_tokens + 1 <= longest + 1
    assert got.groupBy("mix_block").agg((mixing.F.max("mix_order") == mixing.F.count("*")).alias("ok")).filter("not ok").count() == 0


def test_odd_rows(spark):
    rows = [(1, "a b", None, 1), (1, "a b", None, 1), (2, None, "x", 1), (3, " \n", "x", 1), (None, "c " * 40000, "y", 1), (4, "d", "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_epoch int")
    got = mixing.mix(docs)
    assert sorted(got.columns) == sorted(["doc_id", "text", "source", "mix_epoch", "mix_block", "mix_order"])
    assert {r.doc_id for r in got.collect()} <= {1, 4, None}
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mix(docs.filter("doc_id in (2, 3)")).count() == 0
    one = mixing.mix(docs.filter("source = 'y'")).collect()
    assert [r.mix_epoch for r in one] == [0]


def test_a_source_with_fewer_documents_than_blocks_gets_its_share(spark):
    words = lambda n: "w " * n
    rows = [(i, words(50 + i % 100), "large") for i in range(400)] + [(1000 + i, words(5 + i % 20), "small") for i in range(150)] + [(2000 + i, words(10 + i % 7), "tiny") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    n = mixing.F.sum(mixing.tokens_of(mixing.F.col("text"))).alias("tokens")
    weights = {r.source: r for r in mixing.temperature(docs.groupBy("source").agg(n), gain=0.3).collect()}
    got = {r.source: r.tokens for r in mixing.mix(docs, gain=0.3, block_tokens=100).groupBy("source").agg(n).collect()}
    assert all(r.all_tokens > 300 * 100 and (r.weight * r.all_tokens / r.tokens) % 1 > 0.02 for r in weights.values())
    for source, longest in (("large", 149), ("small", 24), ("tiny", 16)):
        r = weights[source]
        assert -1 <= got[source] - r.weight * r.all_tokens <= longest + 1


def test_columns_that_clash(spark):
    names = ("_source", "_tokens", "_mark", "_draw", "_repeats", "_blocks", "_home", "_times", "_left", "_over", "_row", "_key", "_Part")
    docs = spark.createDataFrame([(i, f"a b c {i}", "s" if i % 3 else None, *range(len(names))) for i in range(30)], f"doc_id long, text string, source string, {', '.join(f'{n} int' for n in names)}")
    got = mixing.mix(docs, block_tokens=20)
    assert got.columns == [*docs.columns, "mix_epoch", "mix_block", "mix_order"]
    assert {tuple(r)[:3] for r in got.collect()} <= {tuple(r)[:3] for r in docs.collect()} and got.count() > 20
