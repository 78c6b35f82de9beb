"""The pipeline's stages on a small corpus with planted cases, and the queries that SQL can express."""

import duckdb
import pytest

import corpus_pipeline
from relkit.llm.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_stages_take_and_leave_what_they_should(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    base = docs.orderBy("doc_id").limit(60)
    one = base.where("length(text) > 1500").orderBy("doc_id").first()
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").where("size(split(text, ' ')) > 15").first()
    clean = "the of and to in is that it was for on are as with his they at be this have from or had by"
    near = "\n".join(x + " again" * (i % 2) for i, x in enumerate(one.text.split("\n")))
    planted = [
        (10_000, one.text, "en", "x", 1),  # an exact copy
        (10_001, near, "en", "x", 1),  # a near copy of which no two lines in a row are the same
        (10_002, f"{clean} {item.text} {clean}", "en", "x", 1),
        (10_003, "这是一个中文文本用于测试语言识别", None, "x", 1),
        (10_004, f"Quite another text, {clean} and nothing else of note.", "en", "x", 1),
        (10_005, None, None, None, None),
    ]
    spark.createDataFrame([*map(tuple, base.collect()), *planted], docs.schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{FOLDER}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        now = spark.read.parquet(f"{tmp_path}/{i}")
        seen[name] = {r.doc_id for r in now.select("doc_id").collect()}
        assert name == "tokens" or now.columns == docs.columns
    assert seen["language"] >= {10_000, 10_001, 10_002, 10_004} and not seen["language"] & {10_003, 10_005}
    assert 10_000 not in seen["near_duplicates"] and 10_001 not in seen["near_duplicates"]
    assert 10_002 in seen["near_duplicates"] and 10_002 not in seen["contamination"]
    assert 10_004 in seen["tokens"] and now.where("not round_trip").count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = QUERIES[name](spark, FOLDER)
    result = duck.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(result.fetchall(), key=repr)
