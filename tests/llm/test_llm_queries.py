import os

import duckdb
import pytest

from loamline.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck, compare):
    df = QUERIES[name](spark, SMALL)
    got = df.toPandas()
    assert len(got) > 0
    if name in ORACLES:
        want = duck.sql(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and compare(got) == compare(want)


def test_pipeline(spark):
    """Stage by stage: what each drops, against SQL or its law."""
    import corpus_pipeline as cp
    from loamline.llm.shared import written

    c = duckdb.connect()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    c.execute(f"CREATE VIEW benchmark AS FROM '{SMALL}/benchmark.parquet'")
    for name, stage in cp.STAGES:
        before = docs.toPandas()
        docs = written(stage(spark, docs, SMALL), "test")
        after = docs.toPandas()
        assert list(after.columns)[:5] == list(before.columns)
        c.execute("CREATE OR REPLACE TABLE documents AS SELECT * FROM before")
        if name.startswith("n-gram"):
            want = c.sql(f"SELECT doc_id FROM ({ORACLES['op5_jaccard']}) WHERE doc_id = component_id").df()
            assert sorted(after.doc_id) == sorted(want.doc_id)
        elif name.startswith("benchmark"):
            want = c.sql(f"SELECT doc_id FROM ({ORACLES['op6_decontamination']}) WHERE NOT contaminated").df()
            assert sorted(after.doc_id) == sorted(want.doc_id)
        elif name.startswith("mixing"):
            sizes = before.text.map(lambda t: len(t.encode().split()))
            law = ORACLES["op4_mixing"].replace("coalesce(doc_id::VARCHAR, '')", "doc_id::VARCHAR || ':' || sha256(text)")
            want = c.sql(f"SELECT doc_id, floor(taken / size + 0.5) AS n FROM ({law}) WHERE taken / size >= 0.5").df().set_index("doc_id").n.to_dict()
            assert (sizes > 0).all() and after.groupby("doc_id").size().to_dict() == want and set(after.text) <= set(before.text)
        elif name == "sharding":
            assert sorted(map(str, after[before.columns].values.tolist())) == sorted(map(str, before.values.tolist()))
            assert after.shard.value_counts().max() - after.shard.value_counts().min() <= 1
        else:
            assert 0 < len(after) < len(before)
    assert os.path.exists(cp.__file__)
