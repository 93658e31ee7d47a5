import pytest

from loamline.plans import catalog

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_same_rows_as_sql(name, spark, duck, compare):
    got = catalog.QUERIES[name](spark, SMALL).toPandas()
    if name not in catalog.ORACLES:
        assert len(got) > 0
        return
    want = duck.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert compare(got) == compare(want)


@pytest.mark.parametrize("name", ["q_seed_partitions", "q_near_dup_clusters", "q_upsample", "q_one_per_entity"])
def test_the_same_for_any_partitioning(name, spark, compare):
    rows = []
    for n in ("1", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        rows.append(compare(catalog.QUERIES[name](spark, SMALL).toPandas()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert rows[0] == rows[1]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(e.queries())
