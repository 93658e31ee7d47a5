import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamline.sources import feeds, jsonl
from loamline.streaming import incremental as R

PAIR = T.StructType([T.StructField("commit", T.StringType()), T.StructField("target", T.IntegerType())])


def write(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))


def test_pairs(spark, tmp_path):
    write(tmp_path / "a.jsonl", [{"commit": "x", "target": 1}, {"commit": "x", "target": 0}, {"commit": "y", "target": 1}, {"commit": "y", "target": 0}])
    got = jsonl.read_pairs(spark, str(tmp_path / "a.jsonl"), PAIR, F.col("first.commit")).orderBy("pair").collect()
    assert [(r.pair, r.first.commit, r.first.target, r.second.target) for r in got] == [(0, "x", 1, 0), (1, "y", 1, 0)]
    for bad in ([{"commit": "x", "target": 1}], [{"commit": "x", "target": 1}, {"commit": "x", "other": 0}], [{"commit": "x", "target": 1}, {"commit": "x", "target": 0}] * 2):
        write(tmp_path / "b.jsonl", bad)
        with pytest.raises(Exception):  # noqa: B017
            jsonl.read_pairs(spark, str(tmp_path / "b.jsonl"), PAIR, F.col("first.commit")).collect()


def test_round_trip_and_freeze(spark, tmp_path):
    df = spark.createDataFrame([("é", 1, None), ("a", 2, "x")], "b string, a int, c string")
    jsonl.write_jsonl(df, str(tmp_path / "out"), ["a"])
    back = jsonl.read_jsonl(spark, str(tmp_path / "out"), df.schema)
    assert jsonl.content_hash(back) == jsonl.content_hash(df.repartition(3))
    manifest = jsonl.frozen(df, {}, "t")
    assert jsonl.frozen(back, manifest, "t") == manifest
    with pytest.raises(ValueError):
        jsonl.frozen(df.union(df), manifest, "t")
    assert [r.line for r in jsonl.canonical(df).orderBy("line").collect()] == ['{"a":1,"b":"é","c":null}', '{"a":2,"b":"a","c":"x"}']


def test_reports(spark, tmp_path):
    assert jsonl.markdown_table(["a", "b"], [(1, None)]) == "| a | b |\n| --- | --- |\n| 1 |  |\n"
    assert jsonl.json_document({"b": 1, "a": "é"}) == '{\n  "a": "é",\n  "b": 1\n}\n'
    jsonl.write_csv(spark.range(1), str(tmp_path / "csv"), ["verdict"])
    assert "id,verdict" in "".join(p.read_text() for p in (tmp_path / "csv").glob("*.csv"))


RECORD = T.StructType([T.StructField("id", T.StringType()), T.StructField("lastModified", T.StringType()), T.StructField("descriptions", T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("value", T.StringType())])))])


def record(i, t, v="text"):
    return {"cve": {"id": i, "lastModified": t, "descriptions": [{"lang": "es", "value": "no"}, {"lang": "en", "value": " "}, {"lang": "en", "value": f" {v} "}]}}


def test_feeds(spark, tmp_path):
    body = {2020: [record("A", "2"), record("B", "1")], 2021: [record("A", "2", "later feed"), record("C", "1"), record("B", "3", "newer")]}
    for year, rows in body.items():
        raw = json.dumps({"timestamp": "t", "vulnerabilities": rows}).encode()
        (tmp_path / f"nvdcve-2.0-{year}.json.gz").write_bytes(gzip.compress(raw))
        (tmp_path / f"nvdcve-2.0-{year}.meta").write_text(f"size:1\nsha256:{hashlib.sha256(raw).hexdigest().upper()}\n")
    (tmp_path / "nvdcve-2.0-recent.json").write_text("{}")
    got = feeds.extract(feeds.read_feeds(spark, str(tmp_path), RECORD), spark.createDataFrame([("A",), ("B",)], "id string"))
    assert sorted((r.id, r.d) for r in got.select("id", feeds.english(F.col("descriptions")).alias("d")).collect()) == [("A", "text"), ("B", "newer")]
    (tmp_path / "nvdcve-2.0-2021.meta").write_text(f"sha256:{'0' * 64}\n")
    with pytest.raises(Exception):  # noqa: B017
        feeds.read_feeds(spark, str(tmp_path), RECORD).collect()


def test_taxonomy(spark, tmp_path):
    (tmp_path / "t.xml").write_text("""<Catalog><Weaknesses>
<Weakness ID="1" Name="Top" Abstraction="Pillar" Status="Stable"/>
<Weakness ID="2" Name="Low" Abstraction="Base" Status="Draft"><Related_Weaknesses>
<Related_Weakness Nature="ChildOf" CWE_ID="1" View_ID="1000"/><Related_Weakness Nature="ChildOf" CWE_ID="9" View_ID="699"/></Related_Weaknesses></Weakness></Weaknesses></Catalog>""")
    nodes, edges = feeds.read_taxonomy(spark, str(tmp_path / "t.xml"))
    assert nodes.count() == 2 and [tuple(r) for r in edges.collect()] == [("2", "1")]


def test_resumed_stream_keeps_the_last_success(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("ok", T.BooleanType())])
    (tmp_path / "in").mkdir()
    run = lambda: R.arriving(spark, str(tmp_path / "in"), schema).writeStream.foreachBatch(R.merge_last_success(str(tmp_path / "t"), "id", "n", F.col("ok"))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    (tmp_path / "in" / "1.json").write_text('{"id":"a","n":1,"ok":false}\n{"id":"b","n":1,"ok":true}\n{"id":"c"')
    run()
    (tmp_path / "in" / "2.json").write_text('{"id":"a","n":2,"ok":true}\n{"id":"b","n":2,"ok":false}\n')
    run()
    got = lambda: sorted(tuple(r) for r in R.current(spark, str(tmp_path / "t"), schema).select("id", "n", "ok").collect())
    assert got() == [("a", 2, True), ("b", 1, True)]


def test_a_batch_rewrites_what_it_touches_and_may_run_again(spark, tmp_path):
    schema, t = "id int, n int, ok boolean", str(tmp_path / "t")
    put = R.merge_last_success(t, "id", "n", F.col("ok"), 16)
    batches = [[(i, 0, i % 2 == 0) for i in range(200)], [(3, 1, True), (4, 1, False), (900, 1, False)], [(3, 2, False), (900, 2, True)]]
    want = {}
    for k, rows in enumerate(batches):
        for _ in range(2):  # the second time as after a crash
            put(spark.createDataFrame(rows, schema), k)
        for i, n, ok in rows:
            if ok or not want.get(i, (0, False))[1]:
                want[i] = (n, ok)
        assert {r.id: (r.n, r.ok) for r in R.current(spark, t, spark.createDataFrame([], schema).schema).collect()} == want
    folders = {p.name: sorted(v.name for v in p.glob("v=*")) for p in (tmp_path / "t").glob("part=*")}
    assert len(folders) == 16 and sum(v == ["v=0"] for v in folders.values()) >= 13 and all(len(v) <= 2 for v in folders.values())


def test_windows_of_a_stream(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type")
    (tmp_path / "in").mkdir()
    rows.write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    R.tumbling(stream, "ts", "1 hour", "1 day", ["event_type"]).writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, R.tumbling(rows, "ts", "1 hour", "1 day", ["event_type"]).collect()))


def test_vector_selection(spark):
    v = "AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"
    words = ", ".join(f"{w}:string" for w in feeds.WORDS.values())
    entry = f"array<struct<source:string,cvssData:struct<version:string,vectorString:string,{words}>>>"
    e = lambda s="nvd", t=f"CVSS:3.1/{v}", ver="3.1", av=None: (s, (ver, t, av, *[None] * 7))
    rows = [
        (([e()], [e(t=f"CVSS:3.0/{v}", ver="3.0")], None, None), ("ok", "3.1", v, True)), (([e(s="cna")], [e(t=f"CVSS:3.0/{v}", ver="3.0")], None, None), ("ok", "3.0", v, False)),
        (([e(s="cna")], None, None, None), ("cna_only_v3",)), ((None, [], [e()], [e()]), ("v2_only",)), ((None, None, None, [e()]), ("v4_only",)), ((None, None, None, None), ("no_cvss",)),
        (([e(), e(t=f"CVSS:3.1/{v[:-1]}L")], None, None, None), ("conflicting_nvd_vectors",)), (([e(t="CVSS:3.1/AV:N")], None, None, None), ("invalid_vector",)),
        (([e(t=f"CVSS:3.0/{v}")], None, None, None), ("version_mismatch",)), (([e(ver="3.0")], None, None, None), ("version_mismatch",)), (([e(av="LOCAL")], None, None, None), ("decomposed_mismatch",)),
    ]
    df = spark.createDataFrame([(i, m) for i, (m, _) in enumerate(rows)], f"i int, m struct<cvssMetricV31:{entry},cvssMetricV30:{entry},cvssMetricV2:{entry},cvssMetricV40:{entry}>")
    got = [tuple(r.s) for r in df.select("i", feeds.select_vector(F.col("m"), "nvd").alias("s")).orderBy("i").collect()]
    assert got == [w if len(w) > 1 else (w[0], None, None, None) for _, w in rows]


def test_resumed_results_come_once(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("ts", T.TimestampType())])
    (tmp_path / "in").mkdir()
    for i, ids in enumerate((["a", "b", "a"], ["b", "c"])):
        (tmp_path / "in" / f"{i}.json").write_text("".join(json.dumps({"id": x, "ts": "2024-01-01T00:00:00"}) + "\n" for x in ids))
    R.resumed(R.arriving(spark, str(tmp_path / "in"), schema, 1), "id", "ts", "1 hour").writeStream.format("memory").queryName("resumed").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.id for r in spark.table("resumed").collect()) == ["a", "b", "c"]


def test_manifests_and_layouts(spark):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    m = jsonl.manifest_of({"t": df}, {"x": "1"})
    assert m == jsonl.manifest_of({"t": df.repartition(2)}, {"x": "1"}) and m["tables"]["t"]["rows"] == 1
    hashes = {n: t["sha256"] for n, t in m["tables"].items()}
    assert jsonl.checked_table(df, hashes, "t", {}).count() == 1
    for bad in ({}, hashes | {"up": "0"}):
        with pytest.raises(ValueError):
            jsonl.checked_table(df, bad, "t", {"up": df})
    assert jsonl.layout("/x/")["facts"] == "/x/facts" and jsonl.layout("/x", dry=True)["facts"] == "/x/dry/facts"


def test_pairs_over_many_splits(spark, tmp_path):
    """Lines are numbered over the whole file, however it is split; blank lines are skipped."""
    rows = [{"commit": f"c{i // 2}", "target": 1 - i % 2} for i in range(400)]
    (tmp_path / "a.jsonl").write_text("".join(("\n" if i % 7 == 0 else "") + json.dumps(r) + "\n" for i, r in enumerate(rows)))
    lines = [k + 1 for k, x in enumerate((tmp_path / "a.jsonl").read_text().split("\n")) if x]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = jsonl.read_pairs(spark, str(tmp_path / "a.jsonl"), PAIR, F.col("first.commit")).orderBy("pair").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r.first_line, r.second_line, r.first.commit, r.first.target, r.second.target) for r in got] == [(lines[2 * i], lines[2 * i + 1], f"c{i}", 1, 0) for i in range(200)]
