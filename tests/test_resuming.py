"""Files that grow, streams that stop and go on, and files whose bytes depend on their lines alone."""

import gzip
import hashlib
import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loamline.operators import training
from loamline.sources import ordered
from loamline.streaming import replace, resume

SHA = "abc"


def line(i, kind="succeeded", sha=SHA, **more):
    return json.dumps({"custom_id": i, "result_type": kind, "requests_sha256": sha} | more).encode()


def reader(folder, size=7):
    return resume.AppendedReader({"path": str(folder), "requestssha256": SHA, "rangebytes": str(size)})


def test_resumed_at_every_byte(tmp_path):
    """However a file grows, and wherever a reader is killed, each whole line comes once; a torn tail waits; broken lines are none."""
    data = b"\n".join([line("a"), b"", line("b", "errored"), b'{"custom_id": "torn', line("c", note="é" * 9), b"[1]", line("a")]) + b"\n"
    want = [(x["custom_id"], x["result_type"]) for x in (json.loads(y) for y in data.split(b"\n") if y.startswith(b"{") and y.endswith(b"}"))]
    path = tmp_path / "r.jsonl"
    for cut in range(len(data) + 1):
        got, start = [], {}
        for part in (data[:cut], data[:cut], data):  # nothing new the second time; then the rest
            path.write_bytes(part)
            r = reader(tmp_path, 1 + cut % 40)
            end = r.latestOffset()
            assert all(part[:n].endswith(b"\n") for n in end.values())
            got += [row[:2] for p in r.partitions(start, end) for row in r.read(p)]
            start = json.loads(json.dumps(end))
        assert got == want, cut


def test_ranges_meet_at_any_byte(tmp_path):
    data = b"".join(line(f"i{i}", note="x" * (i * 13 % 50)) + b"\n" for i in range(20))
    (tmp_path / "r.jsonl").write_bytes(data)
    for size in range(1, len(data) + 2, 37):
        r = reader(tmp_path, size)
        rows = [row for p in r.partitions({}, r.latestOffset()) for row in r.read(p)]
        assert [x[0] for x in rows] == [f"i{i}" for i in range(20)] and all(data[x[3] :].startswith(x[4].encode()) for x in rows)


def test_results_of_other_requests_are_refused(spark, tmp_path):
    (tmp_path / "r.jsonl").write_bytes(line("a") + b"\n" + line("b", sha="other") + b"\n")
    with pytest.raises(ValueError, match="different requests"):
        r = reader(tmp_path)
        [row for p in r.partitions({}, r.latestOffset()) for row in r.read(p)]
    with pytest.raises(Exception, match="different requests"):
        resume.collected(resume.appended(spark, str(tmp_path), SHA), str(tmp_path / "out"), str(tmp_path / "check"))


def test_a_run_that_stops_and_goes_on(spark, tmp_path):
    """Two runners append; the stream is stopped in the middle of a line; the final file is written when, and only when, each request has a success."""
    top, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    top.mkdir()
    asked = spark.createDataFrame([(f"q{i:02d}",) for i in range(8)], "custom_id string")
    take = lambda: resume.collected(resume.appended(spark, str(top), SHA, 50), out, check)
    (top / "x.jsonl").write_bytes(line("q01") + b"\n" + line("q00", "errored") + b"\n" + line("q02")[:20])
    take()
    assert {r.custom_id for r in resume.succeeded(spark, out).collect()} == {"q01"}
    assert sorted(r.custom_id for r in resume.remaining(asked, resume.succeeded(spark, out)).collect()) == ["q00", *(f"q{i:02d}" for i in range(2, 8))]
    assert not resume.finished(spark, asked, out, str(tmp_path / "final"))
    with open(top / "x.jsonl", "ab") as f:
        f.write(line("q02")[20:] + b"\n" + b"".join(line(f"q{i:02d}", text="aé") + b"\n" for i in (7, 0, 3)))
    (top / "y.jsonl").write_bytes(b"".join(line(f"q{i:02d}") + b"\n" for i in (6, 5, 4, 3)))
    take()
    take()  # nothing new
    assert spark.read.parquet(out).count() == 2 + 4 + 4
    final = str(tmp_path / "final")
    assert resume.finished(spark, asked, out, final)
    lines = gzip.decompress(b"".join(p.read_bytes() for p in sorted((tmp_path / "final").glob("*.gz")))).decode().splitlines()
    assert [json.loads(x)["custom_id"] for x in lines] == [f"q{i:02d}" for i in range(8)]
    with pytest.raises(ValueError):
        resume.finished(spark, asked.union(asked.limit(1)), out, final)


def test_replacements_of_batches_are_those_of_one(spark, tmp_path):
    """Three micro-batches, the last after a restart; kinds without a queue, queues with repeated items, queues of one."""
    rows = [(i, "abcd"[i * 7 % 4 if i % 5 else 3]) for i in range(60)]
    queue = [("a", f"x{i % 4}", i) for i in range(9)] + [("b", "only", 0)] + [("d", "z", 2), ("d", "y", 1), ("e", "unused", 0)]
    asked, line_ = spark.createDataFrame(rows, "pos long, kind string"), spark.createDataFrame(queue, "kind string, item string, o int")
    want = {tuple(r) for r in training.replacements(asked, "kind", "pos", line_, "item", "o").select("pos", "kind", "item", F.col("used").cast("long")).collect()}
    folder, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")

    def go():
        stream = spark.readStream.schema("pos long, kind string").option("maxFilesPerTrigger", 1).parquet(folder)
        replace.replaced(stream, "kind", "pos", line_, "item", "o").writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()

    for lo, hi in ((0, 20), (20, 37)):
        asked.where(f"pos >= {lo} AND pos < {hi}").coalesce(1).write.mode("append").parquet(folder)
    go()
    asked.where("pos >= 37").coalesce(1).write.mode("append").parquet(folder)
    go()
    got = spark.read.parquet(out).select("pos", "kind", "item", "used").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_bytes_depend_on_lines_alone(spark, tmp_path):
    rows = [(i % 7, f"line {i}" if i % 11 else None) for i in range(1000)] + [(3, "same"), (3, "same"), (None, "no key")]
    df, hashes = spark.createDataFrame(rows, "k int, line string"), []
    for n, parts in enumerate((1, 3, 16)):
        path = str(tmp_path / str(n))
        ordered.write_lines(df.repartition(parts), "line", ["k"], path, 100)
        hashes.append(sorted(map(tuple, ordered.file_hashes(spark, path).collect())))
        files = sorted((tmp_path / str(n)).glob("*"))
        assert [f.name for f in files] == [f"part-{i:06d}.jsonl.gz" for i in range(10)]
        text = "".join(gzip.decompress(f.read_bytes()).decode() for f in files).splitlines()
        assert text == [x for _, x in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))]
        assert all(f.read_bytes()[:10] == b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff" or f.read_bytes()[4:8] == bytes(4) for f in files)
    assert hashes[0] == hashes[1] == hashes[2]
    assert [h for _, h, _ in hashes[0]] == [hashlib.sha256(f.read_bytes()).hexdigest() for f in files]
    assert Counter(spark.read.text(path).toPandas().value) == Counter(x for _, x in rows if x)
    with pytest.raises(Exception, match="line break"):
        ordered.write_lines(spark.createDataFrame([(1, "a\nb")], "k int, line string"), "line", ["k"], str(tmp_path / "bad"))
    ordered.write_lines(df.where("false"), "line", ["k"], str(tmp_path / "none"))
    assert not list((tmp_path / "none").glob("*"))


def test_arrays_of_any_pieces(spark, tmp_path):
    """Fields before, between and after the array, nested brackets and quotes in strings, numbers that a piece cuts, text of several bytes; in gzip and not."""
    from loamline.sources import arrays

    rows = [{"cve": {"id": f"é🙂\\\"]{i}", "n": [1.5e10, -2, {"a": []}]}} if i % 3 else i * 1234567 for i in range(40)] + ["x" * 3000, None, True, 12]
    doc = {"timestamp": "t", "other": {"vulnerabilities": [1]}, "vulnerabilities": rows, "after": 12.5}
    raw = json.dumps(doc, ensure_ascii=False, indent=1).encode()
    (tmp_path / "a.json").write_bytes(raw)
    (tmp_path / "b.json.gz").write_bytes(gzip.compress(raw))
    sha = hashlib.sha256(raw).hexdigest()
    for size in (1, 2, 3, 7, 100, 1 << 20):
        for name in ("a.json", "b.json.gz"):
            out = list(arrays.ArrayReader({"array": "vulnerabilities", "piecebytes": str(size)}).read(arrays.File(str(tmp_path / name), sha)))
            assert [json.loads(v) for _, nth, v, _ in out if nth is not None] == rows and json.loads(out[-1][2]) == {k: v for k, v in doc.items() if k != "vulnerabilities"} and out[-1][3] == len(rows)
    for bad in (raw[:-3], raw + b"x", raw.replace(b'"after": 12.5', b'"after" 1'), raw.replace(b"12\n ],", b"12 1\n ],")):
        (tmp_path / "bad.json").write_bytes(bad)
        with pytest.raises(ValueError):
            list(arrays.ArrayReader({"array": "vulnerabilities"}).read(arrays.File(str(tmp_path / "bad.json"), "")))
    files = [(str(tmp_path / "a.json"), sha), (str(tmp_path / "b.json.gz"), sha)]
    got = arrays.read_arrays(spark, files, "vulnerabilities", 50)
    assert got.where("nth IS NOT NULL").count() == 2 * len(rows) and {r.n for r in got.where("nth IS NULL").collect()} == {len(rows)}
    with pytest.raises(Exception, match="checksum"):
        arrays.read_arrays(spark, [(files[0][0], "0" * 64)], "vulnerabilities").count()
