"""Operators on small tables, against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loamline.llm import decontamination, embeddings, language, mixing, pii, quality, sharding, signatures, urlfilter, warc
from loamline.llm.components import components
from loamline.llm.words import ALNUM, SPACED, words


def text_of(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def root_of(links, ids):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_words_are_those_of_the_patterns():
    rng = random.Random(1)
    texts = [None, "", " \t", "é", "A\x00b c\x0bd", *["".join(rng.choice("aZé9 \t\n\x0c\x1c.-_ß\u2003\x7f") for _ in range(rng.randrange(30))) for _ in range(500)], "x" * 3_000_000, "y z"]
    for table, pattern in ((SPACED, r"[^\x20\x09-\x0D]+"), (ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        seen, by_word = 0, {}
        for w in words(pa.array(texts), table):
            for d in range(w.n):
                t = re.sub("[A-Z]", lambda m: m[0].lower(), texts[w.first + d] or "")
                mine = w.hashes[w.at[d] : w.at[d + 1]].tolist()
                want = re.findall(pattern, t)
                assert len(mine) == len(want)
                for h, x in zip(mine, want, strict=True):
                    assert by_word.setdefault(x, h) == h
                seen += 1
        assert seen == len(texts) and len(set(by_word.values())) == len(by_word)


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, 5000 + i) for i in range(1, 80)]
    want = root_of(links, {x for p in links for x in p})
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {k: v for k, v in want.items() if any(k in p and p[0] != p[1] for p in links)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/", "x"), (2, "http://b/", "x"), (3, None, None), (4, "u", ""), (5, "u\r\nv", "é\r\n\r\nWARC/1.1 ü"), (None, "n", "x"), (6, "big", "z" * 700_000), (2, "http://b/", "x"), (7, "q", "once")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.coalesce("html", F.lit("")).cast("binary"))
    index = warc.write_warc(pages, frame_bytes=200, bundle_bytes=2000)
    got = warc.read_warc(index, frames_per_task=2).collect()
    by = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got)
    digest = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    want = Counter()
    for i, _, h in rows:
        same = [j for j, _, g in rows if (g or "") == (h or "")]
        top = max((j for j in same if j is not None), default=None)
        want[i, len((h or "").encode()), digest(h or ""), "response" if i == top and not want[i, len((h or "").encode()), digest(h or ""), "response", None] else "revisit", None if i == top and not want[i, len((h or "").encode()), digest(h or ""), "response", None] else top] += 1
    assert by == want
    for r in index.collect():
        head, body = warc.read_record(r.bundle, r.frame_at, r.frame_bytes, r.at)
        assert head["WARC-Record-ID"] == r.record_id and head["X-Page-Id"] == ("" if r.page_id is None else str(r.page_id))
    assert len({r.record_id for r in index.collect()}) == len(rows)
    assert warc.read_warc(warc.write_warc(pages.where("false"))).count() == 0


def test_frames_open_with_any_zstd_reader(spark):
    import zstandard

    pages = spark.createDataFrame([(i, "u", f"page {i} " * 50) for i in range(40)], "page_id long, url string, html string").withColumn("payload", F.col("html").cast("binary")).coalesce(1)
    index = warc.write_warc(pages, frame_bytes=1000)
    uri = index.first().bundle
    fs, path = warc.filesystem(uri)
    with fs.open_input_file(path) as f:
        frames = warc.seek_table(f, f.size())
        raw = f.read_at(f.size(), 0)
    assert len(frames) > 3
    whole = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    assert whole.count(b"WARC/1.1\r\n") == index.where(F.col("bundle") == uri).count() and sum(f[2] for f in frames) == len(whole)


# 2


def brute_embeddings(rows, cosine=0.93):
    good = {i: (np.array(v, float), label) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = sorted(good)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0]) and good[a][0] @ good[b][0] / np.linalg.norm(good[a][0]) / np.linalg.norm(good[b][0]) >= cosine]
    n = Counter(x for p in links for x in p)
    root = root_of(links, [r[0] for r in rows if r[0] is not None])
    return {i: (n[i], root[i], root[i] == i) for i in root}


@pytest.mark.parametrize("leaf", [2000, 40])
def test_embeddings_against_brute_force(spark, leaf):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 16))
    rows = [(i, (base[i % 30] + rng.normal(size=16) * 0.12).tolist(), int(i % 3)) for i in range(300)]
    rows += [(1000 + i, rows[0][1], 0) for i in range(20)] + [(2000, None, 0), (2001, [0.0] * 16, 0), (2002, [float("nan")] * 16, 0), (2003, [float("inf")] + [1.0] * 15, 0), (2004, [None] * 16, 0), (2005, rows[0][1], None), (2006, [], 0), (2007, [1.0, 2.0], 0), (2008, [2.0, 4.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df, leaf=leaf).collect()}
    want = brute_embeddings(rows)
    assert got.keys() == want.keys()
    if leaf == 2000:
        assert got == want
    else:
        assert sum(g[0] for g in got.values()) >= 0.97 * sum(w[0] for w in want.values()) and all(got[i][0] <= want[i][0] for i in got)


def test_embeddings_without_rows_and_with_null_ids(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0], 1), (5, [1.0, 2.0], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted((r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df.where("vec_id is not null")).collect()) == [(0, 5, True)]
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()} == {(None, 0, None, True), (5, 0, 5, True)}
    assert embeddings.near_duplicates(df.where("false")).count() == 0


# 3 and 10


def test_language(spark):
    rng = random.Random(4)
    sound = {"aa": "ka mo ti ru".split(), "bb": "schwe unge zit orf".split(), "cc": "ção lhe não éra".split()}
    rows = [(i, " ".join("".join(rng.choices(sound[k], k=rng.randrange(1, 4))) for _ in range(rng.randrange(5, 200))), k) for i in range(240) for k in [rng.choice(list(sound))]]
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 34!", "aa"), (1003, "kamo tiru moka kati rumo " * 30_000, None), (None, "schweunge zitorf ungezit", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id: (r.lang_pred, r.score) for r in language.predicted(df, language.fit_language(df, F.expr("doc_id % 4 <> 2")), ["doc_id"]).collect()}
    assert [out[i] for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3 and out[1003][0] == "aa" and out[None][0] == "bb"
    held = [(out[i][0], k) for i, _, k in rows if i is not None and i < 1000 and i % 4 == 2]
    assert np.mean([a == b for a, b in held]) > 0.95 and all(0 <= s <= 1 for _, s in out.values())
    empty = df.where("false")
    assert language.predicted(empty, language.fit_language(empty, F.lit(True)), ["doc_id"]).count() == 0


def test_language_learns_every_value(spark):
    rows = [(i, f"text {chr(97 + i % 26)}{chr(97 + i // 26)}", f"l{i:03}") for i in range(300)]
    net = language.fit_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert list(net.names) == [f"l{i:03}" for i in range(300)]


def test_quality(spark):
    rng = random.Random(5)
    rows = [(i, text_of(rng, 80) if i % 2 else text_of(rng, 80).upper() + "!!! ###") for i in range(400)] + [(1000, None), (1001, ""), (1002, text_of(rng, 60_000)), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(7, 1), (None, 1), (8, None)], "doc_id long, quality int")
    trees = quality.fit_quality(docs, labels, F.expr("doc_id % 3 <> 1"))
    out = {r.doc_id: r.score for r in quality.scored(docs, trees).collect()}
    assert np.mean([(out[i] >= 0.5) == (i % 2 == 1) for i in range(300, 400)]) > 0.97 and len(out) == len(rows) and all(0 <= s <= 1 for s in out.values())
    assert quality.scored(docs, trees, least=0.5).columns == docs.columns
    none = quality.fit_quality(docs, labels.where("false"), F.lit(True))
    assert {r.score for r in quality.scored(docs, none).collect()} == {0.5}
    assert quality.scored(docs.where("false"), none).count() == 0


# 4


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Water filling in rounds."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        unit = left / sum(w[s] for s in open_)
        over = {s for s in open_ if unit * w[s] > most * sizes[s]}
        if not over:
            return out | {s: unit * w[s] for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def test_mixing(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["a", "b", "c", "Z", None]), text_of(rng, rng.randrange(40)) if rng.random() > 0.05 else None) for i in range(500)] + [(1, "a", "same row")] * 3 + [(9000, "only empty", "")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    sized = df.withColumn("size", mixing.n_words(F.col("text")))
    out = mixing.mix(sized, F.col("source"), F.col("size"), F.col("doc_id").cast("string"))
    got = out.collect()
    sizes = Counter()
    for _, s, t in rows:
        sizes[s] += len((t or "").split())
    want, taken = targets(sizes), Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r.size
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes) and len(got) == len(rows)
    again = mixing.mix(sized.repartition(7), F.col("source"), F.col("size"), F.col("doc_id").cast("string"))
    assert sorted((str(r.doc_id), r.size, r.taken) for r in got) == sorted((str(r.doc_id), r.size, r.taken) for r in again.collect())
    texts = mixing.mixed_rows(out, df.columns).collect()
    mixed = Counter((r.doc_id, r.source, r.text) for r in texts)
    assert mixed == Counter(k for r in got for k in [(r.doc_id, r.source, r.text)] * (int(r.taken / r.size + 0.5) if r.size else int(round(r.target) // r.source_size) if r.source_size else 0))
    words_ = Counter()
    for r in texts:
        words_[r.source] += len((r.text or "").split())
    assert all(abs(words_[s] - taken[s]) <= max((len((t or "").split()) for _, q, t in rows if q == s), default=0) / 2 for s in sizes)
    assert mixing.mix(sized.where("false"), F.col("source"), F.col("size"), F.lit("")).count() == 0


def test_mixing_keeps_texts_without_words(spark):
    rows = [(1, "a", "x " * 10), (2, "a", ""), (3, "a", None), (4, "b", "y " * 1000), (5, "b", " "), (6, "none", "")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", mixing.n_words(F.col("text")))
    out = mixing.mix(df, F.col("source"), F.col("size"), F.col("doc_id").cast("string"))
    epochs = {r.source: round(r.target) // r.source_size if r.source_size else 0 for r in out.collect()}
    got = Counter(r.doc_id for r in mixing.mixed_rows(out, ["doc_id", "source", "text"]).collect())
    assert epochs["a"] == 2 and [got[i] for i in (2, 3)] == [2, 2] and got[5] == epochs["b"] and got[6] == 0


# 5


def shingles(t, k=4):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_jaccard(rows, share=85):
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b])]
    return sets, root_of(links, sets)


def copies(rng, n):
    bases = [text_of(rng, rng.choice([6, 30, 80, 150, 300]), 3000).split() for _ in range(12)]
    common = text_of(rng, 50).split()
    rows = []
    for i in range(n):
        t = list(rng.choice(bases))
        if rng.random() < 0.3:
            t[5:5] = common
        for _ in range(rng.randrange(4)):
            t[rng.randrange(len(t))] = f"edit{rng.randrange(9)}"
        rows.append((i, " ".join(t)))
    return rows


@pytest.mark.parametrize("block", [8192, 16])
def test_jaccard_against_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(signatures, "BLOCK", block)
    rng = random.Random(7)
    rows = copies(rng, 250) + [(1000, None), (1001, ""), (1002, " "), (1003, "One two"), (1004, "one TWO"), (1005, "One two three"), (1006, "É É É É É"), (1007, "é é é é é"), (1008, text_of(rng, 20_000, 10**6))]
    sets, want = brute_jaccard(rows)
    got = {r.doc_id: r for r in signatures.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert {i: r.component_id for i, r in got.items()} == want and {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}


def test_jaccard_exactly_at_the_threshold(spark):
    w = [f"x{i}" for i in range(200)]
    rows = [(i, " ".join(w[:n])) for i, n in enumerate([103, 88, 87, 102, 199])]  # 100, 85, 84, 99 and 196 shingles
    _, want = brute_jaccard(rows)
    got = {r.doc_id: r.component_id for r in signatures.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and want[1] == 0 and got[4] == 4


def test_jaccard_edge_tables(spark):
    df = spark.createDataFrame([(3, "a b c d e"), (3, "a b c d e"), (None, "a b c d e"), (None, "q r s t u"), (8, "a b c d e f")], "doc_id long, text string")
    assert sorted((str(r.doc_id), str(r.component_id)) for r in signatures.jaccard_classes(df).collect()) == [("3", "3"), ("3", "3"), ("8", "8"), ("None", "3"), ("None", "None")]
    assert signatures.jaccard_classes(df.where("false")).count() == 0


def test_pipeline_joins_five_words_at_four_fifths(spark):
    import corpus_pipeline

    rng = random.Random(11)
    w = [f"y{i}" for i in range(140)]
    rows = copies(rng, 150) + [(1000, " ".join(w[:100])), (1001, " ".join(w[:122])), (1002, " ".join(f"z{i}" for i in range(100))), (1003, " ".join("new" if i in (30, 70) else f"z{i}" for i in range(100))), (1004, None), (1005, " ")]
    sets = {i: shingles(t, 5) for i, t in rows}
    want = root_of([(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])], sets)
    assert want[1001] == 1000 and want[1003] == 1002 and [brute_jaccard(rows)[1][i] for i in (1001, 1003)] == [1001, 1003]
    kept = corpus_pipeline.jaccard_stage(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(5), "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(i for i, root in want.items() if i == root)


def test_jaccard_prefix_always_meets():
    rng = np.random.default_rng(12)
    common = np.sort(rng.integers(1, 2**63, 60, dtype=np.uint64))
    order = (common, rng.integers(1, 5, 60).astype(np.uint8))
    for share in (80, 85):
        for _ in range(300):
            n = int(rng.integers(1, 400))
            a = rng.integers(1, 2**63, n, dtype=np.uint64)
            a[: n // 3] = rng.choice(common, n // 3)
            a = np.unique(a)
            lost = int(rng.integers(0, len(a) * (100 - share) // 100 + 1))
            b = np.unique(np.concatenate([rng.permutation(a)[lost:], rng.integers(1, 2**63, int(rng.integers(0, 9)), dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= share * (len(a) + len(b) - both):
                assert len(np.intersect1d(signatures.keys_of(a, share, order), signatures.keys_of(b, share, order)))
    assert (signatures.prefix(100, 85), signatures.prefix(100, 80), signatures.prefix(1, 85)) == (16, 21, 1)


def test_jaccard_of_long_texts_at_the_threshold(spark):
    w = [f"x{i}" for i in range(30_003)]
    rows = [(i, " ".join([*w[:n], *(f"tail{i}-{j}" for j in range(extra))])) for i, (n, extra) in enumerate([(30_003, 0), (25_503, 0), (25_502, 0), (27_753, 0)])]
    rows += [(10 + i, " ".join(f"{'new' if j < 2250 else 'y'}{i if j < 2250 else ''}-{j}" for j in range(30_003))) for i in range(2)]
    _, want = brute_jaccard(rows)
    got = {r.doc_id: r.component_id for r in signatures.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and want[1] == 0


def group_table(sets, whole):
    """A list (bitmaps) or a family (sets) as the tree tasks see it."""
    n = len(sets)
    c = max(signatures.size_class(len(s)) for s in sets)
    g = pa.array(np.arange(n))
    data = [s.astype("<u8").tobytes() if whole else signatures.bitmap(s) for s in sets]
    zero = pa.array(np.zeros(n, np.int64))
    t = pa.table({"c": pa.array(np.full(n, c, np.int32)), "a": zero, "b": zero, "i": zero.cast(pa.int32()), "j": zero.cast(pa.int32()), "side": zero.cast(pa.int32()), "g": g, "n": pa.array([len(s) for s in sets], pa.int64()), "comp": g, "guest": pa.array(np.zeros(n, bool)), "data": pa.array(data, pa.binary())})
    return t.to_batches(max_chunksize=1000)


def test_jaccard_memory_of_a_block_of_templates():
    import subprocess
    import sys

    code = """
import resource, sys
import numpy as np
sys.path[:0] = {paths!r}
import test_llm_operators as T
from loamline.llm import signatures
rng = np.random.default_rng(1)
base = rng.integers(0, 2**63, 100, dtype=np.uint64)
sets = [np.unique(np.concatenate([base[:75], rng.integers(0, 2**63, 25, dtype=np.uint64)])) for _ in range(8192)]
tables = T.group_table(sets, {whole})
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
out = sum(b.num_rows for b in signatures.together(85, {whole})(tables))
print(out, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    import os

    here = os.path.dirname(os.path.abspath(__file__))
    for whole in (False, True):
        out = subprocess.run([sys.executable, "-c", code.format(paths=[here, os.path.dirname(os.path.dirname(here))], whole=whole)], capture_output=True, text=True, timeout=600)
        linked, mb = map(int, out.stdout.split())
        assert linked == 0 and mb < 250


@pytest.mark.parametrize("whole", [False, True])
def test_trees_join_small_and_large_groups(whole):
    rng = np.random.default_rng(2)
    for size in (2, 9, 300):
        base = rng.integers(0, 2**63, 56, dtype=np.uint64)
        sets = [np.unique(np.concatenate([rng.permutation(base)[: rng.integers(48, 56)], rng.integers(0, 2**63, int(rng.integers(0, 8)), dtype=np.uint64)])) for _ in range(size)]
        links = [(a, b) for a in range(size) for b in range(a) if 100 * (x := len(np.intersect1d(sets[a], sets[b]))) >= 85 * (len(sets[a]) + len(sets[b]) - x)]
        found = [(r["x"], r["y"]) for b in signatures.together(85, whole)(group_table(sets, whole)) for r in b.to_pylist()]
        want, got = root_of(links, range(size)), root_of(found, range(size))
        if whole:
            assert got == want
        else:  # bitmaps may join more, never less
            assert all(got[a] == got[b] for a, b in links)


# 6


def brute_hits(docs, items, window=10):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    split = lambda t: re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = {}
    for i, t in docs:
        w, hit, names = split(t), set(), set()
        for name, x in items:
            v = split(x)
            n = min(window, len(v))
            for a in range(len(v) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[a : a + n]:
                        hit |= set(range(p, p + n))
                        names.add(str(name))
        out[i] = (len(w), len(hit), sorted(names))
    return out


@pytest.mark.parametrize("pass_bytes", [1 << 20, 900])
def test_decontamination_against_brute_force(spark, pass_bytes):
    rng = random.Random(8)
    items = [(i, text_of(rng, rng.choice([0, 1, 3, 9, 10, 11, 40]), 30)) for i in range(25)] + [(90, None), (91, "Ünïcode passage of exactly these ten plain words or so"), (92, "w1 w2")]
    docs = []
    for i in range(60):
        t = text_of(rng, 60, 30).split()
        if i % 3 == 0:
            x = (rng.choice(items)[1] or "").split()
            t[20:20] = x[: rng.randrange(1, len(x) + 2)]
        docs.append((i, rng.choice([" ", ", ", "\n", "--"]).join(t).upper() if i % 2 else " ".join(t)))
    docs += [(100, None), (101, ""), (102, "w1, W2!"), (103, "ünïcode PASSAGE of exactly these ten plain words"), (104, (text_of(rng, 50_000, 10**6) + " ") + items[-2][1])]
    df, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in decontamination.contamination(df, b, ["doc_id"], pass_bytes=pass_bytes).collect()}
    want = brute_hits(docs, items)
    assert got == want and any(v[1] for v in want.values())
    kept = {r.doc_id for r in decontamination.clean(df, b, pass_bytes=pass_bytes).collect()}
    assert kept == {i for i, v in want.items() if not v[1]}
    assert decontamination.contamination(df, b.where("false"), ["doc_id"]).where("n_hit > 0").count() == 0
    assert decontamination.contamination(df.where("false"), b, ["doc_id"]).count() == 0


# 7


def test_matrix_margins():
    m = sharding.communication_matrix(np.array([5, 0, 70, 25]), np.array([34, 33, 33]), 1)
    assert m.sum(1).tolist() == [5, 0, 70, 25] and m.sum(0).tolist() == [34, 33, 33] and (m >= 0).all()


@pytest.mark.parametrize(("n", "block"), [(0, 10), (5, 10), (803, 10), (803, 10**6)])
def test_sharding(spark, n, block):
    df = spark.range(n).select(F.when(F.col("id") % 50 != 0, F.col("id")).alias("doc_id"), F.lit("t").alias("text"), F.lit(1).alias("shard_")).repartition(7)
    got = sharding.hypergeometric_shards(df, 8, F.struct("doc_id", "text"), block_rows=block).collect()
    by = {s: sorted(r.slot for r in got if r.shard == s) for s in range(8)}
    assert all(v == list(range(len(v))) for v in by.values()) and sum(map(len, by.values())) == n
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in df.collect())


def test_shuffle_mixes_partitions(spark):
    df = spark.range(4000).repartitionByRange(4, "id")
    got = sharding.hypergeometric_shards(df, 4, F.struct("id")).collect()
    counts = Counter((r.shard, r.id // 1000) for r in got)
    assert all(200 < c < 300 for c in counts.values())
    order = [r.id for r in sorted(got, key=lambda r: (r.shard, r.slot)) if r.shard == 0]
    assert abs(np.corrcoef(order, range(len(order)))[0, 1]) < 0.12


def test_partitions_of_a_group_are_mixed(spark, monkeypatch):
    monkeypatch.setattr(sharding, "GROUPS", 2)
    df = spark.range(7000).repartitionByRange(7, "id")
    got = sharding.hypergeometric_shards(df, 4, F.struct("id"), block_rows=300).collect()
    counts = Counter((r.shard, r.id // 1000) for r in got)
    assert len(counts) == 28 and all(190 < c < 310 for c in counts.values()) and sorted(r.id for r in got) == list(range(7000))
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(1750)) for s in range(4))


# 8


def plain_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 14 <= len(d) <= 19 and (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return [(a, b, pii.KINDS[k]) for a, k, b in sorted(out)]


def test_base_spans_against_the_patterns():
    rng = random.Random(9)
    for _ in range(20_000):
        t = "".join(rng.choice("aé@@..--+ ()0123459") for _ in range(rng.randrange(60)))
        assert pii.base_spans(t) == plain_spans(t)
    for t in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" + "." * 100_000, "a@" * 50_000):
        pii.base_spans(t)


def test_contexts_find_more(spark):
    rows = [(i, f"Wörd{i} contact phone: +1 (743) 555-{1000 + i} bye") for i in range(30)] + [(100 + i, f"hellö{i} contact phone: 743 555 {2000 + i} there") for i in range(8)]
    rows += [(200 + i, f"some number of 743555{i:04} here") for i in range(9)] + [(300 + i, f"one of +1 (743) 555-{3000 + i}") for i in range(6)] + [(310 + i, f"number of things {i}") for i in range(20)] + [(400, None), (401, ""), (402, "a@b.co and a@b.co " * 20_000)]
    out = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()}
    assert all([tuple(s) for s in out[100 + i].spans] == [("phone", 22 + 1 - 1, 34)] for i in range(8))
    assert all(not out[200 + i].spans for i in range(9)) and not out[400].spans and not out[401].spans and len(out[402].base) == 40_000
    assert all([tuple(s) for s in r.base] == [(k, a, b) for a, b, k in plain_spans(dict(rows)[i] or "")] for i, r in out.items())
    assert all(set(map(tuple, r.base)) <= set(map(tuple, r.spans)) for r in out.values())
    assert pii.personal_data(spark.createDataFrame([], "doc_id long, text string"), ["doc_id"]).count() == 0


# 9


def test_url_rules(spark):
    urls = ["http://Example.ORG/es/1?x=/en/", "https://a.b.example.org/en/199", "http://notexample.org/es/", "x://org", "x://org/", "no", None, "http://x.com/fr/#q", "http://x.com/de/", "http://x.com?/fr/", "http://x.net/", "a://b://example.org/es/", "x:///es/", "h://example.org/es", "h://.org/", "h://" + "a." * 3000 + "com/fr/" + "z" * 10_000]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string").withColumn("rule", F.lit("clash"))
    got = {r.page_id: r for r in urlfilter.judged(df).collect()}
    for i, u in enumerate(urls):
        host, path = "", ""
        if u and "://" in u:
            m = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1], re.S)
            host, path = re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]
        fits = [(len(h + p), h + p, v) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, best and best[1], best[2] if best else "allow")
    assert urlfilter.judged(df.where("false")).count() == 0


def test_cascade_is_exact_on_its_universe(spark):
    pages = spark.createDataFrame([(i, f"http://h{i}.example.com/p{i}") for i in range(3000)], "page_id int, url string")
    listed = [f"h{i}.example.com/p" for i in range(0, 3000, 7)]
    levels = urlfilter.fit_cascade(pages, listed, (2,))
    universe = sorted({k for i in range(3000) for k in urlfilter.keys_of(f"h{i}.example.com", f"/p{i}", (2,))})
    listed = [k.replace("/p", "/p") for k in listed]
    held = urlfilter.holds(levels, universe)
    assert [k for k, x in zip(universe, held, strict=True) if x] == sorted(set(listed) & set(universe)) and len(levels) > 1


# columns with clashing names, repeated rows, ties


def test_mixing_keeps_columns_of_any_name(spark):
    import corpus_pipeline

    rows = [(i, "ab"[i % 2], "word " * (i % 7 + 1)) for i in range(60)]
    names = ("size", "source_size", "target", "taken", "taken_taken", "mix_key", "copy", "before")
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    plain = corpus_pipeline.mixing_stage(spark, docs, "").collect()
    wide = corpus_pipeline.mixing_stage(spark, docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names}), "").collect()
    assert sorted((r.doc_id, r.text) for r in plain) == sorted((r.doc_id, r.text) for r in wide) and plain
    assert all(r[n] == f"{n}{r.doc_id}" for r in wide for n in names)
    with pytest.raises(ValueError):
        mixing.mix(docs.withColumn("target", F.lit(1)).withColumn("size", F.lit(1)), F.col("source"), F.col("size"), F.lit(""))


def test_mixing_of_equal_rows_at_the_cut(spark):
    docs = spark.createDataFrame([(7, "a", 3)] * 50 + [(8, "b", 1000)], "doc_id long, source string, size long")
    out = mixing.mix(docs, F.col("source"), F.col("size"), F.col("doc_id").cast("string")).collect()
    for s in "ab":
        mine = [r for r in out if r.source == s]
        assert sum(r.taken for r in mine) == round(mine[0].target)
    assert Counter(r.taken for r in out if r.source == "a").keys() <= {0, 1, 2, 3, 4, 5, 6}


def test_mixing_takes_one_very_long_text(spark):
    df = spark.createDataFrame([(1, "a", "w " * 400_000), (2, "b", "x " * 10)], "doc_id long, source string, text string").withColumn("size", mixing.n_words(F.col("text")))
    out = {r.doc_id: (r.size, r.taken, r.target) for r in mixing.mix(df, F.col("source"), F.col("size"), F.col("doc_id").cast("string")).collect()}
    assert out[1][:2] == (400_000, round(out[1][2])) and out[2][:2] == (10, 20)


def test_sharding_keeps_columns_of_any_name(spark):
    names = ("shard", "slot", "part", "one", "two", "place", "cell", "first", "_shard")
    df = spark.range(100).withColumn("text", F.lit("z" * 300_000)).withColumns({n: F.concat(F.lit(n), F.col("id").cast("string")) for n in names})
    got = sharding.hypergeometric_shards(df, 4, F.struct("id")).drop("text").collect()
    assert len(got) == 100 and {r["shard"] for r in got} == {0, 1, 2, 3}
    assert all(r["__shard"] == f"shard{r.id}" and r["_slot"] == f"slot{r.id}" and r["_shard"] == f"_shard{r.id}" and r["cell"] == f"cell{r.id}" for r in got)


def test_quality_keeps_a_score(spark):
    docs = spark.createDataFrame([(1, "some text"), (1, "some text"), (None, None)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    trees = quality.fit_quality(docs, spark.createDataFrame([], "doc_id long, quality int"), F.lit(True))
    got = quality.scored(docs, trees)
    assert got.columns == ["doc_id", "text", "_score", "score"] and {(r["_score"], r["score"]) for r in got.collect()} == {("clash", 0.5)}
    assert quality.scored(docs, trees, least=0.5).columns == docs.columns
    assert quality.scored(docs.where("false"), quality.fit_quality(docs.where("false"), spark.createDataFrame([(1, 1)], "doc_id long, quality int"), F.lit(True))).count() == 0


def test_operators_with_clashing_columns(spark):
    """Extra columns with the operators' own names change nothing."""
    own = ("g", "n", "keys", "bits", "h", "a", "b", "c", "i", "j", "component", "class_id", "rep", "hash", "lang_pred", "score", "items", "n_hit", "n_words", "base", "like", "spans", "_row", "sha1", "bytes", "top", "leaf", "v", "tree", "label_", "_id", "several", "stays")
    add = lambda df: df.withColumns({c: F.lit("clash") for c in own})
    docs = spark.createDataFrame([(i, f"one two three four five six {i % 3} a{i % 3}@b.co", "en") for i in range(30)], "doc_id long, text string, lang string")
    items = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    found = signatures.jaccard_classes(docs)
    pairs = [
        (found, signatures.jaccard_classes(add(docs))),
        (signatures.one_of_each(docs, found), signatures.one_of_each(add(docs), found).select(docs.columns)),
        (decontamination.contamination(docs, items, ["doc_id"]), decontamination.contamination(add(docs), add(items), ["doc_id"])),
        (decontamination.clean(docs, items), decontamination.clean(add(docs), add(items)).select(docs.columns)),
        (pii.personal_data(docs, ["doc_id"]), pii.personal_data(add(docs), ["doc_id"])),
        (language.predicted(docs, language.fit_language(docs, F.lit(True)), ["doc_id"]), language.predicted(add(docs), language.fit_language(add(docs), F.lit(True)), ["doc_id"])),
    ]
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").cast("binary").alias("payload"))
    pairs.append((warc.read_warc(warc.write_warc(pages)).drop("payload"), warc.read_warc(warc.write_warc(add(pages).select("page_id", "url", "payload"))).drop("payload")))
    vectors = docs.select(F.col("doc_id").alias("vec_id"), F.array(F.col("doc_id") % 3 + 1.0, F.lit(1.0)).alias("embedding"), F.lit(1).alias("label"))
    pairs.append((embeddings.near_duplicates(vectors), embeddings.near_duplicates(add(vectors))))
    for plain, wide in pairs:
        assert sorted(map(str, plain.collect())) == sorted(map(str, wide.collect()))


def test_repeated_rows_are_judged_alike(spark):
    """Equal rows get equal results, as often as they come; equal scores are ties that nothing breaks."""
    docs = spark.createDataFrame([(1, "one two three mail a@b.co now", "en"), (2, "eins zwei drei vier", "de")] * 20, "doc_id long, text string, lang string")
    items = spark.createDataFrame([(1, "one two three mail"), (1, "one two three mail")], "item_id long, text string")
    net = language.fit_language(docs, F.lit(True))
    for out, n in ((language.predicted(docs, net, ["doc_id"]), 2), (decontamination.contamination(docs, items, ["doc_id"]), 2), (pii.personal_data(docs, ["doc_id"]), 2), (urlfilter.judged(docs.select(F.col("doc_id").alias("page_id"), F.lit("x://org/").alias("url"))), 2)):
        got = Counter(map(str, out.collect()))
        assert len(got) == n and set(got.values()) == {20}


# brute force


def test_language_forward_pass_and_gradient():
    rng = np.random.default_rng(0)
    windows, labels = rng.integers(0, 256, (6, language.WINDOW)).astype(np.uint16), np.array([0, 1, 0, 1, 0, 1])
    net = language.fit_net(windows, labels, ["a", "b"], epochs=1, batch=6)
    got = net.log_probabilities(windows)

    def plain(net, w):
        padded = list(w) + [language.PAD] * language.WIDE
        z = np.full(net.filters.shape[1], -np.inf)
        for at in range(0, language.WINDOW, language.STEP):
            x = np.concatenate([net.embed[b].astype(float) for b in padded[at : at + language.WIDE]])
            z = np.maximum(z, x @ net.filters.astype(float))
        logits = np.maximum(z + net.bias, 0) @ net.dense.astype(float) + net.prior
        return logits - np.log(np.exp(logits).sum())

    assert np.allclose(got, [plain(net, w) for w in windows], atol=1e-4)
    for k, width in enumerate(language.WIDTHS):
        assert not net.filters[width * language.EMBED :, k * language.FILTERS : (k + 1) * language.FILTERS].any()
    # one step of Adam from the start moves each number against the sign of its gradient, which differences of the loss show
    before = language.fit_net(windows, labels, ["a", "b"], epochs=0)
    loss = lambda net: -np.mean([plain(net, w)[y] for w, y in zip(windows, labels, strict=True)])
    for name in ("dense", "bias", "filters", "embed"):
        a, b = getattr(before, name), getattr(net, name)
        moved = np.argwhere(np.abs(b - a) > 1e-3)
        for at in map(tuple, moved[rng.permutation(len(moved))[:6]]):
            keep = a[at]
            a[at] = keep + 1e-2
            up = loss(before)
            a[at] = keep - 1e-2
            down = loss(before)
            a[at] = keep
            if abs(up - down) > 1e-5:
                assert np.sign(up - down) == -np.sign(b[at] - a[at])


def test_quality_trees_one_by_one():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(500, quality.N_FEATURES)).astype(np.float32), None
    y = (x[:, 3] + 0.5 * x[:, 7] ** 2 > 0.4).astype(float)
    trees = quality.fit_trees(x, y, trees=12, depth=3)
    for row, score in zip(x[:60], trees.score(x[:60]), strict=True):
        total = trees.base
        for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
            at = 0
            while at < len(f):
                at = 2 * at + (2 if row[f[at]] > t[at] else 1)
            total += leaf[at - len(f)]
        assert abs(1 / (1 + np.exp(-total)) - score) < 1e-9
    # the first split is the best of all by brute force over the bins' edges
    g, h = y - 1 / (1 + np.exp(-trees.base)), np.full(500, 1 / (1 + np.exp(-trees.base)) * (1 - 1 / (1 + np.exp(-trees.base))))
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + quality.RIDGE) + g[~m].sum() ** 2 / (h[~m].sum() + quality.RIDGE)
    best = max(gain(x[:, f] <= e) for f in range(quality.N_FEATURES) for e in np.unique(np.quantile(x[:, f], np.arange(1, quality.BINS) / quality.BINS)).astype(np.float32))
    assert np.isclose(gain(x[:, trees.feature[0][0]] <= trees.threshold[0][0]), best)
    assert np.mean((trees.score(x) > 0.5) == y) > 0.9


def test_matrix_follows_the_law():
    """Cells against the hypergeometric chances, with numpy's draws and with those for large populations."""
    from math import comb

    for small in (10**9, 1):
        rng = np.random.default_rng(5)
        draws = np.array([sharding.dealt(rng, np.array([7, 5, 8]), 6, small) for _ in range(6000)])
        assert (draws.sum(1) == 6).all()
        for k in range(7):
            want = comb(7, k) * comb(13, 6 - k) / comb(20, 6)
            assert abs((draws[:, 0] == k).mean() - want) < 5 * np.sqrt(want * (1 - want) / 6000) + 1e-3
    rng = np.random.default_rng(6)
    good, bad, n = 3 * 10**12, 7 * 10**12, 2 * 10**11
    x = np.array([sharding.hypergeometric(rng, good, bad, n) for _ in range(4000)], float)
    sd = np.sqrt(n * 0.3 * 0.7 * (1 - n / (good + bad)))
    assert abs(x.mean() - 0.3 * n) < 5 * sd / np.sqrt(4000) and abs(x.std() / sd - 1) < 0.06
    m = sharding.communication_matrix(np.array([4 * 10**9, 6 * 10**9]), np.array([25 * 10**8] * 4), 3)
    assert m.sum(1).tolist() == [4 * 10**9, 6 * 10**9] and m.sum(0).tolist() == [25 * 10**8] * 4 and (abs(m[0] - 10**9) < 10**6).all()
    for x, n, p in ((3, 10, 0.2), (0, 5, 0.3), (5, 5, 0.3), (40, 100, 0.5)):
        assert np.isclose(sharding.log_binomial(x, n, p), np.log(float(comb(n, x))) + x * np.log(p) + (n - x) * np.log1p(-p))


def plain_scores(edges, rounds=pii.ROUNDS):
    """edges: (pattern, kind, instance, seed) with counts."""
    r = {}
    for _ in range(rounds):
        stat = {}
        for (p, k, i, seed), n in edges.items():
            x = 1.0 if seed else r.get((k, i), 0.0)
            s = stat.setdefault((p, k), [0.0, 0.0, 0, 0, 0])
            s[0] += n * x
            s[1] += n * (1 - x)
            s[2] += n * seed
            s[3] += x >= pii.SURE
            s[4] += n
        base = Counter()
        for (p, _, _, seed), n in edges.items():
            base[p] += n * seed
        scores = {pk: (s[0] / (s[0] + base[pk[0]] - s[2] + 0.1 * s[1]) * s[3] / (s[3] + 1), s[3], s[4]) for pk, s in stat.items() if s[3]}
        miss = {}
        for (p, k, i, seed), _ in edges.items():
            if not seed and (p, k) in scores:
                miss[k, i] = miss.get((k, i), 1.0) * (1 - min(scores[p, k][0], 0.999))
        r = {ki: 1 - m for ki, m in miss.items()}
    return scores


def test_pattern_scores_against_plain_python(spark):
    rng = random.Random(13)
    edges = Counter((rng.randrange(9), rng.choice(["phone", "email"]), f"x{rng.randrange(14)}", int(rng.random() < 0.55)) for _ in range(400))
    rows = [([{"kind": k, "start": 0, "end": 1, "pattern": p, "instance": i}] * n if s else [], [] if s else [{"kind": k, "start": 0, "end": 1, "pattern": p, "instance": i}] * n) for (p, k, i, s), n in edges.items()]
    spans = spark.createDataFrame(rows, f"base {pii.SPAN}, like {pii.SPAN}")
    got = {(r.pattern, r.kind): (r.score, r.seeds, r.n) for r in pii.pattern_scores(spans).collect()}
    want = plain_scores(edges)
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_contexts_are_whole_words(spark):
    long = "x" * 5000
    t = f"{long} phone: +1 (743) 555-1000, {long} tel:+1 (743) 555-2000"
    w = next(iter(words(pa.array([t]), pii._NINES)))
    hashes = pii.pairs(w)
    at = [m.start() for m in re.finditer(r"\+", t)]
    assert pii.contexts(t, [*at, 0, 3], hashes) == [int(hashes[0].astype(np.int64)), int(hashes[4].astype(np.int64)), None, None]
    rows = [(i, f"{long} phone: +1 (743) 555-{1000 + i}") for i in range(30)] + [(100 + i, f"{long} phone: 743 555 {2000 + i}") for i in range(8)]
    out = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).where("doc_id >= 100").collect()
    assert all(len(r.spans) == 1 for r in out)


def test_found_identifiers_induce_patterns(spark):
    """Numbers found in a sure context are seeds of the next round: where else they stand, others of their form are found."""
    rows = [(i, f"say contact phone: +1 (743) 555-{1000 + i} bye") for i in range(30)]
    rows += [(100 + i, f"say contact phone: 743 555 {2000 + i} there") for i in range(12)]
    rows += [(200 + i, f"or just ring up 743 555 {2000 + i} today") for i in range(12)] + [(300 + i, f"or just ring up 743 555 {7000 + i} today") for i in range(5)]
    out = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()}
    assert all(len(out[i].spans) == 1 for i in [*range(100, 112), *range(200, 212), *range(300, 305)])


def test_pipeline_stages_with_nulls_empty_tables_and_extra_columns(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(14)
    rows = [(i, text_of(rng, 60), ["en", None][i % 2], ["a", "b", None][i % 3], 1) for i in range(60)] + [(None, None, None, None, None), (60, None, "en", "a", 0), (61, "", "en", "a", 0), (5, text_of(rng, 60), "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"score": F.lit("s"), "shard": F.lit("t"), "taken": F.lit("u"), "_class": F.lit("v")})
    spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(None, 0, 1), (41, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None), (None, text_of(rng, 12)), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for start in (docs, docs.where("false")):
        now = start
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            now = stage(spark, now, str(tmp_path))
            now = spark.createDataFrame(now.collect(), now.schema)
            if i < 4:
                assert now.columns == docs.columns
        assert now.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "_shard", "taken", "_class", "shard", "slot"]
        assert (now.count() > 0) == (start is docs)
