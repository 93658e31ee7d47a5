"""Distinct strings of blocks, SentencePiece by marked words, importance resampling and the audit of filter orders, against plain Python and the library."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loamline.llm import audit, distinct, pieces, resampling
from loamline.llm.words import ALNUM

ODD = ["", None, " ", "  ", "a", " a ", "a  b", "\n", "a\nb\n\n c\t", "▁", "a▁ b", " ▁▁x", "\x00 y\x00", "<s> </s> <0x0A> <unk>", "日本語 と 英語", "🙂🙂 é", " x y", "x" * 5000, " " * 3000, "word " * 4000, "\r\n \r\n"]


def some_texts(seed, n):
    rng = random.Random(seed)
    alphabet = list("abcdeABC  \n\t.,'▁é日🙂\x00<>#$%&*|0123456789-")
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(120))) for _ in range(n)]


@pytest.mark.parametrize("most", [1, 16, 1 << 20])
def test_numbered_strings_are_the_texts_words(most):
    texts = some_texts(1, 200)
    listed, numbers, at = distinct.numbered(pa.array(texts, pa.string()), distinct.words_of(ALNUM, most))
    names, rows = listed.to_pylist(), np.split(numbers, at[1:-1])
    assert len(names) == len(set(names)) and len(rows) == len(texts)
    for t, r in zip(texts, rows, strict=True):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        assert [names[i] for i in r] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


@pytest.mark.parametrize("most", [3, 1 << 20])
def test_marked_words_put_together_are_the_text(most, monkeypatch):
    monkeypatch.setattr(pieces, "CHUNK_BYTES", most)
    texts = some_texts(2, 200)
    listed, numbers, at = distinct.numbered(pa.array(texts, pa.string()), pieces.marked_words)
    names, rows = listed.to_pylist(), np.split(numbers, at[1:-1])
    for t, r in zip(texts, rows, strict=True):
        own = [names[i] for i in r]
        assert "".join(own) == (" " + t.replace("▁", " ") if t else "") and all(re.fullmatch(" +[^ ]*", x) for x in own)


def test_packed_numbers():
    for most in (0, 255, 256, 65535, 65536, 1 << 31):
        x = np.array([0, most, most // 2])
        assert distinct.unpacked(distinct.packed(x, most)).tolist() == x.tolist()


# 11


@pytest.fixture(scope="module")
def model():
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def test_encoding_and_decoding_are_the_librarys(spark, model):
    """Every kind of text, repeated rows, null ids, and columns of any name."""
    texts = some_texts(3, 300)
    rows = [(None if i % 50 == 7 else i, t, "k", i) for i, t in enumerate(texts)] + [(0, "a  b", "k", -1)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, _block string, string int").repartition(5)
    p = pieces.processor(model)
    out = pieces.decoded(pieces.encoded(docs, model, ["doc_id", "_block", "string", "text"]), model).collect()
    assert Counter((r.doc_id, r.text, r._block, r.string) for r in out) == Counter((a, b, c, d) for a, b, c, d in rows)
    for r in out:
        want = p.encode(r.text or "", add_eos=True)
        assert r.ids == want and r.decoded == p.decode(want), repr(r.text)
    both = pieces.encoded(docs.where("doc_id = 0"), model, [], bos=True, eos=False).collect()
    assert sorted(r.ids for r in both) == sorted(p.encode(t or "", add_bos=True) for i, t, _, _ in rows if i == 0)


def test_encoding_of_empty_tables_and_of_long_texts(spark, model):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pieces.encoded(docs, model, ["doc_id"]).collect() == []
    p, t = pieces.processor(model), "lorem  ipsum dolor\nsit amet " * 300_000
    docs = spark.createDataFrame([(1, t), (2, "z" * 200_000)], "doc_id long, text string")
    got = {r.doc_id: r.ids for r in pieces.encoded(docs, model, ["doc_id"]).collect()}
    assert got[1] == p.encode(t, add_eos=True) and got[2] == p.encode("z" * 200_000, add_eos=True)


def test_decoding_of_any_ids(spark, model):
    """Ids that no text has: broken bytes, control and unknown ids, nothing."""
    p, rng = pieces.processor(model), random.Random(4)
    lists = [[], [0], [1, 2], [2, 28705], [131, 132], [28705, 13, 28705], [0, 1, 28705, 300], [28705, 28705, 28705]] + [[rng.randrange(32000 if rng.random() < 0.5 else 300) for _ in range(rng.randrange(12))] for _ in range(400)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lists)] + [(-1, None)], "i int, ids array<int>")
    for r in pieces.decoded(rows, model).collect():
        assert r.decoded == (p.decode(r.ids) if r.ids else ""), r.ids
    with pytest.raises(ValueError):
        pieces.decoded(rows.withColumn("decoded", F.lit(1)), model)


def test_models_whose_pieces_cross_spaces_are_refused(model):
    from sentencepiece import sentencepiece_model_pb2

    for change in (lambda s: setattr(s.pieces[500], "piece", "a▁b"), lambda s: setattr(s.normalizer_spec, "remove_extra_whitespaces", True), lambda s: setattr(s.trainer_spec, "model_type", 1)):
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(model)
        change(spec)
        with pytest.raises(ValueError):
            pieces.checked(spec.SerializeToString())


def test_the_query_against_the_library(spark, model):
    p, sf = pieces.processor(model), "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = pieces.op11_sentencepiece(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = p.encode(texts[r.doc_id], add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(p.decode(ids)))


# 12


def features_of(text, longest):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(w), [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


@pytest.mark.parametrize("longest,buckets", [(1, 10_000), (3, 64)])
def test_resampling_against_plain_python(spark, longest, buckets):
    rng = random.Random(5)
    body = lambda n: " ".join(rng.choice(["Aa", "b-b", "c9", "É", "dd", "ee"]) for _ in range(n))
    rows = [(i, body(rng.randrange(40))) for i in range(300)] + [(7, "same row"), (7, "same row"), (None, body(30)), (None, body(30)), (900, None), (901, ""), (902, "w" * 9000), *[(1000 + i, body(1) * 0 + "tie " * 25) for i in range(5)]]
    target = [("Aa c9 " * 20,), (None,), ("",), ("zz dd",)]
    docs, goal = spark.createDataFrame(rows, "doc_id long, text string").repartition(6), spark.createDataFrame(target, "text string")
    got = resampling.resampled(docs, goal, "doc_id", longest, buckets, 20, 10, 2024).collect()
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(map(bucket, features_of(x, longest)[1]))
    for (x,) in target:
        t.update(map(bucket, features_of(x, longest)[1]))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1.0) * (S + buckets)) / ((s[b] + 1.0) * (T + buckets))))
    want = []
    for i, x in rows:
        n_words, f = features_of(x, longest)
        weight = sum(gain(bucket(y)) for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        want.append((i, n_words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    assert Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in got) == Counter(want)
    fit = sorted((w for w in want if w[1] >= 20), key=lambda w: (-w[4], w[0] is None, w[0]))
    n = len(fit) * 10 // 100
    assert [(r.doc_id, r.score) for r in sorted((r for r in got if r.rank), key=lambda r: r.rank)] == [(w[0], w[4]) for w in fit[:n]]
    assert sorted(r.rank for r in got if r.rank) == list(range(1, n + 1))


def test_ranks_of_ties_and_of_all_rows(spark):
    rows = [(i, s, i % 7 != 0) for i, s in enumerate([5] * 40 + [9] * 3 + [-2] * 30 + [5] * 10)] + [(None, 5, True)] * 2
    scored = spark.createDataFrame(rows, "doc_id long, score long, fit boolean")
    order = sorted((r for r in rows if r[2]), key=lambda r: (-r[1], r[0] is None, r[0]))
    for percent in (0, 1, 37, 100):
        got = resampling.ranked(scored, F.col("fit"), "score", "doc_id", percent).collect()
        drawn = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
        assert len(got) == len(rows) and [(r.doc_id, r.score) for r in drawn] == [r[:2] for r in order[: len(order) * percent // 100]]


def test_resampling_of_empty_tables_and_clashing_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert resampling.resampled(none, some, "doc_id").collect() == []
    got = resampling.importance(some.withColumns({"_features": F.lit("x"), "gain": F.lit(1), "k": F.lit(2)}), none, ["doc_id", "gain", "k"]).first()
    assert (got.doc_id, got.gain, got.k, got.n_words, got.n_features) == (1, 1, 2, 2, 2)
    with pytest.raises(ValueError):
        resampling.importance(some.withColumn("weight", F.lit(1)), some, ["weight"])
    with pytest.raises(ValueError):
        resampling.importance(some, some, ["doc_id"], buckets=1 << 30)


# 13


def failing(text):
    w, t = re.findall(r"[^\x20\x09-\x0D]+", text or ""), text or ""
    return [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t))]


def test_audit_against_plain_python(spark):
    """All orders of five filters, with nulls, ties, repeated rows, labels that repeat, a part whose rows all fail at once, and extra columns."""
    rng = random.Random(6)
    body = lambda n: " ".join(rng.choice(["Ab", "ab", "c#", "É", "x y", "\x00"]) + str(rng.randrange(rng.choice([5, 5000]))) for _ in range(n))
    texts = [body(rng.choice([0, 3, 199, 200, 201, 300])) for _ in range(60)]
    rows = [(i, rng.choice(texts), rng.choice(["en", "de", "", None])) for i in range(150)]
    rows += [(None, texts[0], "en"), (5, texts[1], "en"), (5, texts[1], "en"), (400, None, "xx"), (401, "", "xx"), (402, None, "xx"), (403, "HIT " * 300, "only")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 150, 2)] + [(400, 1, 1), (400, 0, 0), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"part": F.lit(1), "A": F.lit("x"), "key": F.lit(None).cast("string")})
    base = audit.failures(docs.repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = audit.audited(base, list("ABCDE"), "part", ["good", "toxic"]).collect()
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    facts = []
    for i, t, lang in rows:
        f = failing(t) + [i is not None and least[t or ""] < i]
        mine = [x for x in labels if i is not None and x[0] == i]
        facts.append((lang or "", f, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    want, shapley = {}, Counter()
    for part in {f[0] for f in facts}:
        for order in permutations(range(5)):
            left = [f for f in facts if f[0] == part]
            for step, k in enumerate(order):
                gone = [f for f in left if f[1][k]]
                every = [f for f in facts if f[0] == part and f[1][k]]
                left = [f for f in left if not f[1][k]]
                shapley[part, k] += len(gone)
                want[part, "".join("ABCDE"[x] for x in order), step + 1] = (len(left), len(gone), len(every) - len(gone), sum(sum(f[1]) == 1 for f in every), sum(f[2] for f in gone), sum(f[3] for f in gone))
    assert len(got) == len(want) == 600 * len({f[0] for f in facts})
    for r in got:
        assert (r.kept, r.removed, r.redundant, r.unique_fails, r.lost_good, r.lost_toxic) == want[r.part, r.filter_order, r.step]
        assert r.shapley == shapley[r.part, "ABCDE".index(r.filter_order[r.step - 1])]


def test_states_are_made_once_and_let_go(spark, monkeypatch):
    """32 sets of filters, of which the full one has no edges: 31 tables, not one for each of 326 prefixes; none stays persisted."""
    rows = spark.createDataFrame([("p", i % 2 == 0, i % 3 == 0, i % 5 == 0, i % 7 == 0, i % 11 == 0, i % 13 == 0) for i in range(300)], "part string, A boolean, B boolean, C boolean, D boolean, E boolean, good boolean")
    made = []
    monkeypatch.setattr(audit, "written", lambda df, name, *a, f=audit.written: made.append(name) or f(df, name, *a))
    edges = audit.walked(rows, list("ABCDE"), "part", ["good"])
    assert len(made) == 31 and edges.count() == 80
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0
    assert edges.groupBy("state", "filter").count().where("count > 1").isEmpty()


def test_audit_without_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audited(audit.failures(docs, labels), list("ABCDE"), "part", ["good", "toxic"]).collect() == []
    with pytest.raises(ValueError):
        audit.audited(docs, list("ABCDEFGH"), "part", [])
