"""Bytes of every kind, long texts, many spans, rows without ids and kept columns of any name."""

import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loamline.llm import embeddings, language, mixing, pii, signatures, urlfilter
from loamline.llm import words as words_module
from loamline.llm.words import ALNUM, SPACED, words


def lowered(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


@pytest.mark.parametrize("piece", [1, 7, 1 << 20])
def test_words_of_all_ascii_bytes_and_cut_pieces(monkeypatch, piece):
    """Words as the patterns tell them, one hash a word, also where a long text is hashed piece by piece."""
    monkeypatch.setattr(words_module, "CHUNK_BYTES", piece)
    rng = random.Random(4)
    every = [chr(i) for i in range(128)] + ["é", "\u2003", "🙂"]
    texts = ["".join(every), *[f"a{c}b" for c in every], *["".join(rng.choice(every + ["a"] * 60 + [" "] * 20) for _ in range(rng.randrange(200))) for _ in range(60)], "", None, "z" * 50]
    for table, pattern in ((SPACED, r"[^\x20\x09-\x0D]+"), (ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        by_word, seen = {}, 0
        for w in words(pa.array(texts), table):
            for d in range(w.n):
                mine = w.hashes[w.at[d] : w.at[d + 1]].tolist()
                want = re.findall(pattern, lowered(texts[w.first + d] or ""))
                assert len(mine) == len(want)
                assert [w.data[a:b].tobytes().decode() for a, b in zip(w.starts[w.at[d] : w.at[d + 1]], w.ends[w.at[d] : w.at[d + 1]], strict=True)] == want
                for h, x in zip(mine, want, strict=True):
                    assert by_word.setdefault(x, h) == h
                seen += 1
        assert seen == len(texts) and len(set(by_word.values())) == len(by_word)


def test_jaccard_tells_control_bytes_apart(spark):
    rows = [(i, f"x{chr(c)} y z w") for i, c in enumerate([0, 1, 2, 7, 8, 14, 31, 127])] + [(90, "x\x00 y z w")]
    got = dict(signatures.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id").collect())
    assert got == {i: i for i, _ in rows if i != 90} | {90: 0}


def test_many_spans_in_one_text_take_no_time():
    t = " ".join(f"mail u{i}@h{i}.org or call 030 {1000000 + i} now" for i in range(20_000))
    base = pii.base_spans(t)
    began = time.perf_counter()
    like = pii.lookalikes(t, base)
    assert time.perf_counter() - began < 2 and len(base) == len(like) == 20_000
    rng = random.Random(5)
    for _ in range(300):  # as each is told from every other
        t = " ".join(rng.choice(["a@b.c", "+49 30 1234567", "4111 1111 1111 1111", "1.2.3.4", "12345678", "(555) 123-4567", "x at y dot z", "ab:cd::1:2"]) + rng.choice(["", ".", "@q.r"]) for _ in range(rng.randrange(12)))
        base = pii.base_spans(t)
        free, last = [], (0, 0)
        for a, b, k in sorted(pii.lookalikes(t, [])):
            assert not last[1] > a
            last = (a, b)
        for a, b, _ in pii.lookalikes(t, base):
            free.append(all(b <= x or y <= a for x, y, _ in base))
        assert all(free)


def test_languages_whose_rows_have_no_ids_are_learned(spark):
    rng = random.Random(8)
    of = {"aa": "abcde", "bb": "vwxyz"}
    rows = [(None if lang == "bb" else i, " ".join("".join(rng.choice(of[lang]) for _ in range(5)) for _ in range(60)), lang) for i in range(2400) for lang in of]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = language.fit_language(docs, F.lit(True), train_docs=100)
    assert net.names == ["aa", "bb"]
    got = language.predicted(docs, net, ["lang"]).where("lang = lang_pred").count()
    assert got > 0.98 * len(rows)


def test_url_columns_that_are_kept_may_have_any_name(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x", "own", "p", 3)], "page_id long, url string, host string, verdict string, Path int")
    out = urlfilter.judged(pages, keep=("page_id", "host", "Path", "verdict", "url"))
    assert out.columns == ["page_id", "host", "Path", "verdict", "url", "_host", "_path", "rule", "_verdict"]
    assert out.first() == (1, "own", 3, "p", "http://a.org/x", "a.org", "/x", "org/", "allow")


def near(rng, n, width, cosine):
    """n isolated pairs of about that cosine."""
    x = rng.standard_normal((n, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((n, width))
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    return x, cosine * x + np.sqrt(1 - cosine**2) * y


def test_forest_of_shipped_settings(spark):
    """One label that splits: pairs just above the threshold are found, and a vector is in few leaves. Labels below a leaf's size: one leaf."""
    rng = np.random.default_rng(3)
    x, y = near(rng, 2000, 64, 0.935)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([x, y]))] + [(10_000 + i, rng.standard_normal(64).tolist(), 2) for i in range(100)]
    reps = spark.createDataFrame([(a, c, b) for a, b, c in rows], "rep long, label int, v array<double>")
    leaves = embeddings.forest(reps).collect()
    by = {}
    for r in leaves:
        by.setdefault(r.rep, set()).add(r.leaf)
    assert len(leaves) == sum(map(len, by.values())) and all(len(by[10_000 + i]) == 1 for i in range(100))
    assert sum(bool(by[i] & by[i + 2000]) for i in range(2000)) >= 0.95 * 2000
    assert sum(len(by[i]) for i in range(4000)) <= 12 * 4000


@pytest.mark.parametrize("close", [0.05, 0.2])
def test_clusters_on_both_sides_of_the_density_at_which_splitting_ends(spark, close):
    """Half of the vectors are near one another, or only a few are: the links are those of brute force."""
    rng = np.random.default_rng(6)
    n = 400
    dense = int(n * close**0.5)
    centre = rng.standard_normal(16)
    v = np.concatenate([centre + 0.03 * rng.standard_normal((dense, 16)), rng.standard_normal((n - dense, 16))])
    df = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    links = (u @ u.T >= 0.93).sum(1) - 1
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(df).collect()}
    found, there = sum(got.values()), int(links.sum())
    assert all(got[i] <= links[i] for i in range(n)) and found >= 0.99 * there


def test_mix_tells_rows_without_ids_apart_by_their_texts(spark):
    import corpus_pipeline as cp

    docs = spark.createDataFrame([(None, f"{'w ' * 9}t{i}", "en", s, 20) for i in range(50) for s in ("a", "b")], "doc_id long, text string, lang string, source string, n_chars long")
    runs = [sorted(r.text + r.source for r in cp.mixing_stage(spark, docs.repartition(n), "").collect()) for n in (1, 7)]
    assert runs[0] == runs[1] and {t[:-1] for t in runs[0]} <= {r.text for r in docs.collect()}
