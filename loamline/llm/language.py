"""Language identification by a convolutional network over bytes, trained in numpy."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import small_batches
from .words import chunks, text_bytes

#: Bytes of a window; filters' widths and their number for each width; the step between positions; numbers that stand for a byte.
WINDOW, WIDTHS, FILTERS, STEP, EMBED = 128, (2, 3, 4, 5), 16, 2, 8
#: Documents of each language that are learned from, chosen by a hash of their id and text; windows of each of them.
TRAIN_DOCS, TRAIN_WINDOWS = 500, 8
PAD, WIDE = 256, max(WIDTHS)
UNKNOWN = "und"


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every text's bytes in windows, the last one padded, and the number of windows of each text (none for an empty one)."""
    n = -(-np.diff(offsets) // WINDOW)
    out = np.full((int(n.sum()), WINDOW), PAD, np.uint16)
    of, first = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
    nth = np.arange(len(of)) - first[of]
    at = offsets[:-1][of] + nth * WINDOW
    size = np.minimum(WINDOW, offsets[1:][of] - at)
    whole = size == WINDOW
    if whole.any():
        out[whole] = data[at[whole, None] + np.arange(WINDOW)]
    for k in np.flatnonzero(~whole):
        out[k, : size[k]] = data[at[k] : at[k] + size[k]]
    return out, n


@dataclass
class ByteNet:
    names: list[str]
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    prior: np.ndarray

    def columns(self, windows: np.ndarray) -> np.ndarray:
        """The WIDE bytes from each position on, embedded: windows x positions x (WIDE * EMBED)."""
        wide = np.concatenate([windows, np.full((len(windows), WIDE), PAD, windows.dtype)], 1)
        x = self.embed[wide]
        s = x.strides
        return np.ascontiguousarray(np.lib.stride_tricks.as_strided(x, (len(x), WINDOW // STEP, WIDE * EMBED), (s[0], s[1] * STEP, s[2])))

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(windows), len(self.names)), np.float32)
        for i in range(0, len(windows), 512):
            c = self.columns(windows[i : i + 512])
            z = (c.reshape(-1, c.shape[2]) @ self.filters).reshape(len(c), c.shape[1], -1).max(1) + self.bias
            logits = np.maximum(z, 0) @ self.dense + self.prior
            logits -= logits.max(1, keepdims=True)
            out[i : i + 512] = logits - np.log(np.exp(logits).sum(1, keepdims=True))
        return out


def fit_net(windows: np.ndarray, labels: np.ndarray, names: list[str], epochs: int = 5, batch: int = 64, rate: float = 3e-3, seed: int = 3) -> ByteNet:
    """Adam on the cross-entropy of windows. Filters of each width see that many bytes; the rest of their WIDE bytes is held at zero."""
    rng = np.random.default_rng(seed)
    n_filters = FILTERS * len(WIDTHS)
    mask = np.zeros((WIDE * EMBED, n_filters), np.float32)
    for k, w in enumerate(WIDTHS):
        mask[: w * EMBED, k * FILTERS : (k + 1) * FILTERS] = 1
    f32 = lambda *shape: rng.normal(0, 1, shape).astype(np.float32)
    net = ByteNet(names, f32(257, EMBED), f32(WIDE * EMBED, n_filters) * mask * 0.15, np.zeros(n_filters, np.float32), f32(n_filters, len(names)) * 0.1, np.zeros(len(names), np.float32))
    net.embed[PAD] = 0
    moments, step = {k: (np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))) for k in ("embed", "filters", "bias", "dense", "prior")}, 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for i in range(0, len(order), batch):
            w, y = windows[order[i : i + batch]], labels[order[i : i + batch]]
            rows = np.arange(len(w))
            c = net.columns(w)
            z = (c.reshape(-1, c.shape[2]) @ net.filters).reshape(len(w), c.shape[1], n_filters)
            best = z.argmax(1)
            top = np.take_along_axis(z, best[:, None, :], 1)[:, 0] + net.bias
            hidden = np.maximum(top, 0)
            logits = hidden @ net.dense + net.prior
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[rows, y] -= 1
            p /= len(w)
            back = (p @ net.dense.T) * (top > 0)
            seen = c[rows[:, None], best]
            to_bytes = (back[:, :, None] * net.filters.T[None]).reshape(-1, EMBED)
            at = np.minimum(best[:, :, None] * STEP + np.arange(WIDE), WINDOW + WIDE - 1)
            which = np.concatenate([w, np.full((len(w), WIDE), PAD, w.dtype)], 1)[rows[:, None, None], at].ravel()
            embed = np.stack([np.bincount(which, to_bytes[:, e], 257) for e in range(EMBED)], 1).astype(np.float32)
            embed[PAD] = 0
            grads = {"embed": embed, "filters": np.einsum("bf,bfk->kf", back, seen) * mask, "bias": back.sum(0), "dense": hidden.T @ p, "prior": p.sum(0)}
            step += 1
            for k, g in grads.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                setattr(net, k, (getattr(net, k) - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32))
    return net


def some_windows(batches):
    """TRAIN_WINDOWS windows spread over each text, or all that it has."""
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        langs = batch.column("lang").to_pylist()
        rows, names = [], []
        for i, lang in enumerate(langs):
            w, n = windows_of(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))
            for k in np.unique(np.linspace(0, n[0] - 1, TRAIN_WINDOWS).astype(int)) if n[0] else []:
                rows.append(w[k].astype("<u2").tobytes())
                names.append(lang)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(rows, pa.binary())], names=["lang", "w"])


def has_letter(texts: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    found = np.zeros(len(texts), bool)
    letter = ((data | 32) >= 97) & ((data | 32) <= 122) & (data < 128)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        found[full] = np.logical_or.reduceat(letter, offsets[full])
    for i in full[~found[full]]:
        found[i] = any(ch.isalpha() for ch in texts[int(i)].as_py())
    return found


def fit_language(docs: DataFrame, learnable: Column, train_docs: int = TRAIN_DOCS) -> ByteNet | None:
    """A network from the text and lang of learnable rows with both; None where there are none.

    Every value of lang is a class. Of each language about train_docs rows are learned, by a hash of id and text: first rows are counted by language, then that
    share of each language is taken. Rows of one id and text are taken or left together, so copies count more, as they do in the corpus.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.where(learnable & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "text", "lang")
    counts = docs.where(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull()).groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    if not counts:
        return None
    share = F.element_at(F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, train_docs / r["count"]))]), F.col("lang"))
    hashed = F.xxhash64(F.lit(3), "doc_id", "text").bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    got = rows.where(hashed < share).mapInArrow(some_windows, "lang string, w binary").toArrow()
    if not got.num_rows:
        return None
    order = sorted(range(got.num_rows), key=lambda i, l=got.column("lang").to_pylist(), w=got.column("w").to_pylist(): (l[i], w[i]))
    langs, w = got.column("lang").to_pylist(), got.column("w").to_pylist()
    names = sorted(set(langs))
    nth = {name: i for i, name in enumerate(names)}
    windows = np.frombuffer(b"".join(w[i] for i in order), "<u2").reshape(-1, WINDOW)
    return fit_net(windows, np.array([nth[langs[i]] for i in order]), names)


def predicted(docs: DataFrame, net: ByteNet | None, keep: list[str]) -> DataFrame:
    """Adds lang_pred and score to the columns `keep` of every row, from all windows of its text.

    The log-probabilities of a text's windows are averaged; score is the softmax of that average at lang_pred. A text that is null
    or has no letter, and any text where nothing was learned, is `und` with score 0.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def predict(batches):
        net = sent.value
        for batch in batches:
            texts = batch.column("text")
            data, offsets = text_bytes(texts)
            known = has_letter(texts, data, offsets)
            lang, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            for i, j in chunks(offsets, 1 << 20) if net is not None else []:
                sums, weights = np.zeros((j - i, len(net.names))), np.zeros(j - i)
                for a in range(int(offsets[i]), int(offsets[j]), 1 << 20) if j == i + 1 else [int(offsets[i])]:
                    off = np.array([a, min(a + (1 << 20), int(offsets[j]))]) if j == i + 1 else offsets[i : j + 1]
                    w, n = windows_of(data, off)
                    of = np.repeat(np.arange(len(n)), n)
                    logs = net.log_probabilities(w)
                    for c in range(len(net.names)):
                        sums[:, c] += np.bincount(of, logs[:, c], j - i)
                    weights += n
                mean = sums / np.maximum(weights, 1)[:, None]
                p = np.exp(mean - mean.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                ok = known[i:j]
                lang[i:j][ok] = np.array(net.names, object)[p.argmax(1)][ok]
                score[i:j][ok] = p.max(1)[ok].round(6)  # single precision tells no more, and depends on how rows are batched
            out = [batch.column(c) for c in keep] + [pa.array(lang.tolist(), pa.string()), pa.array(score)]
            yield pa.RecordBatch.from_arrays(out, names=[*keep, "lang_pred", "score"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(predict, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", lang_pred string, score double")


def held_out() -> Column:
    """Whether a row's id is held out: its CRC as text, mod 4, is 2."""
    return F.expr("crc32(cast(coalesce(cast(doc_id AS string), '') AS binary)) % 4 = 2")


def op3_language(spark, sf_dir):
    """The language of every whole text of documents."""
    from .shared import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = predicted(docs.select("doc_id", "text"), fit_language(docs, ~held_out()), ["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
