"""Encoding and decoding with a SentencePiece model by a table of the distinct marked words of a corpus."""

from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .distinct import Runs, numbered, parts, strings_of
from .shared import free, small_batches
from .words import CHUNK_BYTES, text_bytes

#: The character that stands for a space in pieces.
MARK = "▁"
#: Buckets of distinct words; the table of a bucket's words is what a task holds.
BUCKETS = 4096


@lru_cache(maxsize=2)
def processor(model: bytes):
    """The library's processor of a model file's bytes."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def checked(model: bytes) -> bytes:
    """The model, if words marked by spaces can be segmented one by one: merges that no piece carries over a space, texts not normalised, spaces kept and one put
    before a text."""
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto()
    spec.ParseFromString(model)
    normal, trained = spec.normalizer_spec, spec.trainer_spec
    kinds = trained.model_type == trained.BPE and not trained.treat_whitespace_as_suffix
    plain = not normal.precompiled_charsmap and normal.add_dummy_prefix and normal.escape_whitespaces and not normal.remove_extra_whitespaces
    if not (kinds and plain) or any(MARK in p.piece.lstrip(MARK) for p in spec.pieces):
        raise ValueError("a piece of this model can cross a space, or it normalises texts")
    return model


def marked_words(texts: pa.Array) -> list[Runs]:
    """A cut into spaces and what follows them, up to the next space; a text that isn't empty gets a space before it. U+2581 counts as a space."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if pc.any(pc.match_substring(texts, MARK)).as_py():
        texts = pc.replace_substring(texts, MARK, " ")
    none, space = (pa.scalar(x, pa.large_string()) for x in ("", " "))
    texts = pc.if_else(pc.equal(texts, none), none, pc.binary_join_element_wise(space, texts, none))
    data, offsets = text_bytes(texts)
    for i, off in parts(data, offsets, lambda d, at: (d[at] == 32) & (d[at - 1] != 32), CHUNK_BYTES):
        raw, off = data[off[0] : off[-1]], off - off[0]
        first = np.zeros(len(raw) + 1, bool)
        first[off] = True
        space = raw == 32
        before = np.zeros(len(raw), bool)
        before[1:] = space[:-1]
        starts = np.flatnonzero(space & (~before | first[:-1]))
        yield i, np.searchsorted(starts, off), strings_of(raw, np.append(starts, len(raw)))


def dealt(names: pa.Array, buckets: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct strings as bytes, the buckets that have some, and for each string its number when they are ordered by bucket, then as they come."""
    import xxhash

    found = names.cast(pa.large_binary()).to_pylist()
    own = np.array([xxhash.xxh32_intdigest(x) for x in found], np.int64) % buckets
    order = np.argsort(own, kind="stable")
    number = np.empty(len(found), np.int64)
    number[order] = np.arange(len(found))
    return [found[i] for i in order], own[order], number


def squeezed(*arrays: np.ndarray) -> bytes:
    """Whole numbers from 0 on as bytes: their number, then bytes of equal weight together, compressed."""
    import zstandard

    raw = b"".join(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for x in arrays)
    return np.array([len(x) for x in arrays], "<i8").tobytes() + zstandard.ZstdCompressor(level=1).compress(raw)


def unsqueezed(data: bytes, n: int = 1) -> list[np.ndarray]:
    import zstandard

    sizes = np.frombuffer(data[: 8 * n], "<i8")
    raw, out, at = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[8 * n :], max_output_size=int(sizes.sum()) * 4), np.uint8), [], 0
    for k in sizes.tolist():
        out.append(np.ascontiguousarray(raw[at : at + 4 * k].reshape(4, -1).T).view("<u4").ravel())
        at += 4 * k
    return out


def segment(model: bytes):
    """Words of blocks, in order of buckets, to ids. In a bucket each distinct word is segmented once; the table of its words is let go with the bucket."""

    def run(batches):
        import zstandard

        encode = processor(model).encode
        space = encode("x ")[len(encode("x")) :]  # a space alone, for which the library would see an empty text
        bucket, table = None, {}
        for batch in batches:
            out = []
            for b, data in zip(batch.column("_bucket").to_pylist(), batch.column("_words").to_pylist(), strict=True):
                if b != bucket:
                    bucket, table = b, {}
                words = zstandard.ZstdDecompressor().decompressobj().decompress(data).split(b"\xff")
                new = [w for w in words if w not in table]
                # the library puts the first space before a word itself
                table.update(zip(new, map(partial(np.array, dtype=np.uint32), encode([w[1:].decode() for w in new], num_threads=1)), strict=True))
                if b" " in table:
                    table[b" "] = np.array(space, np.uint32)
                ids = [table[w] for w in words]
                out.append(squeezed(np.array([len(x) for x in ids]), np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([batch.column("_block"), batch.column("_bucket"), pa.array(out, pa.binary())], names=["_block", "_bucket", "_ids"])

    return run


def gathered(flat: np.ndarray, begin: np.ndarray, places: np.ndarray, at: np.ndarray, head: list[int], tail: list[int]) -> pa.Array:
    """Lists of ids: of each row head, the ids of its words, flat[begin[p]] up to flat[begin[p + 1]] for each place p in places[at[i]] .. places[at[i + 1]], and tail."""
    size = np.diff(begin).astype(np.int64)
    ends = np.cumsum(size[places], dtype=np.int64)
    own = np.concatenate([[0], ends])[at]  # ids before each row
    extra = len(head) + len(tail)
    bounds = own + extra * np.arange(len(at))
    out = np.empty(int(bounds[-1]), np.int32)
    for i, x in enumerate(head):
        out[bounds[:-1] + i] = x
    for i, x in enumerate(reversed(tail)):
        out[bounds[1:] - 1 - i] = x
    for a in range(0, len(places), 1 << 20):  # a long text's words a part at a time
        p = places[a : a + (1 << 20)]
        n = size[p]
        first = ends[a : a + len(p)] - n  # of each word's ids, which comes first among all
        nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        shift = len(head) + extra * (np.searchsorted(at, np.arange(a, a + len(p)), "right") - 1)
        out[np.repeat(first + shift, n) + nth] = flat[np.repeat(begin[p], n) + nth]
    return pa.LargeListArray.from_arrays(pa.array(bounds), pa.array(out))


def encoded(docs: DataFrame, model: bytes, keep: list[str], bos: bool = False, eos: bool = True, buckets: int = BUCKETS) -> DataFrame:
    """docs (text, and the columns `keep`). Returns the columns kept and ids: the library's ids of each whole text, with begin and end ids as asked for.

    Each distinct marked word of the corpus is segmented once: a block (an Arrow batch of texts) lists its distinct words once, by hash buckets; a bucket's words of all
    blocks meet in one task, whose table of distinct words gives their ids; and these are joined back to the places of the block's words. So a word
    moves once for each block that has it, and a text moves as numbers. Both scans of docs must give rows in the same order, as scans of tables do:
    blocks are named by what they hold, and one that doesn't find its words is an error, never a wrong text. Write a table first where docs come from a
    shuffle without an order. Null is an empty text, whose ids are only begin and end. Every row has one result, repeated rows too. A kept column named
    ids is an error.
    """
    if "ids" in {c.lower() for c in keep}:
        raise ValueError("a column is named ids")
    small_batches(docs.sparkSession)
    model, kinds, names = checked(model), {f.name: f.dataType.simpleString() for f in docs.schema.fields}, free(keep, "_block", "_places", "_at")

    def blocks(batches):
        import xxhash

        part = TaskContext.get().partitionId()
        for nth, batch in enumerate(batches):
            if batch.num_rows:
                listed, numbers, at = numbered(batch.column("text"), marked_words)
                words, own, number = dealt(listed, buckets)
                name = xxhash.xxh64_intdigest(b"\xff".join([b"%d %d %d" % (part, nth, batch.num_rows), *words])) - (1 << 63)
                yield batch, name, words, own, number[numbers], at

    def list_words(batches):
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3).compress
        for _, name, words, own, _, _ in blocks(batches):
            at = np.flatnonzero(np.diff(own, prepend=-1))
            ends = np.append(at, len(words))[1:]
            lists = [squeeze(b"\xff".join(words[a:b])) for a, b in zip(at, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.int64()), pa.array(own[at].astype(np.int32)), pa.array(lists, pa.binary())], names=["_block", "_bucket", "_words"])

    def list_places(batches):
        for batch, name, words, _, places, at in blocks(batches):
            whole = [pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([squeezed(places, at, np.array([len(words)]))], pa.binary()), *whole], names=[names[0], names[1], *keep])

    def finish(rows, words):
        p = processor(model)
        places, at, n = unsqueezed(rows.column(names[1])[0].as_py(), 3)
        lists = [unsqueezed(x, 2) for x in words.take(pa.array(np.argsort(words.column("_bucket").to_numpy()))).column("_ids").to_pylist()]
        size = np.concatenate([np.zeros(0, np.int64), *(x for x, _ in lists)]).astype(np.int64)
        if len(size) != n[0]:
            raise RuntimeError("a block's words aren't those of its first scan: its rows came in another order; write docs as a table first")
        flat = np.concatenate([np.zeros(0, np.uint32), *(y for _, y in lists)])
        ids = gathered(flat, np.concatenate([[0], np.cumsum(size)]), places, at.astype(np.int64), [p.bos_id()] * bos, [p.eos_id()] * eos)
        return pa.table([*(rows.column(c).combine_chunks().flatten() for c in keep), ids.cast(pa.list_(pa.int32()))], names=[*keep, "ids"])

    texts = docs.select(*dict.fromkeys([*keep, "text"]))
    words = texts.mapInArrow(list_words, "_block long, _bucket int, _words binary").repartition("_bucket").sortWithinPartitions("_bucket").mapInArrow(segment(model), "_block long, _bucket int, _ids binary")
    places = texts.mapInArrow(list_places, f"`{names[0]}` long, `{names[1]}` binary" + "".join(f", `{c}` array<{kinds[c]}>" for c in keep))
    return places.groupBy(names[0]).cogroup(words.groupBy("_block")).applyInArrow(finish, "".join(f"`{c}` {kinds[c]}, " for c in keep) + "ids array<int>")


@lru_cache(maxsize=2)
def piece_bytes(model: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Of each id what it stands for in a decoded text, as bytes; whether it is a control id; whether it begins with a space."""
    p = processor(model)
    names = [p.id_to_piece(i) for i in range(len(p))]
    control = np.array([p.is_control(i) for i in range(len(p))])
    spaced = np.array([n.startswith(MARK) and not p.is_byte(i) and not p.is_unknown(i) for i, n in enumerate(names)])
    out = [b"" if control[i] else bytes([int(n[3:5], 16)]) if p.is_byte(i) else p.decode([i]).encode() if p.is_unknown(i) else n.replace(MARK, " ").encode() for i, n in enumerate(names)]
    return pa.array(out, pa.large_binary()), control, spaced


def decoded(rows: DataFrame, model: bytes, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """Adds the text that the library decodes the ids to. rows: any, with a column of arrays of ids, null and empty ones decode to an empty text.

    Pieces are put together as bytes, without the space that the library puts before a text; ids whose bytes aren't a text, or whose words are unknown, are
    decoded by the library itself. A column named as the result is an error.
    """
    if name.lower() in {c.lower() for c in rows.columns}:
        raise ValueError(f"a column is named {name}")
    small_batches(rows.sparkSession)
    columns, kinds = rows.columns, {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches):
        pieces, control, spaced = piece_bytes(model)
        for batch in batches:
            out = []
            for x in batch.column(ids):
                own = x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.zeros(0, np.int32)
                seen = own[~control[own]]
                got = pieces.take(pa.array(seen))
                a, b = np.frombuffer(got.buffers()[1], np.int64)[[got.offset, got.offset + len(got)]] if len(got) else (0, 0)
                text = got.buffers()[2].to_pybytes()[a:b] if b > a else b""
                try:
                    out.append(text[1 if len(seen) and spaced[seen[0]] else 0 :].decode())
                except UnicodeDecodeError:
                    out.append(processor(model).decode(own.tolist()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(out, pa.string())], names=[*columns, name])

    return rows.mapInArrow(run, "".join(f"`{c}` {kinds[c]}, " for c in columns) + f"`{name}` string")


def op11_sentencepiece(spark, sf_dir, model: str | None = None):
    """Every whole text of documents, encoded with an end id and decoded. model: the model file's path, on the driver; its bytes go to the executors."""
    from .shared import table

    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    with open(model, "rb") as f:
        proto = f.read()
    out = decoded(encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), proto, ["doc_id"]), proto)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))
