"""Texts cut into strings, each distinct string of a block of rows once: what a string stands for is then found once and joined back by number.

A block is what one Arrow batch holds: at most BATCH_BYTES of texts, or one longer text. Its rows carry the numbers of their strings, its first row
the list of its distinct strings. So what is shuffled by string is one row for each block that has it, however often a text repeats it.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free, small_batches, written
from .words import CHUNK_BYTES, ByteTable, chunks, text_bytes

#: What a cut tells of some texts: the first text's row, where each text's strings begin and end, and all strings.
Runs = tuple[int, np.ndarray, pa.Array]


def strings_of(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The strings between neighbouring bounds in one stretch of bytes."""
    return pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))


def parts(data: np.ndarray, offsets: np.ndarray, may_cut: Callable[[np.ndarray, np.ndarray], np.ndarray], most: int) -> Iterator[tuple[int, np.ndarray]]:
    """Ranges of whole texts of about `most` bytes; a longer text comes in several, cut at the first place from there on at which may_cut says so.

    may_cut: of places in data, none of them the first of a text, whether strings end there.
    """
    for i, j in chunks(offsets, most):
        lo, end = int(offsets[i]), int(offsets[j])
        while j == i + 1 and end - lo > most:
            at, hi = lo + most, end
            while at < end:
                places = np.arange(at, min(end, at + most))
                ok = np.flatnonzero(may_cut(data, places))
                if len(ok):
                    hi = int(places[ok[0]])
                    break
                at += most
            yield i, np.array([lo, hi])
            lo = hi
        if lo < end or j > i + 1 or lo == offsets[i]:
            yield i, np.array([lo, end]) if j == i + 1 else offsets[i : j + 1]


def words_of(table: ByteTable, most: int | None = None) -> Callable[[pa.Array], Iterator[Runs]]:
    """A cut into words, bytes lowered as the table says."""

    def cut(texts: pa.Array) -> Iterator[Runs]:
        data, offsets = text_bytes(texts)
        for i, off in parts(data, offsets, lambda d, at: ~table.inside[d[at]], most or CHUNK_BYTES):
            raw, off = data[off[0] : off[-1]], off - off[0]
            inside = table.inside[raw]
            first = np.zeros(len(raw) + 1, bool)
            first[off] = True
            before = np.zeros(len(raw), bool)
            before[1:] = inside[:-1]
            starts = np.flatnonzero(inside & (~before | first[:-1]))
            sums = np.concatenate([[0], np.cumsum(inside)])  # bytes of words before each place
            yield i, np.searchsorted(starts, off), strings_of(table.low[raw][inside], np.concatenate([sums[starts], sums[-1:]]))

    return cut


def numbered(texts: pa.Array, cut: Callable[[pa.Array], Iterator[Runs]]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct strings of all texts, in the order in which they come; all texts' strings, as numbers in that list; and where each text's begin and end in these."""
    runs, counts = [], np.zeros(len(texts), np.int64)
    for first, at, found in cut(texts):
        counts[first : first + len(at) - 1] += np.diff(at)
        runs.append(found)
    coded = pa.chunked_array(runs, pa.large_string()).dictionary_encode()
    numbers = [c.indices.to_numpy() for c in coded.chunks]  # all chunks share the last one's list
    names = coded.chunk(coded.num_chunks - 1).dictionary if coded.num_chunks else pa.array([], pa.large_string())
    return names, np.concatenate([np.zeros(0, np.int32), *numbers]), np.concatenate([[0], np.cumsum(counts)])


def packed(x: np.ndarray, most: int) -> bytes:
    """Numbers from 0 to `most` as bytes, in the least width that holds them; see unpacked()."""
    kind = "<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4"
    return kind[2:].encode() + x.astype(kind).tobytes()


def unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(x, "<u" + x[:1].decode(), offset=1).astype(np.int64)


def blocks(docs: DataFrame, keep: list[str], describe: Callable[[pa.Array], tuple[list[str], list[int], list[dict]]], extra: str) -> tuple[DataFrame, DataFrame]:
    """docs (text, and the columns `keep`). Returns two views of one written table.

    describe: of a block's texts its strings, how often each comes, and of each text the values of the columns in `extra` (their SQL types).
    rows: (_block, the columns kept, those of extra). strings: (_block, k, string, n), k from 0 in each block.
    """
    small_batches(docs.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    block, listed, times = free([*keep, *(x.split()[0] for x in extra.split(", "))], "_block", "_strings", "_times")
    names = [x.split()[0] for x in extra.split(", ")]
    arrow = {"long": pa.int64(), "binary": pa.binary(), "int": pa.int32()}
    types = {x.split()[0]: arrow[x.split()[1]] for x in extra.split(", ")}

    def run(batches):
        part = TaskContext.get().partitionId()
        for nth, batch in enumerate(batches):
            if not batch.num_rows:
                continue
            strings, n, rows = describe(batch.column("text"))
            rest = [None] * (batch.num_rows - 1)
            columns = [pa.array([(part << 32) + nth] * batch.num_rows), *(batch.column(c) for c in keep), *(pa.array([r[c] for r in rows], types[c]) for c in names)]
            columns += [pa.array([strings, *rest], pa.list_(pa.string())), pa.array([n, *rest], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[block, *keep, *names, listed, times])

    schema = f"`{block}` long, " + "".join(f"`{c}` {kinds[c]}, " for c in keep) + f"{extra}, `{listed}` array<string>, `{times}` array<long>"
    made = written(docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema), "blocks", "zstd")
    pairs = made.where(F.col(listed).isNotNull()).select(F.col(block).alias("_block"), F.posexplode(F.arrays_zip(F.col(listed).alias("string"), F.col(times).alias("n"))).alias("k", "x"))
    return made.select(F.col(block).alias("_block"), *keep, *names), pairs.select("_block", "k", "x.string", "x.n")


def joined_back(rows: DataFrame, values: DataFrame, finish: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """rows: of blocks(). values: (_block, k, and what each string stands for). finish: makes a block's result of its rows and its values, which come by k.

    A block's rows and values meet in one task; both are bounded by what one batch holds.
    """

    def run(left, right):
        return finish(left, right.take(pa.array(np.argsort(right.column("k").to_numpy(), kind="stable"))))

    return rows.groupBy("_block").cogroup(values.groupBy("_block")).applyInArrow(run, schema)
