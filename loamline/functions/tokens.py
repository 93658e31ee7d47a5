"""Tokens of a byte-level BPE vocabulary file that the tokenizers library opens: counts, ids and texts, as Arrow UDFs.

The file's path is a parameter; it must be readable on every executor. A worker opens it once.
"""

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_OPEN: dict = {}


def opened(path: str):
    """The tokenizer of a file; strings of its special tokens in a text are ordinary text."""
    if path not in _OPEN:
        from tokenizers import Tokenizer

        _OPEN[path] = Tokenizer.from_file(path)
        _OPEN[path].encode_special_tokens = True
    return _OPEN[path]


def token_ids(text: Column, path: str) -> Column:
    """The ids of each text, without special tokens; null stays null."""

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        known = [i for i, t in enumerate(texts) if t is not None]
        found = opened(path).encode_batch([texts.iloc[i] for i in known], add_special_tokens=False)
        out = [None] * len(texts)
        for i, e in zip(known, found, strict=True):
            out[i] = e.ids
        return pd.Series(out, dtype=object)

    return run(text)


def token_count(text: Column, path: str) -> Column:
    @F.pandas_udf("int")
    def run(texts: pd.Series) -> pd.Series:
        known = [t or "" for t in texts]
        return pd.Series([None if t is None else len(e.ids) for t, e in zip(texts, opened(path).encode_batch(known, add_special_tokens=False), strict=True)], dtype="Int32")

    return run(text)


def decoded(ids: Column, path: str) -> Column:
    """The text of token ids, special tokens included."""

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else opened(path).decode([int(i) for i in r], skip_special_tokens=False) for r in rows], dtype=object)

    return run(ids)
