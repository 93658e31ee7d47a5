"""A second, independent line diff: shortest edit scripts in linear space, furthest points of all diagonals at once in numpy."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .code import code_lines


def interned(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lines as numbers, equal ones alike."""
    names: dict[str, int] = {}
    return tuple(np.array([names.setdefault(x, len(names)) for x in side], np.int64) for side in (a, b))


class Front:
    """The furthest points that d edits reach on each diagonal x - y of a rectangle of n by m, searched from its corner."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.a, self.b, self.n, self.m = a, b, len(a), len(b)
        self.zero = len(b) + 1  # where diagonal 0 is
        self.x = np.full(len(a) + len(b) + 3, -1, np.int64)
        self.x[self.zero + 1] = 0

    def step(self, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Goes on by one edit. Returns the diagonals, and on each where its last run of equal lines begins and ends, as x."""
        k = np.arange(-d, d + 1, 2)
        k = k[(k >= -self.m) & (k <= self.n)]  # others leave the rectangle
        at = self.zero + k
        right, down = self.x[at - 1] + 1, self.x[at + 1]
        x = np.where((right > down) & (right <= self.n), right, down)
        y = x - k
        fits = (x >= 0) & (y >= 0) & (x <= self.n) & (y <= self.m)
        begin, live = x.copy(), np.flatnonzero(fits)
        while len(live):
            live = live[(x[live] < self.n) & (y[live] < self.m)]
            live = live[self.a[x[live]] == self.b[y[live]]]
            x[live] += 1
            y[live] += 1
        x[~fits] = -1
        self.x[at] = x
        return k[fits], begin[fits], x[fits]


def middle(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, int]:
    """A run of equal lines, maybe an empty one, in the middle of a shortest script, as (x, y, x_end, y_end): where searches from both ends first meet."""
    n, m = len(a), len(b)
    there, back, skew = Front(a, b), Front(a[::-1], b[::-1]), n - m
    for d in range((n + m + 1) // 2 + 1):
        k, begin, end = there.step(d)
        if skew % 2:  # an odd number of edits: this search meets what the other reached with one less
            mirror = skew - k
            ok = (np.abs(mirror) <= d - 1) & (mirror >= -m) & (mirror <= n)
            far = np.where(ok, back.x[back.zero + np.where(ok, mirror, 0)], -1)
            met = np.flatnonzero(ok & (far >= 0) & (end + far >= n))
            if len(met):
                i = met[0]
                return int(begin[i]), int(begin[i] - k[i]), int(end[i]), int(end[i] - k[i])
        k, begin, end = back.step(d)
        if not skew % 2:
            mirror = skew - k
            ok = (np.abs(mirror) <= d) & (mirror >= -m) & (mirror <= n)
            far = np.where(ok, there.x[there.zero + np.where(ok, mirror, 0)], -1)
            met = np.flatnonzero(ok & (far >= 0) & (end + far >= n))
            if len(met):
                i = met[0]
                return int(n - end[i]), int(m - (end[i] - k[i])), int(n - begin[i]), int(m - (begin[i] - k[i]))
    raise AssertionError("searches from both ends meet")


def shortest_script(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries of a are deleted and which of b inserted, as few as can be. Rectangles between equal runs are split at their middle, so memory is linear."""
    gone, come = np.zeros(len(a), bool), np.zeros(len(b), bool)
    stack = [(0, len(a), 0, len(b))]
    while stack:
        i, j, k, l = stack.pop()
        same = min(j - i, l - k)
        head = a[i : i + same] != b[k : k + same]
        h = int(head.argmax()) if head.any() else same
        i, k, same = i + h, k + h, same - h
        tail = a[j - same : j][::-1] != b[l - same : l][::-1]
        t = int(tail.argmax()) if tail.any() else same
        j, l = j - t, l - t
        if i == j or k == l:
            gone[i:j] = come[k:l] = True
            continue
        x, y, x_end, y_end = middle(a[i:j], b[k:l])
        stack += [(i, i + x, k, k + y), (i + x_end, j, k + y_end, l)]
    return gone, come


def hunks(gone: np.ndarray, come: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Changed ranges i..j of the old and k..l of the new side, apart by lines that both have."""
    kept_a, kept_b = np.flatnonzero(~gone), np.flatnonzero(~come)
    ends = np.append(kept_a, len(gone)), np.append(kept_b, len(come))
    begins = np.append(-1, kept_a) + 1, np.append(-1, kept_b) + 1
    some = np.flatnonzero((ends[0] > begins[0]) | (ends[1] > begins[1]))
    return [tuple(int(x[s]) for x in (begins[0], ends[0], begins[1], ends[1])) for s in some]


def second_lines(before: str, after: str) -> dict:
    """Lines of `before` that a shortest script touches, white space and blank lines apart and comments like other lines: those deleted, and for what is only inserted the
    line before it, else the first."""
    old, new = ([(i, k) for i, line in enumerate(t.split("\n"), 1) if (k := "".join(line.split()))] for t in (before, after))
    gone, come = shortest_script(*interned([k for _, k in old], [k for _, k in new]))
    touched = set()
    for i, j, _, _ in hunks(gone, come):
        touched |= {n for n, _ in old[i:j]} if j > i else {old[max(0, i - 1)][0]} if old else set()
    return {"lines": sorted(touched), "n_deleted": int(gone.sum()), "n_inserted": int(come.sum())}


SECOND = T.StructType([T.StructField("lines", T.ArrayType(T.IntegerType())), T.StructField("n_deleted", T.IntegerType()), T.StructField("n_inserted", T.IntegerType())])


def second_change(before, after):
    """What second_lines() gives, as a struct; nulls count as empty texts."""

    @F.pandas_udf(SECOND)
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([second_lines(a or "", b or "") for a, b in zip(x, y, strict=True)], columns=["lines", "n_deleted", "n_inserted"])

    return run(before, after)


def code_line_numbers(before):
    """Numbers of the lines that are code: what is left of them without comments isn't blank. Comments that aren't closed are code."""

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([code_lines(t or "") for t in texts], dtype=object)

    return run(before)
