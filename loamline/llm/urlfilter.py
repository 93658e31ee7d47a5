"""URL rules by a cascade of Bloom filters that is exact on the corpus's own keys."""

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import free, small_batches

#: (verdict, host, path): a rule fits its host and all subdomains if the URL's path starts with its path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
LOWER = {c: c + 32 for c in range(65, 91)}
#: False keys that the first level may let through, at most so many times the listed keys, on average.
FALSE_SHARE = 0.5
#: Keys that are put into a level at once.
KEYS_AT_ONCE = 100_000


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path. The host stands after the first :// up to /, ? or #, with A-Z lower-cased; the path then up to ? or #. Else both are empty."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    ends = [i for c in "?#" if (i := rest.find(c)) >= 0]
    rest = rest[: min(ends)] if ends else rest
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return host.translate(LOWER), path


def keys_of(host: str, path: str, lengths: tuple[int, ...]) -> list[str]:
    """Every key that a rule for this URL could have: the host or a domain above it, with a start of the path that is as long as some rule's."""
    starts = [path[:n] for n in lengths if n <= len(path)]
    out, at = [], 0
    while starts and host:
        out += [host[at:] + s for s in starts]
        at = host.find(".", at) + 1
        if not at:
            break
    return out


def hashes(keys: list[str], level: int) -> tuple[np.ndarray, np.ndarray]:
    import xxhash

    raw = np.array([xxhash.xxh3_128_intdigest(k.encode("utf-8", "surrogatepass"), level) & ((1 << 128) - 1) for k in keys], dtype=object)
    low = np.array([int(x) & 0xFFFFFFFFFFFFFFFF for x in raw], np.uint64)
    return low, np.array([int(x) >> 64 for x in raw], np.uint64) | np.uint64(1)


@dataclass
class Bloom:
    bits: np.ndarray
    size: int
    n_hashes: int
    level: int

    @classmethod
    def of(cls, keys: list[str], rate: float, level: int) -> "Bloom":
        size = max(64, math.ceil(-len(keys) * math.log(rate) / math.log(2) ** 2))
        out = cls(np.zeros(-(-size // 8), np.uint8), size, max(1, round(-math.log2(rate))), level)
        for i in range(0, len(keys), KEYS_AT_ONCE):
            at = out.places(keys[i : i + KEYS_AT_ONCE]).ravel()
            np.bitwise_or.at(out.bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        return out

    def places(self, keys: list[str]) -> np.ndarray:
        low, high = hashes(keys, self.level)
        return (low[:, None] + high[:, None] * np.arange(self.n_hashes, dtype=np.uint64)) % np.uint64(self.size)

    def holds(self, keys: list[str]) -> np.ndarray:
        if not keys:
            return np.zeros(0, bool)
        at = self.places(keys)
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool).all(1)


def holds(levels: list[Bloom], keys: list[str]) -> np.ndarray:
    """Membership by the cascade: the first level that lacks a key decides; an odd number of levels that hold it means that it is listed."""
    depth, live = np.zeros(len(keys), np.int64), np.arange(len(keys))
    for level in levels:
        live = live[level.holds([keys[i] for i in live])] if len(live) else live
        depth[live] += 1
    return depth % 2 == 1


def fit_cascades(universe: DataFrame, lists: dict[str, list[str]], lengths: tuple[int, ...], url: str = "url") -> dict[str, list[Bloom]]:
    """For each list the levels that tell its keys from every other key of the corpus.

    Lists are rule lists that the driver holds. One pass over the corpus counts its keys (repeats counted, an upper bound) and sets the
    first levels' rates so that the false keys that each lets through are about as many as the listed ones; a second pass finds these,
    each once, for all lists. Further levels need no pass: each encodes what of one side the levels before let through, until nothing is left.
    """
    small_batches(universe.sparkSession)

    def count(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(keys_of(*split_url(u), lengths)) for u in batch.column(url).to_pylist())], pa.int64())], names=["n"])

    urls = universe.select(url)
    n = urls.mapInArrow(count, "n long").groupBy().sum("n").first()[0] or 0
    first = {name: Bloom.of(listed, min(0.5, max(1e-9, FALSE_SHARE * max(1, len(listed)) / max(1, n))), 0) for name, listed in lists.items()}
    sent = universe.sparkSession.sparkContext.broadcast((first, {name: frozenset(listed) for name, listed in lists.items()}))

    def false_keys(batches):
        levels, known = sent.value
        for batch in batches:
            keys = sorted({k for u in batch.column(url).to_pylist() for k in keys_of(*split_url(u), lengths)})
            for name, level in levels.items():
                own = [k for k, x in zip(keys, level.holds(keys), strict=True) if x and k not in known[name]]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(own), pa.string()), pa.array(own, pa.string())], names=["name", "k"])

    passed: dict[str, list[str]] = {name: [] for name in lists}
    for r in urls.mapInArrow(false_keys, "name string, k string").distinct().collect():  # about as many as are listed
        passed[r["name"]].append(r["k"])
    out = {}
    for name, listed in lists.items():
        levels, sides = [first[name]], (sorted(passed[name]), list(listed))
        while sides[0]:
            level = Bloom.of(sides[0], 0.3, len(levels))
            levels.append(level)
            sides = ([k for k, x in zip(sides[1], level.holds(sides[1]), strict=True) if x], sides[0])
            if len(levels) > 200:
                raise ValueError("the cascade doesn't end")
        out[name] = levels
    return out


def fit_cascade(universe: DataFrame, listed: list[str], lengths: tuple[int, ...], url: str = "url") -> list[Bloom]:
    """The levels of one list."""
    return fit_cascades(universe, {"": listed}, lengths, url)[""]


def judged(pages: DataFrame, rules=RULES, default: str = "allow", keep: tuple[str, ...] = ("page_id",), url: str = "url") -> DataFrame:
    """Adds host, path, rule and verdict to the columns `keep` of every row; a kept column of such a name stays, and what is added gets underscores before its name.

    Two cascades, of the allowed and the blocked keys, decide which of a URL's keys are listed; of these the longest is its rule. A URL
    without a listed key, also a null one or one without ://, has no rule and the default verdict. A key listed twice has its last verdict.
    """
    spark, added = pages.sparkSession, free(list(keep), "host", "path", "rule", "verdict")
    verdicts = {h + p: v for v, h, p in rules}
    lengths = tuple(sorted({len(p) for _, _, p in rules}))
    cascades = fit_cascades(pages, {v: sorted(k for k, x in verdicts.items() if x == v) for v in ("allow", "block")}, lengths, url)
    sent = spark.sparkContext.broadcast(cascades)

    def judge(batches):
        for batch in batches:
            parts = [split_url(u) for u in batch.column(url).to_pylist()]
            keys = [keys_of(h, p, lengths) for h, p in parts]
            flat = list(dict.fromkeys(k for ks in keys for k in ks))
            found = {}
            for verdict, levels in sent.value.items():
                found |= {k: verdict for k, x in zip(flat, holds(levels, flat), strict=True) if x}
            best = [max((k for k in ks if k in found), key=len, default=None) for ks in keys]
            columns = [pa.array(x, pa.string()) for x in ([h for h, _ in parts], [p for _, p in parts], best, [found.get(k, default) for k in best])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns], names=[*keep, *added])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return pages.select(*dict.fromkeys([*keep, url])).mapInArrow(judge, "".join(f"`{c}` {kinds[c]}, " for c in keep) + ", ".join(f"`{c}` string" for c in added))


def op9_urlfilter(spark, sf_dir):
    """Every page; a null url has neither host nor path and the verdict allow. Repeated rows are judged each; columns of other names aren't read."""
    from .shared import table

    return judged(table(spark, sf_dir, "pages"))


OP9_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS r FROM pages),
s AS (SELECT page_id, coalesce(translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
l(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (SELECT s.*, l.verdict, l.h || l.p AS rule, row_number() OVER (PARTITION BY page_id ORDER BY length(l.h || l.p) DESC) AS nth
      FROM s LEFT JOIN l ON (s.host = l.h OR suffix(s.host, '.' || l.h)) AND starts_with(s.path, l.p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE nth = 1
"""
