"""Personal data: fixed patterns as seeds, and contexts learned from them that find further identifiers."""

import re
from bisect import bisect_left
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, written
from .words import Words, byte_table, mixed, words

KINDS = ("email", "ip", "card", "phone")
AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can begin inside a run of digits only where one began at the run's start, so the lookbehind changes no result.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Texts that look like an identifier of a kind without being one by the fixed patterns; which kind, their digits say.
LIKE_EMAIL = re.compile(r"(?: ?\(at\) ?| ?\[at\] ?| at |@)[A-Za-z0-9-]++(?:(?:\.| dot | ?\[dot\] ?)[A-Za-z0-9-]++)+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LIKE_NUMBER = re.compile(r"(?<![A-Za-z0-9])[(]?[0-9](?:[\x20().-]{0,2}[0-9])*+(?![A-Za-z0-9])")
LIKE_IP = re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}(?![0-9A-Fa-f:])")
#: Rounds of scoring; the least score of a pattern and of an instance; distinct seeds that a pattern needs; share of a pattern's
#: occurrences in the corpus that an identifier of its kind must follow.
ROUNDS, SURE, SEEDS, FOLLOWED = 3, 0.8, 5, 0.6
#: Patterns, of 8 bytes each, whose occurrences one pass over the corpus counts.
PASS_PATTERNS = 500_000
#: Tasks among which the look-alikes of one pattern are dealt.
SALTS = 32

_NINES = byte_table(lambda c: c != 32 and not 9 <= c <= 13, c9="0123456789")


def emails(t: str) -> list[tuple[int, int]]:
    out, end = [], 0
    for m in AT.finditer(t) if "@" in t else ():
        a = m.start()
        while a > end and t[a - 1] in LOCAL:
            a -= 1
        if a < m.start():
            out.append((a, m.end()))
            end = m.end()
    return out


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(number: str) -> bool:
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(number))) % 10 == 0


def base_spans(t: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind; matches of each kind are the leftmost that don't overlap, and failing ones are dropped."""
    out = [(a, b, 0) for a, b in emails(t)]
    out += [(m.start(), m.end(), 1) for m in IP.finditer(t) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(t):
        if m.end() - m.start() >= 14 and 14 <= len(n := digits(m[0])) <= 19 and luhn(n):
            out.append((m.start(), m.end(), 2))
    out += [(m.start(), m.end(), 3) for m in PHONE.finditer(t) if 10 <= len(digits(m[0])) <= 15] if "+" in t else []
    return [(a, b, KINDS[k]) for a, b, k in sorted(out, key=lambda s: (s[0], s[2]))]


def lookalikes(t: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans that look like identifiers, apart from those taken and from one another."""
    found, end = [], 0
    for m in LIKE_EMAIL.finditer(t) if "@" in t or "at" in t else ():
        a = m.start()
        while a > end and t[a - 1] in LOCAL:
            a -= 1
        if a < m.start():
            found.append((a, m.end(), "email"))
        end = m.end()
    if ":" in t:
        found += [(m.start(), m.end(), "ip") for m in LIKE_IP.finditer(t)]
    for m in LIKE_NUMBER.finditer(t):
        if m.end() - m.start() >= 7 and 7 <= (n := len(digits(m[0]))) <= 19:
            found.append((m.start(), m.end(), "phone" if n <= 13 else "card"))
    out, used = [], sorted((a, b) for a, b, _ in taken)
    begins, reach = [a for a, _ in used], [0, *accumulate((b for _, b in used), max)]
    for a, b, k in sorted(found):
        if reach[bisect_left(begins, b)] <= a and not (out and a < out[-1][1]):  # of the taken ones that begin before its end, none ends after its start
            out.append((a, b, k))
    return out


def pairs(w: Words) -> np.ndarray:
    """A hash for each two neighbouring words, A-Z lower-cased and digits made 9."""
    return mixed(w.hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + w.hashes[1:])


def contexts(t: str, places: list[int], hashes: np.ndarray) -> list[int | None]:
    """Of each place the pattern before it: the hash of the last two whole words that end before it, or before the word in which it stands; None with fewer.

    hashes: pairs() of the text's own words.
    """
    if not places:
        return []
    begins, ends = [], []
    for m in WORD.finditer(t):
        begins.append(m.start())
        ends.append(m.end())
    out = []
    for at in places:
        whole = bisect_left(begins, at)  # words that begin before it
        whole -= bool(whole and ends[whole - 1] > at)
        out.append(int(hashes[whole - 2].astype(np.int64)) if whole >= 2 else None)
    return out


SPAN = "array<struct<kind:string,start:int,end:int,pattern:long,instance:string>>"


def found_spans(docs: DataFrame, keep: list[str]) -> DataFrame:
    """One pass over whole texts: base and look-alike spans of each row, with their contexts. A written table; _row tells rows apart."""
    small_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("pattern", pa.int64()), ("instance", pa.string())]))

    def find(batches):
        for batch in batches:
            base, like, texts = [], [], batch.column("text").to_pylist()
            for w in words(batch.column("text"), _NINES):
                hashes = pairs(w) if len(w.hashes) > 1 else np.zeros(0, np.uint64)
                for d in range(w.n):
                    t = texts[w.first + d] or ""
                    b = base_spans(t)
                    both = [b, lookalikes(t, b)]
                    at = contexts(t, [s[0] for x in both for s in x], hashes[w.at[d] : max(w.at[d], w.at[d + 1] - 1)])
                    for x, out in zip(both, (base, like), strict=True):
                        out.append([{"kind": s[2], "start": s[0], "end": s[1], "pattern": p, "instance": t[s[0] : s[1]].lower()} for s, p in zip(x, at, strict=False)])
                        at = at[len(x) :]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(base, kind), pa.array(like, kind)], names=[*keep, "base", "like"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    out = docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(find, "".join(f"`{c}` {kinds[c]}, " for c in keep) + f"base {SPAN}, like {SPAN}")
    return written(out.withColumn("_row", F.monotonically_increasing_id()), "pii")


def pattern_scores(spans: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Scores of (pattern, kind) from the graph of patterns and instances.

    Base spans have score 1 for their kind; look-alikes begin at 0, and those with a score of SURE or more are seeds of the next round like base spans,
    so that what a sure pattern has found induces patterns of its own. A pattern's score for a kind is the weight of its instances of that kind by
    their scores, over that weight, plus all base spans of other kinds, plus a tenth of what is unknown; times seeds / (seeds + 1), seeds being
    its distinct instances that are sure. A look-alike's score is the noisy-or of its patterns. Edges are counts, so a hot pattern or
    instance is combined before it is moved.
    """
    edge = lambda c, seed: spans.select(F.explode(c).alias("s")).where("s.pattern is not null").select("s.pattern", "s.kind", "s.instance", F.lit(seed).alias("seed"))
    edges = written(edge("base", 1).union(edge("like", 0)).groupBy("pattern", "kind", "instance", "seed").agg(F.count("*").alias("n")), "pii-edges")
    others = edges.where("seed = 1").groupBy("pattern").agg(F.sum("n").alias("all_seeds"))
    instance = edges.where("seed = 0").select("kind", "instance").distinct().withColumn("r", F.lit(0.0))
    scores = None
    for _ in range(rounds):
        known = edges.join(instance, ["kind", "instance"], "left").withColumn("r", F.when(F.col("seed") == 1, 1.0).otherwise(F.coalesce("r", F.lit(0.0))))
        sure = (F.col("r") >= SURE).cast("long")
        scores = known.groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.col("r")).alias("pos"), F.sum(F.col("n") * (1 - F.col("r"))).alias("unknown"), F.sum(F.when(F.col("seed") == 1, F.col("n")).otherwise(0)).alias("own"), F.sum(sure).alias("seeds"), F.sum("n").alias("n"))
        foreign = F.coalesce("all_seeds", F.lit(0)) - F.col("own")
        scores = scores.where("seeds > 0").join(others, "pattern", "left").withColumn("score", F.col("pos") / (F.col("pos") + foreign + 0.1 * F.col("unknown")) * F.col("seeds") / (F.col("seeds") + 1))
        scores = written(scores.select("pattern", "kind", "score", "seeds", "n"), "pii-patterns")
        instance = edges.where("seed = 0").join(scores, ["pattern", "kind"]).groupBy("kind", "instance").agg((1 - F.exp(F.sum(F.log(1 - F.least("score", F.lit(0.999)))))).alias("r"))
    return scores


def occurrences(docs: DataFrame, patterns: np.ndarray) -> DataFrame:
    """How often each pattern's two words follow each other in all texts. patterns: hashes, signed."""
    sent = docs.sparkSession.sparkContext.broadcast(np.sort(patterns.astype(np.uint64)))

    def count(batches):
        for batch in batches:
            keys = sent.value
            total = np.zeros(len(keys), np.int64)
            for w in words(batch.column("text"), _NINES):
                if len(w.hashes) < 2:
                    continue
                h = pairs(w)
                last = w.at[1:-1]
                inside = np.ones(len(h), bool)
                inside[last[(last > 0) & (last <= len(h))] - 1] = False
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                total += np.bincount(at[(keys[at] == h) & inside], minlength=len(keys))
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(keys[some].astype(np.int64)), pa.array(total[some])], names=["pattern", "times"])

    return docs.select("text").mapInArrow(count, "pattern long, times long").groupBy("pattern").agg(F.sum("times").alias("times"))


def sure_patterns(docs: DataFrame, spans: DataFrame) -> DataFrame | None:
    """Patterns (pattern, kind) with a high score, enough seeds, and few occurrences that no identifier of the kind follows; None if there are none.

    Only patterns with look-alikes to find are of use. Their occurrences are counted over all texts, so many patterns in a pass.
    """
    scores = pattern_scores(spans)
    useful = spans.select(F.explode("like").alias("s")).select("s.pattern", "s.kind").where("pattern is not null").distinct()
    good = written(scores.where((F.col("score") >= SURE) & (F.col("seeds") >= SEEDS)).join(useful, ["pattern", "kind"], "left_semi"), "pii-good")
    n = good.count()
    if not n:
        return None
    parts = -(-n // PASS_PATTERNS)
    counted = []
    for i in range(parts):
        some = good.select("pattern").distinct().where(F.pmod(F.xxhash64("pattern"), F.lit(parts)) == i).toArrow().column("pattern").to_numpy()
        counted += [occurrences(docs, some)] if len(some) else []
    times = reduce(DataFrame.union, counted)
    return written(good.join(times, "pattern", "left").where(F.col("n") >= FOLLOWED * F.coalesce("times", F.lit(0))).select("pattern", "kind"), "pii-sure")


def personal_data(docs: DataFrame, keep: list[str]) -> DataFrame:
    """docs (text, and the columns `keep`). Adds base and spans: arrays of (kind, start, end) in code points, by start, then kind as listed.

    base has the matches of the fixed patterns; spans adds the look-alikes that a sure pattern precedes. Null and empty texts have none.
    """
    found = found_spans(docs, keep)
    sure = sure_patterns(docs, found)
    bare = lambda c: F.transform(c, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    out = found.withColumn("spans", bare("base"))
    if sure is not None:
        salt = F.pmod(F.xxhash64("_row"), F.lit(SALTS))  # a context that much of the corpus shares is met in SALTS tasks
        like = found.select("_row", F.explode("like").alias("s")).select("_row", "s.*", salt.alias("salt"))
        more = like.join(sure.select("pattern", "kind", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")), ["pattern", "kind", "salt"])
        more = more.groupBy("_row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more"))
        place = lambda s: F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"])
        keyed = F.transform(F.concat("spans", F.coalesce("more", F.array().cast("array<struct<kind:string,start:int,end:int>>"))), lambda s: F.struct(s["start"].alias("start"), place(s).alias("nth"), s["end"].alias("end"), s["kind"].alias("kind")))
        out = out.join(more, "_row", "left").withColumn("spans", F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    return out.select(*keep, bare("base").alias("base"), "spans")


def redacted(text, spans):
    """The text with every span replaced by its kind in brackets, as a column; spans that overlap an earlier one are left out."""
    step = lambda acc, s: F.when(
        s["start"] >= acc["at"], F.struct(F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]")).alias("out"), s["end"].alias("at"))
    ).otherwise(acc)
    return F.aggregate(spans, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def listed(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_pii(spark, sf_dir):
    """Every whole text of documents."""
    from .shared import table

    out = personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == F.lit(k)))
    counts = [of(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
