"""Question banks: options and their order, admission of proposed distractors, items, near misses, baselines and invariants."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import code as S
from ..functions import diff as D
from ..functions import text as T
from ..functions import verify as V
from ..functions.rank import rank_hex, rank_mod
from . import checks as C
from .graph import kept, stored
from .sampling import weighted_draw

LETTERS = "ABCD"


def layout(rows: DataFrame, key: str, gold: str, others: str, letter_salt: str, slot_salt: str) -> DataFrame:
    """Adds options, an array of (letter, cwe) from A to D, and gold_letter: the rank of the key says which letter the gold gets; the three others fill the
    rest in the order of their ranks."""
    at = (rank_mod(4, F.col(key), letter_salt) + 1).cast("int")
    rest = F.array_sort(F.transform(others, lambda c: F.struct(rank_hex(F.col(key), slot_salt, c).alias("r"), c.alias("c"))))
    rest = F.transform(rest, lambda x: x["c"])
    line = F.concat(F.slice(rest, F.lit(1), F.col("_at") - 1), F.array(F.col(gold)), F.slice(rest, F.col("_at"), F.lit(4)))
    out = rows.withColumn("_at", at)
    out = out.withColumn("options", F.transform(line, lambda c, i: F.struct(F.substring(F.lit(LETTERS), i + 1, F.lit(1)).alias("letter"), c.alias("cwe"))))
    return out.withColumn("gold_letter", F.substring(F.lit(LETTERS), F.col("_at"), F.lit(1))).drop("_at")


def judged_proposals(rows: DataFrame, key: str, gold: str, proposals: str, pattern: str, canonical, live: DataFrame, above: DataFrame, taken: str | None = None) -> DataFrame:
    """(key, pos, raw, value, reason) for each proposal of a row; reason is the first of malformed, gold, not_live, ancestor, descendant, duplicate, or null.

    pattern: what a trimmed, upper-cased proposal must match; canonical: a column of it to the value. live (id), above (node, ancestor). duplicate:
    one with an earlier place was admitted, or it is in the array `taken`.
    """
    each = rows.select(key, gold, *([taken] if taken else []), F.posexplode(proposals).alias("pos", "raw"))
    shown = F.upper(F.regexp_replace("raw", r"(?U)\A\s+|\s+\z", ""))
    each = each.withColumn("value", F.when(shown.rlike(pattern), canonical(shown)))
    flag = lambda df, a, b, name: df.select(F.col(a).alias("value"), F.col(b).alias(gold), F.lit(True).alias(name)).distinct()
    each = each.join(live.select(F.col("id").alias("value"), F.lit(True).alias("_live")).distinct(), "value", "left")
    each = each.join(flag(above, "ancestor", "node", "_up"), ["value", gold], "left").join(flag(above, "node", "ancestor", "_down"), ["value", gold], "left")
    first = F.when(F.col("value").isNull(), "malformed").when(F.col("value") == F.col(gold), "gold").when(F.col("_live").isNull(), "not_live").when(F.col("_up"), "ancestor").when(F.col("_down"), "descendant")
    each = each.withColumn("_why", first)
    before = F.row_number().over(Window.partitionBy(key, "value", F.col("_why").isNull()).orderBy("pos")) > 1
    again = before | F.array_contains(taken, F.col("value")) if taken else before
    return each.withColumn("reason", F.coalesce("_why", F.when(again, "duplicate"))).select(key, "pos", "raw", "value", "reason")


def relatives(golds: DataFrame, gold: str, above: DataFrame, counts: DataFrame) -> DataFrame:
    """(gold, item): of each gold itself, its ancestors and its descendants, which are no distractors for it, those that could be drawn: the items of counts."""
    g = golds.select(gold).distinct()
    up = g.join(above.select(F.col("node").alias(gold), F.col("ancestor").alias("item")), gold)
    down = g.join(above.select(F.col("ancestor").alias(gold), F.col("node").alias("item")), gold)
    every = g.select(gold, F.col(gold).alias("item")).union(up.select(gold, "item")).union(down.select(gold, "item")).distinct()
    return kept(every.join(counts.select("item").distinct(), "item", "left_semi").select(gold, "item"))


def drawn_distractors(rows: DataFrame, key: str, gold: str, counts: DataFrame, above: DataFrame, k: int, salt: str) -> DataFrame:
    """(key, drawn): k labels of counts (item, w) for each row, drawn by weight without replacement from those that aren't relatives of its gold."""
    banned = rows.select(key, gold).join(relatives(rows, gold, above, counts), gold).select(key, "item")
    return weighted_draw(rows.select(key), key, counts, "item", "w", k, salt, banned)


def decided_distractors(rows: DataFrame, key: str, gold: str, attempts: list[tuple[str, DataFrame]], counts: DataFrame, above: DataFrame, k: int, salt: str) -> DataFrame:
    """(key, distractors, sources): the first k admitted proposals (key, pos, value) of the attempts in order, each with its attempt's name, and what is
    still missing drawn by weight, slots numbered from how many there are."""
    parts = [a.select(key, F.lit(i).alias("o"), "pos", "value", F.lit(name).alias("source")) for i, (name, a) in enumerate(attempts)]
    each = parts[0]
    for p in parts[1:]:
        each = each.union(p)
    once = each.groupBy(key, "value").agg(F.min(F.struct("o", "pos", "source")).alias("x"))
    at = F.row_number().over(Window.partitionBy(key).orderBy("x.o", "x.pos"))
    chosen = once.withColumn("at", at).where(F.col("at") <= k)
    line = F.array_sort(F.collect_list(F.struct("at", "value", F.col("x.source").alias("source"))))
    have = rows.select(key, gold).join(chosen.groupBy(key).agg(line.alias("line")), key, "left")
    have = have.withColumn("line", F.coalesce("line", F.array().cast(f"array<struct<at:int,value:{dict(once.dtypes)['value']},source:string>>"))).withColumn("n", F.size("line"))
    banned = rows.select(key, gold).join(relatives(rows, gold, above, counts), gold).select(key, "item").union(chosen.select(key, F.col("value").alias("item")))
    out = weighted_draw(have, key, counts, "item", "w", k, salt, banned, F.col("n"))
    more = F.slice("drawn", F.lit(1), k - F.col("n"))
    return out.select(key, F.concat(F.transform("line", lambda x: x["value"]), more).alias("distractors"), F.concat(F.transform("line", lambda x: x["source"]), F.transform(more, lambda _: F.lit("draw"))).alias("sources"))


def six_items(facts: DataFrame, key: str, prompts: dict[str, str], system: str) -> DataFrame:
    """Six rows for each fact (mcq, exact_id, cvss, find_error 0 and 1, line_loc 0): item_id, type, index, user, prompt, target, gold.

    facts: key, cwe, vector, description, vuln, patched, lines (array), n_lines, options, gold_letter. Prompts are templates with {description},
    {options}, {function} and {numbered}. The row's own id and literal label ids are redacted; gold is one nullable struct for all types.
    """
    desc = T.redact_own(T.redact_ids(F.col("description"), "CWE"), F.col(key), "CVE-[redacted]")
    vuln, patched = (T.redact_own(F.col(c), F.col(key), "CVE-[redacted]") for c in ("vuln", "patched"))
    options = F.array_join(F.transform("options", lambda o: F.concat(o["letter"], F.lit(". "), o["cwe"])), "\n")
    lines = F.concat(F.lit("LINES: "), F.when(F.size("lines") > 0, F.array_join(F.transform("lines", lambda x: x.cast("string")), ", ")).otherwise("none"))
    null = {"letter": "string", "cwe": "string", "options": "array<struct<letter:string,cwe:string>>", "vector": "string", "vulnerable": "boolean", "lines": "array<int>", "n_lines": "int"}

    def fill(template: str, **fields: Column) -> Column:
        parts, rest = [], template
        while rest:
            at = [(rest.index("{" + k + "}"), k) for k in fields if "{" + k + "}" in rest]
            if not at:
                parts.append(F.lit(rest))
                break
            i, k = min(at)
            parts += [F.lit(rest[:i]), fields[k]]
            rest = rest[i + len(k) + 2 :]
        return F.concat(*parts)

    def item(kind: str, index: int, user: Column, target: Column, **gold: Column) -> Column:
        g = F.struct(*[(gold[k] if k in gold else F.lit(None)).cast(t).alias(k) for k, t in null.items()])
        return F.struct(F.concat_ws(":", F.col(key), F.lit(kind), F.lit(str(index))).alias("item_id"), F.lit(kind).alias("type"), F.lit(index).alias("index"), user.alias("user"), T.chat(system, user).alias("prompt"), target.alias("target"), g.alias("gold"))

    cwe = F.col("cwe")
    return facts.select(key, F.inline(F.array(
        item("mcq", 0, fill(prompts["mcq"], description=desc, options=options), F.concat(F.lit("ANSWER: "), F.col("gold_letter")), letter=F.col("gold_letter"), cwe=cwe, options=F.col("options")),
        item("exact_id", 0, fill(prompts["exact_id"], description=desc), cwe, cwe=cwe),
        item("cvss", 0, fill(prompts["cvss"], description=desc), F.col("vector"), vector=F.col("vector")),
        item("find_error", 0, fill(prompts["find_error"], function=vuln), F.concat(F.lit("VULNERABLE: yes, "), cwe), vulnerable=F.lit(True), cwe=cwe),
        item("find_error", 1, fill(prompts["find_error"], function=patched), F.lit("VULNERABLE: no"), vulnerable=F.lit(False), cwe=cwe),
        item("line_loc", 0, fill(prompts["line_loc"], description=desc, numbered=T.numbered(vuln)), lines, lines=F.col("lines"), n_lines=F.col("n_lines")),
    )))


def template_hash(prompts: dict[str, str], *more: str) -> str:
    """One hash of all templates and constants that a bank is made with."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps([sorted(prompts.items()), list(more)], ensure_ascii=False).encode()).hexdigest()


def item_violations(items: DataFrame, key: str, system: str, verdicts: DataFrame | None = None) -> DataFrame:
    """Invariants of a bank: (check, key, message). Ids are unique and made of their fields, prompts are the rendering of user, six items a row, no prompt names its own id or, outside the
    options, its label; with verdicts (item_id, v) of the items' own targets, each target is strict and scores 1."""
    outside = F.array_join(F.filter(F.split("user", "\n"), lambda l: ~l.rlike(r"\A[A-D]\. ")), "\n")
    own = lambda text, c, tail: F.regexp_like(text, F.concat(F.lit(r"(?i)(?<![A-Za-z0-9])\Q"), c, F.lit(r"\E" + tail)))
    checks = {
        "id of its fields": F.col("item_id") == F.concat_ws(":", F.col(key), "type", F.col("index").cast("string")),
        "prompt rendered": F.col("prompt") == T.chat(system, F.col("user")),
        "no own id": ~own(F.col("user"), F.col(key), r"(?!\d)"),
        "no gold label": F.col("gold.cwe").isNull() | ~own(outside, F.col("gold.cwe"), r"(?!\d)"),
    }
    parts = [C.row_checks(items, "item_id", checks), C.unique(items, "item_id")]
    parts.append(items.groupBy(key).count().where("count <> 6").select(F.lit("six items").alias("check"), F.col(key).cast("string").alias("key"), F.concat(F.col("count").cast("string"), F.lit(" items")).alias("message")))
    if verdicts is not None:
        parts.append(target_violations(items.select("item_id").join(verdicts, "item_id", "left")))
    return C.together(parts)


def own_verdicts(items: DataFrame, reply: Column, gold: Column, credits: Column) -> DataFrame:
    """(item_id, v): verdicts of the items' own targets. items (item_id, type, target, gold); reply, gold and credits: columns of type, target and gold, as verify.verdict() takes them.

    A verdict depends on type, target and gold alone, and takes far longer than a read: so those that are equal are judged once. What it reads often is stored first, else it is
    computed wherever it is named.
    """
    keys = ["type", "target", "gold"]
    read = stored(items.select(*keys).distinct().select(*keys, reply.alias("_reply"), gold.alias("_full"), credits.alias("_credits")))
    told = stored(read.select(*[F.col(k).alias(f"_{k}") for k in keys], V.verdict(F.col("type"), F.col("_reply"), F.col("_full"), F.col("_credits")).alias("v")))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return items.join(told, same).select("item_id", "v")


def target_violations(judged: DataFrame) -> DataFrame:
    """judged (item_id, v): verdicts of items' own targets. Those that aren't strict or don't score 1: (check, key, message)."""
    full = F.col("v.strict_ok") & (F.col("v.metric.n") == F.col("v.metric.d")) & (F.col("v.dense.n") == F.col("v.dense.d"))
    return C.row_checks(judged, "item_id", {"own target scores 1": full})


# Near misses.

FAR = 2


def vector_near_miss(key: Column, vector: Column, salt: str) -> Column:
    """A vector (a map) with one component changed: of all changes the one with the lowest rank of (key, salt, 'K:V')."""
    all_ = F.array(*[F.struct(rank_hex(key, salt, f"{k}:{v}").alias("r"), F.lit(f"{k}:{v}").alias("part"), F.lit(k).alias("k"), F.lit(v).alias("v")) for k, vs in T.VECTOR.items() for v in vs])
    best = F.array_min(F.filter(all_, lambda c: F.try_element_at(vector, c["k"]) != c["v"]))
    changed = [F.when(best["k"] == k, best["v"]).otherwise(F.try_element_at(vector, F.lit(k))) for k in T.VECTOR]
    return F.concat_ws("/", *[F.concat(F.lit(f"{k}:"), c) for k, c in zip(T.VECTOR, changed, strict=True)])


def line_near_miss(key: Column, gold: Column, code: Column, salt: str) -> Column:
    """Line numbers near the gold ones: without the lowest-ranked, if there are two or more; else the nearest code line at least 2 away, the lower rank of two."""
    ranked = lambda xs: F.transform(xs, lambda x: F.struct(rank_hex(key, salt, x).alias("r"), x.alias("x")))
    less = F.filter(gold, lambda x: x != F.array_min(ranked(gold))["x"])
    g = F.try_element_at(gold, F.lit(1))
    far = F.transform(F.filter(code, lambda x: F.abs(x - g) >= FAR), lambda x: F.struct(F.abs(x - g).alias("d"), rank_hex(key, salt, x).alias("r"), x.alias("x")))
    return F.when(F.size(gold) >= 2, less).when(F.size(gold) == 1, F.array(F.array_min(far)["x"]))


def vector_miss_reason(proposed: Column, gold: Column) -> Column:
    """Why a proposed vector (a map, or null) isn't one component off the gold: malformed, gold, not_one_component; null if it is."""
    off = sum(F.coalesce((F.try_element_at(proposed, F.lit(k)) != F.try_element_at(gold, F.lit(k))).cast("int"), F.lit(0)) for k in T.VECTOR)
    return F.when(proposed.isNull(), "malformed").when(off == 0, "gold").when(off != 1, "not_one_component")


def line_miss_reason(proposed: Column, gold: Column, n_lines: Column, code: Column) -> Column:
    """Why proposed lines aren't one change off the gold: gold, out_of_range, not_one_change, single_line_drop, too_close, not_code_line; null if they are."""
    p, g = F.array_distinct(proposed), F.array_distinct(gold)
    gone, come = F.array_except(g, p), F.array_except(p, g)
    x, y = F.try_element_at(come, F.lit(1)), F.try_element_at(gone, F.lit(1))
    return (
        F.when((F.size(gone) == 0) & (F.size(come) == 0), "gold").when(F.exists(p, lambda v: (v < 1) | (v > n_lines)), "out_of_range")
        .when((F.size(gone) != 1) | (F.size(come) > 1), "not_one_change").when((F.size(come) == 0) & (F.size(g) < 2), "single_line_drop")
        .when((F.size(come) == 1) & (F.abs(x - y) < FAR), "too_close").when((F.size(come) == 1) & ~F.array_contains(code, x), "not_code_line")
    )


def id_miss_reason(rows: DataFrame, key: str, proposed: str, gold: str, neighbours: DataFrame) -> DataFrame:
    """(key, reason): gold, not_one_hop, or null for a proposed id that is a parent or child of the gold."""
    near = neighbours.select(F.col("node").alias(gold), F.col("other").alias(proposed), F.lit(True).alias("_near")).distinct()
    out = rows.join(near, [gold, proposed], "left")
    return out.select(key, F.when(F.col(proposed) == F.col(gold), "gold").when(F.col("_near").isNull(), "not_one_hop").alias("reason"))


def nearest_option(options: DataFrame, key: str, option: str, gold: str, pos: str, distances: DataFrame) -> DataFrame:
    """(key, option): of each row's options the one nearest to its gold by distances (node, other, distance); unreachable ones last, ties to the earlier."""
    d = distances.select(F.col("node").alias(gold), F.col("other").alias(option), "distance")
    far = F.coalesce("distance", F.lit(1 << 30))
    return options.join(d, [gold, option], "left").groupBy(key).agg(F.min_by(option, F.struct(far, F.col(pos))).alias(option))


# Baselines: constant replies.


def every_kth(n_lines: Column, k: int) -> Column:
    return F.concat(F.lit("LINES: "), F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n_lines, F.lit(1)), F.lit(k)), lambda x: x.cast("string")), ", "))


def keyword_lines(source: Column, keywords: tuple[str, ...]) -> Column:
    """A reply that names the lines with any of some keywords."""
    hit = lambda l: F.exists(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(l, k))
    found = F.filter(F.transform(T.lines(source), lambda l, i: F.when(hit(l), i + 1)), lambda x: x.isNotNull())
    return F.concat(F.lit("LINES: "), F.when(F.size(found) > 0, F.array_join(F.transform(found, lambda x: x.cast("string")), ", ")).otherwise("none"))


def baselines(items: DataFrame, replies: dict[str, tuple[str, Column]], unit: str, credits: Column) -> DataFrame:
    """(baseline, type, n, metric, dense, paired): mean scores of a reply that is a column of the item, by the verifiers. items: type, gold, the unit's key.
    replies: of each baseline the type and the reply. paired: share of units all of whose items are right."""
    each = items.select(unit, "type", "gold", F.explode(F.array(*[F.struct(F.lit(n).alias("baseline"), F.lit(t).alias("of"), r.alias("reply")) for n, (t, r) in replies.items()])).alias("b")).where("b.of = type")
    judged = each.withColumn("v", V.verdict(F.col("type"), F.col("b.reply"), F.col("gold"), credits))
    share = lambda c: F.col(f"v.{c}.n") / F.col(f"v.{c}.d")
    per = judged.select(F.col("b.baseline").alias("baseline"), "type", unit, share("metric").alias("m"), share("dense").alias("d")).groupBy("baseline", "type", unit).agg(F.count("*").alias("n"), F.sum("m").alias("m"), F.sum("d").alias("d"), F.min("m").alias("least"))
    return per.groupBy("baseline", "type").agg(F.sum("n").alias("n"), (F.sum("m") / F.sum("n")).alias("metric"), (F.sum("d") / F.sum("n")).alias("dense"), F.avg((F.col("least") == 1).cast("double")).alias("paired"))


def agreement_class(ours: Column, theirs: Column, code: Column, replaced: Column) -> Column:
    """How two diffs' line sets differ: agree, comment_lines_only (equal on code lines), insertion_anchor_only (only lines that anchor an insertion differ), other_alignment."""
    on_code = F.array_intersect(theirs, code)
    same = lambda a, b: (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)
    anchors = F.array_except(ours, replaced)
    return F.when(same(theirs, ours), "agree").when(same(on_code, ours), "comment_lines_only").when(F.size(F.array_except(F.array_except(ours, on_code), anchors)) == 0, "insertion_anchor_only").otherwise("other_alignment")


def line_agreement(pairs: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """(key, ours, theirs, class, f1): of each pair of texts the lines that the first diff and an independent one say were changed, how they differ, and the F1 of the second's code
    lines against the first's (0 where the second has none). Nulls are empty texts."""
    ours = S.line_change(before, after)
    found = pairs.select(key, ours.alias("o"), D.second_change(before, after).alias("t"), D.code_line_numbers(before).alias("code"), S.line_edits(before, after).alias("e"))
    replaced = F.flatten(F.transform("e", lambda c: c["old"]))
    on_code = F.array_intersect("t.lines", "code")
    hits = F.size(F.array_intersect(on_code, F.col("o.lines")))
    f1 = F.when(hits == 0, 0.0).otherwise(2.0 * hits / (F.size(on_code) + F.size("o.lines")))
    return found.select(key, F.col("o.lines").alias("ours"), F.col("t.lines").alias("theirs"), agreement_class(F.col("o.lines"), F.col("t.lines"), F.col("code"), replaced).alias("class"), f1.alias("f1"))
