"""Replies in free text parsed and scored. Scores are whole numbers: eighths for credit and vectors, sixteenths for paired labels, n / d for lines.

A parsed value is null where nothing could be read; that scores 0. Digits are ASCII.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import VECTOR, body_above, final_line, leaks_hint

# The patterns that replies are read with.
ID_LENIENT = r"(?i)(?<![A-Za-z0-9])CWE[-_ :]*0*(\d{1,5})(?!\d)"
ID_STRICT = r"\A\s*CWE-[1-9]\d*\s*\z"
VECTOR_PART = r"(?i)(?<![A-Za-z])(AV|AC|PR|UI|S|C|I|A)\s*:\s*(adjacent network|[A-Za-z]+)(?![A-Za-z])"
MCQ_ANSWER = r"(?i:ANSWER)\s*:\s*[(\[*]*\s*([A-D])(?![A-Za-z0-9])"
MCQ_LONE = r"\A[\s(\[*]*([A-D])[\s).\]*]*\z"
MCQ_PAREN = r"(?i)\(([A-D])\)|\b(?:option|answer is)\s+([A-D])(?![A-Za-z0-9])"
MCQ_STRICT = r"\A\s*ANSWER: [A-D]\s*\z"
LABEL_FIELD = r"(?i)VULNERABLE\s*:\s*\**\s*(yes|no)(?![A-Za-z])"
LABEL_NEGATIVE = r"(?i)\b(?:not|isn't|is\s+not|no\s+longer)\s+vulnerable\b|\bno\s+(?:known\s+|security\s+)?vulnerabilit(?:y|ies)\b"
LABEL_POSITIVE = r"(?i)\bvulnerab(?:le|ilit(?:y|ies))\b"
LABEL_STRICT = r"\A\s*VULNERABLE: (?:yes, CWE-[1-9]\d*|no)\s*\z"
LINES_FIELD = r"(?is)\A.*LINES\s*:"
LINES_STRICT = r"\A\s*LINES: (?:none|[1-9]\d*(?:, [1-9]\d*)*)\s*\z"
VECTOR_WORDS = {
    "AV:NETWORK": "N", "AV:ADJACENT NETWORK": "A", "AV:ADJACENT": "A", "AV:LOCAL": "L", "AV:PHYSICAL": "P", "AC:LOW": "L", "AC:HIGH": "H",
    "PR:NONE": "N", "PR:LOW": "L", "PR:HIGH": "H", "UI:NONE": "N", "UI:REQUIRED": "R", "S:UNCHANGED": "U", "S:CHANGED": "C",
    "C:NONE": "N", "C:LOW": "L", "C:HIGH": "H", "I:NONE": "N", "I:LOW": "L", "I:HIGH": "H", "A:NONE": "N", "A:LOW": "L", "A:HIGH": "H",
}


def last(found: Column) -> Column:
    return F.try_element_at(found, F.lit(-1))


def parse_id(reply: Column) -> Column:
    """The last id mentioned, as CWE-n."""
    n = last(F.regexp_extract_all(reply, F.lit(ID_LENIENT), F.lit(1)))
    return F.when(n.isNotNull(), F.concat(F.lit("CWE-"), n.cast("int").cast("string")))


def strict_id(reply: Column) -> Column:
    return reply.rlike(ID_STRICT)


def parse_components(reply: Column) -> Column:
    """A map with the last valid value of each component, a letter or its word; null if there is none."""
    names = F.transform(F.regexp_extract_all(reply, F.lit(VECTOR_PART), F.lit(1)), F.upper)
    values = F.transform(F.regexp_extract_all(reply, F.lit(VECTOR_PART), F.lit(2)), lambda v: F.regexp_replace(F.upper(v), r"\s+", " "))
    known = {f"{k}:{v}": v for k, vs in VECTOR.items() for v in vs} | VECTOR_WORDS
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    read = F.filter(F.zip_with(names, values, lambda k, v: F.struct(k.alias("k"), F.try_element_at(table, F.concat(k, F.lit(":"), v)).alias("v"))), lambda p: p["v"].isNotNull())
    put = lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["k"]), F.create_map(p["k"], p["v"]))
    return F.aggregate(read, F.create_map().cast("map<string,string>"), put, lambda m: F.when(F.size(m) > 0, m))


def vector_text(parts: Column) -> Column:
    return F.when(parts.isNotNull(), F.array_join(F.transform(F.array(*[F.lit(k) for k in VECTOR]), lambda k: F.concat(k, F.lit(":"), F.coalesce(F.try_element_at(parts, k), F.lit("?")))), "/"))


def strict_vector(reply: Column) -> Column:
    return reply.rlike(r"\A\s*(?:CVSS:3\.[01]/)?" + "/".join(f"{k}:[{v}]" for k, v in VECTOR.items()) + r"\s*\z")


def vector_eighths(parts: Column, gold: Column) -> Column:
    """Components that agree, of eight; gold is a map with all of them."""
    same = [F.coalesce((F.try_element_at(parts, F.lit(k)) == F.try_element_at(gold, F.lit(k))).cast("int"), F.lit(0)) for k in VECTOR]
    total = same[0]
    for s in same[1:]:
        total = total + s
    return total


def parse_mcq(reply: Column, options: Column | None = None) -> Column:
    """The capital after the last ANSWER:, else a reply of one letter, else the last (X), option X or answer is X, else the option that the last line is.

    options: array of (letter, cwe, name).
    """
    lone = F.regexp_extract(reply, MCQ_LONE, 1)
    capital = F.filter(F.regexp_extract_all(reply, F.lit(MCQ_PAREN), F.lit(0)), lambda x: x.rlike(r"\([A-D]\)\z|[A-D]\z"))
    loose = F.regexp_extract(last(capital), r"([A-D])\)?\z", 1)
    found = [last(F.regexp_extract_all(reply, F.lit(MCQ_ANSWER), F.lit(1))), F.when(lone != "", lone), F.when(loose != "", loose)]
    if options is not None:
        line = last(F.filter(F.transform(F.split(reply, "\n"), F.trim), lambda x: x != ""))
        text = lambda o: F.concat(o["cwe"], F.lit(": "), o["name"])
        found.append(F.try_element_at(F.filter(options, lambda o: (line == text(o)) | (line == F.concat(o["letter"], F.lit(". "), text(o)))), F.lit(1))["letter"])
    return F.coalesce(*found)


def strict_mcq(reply: Column) -> Column:
    return reply.rlike(MCQ_STRICT)


def parse_label(reply: Column) -> Column:
    """yes or no: the last field; without one, whether the last statement is positive, negations first; null if there is neither.

    A negation is blanked with as many characters before positive statements are looked for, so both are compared by where they stand.
    """
    field = F.lower(last(F.regexp_extract_all(reply, F.lit(LABEL_FIELD), F.lit(1))))
    marked = F.regexp_replace(F.regexp_replace(reply, LABEL_NEGATIVE, "\x01"), LABEL_POSITIVE, "\x02")
    events = F.regexp_replace(marked, "[^\x01\x02]", "")
    stated = F.when(events == "", None).when(F.substring(events, -1, 1) == "\x02", "yes").otherwise("no")
    return F.coalesce(field, stated)


def strict_label(reply: Column) -> Column:
    return reply.rlike(LABEL_STRICT)


def label_sixteenths(parsed: Column, vulnerable: Column, credit_eighths: Column) -> Column:
    """On vulnerable items half for the label and half for its credit; on others all for the label."""
    right = (parsed == F.when(vulnerable, "yes").otherwise("no")).cast("int")
    return F.coalesce(F.when(vulnerable, right * (8 + F.coalesce(credit_eighths, F.lit(0)))).otherwise(right * 16), F.lit(0))


def without_code(reply: Column) -> Column:
    """Without fenced blocks, of which an unclosed one runs to the end, and without lines like `12: ...`."""
    open_ = F.regexp_replace(reply, r"(?s)```.*?(?:```|\z)", " ")
    return F.array_join(F.filter(F.split(open_, "\n"), lambda l: ~l.rlike(r"\A\s*\d+:")), "\n")


def parse_lines(reply: Column, n_lines: Column) -> Column:
    """Sorted distinct line numbers in range after the last LINES: (else in the whole reply without code); empty for none; null if there is neither."""
    tail = F.when(reply.rlike(r"(?i)LINES\s*:"), F.regexp_replace(reply, LINES_FIELD, "")).otherwise(without_code(reply))
    digits = F.regexp_extract_all(tail, F.lit(r"\d+"), F.lit(0))
    numbers = F.filter(F.transform(digits, lambda d: F.when(F.length(F.regexp_replace(d, r"\A0+", "")) <= 9, d.cast("decimal(38,0)").cast("int"))), lambda x: x.isNotNull() & (x >= 1) & (x <= n_lines))
    return F.when(F.size(digits) > 0, F.array_sort(F.array_distinct(numbers))).when(tail.rlike(r"(?i)\bnone\b"), F.array().cast("array<int>"))


def strict_lines(reply: Column, n_lines: Column) -> Column:
    numbers = parse_lines(reply, n_lines)
    shown = F.concat(F.lit("LINES: "), F.when(F.size(numbers) > 0, F.array_join(numbers, ", ")).otherwise("none"))
    return F.coalesce(reply.rlike(LINES_STRICT) & (F.trim(reply) == shown), F.lit(False))


def matched_lines(predicted: Column, gold: Column) -> Column:
    """Pairs of a maximum one-to-one matching of sorted distinct numbers at most 1 apart.

    Each predicted number in turn takes the least gold number in reach that is above the last one taken.
    """
    start = F.struct(F.lit(0).alias("n"), F.lit(-10).alias("taken"))

    def step(acc, p):
        free = F.try_element_at(F.filter(gold, lambda g: (g > acc["taken"]) & (g >= p - 1) & (g <= p + 1)), F.lit(1))
        return F.when(free.isNotNull(), F.struct((acc["n"] + 1).alias("n"), free.alias("taken"))).otherwise(acc)

    return F.aggregate(predicted, start, step, lambda acc: acc["n"])


def line_f1(predicted: Column, gold: Column) -> Column:
    """(n, d): twice the matched numbers over both sets' sizes. Null for an empty gold set, 0 for an empty prediction."""
    return F.when(F.size(gold) > 0, F.struct((2 * matched_lines(predicted, gold)).alias("n"), (F.size(predicted) + F.size(gold)).alias("d")))


def review_category(kind: Column, reply: Column, finish: Column, judged: Column) -> Column:
    """Why a reply wants a look, by its verdict: parse_failure (unread though it stopped by itself), no_field (read, but not from the type's own field),
    lenient_not_strict, or null. A reply that was cut off and couldn't be read has no category."""
    r = F.coalesce(reply, F.lit(""))
    field = {"mcq": MCQ_ANSWER, "find_error": LABEL_FIELD, "line_loc": r"(?i)LINES\s*:"}
    without = F.lit(False)
    for name, pattern in field.items():
        without = without | ((kind == name) & ~r.rlike(pattern))
    without = without | ((kind == "cvss") & F.contains(judged["parsed"], F.lit("?")))
    last_line = F.element_at(F.split(F.regexp_replace(r, r"(?U)\s+\z", ""), "\n"), -1)
    without = without | ((kind == "exact_id") & ~parse_id(last_line).eqNullSafe(judged["parsed"]))
    unread = F.when(finish == "stop", "parse_failure")
    return F.when(~judged["parse_ok"], unread).when(without, "no_field").when(~judged["strict_ok"], "lenient_not_strict")


def rationale(text: Column, finish: Column, target: Column, last_judged: Column, target_judged: Column) -> Column:
    """(target, reason): the body above the last line with the item's target below it, or the first reason against it.

    last_judged and target_judged: verdicts of the last line and of the item's own target. In order: truncated, empty, no_final_answer,
    wrong_final_answer, no_reasoning, hint_leak.
    """
    body = body_above(text)
    reason = (
        F.when(~finish.eqNullSafe(F.lit("stop")), "truncated").when(F.coalesce(final_line(text), F.lit("")) == "", "empty").when(~last_judged["parse_ok"], "no_final_answer")
        .when(~last_judged["parsed"].eqNullSafe(target_judged["parsed"]), "wrong_final_answer").when(F.coalesce(F.regexp_replace(body, r"(?U)\s", ""), F.lit("")) == "", "no_reasoning").when(leaks_hint(body), "hint_leak")
    )
    return F.struct(F.when(reason.isNull(), F.concat(F.regexp_replace(body, r"(?U)\A\s+", ""), F.lit("\n\n"), target)).alias("target"), reason.alias("reason"))


def verdict(kind: Column, reply: Column, gold: Column, credits: Column) -> Column:
    """(parsed, parse_ok, strict_ok, metric, dense) of a reply to an item; scores are (n, d), 0 / 1 where nothing could be read.

    gold: a struct with letter, options, cwe, vector (a map), vulnerable, lines, n_lines, null where the type doesn't use them. credits: a map
    from predicted ids to eighths for the item's gold id; what isn't in it earns 0. An unknown type is an error.
    """
    r = F.coalesce(reply, F.lit(""))
    score = lambda n, d: F.struct(n.cast("int").alias("n"), F.lit(d).cast("int").alias("d") if isinstance(d, int) else d.cast("int").alias("d"))

    def made(parsed, strict, metric, dense):
        ok, zero = parsed.isNotNull(), score(F.lit(0), 1)
        return F.struct(parsed.alias("parsed"), ok.alias("parse_ok"), F.coalesce(ok & strict, F.lit(False)).alias("strict_ok"), F.when(ok, metric).otherwise(zero).alias("metric"), F.when(ok, dense).otherwise(zero).alias("dense"))

    earned = lambda i: F.coalesce(F.try_element_at(credits, i), F.lit(0))
    letter, found, label = parse_mcq(r, gold["options"]), parse_id(r), parse_label(r)
    parts, numbers = parse_components(r), parse_lines(r, gold["n_lines"])
    f1 = line_f1(numbers, gold["lines"])
    right = (label == F.when(gold["vulnerable"], "yes").otherwise("no")).cast("int")
    shown = F.when(label == "yes", F.concat_ws(", ", F.lit("VULNERABLE: yes"), found)).when(label == "no", "VULNERABLE: no")
    shown_lines = F.when(numbers.isNotNull(), F.concat(F.lit("LINES: "), F.when(F.size(numbers) > 0, F.array_join(numbers, ", ")).otherwise("none")))
    hit = (letter == gold["letter"]).cast("int")
    eight = vector_eighths(parts, gold["vector"])
    of_lines = score(f1["n"], f1["d"])
    kind_of_verdict = "struct<parsed:string,parse_ok:boolean,strict_ok:boolean,metric:struct<n:int,d:int>,dense:struct<n:int,d:int>>"
    whole = F.forall(F.array(*[F.lit(k) for k in VECTOR]), lambda k: F.try_element_at(gold["vector"], k).isNotNull())
    bad = ((kind == "cvss") & ~F.coalesce(whole, F.lit(False))) | ((kind == "line_loc") & (F.coalesce(F.size(gold["lines"]), F.lit(0)) <= 0))
    return (
        F.when(bad, F.raise_error(F.concat(F.lit("the gold isn't valid: "), kind)).cast(kind_of_verdict))
        .when(kind == "mcq", made(letter, strict_mcq(r), score(hit, 1), score(hit, 1)))
        .when(kind == "exact_id", made(found, strict_id(r), score((found == gold["cwe"]).cast("int"), 1), score(earned(found), 8)))
        .when(kind == "cvss", made(vector_text(parts), strict_vector(r), score(eight, 8), score(eight, 8)))
        .when(kind == "find_error", made(shown, strict_label(r), score(right, 1), score(label_sixteenths(label, gold["vulnerable"], earned(found)), 16)))
        .when(kind == "line_loc", made(shown_lines, strict_lines(r, gold["n_lines"]), of_lines, of_lines))
        .otherwise(F.raise_error(F.concat(F.lit("unknown item type "), F.coalesce(kind, F.lit("null")))).cast(kind_of_verdict))
    )


def both_right(rows, by: list[str], kind: str, verdict_column: str):
    """(by, both_right, both_strict): of units of two items whether both labels are right, and whether the vulnerable one's id is exact as well
    (its dense score is 1)."""
    v = lambda f: F.col(f"{verdict_column}.{f}")
    one, full = v("metric.n") == v("metric.d"), v("dense.n") == v("dense.d")
    return rows.where(F.col(kind) == "find_error").groupBy(*by).agg(F.bool_and(one).alias("both_right"), F.bool_and(one & full).alias("both_strict"))
