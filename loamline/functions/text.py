"""Scalars over texts, lines and nested values. White space is Unicode's unless said otherwise."""

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s"


def text_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def lines(text: Column) -> Column:
    """Split at LF only."""
    return F.split(text, "\n", -1)


def clean(text: Column) -> Column:
    """CRLF and CR become LF; blank lines at both ends go."""
    t = F.regexp_replace(text, "\r\n?", "\n")
    t = F.regexp_replace(t, r"(?U)\A(?:[^\S\n]*\n)+", "")
    return F.regexp_replace(t, r"(?U)(?:\n[^\S\n]*)+\z", "")


def numbered(text: Column) -> Column:
    return F.array_join(F.transform(lines(text), lambda l, i: F.concat((i + 1).cast("string"), F.lit(": "), l)), "\n")


def line_key(line: Column) -> Column:
    return F.regexp_replace(line, SPACE, "")


def line_keys(text: Column) -> Column:
    """Keys of the lines that aren't blank, in order."""
    return F.filter(F.transform(lines(text), line_key), lambda k: k != "")


def body_hash(text: Column) -> Column:
    """The hash of a text's line keys. For source code, give code.code_text() of it, so that comments don't count."""
    return text_hash(F.array_join(line_keys(text), "\n"))


def shingles(keys: Column, n: int = 3) -> Column:
    """Distinct runs of n keys joined by U+001F; a shorter input is one run, also an empty one."""
    whole = F.array(F.array_join(keys, "\x1f"))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(keys) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(keys, i, n), "\x1f"))
    return F.array_distinct(F.when(F.size(keys) <= n, whole).otherwise(runs))


def jaccard_at_least(shared: Column, a: Column, b: Column, num: int, den: int) -> Column:
    """shared / (a + b - shared) >= num / den in whole numbers."""
    return shared * den >= (a + b - shared) * num


def final_line(text: Column) -> Column:
    """The last line that isn't blank, trimmed."""
    return F.regexp_replace(F.element_at(lines(F.regexp_replace(text, r"(?U)\s+\z", "")), -1), r"(?U)\A\s+|\s+\z", "")


def body_above(text: Column) -> Column:
    t = F.regexp_replace(text, r"(?U)\s+\z", "")
    return F.regexp_replace(F.regexp_replace(t, r"[^\n]*\z", ""), r"(?U)\s+\z", "")


def redact_ids(text: Column, prefix: str) -> Column:
    """Numbers with a prefix, such as CWE-79, in any case and not inside a longer word, become PREFIX-[redacted]."""
    return F.regexp_replace(text, rf"(?i)(?<![A-Za-z0-9]){prefix}-\d+(?!\d)", f"{prefix}-[redacted]")


def redact_own(text: Column, own: Column, to: str) -> Column:
    """A row's own id, in any case and with boundaries."""
    return F.regexp_replace(text, F.concat(F.lit(r"(?i)(?<![A-Za-z0-9-])\Q"), own, F.lit(r"\E(?![A-Za-z0-9-])")), F.lit(to))


def holds_word(text: Column, words: Column) -> Column:
    """Whether any of the words stands in the text with [A-Za-z0-9_] boundaries, in its case."""
    return F.exists(words, lambda w: F.regexp_like(text, F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), w, F.lit(r"\E(?![A-Za-z0-9_])"))))


# What gives a hint away.
HINTS = (
    r"(?i)\b(?:we|i)\s+(?:were|was|are|am|have\s+been|'ve\s+been)\s+(?:told|given|informed)\b",
    r"(?i)\b(?:given|provided|supplied|stated)\s+(?:correct\s+)?(?:answer|solution)\b",
    r"(?i)\b(?:answer|solution)\s+(?:was|is|has\s+been)\s+(?:given|provided|supplied|stated)\b",
    r"(?i)\bthe\s+hint\b",
    r"(?i)\b(?:you|the\s+(?:prompt|question|user))\s+(?:said|says|stated|states|told|tells)\b[^.\n]{0,40}\banswer\b",
)


def leaks_hint(text: Column, patterns: tuple[str, ...] = HINTS) -> Column:
    """Whether any of the patterns is found; null leaks nothing."""
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(p)
    return F.coalesce(out, F.lit(False))


def chat(system: str, user: Column, assistant: str = "") -> Column:
    """ChatML: system and user turns and the start of the assistant's."""
    return F.concat(F.lit(f"<|im_start|>system\n{system}<|im_end|>\n<|im_start|>user\n"), user, F.lit(f"<|im_end|>\n<|im_start|>assistant\n{assistant}"))


def chat_turns(turns: Column) -> Column:
    """turns: array of (turn, role, text); rendered in the order of turn."""
    return F.array_join(F.transform(F.array_sort(turns), lambda t: F.concat(F.lit("<|im_start|>"), t["role"], F.lit("\n"), F.coalesce(t["text"], F.lit("")), F.lit("<|im_end|>"))), "\n")


def custom_id(item: Column, attempt: Column) -> Column:
    """`:` becomes `_`; the attempt is appended. valid_custom_id() says whether the result may be sent."""
    return F.concat(F.translate(item, ":", "_"), F.lit("_a"), attempt.cast("string"))


def valid_custom_id(custom: Column) -> Column:
    return custom.rlike(r"\A[A-Za-z0-9_-]{1,64}\z")


def word_tokens(text: Column) -> Column:
    """Tokens of the stand-in tokenizer: runs of what isn't white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")


def prefix_cut(ids: Column, cap: Column, stop: int) -> Column:
    """What a cap would have returned: (ids, cut). The stop token counts, and ends the reply."""
    head = F.slice(ids, F.lit(1), cap)
    at = F.array_position(head, F.lit(stop))
    return F.struct(F.when(at > 0, F.slice(head, F.lit(1), at.cast("int"))).otherwise(head).alias("ids"), (at == 0).alias("cut"))


def stop_normalised(ids: Column, stop: int) -> Column:
    """Without the stop token; -1 at the end if there was one."""
    return F.concat(F.filter(ids, lambda t: t != stop), F.when(F.array_contains(ids, stop), F.array(F.lit(-1))).otherwise(F.array().cast("array<int>")))


def first_difference(a: Column, b: Column) -> Column:
    """0-based index of the first difference; null if there is none; a prefix differs where it ends."""
    at = F.array_position(F.transform(F.arrays_zip(a.alias("x"), b.alias("y")), lambda p: ~p["x"].eqNullSafe(p["y"])), True)
    return F.when(at > 0, (at - 1).cast("int"))


def loss_labels(ids: Column, mask: Column) -> Column:
    """The id where the mask is 1, else -100."""
    return F.zip_with(ids, mask, lambda i, m: F.when(m == 1, i).otherwise(F.lit(-100)))


def json_int_status(raw: Column, field: str) -> Column:
    """ok if the field is a whole number (true and false aren't), missing without it, wrong_type for anything else, bad_json if it can't be read."""
    v = F.try_parse_json(raw)
    kind = F.schema_of_variant(F.try_variant_get(v, f"$.{field}", "variant"))
    return F.when(v.isNull(), "bad_json").when(kind.isNull(), "missing").when(kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "ok").otherwise("wrong_type")


def span_years(first: Column, last: Column) -> Column:
    return (F.unix_micros(last.cast("timestamp")) - F.unix_micros(first.cast("timestamp"))) / F.lit(1e6 * 365.25 * 86400)


def document(fields: dict[str, Column], end: str) -> Column:
    """A plain document, a line for each field, and an end token."""
    return F.concat(F.array_join(F.array(*[F.concat(F.lit(f"{k}: "), F.coalesce(c.cast("string"), F.lit(""))) for k, c in fields.items()]), "\n"), F.lit(end))


def canonical_vector(parts: Column, order: tuple[str, ...]) -> Column:
    return F.array_join(F.transform(F.array(*[F.lit(k) for k in order]), lambda k: F.concat(k, F.lit(":"), F.element_at(parts, k))), "/")


def parse_vector(text: Column, domains: dict[str, str]) -> Column:
    """A map of components from `AV:N/AC:L/...` in any order and case, a version before it or not; null unless each is there once and in its domain."""
    body = F.regexp_replace(F.upper(F.trim(text)), r"\ACVSS:3\.[01]/", "")
    pairs = F.transform(F.split(body, "/"), lambda p: F.split(p, ":"))
    fine = F.forall(pairs, lambda p: (F.size(p) == 2) & F.coalesce(F.array_contains(F.array(*[F.lit(f"{k}:{v}") for k, vs in domains.items() for v in vs]), F.array_join(p, ":")), F.lit(False)))
    names = F.transform(pairs, lambda p: p[0])
    whole = (F.size(names) == len(domains)) & (F.size(F.array_distinct(names)) == len(domains))
    return F.when(fine & whole, F.map_from_arrays(names, F.transform(pairs, lambda p: F.try_element_at(p, F.lit(2)))))


# The components of a base vector, in canonical order, with their values in order.
VECTOR = {"AV": "NALP", "AC": "LH", "PR": "NLH", "UI": "NR", "S": "UC", "C": "HLN", "I": "HLN", "A": "HLN"}
