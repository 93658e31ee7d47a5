"""Requests, training rows and runs: pins, layouts, parts of batches, accounting, chains of hashes and gates."""

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import checks as C
from .graph import kept


def pin_violations(requests: DataFrame, key: str, pins: dict[str, Column]) -> DataFrame:
    """Requests whose pinned columns (model, revision, sampling as JSON, ...) aren't what they must be."""
    return C.row_checks(requests, key, {f"pinned {k}": F.col(k).eqNullSafe(v) for k, v in pins.items()})


def chain_violations(stages: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """stages: (name, rows, own hash column, parent hash column), from the first on. Rows of a stage whose parent hash is no row's own hash of the stage before."""
    out = []
    for (before, rows, own, _), (name, later, mine, parent) in zip(stages[:-1], stages[1:], strict=True):
        lost = later.join(rows.select(F.col(own).alias(parent)).distinct(), parent, "left_anti")
        out.append(lost.select(F.lit(f"{name} from {before}").alias("check"), F.col(mine).cast("string").alias("key"), F.concat(F.lit("parent "), F.coalesce(F.col(parent).cast("string"), F.lit("null"))).alias("message")))
    return C.together(out)


def file_hash(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def tree_hash(folder: str, exclude: tuple[str, ...] = ()) -> str:
    """One hash of a folder of this machine: sorted relative paths and hashes of their files, names in `exclude` left out."""
    from pathlib import Path

    top, h = Path(folder), hashlib.sha256()
    for p in sorted((p for p in top.rglob("*") if p.is_file() and not set(p.relative_to(top).parts) & set(exclude)), key=lambda p: p.relative_to(top).as_posix()):
        h.update(p.relative_to(top).as_posix().encode() + b"\0" + file_hash(str(p)).encode() + b"\0")
    return h.hexdigest()


def gate(folder: str, pinned: str | None, exclude: tuple[str, ...] = ()) -> None:
    """Refuses if the source isn't the pinned one, or no pin is set."""
    now = tree_hash(folder, exclude)
    if pinned is None or now != pinned:
        raise ValueError(f"the source has the hash {now}, not the pinned one")


def drift(pinned: dict[str, str], found: dict[str, str]) -> list[str]:
    """Names whose versions differ from the pins, or that are pinned and missing."""
    return sorted(k for k, v in pinned.items() if found.get(k) != v)


def not_ready(pins: dict) -> list[str]:
    """Pins that are still open."""
    return sorted(k for k, v in pins.items() if v is None)


def resolved_config(shared: dict, own: dict) -> tuple[dict, str]:
    """A run's settings, the arm's over the shared ones, and their hash."""
    whole = shared | own
    return whole, hashlib.sha256(json.dumps(whole, sort_keys=True).encode()).hexdigest()


def unequal_settings(configs: dict[str, dict], shared: tuple[str, ...]) -> list[str]:
    """Shared settings that differ between arms."""
    return [k for k in shared if len({json.dumps(c.get(k), sort_keys=True) for c in configs.values()}) > 1]


def config_name(num: int | None = None, den: int | None = None, dropped: str | None = None) -> str:
    """m1, m2-<type> or m1v-<num>of<den>."""
    if dropped is not None:
        return f"m2-{dropped}"
    return "m1" if num is None else f"m1v-{num}of{den}"


def config_of(name: str) -> dict:
    """What a name says: the dropped type or the share of items removed."""
    if name.startswith("m2-"):
        return {"dropped": name[3:], "share": None}
    if name.startswith("m1v-"):
        a, b = name[4:].split("of")
        return {"dropped": None, "share": (int(a), int(b))}
    return {"dropped": None, "share": None}


def next_version(path: str, taken) -> str:
    """The path itself, or with the first suffix _v2, _v3, ... that isn't taken."""
    stem, dot, end = path.rpartition(".")
    n, out = 1, path
    while taken(out):
        n += 1
        out = f"{stem}_v{n}{dot}{end}" if dot else f"{path}_v{n}"
    return out


# Training rows.


def training_rows(selected: DataFrame, item: str, pos: str, sources: dict[str, tuple[DataFrame, dict[str, Column]]]) -> dict[str, DataFrame]:
    """For each arm its rows in the selection's order: sources has the arm's table, keyed by item, and its columns. An item that a table lacks is an error."""
    out = {}
    for arm, (table, columns) in sources.items():
        have = table.withColumn("_have", F.lit(True))
        rows = selected.join(have, item, "left").withColumn(item, F.when(F.col("_have"), F.col(item)).otherwise(F.raise_error(F.concat(F.lit(f"{arm} lacks "), F.col(item).cast("string"))).cast(dict(selected.dtypes)[item])))
        out[arm] = rows.select(pos, item, *[c.alias(k) for k, c in columns.items()])
    return out


def composition(selected: DataFrame, item: str) -> DataFrame:
    """(type, n): the types of a selection's items 'unit:type:index'."""
    return selected.groupBy(F.try_element_at(F.split(item, ":"), F.lit(2)).alias("type")).agg(F.count("*").alias("n"))


def selection_violations(stored: DataFrame, fresh: DataFrame, columns: list[str]) -> DataFrame:
    """A stored selection against one that is made anew: rows that only one of them has, as often as they are over."""
    side = lambda a, b, m: a.select(columns).exceptAll(b.select(columns)).select(F.lit("selection").alias("check"), F.to_json(F.struct(*columns)).alias("key"), F.lit(m).alias("message"))
    return side(stored, fresh, "stored only").union(side(fresh, stored, "missing"))


def encoding_violations(rows: DataFrame, key: str, ids: str, end: int, expected: str | None = None) -> DataFrame:
    """Token arrays that don't end in exactly one end token, or don't have the number of tokens that the bank says."""
    checks = {"one end token": F.size(F.filter(ids, lambda t: t == end)) == 1, "end token last": F.try_element_at(ids, F.lit(-1)) == end}
    if expected:
        checks["as many tokens"] = F.size(ids) == F.col(expected)
    return C.row_checks(rows, key, checks)


def id_differences(a: DataFrame, b: DataFrame, key: str, ids: str) -> DataFrame:
    """(key, at): rows whose token arrays differ, with the first place, from 0, where they do; a prefix differs where it ends; -1 where one side is missing."""
    both = a.select(key, F.col(ids).alias("_x")).join(b.select(key, F.col(ids).alias("_y")), key, "full_outer")
    at = F.array_position(F.transform(F.arrays_zip(F.col("_x").alias("x"), F.col("_y").alias("y")), lambda p: ~p["x"].eqNullSafe(p["y"])), True) - 1
    where = F.when(F.col("_x").isNull() | F.col("_y").isNull(), F.lit(-1).cast("long")).otherwise(at)
    return both.where(~F.col("_x").eqNullSafe(F.col("_y"))).select(key, where.alias("at"))


def flop_totals(rows: DataFrame, by: list[str], trained: str, reference: str, parameters: int) -> DataFrame:
    """(by, trained, reference, flops): 6 N for each trained token and 2 N for each that only a reference model reads."""
    sums = rows.groupBy(*by).agg(F.sum(trained).alias("trained"), F.sum(reference).alias("reference"))
    return sums.withColumn("flops", (F.col("trained").cast("double") * 6 + F.col("reference").cast("double") * 2) * parameters)


def token_table(texts: DataFrame, key: str, text: str, count: Column) -> DataFrame:
    """(key, tokens): each distinct text is counted once. count: a column of the text."""
    once = texts.select(text).distinct().withColumn("tokens", count)
    return texts.join(once, text).select(key, "tokens")


def cap_of(rows: DataFrame, prompt: str, caps: DataFrame) -> DataFrame:
    """Adds cap by prompt; a prompt without one is an error."""
    out = rows.join(caps.select(prompt, "cap"), prompt, "left")
    return out.withColumn("cap", F.coalesce("cap", F.raise_error(F.lit("a prompt has no cap")).cast(dict(caps.dtypes)["cap"])))


def parts_by_cap(rows: DataFrame, pos: str, cap: str) -> DataFrame:
    """Adds part_pos: the place of a row in its cap's part. Parts are put together again by pos."""
    return rows.withColumn("part_pos", F.row_number().over(Window.partitionBy(cap).orderBy(pos)) - 1)


def merged_parts(rows: DataFrame, results: DataFrame, pos: str, cap: str) -> DataFrame:
    """Results (cap, part_pos, ...) at the places of the rows that they belong to; a row without a result, or one over, is an error."""
    placed = parts_by_cap(rows.select(pos, cap), pos, cap).withColumn("_asked", F.lit(True))
    out = placed.join(results.withColumn("_got", F.lit(True)), [cap, "part_pos"], "full_outer")
    fits = F.col("_asked") & F.col("_got")
    out = out.withColumn(pos, F.when(fits, F.col(pos)).otherwise(F.raise_error(F.lit("parts don't fit")).cast(dict(rows.dtypes)[pos])))
    return out.drop("_asked", "_got", "part_pos")


def scattered(batch: DataFrame, new: DataFrame, pos: str, ids: str, pad: int) -> DataFrame:
    """The batch with the rows of `new` in place of those at the same positions, all padded to the longest. A position that the batch lacks is an error."""
    rows = batch.select(pos, F.col(ids).alias("_old")).join(new.select(pos, F.col(ids).alias("_new")), pos, "full_outer")
    rows = kept(rows.select(F.when(F.col("_old").isNotNull(), F.col(pos)).otherwise(F.raise_error(F.lit("no such row")).cast(dict(batch.dtypes)[pos])).alias(pos), F.coalesce("_new", "_old").alias(ids)))
    wide = rows.agg(F.max(F.size(ids)).alias("_w"))
    return rows.crossJoin(F.broadcast(wide)).select(pos, F.concat(ids, F.array_repeat(F.lit(pad).cast("int"), F.col("_w") - F.size(ids))).alias(ids))


def label_differences(rows: DataFrame, key: str, expected: str, collated: str) -> DataFrame:
    """(key, at): labels that differ from the collated ones, the first position exempt; the first place, from 0, where they do; the length where it differs."""
    body = lambda c: F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0)))
    at = F.array_position(F.transform(F.arrays_zip(body(expected).alias("x"), body(collated).alias("y")), lambda p: ~p["x"].eqNullSafe(p["y"])), True)
    return rows.where(~body(expected).eqNullSafe(body(collated))).select(key, at.alias("at"))


def first_present(wanted: DataFrame, key: str, kinds: str, have: DataFrame, kind: str) -> DataFrame:
    """(key, kind): of each row's ordered array of kinds the first that `have` (kind) has; null if none."""
    each = wanted.select(key, F.posexplode_outer(kinds).alias("_at", kind))
    got = each.join(have.select(kind).distinct(), kind, "left_semi").groupBy(key).agg(F.min_by(kind, "_at").alias(kind))
    return wanted.select(key).join(got, key, "left")


def role_sets(roles: DataFrame, key: str, seed: str, role: str, checkpoint: str) -> DataFrame:
    """(seed, set, key): train and dev members, and the checkpoint's as a set of their own."""
    return roles.select(seed, F.col(role).alias("set"), key).union(roles.where(checkpoint).select(seed, F.lit("checkpoint").alias("set"), key))


def run_costs(steps: DataFrame, run: str, step: str, elapsed: str, first: int, last: int, meta: DataFrame) -> DataFrame:
    """(run, per_step, overhead): the median duration of steps first to last, and what the run took besides. meta (run, steps_done, load, train), finished runs.
    Elapsed times that don't grow are an error."""
    gap = F.col(elapsed) - F.lag(elapsed).over(Window.partitionBy(run).orderBy(step))
    each = steps.withColumn("gap", gap).where((F.col(step) >= first) & (F.col(step) <= last))
    each = each.withColumn("gap", F.when(F.col("gap") > 0, F.col("gap")).otherwise(F.raise_error(F.lit("elapsed times don't grow")).cast("double")))
    return each.groupBy(run).agg(F.median("gap").alias("per_step")).join(meta, run).select(run, "per_step", (F.col("load") + F.col("train") - F.col("steps_done") * F.col("per_step")).alias("overhead"))


def score_export(rows: DataFrame, runs: DataFrame, by: list[str], num: str, den: str) -> DataFrame:
    """(by, item_id, metric) with metrics as n/d in lowest terms' text; refused while a run of `runs` has no score."""
    missing = runs.select(by).distinct().join(rows.select(by).distinct(), by, "left_anti")
    if not missing.isEmpty():
        raise ValueError(f"no scores of {missing.first().asDict()}")
    return rows.select(*by, "item_id", F.when(F.col(den) == 1, F.col(num).cast("string")).otherwise(F.concat_ws("/", F.col(num).cast("string"), F.col(den).cast("string"))).alias("metric"))


def extrapolated(cost: Column, pilot: Column, whole: Column) -> Column:
    """A pilot's cost at the size of the whole."""
    return cost * whole / pilot
