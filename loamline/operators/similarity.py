"""Near-duplicates by shingles of lines: an exact theta self-join as an equi-join on what sets must share.

Texts are taken as source code, whose comments don't count, unless code=False says that they are prose."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import code as C
from ..functions import text as T
from ..tables import spread
from .graph import kept, stored


def as_code(rows: DataFrame, text: str, code: bool) -> DataFrame:
    """Rows with a text, comments blanked if it is code."""
    rows = rows.where(F.col(text).isNotNull())
    return rows.withColumn(text, C.masked_text(F.col(text))) if code else rows


def shingle_rows(rows: DataFrame, key: str, text: str, n: int = 3, code: bool = True) -> DataFrame:
    """(key, shingle hash) for each distinct run of n line keys."""
    keys = as_code(rows.select(key, text), text, code).select(key, T.line_keys(F.col(text)).alias("_keys"))  # a column of its own: computed once
    return keys.select(key, T.shingles(F.col("_keys"), n).alias("_s")).select(key, F.explode("_s").alias("_s")).select(key, F.xxhash64("_s").alias("shingle")).distinct()


def near_duplicate_classes(rows: DataFrame, key: str, text: str, num: int = 4, den: int = 5, n: int = 3, code: bool = True) -> tuple[DataFrame, DataFrame]:
    """(members (key, rep, size), links (a, b, shared, total)): of each row the least key with an equal body and its number of shingles; of bodies, the
    pairs a < b with shared / total >= num / den.

    Classes meet on the prefix of their shingles, rarest first, that a similar set can't miss: all but ceil(size * num / den) - 1 of
    them; pairs outside the size bound are dropped before sets are compared. What is moved is hashes, never texts.
    """
    body = as_code(rows.select(key, text), text, code).select(key, T.line_keys(F.col(text)).alias("_keys"))
    body = body.select(key, F.xxhash64(F.array_join("_keys", "\n")).alias("h1"), F.hash(F.array_join("_keys", "\n")).alias("h2"), F.transform(T.shingles(F.col("_keys"), n), lambda s: F.xxhash64(s)).alias("s"))
    body = kept(body.withColumn("s", F.array_sort(F.array_distinct("s"))))
    reps = body.groupBy("h1", "h2").agg(F.min(key).alias("rep"), F.any_value("s").alias("s"))
    members = body.select(key, "h1", "h2").join(reps.select("h1", "h2", "rep", F.size("s").alias("size")), ["h1", "h2"]).select(key, "rep", "size")
    sets = kept(reps.select("rep", "s"))
    sh = sets.select("rep", F.size("s").alias("size"), F.explode("s").alias("shingle"))
    rarity = sh.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    ranked = sh.join(rarity, "shingle", "left").withColumn("df", F.coalesce("df", F.lit(1)))
    at = F.row_number().over(Window.partitionBy("rep").orderBy("df", "shingle"))
    prefix = ranked.withColumn("at", at).where(F.col("at") <= F.col("size") - F.ceil(F.col("size") * num / den) + 1).where("df > 1").select("rep", "shingle", "size")
    x, y = prefix.toDF("a", "shingle", "na"), prefix.toDF("b", "shingle", "nb")
    pairs = x.join(y, "shingle").where("a < b").where((F.col("na") * den >= F.col("nb") * num) & (F.col("nb") * den >= F.col("na") * num)).select("a", "b", "na", "nb").distinct()
    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b").withColumn("shared", F.size(F.array_intersect("sa", "sb")).cast("long"))
    both = both.where(T.jaccard_at_least(F.col("shared"), F.col("na"), F.col("nb"), num, den)).withColumn("total", (F.col("na") + F.col("nb") - F.col("shared")).cast("long")).select("a", "b", "shared", "total")
    return members, both


#: Members of a class that meet at once.
BLOCK = 1024


def paired(links: DataFrame, members: DataFrame) -> DataFrame:
    """links (x, y, ...): classes that are linked, each two once, x = y for a class within itself. members (c, m). Links have no columns i, j, u, v or across of their own. Adds u of x and v of y: all pairs of their members, each once,
    for x = y without a member and itself.

    There may be as many pairs as the square of a class. Members are dealt to blocks by hash, and two blocks meet in a task, where their pairs stand: none is moved.
    """
    n = members.groupBy("c").agg(F.ceil(F.count("*") / BLOCK).alias("n"))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    dealt = links.join(n.toDF("x", "nx"), "x").join(n.toDF("y", "ny"), "y").withColumn("i", every("nx")).withColumn("j", every("ny")).withColumn("across", F.expr("x <> y OR i < j")).where("across OR i = j").drop("nx", "ny")
    at = members.join(n, "c").select("c", F.pmod(F.xxhash64("m"), "n").alias("r"), "m")
    by = ["x", "y", "i", "j"]
    left, right = dealt.join(at.toDF("x", "i", "u"), ["x", "i"]), dealt.select(*by).join(at.toDF("y", "j", "v"), ["y", "j"])
    return spread(left, *by).join(spread(right, *by), by).where("across OR u < v").drop("i", "j", "across")


def class_links(members: DataFrame, both: DataFrame) -> DataFrame:
    """(x, y, kind, shared, total) for paired(): the classes of members (rep, size, ...) that have several, each with itself, and the pairs of classes that both tells."""
    size = F.col("size").cast("long")
    own = members.groupBy("rep").agg(F.first("size").alias("size"), F.count("*").alias("n")).where("n > 1")
    return own.select(F.col("rep").alias("x"), F.col("rep").alias("y"), F.lit("exact").alias("kind"), size.alias("shared"), size.alias("total")).union(both.select("a", "b", F.lit("fuzzy"), "shared", "total"))


def near_duplicate_links(rows: DataFrame, key: str, text: str, num: int = 4, den: int = 5, n: int = 3, code: bool = True) -> DataFrame:
    """(a, b, kind, shared, total): all pairs a < b of rows with shared / total >= num / den; kind is exact where bodies are equal, else fuzzy.

    The full listing grows with the square of a class; near_duplicate_classes() and spanning_links() say the same in as many rows as there are members.
    """
    members, both = near_duplicate_classes(rows, key, text, num, den, n, code)
    members = stored(members.select(F.col("rep").alias("c"), F.col(key).alias("m"), "rep", "size"))
    found = paired(class_links(members, both), members.select("c", "m"))
    return found.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "kind", "shared", "total")


def entity_links(rows: DataFrame, entity: str, side: str, text: str, num: int = 4, den: int = 5, n: int = 3, code: bool = True) -> DataFrame:
    """(a, b, kind, jaccard, side_a, side_b): one link for each two entities a < b any of whose texts (of several sides) are near-duplicates: the strongest by
    (exact first, higher similarity, sides); jaccard is rounded to 4 places.

    An entity's copies of a body are one, its least side. Two entities of one body each meet once, and their link stays where it is found; only links of entities with several
    bodies are moved, for the strongest of them.
    """
    keyed = rows.select(F.struct(F.col(entity).alias("e"), F.col(side).alias("s")).alias("_key"), F.col(text).alias("_text"))
    members, both = near_duplicate_classes(keyed, "_key", "_text", num, den, n, code)
    one = members.groupBy("rep", F.col("_key.e").alias("e")).agg(F.min("_key.s").alias("s"), F.first("size").alias("size"))
    several = one.groupBy("e").agg((F.count("*") > 1).alias("several"))
    one = stored(one.join(several, "e").select(F.col("rep").alias("c"), F.struct("e", "s", "several").alias("m"), "rep", "size"))
    links = stored(class_links(one, both))
    mixed = one.where("m.several").select("c").distinct()
    some = links.join(mixed.toDF("x"), "x", "left_semi").select(*links.columns).union(links.join(mixed.toDF("y"), "y", "left_semi").select(*links.columns)).distinct()

    def told(found, *more):
        pick = lambda x, y, f: F.when(F.col("u.e") < F.col("v.e"), F.col(f"{x}.{f}")).otherwise(F.col(f"{y}.{f}"))
        return found.where("u.e <> v.e").select(pick("u", "v", "e").alias("a"), pick("v", "u", "e").alias("b"), "kind", *more, pick("u", "v", "s").alias("side_a"), pick("v", "u", "s").alias("side_b"))

    near = lambda df: df.select("x", "y", "kind", F.round(F.col("shared") / F.col("total"), 4).alias("jaccard"), (-F.col("shared") / F.col("total")).alias("less"))
    plain = told(paired(near(links), one.where("NOT m.several").select("c", "m")), "jaccard")
    each = told(paired(near(some), one.select("c", "m")).where("u.several OR v.several"), "jaccard", "less")
    best = each.groupBy("a", "b").agg(F.min(F.struct((F.col("kind") != "exact").alias("o"), "less", "side_a", "side_b", "kind", "jaccard")).alias("k"))
    return plain.union(best.select("a", "b", "k.kind", "k.jaccard", "k.side_a", "k.side_b"))


def spanning_links(rows: DataFrame, key: str, text: str, num: int = 4, den: int = 5, n: int = 3, code: bool = True) -> DataFrame:
    """(a, b) that connect what near_duplicate_links does, with one link for each copy instead of all pairs of copies."""
    members, both = near_duplicate_classes(rows, key, text, num, den, n, code)
    return members.where(F.col(key) != F.col("rep")).select(F.col("rep").alias("a"), F.col(key).alias("b")).union(both.select("a", "b"))


#: Bytes of the items' hashes that may be broadcast.
SMALL = 8 << 20


def containment(rows: DataFrame, key: str, text: str, items: DataFrame, item: str, item_text: str, n: int) -> DataFrame:
    """(key, item, shared, size): how many of an item's distinct n-word shingles a row's text holds, where any.

    Rows first tell hashes of their shingles only; texts are cut into shingles again where a hash is an item's, and then the words are compared. The
    items' hashes are broadcast if they are few; else they are joined.
    """
    def words(df, k, t):
        w = F.filter(F.split(F.lower(F.col(t)), r"[^\p{L}\p{N}]+"), lambda x: x != "")
        return df.where(F.col(t).isNotNull()).select(k, w.alias("w")).where("size(w) > 0")

    places = F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1)))

    def of(df, k, t):
        return words(df, k, t).select(k, F.explode(F.array_distinct(F.transform(places, lambda i: F.array_join(F.slice("w", i, n), " ")))).alias("s"))

    def hashed(df, k, t):
        each = words(df, k, t).select(k, F.transform("w", lambda x: F.xxhash64(x)).alias("w"))
        return each.select(k, F.explode(F.transform(places, lambda i: F.xxhash64(F.slice("w", i, n)))).alias("h"))

    own = kept(of(items, item, item_text))
    sizes = own.groupBy(item).agg(F.count("*").alias("size"))
    hashes = kept(hashed(items, item, item_text).select("h").distinct())
    few = F.broadcast(hashes) if hashes.count() * 16 <= SMALL else hashes
    some = hashed(rows, key, text).join(few, "h", "left_semi").select(key).distinct()
    hit = of(rows.join(some, key, "left_semi"), key, text).join(own, "s").groupBy(key, item).agg(F.count("*").alias("shared"))
    return hit.join(sizes, item).select(key, item, "shared", "size")
