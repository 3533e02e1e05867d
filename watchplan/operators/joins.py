"""Joins of the catalogue: stars, latest-per-key, semi, interval overlap, disjunctive ids, rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchplan.sources.shared import folder, written

#: Sides counted below this many rows may be broadcast.
SMALL_ROWS = 200_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows (it reads no further than that to find out)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def star(fact: DataFrame, dims: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """fact left-joined to dimensions (dim, fact column, dim key); Catalyst broadcasts those whose size allows it."""
    return reduce(lambda acc, x: acc.join(x[0], acc[x[1]] == x[0][x[2]], "left"), dims, fact)


def latest(df: DataFrame, by: list[str], order: list[Column], name: str = "latest") -> DataFrame:
    """One row per key: the first in the given order (LATERAL ... LIMIT 1), by a window, which moves every row to its key.

    Where all orders descend and nulls come last, latest_by_max does the same with a maximum that tasks make first.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) == 1).drop(name)


def latest_by_max(df: DataFrame, by: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """latest() for descending orders, as a pre-aggregated maximum: hot keys cost one row per task."""
    top = df.groupBy(*by).agg(F.max(F.struct(*order, *(c for c in keep if c not in order))).alias("_top"))
    return top.select(*by, *(F.col(f"_top.{c}").alias(c) for c in dict.fromkeys([*order, *keep])))


def exists(df: DataFrame, other: DataFrame, on: Column | list[str]) -> DataFrame:
    return df.join(other, on, "left_semi")


def orphans(df: DataFrame, parent: DataFrame, on: Column | list[str]) -> DataFrame:
    return df.join(parent, on, "left_anti")


def interval_overlap(left: DataFrame, right: DataFrame, keys: list[str], left_range: tuple[str, str], right_range: tuple[str, str], width: str) -> DataFrame:
    """Rows of left and right of equal keys whose ranges strictly overlap.

    Both sides are cut into cells of `width` time, so that a long history of one key isn't one join
    key; a pair counts in the first cell that both are in.  Left columns keep their names, right ones get r_.
    """
    span = F.lit(_seconds(width))
    floor = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / span)
    mark = lambda df, rng, first: df.where(F.col(rng[0]) < F.col(rng[1])).withColumn(first, floor(rng[0])).withColumn("cell", F.explode(F.sequence(floor(rng[0]), floor(rng[1]))))
    right = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns))
    a, b = mark(left, left_range, "_a"), mark(right, tuple(f"r_{c}" for c in right_range), "_b").withColumnRenamed("cell", "_cell")
    on = [a[k] == b[f"r_{k}"] for k in keys] + [a["cell"] == b["_cell"], a["cell"] == F.greatest("_a", "_b")]
    on += [b[f"r_{right_range[0]}"] < a[left_range[1]], b[f"r_{right_range[1]}"] > a[left_range[0]]]
    return a.join(b, reduce(lambda x, y: x & y, on)).drop("cell", "_cell", "_a", "_b")


def _seconds(width: str) -> int:
    n, unit = width.split()
    return int(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]


def close_pairs(df: DataFrame, key: str, by: list[str], within: dict[str, tuple[float, bool]]) -> DataFrame:
    """Pairs (a, b), a < b, of rows alike in `by` and no further apart than given in each column of `within`: (distance, whether it counts itself).

    Each column is cut into cells of that distance, and a row meets those of its own and the neighbouring cells alone.
    """
    cells = list(within)
    cell = lambda c: F.floor(F.col(c) / within[c][0]).cast("long")
    left = df.select(*by, F.col(key).alias("a"), *(F.col(c).alias(f"_a{c}") for c in cells), *(cell(c).alias(f"_c{c}") for c in cells))
    right = df.select(*by, F.col(key).alias("b"), *(F.col(c).alias(f"_b{c}") for c in cells), *(cell(c).alias(f"_c{c}") for c in cells))
    for c in cells:
        right = right.withColumn(f"_c{c}", F.explode(F.array(F.col(f"_c{c}") - 1, F.col(f"_c{c}"), F.col(f"_c{c}") + 1)))
    both = left.join(right, [*by, *(f"_c{c}" for c in cells)]).where("a < b")
    for c, (most, itself) in within.items():
        apart = F.abs(F.col(f"_a{c}") - F.col(f"_b{c}"))
        both = both.where(apart <= most if itself else apart < most)
    return both.select(*by, "a", "b")


def any_id(events: DataFrame, ids: list[str], other: DataFrame, key: str) -> DataFrame:
    """events joined to other where key is among the ids: once per (event, row), as SQL's IN; an equi-join on exploded distinct ids."""
    one = events.withColumn("_id", F.explode(F.array_distinct(F.array_compact(F.array(*ids)))))
    return one.join(other, one["_id"] == other[key]).drop("_id")


def first_key(df: DataFrame, keys: list[str], lookup: DataFrame, key: str, value: str) -> DataFrame:
    """df with `value` found by the first of several candidate keys that the lookup has."""
    own = lookup.groupBy(key).agg(F.min(value).alias("_v"))
    out = df
    for n, k in enumerate(keys):
        out = out.join(own.select(F.col(key).alias(f"_k{n}"), F.col("_v").alias(f"_v{n}")), F.col(k) == F.col(f"_k{n}"), "left")
    found = F.coalesce(*(F.col(f"_v{n}") for n in range(len(keys))))
    return out.withColumn(value, found).drop(*(f"_{x}{n}" for n in range(len(keys)) for x in "kv"))


#: A block has at most 2 to the power of BLOCK_BITS rules; the blocks of a place are dealt to DEALS tasks, those met with 'all' to a grid of FAR.
BLOCK_BITS, DEALS, FAR = 8, 16, (64, 4)


def conflicting_rules(rules: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of rules that may contradict: types differ or one is 'other', events equal or one is 'other', places overlap.

    Rules of a kind (type, event, place) are cut into blocks of ids, and blocks are joined by what their kinds say: those of a place with each other,
    and with those of 'all'.  Blocks alone are written and shuffled; each pair is made once, in the last stage, and never moved.  The pairs of two blocks
    follow one another as an a with its run of b's, so columnar files keep them in a fraction of a byte each.
    """
    n, kind = int(rules.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["rule_type", "event", "place"]
    r = rules.where("id is not null").select("id", "rule_type", "event", F.lower(F.trim("place")).alias("place"))
    # numbers run on within a partition: a block is some rows of one kind that follow one another, and a kind of many rules is many blocks of many tasks
    r = r.repartitionByRange(n, *kind, "id").sortWithinPartitions(*kind, "id").withColumn("n", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS))
    r = r.groupBy(*kind, "n").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    r = written(r.select(*kind, "ids", F.monotonically_increasing_id().alias("n")), f"{folder(rules.sparkSession)}/blocks")
    a, b = (r.select(*(F.col(c).alias(f"{s}_{c}") for c in r.columns)) for s in "ab")
    own = lambda c, deals: F.pmod(c, F.lit(deals)).cast("int")
    every = lambda deals: F.explode(F.sequence(F.lit(0), F.lit(deals - 1)))

    def met(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
        # by numbers of partitions, as what is read says nothing of the work
        left, right = left.repartition(n, *(f"a_{k}" for k in keys)), right.repartition(n, *(f"b_{k}" for k in keys)).hint("shuffle_hash")
        clash = F.expr("""(a_rule_type <> b_rule_type OR a_rule_type = 'other' OR b_rule_type = 'other') AND (a_event = b_event OR a_event = 'other' OR b_event = 'other')
            AND a_ids[0] < b_ids[size(b_ids) - 1]""")
        return left.join(right, reduce(lambda x, y: x & y, [F.col(f"a_{k}") == F.col(f"b_{k}") for k in keys], clash)).select("a_ids", "b_ids")

    dealt = lambda df, s, one, two: df.withColumn(f"{s}_one", one).withColumn(f"{s}_two", two)
    rest = lambda df, s: dealt(df.where(f"not {s}_place <=> 'all'"), s, own(f"{s}_n", FAR[0]), every(FAR[1]))
    wide = lambda df, s: dealt(df.where(f"{s}_place = 'all'"), s, every(FAR[0]), own(f"{s}_n", FAR[1]))
    near = met(a.withColumn("a_one", every(DEALS)), b.withColumn("b_one", own("b_n", DEALS)), ["place", "one"])
    blocks = near.unionByName(met(rest(a, "a"), wide(b, "b"), ["one", "two"])).unionByName(met(wide(a, "a"), rest(b, "b"), ["one", "two"]))
    return blocks.select(F.explode("a_ids").alias("a"), "b_ids").select("a", F.explode("b_ids").alias("b")).where("a < b")


def first_conflicts(rules: DataFrame, most: int) -> DataFrame:
    """The first `most` pairs of conflicting_rules by (a, b): only the `most` least ids that are some pair's a can have them.

    Whether an id is one depends on its kind (type, event, place) and the greatest id of the kinds that contradict it, so kinds are
    compared with kinds, and then at most `most` rules with all.
    """
    r = rules.select("id", "rule_type", "event", F.lower(F.trim("place")).alias("place"))
    clash = F.expr("""(a_type <> b_type OR a_type = 'other' OR b_type = 'other') AND (a_event = b_event OR a_event = 'other' OR b_event = 'other')
        AND (a_place = b_place OR a_place = 'all' OR b_place = 'all')""")
    side = lambda df, s: df.select(*(F.col(c).alias(f"{s}_{n}") for c, n in (("id", "id"), ("rule_type", "type"), ("event", "event"), ("place", "place"))))
    kinds = r.groupBy("rule_type", "event", "place").agg(F.max("id").alias("id"))
    one, two = side(kinds, "a"), side(kinds, "b")
    # kinds of 'all' are as many as there are types and events
    met = [one.join(two, clash & (F.col("a_place") == F.col("b_place"))), F.broadcast(one.where("a_place = 'all'")).join(two.where("not b_place <=> 'all'"), clash), one.where("not a_place <=> 'all'").join(F.broadcast(two.where("b_place = 'all'")), clash)]
    last = reduce(DataFrame.unionByName, met).groupBy(F.col("a_type").alias("type"), F.col("a_event").alias("event"), F.col("a_place").alias("place")).agg(F.max("b_id").alias("last"))
    own = F.expr("a_type <=> type AND a_event <=> event AND a_place <=> place AND a_id < last")
    a = side(r, "a").join(last, own).select("a_id", "a_type", "a_event", "a_place").orderBy("a_id").limit(most)
    return side(r, "b").join(F.broadcast(a), clash & (F.col("a_id") < F.col("b_id"))).select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).orderBy("a", "b").limit(most)


def duplicate_rules(rules: DataFrame) -> DataFrame:
    """Pairs of rules alike in normalised text, type, event and place."""
    norm = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    r = rules.select("id", norm("text").alias("t"), norm("rule_type").alias("y"), norm("event").alias("e"), norm("place").alias("p"))
    b = r.select(F.col("id").alias("b"), "t", "y", "e", "p")
    return r.withColumnRenamed("id", "a").join(b, ["t", "y", "e", "p"]).where("a < b").select("a", "b")
