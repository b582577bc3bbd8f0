"""First valid row wins: which row owns each key, when a row takes its keys only if it ends valid."""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.functions import variants
from rowmill.operators.mapping import quoted
from rowmill.operators.transformations import INTEGRAL, is_decimal
from rowmill.plans.state import cut, dropped


def upsert_identity(c: Column, kind: str) -> Column:
    """The key as it is compared: numbers by value, dates in whole milliseconds (toward zero), text as it is."""
    if kind == "variant":
        return variants.identity(c, by_value=True)
    if kind in INTEGRAL:
        return c.cast("decimal(38,0)")
    if is_decimal(kind) or kind in ("string", "boolean"):
        return c
    if kind in ("double", "float"):
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c.try_cast("decimal(38,12)"))
    if kind in ("date", "timestamp", "timestamp_ntz"):
        micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c.cast("timestamp_ntz"))
        return F.when(micros >= 0, F.floor(micros / 1000)).otherwise(-F.floor(-micros / 1000))
    return F.lit(None).cast("string")


def owners_of_one(rows: DataFrame, key: str, order: str, candidate: str) -> DataFrame:
    """(key, owner): the first candidate of each key that two rows have at least; a candidate alone with its key owns it anyway.

    An aggregate, so a hot key costs one row for each task. The table is written, so that it is joined by its real size:
    where few keys repeat, the rows themselves are not shuffled.
    """
    each = rows.groupBy(F.col(key).alias("key")).agg(F.min(F.when(F.col(candidate), F.col(order))).alias("owner"), F.count("*").alias("n"))
    return cut(each.where("n > 1 and owner is not null").select("key", "owner"), "owners")


def owners_of_many(candidates: DataFrame, keys: list[str], order: str) -> list[DataFrame]:
    """For each key column, (key, owner) of the rows accepted in order, each only if none of its keys is taken.

    In each round a row that is first in all its keys is accepted, and rows that share a key with
    an accepted one go. A row that waits for one earlier row alone is accepted if that one is not: chains of such rows are
    settled in the same round, by pointers that double, so a chain of n rows takes log n joins. That gives
    what accepting one by one in order would give; the rounds follow the longest chain of rows that wait for two others or more.
    """
    active = cut(candidates.select(order, *keys), "candidates")
    accepted: list[DataFrame] = []
    while active.limit(1).count():
        won = _settled(active, keys, order)
        accepted.append(won)
        waiting = active
        for key in keys:
            waiting = waiting.join(won.select(F.col(key).alias("__taken")).distinct(), F.col(key) == F.col("__taken"), "left_anti")
        waiting = cut(waiting, "candidates")
        dropped(active)
        active = waiting
    every = reduce(DataFrame.union, accepted) if accepted else active
    return [every.select(F.col(key), F.col(order).alias("owner")) for key in keys]


def _settled(active: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows that are surely accepted: first in all their keys, or at the end of a chain of rows that wait for one other each."""
    ranked = active
    for i, key in enumerate(keys):
        # the first row of each key, and the first behind it: two aggregates, so a hot key is a row for each task
        first = active.groupBy(F.col(key).alias(f"__g{i}")).agg(F.min(order).alias(f"__m{i}"))
        ranked = ranked.join(first, F.col(key) == F.col(f"__g{i}"))
    ranked = cut(ranked.drop(*(f"__g{i}" for i in range(len(keys)))), "ranked")
    waits = None
    for i, key in enumerate(keys):
        behind = ranked.where(F.col(order) > F.col(f"__m{i}"))
        second = behind.groupBy(F.col(key).alias(f"__g{i}")).agg(F.min(order).alias(f"__s{i}"))
        waits = (ranked if waits is None else waits).join(second, F.col(key) == F.col(f"__g{i}"), "left").drop(f"__g{i}")
    free = reduce(lambda a, b: a & b, (F.col(f"__m{i}") == F.col(order) for i in range(len(keys))))
    before = [F.when(F.col(f"__m{i}") < F.col(order), F.col(f"__m{i}")) for i in range(len(keys))]
    # in each key first or second, and behind the same row wherever second
    near = reduce(lambda a, b: a & b, ((F.col(f"__m{i}") == F.col(order)) | (F.coalesce(F.col(f"__s{i}") == F.col(order), F.lit(False))) for i in range(len(keys))))
    least, most = (F.least(*before), F.greatest(*before)) if len(keys) > 1 else (before[0], before[0])
    kind = F.when(free, "free").when(near & (least == most), "one").otherwise("more")
    waits = cut(waits.select(order, *keys, kind.alias("__kind"), least.alias("__up")), "waits")
    dropped(ranked)
    won = waits.where("__kind = 'free'").select(order, *keys)
    chain = waits.where("__kind = 'one'").select(order, F.col("__up").alias("up"), F.lit(True).alias("turned"))
    if not chain.isEmpty():
        won = won.unionByName(waits.join(_at_even_places(chain, waits.where("__kind = 'free'").select(F.col(order).alias("root")), order), order, "left_semi").select(order, *keys))
    return cut(won, "accepted")


def _at_even_places(chain: DataFrame, roots: DataFrame, order: str) -> DataFrame:
    """The rows of chains (each row with the one it waits for) that are an even number of steps from an accepted root."""
    chain = cut(chain, "chain")
    while True:
        up = chain.select(F.col(order).alias("__at"), F.col("up").alias("__next"), F.col("turned").alias("__more"))
        jumped = chain.join(up, F.col("up") == F.col("__at"), "left")
        step = cut(jumped.select(order, F.coalesce("__next", "up").alias("up"), F.when(F.col("__at").isNull(), F.col("turned")).otherwise(F.col("turned") != F.col("__more")).alias("turned"), F.col("__at").isNotNull().alias("moved")), "chain")
        dropped(chain)
        chain = step.drop("moved")
        if step.where("moved").isEmpty():
            return chain.where("not turned").join(roots, F.col("up") == F.col("root"), "left_semi").select(order)


@dataclass(frozen=True)
class Key:
    """Columns that identify rows. kind: primary, unique (both declared by a source) or found (by looking at all rows)."""

    columns: tuple[str, ...]
    kind: str = "found"
    name: str = ""


class NoKey(ValueError):
    """Nothing identifies the rows."""


def chosen_key(keys: list[Key]) -> Key:
    """The key that rows are ordered by: the primary one, else a declared unique one, else a found one; the first by name, then by columns. None is an error."""
    usable = [k for k in keys if k.columns]
    if not usable:
        raise NoKey("The table has no primary key and no unique key without nulls, so its rows have no fixed order.")
    return min(usable, key=lambda k: (("primary", "unique", "found").index(k.kind), len(k.columns) if k.kind == "found" else 0, k.name, k.columns))


def discover_keys(df: DataFrame, most: int = 3, columns: list[str] | None = None, error: float = 0.02) -> list[Key]:
    """The smallest sets of at most `most` columns that identify all rows, fewest columns first, then in the order of the table.

    Level by level: sets whose columns can't have enough different values together, or hold a set that is a key, are passed over; the others are
    looked at by distinct-count sketches, all of a level in one pass, and those that may be keys are counted
    exactly, a two-step aggregate each. Columns with nulls, and types without an order, take no part. A sketch passes a set over only if it is ten standard errors short.
    """
    kinds = dict(df.dtypes)
    names = [c for c in (columns or df.columns) if not kinds[c].startswith(("map", "variant", "interval"))]
    if not names:
        return []
    sketch = lambda *cs: F.approx_count_distinct(F.struct(*map(quoted, cs)) if len(cs) > 1 else quoted(cs[0]), error)
    first = df.agg(F.count("*").alias("n"), *(F.count_if(quoted(c).isNull()).alias(f"n{i}") for i, c in enumerate(names)), *(sketch(c).alias(f"d{i}") for i, c in enumerate(names))).first()
    rows, enough = first["n"], first["n"] * (1 - 10 * error)
    distinct = {c: first[f"d{i}"] for i, c in enumerate(names) if not first[f"n{i}"]}
    found: list[Key] = []
    for size in range(1, most + 1):
        level = [s for s in itertools.combinations(distinct, size) if not any(set(k.columns) <= set(s) for k in found) and math.prod(distinct[c] * (1 + 10 * error) for c in s) >= enough]
        if size > 1 and level:
            many = df.agg(*(sketch(*s).alias(f"s{i}") for i, s in enumerate(level))).first()
            level = [s for i, s in enumerate(level) if many[f"s{i}"] >= enough]
        else:
            level = [s for s in level if distinct[s[0]] >= enough]
        if level:
            exact = {r["columns"]: r["is_key"] for r in candidate_keys(df, [list(s) for s in level]).collect()}
            found += [Key(s) for s in level if exact[",".join(s)]]
    return found if rows else []


def candidate_keys(df: DataFrame, column_sets: list[list[str]]) -> DataFrame:
    """For each set of columns, whether it identifies rows: (columns, n_rows, n_distinct, n_null, is_key), key candidates first.

    Each set is counted by its own two-step aggregate, so no count holds all values in one task.
    """
    out = []
    for names in column_sets:
        nulls = reduce(lambda a, b: a | b, (quoted(n).isNull() for n in names))
        per = df.select(*map(quoted, names)).groupBy(*map(quoted, names)).agg(F.count("*").alias("n"), F.sum(nulls.cast("long")).alias("nulls"))
        row = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_distinct"), F.coalesce(F.sum("nulls"), F.lit(0)).alias("n_null"))
        out.append(row.select(F.lit(",".join(names)).alias("columns"), "n_rows", "n_distinct", "n_null", ((F.col("n_rows") == F.col("n_distinct")) & (F.col("n_null") == 0)).alias("is_key")))
    return reduce(DataFrame.union, out)
