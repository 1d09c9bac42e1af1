"""Upserts and merges as joins and aggregations (tables are immutable; the result is the new table)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.durable import materialize
from touchline.operators.matches import TIE


def upsert_versions(rows: DataFrame, keys: list[str], old: Column, new: Column, order: Column, overwrite: list[str], fill: list[str] = (), keep: list[str] = ()) -> DataFrame:
    """``upsert`` of two roles of one table's rows: per key the least ``old`` row and the greatest ``new`` one by ``order``.  One shuffle."""
    body = F.struct(*overwrite, *fill, *keep)
    per = rows.groupBy(*keys).agg(F.min_by(body, F.when(old, order)).alias("o"), F.max_by(body, F.when(new, order)).alias("n"), F.max(new).alias("present"))
    rule = [F.when(F.col("present"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in overwrite]
    rule += [F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in fill] + [F.coalesce(f"o.{c}", f"n.{c}").alias(c) for c in keep]
    return per.filter("o is not null or n is not null").select(*keys, *rule)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], overwrite: list[str], fill: list[str] = (), keep: list[str] = ()) -> DataFrame:
    """New rows enter; matched rows take ``overwrite`` from the new row, ``fill`` from it where it has a value, and
    ``keep`` from it only where the old row has none.  Each side has one row for each key; rows of a null key are one.

    Both sides are united under a mark, so that one aggregation does what a full join would do after two."""
    columns = [*keys, *overwrite, *fill, *keep]
    both = old.select(*columns, F.lit(False).alias("_new")).unionByName(new.select(*columns, F.lit(True).alias("_new")))
    return upsert_versions(both, keys, ~F.col("_new"), F.col("_new"), F.lit(0), overwrite, fill, keep)


def last_write(rows: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """The newest row of each key (a partial aggregation, no window)."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("_r")).select(*keys, "_r.*")


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], required: list[str]) -> DataFrame:
    """Old rows, and new ones whose key is new and whose required columns are set."""
    return old.unionByName(new.dropna(subset=required).join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def first_and_last(rows: DataFrame, keys: list[str], old: Column, new: Column, order: Column, fields: list[str]) -> DataFrame:
    """keys, o and n: the ``fields`` of each key's least ``old`` row and of its greatest ``new`` one by ``order`` (null: it has none).  One
    shuffle, of these fields alone."""
    body = F.struct(*fields)
    return rows.groupBy(*keys).agg(F.min_by(body, F.when(old, order)).alias("o"), F.max_by(body, F.when(new, order)).alias("n"))


def _matched(keys: list[str]) -> Column:
    """Whether a key has an old row; keys with a null match none."""
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in keys], F.col("o").isNotNull())


def insert_ignore_versions(rows: DataFrame, keys: list[str], old: Column, new: Column, order: Column, required: list[str], fields: list[str]) -> DataFrame:
    """``insert_ignore`` of two roles of one table's rows, which are picked as in ``first_and_last``: neither a second pass nor a join."""
    enters = reduce(lambda a, b: a & b, [F.col(f"n.{c}").isNotNull() for c in required], ~_matched(keys))
    per = first_and_last(rows, keys, old, new, order, fields)
    return per.select(*keys, F.inline(F.array_compact(F.array("o", F.when(enters, F.col("n"))))))


def id_or_key(rows: DataFrame, keys: list[str], old: Column, new: Column, order: Column, second: list[str], value: str) -> DataFrame:
    """keys, ``value`` and how of each key's greatest ``new`` row: the value of the least ``old`` row of the same keys, or else the greatest of
    the old rows with the same ``second`` keys.

    Both roles come from one shuffle, written once; only rows without a value of their own are sent to their second keys."""
    per = materialize(first_and_last(rows, keys, old, new, order, [*second, value]))
    by_key = materialize(per.filter("o is not null").select("o.*").groupBy(*second).agg(F.max(value).alias("_b")).withColumn("_met", F.lit(True)))
    asked = per.filter("n is not null").select(*keys, *[F.col(f"n.{c}").alias(c) for c in second], F.when(_matched(keys), F.col(f"o.{value}")).alias("_a"), _matched(keys).alias("_id"))
    own = asked.filter("_a is not null").select(*keys, F.col("_a").alias(value), F.lit("id").alias("how"))
    rest = asked.filter("_a is null").join(by_key, second, "left")
    return own.unionByName(rest.select(*keys, F.col("_b").alias(value), F.when(F.col("_id"), "id").when(F.col("_met"), "key").otherwise("none").alias("how")))


def merge_sources(rows: DataFrame, keys: list[str], rank: str, fields: list[str]) -> DataFrame:
    """One row for each key; each field comes from the best-ranked source that has it."""
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(rank))).alias(c) for c in fields]
    return rows.groupBy(*keys).agg(*first, F.min(rank).alias("best_rank"), F.count("*").alias("merged"))


def alias_sweep(matches: DataFrame, aliases: DataFrame, fill: list[str]) -> DataFrame:
    """Rewrite aliased teams and ids (day_home_away) of ``matches`` by ``aliases`` (league, alias, canonical; one row each).

    Rows that collide become one: the row that kept its names wins, then the least key; its empty ``fill`` columns are
    taken from the next row that knows them."""
    to = lambda side: aliases.select("league", F.col("alias").alias(side), F.col("canonical").alias(f"_{side}"))
    named = matches.join(to("home"), ["league", "home"], "left").join(to("away"), ["league", "away"], "left")
    moved = F.col("_home").isNotNull() | F.col("_away").isNotNull()
    order = F.struct(moved.alias("moved"), *TIE)
    h, a = F.coalesce("_home", "home").alias("_h"), F.coalesce("_away", "away").alias("_a")
    filled = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_order"))).alias(c) for c in fill]
    one = named.select("league", "match_date", h, a, order.alias("_order"), *fill).groupBy("league", "match_date", "_h", "_a").agg(F.count("*").alias("n"), F.min("_order").alias("_order"), *filled)
    return one.select(F.concat_ws("_", F.col("match_date").cast("string"), "_h", "_a").alias("id"), "league", "n", *[F.col("_order")[c].alias(c) for c in TIE], *fill)


def intel_lookup(fixtures: DataFrame, reports: DataFrame, value: str) -> DataFrame:
    """Fixtures with ``value`` and key (intel_ok) of the last report of the same teams and day; names without regard to case.

    ``day`` is text on both sides, cut at its T; reports without a team are no match."""
    key = lambda c: F.lower(F.trim(c))
    day = F.split_part("day", F.lit("T"), F.lit(1))
    known = reports.filter((key("home") != "") & (key("away") != ""))
    last = known.groupBy(key("home").alias("_h"), key("away").alias("_a"), day.alias("_d")).agg(F.max_by(F.struct(F.col(value), F.col("ok").alias("intel_ok")), F.struct(*TIE)).alias("_last"))
    found = fixtures.withColumns({"_h": key("home"), "_a": key("away"), "_d": day}).join(last, ["_h", "_a", "_d"], "left")
    return found.select(*fixtures.columns, F.col("_last")[value].alias(value), F.col("_last.intel_ok").alias("intel_ok"))


def without_mocks(rows: DataFrame, allowed: bool = False) -> DataFrame:
    """Rows that are no mock (an unknown mark is none), or all where mocks are allowed."""
    return rows if allowed else rows.filter(F.coalesce("is_mock", F.lit(0)) == 0)


def keepers(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The rows, and as keep_... the ``order`` columns of the row of each one's group that stays: the least one.

    Groups' least rows are written before the join, so that Spark can split a group that very many rows share."""
    kept = materialize(rows.groupBy(*group).agg(F.min(F.struct(*order)).alias("_kept")))
    same = [rows[c].eqNullSafe(kept[c]) for c in group]
    return rows.join(kept, same).select(*[rows[c] for c in rows.columns], *[F.col("_kept")[c].alias(f"keep_{c}") for c in order])


def alias_sets(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """name, other: what each name reaches over ``aliases`` (alias, canonical): itself, one link in either direction, and from there one
    link more from a canonical name to its aliases.

    Three equi-joins; both directions of the links are written first, so that Spark can split the many aliases of one name."""
    links = aliases.select("alias", "canonical").filter("alias is not null and canonical is not null").distinct()
    up = materialize(links.select(F.col("alias").alias("name"), F.col("canonical").alias("other")))
    down = materialize(links.select(F.col("canonical").alias("name"), F.col("alias").alias("other")))
    asked = names.select("name").filter("name is not null").distinct()
    near = asked.join(up.unionByName(down), "name").distinct()
    far = near.select(F.col("name").alias("of"), F.col("other").alias("name")).filter("of <> name").join(down, "name").select(F.col("of").alias("name"), "other")
    return asked.select("name", F.col("name").alias("other")).unionByName(near).unionByName(far).distinct()
