"""Append-only histories and names: helpers of writers that never overwrite what was known."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_name(name: Column, aliases: Mapping[str, str]) -> Column:
    """The name that an alias stands for, by a literal map; other names stay."""
    pairs = [F.lit(x) for kv in sorted(aliases.items()) for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), name), name) if pairs else name


def display_name(key: Column) -> Column:
    """A key as a title: underscores become spaces, words begin with capitals."""
    return F.initcap(F.replace(key, F.lit("_"), F.lit(" ")))


def appended(history: DataFrame, batch: DataFrame, keys: Sequence[str], value: str, at: str) -> DataFrame:
    """Rows of the batch (one a key) whose value differs from the latest one in history: what append-on-change writes."""
    latest = history.groupBy(*keys).agg(F.max_by(value, at).alias("__latest"), F.lit(True).alias("__any"))
    joined = batch.join(latest, list(keys), "left")
    return joined.where(F.col("__any").isNull() | ~F.col(value).eqNullSafe(F.col("__latest"))).select(*batch.columns)


def differs(old: Column, new: Column, fields: Sequence[str], free: Sequence[str] = ("status",)) -> Column:
    """Whether two rows (structs) differ in any field but those that may change; NULL equals NULL."""
    pinned = [f for f in fields if f not in free]
    return ~F.struct(*[old[f].alias(f) for f in pinned]).eqNullSafe(F.struct(*[new[f].alias(f) for f in pinned]))


def merged_ids(old: Column, new: Column) -> Column:
    """A map of external ids with the other's entries put over it; a NULL map is an empty one, NULL values don't overwrite."""
    empty = F.create_map().cast("map<string,string>")
    put = F.map_filter(F.coalesce(new, empty), lambda k, v: v.isNotNull())
    return F.map_concat(F.map_filter(F.coalesce(old, empty), lambda k, v: ~F.map_contains_key(put, k)), put)


def guarded(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """What an append-only table with a status makes of an update: key and verdict (``ok``, ``deleted``, ``immutable`` for
    any other change, ``transition`` for a status that leaves a final state; ``inserted`` for new rows)."""
    fields = [c for c in old.columns if c != key]
    both = old.select(key, F.struct(*fields).alias("o")).join(new.select(key, F.struct(*fields).alias("n")), key, "full")
    o, n = F.col("o"), F.col("n")
    settled = ~F.coalesce(allowed_transition(o["status"], n["status"]), F.lit(False))
    return both.select(key, F.when(o.isNull(), "inserted").when(n.isNull(), "deleted").when(differs(o, n, fields), "immutable").when(settled, "transition").otherwise("ok").alias("verdict"))


def allowed_transition(old: Column, new: Column) -> Column:
    """A pick leaves ``pending`` for a final state, and never that one."""
    return (old == "pending") & new.isin("won", "lost", "push", "void") | (old == new)
