"""Key-value metadata: merging, typed columns, residual JSON, category groups."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_pairs(df: DataFrame, entity: str, key: str, value: str, order: str, sep: str = "; ") -> DataFrame:
    """One value per (entity, key): its distinct values joined in order of first appearance.

    Keys and values are trimmed; NULL and blank ones are dropped. Repeats are
    reduced to their first place before anything is collected, so a value repeated
    in a third of all rows is one element.
    """
    t = df.select(F.col(entity), F.trim(key).alias(key), F.trim(value).alias("__v"), F.col(order).alias("__o")).filter(f"`{key}` <> '' and __v <> ''")
    first = t.groupBy(entity, key, "__v").agg(F.min("__o").alias("__o"))
    merged = first.groupBy(entity, key).agg(F.array_sort(F.collect_list(F.struct("__o", "__v"))).alias("__a"))
    return merged.select(entity, key, F.array_join(F.transform("__a", lambda x: x["__v"]), sep).alias(value))


def as_map(merged: DataFrame, entity: str, key: str, value: str, out: str = "attrs") -> DataFrame:
    """One row per entity with a map of its merged keys."""
    return merged.groupBy(entity).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias(out))


def pivot_keys(attrs: Column | str, keys: Mapping[str, str]) -> list[Column]:
    """A column per listed key (key -> column name), NULL where missing."""
    m = F.col(attrs) if isinstance(attrs, str) else attrs
    return [F.try_element_at(m, F.lit(k)).alias(name) for k, name in keys.items()]


def residual_json(attrs: Column | str, typed: list[str]) -> Column:
    """JSON of the keys that have no column of their own, sorted by key."""
    m = F.col(attrs) if isinstance(attrs, str) else attrs
    rest = F.map_filter(m, lambda k, v: ~k.isin(typed)) if typed else m
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(rest))))


def category_table(groups: Mapping[str, list[str]]) -> dict[str, str]:
    """category -> group; a category listed twice is an error."""
    out: dict[str, str] = {}
    for group, names in groups.items():
        for n in names:
            if n in out:
                raise ValueError(f"category {n!r} belongs to {out[n]!r} and {group!r}")
            out[n] = group
    return out


def category_group(category: Column | str, groups: Mapping[str, list[str]]) -> Column:
    """Group of a category by a literal map; unknown and NULL ones are ``unmapped``."""
    c = F.col(category) if isinstance(category, str) else category
    table = category_table(groups)
    if not table:
        return F.lit("unmapped")
    lookup = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(lookup, F.coalesce(c, F.lit(""))), F.lit("unmapped"))
