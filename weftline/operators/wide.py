"""Attribute-value rows into one typed row per entity."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.typed_text import folded, has_value, read_boolean, read_date, read_number, trimmed
from weftline.plans.bounded import small_side
from weftline.plans.durable import materialize, scratch

_SQL_TYPE = {"int": "bigint", "double": "double", "boolean": "boolean", "date": "date", "string": "string"}
_SLOT = {t: f"n_{t}" for t in _SQL_TYPE}
#: Narrow tables that one stage joins with the entities; more are joined by nodes, whose results are joined in turn.
FAN_IN = 16


def typed_cells(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """One row per attribute row with a known key and a value: ``entity``, ``attr_name``, and the value in the slot of its type.

    ``rows``: ``entity``, ``attribute``, ``value`` (text). ``dictionary``: ``spelling``,
    ``attr_name``, ``value_type``. A key belongs to the spelling it equals apart from case,
    ё/е and outer blanks; other keys are dropped, and so are texts that mean no value. Texts that
    the type can't read leave all slots NULL.
    """
    keys = dictionary.select(folded(F.col("spelling")).alias("k"), "attr_name", "value_type").distinct()
    known = rows.withColumn("key", folded(F.col("attribute"))).join(small_side(keys), F.col("key") == F.col("k")).filter(has_value(F.col("value")))
    of = lambda *types: F.col("value_type").isin(*types)
    v = F.col("value")
    # Each text is read once: numbers first, whole numbers out of them.
    read = known.select("entity", "attr_name", "value_type", F.when(of("int", "double"), read_number(v)).alias("number"), F.when(of("boolean"), read_boolean(v)).alias("n_boolean"), F.when(of("date"), read_date(v)).alias("n_date"), F.when(of("string"), trimmed(v)).alias("n_string"))
    n = F.col("number")
    whole = of("int") & (n == F.floor(n)) & (F.abs(n) < 9e15)
    return read.select("entity", "attr_name", F.when(whole, n.cast("long")).alias("n_int"), F.when(of("double"), n).alias("n_double"), "n_boolean", "n_date", "n_string")


def _specification(dictionary: DataFrame, entity: str) -> dict[str, str]:
    """attr_name -> type, of a small fixed table."""
    spec: dict[str, str] = {}
    for r in dictionary.select("attr_name", "value_type").distinct().collect():
        if r["value_type"] not in _SLOT:
            raise ValueError(f"unknown type {r['value_type']!r} of attribute {r['attr_name']!r}")
        if spec.setdefault(r["attr_name"], r["value_type"]) != r["value_type"]:
            raise ValueError(f"attribute {r['attr_name']!r} has two types")
    if entity in spec:
        raise ValueError(f"attribute {entity!r} clashes with the entity column")
    return dict(sorted(spec.items()))


def narrow_tables(cells: DataFrame, spec: Mapping[str, str]) -> list[DataFrame]:
    """``entity`` and one typed column for each attribute: the narrow tables, each partitioned by entity.

    The cells are written once, partitioned by attribute (rebalanced before, so that an attribute's files follow its size: a hot
    attribute is split, small ones don't become many files). Two unequal values of a number, boolean or date leave the
    cell empty; of several strings the smallest (by code point) fills it. Repeats are reduced map-side.
    """
    spark = cells.sparkSession
    path = scratch(spark, f"cells-{uuid.uuid4().hex}")
    number = F.create_map(*[x for i, n in enumerate(spec) for x in (F.lit(n), F.lit(i))])
    cells.withColumn("attr", number[F.col("attr_name")]).drop("attr_name").hint("rebalance", "attr").write.partitionBy("attr").parquet(path)
    stored = spark.read.schema(f"entity {cells.schema['entity'].dataType.simpleString()}, " + ", ".join(f"{s} {_SQL_TYPE[t]}" for t, s in _SLOT.items()) + ", attr int").parquet(path)
    out = []
    for i, (name, kind) in enumerate(spec.items()):
        slot = F.col(_SLOT[kind])
        low, high = F.min(slot), F.max(slot)
        one = stored.filter(F.col("attr") == i).groupBy("entity")
        out.append(one.agg((low if kind == "string" else F.when(low == high, low)).alias(name)))
    return out


def widen(entities: DataFrame, entity: str, rows: DataFrame, dictionary: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """One row per entity with one typed column per ``attr_name`` of the dictionary.

    Each attribute becomes a narrow typed table (``narrow_tables``), and the narrow tables are combined by a balanced
    tree of multiway outer joins. A node joins the entities, partitioned once, with up to ``fan_in`` narrow tables partitioned
    the same way, so nothing is shuffled between its joins; every entity stands on the left side, so left
    joins are as good as full ones, and keep the partitioning. With more attributes than ``fan_in`` the nodes' results are written and
    joined by the next level. Entities without any attribute
    keep a row of NULLs; NULL entities are dropped; repeated ones give one
    row. The dictionary is a small fixed table: its attribute names are read to the driver.
    Columns come in order of ``attr_name``. An attribute with two types is an error.
    """
    spec = _specification(dictionary, entity)
    spine = entities.select(F.col(entity).alias("entity")).filter("entity is not null").distinct()
    level = narrow_tables(typed_cells(rows, dictionary), spec) if spec else []

    def node(parts: list[DataFrame]) -> DataFrame:
        out = spine
        for p in parts:
            out = out.join(p, "entity", "left")
        return out

    while len(level) > fan_in:
        each = -(-len(level) // -(-len(level) // fan_in))  # nodes of even size
        level = [materialize(node(level[i : i + each]), "node") for i in range(0, len(level), each)]
    return node(level).withColumnRenamed("entity", entity).select(entity, *spec)


def filled_cells(wide: DataFrame, entity: str) -> DataFrame:
    """``entity``, ``attr_name`` of each cell that isn't NULL."""
    names = [c for c in wide.columns if c != entity]
    marks = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in names]))
    return wide.select(entity, F.explode(marks).alias("attr_name"))
