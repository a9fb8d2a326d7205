"""Entity-attribute-value rows out of JSON texts of several layouts."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class _Pairs(list):
    """A JSON object as its (key, value) pairs, repeated keys included."""


def _text(v) -> str | None:
    if v is None or isinstance(v, str):
        return v
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return repr(v)
    return json.dumps(v, ensure_ascii=False)


def json_pairs(text: str | None) -> list[tuple[str, str | None]]:
    """(key, value text) pairs of an object, a list of [key, value], a list of {"key", "value"} objects, or any of them encoded once more as a string.

    NULL, empty and broken texts, and other JSON, give no pairs.
    """
    try:
        o = json.loads(text, object_pairs_hook=_Pairs) if text else None
        if isinstance(o, str):
            o = json.loads(o, object_pairs_hook=_Pairs)
    except (ValueError, RecursionError):
        return []
    if isinstance(o, _Pairs):
        return [(k, _text(v)) for k, v in o]
    out = []
    for e in o if isinstance(o, list) else []:
        if isinstance(e, _Pairs):
            m = dict(e)
            k, v = m.get("key"), m.get("value")
        elif isinstance(e, list) and len(e) == 2:
            k, v = e
        else:
            continue
        if isinstance(k, str):
            out.append((k, _text(v)))
    return out


def _explode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        ids, keys, values = [], [], []
        for i, t in enumerate(batch.column(1).to_pylist()):
            for k, v in json_pairs(t):
                if v is not None:
                    ids.append(i)
                    keys.append(k)
                    values.append(v)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(keys, pa.string()), pa.array(values, pa.string())], ["entity", "attribute", "value"])


def attribute_rows(df: DataFrame, entity: str, text: str) -> DataFrame:
    """``entity``, ``attribute``, ``value`` (text) rows of a JSON column, map-only; repeated rows give repeated rows, JSON null gives no row."""
    src = df.select(F.col(entity).alias("entity"), F.col(text).alias("text")).filter("entity is not null and text is not null and text <> ''")
    kind = src.schema["entity"].dataType.simpleString()
    return src.mapInArrow(_explode, f"entity {kind}, attribute string, value string")
