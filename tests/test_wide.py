import datetime

import pytest
from pyspark.sql import functions as F

from weftline.functions import typed_text as tt
from weftline.operators.wide import filled_cells, widen
from weftline.sources.json_attributes import attribute_rows


def test_numbers(spark):
    good = {"5": 5, "1 760 г": 1760, "1 760": 1760, "34,5 см": 34.5, " 2шт.": 2, "36 °C": 36, "2.5 %": 2.5, "195 г/м²": 195, "-3": -3, "5.0": 5}
    bad = ["46-48", "1…3", "12 / 14", "1; 2", "по таблице", "?", "", "-", "около 5", "5 или 6", "1,2,3", "true"]
    df = spark.createDataFrame([(x,) for x in [*good, *bad]], "t string").select("t", tt.read_number(F.col("t")).alias("n"), tt.read_integer(F.col("t")).alias("i"))
    got = {r["t"]: r for r in df.collect()}
    assert {t: got[t]["n"] for t in good} == good and all(got[t]["n"] is None for t in bad)
    assert got["34,5 см"]["i"] is None and got["5.0"]["i"] == 5


def test_dates_and_booleans(spark):
    d = {"2024-02-29": (2024, 2, 29), " 18.11.2025 ": (2025, 11, 18), "05/03/2025": (2025, 3, 5), "2025-04-31": None, "2025-13-04": None, "31.02.2025": None, "март 2025": None, "09.2025": None}
    b = {"Да": True, "НЕТ ": False, "есть": True, "1": True, "0": False, "no": False, "да; нет": None, "частично": None, "2": None}
    df = spark.createDataFrame([(x,) for x in [*d, *b]], "t string").select("t", tt.read_date(F.col("t")).alias("d"), tt.read_boolean(F.col("t")).alias("b"))
    got = {r["t"]: r for r in df.collect()}
    assert {t: got[t]["d"] for t in d} == {t: v and datetime.date(*v) for t, v in d.items()} and {t: got[t]["b"] for t in b} == b


DICT = [("Вес, г", "weight", "int"), ("Масса", "weight", "int"), ("Подкладка", "lined", "boolean"), ("Состав ткани", "mix", "string"), ("Снято", "shot", "date"), ("Длина", "len", "double")]


def wide(spark, rows, dictionary=DICT):
    df = spark.createDataFrame(rows, "sku_id string, attrs_json string").selectExpr("*", "1 as entity", "2 as attr", "3 as weight")
    return widen(df, "sku_id", attribute_rows(df, "sku_id", "attrs_json"), spark.createDataFrame(dictionary, "spelling string, attr_name string, value_type string"))


def test_one_row_per_entity(spark):
    rows = [
        ("a", '{" ВЕС, Г ": "1 200 г", "масса": 1200, "Подкладка": "по желанию", "Состав ткани": " лён ", "x": 1}'), ("a", '{" ВЕС, Г ": "1 200 г", "масса": 1200, "Подкладка": "по желанию", "Состав ткани": " лён ", "x": 1}'),
        ("b", '{"Масса": 5, "Вес, г": 6, "Подкладка": true, "Снято": "01.02.2024", "Длина": 5.5}'), ("c", None), ("d", "broken"), ("e", '{"Состав ткани": "n/a", "Длина": "—"}'), (None, '{"Масса": 5}'), ("f", '[["Состав ткани", "б"], ["Состав ткани", "а"]]'),
    ]
    df = wide(spark, rows)
    assert df.columns == ["sku_id", "len", "lined", "mix", "shot", "weight"] and dict(df.dtypes)["weight"] == "bigint"
    got = {r["sku_id"]: tuple(r)[1:] for r in df.collect()}
    none = (None,) * 5
    assert got == {"a": (None, None, "лён", None, 1200), "b": (5.5, True, None, datetime.date(2024, 2, 1), None), "c": none, "d": none, "e": none, "f": (None, None, "а", None, None)}
    assert {tuple(r) for r in filled_cells(df, "sku_id").collect()} == {("a", "mix"), ("a", "weight"), ("b", "len"), ("b", "lined"), ("b", "shot"), ("f", "mix")}


def test_edges(spark):
    assert wide(spark, []).count() == 0
    assert wide(spark, [("a", "{}")], DICT[:1]).collect()[0].asDict() == {"sku_id": "a", "weight": None}
    with pytest.raises(ValueError):
        wide(spark, [("a", "{}")], [("x", "y", "int"), ("z", "y", "date")])
    with pytest.raises(ValueError):
        wide(spark, [("a", "{}")], [("x", "sku_id", "int")])


@pytest.mark.parametrize("fan_in", [2, 3, 16])
def test_nodes_of_a_tree_give_the_same_row(spark, fan_in):
    names = [f"a{i}" for i in range(7)]
    dictionary = spark.createDataFrame([(n, n, "int") for n in names], "spelling string, attr_name string, value_type string")
    cells = [(f"e{e}", n, str(e * i)) for e in range(40) for i, n in enumerate(names) if (e + i) % 3]
    df = widen(spark.createDataFrame([(f"e{e}",) for e in range(41)], "id string"), "id", spark.createDataFrame(cells, "entity string, attribute string, value string"), dictionary, fan_in)
    got = {r["id"]: tuple(r)[1:] for r in df.collect()}
    assert got == {f"e{e}": tuple(e * i if (e + i) % 3 and e < 40 else None for i in range(7)) for e in range(41)}


def test_joins_of_a_node_shuffle_nothing(spark):
    df = wide(spark, [("a", '{"Масса": 5}')])
    plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
    joins = max(i for i, x in enumerate(plan) if "Join" in x)
    assert not [x for x in plan[:joins] if "Exchange" in x and plan.index(x) < min(i for i, y in enumerate(plan) if "Join" in y)]
    # One exchange for each narrow table and one for the entities.
    assert sum("Exchange hashpartitioning" in x for x in plan) <= 6
