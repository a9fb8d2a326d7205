import json
import struct

import pytest

from weftline.sources import directory, readers, writers
from weftline.sources.json_attributes import attribute_rows, json_pairs
from weftline.streaming.incremental import run_incremental


def webp(w, h):
    return b"RIFF\0\0\0\0WEBPVP8X\x0a\0\0\0\0\0\0\0" + (w - 1).to_bytes(3, "little") + (h - 1).to_bytes(3, "little") + b"\0" * 20


def test_headers():
    assert directory.image_size(webp(1000, 750)) == (1000, 750)
    assert directory.image_size(b"RIFF\0\0\0\0WEBPVP8 \0\0\0\0\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 450, 900)) == (450, 900)
    assert directory.image_size(b"RIFF\0\0\0\0WEBPVP8L\0\0\0\0\x2f" + ((99) | (49 << 14)).to_bytes(4, "little")) == (100, 50)
    assert directory.image_size(b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 7, 8)) == (7, 8)
    assert directory.image_size(b"") == directory.image_size(None) == directory.image_size(b"RIFF") == (-1, -1)


def test_lake(spark, tmp_path):
    item = tmp_path / "Верх 1" / "Блузка + шарф (2)"
    for branch, names in (("студия", ["10.webp", "2.webp"]), ("отзывы", ["1_fs.webp"]), ("прочее", ["x.webp"])):
        (item / branch).mkdir(parents=True)
        for n in names:
            (item / branch / n).write_bytes(webp(30, 40) if n != "2.webp" else b"")
    (item / "info.csv").write_text("key,value\nСостав,хлопок, лён\nЦвет, синий \nЦвет,белый\nЦвет,синий\nпусто\n", encoding="utf-8")
    root = str(tmp_path)
    listed = spark.createDataFrame([(str(p.relative_to(tmp_path)), p.stat().st_size) for p in item.rglob("*.webp")], "rel_path string, length long")
    branches = {"студия": "product", "отзывы": "review"}
    assert directory.scan_frames(spark, root, branches).count() == 2  # file sources skip empty files
    f = {r["rel_path"].split("/")[-1]: r for r in directory.scan_frames(spark, root, branches, inventory=listed).collect()}
    assert set(f) == {"10.webp", "2.webp", "1_fs.webp"} and f["10.webp"]["order_idx"] == 1 and f["10.webp"]["is_last_product"] and not f["1_fs.webp"]["is_last_product"]
    assert (f["10.webp"]["width"], f["10.webp"]["height"], f["2.webp"]["corrupt"], f["2.webp"]["file_size"]) == (30, 40, True, 0)
    i = directory.scan_items(spark, root).first()
    assert (i["category_raw"], i["folder"], i["sku_id"]) == ("Верх 1", "Блузка + шарф (2)", f["10.webp"]["sku_id"])
    kv = {(r["key"], r["value"]) for r in directory.read_info(spark, root).collect()}
    assert kv == {("Состав", "хлопок, лён"), ("Цвет", "синий"), ("Цвет", "белый")}


def test_info_files():
    text = '\ufeffkey,value\r\n"Состав, %","хлопок\nлён",5\r\nЦвет,"тёмно-""синий"""\r\n  ,x\nпусто,\nодин\n'
    assert directory.info_pairs(text) == [(1, "Состав, %", "хлопок\nлён,5"), (2, "Цвет", 'тёмно-"синий"')]
    assert directory.info_pairs(None) == directory.info_pairs("") == []


def test_json_layouts(spark):
    plain = [("a", "1"), ("a", "true"), ("b", None)]
    assert json_pairs('{"a": 1, "a": true, "b": null}') == plain == json_pairs('[["a", 1], ["a", true], ["b", null]]') == json_pairs('[{"key": "a", "value": 1}, {"key": "a", "value": true}, {"key": "b"}]')
    assert json_pairs(json.dumps('{"a": [1, "x"]}')) == [("a", '[1, "x"]')]
    assert json_pairs(None) == json_pairs("") == json_pairs("{") == json_pairs("3") == json_pairs("null") == json_pairs('[["a"], 5, {"value": 1}]') == []
    df = spark.createDataFrame([("i", '{"a": 1}'), ("i", '{"a": 1}'), (None, '{"a": 1}'), ("j", None)], "entity string, text string")
    assert [tuple(r) for r in attribute_rows(df, "entity", "text").collect()] == [("i", "a", "1")] * 2


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "labels_1.csv").write_text("image_id,rel_path,category_group,label,batch\na,p,upper,ok,1\n")
    (tmp_path / "labels_2.csv").write_text('image_id,rel_path,category_group,label,batch\na,p,upper,bad,2\nb,"q ""x""",upper,ok,2\n')
    got = {r["image_id"]: r for r in readers.read_labels(spark, f"{tmp_path}/labels_*.csv").collect()}
    assert got["a"]["label"] == "ok" and set(got) == {"a", "b"}
    log = str(tmp_path / "log.jsonl")
    for k in range(3):
        writers.append_log({"step": k, "loss": 1.5}, log)
    with open(log, "a") as f:
        f.write("\nbroken\n")
    assert readers.read_log(spark, log).count() == 3
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    writers.replace_table(spark.read.parquet(path).filter("id > 0"), path)  # reads what it replaces
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(ValueError):
        writers.replace_table(spark.range(1), path, partial=True)
    writers.write_metrics(spark.createDataFrame([("p", "g", 0.5, float("nan"), None, None)], readers.METRICS), str(tmp_path / "m"))
    assert tuple(readers.read_metrics(spark, str(tmp_path / "m")).first()) == ("p", "g", 0.5, None, None, None)
    writers.write_json({"ё": 1}, str(tmp_path / "x" / "j.json"))
    assert json.loads((tmp_path / "x" / "j.json").read_text()) == {"ё": 1}


def test_incremental_stage_computes_each_row_once(spark, tmp_path):
    src, out, chk = (str(tmp_path / x) for x in ("src", "out", "chk"))
    run = lambda: run_incremental(spark, src, "image_id string, v int", out, chk, lambda d: d.selectExpr("image_id", "v * 2 as payload"))
    spark.createDataFrame([("a", 1), ("b", 2)], "image_id string, v int").write.parquet(src)
    run()
    run()
    spark.createDataFrame([("b", 9), ("c", 3), ("c", 3)], "image_id string, v int").write.mode("append").parquet(src)
    run()
    assert {tuple(r) for r in spark.read.parquet(out).collect()} == {("a", 2), ("b", 4), ("c", 6)} and spark.read.parquet(out).count() == 3


def test_a_failed_replacement_keeps_the_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    real = writers.filesystem

    class Faulty:
        def __init__(self, fs, fail):
            self.fs, self.fail, self.n = fs, fail, 0

        def rename(self, a, b):
            self.n += 1
            return False if self.n == self.fail else self.fs.rename(a, b)

        def __getattr__(self, name):
            return getattr(self.fs, name)

    for fail in (1, 2):
        fs = Faulty(real(spark, path)[0], fail)
        monkeypatch.setattr(writers, "filesystem", lambda s, p, fs=fs: (fs, real(s, p)[1]))
        with pytest.raises(OSError):
            writers.replace_table(spark.range(5), path)
        assert spark.read.parquet(path).count() == 3 and [x.name for x in tmp_path.iterdir()] == ["t"]


def test_stage_rows_are_replaced_by_key(spark, tmp_path):
    path = str(tmp_path / "s")
    stage = lambda rows: spark.createDataFrame(rows, "image_id string, payload string")
    assert writers.read_stage(spark, path, "string", "string").count() == 0
    writers.write_stage(stage([("a", "1"), ("b", "1")]), path)
    writers.write_stage(stage([("c", "1")]), path)
    writers.replace_stage_rows(stage([("b", "2")]), stage([("b", None)]).select("image_id"), path)
    writers.write_stage(stage([("d", "1")]), path)
    assert sorted(map(tuple, writers.read_stage(spark, path, "string", "string").collect())) == [("a", "1"), ("b", "2"), ("c", "1"), ("d", "1")]


def test_a_target_that_cannot_be_read_is_an_error(spark, tmp_path):
    src, out, chk = (str(tmp_path / x) for x in ("src", "out", "chk"))
    spark.createDataFrame([("a", 1)], "image_id string, v int").write.parquet(src)
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "part-0.parquet").write_bytes(b"damaged")
    with pytest.raises(Exception):  # noqa: B017 - whatever the stream raises, nothing is computed again
        run_incremental(spark, src, "image_id string, v int", out, chk, lambda d: d.selectExpr("image_id", "v as payload"))
    assert [x.name for x in (tmp_path / "out").iterdir()] == ["part-0.parquet"]
