import json
import random
from pathlib import Path

import numpy as np
import pytest

from weftline.config import Roots, evaluation_settings, mask_for_training, resolve
from weftline.functions.images import png_array
from weftline.plans import pipeline
from weftline.sources.readers import METRICS, read_table

CONFIG = {"layout": {"product_dir": "studio", "review_dir": "reviews", "info_file": "info.csv"}, "categories": {"upper": ["Tops"], "lower": ["Skirts"]}, "info_columns": ["Colour"], "info_names": {"Colour": "colour"}}


def picture(seed):
    r = random.Random(seed)
    return b"P5 16 16 255\n" + bytes(r.randrange(256) for _ in range(256))


def lake(root):
    for i in range(12):
        d = root / ("Tops" if i % 2 else "Skirts") / f"Item {i // 4} ({i})"
        for b in ("studio", "reviews"):
            (d / b).mkdir(parents=True)
            for k in range(2):
                (d / b / f"{k}.webp").write_bytes(picture(i * 100 + k + 10 * (b == "reviews")))
        (d / "info.csv").write_text(f"key,value\nColour,red\nSize,{i}\n")
    (root / "Tops" / "Item 0 (1)" / "studio" / "9.webp").write_bytes(b"broken")


def test_roots(monkeypatch):
    monkeypatch.setenv("WEFTLINE_CACHE_ROOT", "/x/y")
    r = Roots.of({"paths": {"raw_root": "a", "cache_root": "b"}}, "/base")
    assert (r.raw, r.cache, r.has("stages")) == ("/base/a", "/x/y", False) and resolve(None, "NO_SUCH") is None
    with pytest.raises(RuntimeError):
        r.need("stages")


def test_evaluation_settings():
    hp = {"mask_stage": "new", "lr": 1}
    assert evaluation_settings(hp, {"mask_stage": "old", "height": 5, "lr": 9}, True)[0] == {"mask_stage": "old", "height": 5, "lr": 1}
    assert evaluation_settings(hp, None, True)[0]["mask_stage"] == "agnostic" and evaluation_settings(hp, None, False, "x")[0]["mask_stage"] == "x" and hp["mask_stage"] == "new"
    with pytest.raises(ValueError):
        evaluation_settings(hp, {}, True, "x")


def test_mask_is_checked_before_training():
    assert mask_for_training({}, lambda s: s == "agnostic") == "agnostic"
    for config in ({"mask_stage": "agnostic_refined"}, {"mask_stage": "other"}):
        with pytest.raises((ValueError, FileNotFoundError)):
            mask_for_training(config, lambda s: s == "agnostic")


def test_from_lake_to_pairs(spark, tmp_path):
    raw, cache, stage = (tmp_path / x for x in ("raw", "cache", "stages"))
    lake(raw)
    cache.mkdir()
    roots = Roots(str(raw), str(cache), str(stage))
    reports = pipeline.build_manifest(spark, roots, CONFIG)
    assert {r["category_group"]: r["items"] for r in reports["groups"].collect()} == {"upper": 6, "lower": 6}
    items = read_table(spark, roots.table("manifest_sku.parquet"))
    first = items.filter("folder = 'Item 0 (1)'").first()
    assert (first["design_id"], first["variant_no"], first["colour"], first["attrs_json"], first["n_product"], first["design_variants"]) == ("item 0", 1, "red", '{"Size":"1"}', 3, 4)
    pipeline.run_qc(spark, roots, limit=3)
    assert "phash" not in read_table(spark, roots.table("manifest_images.parquet")).columns
    pipeline.run_qc(spark, roots)
    images = read_table(spark, roots.table("manifest_images.parquet"))
    assert images.filter("read_ok").count() == 48 and images.filter("not read_ok").count() == 1
    _, leaks = pipeline.make_splits(spark, roots)
    assert leaks == 0
    _, leaks = pipeline.make_splits(spark, roots)  # again over its own result
    images = read_table(spark, roots.table("manifest_images.parquet"))
    assert images.count() == 49 and images.filter("split is null").count() == 1 and images.filter("is_canonical").count() == 48
    assert json.loads((cache / "splits.json").read_text())["n_groups"] == 3

    detect = lambda rows: [json.dumps({"n_persons": int(r["rel_path"].endswith("1.webp") or r["branch"] == "review"), "area_frac": 0.5}) for r in rows]
    pose = lambda rows: [json.dumps({"scores": {j: 0.9 for j in ("left_shoulder", "right_shoulder", "left_hip", "right_hip")}}) for r in rows]
    for k in range(2):
        pipeline.run_one_stage(spark, roots, "detect", detect, k, 2)
    assert pipeline.run_one_stage(spark, roots, "pose", pose).count() == 0
    pipeline.run_one_stage(spark, roots, "detect", lambda rows: 1 / 0)  # nothing is pending
    pipeline.run_one_stage(spark, roots, "parse", lambda rows: [b"x" for _ in rows])
    pipeline.run_one_stage(spark, roots, "embed", lambda rows: [[1.0, 0.0] for _ in rows])
    assert pipeline.collect_signals(spark, roots).filter("torso_min = 0.9").count() == 48
    first = images.filter("branch = 'review'").limit(1).first()
    (cache / "labels_wild.csv").write_text("image_id,rel_path,category_group,label,batch\n" + f"{first['image_id']},p,upper,good,1\n")
    done, reports = pipeline.similarity(spark, roots, str(cache / "labels_wild.csv"))
    assert done.filter("garment_sim = 1").count() == 24
    assert (reports["auc"].first()["n_pos"], reports["auc"].first()["auc"]) == (1, None) and reports["sweep"].first()["precision"] == 1
    read_table(spark, roots.table("signals.parquet")).selectExpr("image_id", "hash(image_id) / 1.0 as colour_med", "1.0 as colour_hist").write.parquet(roots.table("colour_sim.parquet"))
    reports = pipeline.build_pairs(spark, roots, min_white=0.0)
    assert reports["funnel"].orderBy("step_no").collect()[-1]["kept"] in (13, 14)
    pairs = read_table(spark, roots.table("manifest_pairs.parquet"))
    assert pairs.filter("arm = 'studio'").count() == 12
    (cache / "labeling").mkdir()
    chosen = [r["person_image_id"] for r in pairs.filter("arm = 'wild'").collect()]
    (cache / "labeling" / "labels_verify_1.csv").write_text("image_id,rel_path,category_group,label,batch\n" + "".join(f"{i},p,upper,ok,1\n" for i in chosen))
    reports, overlap = pipeline.build_test_set(spark, roots)
    assert overlap == 0 and sum(reports["colour_filter"].first()[c] for c in ("tp", "fn")) == len(chosen) and reports["colour_auc"].first()["n_neg"] == 0
    pages = pipeline.make_labeling_set(spark, roots, n=6)
    assert set(pages) == {"garment", "wild", "verify"}
    page = Path(pages["wild"]).read_text()
    assert page.count("data:image/") >= 2 and Path(pages["wild"]).name.split("_")[1][:-5] in page and "data:image" in Path(pages["garment"]).read_text()
    items = read_table(spark, roots.table("manifest_sku.parquet"))
    batch, page = pipeline.label_batch(spark, images.join(items.select("sku_id", "category_group"), "sku_id"), 6, 1, "T", "h", [("ok", "fine")])
    assert batch in page


def stage_rows(spark, roots, name):
    return {r["image_id"]: r["payload"] for r in pipeline._stage(spark, roots, name).collect()}


def test_stages(spark, tmp_path):
    """Shards, overwriting, left out rows and runners over stored stages."""
    raw, cache, stage = (tmp_path / x for x in ("raw", "cache", "stages"))
    lake(raw)
    cache.mkdir()
    roots = Roots(str(raw), str(cache), str(stage))
    pipeline.build_manifest(spark, roots, CONFIG)
    pipeline.run_qc(spark, roots)
    pipeline.make_splits(spark, roots)
    assert pipeline.preprocess(spark, roots, "detect", dry_run=True) == {"rows": 48, "todo": 48, "missing": {}} and stage_rows(spark, roots, "detect") == {}
    with pytest.raises(ValueError):
        pipeline.preprocess(spark, roots, "detect")
    people = lambda pictures: [[("Person", 0.9, (0, 0, 384, 512)), ("person", 0.4, (0, 0, 9, 9)), ("bag", 0.9, (0, 0, 1, 1))] for _ in pictures]
    sizes = [pipeline.preprocess(spark, roots, "detect", people, shard=k, shards=3)["todo"] for k in range(3)]
    assert sum(sizes) == 48 and min(sizes) > 0
    first = stage_rows(spark, roots, "detect")
    assert len(first) == 48 and pipeline._stage(spark, roots, "detect").count() == 48
    assert {(json.loads(v)["n_persons"], json.loads(v)["max_area_frac"]) for v in first.values()} == {(1, 0.25)}
    nobody = lambda pictures: [[] for _ in pictures]
    assert pipeline.preprocess(spark, roots, "detect", nobody, shard=1, shards=3, overwrite=True)["todo"] == sizes[1]
    again = stage_rows(spark, roots, "detect")
    assert pipeline._stage(spark, roots, "detect").count() == 48 == len(again)  # replaced, not doubled
    assert sum(json.loads(v)["n_persons"] == 0 for v in again.values()) == sizes[1]
    joints = lambda picture, box: ([[10 * k, 10 * k] for k in range(17)], [0.9] * 17)
    pipeline.preprocess(spark, roots, "pose", joints)
    poses = [json.loads(v) for v in stage_rows(spark, roots, "pose").values()]
    assert sum(p == {"keypoints": {}, "scores": {}, "box": None} for p in poses) == sizes[1] and {p["box"][2] for p in poses if p["box"]} == {384.0}
    label = lambda pictures: [np.full(p.shape[:2], 4, np.uint8) for p in pictures]
    assert pipeline.preprocess(spark, roots, "agnostic")["missing"] == {"parse": 48}
    pipeline.preprocess(spark, roots, "parse", label, limit=30)
    assert pipeline.preprocess(spark, roots, "agnostic", grow_px=0)["missing"] == {"parse": 18}
    assert pipeline.preprocess(spark, roots, "agnostic_refined")["missing"] == {"parse": 18, "agnostic": 18}
    mask = png_array(next(iter(stage_rows(spark, roots, "agnostic_refined").values())))
    assert mask.shape == (1024, 768) and mask.max() in (0, 255)
    pipeline.preprocess(spark, roots, "colour")
    pipeline.preprocess(spark, roots, "embed", lambda crops: np.ones((len(crops), 4)))
    vectors = list(stage_rows(spark, roots, "embed").values())
    assert len(vectors) == 30 and {len(v) for v in vectors} <= {0, 4} and all(v == [] or sum(x * x for x in v) == pytest.approx(1, abs=1e-3) for v in vectors)
    assert {len(v) for v in stage_rows(spark, roots, "colour").values()} <= {0, 515}
    pipeline.preprocess(spark, roots, "latents", lambda x: x[:, :, ::256, ::256])
    assert {len(v) for v in stage_rows(spark, roots, "latents").values()} == {3 * 4 * 3}
    pipeline.collect_signals(spark, roots)
    sim = pipeline.colour_similarity(spark, roots)
    assert sim.count() == 24 and sim.filter("colour_hist > 1.001 or colour_med > 0").count() == 0
    n, sheet = pipeline.inspect_stages(spark, roots, 3, 60)
    assert n == 3 and png_array(Path(sheet).read_bytes()).shape == (180, 135, 3)
    (stage / ".git").mkdir()
    with pytest.raises(ValueError):
        pipeline.preprocess(spark, roots, "detect", people)


def test_comparison(spark, tmp_path):
    for n, add, rows in (("a", 0.0, 40), ("b", 0.2, 41)):
        table = spark.createDataFrame([(f"p{i:03}", "upper" if i % 2 else "dress", 0.5 + i % 7 / 100 + add, 0.1 + i % 5 / 50 - add / 4 * (i % 3), None, 0.3) for i in range(rows)], METRICS)
        got = pipeline.write_run_metrics(spark, table, str(tmp_path / n), 1 if n == "a" else 2, checkpoint="c")
        assert got["seed"] == json.loads((tmp_path / n / "metrics.json").read_text())["seed"] and got["metrics"]["ssim"]["n"] == rows
    out = str(tmp_path / "comparison.json")
    document, warnings = pipeline.comparison(spark, {n: str(tmp_path / n) for n in ("a", "b")}, by_category=True, out=out)
    assert len(warnings) == 2 and "1 pairs" in warnings[0] and "seeds" in warnings[1]
    assert json.loads(Path(out).read_text()) == json.loads(json.dumps(document)) and document["pairs"] == 40
    ssim, lpips = document["metrics"]["ssim"]["b"], document["metrics"]["lpips"]["b"]
    assert ssim["vs_reference"]["verdict"] == lpips["vs_reference"]["verdict"] == "better" and ssim["vs_reference"]["share_b_higher"] == 1
    assert ssim["vs_reference"]["mean_diff"] == pytest.approx(0.2) and ssim["vs_reference"]["wilcoxon_p"] < 1e-4 and document["metrics"]["lpips_mask"]["b"]["vs_reference"]["verdict"] == "alike"
    assert document["metrics"]["ssim"]["by_category"]["dress"]["b"]["pairs"] == 20 and document["metrics"]["l1_mask"] == {}
    from weftline.cli import report_lines

    assert any("better" in x for x in report_lines(document))


def test_runs(spark, tmp_path):
    for n, add in (("a", 0.0), ("b", 0.2)):
        (tmp_path / n).mkdir()
        rows = [f"p{i},upper,{0.5 + i % 7 / 100 + add},0.1,,0.3" for i in range(40 + (n == "b"))]
        (tmp_path / n / "metrics_pairs.csv").write_text("pair_id,category_group,ssim,lpips,l1_mask,lpips_mask\n" + "\n".join(rows) + "\n")
        (tmp_path / n / "log.jsonl").write_text("".join(json.dumps({"step": i, "loss": 2 - i / 100}) + "\n" for i in range(100)))
    runs = {n: str(tmp_path / n) for n in ("a", "b")}
    got = {r["metric"]: r for r in pipeline.compare_runs(spark, runs).collect()}
    assert got["ssim"]["significant"] and got["ssim"]["n"] == 40 and got["ssim"]["mean"] == pytest.approx(0.2) and not got["lpips"]["significant"] and "l1_mask" not in got
    assert pipeline.compare_runs(spark, runs, "b", by_category=True).filter("metric = 'ssim'").first()["category_group"] == "upper"
    for bad in ({}, runs):
        with pytest.raises(ValueError):
            pipeline.compare_runs(spark, bad, "nobody")
    trend, rolling = pipeline.report_run(spark, runs["a"])
    assert trend.first()["significant"] and rolling.count() == 100
    picture = png_array(Path(pipeline.plot_run(spark, runs["a"])).read_bytes())
    assert picture.shape == (400, 900, 3) and len(np.unique(picture.reshape(-1, 3), axis=0)) >= 3
    from weftline.cli import main

    assert main(["report-run", runs["a"], "--plot"]) == 0
    assert main(["compare-runs", *runs.values(), "--out", str(tmp_path / "c.json")]) == 0 and json.loads((tmp_path / "c.json").read_text())["pairs"] == 40


def test_command_line_knows_its_commands():
    from weftline.cli import _parser

    a = _parser().parse_args(["build-pairs", "--config", "c.json", "--colour-drop", "0.3"])
    assert a.colour_drop == 0.3
    with pytest.raises(SystemExit):
        _parser().parse_args(["select-pairs", "--config", "c", "--arm", "none", "--out", "x"])
