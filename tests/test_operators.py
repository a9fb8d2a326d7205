import math

import pytest
from pyspark.sql import functions as F

from weftline.functions import ids, vectors
from weftline.functions.nulls import known, nan_to_null
from weftline.operators import assets, catalog, copies, labeling, matching, pairs, splits, stages, stats
from weftline.operators.ranking import average_rank, exact_quantiles, global_index, salted_row_number
from weftline.operators.tables import consolidate

NAN = float("nan")


def test_nan_is_null(spark):
    df = spark.createDataFrame([(1.0, NAN), (None, 2.0)], "a double, b double")
    assert [tuple(r) for r in nan_to_null(df).collect()] == [(1.0, None), (None, 2.0)]
    assert df.filter(known("b") >= 0.3).count() == 1


def test_consolidate_fills_and_drops_null_keys(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("a", "x", NAN), (None, "y", 1.0)], "k string, s string, d double")
    assert [tuple(r) for r in consolidate(df, "k").collect()] == [("a", "x", 1.0)]
    assert consolidate(df.limit(0), "k").count() == 0


def test_salted_rank_has_no_gaps(spark):
    df = spark.range(500).select(F.col("id"), F.when(F.col("id") < 300, "hot").when(F.col("id") < 320, None).otherwise("b").alias("g"), F.lit(1).alias("n"))
    by = {}
    for r in salted_row_number(df, ["g"], ["id"], "r", buckets=16).collect():
        by.setdefault(r["g"], []).append(r["r"])
    assert {k: sorted(v) for k, v in by.items()} == {k: list(range(n)) for k, n in (("hot", 300), (None, 20), ("b", 180))}
    assert salted_row_number(df.limit(0), ["g"], ["id"]).count() == 0


def test_global_index_follows_the_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    assert all(r["i"] == r["x"] for r in global_index(df, ["x"], "i").collect())


def test_average_rank_with_ties_and_unknown(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (0.5,), (NAN,), (None,), (3.0,)], "v double")
    got = {(None if r["v"] is None or math.isnan(r["v"]) else r["v"], r["avg_rank"]) for r in average_rank(df, "v").collect()}
    assert got == {(1.0, 2.5), (0.5, 1.0), (3.0, 4.0), (None, None)}


def test_quantiles_interpolate(spark):
    import numpy as np

    x = [5.0, 1.0, 4.0, 1.0, 9.0]
    df = spark.createDataFrame([("a", v) for v in x] + [("b", 2.0), ("c", None), ("b", NAN)], "g string, v double")
    got = {(r["g"], r["q"]): r["value"] for r in exact_quantiles(df, "v", [0.0, 0.35, 1.0], ["g"]).collect()}
    assert got == pytest.approx({("a", q): float(np.quantile(x, q)) for q in (0.0, 0.35, 1.0)} | {("b", q): 2.0 for q in (0.0, 0.35, 1.0)})
    assert exact_quantiles(df.limit(0), "v", [0.5]).count() == 0


def test_identities(spark):
    df = spark.createDataFrame([("Блузка  Ёлка (3)",), ("ｆｕｌｌ Straße",), (None,)], "f string")
    got = [tuple(r) for r in df.select(ids.base_title("f"), ids.variant_number("f"), ids.design_key("f"), ids.design_key("f", exact=True)).collect()]
    assert got == [("Блузка  Ёлка", 3, "блузка елка", "блузка елка"), ("ｆｕｌｌ Straße", 1, "ｆｕｌｌ straße", "full strasse"), (None, None, None, None)]
    import hashlib

    h = spark.createDataFrame([("й",)], "p string").select(ids.short_id("p"), ids.blake_rank("p", 5)).first()
    assert h[0] == hashlib.blake2b("й".encode(), digest_size=16).hexdigest()[:12]
    assert h[1] == pytest.approx(int.from_bytes(hashlib.blake2b("5:й".encode(), digest_size=8).digest(), "big") / 2**64)


def test_shards_partition_exactly_once(spark):
    df = spark.range(200).select(F.concat(F.lit("img"), "id").alias("image_id"))
    for n in (2, 3, 8):
        parts = [{r[0] for r in stages.pending_rows(df, None, shard=k, shards=n).collect()} for k in range(n)]
        assert all(parts) and sum(map(len, parts)) == 200 == len(set().union(*parts))


def test_pending_leaves_out_what_is_done(spark):
    df = spark.createDataFrame([("a",), ("b",)], "image_id string")
    assert [r[0] for r in stages.pending_rows(df, df.filter("image_id = 'a'")).collect()] == ["b"]
    assert stages.pending_rows(df, df, overwrite=True).count() == 2


def test_stage_order():
    order = stages.stage_order()
    assert order.index("agnostic_refined") > max(order.index(n) for n in stages.STAGES["agnostic_refined"].needs)
    with pytest.raises(ValueError):
        stages.stage_order({"a": stages.Stage("a", ("a",))})


COPY = "image_id string, content_md5 string, design_id string, category_raw string, branch string, sku_id string, order_idx int"


def annotated(spark, rows):
    df = spark.createDataFrame([(f"i{k}", *r) for k, r in enumerate(rows)], COPY)
    return copies.annotate_copies(df)


def test_templates_labels_canonical(spark):
    rows = [("x", "d1", "A", "product", "s1", 0), ("x", "d2", "B", "product", "s2", 0), *[("t", f"d{k}", "A", "product", f"s{k}", 0) for k in range(4)], ("p", "d1", "A", "product", "s1", 1), ("p", "d2", "A", "product", "s2", 1), ("r", "d1", "A", "review", "s1", 0), ("r", "d2", "A", "review", "s2", 0), (None, "d1", "A", "review", "s1", 3)]
    a = {r["image_id"]: r for r in annotated(spark, rows).collect()}
    assert [a[f"i{k}"]["is_template"] for k in range(11)] == [True] * 6 + [False] * 5
    assert not a["i6"]["label_ok"] and not a["i8"]["label_ok"]
    assert [a[i]["is_canonical"] for i in ("i8", "i9", "i10")] == [True, False, False]
    assert a["i10"]["dup_designs"] is None


def test_designs_link_through_product_frames_only(spark):
    rows = [("p", "b", "A", "product", "s1", 0), ("p", "a", "A", "product", "s2", 0), ("r", "c", "A", "review", "s3", 0), ("r", "a", "A", "review", "s2", 1), ("q", "d", "A", "product", "s4", 0)]
    assert {tuple(r) for r in copies.linked_designs(annotated(spark, rows)).collect()} == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "d")}
    assert copies.linked_designs(annotated(spark, rows).limit(0)).count() == 0


def test_stratified_splits(spark):
    df = spark.range(200).select(F.concat(F.lit("g"), "id").alias("split_group"), F.when(F.col("id") < 40, "a").when(F.col("id") < 45, None).otherwise("b").alias("category_group"))
    one = {r["split_group"]: r["split"] for r in splits.stratified_splits(df).collect()}
    assert one == {r["split_group"]: r["split"] for r in splits.stratified_splits(df.orderBy(F.desc("split_group"))).collect()}
    assert one != {r["split_group"]: r["split"] for r in splits.stratified_splits(df, seed=1).collect()}
    assert {one[f"g{i}"] for i in range(40)} == {"train", "val", "test"}
    assert sum(one[f"g{i}"] == "train" for i in range(40)) == 28


def test_leak_check_and_mode(spark):
    df = spark.createDataFrame([("h", "train"), ("h", "test"), ("k", "val"), ("k", None), (None, "val"), (None, "test")], "content_md5 string, split string")
    assert tuple(splits.leak_check(df).first()) == (1, 2) and tuple(splits.leak_check(df.limit(0)).first()) == (0, 0)
    g = spark.createDataFrame([("g", "b"), ("g", "a"), ("g", "a"), ("g", "b"), ("h", None), (None, "a")], "split_group string, category_group string")
    assert {tuple(r) for r in splits.group_mode(g).collect()} == {("g", "a", 4), ("h", None, 1)}


def test_certified_json(spark, tmp_path):
    import hashlib
    import json

    df = spark.createDataFrame([("g", "train"), ("h", "val")], "split_group string, split string")
    splits.certified_json(df, str(tmp_path / "s.json"), seed=3)
    body = json.loads((tmp_path / "s.json").read_text())
    mark = body.pop("content_sha256")
    assert mark == hashlib.sha256(json.dumps(body, ensure_ascii=False, sort_keys=True).encode()).hexdigest() and body["counts"] == {"train": 1, "val": 1}


def test_similarity_is_the_maximum_and_null_without_a_side(spark):
    rows = [(1, "s", [1.0, 0.0], True), (2, "s", [0.0, 1.0], True), (3, "s", [0.6, 0.8], False), (4, "t", [1.0, 0.0], False), (5, "s", [], False), (6, "s", None, False)]
    df = spark.createDataFrame(rows, "id long, item string, v array<float>, ref boolean")
    bank = matching.reference_bank(df, "item", "v", "ref")
    got = {r["id"]: r["garment_sim"] for r in matching.max_similarity(df.filter("not ref"), bank, "id", "item", "v").collect()}
    assert got[3] == pytest.approx(0.8) and got[4] is got[5] is got[6] is None


@pytest.mark.parametrize("block", [1, 3, 512])
def test_similarity_in_blocks_of_a_hot_item(spark, block):
    import numpy as np

    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(60, 6))
    rows = [(i, "hot" if i < 50 else f"s{i % 3}", v.tolist(), i % 4 == 0) for i, v in enumerate(x)] + [(99, "hot", [1.0, 2.0], False), (100, None, [1.0] * 6, False), (101, None, [1.0] * 6, True)]
    df = spark.createDataFrame(rows, "id long, item string, v array<double>, ref boolean")
    bank = matching.reference_bank(df, "item", "v", "ref")
    got = {r["id"]: r for r in matching.max_similarity(df.filter("not ref"), bank, "id", "item", "v", block=block).collect()}
    colour = {r["id"]: r for r in matching.colour_likeness(df.filter("not ref"), bank, "id", "item", "v", block=block).collect()}
    assert len(got) == len(colour) == sum(not r[3] for r in rows)
    for i, item, v, ref in rows[:60]:
        if not ref:
            mates = np.array([w for _, other, w, r in rows[:60] if r and other == item]).reshape(-1, 6)
            want = [(mates @ v).max(), -np.linalg.norm(mates[:, :3] - v[:3], axis=1).min(), np.minimum(mates[:, 3:], v[3:]).sum(1).max()] if len(mates) else [None] * 3
            assert [got[i]["garment_sim"], colour[i]["colour_med"], colour[i]["colour_hist"]] == [x if x is None else pytest.approx(x) for x in want]
    assert got[99]["garment_sim"] is got[100]["garment_sim"] is None


def test_quantiles_of_a_value_that_most_rows_share(spark):
    rows = [(0.5, "a")] * 700 + [(float(i), "b" if i % 2 else "a") for i in range(300)]
    df = spark.createDataFrame(rows, "v double, g string")
    from weftline.operators.ranking import counted_values

    assert counted_values(df, "v").count() == 301
    import numpy as np

    for group, values in (([], [v for v, _ in rows]), (["g"], [v for v, g in rows if g == "a"])):
        got = {r["q"]: r["value"] for r in exact_quantiles(df, "v", [0.0, 0.3, 0.71, 0.999, 1.0], group).filter("g = 'a'" if group else "true").collect()}
        assert got == {q: pytest.approx(np.quantile(values, q)) for q in got} and len(got) == 5


def test_auc_and_sweep(spark):
    df = lambda rows: spark.createDataFrame(rows, "p boolean, s double")
    sep = df([(True, 0.9), (True, 0.8), (False, 0.2), (False, 0.1), (None, 0.5), (True, NAN)])
    assert matching.auc(sep, "p", "s").first()["auc"] == 1.0
    assert matching.auc(df([(True, 1.0), (False, 1.0)]), "p", "s").first()["auc"] == 0.5
    assert matching.auc(df([(True, 1.0)]), "p", "s").first()["auc"] is None
    recall = [r["recall"] for r in matching.threshold_sweep(sep, "p", "s", 5).orderBy("step").collect()]
    assert recall == sorted(recall, reverse=True) and recall[0] == 1.0
    assert matching.threshold_sweep(sep.limit(0), "p", "s").count() == 0


def test_colour_rank_policies(spark):
    df = spark.createDataFrame([(1, 0.5, 0.5), (2, None, 0.1), (3, 0.9, NAN)], "id int, a double, b double")
    low = {r["id"]: r["colour_rank"] for r in matching.colour_rank(df, "a", "b").collect()}
    skip = {r["id"]: r["colour_rank"] for r in matching.colour_rank(df, "a", "b", nulls="skip").collect()}
    assert low == pytest.approx({1: 2 / 3 + 1, 2: 1 / 3 + 2 / 3, 3: 1 + 1 / 3}) and skip == pytest.approx({1: 0.5 + 1, 2: 0.5, 3: 1.0})
    with pytest.raises(ValueError):
        matching.colour_rank(df, "a", "b", nulls="other")


def arms_table(spark):
    rows = [(f"s{i}", "studio", "train", None) for i in range(20)] + [(f"w{i}", "wild", "train", i / 20) for i in range(20)] + [("t", "wild", "test", 99.0)]
    return spark.createDataFrame(rows, "pair_id string, branch string, split string, colour_rank double")


def test_arms(spark):
    p = arms_table(spark)
    take = lambda arm: {r["pair_id"] for r in pairs.select_pairs(p, arm).collect()}
    n = {arm: take(arm) for arm in pairs.ARMS}
    assert len(n["studio"]) == 20 and len(n["studio_wild"]) == 40
    assert n["studio_clean"] < n["studio_wild"] and len(n["studio_clean"]) == 27
    assert len(n["studio_random"]) == 27 and n["studio_random"] == take("studio_random") != n["studio_clean"]
    with pytest.raises(ValueError):
        pairs.select_pairs(p, "other")


FRAMES = "image_id string, sku_id string, design_id string, category_group string, split string, branch string, rel_path string, n_persons double, area_frac double, torso_min double, garment_sim double, colour_rank double, white_frac double"


def frame(i, sku="s", branch="review", n=1.0, area=0.5, torso=0.9, sim=0.9, rank=1.0, white=0.0):
    return (i, sku, "d", "upper", "train", branch, f"p/{i}", n, area, torso, sim, rank, white)


def test_cascade_and_pairs(spark):
    rows = [frame("g1", branch="product", n=0.0, white=0.5), frame("g0", branch="product", n=0.0, white=0.5), frame("g2", branch="product", n=0.0, white=NAN), frame("st", branch="product"), frame("ok"), frame("nan", sim=NAN), frame("null", torso=None), frame("low", rank=0.0), frame("other", sku="t")]
    df = spark.createDataFrame(rows, FRAMES)
    assert [(r["step"], r["kept"]) for r in pairs.cascade_funnel(df).orderBy("step_no").collect()] == [("review_frames", 5), ("person_found", 5), ("large_enough", 5), ("torso_visible", 4), ("same_garment", 3), ("same_colour", 2)]
    got = {(r["pair_id"], r["arm"]) for r in pairs.build_pairs(df).collect()}
    assert got == {("g0_st", "studio"), ("g0_ok", "wild")}
    assert pairs.build_pairs(df.limit(0)).count() == 0


def test_stratified_sample(spark):
    df = spark.range(400).select(F.concat(F.lit("i"), "id").alias("image_id"), F.when(F.col("id") < 200, "a").when(F.col("id") < 300, "b").when(F.col("id") < 399, "c").alias("category_group"))
    got = labeling.stratified_sample(df, 100, 1).collect()
    n = {g: sum(r["category_group"] == g for r in got) for g in "abc"}
    assert n == {"a": 50, "b": 25, "c": 25} and len({r["image_id"] for r in got}) == 100
    assert {r["image_id"] for r in labeling.stratified_sample(df, 100, 1).collect()} == {r["image_id"] for r in got} != {r["image_id"] for r in labeling.stratified_sample(df, 100, 2).collect()}
    thin = spark.createDataFrame([(f"{i}", "a" if i < 10 else "b") for i in range(12)], "image_id string, category_group string")
    assert labeling.stratified_sample(thin, 100, 1).count() == 12 and labeling.stratified_sample(thin.limit(0), 5, 1).count() == 0


def test_labels_batches_page(spark):
    df = spark.createDataFrame([("a", "late", 2), ("a", "first", 1), ("b", "x", 3), (None, "x", 1)], "image_id string, label string, batch int")
    assert {tuple(r) for r in labeling.merge_labels(df).collect()} == {("a", "first", 1), ("b", "x", 3)}
    assert labeling.batch_id(["b", "a"]) == labeling.batch_id(["a", "b"]) != labeling.batch_id(["a"])
    page = labeling.label_page("T", "h", [("ok", "fine")], [{"image_id": "a", "rel_path": "</script>", "category": "upper"}])
    assert labeling.batch_id(["a"]) in page and page.count("</script>") == 2 and 'download: `labels_${this.batch}.csv`' in page


def test_paired_and_bootstrap(spark):
    import numpy as np

    rnd = np.random.default_rng(0)
    a = spark.createDataFrame([(i, float(x)) for i, x in enumerate(rnd.normal(size=60))] + [(100, NAN), (101, 1.0)], "k long, m double")
    b = a.withColumn("m", F.col("m") + 0.5)
    r = stats.paired_compare(a, b, "k", "m").first()
    assert (r["pairs"], r["share_b_higher"]) == (61, 1.0) and r["mean_diff"] == pytest.approx(0.5)
    d = a.withColumn("g", F.lit("x")).unionByName(spark.createDataFrame([(1, 2.0, "one"), (1, NAN, "none")], "k long, m double, g string"))
    out = {r["g"]: r for r in stats.bootstrap_interval(d, "k", "m", ["g"], 300).collect()}
    x = [v for v in [r["m"] for r in a.orderBy("k").collect()] if v == v]
    means = np.random.default_rng(0).choice(np.array(x), (300, len(x))).mean(1)
    assert out["x"]["ci_low"] == pytest.approx(np.quantile(means, 0.025)) and out["one"]["mean"] == 2.0 and out["one"]["ci_low"] is None and out["none"]["n"] == 0
    p = stats.poisson_interval(d.filter("g = 'x'"), "k", "m", ["g"], 200).first()
    assert p["ci_low"] < out["x"]["mean"] < p["ci_high"]


def test_registered_intervals_are_whole(spark):
    import numpy as np

    from weftline import queries

    d = "/root/testdata/sf0.001"
    got = {r["l_linestatus"]: r for r in queries.queries()["bootstrap_ci"](spark, d).collect()}
    for run in queries._runs(spark, d):
        x = run.orderBy("pair_id").toPandas()
        v = x["score"].to_numpy(float)
        means = np.random.default_rng(0).choice(v, (5000, len(v))).mean(1)
        r = got[x["l_linestatus"][0]]
        assert (r["ci_low"], r["ci_high"]) == pytest.approx(tuple(np.quantile(means, [0.025, 0.975])))
    assert {r["l_linestatus"] for r in queries.queries()["poisson_ci"](spark, d).collect()} == set(got) == {"O", "F"}


def test_signed_rank(spark):
    a = spark.createDataFrame([(i, 0.0) for i in range(12)], "k long, m double")
    b = spark.createDataFrame([(i, float([0, 1, 1, 2, -1, 3, 4, 5, -2, 6, 7, 8][i])) for i in range(12)], "k long, m double")
    r = stats.signed_rank(a, b, "k", "m").first()
    assert (r["n"], r["w_plus"]) == (11, 66 - 2 - 4.5) and r["z"] == pytest.approx((59.5 - 33) / math.sqrt(126.5 - 30 / 48)) and 0 < r["p"] < 0.05
    assert tuple(stats.signed_rank(a, a, "k", "m").first()) == (0, 0.0, None, None)


def test_trend_and_rolling(spark):
    log = spark.createDataFrame([(i, 10 - i / 100 + (i % 3) / 10) for i in range(600)], "step long, loss double")
    r = stats.run_trend(log, ["step"], "step", "loss").first()
    assert r["significant"] and r["slope_10k"] == pytest.approx(-100, rel=0.01) and r["rows"] == 600
    short = stats.run_trend(log.limit(2), ["step"], "step", "loss").first()
    assert short["error"] == float("inf") and not short["significant"]
    got = {x["step"]: x["rolling"] for x in stats.rolling_mean(log, ["step"], "loss", 40, block=50).collect()}
    v = [x["loss"] for x in log.orderBy("step").collect()]
    assert len(got) == 600 and all(got[i] == pytest.approx(sum(v[max(0, i - 39) : i + 1]) / len(v[max(0, i - 39) : i + 1])) for i in range(600))


def test_metadata(spark):
    rows = [(1, "k", "b", 0), (1, "k", "a", 1), (1, " k ", "b", 2), (1, "z", " ", 3), (1, None, "x", 4), (1, "m", "q", 5)]
    m = catalog.merge_pairs(spark.createDataFrame(rows, "e int, k string, v string, o int"), "e", "k", "v", "o")
    assert {tuple(r) for r in m.collect()} == {(1, "k", "b; a"), (1, "m", "q")}
    a = catalog.as_map(m, "e", "k", "v")
    assert tuple(a.select(*catalog.pivot_keys("attrs", {"k": "kk", "none": "nn"}), catalog.residual_json("attrs", ["k"])).first()) == ("b; a", None, '{"m":"q"}')
    with pytest.raises(ValueError):
        catalog.category_table({"a": ["x"], "b": ["x"]})


def test_orders_frames_by_leading_number(spark):
    df = spark.createDataFrame([("s", "product", f"a/{n}") for n in ("10_fs", "fs", "2_fs")], "sku_id string, branch string, rel_path string")
    assert [r["rel_path"] for r in assets.order_assets(df).orderBy("order_idx").collect()] == ["a/fs", "a/2_fs", "a/10_fs"]


def test_vectors(spark):
    df = spark.createDataFrame([({"left_shoulder": 0.9, "right_shoulder": 0.5, "left_hip": 0.4, "right_hip": 0.3}, [[0.0, 0.0, 2.0, 2.0], [1.0, 1.0, 5.0, 2.0]], [3.0, 4.0]), ({}, [], []), (None, None, None)], "s map<string,double>, b array<array<double>>, v array<double>")
    got = [tuple(r) for r in df.select(vectors.torso_visible("s"), vectors.torso_min("s"), vectors.largest_box("b"), vectors.l2_normalise("v")).collect()]
    assert got[0] == (True, 0.3, [1.0, 1.0, 5.0, 2.0], [0.6, 0.8]) and got[1] == (False, 0.0, None, []) and got[2][2:] == (None, None)
