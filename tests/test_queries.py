import hashlib
import pathlib

import duckdb
import numpy as np
import pytest

from tests.compare import connect, same
from weftline.functions import pixels as px
from weftline.queries import oracle_sql, queries

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_against_sql(spark, con, name):
    same(queries()[name](spark, SMALL), con, oracle_sql()[name])


def rows(spark, name):
    return {r[0]: r for r in queries()[name](spark, SMALL).collect()}


@pytest.fixture(scope="module")
def pictures():
    """vec_id -> (picture, label map, group), drawn here anew."""
    out = {}
    for i, label, v in duckdb.sql(f"select vec_id, label, embedding from '{SMALL}/embeddings.parquet'").fetchall():
        x = np.array(v, np.float32).astype(float).reshape(8, 8)
        grey = np.kron((x - x.min()) / (x.max() - x.min()) * 255, np.ones((6, 6))).astype(np.uint8)
        parse = np.kron((np.abs(x) * 60).astype(np.uint8) % 18, np.ones((6, 6), np.uint8))
        out[i] = grey, parse, "upper" if label < 5 else "lower", x.ravel()
    return out


def test_frame_features(spark, pictures):
    got = rows(spark, "frame_features")
    assert set(got) == set(pictures)
    for i, (grey, *_) in pictures.items():
        f = px.frame_features(grey)
        content = b"P5 48 48 255\n" + grey.tobytes()
        assert got[i]["read_ok"] and got[i]["content_md5"] == hashlib.md5(content).hexdigest()
        assert got[i]["sharpness"] == pytest.approx(f["sharpness"], abs=1e-5) and got[i]["phash"] % 2**64 == f["phash"]


def test_masks(spark, pictures):
    got = rows(spark, "mask_load")
    assert set(got) == set(pictures)
    for i, (_, parse, group, _) in pictures.items():
        mask = px.resize_nearest(px.agnostic_mask(parse, group), 64, 48) > 127
        assert got[i]["share"] == pytest.approx(mask.mean(), abs=1e-6)
        box = px.mask_box(mask, 0)
        assert got[i]["box"] == (None if box is None else ",".join(map(str, box)))


def test_refined_masks(spark, pictures):
    got, plain = rows(spark, "agnostic_refined"), {}
    assert set(got) == set(pictures)
    for i, (_, parse, group, v) in pictures.items():
        names = ["left_elbow", "left_wrist", "right_elbow", "right_wrist", "nose", "left_shoulder", "right_shoulder"]
        points = {n: [abs(v[2 * k]) * 160 % 48, abs(v[2 * k + 1]) * 160 % 48] for k, n in enumerate(names)}
        scores = {n: abs(v[20 + k]) * 4 for k, n in enumerate(names)}
        plain[i] = (px.agnostic_mask(parse, group) > 0).mean()
        assert got[i]["share"] == pytest.approx((px.refine_mask(px.agnostic_mask(parse, group), parse, points, scores) > 0).mean(), abs=1e-6)
    assert any(got[i]["share"] < plain[i] - 1e-6 for i in got)


def test_masked_differences(spark, pictures):
    got = rows(spark, "masked_l1")
    assert set(got) == set(pictures)
    for i, (grey, parse, group, _) in pictures.items():
        inside = px.agnostic_mask(parse, group) > 0
        want = np.abs(grey.astype(float) - grey[::-1, ::-1])[inside].mean() / 255 if inside.any() else None
        assert got[i]["l1_mask"] == (None if want is None else pytest.approx(want, abs=1e-6))


def test_training_samples(spark, pictures):
    got, turned = rows(spark, "training_samples"), 0
    assert set(got) == set(pictures)
    for i, (grey, parse, group, _) in pictures.items():
        mirror = np.random.default_rng(i).random() < 0.5
        turned += mirror
        at = -1 if mirror else 0
        assert got[i]["size"] == 3 * 48 * 48 and got[i]["masked"] == (px.agnostic_mask(parse, group) > 127).sum()
        assert (got[i]["person"], got[i]["garment"]) == (pytest.approx(grey[0, at] / 127.5 - 1, abs=1e-5), pytest.approx(grey[::-1, ::-1][0, at] / 127.5 - 1, abs=1e-5))
    assert 0 < turned < len(pictures)


def test_garment_vectors(spark, pictures):
    got = rows(spark, "garment_vectors")
    assert set(got) == set(pictures)
    for i, (grey, parse, group, _) in pictures.items():
        v = px.colour_features(np.repeat(grey[..., None], 3, 2), parse, group)
        if v is None:
            assert got[i]["dimensions"] == 0 and got[i]["l"] is None
        else:
            assert got[i]["dimensions"] == 515 and (got[i]["l"], got[i]["a"], got[i]["b"]) == tuple(np.round(v[:3].astype(float), 3)) and got[i]["fullest"] == pytest.approx(float(v[3:].max()), abs=1e-4)


def test_staged(spark, pictures):
    got = rows(spark, "run_stage")
    assert set(got) == set(pictures)
    for i, (grey, *_) in pictures.items():
        assert got[i]["mean"] == pytest.approx(grey.mean(), abs=1e-2) and got[i]["greatest"] == grey.max()


def test_exact_ids(spark, con):
    got = rows(spark, "short_ids")
    digest = lambda x, n=8: hashlib.blake2b(x.encode(), digest_size=n)
    want = con.execute("select image_id, max(rel_path), max(sku_id) from manifest_images where image_id is not null group by 1").fetchall()
    assert len(got) == len(want)
    for i, path, sku in want:
        number = lambda x: int.from_bytes(digest(x).digest(), "big")
        assert got[i]["shard"] == number(i) % 8 and got[i]["seed"] == number(f"3:{i}") % (2**63 - 1)
        assert got[i]["place"] == pytest.approx(number(f"20260906:{sku}") / 2**64, rel=1e-12)
        assert len(got[i]["short"]) == 12 and int(got[i]["short"], 16) >= 0


def test_intervals(spark, con):
    """Bootstrap intervals are those of the same draws in numpy; Poisson ones lie near them."""
    got, near = rows(spark, "bootstrap_ci"), rows(spark, "poisson_ci")
    runs = con.execute("select l_linestatus, l_partkey, avg(l_discount)::double from lineitem group by 1, 2 order by 1, 2").fetchall()
    assert set(got) == set(near) == {r[0] for r in runs}
    for status, r in got.items():
        x = np.array([v for s, _, v in runs if s == status])
        means = np.random.default_rng(0).choice(x, (5000, len(x))).mean(1)
        low, high = np.quantile(means, [0.025, 0.975])
        assert r["n"] == len(x) and r["mean"] == pytest.approx(x.mean()) and r["ci_low"] == pytest.approx(low, abs=1e-9) and r["ci_high"] == pytest.approx(high, abs=1e-9)
        width = high - low
        assert abs(near[status]["ci_low"] - low) < 0.35 * width and abs(near[status]["ci_high"] - high) < 0.35 * width


def test_paired_report(spark, con):
    got = queries()["paired_report"](spark, SMALL).collect()
    a, b = ({k: v for k, v in con.execute(f"select l_partkey, avg(l_discount)::double from lineitem where l_linestatus = '{s}' group by 1").fetchall()} for s in "OF")
    d = np.array([b[k] - a[k] for k in sorted(a.keys() & b.keys())])
    low, high = np.quantile(np.random.default_rng(0).choice(d, (5000, len(d))).mean(1), [0.025, 0.975])
    (r,) = got
    assert r["pairs"] == len(d) and r["mean_diff"] == pytest.approx(d.mean()) and (r["ci_low"], r["ci_high"]) == (pytest.approx(low, abs=1e-9), pytest.approx(high, abs=1e-9))
    assert r["share_b_higher"] == pytest.approx((d > 0).mean()) and r["significant"] == (low > 0 or high < 0) and 0 <= r["p"] <= 1


def test_every_query_without_sql_is_tested_here():
    assert set(queries()) - set(oracle_sql()) == {"frame_features", "mask_load", "agnostic_refined", "masked_l1", "garment_vectors", "run_stage", "short_ids", "bootstrap_ci", "poisson_ci", "training_samples", "paired_report"}


def test_core_needs_no_optional_package():
    for p in pathlib.Path(__file__).parent.parent.glob("weftline/**/*.py"):
        if "llm" not in p.parts:
            assert "weftline.llm" not in p.read_text()
