"""Command line: ``python -m weftline.cli COMMAND --config FILE``."""

from __future__ import annotations

import argparse
import importlib
import sys
from collections.abc import Sequence

from weftline.config import Roots, load_config
from weftline.operators.labeling import TASKS
from weftline.operators.pairs import ARMS, COLOUR_DROP, MIN_WHITE, select_pairs
from weftline.operators.stages import STAGES


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weftline", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *flags: tuple[str, dict]) -> None:
        c = sub.add_parser(name)
        c.add_argument("--config", required=name not in ("compare-runs", "report-run", "check-env"))
        for flag, how in flags:
            c.add_argument(flag, **how)

    command("build-manifest")
    command("run-qc", ("--limit", {"type": int}))
    command("make-splits", ("--seed", {"type": int, "default": 20260906}))
    command("collect-signals")
    command("match", ("--labels", {"help": "label file; prints AUC and threshold sweep"}))
    command("preprocess", ("--stage", {"choices": list(STAGES), "required": True}), ("--shard", {"default": "0/1", "help": "i/N"}), ("--batch-size", {"type": int}), ("--grow", {"type": int, "help": "pixels the agnostic mask grows"}), ("--model", {"help": "module:function that makes the stage's model"}), ("--overwrite", {"action": "store_true"}), ("--limit", {"type": int}), ("--dry-run", {"action": "store_true"}))
    command("colour-features", ("--overwrite", {"action": "store_true"}))
    command("colour-similarity")
    command("make-labeling-set", ("--task", {"choices": [*TASKS, "all"], "default": "all"}), ("--n", {"type": int, "default": 250}), ("--seed", {"type": int, "default": 20260906}))
    command("build-pairs", ("--colour-drop", {"type": float, "default": COLOUR_DROP}), ("--min-white-frac", {"type": float, "default": MIN_WHITE}))
    command("build-test-set")
    command("select-pairs", ("--arm", {"choices": ARMS, "required": True}), ("--out", {"required": True}))
    command("compare-runs", ("runs", {"nargs": "+"}), ("--reference", {}), ("--by-category", {"action": "store_true"}), ("--out", {"default": "comparison.json"}))
    command("report-run", ("runs", {"nargs": "+"}), ("--window", {"type": int, "default": 40}), ("--plot", {"action": "store_true"}))
    command("inspect-preproc", ("--n", {"type": int, "default": 8}), ("--cell", {"type": int, "default": 260}), ("--out", {}))
    command("check-env")
    return p


def report_lines(document: dict) -> list[str]:
    """A comparison as lines: metric, run, mean with interval, and difference, interval and verdict against the reference."""
    out = [f"{document['pairs']} common pairs, reference {document['reference']}"]
    span = lambda low, high: "[-]" if low is None or high is None else f"[{low:.4f}, {high:.4f}]"
    for metric, runs in document["metrics"].items():
        for run, e in runs.items():
            if run == "by_category":
                out += [f"  {metric} {c} {r}: {d['mean_diff']:+.4f} ({d['pairs']} pairs) {d['verdict']}" for c, ds in e.items() for r, d in ds.items()]
                continue
            d = e.get("vs_reference")
            out.append(f"{metric} {run}: {e['mean']:.4f} {span(*e['ci'])}" + (f"  {d['mean_diff']:+.4f} {span(d['ci_low'], d['ci_high'])} {d['verdict']}" if d else ""))
    return out


def _stage(pipeline, spark, roots: Roots, config: dict, a: argparse.Namespace) -> bool:
    """Runs a stage and says how much there is to do and what lacks an input; true if rows were left out."""
    colour = a.command == "colour-features"
    shard, shards = (0, 1) if colour else map(int, a.shard.split("/"))
    keys = {"shard": shard, "shards": shards, "overwrite": a.overwrite, "batch": 64}
    stage, model = "colour", None
    if not colour:
        stage = a.stage
        keys |= {"limit": a.limit, "dry_run": a.dry_run, "grow_px": a.grow, "batch": a.batch_size or config.get("compute", {}).get("batch_size", 8)}
        if a.model:
            module, _, name = a.model.partition(":")
            model = getattr(importlib.import_module(module), name)(config.get("compute", {}))
    done = pipeline.preprocess(spark, roots, stage, model, **keys)
    print(f"{stage}: {done['rows']} frames, shard {shard}/{shards}, {done['todo']} to do")
    for need, n in done["missing"].items():
        print(f"LEFT OUT {n}: no result of stage {need}; run it on the same frames first")
    return bool(done["missing"])


def main(argv: Sequence[str] | None = None) -> int:
    """Exit code 0, or 1 when a leak was found or a stage left rows out for want of an input."""
    a = _parser().parse_args(argv)
    from weftline.plans import pipeline
    from weftline.session import build_session

    spark = build_session(a.command)
    config = load_config(a.config) if a.config else {}
    roots = Roots.of(config)
    bad = 0
    if a.command == "build-manifest":
        for df in pipeline.build_manifest(spark, roots, config).values():
            df.show(100, False)
    elif a.command == "run-qc":
        pipeline.run_qc(spark, roots, a.limit).show()
    elif a.command == "make-splits":
        reports, bad = pipeline.make_splits(spark, roots, a.seed)
        for df in reports.values():
            df.show(100, False)
    elif a.command == "collect-signals":
        pipeline.collect_signals(spark, roots).groupBy("branch").count().show()
    elif a.command == "match":
        done, reports = pipeline.similarity(spark, roots, a.labels)
        for df in (done.groupBy("category_group").count(), *reports.values()):
            df.show(100, False)
    elif a.command in ("preprocess", "colour-features"):
        bad = _stage(pipeline, spark, roots, config, a)
    elif a.command == "colour-similarity":
        pipeline.colour_similarity(spark, roots).selectExpr("count(*) as frames", "count(colour_med) as measured").show()
    elif a.command == "make-labeling-set":
        for task, path in pipeline.make_labeling_set(spark, roots, a.task, a.n, a.seed).items():
            print(task, path)
    elif a.command == "build-pairs":
        for df in pipeline.build_pairs(spark, roots, a.colour_drop, a.min_white_frac).values():
            df.show(100, False)
    elif a.command == "build-test-set":
        reports, bad = pipeline.build_test_set(spark, roots)
        for df in reports.values():
            df.show(100, False)
    elif a.command == "select-pairs":
        table = spark.read.parquet(roots.table("manifest_pairs.parquet"))
        select_pairs(table, a.arm, branch="arm" if "arm" in table.columns else "branch").write.parquet(a.out)
    elif a.command == "compare-runs":
        document, warnings = pipeline.comparison(spark, {r.rstrip("/").split("/")[-1]: r for r in a.runs}, a.reference, a.by_category, a.out)
        print(*[f"WARNING {w}" for w in warnings], *report_lines(document), sep="\n")
    elif a.command == "report-run":
        for r in a.runs:
            for value in ("loss", "loss_masked"):
                t = pipeline.report_run(spark, r, value, a.window)[0].first()
                if t["rows"]:
                    print(f"{r} {value}: {t['head']:.4f} -> {t['tail']:.4f} ({t['change']:+.4f} +- {t['error']:.4f}, {'significant' if t['significant'] else 'within noise'}), {t['slope_10k']:+.4f} in 10k steps")
            if a.plot:
                print(pipeline.plot_run(spark, r, window=a.window))
    elif a.command == "inspect-preproc":
        n, path = pipeline.inspect_stages(spark, roots, a.n, a.cell, a.out)
        print(f"{n} frames: {path}" if n else "no results of stage parse yet")
        bad = not n
    else:
        print(sys.version, spark.version, spark.sparkContext.defaultParallelism, sep="\n")
    return int(bool(bad))


if __name__ == "__main__":
    sys.exit(main())
