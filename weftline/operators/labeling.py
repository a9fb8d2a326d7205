"""Samples for human labelling, pools, merging of label batches, and the labelling page."""

from __future__ import annotations

import hashlib
import html
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.ids import hash_rank
from weftline.functions.nulls import known
from weftline.operators.pairs import MIN_AREA, MIN_SIM, MIN_TORSO
from weftline.plans.bounded import small_side


def stratified_sample(pool: DataFrame, n: int, seed: int, stratum: str = "category_group", key: str = "image_id") -> DataFrame:
    """About ``n`` rows, shared out by stratum: max(1, round half to even of n * share), at most the stratum.

    Rows of a stratum are taken in hash order of (seed, key); the rank filter limits
    every partition before the shuffle (no stratum sends more than its quota from a partition). NULL strata are left out.
    """
    base = pool.filter(F.col(stratum).isNotNull())
    sizes = base.groupBy(F.col(stratum).alias("__s")).agg(F.count(F.lit(1)).alias("__n"))
    total = sizes.agg(F.sum("__n")).first()[0] or 0
    quota = F.greatest(F.lit(1), F.bround(F.lit(float(n)) * F.col("__n") / F.lit(float(max(total, 1)))).cast("int"))
    sizes = sizes.select("__s", quota.alias("__q"))
    most = sizes.agg(F.max("__q")).first()[0] or 0
    w = Window.partitionBy(stratum).orderBy("__h", key)
    ranked = base.withColumn("__h", hash_rank(key, seed)).withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= most)
    return ranked.join(small_side(sizes), F.col(stratum) == F.col("__s")).filter("__r <= __q").drop("__h", "__r", "__s", "__q")


def verify_pool(frames: DataFrame, garments: DataFrame, labelled: DataFrame, covered: DataFrame, cap: int = 4, split: str = "test", seed: int = 0) -> DataFrame:
    """Review frames of the test split to be confirmed by hand, at most ``cap`` per item.

    Frames pass the cascade without its colour step, have a garment reference (``garments``: ``sku_id, ref_path``) and
    no label yet; items not covered by the test set come first, the rest is hash order.
    """
    ok = (F.col("branch") == "review") & (F.col("split") == split) & (known("n_persons") >= 1) & (known("area_frac") >= MIN_AREA) & (known("torso_min") >= MIN_TORSO) & (known("garment_sim") >= MIN_SIM)
    rows = frames.filter(ok).join(garments.select(F.col("sku_id").alias("__g"), "ref_path"), F.col("sku_id") == F.col("__g")).drop("__g")
    rows = rows.join(labelled.select(F.col("image_id").alias("__l")), F.col("image_id") == F.col("__l"), "left_anti")
    known_items = covered.select(F.col("sku_id").alias("__c")).distinct()
    rows = rows.join(known_items, F.col("sku_id") == F.col("__c"), "left").withColumn("new_item", F.col("__c").isNull()).drop("__c")
    w = Window.partitionBy("sku_id").orderBy(F.desc("new_item"), "__h", "image_id")
    return rows.withColumn("__h", hash_rank("image_id", seed)).withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= cap).drop("__h", "__r")


def label_pools(frames: DataFrame, groups: tuple[str, ...] = ("upper", "lower", "dress", "outer"), split: str = "train") -> tuple[DataFrame, DataFrame]:
    """(garment pool, wild pool): readable train frames of the groups; wild ones carry the item's first product frame as ``ref_path``."""
    base = frames.filter((F.col("split") == split) & F.col("category_group").isin(list(groups)) & F.coalesce(F.col("read_ok"), F.lit(False)))
    garment = base.filter((F.col("branch") == "product") & ~F.col("is_template"))
    first = garment.groupBy(F.col("sku_id").alias("__s")).agg(F.min(F.struct("order_idx", "image_id", "rel_path")).alias("f")).select("__s", F.col("f.rel_path").alias("ref_path"))
    wild = base.filter((F.col("branch") == "review") & F.col("label_ok") & F.col("is_canonical")).join(first, F.col("sku_id") == F.col("__s")).drop("__s")
    return garment, wild.filter("ref_path is not null")


def merge_labels(labels: DataFrame, key: str = "image_id", order: list[str] | None = None) -> DataFrame:
    """The first label of each key by batch order (``order`` columns, then the label)."""
    order = order or ["batch"]
    rest = [c for c in labels.columns if c != key]
    first = F.min(F.struct(*order, *[c for c in rest if c not in order]))
    return labels.filter(F.col(key).isNotNull()).groupBy(key).agg(first.alias("f")).select(key, *[F.col("f")[c].alias(c) for c in rest])


def batch_id(ids: list[str]) -> str:
    """Print of a batch: the same for the same ids in any order."""
    return hashlib.blake2b("\n".join(sorted(ids)).encode(), digest_size=4).hexdigest()


@dataclass(frozen=True)
class Task:
    """A labelling task: what is asked, the classes (code, caption), and whether the item's reference is shown beside the frame."""

    title: str
    hint: str
    classes: tuple[tuple[str, str], ...]
    paired: bool = True


# The tasks and the codes of their classes, which label files carry.
TASKS = {
    "garment": Task("Product frame: laid flat or worn", "Infographics, close-ups of fabric and accessories are other.", (("flat", "laid flat"), ("on_model", "worn"), ("other", "other")), False),
    "wild": Task("Review frame: fit for training", "The item's product frame is on the right: compare the colours.", (("good", "fit"), ("no_person", "nobody wears it"), ("crop", "torso cut or covered"), ("color_mismatch", "other colour"))),
    "verify": Task("Pair for the test set", "Confirm only what is beyond doubt.", (("ok", "right"), ("wrong_colour", "other colour"), ("not_visible", "not seen or not worn"))),
}

_PAGE = """<!doctype html>
<html lang="en"><head><meta charset="utf-8"><title>%(title)s</title>
<style>
body { font: 16px sans-serif; margin: 2em; }
figure { display: inline-block; margin: 0 1em 1em 0; }
img { max-height: 70vh; }
.chosen { outline: 3px solid #06c; }
progress { width: 100%%; }
</style></head><body>
<h1>%(title)s</h1>
<p>%(hint)s</p>
<main></main>
<script type="application/json" id="task">%(task)s</script>
<script>
"use strict";
class Labelling {
  constructor(task, root) {
    Object.assign(this, task, { root, place: 0 });
    this.slot = `weftline/${this.batch}`;
    this.given = new Map(JSON.parse(localStorage.getItem(this.slot) ?? "[]"));
    this.place = Math.max(0, this.items.findIndex(x => !this.given.has(x.image_id)));
    addEventListener("keyup", e => this.key(e.key));
    this.draw();
  }
  key(name) {
    const step = { ArrowRight: 1, ArrowLeft: -1 }[name];
    if (step) this.move(step);
    else if (/^[1-9]$/.test(name) && name <= this.classes.length) this.give(this.classes[name - 1][0]);
  }
  move(step) {
    this.place = Math.min(this.items.length - 1, Math.max(0, this.place + step));
    this.draw();
  }
  give(code) {
    this.given.set(this.items[this.place].image_id, code);
    localStorage.setItem(this.slot, JSON.stringify([...this.given]));
    this.move(1);
  }
  csv() {
    const cell = v => `"${String(v ?? "").split('"').join('""')}"`;
    const rows = this.items.filter(x => this.given.has(x.image_id))
      .map(x => [x.image_id, x.rel_path, x.category, this.given.get(x.image_id), this.batch].map(cell).join());
    return ["image_id,rel_path,category_group,label,batch", ...rows].join("\\n") + "\\n";
  }
  save() {
    const url = URL.createObjectURL(new Blob([this.csv()], { type: "text/csv" }));
    Object.assign(document.createElement("a"), { href: url, download: `labels_${this.batch}.csv` }).click();
    URL.revokeObjectURL(url);
  }
  draw() {
    const el = (name, props, ...inside) => { const e = Object.assign(document.createElement(name), props); e.append(...inside); return e; };
    const item = this.items[this.place];
    const picture = (src, caption) => src ? [el("figure", {}, el("img", { src }), el("figcaption", { textContent: caption ?? "" }))] : [];
    const buttons = this.classes.map(([code, caption], n) => el("button", {
      textContent: `${n + 1} ${caption}`, onclick: () => this.give(code), className: item && this.given.get(item.image_id) === code ? "chosen" : "" }));
    this.root.replaceChildren(
      el("progress", { max: this.items.length, value: this.given.size }),
      ...(item ? [...picture(item.thumb, item.rel_path), ...picture(item.ref_thumb, item.ref_path)] : []),
      el("p", {}, ...buttons),
      el("button", { textContent: "CSV", onclick: () => this.save() }));
  }
}
new Labelling(JSON.parse(document.getElementById("task").textContent), document.querySelector("main"));
</script></body></html>
"""


def label_page(title: str, hint: str, classes: list[tuple[str, str]], items: list[dict]) -> str:
    """A self-contained labelling page for a bounded sample.

    Each item has ``image_id``, ``rel_path``, ``category`` and optional ``thumb`` / ``ref_thumb`` (data URLs). Digits or buttons give a class, arrows move. Marks are kept
    in the browser under the batch's id, so a reload goes on where it stopped, and are exported as CSV with the batch in its name.
    """
    task = {"batch": batch_id([i["image_id"] for i in items]), "classes": [list(c) for c in classes], "items": items}
    return _PAGE % {"title": html.escape(title), "hint": html.escape(hint), "task": json.dumps(task, ensure_ascii=False).replace("</", "<\\/")}
