"""SQL that says the same as queries of this subpackage, by brute force over whole tables."""

from __future__ import annotations

_FOLD = "trim(regexp_replace(replace(lower({}), 'ё', 'е'), '\\s+', ' ', 'g'))"
LINKS = f"""links as (select {_FOLD.format("design_a")} a, {_FOLD.format("design_b")} b from design_links where verdict = 'same' and trim(design_a) <> '' and trim(design_b) <> ''),
edges as (select a, b from links where a <> b union select b, a from links where a <> b),
reach as (select a v, a r from edges union select e.a, reach.r from edges e join reach on e.b = reach.v),
groups as (select v, min(r) g from reach group by v)"""
FRAMES = """frames as (select image_id, max(phash) h, max(case when lower(trim(split)) in ('train', 'val', 'test') then lower(trim(split)) end) s, min(branch) branch
 from manifest_images where image_id is not null group by image_id having max(phash) is not null and not coalesce(bool_or(read_ok = false), false))"""
OVERLAPS = f"""{FRAMES}, hits as (select e.image_id ev, t.image_id tr, e.s, e.branch from frames e join frames t on e.s in ('val', 'test') and t.s = 'train' and bit_count(xor(e.h, t.h)) <= 5)"""
ITEMS = f"""items as (select sku_id, min({_FOLD.format("design_id")}) d, min(lower(trim(split))) lo, max(lower(trim(split))) hi from manifest_sku where sku_id is not null group by 1)"""
_WORDS = "regexp_extract_all(replace(lower(nfc_normalize(regexp_replace(regexp_replace(text, '<[^<>]*>', ' ', 'g'), '&(#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);', ' ', 'g'))), 'ё', 'е'), '[\\p{L}\\p{N}]+')"
RUNS = f"""dw as (select doc_id, {_WORDS} w from documents), iw as (select item_id, {_WORDS} w from eval_items),
d12 as (select distinct doc_id, array_to_string(w[i : i + 11], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 10)) i from dw where len(w) >= 12)),
i12 as (select distinct item_id, array_to_string(w[i : i + 11], ' ') g from (select item_id, w, unnest(range(1, len(w) - 10)) i from iw where len(w) >= 12))"""

SQL = {
    "p2_found": f"with recursive {LINKS} select v design_id, g group_id from groups",
    "p2_split_groups": f"with recursive {LINKS}, k as (select distinct {_FOLD.format('design_id')} design_id from manifest_sku where trim(design_id) <> '') select design_id, coalesce(g, design_id) split_group from k left join groups on v = design_id",
    "p3_found": f"with {OVERLAPS} select least(ev, tr) image_a, greatest(ev, tr) image_b from hits",
    "p3_report": f"with {OVERLAPS} select s eval_split, branch, count(*) pairs, count(distinct ev) eval_frames from hits group by 1, 2",
    "p4_found": f"with recursive {LINKS}, {ITEMS}, m as (select coalesce(g, d, sku_id) g, lo, hi from items left join groups on v = d) select g group_id from m group by 1 having min(lo) <> max(hi)",
    "p6_found": f"""with recursive {FRAMES}, hs as (select h, min(image_id) first, count(*) n from frames group by 1),
 near as (select a.first a, b.first b from hs a join hs b on a.h <> b.h and bit_count(xor(a.h, b.h)) <= 5), reach as (select distinct a v, a r from near union select e.a, reach.r from near e join reach on e.b = reach.v),
 g as (select v, min(r) g from reach group by v) select f.image_id, coalesce(g.g, hs.first) group_id from frames f join hs on hs.h = f.h left join g on g.v = hs.first where g.g is not null or hs.n > 1""",
    "p8_found": f"with {RUNS} select distinct doc_id, item_id from d12 join i12 using (g)",
}
