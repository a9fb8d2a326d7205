"""SQL that says the same as the core queries, for the comparison engine."""

from __future__ import annotations


def _max(cols: str) -> str:
    return ", ".join(f"max({c}) as {c}" for c in cols.split())


def _num(cols: str) -> str:
    return ", ".join(f"max(case when {c}::varchar <> 'nan' then {c} end) as {c}" for c in cols.split())


FRAMES = f"""frames as (select image_id, {_max("sku_id branch order_idx is_last_product rel_path width height file_size corrupt read_ok phash content_md5")},
 {_num("sharpness white_frac")}, max(lower(trim(split))) as split from manifest_images where image_id is not null group by image_id)"""
ITEMS = f"""items as (select sku_id, {_max("folder title_base variant_no design_id category_raw n_product n_review")},
 max(lower(trim(category_group))) as category_group, max(lower(trim(split))) as split from manifest_sku where sku_id is not null group by sku_id)"""
PAIRS = f"""pairs as (select pair_id, {_max("branch sku_id design_id garment_image_id garment_rel_path person_image_id person_rel_path")},
 {_num("n_persons area_frac torso_min garment_sim colour_rank")}, max(lower(trim(category_group))) as category_group, max(lower(trim(split))) as split
 from manifest_pairs where pair_id is not null group by pair_id)"""
JOINED = f"""{FRAMES}, {ITEMS}, joined as (select f.*, i.design_id, i.category_raw, i.category_group from frames f join items i on f.sku_id = i.sku_id)"""
ANNOTATED = f"""{JOINED}, facts as (select content_md5 c, count(distinct design_id) dup_designs, count(distinct category_raw) cats from joined group by 1),
firsts as (select content_md5 c, image_id, row_number() over (partition by content_md5 order by sku_id, branch, order_idx, image_id) r from joined where content_md5 is not null),
a1 as (select j.*, case when j.content_md5 is not null then facts.dup_designs end dup_designs, facts.cats, f1.image_id is not null as is_canonical
 from joined j left join facts on facts.c = j.content_md5 left join firsts f1 on f1.image_id = j.image_id and f1.r = 1),
a2 as (select *, coalesce(cats > 1 or (branch = 'product' and dup_designs >= 4), false) is_template from a1),
annotated as (select *, coalesce(dup_designs = 1, false) and not is_template as label_ok from a2)"""
LINKS = """base as (select distinct content_md5 c, design_id d from annotated where branch = 'product' and not is_template and content_md5 is not null and design_id is not null),
star as (select b.d, m.lo from base b join (select c, min(d) lo from base group by c) m on b.c = m.c where b.d <> m.lo),
edges as (select d a, lo b from star union select lo, d from star),
reach as (select distinct design_id v, design_id r from annotated where design_id is not null union select e.a, reach.r from edges e join reach on e.b = reach.v),
components as (select v design_id, min(r) split_group from reach group by v)"""
GROUPED = f"""{ANNOTATED}, {LINKS}, gitems as (select i.*, c.split_group from items i left join components c on c.design_id = i.design_id)"""
MODE = f"""{GROUPED}, n as (select split_group, category_group, count(*) n from gitems where split_group is not null group by 1, 2),
mode as (select split_group, category_group, total as n_sku from (select *, sum(n) over (partition by split_group) total,
 row_number() over (partition by split_group order by category_group is null, n desc, category_group) r from n) where r = 1)"""
ASSIGNED = f"""{MODE}, placed as (select *, (row_number() over w - 0.5) / count(*) over (partition by coalesce(category_group, '')) place from mode
 window w as (partition by coalesce(category_group, '') order by ('0x' || substr(md5('20260906:' || split_group), 1, 13))::bigint / 4503599627370496.0, split_group)),
assigned as (select split_group, category_group, n_sku::bigint n_sku, case when place < 0.7 then 'train' when place < 0.85 then 'val' else 'test' end split from placed)"""
SIGNALS = f"""{JOINED}, {PAIRS}, person as (select person_image_id p, {_max("n_persons area_frac torso_min garment_sim colour_rank")} from pairs group by 1),
garment as (select distinct garment_image_id g from pairs),
signals as (select j.*, coalesce(p.n_persons, case when g.g is not null then 0.0 end) n_persons, p.area_frac, p.torso_min, p.garment_sim, p.colour_rank
 from joined j left join person p on p.p = j.image_id left join garment g on g.g = j.image_id)"""
FLAT = f"""{SIGNALS}, flat as (select * from signals where branch = 'product' and n_persons = 0 and white_frac >= 0.25),
garments as (select * from (select sku_id, image_id garment_image_id, rel_path garment_rel_path, row_number() over (partition by sku_id order by white_frac desc, image_id) r from flat) where r = 1)"""
WILD = f"""{FLAT}, t as (select quantile_cont(colour_rank::double, 0.45::double) t from signals where branch = 'review'),
wild as (select s.*, coalesce(n_persons >= 1, false) c1, coalesce(area_frac >= 0.05, false) c2, coalesce(torso_min >= 0.2, false) c3,
 coalesce(garment_sim >= 0.3, false) c4, coalesce(colour_rank >= t.t, false) c5 from signals s, t where branch = 'review')"""
_N = "('0x' || substr(md5({}), 1, 13))::bigint"
LABELS = f"""labels as (select image_id, case when n < 2 then 'ok' when n = 2 then 'wrong_colour' else 'not_visible' end as label, b as batch from
 (select distinct person_image_id image_id, {_N.format("person_image_id")} % 4 n, ({_N.format("'b' || person_image_id")} % 3)::int b from pairs))"""
TESTS = f"""{SIGNALS}, {LABELS}, g as (select sku_id, garment_image_id, garment_rel_path from (select *, row_number() over (partition by sku_id order by pair_id) r from pairs) where r = 1),
tests as (select g.garment_image_id || '_' || s.image_id pair_id, s.sku_id, s.category_group, g.garment_rel_path from signals s
 join labels l on l.image_id = s.image_id and l.label = 'ok' join g on g.sku_id = s.sku_id where s.split = 'test')"""
RUNS = """runs as (select l_linestatus, l_partkey pair_id, l_partkey % 4 category, avg(l_discount) score from lineitem group by all),
ab as (select a.pair_id, a.category, b.score - a.score d from runs a join runs b on a.pair_id = b.pair_id and a.l_linestatus = 'O' and b.l_linestatus = 'F')"""
DET = """det as (select vec_id, k, case when embedding[21 + k] > 0 then 'person' else 'bag' end as label, abs(embedding[31 + k]::double) * 5 score,
 round_even(abs(embedding[4 * k + 1]::double) * 100, 0) x0, round_even(abs(embedding[4 * k + 2]::double) * 100, 0) y0,
 round_even((abs(embedding[4 * k + 3]::double) + 1) * 100, 0) x1, round_even((abs(embedding[4 * k + 4]::double) + 1) * 100, 0) y1
 from embeddings, range(4) t(k)),
detected as (select vec_id, count(*) filter (where ok) n_persons, round(coalesce(max(case when ok then (x1 - x0) * (y1 - y0) end) / 90000.0, 0), 6) area_frac
 from (select *, label = 'person' and score > 0.5 ok from det) group by vec_id)"""
SCORES = """js as (select vec_id, case when v > 0.02 then v else 0 end v from (select vec_id, abs(embedding[k + 1]::double) * 4 v from embeddings, range(4) t(k))),
torso as (select vec_id, min(v) >= 0.3 visible, round(min(v), 5) torso_min from js group by vec_id)"""
SIM = """sims as (select q.vec_id, q.label, max(list_dot_product(q.embedding::double[], r.embedding::double[])) s from embeddings q
 join embeddings r on q.label = r.label and r.embedding[1] > 0 where not q.embedding[1] > 0 group by 1, 2)"""
MERGED = """firsts as (select user_id, trim(event_type) event_type, trim(props) v, min(event_id) o from events where trim(event_type) <> '' and trim(props) <> '' group by all),
merged as (select user_id, event_type, string_agg(v, '; ' order by o, v) props from firsts group by all)"""


def _pct(col: str, where: str = "") -> str:
    return f"""(rank() over (order by {col}) + (count(*) over (partition by {col}) - 1) / 2.0) / count({col}) over ()"""


def _auc(src: str) -> str:
    return f"""r as (select p, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0 k from {src}),
n as (select sum(p::int)::bigint n_pos, sum((not p)::int)::bigint n_neg, sum(case when p then k end) up from r)
select round((up - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg), 6) auc, n_pos, n_neg from n"""


def _category() -> str:
    from weftline.queries import CATEGORIES

    return "case " + " ".join("when category_raw in (" + ", ".join(f"'{n}'" for n in names) + f") then '{g}'" for g, names in CATEGORIES.items()) + " else 'unmapped' end"


def _marked() -> str:
    return f"with {PAIRS}, x as (select branch = 'wild' p, garment_sim s from pairs where garment_sim is not null)"


def _arm(which: str) -> str:
    base = f"with {PAIRS}, tr as (select *, {_N.format("'20260910:' || pair_id")} h from pairs where split = 'train'), t as (select quantile_cont(colour_rank::double, 0.65::double) t from tr where branch = 'wild')"
    clean = "select pair_id, branch from tr, t where branch = 'wild' and colour_rank >= t.t"
    studio = "select pair_id, branch from tr where branch = 'studio'"
    more = {
        "studio": "",
        "studio_wild": " union all select pair_id, branch from tr where branch = 'wild'",
        "studio_clean": f" union all {clean}",
        "studio_random": f" union all select pair_id, branch from (select *, row_number() over (order by h, pair_id) r from tr where branch = 'wild') where r <= (select count(*) from ({clean}))",
    }
    return f"{base} {studio}{more[which]}"


_B = " \t\n\x0b\f\r\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u202f\u2060\u3000\ufeff"
_FOLDED = f"replace(lower(trim({{}}, '{_B}')), 'ё', 'е')"
_NONE = "'', '-', '–', '—', '−', 'n/a', 'na', 'неизвестно', 'не известно', 'не указано', 'не указан', 'не указана', 'нет данных', 'unknown', 'none', 'null'"
_NUMERAL = rf"^([+-]?\d+(?:[{_B}]+\d+)*(?:[.,]\d+)?(?:[eE][+-]?\d+)?)[{_B}]*(?:[\p{{L}}°%$€₽][^\d,;]*)?$"
# Cells of the attribute rows, read in SQL: JSON of all layouts, typed values, one per item and attribute.
CELLS = rf"""raw as (select distinct sku_id, attrs_json::json j from manifest_sku where sku_id is not null and json_valid(attrs_json)),
docs as (select sku_id, case when json_type(j) <> 'VARCHAR' then j when json_valid(j ->> '$') then (j ->> '$')::json end j from raw),
elements as (select sku_id, e.value el from docs, json_each(docs.j) e where json_type(j) = 'ARRAY'),
rows_ as (select sku_id, e.key k, e.value v from docs, json_each(docs.j) e where json_type(j) = 'OBJECT'
 union all select sku_id, el ->> 0, el -> 1 from elements where json_type(el) = 'ARRAY' and json_array_length(el) = 2 and json_type(el -> 0) = 'VARCHAR'
 union all select sku_id, el ->> 'key', el -> 'value' from elements where json_type(el) = 'OBJECT' and json_type(el -> 'key') = 'VARCHAR'),
texts as (select sku_id, k, trim(v ->> '$', '{_B}') t from rows_ where v is not null and json_type(v) <> 'NULL'),
known as (select sku_id, attr_name, value_type, t, {_FOLDED.format("t")} f from texts join (select distinct {_FOLDED.format("spelling")} s, attr_name, value_type from attr_dict) on s = {_FOLDED.format("k")}),
read as (select sku_id, attr_name, value_type, t, f,
 case when value_type in ('int', 'double') then try_cast(replace(regexp_replace(nullif(regexp_extract(t, '{_NUMERAL}', 1), ''), '[{_B}]', '', 'g'), ',', '.') as double) end n,
 regexp_extract(t, '^(\d{{4}})[-./](\d{{1,2}})[-./](\d{{1,2}})$', ['a', 'b', 'c']) ymd, regexp_extract(t, '^(\d{{1,2}})[-./](\d{{1,2}})[-./](\d{{4}})$', ['c', 'b', 'a']) dmy from known where f not in ({_NONE})),
typed as (select sku_id, attr_name, value_type, case when value_type = 'double' or n = floor(n) and abs(n) < 9e15 then n end n,
 case when value_type = 'boolean' then case when f in ('true', '1', '1.0', 'да', 'yes', 'есть', 'имеется') then true when f in ('false', '0', '0.0', 'нет', 'no', 'нету', 'отсутствует') then false end end b,
 case when value_type = 'date' then try_cast(case when ymd.a <> '' then ymd.a || '-' || lpad(ymd.b, 2, '0') || '-' || lpad(ymd.c, 2, '0') when dmy.a <> '' then dmy.a || '-' || lpad(dmy.b, 2, '0') || '-' || lpad(dmy.c, 2, '0') end as date) end d,
 case when value_type = 'string' then t end s from read),
cells as (select sku_id, attr_name, case when min(n) = max(n) then min(n) end n, case when min(b::int) = max(b::int) then min(b::int) = 1 end b, case when min(d) = max(d) then min(d) end d, min(s) s from typed group by 1, 2)"""
# Attributes of the dictionary that become columns, by the slot their type is read into.
_WIDE = {
    "n::bigint": "density_gsm pieces wash_temp_c weight_g", "n": "elastane_pct length_cm sleeve_cm", "b": "lined pockets sheer", "d": "restocked_on shot_on", "s": "closure fabric_mix pattern_name sewn_in",
}
_COLUMNS = ", ".join(f"(max(case when attr_name = '{name}' then {slot.replace('::bigint', '')} end)){slot[len(slot.split(':')[0]):]} as {name}" for slot, names in _WIDE.items() for name in names.split())

SQL = {
    "p5_found": f"with {CELLS} select sku_id, attr_name from cells where coalesce(n::varchar, b::varchar, d::varchar, s) is not null",
    "p5_wide": f"with {CELLS} select i.sku_id, {_COLUMNS} from (select distinct sku_id from manifest_sku where sku_id is not null) i left join cells on cells.sku_id = i.sku_id group by 1",
    "content_hash": "select doc_id, md5(text) as hash from documents",
    "hash_rank": f"with {ITEMS} select sku_id, round({_N.format("'7:' || sku_id")} / 4503599627370496.0, 9) place from items",
    "shard_of": f"with {FRAMES} select ({_N.format('image_id')} % 8)::int shard, count(*) frames from frames group by 1",
    "pair_seed": f"with {PAIRS} select pair_id, {_N.format("'3:' || pair_id")} seed from pairs",
    "hamming": f"with {FRAMES}, ok as (select * from frames where phash is not null and read_ok), f as (select sku_id, arg_min(phash, image_id) h from ok group by 1) select image_id, bit_count(xor(phash, h))::bigint bits from ok join f on ok.sku_id = f.sku_id",
    "split_variant": f"with {ITEMS} select sku_id, regexp_replace(folder, '\\s*\\((\\d+)\\)\\s*$', '') base, case when folder is not null then coalesce(try_cast(nullif(regexp_extract(folder, '\\s*\\((\\d+)\\)\\s*$', 1), '') as int), 1) end variant from items",
    "design_key": f"with {ITEMS} select sku_id, trim(regexp_replace(replace(lower(regexp_replace(folder, '\\s*\\((\\d+)\\)\\s*$', '')), 'ё', 'е'), '\\s+', ' ', 'g')) design from items",
    "path_nfc": f"with {FRAMES} select image_id, nfc_normalize(rel_path) as path from frames",
    "aspect_ratio": f"with {FRAMES} select image_id, round(case when height > 0 then width / height end, 6) aspect from frames",
    "letterbox_geometry": f"""with {FRAMES}, s as (select image_id, case when width > 0 and height > 0 then least(768.0::double / width, 1024.0::double / height) end scale, width, height from frames),
 n as (select image_id, scale, greatest(1, round_even(width * scale, 0))::int nw, greatest(1, round_even(height * scale, 0))::int nh from s)
 select image_id, round(scale, 6) scale, case when scale is not null then nw end new_width, case when scale is not null then nh end new_height,
 case when scale is not null then floor((768 - nw) / 2.0)::int end as left, case when scale is not null then floor((1024 - nh) / 2.0)::int end as top from n""",
    "pixel_normalise": f"with {FRAMES} select image_id, round((width % 256) / 127.5::double - 1, 6) as value from frames where width is not null",
    "probe_headers": f"with {FRAMES} select image_id, case when width > 0 and height > 0 then width else -1 end as width, case when width > 0 and height > 0 then height else -1 end as height, not coalesce(width > 0 and height > 0, false) corrupt from frames",
    "json_extract": "select event_id, cast(json_extract_string(props, '$.k') as bigint) k from events",
    "kv_merge": f"with {MERGED} select * from merged",
    "kv_pivot": f"with {MERGED} select user_id, max(case when event_type = 'click' then props end) clicks, max(case when event_type = 'view' then props end) as views from merged group by 1",
    "kv_residual": f"with {MERGED} select user_id, '{{' || coalesce(string_agg(to_json(event_type)::varchar || ':' || to_json(props)::varchar, ',' order by event_type) filter (where event_type not in ('click', 'view')), '') || '}}' rest from merged group by 1",
    "category_map": f"with {ITEMS} select sku_id, {_category()} mapped from items",
    "asset_ordering": f"""with {FRAMES}, k as (select *, split_part(rel_path, '/', -1) nm from frames), o as (select *, coalesce(try_cast(nullif(regexp_extract(nm, '^(\\d+)', 1), '') as bigint), 0) lead from k)
 select image_id, (row_number() over (partition by sku_id, branch order by lead, nm, rel_path) - 1)::int order_idx,
 row_number() over (partition by sku_id, branch order by lead desc, nm desc, rel_path desc) = 1 and coalesce(branch = 'product', false) is_last_product from o""",
    "design_variants": f"with {ITEMS} select sku_id, case when design_id is not null then count(*) over (partition by design_id) end design_variants from items",
    "group_inventory": f"with {FRAMES}, {ITEMS} select category_group, count(*) as items, coalesce(sum(n), 0)::bigint frames from items i left join (select sku_id, count(*) n from frames group by 1) f on f.sku_id = i.sku_id group by 1",
    "health_counts": f"with {FRAMES} select count(*) filter (where corrupt) corrupt, count(*) filter (where not read_ok) unread, count(*) filter (where read_ok is null) unchecked, count(*) filter (where phash is null) no_hash, count(*) filter (where split is null) no_split from frames",
    "distinct_counts": f"with {ITEMS} select count(distinct sku_id) sku_id, count(distinct design_id) design_id, count(distinct category_raw) category_raw from items",
    "dup_annotate": f"with {ANNOTATED} select image_id, dup_designs, is_template, label_ok, is_canonical from annotated",
    "working_set": f"with {ANNOTATED} select image_id, sku_id, category_group from annotated where read_ok and is_canonical and label_ok and not is_template and category_group in ('upper', 'lower', 'dress', 'outer')",
    "working_set_counts": f"with {ANNOTATED} select category_group, branch, count(*) frames, count(distinct design_id) designs from annotated where read_ok and is_canonical and label_ok and not is_template and category_group in ('upper', 'lower', 'dress', 'outer') group by 1, 2",
    "pending_rows": f"with {FRAMES} select image_id, ({_N.format('image_id')} % 4)::int shard from frames where phash is null",
    "missing_inputs": f"with {FRAMES} select image_id, 'agnostic' as missing from frames where not coalesce(width > 500, false) union all select image_id, 'parse' from frames where not coalesce(height > 600, false) union all select image_id, 'pose' from frames where not coalesce(branch = 'review', false)",
    "qc_join": f"with {FRAMES} select image_id, case when read_ok then sharpness * 2 end sharpness from frames",
    "design_components": f"with recursive {ANNOTATED}, {LINKS} select design_id, split_group from components",
    "group_mode": f"with recursive {MODE} select split_group, category_group, n_sku::bigint n_sku from mode",
    "split_assign": f"with recursive {ASSIGNED} select * from assigned",
    "split_counts": f"with recursive {ASSIGNED} select split, count(*) n from assigned group by 1",
    "leak_check": f"with {FRAMES}, c as (select content_md5, count(distinct split) k, count(*) n from frames where branch = 'product' and content_md5 is not null group by 1) select count(*) contents_in_several_splits, coalesce(sum(n), 0)::bigint rows_affected from c where k > 1",
    "leak_overlap": f"with {PAIRS} select sku_id from pairs where split = 'test' and sku_id is not null intersect select sku_id from pairs where split <> 'test'",
    "crosstab_split": f"with recursive {ASSIGNED} select i.category_group, count(*) filter (where a.split = 'train') train, count(*) filter (where a.split = 'val') val, count(*) filter (where a.split = 'test') test from gitems i left join assigned a on a.split_group = i.split_group group by 1",
    "persons_crosstab": f"with {PAIRS}, x as (select branch, least(n_persons, 3)::int k from pairs) select branch, count(*) filter (where k = 0) \"0\", count(*) filter (where k = 1) \"1\", count(*) filter (where k = 2) \"2\", count(*) filter (where k = 3) \"3\" from x group by 1",
    "quality_percentiles": f"with {FRAMES} select branch, " + ", ".join(f"round(quantile_cont(sharpness::double, {q}::double), 1) p{n}" for q, n in (("0.05", "05"), ("0.1", "10"), ("0.5", "50"), ("0.9", "90"))) + " from frames group by 1",
    "reference_bank": "select label bank_item, count(*) vectors from embeddings where embedding[1] > 0 group by 1",
    "dot_product": "select v.vec_id, round(list_dot_product(v.embedding::double[], f.e::double[]), 5) product from embeddings v join (select label, arg_min(embedding, vec_id) e from embeddings group by 1) f on f.label = v.label",
    "max_similarity": f"with {SIM} select vec_id, round(s, 5) garment_sim from sims",
    "l2_normalise": "select vec_id, round(embedding[1]::double * 3 / sqrt(list_sum(list_transform(embedding, lambda x: (x::double * 3) * (x::double * 3)))), 5) as first from embeddings",
    "torso_visible": f"with {SCORES} select vec_id, visible, torso_min from torso",
    "largest_box": f"with {DET} select vec_id, x0, y1 from (select *, row_number() over (partition by vec_id order by (x1 - x0) * (y1 - y0) desc, x0 desc, y0 desc, x1 desc, y1 desc) r from det) where r = 1",
    "detect_summary": f"with {DET} select * from detected",
    "collect_signals": f"with {DET}, {SCORES} select e.vec_id, d.n_persons::double n_persons, d.area_frac, t.torso_min from embeddings e left join detected d on d.vec_id = e.vec_id and d.n_persons > 0 left join torso t on t.vec_id = e.vec_id and t.visible",
    "pct_rank": f"with {PAIRS} select pair_id, case when garment_sim is not null then round({_pct('garment_sim')}, 9) end pct from pairs",
    "colour_rank_lowest": f"with {PAIRS}, x as (select pair_id, coalesce(area_frac, -1e9) a, coalesce(torso_min, -1e9) b from pairs) select pair_id, round({_pct('a')} + {_pct('b')}, 9) colour_rank from x",
    "colour_rank_skip": f"with {PAIRS} select pair_id, round(coalesce(case when area_frac is not null then {_pct('area_frac')} end, 0) + coalesce(case when torso_min is not null then {_pct('torso_min')} end, 0), 9) colour_rank from pairs",
    "colour_threshold": f"with {PAIRS} select 0.45::double q, round(quantile_cont(colour_rank::double, 0.45::double), 6) threshold from pairs where branch = 'wild'",
    "auc": f"{_marked()}, {_auc('x')}",
    "similarity_auc": f"with {SIM}, x as (select label < 5 p, s from sims), {_auc('x')}",
    "threshold_sweep": f"""{_marked()}, q as (select unnest(range(40))::int step, unnest(quantile_cont(s::double, [{', '.join(f'{0.9 * i / 39!r}::double' for i in range(40))}])) t from x)
 select step, round(t, 6) threshold, count(*) filter (where s >= t) kept, round(count(*) filter (where s >= t and p) / count(*) filter (where s >= t), 6) as precision,
 round(count(*) filter (where s >= t and p) / count(*) filter (where p), 6) recall from q, x group by step, t having count(*) filter (where s >= t and p) > 0""",
    "filter_quality": f"""with {PAIRS}, {LABELS}, t as (select quantile_cont(colour_rank::double, 0.45::double) t from pairs where colour_rank is not null), x as (select l.label = 'ok' p, colour_rank s from pairs join labels l on l.image_id = person_image_id and l.label in ('ok', 'wrong_colour') where colour_rank is not null),
 c as (select count(*) filter (where s >= t and p) tp, count(*) filter (where s >= t and not p) fp, count(*) filter (where s < t and p) fn from x, t) select tp, fp, fn, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) recall from c""",
    "flat_candidates": f"with {FLAT} select image_id, sku_id from flat",
    "best_garment": f"with {FLAT} select sku_id, garment_image_id, garment_rel_path from garments",
    "cascade_funnel": f"""with {WILD}, n as (select count(*) s0, count(*) filter (where c1) s1, count(*) filter (where c1 and c2) s2, count(*) filter (where c1 and c2 and c3) s3,
 count(*) filter (where c1 and c2 and c3 and c4) s4, count(*) filter (where c1 and c2 and c3 and c4 and c5) s5 from wild)
 select 0 step_no, 'review_frames' step, s0 kept from n union all select 1, 'person_found', s1 from n union all select 2, 'large_enough', s2 from n union all select 3, 'torso_visible', s3 from n
 union all select 4, 'same_garment', s4 from n union all select 5, 'same_colour', s5 from n""",
    "build_pairs": f"""with {WILD}, both_arms as (select image_id, sku_id, 'studio' arm from signals where branch = 'product' and n_persons > 0 union all select image_id, sku_id, 'wild' from wild where c1 and c2 and c3 and c4 and c5)
 select g.garment_image_id || '_' || b.image_id pair_id, arm, b.sku_id, g.garment_image_id, b.image_id person_image_id from both_arms b join garments g on g.sku_id = b.sku_id""",
    "test_set": f"with {TESTS} select pair_id, sku_id, garment_rel_path from tests",
    "test_set_summary": f"with {TESTS} select category_group, count(*) pairs, count(distinct sku_id) as items from tests group by 1",
    "check_inputs": f"""with {PAIRS}, {FRAMES}, sides as (select pair_id, 'garment' what, garment_image_id id from pairs union all select pair_id, 'person', person_image_id from pairs)
 select pair_id, what from sides where not exists (select 1 from frames f where f.image_id = sides.id and f.read_ok)""",
    "stratified_sample": f"""with {PAIRS}, b as (select *, {_N.format("'20260906:' || pair_id")} h from pairs where category_group is not null), z as (select category_group c, greatest(1, round_even(250.0 * count(*) / (select count(*) from b), 0)) q from b group by 1)
 select pair_id, category_group from (select b.*, z.q, row_number() over (partition by category_group order by h, pair_id) r from b join z on z.c = b.category_group) where r <= q""",
    "verify_pool": f"""with {SIGNALS}, {LABELS}, g as (select sku_id, min(garment_rel_path) ref_path from pairs group by 1), cov as (select distinct sku_id from pairs where {_N.format('sku_id')} % 3 = 0),
 c as (select s.image_id, s.sku_id, g.ref_path, cov.sku_id is null new_item, {_N.format("'0:' || s.image_id")} h from signals s join g on g.sku_id = s.sku_id left join cov on cov.sku_id = s.sku_id
 where branch = 'review' and split = 'test' and n_persons >= 1 and area_frac >= 0.05 and torso_min >= 0.2 and garment_sim >= 0.3 and s.image_id not in (select image_id from labels where label = 'wrong_colour'))
 select image_id, sku_id, ref_path, new_item from (select *, row_number() over (partition by sku_id order by new_item desc, h, image_id) r from c) where r <= 4""",
    "label_pool_garment": f"with {ANNOTATED} select image_id from annotated where split = 'train' and category_group in ('upper', 'lower', 'dress', 'outer') and read_ok and branch = 'product' and not is_template",
    "label_pool_wild": f"""with {ANNOTATED}, base as (select * from annotated where split = 'train' and category_group in ('upper', 'lower', 'dress', 'outer') and read_ok),
 f as (select sku_id, rel_path ref_path from (select *, row_number() over (partition by sku_id order by order_idx nulls first, image_id, rel_path) r from base where branch = 'product' and not is_template) where r = 1)
 select image_id, ref_path from base join f on f.sku_id = base.sku_id where branch = 'review' and label_ok and is_canonical and ref_path is not null""",
    "label_merge": f"with {PAIRS}, {LABELS}, u as (select image_id, label, batch from labels union all select image_id, 'late', 1 from labels) select image_id, label, batch from (select *, row_number() over (partition by image_id order by batch, label) r from u) where r = 1",
    "common_pairs": f"with {RUNS} select pair_id from runs where l_linestatus = 'O' intersect select pair_id from runs where l_linestatus = 'F'",
    "metrics_mean": f"with {PAIRS} select branch, round(avg(area_frac), 6) area_frac, round(avg(torso_min), 6) torso_min, round(avg(garment_sim), 6) garment_sim from pairs group by 1",
    "paired_compare": f"with {RUNS} select count(*) pairs, round(avg(d), 6) mean_diff, round(avg((d > 0)::int), 6) share_b_higher from ab",
    "compare_by_category": f"with {RUNS} select category, count(*) pairs, round(avg(d), 6) mean_diff, round(avg((d > 0)::int), 6) share_b_higher from ab group by 1",
    "signed_rank": f"""with {RUNS}, nz as (select d, abs(d) m from ab where d <> 0), r as (select d, rank() over (order by m) + (count(*) over (partition by m) - 1) / 2.0 r from nz),
 w as (select count(*) n, coalesce(sum(case when d > 0 then r end), 0)::double w from r), t as (select sum(c * c * c - c)::double ties from (select count(*)::double c from nz group by m))
 select n, round(w, 3) w_plus, round((w - n * (n + 1) / 4.0) / sqrt(n * (n + 1.0) * (2 * n + 1) / 24.0 - ties / 48.0), 4) z from w, t""",
    "run_trend": """with l as (select event_id, value v, row_number() over (order by ts, event_id) - 1 i, count(*) over () n from events where value is not null), k as (select *, greatest(1, n // 10) k from l),
 a as (select count(*) as rows, avg(v) filter (where i < k) head, avg(v) filter (where i >= n - k) tail, sqrt(var_samp(v) filter (where i < k) / max(k) + var_samp(v) filter (where i >= n - k) / max(k)) error, regr_slope(v, event_id::double) * 10000 s from k)
 select rows, round(head, 6) head, round(tail, 6) tail, round(tail - head, 6) change, round(error, 6) error, round(s, 6) slope_10k, abs(tail - head) > 2 * error significant from a""",
    "rolling_mean": "select event_id, round(avg(value) over (order by ts, event_id rows between 39 preceding and current row), 6) rolling from events",
    **{f"select_pairs_{a}": _arm(a) for a in ("studio", "studio_wild", "studio_clean", "studio_random")},
}
