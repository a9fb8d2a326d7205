from collections import Counter, defaultdict

import pytest

from tests.compare import connect, same
from weftline.llm.packing import VOCABULARY, encoder
from weftline.llm.queries import SUBSET_SHARE, oracle_sql, queries
from weftline.llm.truncation import MEASURES, core_text, lengths
from weftline.llm.words import words

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_against_sql(spark, con, name):
    same(queries()[name](spark, SMALL), con, oracle_sql()[name])


def rows(spark, name):
    return queries()[name](spark, SMALL).collect()


@pytest.fixture(scope="module")
def documents(con):
    return con.execute("select doc_id, text, source from documents").fetchall()


def test_subset(spark, con):
    got = rows(spark, "p1_subset")
    table = con.execute("select distinct pair_id, sku_id, lower(trim(category_group)) from manifest_pairs where lower(trim(split)) = 'train' and pair_id is not null").fetchall()
    pairs, items = {r[0] for r in table}, {r[1] for r in table}
    k = round(SUBSET_SHARE * len(pairs))
    assert len(got) == len({r["pair_id"] for r in got}) == k and {r["pair_id"] for r in got} <= pairs
    assert len({r["sku_id"] for r in got}) == min(k, len(items))
    per = Counter(r["category_group"] for r in got)
    room = defaultdict(set)
    for _, sku, group in table:
        room[group].add(sku)
    # Groups whose items aren't used up have about as many as the largest.
    assert all(n >= max(per.values()) - 1 or n >= len(room[g]) - 1 for g, n in per.items() if g)


def test_assigned_splits(spark, con):
    got = rows(spark, "p4_assign")
    assert {r["sku_id"] for r in got} == {r[0] for r in con.execute("select distinct sku_id from manifest_sku where sku_id is not null").fetchall()} and len(got) == len({r["sku_id"] for r in got})
    of = defaultdict(set)
    for r in got:
        of[r["group_id"]].add(r["split"])
    assert all(len(s) == 1 for s in of.values())
    n = Counter(r["split"] for r in got)
    assert n["val"] == n["test"] == round(0.15 * len(got))  # single items make every total possible
    linked = {r["design_id"]: r["split_group"] for r in rows(spark, "p2_split_groups")}
    assert {r["group_id"] for r in got} & set(linked.values())


def test_sequences(spark, documents):
    got, enc = rows(spark, "p7_sequences"), encoder(VOCABULARY)
    size = {d: len(enc.encode_ordinary(t)) if t else 0 for d, t, _ in documents}
    parts, room = defaultdict(list), defaultdict(list)
    for r in got:
        parts[r["doc_id"]].append((r["start"], r["n_tokens"]))
        if r["n_tokens"]:
            room[r["sequence_id"]].append((r["sequence_offset"], r["n_tokens"]))
    assert set(parts) == set(size)
    for d, p in parts.items():
        assert sum(n for _, n in p) == size[d] and len(p) == max(1, -(-size[d] // 2048))
    for p in room.values():
        end = 0
        for at, n in sorted(p):
            assert at == end
            end += n
        assert end <= 2048
    assert sorted(room) == list(range(len(room)))
    report = rows(spark, "p7_report")[0]
    total = sum(size.values())
    assert (report["sequences"], report["tokens"]) == (len(room), total) and report["unused"] == round(1 - total / (2048 * len(room)), 6) < 0.05


def test_leak_report(spark, con, documents):
    items = con.execute("select item_id, text from eval_items").fetchall()
    runs = lambda w: {tuple(w[i : i + 12]) for i in range(len(w) - 11)}
    docs = [(words(t), runs(words(t))) for _, t, _ in documents]
    got = {r["item_id"]: r for r in rows(spark, "p8_report")}
    for item, text in items:
        w = words(text)
        mine = runs(w)
        leaked = [d for d, r in docs if r & mine]
        assert (got[item]["documents"] if item in got else 0) == len(leaked)
        if leaked:
            # Words of the item in a shared run of 12; tiles can't cover more.
            most = 0
            for d in leaked:
                shared = runs(d) & mine
                covered = {j for i in range(len(w) - 11) if tuple(w[i : i + 12]) in shared for j in range(i, i + 12)}
                most = max(most, len(covered) / len(w))
            assert 12 / len(w) - 1e-6 <= got[item]["most"] <= most + 1e-6 and got[item]["mostly"] <= got[item]["documents"]


def test_truncated_texts(spark, documents):
    found = {r["doc_id"] for r in rows(spark, "p9_found")}
    texts = {d: t for d, t, _ in documents}
    assert found and all(core_text(texts[d])[-1:] not in (".", "!", "?", "") for d in found)
    per, cut = Counter(s for _, t, s in documents if t is not None), Counter(s for d, _, s in documents if d in found)
    got = {r["source"]: r for r in rows(spark, "p9_report")}
    assert set(got) == set(per)
    for s, r in got.items():
        assert (r["documents"], r["truncated"], r["share"]) == (per[s], cut[s], round(cut[s] / per[s], 6))


def test_exposed_limits(spark, documents):
    n = Counter()
    for source, core, size in {(s, core_text(t), tuple(lengths(t))) for _, t, s in documents if t is not None}:
        for m, x in zip(MEASURES, size):
            n[source, m, x, core] = 1
    per = Counter()
    for source, m, x, _ in n:
        per[source, m, x] += 1
    for r in rows(spark, "p9_limits"):
        near = sum(per[r["source"], r["measure"], r["length"] + d] for d in range(-25, 26) if d) / 50
        assert per[r["source"], r["measure"], r["length"]] == r["n"] >= 5 * max(near, 0.2) and 4 <= r["n_open"] <= r["n"] <= 2 * r["n_open"]


def test_every_query_without_sql_is_tested_here():
    assert set(queries()) - set(oracle_sql()) == {"p1_subset", "p4_assign", "p7_sequences", "p7_report", "p8_report", "p9_found", "p9_report", "p9_limits"}
