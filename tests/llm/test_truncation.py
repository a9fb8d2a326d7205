import random
import re

import numpy as np
import pyarrow as pa
import pytest

from weftline.llm.truncation import MEASURES, Vocabulary, _endings, _tails, core_text, exposed_limits, lengths, text_tails, truncated_documents, truncation_report

PARTS = ["The fabric is soft and keeps its shape", "I ordered it for a walk and like it a lot", "Wash it apart and dry it flat far from the radiator", "The zip never sticks, the pockets are real", "Sizes start from 44 and go up in single steps"]
SIGNS = ["Would buy again", "Good quality", "A pity, really…"]


def corpus(n=900, seed=0):
    rnd = random.Random(seed)
    rows, cut = [], set()
    for i in range(n):
        text = " ".join(rnd.choice(PARTS) + rnd.choice("..!") for _ in range(rnd.randint(2, 7)))
        source = f"s{i % 3}"
        if source == "s0" and len(text) > 150:
            text = text[:150]
            if not text.rstrip().endswith((".", "!")) and not any(text.endswith(p) for p in PARTS):
                cut.add(i)
        elif i % 10 == 1:
            at = rnd.randint(30, len(text) - 25)
            while text[at - 1] in " .!," or any(text[:at].endswith(p) for p in PARTS):
                at += 1
            text = text[:at] + rnd.choice(["", "…", "...", " ", "�", "<b"])
            cut.add(i)
        elif i % 5 == 2:
            text += " " + rnd.choice(SIGNS)
        elif i % 7 == 3:
            text = text[:-1] + rnd.choice(["", " :)", " 👍"])
        rows.append((i, text, source))
    return rows, cut


def tokens(core):
    """One text read word by word."""
    out, start = ["\0"], True
    for w in re.findall(r"[^\W_]+(?:[-'’][^\W_]+)*|[.!?…]+|[^\w\s]", core):
        if w[0].isalnum():
            out.append("0" if w[0].isdigit() else "\1" if not start and w[0].isupper() and not w.isupper() else w.lower())
            start = False
        elif w in ",;:()«»\"'“”„—–-/%№°*+=&_[]":
            out.append(w)
        else:
            out.append("\0")
            start = True
    return out


def test_core_and_tokens():
    assert core_text("One two <b>thr…") == "One two  thr" and core_text("a b</") == "a b" and core_text("x �\n") == "x" and core_text("… ...") == ""
    assert core_text("a &amp; b &nb") == "a   b" and core_text("a.…") == "a." and core_text("5 < 6 > 5") == "5   5"
    assert tokens("Model Zatuso costs 5, ok. New") == ["\0", "model", "\1", "costs", "0", ",", "ok", "\0", "new"]
    texts = ["Model Zatuso costs 5, ok. New", "", "(Only) «Signs» , — !", "OK МОДЕЛЬ Рост-170! «Да» A", "no end"]
    v = Vocabulary()
    for _ in range(2):
        _, _, h, size = v.read(texts)
        want = [tokens(t) for t in texts]
        assert size.tolist() == [len(w) for w in want] and h.tolist() == [v.hashes[w] for t in want for w in t]


def test_ends_of_long_texts_are_those_of_whole_texts():
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice(PARTS) + rnd.choice(["", ".", ",", ", Word", " — Да", " x" * 30, "y" * 190]) for _ in range(12)) for _ in range(60)]
    rows = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(["s"] * 60), pa.array(texts)], ["doc_id", "source", "text"])
    got = next(_tails(pa.int64())(iter([rows]))).to_pylist()
    v = Vocabulary()
    for r, text in zip(got, texts):
        _, open_, keys, inside, last = _endings(v, [core_text(text)], np.zeros(1, bool))
        assert r["open"] == open_[0] and r["keys"] == keys[0][inside[0]].tolist()
        assert r["last"] == (last.view(np.int64)[0] if open_[0] else None)


@pytest.mark.parametrize("text", ['ё<"&\n😀', "", 'plain "text" & <b>\n\\', "é\t\r"])
def test_lengths(text):
    r = dict(zip(MEASURES, lengths(text)))
    import html
    import json

    want = {
        "chars": len(text), "utf8": len(text.encode()), "utf16": len(text.encode("utf-16-be")) // 2, "chars_html": len(html.escape(text, quote=True)), "utf8_html": len(html.escape(text).encode()), "chars_json": len(json.dumps(text, ensure_ascii=False)) - 2,
        "utf8_json": len(json.dumps(text, ensure_ascii=False).encode()) - 2, "ascii_json": len(json.dumps(text)) - 2, "chars_crlf": len(text.replace("\n", "\r\n")), "utf8_crlf": len(text.replace("\n", "\r\n").encode()), "chars_br": len(text.replace("\n", "<br>")),
    }
    assert r == want


def test_found(spark):
    rows, cut = corpus()
    rows += [(2000, None, "s0"), (2001, "", "s0"), (2002, "… !", "s1"), (None, "The fab", "s1"), (2003, "The fabric is soft and kee", None), (2004, "word " * 50_000 + "end.", "s2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as own", "2 as key", "3 as m", "4 as length")
    got = {r["doc_id"]: r["truncated"] for r in truncated_documents(df).collect()}
    found = {i for i, t in got.items() if t}
    assert set(got) == {r[0] for r in rows if r[0] is not None and r[1] is not None}
    assert len(found & (cut | {2003})) >= 0.95 * len(cut) and len(found - cut - {2003}) <= 0.03 * len(cut)
    assert ("s0", 150) in {(r["source"], r["length"]) for r in exposed_limits(text_tails(df)).collect() if r["measure"] == "chars"}
    report = {r["source"]: r for r in truncation_report(df).collect()}
    assert report["s2"]["truncated"] == sum(i % 3 == 2 for i in found if i < 1000) and 0 < report["s0"]["share"] < 1
    assert truncated_documents(df.limit(0)).count() == 0


def test_copies_are_no_proof(spark):
    rows, _ = corpus(300, 1)
    rows = [r for r in rows if r[2] == "s2"] + [(9000 + i, "I ordered it for a wa", "s1") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert all(r["truncated"] for r in truncated_documents(df).filter("doc_id >= 9000").collect())


def test_copies_make_no_limit(spark):
    rows, _ = corpus(300, 2)
    rows = [r for r in rows if r[2] == "s1"] + [(9000 + i, " ".join(f"{a}{b}ilo" for a in "bdfgklmnprst" for b in "aeiouy"), "s1") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    size = len(rows[-1][1])
    assert not [r for r in exposed_limits(text_tails(df)).collect() if r["length"] == size]
    assert not any(r["truncated"] for r in truncated_documents(df).filter("doc_id >= 9000").collect())


def test_copies_hide_no_limit(spark):
    cut = [(i, f"{i:03d} " + "Wash it apart and dry it flat far from the radiator. " * 3, "s0") for i in range(12)]
    cut = [(i, t[:130], s) for i, t, s in cut]
    for size in (130, 120):  # at the limit and near it
        hot = [(1000 + i, "x" * (size - 1) + ".", "s0") for i in range(400)]
        df = spark.createDataFrame(cut + hot, "doc_id long, text string, source string")
        found = {(r["measure"], r["length"]): (r["n"], r["n_open"]) for r in exposed_limits(text_tails(df)).collect()}
        assert found.get(("chars", 130)) == (12 + (size == 130), 12)
