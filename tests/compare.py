"""A query's rows against those of its SQL, order apart."""

import math
from pathlib import Path

import duckdb


def connect(d):
    c = duckdb.connect()
    for p in Path(d).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    return v


def same(df, con, sql):
    cols = sorted(df.columns)
    rel = con.execute(sql)
    names = [x[0] for x in rel.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    want = sorted((tuple(_plain(r[i]) for i in order) for r in rel.fetchall()), key=key)
    got = sorted((tuple(_plain(r[c]) for c in cols) for r in df.select(*cols).collect()), key=key)
    assert len(got) == len(want), (len(got), len(want))
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    assert not bad, bad[:3]
    return len(got)
