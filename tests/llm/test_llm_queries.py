"""Every registered query of the problems on the smallest tables, against its SQL where it has one, and
invariants of those that have none."""

import math
import os
from glob import glob

import duckdb
import pytest

from inkgrain.llm import queries as llm

D = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = llm.queries(), llm.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in glob(f"{D}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(v, 6) if isinstance(v, float) else v


def one(con, sql):
    return con.execute(sql).fetchone()[0]


def check_p1_splits(rows, con):
    assert len(rows) == one(con, "select count(*) from instances") and all(r["new_split"] for r in rows)
    assert all(len({r["new_split"] for r in rows if r["component"] == c}) == 1 for c in {r["component"] for r in rows})


def check_p1_shares(rows, con):
    assert sum(r["n_rows"] for r in rows) == one(con, "select count(*) from instances") and all(abs(r["share"] - r["target_share"]) < 0.1 for r in rows)


def check_p6_packed(rows, con):
    sizes = dict(con.execute("select container, capacity_tokens from pack_limits").fetchall())
    n = one(con, "select count(distinct doc_id) from documents")
    for c, room in sizes.items():
        own = [r for r in rows if r["container"] == c]
        held = {}
        for r in own:
            held[r["number"]] = held.get(r["number"], 0) + r["size"]
        assert max(held.values()) <= room and len({r["doc_id"] for r in own}) == n
        assert len({(r["doc_id"], r["piece"]) for r in own}) == len(own)


def check_p7_mixed(rows, con):
    most = {(m, s): k for m, s, k in con.execute("select mix, source, max_repeats from mix_targets").fetchall()}
    used = {}
    for r in rows:
        key = r["mix"], r["source"], r["doc_id"]
        used[key] = used.get(key, 0) + 1
        assert r["slot"] is not None
    assert all(n <= most[m, s] for (m, s, _), n in used.items())


def check_p8_scores(rows, con):
    assert len(rows) == one(con, "select count(*) from documents")
    assert all((r["e_value"] is None) == (r["n_words"] == 0) for r in rows)


def check_p8_rates(rows, con):
    assert sum(r["n_docs"] for r in rows) == one(con, "select count(*) from documents")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, D)
    rows = df.collect()
    if f"check_{name}" in globals():
        globals()[f"check_{name}"](rows, con)
    if name not in SQL:
        return
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in rows), key=str)
    rel = con.execute(SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=str)
    assert [tuple(map(str, r)) for r in got] == [tuple(map(str, r)) for r in want]
