"""Every query over the smallest tables against its SQL, and the contract of the entry module."""

import os

import pytest
from compare import spark_rows, sql_rows
from conftest import DATA

import __spark_entry__ as entry

FOLDER = f"{DATA}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
SLOW_SQL = {"p10_found", "p10_shares"}  # compared beside their own operators


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - SLOW_SQL))
def test_query_equals_sql(spark, name):
    assert spark_rows(entry.queries()[name](spark, FOLDER)) == sql_rows(FOLDER, entry.oracle_sql()[name])


@pytest.mark.parametrize("name, kind, columns", [("p3_nodes", "node", ("lon_i", "lat_i", "tags", "meta")), ("p3_ways_whole", "way", ("nodes", "tags", "meta")), ("p3_relations", "relation", ("members", "tags", "meta"))])
def test_whole_state_after_the_feed(spark, name, kind, columns):
    """Every element, and all it carries, against plain Python."""
    import pyarrow.parquet as pq

    table = lambda t: pq.read_table(f"{FOLDER}/{t}.parquet").to_pylist()
    of = lambda r: -1 if not r["meta"] or r["meta"]["version"] is None else r["meta"]["version"]
    now = {}
    for r in table(f"{kind}s"):
        if r["id"] is not None and (r["id"] not in now or of(r) > of(now[r["id"]])):
            now[r["id"]] = r
    version = {i: r["meta"] and r["meta"]["version"] for i, r in now.items()}
    if kind == "node":
        at = {}
        for r in table("locations"):
            if r["id"] not in at or r["version"] > at[r["id"]]["version"]:
                at[r["id"]] = r
        version |= {i: r["version"] for i, r in at.items()}
        now = {i: {"lon_i": None, "lat_i": None, "tags": None, "meta": None} | now.get(i, {}) | at.get(i, {}) for i in {*now, *at}}
    last = {}
    for c in table("changes"):
        rank = (c["version"], -1 if not c["meta"] or c["meta"]["timestamp"] is None else c["meta"]["timestamp"])
        if c["type"] == kind and c["id"] is not None and (c["id"] not in last or rank > last[c["id"]][0]):
            last[c["id"]] = rank, c
    want = {i: (version[i], "base", *[r[c] for c in columns]) for i, r in now.items()}
    for i, (rank, c) in last.items():
        if i not in now or rank[0] > (-1 if version[i] is None else version[i]):
            want[i] = (rank[0], "change", *[c[k] for k in columns])
            if c["action"].strip().lower() == "delete":
                del want[i]
    rows = [r.asDict(recursive=True) for r in entry.queries()[name](spark, FOLDER).collect()]
    assert len(rows) == len(want) and {r["id"]: (r["version"], r["source"], *[r[c] for c in columns]) for r in rows} == want


def test_paths_have_the_pairs_of_p1_found(spark):
    paths = entry.queries()["p1_paths"](spark, FOLDER).collect()
    found = {tuple(r) for r in entry.queries()["p1_found"](spark, FOLDER).select("relation_id", "root_id", "depth").collect()}
    assert len(paths) == len(found) and {(r["relation_id"], r["root_id"], r["depth"]) for r in paths} == found
    assert all(len(r["relation_ids"]) == r["depth"] + 1 and r["relation_ids"][-1] == r["relation_id"] for r in paths)


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    n = {f"p{i}_" for i in (1, 2, 3, 5, 6, 7)}
    assert all(any(q.startswith(p) for q in entry.queries()) for p in n)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_the_rest_does_not_need_the_text_operators():
    import subprocess
    import sys

    code = "import sys; sys.modules['terrafold.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p1_found' in q and 'p8_ids' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(entry.__file__), check=True)


def test_stored_index_agrees_with_a_covering(spark):
    """The covering of the box over the stored index holds every current node in the box."""
    from terrafold.plans import reference as r

    exact, held = r.nodes_in_bbox(spark, FOLDER), r.cell_range_nodes(spark, FOLDER)
    assert held.count() >= exact.count() and exact.join(held, exact["id"] == held["node_id"], "left_anti").count() == 0


def test_refs_of_the_same_column_names_do_not_clash(spark):
    """Tables with further columns named like those the operators make."""
    from terrafold import tables as T
    from terrafold.operators import changefeed, history, orphans

    read = lambda t: T.read(spark, FOLDER, t).selectExpr("*", "1 as base", "2 as deleted", "3 as s", "4 as rn", "'x' as reason", "5 as alive", "6 as at")
    v = changefeed.named_state(read("changes"), read("locations"), read("ways"), read("relations"), bands=3)
    assert v.count() == entry.queries()["p3_found"](spark, FOLDER).count()
    assert history.history(read("snapshots")).count() == entry.queries()["p7_found"](spark, FOLDER).count()
    refs = orphans.references(T.current(read("ways"), "meta.version"), T.current(read("relations"), "meta.version"))
    assert refs.count() > 0
