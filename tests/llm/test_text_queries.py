import os
from collections import defaultdict

import pytest
from compare import spark_rows, sql_rows
from conftest import DATA

from terrafold.llm import queries, tokens

FOLDER = f"{DATA}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    assert spark_rows(queries.QUERIES[name](spark, FOLDER)) == sql_rows(FOLDER, queries.SQL[name])


def test_ids_of_all_documents(spark):
    enc = tokens.encoder(tokens.rank_file())
    got = {r["doc_id"]: r["ids"] for r in queries.p8_ids(spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    assert got == {r["doc_id"]: enc.encode_ordinary(r["text"] or "") for r in docs}
    assert all(r["same"] for r in queries.p8_round_trip(spark, FOLDER).collect())


def test_all_documents_are_packed(spark):
    size = {r["doc_id"]: len(r["ids"]) for r in queries.p8_ids(spark, FOLDER).collect()}
    caps = {r["pack_id"]: r["capacity"] for r in spark.read.parquet(f"{FOLDER}/pack_sizes.parquet").collect()}
    used, docs, pieces = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in queries.p9_pack(spark, FOLDER).collect():
        used[r["pack_id"], r["container_id"]] += r["n_tokens"]
        docs[r["pack_id"], r["doc_id"]] += r["n_tokens"]
        pieces[r["pack_id"], r["doc_id"]] += 1
    assert docs == {(p, i): n for p in caps for i, n in size.items()}
    assert all(n <= caps[p] for (p, _), n in used.items())
    assert all(k == max(1, -(-size[i] // caps[p])) for (p, i), k in pieces.items())


def test_sketch_bounds_hold(spark):
    rows = queries.p4_top(spark, FOLDER).collect()
    assert len(rows) == queries.TOP_K and all(r["bounds_hold"] for r in rows)
