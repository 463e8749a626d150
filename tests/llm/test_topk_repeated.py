"""op5 on a table with repeated vec_ids: every row is searched, and the SQL agrees."""
from collections import Counter

import duckdb
import numpy as np
import pytest

from volforge.llm import exact_topk


@pytest.mark.parametrize("sizes", [None, (40, 3)])
def test_repeated_ids_are_all_searched(spark, monkeypatch, sizes):
    rng = np.random.default_rng(5)
    ids = [*range(0, 1200, 6), *[3] * 14, *[100, 200, 200], *[900] * 3]
    rows = [(i, [round(float(x), 4) for x in rng.normal(size=6)]) for i in ids]
    rows += [(3, [9.0] * 6)] * 3 + [(7, [1.0] * 5), (7, [2.0] * 5), (400, [1.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(exact_topk, "table", lambda *_: df)
    found = (exact_topk.op5_exact_topk(spark, "") if sizes is None else
             exact_topk.top_k(df, lambda i: i % 100 == 0, shard_rows=sizes[0], query_rows=sizes[1], every_row=True))
    got = Counter(map(tuple, found.select("query_id", "rank", "vec_id", "score").collect()))
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    want = Counter(con.execute(exact_topk.ORACLE["op5_exact_topk"]).fetchall())
    assert got == want
    assert any(n > 1 for n in Counter((q, v, s) for q, _, v, s in got).values())
