"""The queries over all rows agree with brute force on a small fixture."""

from collections import Counter

import __spark_entry__ as entry

QUERIES = entry.registry.QUERIES


def test_reach_over_all_edges(spark, tmp_path):
    # 1 -> 2 -> 3 -> 4 -> 5 -> 6 by edges that a subset of rows would lose
    spark.createDataFrame([(k,) for k in range(1, 8)], "s_suppkey bigint").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(k, k, 50.0) for k in range(1, 6)] + [(7, 1, 50.0), (1, 1, 9.0)], "l_suppkey bigint, l_partkey bigint, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert {tuple(r) for r in QUERIES["bfs_reachable"](spark, str(tmp_path)).collect()} == {(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)}


def test_digests_of_all_batches(spark, tmp_path):
    items = [(i, [None, 1, 31, 64, 64, 64][i * 7 % 6], f"t{i}" if i % 5 else None, "article", [f"a{i % 3}", f"b{i % 11}"] if i % 4 else None) for i in range(1, 300)]
    spark.createDataFrame(items, "item_id bigint, batch_id int, title string, content_type string, tags array<string>").repartition(5).write.parquet(f"{tmp_path}/items.parquet")
    got = {r.batch_id: (r["items"], r.body) for r in QUERIES["digest_body"](spark, str(tmp_path)).collect()}
    topics = sorted((r for r in QUERIES["digest_topics"](spark, str(tmp_path)).collect()), key=lambda r: r.rank)
    assert set(got) == {None, 1, 31, 64}
    for batch in got:
        rows = [r for r in items if r[1] == batch]
        assert got[batch] == (len(rows), "\n".join(f"{k}. {r[2] or 'Untitled'} ({r[3]})" for k, r in enumerate(rows, 1)))
        n, first = Counter(t for r in rows for t in r[4] or []), {}
        for r in rows:
            for t in r[4] or []:
                first.setdefault(t, r[0])
        want = sorted(n, key=lambda t: (-n[t], first[t], t))[:5]
        assert [(r.topic, r["size"]) for r in topics if r.batch_id == batch] == [(t, n[t]) for t in want]
