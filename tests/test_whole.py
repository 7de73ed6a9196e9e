"""Catalogue queries over the whole of their tables, against brute force on the small tables."""

from __future__ import annotations

import os
import re
from collections import Counter

import pyarrow.parquet as pq

from lodestrata import catalogue

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def column(table, *names):
    t = pq.read_table(f"{DATA}/{table}.parquet", columns=list(names))
    return list(zip(*(t.column(n).to_pylist() for n in names), strict=True))


def rows(spark, name, data=DATA):
    return [tuple(r) for r in catalogue.queries()[name](spark, data).collect()]


def test_graph_has_all_edges(spark):
    edges = {(u, e * 31 % 150) for u, e, k in column("events", "user_id", "event_id", "event_type") if k == "purchase"}
    nodes = {x for e in edges for x in e}
    assert set(rows(spark, "graph_degrees")) == {(n, sum(a == n for a, _ in edges), sum(b == n for _, b in edges)) for n in nodes}
    assert {x for (x,) in rows(spark, "graph_neighbors")} == {b for a, b in edges if a == 7}
    path, front = {7: (0, "7")}, {7: "7"}
    while front:
        step = sorted((f"{p}>{b}", b) for n, p in front.items() for a, b in edges if a == n and b not in path)
        front = {b: p for p, b in reversed(step)}
        path |= {b: (p.count(">"), p) for b, p in front.items()}
    assert sorted(rows(spark, "graph_shortest_path")) == sorted((n, d, p) for n, (d, p) in path.items())
    assert sorted(rows(spark, "graph_bfs")) == sorted((n, d) for n, (d, _) in path.items() if d <= 8)


def test_sets_have_all_members(spark):
    of = {k: {str(u) for u, e, v in column("events", "user_id", "event_type", "value") if e == k and v >= 100} for k in ("view", "purchase")}
    view, purchase = of["view"], of["purchase"]
    for name, want in (("union", view | purchase), ("intersection", view & purchase), ("difference", view - purchase), ("symmetric_difference", view ^ purchase)):
        assert sorted(m for (m,) in rows(spark, f"set_{name}")) == sorted(want)
    assert rows(spark, "set_relations") == [(len(purchase), len(view), len(purchase & view), purchase <= view, purchase >= view, not purchase & view)]


def test_index_searches_all_texts(spark):
    stop = set("a an and are as at be by for from has he in is it its of on or that the to was were will with".split())

    def words(x):
        return [w for w in re.findall(r"[a-z0-9']+", x.lower()) if len(w) >= 2 and w not in stop]

    docs = {i: set(words(x)) for i, x in column("documents", "doc_id", "text")}
    assert dict(rows(spark, "idx_token_counts")) == Counter(w for d in docs.values() for w in d)
    want = []
    for q, x in column("benchmark", "item_id", "text"):
        asked = words(x)
        scored = sorted((-sum(w in d for w in asked), min(k for k, w in enumerate(asked) if w in d), i) for i, d in docs.items() if not d.isdisjoint(asked))
        want += [(q, i, -s, place + 1) for place, (s, _, i) in enumerate(scored[:5])]
    assert sorted(rows(spark, "idx_search")) == sorted(want)


def test_batches_have_all_customers(spark):
    live = {k: (v, e) for k, v, e, _ in rows(spark, "kv_live")}
    customers = {f"user:{c:06d}": (c, n) for c, n in column("customer", "c_custkey", "c_name")}
    moved = {k: "moved:" + k[5:] for k in customers}
    batch = {k: v for k, (v, _) in live.items() if k not in customers} | {k: n for k, (c, n) in customers.items() if c % 3}
    assert sorted(rows(spark, "batch_apply")) == sorted(batch.items())
    renamed = {(moved[k], v, None) if k in moved else (k, v, e) for k, (v, e) in live.items()}
    assert set(rows(spark, "kv_rename")) == renamed
    assert set(rows(spark, "kv_copy")) == renamed | {(k, v, e) for k, (v, e) in live.items()}
    pairs = [(f"user:{c:06d}", f"user:{c + 1:06d}") for c in range(1, len(customers), 2)]
    swapped = {x: live[y][0] for a, b in pairs if a in live and b in live for x, y in ((a, b), (b, a))}
    assert swapped and sorted(rows(spark, "kv_swap")) == sorted(swapped.items())
    building = {f"user:{c:06d}" for c, m in column("customer", "c_custkey", "c_mktsegment") if m == "BUILDING"}
    assert set(rows(spark, "kv_delete_many")) == {(k, v, e) for k, (v, e) in live.items() if k not in building}


def test_bloom_filter_grows_with_its_items(spark, tmp_path):
    """3,000 members: none is lost, and few others answer maybe."""
    spark.sql("SELECT 'purchase' AS event_type, id AS user_id, current_timestamp() AS ts FROM range(3000)").write.parquet(f"{tmp_path}/events.parquet")
    spark.sql("SELECT id AS c_custkey FROM range(9000)").write.parquet(f"{tmp_path}/customer.parquet")
    maybe = {int(i[5:]): m for i, m in rows(spark, "bloom_probe", str(tmp_path))}
    assert len(maybe) == 9000 and all(maybe[i] for i in range(3000))
    assert sum(maybe[i] for i in range(3000, 9000)) < 0.03 * 6000
