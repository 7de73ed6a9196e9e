"""Headline queries, timed: one JSON line.  $BENCH_SF_DIR and $BENCH_CPUS choose data and threads."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lodestrata import catalogue  # noqa: E402
from lodestrata.inputs import AS_OF, kv_log  # noqa: E402
from lodestrata.plans import log, view  # noqa: E402
from lodestrata.plans.scratch import Tables  # noqa: E402
from lodestrata.session import build  # noqa: E402

HEADLINE = "kv_live kv_scan_range kv_mget kv_floor_ceiling kv_getset kv_cas_fold kv_append txn_validate rate_limit ts_downsample lb_top set_relations bitmap_count mm_as_dict trie_search pq_drain graph_degrees idx_search hll_estimate latency_percentile".split()


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = build(f"local[{cpus}]", "bench", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    made = catalogue.queries()
    took = {}
    path = f"{Tables(spark, 'bench').path}/view"

    def warm(spark, sf_dir):  # noqa: ANN001, ANN202
        return view.read(spark, path, AS_OF).where("key >= 'user:000010' AND key < 'user:010010'").orderBy("key")

    def build_view(spark, sf_dir):  # noqa: ANN001, ANN202
        view.write(log.latest(kv_log(spark, sf_dir)), path)
        return spark.range(1)

    made |= {"view_build": build_view, "view_scan": warm, "view_get": lambda spark, sf_dir: view.read(spark, path, AS_OF).where("key = 'user:000016'")}
    for name in [*HEADLINE, "view_build", "view_scan", "view_get"]:
        best = None
        for _ in range(2):  # the first run compiles
            began = time.perf_counter()
            made[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best or 1e9, time.perf_counter() - began)
        took[name] = round(best, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
