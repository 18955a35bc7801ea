"""Time the headline queries: one JSON line with seconds per query.

`$BENCH_SF_DIR` names the tables, `$BENCH_CPUS` the local cores. `python bench.py key ...` runs a
selection.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from siftmill import catalog  # noqa: E402
from siftmill.session import get_spark  # noqa: E402

HEADLINE = (
    "s02_csv_tree s07_batches t03_chunks t05_chunk_rows t06_parse_vector t10_truncate "
    "c01_turn_pairs c05_chat_chunks d02_sample_n d03_shuffle d06_take_until d07_author_cap "
    "d08_cap_quota d11_author_split d13_cap_then_quota v03_knn_exact v04_knn_cells "
    "v05_self_density v08_soft_labels v09_idw_risk m02_probe_fit m03_probe_score m07_student "
    "i06_sentinels e02_weighted_prf e06_threshold_sweep x01_stream_chunks x03_usage_windows "
    "x05_stream_cap z01_compile_train z02_risk_posts z03_control_posts z04_chats z05_emotions "
    "z06_enrich z07_silver"
).split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    catalog.load_all()
    spark = get_spark(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory="12g", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for key in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[key](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[key] = round(time.perf_counter() - start, 3)
        print(key, seconds[key], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
