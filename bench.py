"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR: tables (default /root/testdata/sf0.1); BENCH_CPUS: cores (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINES = (
    "dorfler_mark", "element_l2", "eos_unesco", "flux_hllc", "morton_encode", "locate_points", "nearest_point", "edge_adjacency", "assemble_normal", "condense", "jacobi_sweep",
    "bilinear", "box_filter", "depth_average", "omega_column", "reference_gradient", "descriptive_stats", "solver_pairs",
)


def main() -> None:
    from tidalframe.plans import registry
    from tidalframe.session import session

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    names = [n for n in HEADLINES if n in registry.QUERIES]
    registry.QUERIES[names[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start-up isn't timed
    took = {}
    for name in names:
        began = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total wall clock", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(sf_dir).name}))


if __name__ == "__main__":
    main()
