"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

#: Timed runs of each query after one that isn't timed; the figure is their median.
RUNS = 3
HEADLINE = ["spgemm_aat_sp", "spgemm_ata_op", "spgemm_structure_op", "split_accumulate_sp", "nnz_cub_ab", "compression", "semiring_minplus", "numeric_tiles_c", "median_prices", "tile_totals", "tile_decode", "cand_tiles", "tile_work", "seed_order", "axis_profile_rows", "window_tiles_fanout", "heatmap_16"]
#: Fixed inputs of the products: pairs of entries that meet, from counts.
PRODUCTS = {"spgemm_aat_sp": "supplier_part", "spgemm_ata_op": "order_part"}


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus) if cpus.isdigit() else 16))
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from quillmat.operators.product import product_count
    from quillmat.plans import catalogue, data

    spent, rate = {name: [] for name in HEADLINE}, {}
    for name in HEADLINE:
        for _ in range(1 + RUNS):
            started = time.monotonic()
            catalogue.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            spent[name].append(time.monotonic() - started)
    took = {name: round(median(times[1:]), 3) for name, times in spent.items()}
    for name, source in PRODUCTS.items():
        a = getattr(data, source)(spark, folder)
        a = a.transpose() if name == "spgemm_ata_op" else a
        rate[name] = round(product_count(a, a.transpose()).first()[0] / took[name])
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "runs": RUNS, "products_per_second": rate, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
