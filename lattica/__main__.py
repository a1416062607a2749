"""Commands: python -m lattica COMMAND GRAPH ... ; GRAPH is a file in the text format.

mine GRAPH SUPPORT [STRATEGY [WEIGHT]]      patterns as text, and the run's counters
compare | bench | ablation | pruning GRAPH SUPPORT WEIGHT
reduction | sweep GRAPH SUPPORT
describe GRAPH
scenarios FOLDER FILE                       FILE: CSV of dataset,min_sup,least with a header

bench and scenarios take their strategies from LATTICA_ALGOS (comma-separated), and print lines "CSV,..." if
LATTICA_CSV is set.
"""

from __future__ import annotations

import argparse
import csv
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.scalars import constant_label, nearest_label
from lattica.plans import compare
from lattica.plans.mine import Options, metrics_row, mine, pattern_rows
from lattica.sources.lg import read_lg


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lattica", description="Frequent patterns of one weighted graph")
    top.add_argument("command", choices=["mine", "compare", "bench", "ablation", "pruning", "reduction", "sweep", "describe", "scenarios"])
    top.add_argument("path")
    top.add_argument("rest", nargs="*", help="support, then a strategy and a weight (mine) or a weight; for scenarios the cells' file")
    top.add_argument("--limit", type=float, help="seconds after which a run is ended")
    top.add_argument("--max-edges", type=int)
    top.add_argument("--warmup", type=int, default=1)
    top.add_argument("--measured", type=int, default=5)
    top.add_argument("--edge-labels", action="store_true", help="the third value of an edge line is also its label")
    return top


def show(rows: DataFrame) -> None:
    # results of commands have a few rows each
    rows.show(1000, truncate=False)


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("lattica").getOrCreate()
    options = Options(max_edges=a.max_edges, limit_s=a.limit)
    names = [n for n in os.environ.get("LATTICA_ALGOS", ",".join(compare.STRATEGIES)).split(",") if n]
    if a.command == "describe":
        for name, rows in compare.describe(spark, a.path).items():
            print(f"-- {name}")
            show(rows)
        return
    if a.command == "scenarios":
        with open(a.rest[0]) as f:
            cells = [compare.Scenario(r["dataset"], int(r["min_sup"]), float(r["least"])) for r in csv.DictReader(f)]
        rows = compare.scenarios(spark, a.path, cells, names, options, a.warmup, a.measured)
        finish(rows)
        return
    support = int(a.rest[0])
    g = read_lg(spark, a.path, edge_label=nearest_label if a.edge_labels else constant_label).graph.cached()
    if a.command == "mine":
        name, least = (a.rest[1] if len(a.rest) > 1 else "none"), float(a.rest[2]) if len(a.rest) > 2 else 0.0
        found = mine(g, support, compare.strategy(name, least, cut=True), options)
        for r in pattern_rows(spark, found).orderBy("no").collect():
            print(f"# {r['no']} support {r['support']}\n{r['text']}")
        show(metrics_row(spark, name, os.path.basename(a.path), support, least, found))
        show(compare.largest_edges(found.to_df(spark)).withColumn("timed_out", F.lit(found.timed_out)).withColumn("peak_mem_mb", F.lit(compare.peak_memory_mb(spark))))
    elif a.command in ("reduction", "sweep"):
        show({"reduction": compare.reduction_compare, "sweep": compare.sweep}[a.command](g, support, options=options))
    elif a.command == "bench":
        dataset = os.path.basename(a.path).removesuffix(".lg")
        finish(compare.bench(g, dataset, support, float(a.rest[1]), names, options, a.warmup, a.measured))
    else:
        run = {"compare": compare.compare, "ablation": compare.ablation, "pruning": compare.pruning_compare}
        show(run[a.command](g, support, float(a.rest[1]), options=options))
    g.released()


def finish(rows: DataFrame) -> None:
    show(rows)
    if os.environ.get("LATTICA_CSV"):
        print(*compare.csv_lines(rows), sep="\n")


if __name__ == "__main__":
    main()
