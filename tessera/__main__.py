"""Command line: ``python -m tessera campaign|curve|timing|stats ...`` over a Parquet table of
(dataset, row_id, label, x) or, for stats, a folder of result shards."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from tessera.plans import battery
from tessera.plans import campaign as K
from tessera.plans.session import session
from tessera.sources.results import read_shards, write_results


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tessera", description=__doc__)
    p.add_argument("command", choices=["campaign", "curve", "timing", "stats"])
    p.add_argument("source")
    p.add_argument("target")
    p.add_argument("--folds", type=int, default=None)
    p.add_argument("--only-folds", type=int, nargs="*")
    p.add_argument("--methods", nargs="*", default=list(K.METHODS))
    p.add_argument("--fractions", type=float, nargs="*", default=[0.02, 0.05, 0.1])
    p.add_argument("--scaling", choices=K.SCALINGS, default="minmax")
    a = p.parse_args(argv)
    spark = session()
    if a.command == "stats":
        rows = read_shards(spark, a.source)
        for name, tables in battery.run_all(rows).items():
            for part, df in (tables if isinstance(tables, dict) else {"table": tables}).items():
                df.write.mode("overwrite").option("header", True).csv(f"{a.target}/{name}/{part}")
        return
    k = a.folds or (5 if a.command == "timing" else 10)
    d = spark.read.parquet(a.source)
    d = d if "fold" in d.columns else K.with_folds(d.withColumn("label", F.col("label").cast("int")), k)
    rows = K.run_campaign(d, k, a.methods, a.scaling, a.only_folds, a.fractions if a.command == "curve" else None)
    if a.command == "timing":
        rows = battery.timing_means(rows)
    write_results(rows, a.target, "parquet")
    if a.command == "curve":  # read back, so that nothing is built again
        done = spark.read.parquet(a.target)
        means = K.curve_means(done).join(K.anchor_fractions(done), "dataset", "left")
        means.write.mode("overwrite").option("header", True).csv(f"{a.target}-mean")


if __name__ == "__main__":
    main()
