"""Command line: ``python -m erspark.cli compare|match|tune FILE.json``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from erspark.operators import lsh
from erspark.plans import curves, sweep, tuning
from erspark.plans.matching import match
from erspark.plans.params import FULL, LshParams
from erspark.plans.shipping import importable
from erspark.sources.products import from_json


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("command", choices=["compare", "match", "tune"])
    parser.add_argument("file")
    parser.add_argument("--out", default="results")
    parser.add_argument("--trials", type=int, default=20)
    parser.add_argument("--bootstraps", type=int, default=5)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("erspark").getOrCreate()
    importable(spark)
    products = from_json(spark, args.file)
    if args.command == "match":
        _, found = match(products, FULL[0], LshParams(50, 4), FULL[1])
        found.write.mode("overwrite").parquet(args.out)
    elif args.command == "tune":
        objective = tuning.MatchingObjective(products, bootstraps=args.bootstraps)
        tuning.optimise(spark, objective, args.out, args.trials, len(lsh.tuning_lsh_params())).show(10, truncate=False)
    else:
        tables = {}
        for name, full in (("full", True), ("restricted", False)):
            tables[name] = sweep.run_grid(products, sweep.grid(full, bootstraps=args.bootstraps)).persist()
            tables[name].show(1000, truncate=False)
            curves.save_curve(curves.performance_curve(tables[name]), f"{args.out}_{name}.png")
        curve = curves.combined_curve(tables["full"], tables["restricted"])
        curves.save_curve(curve, f"{args.out}_combined.png")
        curve.write.mode("overwrite").parquet(args.out)


if __name__ == "__main__":
    main()
