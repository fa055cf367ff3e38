"""python -m unskew.cli: list models and datasets, run a benchmark grid, rank result tables, build imbalanced sets."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .lineage import checkpointed
from .operators import report
from .operators.learners import LEARNERS
from .plans import benchmark
from .session import ship
from .sources import baselines, config, tabular, xlsx

METRICS = {"F1_mean": "F1", "GMean_mean": "GMean", "AUC_mean": "AUC", "AUPRC_mean": "AUPRC", "Runtime_mean": "Runtime"}


def _names(text: str | None):
    """Not given: all; empty: none; else those named."""
    return None if text is None else [x for x in text.split(",") if x]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="unskew")
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("list-models")
    for name in ("list-datasets", "run"):
        p = sub.add_parser(name)
        p.add_argument("--root", required=True)
        p.add_argument("--config")
        p.add_argument("--datasets", type=_names)
        p.add_argument("--sources", type=_names)
        p.add_argument("--irs", type=lambda t: [int(x) for x in _names(t)])
    p.add_argument("--models", type=_names)
    p.add_argument("--keel-folds", choices=("5fold", "complete"))
    p.add_argument("--n-folds", type=int)
    p.add_argument("--full", action="store_true")
    p.add_argument("--out")
    p = sub.add_parser("rank")
    p.add_argument("--source", required=True, nargs="+")
    p.add_argument("--out", help="a folder for CSV, or a file name that ends in .xlsx")
    p.add_argument("--baselines", action="store_true", help="show the means beside published ones")
    p.add_argument("--rename", type=lambda t: dict(x.split("=", 1) for x in _names(t)), default={}, help="old=new,...: models to rename")
    p = sub.add_parser("build-ir")
    p.add_argument("--csv", required=True)
    p.add_argument("--irs", type=lambda t: [int(x) for x in _names(t)], default=[5, 10, 20, 30])
    p.add_argument("--out", required=True)
    return top


def run(spark: SparkSession, args: argparse.Namespace):
    """Runs all cells without a result yet and writes the merged table; returns it."""
    given = {k: v for k, v in (("models", args.models), ("datasets", args.datasets), ("sources", args.sources), ("irs", args.irs), ("keel_folds", args.keel_folds), ("n_folds", args.n_folds), ("out", args.out)) if v is not None}
    c = config.load(args.config, smoke=not args.full, **given)
    found = tabular.discover(args.root, c.datasets, c.irs, c.sources)
    found = [d for d in found if d.source not in ("keel", "keel_complete") or d.source == ("keel" if c.keel_folds == "5fold" else "keel_complete")]
    if not found:
        raise FileNotFoundError(f"no dataset under {args.root}")
    models = [m for m in LEARNERS if c.models is None or m in c.models]
    try:
        done = tabular.read_results(spark, c.out)
    except Exception as e:  # the first run has no table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = None
    catalog = tabular.catalog(spark, found)
    todo = benchmark.grid(catalog, models)
    todo = todo if done is None else report.open_cells(todo, done)
    # the names of datasets with open cells; each has its files
    names = {r["Dataset"] for r in todo.select("Dataset").distinct().collect()}
    folds = None
    for d in (d for d in found if d.name in names):
        one = tabular.load_folds(spark, d, c.n_folds, c.base_seed)
        folds = one if folds is None else folds.unionByName(one)
    if folds is not None:
        folds = checkpointed(folds if args.full else folds.where("fold = 1"))
        classes = folds.groupBy("dataset").agg((F.max("label_idx") + 1).alias("classes"))
        for r in classes.groupBy("classes").agg(F.collect_list("dataset").alias("datasets")).orderBy("classes").collect():
            # all datasets of so many classes are one job of cells, and are saved when it is done
            pred = benchmark.predictions(folds.where(F.col("dataset").isin(r["datasets"])), models, c.base_seed, c.smoke, c.model_params, cells=todo)
            new = benchmark.results(pred, catalog.select(F.col("name").alias("Dataset"), F.col("source").alias("Source"))).withColumn("run", F.lit(1))
            table = new if done is None else done.withColumn("run", F.lit(0)).unionByName(new, allowMissingColumns=True)
            tabular.write_results(checkpointed(report.last_results(table, "run").drop("run")), c.out)
            done = tabular.read_results(spark, c.out)
    return done


def read_ranked(spark: SparkSession, sources: list[str], names: dict[str, str] | None = None):
    """All result tables as one, metrics and models under the report's names."""
    rows = tabular.read_results(spark, sources[0])
    for s in sources[1:]:
        rows = rows.unionByName(tabular.read_results(spark, s), allowMissingColumns=True)
    rows = rows.withColumnsRenamed(METRICS)
    missing = [m for m in report.METRICS if m not in rows.columns]
    if missing:
        raise ValueError(f"result columns are missing: {', '.join(missing)}")
    return report.normalise_models(rows, names or {})


def rank(spark: SparkSession, sources: list[str], names: dict[str, str] | None = None):
    """The ranking of complete models by group, with the others at the end by name alone."""
    rows = report.with_group(read_ranked(spark, sources, names))
    return report.ordered(report.with_excluded(report.rankings(rows), rows))


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    if args.command == "list-models":
        print("\n".join(sorted(LEARNERS)))
        return
    if args.command == "list-datasets":
        for d in tabular.discover(args.root, args.datasets, args.irs, args.sources):
            print(d.source, d.name)
        return
    spark = ship(SparkSession.builder.appName("unskew").getOrCreate())
    if args.command == "run":
        run(spark, args).select("Model", "Dataset", "F1_mean", "GMean_mean", "AUC_mean", "AUPRC_mean", "Error").orderBy("Dataset", "Model").show(1000, False)
    elif args.command == "rank":
        ranked = rank(spark, args.source, args.rename)
        ranked.show(200, False)
        if args.baselines:
            means = ranked.where("Group = 'Overall'").select("Model", "F1", "GMean", "AUC", "AUPRC")
            report.with_baselines(means, baselines.baselines(spark)).orderBy(F.desc("GMean")).show(200, False)
        if args.out and args.out.endswith(".xlsx"):
            ranks = ["Group", "Model", *[c for c in ranked.columns if "ank" in c]]
            xlsx.write(args.out, {"Mean Values": ranked.select("Group", "Model", "n_datasets", *report.METRICS), "Mean Ranking": ranked.select(*ranks), "Notes": report.notes(read_ranked(spark, args.source, args.rename)).orderBy("Item")})
        elif args.out:
            ranked.write.mode("overwrite").option("header", True).csv(args.out)
    else:
        rows = tabular.numbered(tabular.read_csv(spark, args.csv))
        tabular.write_imbalanced(rows, args.irs, args.out).orderBy("ir", "label").show()


if __name__ == "__main__":
    main()
