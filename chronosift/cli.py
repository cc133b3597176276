"""Command line: python -m chronosift.cli COMMAND; --help lists them."""

from __future__ import annotations

import argparse
import json
from dataclasses import asdict

from pyspark.sql import SparkSession


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="chronosift")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, help_: str, *names: str, **options: str | None) -> None:
        one = sub.add_parser(name, help=help_)
        for n in names:
            one.add_argument(n)
        for n, default in options.items():
            one.add_argument(f"--{n.replace('_', '-')}", default=default)

    for name in ("features", "rules", "queries"):
        add(name, f"list the registered {name}")
    add("run", "run a registered query and write its result as Parquet", "query", "tables", "out")
    add("info", "rows, span and content hash of a bar store", "path")
    add("config", "check a configuration and show it with its hash", config=None)
    add("data-build", "bars of all sizes from cached candle files", "bid", "ask", "out", scale="1000")
    add("backtest", "one split", "bars", "out", "split", config=None)
    add("walkforward", "folds, and the holdout once", "bars", "out", config=None, ledger=None)
    add("train-final", "weights of all bars", "bars", "out", config=None, end=None)
    add("report", "the figures of a run", "out")
    add("explain", "one decision of a run", "out", "at")
    add("attribution", "a run's pnl by rule", "out")
    add("stress", "paths and shocks of a run", "out", paths="1000", horizon="252")
    add("sweep", "grid of the mean-reversion rule", "bars", "out", n="10,20,40", enter="1.5,2.0")
    add("tearsheet", "a page of a run", "out", "html")
    add("live-run", "process new bars of a folder once", "bars", "weights", "state", config=None)
    add("live-status", "state of a live loop", "weights", "state", config=None)
    add("live-reset-halt", "clear a halt", "weights", "state", "reason", config=None)
    return p


def _config(path: str | None):
    from chronosift.plans.runs import RunConfig, load_config

    if path is None:
        return RunConfig()
    with open(path, encoding="utf-8") as f:
        return load_config(f.read())


def _show(df) -> None:
    for r in df.limit(1000).collect():
        print(json.dumps(r.asDict(), default=str))


def _live(spark: SparkSession, args):
    from chronosift.streaming.live import Live

    rows = spark.read.parquet(args.weights).collect()
    return Live(args.state, _config(args.config), tuple((r["strategy"], r["weight"]) for r in rows), rows[0]["fdm"] if rows else 1.0)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    c = args.command
    if c in ("features", "rules", "queries"):
        from chronosift import catalogue
        from chronosift.plans.features import GROUPS
        from chronosift.plans.rules import RULES

        print("\n".join({"features": GROUPS, "rules": RULES, "queries": catalogue.queries() if c == "queries" else ()}[c]))
        return 0
    if c == "config":
        config = _config(args.config)
        print(json.dumps(asdict(config) | {"hash": config.hash()}, default=str))
        return 0
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    from chronosift.plans import runs
    from chronosift.sources import bars as B

    if c == "run":
        from chronosift import catalogue

        known = catalogue.queries()
        if args.query not in known:
            print(f"no query {args.query!r}")
            return 2
        known[args.query](spark, args.tables).write.mode("overwrite").parquet(args.out)
    elif c == "info":
        from pyspark.sql import functions as F

        bars = B.load_bars(spark, args.path)
        r = bars.agg(F.count(F.lit(1)).alias("rows"), F.min("time").alias("start"), F.max("time").alias("end")).head().asDict()
        print(json.dumps(r | {"content_hash": B.content_hash(bars)}, default=str))
    elif c == "data-build":
        from chronosift.sources.dataset import build

        print(json.dumps(build(spark, args.bid, args.ask, args.out, scale=float(args.scale)), default=str))
    elif c == "backtest":
        print(json.dumps(runs.run_single(B.load_bars(spark, args.bars), _config(args.config), args.split, args.out), default=str))
    elif c == "walkforward":
        config = _config(args.config)
        print(json.dumps(runs.run_walk_forward(B.load_bars(spark, args.bars), config, args.out), default=str))
        if args.ledger and config.holdout:
            last = spark.read.parquet(f"{args.out}/book").agg({"time": "max"}).head()[0]
            runs.record_look(spark, args.ledger, config, config.holdout, str(last), str(last))
    elif c == "train-final":
        runs.fit_book(B.load_bars(spark, args.bars), _config(args.config), args.end).write.mode("overwrite").parquet(args.out)
    elif c == "report":
        print(json.dumps(runs.summary(spark, args.out)))
        _show(spark.read.parquet(f"{args.out}/metrics"))
    elif c == "explain":
        _show(runs.explain(spark, args.out, args.at))
    elif c == "attribution":
        _show(runs.attribution(spark, args.out, by_year=True))
    elif c == "stress":
        for name, df in runs.stress_run(spark, args.out, paths=int(args.paths), horizon=int(args.horizon)).items():
            df.write.mode("overwrite").parquet(f"{args.out}/stress/{name}")
    elif c == "sweep":
        from chronosift.plans.evidence import zscore_point
        from chronosift.plans.research_runs import sweep_rows

        axes = {"n": [int(x) for x in args.n.split(",")], "enter": [float(x) for x in args.enter.split(",")]}
        sweep_rows(B.load_bars(spark, args.bars), lambda rows, base: zscore_point(rows, base, tuple(axes["n"])), axes, _config(None).costs).write.mode("overwrite").parquet(args.out)
    elif c == "tearsheet":
        with open(args.html, "w", encoding="utf-8") as f:
            f.write(runs.tearsheet(spark, args.out))
    else:
        from chronosift.streaming import live

        own = _live(spark, args)
        if c == "live-run":
            live.run(spark.readStream.schema(live.BARS).parquet(args.bars), own)
        elif c == "live-reset-halt":
            live.reset_halt(spark, own, args.reason)
        print(json.dumps(live.status(spark, own), default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
