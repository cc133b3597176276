"""Research runs as stored tables: folds with a holdout, out-of-sample forecasts, weights, book, metrics; and reports of them."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronosift.functions import ewm
from chronosift.operators import books, compare, drawdown, risk, splits
from chronosift.operators.execution import Costs, target_lots_pnl
from chronosift.operators.rolling import series
from chronosift.plans import combination
from chronosift.plans.rules import RULES
from chronosift.sources.bars import content_hash

#: Bars ahead that a rule's labels or holds reach at most; rules without an entry reach one.
HORIZONS = {"vol_squeeze": 36, "orb": 24}


@dataclass(frozen=True)
class RunConfig:
    rules: tuple[str, ...] = ("tsmom", "donchian", "zscore_fade")
    start: str | None = None
    end: str | None = None
    holdout: str | None = None
    train: int = 2000
    test: int = 500
    embargo: int = 1
    method: str = "sharpe_shrink"
    largest: float = 0.6
    lots: float = 1.0
    halflife: float = 50.0
    width: str = "1 hour"
    bars_per_year: float = 6048.0
    costs: Costs = field(default_factory=Costs)

    def checked(self) -> RunConfig:
        unknown = [r for r in self.rules if r not in RULES]
        if unknown or not self.rules:
            raise ValueError(f"unknown or no rules: {unknown}")
        if min(self.train, self.test) < 1:
            raise ValueError("train and test must be positive")
        return self

    def hash(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True, default=str).encode()).hexdigest()


def load_config(text: str) -> RunConfig:
    """A configuration from JSON; unknown keys are errors."""
    given = json.loads(text)
    given |= {"rules": tuple(given.get("rules", RunConfig.rules))} | ({"costs": Costs(**given["costs"])} if "costs" in given else {})
    return RunConfig(**given).checked()


def provenance(config: RunConfig, bars: DataFrame) -> dict[str, str]:
    """What a run came from: hashes of configuration and data, and versions."""
    import pyspark

    from chronosift import __version__

    return {"config_hash": config.hash(), "data_hash": content_hash(bars), "pyspark": pyspark.__version__, "engine": __version__}


def label_horizon(rules: tuple[str, ...]) -> int:
    return max((HORIZONS.get(r, 1) for r in rules), default=1)


def plan_folds(n: int, config: RunConfig, holdout_from: int | None = None) -> list[dict]:
    """Folds of the research bars, purged by the longest horizon; the holdout is one more fold, trained on all before."""
    purge, last = label_horizon(config.rules), n if holdout_from is None else holdout_from
    out = splits.walk_forward(last, config.train, config.test, purge=purge, embargo=config.embargo)
    if holdout_from is not None and holdout_from < n:
        out.append({"fold": -1, "train_from": max(0, holdout_from - purge - config.embargo - config.train), "train_to": holdout_from - purge - config.embargo, "test_from": holdout_from, "test_to": n})
    return out


def forecasts(bars: DataFrame, config: RunConfig) -> DataFrame:
    """bars with one column a rule, the volatility and the position in time."""
    rows = bars
    for r in config.rules:
        rows = RULES[r](rows)
    rows = ewm.with_kernels(rows, {"vol": lambda p: ewm.ewma_vol(p, config.halflife, 20)})
    return rows.withColumns({r: F.coalesce(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col(r))), F.lit(0.0)) for r in config.rules}).withColumn("pos", (F.row_number().over(series()) - 1).cast("long"))


def weights_table(rows: DataFrame, folds: list[dict], config: RunConfig) -> DataFrame:
    """(fold, strategy, weight, fdm): fitted on each fold's training bars; a run has few folds."""
    out = None
    for f in folds:
        train = rows.filter((F.col("pos") >= f["train_from"]) & (F.col("pos") < f["train_to"]))
        one = combination.fit(train, list(config.rules), config.costs, method=config.method, largest=config.largest).withColumn("fold", F.lit(f["fold"]))
        out = one if out is None else out.unionByName(one)
    return out.select("fold", "strategy", "weight", "fdm")


def _book(rows: DataFrame, weights: DataFrame, folds: list[dict], config: RunConfig) -> DataFrame:
    spark = rows.sparkSession
    member = splits.folds_frame(spark, folds).select("fold", "test_from", "test_to")
    own = rows.join(F.broadcast(member), (F.col("pos") >= F.col("test_from")) & (F.col("pos") < F.col("test_to"))).drop("test_from", "test_to")
    wide = weights.groupBy("fold").pivot("strategy", list(config.rules)).agg(F.first("weight")).select("fold", *[F.col(r).alias(f"w_{r}") for r in config.rules])
    fdm = weights.groupBy("fold").agg(F.first("fdm").alias("fdm"))
    joined = own.join(F.broadcast(wide), "fold").join(F.broadcast(fdm), "fold")
    total = sum((F.col(r) * F.coalesce(f"w_{r}", F.lit(0.0)) for r in config.rules), F.lit(0.0))
    combined = joined.withColumn("combined", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), total * F.col("fdm"))))
    return target_lots_pnl(combined.withColumn("lots", F.col("combined") * config.lots), "lots", config.costs)


def run_walk_forward(bars: DataFrame, config: RunConfig, out: str) -> dict:
    """Stores forecasts, weights, folds, book, trades and metrics under `out`; returns the summary.

    The holdout, if any, is scored once more by a fold of its own, and marked as fold -1.
    """
    config = config.checked()
    research = compare.research_window(bars, start=config.start, end=config.end)
    rows = forecasts(research, config)
    n = research.groupBy("series_id").count().agg(F.max("count")).head()[0] or 0
    before = None if config.holdout is None else compare.research_window(research, holdout=config.holdout).groupBy("series_id").count().agg(F.max("count")).head()[0] or 0
    folds = plan_folds(n, config, before)
    if not folds:
        raise ValueError(f"{n} bars are too few for a fold of {config.train} and {config.test}")
    rows.write.mode("overwrite").parquet(f"{out}/forecasts")
    spark = bars.sparkSession
    rows = spark.read.parquet(f"{out}/forecasts")
    splits.folds_frame(spark, folds).write.mode("overwrite").parquet(f"{out}/folds")
    weights_table(rows, folds, config).write.mode("overwrite").parquet(f"{out}/weights")
    _book(rows, spark.read.parquet(f"{out}/weights"), folds, config).write.mode("overwrite").parquet(f"{out}/book")
    book = spark.read.parquet(f"{out}/book")
    books.trades(book, config.costs.contract).write.mode("overwrite").parquet(f"{out}/trades")
    books.fills(book).write.mode("overwrite").parquet(f"{out}/fills")
    m = books.metrics(book, width=config.width, bars_per_year=config.bars_per_year, contract=config.costs.contract)
    m.write.mode("overwrite").parquet(f"{out}/metrics")
    summary = provenance(config, research) | {"bars": n, "folds": len(folds), "holdout": config.holdout, "config": json.dumps(asdict(config), default=str)}
    spark.createDataFrame([(json.dumps(summary),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/summary")
    return summary


def run_single(bars: DataFrame, config: RunConfig, split: str, out: str) -> dict:
    """One split: weights from the bars before it, the book on those from it on."""
    rows = compare.research_window(bars, start=config.start, end=config.end)
    before = rows.filter(F.col("time") < F.lit(split).cast("timestamp_ntz")).groupBy("series_id").count().agg(F.max("count")).head()[0] or 0
    n = rows.groupBy("series_id").count().agg(F.max("count")).head()[0] or 0
    gap = label_horizon(config.rules) + config.embargo
    if before <= gap or before >= n:
        raise ValueError("the split leaves no bars on one of its sides")
    one = RunConfig(**{**{k: getattr(config, k) for k in config.__dataclass_fields__}, "train": before - gap, "test": n - before, "holdout": None})
    return run_walk_forward(bars, one, out)


def fit_book(bars: DataFrame, config: RunConfig, end: str | None = None) -> DataFrame:
    """(strategy, weight, fdm) of all bars up to the end, for trading from there on."""
    rows = compare.research_window(bars, start=config.start, end=end or config.end)
    return combination.fit(forecasts(rows, config.checked()), list(config.rules), config.costs, method=config.method, largest=config.largest)


def load_run(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{out}/{name}") for name in ("forecasts", "folds", "weights", "book", "trades", "fills", "metrics")}


def summary(spark: SparkSession, out: str) -> dict:
    return json.loads(spark.read.text(f"{out}/summary").head()[0])


def bar_weights(spark: SparkSession, out: str) -> DataFrame:
    """(series_id, time, fold, strategy, weight, fdm) in force at each bar."""
    run = load_run(spark, out)
    return run["book"].select("series_id", "time", "fold").join(F.broadcast(run["weights"]), "fold").select("series_id", "time", "fold", "strategy", "weight", "fdm")


def contributions(spark: SparkSession, out: str) -> DataFrame:
    """(series_id, time, strategy, forecast, weight, contribution) of every out-of-sample bar."""
    run = load_run(spark, out)
    names = [r["strategy"] for r in run["weights"].select("strategy").distinct().collect()]
    long_ = run["book"].select("series_id", "time", "fold", F.explode(F.create_map(*[x for n in sorted(names) for x in (F.lit(n), F.col(n))])).alias("strategy", "forecast"))
    return long_.join(F.broadcast(run["weights"]), ["fold", "strategy"]).select("series_id", "time", "strategy", "forecast", "weight", (F.col("forecast") * F.col("weight") * F.col("fdm")).alias("contribution"))


def explain(spark: SparkSession, out: str, at: str) -> DataFrame:
    """(series_id, time, strategy, forecast, weight, contribution, share, combined) of the last bar by a time; the largest first."""
    from chronosift.functions.timeframes import at_or_before

    bar = at_or_before(load_run(spark, out)["book"].select("series_id", "time", "combined"), at)
    rows = contributions(spark, out).join(F.broadcast(bar), ["series_id", "time"])
    whole = Window.partitionBy("series_id")
    return rows.withColumn("share", F.try_divide(F.abs("contribution"), F.sum(F.abs("contribution")).over(whole))).orderBy(F.desc(F.abs("contribution")), "strategy")


def attribution(spark: SparkSession, out: str, by_year: bool = False) -> DataFrame:
    return books.pnl_attribution(load_run(spark, out)["book"], contributions(spark, out).select("series_id", "time", "strategy", "contribution"), by_year=by_year)


def stress_run(spark: SparkSession, out: str, *, paths: int = 1000, horizon: int = 252, mean_block: float = 10.0, seed: int = 0, width: str = "1 hour", start_equity: float = 100_000.0) -> dict[str, DataFrame]:
    """Tables of bootstrapped paths of the book's daily returns: figures, exceedance, ruin, fan and worst moves."""
    days = books.daily_returns(load_run(spark, out)["book"], width).filter("ret IS NOT NULL").select("date", "ret")
    walks = risk.simulate_paths(days, paths, horizon, mean_block, seed)
    figures = risk.path_figures(walks)
    return {
        "figures": figures, "distribution": risk.distribution(figures, ["final", "cagr", "max_drawdown", "underwater"], [0.05, 0.5, 0.95]), "exceedance": risk.drawdown_exceedance(figures, [0.05, 0.1, 0.2, 0.3]),
        "ruin": risk.risk_of_ruin(walks, [0.5, 0.8]), "fan": risk.fan_bands(walks, [0.05, 0.25, 0.5, 0.75, 0.95]), "recovery": risk.recovery(figures), "moves": risk.worst_moves(days, [1, 5, 20], 1.0, 1.0, start_equity),
    }


def record_look(spark: SparkSession, ledger: str, config: RunConfig, start: str, end: str, at: str) -> None:
    """Appends one look at a holdout to a ledger of JSON lines."""
    row = [(start, end, config.hash(), at)]
    spark.createDataFrame(row, "start string, end string, config_hash string, at string").coalesce(1).write.mode("append").json(ledger)


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """(start, end, config_hash, at); lines that can't be read are left out."""
    rows = spark.read.schema("start timestamp_ntz, end timestamp_ntz, config_hash string, at string").json(ledger)
    return rows.filter("start IS NOT NULL AND end IS NOT NULL")


def tearsheet(spark: SparkSession, out: str, title: str = "Run", width: str = "1 hour") -> str:
    """A page of the run's short tables: metrics, months, trades and weights."""
    run = load_run(spark, out)
    months = drawdown.monthly_rollup(books.daily_returns(run["book"], width).filter("ret IS NOT NULL"))
    parts = {"Metrics": run["metrics"].limit(50), "Trades": books.trade_table(run["trades"]).limit(200), "Weights": run["weights"].orderBy("fold", "strategy").limit(500), "Months": months.limit(600)}
    body = []
    for name, df in parts.items():
        rows = df.collect()
        head = "".join(f"<th>{c}</th>" for c in df.columns)
        cells = "".join("<tr>" + "".join(f"<td>{_shown(v)}</td>" for v in r) + "</tr>" for r in rows)
        body.append(f"<h2>{name}</h2><table><tr>{head}</tr>{cells}</table>")
    style = "body{font-family:sans-serif}td,th{padding:2px 8px;text-align:right}"
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{title}</title><style>{style}</style></head><body><h1>{title}</h1>{''.join(body)}</body></html>"


def _shown(v) -> str:
    return f"{v:.6g}" if isinstance(v, float) else str(v).replace("<", "&lt;")
