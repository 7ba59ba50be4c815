"""Command line over stored bars: python -m tidemill.cli run|scan|grid|check --bars PATH ..."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemill.functions import rules as R
from tidemill.operators import bracket, quality
from tidemill.operators import ledger as L
from tidemill.plans import experiments as X
from tidemill.plans import specs as S
from tidemill.sources import store


def value(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return text


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemill")
    p.add_argument("command", choices=["run", "scan", "grid", "check"])
    p.add_argument("--bars", required=True, help="a table of bars, partitioned by symbol")
    p.add_argument("--spec", default='{"type": "ma_crossover"}', help="a rule as JSON")
    p.add_argument("--set", nargs="*", default=[], metavar="PATH=VALUE")
    p.add_argument("--grid", nargs="*", default=[], metavar="PATH=V1,V2")
    p.add_argument("--rate", type=float, default=0.0008)
    p.add_argument("--start")
    p.add_argument("--end")
    return p


def main(argv=None, spark: SparkSession | None = None):
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    bars = store.read_bars(spark, a.bars, a.start, a.end)
    if bars is None:
        raise SystemExit(f"no bars at {a.bars}")
    if a.command == "check":
        return quality.check_bars(bars)
    bars = bars if "funding_rate" in bars.columns else bars.withColumn("funding_rate", F.lit(0.0))
    spec = json.loads(a.spec)
    for item in a.set:
        path, text = item.split("=", 1)
        spec = S.set_path(spec, path, value(text))
    if a.command == "run":
        if R.RULES[spec["type"]].bracket:
            p = R.from_spec(spec)
            s = bracket.Settings(max_bars=p.get("max_bars", 0), cooldown_win=p["cooldown_win"], cooldown_loss=p["cooldown_loss"], kill_drawdown=p["kill_drawdown"])
            signals = R.with_signals(bars, spec)
            return L.summarize(bracket.simulate(signals, s), bracket.bracket_trades(signals, s))
        book = L.ledger(R.with_target(bars, spec), a.rate)
        return L.summarize(book, L.trades(book, a.rate))
    if a.command == "scan":
        names = [n for n, r in R.RULES.items() if not r.children and not r.bracket]
        specs = {k: {"type": n} for k, n in enumerate(names)}
        label = F.element_at(F.array(*map(F.lit, names)), F.col("config_id") + 1)
    else:
        made = S.grid_specs(spec, {p: [value(v) for v in vs.split(",")] for p, vs in (g.split("=", 1) for g in a.grid)})
        specs = {k: s for k, (_, s) in enumerate(made)}
        label = F.element_at(F.array(*(F.lit(json.dumps(p)) for p, _ in made)), F.col("config_id") + 1)
    return X.board(X.run_grid(bars, specs, a.rate), a.rate).withColumn("label", label).orderBy(F.desc("median_sharpe"))


if __name__ == "__main__":
    main().show(100, truncate=False)
