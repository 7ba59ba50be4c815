"""Bars and decisions from a stream of ticks.

Ticks become bars under a watermark, so a bar appears once it can no longer change (the forming
bar is never seen). The decider keeps one small state per symbol: exponential averages advance
by one step per bar instead of being recomputed from history, and give the batch rule's targets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemill.functions import rules as R
from tidemill.operators import bracket
from tidemill.sources import store

STATE = "n long, fast double, slow double, last timestamp_ntz"
OUT = "symbol string, ts timestamp_ntz, target double, late boolean"


def stream_bars(ticks: DataFrame, step: str = "4 hours", late: str = "10 minutes") -> DataFrame:
    """ticks: symbol, ts, event_id, price. Rows later than the watermark are dropped."""
    order = F.struct("ts", "event_id")
    return ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy("symbol", F.window("ts", step)).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count("*").cast("double").alias("volume")
    ).select("symbol", F.col("window.start").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume")


class CrossoverDecider(StatefulProcessor):
    """Exponential crossover per symbol; a bar at or before the last one is marked late and ignored."""

    def __init__(self, fast: int, slow: int, stake: float = 1.0):
        self.fast, self.slow, self.stake = fast, slow, stake

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("averages", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        bars = pd.concat(list(rows)).sort_values("ts", kind="stable")
        n, fast, slow, last = self.state.get() if self.state.exists() else (0, 0.0, 0.0, None)
        out = []
        for ts, close in zip(bars.ts, bars.close):
            if last is not None and ts <= pd.Timestamp(last):
                out.append((key[0], ts, None, True))
                continue
            a, b = 2 / (self.fast + 1), 2 / (self.slow + 1)
            fast, slow = (close, close) if n == 0 else (fast + a * (close - fast), slow + b * (close - slow))
            n, last = n + 1, ts.to_pydatetime()
            side = 0.0 if n < self.slow else float(fast > slow) - float(fast < slow)
            out.append((key[0], ts, side * self.stake, False))
        self.state.update((n, fast, slow, last))
        yield pd.DataFrame(out, columns=["symbol", "ts", "target", "late"])

    def close(self) -> None:
        pass


def decide(bars: DataFrame, fast: int = 5, slow: int = 20, stake: float = 1.0) -> DataFrame:
    """A target per bar of a stream of (symbol, ts, close); needs the RocksDB state store."""
    return bars.select("symbol", "ts", "close").groupBy("symbol").transformWithStateInPandas(CrossoverDecider(fast, slow, stake), OUT, "append", "none")


@dataclass
class Bracket:
    """What a bracket rule wants after each closed bar of one symbol. Signals and equity come in, fills are reported back."""

    settings: bracket.Settings
    bar: int = -1
    entered_at: int | None = None
    last_exit: int | None = None
    wait: int = 0
    peak: float = 0.0
    killed: bool = False

    def decide(self, long: bool, short: bool, stop: float, target: float, equity: float | None = None) -> tuple | None:
        """After one more bar: ("enter", side, stop, target), ("close", "time" or "kill") or nothing."""
        self.bar += 1
        s, held = self.settings, self.entered_at is not None
        if equity is not None:
            self.peak = max(self.peak, equity)
            if not self.killed and equity <= (1 - s.kill_drawdown) * self.peak:
                self.killed = True
                return ("close", "kill") if held else None
        if self.killed:
            return None
        if held:
            return ("close", "time") if s.max_bars and self.bar - self.entered_at + 1 >= s.max_bars else None
        cooling = self.last_exit is not None and self.bar - self.last_exit < self.wait
        if cooling or not (stop > 0 and target > 0) or not (long or short):
            return None
        return "enter", 1 if long else -1, stop, target

    def entered(self) -> None:
        """The entry has filled at the open of the bar after the signal."""
        self.entered_at = self.bar + 1

    def exited(self, profit: float, at_close: bool = False) -> None:
        """The trade has ended: within the bar that is forming, or at the last close."""
        self.entered_at, self.last_exit = None, self.bar if at_close else self.bar + 1
        self.wait = self.settings.cooldown_win if profit > 0 else self.settings.cooldown_loss


def decide_rule(bars: DataFrame, spec: dict, root: str, stake: float = 1.0, history: int = 5000):
    """Decisions of any rule over a stream of closed bars: each micro-batch is added to the bars stored under root, and
    the rule's plan runs over the last `history` bars of its symbols. Returns the stream's writer; decisions lie under
    root/decisions: a target, or a bracket's signals, of every new bar. A bar at or before a stored one is left out, so a
    batch that is run again changes nothing."""
    is_bracket = R.RULES[R.from_spec(spec)["type"]].bracket

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        columns = [c for c in batch.columns]
        path = f"{root}/bars"
        old = [f"{path}/batch={k}" for k in range(number) if store.exists(spark, f"{path}/batch={k}")]
        stored = spark.read.parquet(*old).select(*columns) if old else None
        new = batch.dropDuplicates(["symbol", "ts"]) if stored is None else store.append_after(stored, batch.dropDuplicates(["symbol", "ts"]))
        new.select(*columns).write.mode("overwrite").parquet(f"{path}/batch={number}")
        new = spark.read.parquet(f"{path}/batch={number}")
        rows = new.select(*columns) if stored is None else stored.join(F.broadcast(new.select("symbol").distinct()), "symbol", "left_semi").select(*columns).unionByName(new.select(*columns))
        last = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))
        rows = rows.withColumn("_k", last).filter(F.col("_k") <= history).drop("_k")
        said = R.with_signals(rows, spec).select("symbol", "ts", "long", "short", "stop_dist", "target_dist") if is_bracket else R.with_target(rows, spec).select("symbol", "ts", (F.coalesce("target", F.lit(0.0)) * stake).alias("target"))
        said.join(new.select("symbol", "ts"), ["symbol", "ts"], "left_semi").write.mode("overwrite").parquet(f"{root}/decisions/batch={number}")

    return bars.writeStream.foreachBatch(one).option("checkpointLocation", f"{root}/state").outputMode("append")


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
