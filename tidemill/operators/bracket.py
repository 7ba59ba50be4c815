"""Bracket trades: entry at the next open, stop and target, one position at a time.

The order of fills within a bar, the cooldowns and the kill switch make this a sequential state
machine: one pass over a symbol's bars in a grouped map per (configuration, symbol).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

LEDGER = ("position", "turnover", "gross", "trading_cost", "funding_cost", "net", "equity")
TRADES = "entry timestamp_ntz, exit timestamp_ntz, direction double, bars long, return double, open boolean, qty double, entry_price double, exit_price double, exit_reason string, pnl double"


@dataclass(frozen=True)
class Settings:
    fee: float = 0.0005
    slippage: float = 0.0003
    leverage: float = 1.0
    max_bars: int = 0
    cooldown_win: int = 0
    cooldown_loss: int = 0
    kill_drawdown: float = 1.0
    funding: bool = True


class Account:
    """One symbol's account, stepped bar by bar; also the state of the streaming decider."""

    def __init__(self, s: Settings):
        self.s = s
        self.equity = self.peak = 1.0
        self.killed = self.kill_next = False
        self.side, self.qty, self.mark = 0, 0.0, 0.0
        self.pending = None  # (side, stop distance, target distance)
        self.last_exit, self.wait = None, 0
        self.trade: dict = {}
        self.done: list[dict] = []

    def fill(self, price: float, slip: bool, buys: int) -> float:
        """A market fill moves against us by the slippage; a resting target doesn't."""
        return price * (1 + buys * self.s.slippage) if slip else price

    def leave(self, i: int, price: float, slip: bool, reason: str) -> None:
        price = self.fill(price, slip, -self.side)
        fee = self.qty * price * self.s.fee
        self.gain += self.side * self.qty * (price - self.mark)
        self.cost += fee
        self.turned += self.qty * price
        t = self.trade
        t |= {"exit": i, "exit_price": price, "exit_reason": reason, "fees": t["fees"] + fee, "open": False}
        self.close_trade(i)

    def close_trade(self, i: int) -> None:
        t = self.trade
        t["pnl"] = t["direction"] * t["qty"] * (t["exit_price"] - t["entry_price"]) - t["fees"] - t["funding"]
        t["return"] = t["pnl"] / t["equity"]
        t["bars"] = t["exit"] - t["entry"] + (t["exit_reason"] != "kill")
        self.done.append(t)
        self.side, self.qty = 0, 0.0
        self.last_exit, self.wait = i, self.s.cooldown_win if t["pnl"] > 0 else self.s.cooldown_loss

    def step(self, i: int, o: float, h: float, low: float, c: float, rate: float, long: bool, short: bool, stop: float, target: float) -> tuple:
        s, before = self.s, self.equity
        self.gain = self.cost = self.paid = self.turned = 0.0
        if self.kill_next and self.side:
            self.leave(i, o, True, "kill")
        elif self.pending and not self.killed and o > 0:  # at a price of 0 no quantity can be had: the order lapses
            side, stop_dist, target_dist = self.pending
            price = self.fill(o, True, side)
            self.side, self.qty, self.mark = side, s.leverage * self.equity / price, price
            fee = self.qty * price * s.fee
            self.cost += fee
            self.turned += self.qty * price
            self.trade = {"entry": i, "direction": float(side), "qty": self.qty, "entry_price": price, "fees": fee, "funding": 0.0, "equity": self.equity, "stop": price - side * stop_dist, "target": price + side * target_dist, "open": True}
        self.kill_next, self.pending = False, None
        if self.side:
            d, t = self.side, self.trade
            worst, best = (low, h) if d > 0 else (h, low)
            if d * (o - t["stop"]) <= 0:
                self.leave(i, o, True, "stop")
            elif d * (o - t["target"]) >= 0:
                self.leave(i, o, False, "target")
            elif d * (worst - t["stop"]) <= 0:
                self.leave(i, t["stop"], True, "stop")
            elif d * (best - t["target"]) >= 0:
                self.leave(i, t["target"], False, "target")
        if self.side:
            self.gain += self.side * self.qty * (c - self.mark)
            self.mark = c
            self.paid = self.side * self.qty * c * rate if s.funding else 0.0
            self.trade["funding"] += self.paid
            if s.max_bars > 0 and i - self.trade["entry"] + 1 >= s.max_bars:
                self.leave(i, c, True, "time")
        self.equity += self.gain - self.cost - self.paid
        if self.equity <= 0:
            self.equity = 0.0
            self.killed = True
            if self.side:
                self.trade |= {"exit": i, "exit_price": c, "exit_reason": "liquidated", "open": False}
                self.close_trade(i)
            if self.done and self.done[-1]["exit"] == i:
                t = self.done[-1]
                t["pnl"], t["exit_reason"] = max(t["pnl"], -t["equity"]), "liquidated"
                t["return"] = t["pnl"] / t["equity"]
        self.peak = max(self.peak, self.equity)
        if not self.killed and self.equity <= (1 - s.kill_drawdown) * self.peak:
            self.killed, self.kill_next = True, self.side != 0
        if not self.side and not self.killed and (self.last_exit is None or i - self.last_exit >= self.wait) and stop > 0 and target > 0:
            self.pending = (1, stop, target) if long else (-1, stop, target) if short else None
        base = before or 1.0
        held = self.side * self.qty * c / self.equity if self.equity > 0 else 0.0
        return held, self.turned / base, self.gain / base, self.cost / base, self.paid / base, (self.equity / before - 1) if before > 0 else 0.0, self.equity


def run(b: pd.DataFrame, settings: Settings) -> tuple[np.ndarray, Account]:
    """Ledger columns of one symbol's bars with signals, and the account with its trades."""
    a = Account(settings)
    rate = b.funding_rate.fillna(0.0) if "funding_rate" in b else pd.Series(0.0, index=b.index)
    columns = (b.open, b.high, b.low, b.close, rate, b.long.fillna(False).astype(bool), b.short.fillna(False).astype(bool), b.stop_dist.fillna(0.0), b.target_dist.fillna(0.0))
    book = [a.step(i, *row) for i, row in enumerate(zip(*(c.tolist() for c in columns)))]
    return np.array(book, float).reshape(len(b), len(LEDGER)), a


def run_lanes(b: pd.DataFrame, long: np.ndarray, short: np.ndarray, stop: np.ndarray, target: np.ndarray, settings: Settings | list[Settings]) -> tuple[np.ndarray, np.ndarray]:
    """Net returns (bars x lanes) and closed trades of many accounts over the same bars, all stepped at once.

    The same rules as Account.step; a lane has its own signals (bars x lanes) and, if settings is a list, its own settings.
    """
    n, lanes = long.shape
    each = settings if isinstance(settings, list) else [settings] * lanes
    fee, slip, lever, most, win, loss, kill, pays = (np.array([getattr(s, f) for s in each]) for f in ("fee", "slippage", "leverage", "max_bars", "cooldown_win", "cooldown_loss", "kill_drawdown", "funding"))
    rate = (b.funding_rate.fillna(0.0) if "funding_rate" in b else pd.Series(0.0, index=b.index)).to_numpy()
    prices = [b[c].to_numpy(float) for c in ("open", "high", "low", "close")]
    zero = np.zeros(lanes)
    equity, peak, side, qty, mark, pending = np.ones(lanes), np.ones(lanes), zero.copy(), zero.copy(), zero.copy(), zero.copy()
    far, near, entry, fees, funding, lower, upper = (zero.copy() for _ in range(7))
    killed, kill_next, last, wait, done = np.zeros(lanes, bool), np.zeros(lanes, bool), np.full(lanes, -10**9), np.zeros(lanes, int), np.zeros(lanes, int)
    begun, net, limited, charged = np.zeros(lanes, int), np.zeros((n, lanes)), bool((most > 0).any()), bool(rate.any())

    def leave(at: np.ndarray, price: np.ndarray, slips: np.ndarray) -> None:
        price = price * (1 - side[at] * slip[at] * slips)
        cost = qty[at] * price * fee[at]
        change[at] += side[at] * qty[at] * (price - mark[at]) - cost
        profit = side[at] * qty[at] * (price - entry[at]) - fees[at] - cost - funding[at]
        side[at], qty[at], last[at], wait[at] = 0.0, 0.0, i, np.where(profit > 0, win[at], loss[at])
        done[at] += 1

    for i, (o, h, low, c) in enumerate(zip(*prices)):
        change, before = np.zeros(lanes), equity.copy()
        at = np.flatnonzero(kill_next & (side != 0))
        enters = (pending != 0) & ~killed & (o > 0)
        if len(at):
            leave(at, np.full(len(at), o), np.ones(len(at)))
            enters[at] = False
        kill_next[:] = False
        at = np.flatnonzero(enters)
        if len(at):
            d = pending[at]
            price = o * (1 + d * slip[at])
            side[at], qty[at], mark[at], entry[at], begun[at] = d, lever[at] * equity[at] / price, price, price, i
            fees[at], funding[at], lower[at], upper[at] = lever[at] * equity[at] * fee[at], 0.0, price - d * far[at], price + d * near[at]
            change[at] -= fees[at]
        pending[:] = 0
        at = np.flatnonzero(side)
        if len(at):
            d, x, y = side[at], lower[at], upper[at]
            worst, best = np.where(d > 0, low, h), np.where(d > 0, h, low)
            case = np.select([d * (o - x) <= 0, d * (o - y) >= 0, d * (worst - x) <= 0, d * (best - y) >= 0], [1, 2, 3, 4], 0)
            out = np.flatnonzero(case)
            if len(out):
                k = case[out]
                leave(at[out], np.where(k <= 2, o, np.where(k == 3, x[out], y[out])), k % 2)
                at = at[case == 0]
        if len(at):
            change[at] += side[at] * qty[at] * (c - mark[at])
            mark[at] = c
            if charged:
                owed = side[at] * qty[at] * c * rate[i] * pays[at]
                funding[at] += owed
                change[at] -= owed
            if limited:
                over = at[(most[at] > 0) & (i - begun[at] + 1 >= most[at])]
                if len(over):
                    leave(over, np.full(len(over), c), np.ones(len(over)))
        equity = equity + change
        lost = equity <= 0
        if lost.any():
            equity[lost], killed[lost] = 0.0, True
            done[lost & (side != 0)] += 1
            side[lost], qty[lost] = 0.0, 0.0
        peak = np.maximum(peak, equity)
        stops = ~killed & (equity <= (1 - kill) * peak)
        if stops.any():
            killed |= stops
            kill_next = stops & (side != 0)
        free = (side == 0) & ~killed & (i - last >= wait) & (stop[i] > 0) & (target[i] > 0)
        if free.any():
            pending = np.where(free, np.where(long[i], 1.0, np.where(short[i], -1.0, 0.0)), 0.0)
            far, near = np.where(pending != 0, stop[i], far), np.where(pending != 0, target[i], near)
        net[i] = np.where(before > 0, equity / np.where(before > 0, before, 1.0) - 1, 0.0)
    return net, done


def trade_rows(b: pd.DataFrame, a: Account) -> pd.DataFrame:
    done = list(a.done)
    if a.side:
        t = dict(a.trade)
        t |= {"exit": len(b) - 1, "exit_price": a.mark, "exit_reason": "open", "bars": len(b) - t["entry"]}
        t["pnl"] = t["direction"] * t["qty"] * (a.mark - t["entry_price"]) - t["fees"] - t["funding"]
        t["return"] = t["pnl"] / t["equity"]
        done.append(t)
    names = [c.split()[0] for c in TRADES.split(", ")]
    out = pd.DataFrame(done, columns=[n for n in names]) if done else pd.DataFrame(columns=names)
    ts = b.ts.to_numpy()
    for c in ("entry", "exit"):
        out[c] = ts[out[c].astype(int)] if done else pd.Series(dtype="datetime64[ns]")
    return out


def simulate(bars: DataFrame, settings: Settings, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The ledger: the bars' keys, ts and close with position, turnover, gross, costs, net and equity."""
    kinds = dict(bars.dtypes)

    def one(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("ts", kind="stable", ignore_index=True)
        book, _ = run(b, settings)
        return b[[*keys, "ts", "close"]].assign(**{n: book[:, k] for k, n in enumerate(LEDGER)})

    return bars.groupBy(*keys).applyInPandas(one, ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"ts {kinds['ts']}", "close double", *(f"{n} double" for n in LEDGER)]))


def bracket_trades(bars: DataFrame, settings: Settings, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    kinds = dict(bars.dtypes)

    def one(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("ts", kind="stable", ignore_index=True)
        out = trade_rows(b, run(b, settings)[1])
        for k in keys:
            out[k] = b[k].iloc[0]
        return out[[*keys, *(c.split()[0] for c in TRADES.split(", "))]]

    return bars.groupBy(*keys).applyInPandas(one, ", ".join([*(f"{k} {kinds[k]}" for k in keys), TRADES]))
