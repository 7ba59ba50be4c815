"""Report tables from ledgers, trades and bars: group-bys, pivots and one interval join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions import folds as K
from tidemill.operators import ledger as L


def aggregate(summary: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Across symbols: medians, worst cases and the share that earned."""
    return summary.groupBy(*keys).agg(
        F.count("*").alias("symbols"), F.median("sharpe").alias("median_sharpe"), F.min("sharpe").alias("min_sharpe"), F.avg((F.col("total_return") > 0).cast("double")).alias("positive"),
        F.median("cagr").alias("median_cagr"), F.min("max_drawdown").alias("worst_drawdown"), F.median("trades").alias("median_trades"))


def periodic(book: DataFrame, unit: str = "YEAR") -> DataFrame:
    """Return and greatest fall per calendar period; a period's first peak is the close before it. Undefined after ruin."""
    period = F.date_trunc(unit, "ts").cast("timestamp_ntz")
    rows = book.withColumn("period", period)
    ends = rows.groupBy("symbol", "period").agg(F.max_by("equity", "ts").alias("final"))
    starts = ends.withColumn("start", F.coalesce(F.lag("final").over(Window.partitionBy("symbol").orderBy("period")), F.lit(1.0)))
    w = Window.partitionBy("symbol", "period").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    curve = rows.join(starts, ["symbol", "period"]).withColumn("drop", F.try_divide("equity", F.greatest(F.col("start"), F.max("equity").over(w))) - 1)
    return curve.groupBy("symbol", "period").agg((F.try_divide(F.first("final"), F.first("start")) - 1).alias("return"), F.least(F.min("drop"), F.lit(0.0)).alias("max_drawdown"))


def return_grid(book: DataFrame) -> DataFrame:
    """Weeks by weekdays of compounded returns, and the week's total: a pivot with known columns."""
    rows = book.select("symbol", F.date_trunc("WEEK", "ts").cast("timestamp_ntz").alias("week"), (F.weekday("ts") + 1).alias("k"), (1 + F.col("net")).alias("g"))
    grid = rows.groupBy("symbol", "week").pivot("k", list(range(1, 8))).agg(F.product("g") - 1)
    total = rows.groupBy("symbol", "week").agg((F.product("g") - 1).alias("total"))
    return grid.select("symbol", "week", *(F.col(str(k)).alias(f"d{k}") for k in range(1, 8))).join(total, ["symbol", "week"])


def month_grid(book: DataFrame) -> DataFrame:
    """Years by months of returns from month end to month end, and the year's: a pivot with known columns."""
    rows = book.select("symbol", F.year("ts").alias("year"), F.month("ts").alias("k"), (1 + F.col("net")).alias("g"))
    grid = rows.groupBy("symbol", "year").pivot("k", list(range(1, 13))).agg(F.product("g") - 1)
    return grid.join(rows.groupBy("symbol", "year").agg((F.product("g") - 1).alias("total")), ["symbol", "year"]).select("symbol", "year", *(F.col(str(k)).alias(f"m{k}") for k in range(1, 13)), "total")


def annual(book: DataFrame, trades: DataFrame, capital: float = 10_000.0) -> DataFrame:
    """Return, profit, greatest fall and closed trades (by their exit) of each calendar year."""
    years = periodic(book, "YEAR").withColumn("year", F.year("period"))
    ends = book.groupBy("symbol", F.year("ts").alias("year")).agg(F.max_by("equity", "ts").alias("final"))
    deals = trades.filter("not open").groupBy("symbol", F.year("exit").alias("year")).agg(F.count("*").alias("trades"), F.avg((F.col("return") > 0).cast("double")).alias("win_rate"))
    ends = ends.withColumn("start", F.coalesce(F.lag("final").over(Window.partitionBy("symbol").orderBy("year")), F.lit(1.0)))
    out = years.join(ends, ["symbol", "year"]).join(deals, ["symbol", "year"], "left")
    profit = (F.col("final") - F.col("start")) * capital
    return out.select("symbol", "year", "return", profit.alias("net_profit"), "max_drawdown", F.coalesce("trades", F.lit(0)).alias("trades"), "win_rate")


def side_stats(trades: DataFrame) -> DataFrame:
    """Closed trades of all, long and short, by one expansion and one group-by."""
    ret = F.col("return")
    rows = trades.filter("not open").withColumn("side", F.explode(F.array(F.lit("All"), F.when(F.col("direction") > 0, "Long").otherwise("Short"))))
    return rows.groupBy("symbol", "side").agg(
        F.count("*").alias("trades"), F.avg((ret > 0).cast("double")).alias("win_rate"), F.sum(ret).alias("total"), F.max(ret).alias("best"), F.min(ret).alias("worst"),
        F.avg(F.when(ret > 0, ret)).alias("avg_win"), F.avg(F.when(ret < 0, ret)).alias("avg_loss"), F.median("bars").alias("median_bars"), F.coalesce(F.stddev_samp(ret), F.lit(0.0)).alias("deviation"))


def streaks(trades: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Longest runs of winning and of other closed trades."""
    w, by_win = Window.partitionBy(*keys).orderBy("entry"), Window.partitionBy(*keys, "win").orderBy("entry")
    rows = trades.filter("not open").withColumn("win", F.col("return") > 0)
    runs = rows.withColumn("run", F.row_number().over(w) - F.row_number().over(by_win)).groupBy(*keys, "win", "run").agg(F.count("*").alias("n"))
    longest = lambda c: F.coalesce(F.max(F.when(c, F.col("n"))), F.lit(0))
    return runs.groupBy(*keys).agg(longest(F.col("win")).alias("wins"), longest(~F.col("win")).alias("losses"))


def loss_streaks(trades: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Longest runs of winners and of losers; a trade that breaks even ends both."""
    rows = trades.withColumn("sign", F.signum("return"))
    w, by_sign = Window.partitionBy(*keys).orderBy("entry"), Window.partitionBy(*keys, "sign").orderBy("entry")
    runs = rows.withColumn("run", F.row_number().over(w) - F.row_number().over(by_sign)).groupBy(*keys, "sign", "run").agg(F.count("*").alias("n"))
    longest = lambda k: F.coalesce(F.max(F.when(F.col("sign") == k, F.col("n"))), F.lit(0))
    return runs.groupBy(*keys).agg(longest(1).alias("max_consec_wins"), longest(-1).alias("max_consec_losses"))


def trade_summary(trades: DataFrame) -> DataFrame:
    """The 23 statistics of closed trades with their `money`: all, long and short, one row for each symbol and side."""
    keys = ("symbol", "side")
    rows = trades.filter("not open").withColumn("side", F.explode(F.array(F.lit("All"), F.when(F.col("direction") > 0, "Long").otherwise("Short"))))
    r, money, bars = F.col("return"), F.col("money"), F.col("bars")
    won, lost = (lambda c: F.when(r > 0, c)), (lambda c: F.when(r < 0, c))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = rows.groupBy(*keys).agg(
        F.sum(money).alias("net_profit"), zero(F.sum(won(money))).alias("gross_profit"), zero(F.sum(lost(money))).alias("gross_loss"), F.count("*").alias("trades"), F.avg((r > 0).cast("double")).alias("win_rate"),
        F.count(won(r)).alias("winners"), F.count(lost(r)).alias("losers"), F.avg(r).alias("avg_trade"), F.avg(money).alias("avg_trade_usd"), F.avg(won(r)).alias("avg_win"), F.avg(lost(r)).alias("avg_loss"),
        F.max(won(r)).alias("largest_win"), F.min(lost(r)).alias("largest_loss"), F.max(won(money)).alias("_top"), F.min(lost(money)).alias("_bottom"), F.avg(bars).alias("avg_bars"), F.avg(won(bars)).alias("avg_bars_win"), F.avg(lost(bars)).alias("avg_bars_loss"))
    profit, loss = F.col("gross_profit"), F.col("gross_loss")
    out = out.withColumns({
        "profit_factor": F.when(loss < 0, profit / -loss).when(profit > 0, F.lit(float("inf"))), "even": F.col("trades") - F.col("winners") - F.col("losers"),
        "win_loss_ratio": F.try_divide("avg_win", -F.col("avg_loss")), "largest_win_share": F.try_divide("_top", profit), "largest_loss_share": F.try_divide("_bottom", loss)})
    return out.drop("_top", "_bottom").join(loss_streaks(rows, keys), list(keys))


def excursions(trades: DataFrame, bars: DataFrame, atr_length: int = 14) -> DataFrame:
    """Worst and best price of each closed trade, as shares of its entry price and in true ranges at entry; never below 0.

    A trade is entered at the close before its first bar, a bracket's at its `entry_price`, and its last bar is the
    one it was closed in. Bars are numbered and each trade explodes to the numbers it spans, so the interval join is an
    equi-join on (symbol, number).
    """
    w = Window.partitionBy("symbol").orderBy("ts")
    numbered = K.with_folds(bars, {"_atr": lambda b: K.atr(b, atr_length)}).withColumn("n", F.row_number().over(w))
    first = F.col("n") == 1
    numbered = numbered.withColumns({"before": F.when(first, F.col("close")).otherwise(F.lag("close").over(w)), "range": F.when(first, F.col("_atr")).otherwise(F.lag("_atr").over(w))})
    price = F.col("entry_price") if "entry_price" in trades.columns else F.col("before")
    held = numbered.select("symbol", F.col("ts").alias("entry"), "n", "before", "range")
    starts = trades.filter("not open").join(held, ["symbol", "entry"]).select("symbol", "entry", "direction", "return", price.alias("price"), "range", "n", "bars")
    spans = starts.withColumn("n", F.explode(F.sequence(F.col("n"), F.col("n") + F.col("bars") - 1)))
    met = spans.join(numbered.select("symbol", "n", "high", "low"), ["symbol", "n"]).groupBy("symbol", "entry", "direction", "return", "price", "range", "bars").agg(F.max("high").alias("h"), F.min("low").alias("l"))
    up, down = F.col("h") / F.col("price") - 1, 1 - F.col("l") / F.col("price")
    long, unit = F.col("direction") > 0, F.col("range") / F.col("price")
    out = met.withColumn("mae", F.greatest(F.lit(0.0), F.when(long, down).otherwise(up))).withColumn("mfe", F.greatest(F.lit(0.0), F.when(long, up).otherwise(down)))
    return out.select("symbol", "entry", "direction", "return", "bars", "mae", "mfe", F.try_divide("mae", unit).alias("mae_atr"), F.try_divide("mfe", unit).alias("mfe_atr"))


def winners_and_losers(excursed: DataFrame) -> DataFrame:
    """Excursions and holding of winning and of other trades."""
    q = lambda c, p: F.percentile(c, F.lit(p))
    return excursed.groupBy(F.when(F.col("return") > 0, "winners").otherwise("losers").alias("outcome")).agg(
        F.count("*").alias("trades"), *(q("bars", p).alias(n) for n, p in (("p50", 0.5), ("p75", 0.75), ("p90", 0.9))), F.max("bars").alias("longest"),
        *(q(c, p).alias(f"{n}_{c}") for c in ("mae", "mfe") for n, p in (("median", 0.5), ("p75", 0.75))), *(q(c, 0.5).alias(f"median_{c}") for c in ("mae_atr", "mfe_atr")))


def regime_labels(bars: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """keys, ts, kind and regime of every bar: trend by its strength, volatility by terciles of the symbol's
    own true range against the close, ties in the order of time. Before an indicator is defined it is warm-up."""
    rows = K.with_folds(bars, {"_adx": lambda b: K.adx(b, 14)[2], "_atr": lambda b: K.atr(b, 14)}, keys).withColumn("_width", F.try_divide("_atr", "close"))
    known = F.col("_width").isNotNull()
    place = F.row_number().over(Window.partitionBy(*keys, known).orderBy("_width", "ts")) - 1
    last = F.count("*").over(Window.partitionBy(*keys, known)) - 1
    rows = rows.withColumn("_place", place).withColumn("_last", last)
    a, p, m = F.col("_adx"), 3 * F.col("_place"), F.col("_last")
    trend = F.when(a.isNull(), "warm-up").when(a >= 25, "trending (ADX>=25)").when(a <= 20, "ranging (ADX<=20)").otherwise("neither")
    volatility = F.when(~known, "warm-up").when(p <= m, "low vol").when(p <= 2 * m, "mid vol").otherwise("high vol")
    pairs = F.array(F.struct(F.lit("trend").alias("kind"), trend.alias("regime")), F.struct(F.lit("volatility").alias("kind"), volatility.alias("regime")))
    return rows.select(*keys, "ts", F.explode(pairs).alias("l")).select(*keys, "ts", "l.*")


def regime_returns(book: DataFrame, labels: DataFrame) -> DataFrame:
    """Per kind and regime: share of all bars, the median of the symbols' Sharpe ratios and the mean of their mean returns."""
    per_year = F.sqrt(L.periods_per_year(F.col("median_step")))
    each = book.join(labels, ["symbol", "ts"]).groupBy("symbol", "kind", "regime").agg(F.count("*").alias("n"), F.avg("net").alias("mean"), F.stddev_samp("net").alias("dev"))
    each = each.join(L.spacing(book).select("symbol", "median_step"), "symbol").withColumn("sharpe", F.coalesce(F.when(F.col("dev") > 0, F.col("mean") / F.col("dev") * per_year), F.lit(0.0)))
    out = each.groupBy("kind", "regime").agg(F.sum("n").alias("n"), F.median("sharpe").alias("median_sharpe"), F.avg("mean").alias("mean_net"))
    return out.select("kind", "regime", (F.col("n") / F.sum("n").over(Window.partitionBy("kind"))).alias("share_of_time"), "median_sharpe", "mean_net")


def histogram(rows: DataFrame, column: str, bins: int) -> DataFrame:
    limits = rows.agg(F.min(column).alias("a"), F.max(column).alias("b"))
    place = F.floor((F.col(column) - F.col("a")) / (F.col("b") - F.col("a")) * bins)
    return rows.crossJoin(F.broadcast(limits)).groupBy(F.least(F.lit(bins - 1), place).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def weaknesses(summary: DataFrame, trades: DataFrame) -> DataFrame:
    """Symbols and sides that lost."""
    losing = summary.filter("total_return < 0").select(F.lit("symbol").alias("kind"), F.col("symbol").alias("name"), F.col("total_return").alias("value"))
    side = F.when(F.col("direction") > 0, "Long").otherwise("Short")
    sides = trades.filter("not open").groupBy(side.alias("name")).agg(F.sum("return").alias("value")).filter("value < 0").select(F.lit("side").alias("kind"), "name", "value")
    return losing.unionByName(sides)


def by_class(summary: DataFrame, instruments: DataFrame) -> DataFrame:
    """The aggregate of each asset class."""
    return aggregate(summary.join(F.broadcast(instruments.select("symbol", "asset_class")), "symbol"), ("asset_class",))


def holding(trades: DataFrame) -> DataFrame:
    """Exact linear quantiles of the bars held by closed trades."""
    q = F.percentile("bars", F.array(F.lit(0.5), F.lit(0.75), F.lit(0.9)))
    out = trades.filter("not open").groupBy("symbol").agg(F.count("*").alias("trades"), q.alias("q"), F.max("bars").alias("longest"))
    return out.select("symbol", "trades", *(F.col("q")[k].alias(n) for k, n in enumerate(("p50", "p75", "p90"))), "longest")


def capture(book: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Slope and intercept against a benchmark's returns, and the shares of its gains and losses captured."""
    both = book.select("symbol", "ts", F.col("net").alias("y")).join(benchmark.select("symbol", "ts", F.col("net").alias("x")), ["symbol", "ts"])
    share = lambda c: F.try_divide(F.avg(F.when(c, F.col("y"))), F.avg(F.when(c, F.col("x"))))
    return both.groupBy("symbol").agg(F.regr_slope("y", "x").alias("beta"), F.regr_intercept("y", "x").alias("alpha"), share(F.col("x") > 0).alias("up_capture"), share(F.col("x") < 0).alias("down_capture"))


def trade_money(trades: DataFrame, book: DataFrame, capital: float = 10_000.0) -> DataFrame:
    """Each trade's result in money: its share of the equity before its first bar."""
    w = Window.partitionBy("symbol").orderBy("ts")
    before = book.select("symbol", F.col("ts").alias("entry"), (F.coalesce(F.lag("equity").over(w), F.lit(1.0)) * capital).alias("account"))
    return trades.join(before, ["symbol", "entry"]).withColumn("money", F.col("return") * F.col("account")).withColumn(
        "running", F.sum("money").over(Window.partitionBy("symbol").orderBy("entry").rowsBetween(Window.unboundedPreceding, 0)))


def account_summary(book: DataFrame, trades: DataFrame, capital: float = 10_000.0, benchmark: DataFrame | None = None) -> DataFrame:
    """One account per symbol: results, falls, money paid for trading and funding, and the benchmark's measures."""
    measures = L.summarize(book, trades)
    before = F.coalesce(F.lag("equity").over(Window.partitionBy("symbol").orderBy("ts")), F.lit(1.0))
    money = book.withColumn("before", before).groupBy("symbol").agg(
        (F.max_by("equity", "ts") * capital).alias("ending_equity"), (F.sum(F.col("trading_cost") * F.col("before")) * capital).alias("costs_paid"), (F.sum(F.col("funding_cost") * F.col("before")) * capital).alias("funding_paid"),
        F.min(F.when(F.col("equity") == 0, F.col("ts"))).alias("stopped_at"))
    falls = L.drawdowns(book).select("symbol", F.col("depth").alias("fall"), (F.col("fall_of_start") * capital).alias("max_drawdown_usd"), "trough", "peak", "recovery", "longest_days", "underwater")
    out = measures.join(money, "symbol").join(falls, "symbol")
    profit = F.col("ending_equity") - capital
    out = out.select("symbol", F.lit(capital).alias("capital"), "ending_equity", profit.alias("net_profit"), "total_return", "cagr", "ann_vol", "sharpe", "sortino", F.col("fall").alias("max_drawdown"), "max_drawdown_usd", "peak", "trough", "recovery", "longest_days", "underwater",
                     L.ratio(profit, F.col("max_drawdown_usd")).alias("return_on_account"), L.ratio(-F.col("cagr"), F.col("fall")).alias("calmar"), "exposure", "trades_per_year", "costs_paid", "funding_paid", "cost_drag_per_year", "funding_drag_per_year", "stopped_at")
    if benchmark is None:
        return out
    held = L.summarize(benchmark, L.trades(benchmark)).select("symbol", F.col("cagr").alias("benchmark_cagr"), F.col("sharpe").alias("benchmark_sharpe"))
    return out.join(held, "symbol").join(L.drawdowns(benchmark).select("symbol", F.col("depth").alias("benchmark_max_drawdown")), "symbol")


MIN_TRADES = 20


def build_report(book: DataFrame, trades: DataFrame, capital: float = 10_000.0, benchmark: DataFrame | None = None, runs: int = 2500, ruin: float = 0.5, seed: int = 0) -> dict[str, DataFrame]:
    """Every table of a report, for all symbols at once: trades with money, their summary, the account, years, months, the
    curve below its peak, Monte Carlo per symbol (with enough closed trades) and notes."""
    from tidemill.plans import experiments as X

    money = trade_money(trades, book, capital)
    account = account_summary(book, trades, capital, benchmark)
    closed = trades.filter("not open")
    counts = closed.groupBy("symbol").agg(F.count("*").alias("closed"))
    each = account.select("symbol", "stopped_at").join(counts, "symbol", "left").withColumn("closed", F.coalesce("closed", F.lit(0)))
    few = each.filter(F.col("closed") < MIN_TRADES).select("symbol", F.format_string("Monte Carlo skipped: %d closed trades (need %d).", F.col("closed"), F.lit(MIN_TRADES)).alias("note"))
    stopped = each.filter("stopped_at is not null").select("symbol", F.concat(F.lit("Trading stopped on "), F.date_format("stopped_at", "yyyy-MM-dd"), F.lit("; what follows is flat.")).alias("note"))
    still = money.filter("open").select("symbol", F.format_string("Open trade at the end of the data: %.2f, not in the trade statistics.", F.col("money")).alias("note"))
    return {"trades": money, "trade_summary": trade_summary(money), "account": account, "annual": annual(book, trades, capital), "monthly": month_grid(book), "drawdown": L.drawdown_series(book),
            "monte_carlo": X.monte_carlo_by_symbol(closed.join(each.filter(F.col("closed") >= MIN_TRADES).select("symbol"), "symbol"), book, runs, ruin, seed), "notes": few.unionByName(stopped).unionByName(still)}


def bands(paths: DataFrame, value: str = "e") -> DataFrame:
    """5, 50 and 95 % of all paths at each step."""
    q = F.percentile(value, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    return paths.groupBy("step").agg(q.alias("q")).select("step", *(F.col("q")[k].alias(n) for k, n in enumerate(("p05", "p50", "p95"))))
