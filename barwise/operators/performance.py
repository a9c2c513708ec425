"""Positions, profit, drawdown and trailing scenes from order events and prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwise.functions.frames import affine, rolling, running


def average_prices(events: DataFrame) -> DataFrame:
    """``events`` (``symbol, ts, tie, side, volume, price, ..``) with ``position`` and ``avg_price`` of their side after each event.

    An opening event (volume above 0) moves the average towards its price by its share of the new position, a closing one
    leaves it; after a flat position it begins anew.  It is null while flat; openings without a price leave it as it was.
    """
    e = events.withColumn("symbol", F.struct("symbol", "side"))
    e = running(e, sums={"position": F.coalesce(F.col("volume"), F.lit(0.0))})
    held, opens = F.abs("position") > 1e-9, F.col("volume") > 0
    a = F.when(~held, 0.0).when(opens & F.col("price").isNotNull(), (F.col("position") - F.col("volume")) / F.col("position")).otherwise(1.0)
    b = F.when(held & opens & F.col("price").isNotNull(), F.col("volume") * F.col("price") / F.col("position")).otherwise(0.0)
    e = affine(e, "_avg", a, b)
    return e.withColumn("symbol", F.col("symbol.symbol")).withColumn("avg_price", F.when(F.abs("position") > 1e-9, F.col("_avg"))).drop("_avg")


def positions(bars: DataFrame, events: DataFrame) -> DataFrame:
    """``symbol, ts, price`` with per side running position, average open price, floating and realised profit, cost and capital.

    ``events``: ``symbol, ts, tie, side (long, short), volume (closes negative), price, profit, cost``, in order of
    ``ts`` and ``tie``.  They count from the first bar at their own time (others are left out).
    The average price is that of :func:`average_prices`.
    """
    ev = average_prices(events).groupBy("symbol", "ts", "side").agg(
        F.sum("volume").alias("v"), F.sum("profit").alias("pr"), F.sum("cost").alias("c"), F.max_by(F.struct("avg_price"), "rn").alias("avg"))
    sides = ev.groupBy("symbol", "ts").pivot("side", ["long", "short"]).agg(*[F.first(c).alias(c) for c in ("v", "pr", "c", "avg")])
    d = bars.select("symbol", "ts", "tie", "price").join(sides, ["symbol", "ts"], "left")
    sums = {f"{s}_{n}": F.coalesce(F.col(f"{s}_{c}"), F.lit(0.0)) for s in ("long", "short") for n, c in (("position", "v"), ("fix_profit", "pr"), ("cost", "c"))}
    d = running(d, sums=sums, latest={f"_{s}": F.col(f"{s}_avg") for s in ("long", "short")})
    out = d.select("symbol", "ts", "tie", "price", "rn", *sums, *[F.when(F.abs(f"{s}_position") > 1e-9, F.col(f"_{s}.avg_price")).alias(f"{s}_avg_price") for s in ("long", "short")])
    for s, sign in (("long", 1), ("short", -1)):
        out = out.withColumn(f"{s}_float", F.coalesce((F.col("price") - F.col(f"{s}_avg_price")) * F.col(f"{s}_position") * sign, F.lit(0.0)))
        out = out.withColumn(f"{s}_capital", F.col(f"{s}_float") + F.col(f"{s}_fix_profit") - F.col(f"{s}_cost"))
    return out.withColumn("net_position", F.col("long_position") - F.col("short_position")).withColumn("capital", F.col("long_capital") + F.col("short_capital"))


def account(orders: DataFrame, initial: float) -> DataFrame:
    """``symbol, ts, tie, kind`` of every opening and closing with the account after it.

    ``orders``: ``symbol, order_id, open_ts, close_ts, side, price, volume, deposit, cost, profit``.  Opening takes deposit and
    cost from the cash and adds deposit and volume to the side; closing gives deposit and profit back.  Columns: ``cash``,
    ``long_asset, short_asset, long_volume, short_volume``, ``long_avg, short_avg`` (0 while flat).  Each symbol is an account of
    its own; nothing is refused for want of cash.  Events at one time go by order number, closings first; null amounts count 0.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    leg = lambda ts, kind, sign: F.struct(F.col(ts).alias("ts"), F.struct(F.lit(max(sign, 0)).alias("k"), F.col("order_id").alias("o")).alias("tie"), F.lit(kind).alias("kind"), F.lit(float(sign)).alias("sign"))
    e = orders.select("symbol", "side", "price", *[zero(c).alias(c) for c in ("volume", "deposit", "cost", "profit")], F.explode(F.array(leg("open_ts", "open", 1), leg("close_ts", "close", -1))).alias("e"))
    e = e.select("symbol", "side", "price", "volume", "deposit", "cost", "profit", "e.*").filter("symbol is not null and ts is not null").withColumn("volume", F.col("volume") * F.col("sign"))
    e = average_prices(e).drop("rn", "position")
    opens = F.col("sign") > 0
    cash = F.when(opens, -F.col("deposit") - F.col("cost")).otherwise(F.col("deposit") + F.col("profit"))
    own = lambda s, c: F.when(F.col("side") == s, c).otherwise(0.0)
    sums = {"_cash": cash} | {f"{s}_asset": own(s, F.col("sign") * F.col("deposit")) for s in ("long", "short")} | {f"{s}_volume": own(s, F.col("volume")) for s in ("long", "short")}
    d = running(e, sums=sums, latest={f"_{s}": F.when(F.col("side") == s, F.struct("avg_price")) for s in ("long", "short")})
    avg = [F.when(F.abs(f"{s}_volume") > 1e-9, F.col(f"_{s}.avg_price")).otherwise(0.0).alias(f"{s}_avg") for s in ("long", "short")]
    return d.select("symbol", "ts", F.col("tie.o").alias("order_id"), "kind", "side", (initial + F.col("_cash")).alias("cash"), "long_asset", "short_asset", "long_volume", "short_volume", *avg)


def streaks(df: DataFrame, flag: Column) -> DataFrame:
    """``df`` with ``flag`` and ``streak_id``: runs of equal flags numbered from 1 in each symbol."""
    d = df.withColumn("flag", flag)
    d = rolling(d, lambda w: {"turns": F.coalesce(F.col("flag") != F.lag("flag").over(w), F.lit(True)).cast("long")}, back=1)
    return running(d, sums={"streak_id": F.col("turns")}).drop("turns")


def underwater(df: DataFrame, capital: str, position: str) -> DataFrame:
    """``symbol, streak_id, start_ts, end_ts, rows, minutes, position_minutes, worst``: stretches in which capital is below its running maximum.

    ``position_minutes`` are the minutes times the share of rows with a position; ``worst`` the
    smallest capital / peak - 1.  The first row of a symbol never belongs to one.
    """
    d = running(df, maxima={"peak": F.col(capital)})
    d = streaks(d, F.col(capital) < F.col("peak")).filter("flag")
    minutes = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 6e7
    return d.groupBy("symbol", "streak_id").agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count(F.lit(1)).alias("rows"), minutes.alias("minutes"),
        (minutes * F.count_if(F.abs(F.col(position)) > 1e-9) / F.count(F.lit(1))).alias("position_minutes"), F.min(F.try_divide(F.col(capital) - F.col("peak"), F.col("peak"))).alias("worst"))


def holding_streaks(df: DataFrame, position: str) -> DataFrame:
    """``symbol, streak_id, start_ts, end_ts, rows, minutes``: stretches with a position."""
    d = streaks(df, F.abs(F.col(position)) > 1e-9).filter("flag")
    minutes = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 6e7
    return d.groupBy("symbol", "streak_id").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count(F.lit(1)).alias("rows"), minutes.alias("minutes"))


def sharpe(df: DataFrame, returns: str) -> DataFrame:
    """``symbol, sharpe``: mean over deviation times the root of (days covered / 252), as the reference has it."""
    days = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 8.64e10
    return df.groupBy("symbol").agg((F.try_divide(F.avg(returns), F.stddev_samp(returns)) * F.sqrt(days / 252)).alias("sharpe"))


def profit_points(df: DataFrame, profit: str, position: str) -> DataFrame:
    """``symbol, pnl_ratio, holding_ratio``: mean gain over mean loss, and the share of rows with a position."""
    return df.groupBy("symbol").agg(
        F.try_divide(F.avg(F.when(F.col(profit) > 0, F.col(profit))), F.avg(F.when(F.col(profit) < 0, F.col(profit)))).alias("pnl_ratio"),
        (F.count_if(F.abs(F.col(position)) > 1e-9) / F.count(F.lit(1))).alias("holding_ratio"))


def scenes(df: DataFrame, n: int) -> DataFrame:
    """``df`` with ``scene``: the prices of the ``n`` rows before, oldest first, without the row itself."""
    return rolling(df, lambda w: {"scene": F.collect_list("price").over(w.rowsBetween(-n, -1))}, back=n)


def isoelastic(r: Column, a: float) -> Column:
    """CRRA utility of a gross return: (r^(1-a) - 1) / (1 - a), or ln r for a = 1."""
    return F.ln(r) if a == 1 else (F.pow(r, F.lit(1 - a)) - 1) / (1 - a)


def exponential(r: Column, a: float = 0.1) -> Column:
    """e^(|r| a) r."""
    return F.exp(F.abs(r) * a) * r


def rewards(df: DataFrame, n: int, a: float = 0.1, change_cost: float = 0.0, penalty_sign: int = 1) -> DataFrame:
    """``df`` with ``reward``: utility of position times the n-step return, plus (as the reference has it; minus with
    ``penalty_sign`` -1) a cost per unit of changed position."""

    def make(w) -> dict[str, Column]:  # noqa: ANN001
        step = F.try_divide(F.lead("price", n).over(w), F.col("price")) - 1
        changed = F.abs(F.col("position") - F.coalesce(F.lag("position").over(w), F.lit(0.0)))
        return {"reward": exponential(F.col("position") * step, a) + penalty_sign * change_cost * changed}

    return rolling(df, make, back=1, ahead=n)


def env_steps(df: DataFrame, portfolio: Column, n: int = 1, cool_down: int = 10, gain_aversion: float = 0.5, loss_aversion: float = 0.1, operation_loss: float = 0.01, mean: bool = False) -> DataFrame:
    """``symbol, ts, tie, portfolio, reward, done``: an episode per symbol that replays its prices with the given portfolios (-1 .. 1).

    It begins flat at row ``cool_down`` and ends ``n`` + 1 rows before the last one.  The return is that of the price ``n`` rows on (or of the
    ``mean`` of the next ``n``) times the portfolio; gains go through the isoelastic utility, losses through the exponential one (with aversion 0
    they stay as they are); a changed portfolio adds ``operation_loss``, as the original has it.
    """

    def make(w) -> dict[str, Column]:  # noqa: ANN001
        ahead = F.avg("price").over(w.rowsBetween(1, n)) if mean else F.lead("price", n).over(w)
        before = F.when(F.col("rn") > cool_down, F.lag("portfolio").over(w)).otherwise(0.0)
        return {"_r": F.col("portfolio") * (F.try_divide(ahead, F.col("price")) - 1), "_before": before, "_left": F.count("price").over(w.rowsBetween(1, n + 2))}

    d = rolling(df.withColumn("portfolio", portfolio.cast("double")), make, back=1, ahead=n + 2).filter((F.col("rn") >= cool_down) & (F.col("_left") > n))
    r = F.col("_r")
    utility = F.when((r >= 0) & F.lit(gain_aversion > 0), isoelastic(r + 1, gain_aversion)).when((r < 0) & F.lit(loss_aversion > 0), exponential(r, loss_aversion)).otherwise(r)
    cost = F.when(F.col("portfolio") != F.col("_before"), operation_loss).otherwise(0.0)
    return d.select("symbol", "ts", "tie", "portfolio", (utility + cost).alias("reward"), (F.col("_left") == n + 1).alias("done"))
