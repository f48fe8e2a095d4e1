"""Lots that need a symbol's trades in order: last in first out, and average cost."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

ORDER = ["ts", "id", "line", "part", "price", "shares"]


def _by_symbol(trades: DataFrame, f, schema: str) -> DataFrame:
    kept = trades.select("symbol", "side", *ORDER)

    def run(series: pd.DataFrame) -> pd.DataFrame:
        return f(series.sort_values(ORDER, kind="stable"))

    return kept.groupBy("symbol").applyInPandas(run, f"symbol {dict(trades.dtypes)['symbol']}, {schema}")


def lifo_lots(trades: DataFrame) -> DataFrame:
    """B3 realised lots, the latest purchase first: symbol, buy_no, sell_no, shares, realised. What is sold without a
    purchase is left out."""

    def f(s: pd.DataFrame) -> pd.DataFrame:
        held, out = [], []
        for k, (side, price, shares) in enumerate(zip(s["side"], s["price"], s["shares"]), 1):
            if side == "buy":
                held.append([k, price, shares])
                continue
            while shares > 0 and held:
                lot = held[-1]
                n = min(shares, lot[2])
                out.append((s["symbol"].iloc[0], lot[0], k, n, n * (price - lot[1])))
                shares -= n
                lot[2] -= n
                if lot[2] <= 0:
                    held.pop()
        return pd.DataFrame(out, columns=["symbol", "buy_no", "sell_no", "shares", "realised"])

    return _by_symbol(trades, f, "buy_no long, sell_no long, shares double, realised double")


def average_cost(trades: DataFrame) -> DataFrame:
    """B4 realised profit against the average cost of what is held: symbol, held, cost (of all that is held), realised."""

    def f(s: pd.DataFrame) -> pd.DataFrame:
        held = cost = realised = 0.0
        for side, price, shares in zip(s["side"], s["price"], s["shares"]):
            if side == "buy":
                held, cost = held + shares, cost + shares * price
            elif held > 0:
                n = min(shares, held)
                realised += n * (price - cost / held)
                held, cost = held - n, cost * (1 - n / held)
        return pd.DataFrame({"symbol": s["symbol"].iloc[:1], "held": [held], "cost": [cost], "realised": [realised]})

    return _by_symbol(trades, f, "held double, cost double, realised double")
