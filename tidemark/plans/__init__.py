"""Registered queries: each applies operators to the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.operator import Operator
from ..operators import desk, equity, loads, market, options, pairs, performance, phrases, portfolio, risk, scan, signals, technical, text
from ..registry import query
from ..sources.views import portable_views, view

MODULES = (technical, signals, risk, performance, desk, portfolio, market, text, options, loads)
_DONE: list[str] = []
#: Indicators that are a scan of their own, from bars, for the statement over all indicators that states their rows.
SCANS = {
    "ema": (scan.ema, "ema", "true"), "rsi": (scan.rsi, "rsi", "true"), "macd": (scan.macd, "line signal histogram", "line is not null"), "atr": (scan.atr, "atr", "atr is not null"),
    "adx": (scan.adx, "plus_di minus_di adx", "plus_di is not null"), "keltner": (scan.keltner, "lower middle upper", "lower is not null"),
}
#: Operators that Spark runs in another form than their statement, over the same inputs.
FORMS = {
    "correlations": pairs.correlations, "substitutes": pairs.substitutes, "drawdown_events": equity.drawdown_events, "monthly_returns": equity.monthly_returns,
    "topics": lambda words, documents: phrases.topics(documents),
}


def _put(op: Operator) -> None:
    @query(op.name, op.portable(portable_views(op.inputs)))
    def run(spark, sf_dir):
        if op.name in SCANS:
            f, names, kept = SCANS[op.name]
            return f(view(spark, sf_dir, "bars")).where(kept).select("symbol", "ts", *[F.round(n, 6).alias(n) for n in names.split()])
        return FORMS.get(op.name, op)(*(view(spark, sf_dir, n) for n in op.inputs))


def load() -> None:
    """Register every operator once."""
    if not _DONE:
        for module in MODULES:
            for op in module.OPERATORS:
                _put(op)
        from . import extra, intake, reviews, vendors

        extra.register()
        intake.register()
        reviews.register()
        vendors.register()
        _DONE.append("done")
