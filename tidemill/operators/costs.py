"""Transaction costs and returns of selected events."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.frames import exact_quantiles

# Slippage in basis points by hour (UTC).
HOURLY_BPS = {
    0: 0.18, 1: 0.18, 2: 0.18, 3: 0.18, 4: 0.18, 5: 0.18, 6: 0.15, 7: 0.10, 8: 0.08, 9: 0.06, 10: 0.06, 11: 0.06,
    12: 0.06, 13: 0.05, 14: 0.05, 15: 0.05, 16: 0.06, 17: 0.08, 18: 0.10, 19: 0.12, 20: 0.14, 21: 0.16, 22: 0.18, 23: 0.18,
}


@dataclass(frozen=True)
class Costs:
    """Fee and slippage in basis points, charged ``sides`` times; ``hourly`` slippage unless ``fixed_bps`` is given."""

    fee_bps: float = 0.25
    fixed_bps: float | None = None
    hourly: Mapping[int, float] = field(default_factory=lambda: HOURLY_BPS)
    other_bps: float = 0.10
    sides: int = 2

    def slippage_bps(self, ts: Column) -> Column:
        if self.fixed_bps is not None:
            return F.lit(self.fixed_bps)
        table = F.create_map(*(F.lit(x) for h, b in self.hourly.items() for x in (h, float(b))))
        return F.coalesce(F.try_element_at(table, F.hour(ts)), F.lit(self.other_bps))

    def charge(self, ts: Column) -> Column:
        """What a trade at ``ts`` costs, as a return."""
        return self.sides * (self.slippage_bps(ts) + self.fee_bps) * 1e-4


def classified_return(signal: Column, payoff: Column, ts: Column, costs: Costs = Costs(), size: Column | float = 1.0) -> Column:
    """signal * (exp(payoff) - 1), less costs where there is a signal; times ``size``."""
    return (signal * F.expm1(payoff) - F.when(signal != 0, costs.charge(ts)).otherwise(0.0)) * size


def selected_return(take: Column, payoff: Column, ts: Column, costs: Costs = Costs()) -> Column:
    """exp(payoff) - 1 less costs where taken, else 0."""
    return F.when(take, F.expm1(payoff) - costs.charge(ts)).otherwise(0.0)


def takes(prediction: Column, threshold: Column, compat: bool = False) -> Column:
    """Whether a prediction reaches the threshold. ``compat``: it is compared to the truth of that (1 or 0) instead, which
    in effect takes predictions from zero up to the threshold."""
    over = prediction >= threshold
    return prediction >= over.cast("int") if compat else over


def thresholds(predictions: DataFrame, by: Sequence[str], quantiles: Sequence[float], column: str = "prediction") -> DataFrame:
    """(by, q, threshold): exact quantiles of the predictions of each group."""
    q = exact_quantiles(predictions, F.col(column), quantiles, by)
    return q.select(*by, F.posexplode("_q").alias("i", "threshold")).select(*by, F.element_at(F.array(*map(F.lit, map(float, quantiles))), F.col("i") + 1).alias("q"), "threshold")
