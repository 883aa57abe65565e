"""Named metric series: the input of the recording rules, dashboards and alerts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from devicelens.config import GridConfig
from devicelens.operators import series as s
from devicelens.operators.histograms import histogram_quantile, histogram_quantiles


@dataclass(frozen=True)
class Series:
    """Samples ``(labels..., ts, value)`` of one metric."""

    samples: DataFrame
    labels: tuple[str, ...]


@dataclass
class Metrics:
    """Lookup of series by metric name; a series is built on first use."""

    build: dict[str, Callable[[], Series]]
    cfg: GridConfig = field(default_factory=GridConfig)
    last_tick_s: int | None = None
    _made: dict[str, Series] = field(default_factory=dict)

    def __getitem__(self, name: str) -> Series:
        if name not in self._made:
            self._made[name] = self.build[name]()
        return self._made[name]

    def rate(self, name: str, range_s: int | None = None, **matchers: str) -> DataFrame:
        """Per-second rate of a counter (matchers filter series before the rate is taken)."""
        series = self[name]
        return s.rate(
            s.match(series.samples, **matchers), list(series.labels), range_s or self.cfg.range_s
        )

    def rate_by(
        self, name: str, by: tuple[str, ...] = (), range_s: int | None = None, **matchers: str
    ) -> DataFrame:
        return s.sum_by(self.rate(name, range_s, **matchers), by)

    def quantile(self, name: str, q: float, by: tuple[str, ...] = (), **matchers: str) -> DataFrame:
        return histogram_quantile(self.rate_by(name, ("le", *by), **matchers), q, by)

    def quantiles(
        self, name: str, qs: dict[str, float], by: tuple[str, ...] = (), **matchers: str
    ) -> DataFrame:
        return histogram_quantiles(self.rate_by(name, ("le", *by), **matchers), qs, by)

    def gauge(self, name: str) -> DataFrame:
        series = self[name]
        return s.instant(
            series.samples, list(series.labels), self.cfg.step_s, self.cfg.lookback_s
        )

    def total(self, name: str, by: tuple[str, ...] = ()) -> DataFrame:
        series = self[name]
        return s.total(series.samples, list(series.labels), by)
