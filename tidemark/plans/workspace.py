"""One filter selection and one frequency: the KPI frames every view starts from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tidemark.plans import kpis as K
from tidemark.plans import ledger as L
from tidemark.sources.readers import FrameCache


class DepositWorkspace:
    """Builds the KPI frames lazily and keeps them persisted for the views.

    Account and user status are worked out on the whole ledger before any filter, since a
    filtered ledger would count accounts differently. The kept frames are cubes, their size
    is that of the domain (segments x periods) and not that of the ledger. ``sets`` limits the
    cubes to the grouping sets that are wanted, for instance ``kpis.VIEW_SETS``."""

    def __init__(
        self,
        trxns: DataFrame,
        rgsns: DataFrame,
        market: DataFrame,
        freq: str = "Monthly",
        countries: Sequence[str] | None = None,
        services: Sequence[str] | None = None,
        channels: Sequence[str] | None = None,
        sets: Sequence[Sequence[str]] | None = None,
    ):
        self.freq, self.sets = freq, sets
        chosen = dict(countries=countries, services=services, channels=channels)
        events = L.registration_events(rgsns, trxns)
        self.ledger, self.registrations = L.apply_filters(L.enrich_ledger(trxns), events, **chosen)
        # the same rows without the per-user scan, for what does not need it
        self.trxns, _ = L.apply_filters(L.add_groups(trxns), events, **chosen)
        self.market = L.market_dim(market)
        self._cache = FrameCache(max_entries=4)

    @property
    def transactions(self) -> DataFrame:
        return self._cache.get("transactions", lambda: K.transaction_kpis(self.ledger, self.freq, self.sets))

    @property
    def acquisition(self) -> DataFrame:
        return self._cache.get("acquisition", lambda: K.acquisition_kpis(self.registrations, self.freq))

    @property
    def conversion(self) -> DataFrame:
        return self._cache.get("conversion", lambda: K.conversion_rates(self.acquisition))

    @property
    def dues(self) -> DataFrame:
        return self._cache.get("dues", lambda: K.due_kpis(self.trxns, self.freq, self.sets))

    def close(self) -> None:
        self._cache.clear()
