"""The five role tables every operator works on."""

from __future__ import annotations

from collections.abc import Callable
from copy import copy
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from stayrate.plans.joins import HotKeys, hot_keys
from stayrate.plans.keystats import analyze_table, known_hot_keys

# The names of the role tables.
TABLES = ("accounts", "subscriptions", "feature_usage", "support_tickets", "churn_events")

JOIN_KEYS = {"feature_usage": ("subscription_id", "feature_key"), "subscriptions": ("account_id",)}


class _Table:
    """A table given as a DataFrame, or as a function of the roles that is called when first needed."""

    def __init__(self, needed: bool = True) -> None:
        self.needed = needed

    def __set_name__(self, owner: type, name: str) -> None:
        self.name = name

    def __get__(self, roles: Roles | None, owner: type) -> DataFrame | None:
        if roles is None:  # asked for the field's default
            if self.needed:
                raise AttributeError(self.name)
            return None
        table = vars(roles)[self.name]
        if callable(table):
            table = vars(roles)[self.name] = table(roles)
        return table

    def __set__(self, roles: Roles, table: DataFrame | Callable[[Roles], DataFrame] | None) -> None:
        vars(roles)[self.name] = table


@dataclass
class Roles:
    """Role tables, each a DataFrame or a function of the roles that makes it when it is first needed.

    ``feature_usage`` holds either ``feature_name`` itself or a ``feature_key`` that ``features``
    (feature_key, feature_name) resolves; the second form lets an operator filter its usage rows
    before paying for the name, or never ask for it. ``owned`` is a prepared table of usage rows with
    their account's columns; operators read it instead of joining usage to its accounts.
    ``key_stats`` is a folder of key statistics, see :func:`analyze_keys`: queries then read the heavy
    keys from it, and where it has none, or is empty text, leave skew to Spark. Without it they are
    looked for in one pass when a join first needs them, which suits tables of a session's own.
    """

    accounts: DataFrame = _Table()
    subscriptions: DataFrame = _Table()
    feature_usage: DataFrame = _Table()
    support_tickets: DataFrame = _Table()
    churn_events: DataFrame = _Table()
    features: DataFrame | None = _Table(needed=False)
    owned: DataFrame | None = _Table(needed=False)
    key_stats: str | None = None
    hot_share: float = 0.001
    hot_min_rows: int = 1_000_000
    _hot: dict[str, dict[str, HotKeys]] = field(default_factory=dict, repr=False)

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)

    @property
    def tickets(self) -> DataFrame:
        return self.support_tickets

    def hot(self, table: str, key: str) -> HotKeys:
        """Heavy values of ``key``, read or looked for once per table, for all its keys.

        They only steer how a join spreads its rows, so a stale list costs time, never rows.
        """
        if table not in self._hot:
            frame = self.table(table)
            limits = (self.hot_share, self.hot_min_rows)
            if self.key_stats is None:
                self._hot[table] = hot_keys(frame, self.join_keys(table), *limits)
            elif self.key_stats:
                folder = f"{self.key_stats}/{table}"
                self._hot[table] = known_hot_keys(frame.sparkSession, folder, *limits)
            else:
                self._hot[table] = {}
        return self._hot[table].get(key, [])

    def but(self, **changes) -> Roles:
        """A copy with other tables or options; tables that were not needed so far are not made."""
        other = copy(self)
        for name, value in changes.items():
            setattr(other, name, value)
        return other

    def join_keys(self, table: str) -> list[str]:
        return [key for key in JOIN_KEYS[table] if key in self.table(table).columns]

    def register_views(self) -> None:
        """Make the role tables available to ``spark.sql``."""
        for name in TABLES:
            self.table(name).createOrReplaceTempView(name)


def analyze_keys(roles: Roles, folder: str) -> Roles:
    """Bring the key statistics in ``folder`` up to date; roles whose queries read them.

    Files sketched by an earlier call are not read again.
    """
    for table in JOIN_KEYS:
        analyze_table(roles.table(table), roles.join_keys(table), f"{folder}/{table}")
    return roles.but(key_stats=folder, _hot={})
