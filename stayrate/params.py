"""Dates, windows and thresholds shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta


@dataclass(frozen=True)
class Params:
    # The observation window and cut dates of the reference data.
    window_start: date = date(2023, 1, 1)
    window_end: date = date(2024, 12, 31)
    cohort_cut: date = date(2024, 1, 1)  # cohorts must sign up before this day
    maturity_cut: date = date(2024, 6, 30)  # last signup day with six months observed

    # Day windows, both ends included.
    early_window: tuple[int, int] = (0, 30)
    adoption_window: tuple[int | None, int] = (0, 60)
    persistence_windows: tuple[tuple[int, int], tuple[int, int]] = ((0, 29), (30, 59))
    prechurn_windows: tuple[tuple[int, int], ...] = ((0, 30), (31, 90), (91, 150))
    tenure_marks: tuple[int, int] = (90, 180)

    # Upper edges (included) and labels; the last label is open-ended.
    seat_edges: tuple[int, ...] = (5, 20, 50)
    seat_labels: tuple[str, ...] = ("1-5", "6-20", "21-50", "50+")
    breadth_edges: tuple[int, ...] = (2, 5, 10, 15)
    breadth_labels: tuple[str, ...] = ("0-2", "3-5", "6-10", "11-15", "16+")

    min_n: int = 15  # thinnest segment cross worth a percentage
    cross_limit: int = 12
    feature_limit: int = 10

    @property
    def months(self) -> int:
        """Calendar months touched by the window."""
        first, last = self.month_numbers
        return last - first + 1

    @property
    def month_numbers(self) -> tuple[int, int]:
        """First and last month of the window, counted from the start of the calendar."""
        return tuple(d.year * 12 + d.month - 1 for d in (self.window_start, self.window_end))

    @property
    def whole_months(self) -> tuple[date, date]:
        """First and last day of the months of the window."""
        last = self.window_end.replace(day=1) + timedelta(days=31)
        return self.window_start.replace(day=1), last.replace(day=1) - timedelta(days=1)
