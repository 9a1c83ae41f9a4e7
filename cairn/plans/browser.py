"""A walk through directories: where one is, how the listing is sorted, and what a window shows of it."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.keys import check_prefix
from ..operators.listing import next_order, ranked, with_entry_cost, with_share
from ..operators.paging import window_rows


class Browser:
    """Holds a position in an inventory; every view is a DataFrame."""

    def __init__(self, objects: DataFrame, region: str = "us-east-1", rows: int = 20):
        self.objects, self.region, self.rows = objects, region, rows
        self.prefix, self.cursor = "", 0
        self.by, self.descending, self.dirs_first = "size", True, False
        self.trail: list[tuple[str, int]] = []

    def entries(self) -> DataFrame:
        listed = with_share(with_entry_cost(self.objects, self.prefix, self.region))
        return ranked(listed, self.by, self.descending, self.dirs_first)

    def view(self) -> DataFrame:
        entries = self.entries()
        return window_rows(entries, self.cursor, self.rows, entries.count())

    def descend(self, name: str) -> None:
        self.trail.append((self.prefix, self.cursor))
        self.prefix, self.cursor = check_prefix(self.prefix + name), 0

    def ascend(self) -> None:
        if self.trail:
            self.prefix, self.cursor = self.trail.pop()

    def sort(self, by: str) -> None:
        self.by, self.descending = next_order(self.by, self.descending, by)

    def toggle_dirs_first(self) -> None:
        self.dirs_first = not self.dirs_first
