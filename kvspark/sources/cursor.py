"""A cursor over a bucket, both ways.

Rows come in pages; a page is a sorted, limited scan from the current key, so it touches only the
files and row groups around it. A change of direction, or a new position, drops the page.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators import scan

Item = tuple[bytes | None, bytes | None]
NONE: Item = (None, None)


class Cursor:
    """Positions return (key, value), or (None, None) where there is none. next() and prev() on a
    cursor without a position return none; past an end they stay there, and turning back
    from there gives the last row on that side."""

    def __init__(self, rows: Callable[[], DataFrame], page_rows: int = 256):
        self._rows, self._page_rows = rows, page_rows
        self._key: bytes | None = None
        self._page: list[tuple[bytes, bytes]] = []
        self._way = 0
        self._beyond = 0  # -1: before the first row, 1: after the last

    def _load(self, df: DataFrame, way: int) -> Item:
        self._page = [(bytes(r.key), bytes(r.value)) for r in df.collect()]  # a page at most
        self._page.reverse()
        self._way = way
        return self._serve(way)

    def _serve(self, way: int) -> Item:
        if not self._page:
            self._beyond = way
            return NONE
        key, value = self._page.pop()
        self._key, self._beyond = key, 0
        return key, value

    def _reset(self) -> None:
        self._key, self._page, self._beyond = None, [], 0

    def first(self) -> Item:
        self._reset()
        return self._load(scan.page_after(self._rows(), None, self._page_rows), 1)

    def last(self) -> Item:
        self._reset()
        return self._load(scan.page_before(self._rows(), None, self._page_rows), -1)

    def seek(self, key: bytes) -> Item:
        """The first row at or after the key."""
        self._reset()
        found = self._load(scan.key_range(self._rows(), key).orderBy("key").limit(self._page_rows), 1)
        if found == NONE:
            self._key = key
        return found

    def next(self) -> Item:
        return self._step(1)

    def prev(self) -> Item:
        return self._step(-1)

    def _step(self, way: int) -> Item:
        if self._key is None or self._beyond == way:
            return NONE
        if self._beyond:
            # From beyond an end, the nearest row on the way back.
            return self.first() if way > 0 else self.last()
        if self._way == way and self._page:
            return self._serve(way)
        page = scan.page_after if way > 0 else scan.page_before
        return self._load(page(self._rows(), self._key, self._page_rows), way)
