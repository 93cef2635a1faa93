"""Server-side cursors: rows of a result by position, fetched in pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.numbering import number_rows


class Cursor:
    """A result in a fixed order that is fetched page by page.

    Opening numbers the rows once (range-partitioned, in the shared folder); each fetch is a filter
    on the number, so a page costs no more than its rows' files and the driver holds no row.
    """

    def __init__(self, df: DataFrame, order: Sequence[Column]) -> None:
        self.columns, self.rows, self.at = df.columns, number_rows(df, order, "__row"), 0

    def fetch(self, n: int) -> DataFrame:
        """The next ``n`` rows (fewer at the end)."""
        page = self.rows.where((F.col("__row") > self.at) & (F.col("__row") <= self.at + n)).select(*self.columns)
        self.at += n
        return page

    def rewind(self) -> None:
        self.at = 0
