"""The four tables and their cleaned forms."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from tillroll.operators.keys import dedup_rows, drop_ambiguous_keys


@dataclass(frozen=True)
class Tables:
    """Receipts, their items, users and brands; everything else is derived lazily."""

    receipts: DataFrame
    items: DataFrame
    users: DataFrame
    brands: DataFrame

    @cached_property
    def users_dedup(self) -> DataFrame:
        """Users without exact copies."""
        return dedup_rows(self.users)

    @cached_property
    def brands_cleaned(self) -> DataFrame:
        """Brands without those that share a barcode."""
        return drop_ambiguous_keys(self.brands, "barcode")
