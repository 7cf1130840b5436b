"""Keeps a caller's columns apart from those an operator makes on the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Apart:
    """A frame whose columns have names of no other use, and the way back to the caller's."""

    def __init__(self, df: DataFrame) -> None:
        self.names = df.columns
        self.df = df.toDF(*[f"caller_{i}" for i in range(len(self.names))])

    def __getitem__(self, name: str) -> str:
        """What the caller's column is called here."""
        return f"caller_{self.names.index(name)}"

    def back(self, out: DataFrame, made: dict[str, Column] | None = None) -> DataFrame:
        """The caller's columns under their names; made ones stand in place of their namesakes, or last."""
        made = made or {}
        own = [made[n].alias(n) if n in made else F.col(self[n]).alias(n) for n in self.names]
        return out.select(*own, *[c.alias(n) for n, c in made.items() if n not in self.names])
