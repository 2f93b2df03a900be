"""Batches of seed rows that name their parents by natural keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outings.operators.mutation import Mutation, insert_absent


@dataclass(frozen=True)
class Parent:
    """Rows of ``table`` are found by ``names`` (seed column to table column) and give their ``key`` under the name ``gives``. Of several
    rows with the same names the one with the least key counts."""

    table: DataFrame
    names: Mapping[str, str]
    key: str
    gives: str = ""

    @property
    def given(self) -> str:
        return self.gives or self.key

    def keys(self) -> DataFrame:
        """One row per natural key: the seed's names for it, and the key."""
        named = self.table.select(*[F.col(own).alias(seed) for seed, own in self.names.items()], F.col(self.key).alias(self.given))
        return named.dropna().groupBy(*self.names).agg(F.min(self.given).alias(self.given))


@dataclass(frozen=True)
class Seeding:
    """``table`` is the new state; ``rejected`` are the seed rows that lack a parent, with ``missing``, the key that was not found."""

    table: Mutation
    rejected: DataFrame = field(repr=False)


def resolved(seed: DataFrame, parents: Sequence[Parent]) -> DataFrame:
    """The seed rows with the keys of their parents, null where there is none; the natural keys stay."""
    for parent in parents:
        seed = seed.join(parent.keys(), list(parent.names), "left")
    return seed


def seed_table(seed: DataFrame, parents: Sequence[Parent], target: DataFrame, key: Sequence[str], first: Sequence[Column],
               defaults: Mapping[str, Column] | None = None) -> Seeding:
    """Insert the seed rows whose parents are there and whose ``key`` the target does not have; known rows stay as they are.

    ``defaults`` are columns that a seed row does not state. Of seed rows with the same key the one that is first in ``first`` counts.
    """
    found = resolved(seed, parents)
    missing = F.lit(None).cast("string")
    for parent in reversed(parents):
        missing = F.when(F.col(parent.given).isNull(), parent.given).otherwise(missing)
    found = found.withColumns(dict(defaults or {})).withColumn("missing", missing)
    rows = found.where(F.col("missing").isNull()).drop("missing")
    kept = rows.select(*[c for c in rows.columns if c in target.columns])
    return Seeding(insert_absent(target, kept, list(key), first=list(first)), found.where(F.col("missing").isNotNull()).select(*seed.columns, "missing"))
