"""Predicates with SQL three-valued logic kept on purpose."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column


def none_of(col: Column, values: Iterable[str]) -> Column:
    """A chain of ``col <> v``: a null ``col`` is dropped, like the scripts' filters.

    ``NOT col IN (...)`` has the same null behaviour and pushes to parquet as
    ``Not(In(...))``; an anti-join would keep nulls and is therefore wrong here.
    """
    values = list(values)
    if not values:
        return col.isNotNull()
    return ~col.isin(values)


def any_of(col: Column, values: Iterable[str]) -> Column:
    """An OR of equalities."""
    return col.isin(list(values))
