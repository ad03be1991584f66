"""Keeping a table or computing it again, decided by what Spark says it takes."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Row


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the table's size: files' sizes carried through the plan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def storage_for(n_bytes: int, memory: int, disk: int = 0, repeatable: bool = True) -> StorageLevel | None:
    """Where a table of that size can be kept, given the cluster's bytes for it; None: compute it again.

    A plan that is not repeatable (random draws) must not be kept, since every epoch draws anew.
    """
    if memory < 0 or disk < 0:
        raise ValueError("bytes cannot be negative")
    if not repeatable:
        return None
    if n_bytes <= memory:
        return StorageLevel.MEMORY_ONLY
    return StorageLevel.MEMORY_AND_DISK if n_bytes <= memory + disk else None


def kept(df: DataFrame, memory: int, disk: int = 0, repeatable: bool = True) -> DataFrame:
    """df, persisted where it fits."""
    level = storage_for(estimated_bytes(df), memory, disk, repeatable)
    return df if level is None else df.persist(level)


def field_share(file_bytes: int, wanted: int, stored: int, wide: int = 8, narrow: int = 4) -> int:
    """Bytes of ``wanted`` of the ``stored`` fields of files, once numbers of ``wide`` bytes are ``narrow``."""
    if not 0 < wanted <= stored:
        raise ValueError(f"{wanted} of {stored} fields")
    return -(-file_bytes * wanted * narrow // (stored * wide))


def shares(wanted: dict[str, int], budget: int) -> dict[str, int]:
    """The budget over named users: what they want where that fits, else in proportion, never beyond."""
    total = sum(wanted.values())
    return dict(wanted) if total <= budget else {k: n * budget // total for k, n in wanted.items()}


def delivered(df: DataFrame, expected: int) -> Iterator[Row]:
    """df's rows a partition at a time, the next one fetched meanwhile; raises at the end if there were
    not exactly ``expected``."""
    n = 0
    for row in df.toLocalIterator(prefetchPartitions=True):
        n += 1
        yield row
    if n != expected:
        raise ValueError(f"{n} rows came, {expected} were expected")


def batch_columns(df: DataFrame, control: list[str]) -> list[str]:
    """The columns that go into a batch: all but the control columns, which must hold numbers or arrays of them."""
    numbers = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    out = [(f.name, f.dataType.simpleString()) for f in df.schema if f.name not in control]
    bad = [n for n, kind in out if kind.replace("array<", "").replace(">", "") not in numbers]
    if bad:
        raise TypeError(f"no numbers in {', '.join(bad)}")
    return [n for n, _ in out]
