"""Numbered migrations over a set of tables, and the column changes that they are made of."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.errors import QueryError

Tables = dict[str, DataFrame]


@dataclass
class Migration:
    """One step: ``up`` gives the changed tables; a ``preflight`` step is only ever checked."""

    number: int
    name: str
    up: Callable[[Tables], Tables]
    preflight: bool = False


@dataclass
class Record:
    """What has run: numbers that are done, and the failure that stopped the last run."""

    done: list[int] = field(default_factory=list)
    failed: tuple[int, str] | None = None


def _ordered(steps: list[Migration]) -> list[Migration]:
    numbers = [m.number for m in steps]
    if len(set(numbers)) != len(numbers) or any(n < 1 for n in numbers):
        raise QueryError("invalid_migration", "numbers must be positive and differ")
    return sorted(steps, key=lambda m: m.number)


def _applied(step: Migration, tables: Tables) -> Tables:
    after = {**tables, **step.up(dict(tables))}
    for df in after.values():
        df.limit(0).collect()  # analysed and planned: a step that can't run fails here, and none of it counts
    return after


def run(tables: Tables, steps: list[Migration], record: Record, fresh: bool = False) -> tuple[Tables, Record]:
    """Pending steps once, in order; the first failure is recorded, leaves its tables as they were, and stops the rest.

    ``fresh``: a new database is at the newest number without running any.
    """
    done = list(record.done)
    for step in _ordered(steps):
        if step.number in done or step.preflight:
            continue
        if not fresh:
            try:
                tables = _applied(step, tables)
            except Exception as e:
                return tables, Record(done, (step.number, str(e).splitlines()[0]))
        done.append(step.number)
    return tables, Record(done)


def status(steps: list[Migration], record: Record) -> list[tuple[int, str, str]]:
    """(number, name, done, failed, preflight or pending)."""
    kind = lambda m: "done" if m.number in record.done else "failed" if record.failed and record.failed[0] == m.number else "preflight" if m.preflight else "pending"
    return [(m.number, m.name, kind(m)) for m in _ordered(steps)]


def check(tables: Tables, steps: list[Migration], record: Record) -> list[tuple[int, str | None]]:
    """(number, error) of all pending steps, preflight ones too, tried one after another without keeping anything."""
    out = []
    for step in _ordered(steps):
        if step.number not in record.done:
            try:
                tables = _applied(step, tables)
                out.append((step.number, None))
            except Exception as e:
                out.append((step.number, str(e).splitlines()[0]))
    return out


def alter_column(df: DataFrame, name: str, to: Column | str, rename: str | None = None) -> DataFrame:
    """A column as an expression of the row (or cast to a type), in its place, under a new name if given."""
    if name not in df.columns:
        raise QueryError("invalid_migration", f"no column {name}")
    value = F.col(name).cast(to) if isinstance(to, str) else to
    return df.select(*(value.alias(rename or name) if c == name else F.col(c) for c in df.columns))


def drop_column(df: DataFrame, name: str) -> DataFrame:
    if name not in df.columns:
        raise QueryError("invalid_migration", f"no column {name}")
    return df.drop(name)


def rebuild_table(df: DataFrame, columns: dict[str, Column], referenced: bool = False) -> DataFrame:
    """A table of new columns from old ones; refused while others refer to it."""
    if referenced:
        raise QueryError("rebuild_referenced_table", "other tables refer to it")
    return df.select(*(c.alias(n) for n, c in columns.items()))
