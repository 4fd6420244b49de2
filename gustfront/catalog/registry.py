"""Registration of named queries and helpers to keep floats comparable across engines."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gustfront.catalog.views import Inputs, oracle
from gustfront.session import shared_folder, use_utc


@dataclass(frozen=True)
class Entry:
    build: Callable[[Inputs], DataFrame]
    twin: str | None


ENTRIES: dict[str, Entry] = {}


def query(name: str, twin: str | None = None):
    """Register ``build(inputs) -> DataFrame`` under ``name`` with its SQL twin."""

    def keep(build: Callable[[Inputs], DataFrame]):
        if name in ENTRIES:
            raise ValueError(f"query {name} registered twice")
        ENTRIES[name] = Entry(build, oracle(twin) if twin else None)
        return build

    return keep


def runner(entry: Entry) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        use_utc(spark)
        shared_folder(spark)
        return entry.build(Inputs(spark, folder))

    return run


def rnd(value: Column | str, digits: int = 6) -> Column:
    """Half-up rounding spelled with plain arithmetic, equal bit for bit in both engines."""
    value = F.col(value) if isinstance(value, str) else value
    scale = float(10**digits)
    return F.floor(value * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def sql_rnd(value: str, digits: int = 6) -> str:
    return f"(cast(floor(({value}) * 1e{digits} + 0.5e0) as double) / 1e{digits})"


def stamp(value: Column | str) -> Column:
    """Instant as text, so that results do not depend on the reader's time zone."""
    return F.date_format(value, "yyyy-MM-dd HH:mm:ss")


def sql_stamp(value: str) -> str:
    return f"strftime({value}, '%Y-%m-%d %H:%M:%S')"
