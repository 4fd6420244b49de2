"""Import every module that registers queries."""

from gustfront.catalog import alerting, dataset, landing, learning, operations, raster, streams  # noqa: F401
from gustfront.catalog.registry import ENTRIES, runner


def registered():
    return {name: runner(entry) for name, entry in ENTRIES.items()}


def twins():
    return {name: entry.twin for name, entry in ENTRIES.items() if entry.twin}
