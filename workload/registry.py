"""Collects every query module."""

from workload import columns, full, learning, panel, profiling, ranking, storage  # noqa: F401
from workload.base import ORACLES, QUERIES  # noqa: F401
from workload.panel import flagship  # noqa: F401
