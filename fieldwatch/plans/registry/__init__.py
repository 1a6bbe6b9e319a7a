"""One registered query per operator over the driver's tables, with its DuckDB counterpart."""

from . import (alarms_scoring, cleaning, episodes, grid, maintenance, models, segments, serving, storage, streams,
               windows)  # noqa: F401
from .base import ENTRIES

__all__ = ["ENTRIES"]
