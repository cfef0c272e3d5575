"""All registered queries."""

from busward.catalog import (  # noqa: F401
    frames, context, leakage, statistics, inferential, signal_gate, sources, online, modelling)
from busward.catalog.registry import QUERIES  # noqa: F401
