"""Registered queries over the driver tables and their SQL oracles."""

from . import etl  # noqa: F401  (registration order: warehouse side first)
from . import demand  # noqa: F401
from . import routing  # noqa: F401
from . import landed  # noqa: F401
from .registry import ORACLES, QUERIES


def all_queries():
    return dict(QUERIES)


def all_oracles():
    return dict(ORACLES)
