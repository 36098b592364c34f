"""Registered queries and their SQL twins."""

from pixelquilt.catalog import features, geometry, intake, jobs, metrics, prompts, sequences, sharding, streams  # noqa: F401
from pixelquilt.catalog.base import QUERIES, SQL  # noqa: F401
