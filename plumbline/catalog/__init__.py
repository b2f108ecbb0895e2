"""Named queries over the test tables, each with the SQL that must give the same rows."""

from plumbline.catalog import audit, cleaning, preparation, profiling, storage  # noqa: F401
from plumbline.catalog.registry import REGISTRY

__all__ = ["REGISTRY"]
