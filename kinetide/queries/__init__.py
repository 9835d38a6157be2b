from . import evaluate, features, focus, label, models, quality, sources, streams, study  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
