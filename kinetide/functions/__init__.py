from .scalars import lenient_double, lenient_long, local_ms, safe_id, sorted_codes

__all__ = ["lenient_double", "lenient_long", "local_ms", "safe_id", "sorted_codes"]
