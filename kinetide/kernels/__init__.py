from .attach import attach
from .asof import nearest_asof
from .interval import interval_anti, interval_join
from .islands import islands, summarise_islands
from .order import Ordering, scan, with_chunks
from .stats import auc, mad, quantiles, ranked

__all__ = [
    "attach", "Ordering", "scan", "with_chunks", "nearest_asof", "interval_join", "interval_anti",
    "islands", "summarise_islands", "quantiles", "mad", "ranked", "auc",
]
