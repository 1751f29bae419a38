from . import fold, order, scan, stats

__all__ = ["fold", "order", "scan", "stats"]
