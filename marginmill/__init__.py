"""marginmill: diff-and-feedback corpus analytics expressed as Spark plans."""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
