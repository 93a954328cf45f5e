"""Bounds of graph queries."""

DEPTH, DEPTH_MOST = 5, 20
LIMIT, LIMIT_MOST = 200, 5000


def check(depth: int, limit: int | None) -> None:
    """depth 0..20 and limit 1..5000 (None: no limit); booleans are no integers here."""
    for name, value, low, high in (("depth", depth, 0, DEPTH_MOST), ("limit", limit, 1, LIMIT_MOST)):
        if name == "limit" and value is None:
            continue
        if isinstance(value, bool) or not isinstance(value, int) or not low <= value <= high:
            raise ValueError(f"{name} must be an integer from {low} to {high}")
