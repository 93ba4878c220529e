"""Writers."""

from ranksmith.sinks.lists import write_lists

__all__ = ["write_lists"]
