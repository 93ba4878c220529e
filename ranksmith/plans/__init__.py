"""Whole jobs, from rating tables to finished lists."""

from ranksmith.plans.global_lists import Recommendation, global_lists, write_global_lists
from ranksmith.plans.segment_lists import SegmentLists, segment_lists
from ranksmith.plans.titled_lists import titled_lists

__all__ = ["Recommendation", "SegmentLists", "global_lists", "segment_lists", "titled_lists", "write_global_lists"]
