"""Column functions that other parts share."""

from ..derived import heap_hops
from ..operators.evidence import coin
from ..sources.lines import is_data, without_comment

__all__ = ["coin", "heap_hops", "is_data", "without_comment"]
