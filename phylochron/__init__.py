"""Time-consistency ranking of the nodes of a tree, on Spark: `rank`, `session`, sources and operators.

Names are imported on use, so that parts can be imported alone.
"""

__version__ = "0.1.0"
_EXPORTS = {"rank": "plans.rank", "Result": "plans.rank", "session": "session", "read_evidence": "sources.lines", "read_tree": "sources.newick"}


def __getattr__(name):
    import importlib

    if name not in _EXPORTS:
        raise AttributeError(name)
    return getattr(importlib.import_module(f"{__name__}.{_EXPORTS[name]}"), {"read_evidence": "read", "read_tree": "read"}.get(name, name))
