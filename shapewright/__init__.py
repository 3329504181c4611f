"""Structural pre-flight checks for filesets, built on Spark DataFrames.

    from shapewright import scan, check, from_flat
"""

__version__ = "0.1.0"

_PLACES = {"scan": "plans.scan", "check": "plans.scan", "from_flat": "operators.baseline", "from_result": "operators.baseline", "from_golden": "operators.baseline", "from_ddl": "operators.baseline", "load": "operators.baseline", "Limits": "sources.listing"}
__all__ = sorted(_PLACES)


def __getattr__(name: str):
    if name not in _PLACES:
        raise AttributeError(name)
    from importlib import import_module

    return getattr(import_module(f"shapewright.{_PLACES[name]}"), name)
