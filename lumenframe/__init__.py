"""A structured dataframe engine on Spark: named operations with declared parameters, compiled to DataFrame plans."""

from typing import Any

_WHERE = {"Engine": "engine", "Options": "engine", "Response": "envelope", "FrameError": "errors"}
__all__ = list(_WHERE)


def __getattr__(name: str) -> Any:
    """Loaded when asked for: Python workers on executors import the package often, and need little of it."""
    if name not in _WHERE:
        raise AttributeError(name)
    from importlib import import_module

    return getattr(import_module(f".{_WHERE[name]}", __name__), name)
