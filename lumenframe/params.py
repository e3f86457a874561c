"""Declared parameters of operations and their checks."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from .errors import INVALID_ARGUMENT, INVALID_TYPE, FrameError

_MISSING = object()


@dataclass(frozen=True)
class Param:
    """kind: string, integer, number, boolean, array or object. ``default`` tells readers only; checks don't apply it."""

    name: str
    kind: str = "string"
    required: bool = False
    description: str = ""
    allowed: tuple = ()
    minimum: float | None = None
    maximum: float | None = None
    pattern: str | None = None
    default: Any = None


def is_array(x: Any) -> bool:
    return isinstance(x, Iterable) and not isinstance(x, (str, bytes, Mapping))


def to_int(x: Any) -> int | None:
    if isinstance(x, bool):
        return int(x)
    if isinstance(x, int):
        return x
    if isinstance(x, float):
        return int(x) if x == int(x) else None
    if isinstance(x, str) and re.fullmatch(r"\s*[+-]?\d+\s*", x):
        return int(x)
    return None


def to_number(x: Any) -> float | None:
    try:
        return float(x)
    except (TypeError, ValueError):
        return None


def to_bool(x: Any) -> bool | None:
    if isinstance(x, bool):
        return x
    if isinstance(x, str) and x.strip().lower() in ("true", "false"):
        return x.strip().lower() == "true"
    return bool(x) if to_int(x) in (0, 1) else None


def _text(x: Any) -> str:
    return str(x) if not isinstance(x, bool) else ("True" if x else "False")


def check(values: Mapping[str, Any], declared: Sequence[Param]) -> None:
    """Presence, closed sets, kinds, ranges and patterns, in this order; parameters that aren't declared are ignored."""
    for p in declared:
        x = values.get(p.name)
        if x is None:
            if p.required:
                raise FrameError(INVALID_TYPE, f"The request lacks '{p.name}'.", parameter=p.name)
            continue
        if p.allowed and _text(x) not in [_text(a) for a in p.allowed]:
            raise FrameError(INVALID_ARGUMENT, f"'{p.name}' is one of {', '.join(map(_text, p.allowed))}; that value is none of them.", parameter=p.name)
        fits, what = {
            "integer": (lambda: not isinstance(x, bool) and to_int(x) is not None, "an integer"),
            "number": (lambda: not isinstance(x, bool) and to_number(x) is not None, "a number"),
            "boolean": (lambda: to_bool(x) is not None, "a boolean"),
            "array": (lambda: is_array(x), "an array"),
            "object": (lambda: isinstance(x, Mapping), "an object"),
        }.get(p.kind, (lambda: True, ""))
        if not fits():
            raise FrameError(INVALID_TYPE, f"The value of '{p.name}' should be {what}.", parameter=p.name)
        v = to_number(x) if p.minimum is not None or p.maximum is not None else None
        if v is not None and p.minimum is not None and v < p.minimum:
            raise FrameError(INVALID_TYPE, f"The value of '{p.name}' is below {p.minimum}.", parameter=p.name)
        if v is not None and p.maximum is not None and v > p.maximum:
            raise FrameError(INVALID_TYPE, f"The value of '{p.name}' is above {p.maximum}.", parameter=p.name)
        if p.pattern and isinstance(x, str) and not re.search(p.pattern, x):
            raise FrameError(INVALID_TYPE, f"The value of '{p.name}' has a form that isn't allowed.", parameter=p.name)


def text_list(name: str, x: Any) -> list[str]:
    if x is None:
        return []
    if isinstance(x, (str, Mapping)):
        raise FrameError(INVALID_TYPE, f"'{name}' takes a list of texts.", parameter=name)
    return [str(v) for v in x if v is not None] if isinstance(x, Iterable) else []


def text(x: Any) -> str | None:
    """A non-blank string form, else None."""
    return str(x) if x is not None and str(x).strip() else None
