"""Parameter checks, made when a plan is built, and real intervals as parameter domains."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass


@dataclass(frozen=True)
class Interval:
    """left..right with ends closed 'left', 'right', 'both' or 'neither'."""

    left: float
    right: float
    closed: str = "right"

    def __post_init__(self):
        if self.closed not in ("left", "right", "both", "neither"):
            raise ValueError(f"unknown closure {self.closed!r}")
        if not self.left <= self.right:
            raise ValueError("left end is above the right end")

    @property
    def closed_left(self) -> bool:
        return self.closed in ("left", "both")

    @property
    def closed_right(self) -> bool:
        return self.closed in ("right", "both")

    def __contains__(self, x) -> bool:
        above = self.left <= x if self.closed_left else self.left < x
        below = x <= self.right if self.closed_right else x < self.right
        return above and below

    def _map(self, f) -> Interval:
        a, b = f(self.left), f(self.right)
        flip = {"left": "right", "right": "left"}
        return Interval(a, b, self.closed) if a <= b else Interval(b, a, flip.get(self.closed, self.closed))

    def __add__(self, k):
        return self._map(lambda x: x + k)

    def __sub__(self, k):
        return self._map(lambda x: x - k)

    def __mul__(self, k):
        return self._map(lambda x: x * k)

    def __truediv__(self, k):
        return self._map(lambda x: x / k)

    def __floordiv__(self, k):
        return self._map(lambda x: x // k)

    __radd__, __rmul__ = __add__, __mul__

    @property
    def length(self) -> float:
        return self.right - self.left

    @property
    def mid(self) -> float:
        return (self.left + self.right) / 2

    @property
    def is_empty(self) -> bool:
        return self.left == self.right and self.closed != "both"

    def overlaps(self, other: Interval) -> bool:
        if self.is_empty or other.is_empty:
            return False
        left = self.left < other.right or (self.left == other.right and self.closed_left and other.closed_right)
        right = other.left < self.right or (other.left == self.right and other.closed_left and self.closed_right)
        return left and right


def validate(params: Mapping, rules: Mapping) -> None:
    """rules: name -> {'type', 'in', 'of', 'other'}. TypeError, ValueError or KeyError on the first breach."""
    for name, value in params.items():
        if name not in rules:
            raise KeyError(f"{name} is not a parameter; there are {sorted(rules)}")
        rule = rules[name]
        kinds = rule.get("type")
        if kinds is not None and not isinstance(value, kinds):
            raise TypeError(f"{name} is a {type(value).__name__}, not one of {kinds}")
        if "in" in rule and value is not None and isinstance(value, int | float | str) and (isinstance(value, float) and math.isnan(value) or value not in rule["in"]):
            raise ValueError(f"{name} = {value!r} is outside of {rule['in']}")
        if "of" in rule and isinstance(value, list | tuple | dict):
            items = value.items() if isinstance(value, dict) else ((f"{name}[{k}]", v) for k, v in enumerate(value))
            for key, item in items:
                validate({key: item}, {key: rule["of"]} if not isinstance(value, dict) else rule["of"])
        if "other" in rule:
            rule["other"](value)
