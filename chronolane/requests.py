"""Immutable query requests, validated when made."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from chronolane.types import Aggregator, CompareOp


@dataclass(frozen=True)
class Compare:
    op: CompareOp
    value: float | int

    def __post_init__(self) -> None:
        if isinstance(self.value, (str, bytes, bool)):
            raise TypeError("only numbers can be compared")


@dataclass(frozen=True)
class Latest:
    """The newest row of each entity; ``vins`` None means every entity, ``columns`` empty means all."""

    vins: tuple[str, ...] | None = None
    columns: tuple[str, ...] = ()

    @classmethod
    def of(cls, vins: Iterable[str] | None, columns: Iterable[str] = ()) -> Latest:
        return cls(None if vins is None else tuple(dict.fromkeys(vins)), tuple(columns))


@dataclass(frozen=True)
class Span:
    """Rows of one entity with ``lower <= ts < upper``."""

    vin: str
    lower: int
    upper: int

    def __post_init__(self) -> None:
        if self.lower >= self.upper:
            raise ValueError(f"empty range [{self.lower}, {self.upper})")


@dataclass(frozen=True)
class TimeRange(Span):
    columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class Aggregate(Span):
    column: str = ""
    how: Aggregator = Aggregator.AVG


@dataclass(frozen=True)
class Downsample(Aggregate):
    interval: int = 0
    compare: Compare | None = None
    empty_windows: str = field(default="omit")

    def __post_init__(self) -> None:
        super().__post_init__()
        if self.interval <= 0:
            raise ValueError("the interval must be positive")
        if self.empty_windows not in ("omit", "fill"):
            raise ValueError("empty_windows is 'omit' or 'fill'")
