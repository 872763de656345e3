"""Options of the audit rules, with the same checks wherever they are made."""

from __future__ import annotations

from dataclasses import dataclass

SECOND = 1_000_000
HOUR = 3_600 * SECOND


@dataclass(frozen=True)
class CorrelationOptions:
    """Matching window in microseconds; both edges belong to it."""

    window_us: int = 3 * SECOND

    def __post_init__(self) -> None:
        if self.window_us <= 0:
            raise ValueError("the matching window must be positive")


@dataclass(frozen=True)
class RiskOptions:
    """Session gap in microseconds, and the running counts from which a session is graded up."""

    window_us: int = 10 * SECOND
    warning: int = 30
    critical: int = 100

    def __post_init__(self) -> None:
        if self.window_us <= 0 or self.warning <= 0 or self.critical <= self.warning:
            raise ValueError("the window and counts must be positive, and critical above warning")


@dataclass(frozen=True)
class ProtectedRule:
    """A protected root; of the enabled rules that match a path the first in the list counts."""

    rule_id: str
    path: str
    enabled: bool = True
