"""Knobs shared by all profile operators."""
from __future__ import annotations

import math
from dataclasses import dataclass, field

from .functions.patterns_fixed import DEFAULT_CUSTOM_PATTERNS


@dataclass(frozen=True)
class ProfileOptions:
    """How a table is profiled.

    exact          exact distinct counts and exact (discrete) quartiles of every column instead of
                   sketches; the distinct values are shuffled.
    rsd            relative standard deviation of the distinct-count sketch.
    quantile_error relative rank error of the quartile sketch (``1/accuracy``).
    pk_gate        ``tolerant``: verify keys whose estimate is within 15 % of the row
                   count; ``strict``: only when the estimate equals it; ``none``: all.
    extended_types byte/short count as numeric, dates and timestamps get min/max.
    custom_patterns (name, regex) pairs added to the universal patterns; a name
                   equal to a universal one replaces its regex in place
                   (``patterns.patterns_from`` reads them from a table).
    credit_card    add the Luhn-checked CREDIT_CARD personal-data type.
    """

    exact: bool = False
    rsd: float = 0.01
    quantile_error: float = 0.05
    pk_gate: str = "tolerant"
    extended_types: bool = False
    custom_patterns: tuple[tuple[str, str], ...] = field(default=DEFAULT_CUSTOM_PATTERNS)
    credit_card: bool = False

    @property
    def sketch_accuracy(self) -> int:
        return max(1, int(round(1.0 / self.quantile_error)))

    @property
    def sketch_lg_k(self) -> int:
        """Size of the distinct-count sketch whose error is about 1.04 / sqrt(2 ** k)."""
        return min(21, max(4, math.ceil(2 * math.log2(1.04 / self.rsd))))
