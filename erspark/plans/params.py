"""Parameters of the matching pipeline."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class FeatureParams:
    shingle: int = 3
    weight: int = 2
    stop_share: float = 0.05


@dataclass(frozen=True)
class LshParams:
    bands: int = 50
    rows: int = 4

    @property
    def size(self) -> int:
        return self.bands * self.rows


# The default thresholds and weights.
@dataclass(frozen=True)
class MatchParams:
    gamma: float = 0.718
    epsilon: float = 0.454
    mu: float = 0.819
    alpha: float = 0.558
    beta: float = 0.859
    delta: float = 0.190
    threshold: float = 0.5


# The published settings of the full and of the restricted model.
FULL = (FeatureParams(4, 2, 0.0138), MatchParams(threshold=0.528))
RESTRICTED = (FeatureParams(5, 0, 1.0), MatchParams(0.744, 0.381, 0.559, 0.567, 0.611, 0.215, 0.618))
