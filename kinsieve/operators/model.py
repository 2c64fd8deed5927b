"""The link model: comparisons with their m and u, and the prior. Immutable, kept as JSON."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, replace

from .comparison import Comparison, Level, Measure, default_comparisons, default_m_u, weaken_comparison

#: The odds that two random records match, and the probability that makes a match.
PRIOR, TAU = 0.0001, 0.85


@dataclass(frozen=True)
class LinkModel:
    comparisons: tuple[Comparison, ...]
    prior: float = PRIOR
    tau: float = TAU
    #: ``neutral``: a missing value says nothing. ``observed``: it is a level of its own, the closest of an untrained comparison.
    null_mode: str = "neutral"
    trained: bool = False

    @staticmethod
    def untrained(comparisons: list[Comparison] | None = None, **settings) -> LinkModel:
        return LinkModel(tuple(comparisons or default_comparisons()), **settings)

    def with_(self, **settings) -> LinkModel:
        """The same model with other settings; those given win."""
        return replace(self, **settings)

    def weakened(self, name: str, strength: float) -> LinkModel:
        """With one comparison weakened; a strength of 1 or more changes nothing."""
        if strength >= 1:
            return self
        return self.with_(comparisons=tuple(weaken_comparison(c, strength) if c.name == name else c for c in self.comparisons))

    def weights(self, c: Comparison) -> dict[int, float]:
        """The match weight log2(m/u) of each level by its integer; bounded where m or u is 0."""
        out = {}
        for level, value in zip(c.levels, c.values, strict=True):
            if level.is_null:
                n = sum(not x.is_null for x in c.levels)
                m, u = default_m_u(n + 1)[0] if self.null_mode == "observed" else (1.0, 1.0)
            else:
                m, u = level.m, level.u
            out[value] = math.log2(max(m, 1e-12) / max(u, 1e-12))
        return out

    @property
    def prior_weight(self) -> float:
        return math.log2(self.prior / (1 - self.prior))

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> LinkModel:
        d = json.loads(text)
        comparisons = tuple(
            Comparison(c["name"], tuple(c["fields"]), tuple(Level(**x) for x in c["levels"]), tuple(Measure(**x) for x in c["measures"])) for c in d.pop("comparisons")
        )
        return LinkModel(comparisons, **d)
