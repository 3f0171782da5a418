"""Tolerances, windows and version stamps of a reconciliation run.

Money is held as BIGINT cents inside the engine: sums, differences and costs
are then exact and the same on every executor.
"""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class MatchConfig:
    # Amounts in cents, windows in days.
    tight_cents: int = 300
    tight_days: int = 3
    fuzzy_cents: int = 1000
    fuzzy_days: int = 7
    split_cents: int = 500
    split_days: int = 5
    tie_gap_cents: int = 100
    day_cost_cents: int = 200
    cost_scale_cents: int = 3000
    floor_pct: int = 55
    auto_accept_pct: int = 85
    exact_pct: int = 99
    lifecycle_pct: int = 98
    split_pct: int = 80
    proposal_min_pct: int = 60
    proposal_cap_pct: int = 79
    nearby_days: int = 15
    queue_candidates: int = 5
    home_currency: str = "INR"
    default_merchant: str = "default"
    default_rail: str = "default"
    processor_name: str = "Processor"
    rule_version: str = "ledgerloom-rules-2"
    blocking_version: str = "ledgerloom-blocks-2"
    policy_version: str = "ledgerloom-gate-2"

    @property
    def half_up_costs(self) -> tuple[int, ...]:
        """Costs that lie halfway between two hundredths and round up.

        Which way a half goes is decided by the double nearest to
        1 - cost / 30, as a plain round() of it to two places does.
        """
        scale = self.cost_scale_cents
        halves = range(scale // 200, (100 - self.floor_pct) * scale // 100, scale // 100)
        return tuple(c for c in halves if round(100 * round(1 - (c / 100) / (scale / 100), 2)) * scale > 100 * (scale - c))

    @property
    def fuzzy_cost_cut(self) -> int:
        """Largest cost whose rounded confidence still reaches the gate."""
        half = (100 - self.auto_accept_pct) * self.cost_scale_cents // 100 + self.cost_scale_cents // 200
        return half if half in self.half_up_costs else half - 1

    @property
    def raw_cost_cut(self) -> int:
        """Largest cost whose unrounded confidence reaches the gate."""
        return (100 - self.auto_accept_pct) * self.cost_scale_cents // 100

    def with_(self, **changes) -> "MatchConfig":
        return replace(self, **changes)


DEFAULT = MatchConfig()
