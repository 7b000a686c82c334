"""Settings of every query, in one frozen value, so that tests can shrink them."""

from __future__ import annotations

from dataclasses import dataclass

DAY = 86_400


@dataclass(frozen=True)
class Params:
    now: int  # reference time, epoch seconds
    t0_days: int = 180
    t1_days: int = 365
    multipliers: tuple[float, float, float] = (1.0, 0.85, 0.45)
    pad: int = 30
    gap: int = 30
    threshold: float = 1.0
    max_window: int = 120
    ignore_kinds: tuple[str, ...] = ("megagroup", "chat")
    ignore_dialogs: tuple[int, ...] = ()
    max_delete_ratio: float = 0.05
    max_dialog_ratio: float = 0.40
    min_term_len: int = 4
    structural_weight: float = 0.5
    structural_axis: str = "politics"
    #: An axis whose hits a keep-list does not lift.
    hard_axes: tuple[str, ...] = ("crypto_hard",)
    max_range: int = 100
    #: Let messages with a hit on a hard axis anchor and be planned although a keep-list protects them.
    honour_hard_axes: bool = False
