"""Searches over a monotone check: the gas a call needs."""

from __future__ import annotations

from collections.abc import Callable

TRANSFER = 21_000


def gas_needed(succeeds: Callable[[int], bool], cap: int, peak: int | None = None, runs: int = 24) -> int | None:
    """The least gas (to 1.5 %) at which a call succeeds, at most `cap`; None if it fails at the cap.

    peak: gas that a run at the cap used; first tried with the reserve of a nested call.
    """
    if succeeds(TRANSFER):
        return TRANSFER
    if not succeeds(cap):
        return None
    low, high = TRANSFER, cap
    if peak is not None and low < (guess := (peak + 2_300) * 64 // 63) < high:
        low, high = (low, guess) if succeeds(guess) else (guess, high)
    for _ in range(runs):
        if high - low <= 1 or (high - low) / high < 0.015:
            break
        middle = min((low + high) // 2, low * 2)
        low, high = (low, middle) if succeeds(middle) else (middle, high)
    return high
