"""The detector on one path in plain Python, from run to run of a level's sides: what the fold is tested against."""

from __future__ import annotations

import numpy as np

from pricepanel.operators.events import Rules

TERMINAL = ("PULLBACK", "BREAKOUT", "TIMEOUT")
SIDES = {-1: "below", 1: "above"}


def checked(prices: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    prices, levels = np.asarray(prices, float), np.unique(np.asarray(levels, float))
    if not len(prices) or not len(levels) or not np.isfinite(prices).all() or not np.isfinite(levels).all():
        raise ValueError("prices and levels must be finite and not empty")
    return prices, levels


def detect(prices: np.ndarray, levels: np.ndarray, rules: Rules = Rules()) -> tuple[list[dict], list[str]]:
    """Events of one path in order, and its state at every step."""
    prices, levels = checked(prices, levels)
    n = len(prices)
    gap = prices[None, :] - levels[:, None]
    sides = (gap > rules.tolerance).astype(int) - (gap < -rules.tolerance)
    ends = np.full_like(sides, n)
    for i in range(n - 2, -1, -1):
        ends[:, i] = np.where(sides[:, i] == sides[:, i + 1], ends[:, i + 1], i + 1)
    nearest = np.abs(gap).argmin(axis=0)
    in_zone = np.abs(gap).min(axis=0) <= rules.tolerance
    outside_before = np.zeros(n, bool)
    outside_before[1:] = sides[nearest[1:], np.arange(n - 1)] != 0
    entries = np.flatnonzero(in_zone & outside_before)
    states, events = ["IDLE"] * n, []

    def mark(a: int, b: int, state: str, last: str | None = None) -> None:
        states[a:b] = [state] * (b - a)
        if last:
            states[b] = last

    at = 1
    while (k := int(np.searchsorted(entries, at))) < len(entries):
        entry = int(entries[k])
        level = int(nearest[entry])
        side, end = sides[level], ends[level]
        came = int(side[entry - 1])
        base = {
            "fib_level": float(levels[level]), "entry_index": entry, "approach_side": SIDES[came], "approach_direction": "up" if came < 0 else "down",
            "consolidation_index": None, "hover_index": None, "dwell_time": 1,
        }

        def emit(kind: str, out: int, dwell: int, leave: int | None = None, confirmed: bool = False, stage: str | None = None, base: dict = base, side: np.ndarray = side) -> None:
            span = prices[leave : out + 1] if confirmed else None
            events.append(base | {
                "event_type": kind, "is_terminal": kind in TERMINAL, "output_index": out, "dwell_time": dwell, "pullback_stage": stage,
                "exit_direction": ("up" if side[leave] > 0 else "down") if confirmed else None, "exit_index": leave, "confirmation_end_index": out if confirmed else None,
                "exit_price": None if leave is None else float(prices[leave]), "max_price_after": float(span.max()) if confirmed else None, "min_price_after": float(span.min()) if confirmed else None,
            })

        settled, left = entry + rules.min_dwell - 1, int(end[entry])
        if left <= settled:  # it leaves the zone before it has settled
            mark(entry, left, "APPROACHING")
            if left == n:
                break
            if side[left] != came:
                at = left
                continue
            done = left + rules.confirmation - 1
            if done >= n:
                break
            if end[left] > done:
                mark(left, done, "APPROACHING", "FINISHED")
                emit("PULLBACK", done, left - entry, left, True, "approaching")
                at = done + 1
            else:
                mark(left, int(end[left]), "APPROACHING")
                at = int(end[left])
            continue
        mark(entry, settled, "APPROACHING", "CONSOLIDATING")
        base["consolidation_index"] = base["hover_index"] = settled
        emit("HOVER", settled, rules.min_dwell)
        timeout, i, dwell = settled + rules.max_dwell, settled + 1, rules.min_dwell
        while True:
            if i >= n:
                return events, states
            if i >= timeout:
                mark(settled, timeout, "CONSOLIDATING", "FINISHED")
                emit("TIMEOUT", timeout, dwell, timeout)
                at = timeout + 1
                break
            if side[i] == 0:
                until = min(int(end[i]), timeout)
                mark(i, until, "CONSOLIDATING")
                dwell, i = dwell + until - i, until
                continue
            done = i + rules.confirmation - 1
            if timeout < n and done >= timeout:
                i = timeout
                continue
            if done >= n:
                return events, states
            if end[i] > done:
                mark(i, done, "CONSOLIDATING", "FINISHED")
                back = side[i] == came
                emit("PULLBACK" if back else "BREAKOUT", done, dwell, i, True, "consolidating" if back else None)
                at = done + 1
                break
            mark(i, int(end[i]), "CONSOLIDATING")
            i = int(end[i])
    return events, states
