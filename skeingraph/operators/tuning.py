"""Parameter tuning from evaluation reports: diagnose, propose, keep the best."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

#: Parameter: least, most, step; bounds are fixed values.
BOUNDS: dict[str, tuple[float, float, float]] = {
    "recall_limit": (3, 15, 2), "walk_depth": (1, 4, 1), "damping": (0.7, 0.95, 0.05), "rank_rounds": (10, 50, 5), "duplicate_threshold": (0.8, 0.98, 0.02),
    "fresh_tail": (5, 20, 1), "vector_top_k": (5, 30, 1), "compact_turns": (3, 12, 1), "interim_turns": (5, 30, 1), "extract_interval_ms": (900_000, 3_600_000, 300_000),
}


@dataclass(frozen=True)
class Round:
    parameters: dict[str, float]
    p1: float
    p3: float
    f1: float
    slow_share: float


def diagnose(r: Round) -> list[str]:
    """What a report suffers from."""
    rules = [("ranking", r.p3 > 2 * r.p1 and r.p1 < 0.3), ("coverage", r.f1 < 0.3), ("latency", r.slow_share > 0.5), ("answers", r.f1 < 0.2)]
    return [name for name, on in rules if on]


def propose(r: Round, turn: int, stagnant: int) -> dict[str, float]:
    """One step of one parameter for the first finding; after five stagnant rounds, the next in turn."""
    moves = {"ranking": ("damping", 1), "coverage": ("recall_limit", 1), "latency": ("rank_rounds", -1), "answers": ("walk_depth", 1)}
    found = diagnose(r)
    names = sorted(BOUNDS)
    name, sign = moves[found[0]] if found and stagnant < 5 else (names[turn % len(names)], 1 if turn % 2 == 0 else -1)
    low, high, step = BOUNDS[name]
    return r.parameters | {name: min(high, max(low, r.parameters[name] + sign * step))}


def tune(start: dict[str, float], evaluate: Callable[[dict[str, float]], Round], rounds: int = 10, revert_at: float = 0.02) -> tuple[Round, list[Round]]:
    """The best round by P@1 and all of them; a round well below the best goes back to it."""
    best = current = evaluate(start)
    seen, stagnant = [current], 0
    for turn in range(rounds):
        base = best if best.p1 - current.p1 > revert_at else current
        current = evaluate(propose(base, turn, stagnant))
        seen.append(current)
        stagnant = 0 if current.p1 > best.p1 else stagnant + 1
        best = current if current.p1 > best.p1 else best
    return best, seen
