"""SQL expressions for quintile shares, RPS and hard quintiles.

They are built as SQL text: one parsed expression instead of dozens of Column objects.
"""

from __future__ import annotations

from crossrank.schema import RANKS

TARGETS = ["Target1", "Target2", "Target3", "Target4", "Target5"]


def threshold(n: str, q: int) -> str:
    """Last position of quintile ``q`` among ``n`` assets: floor(q n / 5)."""
    return f"(({n}) * {q} div 5)"


def tie_share(less: str, ties: str, n: str, q: int) -> str:
    """Part of a tie group at positions less+1 .. less+ties that falls in quintile q."""
    upper = f"least({less} + {ties}, {threshold(n, q)})"
    lower = f"greatest({less}, {threshold(n, q - 1)})"
    return f"greatest({upper} - {lower}, 0L) / double({ties})"


def rps_expr(forecast: list[str] = RANKS, target: list[str] = TARGETS) -> str:
    """Mean over the five quintiles of (cumulative target - cumulative forecast) squared."""
    terms = []
    for q in range(1, 6):
        gap = " + ".join(f"({t} - {f})" for t, f in zip(target[:q], forecast[:q]))
        terms.append(f"pow({gap}, 2)")
    return f"(({' + '.join(terms)}) / 5D)"


def hard_quintile(shares: list[str]) -> str:
    """1-based quintile with the largest share, the first one on equal shares."""
    cells = f"array({', '.join(shares)})"
    return f"int(array_position({cells}, array_max({cells})))"


def expected_rank_score(ranks: list[str] = RANKS) -> str:
    return "(" + " + ".join(f"{c} * {q}D" for q, c in enumerate(ranks, 1)) + " - 3D)"
