"""The tree of a plan as lines of text."""

from __future__ import annotations

from planweft.plans.rels import Rel


def tree(rel: Rel) -> list[str]:
    lines = [str(rel)]
    below = [tree(x) for x in rel.inputs()]
    for i, child in enumerate(below):
        rest = "   " if i == len(below) - 1 else "|  "
        lines += [f"|- {child[0]}", *(rest + x for x in child[1:])]
    return lines
