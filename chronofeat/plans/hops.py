"""The hops that the features of a path run through."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Hop:
    """One join of the plan: from table `src` (number on the path) over relations src..dst-1; timed or not; to many or to one."""

    src: int
    dst: int
    timed: bool
    many: bool


def hops(unique: list[bool], timed: list[bool]) -> list[Hop]:
    """Deepest hop first. unique[i]: relation i is to one; timed[i]: table i has a time.

    An untimed table before a timed one is passed over with the to-one hops above it until a timed
    table is reached; without one the hop sees all rows.
    """
    out, i = [], len(unique) - 1
    while i >= 0:
        if not timed[i + 1] or timed[i]:
            out.append(Hop(i, i + 1, timed[i + 1] and timed[i], not unique[i]))
            i -= 1
            continue
        j = i - 1
        while j >= 0 and unique[j] and not timed[j]:
            j -= 1
        if j >= 0 and unique[j] and timed[j]:
            out.append(Hop(j, i + 1, True, not unique[i]))
            i = j - 1
        else:
            out.append(Hop(i, i + 1, False, not unique[i]))
            i -= 1
    return out
