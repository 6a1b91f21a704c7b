"""Why every pair of neighbouring lines is a chunk of ``lines``: what boundaries that a rolling hash chooses would leave.

A plain version of the other choice: a boundary stands after a line where a hash over the last two lines is 0 modulo ``mean``, chunks of two lines or more that
stand earlier are found by their lines, and a hit grows line by line to the whole common run.
"""

import random

import pytest

from sheaf.llm import lines


def grown(docs, mean):
    """Removed lines of each document, with chosen boundaries."""
    first, out = {}, []
    for d, own in enumerate(docs):
        cuts = [0, *(i + 1 for i in range(1, len(own) - 1) if hash((own[i - 1], own[i])) % mean == 0), len(own)]
        gone = set()
        for a, b in zip(cuts, cuts[1:]):  # noqa: B905
            e, p = first.setdefault(tuple(own[a:b]), (d, a))
            if b - a < 2 or (e, p) == (d, a):
                continue
            other, x, y = docs[e], 0, 0
            while min(a, p) - x > 0 and own[a - x - 1] == other[p - x - 1]:
                x += 1
            while b + y < len(own) and p + b - a + y < len(other) and own[b + y] == other[p + b - a + y]:
                y += 1
            gone |= set(range(a - x, b + y))
        out.append(gone)
    return out


@pytest.mark.parametrize(("mean", "length", "most"), [(2, 2, 0.01), (2, 5, 0.6), (4, 5, 0.35), (8, 13, 0.6)])
def test_chosen_boundaries_leave_short_passages(mean, length, most):
    rng = random.Random(mean * 100 + length)
    passages = [[f"p{i} {k} {rng.random()}" for k in range(length)] for i in range(400)]
    docs = [[f"head {i} {j}", *passages[i], f"tail {i} {j}"] for j in (0, 1) for i in range(400)]
    whole = set(range(1, length + 1))
    assert sum(whole <= g for g in grown(docs, mean)[400:]) / 400 <= most
    # as the operator chooses chunks, every line of a passage is in one that is the passage's alone
    first, n, *_ = lines.chunks("\n".join(docs[-1]))
    inside = {k for a, m in zip(first.tolist(), n.tolist(), strict=True) if a >= 1 and a + m <= length + 1 for k in range(a, a + m)}
    assert inside == whole
