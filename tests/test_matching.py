"""The banded matching against all placements, its prices, and its memory."""

import itertools
import random
import tracemalloc

import numpy as np

from dialoom.operators import matching


def best_total(first, cost, columns):
    """The least total over all placements, by sets of taken columns."""
    states = {frozenset(): 0.0}
    for i in range(len(cost)):
        after = {}
        for taken, total in states.items():
            options = [(j, cost[i, k]) for k in range(cost.shape[1]) if np.isfinite(cost[i, k]) and (j := first[i] + k) not in taken]
            for j, c in [*options, (None, matching.UNPLACED)]:
                key = taken if j is None else taken | {j}
                after[key] = min(after.get(key, np.inf), total + c)
        low = first[i + 1] if i + 1 < len(cost) else 0
        states = {}
        for taken, total in after.items():
            key = frozenset(j for j in taken if j >= low)
            states[key] = min(states.get(key, np.inf), total)
    return min(states.values())


def test_random_bands_with_ties_and_forbidden_pairs():
    rng = random.Random(7)
    for case in range(1000):
        n, width = rng.randint(1, 8), rng.randint(1, 5)
        first = np.array(sorted(rng.randint(0, 6) for _ in range(n)))
        cost = np.array([[rng.choice([0.0, 0.5, 1.0, 1.0, 2.0, rng.random(), np.inf]) for _ in range(width)] for _ in range(n)])
        columns, price, column_price = matching.place(first, cost)
        placed = [j for j in columns if j >= 0]
        assert len(set(placed)) == len(placed)
        total = sum(cost[i, j - first[i]] if j >= 0 else matching.UNPLACED for i, j in enumerate(columns))
        assert abs(total - best_total(first.tolist(), cost, 12)) < 1e-6, case
        assert all(p <= 0 for p in column_price.values()) and set(column_price) <= set(placed)
        assert abs(total - price.sum() - sum(column_price.values())) < 1e-6
        for i, k in itertools.product(range(n), range(width)):
            assert price[i] + column_price.get(int(first[i]) + k, 0.0) <= cost[i, k] + 1e-6


def test_a_talkative_stream_stays_small():
    """50,000 frames that all speak."""
    n, rng = 50_000, random.Random(3)
    gen, ref = ["g"] * n, ["r" if rng.random() < 0.7 else "" for _ in range(n)]
    tracemalloc.start()
    rows = matching.match_sample(gen, ref, -4, 2, lambda a, b: np.linspace(0, 1, len(a)) % 0.3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500 << 20
    assert sum(r[0] != "missed" for r in rows) == n


def test_no_frame_and_no_reference():
    assert matching.match_sample([], [], -4, 2) == []
    assert matching.match_sample(["", ""], ["a", ""], -1, 1) == [("missed", None, 0, None, None)]
    assert [r[0] for r in matching.match_sample(["x"], [""], -1, 1)] == ["redundant"]
    assert matching.match_sample(["x"], ["y"], 1, 2)[0][:3] == ("redundant", 0, None)
