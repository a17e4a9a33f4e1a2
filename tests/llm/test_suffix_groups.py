"""The linear grouping construction against sorting."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerstone.llm.suffix_groups import order, order_one


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=40), min_size=1, max_size=6))
def test_order(lanes):
    lanes = [np.array([*x, 0]) for x in lanes]
    edges = np.cumsum([0, *map(len, lanes)])
    got = order(np.concatenate(lanes), edges)
    for k, x in enumerate(lanes):
        want = sorted(range(len(x)), key=lambda i: x[i:].tolist())
        assert (got[edges[k] : edges[k + 1]] - edges[k]).tolist() == want
        assert order_one(x).tolist() == want
