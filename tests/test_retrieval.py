"""Block search against a full sort: ties, copies, zero and odd vectors; what is ranked in full."""

import numpy as np
import pandas as pd

from plumbline.operators import retrieval as N


def plain(v, k):
    norm = np.linalg.norm(v, axis=1)
    scale = norm[:, None] * norm
    sims = np.divide(np.einsum("id,jd->ij", v, v), scale, out=np.zeros_like(scale), where=scale > 0)
    return {q: sorted((j for j in range(len(v)) if j != q), key=lambda j: (-round(sims[q, j], 12), j))[:k] for q in range(len(v))}


def test_nearest_with_copies_and_zero_vectors_equals_full_sort(monkeypatch):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(700, 16)).astype("float32").astype("float64")
    v[50], v[200:500], v[600] = 0, v[7], -v[6]
    rows = pd.DataFrame({"id": range(len(v)), "v": list(v)}).sample(frac=1, random_state=1)
    for pairs in (50_000, 37):  # candidates of a query may be cut
        monkeypatch.setattr(N, "PAIRS", pairs)
        got = N._nearest(rows, rows, 16, 5, True)
        assert {q: list(g["id"]) for q, g in got.groupby("query_id")} == plain(v, 5)


def test_few_entries_are_ranked_in_full():
    """Before, every entry of a block was sorted; copies of a vector must not bring that back."""
    sims = np.random.default_rng(1).normal(size=(64, 20_000)).astype("float32")
    rows, cols = N._candidates(sims, 5, 1e-5)
    assert len(rows) < 64 * 40
    best = np.argsort(-sims, axis=1)[:, :5]
    assert all(set(best[i]) <= set(cols[rows == i]) for i in range(64))


def test_odd_components_take_no_part_and_an_empty_side_has_no_rows():
    rows = pd.DataFrame({"id": [1, 2, 3, 4], "v": [[1.0, 0.0], [0.9, 0.1], [float("nan"), 1.0], [float("inf"), 1.0]]})
    got = N._nearest(rows, rows, 2, 5, True)
    assert sorted(zip(got["query_id"], got["id"])) == [(1, 2), (2, 1)]
    assert len(N._nearest(rows.iloc[2:], rows.iloc[2:], 2, 5, False)) == 0
