"""The step that all exact searches share: it asks few rows exactly and finds what asking all would find."""

import numpy as np
import pytest

from nearloom.functions import distances
from nearloom.operators import policies, search

RNG = np.random.default_rng(7)
BASE = np.concatenate([RNG.normal(size=(3_000, 24)), RNG.normal(size=(30, 24)) * 1e-12, RNG.normal(size=(20, 24)) * 1e8, RNG.normal(size=(3, 24)) * 1e60, np.full((2, 24), np.nan), np.repeat(RNG.normal(size=(1, 24)), 40, axis=0)])
QUERIES = np.concatenate([BASE[:40], BASE[3_000:3_004], BASE[3_030:3_033], BASE[-3:], RNG.normal(size=(20, 24))])
LABEL, DOC = RNG.permutation(len(BASE)), RNG.integers(0, 9, len(BASE))
POLICIES = [policies.TopK(10), policies.TopK(1), policies.TopK(9_999), policies.Radius(30.0), policies.Radius(30.0, 4), policies.Radius(30.0, 0), policies.Documents(3), policies.Documents(20)]


@pytest.mark.parametrize("space", ["l2", "ip", "cosine", distances.l1], ids=["l2", "ip", "cosine", "l1"])
@pytest.mark.parametrize("policy", POLICIES, ids=repr)
def test_a_scan_finds_what_asking_all_rows_finds(space, policy):
    radius = policy.epsilon if isinstance(policy, policies.Radius) else None
    kept = [search._Kept() for _ in QUERIES]
    for rows in np.array_split(np.arange(len(BASE)), 3):
        search._scan(kept, QUERIES, LABEL[rows], DOC[rows], BASE[rows], space, policy, radius)
    whole = np.isfinite(BASE).all(axis=1)
    label, doc, base = LABEL[whole], DOC[whole], BASE[whole]
    for q, got in zip(QUERIES, kept, strict=True):
        with np.errstate(all="ignore"):
            d = distances.pairs(space, q[None], base, np.zeros(len(base), int), np.arange(len(base)))
        order = np.lexsort((label, d))
        want = order[: policy.prefix(d[order], doc[order])]
        if isinstance(policy, policies.Radius):
            want = want[d[want] <= policy.epsilon]
        # More may be kept than the answer needs; what the policy makes of it is the same.
        n = policy.prefix(got.distance, got.doc)
        assert got.label[:n].tolist() == label[want].tolist()
        assert got.distance[:n].tolist() == d[want].tolist()


@pytest.mark.parametrize("policy", [policies.TopK(10), policies.Documents(3), policies.Radius(20.0, 5)], ids=repr)
def test_few_rows_are_asked_exactly(monkeypatch, policy):
    asked, pairs = [], distances.pairs
    monkeypatch.setattr(distances, "pairs", lambda space, q, x, i, j: asked.append(len(i)) or pairs(space, q, x, i, j))
    base, queries = BASE[:3_000], QUERIES[:40]
    search._scan([search._Kept() for _ in queries], queries, LABEL[:3_000], DOC[:3_000], base, "l2", policy, getattr(policy, "epsilon", None))
    assert 0 < sum(asked) <= 40 * 30


@pytest.mark.parametrize("space", [distances.l1, distances.l2], ids=["l1", "l2"])
@pytest.mark.parametrize("base", [BASE[:2_000], BASE[3_000:3_030], BASE[3_030:3_050], RNG.integers(0, 3, (500, 24)).astype(float), np.ones((40, 24))], ids=["usual", "tiny", "huge", "few values", "equal"])
def test_bounds_are_below_every_distance(space, base):
    queries = np.concatenate([QUERIES[:45], base[:9], 3 * base[:3]])
    low = space.below(base)(queries).astype(float)
    assert (low <= np.stack([space.kernel(q, base) for q in queries])).all()


@pytest.mark.parametrize("space", [distances.l1, distances.l2], ids=["l1", "l2"])
@pytest.mark.parametrize("policy", [policies.TopK(10), policies.Documents(3)], ids=repr)
def test_a_kernel_is_asked_for_few_pairs(space, policy):
    rows, base = [], RNG.normal(size=(16_000, 24))
    doc = np.arange(16_000) % 900
    own = distances.Distance(space.column, lambda q, x: rows.append(len(x)) or space.kernel(q, x), space.below)
    search._scan([search._Kept() for _ in range(40)], base[:40] + 0.1, np.arange(16_000), doc, base, own, policy, None)
    assert 0 < sum(rows) <= 40 * 800  # 40 * 16,000 without bounds
