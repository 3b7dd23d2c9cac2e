"""House effects against a sum over pairs of polls, and permutation tests in both forms."""

import random
from collections import defaultdict

import numpy as np
import pytest

from votelake.operators import polls, spatial


def brute_effects(rows, settings):
    """By the definition: every poll against every other house's poll."""
    groups = defaultdict(list)
    for cutoff, candidate, house, age, share, base, quality in rows:
        groups[cutoff, candidate].append((house, age, share, base, quality))
    out = {}
    for key, own in groups.items():
        effect = {h: 0.0 for h, *_ in own}
        for _ in range(settings.iterations):
            resid = defaultdict(list)
            for h, age, share, *_ in own:
                w = [(0.5 ** (abs(age - a) / settings.half) * b, x - effect[g]) for g, a, x, b, _ in own if g != h]
                total = sum(v for v, _ in w)
                resid[h].append(share - sum(v * x for v, x in w) / total if total else 0.0)
            quality = {h: max(q for g, *_, q in own if g == h) for h in effect}
            mean = {h: sum(r) / (len(r) + settings.shrink) for h, r in resid.items()}
            anchor = {h: quality[h] * len(resid[h]) for h in effect}
            centre = sum(mean[h] * anchor[h] for h in effect) / sum(anchor.values())
            effect = {h: mean[h] - centre for h in effect}
        out |= {(*key, h): e for h, e in effect.items()}
    return out


def test_house_effects_equal_the_pairs(spark):
    rng = random.Random(8)
    settings = polls.PollSettings()
    rows = [(c, cand, f"house {h}", rng.randrange(46), rng.random(), rng.random() + 0.1, 0.5 + h / 10) for c in (1, 2) for cand in "ab" for h in range(5) for _ in range(rng.randrange(1, 8))]
    rows += [(3, "a", "alone", 4, 0.4, 1.0, 1.0), (3, "a", "alone", 9, 0.6, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "cutoff int, candidate string, house string, age int, share double, base double, quality double")
    got = {(r["cutoff"], r["candidate"], r["house"]): r["effect"] for r in polls.house_effects(df, settings, ["cutoff"]).collect()}
    want = brute_effects(rows, settings)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


@pytest.mark.parametrize("star", [False, True])
def test_permutations_in_tasks_equal_those_of_rows(spark, monkeypatch, star):
    rng = np.random.default_rng(1)
    n = 60
    values = spark.createDataFrame([(i * 3, float(x)) for i, x in enumerate(rng.normal(size=n))] + [(999, None)], "node long, x double")
    edges = [(i * 3, j * 3) for i in range(n) for j in {(i + k) % n for k in rng.integers(1, n, 1 + i % 9).tolist()} if i != j]
    links = spark.createDataFrame(edges, "src long, dst long")
    run = lambda: [(r[0], *(round(v, 9) for v in r[1:5]), r[5]) for r in sorted(map(tuple, spatial.local_clusters(values, links, 50, 7, 0.1, star).collect()))]
    in_tasks = run()
    monkeypatch.setattr(spatial, "HELD_DRAWS", 16)
    monkeypatch.setattr(spatial, "TASK_DRAWS", 500)
    assert run() == in_tasks
    monkeypatch.setattr(spatial, "BROADCAST_NODES", 0)
    assert run() == in_tasks and len(in_tasks) == n
