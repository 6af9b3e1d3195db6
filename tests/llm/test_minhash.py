import itertools
import random
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import make, prose
from veldt.llm import common as C
from veldt.llm import minhash as M


def brute(rows, k, percent):
    """(doc_id, n, component) of every row; rows of one id are one node."""
    sets = [M.shingle_set(None if t is None else t.encode(), k) for _, t, *_ in rows]
    up = {r[0]: r[0] for r in rows if r[0] is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, x), (b, y) in itertools.combinations([(r[0], s) for r, s in zip(rows, sets, strict=True) if r[0] is not None and s], 2):
        if 100 * len(x & y) >= percent * len(x | y):
            a, b = sorted((find(a), find(b)))
            up[b] = a
    out = []
    for r, s in zip(rows, sets, strict=True):
        if r[0] is not None:
            out.append((r[0], len(s), find(r[0]) if s else r[0]))
        else:
            mates = [find(q[0]) for q, z in zip(rows, sets, strict=True) if q[0] is not None and z == s and s]
            out.append((None, len(s), min(mates, default=None)))
    return Counter(out)


def run(df, k=5):
    got = M.near_duplicates(df, k=k).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got)


@pytest.mark.parametrize("k", [2, 5])
def test_messy_rows(messy, messy_rows, k):
    assert run(messy, k) == brute(messy_rows, k, 80)


def test_empty(empty):
    assert not run(empty)


def test_chains_and_hot_buckets_lose_no_link(spark):
    """Chains of small edits (the ends are not alike), a large group of near copies, and look-alikes just under 0.8."""
    rng, rows = random.Random(3), []
    for chain in range(6):
        words = prose(rng, 80, 3000).split()
        for _ in range(12):
            rows.append((len(rows) * 7 % 1009, " ".join(words), "en", "a"))
            for _ in range(1 + chain % 4):
                words[rng.randrange(80)] = f"e{rng.randrange(10**6)}"
    words = prose(rng, 120, 3000).split()
    for _ in range(80):
        w = list(words)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
        rows.append((2000 + len(rows), " ".join(w), "en", "a"))
    old = M.ROUNDS
    try:
        for M.ROUNDS, k in ((1, 2), (old, 5)):
            assert run(make(spark, rows), k) == brute(rows, k, 80)
    finally:
        M.ROUNDS = old


@pytest.mark.parametrize(("k", "changed"), [(2, 5), (5, 3)])
def test_a_large_group_of_look_alikes_meets_few_pairs(spark, monkeypatch, k, changed):
    """Copies of one text with changed words, most pairs just under 0.8: components as by brute force, and the
    pairs compared after the pivot rounds stay far below all pairs."""
    rng, rows = random.Random(5), []
    words = prose(rng, 120, 3000).split()
    for i in range(1000):
        w = list(words)
        for j in rng.sample(range(120), changed):
            w[j] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), "en", "a"))
    made, plain = [], M._compared
    monkeypatch.setattr(M, "_compared", lambda pairs, *a: made.append(C.materialize(pairs, "pairs")) or plain(made[-1], *a))
    assert run(make(spark, rows), k) == brute(rows, k, 80)
    assert len(made) == M.ROUNDS + 3 and sum(p.count() for p in made[M.ROUNDS:]) < 0.2 * 1000 * 999 / 2


def test_min_max_votes_are_unbiased():
    rng = np.random.default_rng(0)
    err = []
    for _ in range(60):
        u = C.mix(rng.integers(0, 2**63, 1000).astype(np.uint64))
        (al, ah), (bl, bh) = M.min_max(u[:900]), M.min_max(u[100:])
        err.append(np.mean(np.concatenate([al == bl, ah == bh])) - 0.8)
    assert abs(np.mean(err)) < 0.015


def test_stage_keeps_one_row_of_each_group(messy, messy_rows):
    kept = M.drop_near_duplicates(messy)
    assert kept.columns == messy.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    want = {i for (i, n, c), _ in brute(messy_rows, 5, 80).items() if i is not None and i == c}
    assert {i for i in ids if i is not None} == want and all(n == 1 for i, n in ids.items() if i is not None) and ids[None] == 2


def test_components_of_paths_and_rings(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, 2), (2, 3), (3, 1), (9, 8), (5, 5)]
    got = {r["node"]: r["component"] for r in C.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(101, 161)) and got[2] == got[3] == 1 and got[9] == 8 and 5 not in got


def test_texts_under_one_id_are_not_lost(spark):
    """Different texts that share a doc_id: of every group of near copies one row stays, whichever id it has."""
    rng = random.Random(12)
    one, two, three = (prose(rng, 60, 4000) for _ in range(3))
    near = " ".join([*two.split()[:-1], "end"])
    rows = [(5, one, "en", "a"), (5, two, "en", "a"), (3, one, "en", "a"), (8, two, "en", "a"), (9, near, "en", "a"),
            (7, three, "en", "a"), (7, one + " " + two, "en", "a"), (7, three, "en", "b"), (7, "", "en", "a")]
    for part in (rows, rows[:3], rows[:2], rows[5:]):
        df = make(spark, part)
        left = M.drop_near_duplicates(df, k=5)
        assert left.columns == df.columns
        want = Counter({(3 if len(part) != 2 else 5, one): 1, (5, two): 1, (7, three): 1, (7, one + " " + two): 1, (7, ""): 1})
        held = {t for _, t, *_ in part}
        assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter({x: n for x, n in want.items() if x[1] in held})
