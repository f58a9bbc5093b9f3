"""Links between sets, MinHash signatures and near-duplicates, against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("tidemark.llm.queries")
import numpy as np

from tidemark.llm import minhash, set_links

SHAPES = ["template", "slots", "chain", "mixed", "sizes", "copies"]


def sets_of(shape, seed):
    """Sets that meet under few elements: versions of one template with one change or several, chains, parts of a whole."""
    r = random.Random(seed)
    base = list(range(100, 156))
    fresh = iter(range(10_000, 1_000_000))
    out = []
    for k in range(130):
        s = list(base)
        if shape == "template":
            at = r.randrange(52)
            s[at : at + 5] = [next(fresh) for _ in range(5)]
        elif shape == "slots":
            for at in r.sample(range(52), 2):
                s[at : at + 5] = [next(fresh) for _ in range(5)]
        elif shape == "chain":
            s = list(range(k, k + 40))
        elif shape == "mixed":
            n = r.choice([0, 1, 3, 6, 9, 12])
            for at in r.sample(range(56), n):
                s[at] = r.choice([next(fresh), 5000 + r.randrange(6)])
        elif shape == "sizes":
            s = r.sample(base, r.randrange(40, 57)) + [5000 + r.randrange(30) for _ in range(r.randrange(6))]
        else:
            s = s[: r.choice([56, 50, 46, 45])]
        out.append(sorted(set(s)))
    return out


def plain_roots(sets, percent):
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = set(sets[a]), set(sets[b])
            if 100 * len(x & y) >= percent * len(x | y):
                i, j = sorted((find(a), find(b)))
                root[j] = i
    return [find(k) for k in range(len(sets))]


@pytest.mark.parametrize(("few", "rounds"), [(32, 12), (4, 0), (4, 2)])
def test_crowd_equals_all_pairs(spark, monkeypatch, few, rounds):
    """Shapes with elements of their own, in one crowd; with few rounds more is left to pairs and differences."""
    monkeypatch.setattr(set_links, "FEW", few)
    monkeypatch.setattr(set_links, "ROUNDS", rounds)
    sets = [[10_000_000 * k + x for x in s] for k, shape in enumerate(SHAPES) for s in sets_of(shape, k)]
    df = spark.createDataFrame(list(enumerate(sets)), "p long, s array<long>").repartition(4)
    got = {x.p: x.root for x in set_links.crowd_roots(df.select("p", F.col("p").alias("root")), df, 0.8).collect()}
    want = plain_roots(sets, 80)
    assert [got[k] for k in range(len(sets))] == want and 50 < len(set(want)) < len(sets) - 50


def test_template_is_linear(spark, monkeypatch):
    """One component for each place of a template, found with centres: what is compared grows with the lines, not with their pairs."""
    made = []
    verified = set_links.verified
    monkeypatch.setattr(set_links, "verified", lambda pairs, sets, s: (made.append(pairs.count()), verified(pairs, sets, s))[1])
    seen = {}
    for n in (400, 1600):
        r = random.Random(n)
        fresh = iter(range(10_000, 10_000_000))
        lines = []
        for _ in range(n):
            s, at = list(range(100, 156)), r.randrange(52)
            s[at : at + 5] = [next(fresh) for _ in range(5)]
            lines.append(sorted(s))
        df = spark.createDataFrame(list(enumerate(lines)), "p long, s array<long>").repartition(4)
        made.clear()
        got = set_links.crowd_roots(df.select("p", F.col("p").alias("root")), df, 0.8)
        assert got.select("root").distinct().count() == 1
        seen[n] = sum(made)
    assert seen[1600] < 6 * seen[400] and seen[1600] < 1600 * 200


def test_signatures():
    r = np.random.default_rng(4)
    sets = [r.integers(0, 2**63, n).astype(np.uint64) for n in (1, 2, 5, 40, 400, 3000)]
    signed = minhash.signatures(np.concatenate(sets), np.array([len(x) for x in sets]))
    assert (signed != np.iinfo(np.uint64).max).all() and len(set(signed[0])) == 1
    again = minhash.signatures(np.concatenate([x[::-1] for x in sets]), np.array([len(x) for x in sets]))
    assert (again == signed).all()
    # Bins agree as often as the sets do, small sets included.
    for n in (12, 40, 400):
        agree = []
        for _ in range(60):
            both, a, b = (r.integers(0, 2**63, k).astype(np.uint64) for k in (n, n // 4, n // 4))
            x = minhash.signatures(np.concatenate([both, a, both, b]), np.array([n + n // 4] * 2))
            agree.append((x[0] == x[1]).mean())
        assert abs(np.mean(agree) - 1 / 1.5) < 0.05


def plain_near(rows, percent=85, size=3):
    words = [(t or "").encode().lower().split() for _, t in rows]
    sets = [{tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set() for w in words]
    full = [k for k, s in enumerate(sets) if s]
    roots = plain_roots([sets[k] for k in full], percent)
    least = {}
    for k, root in zip(full, roots, strict=True):
        least.setdefault(root, []).append(rows[k][0])
    root_of = dict(zip(full, roots, strict=True))
    name = lambda k: min((x for x in least[root_of[k]] if x is not None), default=None) if k in root_of else rows[k][0]
    return sorted(((i, len(sets[k]), name(k), name(k) is not None and name(k) == i) for k, (i, _) in enumerate(rows)), key=str)


def test_near_duplicates(spark):
    r = random.Random(9)
    base = [f"w{r.randrange(300)}" for _ in range(120)]
    rows = [(5, " ".join(base)), (3, " ".join(base).upper()), (3, "x " + " ".join(base)), (None, " ".join(base) + " end"), (None, "alone here and now"), (None, None), (8, ""), (9, " \n"), (10, "two words"), (11, "Two\tWORDS"), (12, "two"), (13, "a " * 50), (14, "a " * 60)]
    for k in range(20, 90):
        text = list(base)
        for at in r.sample(range(120), r.choice([1, 2, 3, 4, 5])):
            text[at] = f"v{r.randrange(1000)}"
        rows.append((k, " ".join(text)))
    rows += [(100 + k, " ".join([f"u{j}" for j in range(k, k + 30)])) for k in range(0, 40)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, p string, n int").repartition(5)
    got = sorted(map(tuple, minhash.near_duplicates(docs).collect()), key=str)
    assert got == plain_near(rows)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
