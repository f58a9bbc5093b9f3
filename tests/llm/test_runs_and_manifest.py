"""Periodic runs and the Merkle manifest against plain versions."""

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

pytest.importorskip("tidemark.llm.queries")
import numpy as np

from tidemark.llm import merkle, periodic_runs


def plain_runs(w, least, times):
    """Maximal stretches for each period; of one stretch, the smallest period."""
    n, found = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] == w[i + q]:
                j = i
                while j + q < n and w[j] == w[j + q]:
                    j += 1
                if j - i >= q:
                    found.setdefault((i, j - i + q), q)
                i = j
            i += 1
    return sorted((s, m, q) for (s, m), q in found.items() if m >= max(least, times * q))


@pytest.mark.parametrize(("least", "times"), [(24, 3), (6, 2), (2, 2), (10, 3)])
@pytest.mark.parametrize("lookups", [1_000_000, 40])
def test_runs_equal_brute_force(monkeypatch, least, times, lookups):
    monkeypatch.setattr(periodic_runs, "LOOKUPS", lookups)
    r = random.Random(least + lookups)
    for _ in range(60):
        texts = []
        for _ in range(r.randrange(1, 6)):
            w = [r.randrange(r.choice([1, 2, 3, 10])) for _ in range(r.randrange(90))]
            if w and r.random() < 0.7:
                a, p = r.randrange(len(w)), r.randrange(1, 12)
                for i in range(a, r.randrange(a, len(w) + 1)):
                    w[i] = w[a + (i - a) % p]
            texts.append(w)
        got = periodic_runs.find_runs([np.array(w, np.int64) for w in texts], least, times)
        assert [[tuple(x) for x in g.tolist()] for g in got] == [plain_runs(w, least, times) for w in texts]


def test_runs_rows(spark, monkeypatch):
    monkeypatch.setattr(periodic_runs, "TOGETHER", 50)
    long = "x y z " * 3000 + "end"
    texts = [None, "", " \n\t", "a " * 30, "a " * 30, "a b " * 11, "é\tü\n" * 20 + "tail", long, "one two three"]
    docs = spark.createDataFrame([(k, t, "s", 1) for k, t in enumerate(texts)] + [(None, "a " * 24, "s", 2)], "doc_id long, text string, start string, n_words int").repartition(2)
    got = {r.doc_id: r for r in docs.withColumn("found", periodic_runs.runs(F.col("text"))).collect()}
    runs = lambda k: list(zip(got[k].found.start, got[k].found.length, got[k].found.period, strict=True))
    for k, text in enumerate(texts):
        words = (text or "").split()
        assert got[k].start == "s" and got[k].found.n_words == len(words)
        if k != 7:
            assert runs(k) == plain_runs(words, 24, 3)
    assert runs(7) == [(0, 9000, 3)] and got[7].found.collapsed == "x y z end"
    assert (got[3].found.collapsed, got[5].found.collapsed, got[6].found.collapsed, got[1].found.collapsed) == ("a", "a b " * 10 + "a b", "é ü tail", "")
    assert runs(None) == [(0, 24, 1)]
    none = docs.limit(0).select("doc_id", periodic_runs.runs(F.col("text")).alias("found"))
    assert none.collect() == []


def plain_proofs(rows):
    """Root and, for each row, its leaf, subroot, siblings and the root its claimed leaf folds to."""
    h = lambda xs: sha256("".join(xs).encode()).hexdigest()
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)

    def trails(leaves):
        level, at, out = leaves, list(range(len(leaves))), [[] for _ in leaves]
        while len(level) > 1:
            for k, p in enumerate(at):
                run = level[p - p % 3 : p - p % 3 + 3]
                out[k].append((run[: p % 3], run[p % 3 + 1 :]))
            level, at = [h(level[k : k + 3]) for k in range(0, len(level), 3)], [p // 3 for p in at]
        return level[0], out

    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    per = {}
    for g in names:
        own = sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[2]))
        per[g] = (own, *trails([x[2] for x in own]))
    root, above = trails([per[g][1] for g in names])
    out = []
    for g, up in zip(names, above, strict=True):
        own, subroot, below = per[g]
        for (i, _, leaf, claimed), path in zip(own, below, strict=True):
            path = path + up
            now = claimed or leaf
            for before, after in path:
                now = h([*before, now, *after])
            out.append((i, leaf, subroot, root, h([x for b, a in path for x in (*b, *a)]), now, now == root))
    return out


@pytest.mark.parametrize("most", [1, 2, 6])
def test_manifest_equals_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(merkle, "MOST", most)
    r = random.Random(most)
    sizes = {None: 1, "": 2, "a": 3, "b": 4, "é": 27, "Z": 28, "hot": 250}
    rows = [(r.choice([None, *range(200)]), g, sha256(str(r.randrange(1000)).encode()).hexdigest(), r.choice([None, "00" * 32])) for g, n in sizes.items() for _ in range(n)]
    leaves = spark.createDataFrame(rows, "doc_id long, source string, leaf string, claimed string").repartition(3)
    made = merkle.manifest(leaves)
    got = sorted(map(tuple, merkle.proofs(made).collect()), key=str)
    assert got == sorted(plain_proofs(rows), key=str)
    assert max(len(merkle.block_heights(6)), 1) == {1: 6, 2: 4, 6: 1}[most]
    assert all(len(x.nodes) <= 32 * merkle.size(most + 1) for x in made.groups[0].collect())
    made.discard()


def test_manifest_cases(spark):
    docs = spark.createDataFrame([(1, None, None, None, ""), (1, None, None, None, None), (2, "s", "en", 3, "a\nb")], "doc_id long, source string, lang string, n_chars long, text string")
    leaf = merkle.digest({c: F.col(c) for c in merkle.FIELDS})
    got = [x.leaf for x in docs.select(leaf.alias("leaf")).collect()]
    assert got == [sha256(x.encode()).hexdigest() for x in ("1:1---0:", "1:1----", "1:21:s2:en1:33:a\nb")]
    none = docs.limit(0).select("doc_id", "source", leaf.alias("leaf"))
    made = merkle.manifest(none)
    assert made.root is None and merkle.proofs(made).collect() == []
    one = merkle.manifest(docs.where("doc_id = 2").select("doc_id", "source", leaf.alias("leaf")))
    row = merkle.proofs(one).first()
    assert row.verified and {row.leaf, row.subroot, row.root} == {got[2]} and row.proof_sha256 == sha256(b"").hexdigest()


def test_layout_is_a_permutation():
    for levels in range(1, 8):
        places = np.concatenate([merkle.address(levels, d, np.arange(3**d)) for d in range(levels)])
        assert sorted(places.tolist()) == list(range(merkle.size(levels)))
    # A subtree of the lower half lies in one piece.
    low = merkle.address(4, 2, np.arange(9)).tolist()
    assert low == [4 * k + 4 for k in range(9)]


def test_crc_in_sql():
    import duckdb

    from tidemark.llm.queries import _crc32_sql

    for x in (0, 7, 123456789, -5):
        assert duckdb.sql(f"SELECT {_crc32_sql('x')} FROM (SELECT {x} AS x)").fetchall()[0][0] == zlib.crc32(str(x).encode())
