"""What corpus operators ask of the driver: rounds of components, and garbage that is let go."""

import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("tidemark.llm.queries")
from tidemark.llm import components, line_crf, simhash


def rooted(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def stored(spark, monkeypatch, edges):
    """The components of ``edges`` and how many tables were written for them."""
    names = []
    monkeypatch.setattr(components, "store", lambda df, name, f=components.store: names.append(name) or f(df, name))
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    monkeypatch.undo()
    assert len(got) == len({r.node for r in got})
    return {r.node: r.root for r in got}, len(names)


def test_stars_take_one_round(spark, monkeypatch):
    star = [(50, k) for k in range(40, 60) if k != 50] + [(7, 8)]
    got, tables = stored(spark, monkeypatch, star)
    assert got == rooted(star)
    assert tables == 2


def test_components(spark, monkeypatch):
    r = random.Random(5)
    chain = [(k + 1, k) for k in range(100, 140)]
    some = [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(35)]
    some = [(a, b) for a, b in some if a != b]
    assert stored(spark, monkeypatch, [*chain, *some, *chain[:3]])[0] == rooted(chain + some)
    assert stored(spark, monkeypatch, [(3, 3), (None, 1), (2, None)]) == ({}, 1)


def collections(spark):
    """How often the driver's whole heap was collected."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())


@pytest.mark.parametrize("what", ["learn", "similar"])
def test_driver_lets_go(spark, what):
    words = ["alpha beta gamma delta epsilon zeta eta theta"] * 3 + ["one two three four five six seven"] * 3
    docs = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    before = collections(spark)
    if what == "learn":
        line_crf.learn(docs, docs.selectExpr("doc_id", "int(doc_id % 2) AS quality"), F.lit(True))
    else:
        simhash.similar_documents(docs)
    assert collections(spark) > before
