"""Links between sets that are alike: buckets of candidates, exact Jaccard similarity, components.

In a bucket every set is compared with the bucket's most frequent one; those that are alike
to it are in one component whatever else they are alike to. Where a bucket is left with
several components, its sets are a crowd, and all links inside the crowd are found that join
components, without comparing all pairs:

* Sets that are alike share one of their early elements in the order of rarity (``_early``).
* Elements that up to ``FEW`` sets of the crowd have early give pairs, less those that the
  places of the element rule out.
* Elements that more sets have early (the words of a template) are first thinned: round after
  round all sets under one are compared with centres, a set of each of ``CENTRES`` components
  that a hash picks, as long as many of them are alike. So lines of one template fall into few
  components.
* What is left under such an element is coded by its difference from the largest of its sets.
  Two sets of which one at least is not alike to that set are themselves alike only if their
  differences share an element early enough, rare ones first (``_by_difference``). What all
  share with the template, or with the largest set, is in no early place.

Every link is taken from the exact similarity of whole sets; what is left out cannot be alike,
or joins what is joined already. No step makes more rows than there are elements, but for
pairs under one early element.

Defined cases: a set in no bucket, and an empty set, have no link; sets that are equal are
alike; no rows give no links; what nothing links is not in the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .memory import release
from .storage import discard, store

#: Sets under one early element up to which their pairs are taken.
FEW = 32
#: Most rounds that compare with centres, and centres of one. Rounds end sooner where fewer than one in ``WORTH`` of the compared are alike.
ROUNDS, CENTRES, WORTH = 8, 4, 25


def _percent(similarity: float) -> int:
    return round(similarity * 100)


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``pairs`` (a, b) with ``alike``, by the whole sets (p, s) of distinct elements."""
    left = sets.select(F.col("p").alias("a"), F.col("s").alias("x"))
    right = sets.select(F.col("p").alias("b"), F.col("s").alias("y"))
    common = F.size(F.array_intersect("x", "y")).cast("long")
    union = F.size("x") + F.size("y") - common
    return pairs.join(right, "b").join(left, "a").select("a", "b", (100 * common >= _percent(similarity) * union).alias("alike"))


def _ranked(sets: DataFrame) -> DataFrame:
    """``p, size, own, l`` of ``sets`` (p, s): ``own`` elements no other set has, the others as (n, x) in the order of the number n of sets that have them."""
    elements = sets.select("p", F.size("s").alias("size"), F.explode("s").alias("x"))
    often = elements.groupBy("x").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = elements.join(often, "x").groupBy("p", "size").agg(F.sort_array(F.collect_list(F.struct("n", "x"))).alias("l"))
    return rows.withColumn("own", F.col("size") - F.size("l"))


def _early(ranked: DataFrame, similarity: float) -> DataFrame:
    """``p, size, left, x``: elements of which alike sets share one, with the number of a set's elements from there on.

    Alike sets of m and n elements share similarity / (1 + similarity) x (m + n) or more, so the
    first shared one comes before place m - similarity x m of the one and n - similarity x n of
    the other. Elements of one set only come first, and are shared by none.
    """
    most = F.floor(F.col("size") * (100 - _percent(similarity)) / 100 + 1e-9).cast("int") + 1
    early = ranked.where(most > F.col("own")).select("p", "size", "own", F.posexplode(F.slice("l", F.lit(1), most - F.col("own"))).alias("at", "t"))
    return early.select("p", "size", (F.col("size") - F.col("own") - F.col("at")).alias("left"), F.col("t.x").alias("x"))


def _mixed(rows: DataFrame, by: str = "x") -> DataFrame:
    """The ``by`` under which ``rows`` (by, p, root) have several roots, with ``n``, the number of rows."""
    return rows.groupBy(by).agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select(by, "n")


def _pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of ``rows`` (x, p, root, size, left) with one element and other roots that the places do not rule out."""
    one = rows.select(F.col("p").alias("a"), F.col("root").alias("r"), F.col("size").alias("m"), F.col("left").alias("u"), "x")
    two = rows.select(F.col("p").alias("b"), F.col("root").alias("t"), F.col("size").alias("n"), F.col("left").alias("v"), "x")
    fits = (F.col("r") < F.col("t")) & (F.least("u", "v") >= similarity / (1 + similarity) * (F.col("m") + F.col("n")) - 1e-9)
    return one.join(two, "x").where(fits).select("a", "b").distinct()


def _by_difference(hot: DataFrame, ranked: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """From ``hot`` (x, p, root, size): links (a, b) with the largest set under each element, and pairs (a, b) to be compared.

    With k = (1 - similarity) / (1 + similarity), sets are alike if they differ in k x (sum of
    their sizes) elements or fewer. Let c be the largest set under an element and d the number of
    elements in which a set differs from it. Two sets of sizes m, n that differ from c in d, e
    elements share (d + e - k (m + n)) / 2 of these or more if they are alike. That is above zero
    if one of them is not alike to c, and bounds the places of the first shared one on both sides.

    A difference is ordered by what few others are likely to share: first elements that only the
    set has; then those that c has not, by the number of sets that have them, and those that c
    has and the set lacks, by the number of members less that; last those that only c has, which
    all lack and which stand together as one.
    """
    p = _percent(similarity)
    k = (100 - p) / (100 + p)
    centre = hot.groupBy("x").agg(F.max(F.struct("size", "p", "root")).alias("c")).select("x", F.col("c.p").alias("g"), F.col("c.root").alias("g_root"))
    # Elements with the same largest set are one group: a set is in it once, and no member is larger.
    rows = store(hot.join(centre, "x").select("g", "g_root", "p", "root").distinct().where("p != g"), "set-groups")
    rows = rows.join(rows.groupBy("g").agg(F.count(F.lit(1)).alias("members")), "g")
    rows = rows.join(ranked.select("p", "own", "l", F.col("size").alias("m")), "p").join(ranked.select(F.col("p").alias("g"), F.col("own").alias("g_own"), F.col("l").alias("gl"), F.col("size").alias("mc")).hint("merge"), "g")
    element = "struct<n:bigint,k:int,x:bigint>"
    more = F.transform(F.array_except("l", "gl"), lambda t: F.struct(t["n"].alias("n"), F.lit(0).alias("k"), t["x"].alias("x")).cast(element))
    less = F.transform(F.array_except("gl", "l"), lambda t: F.struct((F.col("members") - t["n"]).alias("n"), F.lit(1).alias("k"), t["x"].alias("x")).cast(element))
    last = F.when(F.col("g_own") > 0, F.array(F.struct(F.col("members").alias("n"), F.lit(2).alias("k"), F.lit(0).alias("x")).cast(element))).otherwise(F.array().cast(f"array<{element}>"))
    rows = rows.withColumns({"more": more, "less": less})
    rows = rows.withColumn("d", F.col("own") + F.col("g_own") + F.size("more") + F.size("less")).withColumn("l", F.concat(F.sort_array(F.concat("more", "less")), last))
    near = (100 + p) * F.col("d").cast("long") <= (100 - p) * (F.col("m") + F.col("mc")).cast("long")
    rows = rows.withColumn("near", near).withColumn("now", F.when(near, F.col("g_root")).otherwise(F.col("root")))
    m, mc, d, most = F.col("m"), F.col("mc"), F.col("d"), F.least(F.col("m") * 100 / p, F.col("mc"))
    # A partner of n elements differs from c in mc - n or more.
    any_ = (d + mc - most - k * (m + most)) / 2
    # With a partner that differs in as many elements or more, and with one that differs in as many or fewer.
    low = F.greatest(any_, d - k * (m + most) / 2, F.when(F.col("near"), (d + k * (mc - m)) / 2))
    high = F.greatest(any_, F.when(F.col("near"), (d + k * (mc - m)) / 2))
    front = lambda need: F.slice("l", F.lit(1), F.greatest(F.lit(0), d - F.greatest(F.lit(1), F.ceil(need - 1e-9)).cast("int") + 1 - F.col("own")))
    rows = store(rows.select("g", "g_root", "p", "root", "now", "m", "d", "near", "own", front(low).alias("low"), front(high).alias("high")), "set-differences")
    links = rows.where("near AND root != g_root").select(F.col("g").alias("a"), F.col("p").alias("b")).distinct()
    # Groups that are one component by now need no more; c itself is in its own.
    open_ = _mixed(rows.select("g", F.col("now").alias("root")).unionByName(rows.select("g", F.col("g_root").alias("root"))), "g").select("g")
    rows = rows.join(open_, "g", "left_semi")
    place = (F.col("d") - F.col("own") - F.col("at")).alias("left")
    one = rows.select("*", F.posexplode("low").alias("at", "t")).select("g", "t", F.col("p").alias("a"), F.col("now").alias("r"), F.col("m").alias("ma"), F.col("d").alias("da"), F.col("near").alias("na"), place.alias("u"), "low")
    two = rows.select("*", F.posexplode("high").alias("at", "t")).select("g", "t", F.col("p").alias("b"), F.col("now").alias("s"), F.col("m").alias("mb"), F.col("d").alias("db"), F.col("near").alias("nb"), place.alias("v"), "high")
    ordered = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    fits = (F.col("r") != F.col("s")) & ordered & ~(F.col("na") & F.col("nb")) & (F.least("u", "v") >= (F.col("da") + F.col("db") - k * (F.col("ma") + F.col("mb"))) / 2 - 1e-9)
    # Sets that share several elements early meet at the first of them only.
    fits = fits & (F.get(F.array_intersect("low", "high"), F.lit(0)) == F.col("t"))
    # Repeated fronts shrink in a shuffle, so its size would make Spark broadcast what is large.
    return links, one.hint("merge").join(two, ["g", "t"]).where(fits).select("a", "b").distinct()


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (p, root) with the components joined that ``links`` (a, b) connect."""
    for end in ("a", "b"):
        links = links.join(roots.select(F.col("p").alias(end), F.col("root").alias(f"{end}_root")), end)
    tops = connected_components(links.select(F.col("a_root").alias("a"), F.col("b_root").alias("b")))
    return roots.join(tops.withColumnRenamed("node", "of").withColumnRenamed("root", "top"), F.col("root") == F.col("of"), "left").select("p", F.coalesce("top", "root").alias("root"))


def crowd_roots(crowd: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``(p, root)`` of ``crowd`` (p, root) with all components joined that alike sets connect."""
    ranked = store(_ranked(crowd.select("p").join(sets, "p")), "set-ranked")
    early = store(_early(ranked, similarity), "set-elements")
    roots = crowd
    link = lambda pairs: verified(pairs, sets, similarity).where("alike").select("a", "b")
    now = lambda: early.join(roots, "p").select("x", "p", "root", "size", "left")
    for turn in range(ROUNDS):
        rows = now()
        hot = _mixed(rows).where(F.col("n") > FEW).select("x")
        rows = rows.join(hot, "x", "left_semi").select("x", "p", "root")
        # The hash is the same under each element, so sets with many of them meet the same centres.
        pick = F.struct(F.xxhash64("root", F.lit(turn)).alias("h"), F.xxhash64("p", F.lit(turn)).alias("o"), "p", "root")
        centres = rows.groupBy("x", F.pmod(pick["h"], F.lit(CENTRES)).alias("k")).agg(F.min(pick).alias("c")).select("x", F.col("c.p").alias("a"), F.col("c.root").alias("c_root"))
        pairs = rows.join(centres, "x").where("root != c_root").select("a", F.col("p").alias("b")).distinct()
        stars = store(verified(pairs, sets, similarity), "set-stars")
        links = stars.where("alike").select("a", "b")
        compared, alike = stars.agg(F.count(F.lit(1)), F.count_if("alike")).first()
        if alike:
            before, roots = roots, store(_joined(roots, links), "set-roots")
            if turn:
                discard(before)
        discard(stars)
        release(crowd.sparkSession)
        if WORTH * alike < compared or not alike:
            break
    rows = store(now(), "set-rows")
    mixed = _mixed(rows)
    few = rows.join(mixed.where(F.col("n") <= FEW).select("x"), "x", "left_semi")
    hot = rows.join(mixed.where(F.col("n") > FEW).select("x"), "x", "left_semi")
    found = store(link(_pairs(few, similarity)), "set-links")
    if hot.take(1):
        near, pairs = _by_difference(hot, ranked, similarity)
        found = store(found.unionByName(near).unionByName(link(pairs)), "set-links")
    release(crowd.sparkSession)
    out = store(_joined(roots, found), "set-roots")
    for table in (ranked, early, rows, found):
        discard(table)
    return out


def linked(units: DataFrame, sets_of: Callable[[Column], Column], similarity: float, candidates: DataFrame | None = None) -> DataFrame:
    """``(node, root)`` of the rows of ``units`` (p, c, keys, words) that are alike to another.

    Rows with equal p are the same; ``keys`` are its buckets and ``c`` how often it is there.
    ``sets_of`` makes the sorted set of ``words``; ``candidates`` (a, b) are compared besides.
    """
    rows = units.select("p", "c", F.explode_outer("keys").alias("key")).where("key is not null")
    order = F.struct((-F.col("c")).alias("c"), "p")
    buckets = rows.groupBy("key").agg(F.min("p").alias("lo"), F.max("p").alias("hi"), F.min(order).alias("centre")).where("lo < hi").select("key", F.col("centre.p").alias("centre"))
    met = store(rows.join(buckets, "key").select("key", "p", "centre").distinct(), "band-buckets")
    stars = met.where("p != centre").select(F.col("centre").alias("a"), F.col("p").alias("b"))
    members = met.select("p")
    if candidates is not None:
        stars = stars.unionByName(candidates.select("a", "b"))
        members = members.unionByName(candidates.select(F.explode(F.array("a", "b")).alias("p")))
    sets = units.where("words is not null").select("p", "words").join(members.distinct(), "p", "left_semi")
    sets = store(sets.groupBy("p").agg(F.first("words").alias("words")).select("p", sets_of(F.col("words")).alias("s")), "band-sets")
    first = store(verified(stars.distinct(), sets, similarity), "band-links")
    roots = store(connected_components(first.where("alike").select("a", "b")), "band-roots")
    rooted = met.select("key", "p").join(roots.withColumnRenamed("node", "p"), "p", "left").select("key", "p", F.coalesce("root", "p").alias("root"))
    crowd = store(rooted.join(_mixed(rooted, "key").select("key"), "key", "left_semi").select("p", "root").distinct(), "band-crowd")
    release(units.sparkSession)
    found = roots
    if crowd.take(1):
        after = crowd_roots(crowd, sets, similarity)
        tops = crowd.withColumnRenamed("root", "old").join(after, "p").where("root != old").select(F.col("old").alias("of"), F.col("root").alias("top")).distinct()
        known = roots.join(tops, F.col("root") == F.col("of"), "left").select("node", F.coalesce("top", "root").alias("root"))
        # What had no link before is not in ``roots``.
        new = after.select(F.col("p").alias("node"), "root").join(roots.select("node"), "node", "left_anti").join(after.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "root")
        lone = new.where((F.col("n") > 1) | (F.col("node") != F.col("root"))).select("node", "root")
        found = store(known.unionByName(lone), "band-classes")
        discard(after)
        discard(roots)
    for table in (met, sets, first, crowd):
        discard(table)
    release(units.sparkSession)
    return found
