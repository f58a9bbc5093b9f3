"""Quality rules learned as a decision list by sequential covering.

Only DataFrame functions are used. Each document becomes a row of whole-text statistics.
From the labelled rows, rules are learned one after the other: a rule starts empty and
grows by the threshold condition with the greatest FOIL gain on the rows that no earlier
rule covers; conditions are then pruned, last first, while the Laplace precision on the
pruning rows does not fall. A rule is kept if the Laplace share of bad ones among all
labelled rows that it covers is ``min_precision``, and the pruning rows do not speak against
it. After one that fails, its first condition opens no other rule and learning goes on; it
ends after ``patience`` failures in a row, or when no condition gains. Each growth step is one aggregation over (feature, bin) counts, whose
result has features x bins rows whatever the input size. The list becomes one ordered
``CASE WHEN`` column.

Defined cases: a null text has no words and fails the base rules; without labelled rows of
both kinds the learned list is empty and rejects nothing; repeated ids keep a row each; a
null label or a label without a document is ignored; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import store

SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 5
FEATURES = ["n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "upper_share", "digit_share", "line_words"]


def _share(part: str | Column, whole: str | Column) -> Column:
    part, whole = (F.col(x) if isinstance(x, str) else x for x in (part, whole))
    return part / F.greatest(whole, F.lit(1)).cast("double")


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Whole-text counts of every document and the ``FEATURES`` made from them."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.array_remove(F.split(text, SPACE), "").alias("w"),
        F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "").alias("lines"),
        _count(text, SYMBOL).alias("n_symbols"),
        _count(text, "[A-Z]").alias("n_upper"),
        _count(text, "[0-9]").alias("n_digits"),
    )
    tail = F.slice("w", 1, F.greatest(F.size("w") - (WINDOW - 1), F.lit(0)))
    rows = rows.select(
        "id", "n_symbols", "n_upper", "n_digits",
        F.size("w").alias("n_words"),
        F.length(F.array_join("w", "")).alias("word_chars"),
        F.size(F.array_distinct("w")).alias("n_distinct"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.transform(tail, lambda x, i: F.xxhash64(x, *[F.get("w", i + k) for k in range(1, WINDOW)])).alias("h"),
    )
    counts = ["id", "n_symbols", "n_upper", "n_digits", "n_words", "word_chars", "n_distinct", "n_lines", "n_dup_lines"]
    # Only texts with an equal pair of windows are sorted; most have none.
    some = F.size(F.array_distinct("h")) < F.size("h")
    rows = rows.select(*counts, F.when(some, F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("o"))
    near = lambda x, k: F.get("o", k - 1)["h"].eqNullSafe(x["h"]) | F.get("o", k + 1)["h"].eqNullSafe(x["h"])
    starts = F.sort_array(F.transform(F.filter("o", near), lambda x: x["i"]))
    step = lambda acc, i: F.struct((i + WINDOW).alias("end"), (acc["n"] + i + WINDOW - F.greatest(acc["end"], i)).alias("n"))
    covered = F.aggregate(starts, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), step, lambda acc: acc["n"])
    rows = rows.select(*counts, F.coalesce(covered, F.lit(0)).alias("n_repeat_words"))
    return rows.select(
        "*",
        _share("word_chars", "n_words").alias("mean_word"),
        _share("n_symbols", "word_chars").alias("symbol_share"),
        _share("n_dup_lines", "n_lines").alias("dup_line_share"),
        _share("n_repeat_words", "n_words").alias("repeat_share"),
        _share("n_distinct", "n_words").alias("distinct_share"),
        _share("n_upper", "word_chars").alias("upper_share"),
        _share("n_digits", "word_chars").alias("digit_share"),
        _share("n_words", "n_lines").alias("line_words"),
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Condition, ...]


def _holds(rule: Rule) -> Column:
    out = F.lit(True)
    for condition in rule:
        out = out & condition.column()
    return out


def verdict(rules: list[Rule]) -> Column:
    """The ordered list as one CASE WHEN: the number of the first rule that rejects, or null."""
    out = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules))):
        out = F.when(_holds(rule), F.lit(k)).otherwise(out)
    return out


def _best(counts: dict[tuple[int, int], list[int]], cuts: list[list[float]], bad: int, good: int, used: tuple[Condition, ...] | list[Condition]) -> Condition | None:
    """The condition with the greatest FOIL gain, from the counts by feature and bin."""
    start, top, found = math.log2(bad / (bad + good)), 1e-9, None
    for f, edges in enumerate(cuts):
        low = [0, 0]
        for b, edge in enumerate(edges):
            here = counts.get((f, b), (0, 0))
            low = [low[0] + here[0], low[1] + here[1]]
            for above, (p, n) in ((False, low), (True, [bad - low[0], good - low[1]])):
                condition = Condition(FEATURES[f], above, edge)
                if p and p + n < bad + good and condition not in used and (gain := p * (math.log2(p / (p + n)) - start)) > top:
                    top, found = gain, condition
    return found


def _bin(feature: str, edges: list[float]) -> Column:
    """The number of edges below the value."""
    return F.size(F.filter(F.array(*map(F.lit, edges)).cast("array<double>"), lambda edge: edge < F.col(feature)))


def learn_rules(labelled: DataFrame, bins: int = 24, max_conditions: int = 3, min_precision: float = 0.9, min_covered: int = 3, patience: int = 4) -> list[Rule]:
    """Rules that reject, learned from all rows of ``labelled`` (id, bad 0/1 and FEATURES)."""
    data = store(labelled.select("bad", (F.pmod(F.xxhash64("id"), F.lit(3)) == 0).alias("prune"), *FEATURES).where("bad is not null"), "rule-rows")
    steps = F.array(*[F.lit((k + 1) / bins) for k in range(bins - 1)])
    quantiles = data.agg(*[F.percentile_approx(f, steps, F.lit(1000)).alias(f) for f in FEATURES]).first()
    cuts = [sorted(set(quantiles[f] or [])) for f in FEATURES]
    binned = [F.struct(F.lit(f).alias("f"), _bin(FEATURES[f], edges).alias("b")) for f, edges in enumerate(cuts)]
    rules: list[Rule] = []
    failed: list[Condition] = []
    misses = 0
    while misses < patience:
        left, rule = data.where(verdict(rules).isNull()), ()
        while len(rule) < max_conditions:
            rows = left.where(~F.col("prune") & _holds(rule)).select("bad", F.explode(F.array(*binned)).alias("x"))
            got = rows.groupBy("x.f", "x.b").agg(F.count_if(F.col("bad") == 1).alias("bad"), F.count_if(F.col("bad") == 0).alias("good")).collect()
            counts = {(r["f"], r["b"]): [r["bad"], r["good"]] for r in got}
            bad, good = (sum(v[i] for (f, _), v in counts.items() if f == 0) for i in (0, 1))
            if bad < min_covered or not good or (condition := _best(counts, cuts, bad, good, rule or failed)) is None:
                break
            rule = (*rule, condition)
        if not rule:
            break
        prefixes = [rule[: k + 1] for k in range(len(rule))]
        kinds = {"prune": F.col("prune"), "all": F.lit(True)}
        hits = left.agg(*[F.count_if(_holds(p) & (F.col("bad") == b) & rows).alias(f"{name}{k}_{b}") for k, p in enumerate(prefixes) for b in (0, 1) for name, rows in kinds.items()]).first()
        share = lambda name, k: (hits[f"{name}{k}_1"] + 1) / (hits[f"{name}{k}_1"] + hits[f"{name}{k}_0"] + 2)
        best = max(range(len(prefixes)), key=lambda k: (share("prune", k), -k))
        against = hits[f"prune{best}_0"] > (1 - min_precision) * (hits[f"prune{best}_0"] + hits[f"prune{best}_1"])
        if share("all", best) < min_precision or against:
            failed.append(rule[0])
            misses += 1
            continue
        rules.append(prefixes[best])
        misses = 0
    return rules


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[DataFrame, list[Rule]]:
    """Statistics of every document with ``base_failed``, ``rule`` (first that rejects) and ``kept``; and the rules."""
    stats = store(text_statistics(docs, id_col, text_col), "rule-statistics")
    marks = labels.select(F.col(id_col).alias("id"), (1 - F.col(label_col)).alias("bad")).where("bad in (0, 1)").dropDuplicates()
    rules = learn_rules(stats.join(marks, "id"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = stats.withColumn("base_failed", failed).withColumn("rule", verdict(rules))
    out = out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    return out.withColumnRenamed("id", id_col), rules
