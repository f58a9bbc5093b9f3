"""The registered corpus queries: thin digests of the operators over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_extract, line_crf, merkle, minhash, paragraph_dedup, periodic_runs, piece_codec, rule_list, simhash, suffix_dedup, suffix_tree_lm, token_count


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    found = line_crf.scored(docs, *line_crf.learn(docs, labels, _remainder(3) != 1))
    return found.select("doc_id", (_remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = paragraph_dedup.repeats(table(spark, sf_dir, "documents"))
    words = F.aggregate("passages", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select("doc_id", "n_paragraphs", "n_repeated", words.alias("n_removed"), "passages", "kept_in")


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extracted(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.sort_array(F.transform("items", lambda x: x.cast("string"))), ",")
    found = found.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"), "contaminated")


OP4_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(list_slice(w, s, s + least(len(w), 13) - 1), ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM bw WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM win
), places AS (
  SELECT doc_id, size, s, array_to_string(list_slice(w, s, s + size - 1), ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM dw, sizes WHERE len(w) >= size)
), hit AS (SELECT doc_id, item_id, s, places.size FROM places JOIN win USING (win, size)
), words AS (SELECT DISTINCT doc_id, unnest(range(s, s + size)) AS p FROM hit
), hits AS (SELECT doc_id, count(*) AS n_hit FROM words GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = rule_list.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    longs = [F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return found.select("doc_id", *longs, "base_failed", "kept")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.deduplicated(table(spark, sf_dir, "documents"))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    return found.select("doc_id", n_bytes, F.col("_removed").alias("n_removed"), F.col("_spans").alias("n_spans"), F.sha2("_kept", 256).alias("kept_sha256"))


#: Bytes as two hex digits each, so that strings of 50 bytes are strings of 100 characters.
OP10_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), places AS (SELECT r, doc_id, unnest(range(0, length(h) // 2 - 49)) AS i, h FROM d WHERE length(h) >= 100
), strings AS MATERIALIZED (SELECT r, doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM places
), first AS (SELECT s, min(doc_id) AS least FROM strings GROUP BY s HAVING count(*) > 1
), hit AS MATERIALIZED (SELECT r, i FROM strings JOIN first USING (s) WHERE least < doc_id
), steps AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 50 THEN 0 ELSE 1 END AS opens FROM hit
), islands AS (SELECT r, i, sum(opens) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM steps
), spans AS MATERIALIZED (SELECT r, k, min(i) AS a, max(i) + 50 AS b FROM islands GROUP BY r, k
), before AS (SELECT r, k, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY k), 0) AS kept_from FROM spans
), front AS (
  SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(h, 2 * kept_from + 1, 2 * (a - kept_from)), '' ORDER BY k) AS kept
  FROM before JOIN d USING (r) GROUP BY r
)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN front USING (r)
"""


def _remainder(by: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % by


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_count.token_counts(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    return found.select("doc_id", n_bytes, "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op7_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = vocabulary("piece_bpe_32k.model")
    found = piece_codec.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), model, dropout=0.1, seed=7)
    return found.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"), "ids", F.col("text").eqNullSafe(F.col("decoded")).alias("lossless"))


def op9_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = suffix_tree_lm.scored(docs, _remainder(7) != 2)
    return found.select("doc_id", (_remainder(7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    # One text in ten gets a period from some word on.
    rows = docs.withColumn("words", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))))
    n, g = F.size("words"), F.floor(h / 10)
    a = F.when(n > 0, g % n)
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
    rows = rows.select("doc_id", "text", "words", n.alias("n"), a.cast("int").alias("a"), p.cast("int").alias("p"))
    k = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")
    planted = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("words", k(i))), " ")
    rows = rows.select("doc_id", F.when(F.col("a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))
    found = rows.select("doc_id", periodic_runs.runs(F.col("text")).alias("found")).select("doc_id", "found.*")
    run = F.arrays_zip("start", "length", "period")
    lines = F.array_join(F.transform(run, lambda x: F.concat(F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), x["period"].cast("string")), F.lit("\n"))), "")
    longer = lambda best, x: best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"])
    best = F.aggregate(run, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), lambda best, x: F.when(longer(best, x), x).otherwise(best))
    found = found.withColumn("best", best).withColumn("lines", lines)
    milli = F.expr("(1000 * best.length) div best.period")
    return found.select(
        "doc_id", F.size("start").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", milli.alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def _runs_sql() -> str:
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {_crc32_sql('doc_id')} AS h FROM documents
), e AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d
), words AS MATERIALIZED (
  SELECT r, n, i, w[1 + CASE WHEN a IS NULL OR i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END] AS word
  FROM (SELECT *, unnest(range(0, n)) AS i FROM e)
), same AS (
  SELECT x.r, y.i - x.i AS q, x.i, x.i - row_number() OVER (PARTITION BY x.r, y.i - x.i ORDER BY x.i) AS island
  FROM words x JOIN words y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n
), stretches AS (
  SELECT r, q, min(i) AS s, count(*) + q AS len FROM same GROUP BY r, q, island HAVING count(*) + q >= greatest(24, 3 * q)
), runs AS MATERIALIZED (SELECT r, s, len, min(q) AS q FROM stretches GROUP BY r, s, len
), best AS (
  SELECT DISTINCT ON (r) r, s, len, q FROM runs ORDER BY r, CAST(len AS DOUBLE) / q DESC, s, q
), lines AS (
  SELECT r, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY r
), gone AS (SELECT DISTINCT r, unnest(range(s + q, s + len)) AS i FROM runs
), kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, len AS length, q AS period, 1000 * len // q AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN lines USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
"""


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = {c: F.col(c) for c in merkle.FIELDS}
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = merkle.digest(fields | {"text": F.replace("text", F.lit("\n"), F.lit(""))})
    leaves = docs.select("doc_id", "source", merkle.digest(fields).alias("leaf"), F.when(odd, tampered).alias("claimed"))
    return merkle.proofs(merkle.manifest(leaves))


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), t AS (SELECT min(r) AS t, w, unnest(list(r)) AS r FROM d GROUP BY w
), s AS MATERIALIZED (
  SELECT DISTINCT t, array_to_string(list_slice(w, i, i + 2), ' ') AS s
  FROM (SELECT DISTINCT t, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM t WHERE len(w) > 0)
), n AS (SELECT t, count(*) AS n FROM s GROUP BY t
), links AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.t AS a, y.t AS b, count(*) AS shared FROM s x JOIN s y ON x.s = y.s AND x.t <> y.t GROUP BY x.t, y.t)
  JOIN n na ON na.t = a JOIN n nb ON nb.t = b WHERE 100 * shared >= 85 * (na.n + nb.n - shared)
), reach AS (SELECT t AS a, t AS b FROM n UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
), least AS (SELECT a AS t, min(doc_id) AS component_id FROM reach JOIN t ON t.t = reach.b JOIN d ON d.r = t.r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, CASE WHEN n.n IS NULL THEN d.doc_id ELSE component_id END AS component_id,
  coalesce(CASE WHEN n.n IS NULL THEN d.doc_id ELSE component_id END = d.doc_id, false) AS kept
FROM d JOIN t ON t.r = d.r LEFT JOIN n ON n.t = t.t LEFT JOIN least ON least.t = t.t
"""


def _merkle_sql(depth: int, upper: int) -> str:
    """Trees of at most ``depth`` levels over a source's rows and ``upper`` over the sources."""
    part = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join([*map(part, ("doc_id", "source", "lang", "n_chars")), part(text)]) + ")"
    out = [
        f"d AS MATERIALIZED (SELECT doc_id, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS g, {leaf('text')} AS leaf, CASE WHEN {_crc32_sql('doc_id')} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf('text')} END AS f0 FROM documents)",
        "p0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, '' AS s0 FROM d)",
        "a0 AS MATERIALIZED (SELECT g, i, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM p0)",
    ]

    def level(name: str, k: int) -> str:
        return f"{name}{k + 1} AS MATERIALIZED (SELECT g, i // 3 AS i, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h, (any_value(n) + 2) // 3 AS n FROM {name}{k} GROUP BY g, i // 3)"

    def beside(name: str, k: int) -> str:
        side = lambda rows: f"coalesce(string_agg(h, '') OVER (PARTITION BY g, i // 3 ORDER BY i ROWS BETWEEN {rows}), '')"
        return f"{name}s{k} AS MATERIALIZED (SELECT g, i, n, {side('3 PRECEDING AND 1 PRECEDING')} AS l, {side('1 FOLLOWING AND 3 FOLLOWING')} AS r FROM {name}{k})"

    def fold(before: str, after: str, name: str, k: int, keep: str) -> str:
        hashed = "CASE WHEN x.n = 1 THEN f0 ELSE sha256(l || f0 || r) END AS f0, CASE WHEN x.n = 1 THEN s0 ELSE s0 || l || r END AS s0"
        return f"{after} AS MATERIALIZED (SELECT {keep}, p.i // 3 AS i, {hashed} FROM {before} p JOIN {name}s{k} x ON p.g = x.g AND p.i = x.i)"

    for k in range(depth):
        out += [level("a", k), beside("a", k), fold(f"p{k}", f"p{k + 1}", "a", k, "doc_id, leaf, p.g")]
    out.append(f"b0 AS MATERIALIZED (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, h, count(*) OVER () AS n, g AS of FROM a{depth})")
    out.append(f"q0 AS MATERIALIZED (SELECT doc_id, leaf, b0.h AS subroot, '' AS g, b0.i, f0, s0 FROM p{depth} p JOIN b0 ON p.g = b0.of)")
    for k in range(upper):
        out += [level("b", k), beside("b", k), fold(f"q{k}", f"q{k + 1}", "b", k, "doc_id, leaf, subroot, p.g")]
    return "WITH " + ",\n".join(out) + f"\nSELECT doc_id, leaf, subroot, h AS root, sha256(s0) AS proof_sha256, f0 AS folded_root, f0 = h AS verified FROM q{upper} CROSS JOIN (SELECT h FROM b{upper})"


def _crc32_sql(column: str) -> str:
    """CRC-32 of the decimal text of a column: each character is followed by seven steps that mix in nothing."""
    steps = f"[4294967295::BIGINT] || flatten(list_transform(string_split(CAST({column} AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    return f"xor(list_reduce({steps}, lambda a, e: xor(xor(a, e) // 2, 3988292384 * (xor(a, e) % 2))), 4294967295::BIGINT)"


QUERIES = {f.__name__: f for f in (op1_line_crf, op2_paragraph_dedup, op3_html_extract, op4_decontaminate, op5_token_counts, op6_simhash, op7_piece_codec, op8_quality_rules, op9_suffix_tree_lm, op10_suffix_dedup, op11_periodic_runs, op12_merkle_manifest, op13_minhash_dedup)}
SQL = {"op4_decontaminate": OP4_SQL, "op10_suffix_dedup": OP10_SQL, "op11_periodic_runs": _runs_sql(), "op12_merkle_manifest": _merkle_sql(14, 7), "op13_minhash_dedup": OP13_SQL}
