"""The corpus operators against brute-force versions, and their defined cases."""

import hashlib
import math
import random
import zlib
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

pytest.importorskip("tidemark.llm.queries")
from tidemark.llm import decontaminate, html_extract, line_crf, paragraph_dedup, piece_codec, queries, rule_list, simhash, suffix_array, suffix_dedup, suffix_tree_lm, token_count

SCHEMA = "doc_id long, text string, id string, h string, rank long, score double"


def words(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(["alpha", "Beta", "gamma,", "delta.", "über", "Zeta!", "eta", "theta#", "io\tta", "ka\nppa"]) + str(r.randrange(40)) for _ in range(n))


def texts():
    base = words(120, 1)
    passage = words(60, 2)
    rows = [base, base, base + " tail", words(50, 3) + "\n" + passage + "\n" + words(30, 4), words(40, 5) + "\n" + passage, "", None, " \n\t ", "a", "b c", "ab " * 200, "ab " * 210, "é" * 80, "é" * 90, words(4000, 6)]
    return [(i, t) for i, t in enumerate(rows)] + [(3, rows[3])]


@pytest.fixture(scope="module")
def docs(spark):
    # Extra columns carry names that operators use inside.
    return spark.createDataFrame([(i, t, "x", "y", 1, 0.5) for i, t in texts()], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1), (3, 1), (4, 1), (14, 1), (10, 0), (11, 0), (5, 0), (99, 1), (2, None)], "doc_id long, quality int")


def test_line_field(spark, docs, nothing, labels):
    field, prior = line_crf.learn(docs, labels, F.lit(True))
    got = line_crf.scored(docs, field, prior, score_col="s").collect()
    assert len(got) == len(texts()) and all(0 <= r.s <= 1 for r in got)
    assert all(r.s == 0 for r in got if not (r.text or "").strip())
    assert next(r.s for r in got if r.doc_id == 14) > 0.5 > next(r.s for r in got if r.doc_id == 10)
    assert line_crf.learn(docs, labels.limit(0), F.lit(True)) == (None, 0.5)
    assert line_crf.scored(nothing, None, score_col="s").count() == 0


def test_line_field_describes_little_at_a_time():
    import tracemalloc

    import numpy as np
    import pandas as pd

    field = line_crf.Field(np.zeros(line_crf.WIDTH), np.ones(line_crf.WIDTH), np.linspace(-1, 1, 3 * line_crf.WIDTH + 3), np.eye(2))
    column = pd.Series([f"line {k} of a text, and more of it.\nanother one\n" * 40 for k in range(3000)] + [None, ""])
    want = line_crf.score_texts([(t or "").encode() for t in column], field)
    tracemalloc.start()
    got = line_crf.score_column(column, field)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(got, want, atol=1e-12) and len(got) == 3002
    assert peak < 40_000_000  # 2 MB of text described at once took 63 MB, besides the whole batch in bytes


def test_memory_is_given_back_after_the_last_row():
    import weakref

    from tidemark.llm import memory

    class Table:
        pass

    seen = []

    def rows(batches):
        table = Table()
        seen.append(weakref.ref(table))
        yield from batches

    before, memory.give_back = memory.give_back, lambda: seen.append(seen[0]())
    try:
        assert list(memory.tidy(rows)(iter([1, 2]))) == [1, 2]
    finally:
        memory.give_back = before
    assert seen[1] is None  # what the task held is gone by then


def test_marginals_equal_enumeration():
    import itertools

    import numpy as np

    r = np.random.default_rng(1)
    field = line_crf.Field(np.zeros(line_crf.WIDTH), np.ones(line_crf.WIDTH), np.zeros(1), r.normal(size=(2, 2)))
    u = r.normal(size=4)
    ahead, back = field.messages(u, np.array([0]), np.array([4]))
    weight = {y: math.exp(sum(a * b for a, b in zip(y, u)) + sum(field.pairs[a, b] for a, b in zip(y, y[1:]))) for y in itertools.product((0, 1), repeat=4)}
    want = [sum(w for y, w in weight.items() if y[k]) / sum(weight.values()) for k in range(4)]
    assert np.allclose(1 / (1 + np.exp(-(ahead + back))), want)


def near_rows():
    """Documents with copied, edited, embedded and short passages, rows without an id, and repeated rows."""
    r = random.Random(5)
    fresh = lambda n: " ".join(f"{r.choice('abcdefgh')}{r.randrange(10**6)}" for _ in range(n))
    base, passage, title = fresh(60), fresh(70), fresh(6)
    edited = base.split()
    edited[30] = "other"
    far = base.split()
    for k in range(2, 60, 9):
        far[k] = "far" + str(k)
    rows = [(1, base + "\n" + title), (2, title + "\n" + " ".join(edited)), (3, base.upper()), (4, " ".join(far)), (5, fresh(40) + " " + passage + " " + fresh(40)), (6, fresh(30) + " " + passage + " " + fresh(50) + "\n" + fresh(8)), (7, None), (8, ""), (9, title)]
    rows += [(10, fresh(25) + "\n" + fresh(25)), (None, base), (None, passage), (11, passage + "\n" + passage), (11, passage + "\n" + passage), (12, fresh(22)), (13, " \n\t\n")]
    chain = base.split()
    for k in range(14, 22):  # each like the one before it, not like the first
        chain = [*chain[3:], *fresh(3).split()]
        rows.append((k, " ".join(chain)))
    return rows


def brute_passages(rows, min_words=20):
    """What ``repeats`` is to find, by comparing all pairs of paragraphs."""
    cut = lambda words: [0] if len(words) <= paragraph_dedup.LONG else paragraph_dedup.Hashed([words]).cuts()[0]
    order = lambda row: (row[0] is None, row[0] or 0)
    docs = sorted({(i, t) for i, t in rows}, key=order)
    lines, pieces = {}, {}
    for d, (_, t) in enumerate(docs):
        at = 0
        for words in paragraph_dedup.lines_of(t):
            lines.setdefault(b" ".join(words), []).append((d, at, len(words)))
            bounds = cut(words)
            for a, b in zip(bounds[:-1], bounds[1:], strict=True) if len(bounds) > 2 else ():
                pieces.setdefault(b" ".join(words[a:b]), []).append((d, at + a, b - a))
            at += len(words)
    sets = {x: {tuple(x.split()[k : k + 5]) for k in range(max(1, len(x.split()) - 4))} for x in lines}
    group = {x: x for x in lines}
    find = lambda x: x if group[x] == x else find(group[x])
    for x in lines:
        for y in lines:
            if len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]):
                group[find(x)] = find(y)
    classes = {}
    for x, places in lines.items():
        classes.setdefault(find(x), []).extend(places)
    covered = {d: set() for d in range(len(docs))}
    for places in [*classes.values(), *pieces.values()]:
        first = min(places)
        for d, at, n in places:
            if docs[d][0] != docs[first[0]][0] or docs[d] != docs[first[0]]:
                covered[d] |= set(range(at, at + n))
    out = {}
    for d, (i, t) in enumerate(docs):
        runs, start = [], None
        for k in [*sorted(covered[d]), None]:
            if start is not None and k != last + 1:
                if last + 1 - start >= min_words:
                    runs.append((start, last + 1))
                start = None
            start, last = (k if start is None else start), k
        out[i, t] = runs
    return out


def test_paragraphs(spark, nothing):
    rows = near_rows()
    plain = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, id string, h int").repartition(3)
    want = brute_passages([row for row in rows if row[0] is not None])
    got = {r.doc_id: r for r in paragraph_dedup.repeats(plain.where("doc_id is not null")).collect()}
    assert {k: [tuple(x) for x in r.passages] for k, r in got.items()} == {i: v for (i, _), v in want.items()}
    assert got[2].passages and not got[4].passages and got[6].passages and not got[9].passages and got[9].n_repeated == 1
    assert got[7].n_paragraphs == got[8].n_paragraphs == got[13].n_paragraphs == 0 and got[3].kept_in == [1]
    # Rows without an id come last, each as a document of its own.
    nameless = paragraph_dedup.repeats(plain).where("doc_id is null").collect()
    assert len(nameless) == 2 and all(r.passages for r in nameless)
    assert paragraph_dedup.repeats(nothing).count() == 0
    left = paragraph_dedup.deduplicated(plain)
    assert left.columns == plain.columns and left.count() == len(rows)
    texts = {r.doc_id: r.text for r in left.collect()}
    assert texts[3] == "" and texts[7] is None and texts[1] == rows[0][1] and texts[9] == rows[8][1]
    # A passage goes up to the edges of its pieces.
    before, after = dict(rows)[6].split(), texts[6].split()
    assert 0 < len(before) - len(after) <= 70 and set(before[:30]) | set(before[100:]) <= set(after)
    inside = {r.doc_id: r.passages for r in paragraph_dedup.repeats(plain, inside=True).collect()}
    assert (70, 140) in [tuple(x) for x in inside[11]] and not got[11].passages[0][0] == 70


def test_many_unlike_paragraphs(spark):
    """Versions of one paragraph that share bands and are like others of their bucket, but not like its centre."""
    r = random.Random(8)
    base = [f"w{k}" for k in range(40)]
    rows = []
    for k in range(60):
        version = base[:]
        for _ in range(r.randrange(1, 5)):
            version[r.randrange(40)] = f"x{r.randrange(3)}"
        rows.append((k, " ".join(version)))
    got = {r.doc_id: [tuple(x) for x in r.passages] for r in paragraph_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: v for (i, _), v in brute_passages(rows).items()}


PAGE = """<html><head><title>t</title></head><body><nav><ul><li><a href=x>Menu</a></ul></nav><header>Site</header>
<div class="cookie-notice">We use cookies on this site</div><div class="ad">Buy this now and be glad of it.</div>
<article><h1>Title &amp; more</h1><p>First <b>bold</b>  text&nbsp;here.<p>Second<br>line<script>var a="<p>";</script></article>
<aside>Related</aside><form><input>Sign up</form><section id="comments"><p>I am the first to comment on this.</p></section><footer>&copy; x</footer>"""


def test_html(spark):
    rows = spark.createDataFrame([(1, "u", PAGE), (2, "u", None), (3, "u", ""), (4, "u", "<!-- open"), (5, "u", "<p>" + "The plain page of a site that is without an article is read by the density of the words in it. " * 4)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extracted(rows).collect()}
    assert got[1] == "Title & more First bold text here. Second line"
    assert got[2] == got[3] == got[4] == "" and got[5].startswith("The plain page")
    assert html_extract.extracted(rows.limit(0)).count() == 0


PLAIN = "The plain page of a site is read by the density of the words in it and of the links that are on it. " * 3
ITALIAN = "Il gatto che non ha fame sta sul tetto della casa e non scende per il cibo che si trova nella ciotola della cucina. " * 3
TEMPLATES = [
    (f'<body class="single-post has-sidebar"><p>{PLAIN}</p></body>', PLAIN),
    (f'<div class="no-sidebar"><article><p>{PLAIN}</p></article></div>', PLAIN),
    (f'<div class="sidebar-layout"><main><p>{PLAIN}</p></main><div class="widget">{PLAIN.upper()}</div></div>', PLAIN),
    (f'<article><div class="entry-header"><h1>Title</h1></div><p>{PLAIN}</p></article>', "Title " + PLAIN),
    (f"<p title=don't>{PLAIN}</p>", PLAIN),
    (f"<html><head><title>x</title><meta a=b><p>{PLAIN}</p>", PLAIN),
    (f"<svg/><p>{PLAIN}</p><svg><text>drawn</text></svg>", PLAIN),
    (f'<article data-id="sidebar"><p>{PLAIN}</p></article><section class="comments"><p>{PLAIN.upper()}</p></section>', PLAIN),
    (f"<p>{ITALIAN}</p><p><a href=x>{ITALIAN.upper()}</a></p>", ITALIAN),
    ("<p>" + "これは日本語の長い文章です。ここには本文が書かれています。" * 5 + "</p>", "これは日本語の長い文章です。ここには本文が書かれています。" * 5),
    (f"<article><p>{PLAIN}</p><ul>" + "<li><a href=x>Another story that is not part of this one but linked to from here and read a lot</a></li>" * 3 + "</ul></article>", PLAIN),
    (f"<p>{PLAIN}</p><p>So it goes.</p><p>{PLAIN}</p>", PLAIN + "So it goes. " + PLAIN),
]


def test_html_templates(spark):
    rows = [(k, "u", page, "x", 1) for k, (page, _) in enumerate(TEMPLATES)] + [(0, "u", TEMPLATES[0][0], "x", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, id string, label int")
    got = html_extract.extracted(pages).collect()
    assert len(got) == len(rows) and all(r.id == "x" and r.label == 1 for r in got)
    for r in got:
        assert r.text == " ".join(TEMPLATES[r.page_id][1].split()), r.page_id


def test_html_is_linear():
    import time

    long = f"<article>{'<p>' + PLAIN + '</p>'}" * 3000
    start = time.process_time()
    assert len(html_extract.main_text(long)) > 800_000
    for page in ('<a "' * 20_000, "<a =" * 20_000, "<!--" * 20_000, '<a href="x' * 20_000, "<script>" * 20_000, "<" * 80_000):
        html_extract.main_text(page)
    assert time.process_time() - start < 10


def brute_contamination(docs, items):
    import re

    cut = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for i, t in items:
        w = cut(t)
        for k in range(max(1, len(w) - 12)) if w else ():
            windows.setdefault(tuple(w[k : k + 13]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, found = cut(t), set(), set()
        for window, ids in windows.items():
            for k in range(len(w) - len(window) + 1):
                if tuple(w[k : k + len(window)]) == window:
                    hit |= set(range(k, k + len(window)))
                    found |= ids
        out.append((i, len(w), len(hit), tuple(sorted(map(str, found))), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


@pytest.mark.parametrize("bound", [200_000, 0])
def test_decontamination(spark, docs, nothing, bound):
    t = dict(texts())
    items = [(1, t[0][30:300]), (2, t[3][-200:]), (3, "b c"), (4, "a"), (5, None), (6, ""), (10, t[0][30:300])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs, bench, broadcast_windows=bound).collect()
    rows = [(r.doc_id, r.n_words, r.n_hit, tuple(sorted(map(str, r["items"]))), r.contaminated) for r in got for _ in range(r.copies)]
    assert sorted(rows) == brute_contamination(texts(), items)
    assert decontaminate.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(nothing, bench).count() == 0
    kept = decontaminate.decontaminate(docs, bench, broadcast_windows=bound)
    assert kept.columns == docs.columns and kept.count() == sum(not r[-1] for r in rows)
    spans = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench, "span", broadcast_windows=bound).collect()}
    assert spans[9] == "" and spans[10] == t[10]


def test_token_counts(spark, docs):
    from tokenizers import Tokenizer

    path = queries.vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = token_count.token_counts(docs, path, count_col="k").collect()
    assert all(r.k == len(library.encode(r.text or "", add_special_tokens=False).ids) for r in got)
    hard = ["İ ΣΑΣ", "a<|endoftext|>b", "don't I'LL", "x² ½ ５", "\x1c\x85 　z", "aaaa" * 40, "🤗🤗"]
    v = token_count.Vocabulary(path)
    for text in hard:
        w, special = v.pre_tokens(text)
        assert special + int(v.counts([x.encode() for x in w]).sum()) == len(library.encode(text, add_special_tokens=False).ids)


def test_simhash(spark, nothing):
    import xxhash

    assert simhash.fingerprint(None) == simhash.fingerprint(" ") == 0
    assert simhash.fingerprint("A b") == int.from_bytes(xxhash.xxh64(b"a b", 42).digest(), "big", signed=True)
    r = random.Random(5)
    start = [r.getrandbits(64) for _ in range(40)]
    fps = set(start)
    for x in start:
        for _ in range(30):
            x ^= 1 << r.randrange(64)
            if r.random() < 0.4:
                x ^= 1 << r.randrange(64)
            fps.add(x)
    fps |= {start[0] ^ (1 << k) for k in range(64)}  # a large bucket
    order = sorted(fps)
    parent = list(range(len(order)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(order)):
        for j in range(i):
            if (order[i] ^ order[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    signed = [x - 2**64 if x >= 2**63 else x for x in order]
    links = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    roots = {r.node: r.root for r in simhash.connected_components(links).collect()}
    for i in range(len(order)):
        for j in range(i):
            assert (find(i) == find(j)) == (roots.get(signed[i], signed[i]) == roots.get(signed[j], signed[j]))
    assert simhash.near_duplicates(nothing).count() == 0


def test_simhash_rows(docs):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(texts())
    of = {r.doc_id: r.component_id for r in got}
    assert of[0] == of[1] == 0 and of[5] == of[6] == of[7] == 5


def test_pieces(spark, docs, nothing):
    import sentencepiece

    path = queries.vocabulary("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = piece_codec.encode(docs, path, dropout=0.0).collect()
    assert all(r.ids is None if r.text is None else r.ids == library.encode(r.text) for r in plain)
    noisy = piece_codec.decode(piece_codec.encode(docs, path, dropout=0.3, seed=1), path).collect()
    assert all(r.decoded == r.text for r in noisy)
    assert {r.doc_id: r.ids for r in noisy}[0] != {r.doc_id: r.ids for r in plain}[0]
    both = piece_codec.round_trip(docs, path, dropout=0.3, seed=1).collect()
    assert sorted(map(repr, both)) == sorted(map(repr, noisy))
    again = piece_codec.encode(docs.repartition(2), path, dropout=0.3, seed=1).collect()
    assert {r.doc_id: r.ids for r in noisy} == {r.doc_id: r.ids for r in again}
    odd = spark.createDataFrame([(1, "▁ x ▁▁"), (2, "  \n\x00🤗é\t")], "doc_id long, text string")
    assert all(r.decoded == r.text for r in piece_codec.decode(piece_codec.encode(odd, path, 0.2), path).collect())
    assert piece_codec.encode(nothing, path).count() == 0


def test_long_units(monkeypatch):
    """Units encoded by heap and together give the same ids, with and without dropout; time grows mildly with length."""
    import time

    import numpy as np

    pieces = piece_codec.Pieces(queries.vocabulary("piece_bpe_32k.model"))
    r = random.Random(6)
    units = ["".join(r.choice("aeinrst") for _ in range(r.randrange(1, 300))) for _ in range(60)] + ["ab" * 150, "é" * 40, "n" * 290]
    keys = np.array([r.getrandbits(64) for _ in units], np.uint64)
    for dropout in (0.0, 0.3):
        got = []
        for bound in (0, 10**9):
            monkeypatch.setattr(piece_codec, "LONG_UNIT", bound)
            ids, cut = pieces.encode_units(units, dropout, keys)
            got.append((ids.tolist(), cut.tolist()))
        assert got[0] == got[1]
    monkeypatch.setattr(piece_codec, "LONG_UNIT", 256)
    start = time.process_time()
    pieces.encode_units(["".join(r.choice("aeinrst") for _ in range(40_000))], 0.1, keys[:1])
    assert time.process_time() - start < 3


def test_token_classes():
    """Every code point, inside letters, numbers and other characters, is cut and folded as the library does."""
    import unicodedata

    from tokenizers import Tokenizer

    path = queries.vocabulary("word_bpe_49k.json")
    library, mine = Tokenizer.from_file(path), token_count.Vocabulary(path)
    symbols = token_count.byte_symbols()
    points = [chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 4096):
        text = " ".join(f"a{c}a1{c}1?{c}?" for c in points[k : k + 4096])
        want = [x for x, _ in library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(text))]
        got = ["".join(symbols[b] for b in x.encode()) for x in mine.pre_tokens(text)[0]]
        assert got == want, (k, unicodedata.unidata_version)


def brute_statistics(text):
    w = (text or "").encode().split()
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    hit = {p for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_quality_rules(docs, nothing, labels):
    found, rules = rule_list.quality_rules(docs, labels)
    rows = found.collect()
    got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)
    assert got == sorted((i, *brute_statistics(t)) for i, t in texts())
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in rows)
    assert all(not (r.kept and r.base_failed) for r in rows)
    assert rule_list.quality_rules(docs, labels.limit(0))[1] == [] and rule_list.quality_rules(nothing, labels)[0].count() == 0


def test_rules_find_a_threshold(spark):
    rows = [(k, int(k % 4 == 0), *([float(k % 4 == 0) + k / 1000] + [0.5] * (len(rule_list.FEATURES) - 1))) for k in range(400)]
    data = spark.createDataFrame(rows, ["id", "bad", *rule_list.FEATURES])
    rules = rule_list.learn_rules(data)
    assert rules and data.where((rule_list.verdict(rules).isNotNull()) != (F.col("bad") == 1)).count() <= 20


def brute_rules(rows, cuts, min_precision=0.9, min_covered=3, patience=4):
    """Sequential covering over plain rows (prune, bad, *features) as ``learn_rules`` describes it."""
    names = rule_list.FEATURES
    holds = lambda rule, row: all((row[2 + names.index(c.feature)] > c.threshold) == c.above for c in rule)
    rules, failed, misses = [], [], 0
    while misses < patience:
        left, rule = [x for x in rows if not any(holds(done, x) for done in rules)], ()
        while len(rule) < 3:
            here = [x for x in left if not x[0] and holds(rule, x)]
            bad, good = sum(x[1] for x in here), sum(1 - x[1] for x in here)
            if bad < min_covered or not good:
                break
            top, best = 1e-9, None
            for f, name in enumerate(names):
                for edge in cuts[f]:
                    for above in (False, True):
                        c = rule_list.Condition(name, above, edge)
                        p, n = (sum(x[1] == y for x in here if holds((c,), x)) for y in (1, 0))
                        if p and p + n < bad + good and c not in (rule or failed) and (gain := p * (math.log2(p / (p + n)) - math.log2(bad / (bad + good)))) > top:
                            top, best = gain, c
            if best is None:
                break
            rule = (*rule, best)
        if not rule:
            break
        count = lambda part, only: [sum(x[1] == y for x in left if holds(part, x) and (x[0] or not only)) for y in (1, 0)]
        share = lambda part, only: (count(part, only)[0] + 1) / (sum(count(part, only)) + 2)
        part = max((rule[: k + 1] for k in range(len(rule))), key=lambda r: (share(r, True), -len(r)))
        if share(part, False) < min_precision or count(part, True)[1] > (1 - min_precision) * sum(count(part, True)):
            failed.append(rule[0])
            misses += 1
            continue
        rules.append(part)
        misses = 0
    return rules


def test_rules_equal_brute_force(spark):
    r = random.Random(11)
    rows = []
    for k in range(300):
        x = [r.randrange(8) / 8 for _ in rule_list.FEATURES]
        rows.append((k, int(x[1] > 0.7 and x[3] < 0.4 or x[5] > 0.8 or r.random() < 0.03), *x))
    data = spark.createDataFrame(rows, ["id", "bad", *rule_list.FEATURES])
    got = rule_list.learn_rules(data)
    prune = {x.id for x in data.where("pmod(xxhash64(id), 3) = 0").collect()}
    cuts = [sorted({x[2 + f] for x in rows}) for f in range(len(rule_list.FEATURES))]
    assert got and got == brute_rules([(x[0] in prune, *x[1:]) for x in rows], cuts)


def test_suffix_tree(spark, nothing):
    rows = texts() + [(20 + k, "the cat sat on the mat and the dog sat on the rug " * 5) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    train = docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2)
    got = suffix_tree_lm.scored(docs, train).collect()
    cut = lambda t: (t or "").encode().lower().split() + [b" "]
    counts = Counter(w for i, t in rows if not held(i) for w in cut(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((i, len(cut(t)), sum(w in counts for w in cut(t)), round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in cut(t)), 6)) for i, t in rows)
    assert sorted((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.score > r.base_score + 10 for r in got if r.doc_id >= 20)
    assert suffix_tree_lm.scored(docs, nothing).where("score != 0").count() == 0
    assert suffix_tree_lm.scored(nothing, nothing).count() == 0


def brute_tree_scores(rows, held):
    """log10 probabilities of all texts from a suffix tree over plain tuples."""
    cut = lambda t: [b" ", *(t or "").encode().lower().split(), b" "]
    train = [cut(t) for i, t in rows if not held(i)]
    counts = Counter(w for seq in train for w in seq[1:])
    total, v = sum(counts.values()), len(counts)
    root = lambda w: (counts[w] + 1) / (total + v + 1)
    levels, kept = [], {}
    at = lambda seq, t, d: tuple(seq[t - d : t]) if t >= d and b" " not in seq[t - d + 1 : t] else None

    def chance(w, history):
        p, spare = root(w), 1.0
        for d in range(1, len(levels) + 1):
            ctx = at([*history, None], len(history), d)
            if ctx in kept:
                left, own = kept[ctx]
                p, spare = own.get(w, 0.0) + left * p, spare * left
        return p

    now = {(w,) for w in counts if counts[w] >= max(1, suffix_tree_lm.MIN_SHARE * total)}
    while now and len(levels) < suffix_tree_lm.DEPTH:
        d = len(levels) + 1
        followers = {ctx: Counter() for ctx in now}
        for seq in train:
            for t in range(1, len(seq)):
                if (ctx := at(seq, t, d)) in followers:
                    followers[ctx][seq[t]] += 1
        new, fresh = set(), {}
        for ctx, c in followers.items():
            n, stored = sum(c.values()), {w: k for w, k in c.items() if k >= 2}
            parent = {w: chance(w, ctx) for w in stored}
            gain = sum(k * math.log(k / n / parent[w]) for w, k in stored.items())
            if (other := n - sum(stored.values())) > 0:
                gain += other * math.log(other / n / max(1 - sum(parent.values()), 1e-12))
            if stored and gain > 0.5 * math.log(total) * (len(stored) + 1):
                own = {w: (k - 0.75) / n for w, k in stored.items()}
                fresh[ctx] = max(1 - sum(own.values()), 1e-12), own
            new |= {(*ctx, w) for w in stored if w != b" "}
        levels.append(now)
        kept |= fresh
        now = new
    assert any(len(ctx) > 2 for ctx in kept)
    return {i: sum(math.log10(chance(w, seq[:t])) for t, w in enumerate(seq) if t) for i, t0 in rows for seq in [cut(t0)]}


def test_suffix_tree_equals_brute_force(spark):
    r = random.Random(12)
    lines = ["ann likes hot tea", "bob likes hot soup", "eve likes hot milk", "the sea is wide"]
    rows = [(k, " ".join(r.choice(lines) for _ in range(r.randrange(1, 9))) + f" {r.choice('xyz')}") for k in range(150)] + [(200, None), (201, "unseen words only"), (202, "red fox unseen")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x.doc_id: x.score for x in suffix_tree_lm.scored(docs, F.col("doc_id") % 3 != 0).collect()}
    want = brute_tree_scores(rows, lambda i: i % 3 == 0)
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)


def test_suffix_tree_keeps_rare_contexts(spark):
    """Contexts and followers of three occurrences among 100,000 symbols, which shares of the corpus left out."""
    r = random.Random(4)
    rows = [(3 * k + 1, " ".join(str(r.randrange(400)) for _ in range(50))) for k in range(2000)]
    rows += [(9001, "zig zag zog"), (9004, "zig zag zog"), (9007, "zig zag zog"), (9003, "zig zag zog"), (9006, "zag zig zog")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x for x in suffix_tree_lm.scored(docs, F.col("doc_id") % 3 != 0).collect()}
    assert got[9003].score > got[9003].base_score + 6
    assert got[9003].score > got[9006].score + 6


@pytest.mark.parametrize("heavy", [1, 6, 40, 150])
def test_suffix_tree_with_a_trunk(spark, monkeypatch, heavy):
    """Contexts too frequent for one bucket, at all depths, with rare followers, beside branches in several waves."""
    r = random.Random(heavy)
    lines = ["ann likes hot tea", "bob likes hot soup", "eve likes hot milk", "the sea is wide and the sea is deep"]
    rows = [(k, " ".join(r.choice([*lines, f"likes {k}", f"the sea {k}", r.choice("uvwxyz")]) for _ in range(r.randrange(1, 12)))) for k in range(300)]
    rows += [(400, None), (401, "unseen words only"), (402, "red fox unseen"), (403, "the sea unseen likes hot unseen")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for name, value in (("HEAVY", heavy), ("HEAVY_BYTES", 10**9), ("BUCKET_BYTES", 4000), ("TOGETHER", 200)):
        monkeypatch.setattr(suffix_tree_lm, name, value)
    got = {x.doc_id: x.score for x in suffix_tree_lm.scored(docs, F.col("doc_id") % 3 != 0).collect()}
    want = brute_tree_scores(rows, lambda i: i % 3 == 0)
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)


def test_suffix_tree_stores_little(spark, monkeypatch):
    """What the operator writes between its steps stays under twice the texts, whatever the depth."""
    stored = []
    size = lambda *tables: stored.append(sum(Path(f.removeprefix("file:")).stat().st_size for t in tables for f in t.inputFiles()))
    store, store_apart = suffix_tree_lm.store, suffix_tree_lm.store_apart
    monkeypatch.setattr(suffix_tree_lm, "store", lambda *a: [x := store(*a), size(x)][0])
    monkeypatch.setattr(suffix_tree_lm, "store_apart", lambda *a: [x := store_apart(*a), size(*x)][0])
    r = random.Random(5)
    rows = [(k, " ".join(f"word{int(r.paretovariate(0.4)) % 20000}" for _ in range(400))) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert suffix_tree_lm.scored(docs, F.col("doc_id") % 7 != 2).count() == 3000
    assert 0 < sum(stored) < 2 * sum(len(t) for _, t in rows)


def test_paragraph_rows_hold_whole_keys():
    """Rows with and without keys side by side: no key goes through a floating-point number."""
    import pyarrow as pa

    long = " ".join(f"w{k % 37} of{k}" for k in range(60))
    rows = [(None, None), (1, ""), (2, "One two\nthree\n\none TWO"), (3, f"a b c d e f\n{long}\nA B c d e f"), (4, long)]
    batch = pa.RecordBatch.from_pylist([{"doc": i, "h": 2**62 + k, "text": t} for k, (i, t) in enumerate(rows)], pa.schema([("doc", pa.int64()), ("h", pa.int64()), ("text", pa.string())]))
    got = [r for b in paragraph_dedup._unit_rows(iter([batch])) for r in b.to_pylist()]
    of = {2**62 + k: [w for line in paragraph_dedup.lines_of(t) for w in line] for k, (_, t) in enumerate(rows)}
    assert sorted((r["h"], r["k"]) for r in got if r["k"] is not None) == [(2**62 + k, len(paragraph_dedup.lines_of(t))) for k, (_, t) in enumerate(rows)]
    places = [r for r in got if r["p"] is not None]
    assert all((r["p"], r["q"]) == paragraph_dedup.paragraph_key(b" ".join(of[r["h"]][r["start"] : r["start"] + r["n"]])) for r in places)
    assert sum(r["n"] == 120 for r in places) == 2 and any(r["n"] < 120 and r["h"] == 2**62 + 4 for r in places)
    assert sorted((r["words"], r["c"], len(r["keys"])) for r in places if r["keys"]) == [(b"a b c d e f", 2, 8), (long.encode(), 2, 8)]


def test_suffix_arrays():
    r = random.Random(3)
    for _ in range(200):
        data = bytes(r.choice(b"abc"[: r.randint(1, 3)]) for _ in range(r.randint(0, 60)))
        assert suffix_array.suffix_array(data).tolist() == sorted(range(len(data)), key=lambda i: data[i:])


def brute_cuts(rows, length=50):
    first, out = {}, []
    for i, t in sorted(rows, key=lambda x: x[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first.setdefault(b[k : k + length], i) < i:
                gone[k : k + length] = b"\x01" * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("limits", [(50_000, 8), (0, 8), (50_000, 1)])
def test_suffix_dedup(docs, nothing, monkeypatch, limits):
    monkeypatch.setattr(suffix_dedup, "HOT", limits[0])
    monkeypatch.setattr(suffix_dedup, "HOT_KEYS", 10**9)
    monkeypatch.setattr(suffix_dedup, "SPLIT", limits[1])
    got = suffix_dedup.deduplicated(docs).collect()
    rows = sorted((r.doc_id, r._removed, r._spans, hashlib.sha256(bytes(r._kept)).hexdigest()) for r in got)
    assert rows == brute_cuts(texts())
    assert suffix_dedup.deduplicated(nothing).count() == 0


def test_suffix_dedup_rows(spark, monkeypatch):
    """Ids of any type and none, texts of one id, whole copies, pieces of long texts, names that meet those inside."""
    monkeypatch.setattr(suffix_dedup, "PIECE", 120)
    monkeypatch.setattr(suffix_dedup, "PART", 500)
    monkeypatch.setattr(suffix_dedup, "PLACES", 5)
    monkeypatch.setattr(suffix_dedup, "SPLIT", 10**9)
    a, b, c = (words(60, k) for k in (51, 52, 53))
    rows = [("b", a), ("c", a), ("c", b), ("d", b[:100] + c), ("a", "short"), (None, a), (None, b), (None, c[:60] + "!" + c[61:]), ("e", a[30:140] + b[20:130])]
    # Documents in order: by id, of one id by text, those without an id last.
    order = {row: n for n, row in enumerate(sorted(rows, key=lambda r: (r[0] is None, r[0] or "", r[1])))}
    plain = spark.createDataFrame([(*row, "s", 1, 2) for row in rows], "doc_id string, text string, s string, doc int, t int").repartition(3)
    got = suffix_dedup.deduplicated(plain)
    assert got.columns == [*plain.columns, "_kept", "_removed", "_spans"]
    found = {(r.doc_id, r.text): (r._removed, r._spans) for r in got.collect()}
    assert len(found) == len(rows)
    copies = {("c", a), (None, a), (None, b)}
    assert all(found[row] == (len(row[1].encode()), 1) for row in copies)
    rest = [row for row in rows if row not in copies]
    nameless = [row for row in rest if row[0] is None]
    want = {n: (gone, spans) for n, gone, spans, _ in brute_cuts([(order[row], row[1]) for row in rest])}
    assert all(found[row] == want[order[row]] for row in rest) and len(nameless) == 1
    twice = suffix_dedup.deduplicated(spark.createDataFrame([(1, a), (1, a)], "doc_id long, text string")).collect()
    assert [r._removed for r in twice] == [0, 0]


def test_pipeline_stages_carry_columns(spark, tmp_path):
    """Clashing names, nulls, empty texts, repeated rows and an empty table in every stage."""
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([(1, 1), (2, 0), (3, None)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, words(20, 61)), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = ("score", "_score", "row", "h", "t", "u", "id", "class", "spans", "_kept", "_id", "_h")
    rows = [(1, words(80, 62), "en", "a"), (1, words(80, 62), "en", "a"), (2, "ab " * 300, "en", "a"), (3, None, None, None), (4, "", "en", "a"), (None, words(80, 63), "en", "a"), (5, words(20, 61), "en", "a")]
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` int" for n in names))
    for name, stage in pipeline.STAGES[:4]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns, name
        assert all([r[n] for n in names] == list(range(len(names))) for r in got.collect()), name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    assert sorted(r.doc_id or 0 for r in pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()) == [0, 1, 2, 3, 5]
    assert sorted(r.doc_id or 0 for r in pipeline.benchmarks(spark, docs, str(tmp_path)).collect()) == [0, 1, 1, 2, 3, 4]
    last = pipeline.pieces(spark, docs, str(tmp_path)).collect()
    assert len(last) == len(rows) and all(r.lossless for r in last)


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    from pathlib import Path

    for name in ("documents", "labels", "benchmark"):
        (tmp_path / f"{name}.parquet").symlink_to(Path(f"/root/testdata/sf0.001/{name}.parquet"))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert 0 < len(got) < docs.count() and all(r.lossless for r in got)
    bad = {r.doc_id for r in spark.read.parquet(f"{tmp_path}/labels.parquet").where("quality = 0").collect()}
    assert not bad & {r.doc_id for r in got}


def brute_components(rows, similarity=0.8):
    cut = [(t or "").encode().lower().split() for _, t in rows]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in cut]
    of = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if of[i] != of[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                of = [of[j] if x == of[i] else x for x in of]
    return of


def near_copies():
    r = random.Random(11)
    rows = []
    for k in range(12):
        base = words(90, 100 + k).split()
        rows.append(" ".join(base))
        for n in (1, 1, 2, 3, 5):
            other = list(base)
            for at in r.sample(range(90), n):
                other[at] = f"new{r.randrange(10**6)}"
            rows.append(" ".join(other))
    return [*enumerate(rows), *((100 + i, t) for i, t in texts())]


def test_pipeline_near_duplicates(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {(r.id, r["class"]) for r in simhash.similar_documents(docs).collect()}
    of = brute_components(rows)
    want = {}
    for (i, _), c in zip(rows, of, strict=True):
        want.setdefault(c, set()).add(i)
    got = {}
    for i, c in found:
        got.setdefault(c, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    left = pipeline.near_duplicates(spark, docs, "")
    assert {r.doc_id for r in left.collect()} == {min(c) for c in want.values()}


def test_pipeline_near_duplicates_without_ids(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    a, b, c = words(60, 31), words(60, 32), words(60, 33)
    docs = spark.createDataFrame([(None, a), (None, a), (None, b), (None, b + " tail"), (1, c), (None, c)], "doc_id long, text string")
    left = sorted((r.doc_id or 0, r.text) for r in pipeline.near_duplicates(spark, docs, "").collect())
    assert len(left) == 3 and left[-1] == (1, c) and a in {t for _, t in left} and {b, b + " tail"} & {t for _, t in left}


def test_pieces_of_each_occurrence(spark):
    path = queries.vocabulary("piece_bpe_32k.model")
    docs = spark.createDataFrame([(i, "international " * 30) for i in range(30)], "doc_id long, text string")
    got = piece_codec.decode(piece_codec.encode(docs, path, dropout=0.3, seed=1), path).collect()
    assert all(r.decoded == r.text for r in got)
    pieces = piece_codec.Pieces(path)
    cuts = [tuple(pieces.decoded[i] for i in r.ids) for r in got]
    assert len(set(cuts)) == 30
    # Within one document, the word is cut in more than one way.
    ways = [{tuple(x.split(b"|")) for x in b"|".join(c).split(b"| ")} for c in cuts]
    assert min(map(len, ways)) > 4
