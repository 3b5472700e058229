"""Source divergence and filter interaction against brute force on odd rows."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelwork.llm import divergence, filters

SCHEMA = "doc_id long, text string, lang string, source string, n int"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def corpus():
    r = random.Random(7)
    stock = ["The", "the", "THE,", "a-b-a", "ÄPFEL", "äpfel", "x1y", "漢字", "don't", "foo.", "(foo)", "foo", "...", "12", "é", "z\x1cq"]
    rows = []
    for i in range(160):
        words = [r.choice(stock) for _ in range(r.randint(0, 14))]
        rows.append((i, r.choice([" ", "\n", "\t "]).join(words), r.choice(["en", "en", "en", "de", None, ""]), r.choice(["a", "a", "a", "b", "ß", None, ""]), 0))
    return [*rows, (200, None, "en", "a", 0), (201, "", "fr", "only", 0), (202, " \n", "fr", "other", 0), (203, "the " * 5000, "en", "b", 0), (5, "foo foo", "en", "b", 0), (5, "foo foo", "en", "b", 0), (None, "foo the", "en", "c", 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).withColumns({"block": F.lit("mine"), "value": F.lit(1), "part": F.lit("x"), "same": F.lit(0), "E": F.lit(2)})


def share(count, total, v):
    return 1 + 10**9 * (count + 5) // (total + 5 * v)


def expected_divergence(rows, min_docs, top):
    held, said, groups = defaultdict(set), Counter(), set()
    for k, (_, text, lang, source, _) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for t in TERM.findall((text or "").translate(UPPER)):
            held[lang, t].add(k)
            said[lang, source, t] += 1
    kept = defaultdict(list)
    for (lang, t), docs_of in held.items():
        if len(docs_of) >= min_docs:
            kept[lang].append(t)
    out = []
    for lang, source in groups:
        terms, v = kept[lang], len(kept[lang])
        own = sorted(s for x, s in groups if x == lang)
        n = {s: sum(said[lang, s, t] for t in terms) for s in own}
        p = {s: [share(said[lang, s, t], n[s], v) for t in terms] for s in own}
        every = [sum(said[lang, s, t] for s in own) for t in terms]
        q = [share(x, sum(every), v) for x in every]
        pair = [(s, sum(abs(x - y) for x, y in zip(p[source], p[s], strict=True))) for s in own if s != source]
        term = [(t, x - y) for t, x, y in zip(terms, p[source], q, strict=True) if said[lang, source, t] and x > y]
        for part, found, most in (("pair", pair, None), ("term", term, top)):
            ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize(("min_docs", "top", "block"), [(3, 4, 300), (1, 50, 12 << 20), (30, 2, 1), (1000, 5, 300)])
def test_source_divergence(docs, min_docs, top, block, monkeypatch):
    monkeypatch.setattr(divergence.source_distances, "__defaults__", (7,))  # several groups a language
    got = divergence.source_divergence(docs, min_docs, top, block).select("lang", "source", "part", "item", "value", "rank").collect()
    assert sorted(map(tuple, got)) == expected_divergence(corpus(), min_docs, top)


def test_divergence_of_nothing(docs):
    assert divergence.source_divergence(docs.limit(0)).count() == 0
    assert divergence.source_divergence(docs.where("lang = 'fr' and source = 'only'")).count() == 0
    blank = divergence.source_divergence(docs.where("lang = 'fr'")).select("source", "item", "value", "rank").collect()
    assert sorted(map(tuple, blank)) == [("only", "other", 0, 1), ("other", "only", 0, 1)]


def test_each_chunk_is_cut_once(docs):
    blocks = divergence.counted_blocks(docs, 300).cache()
    assert blocks.select("block").distinct().count() == blocks.count() == 3
    cut = divergence.cut_chunks(blocks).collect()
    want = {w for _, t, *_ in corpus() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")}
    assert sorted(r["chunk_text"] for r in cut) == sorted(want)
    assert {r["chunk_text"]: r["docs"] for r in cut} == {w: sum(w in re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, *_ in corpus()) for w in want}
    blocks.unpersist()


def test_shares_are_exact(spark):
    r = random.Random(1)
    rows = [(c := r.choice([0, r.randint(0, 10**6), r.randint(0, 8 * 10**15)]), c + r.randint(0, 10**15), r.randint(1, 10**8)) for _ in range(200)]
    want = [share(*x) for x in rows]
    assert [int(divergence.shares(np.array([c]), np.array([n]), v)[0]) for c, n, v in rows] == want
    table = spark.createDataFrame([(k, *x) for k, x in enumerate(rows)], "k int, c long, n long, v long")
    assert [x[0] for x in table.orderBy("k").select(divergence.share(F.col("c"), F.col("n"), F.col("v"))).collect()] == want


def test_packed():
    for x in ([], [0], [5, 2**31 - 1, 0, 7], list(range(1000))):
        assert divergence.unpacked(divergence.packed(np.array(x, np.int64)), len(x)).tolist() == x


def filter_rows():
    r = random.Random(5)
    words = lambda n, m: " ".join(f"w{r.randint(0, m)}" for _ in range(n))
    rows = [(i, r.choice([words(r.randint(0, 200), r.choice([20, 4000])), words(120, 10**6).upper(), words(110, 10**6) + r.choice(" #$%&*|"), "same", "Same", ""]), r.choice(["en", "de", None, ""])) for i in range(120)]
    exact = " ".join(f"w{i}" for i in range(100))
    return [
        *rows, (200, None, "en"), (201, None, "de"), (None, "same", "en"), (None, None, None), (202, exact, "x"), (202, exact, "x"), (203, exact, "x"), (203, "other", "x"), (-5, exact, "y"), (204, "A" + "b" * 9, "x"), (205, "AA" + "b" * 9, "x"),
        (206, " ".join(f"w{i % 80}" for i in range(100)), "x"), (207, " ".join(f"w{i % 79}" for i in range(100)), "x"), (208, "ÄÖ漢 \x1c", "x"),
    ]


def filter_labels():
    return [(i, i % 3 % 2, int(i % 7 == 0)) for i in range(0, 150, 2)] + [(4, 0, 1), (4, None, None), (6, None, 1), (None, 1, 1), (202, 1, 0), (999, 1, 1)]


def expected_steps():
    labels = defaultdict(lambda: [False, False])
    for i, quality, toxic in filter_labels():
        if i is not None:
            labels[i][0] |= quality == 1
            labels[i][1] |= toxic == 1
    found = defaultdict(list)
    for i, text, lang in filter_rows():
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        ids = [j for j, x, _ in filter_rows() if (x or "") == t and j is not None]
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > min(ids)}
        found[lang or ""].append(({k for k, v in fails.items() if v}, *(labels[i] if i is not None else (False, False))))
    out = []
    for part, rows in found.items():
        removed_of = Counter()
        mine = []
        for order in itertools.permutations("ABCDE"):
            left, gone = rows, []
            for step, k in enumerate(order):
                out_now = [x for x in left if k in x[0]]
                again = [x for x in gone if k in x[0]]
                left, gone = [x for x in left if k not in x[0]], gone + out_now
                removed_of[k] += len(out_now)
                alone = sum(x[0] == {k} for x in rows)
                mine.append((part, "".join(order), step + 1, len(left), len(out_now), len(again), alone, sum(x[1] for x in out_now), sum(x[2] for x in out_now), k))
        out += [(*x[:-1], removed_of[x[-1]]) for x in mine]
    return sorted(out)


def test_filter_interactions(spark):
    docs = spark.createDataFrame(filter_rows(), "doc_id long, text string, lang string").repartition(3).withColumns({"E": F.lit("mine"), "same": F.lit(1), "good": F.lit(3), "part": F.lit("y"), "first": F.lit(0)})
    labels = spark.createDataFrame(filter_labels(), "doc_id long, quality int, toxic int").withColumn("text", F.lit("mine"))
    got = filters.filter_interactions(filters.cells(filters.flagged_documents(docs, labels)))
    assert sorted(map(tuple, got.collect())) == expected_steps()
    none = filters.filter_interactions(filters.cells(filters.flagged_documents(docs.limit(0), labels)))
    assert none.count() == 0
    bare = filters.filter_interactions(filters.cells(filters.flagged_documents(docs, labels.limit(0))))
    assert bare.agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0)
