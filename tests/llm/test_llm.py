"""The operators for training data against brute force, on small tables with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelwork.llm import chat, decontaminate, graph, language, lines, mixing, neardup, quality, sharding, substrings, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n, words=400):
    r = random.Random(seed)
    return " ".join(r.choice("abcdefghijklmnopqrstuvwxyz") * r.randint(1, 2) + str(r.randint(0, words)) for _ in range(n))


def odd_rows():
    base = prose(1, 120)
    w = base.split()
    near = " ".join(w[:50] + ["changed"] + w[51:])
    rows = [
        (0, base, "en", "a"), (1, near, "en", "a"), (2, base, "de", "b"), (3, None, None, None), (4, "", "en", ""), (5, " \t\n", "en", "b"), (6, "one two", "fr", "c"),
        (7, "one two", "fr", "c"), (8, prose(2, 9000), "en", "a"), (9, "ä ß É 漢字  x \x1cy", "de", "b"), (10, "x\n" * 60 + "x", "en", "a"), (10, "x\n" * 60 + "x", "en", "a"),
        (11, prose(3, 60) + "\n" + prose(4, 30) + "\n" + prose(3, 60), "en", "b"), (12, prose(5, 40) + " " + base[:200] + " " + prose(6, 40), "es", "d"), (None, base, "en", None),
    ]
    return [(*r, 0) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    # columns that operators use themselves, and one of a name that needs quoting
    return spark.createDataFrame(odd_rows(), SCHEMA).withColumns({"n_words": F.lit("mine"), "slot": F.lit(1), "bands": F.lit(2), "a b.c": F.lit(3)})


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def texts():
    return [(r[0], r[1] or "") for r in odd_rows()]


def test_quality_signals(docs, none):
    got = Counter(tuple(r) for r in quality.quality_signals(docs, ["doc_id", "n_words"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat").collect())
    want = Counter()
    for i, t in texts():
        w = WORD.findall(t)
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        repeat = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        covered, longest = set(), 0
        at = defaultdict(list)
        for k in range(len(w) - 7):
            at[tuple(w[k : k + 8])].append(k)
        for k in range(len(w) - 7):
            best = 0
            for other in at[tuple(w[k : k + 8])]:
                if other != k:
                    n = 0
                    while max(k, other) + n < len(w) and w[k + n] == w[other + n]:
                        n += 1
                    best = max(best, n)
            longest = max(longest, best)
            covered |= set(range(k, k + best))
        ls = [x for x in t.split("\n") if WORD.search(x)]
        want[i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(ls) - len(set(ls)), len(repeat), len(covered), longest] += 1
    assert got == want
    assert quality.quality_signals(none, ["doc_id"]).count() == 0


def test_long_passage_repeated_twice(spark):
    words = [f"w{k}" for k in range(2500)]
    rows = [(1, " ".join(words + words[:500])), (2, " ".join(words + words[:90])), (3, " ".join(words))]
    got = {r.doc_id: (r.longest_repeat, r.gone) for r in quality.quality_signals(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).select("doc_id", "longest_repeat", quality.repetitive().alias("gone")).collect()}
    assert got == {1: (500, True), 2: (90, False), 3: (0, False)}


def test_suffix_order_of_a_period():
    keys = np.array([1, 2, 1, 2, 1, 2, 9], np.uint64)
    assert quality.longest_common(keys, np.zeros(7, np.int64)).tolist() == [4, 3, 4, 3, 2, 1, 0]


def shingles(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components_of(sets, percent):
    low = {i: i for i in sets}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                low[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def test_near_duplicates(spark, docs, none):
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(odd_rows())
    sets = {i: shingles(t) for i, t in texts() if i is not None}
    want = components_of(sets, 75)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    assert neardup.near_duplicates(none).count() == 0


def test_near_duplicates_of_a_family(spark):
    r = random.Random(7)
    base = prose(11, 160).split()
    rows = []
    for i in range(120):  # edited copies of one text, like it more than one another
        w = list(base)
        for _ in range(r.randint(1, 9)):
            w[r.randrange(len(w))] = f"edit{r.randint(0, 10**6)}"
        rows.append((i, " ".join(w)))
    sets = {i: shingles(t) for i, t in rows}
    want = components_of(sets, 75)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want


@pytest.mark.parametrize("size", [400_000, 7])
def test_components_of_chains(spark, monkeypatch, size):
    monkeypatch.setattr(graph, "EDGES_PER_PART", size)
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (None, 5), (7, 7)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_substrings(docs, none):
    got = {}
    for r in substrings.remove_substrings(docs, chunk_bytes=3000).collect():
        got.setdefault(r.doc_id, set()).add((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    first = {}
    rows = sorted(((i, t.encode()) for i, t in texts() if i is not None), key=lambda x: x[0])
    for i, b in rows:
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    for i, b in rows:
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1]))
        assert got[i] == {(len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())}
    assert len(got[None]) == 1 and next(iter(got[None]))[1] == 0
    assert substrings.remove_substrings(none).count() == 0


def test_multikey_sort():
    words = np.random.default_rng(1).integers(0, 3, (500, 5)).astype(np.uint64)
    assert [tuple(words[i]) for i in substrings.multikey_sort(words)] == sorted(map(tuple, words))


def test_token_counts(docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path())
    got = Counter((r.doc_id, r.n, r.within) for r in tokens.prefix_counts(docs).select("doc_id", tokens.total(F.col("token_counts")).alias("n"), tokens.words_within(F.col("token_counts"), 10).alias("within")).collect())
    want = Counter()
    for i, text in texts():
        n = len(t.encode(text, add_special_tokens=False))
        within = sum(len(t.encode(text[: m.end()], add_special_tokens=False)) <= 10 for m in list(WORD.finditer(text))[:40])
        want[i, n, within] += 1
    assert got == want
    assert tokens.prefix_counts(none).count() == 0


def test_token_counts_of_special_strings(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path())
    rows = [(0, "a<|endoftext|>b <|startoftext|>"), (1, "it's WE'LL é don't 12345 ...  x"), (2, "<|endoftext |>"), (3, "long" * 3000)]
    got = {r.doc_id: r.n for r in tokens.prefix_counts(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", tokens.total(F.col("token_counts")).alias("n")).collect()}
    assert got == {i: len(t.encode(x, add_special_tokens=False)) for i, x in rows}


def test_mixing(docs, none):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(odd_rows())
    sizes = defaultdict(int)
    for r in odd_rows():
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    goal, fixed = {}, set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in fixed)
        open_ = [s for s in order if s not in fixed]
        goal = {s: 3 * sizes[s] if s in fixed else left * weight[s] / sum(weight[o] for o in open_) for s in order}
        over = {s for s in open_ if goal[s] > 3 * sizes[s]}
        if not over:
            break
        fixed |= over
    taken = defaultdict(int)
    for r in got:
        assert (r.source_size, round(r.target, 6)) == (sizes[r.source], round(goal[r.source], 6)) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(goal[s] - taken[s]) <= mixing.QUANTUM for s in order) and sum(taken.values()) == sum(sizes.values())
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(docs).collect()))
    assert mixing.mix_sources(none).count() == 0


def test_mixing_against_a_queue(spark):
    """The order over ranges, cut at a budget, is that of one queue of all quanta."""
    r = random.Random(9)
    rows = [(k, r.choice(["a", "b", "c", None]), r.choice([0, 1, 5, 700, r.randint(1, 400)])) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long")
    targets = mixing.source_targets(docs)
    served = mixing.quanta(docs, targets, 9000.0)
    queue = sorted(((q.finish_time, q.source is not None, q.source or "", q.doc_id, q.copy, q.quantum, q.words) for q in served.collect()))
    want, used = defaultdict(int), 0
    for _t, has, source, doc, _c, _q, words in queue:
        part = min(words, 9000 - used)
        if part <= 0:
            break
        want[doc] += part
        used += part
    assert used == 9000
    got = {x.doc_id: x.n for x in mixing.mixed(served).groupBy("doc_id").agg(F.sum("taken").alias("n")).collect()}
    assert got == dict(want)
    # the order within a source is that of its shuffled documents, served in turn, and no time is left out before the cut
    goal = {x.source: (x.source_size, x.target) for x in targets.collect()}
    first = {}
    for q in served.collect():
        if q.copy == 0 and q.quantum == 0:
            first[q.doc_id] = round(q.finish_time * goal[q.source][1]) - q.words
    size = {k: n for k, _s, n in rows}
    for s in goal:
        own = sorted((first[k], k) for k, src, n in rows if src == s and k in first)
        assert all(a + size[k] <= b for (a, k), (b, _) in zip(own, own[1:], strict=False))


def test_sharding(spark, docs, none):
    got = sharding.shard_documents(docs, n_shards=3).collect()
    assert len(got) == len(odd_rows())
    crc = Counter((r.doc_id, r.size, r.text_crc32) for r in got)
    assert crc == Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in odd_rows())
    for s in {r.shard for r in got}:
        places = sorted(r.slot for r in got if r.shard == s)
        assert places == list(range(len(places)))
    assert sharding.shard_documents(none).count() == 0

    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same " * 20)).otherwise(F.repeat(F.col("id").cast("string"), 20)).alias("text"))
    loads = [r.b for r in sharding.shard_documents(many).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(loads) == 24 and max(loads) < 1.05 * min(loads)  # a third of the rows are one text


def test_equal_texts_share_a_shard_unless_larger_than_one(spark):
    rows = [(k, "same " * 30) for k in range(40)] + [(100 + k, prose(500 + k, 30)) for k in range(200)] + [(1000 + k, "huge " * 30) for k in range(150)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), n_shards=4).collect()
    assert len({r.shard for r in got if r.doc_id < 100}) == 1 and len({r.shard for r in got if r.doc_id >= 1000}) == 4
    loads = Counter()
    for r in got:
        loads[r.shard] += r.size
    assert max(loads.values()) < 1.05 * min(loads.values())


def test_stored_map_is_edited(spark, tmp_path):
    folder = str(tmp_path / "map")
    few = [(k, prose(900 + k, 20)) for k in range(150)]
    more = few + [(1000 + k, prose(5000 + k, 20)) for k in range(150)] + [(2000 + k, "one text " * 9) for k in range(20)]
    place = lambda rows: {r.doc_id: (r.virtual_slot, r.shard, r.size) for r in sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), n_shards=5, n_slots=64, folder=folder).collect()}
    versions = lambda: {v: {r.virtual_slot: r.shard for r in rows} for v, rows in groups(spark.read.parquet(folder).collect()).items()}

    def groups(rows):
        out = defaultdict(list)
        for r in rows:
            out[r.version].append(r)
        return out

    first = place(few)
    assert place(few) == first and set(versions()) == {1}
    second = place(more)
    stored = versions()
    assert set(stored) == {1, 2} and all(second[k][0] == first[k][0] for k in first)
    assert {s: d for s, d, _ in second.values()} == stored[2]
    stay = sum(stored[2][s] == d for s, d in stored[1].items())
    assert stay >= len(stored[1]) / 2 and place(more) == second and set(versions()) == {1, 2}
    loads = Counter()
    for _s, d, n in second.values():
        loads[d] += n
    assert max(loads.values()) < 1.25 * min(loads.values())


def test_growing_moves_only_into_the_new_shard(spark, docs):
    slotted = sharding.with_slots(sharding.sized_records(docs), 3, 64)
    loads = sharding.slot_loads(slotted)
    first = sharding.first_map(loads, 3)
    before = {r.virtual_slot: r.shard for r in first.collect()}
    after = sharding.grown_map(first, loads).collect()
    assert all(r.version == 2 and r.shard in (before[r.virtual_slot], 3) for r in after) and len(after) == len(before)


def test_reply_trees(spark):
    nodes = [(1, 0, None, 0.0), (1, 1, 0, 1.0), (1, 2, 0, 2.0), (1, 3, 1, 5.0), (1, 4, 3, None), (2, 0, 9, 1.0), (None, 0, None, 1.0), (3, 0, 1, 0.0), (3, 1, 0, 0.0)]
    df = spark.createDataFrame(nodes, "tree long, node long, parent long, score double")
    got = {(r.tree, r.branch, r.depth, r.node) for r in chat.root_to_leaf(df, None).collect()}
    assert got == {(1, 1, 1, 0), (1, 1, 2, 1), (1, 1, 3, 3), (1, 1, 4, 4), (1, 2, 1, 0), (1, 2, 2, 2), (2, 1, 1, 0), (None, 1, 1, 0)}
    assert chat.root_to_leaf(df.limit(0)).count() == 0


def test_chat_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "\\", "\\<|end|>", "<\\|end|>", "<|turn|>assistant<|body|>x<|end|>", "", None, "[INST][/INST]<<SYS>>", "ä\n漢", "a\\\\n", "<<|end|>|end|>"]
    rows = [(k, t, role, hard[(k + t) % len(hard)]) for k in range(11) for t, role in enumerate(["system", "user", "assistant", "user", "assistant"])] + [(20, 0, "<|end|>", "x"), (20, 1, None, "y"), (None, None, "assistant", "z")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.format_reply_trees(chat.threads(table)).select("tree", chat.read_chats(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), "formatted").collect()
    want = defaultdict(list)
    for k, _t, role, text in rows:
        want[k].append((role or "", text or ""))
    assert {r.tree: [tuple(t) for t in r.turns] for r in made} == dict(want)
    assert {r.tree: r.loss for r in made} == {k: "".join(t for role, t in v if role == "assistant") for k, v in want.items()}
    for r in made:
        for mark in ("<s>", "</s>", "[INST]", "[/INST]"):
            assert mark not in r.formatted
    assert chat.format_reply_trees(chat.threads(table.limit(0))).count() == 0


def test_languages(spark, none):
    r = random.Random(2)
    parts = {"en": ["the", "ing", "th", "and", "wh"], "de": ["der", "sch", "ung", "keit", "ü"], "fr": ["eau", "tion", "é", "ou", "le"], "es": ["ción", "ñ", "que", "os", "ll"]}
    rows = [(k, "".join(r.choice(parts[lang]) + r.choice(["", " ", "a "]) for _ in range(60)), lang) for k, lang in enumerate(["en", "de", "fr", "es"] * 60)]
    rows += [(1000, None, "en"), (1001, "123 !", "en"), (1002, "", None), (1003, "the thing and the", None), (None, "ñ que os", "es")]
    got = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    held = [k for k, _t, lang in rows if k is not None and lang and k < 1000 and zlib.crc32(str(k).encode()) % 4 == 2]
    assert all(by[k].held_out for k in held) and sum(by[k].held_out for k in by if k is not None and k < 1000) == len(held)
    assert sum(by[k].lang_pred == rows[k][2] for k in held) / len(held) >= 0.95
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in (1000, 1001, 1002)) and by[1003].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got)
    assert language.identify(none).count() == 0
    assert {r.lang_pred for r in language.identify(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).collect()} == {"und"}


def test_languages_of_a_family_meet_in_pairs():
    r = random.Random(3)
    parts = {"en": ["the", "ing", "wh"], "de": ["der", "sch", "ung"], "nl": ["het", "ij", "een"], "sv": ["och", "är", "att"]}
    make = lambda lang: "".join(r.choice(parts[lang]) + r.choice(["", " "]) for _ in range(40))
    langs = list(parts) * 30
    model = language.fit([make(x) for x in langs], langs)
    assert model.languages == [["de", "en", "nl", "sv"]] and len(model.language_weights[0]) == 6
    assert language.predict(model, [make(x) for x in langs])[0] == langs
    # 1 beats 0 and 2 narrowly, 0 beats 2 by far: votes count before margins; in a ring the margins decide
    best, least = language.votes(np.array([[-0.1, 0.5], [9.0, -0.2], [0.1, 0.4]]), 3)
    assert best.tolist() == [1, 0] and least.tolist() == [0.1, -0.2]


def test_votes_against_all_pairs():
    """predict() row by row against machines asked one after another."""
    r = random.Random(6)
    parts = {"en": ["the", "ing"], "de": ["der", "sch"], "nl": ["het", "ij"], "fr": ["eau", "tion"], "es": ["ción", "que"], "ja": ["です", "ます"]}
    make = lambda lang: "".join(r.choice(parts[lang] + ["a ", "e ", "o"]) for _ in range(12))
    langs = list(parts) * 15
    model = language.fit([make(x) for x in langs], langs)
    texts = [make(x) for x in langs] + ["", "a", "é"]
    got, _score = language.predict(model, texts)
    for text, lang in zip(texts, got, strict=True):
        bucket, _doc, counts = language.trigrams(*language.lowered([text]))
        ask = lambda w: sum(round(float(w[b]) * 65536) for b in bucket) / 65536 * 100 / max(1, counts[0]) + w[-1]  # noqa: B023, E731
        f = int(np.argmax([ask(w) for w in model.family_weights]))
        members = model.languages[f]
        won, total = Counter(), Counter()
        for w, (i, j) in zip(model.language_weights[f], language.pairs(len(members)), strict=True):
            m = ask(w)
            won[i if m >= 0 else j] += 1
            total[i] += m
            total[j] -= m
        assert lang == members[max(range(len(members)), key=lambda k: (won[k], total[k], -k))]


def test_training_rows_with_one_doc_id(spark):
    rows = [(1 if zlib.crc32(b"1") % 4 != 2 else 5, f"text number {k} of one id", "en") for k in range(3000)] + [(k, f"ein anderer text {k}", "de") for k in range(30)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"h": F.lit(1), "k": F.lit(2), "n": F.lit(3)})
    n = Counter(r.lang for r in language.training_features(language.training_rows(docs)).collect())
    assert n["en"] == 400 and n["de"] == sum(zlib.crc32(str(k).encode()) % 4 != 2 for k in range(30))
    many = spark.createDataFrame([(k, f"text {k}", f"l{k % 300}") for k in range(6000)], "doc_id long, text string, lang string")
    learned = Counter(r.lang for r in language.training_rows(many).select("lang").collect())
    assert len(learned) == 300 and max(learned.values()) <= 10


def test_decontamination(spark):
    item = "If Anna has 3 red apples and Anna buys 12 km of rope from the old shop near the green river , how many days will that take her brother"
    asked_again = item.replace("Anna", "Bob").replace("3", "41").replace("12 km", "7 miles")
    mixed_up = item.replace("has 3 red apples and Anna", "has 3 red apples and Cleo")
    rows = [(1, f"Some text. {item} more text here"), (2, f"Some text before {asked_again}. And so on"), (3, f"We say {mixed_up} here"), (4, prose(9, 100)), (5, None), (6, ""), (None, item), (7, item.upper()), (7, item.upper()), (8, " ".join(item.split()[:9]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hash", F.lit(1))
    items = spark.createDataFrame([(10, item), (11, "too short"), (12, None), (None, item)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.exact for r in decontaminate.benchmark_leaks(docs, items).collect()}
    assert got.get((1, 10)) is True and got.get((2, 10)) is False
    assert not {(3, 10), (4, 10), (8, 10)} & set(got) and {i for i, _ in got} <= {1, 2, 7}
    assert decontaminate.benchmark_leaks(docs.limit(0), items).count() == 0 and decontaminate.benchmark_leaks(docs, items.limit(0)).count() == 0


def test_decontamination_of_reworded_items(spark):
    tom = "Tom has 3 apples. Tom gives 2 to Ann. How many apples does Tom have left?"
    rope = "If Anna has 3 red apples and Anna buys 12 km of rope from the old shop near the green river , how many days will that take her brother"
    words = rope.split()
    rows = [
        (1, tom.replace("Tom", "Lisa")), (2, rope.replace("Anna", "Mary Ann")), (3, " ".join(words[:15] + ["very"] + words[15:])), (4, " ".join(words[:15] + words[16:])),
        (5, "READ THIS. " + rope.upper()), (6, rope.lower().replace("anna", "lisa")), (7, rope.upper().replace("ANNA", "LISA")),
        (9, " ".join(words[18:] + words[:9] + words[9:18])), (10, "The old shop near the green river has red apples and rope. Tom has many apples left to give."),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.exact for r in decontaminate.benchmark_leaks(docs, spark.createDataFrame([(1, tom), (2, rope)], "item_id long, text string")).collect()}
    assert got == {(1, 1): False, (2, 2): False, (3, 2): True, (4, 2): True, (5, 2): True, (6, 2): False, (7, 2): False}


def line_shingles(line):
    low = line.lower()
    return frozenset(low[j : j + lines.SHINGLE] for j in range(len(low) - lines.SHINGLE + 1)) or frozenset([low])


def test_decontamination_of_short_items(spark):
    items = [(1, "what is two plus two"), (2, "too short"), (3, "4 8 15 16 23 42 4"), (4, "..."), (5, "")]
    rows = [(1, "We ask: What is two, plus two? Nobody knows"), (2, "it is too short to say"), (3, "Too short!"), (4, "the numbers 4 8 15 16 23 42 4 again"), (5, "what is two plus three"), (6, "..."), (7, ""), (8, "numbers 4 8 15 16 23 42 5"), (9, "what is two plus two"), (9, "what is two plus two")]
    got = {(r.doc_id, r.item_id): r.exact for r in decontaminate.benchmark_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 1): True, (3, 2): True, (4, 3): True, (9, 1): True}


def test_lines(spark, none):
    r = random.Random(4)
    long = [prose(20 + k, 12) for k in range(6)]
    edited = long[0][:60] + "!" + long[0][60:]
    cyrillic = "Съешь же ещё этих мягких французских булок да выпей чаю"
    rows = [
        (5, "\n".join([long[0], "short", long[1]])), (2, edited + "\nshort\n" + long[2] + "\nSHORT\nabc\n\n \n"), (9, long[1].upper() + "\n\n" + long[3]), (9, long[1].upper() + "\n\n" + long[3]), (3, None), (4, ""), (None, long[0]),
        (6, cyrillic + "\n漢字漢字漢字漢字漢\nabc"), (7, cyrillic.upper() + "\nx漢字漢字漢字漢字漢\n" + cyrillic.replace("этих", "тех")), (8, "aaaaaaa\naaaaaaaaaaa"), (11, "one text of an id\nabc"), (11, "another text of it\nabc"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("line", F.lit(0))
    sets, place = {}, {}
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            if i is not None and line.strip():
                sets[i, t, k] = line_shingles(line)
    want = components_of(sets, lines.PERCENT)
    # of one doc_id with several texts a hash decides which comes first
    simple = {k: v for k, v in want.items() if k[0] != 11}
    found = lines.duplicate_lines(docs).collect()
    got = {(r.doc_id, r.line): (r.first_doc_id, r.first_line) for r in found if r.doc_id != 11}
    assert got == {(i, k): (v[0], v[2]) for (i, _t, k), v in simple.items() if (i, _t, k) != v} and (7, 0) in got and (2, 3) in got
    assert sorted((r.first_doc_id, r.first_line) for r in found if r.doc_id == 11) == [(2, 4), (2, 4)]
    assert lines.duplicate_lines(none).count() == 0
    cleaned = {(r.doc_id, r.text): r.clean_text for r in lines.cleaned_documents(docs).collect()}
    for i, t in rows:
        if i is None or i != 11:
            assert cleaned[i, t] == (t if t is None or i is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in got))
    assert lines.cleaned_documents(none).count() == 0


def test_lines_of_a_family_and_blocks(spark, monkeypatch):
    """Many edited copies of a few lines, more than a block holds, against all pairs."""
    from reelwork.llm import links

    monkeypatch.setattr(links, "BLOCK", 8)
    monkeypatch.setattr(links, "HUB_PAIRS", 8)
    r = random.Random(8)
    base = [prose(40 + k, 14) for k in range(3)]
    made = []
    for k in range(150):
        w = base[k % 3].split()
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = f"edit{r.randint(0, 999)}"
        made.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    want = components_of({k: line_shingles(t) for k, t in enumerate(made)}, lines.PERCENT)
    got = {r.doc_id: r.first_doc_id for r in lines.duplicate_lines(docs).collect()}
    assert got == {k: v for k, v in want.items() if k != v} and len(set(want.values())) > 3
    monkeypatch.undo()


def test_shared_bands(spark, monkeypatch):
    from reelwork.llm import links

    r = random.Random(5)
    rows = [(r.randint(-(2**63), 2**63 - 1), [b << 57 for b in r.choices(range(-60, 60), k=3)]) for _ in range(60)]
    rows += [(r_, b) for r_, b in rows[:20]] + [(1, []), (2, None)]
    pairs = {(b, i) for i, x in rows for b in x or []}
    many = Counter(b for b, _ in pairs)
    table = spark.createDataFrame(rows, "id long, bands array<long>")
    got = sorted((x.band, x.id) for x in links.shared_bands(links.packed_bands(table)).collect())
    assert got == sorted(x for x in pairs if many[x[0]] > 1)

    # taken in small parts, with bands that become shared late
    seen, out = links.Gatherer(), set()
    every = sorted(pairs, key=lambda x: hash(x))
    for k in range(0, len(every), 7):
        b, i = seen.take(np.array([x[0] for x in every[k : k + 7]]), np.array([x[1] for x in every[k : k + 7]]))
        out |= set(zip(b.tolist(), i.tolist()))
    assert out == {x for x in pairs if many[x[0]] > 1}


def test_a_large_slot_is_numbered_in_parts(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 50 != 0, F.col("id")).alias("doc_id"), F.when(F.col("id") < 1100, "the same text").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"))
    slotted = sharding.with_slots(sharding.sized_records(rows), 3, 8)
    loads = sharding.slot_loads(slotted)
    made = sharding.first_map(loads, 3)
    places = [(r.shard, r.slot) for r in sharding.assigned(slotted, made, loads, per_part=40).collect()]
    assert len(places) == 3000
    for shard in range(3):
        mine = sorted(p for s, p in places if s == shard)
        assert mine == list(range(len(mine)))
