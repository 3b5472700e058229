"""Leaks asked again with other names, numbers and units, in several scripts, whatever else the benchmark holds."""

import itertools
import random
import re

import numpy as np
import pytest

from reelwork.llm import casing, decontaminate

ITEMS = {
    1: "Том дал Анне семь яблок и потом Том прошёл двадцать километров по старой дороге вдоль реки до дома своей сестры . Сколько яблок осталось у него вечером ?",
    2: "Łukasz kupił trzy czerwone piłki w małym sklepie obok szkoły a potem Łukasz oddał jedną swojej siostrze przed domem przy rzece . Ile piłek mu zostało ?",
    3: "Die alte Straße führt zwanzig Kilometer am Ufer entlang und danach noch einmal drei Stunden durch den dunklen Wald bis zum Haus am See wo niemand wartet",
    4: "Η Μαρία έχει πέντε μήλα και μετά η Μαρία δίνει δύο μήλα στον αδελφό της δίπλα στο παλιό σχολείο κοντά στο ποτάμι το βράδυ",
    6: "Вчера вечером Том долго шёл домой через старый парк и потом Том тихо сел около большого окна и стал ждать письма",
    5: "if anna has 3 red apples and anna buys 12 km of rope from the old shop near the green river how many days will that take her brother",
}
AGAIN = {
    (1, 1): ITEMS[1].replace("Том", "Лев").replace("Анне", "Ольге"), (2, 1): ITEMS[1].replace("двадцать", "сорок").replace("семь", "5"), (3, 2): ITEMS[2].replace("Łukasz", "Żaneta"), (4, 2): ITEMS[2].replace("Łukasz", "Tom"), (5, 3): ITEMS[3].replace("zwanzig Kilometer", "fünfzig Meilen"),
    (6, 4): ITEMS[4].replace("Μαρία", "Ελένη"), (7, 5): ITEMS[5].replace("3", "41").replace("12 km", "٧٧ miles"), (8, 1): ITEMS[1].lower(), (10, 6): ITEMS[6].replace("Том", "Лев"), (9, 2): ITEMS[2].upper(),
}
MIXED = {20: ITEMS[6].replace("Том долго", "Лев долго"), 22: "Некоторые другие слова о погоде и о дороге вдоль реки", 23: None}


def found(spark, extra=()):
    docs = spark.createDataFrame([(i, f"Foo bar. {t} . More text") for (i, _), t in AGAIN.items()] + [(i, t) for i, t in MIXED.items()], "doc_id long, text string").repartition(3)
    items = spark.createDataFrame([*ITEMS.items(), *extra], "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in decontaminate.benchmark_leaks(docs, items).collect() if r.item_id < 100}


def test_other_scripts_and_languages(spark):
    assert found(spark) == set(AGAIN)


def test_a_name_given_in_small_letters_by_the_words_of_the_benchmark(spark):
    item = "Anna has many red apples and Anna walks along the old river to the shop where her brother waits for bread and milk"
    again = item.lower().replace("anna", "zoltan")
    docs, items = spark.createDataFrame([(1, again)], "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    assert decontaminate.benchmark_leaks(docs, items).count() == 1


@pytest.mark.parametrize(("most", "bits"), [(10, 10), (10, 16), (1 << 23, 10)])
def test_recall_does_not_fall_with_the_size_of_the_benchmark(spark, monkeypatch, most, bits):
    """With a bitmap that is full, the words that it takes for plain by mistake are settled exactly."""
    monkeypatch.setattr(decontaminate, "MOST_PLAIN", most)
    monkeypatch.setattr(decontaminate, "PLAIN_BITS", bits)
    r = random.Random(4)
    item = "Anna has many red apples and Anna walks along the old river to the shop where her brother waits for bread and milk"
    names = ["".join(r.choice("bcdfghklmnprstvz") + r.choice("aeiou") for _ in range(4)) for _ in range(60)]
    docs = spark.createDataFrame([(i, item.lower().replace("anna", n)) for i, n in enumerate(names)], "doc_id long, text string")
    filler = [(1000 + k, " ".join(f"w{k}x{j}" for j in range(100))) for k in range(40)]
    items = spark.createDataFrame([(1, item), *filler], "item_id long, text string")
    got = {x.doc_id for x in decontaminate.benchmark_leaks(docs, items).where("item_id = 1").collect()}
    assert got == set(range(len(names)))
    assert found(spark, filler) == set(AGAIN)


def test_case_of_any_script():
    text = "aZ ÄäßẞŁłЖжΣσǅ«x» 9٣ “İ” Ⱥ 漢 \U00010400\U00010428 Ẁẁ＿Ａａ é"
    data = np.frombuffer(text.encode(), np.uint8)
    lower, kind = casing.cased(data)
    at = 0
    for c in text:
        n = len(c.encode())
        low = c.lower() if len(c.lower()) == 1 and len(c.lower().encode()) == n else c
        assert lower[at : at + n].tobytes().decode() == low
        assert bool(kind[at] & casing.UPPER) == (c.isupper() or c.istitle()) and bool(kind[at] & casing.SMALL) == (c.islower() and c.isalpha())
        assert bool(kind[at] & casing.DIGIT) == c.isdecimal()
        at += n


def brute(docs, items):
    """Pairs of one alignment, by rules spelt out on strings of ASCII words without marks."""
    plain = {w.lower() for t in items.values() for w in t.split() if not w[0].isupper()}
    numbers, units, functions = set(decontaminate.NUMBER_WORDS), set(decontaminate.UNITS), set(decontaminate.FUNCTION_WORDS)

    def template(text, way):
        out = []
        for w in text.split():
            low = w.lower()
            name = (w[0].isupper() if way == 0 else low not in plain) and low not in functions
            kind = 1 if re.search("[0-9]", w) or low in numbers else 2 if low in units else 3 if name else 0
            if out and kind in (1, 3) and out[-1][0] == kind:
                out[-1] = (kind, out[-1][1] + " " + low)
            else:
                out.append((kind, low))
        return out

    def windows(tokens, item):
        rows = []
        for k in range(len(tokens) - 5):
            w = tokens[k : k + 6]
            literal = sum(kind == 0 for kind, _ in w) >= 4
            rows.append((k, ("t", *[(kind, "" if kind else v) for kind, v in w]) if literal else ("v", *[v for _, v in w]), [v for kind, v in w if kind], literal))
        return [x for x in rows if x[3]] if item and any(x[3] for x in rows) else rows

    got = set()
    for (d, text), (i, item), way in itertools.product(docs.items(), items.items(), (0, 1)):
        own, theirs = windows(template(item, way), True), windows(template(text, way), False)
        for shift in {b[0] - a[0] for a in own for b in theirs if a[1] == b[1]}:
            pairs = [(a, b) for a in own for b in theirs if a[1] == b[1] and b[0] - a[0] == shift]
            bound = {(x, y) for a, b in pairs for x, y in zip(a[2], b[2], strict=True)}
            if 100 * len(pairs) >= 60 * len(own) and len({x for x, _ in bound}) == len(bound):
                got.add((d, i))
    return got


def test_against_brute_force(spark):
    r = random.Random(8)
    words, names = [f"{a}{b}" for a in "klmnrst" for b in ("ako", "ilu", "emi", "oru")], ["Anna", "Bob", "Cleo", "Dora"]
    line = lambda n: " ".join(r.choice([*words * 2, *names, str(r.randint(1, 99)), "km", "seven"]) for _ in range(n))
    items = {i: line(r.randint(8, 22)) for i in range(25)}

    def changed(text):
        swap = dict(zip(names, r.sample(["Eve", "Finn", "Gus", "Anna"], 4), strict=True)) if r.random() < 0.7 else {n: r.choice(names) for n in names}
        out = [swap.get(w, w) if r.random() < 0.95 else r.choice(names) for w in text.split()]
        return " ".join(str(r.randint(1, 99)) if w.isdigit() else "miles" if w == "km" else w for w in (out if r.random() < 0.6 else [*out[: len(out) // 2], *line(6).split()]))

    docs = {d: f"{line(5)} {changed(items[r.randrange(25)])} {line(4)}" for d in range(150)}
    got = decontaminate.benchmark_leaks(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string"))
    want = brute(docs, items)
    mine = {(x.doc_id, x.item_id) for x in got.collect()}
    assert len(want) > 50 and want <= mine
    assert len(mine - want) <= len(want) // 20  # chains of near alignments find some more
