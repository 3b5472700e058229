"""Quality rules: word counts, and repeated passages found with a suffix array.

Each document's word suffixes are sorted by prefix doubling. The longest common prefix of
neighbours in that order bounds the maximal repeated substrings; the union of their spans
gives the covered part of a document, and the largest prefix its longest repeat.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelwork.llm.kernel import U64, inside, mix, per_doc, prefix_hash, rolled, span_hash, words_of
from reelwork.llm.shared import documents, map_text

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A repeated substring counts from this many words.
MIN_REPEAT = 8
#: A document goes if repeats cover more than this percentage of its words ...
MAX_COVERED_PERCENT = 40
#: ... or if one repeat is longer than this many words and than this percentage of the words.
#: Two copies cover twice a repeat's length, so the share must stay well below half of the covered one to tell anything.
MAX_LONGEST = 100
MAX_LONGEST_PERCENT = 10

SIGNALS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, longest_repeat long"
_BLANK = " \t\n\v\f\r"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs twice or more."""
    s = np.sort(keys)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys


def longest_common(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest string from it that the document has elsewhere too.

    keys: a hash of the word, salted with its document. The suffixes are ranked by 1, 2, 4 ...
    words until all differ; the prefixes of neighbours then follow from the ranks.
    """
    n = len(keys)
    end = np.searchsorted(doc, doc, "right")
    rank = np.unique(keys, return_inverse=True)[1].astype(np.int64) + 1
    levels, length = [rank], 1
    while rank.max(initial=0) < n:
        ahead = np.zeros(n, np.int64)
        ok = np.flatnonzero(np.arange(n) + length < end)
        ahead[ok] = rank[ok + length]
        rank = np.unique(rank * (n + 1) + ahead, return_inverse=True)[1].astype(np.int64) + 1
        levels.append(rank)
        length *= 2
    order = np.empty(n, np.int64)
    order[rank - 1] = np.arange(n)
    a, b = order[:-1], order[1:]
    common = np.zeros(max(0, n - 1), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        ok = (x < end[a]) & (y < end[b])
        same = ok.copy()
        same[ok] = levels[k][x[ok]] == levels[k][y[ok]]
        common += same * (1 << k)
    longest = np.zeros(n, np.int64)
    longest[a] = common
    longest[b] = np.maximum(longest[b], common)
    return longest


def repeats(hashes: np.ndarray, doc: np.ndarray, n_docs: int, least: int = MIN_REPEAT) -> tuple[np.ndarray, np.ndarray]:
    """Words covered by repeated strings of at least so many words, and the longest of them, by document."""
    covered, longest = np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64)
    salted = mix(hashes + mix(doc.astype(U64) + U64(1 << 63)))
    at = inside(doc, least)
    with_repeat = np.unique(doc[at[repeated(rolled(salted, least)[at])]])
    if not len(with_repeat):
        return covered, longest
    own = np.flatnonzero(np.isin(doc, with_repeat))
    common = longest_common(salted[own], doc[own])
    common[common < least] = 0
    edge = np.zeros(len(own) + 1, np.int64)
    hit = np.flatnonzero(common)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + common[hit], -1)
    np.add.at(covered, doc[own], np.cumsum(edge[:-1]) > 0)
    np.maximum.at(longest, doc[own], common)
    return covered, longest


def signals_of(data: np.ndarray, offsets: np.ndarray, texts) -> list[np.ndarray]:
    words = words_of(data, offsets)
    n_docs = len(offsets) - 1
    hashes = span_hash(prefix_hash(data), words.starts, words.ends)
    salted = mix(hashes + mix(words.doc.astype(U64) + U64(1 << 63)))
    at = inside(words.doc, 3)
    twice = at[repeated(rolled(salted, 3)[at])]
    edge = np.zeros(len(words.starts) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + 3, -1)
    in_repeat = np.cumsum(edge[:-1]) > 0
    covered, longest = repeats(hashes, words.doc, n_docs)
    dup = np.zeros(n_docs, np.int64)
    for i, text in enumerate(texts()):
        if "\n" in text:
            lines = [x for x in text.split("\n") if x.strip(_BLANK)]
            dup[i] = len(lines) - len(set(lines))
    # code points of words: the bytes of the words that don't continue a character
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
    word_chars = chars[words.ends] - chars[words.starts]
    return [words.counts(), per_doc(word_chars, words.first), per_doc(_SYMBOL[data], offsets), dup, per_doc(in_repeat, words.first), covered, longest]


def quality_signals(docs: DataFrame, carry: list[str], text: str = "text") -> DataFrame:
    """carry's columns and the signals of each whole text, in one pass without a shuffle.

    Null and empty texts have zeros. Repeated rows each get their own row.
    """
    return map_text(docs, signals_of, SIGNALS, carry, text)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def repetitive() -> Column:
    """The verdict on repeated substrings."""
    longest = F.col("longest_repeat")
    return (100 * F.col("covered_words") > MAX_COVERED_PERCENT * F.col("n_words")) | ((longest > MAX_LONGEST) & (100 * longest > MAX_LONGEST_PERCENT * F.col("n_words")))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_signals(documents(spark, sf_dir), ["doc_id"])
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & ~repetitive()).alias("kept"), "covered_words", "longest_repeat",
    )
