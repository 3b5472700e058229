"""Language identification in two steps: the family, then the language within it.

Features are the frequencies of hashed byte trigrams of the lower-cased text. A linear
support vector machine for each family against the others, and one for each pair of languages
within a family, are trained on a bounded sample of labelled rows; both use squared hinge loss.
The language is that with the most votes of its family's pairs, ties going by the margins.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelwork.llm.kernel import per_doc
from reelwork.llm.shared import documents, keep, map_text
from reelwork.session import arrow_map

#: Labelled rows that are used at most in all, and of one language; each language has LEAST_ROWS of them if there are so many.
SAMPLE_TOTAL = 2000
SAMPLE_ROWS = 400
LEAST_ROWS = 10
BUCKETS = 8192
ROUNDS = 120
UNKNOWN = "und"
#: Languages not listed are a family each.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "fy", "lb", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "be", "mk"),
}


def family_of(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang in members), lang)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and document of each byte trigram, and the trigrams of each document."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    a = data[:-2].astype(np.uint32) << 16 | data[1:-1].astype(np.uint32) << 8 | data[2:]
    bucket = ((a * np.uint32(2654435761)) >> np.uint32(32 - 13)).astype(np.int64)
    counts = np.maximum(np.diff(offsets) - 2, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(counts.sum()) + np.repeat(offsets[:-1] - (np.cumsum(counts) - counts), counts)
    return bucket[at], doc, counts


def lowered(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased texts as bytes, with a space at each end, and their offsets."""
    text = pc.utf8_lower(pa.array([f" {t} " for t in texts], pa.large_string()))
    offsets = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1)
    return np.frombuffer(text.buffers()[2], np.uint8), offsets


@dataclass
class Model:
    families: list[str]
    family_weights: np.ndarray  # families x (BUCKETS + 1), the last for the bias
    languages: list[list[str]]
    language_weights: list[np.ndarray]  # for each family, pairs() of its languages x (BUCKETS + 1)


def svm(x: np.ndarray, y: np.ndarray, decay: float = 1e-4) -> np.ndarray:
    """Weights and bias of a linear machine by accelerated gradient steps on the squared hinge loss; y is 1 or -1."""
    weigh = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = ahead = np.zeros(x.shape[1], np.float32)
    rate = 0.5 / float((weigh * (x * x).sum(1)).sum() + decay)
    for k in range(ROUNDS):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        new = ahead + rate * (x.T @ (2 * weigh * slack * y) - decay * ahead)
        ahead = new + k / (k + 3) * (new - w)
        w = new
    return w


def pairs(n: int) -> list[tuple[int, int]]:
    return list(combinations(range(n), 2))


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets, their frequencies in percent, and how many buckets each text has."""
    buckets, shares, counts = [], [], []
    for text in texts:
        bucket, _doc, n = trigrams(*lowered([text]))
        found = np.bincount(bucket, minlength=BUCKETS)
        own = np.flatnonzero(found)
        buckets.append(own.astype(np.int32))
        shares.append((found[own] * (100 / max(1, n[0]))).astype(np.float32))
        counts.append(len(own))
    empty = np.zeros(0, np.int32)
    return np.concatenate([empty, *buckets]), np.concatenate([empty.astype(np.float32), *shares]), np.array(counts, np.int64)


def fit(texts: list[str], langs: list[str]) -> Model:
    return fit_features(*features(texts), langs)


def fit_features(buckets: np.ndarray, shares: np.ndarray, counts: np.ndarray, langs: list[str]) -> Model:
    x = np.zeros((len(langs), BUCKETS + 1), np.float32)
    x[np.repeat(np.arange(len(langs)), counts), buckets] = shares
    x[:, -1] = 1
    names = np.array(langs)
    families = sorted({family_of(v) for v in langs})
    of = np.array([family_of(v) for v in langs])
    one = lambda rows, mask: svm(x[rows], np.where(mask[rows], 1, -1).astype(np.float32))
    every = np.arange(len(langs))
    languages = [sorted({v for v in langs if family_of(v) == f}) for f in families]
    return Model(
        families, np.stack([one(every, of == f) for f in families]) if len(families) > 1 else np.zeros((1, BUCKETS + 1), np.float32),
        languages, [np.stack([one(np.flatnonzero((names == members[i]) | (names == members[j])), names == members[i]) for i, j in pairs(len(members))]) if len(members) > 1 else np.zeros((0, BUCKETS + 1), np.float32) for members in languages],
    )


def _scores(weights: np.ndarray, bucket: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Margins of each document: rows are classes."""
    return np.stack([per_doc(np.rint(w[bucket] * 65536).astype(np.int64), ends) / 65536 * 100 / np.maximum(counts, 1) + w[-1] for w in weights])


def votes(margins: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The language of n with most votes for each document, and its least margin, from the margins of pairs(n); ties go by the sum of margins."""
    won, total, least = np.zeros((n, margins.shape[1]), np.int64), np.zeros((n, margins.shape[1])), np.full((n, margins.shape[1]), np.inf)
    for m, (i, j) in zip(margins, pairs(n), strict=True):
        for k, own in ((i, m), (j, -m)):
            total[k] += own
            np.minimum(least[k], own, out=least[k])
        won[i] += m >= 0
        won[j] += m < 0
    best = np.where(won == won.max(0), total, -np.inf).argmax(0)
    return best, least[best, np.arange(margins.shape[1])]


def predict(model: Model, texts: list[str]) -> tuple[list[str], np.ndarray]:
    data, offsets = lowered(texts)
    bucket, _doc, counts = trigrams(data, offsets)
    ends = np.concatenate([[0], np.cumsum(counts)])
    sigmoid = lambda m: 1 / (1 + np.exp(-4 * m))
    margins = _scores(model.family_weights, bucket, ends, counts)
    family = margins.argmax(0)
    score = sigmoid(margins[family, np.arange(len(texts))]) if len(model.families) > 1 else np.ones(len(texts))
    out = np.empty(len(texts), object)
    for f, members in enumerate(model.languages):
        own = np.flatnonzero(family == f)
        if not len(own):
            continue
        if len(members) == 1:
            out[own] = members[0]
            continue
        mine = bucket[np.repeat(family == f, counts)]
        best, margin = votes(_scores(model.language_weights[f], mine, np.concatenate([[0], np.cumsum(counts[own])]), counts[own]), len(members))
        out[own] = np.array(members, object)[best]
        score[own] = score[own] * sigmoid(margin)
    return out.tolist(), score


def training_rows(docs: DataFrame, per_language: int = SAMPLE_ROWS, total: int = SAMPLE_TOTAL) -> DataFrame:
    """(lang, h, text): rows that are not held out, of each language the first by a hash of doc_id and text, up to per_language.

    With many languages each has fewer rows, total in all, but LEAST_ROWS at least. Equal rows
    count as one; a doc_id that stands for many texts is so many rows.
    """
    own = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text", F.xxhash64(F.lit(5), "doc_id", "text").alias("h"))
    rows = own.select("lang", "h").distinct()
    counts = keep(rows.groupBy("lang").agg(F.count("*").alias("n")))
    per_language = min(per_language, max(LEAST_ROWS, total // max(1, counts.count())))
    # the rows with a hash under twice the share that is wanted hold enough of them, save by a freak of chance
    share = F.shiftrightunsigned("h", 1) / F.lit(float(1 << 63))
    near = rows.join(F.broadcast(counts), "lang").where(share * F.col("n") < 2 * per_language + 50)
    chosen = keep(near.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy(F.shiftrightunsigned("h", 1), "h"))).where(F.col("k") <= per_language).select("lang", "h"))
    return own.join(F.broadcast(chosen), ["lang", "h"], "left_semi")


def training_features(rows: DataFrame) -> DataFrame:
    """(lang, h, buckets, shares) of rows (lang, h, text), each once: a text of any length is BUCKETS numbers at most."""

    def run(batches):
        for batch in batches:
            buckets, shares, counts = features(batch.column("text").to_pylist())
            ends = np.cumsum(counts) * 4
            blob = lambda x: pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(x)])
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("h"), blob(buckets), blob(shares)], names=["lang", "h", "buckets", "shares"])

    return arrow_map(rows, run, "lang string, h long, buckets binary, shares binary").dropDuplicates(["lang", "h"])


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, per_language: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs (doc_id, text, lang).

    The machines learn from the text and lang of rows that are not held out, at most
    per_language of each language; predictions read the whole text alone. lang_pred is
    UNKNOWN, with score 0, if the text is null or has no letter, or nothing could be learned.
    Repeated rows each get the same answer and are learned from once. Votes that tie go by the
    sum of the margins, and equal sums by the language's name.
    """
    sample = sorted(training_features(training_rows(docs, per_language)).collect(), key=lambda r: (r.lang, r.h))
    joined = lambda k, kind: np.concatenate([np.frombuffer(r[k], kind) for r in sample])
    model = fit_features(joined("buckets", np.int32), joined("shares", np.float32), np.array([len(r.buckets) // 4 for r in sample]), [r.lang for r in sample]) if sample else None
    sample = None
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(_data, _offsets, texts) -> list:
        if shared.value is None:
            return [pa.array([UNKNOWN] * len(texts()), pa.string()), np.zeros(len(texts()))]
        langs, score = predict(shared.value, texts())
        return [pa.array(langs, pa.string()), score]

    rows = docs.select("doc_id", "text", held_out().alias("held_out"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    out = map_text(rows, work, "lang_pred string, score double", ["doc_id", "held_out", "letters"])
    return out.select("doc_id", "held_out", F.when(F.col("letters"), F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"), F.when(F.col("letters"), F.col("score")).otherwise(0.0).alias("score"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))
