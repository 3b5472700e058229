"""Token counts at every prefix.

A text is cut at ASCII white space, which this tokenizer drops and never joins over, so the
count of a prefix is the count of the prefix before it and that of one more piece:
count[i] = count[i - 1] + tokens(piece[i]). Each distinct piece is encoded once per worker by
the tokenizer's own library. The stored counts answer length, budget and truncation
questions without another encoding.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelwork.llm.kernel import lists
from reelwork.llm.shared import documents, map_text

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Pieces that a worker keeps with their counts.
CACHE = 400_000
LONGEST_CACHED = 24

_piece = re.compile(r"[^ \t-\r]+").findall
_tokenizers: dict[str, tuple[object, dict[str, int]]] = {}


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def piece_counts(path: str, pieces: list[str]) -> np.ndarray:
    """Tokens of each piece."""
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        _tokenizers[path] = (Tokenizer.from_file(path), {})
    tokenizer, known = _tokenizers[path]
    distinct = set(pieces)
    new = list(distinct.difference(known))
    here = {p: known[p] for p in distinct if p in known}
    for at in range(0, len(new), 20_000):
        some = new[at : at + 20_000]
        here.update(zip(some, (len(e) for e in tokenizer.encode_batch_fast(some, add_special_tokens=False)), strict=True))
    if len(known) + len(new) > CACHE:
        known.clear()
    known.update((p, here[p]) for p in new if len(p) <= LONGEST_CACHED)
    return np.fromiter(map(here.__getitem__, pieces), np.int32, len(pieces))


def prefix_counts(docs: DataFrame, path: str | None = None, carry: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """carry's columns and token_counts: the exact count of tokens after each piece of the text.

    path is the file of a tokenizer that treats ASCII white space as a boundary. A null,
    empty or blank text has an empty array. The array has one int for each word of the text.
    """
    path = path or tokenizer_path()

    def work(_data, _offsets, texts) -> list[pa.Array]:
        each = [_piece(t) for t in texts()]
        n = np.array([len(x) for x in each], np.int64)
        counts = np.cumsum(piece_counts(path, [p for x in each for p in x]), dtype=np.int64)
        before = np.concatenate([[0], counts])[np.cumsum(n) - n]
        return [lists((counts - np.repeat(before, n)).astype(np.int32), n, pa.int32())]

    return map_text(docs, work, "token_counts array<int>", list(carry), text)


def total(counts: Column) -> Column:
    return F.coalesce(F.get(counts, F.size(counts) - 1), F.lit(0)).cast("long")


def words_within(counts: Column, limit: int | Column) -> Column:
    """How many words of the text fit in a budget of tokens: where to truncate."""
    return F.size(F.filter(counts, lambda x: x <= limit)).cast("long")


def op3_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counts = F.col("token_counts")
    return prefix_counts(docs, carry=("doc_id", "n_bytes")).select("doc_id", "n_bytes", total(counts).alias("n_tokens"), (total(counts) > LIMIT).alias("over_limit"), words_within(counts, LIMIT).alias("words_within_limit"))
