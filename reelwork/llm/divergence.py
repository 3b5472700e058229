"""How far the sources of a language differ in the terms that they use.

Chunks between white space are counted for each document, in blocks of documents; each chunk that
occurs anywhere is cut into terms once; the terms go back to the blocks, where they turn counts of
chunks into documents and occurrences of terms. What travels is each block's distinct chunks, not
its documents. Terms that enough documents of a language hold are kept, and the shares of every
source are compared in integers.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelwork.llm.kernel import lists, pieces, words_of
from reelwork.llm.shared import bit_table, bounded, documents, drop_folder, keep, shared_folder, with_bit
from reelwork.session import arrow_map, find_package

#: Of a text in which only A-Z are put in lower case.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCS, TOP, UNIT, PRIOR = 30, 50, 1_000_000_000, 5
#: Bytes of text after which a block ends.
BLOCK_BYTES = 16 << 20
#: Terms of one group of the comparison of sources, on average.
TERMS_PER_GROUP = 20_000

BLOCK = "block long, langs array<string>, sources array<string>, n_chunks array<int>, chunk binary, times binary, chunks array<string>, chunk_docs array<int>"


def _chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The chunks of a piece in order, and how many each document has."""
    words = words_of(data, offsets)
    ends = np.stack([words.starts, words.ends], 1).ravel()
    if not len(ends):
        return pa.array([], pa.large_string()), words.counts()
    # every other string is the white space between
    cut = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(data))
    return cut.take(pa.array(np.arange(0, len(ends) - 1, 2))), words.counts()


def packed(x: np.ndarray) -> bytes:
    """Whole numbers under 2**31, compressed byte by byte of equal weight."""
    return pa.compress(x.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def unpacked(x: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(x, 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n).T.copy().view("<i4").ravel()


def _block(name: int, rows: list[pa.RecordBatch], chunks: list[pa.Array], counts: list[np.ndarray]) -> pa.RecordBatch:
    coded = pa.concat_arrays(chunks).dictionary_encode()
    n, size = np.concatenate(counts), max(1, len(coded.dictionary))
    pairs, times = np.unique(np.repeat(np.arange(len(n)), n) * size + coded.indices.to_numpy(), return_counts=True)
    one = lambda values, kind: pa.ListArray.from_arrays([0, len(values)], pa.array(values).cast(kind))
    names = [pc.fill_null(pa.concat_arrays([r.column(c) for r in rows]).cast(pa.string()), "") for c in ("lang", "source")]
    return pa.RecordBatch.from_arrays(
        [pa.array([name]), *[one(x, pa.string()) for x in names], one(np.bincount(pairs // size, minlength=len(n)), pa.int32()), pa.array([packed(pairs % size)]), pa.array([packed(times)]), one(coded.dictionary, pa.string()), one(np.bincount(pairs % size, minlength=len(coded.dictionary)), pa.int32())],
        names=[x.split()[0] for x in BLOCK.split(", ")],
    )


def counted_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """BLOCK: one row for each block of documents (lang, source, text).

    n_chunks has the number of distinct chunks of each document; chunk and times, packed, have an
    entry for each of them, chunk being a place in chunks; chunk_docs counts the documents of each place. A block ends after so many bytes, so
    it holds that many and one piece of 2 MB, or a longer document, at most. Null columns are empty strings.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 32
        rows, chunks, counts, size = [], [], [], 0
        for batch in batches:
            for part, data, offsets in pieces(batch, "text"):
                found, n = _chunks(data, offsets)
                rows, chunks, counts, size = [*rows, part.select(["lang", "source"])], [*chunks, found], [*counts, n], size + len(data)
                if size >= block_bytes:
                    yield _block(name, rows, chunks, counts)
                    rows, chunks, counts, size, name = [], [], [], 0, name + 1
        if rows:
            yield _block(name, rows, chunks, counts)

    return arrow_map(docs.select("lang", "source", "text"), run, BLOCK)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def placed_chunks(blocks: DataFrame) -> DataFrame:
    """(block, place, chunk_text, docs) of each distinct chunk of each block."""
    return blocks.select("block", F.posexplode(F.arrays_zip("chunks", "chunk_docs")).alias("place", "c")).select("block", "place", F.col("c.chunks").alias("chunk_text"), F.col("c.chunk_docs").alias("docs"))


def cut_chunks(blocks: DataFrame) -> DataFrame:
    """(chunk_text, docs, terms): each chunk that occurs anywhere, cut once, and the documents that hold it."""
    each = placed_chunks(blocks).groupBy("chunk_text").agg(F.sum("docs").alias("docs"))
    return each.withColumn("terms", F.regexp_extract_all(lower_ascii(F.col("chunk_text")), F.lit(TERM), F.lit(0)))


def likely_terms(cut: DataFrame, min_docs: int) -> DataFrame:
    """(chunk_text, terms) of cut without the terms that too few documents can hold.

    A term is in no more documents than its chunks together. The terms that pass go into a
    bitmap of fixed size, so some others stay, which costs rows and no result.
    """
    said = cut.select("chunk_text", "docs", F.explode("terms").alias("term")).withColumn("hash", F.xxhash64("term"))
    most = said.groupBy("term").agg(F.sum("docs").alias("docs"), F.first("hash").alias("hash")).where(F.col("docs") >= min_docs)
    return with_bit(said, bit_table(most, "hash"), "hash").where("hit").groupBy("chunk_text").agg(F.collect_list("term").alias("terms"))


def terms_of_places(blocks: DataFrame, cut: DataFrame) -> DataFrame:
    """(block, place, terms) for each block's chunks that are in cut (chunk_text, terms); a bitmap of fixed size stands before the join."""
    table = bit_table(cut.select(F.xxhash64("chunk_text").alias("hash")), "hash")
    mine = with_bit(placed_chunks(blocks).withColumn("hash", F.xxhash64("chunk_text")), table, "hash").where("hit")
    return mine.select("block", "place", "chunk_text").join(cut, "chunk_text").select("block", "place", "terms")


def block_terms(blocks: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, term, docs, codes, counts) for each block: how many of its documents of a language hold a term, and how often each source (code) says it.

    blocks has codes, an array of (lang, source, code).
    """

    def run(mine: pa.Table, given: pa.Table) -> pa.Table:
        if not mine.num_rows or not given.num_rows:
            return pa.table({"lang": pa.array([], pa.string()), "term": pa.array([], pa.string()), "docs": pa.array([], pa.int64()), "codes": pa.array([], pa.list_(pa.int32())), "counts": pa.array([], pa.list_(pa.int32()))})
        whole = lambda c: mine.column(c).combine_chunks().flatten()
        per_doc = whole("n_chunks").to_numpy()
        chunk, times = (unpacked(mine.column(c)[0].as_py(), int(per_doc.sum())) for c in ("chunk", "times"))
        lang, source = (whole(c).dictionary_encode() for c in ("langs", "sources"))
        lists_of = given.column("terms").combine_chunks()
        flat = lists_of.flatten().dictionary_encode()
        n_terms = len(flat.dictionary)
        langs, sources = ({x: i for i, x in enumerate(c.dictionary.to_pylist())} for c in (lang, source))
        code = np.zeros((len(langs), len(sources)), np.int64)
        for c in mine.column("codes")[0].as_py():
            code[langs[c["lang"]], sources[c["source"]]] = c["code"]
        n_codes = int(code.max()) + 1
        # the terms of a place: a run of flat
        many = np.zeros(int(chunk.max()) + 1, np.int64)
        begin = many.copy()
        place, length = given.column("place").to_numpy(), pc.list_value_length(lists_of).to_numpy()
        many[place], begin[place] = length, np.cumsum(length) - length
        n = many[chunk]
        ends = np.cumsum(n)
        term = flat.indices.to_numpy()[np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat(begin[chunk], n)].astype(np.int64)
        doc, times = np.repeat(np.repeat(np.arange(len(per_doc)), per_doc), n), np.repeat(times, n)
        of_lang, of_source = lang.indices.to_numpy().astype(np.int64), source.indices.to_numpy().astype(np.int64)
        held = np.unique(doc * n_terms + term)
        docs = np.bincount(of_lang[held // n_terms] * n_terms + held % n_terms, minlength=len(lang.dictionary) * n_terms)
        key, at = np.unique((of_lang[doc] * n_terms + term) * n_codes + code[of_lang, of_source][doc], return_inverse=True)
        said = np.zeros(len(key), np.int64)
        np.add.at(said, at, times)
        own, first = np.unique(key // n_codes, return_index=True)
        size = np.diff(np.append(first, len(key)))
        return pa.table({
            "lang": lang.dictionary.take(pa.array(own // n_terms)), "term": flat.dictionary.take(pa.array(own % n_terms)), "docs": docs[own],
            "codes": lists(key % n_codes, size, pa.int32()), "counts": lists(said, size, pa.int32()),
        })

    find_package(blocks.sparkSession)
    return blocks.groupBy("block").cogroup(terms.groupBy("block")).applyInArrow(run, "lang string, term string, docs long, codes array<int>, counts array<int>")


def term_counts(docs: DataFrame, min_docs: int = MIN_DOCS, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(lang, term, codes, counts) of the terms in at least min_docs documents of a language, and (lang, source, code) of all documents.

    docs: lang, source, text; each row is a document, and repeated rows count as often. Null
    columns are empty strings. code numbers a language's sources from 0; codes are those that say the
    term, counts their occurrences of it. Both tables are kept in the shared folder; that of the blocks is dropped again.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/chunks-{uuid.uuid4().hex}"
    counted_blocks(docs, block_bytes).write.parquet(f"{folder}/blocks")
    blocks = lambda: spark.read.parquet(f"{folder}/blocks")
    cut_chunks(blocks()).write.parquet(f"{folder}/cut")
    likely_terms(spark.read.parquet(f"{folder}/cut"), min_docs).write.parquet(f"{folder}/likely")
    drop_folder(spark, f"{folder}/cut")
    met = blocks().select("block", F.explode(F.array_distinct(F.arrays_zip("langs", "sources"))).alias("g")).select("block", F.col("g.langs").alias("lang"), F.col("g.sources").alias("source"))
    groups = keep(met.select("lang", "source").distinct().withColumn("code", F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1))
    coded = met.join(bounded(groups), ["lang", "source"]).groupBy("block").agg(F.collect_list(F.struct("lang", "source", "code")).alias("codes"))
    # a term has a row for each block that says it, so no key has more rows than there are blocks
    places = terms_of_places(blocks(), spark.read.parquet(f"{folder}/likely"))
    held = block_terms(blocks().drop("chunks", "chunk_docs").join(coded, "block"), places).repartition("lang", "term")
    # the documents of a term are summed as those of one more source, of code -1
    docs_too = F.arrays_zip(F.array_append("codes", F.lit(-1)).alias("codes"), F.array_append("counts", F.col("docs").cast("int")).alias("counts"))
    each = held.select("lang", "term", F.explode(docs_too).alias("s")).groupBy("lang", "term", F.col("s.codes").alias("code")).agg(F.sum("s.counts").alias("n"))
    said = F.collect_list(F.when(F.col("code") >= 0, F.struct("code", "n")))
    kept = each.groupBy("lang", "term").agg(said.alias("s"), F.max(F.when(F.col("code") < 0, F.col("n"))).alias("docs")).where(F.col("docs") >= min_docs)
    kept = keep(kept.select("lang", "term", F.col("s.code").alias("codes"), F.col("s.n").alias("counts")))
    drop_folder(spark, folder)
    return kept, groups


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (count + PRIOR) / (total + PRIOR * kept)), exactly."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.lit(1) + F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * wide(count + PRIOR), wide(total + PRIOR * kept))


def shares(count: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """share() of arrays: nine digits by long division, exact up to totals of 9e15."""
    below = total + PRIOR * kept
    out, rest = np.divmod(count + PRIOR, below)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, below)
        out = out * 1000 + more
    return out + 1


def group_totals(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, code, n, v, lang_n) for each group: its occurrences of kept terms, its language's kept terms and their occurrences; 0 where there are none."""
    each = kept.select("lang", F.explode(F.arrays_zip("codes", "counts")).alias("s")).groupBy("lang", F.col("s.codes").alias("code")).agg(F.sum("s.counts").alias("n"))
    whole = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("lang_n"))
    return groups.join(each, ["lang", "code"], "left").join(whole, "lang", "left").fillna(0, ["n", "v", "lang_n"])


def excess_terms(kept: DataFrame, totals: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank): the terms of which a group has a larger share than its language, up to rank top."""
    terms = kept.withColumn("lang_count", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x))
    said = terms.select("lang", F.col("term").alias("item"), "lang_count", F.explode(F.arrays_zip("codes", "counts")).alias("s")).select("lang", "item", "lang_count", F.col("s.codes").alias("code"), F.col("s.counts").alias("count"))
    p, q = share(F.col("count"), F.col("n"), F.col("v")), share(F.col("lang_count"), F.col("lang_n"), F.col("v"))
    over = said.join(bounded(totals), ["lang", "code"]).select("lang", "source", "item", (p - q).alias("value")).where("value > 0")
    # Spark keeps the first ranks of each task before it shuffles
    return over.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))).where(F.col("rank") <= top)


def source_distances(kept: DataFrame, totals: DataFrame, per_group: int = TERMS_PER_GROUP) -> DataFrame:
    """(lang, source, item, value, rank): the summed differences of shares between each two sources of a language.

    The terms of a language are dealt by hash into groups of about per_group, each with the
    language's sources; a group gives one sum for each two of them.
    """
    many = 1 + kept.count() // per_group

    def run(sources: pa.Table, terms: pa.Table) -> pa.Table:
        empty = {"lang": [], "source": [], "item": [], "value": []}
        if not sources.num_rows:
            return pa.table(empty, schema=kinds)
        sources = sources.sort_by("code")
        names, total, v = sources.column("source").to_pylist(), sources.column("n").to_numpy(), sources.column("v")[0].as_py()
        sums = np.zeros((len(names), len(names)), np.int64)
        at_once = max(1, (1 << 20) // len(names))
        for begin in range(0, terms.num_rows, at_once):
            some = terms.slice(begin, at_once).combine_chunks()
            lists_of = some.column("codes").combine_chunks()
            row = np.repeat(np.arange(some.num_rows), pc.list_value_length(lists_of).to_numpy())
            count = np.zeros((some.num_rows, len(names)), np.int64)
            count[row, lists_of.flatten().to_numpy()] = some.column("counts").combine_chunks().flatten().to_numpy()
            p = shares(count, total[None, :], v)
            for i in range(len(names)):
                sums[i] += np.abs(p - p[:, i : i + 1]).sum(0)
        a, b = (~np.eye(len(names), dtype=bool)).nonzero()
        code = pa.array(names, pa.string())
        return pa.table([pa.array([sources.column("lang")[0].as_py()] * len(a), pa.string()), code.take(pa.array(a)), code.take(pa.array(b)), pa.array(sums[a, b])], schema=kinds)

    kinds = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])
    find_package(kept.sparkSession)
    left = totals.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(many - 1)))).groupBy("lang", "part")
    right = kept.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(many)).cast("int")).groupBy("lang", "part")
    sums = left.cogroup(right).applyInArrow(run, "lang string, source string, item string, value long")
    found = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return found.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")))


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(lang, source, part, item, value, rank): distances between sources (part pair) and terms that a source overuses (part term).

    An empty table has no rows; a language with one source has no pairs.
    """
    kept, groups = term_counts(docs, min_docs, block_bytes)
    totals = keep(group_totals(kept, groups))
    parts = {"pair": source_distances(kept, totals), "term": excess_terms(kept, totals, top)}
    pair, term = (x.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, x in parts.items())
    return pair.unionByName(term)


def op11_source_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(documents(spark, sf_dir))
