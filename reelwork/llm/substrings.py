"""Exact duplicate substrings over the corpus with a sparse suffix array.

Every byte covered by a string of LENGTH bytes that also starts in a document of a lesser
doc_id goes. The suffixes that are sorted are those at anchors: of the grams in each window
of LENGTH bytes the one with the least hash. Equal windows have equal anchors, so it is
enough to compare windows whose anchors agree.

1. Documents are dealt into chunks. Each chunk sends the distinct hashes of its anchors to
   buckets of the hash range and hears which of them another document has too.
2. The suffixes at those anchors, with the bytes around them, go to ranges of their leading
   bytes, cut at splitters from a bounded sample. A range sorts its suffixes by multikey
   sort, takes the common prefixes of neighbours, and finds the least document of each
   window. Equal leading bytes never lie on two sides of a splitter. Within a chunk, equal
   surroundings are sent once, so a passage that every document has arrives once a chunk.
3. The removed windows go back to the chunks, which cut the texts.

The documents are shuffled once; the three steps read the same exchange.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelwork.llm.kernel import PIECE_BYTES, U64, mix, powers, prefix_hash, span_hash
from reelwork.llm.shared import documents
from reelwork.session import arrow_map, find_package

LENGTH = 50
GRAM = 24
SPREAD = LENGTH - GRAM + 1
CHUNK_BYTES = 4 << 20
#: Documents, and anchors of each, that the splitters are taken from at most.
SAMPLE_DOCUMENTS = 2000
SAMPLE_ANCHORS = 32

_SENT = "bucket int, chunk int, hashes binary, several binary"
_HEARD = "chunk int, bucket int, shared binary"
_CONTEXTS = "part int, chunk int, doc binary, row binary, start binary, ahead binary, n binary, bytes binary, gone binary"
_GONE = "chunk int, gone binary"
_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Document, position, first and last window start, and hash of each anchor; and the prefix hash."""
    c = prefix_hash(data)
    size = np.diff(offsets)
    windows = np.maximum(size - LENGTH + 1, 0)
    if not windows.sum():
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(0, U64), c
    gram = mix((c[GRAM:] - c[:-GRAM]) * powers(len(c))[1][: len(c) - GRAM])
    low = (gram & U64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=U64)
    reach = 1
    while reach * 2 <= SPREAD:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < SPREAD:
        low = np.minimum(low[: len(low) - (SPREAD - reach)], low[SPREAD - reach :])
    doc = np.repeat(np.arange(len(size)), windows)
    at = np.arange(len(doc)) + np.repeat(offsets[:-1] - (np.cumsum(windows) - windows), windows)
    place = (low[at] & U64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(doc), bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(doc)) - 1
    # the least hashes crowd the low end of their range; mixed again they fill it evenly
    return doc[head], place[head], at[head], at[tail], mix(gram[place[head]] + U64(1)), c


class Chunk:
    """The documents of a chunk by doc_id and text, cut into pieces."""

    def __init__(self, table: pa.Table):
        table = table.select(["doc_id", "text"]).combine_chunks()
        order = np.lexsort((np.arange(len(table)), ids := table.column("doc_id").to_numpy()))
        text = table.column("text").cast(pa.large_binary())
        if len(ids) != len(np.unique(ids)):
            values = [(int(i), b or b"", k) for k, (i, b) in enumerate(zip(ids, text.to_pylist(), strict=True))]
            order = np.array([k for _i, _b, k in sorted(values)])
        self.ids = ids[order]
        text = text.take(pa.array(order)).combine_chunks()
        text = text.fill_null(b"") if text.null_count else text
        if isinstance(text, pa.ChunkedArray):
            text = pa.concat_arrays(text.chunks)
        self.offsets = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
        body = text.buffers()[2]
        self.data = np.frombuffer(body, np.uint8)[: self.offsets[-1]] if body is not None else np.zeros(0, np.uint8)

    def pieces(self):
        at, n = 0, len(self.ids)
        while at < n:
            to = max(at + 1, int(np.searchsorted(self.offsets, self.offsets[at] + PIECE_BYTES, "right")) - 1)
            own = self.offsets[at : to + 1]
            yield at, self.data[own[0] : own[-1]], own - own[0]
            at = to


def sent_hashes(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """The distinct anchor hashes of the chunk in order, and whether several of its documents have each."""
    pairs = []
    for at, data, offsets in chunk.pieces():
        doc, _p, _f, _l, gram, _c = anchors(data, offsets)
        # a document's own repeats count once; documents of one doc_id count as one
        pairs.append(_distinct(gram, chunk.ids[doc + at]))
    hashes = np.concatenate([p[0] for p in pairs]) if pairs else np.zeros(0, U64)
    owners = np.concatenate([p[1] for p in pairs]) if pairs else np.zeros(0, np.int64)
    hashes, owners = _distinct(hashes, owners)
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
    return hashes[first], np.diff(np.append(first, len(hashes))) > 1


def _distinct(hashes: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs, by hash."""
    order = np.lexsort((owners, hashes))
    h, o = hashes[order], owners[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return h[new], o[new]


def _cuts(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket of the hash range begins in sorted hashes."""
    edges = (np.arange(1, buckets, dtype=object) * (1 << 64) // buckets).astype(U64)
    return np.concatenate([[0], np.searchsorted(hashes, edges), [len(hashes)]])


def _fine(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The leading 40 bits of each hash's place within its bucket, as 5 bytes; two that agree by chance only cost work."""
    place = hashes * U64(buckets)
    return place.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 3:]


def _coarse(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 5, 8), np.uint8)
    out[:, 3:] = np.frombuffer(blob, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _pack(*arrays: np.ndarray) -> list[bytes]:
    return [np.ascontiguousarray(a).tobytes() for a in arrays]


def send(buckets: int):
    def run(key, table):
        hashes, several = sent_hashes(Chunk(table))
        cuts = _cuts(hashes, buckets)
        rows = [(b, key[0].as_py(), *_pack(_fine(hashes[i:j], buckets), np.packbits(several[i:j]))) for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i]
        return _table(rows, _SENT)

    return run


def hear(_key, table):
    rows = [(r["chunk"], r["bucket"], _coarse(r["hashes"]), np.frombuffer(r["several"], np.uint8)) for r in table.to_pylist()]
    every = np.sort(np.concatenate([r[2] for r in rows]))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    out = []
    for chunk, bucket, hashes, several in rows:
        shared = np.unpackbits(several, count=len(hashes)).astype(bool)
        if len(twice):
            shared |= twice[np.minimum(np.searchsorted(twice, hashes), len(twice) - 1)] == hashes
        if shared.any():
            out.append((chunk, bucket, np.packbits(shared).tobytes()))
    return _table(out, _HEARD)


def contexts(buckets: int, splitters: np.ndarray):
    """The surroundings of the shared anchors of a chunk, by range of leading bytes."""

    def run(key, docs, heard):
        if not len(docs) or not len(heard):
            return _table([], _CONTEXTS)
        chunk = Chunk(docs)
        hashes, _several = sent_hashes(chunk)
        cuts = _cuts(hashes, buckets)
        shared = np.zeros(len(hashes), bool)
        for r in heard.to_pylist():
            i, j = cuts[r["bucket"]], cuts[r["bucket"] + 1]
            shared[i:j] = np.unpackbits(np.frombuffer(r["shared"], np.uint8), count=j - i)
        known = hashes[shared]
        found = []
        for at, data, offsets in chunk.pieces():
            doc, place, first, last, gram, c = anchors(data, offsets)
            own = np.flatnonzero(known[np.minimum(np.searchsorted(known, gram), len(known) - 1)] == gram)
            doc, place, first, last = doc[own], place[own], first[own], last[own]
            alike = mix(span_hash(c, first, last + LENGTH) + (place - first).astype(U64))
            found.append((doc + at, place + chunk.offsets[at], first + chunk.offsets[at], last + chunk.offsets[at], alike))
        row, place, first, last, alike = (np.concatenate(x) for x in zip(*found, strict=True))
        doc = chunk.ids[row]
        order = np.lexsort((doc, alike))
        new = np.ones(len(order), bool)
        new[1:] = alike[order][1:] != alike[order][:-1]
        least = np.empty(len(order), np.int64)
        least[order] = doc[order][new][np.cumsum(new) - 1]
        local = doc > least
        gone = np.stack([row[local], first[local] - chunk.offsets[row[local]], last[local] - chunk.offsets[row[local]]], 1).astype(np.int32)
        row, place, first, last, doc = (x[~local] for x in (row, place, first, last, doc))
        lead = np.ascontiguousarray(chunk.data[place[:, None] + np.arange(GRAM)]).view(f"S{GRAM}").ravel()
        part = np.searchsorted(splitters, lead, "right")
        order = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[order], np.arange(len(splitters) + 2))
        out = []
        for k, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            own = order[i:j]
            if not len(own) and not (k == 0 and len(gone)):
                continue
            size = last[own] - first[own] + LENGTH
            at = np.arange(size.sum()) + np.repeat(first[own] - (np.cumsum(size) - size), size)
            start, ahead, n = first[own] - chunk.offsets[row[own]], place[own] - first[own], last[own] - first[own] + 1
            out.append((k, key[0].as_py(), *_pack(doc[own], row[own].astype(np.int32), start.astype(np.int32), ahead.astype(np.uint8), n.astype(np.uint8), chunk.data[at]), gone.tobytes() if k == 0 else b""))
        return _table(out, _CONTEXTS)

    return run


def multikey_sort(words: np.ndarray) -> np.ndarray:
    """Order of the rows by their words: by the first, then each tied run by the next, and so on."""
    order = np.argsort(words[:, 0], kind="stable")
    run = np.cumsum(np.concatenate([[0], words[order[1:], 0] != words[order[:-1], 0]]))
    for k in range(1, words.shape[1]):
        tied = np.flatnonzero(np.bincount(run)[run] > 1)
        if not len(tied):
            break
        rows = order[tied]
        order[tied] = rows[np.lexsort((words[rows, k], run[tied]))]
        cut = words[order[1:], k] != words[order[:-1], k]
        run = np.cumsum(np.concatenate([[0], cut | (run[1:] != run[:-1])]))
    return order


def removed_windows(doc: np.ndarray, ahead: np.ndarray, n: np.ndarray, body: np.ndarray) -> np.ndarray:
    """For each context, whether its window that starts so many bytes before the anchor goes (column SPREAD - 1: at it)."""
    size = n + LENGTH - 1
    begin = np.cumsum(size) - size
    anchor = begin + ahead
    col = np.arange(LENGTH + 6)
    at = anchor[:, None] + col
    suffix = np.where((at < (begin + size)[:, None]) & (col < LENGTH), body[np.minimum(at, len(body) - 1)], 0).astype(np.uint8)
    order = multikey_sort(suffix.view(">u8").astype(U64))
    doc, ahead, n, anchor, suffix = doc[order], ahead[order], n[order], anchor[order], suffix[order]
    differ = suffix[1:, :LENGTH] != suffix[:-1, :LENGTH]
    common = np.where(differ.any(1), differ.argmax(1), LENGTH)
    gone = np.zeros((len(doc), SPREAD), bool)
    before = np.zeros(len(doc), U64)  # a hash of the bytes between the window's start and the anchor
    for back in range(SPREAD):
        if back:
            before += (body[np.maximum(anchor - back, 0)].astype(U64) + U64(1)) * powers(SPREAD)[0][back]
        own = np.flatnonzero((ahead >= back) & (n - 1 - ahead >= -back))
        if len(own) < 2:
            continue
        interval = np.concatenate([[0], np.cumsum(common < LENGTH - back)])[own].astype(U64)
        key = mix(mix(interval + U64(1 << 63)) + mix(before[own]))
        by = np.lexsort((doc[own], key))
        new = np.ones(len(by), bool)
        new[1:] = key[by][1:] != key[by][:-1]
        least = doc[own][by][new][np.cumsum(new) - 1]
        gone[own[by], SPREAD - 1 - back] = doc[own][by] > least
    out = np.empty_like(gone)
    out[order] = gone
    return out


def compare(_key, table):
    rows = table.to_pylist()
    doc = np.concatenate([np.frombuffer(r["doc"], np.int64) for r in rows])
    row, start, ahead, n = (np.concatenate([np.frombuffer(r[k], kind) for r in rows]).astype(np.int64) for k, kind in (("row", np.int32), ("start", np.int32), ("ahead", np.uint8), ("n", np.uint8)))
    body = np.concatenate([np.frombuffer(r["bytes"], np.uint8) for r in rows])
    counts = [len(r["doc"]) // 8 for r in rows]
    chunk = np.repeat(np.arange(len(rows)), counts)
    found = np.zeros((0, 4), np.int64)
    if len(doc) > 1:
        gone = np.pad(removed_windows(doc, ahead, n, body), ((0, 0), (1, 1)))
        edge = np.diff(gone.astype(np.int8), axis=1)
        who, a = np.nonzero(edge == 1)
        b = np.nonzero(edge == -1)[1] - 1
        base = start[who] + ahead[who] - (SPREAD - 1)
        found = np.stack([chunk[who], row[who], base + a, base + b], 1)
    cuts = np.searchsorted(found[:, 0], np.arange(len(rows) + 1))
    out = [(r["chunk"], r["gone"] + found[i:j, 1:].astype(np.int32).tobytes()) for r, i, j in zip(rows, cuts[:-1], cuts[1:], strict=True)]
    return _table([x for x in out if x[1]], _GONE)


def cut(_key, docs, gone):
    if not len(docs):
        return _table([], _RESULT)
    chunk = Chunk(docs)
    edge = np.zeros(len(chunk.data) + 1, np.int32)
    for blob in gone.column("gone").to_pylist():
        row, a, b = np.frombuffer(blob, np.int32).reshape(-1, 3).T.astype(np.int64)
        np.add.at(edge, chunk.offsets[row] + a, 1)
        np.add.at(edge, chunk.offsets[row] + b + LENGTH, -1)
    removed = np.cumsum(edge[:-1]) > 0
    total = np.concatenate([[0], np.cumsum(removed)])
    begins = removed.copy()
    begins[1:] &= ~removed[:-1]
    inner = chunk.offsets[:-1][chunk.offsets[:-1] < len(removed)]
    begins[inner] |= removed[inner]
    spans = np.concatenate([[0], np.cumsum(begins)])
    kept = chunk.data[~removed].tobytes()
    at = chunk.offsets - total[chunk.offsets]
    view = memoryview(kept)
    digests = [hashlib.sha256(view[i:j]).hexdigest() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    off = chunk.offsets
    return pa.table({"doc_id": chunk.ids, "n_bytes": np.diff(off), "n_removed": total[off[1:]] - total[off[:-1]], "n_spans": spans[off[1:]] - spans[off[:-1]], "kept_sha256": digests})


_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}


def _table(rows: list[tuple], ddl: str) -> pa.Table:
    fields = [f.split() for f in ddl.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.table({name: pa.array(list(c), _TYPES[kind]) for (name, kind), c in zip(fields, columns, strict=True)})


def sampled_splitters(rows: DataFrame, share: float, parts: int) -> np.ndarray:
    """parts - 1 splitters of the leading bytes of anchors, from at most SAMPLE_DOCUMENTS documents."""

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                data = np.frombuffer((text or "").encode(), np.uint8)
                place = np.unique(anchors(data, np.array([0, len(data)]))[1])
                out += [data[p : p + GRAM].tobytes() for p in place[:: max(1, len(place) // SAMPLE_ANCHORS)][:SAMPLE_ANCHORS].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["lead"])

    chosen = rows.where(F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)).select("text").limit(SAMPLE_DOCUMENTS)
    leads = np.sort(np.array([r[0] for r in arrow_map(chosen, run, "lead binary").collect()], f"S{GRAM}"))
    if not len(leads):
        return leads
    return np.unique(leads[np.arange(1, parts) * len(leads) // parts])


def remove_substrings(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs (doc_id, text).

    A null text is empty. Rows with a null doc_id keep their text and are no source for
    others. Rows of one doc_id don't remove from each other.
    """
    spark = docs.sparkSession
    find_package(spark)
    known = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n, total = known.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    chunks = max(1, -(-(total or 0) // chunk_bytes))
    splitters = sampled_splitters(known, SAMPLE_DOCUMENTS / max(1, n) * 0.9, 2 * chunks)
    dealt = known.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int"))
    by_chunk = dealt.groupBy("chunk")
    # one bucket to a partition of the shuffle, so that messages grow with the chunks and not with their square
    buckets = min(chunks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sent = by_chunk.applyInArrow(send(buckets), _SENT)
    heard = sent.groupBy("bucket").applyInArrow(hear, _HEARD)
    around = by_chunk.cogroup(heard.groupBy("chunk")).applyInArrow(contexts(buckets, splitters), _CONTEXTS)
    gone = around.groupBy("part").applyInArrow(compare, _GONE)
    out = by_chunk.cogroup(gone.groupBy("chunk")).applyInArrow(cut, _RESULT)
    body = F.coalesce(docs["text"], F.lit(""))
    rest = docs.where("doc_id is null").select(F.lit(None).cast("long").alias("doc_id"), F.octet_length(body).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(body.cast("binary"), 256).alias("kept_sha256"))
    return out.unionByName(rest)


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_substrings(documents(spark, sf_dir))
