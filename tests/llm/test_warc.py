"""Archives: payloads that hold the magic or whole records, small splits, copies, odd rows, damage."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from reelwork.llm import warc

SCHEMA = "page_id long, url string, html string, type string"


def fake(payload: str, said: int | None = None) -> str:
    """A record as an archive has it."""
    n = len(payload.encode()) if said is None else said
    return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: {n}\r\n\r\n{payload}\r\n\r\n"


def pages():
    r = random.Random(3)
    prose = lambda n: "".join(r.choice("abc äß漢<>/ \r\n") for _ in range(n))
    big, edge = prose(1500), "x" * 1000
    rows = [
        (1, "http://a/1", big), (2, "http://a/2", big), (3, "http://a/3", big), (4, None, None), (5, "http://a/5", ""), (6, "u\r\nWARC-Type: revisit", "small"), (7, "http://a/7", "small"),
        (8, "http://a/8", "before " + fake("inner " + prose(900)) + fake("second") + " after"), (9, "http://a/9", fake(prose(3000), 10**12)), (10, "http://a/10", "WARC/1.1\r\n"), (11, "http://a/11", "WARC/1.1\r\n" * 40 + "end"),
        (12, "http://a/12", "\r\n\r\n" + fake("x") * 30), (13, "http://a/13", "Content-Length: 5\r\n\r\n"), (14, "http://a/14", "WARC/1.1"), (15, "http://a/15", edge), (16, "http://a/16", edge), (17, "a", edge[1:]), (18, "b", edge[1:]),
        (None, "http://a/n", big), (None, "n1", prose(1200) + "!"), (20, "rep", "r" * 1100), (20, "rep", "r" * 1100), (19, "rep", "r" * 1100), (21, "long", prose(200_000)), (22, "ends", "x\r\n\r\nWARC/1.1\r\nContent-Length: 0\r\n\r\n"),
    ]
    lone = "q" * 1300
    return [*rows, (None, "z", lone), (None, "z", lone), *[(100 + k, f"http://b/{k}", prose(r.randint(0, 700))) for k in range(60)]]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(*p, "mine") for p in pages()], SCHEMA).repartition(3)


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def expected():
    out = []
    for i, _, html in pages():
        body = (html or "").encode()
        same = [p[0] for p in pages() if p[0] is not None and (p[2] or "").encode() == body]
        latest = max(same) if same and len(body) >= 1000 else None
        again = latest is not None and latest != i
        out.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", latest if again else None))
    return sorted(out, key=str)


def result(spark, folder):
    found = warc.resolved(warc.read_warc(spark, folder))
    rows = found.select(warc.page_of(F.col("record_id")), "payload_bytes", "payload_sha1", "type", warc.page_of(F.col("refers_to")), "complete").collect()
    assert all(r[-1] for r in rows)
    return sorted((tuple(r)[:-1] for r in rows), key=str)


def test_only_records_that_the_chain_reaches(spark, table, tmp_path):
    warc.write_warc(table, f"{tmp_path}/w")
    assert result(spark, f"{tmp_path}/w") == expected()


def test_small_splits_and_one_file(spark, table, small_splits, tmp_path):
    warc.write_warc(table.coalesce(1), f"{tmp_path}/w")
    lines = warc.lines_of(spark, f"{tmp_path}/w")
    assert lines.select("file", "block").distinct().count() > 20  # so rounds of jumps are needed
    assert result(spark, f"{tmp_path}/w") == expected()


def test_candidates_in_payloads_are_many(spark, table, tmp_path):
    warc.write_warc(table, f"{tmp_path}/w")
    lines = warc.verified_lines(spark, f"{tmp_path}/w")
    assert lines.where("next is not null").count() > lines.where("at = record").count() + 30


def test_payloads_come_back(spark, table, small_splits, tmp_path):
    warc.write_warc(table.coalesce(2), f"{tmp_path}/w")
    got = warc.read_payloads(spark, f"{tmp_path}/w").where("type = 'response'").select(warc.page_of(F.col("record_id")), "payload").collect()
    kept = {(r[0], r[1]) for r in expected() if r[3] == "response"}
    want = sorted(((i, (h or "").encode()) for i, _, h in pages() if (i, len((h or "").encode())) in kept), key=str)
    # rows of one id are responses, or none is
    assert sorted(((r[0], bytes(r[1])) for r in got), key=str) == want


def test_damage_ends_the_chain(spark, tmp_path):
    os.makedirs(f"{tmp_path}/w")
    records = [fake("one"), fake("two"), fake("three")]
    with open(f"{tmp_path}/w/a", "wb") as f:  # a wrong length: the third can't be reached
        f.write((records[0] + records[1].replace("Content-Length: 3", "Content-Length: 2") + records[2]).encode())
    with open(f"{tmp_path}/w/b", "wb") as f:  # the file does not start with a record
        f.write(("junk" + records[0]).encode())
    with open(f"{tmp_path}/w/c", "wb") as f:  # cut off within the block
        f.write(records[0].encode() + fake("cut").encode()[:-6])
    with open(f"{tmp_path}/w/d", "wb"):
        pass
    with open(f"{tmp_path}/w/e", "wb") as f:  # bytes that are no text
        f.write(fake("one").encode().replace(b"one", b"\xff\xfe\x80"))
    got = sorted((r["length"], r["complete"]) for r in warc.read_warc(spark, f"{tmp_path}/w").collect())
    assert got == [(2, True), (3, False), (3, True), (3, True), (3, True)]


def test_empty_table(spark, table, tmp_path):
    warc.write_warc(table.limit(0), f"{tmp_path}/w")
    assert warc.resolved(warc.read_warc(spark, f"{tmp_path}/w")).count() == 0
    assert warc.read_payloads(spark, f"{tmp_path}/w").count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    from reelwork.llm.registry import QUERIES

    assert QUERIES["op13_warc_boundary_chain"](spark, folder).count() == spark.read.parquet(f"{folder}/pages.parquet").count()
