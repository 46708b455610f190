"""WARC archives as files: mandatory fields, references by record identifier, shuffled segments, broken sets."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quillforge.llm import warc
from quillforge.llm.common import Scratch

# The fields that the format asks for in every record, and those by kind of record.
ALWAYS = {"warc-record-id", "warc-date", "warc-type", "content-length"}
BY_KIND = {
    "warcinfo": set(), "response": {"warc-target-uri"}, "revisit": {"warc-target-uri", "warc-profile", "warc-refers-to"},
    "continuation": {"warc-target-uri", "warc-segment-number", "warc-segment-origin-id"},
}


@pytest.fixture(scope="module")
def pages(spark):
    big = "é" * 30_000
    rows = [(1, "http://a", big), (2, "http://b", big), (3, None, "small"), (4, "u", "x" * 1200), (5, "u", "x" * 1200), (5, "v", "x" * 1200), (None, "u", big), (6, "u", "z" * 50_000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


def archives(pages):
    scratch = Scratch(pages.sparkSession)
    return scratch.save(warc.write_archives(warc.plan_revisits(pages, scratch), 4000, 20_000))


def test_records_have_their_fields_and_references_resolve(pages):
    seen, refers, total = {}, [], 0
    for row in archives(pages).collect():
        found = list(warc.records(bytes(row.content)))
        assert found[0][0]["warc-type"] == "warcinfo" and found[0][0]["warc-filename"] == row.archive
        for h, block in found:
            assert ALWAYS | BY_KIND[h["warc-type"]] <= set(h) and h["warc-record-id"].startswith("<urn:uuid:")
            assert h["warc-record-id"] not in seen
            seen[h["warc-record-id"]] = h
            if h["warc-type"] == "revisit":
                refers.append((h["warc-refers-to"], h["warc-payload-digest"]))
            total += 1
    assert total > 20 and len(refers) == 3
    assert all(seen[r]["warc-type"] == "response" and seen[r]["warc-payload-digest"] == d for r, d in refers)


def test_files_are_written_and_read_back(spark, pages, tmp_path):
    made, folder = archives(pages), str(tmp_path / "w")
    names = {r.archive: r.bytes for r in warc.save_archives(made, folder).collect()}
    files = spark.read.format("binaryFile").load(f"file://{folder}")
    assert {r.path.rsplit("/", 1)[1]: r.length for r in files.select("path", "length").collect()} == names
    got = sorted((str(r.page_id), r.payload_bytes, r.record_type, str(r.refers_to)) for r in warc.read_archives(files).collect())
    assert got == sorted((str(r.page_id), r.payload_bytes, r.record_type, str(r.refers_to)) for r in warc.warc_round_trip(pages, 4000).collect())
    assert [x for x in got if x[2] == "revisit"] == [("1", 60_000, "revisit", "2"), ("4", 1200, "revisit", "5"), ("None", 60_000, "revisit", "2")]


def split(content):
    """One archive a record."""
    return [warc.record([(k, v) for k, v in h.items() if k != "content-length"], b) for h, b in warc.records(content)]


def as_frame(spark, contents):
    return spark.createDataFrame([(bytearray(c),) for c in contents], "content binary")


def test_segments_in_any_order_and_broken_sets(spark, pages):
    whole = [r for row in archives(pages).collect() for r in split(bytes(row.content))]
    random.Random(1).shuffle(whole)
    want = sorted((str(r.page_id), r.payload_digest) for r in warc.warc_round_trip(pages).collect())
    assert sorted((str(r.page_id), r.payload_digest) for r in warc.read_archives(as_frame(spark, whole).repartition(4)).collect()) == want
    headers = [next(warc.records(r)) for r in whole]
    target = next(h["warc-refers-to"] for h, _ in headers if h["warc-type"] == "revisit")
    dangling = [r for r, (h, _) in zip(whole, headers) if target not in (h["warc-record-id"], h.get("warc-segment-origin-id"))]
    with pytest.raises(Exception, match="refers to no response"):
        warc.read_archives(as_frame(spark, dangling)).collect()
    last = next(i for i, (h, _) in enumerate(headers) if "warc-segment-total-length" in h)
    fields = {**headers[last][0], "warc-segment-total-length": "7"}
    wrong = [*whole[:last], warc.record([(k, v) for k, v in fields.items() if k != "content-length"], headers[last][1]), *whole[last + 1 :]]
    with pytest.raises(Exception, match="total length"):
        warc.read_archives(as_frame(spark, wrong)).collect()
    with pytest.raises(Exception, match="segment is missing"):
        warc.read_archives(as_frame(spark, [*whole[:last], *whole[last + 1 :]])).collect()
    other = hashlib.sha1(b"other").hexdigest()
    forged = [warc.record([(k, f"sha1:{other}" if k == "warc-payload-digest" and h["warc-type"] == "revisit" else v) for k, v in h.items() if k != "content-length"], b) for h, b in headers]
    with pytest.raises(Exception, match="doesn't agree with its response"):
        warc.read_archives(as_frame(spark, forged)).collect()


def test_extra_columns_and_empty_tables(spark, pages):
    extra = pages.select("*", F.lit(1).alias("row"), F.lit(2).alias("response_row"), F.lit(3).alias("d"))
    assert len(warc.warc_round_trip(extra).collect()) == 8 and warc.warc_round_trip(extra.where("false")).collect() == []
