"""Archives there and back."""

import base64
import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from chronopanel.llm import warc

PAGES = [(1, "http://a/1", "<p>ü</p>"), (2, "http://a/2\r\nX: y", "same"), (5, None, "same"), (3, "u", "same"), (7, "u", None), (8, "u", ""), (9, "u", "x" * 70_000), (10, "u", "a\r\n\r\nWARC/1.1\r\n\r\nb"), (11, "u", "twice"), (11, "u", "twice"), (None, "u", "same"), (None, "u", "alone")]


def expected(min_bytes=0):
    groups = {}
    for i, _, html in PAGES:
        groups.setdefault(html or "", []).append(i)
    out = []
    for i, _, html in PAGES:
        raw = (html or "").encode()
        ids = [x for x in groups[html or ""] if x is not None]
        last = max(ids) if ids and len(raw) >= min_bytes else None
        revisit = len(groups[html or ""]) > 1 and last is not None and i != last
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", last if revisit else None))
    return sorted(map(str, out))


@pytest.mark.parametrize(("min_bytes", "size"), [(0, 32_000_000), (5, 100)])
def test_round_trip(spark, tmp_path, min_bytes, size):
    made = warc.archive(spark.createDataFrame([(*p, 0) for p in PAGES], "page_id long, url string, html string, sha1 int"), str(tmp_path), min_bytes, size)
    got = warc.read_archives(made).collect()
    assert sorted(str(tuple(r)) for r in got) == expected(min_bytes)
    for r in made.collect():
        whole = gzip.decompress(open(r["path"], "rb").read())
        assert whole.count(b"WARC-Record-ID") == r["records"] == len(open(r["index"]).readlines())
    assert not (tmp_path / "whole").exists() and not list(tmp_path.rglob("*.unfinished"))


def test_members_and_broken_archives():
    one, two = warc.record(1, "u", b"abc", None), warc.record(2, None, b"", 1)
    several = gzip.compress(one) + gzip.compress(two)
    assert list(warc.split_records(warc.inflate(io.BytesIO(several)))) == [one, two]
    assert warc.parse(two)[3:] == ("revisit", 1)
    with pytest.raises(ValueError):
        list(warc.split_records(iter([one[:-9]])))
    with pytest.raises(ValueError):
        warc.parse(one.replace(b"abc", b"abd"))


@pytest.mark.parametrize("cut", [1, 4, 8, 60])
def test_cut_streams_raise(cut):
    whole = gzip.compress(warc.record(1, "u", b"abc", None))
    for stream in (whole[:-cut], whole + whole[:-cut]):
        with pytest.raises(ValueError):
            list(warc.split_records(warc.inflate(io.BytesIO(stream))))
    two = whole + gzip.compress(warc.record(2, "u", b"", None))
    with pytest.raises(ValueError):
        list(warc.split_records(warc.inflate(io.BytesIO(two[: len(whole) + 5]))))
    assert list(warc.inflate(io.BytesIO(b""))) == []


def test_counts_are_held_against_what_was_written(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"page {i}") for i in range(10)], "page_id long, url string, html string").coalesce(1)
    made = warc.archive(pages, str(tmp_path / "a"))
    assert warc.read_archives(made).count() == 10
    for wrong in (9, 11):
        with pytest.raises(Exception, match="records"):
            warc.read_archives(made.withColumn("records", F.lit(wrong).cast("long"))).count()
    (path,) = [r["path"] for r in made.collect()]
    with pytest.raises(Exception, match="10 records, 3 were written"):
        warc.normalise(spark.createDataFrame([(path, 3)], "path string, records long"), str(tmp_path / "b")).count()


def test_no_pages(spark, tmp_path):
    assert warc.read_archives(warc.archive(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path))).count() == 0
