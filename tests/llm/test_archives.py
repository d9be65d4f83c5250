import base64
import hashlib
import io
from collections import Counter

import pytest
from awkward_rows import awkward, empty  # noqa: F401
from raterscope.llm import warc


def digest(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


@pytest.fixture(scope="module")
def pages(spark):
    rows = [
        (3, "http://a/3", "same"), (1, "http://a/1", "same"), (2, None, "other"), (4, "http://a\r\nX: y", ""), (5, "u", None),
        (6, "http://é", "<p>é😀</p>\r\n\r\nWARC/1.1\r\n"), (7, "u", "z" * 300000), (None, "u", "same"), (8, "u", "same"), (8, "u", "same"),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string".replace(", digest string", "")).repartition(4)


def test_round_trip(spark, pages):
    archives = warc.write_archives(pages, archive_bytes=500)
    assert archives.count() > 2
    rows = warc.read_archives(archives, payloads=True).collect()
    first = {}
    expected = Counter()
    for r in pages.collect():
        text = r["html"] or ""
        if r["page_id"] is not None:
            first[text] = min(first.get(text, r["page_id"]), r["page_id"])
    for r in pages.collect():
        text, page = r["html"] or "", r["page_id"]
        own = first[text] == page
        expected[(None if page is None else str(page), len(text.encode()), digest(text), "response" if own else "revisit", None if own else str(first[text]))] += 1
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows)
    assert got == expected
    texts = {r["page_id"]: r["payload"].decode() for r in rows if r["record_type"] == "response"}
    assert texts["6"] == "<p>é😀</p>\r\n\r\nWARC/1.1\r\n" and texts["7"] == "z" * 300000
    assert {r["page_id"]: r["url"] for r in rows}["4"] == "http://aX: y"


def test_small_payloads_are_all_responses(spark, pages):
    rows = warc.read_archives(warc.write_archives(pages, least_bytes=5)).collect()
    assert all(r["record_type"] == "response" for r in rows if r["payload_bytes"] < 5)


def test_no_rows(spark, pages):
    assert warc.read_archives(warc.write_archives(pages.filter("false"))).count() == 0


def records(*payloads):
    return [warc.gzip_member(warc.record_bytes(str(i), "u", p, None, "2020-01-01T00:00:00Z")) for i, p in enumerate(payloads)]


class Dribble(io.BytesIO):
    """A stream that gives one byte at a time."""

    def read(self, size=-1):
        return super().read(1)


def test_null_and_empty_ids_are_rows_of_their_own(spark):
    rows = [("", "u1", "same"), (None, "u2", "same"), ("a", "u3", "same"), (None, "u4", "other"), (None, "u5", "other")]
    got = {r["url"]: (r["record_type"], r["refers_to"]) for r in warc.read_archives(warc.write_archives(spark.createDataFrame(rows, "page_id string, url string, html string"))).collect()}
    assert got["u1"] == ("response", None) and {got["u2"][0], got["u3"][0]} == {"revisit"}
    assert got["u4"] == got["u5"] == ("response", None)


def test_folders_have_the_scheme_of_their_file_system(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string")
    for folder in (str(tmp_path / "plain"), f"file://{tmp_path}/named"):
        archives = warc.write_archives(pages, folder)
        assert all(r["path"].startswith("file:/") for r in archives.collect()) and warc.read_archives(archives).count() == 1


def test_members_across_any_reads():
    data = b"".join(records(b"", b"abc", b"x" * 5000))
    for stream in (io.BytesIO(data), Dribble(data)):
        assert [r.payload for r in warc.SequentialReader(stream)] == [b"", b"abc", b"x" * 5000]


def test_damage_is_found():
    one, two = records(b"abc", b"def" * 1000)
    cases = [one + two[:-5], one[:-12] + b"\0" * 12, b"junk" + one]
    plain = warc.record_bytes("1", "u", b"abc", None, "d")
    cases.append(warc.gzip_member(plain.replace(b"abc", b"abd")))
    cases.append(warc.gzip_member(plain + b"more"))
    cases.append(warc.gzip_member(plain[:-5]))
    cases.append(warc.gzip_member(plain.replace(b"WARC/1.1", b"WARC/9.9")))
    for data in cases:
        with pytest.raises(warc.DamagedArchive):
            list(warc.SequentialReader(io.BytesIO(data)))
