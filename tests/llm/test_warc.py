import hashlib
import io
import zlib

import pytest

from shelfwise.functions.staging import new_path
from shelfwise.llm import warc

PAGES = "page_id bigint, url string, html string, digest string, record_type string"


def records(data: bytes, size: int):
    """Records of all ranges of a file, per range."""
    with io.BytesIO(data) as source:
        return [list(warc.records_in(source, a, a + size, len(data))) for a in range(0, len(data), size)]


@pytest.mark.parametrize("size", [1, 7, 64, 500, 5000, 10**6])
def test_every_record_is_owned_once(size):
    payloads = [b"", b"x", bytes(range(256)) * 40, b"\x1f\x8b\x08\x00" * 50, b"plain text " * 300]
    data = b"".join(warc.record(i, "http://a b/\n", p, hashlib.sha1(p).hexdigest(), None) for i, p in enumerate(payloads))
    found = [r for part in records(data, size) for r in part]
    assert [warc._row(r, True)[0] for r in found] == [0, 1, 2, 3, 4]
    assert [warc._row(r, True)[7] for r in found] == payloads
    assert all(warc._row(r, True)[6] for r in found)


def test_false_magic_and_damage_are_passed_over():
    good = warc.record(1, None, b"a" * 100, hashlib.sha1(b"a" * 100).hexdigest(), None)
    other = zlib.compressobj(6, zlib.DEFLATED, 31)
    member = other.compress(b"not a record") + other.flush()
    broken = good[:40] + b"\xff" * 20 + good[60:]
    data = b"\x1f\x8b" + warc.MAGIC + member + good + broken + member + good
    found = [warc._row(r, True) for part in records(data, 50) for r in part]
    assert [f[0] for f in found] == [1, 1]


def test_round_trip(spark):
    big, other = "<p>é</p>" * 400, "y" * 1500
    rows = [(1, "http://a/1", big), (2, None, big), (9, "http://a/9", big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "", ""),
            (None, "n", other), (7, "m", other), (8, "m", other), (8, "m", other), (10, "z", "x" * 999), (11, "z", "x" * 999)]
    pages = spark.createDataFrame([(*r, "d", "t") for r in rows], PAGES)
    manifest = warc.write_archives(pages, new_path(spark, "warc-test"), archive_bytes=500)
    assert manifest.count() > 1
    got = warc.read_archives(manifest, range_bytes=100).collect()
    assert len(got) == len(rows) and all(r["intact"] for r in got)
    refers = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in got)
    assert refers == sorted([("1", "revisit", 9), ("2", "revisit", 9), ("9", "response", None), *[(i, "response", None) for i in (
        "3", "4", "5", "6", "None", "8", "8", "10", "11")], ("7", "revisit", 8)])
    payload = {r["page_id"]: r for r in got}
    assert bytes(payload[9]["payload"]).decode() == big and payload[1]["payload"] is None
    for i, _, html in rows:
        data = (html or "").encode()
        assert payload[i]["payload_bytes"] == len(data) and payload[i]["payload_digest"] == hashlib.sha1(data).hexdigest()
    assert payload[2]["target_uri"] is None


def test_no_pages(spark):
    manifest = warc.write_archives(spark.createDataFrame([], PAGES), new_path(spark, "warc-none"))
    assert manifest.count() == 0 and warc.read_archives(manifest).count() == 0
