import hashlib
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from eventide.llm import warc_zip


def reader(data):
    return (lambda at, n: data[at : at + n]), len(data)


def zipped(members, wide=False, comment=b""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.comment = comment
        for name, data in members.items():
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=wide) as f:
                f.write(data)
    return out.getvalue()


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("comment", [b"", b"note PK\x05\x06 in a comment"])
def test_members(wide, comment):
    members = {"a/b.txt": b"hello", "é.bin": b"x" * 3000, "empty": b""}
    read, size = reader(zipped(members, wide, comment))
    found = warc_zip.zip_members(read, size)
    assert set(found) == set(members)
    for name, data in members.items():
        at, n = warc_zip.stored_range(read, found[name])
        assert read(at, n) == data


def test_many_members_need_zip64():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(66_000):
            z.writestr(zipfile.ZipInfo(str(i)), b"")
        z.writestr(zipfile.ZipInfo("last"), b"here")
    read, size = reader(out.getvalue())
    found = warc_zip.zip_members(read, size)
    assert len(found) == 66_001
    at, n = warc_zip.stored_range(read, found["last"])
    assert read(at, n) == b"here"


def test_zip64_offsets(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)
    members = {str(i): bytes([i]) * 90 for i in range(9)} | {"big": b"z" * 500}
    read, size = reader(zipped(members, wide=True))
    found = warc_zip.zip_members(read, size)
    assert all(read(*warc_zip.stored_range(read, found[k])) == v for k, v in members.items())


def test_damaged_and_compressed():
    with pytest.raises(ValueError):
        warc_zip.zip_members(*reader(b"not a zip at all" * 10))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"a" * 1000)
    read, size = reader(out.getvalue())
    with pytest.raises(ValueError):
        warc_zip.stored_range(read, warc_zip.zip_members(read, size)["a"])


def test_record_round_trip():
    payload = b"<html>\r\n\r\n\xff</html>"
    fields, got = warc_zip.parse_record(warc_zip.warc_record("7 x", "http://a/\r\nEvil: b?q=é", payload, "d", None))
    assert got == payload and fields["warc-type"] == "response" and "evil" not in fields
    fields, got = warc_zip.parse_record(warc_zip.warc_record("8", None, payload, "d", "7"))
    assert got == b"" and fields["warc-refers-to"] == "<urn:x-record:7>" and "warc-target-uri" not in fields


@pytest.mark.parametrize("package_bytes", [1 << 30, 2000])
def test_pages(spark, tmp_path, monkeypatch, package_bytes):
    big, small = "<p>" + "x" * 200, "tiny"
    rows = [(i, f"http://h/{i}", big if i % 3 == 0 else small if i % 3 == 1 else f"page {i} " * 20) for i in range(40)]
    rows += [(100, None, None), (101, "u", ""), (102, "u", "é" * 60), (103, "u", "é" * 60), (3, "again", big), (None, "n", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("payload", "digest", "refers_to", "id", "_first")}).repartition(3)
    monkeypatch.setattr(warc_zip.write_packages, "__defaults__", (package_bytes,))
    got = warc_zip.archived_pages(pages, folder=f"file://{tmp_path}/w").collect()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h] = min(first.get(h, i), i)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        again = len(data) >= 100 and i != first[h]
        want.append((str(i), len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", str(first[h]) if again else "None"))
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in got) == sorted(want)
    files = list((tmp_path / "w").glob("*.wacz"))
    assert (len(files) > 3) == (package_bytes < 1 << 30) and not list((tmp_path / "w").glob("*.tmp"))
    assert all(zipfile.ZipFile(f).testzip() is None for f in files)


def test_no_pages(spark):
    assert warc_zip.archived_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
