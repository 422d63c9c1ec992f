import gzip
import hashlib
import io
import zipfile

import pyarrow.fs
import pytest

from loomgraph.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, n long"
LONG = "<p>long</p>" * 120


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "d", 1) for i, u, h in rows], SCHEMA).repartition(3)


def test_round_trip(spark):
    rows = [(1, "http://a.example/x y", LONG), (5, "http://b.example/", LONG), (3, None, LONG), (2, "http://c.example/é", "short"), (4, "http://d.example/", "short"), (6, "u", None), (7, "u", ""), (8, "u", "ü\r\n\r\nbody" * 300), (None, "u", LONG), (9, "u", "x" * 300_000)]
    got = {r["page_id"]: r for r in warc.round_trip(pages(spark, rows), warc.Params(package_bytes=2000), payload=True).collect()}
    assert len(got) == len(rows)
    for page, _, html in rows:
        r, raw = got[page], (html or "").encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
        if page in (1, 3):
            assert (r["record_type"], r["refers_to"], r["payload"]) == ("revisit", 5, None)
        else:
            assert (r["record_type"], r["refers_to"], bytes(r["payload"])) == ("response", None, raw)


def test_ranges_can_be_chosen_through_the_index(spark, tmp_path):
    rows = [(i, f"http://x.example/{i}", f"page {i}") for i in range(40)]
    packages = warc.write_packages(pages(spark, rows), f"file://{tmp_path}/p", warc.Params(package_bytes=900))
    listed = spark.createDataFrame(packages.collect())
    assert listed.count() > 3 and listed.agg({"records": "sum"}).first()[0] == 40
    some = warc.read_records(warc.locate(listed).filter("page_id % 10 = 3"))
    assert sorted((r["page_id"], bytes(r["payload"]).decode()) for r in some.collect()) == [(i, f"page {i}") for i in (3, 13, 23, 33)]


def test_repeated_rows_and_an_empty_table(spark):
    rows = [(1, "u", LONG), (1, "u", LONG), (2, "v", LONG), (2, "v", LONG)]
    got = sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages(spark, rows)).collect())
    assert got == [(1, "revisit", 2)] * 2 + [(2, "response", None)] * 2
    assert warc.round_trip(pages(spark, [])).count() == 0


@pytest.mark.parametrize("wide", [False, True])
def test_directories_and_zip64_directories(tmp_path, monkeypatch, wide):
    if wide:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    path = tmp_path / "x.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.comment = b"a comment PK\5\6 with a false end"[:0]
        for name, data in (("a.txt", b"first member"), ("d/é.txt", b"second" * 50)):
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=wide) as f:
                f.write(data)
    file = pyarrow.fs.LocalFileSystem().open_input_file(str(path))
    members = warc.read_directory(file)
    assert set(members) == {"a.txt", "d/é.txt"}
    for name, data in (("a.txt", b"first member"), ("d/é.txt", b"second" * 50)):
        assert file.read_at(members[name].size, warc.data_start(file, members[name])) == data


def test_what_is_broken_fails(tmp_path):
    bad = tmp_path / "bad"
    bad.write_bytes(b"no zip file")
    with pytest.raises(ValueError):
        warc.read_directory(pyarrow.fs.LocalFileSystem().open_input_file(str(bad)))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"a" * 99)
    (tmp_path / "deflated").write_bytes(packed.getvalue())
    file = pyarrow.fs.LocalFileSystem().open_input_file(str(tmp_path / "deflated"))
    with pytest.raises(ValueError):
        warc.data_start(file, warc.read_directory(file)["a"])
    record = warc.record_bytes(1, "u", hashlib.sha1(b"x").digest(), 1, b"y", None, "1970-01-01T00:00:00Z")
    with pytest.raises(ValueError):
        warc.parse_record(gzip.decompress(gzip.compress(record)))
