"""ARC files, their conversion and WARC files, read back."""

import gzip
import hashlib
import io
import os

import pytest
from llm_cases import ordered, table

from fleetlens.llm import arc_to_warc as A
from fleetlens.llm.scratch import fresh_path
from fleetlens.llm.ship import ship_code

V1 = (
    b"filedesc://old.arc 0.0.0.0 19970101000000 text/plain 75\n1 0 Org\nURL IP-address Archive-date Content-type Archive-length\n"
    b"\nhttp://a.example/ 1.2.3.4 19970102030405 text/html 41\nHTTP/1.0 200 OK\r\nA: b\r\n\r\nbody with\n\nlines\n"
    b"\ndns:a.example 1.2.3.4 19970102 text/dns 7\n1.2.3.4\n"
)


def v1_archive():
    head, _, rest = V1.partition(b"\n1 0 Org")
    block = b"1 0 Org\nURL IP-address Archive-date Content-type Archive-length\n"
    return b"filedesc://old.arc 0.0.0.0 19970101000000 text/plain " + str(len(block)).encode() + b"\n" + block + rest[rest.index(b"\n\nhttp") + 1 :]


def test_header_lines_and_declared_lengths():
    records = list(A.arc_records(io.BytesIO(v1_archive())))
    assert [r["url"] for r in records] == ["filedesc://old.arc", "http://a.example/", "dns:a.example"]
    assert [r["version"] for r in records] == ["1"] * 3
    assert records[1]["body"].endswith(b"body with\n\nlines") and records[2]["body"] == b"1.2.3.4"
    met = [A.synthesised("old.arc", r) for r in records]
    assert [m["warc_type"] for m in met] == ["warcinfo", "response", "resource"]
    assert [m["date"] for m in met] == ["1997-01-01T00:00:00Z", "1997-01-02T03:04:05Z", "1997-01-02T00:00:00Z"]
    assert met[1]["payload_digest"] == hashlib.sha256(b"body with\n\nlines").hexdigest()
    assert len({m["record_id"] for m in met}) == 3 and met == [A.synthesised("old.arc", r) for r in records]


def test_version_two_lines_have_ten_fields():
    block = A._version_block("2", "x.arc", "20200101000000")
    record = A._arc_record("2", "http://b.example/", "::1", "20200102000000", "text/html", 404, b"HTTP/1.1 404 No\r\n\r\nx", len(block) + 1, "x.arc")
    first, second = A.arc_records(io.BytesIO(block + b"\n" + record + b"\n"))
    assert second["result-code"] == "404" and second["offset"] == int(first["archive-length"]) + block.index(b"\n") + 2
    assert second["checksum"] == hashlib.md5(second["body"]).hexdigest()


@pytest.mark.parametrize("bad", [b"http://a/ 1 2 3 4\nbody", v1_archive()[:-4], v1_archive().replace(b"dns:a.example 1", b"dns:a.example x 1"), v1_archive().replace(b"\n1 0 Org", b"\n9 0 Org")])
def test_malformed_archives_are_refused(bad):
    with pytest.raises(ValueError):
        list(A.arc_records(io.BytesIO(bad)))


def told(data):
    faults = []
    return [r["url"] for r in A.arc_records(io.BytesIO(data), lambda at, what: faults.append((at, what)))], faults


def test_reading_goes_on_after_a_fault():
    good = v1_archive()
    urls = ["filedesc://old.arc", "http://a.example/", "dns:a.example"]
    assert told(good) == (urls, [])
    at = good.index(b"http://a")
    for junk in (b"no header line\n", b"one\n two three\n\nfour 5\n", b"http://b/ 1.2.3.4 1997 text/html many\n", b"\xff\xfe\n"):
        found, faults = told(good[:at] + junk + good[at:])
        assert found == urls and faults == [(at, "not a version 1 header line")]
    found, faults = told(good.replace(b"text/html 41", b"text/html x41"))  # its body is passed, the next record is found
    assert found == [urls[0], urls[2]] and faults[0][0] == at and len(faults) == 1
    found, faults = told(good.replace(b"http://a.example/ ", b"http://a.example/a b  c "))
    assert found[1] == "http://a.example/a b  c" and not faults
    found, faults = told(good[:-4])
    assert found == urls[:2] and [w for _, w in faults] == ["the archive ends within a record"]
    assert told(b"x" + good)[0] == [] and told(good.replace(b"\n1 0 Org", b"\n9 0 Org"))[0] == [] and told(b"") == ([], [])


def test_faulty_archives_do_not_end_the_job(spark):
    ship_code(spark)
    folder = fresh_path(spark, "faulty")
    os.makedirs(folder)
    good = v1_archive()
    files = {
        "part-0.arc": good, "part-1.arc.gz": gzip.compress(good), "part-2.arc.gz": gzip.compress(good * 1)[:-30], "part-3.arc": b"garbage\n" * 50, "part-4.arc": b"",
        "part-5.arc": good.replace(b"dns:a", b"oops\ndns:a"), "part-6.arc": good.replace(b"A: b", b"X-Page-Id: seven")[:-4],
    }
    for name, data in files.items():
        with open(f"{folder}/{name}", "wb") as f:
            f.write(data)
    faults = {(r.archive, r.fault.split(":")[0]) for r in A.arc_faults(spark, folder).collect()}
    assert {a for a, _ in faults} >= {"part-2.arc.gz", "part-3.arc", "part-5.arc", "part-6.arc"} and not {a for a, _ in faults} & {"part-0.arc", "part-1.arc.gz", "part-4.arc"}
    read = A.read_arc(spark, folder).collect()
    assert sum(r.uri == "dns:a.example" for r in read) >= 3
    warc = fresh_path(spark, "warc")
    A.convert(spark, folder, warc)
    assert sorted(r.record_id for r in A.read_warc(spark, warc).collect()) == sorted(r.record_id for r in read)
    with pytest.raises(Exception, match="version block|ends within|header line has|end-of-stream"):
        A.read_arc(spark, folder, strict=True).collect()


PAGES = [
    (1, "http://a.example/x y", "p" * 100, "1"), (2, "http://b.example/", "p" * 100, "2"), (3, None, "p" * 99, "3"), (4, "http://c/", "p" * 99, "4"),
    (5, "http://d/\n", None, "5"), (6, "", "", "6"), (7, "filedesc://trick", "é" * 50, "7"), (8, "http://e/", "é" * 50, "8"), (0, "http://f/", "p" * 100, "0"),
    (9, "http://g/", "HTTP/1.1 200 OK\r\n\r\nWARC/1.1\r\n\n\n" + "z" * 5000, "9"), (None, "http://h/", "q" * 200, "n"), (10, "http://h/", "q" * 200, "10"),
    (11, "http://i/", "long " * 60_000, "11"), (12, "http://i/", "long " * 60_000, "12"),
]


def pages(spark, rows=PAGES):
    ship_code(spark)
    return spark.createDataFrame(rows, "page_id long, url string, html string, record_type string")


def test_round_trip_of_messy_pages(spark):
    got = A.archive_pages(pages(spark).repartition(3))
    by_payload = {}
    for i, _, html, _ in PAGES:
        by_payload.setdefault((html or ""), []).append(i)
    want = []
    for i, _, html, _ in PAGES:
        raw = (html or "").encode()
        least = min((x for x in by_payload[html or ""] if x is not None), default=None)
        revisit = len(raw) >= 100 and least is not None and i != least
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", least if revisit else None))
    assert table(got, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == ordered(want)


def test_files_are_valid_and_keep_the_payload(spark):
    arc, warc = fresh_path(spark, "arc"), fresh_path(spark, "warc")
    A.write_arc(pages(spark).repartition(2), arc)
    A.convert(spark, arc, warc)
    records = []
    for f in spark.read.format("binaryFile").load(warc).select("content").collect():
        records += list(A.warc_records(io.BytesIO(gzip.decompress(f.content)))) if f.content else []
    by_id = {f["warc-record-id"]: (f, b) for f, b in records}
    assert len(by_id) == len(records)
    kinds = [f["warc-type"] for f, _ in records]
    assert kinds.count("warcinfo") == 2 and kinds.count("revisit") == 5 and kinds.count("response") == len(PAGES) - 5
    for f, block in records:
        assert f["warc-block-digest"] == f"sha256:{hashlib.sha256(block).hexdigest()}"
        if f["warc-type"] == "revisit":
            target, target_block = by_id[f["warc-refers-to"]]
            assert target["warc-type"] == "response" and target["warc-payload-digest"] == f["warc-payload-digest"]
            assert target["warc-target-uri"] == f["warc-refers-to-target-uri"] and A.split_http(block)[1] == b""
            assert A.http_field(block, "Content-Length") == str(len(A.split_http(target_block)[1]))
    versions = {r["version"] for f in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(arc).collect() for r in A.arc_records(io.BytesIO(gzip.decompress(f.content)))}
    assert versions == {"1", "2"}


def test_hot_payload_has_one_response(spark):
    rows = [(i, "http://x/", "same " * 50, "") for i in range(400)] + [(1000, "http://y/", "other " * 50, "")]
    got = A.archive_pages(pages(spark, rows).repartition(5)).collect()
    assert sorted(r.page_id for r in got if r.record_type == "response") == [0, 1000]
    assert {r.refers_to for r in got if r.record_type == "revisit"} == {0} and len(got) == 401


def test_empty_table(spark):
    assert A.archive_pages(pages(spark, [])).count() == 0
