import gzip
import hashlib

import pytest

from chronofeat.llm import arc_warc
from chronofeat.session import shared_path


@pytest.fixture
def pages(spark):
    big = "<p>" + "é\r\n\r\nWARC/1.1\r\nline\n" * 200 + "</p>"
    rows = [(1, "http://a/x y\n", big, 1), (2, None, big, 2), (9, "http://b", big, 3),
            (9, "http://b", big, 3), (3, "http://c", None, 4), (4, "", "", 5),
            (5, "u", "short", 6), (6, "u", "short", 6), (None, "v", "n" * 2000, 7),
            (7, "w", "n" * 2000, 8), (8, "z", "x" * 3_000_000, 9)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest long")


def test_round_trip_and_revisits(pages):
    got = arc_warc.archive_pages(pages).collect()
    assert len(got) == 11
    want = sorted((r.page_id or -1, len((r.html or "").encode()),
                   hashlib.sha1((r.html or "").encode()).hexdigest()) for r in pages.collect())
    assert sorted((r.page_id or -1, r.payload_bytes, r.payload_digest) for r in got) == want
    again = sorted((r.page_id or -1, r.refers_to) for r in got if r.record_type == "revisit")
    assert again == [(-1, 7), (1, 9), (2, 9), (9, 9)]
    ids = {r.record_id: r for r in got}
    assert len(ids) == 11
    for r in got:
        if r.refers_to_record:
            assert ids[r.refers_to_record].record_type == "response"
            assert ids[r.refers_to_record].payload_digest == r.payload_digest
    assert {r.date for r in got} == {"2024-01-01T00:00:00Z"}


def test_empty_table(spark, pages):
    assert arc_warc.archive_pages(pages.where("false")).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_both_header_versions(version):
    block = b"HTTP/1.1 200 OK\r\nX: 1\r\n\r\nbody\n\nmore"
    record = arc_warc.arc_record(version, "http://h/", 5, b"pay\nload")
    data = arc_warc.arc_filedesc(version) + b"\n" + record + b"\n\n\n" + record + b"\n"
    got = list(arc_warc.read_arc_records(gzip.compress(data)))
    assert len(got) == 2 and all(f[0] == b"http://h/" and b.endswith(b"pay\nload")
                                 for _, f, b in got)
    assert [at for at, _, _ in got] == [data.index(record), data.rindex(record)]
    assert list(arc_warc.read_arc_records(data)) == got
    assert arc_warc._split_http(block)[1] == b"body\n\nmore"


def test_broken_archives_raise():
    good = arc_warc.arc_filedesc(1) + b"\n" + arc_warc.arc_record(1, "u", 1, b"abc")
    with pytest.raises(ValueError, match="declared length"):
        list(arc_warc.read_arc_records(good[:-1]))
    with pytest.raises(ValueError, match="header"):
        list(arc_warc.read_arc_records(arc_warc.arc_filedesc(2) + b"\n"
                                       + arc_warc.arc_record(1, "u", 1, b"abc")))


def test_other_records_become_resources(spark, tmp_path):
    data = arc_warc.arc_filedesc(1) + b"\ndns:h 0.0.0.0 2020 text/dns 4\nA  1\n"
    (tmp_path / "part-0.gz").write_bytes(gzip.compress(data))
    out = arc_warc.convert(spark, str(tmp_path), shared_path(spark, "warc-test"))
    r = arc_warc.read_warc(spark, out).first()
    assert (r.record_type, r.payload_bytes, r.date) == ("resource", 4, "2020-01-01T00:00:00Z")


def test_malformed_lines_are_set_aside_and_listed(spark, tmp_path):
    good = [arc_warc.arc_record(1, f"http://h/{i}", i, b"payload %d" % i) for i in range(4)]
    bad = [b"http://h/x 0.0.0.0 20240101000000 text/html many\nlost body\nmore of it",
           b"http://h/y 0.0.0.0 20241301000000 text/html 3\nabc"]
    data = b"\n".join([arc_warc.arc_filedesc(1), good[0], bad[0], good[1], bad[1], good[2],
                       b"http://h/a b 0.0.0.0 20240101000000 text/html 2\nhi", good[3][:-2]])
    (tmp_path / "part-0.gz").write_bytes(gzip.compress(data))
    (tmp_path / "part-1.gz").write_bytes(gzip.compress(b"\n".join(
        [arc_warc.arc_filedesc(1).replace(b"1 0 chrono", b"7 0 chrono"), good[0]])))
    faults = arc_warc.arc_faults(spark, str(tmp_path)).orderBy("file", "offset").collect()
    assert [r.offset for r in faults] == [data.index(bad[0]), data.index(bad[1]),
                                          data.rindex(b"http://h/3"), 0]
    for r, reason in zip(faults, ("bad length", "bad date", "declared length", "unknown ARC")):
        assert reason in r.reason
    out = arc_warc.convert(spark, str(tmp_path), shared_path(spark, "warc-faults"))
    read = arc_warc.read_warc(spark, out).collect()
    assert sorted(r.uri for r in read) == ["http://h/0", "http://h/0", "http://h/1", "http://h/2",
                                           "http://h/a%20b"]
    assert sorted(r.page_id for r in read if r.page_id is not None) == [0, 0, 1, 2]
    assert arc_warc.arc_faults(spark, str(tmp_path / "part-1.gz")).count() == 1


def test_whole_archives_have_no_faults(spark, pages):
    path = arc_warc.write_arc(pages, shared_path(spark, "arc-whole"))
    assert arc_warc.arc_faults(spark, path).count() == 0
