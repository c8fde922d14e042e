"""Archives against plain Python: round trips, versions, copies, and damage."""

import base64
import gzip
import hashlib
import tempfile

import pytest

from vacancia.llm import archives
from vacancia.llm.queries import op13_warc

COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def plain(rows, least=0):
    """(page_id, url, html) -> what the archives say."""
    out, last = [], {}
    rank = lambda i: (i is not None, i or 0)
    pages = [(i, (html or "").encode()) for i, _, html in rows]
    for i, payload in pages:
        if len(payload) >= least and (payload not in last or rank(i) > rank(last[payload])):
            last[payload] = i
    held = set()
    for i, payload in pages:
        first = len(payload) < least or (i == last[payload] and payload not in held)
        if first and len(payload) >= least:
            held.add(payload)
        out.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(),
                    "response" if first else "revisit", None if first else last[payload]))
    return sorted(out, key=str)


def trip(spark, table, **options):
    folder = tempfile.mkdtemp(prefix="archives-")
    archives.write_arc(table, folder + "/arc")
    archives.convert(spark, folder + "/arc", folder + "/warc", **options)
    return folder, archives.read_warc(spark, folder + "/warc")


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.withColumnRenamed("key", "page_id").collect()), key=str)


def test_query_equals_plain_python(spark):
    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html").collect()
    got = op13_warc(spark, folder)
    assert dict(got.dtypes)["payload_bytes"] == "bigint"
    assert found(got) == plain([tuple(r) for r in rows])


@pytest.fixture(scope="module")
def odd(spark):
    """Copies over many tasks, repeated rows, nulls, empty pages, and pages that look like archives."""
    rows = [(i, f"http://h/{i}", f"page {i % 7}") for i in range(120)]
    rows += [(i, None, "hot\n") for i in range(500, 900)] + [(900, "u", "hot\n")] * 2
    rows += [(None, "http://a b\nc", "no id"), (None, "", "no id"), (1000, "x", None), (1001, "x", ""), (None, "x", "")]
    rows += [(2000, "y", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n"),
             (2001, "y", "http://u 0.0.0.0 20010203040506 text/html 5\nabcde\n\r\n\r\n\x00é🎉"),
             (-5, "y", "x" * 300_000), (-4, "y", "x" * 300_000)]
    return rows, spark.createDataFrame([(*r, "k", "v") for r in rows],
                                       "page_id long, url string, html string, key string, value string")


@pytest.mark.parametrize("least", [0, 7])
def test_odd_pages(spark, odd, least):
    rows, table = odd
    assert found(trip(spark, table.repartition(5), least=least)[1]) == plain(rows, least)


def test_no_pages(spark, odd):
    assert trip(spark, odd[1].limit(0))[1].collect() == []


def test_versions_and_synthesised_fields(spark):
    """Both versions give the same records; a revisit names its response; other content becomes a resource."""
    blocks = [b"HTTP/1.0 200 OK\r\nX-Page-Id: 3\r\n\r\nsame", b"HTTP/1.0 200 OK\nX-Page-Id: 4\n\nsame", b"\x00\xffraw\n"]
    folder = tempfile.mkdtemp(prefix="archives-")
    import os
    os.mkdir(folder + "/arc")
    for version in (1, 2):
        name = f"old{version}.arc"
        data = archives.arc_opening(version, name, "19990102030405") + b"\n" + b"".join(
            archives.arc_record(version, name, f"dns:v{version} x", "1999010203", b) + b"\n" for b in blocks)
        data = data.replace(b"%20x", b" x")  # addresses with spaces are found in old files
        with open(f"{folder}/arc/{name}", "wb") as file:
            file.write(data if version == 1 else gzip.compress(data[:90]) + gzip.compress(data[90:]))
    assert [x["Archive-length"] for x in archives.parse_arc(data)] == [str(len(b)) for b in blocks]
    archives.convert(spark, folder + "/arc", folder + "/warc")
    rows = archives.read_warc(spark, folder + "/warc").collect()
    assert sorted(r.record_type for r in rows) == ["resource"] * 2 + ["response"] + ["revisit"] * 3
    response = next(r for r in rows if r.record_type == "response")
    assert response.key == 4 and response.date == "1999-01-02T03:00:00Z" and response.url == "dns:v2 x"
    revisits = [r for r in rows if r.record_type == "revisit"]
    assert {(r.refers_to_id, r.refers_to, r.payload_bytes) for r in revisits} == {(response.id, 4, 4)}
    assert len({r.id for r in rows}) == 6
    raw = b"".join(gzip.decompress(open(os.path.join(folder, "warc", f), "rb").read())
                   for f in os.listdir(folder + "/warc") if f.endswith(".gz"))
    fields = [f for f, _ in archives.parse_warc(raw) if f["warc-type"] == "revisit"]
    assert all(f["warc-profile"] == archives.REVISIT_PROFILE and f["warc-refers-to-date"] == response.date
               for f in fields)


@pytest.mark.parametrize("spoil, message", [
    (lambda d: d[:-3], "ends inside"), (lambda d: d[d.index(b"\n") + 1:], "no version block"),
    (lambda d: d.replace(b"text/html 4", b"text/html x"), "no length"),
    (lambda d: d.replace(b"1 0 vacancia\nURL", b"1 0 vacancia\nUrl"), "unknown version"),
])
def test_broken_archives_are_errors(spoil, message):
    data = archives.arc_opening(1, "a", "2001") + b"\n" + archives.arc_record(1, "a", "u", "2001", b"abcd")
    assert [r["block"] for r in archives.parse_arc(data)] == [b"abcd"]
    with pytest.raises(ValueError, match=message):
        list(archives.parse_arc(spoil(data)))
