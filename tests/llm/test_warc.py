import base64
import glob
import hashlib

import pytest

from llm_fixtures import frame  # noqa: F401
from tessera.llm import warc as W

TRAP = ("x\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\n"
        "Content-Type: text/plain\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n")
PAGES = [
    (1, "http://a/", "<p>é</p>"), (2, "http://b/", "<p>é</p>"), (3, None, None), (4, "u\r\nX: y", ""),
    (5, "http://c/", TRAP), (6, "http://d/", "WARC/1.0\r\n\r\nWARC/1.1 WARC/1."),
    (7, "http://e/", "tail\r\n\r\n"), (8, "http://f/", TRAP * 3), (9, "http://g/", TRAP),
    (None, "http://h/", "<p>é</p>"), (None, "http://i/", "only null ids"), (2, "http://b/", "<p>é</p>"),
    (10, "http://j/", "y" * 20000 + "WARC/1.0\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n" + "z" * 500),
]


def expected(pages):
    heads = {}
    for i, _, h in pages:
        heads.setdefault(h or "", []).append(i)
    out = []
    for i, _, h in pages:
        ids = [x for x in heads[h or ""] if x is not None]
        head = min(ids) if ids else None
        again = len(heads[h or ""]) > 1 and head is not None and i != head
        body = (h or "").encode()
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(),
                    "revisit" if again else "response", head if again else None))
    return sorted(out, key=str)


def got(spark, path):
    r = W.read_warc(spark, path)
    rows = r.collect()
    assert all(x.digest_ok for x in rows)
    ids = r.select(W.page_number(r.record_id).alias("p"), "payload_bytes", "payload_digest",
                   "record_type", W.page_number(r.refers_to).alias("r"))
    return sorted([tuple(x) for x in ids.collect()], key=str)


@pytest.mark.parametrize("split", [None, 97, 1000])
def test_round_trip_with_traps(spark, frame, scratch, split):
    df = frame([(*p, "c") for p in PAGES], "page_id long, url string, html string, value string", 2)
    W.write_warc(spark, df, f"{scratch}/w")
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert got(spark, f"{scratch}/w") == expected(PAGES)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_bytes_are_the_format(spark, frame, scratch):
    df = frame([(1, "http://a/", "hello")], "page_id long, url string, html string", 1)
    W.write_warc(spark, df, f"{scratch}/w")
    raw = b"".join(open(f, "rb").read() for f in sorted(glob.glob(f"{scratch}/w/part-*")))
    head, _, rest = raw.partition(b"\r\n\r\n")
    assert head.startswith(b"WARC/1.0\r\nWARC-Type: response\r\n")
    n = int(head.rsplit(b": ", 1)[1])
    assert rest[n:] == b"\r\n\r\n" and rest[:n].endswith(b"\r\n\r\nhello")


def test_index_offsets_point_at_records(spark, frame, scratch):
    df = frame(PAGES, "page_id long, url string, html string", 1)
    W.write_warc(spark, df, f"{scratch}/w")
    files = {f: open(f, "rb").read() for f in glob.glob(f"{scratch}/w/part-*")}
    idx = W.warc_index(spark, f"{scratch}/w").collect()
    assert sum(r.length for r in idx) == sum(map(len, files.values()))
    for r in idx:
        raw = files[r.file.removeprefix("file://").removeprefix("file:")]
        assert raw[r.offset:r.offset + 8] == b"WARC/1.0"
        assert raw[r.offset + r.length - 4:r.offset + r.length] == b"\r\n\r\n"


def test_broken_and_cut_archives(spark, scratch):
    good = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: 2\r\n\r\nok\r\n\r\n"
    import os
    os.makedirs(f"{scratch}/w")
    files = {"a": good % 1 + good.replace(b"Length: 2", b"Length: x") % 2 + good % 3,
             "b": b"junk" + good % 4, "c": b"", "d": good % 5 + (good % 6)[:-5]}
    for k, v in files.items():
        open(f"{scratch}/w/{k}.warc", "wb").write(v)
    rows = {r.record_id: r.got for r in W.warc_index(spark, f"{scratch}/w").collect()}
    assert rows == {"<urn:page:1>": 2, "<urn:page:5>": 2, "<urn:page:6>": 1}


def test_small_payloads_and_empty_table(spark, frame, scratch):
    df = frame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")],
               "page_id long, url string, html string")
    W.write_warc(spark, df, f"{scratch}/w", min_bytes=3)
    kinds = {x[0]: x[3] for x in got(spark, f"{scratch}/w")}
    assert kinds == {1: "response", 2: "response", 3: "response", 4: "revisit"}
    W.write_warc(spark, df.filter("false"), f"{scratch}/e")
    assert W.read_warc(spark, f"{scratch}/e").count() == 0


URLS = ["http://h/WARC/1.0-notes.html", "WARC/1.", "http://h/WARC/1.WARC/1.1?WARC/1.", "http://h/a\r\n\r\nWARC/1.0",
        "http://h/WARC/1.0\r\nContent-Length: 3"]


@pytest.mark.parametrize("split", [None, 331])
def test_magic_in_a_url(spark, frame, scratch, split):
    """A magic in a header cuts neither its record nor those after it from the chain."""
    pages = [p for i, u in enumerate(URLS) for p in (
        (20 + 3 * i, u, f"<p>{i}</p>"), (21 + 3 * i, f"{u}#2", TRAP + str(i)), (22 + 3 * i, "http://z/", f"z{i}"))]
    pages += [(50, URLS[0], "<p>0</p>"), (51, "http://y/", "last")]
    df = frame(pages, "page_id long, url string, html string", 2)
    W.write_warc(spark, df, f"{scratch}/w")
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert got(spark, f"{scratch}/w") == expected(pages)
        uris = {r.record_id: r.target_uri for r in W.read_warc(spark, f"{scratch}/w").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert uris == {f"<urn:page:{i}>": u.replace("\r", "%0D").replace("\n", "%0A") for i, u, _ in pages}


def test_foreign_headers_with_magics(spark, scratch):
    """Magics before and after Content-Length and in the HTTP header; a header cut by the file's end."""
    def record(i, block, head=b"", tail=b""):
        return (b"WARC/1.0\r\nWARC-Type: response\r\n%sWARC-Record-ID: <urn:page:%d>\r\nContent-Type: "
                b"application/http\r\nContent-Length: %d\r\n%s\r\n%s\r\n\r\n" % (head, i, len(block), tail, block))
    http = b"HTTP/1.1 200 OK\r\nServer: WARC/1.0 WARC/1.1\r\nContent-Length: 9\r\n\r\nokWARC/1."
    plain = b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nok"
    import os
    os.makedirs(f"{scratch}/w")
    note = b"X-Note: WARC/1.0 WARC/1.\r\n"
    raw = record(1, plain, note) + record(2, plain, b"", note) + record(3, http) + record(4, http, note, note) \
        + record(5, plain)
    open(f"{scratch}/w/a.warc", "wb").write(raw + b"WARC/1.0\r\nX: WARC/1.0\r\n")
    rows = W.warc_index(spark, f"{scratch}/w").collect()
    assert sum(r.length for r in rows) == len(raw)
    assert {(r.record_id, r.got, r.http_bytes, r.digest) for r in rows} == {
        (f"<urn:page:{i}>", len(p), len(p), base64.b32encode(hashlib.sha1(p).digest()).decode())
        for i, p in ((1, b"ok"), (2, b"ok"), (3, b"okWARC/1."), (4, b"okWARC/1."), (5, b"ok"))}


def test_many_magics_in_one_payload(spark, frame, scratch):
    """Magics by the hundred thousand in a payload, and many in a url, are read in linear time."""
    import time
    pages = [(1, "http://a/", "WARC/1." * 300_000), (2, "http://b/" + "WARC/1." * 20_000, "two"), (3, "http://c/", "x")]
    df = frame(pages, "page_id long, url string, html string", 1)
    W.write_warc(spark, df, f"{scratch}/w")
    start = time.time()
    assert got(spark, f"{scratch}/w") == expected(pages)
    assert time.time() - start < 120


def test_scans_with_different_splits_agree(spark, frame, scratch, monkeypatch):
    """The second scan of torn records has other splits than the first; nothing is lost."""
    df = frame([(*p, "c") for p in PAGES], "page_id long, url string, html string, value string", 2)
    W.write_warc(spark, df, f"{scratch}/w")
    sizes, plain = iter(["97", "311", "53", "1000", "120", "77"]), W.pieces

    def pieces(spark, path):
        spark.conf.set("spark.sql.files.maxPartitionBytes", next(sizes))
        return plain(spark, path)
    monkeypatch.setattr(W, "pieces", pieces)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = W.warc_index(spark, f"{scratch}/w")
        assert len(rows.collect()) == len(PAGES) and int(next(sizes)) < 1000
        monkeypatch.setattr(W, "pieces", plain)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "205")
        assert got(spark, f"{scratch}/w") == expected(PAGES)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
