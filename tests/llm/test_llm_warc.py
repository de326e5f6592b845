"""Archives and capture index against plain rules, and by reading the files without the library."""

import gzip
import hashlib
import io
import random
import zlib

import pytest

from demandloom.llm import warc

SCHEMA = "page_id long, url string, html string"


def plain(rows):
    """Each row as (page_id, bytes, digest, type, refers_to), by the stated rules."""
    data = [(i, u, (h or "").encode()) for i, u, h in rows]
    groups = {}
    for i, u, b in data:
        groups.setdefault(b, []).append((i is None, i or 0, u is not None, u or ""))
    out, begun = [], set()
    for i, u, b in data:
        first = min(groups[b])
        key = (i is None, i or 0, u is not None, u or "")
        if len(b) < 100 or key == first and b not in begun:
            begun.add(b)
            out.append((i, len(b), hashlib.sha256(b).hexdigest(), "response", None))
        else:
            out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit", None if first[0] else first[1]))
    return sorted(out, key=repr)


def listed(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def table(n=400, seed=4):
    rng = random.Random(seed)
    pages = [f"<p>{i} {'wörd ' * rng.randint(1, 200)}</p>" for i in range(40)]
    urls = ["http://one.example.com/a?b=1", "https://User@One.example.com:8080/a#x", "//b.example.org", "no url at all", "http://hot.example/"]
    rows = [(i, rng.choice(urls) if i % 3 else "http://hot.example/page", rng.choice(pages) if i % 4 else f"only {i} " * 40) for i in range(n)]
    rng.shuffle(rows)
    return rows


ODD = [
    (1, None, None), (2, "", ""), (3, "http://a.example/ b\tc\nd\r\x00", "x" * 99), (4, "http://a.example/", "x" * 99),
    (5, "http://a.example/", "y" * 100), (5, "http://a.example/", "y" * 100), (5, "http://a.example/", "y" * 100), (6, None, "y" * 100),
    (None, "http://b.example/", "z" * 300), (None, "http://b.example/", "z" * 300), (None, None, None),
    (8, "http://ü.example/é", "\U0001f600" * 30), (9, "http://" + "long." * 5000 + "/", "w" * 500_000), (-7, "http://a.example/", "z" * 300), (-(1 << 63), "x", "<p>"),
]


@pytest.mark.parametrize("rows", [table(), ODD, []], ids=len)
def test_pages_come_back(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert listed(warc.archived_pages(docs)) == plain(rows)


def test_other_columns(spark):
    wide = [("u", i, u, h, "r", "f") for i, u, h in ODD]
    docs = spark.createDataFrame(wide, "URL string, page_id long, url string, html string, record_type string, file string")
    assert listed(warc.archived_pages(docs)) == plain(ODD)


def test_payloads_and_urls_of_the_archives(spark, tmp_path):
    rows = table(120)
    found = warc.write_archives(warc.typed_records(spark.createDataFrame(rows, SCHEMA)), str(tmp_path))
    got = warc.read_records(found).collect()
    stored = {r.page_id: bytes(r.payload).decode() for r in got if r.record_type == "response"}
    html = {i: h for i, _, h in rows}
    for r in got:
        assert stored[r.page_id if r.record_type == "response" else r.refers_to] == html[r.page_id]
    assert {(r.page_id, r.url) for r in got} == {(i, u.replace(" ", "%20")) for i, u, _ in rows}


def test_archives_are_plain_gzip_of_whole_records(spark, tmp_path):
    warc.archive(spark.createDataFrame(ODD, SCHEMA).coalesce(1), str(tmp_path))
    files = list((tmp_path / "archives").iterdir())
    assert len(files) == 1
    stream, kinds = io.BytesIO(gzip.decompress(files[0].read_bytes())), []
    while line := stream.readline():
        assert line == b"WARC/1.1\r\n"
        headers = {}
        while (line := stream.readline()) != b"\r\n":
            name, value = line.decode().rstrip("\r\n").split(": ", 1)
            headers[name] = value
        block = stream.read(int(headers["Content-Length"]))
        assert stream.read(4) == b"\r\n\r\n"
        kinds.append(headers["WARC-Type"])
        assert block.startswith(b"HTTP/1.1 200 OK\r\n") or headers["WARC-Type"] == "warcinfo"
        assert ("WARC-Refers-To" in headers) == (headers["WARC-Type"] == "revisit")
    assert kinds.count("warcinfo") == 1 and kinds.count("revisit") == 5 and len(kinds) == len(ODD) + 1


def test_index_reads_few_blocks(spark, tmp_path, monkeypatch):
    """A look-up opens one directory and the blocks that may hold its key, and no more."""
    rows = [(i, f"http://h{i % 50}.example/{i % 977}", "x") for i in range(6000)]
    index = warc.archive(spark.createDataFrame(rows, SCHEMA).repartition(4), str(tmp_path))
    assert 4 <= len(index.parts) <= 8 and list(index.parts) == sorted(index.parts, key=lambda p: p.first)
    for i in (0, 17, 5999):
        key = warc.capture_key(rows[i][1], i)
        reader = warc.PartReader(index.parts)
        hits = [h for k, p in enumerate(index.parts) if p.first <= key <= p.last for h in reader.find(k, key)]
        assert len(hits) == 1 and reader.reads <= 2
        assert warc.parse_record(warc.Input().read(*hits[0][1:]))["page_id"] == i
    assert list(warc.PartReader(index.parts).find(0, "zzz) ")) == []
    asked = spark.createDataFrame([("http://h1.example/1", 1), ("http://h1.example/1", 1), ("http://none.example/", 2), (None, None)], "url string, page_id long")
    assert warc.look_up(asked, index).count() == 1


def test_capture_over_several_parts(spark, tmp_path):
    """Two thirds of the captures have one key; it fills several parts, which all answer."""
    rows = [(7, "http://same.example/", f"{i}") for i in range(4000)] + [(i, f"http://x.example/{i}", "y") for i in range(2000)]
    index = warc.archive(spark.createDataFrame(rows, SCHEMA).repartition(4), str(tmp_path))
    key = warc.capture_key("http://same.example/", 7)
    assert sum(p.first <= key <= p.last for p in index.parts) > 2
    found = warc.look_up(spark.createDataFrame([(7, "http://same.example/")], "page_id long, url string"), index)
    assert found.count() == found.distinct().count() == 4000 and found.rdd.getNumPartitions() > 1


def test_keys():
    assert warc.capture_key("http://u@WWW.Example.com:80/a?b#c", 0) == "com,example,www)/a?b 09223372036854775808"
    assert warc.capture_key("a b", None) == ")a%20b "
    assert warc.capture_key("http://b.com", -1) < warc.capture_key("http://b.com", 1) < warc.capture_key("http://b.com/a", 0)


def test_damaged_record_raises():
    row = {"page_id": 1, "url": "u", "html": "<p>", "payload_bytes": 3, "payload_digest": "00", "record_type": "response", "refers_to": None}
    with pytest.raises(ValueError, match="does not match"):
        warc.parse_record(warc.page_record(row, "<urn:x>"))
    with pytest.raises(zlib.error):
        warc.parse_record(warc.page_record(row, "<urn:x>")[:-12])
