import base64
import hashlib
from pathlib import Path

from paceline.llm import warc

from .helpers import same_as_sql

SCHEMA = "page_id long, url string, html string, file string, offset string, key string, first string"
FALSE_RECORD = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
PAGES = [
    (1, "http://www.Example.com:80/a?b=1#c", "<p>é</p>"), (2, "https://example.com/a?b=1", "<p>é</p>"), (3, None, None),
    (4, "http://x.org/a b\r\nX: y", ""), (5, "not a url", FALSE_RECORD * 3), (6, "http://[bad", "\r\n\r\n"), (7, "ftp://h:2121/ü", "x" * 200_000),
    (None, "http://x.org/", "<p>é</p>"), (8, "http://x.org/100%25", FALSE_RECORD * 3), (9, "http://10.0.0.1/", "\n"),
]


def written(spark, tmp_path, pages, block=warc.BLOCK):
    df = spark.createDataFrame([(*p, "x", "x", "x", "x") for p in pages], SCHEMA).repartition(3)
    warc.write_archives(df, f"{tmp_path}/w")
    warc.write_index(warc.read_archives(spark, f"{tmp_path}/w"), f"{tmp_path}/w", block)
    return f"{tmp_path}/w"


def found(spark, path, pages):
    return warc.indexed_records(spark, path, spark.createDataFrame([(*p, "x", "x", "x", "x") for p in pages], SCHEMA)).collect()


def test_sql(spark, sf_dir):
    same_as_sql(spark, sf_dir, "op8_warc")


def test_edges(spark, tmp_path):
    path = written(spark, tmp_path, PAGES)
    got = {r["page_id"]: r for r in found(spark, path, PAGES)}
    first = {}
    for i, _, html in sorted((p for p in PAGES if p[0] is not None), key=lambda p: p[0]):
        first.setdefault(html or "", i)
    assert len(got) == len(PAGES)
    for i, _, html in PAGES:
        body = (html or "").encode()
        want = base64.b32encode(hashlib.sha1(body).digest()).decode()
        refers = None if i is None or first[html or ""] == i else first[html or ""]
        assert (got[i]["payload_bytes"], got[i]["payload_digest"], got[i]["refers_to"]) == (len(body), want, refers)
        assert got[i]["record_type"] == ("revisit" if refers is not None else "response")
    payloads = {r["page_id"]: r["payload"] for r in warc.read_archives(spark, path, payloads=True).collect()}
    assert payloads[5] == (FALSE_RECORD * 3).encode() and payloads[8] is None


def test_lookup_reads_ranges(spark, tmp_path):
    path = written(spark, tmp_path, [*PAGES, *((100 + i, f"http://site{i % 50}.net/{i}", f"page {i}") for i in range(7000))])
    urls = ["http://example.com/a?b=1", "http://site7.net/57", "http://nowhere.net/"]
    captures = warc.lookup(spark, path, urls)
    assert sorted(r[3] for r in warc.read_captures(spark, path, captures)) == [1, 2, 157]
    assert warc.read_captures(spark, path, []) == []
    assert spark.read.parquet(f"{path}/directory").count() > 1
    # Other bytes of the archive are never looked at.
    file, offset, length = captures[0][1:]
    archive = Path(path, "archives", file)
    archive.write_bytes(bytes(offset) + archive.read_bytes()[offset : offset + length])
    (Path(path, "archives") / f".{file}.crc").unlink(missing_ok=True)
    assert len(warc.read_captures(spark, path, captures[:1])) == 1


def test_one_url_over_many_blocks(spark, tmp_path):
    pages = [*((i, "http://hot.org/", f"{i}") for i in range(900)), *((1000 + i, f"http://a{i}.org/", f"{i}") for i in range(120))]
    path = written(spark, tmp_path, pages, 50)
    assert sorted(r["page_id"] for r in found(spark, path, pages)) == [p[0] for p in pages]
    assert len(warc.lookup(spark, path, ["http://hot.org/", "http://b.org/"])) == 900


def test_keys():
    assert warc.surt("https://www.Sub.Example.com/P?q=1#f") == "com,example,sub)/P?q=1"
    assert warc.surt("http://10.0.0.1:8080/x") == "10,0,0,1:8080)/x"


def test_empty(spark, tmp_path):
    path = written(spark, tmp_path, [])
    assert warc.read_archives(spark, path).count() == 0


def test_pages_that_repeat_an_id(spark, tmp_path):
    """Each row is one record, and no payload is lost."""
    pages = [(i, f"http://x.org/{i}", body) for i, body in ((3, "A"), (4, "B"), (5, "A"), (5, "B"), (6, "C"), (6, "A"), (6, "A"))]
    path = written(spark, tmp_path, pages)
    got = sorted((r["page_id"], r["record_type"], r["refers_to"] or 0, r["payload_digest"]) for r in found(spark, path, pages))
    sha = {b: base64.b32encode(hashlib.sha1(b.encode()).digest()).decode() for b in "ABC"}
    want = [(3, "response", 0, sha["A"]), (4, "response", 0, sha["B"]), (5, "revisit", 3, sha["A"]), (5, "revisit", 4, sha["B"])]
    assert got == sorted([*want, (6, "response", 0, sha["C"]), (6, "revisit", 3, sha["A"]), (6, "revisit", 3, sha["A"])])
    assert sorted(r["payload"] or b"" for r in warc.read_archives(spark, path, payloads=True).collect()) == [b""] * 4 + [b"A", b"B", b"C"]
