import gzip
import hashlib
import random
import zlib

import pytest

from refinery.llm import warc
from refinery.llm.common import Scratch


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(2)
    big = ["<p>" + "x%d" % k * 600 + "é</p>" for k in range(4)]
    rows = [(i, f"http://h{i % 3}.example.com/p/{i}?a=b c", rng.choice(big)) for i in range(40)]
    rows += [(100 + i, f"https://www.site.org:8080/{i}#x", "small") for i in range(4)]
    rows += [(200, None, big[0]), (201, "not a url \r\nX: y", "WARC/1.1\r\n\r\n" * 200), (202, "http://[bad", None),
             (203, "", ""), (39, "http://h0.example.com/p/39", big[3]), (39, "http://h0.example.com/p/39", big[3]),
             (None, "http://h1.example.com/", big[1]), (None, "http://h1.example.com/", "alone" * 300)]
    return rows


def test_pages_hold_revisits(pages):
    assert sum("'revisit'" in x for x in expected(pages)) > 20


def expected(rows):
    best = {}
    for i, _, h in rows:
        h = h or ""
        if i is not None and len(h.encode()) >= 1000:
            best[h] = max(best.get(h, i), i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        o = best.get(h or "")
        other = o is not None and o != i
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if other else "response", o if other else None))
    return sorted(map(repr, out))


def test_round_trip(spark, pages):
    df = spark.createDataFrame([(*p, "k") for p in pages], "page_id long, url string, html string, digest string")
    got = warc.archive_pages(df).collect()
    assert sorted(repr((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got) \
        == expected(pages)
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_files_are_gzip_members_and_index_finds_all(spark, pages, monkeypatch):
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    scratch = Scratch(spark, "test")
    archives, index = scratch.folder("archives"), scratch.folder("index")
    entries = scratch.table(warc.write_archives(df, archives, scratch), "entries")
    upper = scratch.table(warc.write_index(entries, index), "upper")
    rows = entries.collect()
    path = archives.removeprefix("file://")
    for r in rows:
        with open(f"{path}/{r.file}", "rb") as f:
            f.seek(r.offset)
            record = zlib.decompress(f.read(r.length), 31)
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
        fields, _ = warc.parse_record(record)
        assert fields.get("Page-ID") == r.page_id and fields["WARC-Record-ID"] == f"<urn:uuid:{r.record}>"
    assert all(gzip.open(f"{path}/{name}").read().count(b"WARC-Record-ID") for name in {r.file for r in rows})
    keys = [(f"{r.key} {r.record}",) for r in rows] + [("com,example,h0)/none x",), ("zzz x",), ("! x",)]
    found = warc.look_up(spark.createDataFrame(keys, "sort_key string"), upper, index, archives).collect()
    assert sorted(r.sort_key for r in found) == sorted(k for k, in keys[:-3])


def test_blocks_of_an_index_file(tmp_path, spark, monkeypatch):
    n = 3500  # several blocks a file
    entries = spark.range(n).selectExpr("'f' AS file", "concat('com,x)/', lpad(id, 6, '0')) AS key", "'r' AS record",
                                        "id AS offset", "id + 1 AS length", "cast(id AS string) AS page_id").coalesce(1)
    folder = tmp_path.as_uri()
    upper = warc.write_index(entries, folder).collect()
    hits = 0
    for u in upper:
        f = warc.IndexFile(folder, u.file)
        for k in range(n):
            hit = f.find(f"com,x)/{k:06d} r")
            hits += hit == ["f", k, k + 1, str(k)]
        assert f.find("com,x)/ r") is None and f.find("zzz r") is None
    assert hits == n


def test_reversed_host_keys():
    assert warc.reversed_host_key("http://www.B.Example.com:80/p?q=1#f") == "com,example,b)/p?q=1"
    assert warc.reversed_host_key("https://a.org") == "org,a)/"
    assert warc.reversed_host_key(None) == warc.reversed_host_key("") == "-"
