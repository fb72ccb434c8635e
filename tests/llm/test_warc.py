import gzip
import hashlib

from fieldgrid.llm import warc
from fieldgrid.llm.queries import op9_warc

SF = "/root/testdata/sf0.01"


def expected(rows):
    groups = {}
    for k, html in rows:
        data = (html or "").encode()
        if len(data) >= 1000:
            groups.setdefault(data, []).append(k)
    for k, html in rows:
        data = (html or "").encode()
        last = max((x for x in groups.get(data, []) if x is not None), default=None)
        refers = last if last is not None and last != k else None
        yield k, len(data), hashlib.sha1(data).hexdigest(), "response" if refers is None else "revisit", refers


def test_whole_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = sorted(tuple(r) for r in op9_warc(spark, SF).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    assert got == sorted(expected([(p.page_id, p.html) for p in pages]))


def test_odd_rows(spark, tmp_path):
    long = "é" * 600
    rows = [(1, None), (2, ""), (3, long), (4, long), (4, long), (None, long), (5, "x" * 999), (6, "x" * 999), (7, "a\r\n\r\nWARC/1.1\r\n" * 100), (8, "y" * 3_000_000), (1234567890123456789, long), (-(1 << 63), "z" * 1000), ((1 << 63) - 1, "z" * 1000)]
    df = spark.createDataFrame([(k, f"http://h/{k}", h, "z") for k, h in rows], "page_id long, url string, html string, d string")
    folder = warc.archives(df, f"file://{tmp_path}/a")
    got = warc.read_archives(spark, folder).where("record_type IN ('response', 'revisit')").collect()
    key = lambda t: tuple(map(str, t))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(expected(rows), key=key)
    assert all(hashlib.sha1(r.payload).hexdigest() == r.payload_digest for r in got if r.record_type == "response")
    assert warc.read_archives(spark, warc.archives(df.limit(0), f"file://{tmp_path}/b")).count() == 0


def test_salvage_of_damaged_members():
    parts = [warc.page_record(i, f"http://h/{i}", f"page {i} ".encode() * 50, None) for i in range(6)]
    broken = bytearray(parts[2])
    broken[len(broken) // 2] ^= 0xFF
    data = b"junk" + parts[0] + parts[1] + bytes(broken) + parts[3] + b"\x1f\x8b\x08garbage" + parts[4] + parts[5][:-20]
    rows = [*warc.salvage(data)]
    assert [r[2]["x-page-id"] for r in rows if r[2]] == ["0", "1", "3", "4"]
    gaps = [(r[0], r[1]) for r in rows if r[2] is None]
    a = 4 + len(parts[0]) + len(parts[1])
    assert gaps[0] == (0, 4) and gaps[1] == (a, a + len(broken)) and gaps[-1][1] == len(data) and len(gaps) == 4
    assert sum(r[1] - r[0] for r in rows) == len(data)


def test_salvage_of_plain_archives(spark, tmp_path):
    plain = [gzip.decompress(warc.page_record(i, None, b"WARC/1.1\r\nnot a record" * 3, None)) for i in range(3)]
    data = plain[0] + plain[1][:-30] + plain[2]
    rows = [*warc.salvage(data)]
    assert [r[2]["x-page-id"] for r in rows if r[2]] == ["0", "2"] and any(r[2] is None for r in rows)
    (tmp_path / "x.warc").write_bytes(data)
    got = warc.read_archives(spark, f"file://{tmp_path}").collect()
    assert sorted(r.kind for r in got) == sorted("record" if r[2] else "gap" for r in rows)
    assert [*warc.salvage(b"")] == []


def test_salvage_of_members_of_many_records(spark, tmp_path):
    plain = [gzip.decompress(warc.page_record(i, f"http://h/{i}", bytes(f"page {i} {'x' * 50}", "utf-8"), None)) for i in range(5)]
    bad = plain[0].replace(b"page 0", b"page 9")
    content = bad + plain[1] + plain[2] + b"junk" + plain[3]
    first, second = gzip.compress(content), gzip.compress(plain[4])
    rows = [*warc.salvage(first + second)]
    assert [r[2] and r[2]["x-page-id"] for r in rows] == [None, "1", "2", None, "3", "4"]
    assert [r[:2] for r in rows] == [(0, len(first))] * 5 + [(len(first), len(first) + len(second))]
    assert [r[5:] for r in rows[:1]] == [(0, len(bad))] and rows[-1][5:] == (None, None)
    assert sum(r[6] - r[5] for r in rows[:5]) == len(content) and all(x[6] == y[5] for x, y in zip(rows[:4], rows[1:5], strict=True))
    (tmp_path / "x.warc.gz").write_bytes(first + second)
    got = warc.read_archives(spark, f"file://{tmp_path}").collect()
    assert sorted(r.page_id for r in got if r.kind == "record") == [1, 2, 3, 4] and sum(r.kind == "gap" for r in got) == 2


def test_salvage_of_a_damaged_member_of_many_records():
    plain = b"".join(gzip.decompress(warc.page_record(i, None, hashlib.sha512(bytes([i])).hexdigest().encode() * 40, None)) for i in range(40))
    whole, last = gzip.compress(plain), warc.page_record(99, None, b"last", None)
    cut = whole[: len(whole) // 2]
    rows = [*warc.salvage(cut + last)]
    ids = [r[2]["x-page-id"] for r in rows if r[2]]
    assert ids[:3] == ["0", "1", "2"] and ids[-1] == "99" and len(ids) > 10
    assert sum(r[1] - r[0] for r in rows) == len(cut + last)
