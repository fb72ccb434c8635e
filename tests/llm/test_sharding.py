import hashlib
import zlib
from collections import defaultdict

from fieldgrid.llm import sharding
from fieldgrid.llm.queries import op13_sharding

SF = "/root/testdata/sf0.01"


def jump(state, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        state = (state * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * ((1 << 31) / ((state >> 33) + 1)))
    return b


def shard(key, shards):
    return jump(int(hashlib.md5(("" if key is None else str(key)).encode()).hexdigest()[:16], 16), shards)


def test_published_values():
    """The plain form above gives what is published for the algorithm, so the columns may be held against it."""
    assert [jump(k, n) for k, n in [(1, 1), (42, 57), (0xDEAD10CC, 666), (256, 1024)]] == [0, 43, 361, 520]


def check_slots(rows):
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append((r.slot, r.doc_id))
    for found in slots.values():
        found.sort()
        assert [s for s, _ in found] == list(range(len(found)))
        keys = [(k is not None, k or 0) for _, k in found]
        assert keys == sorted(keys)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = op13_sharding(spark, SF).collect()
    size = lambda t: len((t or "").encode()) + 1
    want = [(d.doc_id, size(d.text), zlib.crc32((d.text or "").encode()), "key", shard(d.doc_id, 16), shard(d.doc_id, 17)) for d in docs]
    assert sorted((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in rows) == sorted(want)
    check_slots(rows)
    moved = [r for r in rows if r.grown_shard != r.shard]
    assert all(r.grown_shard == 16 for r in moved) and 0.03 < len(moved) / len(rows) < 0.09
    assert {r.shard for r in rows} == set(range(16))


def test_jump_at_many_sizes(spark):
    for n in (1, 2, 3, 17, 100, 1000):
        assert all(r.s == shard(r.id, n) for r in spark.range(-50, 50).withColumn("s", sharding.jump(sharding.F.col("id"), n)).collect()), n


def test_odd_rows(spark):
    long = "é " * 500_000
    rows = [(None, "null key", "r", 1, "x")] * 700 + [(5, "same", None, 2, "y")] * 900 + [(7, None, "r", None, "z"), (8, "", "r", 3, "z"), (9, long, "r", 4, "z"), (-1, "\x00", "r", 5, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, shard int, block string").repartition(5)
    got = sharding.sharded(df, 16).collect()
    size = lambda t: len((t or "").encode()) + 1
    want = [(str(k), size(t), zlib.crc32((t or "").encode()), shard(k, 16), shard(k, 17)) for k, t, *_ in rows]
    assert sorted((str(r.doc_id), r.size, r.text_crc32, r.shard, r.grown_shard) for r in got) == sorted(want)
    check_slots(got)
    assert sharding.sharded(df.limit(0), 16).count() == 0


def test_files_grow_by_what_moves(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    folder = f"file://{tmp_path}/shards"
    sharding.write(docs, folder, 6)
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    for _ in range(2):  # a repeated call changes nothing
        sharding.append(spark, folder, docs.schema, 6, 8)
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())
    assert {int(p.parent.name[6:]) for p in tmp_path.rglob("*.parquet") if p not in before} == {6, 7}
    rows = sharding.read(spark, folder, docs.schema, 8)
    assert sorted(map(str, rows.select("row.*").collect())) == sorted(map(str, docs.collect()))
    placed = sharding.slots(rows.select("shard", "block", "at", "row.doc_id"), "doc_id").collect()
    assert all(r.shard == shard(r.doc_id, 8) for r in placed)
    check_slots(placed)
    moved = sum(r.shard >= 6 for r in placed) / len(placed)
    assert 0.2 < moved < 0.3
