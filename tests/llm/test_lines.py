import random
import time

from pyspark.sql import functions as F

from fieldgrid.llm import lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(docs, least=lines.MIN_CHARS):
    """(key, line number, near) of the lines that go."""
    occurrences = sorted((k, p, line) for k, t in docs if t is not None for p, line in enumerate(t.split("\n")) if line.strip(" \t\r"))
    first, gone = {}, []
    for k, p, line in occurrences:
        if line in first and first[line] != (k, p):
            gone.append((k, p, False))
        first.setdefault(line, (k, p))
    for line, (k, p) in first.items():
        if any(first[o] < (k, p) and len(o) >= least and len(line) >= least and abs(len(o) - len(line)) <= 1 and distance(o, line) <= 1 for o in first if o != line):
            gone.append((k, p, True))
    return sorted(gone)


def edit(rng, line):
    at = rng.randrange(len(line))
    return rng.choice([line[:at] + line[at + 1 :], line[:at] + rng.choice("xyzéq") + line[at:], line[:at] + rng.choice("xyzéq") + line[at + 1 :]])


def test_banded_distance(spark):
    rng = random.Random(3)
    for band in (1, 2, 3):
        rows = []
        for _ in range(400):
            a = "".join(rng.choice("abé") for _ in range(rng.randrange(0, 9)))
            b = a
            for _ in range(rng.randrange(0, 4)):
                b = edit(rng, b) if b else "x"
            rows.append((a, b))
        df = spark.createDataFrame(rows, "a string, b string")
        chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
        for r in df.select("a", "b", lines.banded_distance(chars("a"), chars("b"), band).alias("d")).collect():
            want = distance(r.a, r.b)
            assert (r.d == want) if want <= band else r.d > band, (r, want)


def test_equals_brute_force(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh  é") for _ in range(rng.randrange(15, 60))) for _ in range(60)]
    docs = []
    for k in range(150):
        some = [edit(rng, x) if rng.random() < 0.4 else edit(rng, edit(rng, x)) if rng.random() < 0.3 else x for x in rng.sample(base, 4)]
        docs.append((k, "\n".join([*some, "", "short", " "])))
    crowd = "the quick brown fox jumps over lazy dogs number "
    docs += [(1000 + i, f"{crowd}{rng.randrange(400):03d} of them") for i in range(120)] + [(2000 + i, f"{crowd}{rng.randrange(4000):04d} of them") for i in range(60)]
    docs += [(3000, None), (3001, ""), (3002, "\n\n")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r.k, r.p, r.near) for r in lines.duplicates(df).collect())
    want = brute(docs)
    assert got == want
    assert sum(w[2] for w in want) > 100
    kept = {r.doc_id: r.text for r in lines.dedup(df).collect()}
    gone = {(k, p) for k, p, _ in want}
    assert kept == {k: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (k, p) not in gone) for k, t in docs}


def test_shuffled_candidates(spark, monkeypatch):
    monkeypatch.setattr(lines, "BROADCAST_ROWS", 0)
    docs = [(i, f"a line that is long enough {i % 7}\nanother line, just like it {i % 3}.") for i in range(30)]
    got = sorted((r.k, r.p, r.near) for r in lines.duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == brute(docs)


def test_odd_rows(spark):
    line = "this line is long enough to count"
    df = spark.createDataFrame([(1, line, "a", 1), (1, line, "a", 1), (1, line + "\nother", "b", 2), (None, line + "!", "c", 3), (2, line, "d", 4)], "doc_id long, text string, k string, gone int")
    rows = sorted((str(r.doc_id), r.text, r.k, r.gone) for r in lines.dedup(df).collect())
    # The null key comes first, so its line is the first of the near ones.
    assert rows == [("1", "", "a", 1), ("1", "", "a", 1), ("1", "other", "b", 2), ("2", "", "d", 4), ("None", line + "!", "c", 3)]
    assert lines.dedup(df.limit(0)).count() == 0


def test_frequent_lines_are_decided_alike(spark):
    docs = [(i, "this line is shared by very many documents\n" + f"own line number {i} of this text, {'abcdefghij'[i % 10] * 20}") for i in range(2500)]
    got = sorted((r.k, r.p, r.near) for r in lines.duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got[:3] == [(1, 0, False), (2, 0, False), (3, 0, False)] and sum(p == 0 for _, p, _ in got) == 2499 and not any(n for _, p, n in got if p == 0)


def test_long_lines(spark):
    """Lines about and over PIECES x PIECE characters, against a plain comparison."""
    rng = random.Random(9)
    docs, k = [], 0
    for size in (1534, 1535, 1536, 1537, 1538, 1600, 1601, 2048, 2049, 5000):
        base = "".join(rng.choice("abcdefgh é🙂") for _ in range(size))
        for x in [base, *(edit(rng, base) for _ in range(6)), edit(rng, edit(rng, base)), base + "z", "z" + base, base[:-1], base[1:]]:
            docs.append((k, x))
            k += 1
    at = rng.randrange(3000)
    crowd = "".join(rng.choice("abcdefgh") for _ in range(4000))
    docs += [(k + i, crowd[:at] + c + crowd[at + 1 :]) for i, c in enumerate("ABCDEFGHIJKLMNOPQRSTUVW")]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")

    def near(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]

    first = {}
    for key, t in sorted(docs):
        first.setdefault(t, key)
    want = sorted((key, 0, first[t] == key) for key, t in docs if first[t] != key or any(f < key and near(o, t) for o, f in first.items() if o != t))
    assert sorted((r.k, r.p, r.near) for r in lines.duplicates(df).collect()) == want and len(want) > 60


def test_very_long_lines_that_differ_in_one_piece(spark):
    base = "".join(random.Random(2).choices("abcdefgh ", k=300_000))
    rows = [(i, base[:1000] + f"{i:06d}" + base[1006:]) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.k for r in lines.duplicates(df).collect()) == [i for i in range(20) if i % 10 or i == 10]


def test_very_many_lines_and_very_long_ones_take_seconds(spark):
    """A text of 200,000 short lines, half of them repeated, and lines of a million characters that differ in one."""
    log = [f"entry {i % 100_000}" for i in range(200_000)]
    rng = random.Random(5)
    long = "".join(rng.choices("abcdefgh ", k=1_000_000))
    docs = spark.createDataFrame([(1, "\n".join(log)), (2, long), (3, long[:600_000] + "z" + long[600_001:])], "doc_id long, text string")
    began = time.monotonic()
    got = {r.doc_id: r.text for r in lines.dedup(docs).collect()}
    assert time.monotonic() - began < 150
    assert got == {1: "\n".join(log[:100_000]), 2: long, 3: ""}
