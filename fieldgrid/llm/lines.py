"""Line dedup by a segment-partition edit join, in DataFrame functions alone.

Lines are the pieces of a text between line feeds. Of equal lines the first occurrence stays: the one with the smallest
(key, line number). A line of MIN_CHARS or more also goes if an earlier first occurrence is within one edit.

Near lines are found in three steps, each an equi join or a grouping, and texts don't move until few lines are left:

1. Halves. One edit leaves one of threshold + 1 = 2 segments as it is. Hashes of (length, prefix half) and (length,
   suffix half) are an index; each line also probes it as the longer line of a pair. Lines that meet no other stop here.
2. Pieces. For each of PIECES pieces of a line (of PIECE characters each, in longer lines), a hash of all the rest is the key and the
   piece itself the value. Lines with a common key differ in that piece alone, so their edit distance is that of the
   pieces, and a banded bit-parallel automaton verifies it. Hashes of the rest are put together from chains of hashes, so a
   long line costs time and rows in proportion to its length.
3. Keys that many lines share aren't paired: each line gives its piece with every single character taken out. Lines
   of one length that agree there are one edit apart, so the first of them decides for all. This is a grouping, not a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import written

#: Characters from which near lines count, pieces of a line and their most characters, and lines of a key from which pairs give way to groups.
MIN_CHARS, PIECES, PIECE, CROWD = 20, 24, 64, 12
#: Pieces of a long line whose hashes are chained at a time.
BLOCK = 256
#: Candidates up to which their keys are broadcast (24 bytes each).
BROADCAST_ROWS = 500_000


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (k, r, p, line): a line each, numbered from 0, with the document's key and the hash of its text; null texts have none."""
    whole = F.col(f"`{text}`").cast("string")
    return docs.select(F.col(f"`{key}`").alias("k"), F.xxhash64(whole).alias("r"), F.posexplode(F.split(whole, "\n")).alias("p", "line"))


def _hashed(lines: DataFrame) -> DataFrame:
    """With a 96-bit identity (h, g) of the line; blank lines are left out."""
    return lines.where(F.trim(F.translate("line", "\t\r", "  ")) != "").withColumns({"h": F.xxhash64("line"), "g": F.hash("line")})


def _half_keys(line: Column, n: Column) -> Column:
    """Index keys of the halves, and probe keys as the longer of two lines."""

    def keys(n: Column) -> list[Column]:
        half = F.floor(n / 2).cast("int")
        return [F.xxhash64(n, F.lit(0), F.left(line, half)), F.xxhash64(n, F.lit(1), F.right(line, n - half))]

    return F.array(*keys(n), *keys(n - 1))


def _let(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.transform(F.array(value), then)[0]


def banded_distance(a: Column, b: Column, band: int = 1) -> Column:
    """Edit distance of two arrays of characters: exact where it is at most `band`, larger than `band` otherwise.

    Bit-parallel: vp and vn hold, as bits, where a column of the distance matrix grows or falls within the band of diagonals, which
    moves down a row with each character of b. The distance is followed down the lowest diagonal, then along the last row.
    """
    width = 2 * band + 1
    full = (1 << width) - 1
    mark = F.array_repeat(F.lit(""), band + 1)  # equal beginnings, so that a is longer than the band
    a, b = F.concat(mark, a), F.concat(mark, b)
    n = F.size(a)
    flag = lambda c: F.when(c, 1).otherwise(0)

    def step(s: Column, j: Column) -> Column:
        own = F.element_at(b, j)
        equal = F.lit(0)
        for t in range(width):
            equal = equal + F.coalesce(F.when(F.get(a, j - 1 - band + t) == own, 1 << t), F.lit(0))

        def column(x: Column) -> Column:
            d = (x.bitwiseAND(s.vp) + s.vp).bitwiseXOR(s.vp).bitwiseOR(x).bitwiseOR(s.vn).bitwiseAND(full)
            return _let(d, lambda d: _let(s.vn.bitwiseOR(F.lit(full).bitwiseXOR(d.bitwiseOR(s.vp))), lambda hp: done(d, hp, d.bitwiseAND(s.vp))))

        def done(d: Column, hp: Column, hn: Column) -> Column:
            down = F.shiftright(d, 1)
            row = F.pow(F.lit(2), F.lit(width - 2) - (j - 1 - (n - band))).cast("int")  # the last row's place in the band
            along = flag(hp.bitwiseAND(row) != 0) - flag(hn.bitwiseAND(row) != 0)
            return F.struct(
                hn.bitwiseOR(F.lit(full).bitwiseXOR(down.bitwiseOR(hp))).alias("vp"),
                down.bitwiseAND(hp).alias("vn"),
                (s.dist + F.when(j <= n - band, flag(d.bitwiseAND(1 << (width - 1)) == 0)).otherwise(along)).alias("dist"),
            )

        return _let(equal, column)

    start = F.struct(F.lit(full & (full << (width - band - 1))).alias("vp"), F.lit(0).alias("vn"), F.lit(band).alias("dist"))
    last = F.aggregate(F.sequence(F.lit(1), F.size(b)), start, step, lambda s: s.dist)
    return F.when(F.abs(n - F.size(b)) > band, band + 1).otherwise(last)


def line_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The written table of all lines that aren't blank: identity (h, g), place (k, p, r), characters n, half keys; no texts."""
    n = F.char_length("line")
    lines = _hashed(lines_of(docs, key, text)).select("h", "g", F.struct("k", "p", "r").alias("own"), n.alias("n"), _half_keys(F.col("line"), n).alias("keys"))
    return written(lines.select("h", "g", "own", "n", *[F.col("keys")[i].alias(f"k{i}") for i in range(4)]), "lines")


def first_occurrences(lines: DataFrame) -> DataFrame:
    """The written table of different lines, f being their first place."""
    # Equal lines meet as partial minima of every task, so a line that many documents share moves once a task.
    return written(lines.groupBy("h", "g").agg(F.min("own").alias("f"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("n", "k0", "k1", "k2", "k3")]), "first")


def _meeting(rows: DataFrame) -> DataFrame:
    """The rows (key, role: 0 index, 1 probe, ...) whose key has an index row and another row, with c, the rows of the key."""
    counts = rows.groupBy("key").agg(F.count_if(F.col("role") == 0).alias("i"), F.count("*").alias("c")).where("i >= 1 AND c >= 2")
    return rows.join(counts.select("key", "c"), "key")


def _candidates(distinct: DataFrame) -> DataFrame:
    """(h, g, f) of lines that share a half with another line of their length or one less or more."""
    long = distinct.where(F.col("n") >= MIN_CHARS)
    index = long.select(F.explode(F.array("k0", "k1")).alias("key"), F.lit(0).alias("role"), "h", "g", "f")
    probe = long.where(F.col("n") > MIN_CHARS).select(F.explode(F.array("k2", "k3")).alias("key"), F.lit(1).alias("role"), "h", "g", "f")
    return written(_meeting(index.union(probe)).select("h", "g", "f").distinct(), "candidates")


def _with_text(docs: DataFrame, candidates: DataFrame, key: str, text: str) -> DataFrame:
    """(h, g, f, line) of the candidates, whose lines are cut from their documents again."""
    want = candidates.select("h", "g", "f", F.col("f.k").alias("fk"), F.col("f.r").alias("fr"), F.col("f.p").alias("fp"))
    small = F.broadcast if candidates.count() <= BROADCAST_ROWS else (lambda df: df)
    own = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("t")).withColumn("tr", F.xxhash64("t"))
    some = own.join(small(want.select("fk", "fr").distinct()), F.expr("k <=> fk AND tr = fr"), "left_semi")
    lines = _hashed(lines_of(some, "k", "t"))
    found = lines.join(small(want.select("fk", "fr", "fp", "f")), F.expr("k <=> fk AND r = fr AND p = fp")).select("h", "g", "f", "line")
    return found.dropDuplicates(["h", "g"])


def _pieces(lines: DataFrame) -> DataFrame:
    """(key, role, h, g, f, piece): for each piece of a line, the hash of all the rest, as a line of its own length (role 0) and as the longer one of a pair (role 1)."""
    n = F.char_length("line")

    def short(size: Column, role: int) -> Column:
        n = size + role

        def one(i: Column) -> Column:
            start, rest = F.floor(i * size / PIECES).cast("int"), (size - F.floor((i + 1) * size / PIECES)).cast("int")
            piece = F.substring("line", start + 1, n - rest - start)
            return F.struct(F.xxhash64(size, i, F.left(F.col("line"), start), F.right(F.col("line"), rest)).alias("key"), F.lit(role).alias("role"), piece.alias("piece"))

        return F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), one)

    def chain(parts: Column) -> Column:
        """Hashes of the first 0, 1, 2, ... parts, in blocks: an array grows by copies, so only short ones do."""
        zero = F.lit(0).cast("long")

        def block(s: Column, b: Column) -> Column:
            grown = F.aggregate(F.slice(parts, b * BLOCK + 1, BLOCK), F.array(s.last), lambda a, x: F.concat(a, F.array(F.xxhash64(F.element_at(a, -1), x))))
            return _let(grown, lambda a: F.struct(F.element_at(a, -1).alias("last"), F.concat(s.out, F.array(F.slice(a, 2, BLOCK))).alias("out")))

        blocks = F.sequence(F.lit(0), F.ceil(F.size(parts) / BLOCK).cast("int") - 1)
        return F.flatten(F.aggregate(blocks, F.struct(zero.alias("last"), F.array(F.array(zero)).alias("out")), block).out)

    def long(size: Column, role: int) -> Column:
        n = size + role
        count = F.ceil(size / PIECE).cast("int")
        cut = lambda text: F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
        whole, later = cut(F.col("line")), cut(F.substring(F.col("line"), F.lit(1 + role), n))  # what follows a longer piece is one character on

        def one(parts: Column, before: Column, after: Column, i: Column) -> Column:
            piece = F.get(parts, i) if not role else F.concat(F.get(parts, i), F.coalesce(F.left(F.get(parts, i + 1), F.lit(1)), F.lit("")))
            return F.struct(F.xxhash64(size, i, F.get(before, i), F.get(after, count - 1 - i)).alias("key"), F.lit(role).alias("role"), piece.alias("piece"))

        every = lambda parts, before, after: F.transform(F.sequence(F.lit(0), count - 1), lambda i: one(parts, before, after, i))
        return _let(whole, lambda parts: _let(chain(parts), lambda before: _let(chain(F.reverse(later)), lambda after: every(parts, before, after))))

    def rows(role: int) -> Column:  # characters are counted once
        return _let(n - role, lambda size: F.when(size > PIECES * PIECE, long(size, role)).otherwise(short(size, role)))

    both = F.when(n > MIN_CHARS, F.concat(rows(0), rows(1))).otherwise(rows(0))
    return lines.select("h", "g", "f", F.explode(both).alias("x")).select("x.key", "x.role", "h", "g", "f", "x.piece")


def _pairs(rows: DataFrame) -> DataFrame:
    """(h, g) of the later line of each verified pair, for keys of few rows."""
    a = rows.where("role = 0").select("key", *[F.col(c).alias(f"a_{c}") for c in ("h", "g", "f", "piece")])
    pairs = a.join(rows, "key").where("NOT (a_h = h AND a_g = g) AND (role = 1 OR a_f < f)")
    near = pairs.where(banded_distance(F.split("a_piece", ""), F.split("piece", "")) <= 1)
    return near.select(F.when(F.expr("a_f < f"), F.struct("h", "g")).otherwise(F.struct(F.col("a_h").alias("h"), F.col("a_g").alias("g"))).alias("x")).select("x.h", "x.g")


def _crowds(rows: DataFrame) -> DataFrame:
    """(h, g) of lines that have an earlier near line, for keys of many rows: by groups of pieces without one character."""
    without = F.transform(F.sequence(F.lit(1), F.char_length("piece")), lambda j: F.struct(j.alias("j"), F.concat(F.left(F.col("piece"), j - 1), F.substr(F.col("piece"), j + 1)).alias("w")))
    cut = rows.where("piece <> ''").select("key", "role", "h", "g", "f", F.explode(without).alias("x")).select("key", "role", "h", "g", "f", "x.j", "x.w")
    # One length, one character taken out at one place: all of a group are one substitution apart.
    same = cut.where("role = 0").select(F.xxhash64("key", "j", "w").alias("s"), "h", "g", "f")
    first = same.groupBy("s").agg(F.min("f").alias("least"), F.count("*").alias("c")).where("c > 1").drop("c")
    substituted = same.join(first, "s").where("f > least").select("h", "g")
    # The longer line without one character is the shorter one.
    short = rows.where("role = 0").select(F.xxhash64("key", "piece").alias("s"), "h", "g", "f")
    long = cut.where("role = 1").select(F.xxhash64("key", "w").alias("s"), "h", "g", "f").distinct()
    least = long.groupBy("s").agg(F.min("f").alias("least"))
    inserted = short.join(least, "s").where("f > least").select("h", "g").union(long.join(short.select("s", F.col("f").alias("least")), "s").where("f > least").select("h", "g"))
    return substituted.union(inserted)


def near_lines(docs: DataFrame, distinct: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(h, g) of the different lines that are within one edit of a line with an earlier first occurrence."""
    rows = written(_pieces(_with_text(docs, _candidates(distinct), key, text)), "pieces")
    met = written(_meeting(rows), "met")
    return _pairs(met.where(F.col("c") <= CROWD)).union(_crowds(met.where(F.col("c") > CROWD))).distinct()


def duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (k, r, p, near) of the lines that go: key of the document, hash of its text, line number from 0, and whether the line is near (true) or equal to an earlier one.

    Null and empty texts have no lines that go; blank lines stay. Rows of one key and text are one document: all of them lose the
    same lines. Null keys come first. Other columns don't take part.
    """
    lines = line_table(docs, key, text)
    distinct = first_occurrences(lines)
    near = near_lines(docs, distinct, key, text).withColumn("near", F.lit(True))
    decided = distinct.select("h", "g", "f", "copies").join(near, ["h", "g"], "left")
    # A line of more than a thousandth of all occurrences is one of at most a thousand: those are broadcast, so no task gets them all.
    many = max(1000, (distinct.agg(F.sum("copies")).first()[0] or 0) // 1000)
    frequent = F.broadcast(decided.where(F.col("copies") > many))
    all_lines = lines.select("h", "g", "own")
    rest = all_lines.join(F.broadcast(distinct.where(F.col("copies") > many).select("h", "g")), ["h", "g"], "left_anti").join(decided.where(F.col("copies") <= many), ["h", "g"])
    gone = all_lines.join(frequent, ["h", "g"]).unionByName(rest).where("own > f OR (own = f AND near)")
    return gone.select("own.k", "own.r", "own.p", (F.col("own") == F.col("f")).alias("near")).distinct()


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the duplicate lines taken out of their texts; every row stays, if need be with an empty text."""
    gone = duplicates(docs, key, text).groupBy("k", "r").agg(F.collect_set("p").alias("gone")).select(F.col("k").alias("gone_k"), F.col("r").alias("gone_r"), "gone")
    columns = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    ck, ct = f"c{docs.columns.index(key)}", f"c{docs.columns.index(text)}"
    own = docs.select(*columns).withColumn("own_r", F.xxhash64(ct))
    joined = own.join(gone, F.expr(f"{ck} <=> gone_k AND own_r = gone_r"), "left")
    # The places that stay are a difference of sets, so a text of very many lines takes time in proportion to them.
    kept = _let(F.split(ct, "\n"), lambda own: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(own) - 1), "gone"), lambda i: F.get(own, i)), "\n"))
    joined = joined.withColumn(ct, F.when(F.col("gone").isNull(), F.col(ct)).otherwise(kept))
    return joined.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
