"""The thin queries op1 to op13: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import audit, bpe, decontaminate, infill, katz, language, licenses, lines, neighbours, sharding, simhash, token_files, warc
from .common import documents

#: The vocabulary file of the token queries.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def remainder(key: str, divisor: int):
    """crc32 of the key as text, modulo the divisor; null keys have none."""
    return F.crc32(F.col(key).cast("string")) % divisor


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_tokens, and digests of the ids and of the text decoded from them."""
    coded = bpe.round_trip(documents(spark, sf_dir), TOKENIZER)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a Katz model of those that aren't held out."""
    found = katz.score(documents(spark, sf_dir), ~(remainder("doc_id", 5) == 1))
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document its lines, those that go as equal or near lines, and a digest of their numbers."""
    docs = documents(spark, sf_dir)
    gone = lines.duplicates(docs).groupBy("k", "r").agg(F.count_if(~F.col("near")).alias("n_equal"), F.count_if("near").alias("n_near"), F.array_join(F.array_sort(F.collect_set("p")).cast("array<string>"), ",").alias("gone"))
    own = docs.select("doc_id", F.xxhash64("text").alias("own"), F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return own.join(gone, F.expr("doc_id <=> k AND own = r"), "left").select("doc_id", "n_lines", zero("n_equal"), zero("n_near"), F.sha2(F.coalesce("gone", F.lit("")), 256).alias("gone_sha256"))


#: A line goes as near if it shares one half with an earlier line of its length or one more or less, and one edit makes them equal.
OP3_SQL = """
WITH split AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS p FROM documents),
counted AS (SELECT doc_id, count(*) AS n_lines FROM split GROUP BY doc_id),
occ AS (SELECT * FROM split WHERE trim(translate(line, chr(9) || chr(13), '  ')) <> ''),
ranked AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, p) AS n FROM occ),
first AS (SELECT line, doc_id, p, length(line) AS len FROM ranked WHERE n = 1 AND length(line) >= 20),
short AS (SELECT *, left(line, len // 2) AS a, right(line, len - len // 2) AS b, len AS size FROM first),
long AS (SELECT *, left(line, (len - 1) // 2) AS a, right(line, len - 1 - (len - 1) // 2) AS b, len - 1 AS size FROM first WHERE len > 20),
pairs AS (
  SELECT s.line AS x, t.line AS y, s.doc_id AS xd, s.p AS xp, t.doc_id AS yd, t.p AS yp FROM short s JOIN short t ON s.size = t.size AND s.a = t.a AND s.line <> t.line
  UNION SELECT s.line, t.line, s.doc_id, s.p, t.doc_id, t.p FROM short s JOIN short t ON s.size = t.size AND s.b = t.b AND s.line <> t.line
  UNION SELECT s.line, t.line, s.doc_id, s.p, t.doc_id, t.p FROM short s JOIN long t ON s.size = t.size AND s.a = t.a
  UNION SELECT s.line, t.line, s.doc_id, s.p, t.doc_id, t.p FROM short s JOIN long t ON s.size = t.size AND s.b = t.b),
verified AS (SELECT * FROM pairs WHERE CASE WHEN length(x) = length(y)
  THEN len(list_filter(range(1, length(x) + 1), lambda i: x[i] <> y[i])) <= 1
  ELSE len(list_filter(range(0, length(y)), lambda i: left(y, i) || substr(y, i + 2) = x)) > 0 END),
near AS (SELECT DISTINCT CASE WHEN (xd, xp) < (yd, yp) THEN y ELSE x END AS line FROM verified),
gone AS (
  SELECT r.doc_id, r.p, r.n = 1 AS near FROM ranked r LEFT JOIN near ON r.line = near.line WHERE r.n > 1 OR near.line IS NOT NULL),
sums AS (SELECT doc_id, count(*) FILTER (WHERE NOT near) AS n_equal, count(*) FILTER (WHERE near) AS n_near, string_agg(p::VARCHAR, ',' ORDER BY p) AS gone FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(c.n_lines, 0)::BIGINT AS n_lines, coalesce(s.n_equal, 0)::BIGINT AS n_equal, coalesce(s.n_near, 0)::BIGINT AS n_near, sha256(coalesce(s.gone, '')) AS gone_sha256
FROM documents d LEFT JOIN counted c ON d.doc_id = c.doc_id LEFT JOIN sums s ON d.doc_id = s.doc_id
"""


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words of each document stand in windows of the benchmark, by binary search in suffix arrays."""
    found = decontaminate.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the token files, read them back, and return each document's place, size and checksum."""
    folder = token_files.token_files(documents(spark, sf_dir), TOKENIZER, end_id=1)
    return token_files.read_token_digests(spark, folder)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages by compression with dictionaries that are cut from the texts not held out."""
    docs = documents(spark, sf_dir)
    model = language.fit(docs.where(remainder("doc_id", 4) != 2))
    found = language.predict(docs, model)
    return found.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


#: Where a document stands as a file: a directory for its source, for each 500 of its number, and for each 50; every 50th is a licence file.
PATH_SQL = "concat(source, '/', cast(floor(doc_id / 500) as int), '/', CASE WHEN doc_id % 500 = 0 THEN 'LICENSE' WHEN doc_id % 50 = 0 THEN concat(cast(floor(doc_id % 500 / 50) as int), '/LICENSE.txt') ELSE concat(cast(floor(doc_id % 500 / 50) as int), '/', doc_id, '.txt') END)"


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents as files, by header or licence file, or from the nearest ancestor directory."""
    return licenses.scan(documents(spark, sf_dir).withColumn("path", F.expr(PATH_SQL)))


def _op7_sql() -> str:
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    templates = ", ".join(f"({i}, {quoted(name)}, {quoted(text)})" for i, (name, text) in enumerate(licenses.TEMPLATES))
    common = ", ".join(map(quoted, licenses.COMMON))
    names = ", ".join(map(quoted, licenses.FILE_NAMES))
    words = lambda t: f"list_filter(regexp_split_to_array(lower({t}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')".replace("\\\\", "\\")
    n = len(licenses.TEMPLATES)
    return f"""
WITH tpl(template, license, text) AS (VALUES {templates}),
tt AS (SELECT template, license, token, count(*) AS tf FROM (SELECT template, license, unnest({words("text")}) AS token FROM tpl) WHERE token NOT IN ({common}) GROUP BY ALL),
idf AS (SELECT token, ln({n + 1}.0::DOUBLE / (1 + count(*))) + 1 AS idf FROM tt GROUP BY token),
tw AS (SELECT template, license, token, tf * idf AS w FROM tt JOIN idf USING (token)),
shares AS (SELECT template, license, token, w / sqrt(sum(w * w) OVER (PARTITION BY template)) AS share FROM tw),
files AS (SELECT doc_id, text, {PATH_SQL.replace("cast(floor(", "cast((").replace("doc_id / ", "doc_id // ").replace("% 500 / 50", "% 500 // 50")} AS path FROM documents),
split AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda line: {words("line")}) AS ls FROM files),
starts AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS p FROM split),
units AS (SELECT doc_id, p * {licenses.LINES + 1} + n AS p, flatten(ls[p : p + n - 1]) AS words FROM (SELECT doc_id, ls, p, unnest(range(1, 1 + least({licenses.LINES}, len(ls) - p + 1))) AS n FROM starts) WHERE n = 1 OR len(flatten(ls[p : p + n - 1])) <= {licenses.WORDS}),
picked AS (SELECT * FROM units WHERE list_has_any(words, (SELECT list(token) FROM idf))),
counts AS (SELECT doc_id, p, token, count(*) AS tf FROM (SELECT doc_id, p, unnest(words) AS token FROM picked) WHERE token NOT IN ({common}) GROUP BY ALL),
weighed AS (SELECT doc_id, p, token, tf * coalesce(idf, ln({n + 1}.0::DOUBLE) + 1) AS w FROM counts LEFT JOIN idf USING (token)),
sizes AS (SELECT doc_id, p, sqrt(sum(w * w)) AS size FROM weighed GROUP BY ALL),
dots AS (SELECT doc_id, p, template, license, sum(w * share) AS dot FROM weighed JOIN shares USING (token) GROUP BY ALL),
scored AS (SELECT doc_id, license, round(dot / size, 6) AS score FROM dots JOIN sizes USING (doc_id, p)),
best AS (SELECT doc_id, license, score FROM scored WHERE score >= {licenses.COSINE} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license) = 1),
marked AS (SELECT f.doc_id, f.path, b.license, b.score, regexp_extract(lower(f.path), '([^/.]*)[^/]*$', 1) IN ({names}) AS named, regexp_replace(f.path, '/?[^/]*$', '') AS dir FROM files f LEFT JOIN best b ON f.doc_id = b.doc_id),
licensed AS (SELECT dir AS base, license AS up, score AS up_score FROM marked WHERE named AND license IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, license) = 1),
nearest AS (SELECT dir, base, up, up_score FROM (SELECT DISTINCT dir FROM marked WHERE license IS NULL) JOIN licensed ON base = '' OR dir = base OR starts_with(dir, base || '/') QUALIFY row_number() OVER (PARTITION BY dir ORDER BY length(base) DESC) = 1)
SELECT m.doc_id, m.path, coalesce(m.license, n.up) AS license, coalesce(m.score, n.up_score) AS score,
  CASE WHEN m.license IS NOT NULL THEN CASE WHEN m.named THEN 'file' ELSE 'header' END WHEN n.up IS NOT NULL THEN 'inherited' END AS origin,
  CASE WHEN m.license IS NULL THEN n.base END AS directory
FROM marked m LEFT JOIN nearest n ON m.license IS NULL AND m.dir = n.dir
"""


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints, and the components of their links, by vantage-point trees."""
    found = simhash.groups(simhash.fingerprint(documents(spark, sf_dir)))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write WARC archives of the pages and read them back by the salvage reader."""
    folder = warc.archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    found = warc.read_archives(spark, folder, payloads=False).where("kind = 'record' AND record_type IN ('response', 'revisit')")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth vector, by a pruned graph of each shard."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return neighbours.search(neighbours.build_index(vectors), vectors.where("vec_id % 100 = 0"))


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove, alone and together, in each of their 120 orders, for each source."""
    return audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP11_SQL = """
WITH docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
cut AS (SELECT *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM docs),
firsts AS (SELECT text, min(doc_id) AS least FROM docs GROUP BY text),
known AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(c.doc_id > least, false)::INT AS mask
  FROM cut c JOIN firsts USING (text) LEFT JOIN known k ON c.doc_id = k.doc_id),
counts AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (
  SELECT filter_order, step, filter_order[step] AS letter, (1 << (ascii(filter_order[step]) - 65))::INT AS bit,
    list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65)))::INT AS earlier
  FROM (SELECT filter_order, unnest(range(1, 6))::INT AS step FROM orders)),
sums AS (
  SELECT part, filter_order, step, letter,
    sum(n) FILTER (WHERE mask & (coalesce(earlier, 0) | bit) = 0) AS kept,
    sum(n) FILTER (WHERE mask & coalesce(earlier, 0) = 0 AND mask & bit <> 0) AS removed,
    sum(n) FILTER (WHERE mask & coalesce(earlier, 0) <> 0 AND mask & bit <> 0) AS redundant,
    sum(n) FILTER (WHERE mask = bit) AS unique_fails,
    sum(good) FILTER (WHERE mask & coalesce(earlier, 0) = 0 AND mask & bit <> 0) AS good_lost,
    sum(toxic) FILTER (WHERE mask & coalesce(earlier, 0) = 0 AND mask & bit <> 0) AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  (sum(coalesce(removed, 0)) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM sums
"""


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-the-middle forms of all texts, and the texts rebuilt from them."""
    found = infill.restore(infill.transform(documents(spark, sf_dir)))
    digest = lambda c: F.sha2(c, 256).alias(f"{c}_sha256")
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


OP12_SQL = """
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS units, sha256('42:' || doc_id) AS digest FROM documents),
drawn AS (
  SELECT *, len(units) AS n, ('0x' || digest[1:8])::BIGINT AS h1, ('0x' || digest[9:16])::BIGINT AS h2, ('0x' || digest[17:24])::BIGINT AS h3, ('0x' || digest[25:32])::BIGINT AS h4 FROM cut),
formed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
pieces AS (
  SELECT *, coalesce(array_to_string(units[1:low], ''), '') AS p, coalesce(array_to_string(units[low + 1:high], ''), '') AS m, coalesce(array_to_string(units[high + 1:], ''), '') AS s FROM formed)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM pieces
"""


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written to 16 shards and read back; the shard follows from doc_id and the number of shards."""
    return sharding.sharded(documents(spark, sf_dir), 16).withColumn("law", F.lit("key"))


def _op13_sql() -> str:
    """The jumps as a recursion in 128-bit integers, and CRC-32 byte by byte with its table."""

    def entry(i: int) -> int:
        for _ in range(8):
            i = (i >> 1) ^ (0xEDB88320 if i & 1 else 0)
        return i

    table = f"[{', '.join(str(entry(i)) for i in range(256))}]::BIGINT[]"
    return f"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
sized AS (SELECT r, doc_id, text, octet_length(encode(text)) AS n, hex(encode(text)) AS h FROM docs),
coded AS (SELECT r, doc_id, text, n, list_transform(range(0, n), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT) AS b FROM sized),
summed AS (SELECT r, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, ({table})[xor(c & 255, x) + 1])), 4294967295) AS text_crc32 FROM coded),
jumps(r, n, state, b, j) AS (
  SELECT r, n, ('0x' || substr(md5(doc_id::VARCHAR), 1, 16))::UBIGINT::HUGEINT, -1::BIGINT, 0::BIGINT FROM docs, (VALUES (16), (17)) s(n)
  UNION ALL SELECT r, n, (state * {sharding.MULTIPLIER} + 1) % 18446744073709551616, j,
    trunc((j + 1) * (2147483648.0::DOUBLE / (((state * {sharding.MULTIPLIER} + 1) % 18446744073709551616) // 8589934592 + 1)::DOUBLE))::BIGINT FROM jumps WHERE j < n),
placed AS (SELECT r, max(b) FILTER (WHERE n = 16) AS shard, max(b) FILTER (WHERE n = 17) AS grown FROM jumps GROUP BY r)
SELECT doc_id, (n + 1)::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, grown::INTEGER AS grown_shard
FROM sized JOIN summed USING (r) JOIN placed USING (r)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_katz, op3_line_dedup, op4_decontamination, op5_token_files, op6_language, op7_licenses, op8_simhash, op9_warc, op10_neighbours, op11_audit, op12_infill, op13_sharding)}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": OP3_SQL, "op7_licenses": _op7_sql(), "op11_audit": OP11_SQL, "op12_infill": OP12_SQL, "op13_sharding": _op13_sql()}
