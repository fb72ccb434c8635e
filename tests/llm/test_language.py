import re
import zlib

import zstandard

from fieldgrid.llm import language
from fieldgrid.llm.queries import op6_language

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = op6_language(spark, SF)
    truth = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "lang")
    rows = got.join(truth, "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark):
    german, french = "der die das und nicht ich über schön " * 8, "le la les des été où être français avec " * 8
    labelled = spark.createDataFrame([(1, german, "de"), (2, french, "fr"), (3, None, "fr"), (4, "x", None), (5, "", "es")], "doc_id long, text string, lang string")
    model = language.fit(labelled)
    assert [*model] == ["de", "fr"]  # as many rows of each
    docs = spark.createDataFrame([(1, german), (1, german), (2, french), (3, None), (4, ""), (5, "123 !?"), (None, french), (7, french * 3000)], "doc_id long, text string")
    rows = sorted((str(r.doc_id), r.lang_pred, r.rejected) for r in language.predict(docs, model).collect())
    assert [r[1] for r in rows] == ["de", "de", "fr", "und", "und", "und", "fr", "fr"]
    assert [r[0] for r in rows if r[2]] == ["3", "4", "5"]
    assert {r.lang_pred for r in language.predict(docs, {}).collect()} == {"und"}
    assert language.fit(labelled.limit(0)) == {}
    assert language.predict(docs.limit(0), model).count() == 0


def test_equals_brute_force(spark):
    """Every text's sizes are computed again, from dictionaries that the labelled texts are searched for."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in op6_language(spark, SF).collect()}
    rows = docs.collect()
    learn = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.text and r.lang is not None]
    words = lambda t: re.sub(r"[^\w]|[\d_]", " ", t.lower()).split()
    model = language.fit(docs.where("crc32(cast(doc_id as string)) % 4 <> 2"))
    often = {}
    for r in learn:
        often[r.lang] = often.get(r.lang, 0) + 1
    assert [*model] == sorted(often, key=lambda k: (-often[k], k))
    own = {k: " " + " ".join(w for r in learn if r.lang == k for w in words(r.text)) + " " for k in model}
    for k, content in model.items():
        text = content.decode()
        assert len(text) <= 200 * 401
        inner = [text[i : i + 60].split(" ", 1)[-1].rsplit(" ", 1)[0] for i in range(0, len(text) - 60, 997)]
        assert sum(f" {' '.join(x.split())} " in own[k] for x in inner) > 0.6 * len(inner)  # the others span two excerpts
    coders = {}
    for k, content in model.items():
        coders[k] = zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
    assert len(got) == len(rows)
    for r in rows:
        if not r.text or not any(c.isalpha() for c in r.text):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score, got[r.doc_id].rejected) == ("und", 0.0, True)
            continue
        data = re.sub(r"(?:[^\w]|[\d_])+", " ", r.text.lower()).encode()
        sizes = {k: sum(len(c.compress(data[i : i + 1024])) for i in range(0, len(data), 1024)) for k, c in coders.items()}
        best = min(sizes, key=lambda k: (sizes[k], [*model].index(k)))
        score = 1 - sizes[best] / min(v for k, v in sizes.items() if k != best)
        g = got[r.doc_id]
        assert (g.lang_pred, g.score, g.rejected) == (best, score, score < 0.004)


def test_excerpts_come_from_whole_texts_and_few_labels(spark):
    texts = [(i, "x1 " * 2000 + " ".join(f"wort{c}" for c in "abcdefgh") * 300, "de") for i in range(40)] + [(100 + i, "some text", f"label {i}") for i in range(40)]
    model = language.fit(spark.createDataFrame(texts, "doc_id long, text string, lang string"), languages=3)
    assert [*model] == ["de", "label 0", "label 1"]
    assert b"wort" in model["de"]
