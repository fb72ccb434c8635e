import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as c
from fieldgrid.llm import language

from . import test_decontaminate, test_lines, test_simhash

SF = "/root/testdata/sf0.001"


def test_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    model = language.fit(docs)
    coders = language.Compressors(model, language.LEVEL)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = [(k, t) for k, t in rows if not coders.decide(t, language.BLOCK, language.MARGIN)[2]]
    assert len(rows) > len(kept) > 0.9 * len(rows)
    gone = {(k, p) for k, p, _ in test_lines.brute(kept)}
    kept = [(k, "\n".join(x for p, x in enumerate(t.split("\n")) if (k, p) not in gone)) for k, t in kept]
    root = test_simhash.roots([k for k, _ in kept], [test_simhash.one(t) for _, t in kept])
    kept = [(k, t) for k, t in kept if root[k] == k]
    bad = {k for k, n, h, _ in test_decontaminate.brute(kept, items) if h and 20 * h >= n}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {k: library.encode(t, add_special_tokens=False).ids for k, t in kept if k not in bad}
    got = {r.doc_id: r for r in c.run(spark, SF).collect()}
    assert bad and {k: r.ids for k, r in got.items()} == want
    assert all(r.n_tokens == len(r.ids) and r.decoded == library.decode(r.ids, skip_special_tokens=False) for r in got.values())


def test_stages_of_odd_rows(spark):
    text = "the quick brown fox jumps over the lazy dog and runs away from it all day"
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    docs = spark.createDataFrame([(1, text, "en", "a", 3), (2, None, None, None, None), (None, text, "en", "a", 3), (4, "", "en", "a", 0), (5, text, None, "a", 3), (6, "12 34", "en", "b", 5)], schema)
    for name, stage in c.STAGES[:-1]:
        for some in (docs, docs.limit(0)):
            out = stage(spark, some, SF)
            assert sorted(out.columns) == sorted(docs.columns), name
            out.count()
    assert c.STAGES[-1][1](spark, docs, SF).count() == 6
