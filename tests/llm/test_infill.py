import hashlib
import re

import pytest

from fieldgrid.llm import infill


def brute(key, text, seed=42, rate=50, spm_rate=80, markers=("<P>", "<S>", "<M>")):
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text or "")
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not n or any(m in text for m in markers) or h[2] % 100 >= rate:
        return n, "plain", None, None, text or ""
    low, high = sorted(x % (n + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    a, b, c = markers
    if h[3] % 100 < spm_rate:
        return n, "spm", len(p), len(m), b + s + a + p + c + m
    return n, "psm", len(p), len(m), a + p + b + s + c + m


TEXTS = [None, "", " ", "word", " \t lead", "trail \n", "a b c d e", "naïve   café x \U0001f600 z", "<P> in it", "a <S", "<M", "nul \x00 byte \x1f y", "\x0b\x0c", "w " * 60_000, "x" * 3_000_000]


@pytest.mark.parametrize("options", [{}, {"rate": 100}, {"rate": 100, "spm_rate": 0, "seed": 7}, {"rate": 100, "markers": ("[pre]", "[suf]", "[mid]")}])
def test_odd_rows(spark, options):
    keys = [None, *range(-3, 40)]
    rows = [(t, k, "n", "f", "o", 1) for t in TEXTS for k in (keys if t is None or len(t) < 100 else keys[:6])] * 2
    df = spark.createDataFrame(rows, "text string, doc_id long, n string, form string, restored string, output int")
    marks = {k: v for k, v in options.items() if k == "markers"}
    back = infill.restore(infill.transform(df, **options), **marks)
    got = sorted((str(r.doc_id), r.output, r.n, r.form, r.prefix_chars, r.middle_chars, r.restored) for r in back.collect())
    made = [(k, t, brute(k, t, **options)) for t, k, *_ in rows]
    assert got == sorted((str(k), o, n, f, p, m, t or "") for k, t, (n, f, p, m, o) in made)
    assert infill.restore(infill.transform(df.limit(0))).count() == 0
    if not options:
        assert {f for _, _, (_, f, *_) in made} == {"plain", "psm", "spm"}


def test_malformed_outputs(spark):
    df = spark.createDataFrame([("<P>a<S>b<M>c", "psm", 1), ("<S>b<P>a<M>c", "spm", 2), ("<P>a", "psm", 3), (None, "spm", 4), ("kept <P>", "plain", 5), ("kept", None, 6)], "output string, form string, restored int")
    assert [r.restored for r in infill.restore(df).collect()] == ["acb", "acb", None, None, "kept <P>", "kept"]


@pytest.mark.parametrize("markers", [("<P>", "<P>", "<M>"), ("<P>", "<P>x", "<M>"), ("ab", "bc", "x"), ("aba", "x", "y"), ("", "x", "y")])
def test_markers_that_may_overlap(spark, markers):
    with pytest.raises(ValueError):
        infill.transform(spark.createDataFrame([("a", 1)], "text string, doc_id long"), markers=markers)
