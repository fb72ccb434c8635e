from fieldgrid.llm import licenses


def test_scan(spark):
    apache, gpl = "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3."
    rows = [
        (1, "a/LICENSE", f"{apache}\nmore words"), (2, "a/b/x.py", "print(1)\nnothing here"), (3, "a/b/c/y.py", None), (4, "a/b/z.py", f"# {gpl}\ncode of the file"),
        (5, "x.py", "no licence above"), (6, "d/COPYING.txt", gpl), (7, "d/e/LICENSE", "not a known one"), (8, "d/e/f.py", "x"), (9, None, "x"), (10, None, apache),
        (None, "a/n.py", "x"), (2, "a/b/x.py", "print(1)\nnothing here"), (11, "ab/x.py", "x"), (12, "g/LICENSE", apache), (13, "g/LICENSE.md", gpl + " and others"), (14, "g/x", ""),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, path string, text string, license string, k int")
    got = sorted((str(r.doc_id), r.path, r.license, r.origin, r.directory) for r in licenses.scan(df).collect())
    want = [
        (1, "a/LICENSE", "Apache-2.0", "file", None), (2, "a/b/x.py", "Apache-2.0", "inherited", "a"), (2, "a/b/x.py", "Apache-2.0", "inherited", "a"), (3, "a/b/c/y.py", "Apache-2.0", "inherited", "a"),
        (4, "a/b/z.py", "GPL-3.0", "header", None), (5, "x.py", None, None, None), (6, "d/COPYING.txt", "GPL-3.0", "file", None), (7, "d/e/LICENSE", "GPL-3.0", "inherited", "d"), (8, "d/e/f.py", "GPL-3.0", "inherited", "d"),
        (9, None, None, None, None), (10, None, "Apache-2.0", "header", None), (None, "a/n.py", "Apache-2.0", "inherited", "a"), (11, "ab/x.py", None, None, None), (12, "g/LICENSE", "Apache-2.0", "file", None),
        (13, "g/LICENSE.md", "GPL-3.0", "file", None), (14, "g/x", "Apache-2.0", "inherited", "g"),
    ]
    assert got == sorted((str(w[0]), *w[1:]) for w in want)
    assert licenses.scan(df.limit(0)).count() == 0


def test_root_licence_and_every_template(spark):
    df = spark.createDataFrame([(i, f"d{i}/f", t) for i, (_, t) in enumerate(licenses.TEMPLATES)] + [(100, "LICENSE", licenses.TEMPLATES[3][1]), (101, "x", "y"), (102, "z/x", "y")], "doc_id long, path string, text string")
    got = {r.doc_id: (r.license, r.origin) for r in licenses.scan(df).collect()}
    assert all(got[i] == (name, "header") for i, (name, _) in enumerate(licenses.TEMPLATES))
    assert got[101] == got[102] == ("MIT", "inherited")


def test_the_bounds_lose_nothing(spark):
    import random
    import re

    rng = random.Random(1)
    texts = []
    for _, t in licenses.TEMPLATES:
        words = t.replace(",", "").replace(".", " ").split()
        for n in range(1, len(words) + 1, 2):
            texts.append(" ".join(rng.sample(words, n) + ["filler"] * rng.randrange(3)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.k: (r.license, r.score) for r in licenses.own_licenses(df, "doc_id", "text").collect()}
    parts = licenses.squared_shares
    licenses.squared_shares = lambda *_: {w: [1.0] for w in {x for t in texts for x in re.findall(r"[^\W_]+", t.lower())}}
    try:
        want = {r.k: (r.license, r.score) for r in licenses.own_licenses(df, "doc_id", "text").collect()}
    finally:
        licenses.squared_shares = parts
    assert got == want and 20 < len(got) < len(texts)


def test_wrapped_headers_in_files_of_any_size(spark):
    mit = ["# Permission is hereby granted, free of charge, to any person", "# obtaining a copy of this software and associated documentation files", "# (the Software), to deal in the Software without restriction"]
    short = ["// Licensed under the", "// Apache License,", "// Version 2.0"]
    code = [f"value_{i} = compute(alpha_{i}, beta, gamma)" for i in range(2000)]
    rows = []
    for i, n in enumerate((0, 5, 60, 2000)):
        rows += [(10 * i + j, "x.py", "\n".join([*code[: n // 2], *head, *code[n // 2 : n]])) for j, head in enumerate((mit, short))]
    rows += [(100, "y", "\n".join(["                    GNU GENERAL PUBLIC LICENSE", "                       Version 3, 29 June 2007", "", *code[:50]])), (101, "z", "\n".join(code))]
    got = {r.k: (r.license, r.score) for r in licenses.own_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string"), "doc_id", "text").collect()}
    assert {k: v[0] for k, v in got.items()} == {**{10 * i: "MIT" for i in range(4)}, **{10 * i + 1: "Apache-2.0" for i in range(4)}, 100: "GPL-3.0"}
    assert len({got[10 * i][1] for i in range(4)}) == len({got[10 * i + 1][1] for i in range(4)}) == 1
