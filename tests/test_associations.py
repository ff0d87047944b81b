"""Expansion terms, sentence segments and table cells against plain loops."""

from __future__ import annotations

import math
import re
from collections import Counter

from docloom.operators import association as A


def test_expansions(spark):
    texts = ["solar panel makes power near solar panel roof", "panel power solar wind power", "wind makes power", "roof of the house", "", None] * 4
    units = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = A.expansions(units, "text", spark.createDataFrame([("solar",), ("wind",), ("absent",), ("solar",)], "term string"), window=2, support=4, k=3, stop_words=("near",))
    n, pairs = Counter(), Counter()
    for t in texts:
        ws = (t or "").split()
        n.update(ws)
        for i, w in enumerate(ws):
            pairs.update((w, o) for o in ws[max(0, i - 2) : i] + ws[i + 1 : i + 3] if o != w)
    want = []
    for term in ("solar", "wind"):
        found = sorted((-round(c * c / (n[a] * n[b]), 9), b, c) for (a, b), c in pairs.items() if a == term and c >= 4 and len(b) >= 4 and b != "near")
        want += [(term, b, c, -s, i + 1) for i, (s, b, c) in enumerate(found[:3])]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def vector(s):
    b = s.encode()
    return Counter((b[i] * 256 + b[i + 1]) % A.DIMENSIONS for i in range(len(b) - 1))


def test_sentence_segments(spark):
    one, two = "the cat sat on the mat", "quarterly revenue grew by twelve percent"
    texts = {1: f"{one}. {one} again! {one} and slept. {two}. {two} again? {two} once more.", 2: "Übung macht Meister. x. 日本語の文。日本語。", 3: "", 4: None, 5: "no end"}
    got = A.similarity_segments(spark.createDataFrame(list(texts.items()), "id int, text string"), "id", "text").collect()
    for r in got:
        ss = [s.strip() for s in re.findall(r"[^。！？.!?]+", texts[r.id]) if s.strip()]
        if r.sentence == 0:
            assert r.near is None
            continue
        a, b = vector(ss[r.sentence]), vector(ss[r.sentence - 1])
        norm = math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
        assert abs(r.near - (sum(a[k] * b[k] for k in a) / norm if norm else 0)) < 1e-8
    assert [r.segment for r in sorted(got) if r.id == 1] == [0, 0, 0, 1, 1, 1]
    assert {r.id for r in got} == {1, 2, 5}


def test_tables(spark):
    rows = [("small", i, "a", str(i)) for i in range(10)] + [("mid", i, "a", None) for i in range(11)] + [("big", i, "xy"[i % 2], " ") for i in range(101)]
    df = spark.createDataFrame(rows, "tab string, line int, c string, d string")
    assert {r.tab: r.tier for r in A.table_tiers(df, "tab").collect()} == {"small": "small", "mid": "medium", "big": "large"}
    cells = A.cells(df, "tab", "line", ["c", "d"])
    assert cells.count() == 20 + 11 + 101  # null and blank cells are none
    index = {(r.tab, r.column, r.value): (r.rows, r.first) for r in A.column_index(cells, "tab", "line").collect()}
    assert index["big", "c", "y"] == (50, 1) and index["small", "d", "3"] == (1, 3)
    links = {(r.tab, r.a, r.b): r.rows for r in A.cell_links(cells, "tab", "line").collect()}
    assert links["small", "c=a", "d=3"] == 1 and len(links) == 10


def test_sentences_meet_over_blocks_without_a_join(spark, monkeypatch):
    """Neighbours on either side of a block are compared, too, and nothing is shuffled for it."""
    monkeypatch.setattr(A, "BLOCK", 3)
    text = ". ".join(f"{'ab' * (i % 4 + 1)} côté {i}" for i in range(10)) + ". x. yy"
    units = spark.createDataFrame([(1, text), (2, "x"), (3, None), (4, text)], "id int, text string").coalesce(1)
    found = A.sentence_similarity(units, "id", "text")
    ss = [s.strip() for s in text.split(".")]
    for i in (1, 4):
        near = {r.sentence: r.near for r in found.filter(f"id = {i}").collect()}
        assert len(near) == len(ss) and near[0] is None
        for n in range(1, len(ss)):
            a, b = vector(ss[n]), vector(ss[n - 1])
            norm = math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
            assert abs(near[n] - (sum(a[k] * b[k] for k in a) / norm if norm else 0)) < 1e-8
    assert "Exchange hash" not in found._jdf.queryExecution().executedPlan().toString()
