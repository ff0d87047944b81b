"""Small brute-force versions and edge cases of the ten operators."""

from __future__ import annotations

import datetime
import hashlib
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from docloom.llm import (
    ann,
    components,
    embedding_dedup,
    lm_scoring,
    near_copies,
    packing,
    pii,
    sentencepiece_codec,
    simhash,
    substring_dedup,
    toxicity,
    url_filter,
)
from docloom.llm.common import add_columns
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
PASSAGE = " ".join(f"w{i}" for i in range(30))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, f"start one {PASSAGE} end one"),
        (2, f"other two\n{PASSAGE}\n tail"),
        (2, f"other two\n{PASSAGE}\n tail"),
        (3, None),
        (4, ""),
        (5, "   \n"),
        (6, "short text"),
        (None, f"null id {PASSAGE}"),
        (7, " ".join(f"v{i % 977}x{i}" for i in range(20_000)) + " " + PASSAGE),
    ]
    return spark.createDataFrame([(i, t, "a", "b") for i, t in rows], "doc_id bigint, text string, n_words string, block string")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 6), (6, 5), (9, 9), (None, 1), (5, 7)], "u int, v int")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 5}
    assert components.components(edges.limit(0)).count() == 0


def _moved(values, radices, tweak, key=pii.KEY, rounds=pii.ROUNDS):
    """The Feistel network again, in plain Python."""
    v, n = list(values), len(values)
    h = n // 2
    for r in range(1, rounds + 1):
        other = v[h:] if r % 2 else v[:h]
        digest = hashlib.sha512("|".join([key, tweak, str(n), str(r), ",".join(map(str, other))]).encode()).hexdigest()
        for i in range(n):
            if (i < h) == (r % 2 == 1):
                v[i] = (v[i] + int(digest[i % 32 * 4 : i % 32 * 4 + 4], 16)) % radices[i]
    return v


def _symbols(s, tweak):
    base = [48 if "0" <= c <= "9" else 65 if "A" <= c <= "Z" else 97 if "a" <= c <= "z" else ord(c) for c in s]
    radix = [10 if b == 48 else 26 if b in (65, 97) else 1 for b in base]
    return "".join(chr(b + v) for b, v in zip(base, _moved([ord(c) - b for c, b in zip(s, base, strict=True)], radix, tweak), strict=True))


def _fill(pattern, symbols):
    it = iter(symbols)
    return "".join(next(it) if c.isalnum() else c for c in pattern)


def _luhn(s):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10


def _iban_rest(s):
    return int("".join(str(int(c, 36)) for c in s)) % 97


def _pseudonym(kind, m):
    d = "".join(c for c in m if c.isdigit())
    if kind == "email":
        local, domain = m.split("@")
        return _symbols(local, f"email@{domain.lower()}") + "@" + domain
    if kind == "ipv4":
        return ".".join(map(str, _moved([int(x) for x in m.split(".")], [256] * 4, "ipv4")))
    if kind == "phone":
        k = 1 if d[0] in "17" else 2 if d[:2] in pii._CODES else 3
        return _fill(m, d[:k] + _symbols(d[k:], "phone" + d[:k]))
    if kind == "number":
        body = _symbols(d[:-1], "number")
        return _fill(m, body + str(-_luhn(body + "0") % 10))
    if kind == "ssn":
        a, g, s = (int(x) for x in m.split("-"))
        a, g, s = _moved([a - 2 if a > 666 else a - 1, g - 1, s - 1], [898, 99, 9999], "ssn")
        return f"{a + 2 if a > 664 else a + 1:03d}-{g + 1:02d}-{s + 1:04d}"
    if kind == "iban":
        plain = m.replace(" ", "")
        account = _symbols(plain[4:], "iban" + plain[:2])
        return _fill(m, f"{plain[:2]}{98 - _iban_rest(account + plain[:2] + '00'):02d}{account}")
    form = {4: "%Y-%m-%d"}.get(m.find("-"), "%m@%d@%Y" if m[3:5] > "12" else "%d@%m@%Y").replace("@", m[2])
    n = (datetime.datetime.strptime(m, form).date() - datetime.date(1900, 1, 1)).days
    a, b = _moved(divmod(n, 4297), [17, 4297], "date")
    return (datetime.date(1900, 1, 1) + datetime.timedelta(a * 4297 + b)).strftime(form)


#: (kind or None for what must stay, value); every value follows the one before it after a blank.
FOUND = [
    ("email", "a.B7@x.org"), ("email", "q@Mail.example.com"), ("number", "4381893557741609"), ("number", "4381-8935-5774-1609"), (None, "4381893557741608"),
    (None, "17000000000002"), ("ipv4", "10.0.0.255"), (None, "10.0.0.256"), ("date", "2024-02-29"), ("date", "31.12.1999"), (None, "30.02.2020"), ("date", "12/31/1999"),
    (None, "2023-02-29"), ("phone", "+1 (743) 555-3824"), ("ssn", "123-45-6789"), (None, "666-45-6789"), (None, "123-00-6789"), ("phone", "+17435553824"), ("phone", "+44 20 7946 0958"),
    ("ssn", "899-99-9999"), ("phone", "+44 20 7946 0958"), ("date", "2024-02-29"), ("phone", "+358 40 1234567"), ("number", "378282246310005"), ("phone", "+442079460958"),
    ("iban", "GB82 WEST 1234 5698 7654 32"), (None, "then"), ("iban", "DE89370400440532013000"), (None, "DE88370400440532013000"), ("iban", "ES91 2100 0418 4502 0005 1332"), (None, "NEXT"), (None, "12 345"),
]


def test_pii_brute_force(spark, docs, none):
    text = " ".join(v for _, v in FOUND)
    want = " ".join(v if k is None else _pseudonym(k, v) for k, v in FOUND)
    n = sum(k is not None for k, _ in FOUND)
    rows = [(1, text, 7), (1, text, 7), (2, f"x\n{text}.", 7), (3, None, 7), (4, "", 7), (5, "no data, 1 2 3", 7), (None, "a" * 300_000 + f" {text}", 7)]
    df = spark.createDataFrame(rows, "doc_id int, text string, Found0 int")
    out = pii.pseudonymize(df, count_col="n")
    assert out.columns == ["doc_id", "text", "Found0", "n"]
    got = {r.doc_id: (r.text, r.n, r.Found0) for r in out.collect()}
    assert got[1] == (want, n, 7) and got[2] == (f"x\n{want}.", n, 7) and got[None] == ("a" * 300_000 + f" {want}", n, 7)
    assert got[3] == (None, 0, 7) and got[4] == ("", 0, 7) and got[5] == (rows[5][1], 0, 7) and out.count() == len(rows)
    new = dict(zip((v for _, v in FOUND), (v if k is None else _pseudonym(k, v) for k, v in FOUND), strict=True))
    assert new["+17435553824"][1:] == "".join(c for c in new["+1 (743) 555-3824"] if c.isdigit())
    assert new["+442079460958"][1:] == "".join(c for c in new["+44 20 7946 0958"] if c.isdigit())
    for k, v in FOUND:
        assert k is None or new[v] != v
        assert k != "number" or _luhn("".join(c for c in new[v] if c.isdigit())) == 0
        assert k != "iban" or _iban_rest((p := new[v].replace(" ", ""))[4:] + p[:4]) == 1
    assert pii.pseudonymize(none, count_col="n").columns == [*none.columns, "n"] and pii.pseudonymize(none).count() == 0
    assert pii.pseudonymize(docs).filter("doc_id = 7").first().text == docs.filter("doc_id = 7").first().text


def test_feistel_is_a_permutation(spark):
    three = spark.range(1000).select(pii.permute_symbols(F.lpad(F.col("id").cast("string"), 3, "0"), "k", F.lit("t")).alias("v"))
    assert three.distinct().count() == 1000 and three.filter("length(v) = 3").count() == 1000
    days = spark.range(73049).select(F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")), "dd.MM.yyyy").alias("d"))
    moved = days.select(pii._date(F.col("d"), "k").alias("d"))
    assert moved.distinct().count() == 73049 and moved.exceptAll(days).count() == 0


def test_substring_dedup_brute_force(spark, docs, none):
    rows = docs.collect()
    out = substring_dedup.remove_repeats(docs, digests=True)
    assert out.columns == ["doc_id", "text", "block", "n_words", "n_removed", "kept_sha256"]
    first: dict = {}
    top = 1 << 60
    words = [(top if r.doc_id is None else r.doc_id, (r.text or "").encode().split()) for r in rows]
    for i, w in sorted(words, key=lambda x: x[0]):
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    want = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        want.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    got = out.collect()
    assert sorted((top if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(want)
    for r in got:
        if r.text:
            assert r.n_removed == 0 or r.text.split() == " ".join(r.text.split()).split()
    assert [r.text for r in got if r.doc_id == 3] == [None]
    assert substring_dedup.remove_repeats(none).count() == 0


def _removed(rows, window=13):
    """(id, words) -> removed words per row, by trying all windows."""
    first: dict = {}
    for i, w in sorted(rows, key=lambda x: x[0]):
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = []
    for i, w in rows:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((i, sum(gone)))
    return sorted(out)


def test_frequent_prefixes_are_lengthened(spark):
    rng = np.random.default_rng(4)
    rows = [(i, f"a{i} b{i} {PASSAGE} c{i} d{i} " + " ".join(f"k{x}" for x in rng.integers(0, 3, 60))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for limit in (300, 900, 2000):
        longer = substring_dedup.prefix_lengths(df, "text", limit=limit)
        assert len(longer.gram) and (longer.words > 5).all() and (longer.words <= 13).all()
        got = sorted((r.doc_id, r.n_removed) for r in substring_dedup.remove_repeats(df, prefix_bytes=limit).collect())
        assert got == _removed([(i, t.split()) for i, t in rows])
    assert len(set(substring_dedup.prefix_lengths(df, "text", limit=900).words.tolist())) > 1  # some need more words than others


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(3)
    passage = [f"p{i}" for i in range(20)]
    texts = []
    for i in range(60):
        cut = int(rng.integers(1, 20))
        texts.append(" ".join([*rng.choice(list("abcd"), 9), *passage[:cut], *rng.choice(list("abcd"), 14)]).encode())
    w = substring_dedup.words_of(texts)
    leaf, code = np.flatnonzero(substring_dedup._windows(w, 13)), w.codes()
    order, common = substring_dedup.suffix_array(code, leaf, 13)
    rows = [tuple(code[i : i + 13].tolist()) for i in leaf[order].tolist()]
    assert rows == sorted(rows)
    want = [0] + [next((k for k in range(13) if a[k] != b[k]), 13) for a, b in zip(rows, rows[1:], strict=False)]
    assert common.tolist() == want
    assert {0, 13} < set(want) and len(set(want)) > 8  # nodes of many depths
    none = substring_dedup.suffix_array(np.zeros(0, np.int64), np.zeros(0, np.int64), 13)
    assert [len(x) for x in none] == [0, 0]


def test_colliding_words_do_not_repeat(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("ab"), 6)) for _ in range(400)]
    rows = [(i, " ".join(words[k] for k in rng.integers(0, 400, 80)) + " " + PASSAGE) for i in range(12)]
    w = substring_dedup.words_of([t.encode() for _, t in rows])
    w.hash[:] = w.hash & np.uint64(1)  # hashes tell almost nothing
    owner = np.arange(12)
    leaf, repeated = substring_dedup._repeats(w, owner, 13)
    text = [w.buf[a:z] for a, z in zip(w.start.tolist(), w.end.tolist(), strict=True)]
    first: dict = {}
    for i in leaf.tolist():
        first[k] = min(first.get(k := tuple(text[i : i + 13]), 99), int(w.doc[i]))
    assert repeated.tolist() == [first[tuple(text[i : i + 13])] < w.doc[i] for i in leaf.tolist()]
    assert len(set(w.codes().tolist())) == len(set(text))
    plan = substring_dedup.plan_block(w, 13, substring_dedup.no_lengths(), 7)
    runs = plan.runs
    spans = [tuple(text[a : a + n + 12]) for a, n in zip(runs.start.tolist(), runs.count.tolist(), strict=True)]
    assert all(spans[plan.distinct[p]] == x for p, x in zip(plan.place.tolist(), spans, strict=True))


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id bigint, toxic int")
    texts = [(i, ("nice day vermin here. " if i % 2 else "nice day here now. ") * (1 + i % 3)) for i in range(200)]
    train = spark.createDataFrame(texts, "doc_id bigint, text string")
    chain = toxicity.fit_toxicity(train, labels)
    rows = toxicity.score_toxicity(train, chain).collect()
    assert all((r.score >= 0.3) == bool(r.doc_id % 2) == bool(r.predicted) for r in rows)
    span = next(r for r in rows if r.predicted).spans[0]
    text = next(r for r in rows if r.predicted).text
    assert text[span["start"] : span["end"]] == "vermin"
    odd = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, chain).collect()}
    assert all(0 <= s <= 1 for s in odd.values()) and odd[3] == odd[4]
    assert toxicity.score_toxicity(none, chain).count() == 0
    assert toxicity.score_toxicity(docs, toxicity.fit_toxicity(none, labels.limit(0))).count() == docs.count()


def _peak(f) -> int:
    """The most bytes that f holds at once."""
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_toxicity_holds_little():
    rng = np.random.default_rng(4)
    texts = [" ".join(f"{"vwww"[i % 4]}{k}" + "." * (k % 9 == 0) for k in rng.integers(0, 30_000, 2000).tolist()).encode() for i in range(800)]
    toxic = np.arange(800) % 4 > 0
    size = sum(map(len, texts))
    peak = _peak(lambda: toxicity.fit_tokens(texts, toxic, 0.5, rounds=1))
    assert peak < 8 * size  # one part's arrays besides the codes of all tokens
    chain = toxicity.fit_tokens(texts[:20], toxic[:20], 0.5, rounds=1)
    long = [b"word " * 2_000_000]  # one text is one block
    assert _peak(lambda: toxicity.tokens_of(long)) < 16 * len(long[0])
    assert _peak(lambda: toxicity.score_texts(chain, texts)) < 8 * size


def test_word_codes_hold_little():
    words = np.random.default_rng(6).integers(0, 50_000, 1 << 20).tolist()
    w = substring_dedup.words_of([" ".join(f"word{k}" for k in words).encode(), b"", b"word1 word2"])
    code: list = []
    assert _peak(lambda: code.append(w.codes())) < 48 * len(w.hash)
    assert len(set(code[0].tolist())) == len(set(words)) and code[0][-2] == code[0][words.index(1)]
    assert code[0].tolist() == np.unique(w.hash, return_inverse=True)[1].tolist()
    none = substring_dedup.words_of([])
    assert len(none.codes()) == 0 and len(none.same(none.start, none.start)) == 0


def test_toxicity_by_parts(monkeypatch):
    """Blocks of texts and parts of sequences change neither the model nor the scores and spans."""
    rng = np.random.default_rng(5)
    texts = [" ".join(("vermin" if i % 2 and k < 4 else f"w{k}") + "." * (k % 7 == 0) for k in rng.integers(0, 60, 40).tolist()).encode() for i in range(120)]
    texts += [b"", b"   ", "\u00e9t\u00e9 vermin".encode()]
    toxic = np.arange(len(texts)) % 2 == 1
    one = toxicity.fit_tokens(texts, toxic, 0.3, rounds=20)
    want = toxicity.score_texts(one, texts)
    monkeypatch.setattr(toxicity, "_FIT_BYTES", 500)
    monkeypatch.setattr(toxicity, "_FIT_TOKENS", 30)
    many = toxicity.fit_tokens(texts, toxic, 0.3, rounds=20)
    assert (one.words == many.words).all() and np.allclose(one.weight, many.weight) and np.allclose(one.step, many.step) and np.allclose(one.doc, many.doc)
    got = toxicity.score_texts(one, texts)
    assert np.allclose(got[0].to_numpy(), want[0].to_numpy()) and got[1].equals(want[1])
    assert [[(x["start"], x["end"]) for x in r] for r in got[2].to_pylist()] == [[(x["start"], x["end"]) for x in r] for r in want[2].to_pylist()]
    spans = got[2].to_pylist()
    for text, row, block in zip(texts, spans, (toxicity.tokens_of([t]) for t in texts), strict=True):
        p = toxicity.marginals(one, block)
        hit = [(int(block.start[k]), int(block.end[k])) for k in np.flatnonzero(p >= 0.5)]
        assert [(x["start"], x["end"]) for x in row] == hit and all(text[a:z].strip() == text[a:z] for a, z in hit)
    assert any(spans) and [len(x) for x in toxicity.score_texts(one, [])] == [0, 0, 0]


def test_forward_backward_brute_force():
    rng = np.random.default_rng(0)
    odds, step, seq = np.exp(rng.standard_normal(6)), rng.standard_normal((2, 2)), np.array([0, 0, 0, 0, 1, 1])
    fwd, bwd = toxicity.forward_backward(odds, seq, step)
    got = fwd * bwd / (1 + fwd * bwd)
    for a, z in ((0, 4), (4, 6)):
        total, one = 0.0, np.zeros(z - a)
        for m in range(1 << (z - a)):
            y = [m >> i & 1 for i in range(z - a)]
            p = np.prod([odds[a + i] ** y[i] for i in range(z - a)]) * np.exp(sum(step[y[i], y[i + 1]] for i in range(z - a - 1)))
            total, one = total + p, one + p * np.array(y)
        assert np.allclose(got[a:z], one / total)


def test_packing(spark, docs, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.public_vocabulary())
    rows = packing.pack_documents(docs).toPandas()
    for r in docs.dropna(subset=["doc_id"]).dropDuplicates(["doc_id"]).collect():
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        mine = rows[rows.doc_id == r.doc_id].drop_duplicates("start").sort_values("start")
        assert mine.doc_tokens.eq(len(ids)).all()
        if r.doc_id != 2:
            assert mine.length.sum() == len(ids)
            for p in mine.itertuples():
                assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    for _, s in rows.sort_values("offset").groupby("sequence_id"):
        n = int(s.length.sum())
        assert list(s.offset) == list(s.length.cumsum() - s.length) and n <= 2048 and n & (n - 1) == 0
    assert packing.pack_documents(none).count() == 0


def test_encoding_equals_the_tokenizer():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.public_vocabulary())
    texts = ["It's 1st <|endoftext|>x A\u00a0b é e\u0301 日本", "", "Don't\tSTOP!!", "x<|startoftext|>", "\u1e9e ΣΑΣ \x1c y", "a\0b \x07", "q" * 300 + " y", "İi \x85 q"]
    e = packing.Encoder(packing.public_vocabulary())
    e.words, e.parts = packing.Memory(2000), packing.Memory(2000)  # so small that it starts anew
    for _ in range(3):
        for some in (texts, texts[:1], texts[4:], [], [""]):
            assert [x.tolist() for x in e.encode(some)] == [tok.encode(t, add_special_tokens=False).ids for t in some]


def _place(count, size, capacity):
    """The fill level of least sum of squared counts afterwards, by trying all; ties to the fullest."""
    best = None
    for level in [0, *sorted((h for h in count if count[h]), reverse=True)]:
        if level + size <= capacity:
            after = dict(count)
            if level:
                after[level] -= 1
            if level + size < capacity:
                after[level + size] = after.get(level + size, 0) + 1
            key = (sum(n * n for n in after.values()), -level)
            best = min(best or (key, level), (key, level))
    return best[1]


def test_sum_of_squares_brute_force():
    levels, count = packing.Levels(64), {}
    for i, size in enumerate(np.random.default_rng(1).integers(1, 64, 400).tolist()):
        level = _place(count, size, 64)
        assert levels.place(size, i)[1] == level
        if level:
            count[level] -= 1
        if level + size < 64:
            count[level + size] = count.get(level + size, 0) + 1


def test_packer_empties_what_is_open(monkeypatch):
    monkeypatch.setattr(packing, "_OPEN", 3000)
    packer, out = packing.Packer(64, 0), []
    sizes = np.random.default_rng(2).integers(33, 200, 500).tolist()  # the rests hardly fit together
    docs = {i: np.arange(n) % 60000 for i, n in enumerate(sizes)}
    for i, ids in docs.items():
        out += packer.add(i, ids)
        assert packer.tokens <= 3000 + 64
    out += packer.finish()
    assert len({s for s, _ in out}) == len(out)
    pieces = [(d, start, ids) for _, seq in out for d, start, ids, n in seq]
    for i, ids in docs.items():
        assert np.array_equal(np.concatenate([x for d, _, x in sorted((p for p in pieces if p[0] == i), key=lambda p: p[1])]), ids)
    for _, seq in out:
        n = sum(len(p[2]) for p in seq)
        assert n <= 64 and n & (n - 1) == 0


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://A.Example.ORG/es/x?q#f", "x://example.org/en/12", "http://a.com/de/1", "http://com/fr/", "http://xorg/", "http://b.org", "http://b.org/y"]
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)] * 2, "page_id int, url string, Rule string")
    out = url_filter.judge_urls(pages, url_filter.rules_frame(spark))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}
    assert out.count() == 2 * len(urls) and got[0] == got[1] == ("", "", None, "allow")
    assert got[3] == ("a.example.org", "/es/x", "example.org/es/", "block") and got[4][2:] == ("example.org/en/1", "block")
    assert got[5][2:] == ("com/de/", "block") and got[6][2:] == ("com/fr/", "allow") and got[7][2] is None and got[8][2] is None
    assert got[9][2:] == ("org/", "allow")
    assert url_filter.judge_urls(pages.limit(0), url_filter.rules_frame(spark)).count() == 0


def test_simhash_brute_force(spark, docs, none):
    texts = [(i, " ".join(f"w{j}" for j in range(60 + i // 3))) for i in range(30)] + [(40, None), (41, ""), (42, "One two"), (43, "oNE  two")]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = {r.doc_id: r for r in simhash.simhash_groups(df).collect()}

    def mark(t):
        w = (t or "").encode().lower().split()
        shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fp = {i: mark(t) for i, t in texts}
    group = {i: i for i in fp}
    for _ in fp:
        for i in fp:
            for j in fp:
                if (fp[i] ^ fp[j]).bit_count() <= 2:
                    group[i] = group[j] = min(group[i], group[j])
    assert {i: (f"{fp[i]:016x}", group[i]) for i in fp} == {i: (r.fingerprint, r.component_id) for i, r in got.items()}
    assert simhash.simhash_groups(docs).count() == docs.count() and simhash.simhash_groups(none).count() == 0


def _vectors(spark, n=300):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((n, 16))
    x[1::3] = x[0::3][: len(x[1::3])] + 0.1 * rng.standard_normal(x[1::3].shape)
    rows = [(i, x[i].astype(np.float32).tolist(), i % 2 if i % 3 else 0) for i in range(n)]
    rows += [(n + i, x[0].astype(np.float32).tolist(), 0) for i in range(40)]
    rows += [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] + [1.0] * 15, 0), (1003, [None] + [1.0] * 15, 0), (1004, [1.0] * 16, None), (1005, [], 0)]
    return rows, spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")


def test_embedding_dedup_brute_force(spark):
    rows, df = _vectors(spark)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    fine = [(i, np.array(v, float), k) for i, v, k in rows if k is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links, group = {i: 0 for i, *_ in rows}, {i: i for i, *_ in rows}
    pairs = [(a[0], b[0]) for a in fine for b in fine if a[0] != b[0] and a[2] == b[2] and a[1] @ b[1] / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= 0.93]
    for a, _ in pairs:
        links[a] += 1
    for _ in range(5):
        for a, b in pairs:
            group[a] = group[b] = min(group[a], group[b])
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {i: (links[i], group[i], group[i] == i) for i in links}
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_forest_splits_and_finds(spark, monkeypatch):
    """Small leaves and groups, so that upper splits and trees do cut; one stray vector has another length."""
    monkeypatch.setattr(embedding_dedup, "LEAF", 32)
    monkeypatch.setattr(embedding_dedup, "GROUP", 300)
    rng = np.random.default_rng(9)
    x = rng.standard_normal((1500, 48))
    x[1::2] = x[0::2] + 0.2 * rng.standard_normal(x[1::2].shape)
    rows = [(i, v.astype(np.float32).tolist(), 1) for i, v in enumerate(x)] + [(5000, [1.0] * 90, 1), (5001, [1.0] * 90, 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df).collect()}
    u = np.array([r[1] for r in rows[:1500]], float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = (u @ u.T >= 0.93).sum(axis=1) - 1
    assert all(got[i] <= want[i] for i in range(1500)) and got[5000] == got[5001] == 1
    assert sum(got[i] for i in range(1500)) >= 0.9 * want.sum() > 1000


def test_ann_recall_and_ties(spark):
    rows, df = _vectors(spark)
    out = ann.nearest_neighbours(df, F.col("id") % 20 == 0).collect()
    fine = [(i, np.array(v, float)) for i, v, _ in rows if v and None not in v and np.isfinite(v).all() and np.any(v)]
    hits = total = 0
    for q, x in (f for f in fine if f[0] % 20 == 0):
        score = sorted((-round(x @ y / np.linalg.norm(x) / np.linalg.norm(y), 12), i) for i, y in fine if i != q)[:5]
        mine = sorted((r.rank, r.vec_id) for r in out if r.query_id == q)
        assert [r for r, _ in mine] == [1, 2, 3, 4, 5]
        hits, total = hits + len({i for _, i in score} & {i for _, i in mine}), total + 5
    assert hits / total >= 0.9
    assert ann.nearest_neighbours(df.filter("vec_id < 3"), F.col("id") >= 0).count() == 6
    assert ann.nearest_neighbours(df.limit(0), F.col("id") >= 0).count() == 0


def _small(x):
    return [(i, (v / np.linalg.norm(v)).astype(np.float16).tobytes()) for i, v in enumerate(x)]


def test_ann_search_opens_the_whole_beam(spark):
    turn = np.arange(400) * 0.004  # neighbours on an arc know each other only: a hop leads one node further
    nodes = spark.createDataFrame(_small(np.stack([np.cos(turn), np.sin(turn)], axis=1)), "id bigint, small binary")
    chain = spark.createDataFrame([(i, i + 1, 1.0) for i in range(399)], "u bigint, v bigint, s double")
    asked = nodes.filter("id = 0").select(F.col("id").alias("q"), F.col("small").alias("qsmall"))
    found = {r.v for r in ann.greedy_search(asked, nodes, chain, beam=48).collect()}
    assert len(found) == 48 and found >= set(range(40))  # 16 bits blur the last few
    with pytest.raises(RuntimeError):
        ann.greedy_search(asked, nodes, chain, beam=48, hops=2)


def test_ann_graph_settles_and_grows(spark):
    nodes = spark.createDataFrame(_small(np.random.default_rng(3).standard_normal((600, 16))), "id bigint, small binary")
    with pytest.raises(RuntimeError):
        ann.neighbour_graph(nodes, rounds=1)
    x = np.stack([np.frombuffer(r.small, np.float16).astype(float) for r in nodes.orderBy("id").collect()])
    s = x @ x.T - 9 * np.eye(600)
    true = {(i, j) for i, row in enumerate(np.argsort(-s, axis=1)[:, :20].tolist()) for j in row}
    assert len(true & {(r.u, r.v) for r in ann.neighbour_graph(nodes).collect()}) >= 0.99 * len(true)
    a, b = ann.sizes(10_000), ann.sizes(1_000_000)
    assert a.k < b.k and a.starts < b.starts and a.beam < b.beam and a.entries < b.entries


def test_ann_work_grows_little_faster_than_the_rows(spark):
    """A hundred times the nodes may not cost a query many times the nodes scored; the graph has the recall by itself."""
    a, b = ann.sizes(10_000), ann.sizes(1_000_000)
    assert b.beam * b.k <= 4 * a.beam * a.k and b.k**2 <= 6 * a.k**2
    x = np.random.default_rng(4).standard_normal((2500, 64))
    nodes = spark.createDataFrame(_small(x), "id bigint, small binary")
    asked = nodes.filter("id % 50 = 0").select(F.col("id").alias("q"), F.col("small").alias("qsmall"))
    found: dict = {}
    for r in ann.greedy_search(asked, nodes, ann.neighbour_graph(nodes)).collect():
        found.setdefault(r.u, set()).add(r.v)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = {q: set(np.argsort(-(u @ u[q]))[1:6].tolist()) for q in found}
    assert len(found) == 50 and sum(len(true[q] & found[q]) for q in found) >= 0.9 * 250


def test_sentencepiece_round_trip_and_best(spark, docs):
    coded = sentencepiece_codec.encode_pieces(docs)
    back = sentencepiece_codec.decode_pieces(coded, out="again").select("text", "again").collect()
    assert all(r.text == r.again for r in back)
    c = sentencepiece_codec.codec(sentencepiece_codec.public_vocabulary())
    for t in ["a\u2581b  c\n\n d ", "\0 x", " lead", "日本 é\U0001f600", "\t"]:
        assert c.decode(c.encode(t)) == t
    score = {c.text[i].decode(): -np.log(2.0 - s) for i, s in _scores() if c.text[i] and i not in c.byte.tolist()}
    word = " thonder"

    def best(s):
        return 0.0 if not s else max((score[s[:k]] + best(s[k:]) for k in range(1, len(s) + 1) if s[:k] in score), default=-1e9)

    ids = c.encode(word[1:]).tolist()
    assert "".join(c.text[i].decode() for i in ids) == word
    assert sum(score[c.text[i].decode()] for i in ids) == pytest.approx(best(word))
    units = sorted((f" {a}{b}".encode() for a in ("thonder", "été", "日本x", "\u2581", "zq\0") for b in ("", "ing", "\U0001f600")), key=len, reverse=True)
    assert c.group(units) == [c.single(u) for u in units]


def _scores():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.public_vocabulary())
    return [(i, sp.get_score(i)) for i in range(sp.get_piece_size())]


def test_lm_scoring(spark, docs, none):
    rows = lm_scoring.score_documents(docs).collect()
    count: dict = {}
    src = docs.collect()
    held = lambda i: zlib.crc32(("null" if i is None else str(i)).encode()) % 7 == 2
    for r in src:
        if not held(r.doc_id):
            for w in [*(r.text or "").encode().lower().split(), None]:
                count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    want = []
    for r in src:
        w = [*(r.text or "").encode().lower().split(), None]
        want.append((len(w), sum(x in count for x in w), n, round(sum(np.log10((count.get(x, 0) + 1) / (n + v + 1)) for x in w), 6), held(r.doc_id)))
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), r.held_out) for r in rows) == sorted(want)
    assert all(np.isfinite(r.score) and r.score < 0 for r in rows)
    assert lm_scoring.score_documents(none).count() == 0

    runs = {k: Counter() for k in (1, 2, 3)}
    before = {k: Counter() for k in (2, 3)}
    for r in src:
        if not held(r.doc_id):
            s = ["open", "open", *(r.text or "").encode().lower().split(), "end"]
            for i in range(2, len(s)):
                for k in (1, 2, 3):
                    runs[k][tuple(s[i - k + 1 : i + 1])] += 1
                    if k > 1:
                        before[k][tuple(s[i - k + 1 : i])] += 1
    words = [x for (x,) in runs[1] if x != "end"]
    once, twice = (sum(runs[1][x,] == m for x in words) for m in (1, 2))
    d = once / (once + 2 * twice) if once else 0.5
    every = sorted({x for r in src for x in (r.text or "").encode().lower().split()})
    p = lm_scoring._pieces(lm_scoring.public_vocabulary())
    units = lm_scoring.expected_pieces(words, p, lm_scoring.vocabulary_weights(p))
    sub = dict(zip(every, lm_scoring.lattice(every, p, lm_scoring.gathered_weights(p, units, len(words))), strict=True))

    def score(text):
        s, out = ["open", "open", *(text or "").encode().lower().split(), "end"], 0.0
        for i in range(2, len(s)):
            prob = (max(runs[1][s[i],] - d, 0) + (d * v * np.exp(sub[s[i]]) if s[i] != "end" else 0)) / n
            for k, (a, b) in ((2, lm_scoring.PAIRS), (3, lm_scoring.TRIPLES)):
                m = before[k][tuple(s[i - k + 1 : i])]
                w = a * max(m, 1) ** b
                prob = (runs[k][tuple(s[i - k + 1 : i + 1])] + w * prob) / (m + w)
            out += np.log10(prob)
        return out

    assert np.allclose(sorted(r.score for r in rows), sorted(score(r.text) for r in src), rtol=1e-9)


def test_lattice_one_by_one_and_long_words():
    p = lm_scoring._pieces(lm_scoring.public_vocabulary())
    w = lm_scoring.vocabulary_weights(p)
    words = [f"x{i:02d}the".encode() for i in range(lm_scoring._FEW + 1)]
    assert np.allclose(lm_scoring.lattice(words, p, w), [lm_scoring._forward(x, p, w)[-1] + w.stop for x in words])
    one = np.zeros(p.size, np.int64)
    for x in words:
        lm_scoring._share_one(x, p, w, one)
    assert np.abs(one - lm_scoring.expected_pieces(words, p, w)).max() <= len(words)  # but for rounding
    long = lm_scoring.lattice([b"abcdefgh" * 20_000], p, w)
    assert np.isfinite(long).all() and long[0] < -1e5


def test_lattice_brute_force():
    p = lm_scoring._pieces(lm_scoring.public_vocabulary())
    w = lm_scoring.vocabulary_weights(p)
    ids ={lm_scoring._hash(x): x for x in [b"a"]}
    assert ids
    inner, first = _piece_maps(p)

    def rest(s):
        if not s:
            return np.exp(w.stop)
        return sum(np.exp(w.more + w.log[inner[s[:k]]]) * rest(s[k:]) for k in range(1, len(s) + 1) if s[:k] in inner) + np.exp(w.more + w.log[p.byte[s[0]]]) * rest(s[1:])

    words = [b"the", b"thnd,", "éa".encode(), b"zq"]
    want = [np.log(sum(np.exp(w.log[first[x[:k]]]) * rest(x[k:]) for k in range(len(x) + 1) if x[:k] in first)) for x in words]
    assert np.allclose(lm_scoring.lattice(words, p, w), want)

    def paths(s):  # the pieces of every segmentation of what follows, with its probability
        if not s:
            return [((), np.exp(w.stop))]
        arcs = [(k, inner[s[:k]]) for k in range(1, len(s) + 1) if s[:k] in inner] + [(1, int(p.byte[s[0]]))]
        return [((x, *rest), np.exp(w.more + w.log[x]) * q) for k, x in arcs for rest, q in paths(s[k:])]

    share = np.zeros(p.size)
    for word, total in zip(words, want, strict=True):
        for k in range(len(word) + 1):
            if word[:k] in first:
                for rest, q in paths(word[k:]):
                    for x in (first[word[:k]], *rest):
                        share[x] += np.exp(w.log[first[word[:k]]]) * q / np.exp(total)
    units = lm_scoring.expected_pieces(words, p, w)
    assert np.abs(units / lm_scoring._UNIT - share).max() < 1e-3
    g = lm_scoring.gathered_weights(p, units, len(words))
    assert all(np.isclose(np.exp(g.log[side]).sum(), 1) for side in (p.starts_word, ~p.starts_word))
    assert np.isclose(np.exp(g.stop) + np.exp(g.more), 1)
    none = lm_scoring.gathered_weights(p, np.zeros(p.size, np.int64), 0)  # nothing gathered: the vocabulary alone
    assert np.allclose(none.log, w.log) and np.isclose(none.stop, w.stop)


def _piece_maps(p):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=lm_scoring.public_vocabulary())
    inner, first = {}, {}
    for i in range(sp.get_piece_size()):
        t = sp.id_to_piece(i)
        if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)) and "\u2581" not in t[1:]:
            (first if t[0] == "\u2581" else inner)[t.removeprefix("\u2581").encode()] = i
    return inner, first


def test_added_columns_replace_clashes(spark):
    import pyarrow as pa

    df = spark.createDataFrame([("x", 1)], "text string, Score int")
    out = add_columns(df, ["text"], "score double", lambda a: [pa.array([0.5] * len(a[0]))])
    assert out.columns == ["text", "score"] and out.first().score == 0.5


def test_pipeline_stages(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    before = spark.read.parquet(f"{SF}/documents.parquet")
    kept = out.select("doc_id").distinct().count()
    assert 0.5 * before.count() < kept <= before.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "repeated_passages", "personal_data", "packing"]


def _jaccard(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_near_copies_brute_force(spark):
    import corpus_pipeline

    rng = np.random.default_rng(8)
    texts = []
    for base in range(12):
        words = [f"b{base}w{i}" for i in rng.integers(0, 400, int(rng.integers(3, 300)))]
        for rate in (0, 0, 0.005, 0.01, 0.02, 0.03, 0.05):
            texts.append(" ".join(w if rng.random() >= rate else f"new{rng.integers(1 << 30)}" for w in words))
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if _jaccard(texts[i], texts[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    groups: dict = {}
    for r in near_copies.near_copy_groups(df).collect():
        groups.setdefault(r.root, set()).add(r.id)
    want: dict = {}
    for i, r in enumerate(root):
        want.setdefault(r, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()}
    assert kept == {min(g) for g in want.values()}


def test_near_copies_come_from_simhash(spark, monkeypatch):
    """Without any band, fingerprints within two bits link what they can reach, verified by the sets."""
    rng = np.random.default_rng(12)
    texts = []
    for base in range(6):
        words = [f"b{base}w{i}" for i in rng.integers(0, 5000, 1500)]
        texts += [" ".join(words), " ".join([*words[:-1], "changed"])]
    short = [" ".join(f"s{i}{j}" for j in range(6)) for i in range(4)]
    df = spark.createDataFrame([*enumerate(texts + short), (99, None)], "doc_id bigint, text string")
    sets = near_copies._shingles([t.encode() for t in texts])
    fps = near_copies._fingerprints(sets)
    for s, f in zip(sets, fps.tolist(), strict=True):
        assert f == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in s.tolist()) > len(s))
    near = {i for i in range(0, 12, 2) if (int(fps[i]) ^ int(fps[i + 1])).bit_count() <= 2}
    monkeypatch.setattr(near_copies, "_shared", lambda batches: (b.slice(0, 0) for b in batches))
    root = {r.id: r.root for r in near_copies.near_copy_groups(df).collect()}
    assert near and {i for i in range(0, 12, 2) if root[i] == root[i + 1]} == near
    assert root.pop(99) is None and len(set(root.values())) == 16 - len(near)


def test_near_copies_keeps_rows_by_row(spark):
    import corpus_pipeline

    other = " ".join(f"x{i}" for i in range(30))
    lone = " ".join(f"y{i}" for i in range(30))
    rows = [(1, PASSAGE), (1, other), (2, PASSAGE), (None, PASSAGE), (None, lone), (None, lone), (3, None), (4, ""), (5, " \n"), (None, None), (6, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [tuple(r) for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, [(1, PASSAGE), (1, other), (None, lone), *rows[6:]]))
    assert corpus_pipeline.drop_near_copies(spark, df.limit(0), "").count() == 0


# --- faults that were found later ------------------------------------------------------


def test_addresses_with_other_letters(spark):
    """No part of an address stays in clear, each sign keeps its script, and different addresses stay different."""
    names = ["jörg", "É.Dupont", "иван.Петров", "δοκιμή", "花子", "han한글", "émilie", "jörg", "jorg", "ärger-1"]
    rows = [(i, f"to {n}@x.de, {n}@münchen.example end") for i, n in enumerate(names)]
    got = {r.doc_id: (r.text, r.n) for r in pii.pseudonymize(spark.createDataFrame(rows, "doc_id int, text string"), count_col="n").collect()}
    local = {i: t[3 : t.index("@")] for i, (t, _) in got.items()}
    for i, n in enumerate(names):
        assert got[i][1] == 2 and len(local[i]) == len(n) and got[i][0].endswith("@münchen.example end")
        run = lambda c: next((r for r in pii.RUNS if r[0] <= ord(c) < r[0] + r[1]), c)
        assert [run(c) for c in local[i]] == [run(c) for c in n]
        assert sum(a != b for a, b in zip(local[i], n, strict=True)) >= 1
    assert local[0] == local[7] and len(set(local.values())) == len(set(names))


def test_urls_keep_columns_of_any_name(spark):
    rows = [(1, "http://a.org/x", "h", "p", "b", "r"), (2, None, "h2", None, "b", "r")]
    df = spark.createDataFrame(rows, "page_id int, url string, __host string, url_path string, url_rule string, best string")
    got = {r.page_id: r for r in url_filter.judge_urls(df, url_filter.rules_frame(spark)).collect()}
    assert (got[1]["__host"], got[1].url_path, got[1].url_rule, got[1].best, got[1].host, got[1].path, got[1].verdict) == ("h", "p", "b", "r", "a.org", "/x", "allow")
    assert (got[2]["__host"], got[2].url_path, got[2].host, got[2].path) == ("h2", None, "", "")


def test_keep_first_keeps_columns_of_any_name(spark):
    rows = [(1, PASSAGE, "a", 5, 6), (2, PASSAGE, "b", 7, 8), (3, "other words " + " ".join(f"z{i}" for i in range(20)), "c", 9, 10)]
    df = spark.createDataFrame(rows, "doc_id int, text string, __row string, nth_of_row int, row_hash int")
    assert sorted(tuple(r) for r in near_copies.keep_first(df).collect()) == [rows[0], rows[2]]


def test_one_id_with_several_vectors(spark):
    """Each row of an id has the links of its own vector."""
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (3, [0.01, 1.0], 0), (4, [-1.0, 0.0], 0), (1, [1.0, 0.0], 0), (9, [0.0, 1.0], 1)]
    got = sorted(tuple(r) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id int, embedding array<double>, label int")).collect())
    assert got == [(1, 1, 1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 1, 1, False), (4, 0, 4, True), (9, 0, 9, True)]


def test_near_copies_leave_no_shuffle_files(spark):
    """Rounds read only what was materialized, so their shuffles do not pile up until the driver collects garbage."""

    def shuffles():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for i in range(files.size()) if (f := files.apply(i).getName()).startswith("shuffle_")}

    texts = [" ".join([*(f"b{i // 4}w{j}" for j in range(60)), f"end{i}"]) for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, set_to = shuffles(), spark.conf.get(name, None)
    groups = near_copies.near_copy_groups(df)
    for _ in range(50):  # files go in the background
        if shuffles() <= before:
            break
        time.sleep(0.1)
    assert shuffles() <= before
    assert spark.conf.get(name, None) == set_to
    root = {r.id: r.root for r in groups.collect()}
    assert len(set(root.values())) == 10 and all(root[i] == root[i - i % 4] for i in root)


def test_near_copies_leave_out_no_candidate(spark):
    """All classes of near fingerprints meet unless they are linked, not the least ones only; of a band, too."""
    fps = [0, 0, 0, 1 << 63, 3, 7, 1 << 40, (1 << 40) | 6]
    classes = [(i, 100 if i != 2 else 50, fp if fp < 1 << 63 else fp - (1 << 64), i if i != 1 else 0) for i, fp in enumerate(fps)]
    df = spark.createDataFrame(classes, "cls bigint, n bigint, fp bigint, root bigint")
    want = {(a[0], b[0]) for a in classes for b in classes if a[0] < b[0] and a[3] != b[3] and (fps[a[0]] ^ fps[b[0]]).bit_count() <= 2 and min(a[1], b[1]) >= 0.8 * max(a[1], b[1])}
    assert (1, 3) in want and {(r.u, r.v) for r in near_copies._rest(df).collect()} == want
    band = spark.createDataFrame([(9, i, 10, i // 3) for i in range(12)], "key bigint, cls bigint, n bigint, root bigint")
    got = near_copies._across(band, spark.createDataFrame([(9, 9)], "a bigint, b bigint")).collect()
    assert {(r.u, r.v) for r in got} == {(i, j) for j in range(12) for i in range(j) if i // 3 != j // 3}
