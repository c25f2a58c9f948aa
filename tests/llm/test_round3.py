"""The filter audit, the language model and collocations against plain versions, with odd rows."""

import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkwell.llm import collocations, filter_audit, language_model, vocabulary, words
from inkwell.llm.elias_fano import EliasFano
from inkwell.llm.queries import QUERIES

from plain import WORD
from plain import words as lowered

DOCS = "doc_id long, text string, lang string, source string"
LABELS = "doc_id long, quality int, toxic int"
ODD = [(None, None, None, "a"), (1, "", "en", "a"), (2, "one two three", "en", None), (2, "one two three", "en", None), (2, "other", "", "a"), (3, "one two three", None, "a"), (4, "x " * 300, "en", "b"), (None, "x " * 300, "de", "b"), (5, "É# " * 150 + "A" * 3_000 + " end", "de", "c"), (6, "\x00 a\x0bb\x1cc | d", "fr", "c")]


def lines(seed: int, rows: int) -> list[tuple]:
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdeé", k=rng.randint(1, 4))) for _ in range(60)]
    out = []
    for i in range(rows):
        ws = rng.choices(vocab, [1 / (k + 1) for k in range(60)], k=rng.randint(0, 400))
        text = "".join(w.capitalize() * (rng.random() < 0.1) or w + rng.choice([" ", " ", "  ", "\n", ". ", ",", "\t"]) for w in ws)
        out.append((i, text, rng.choice(["en", "de", None]), "s"))
    return out + [(rows + k, out[k][1], out[k][2], "s") for k in range(0, rows, 5)]


def plain_audit(docs: list[tuple], labels: list[tuple]) -> set[tuple]:
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, t, *_ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    rows = []
    for i, t, lang, _ in docs:
        t = t or ""
        ws = WORD.findall(t)
        fails = {c for c, f in zip("ABCDE", (len(ws) < 200, 100 * len(set(ws)) < 50 * len(ws), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and i > first[t]), strict=True) if f}
        rows.append((lang or "", fails, i in good, i in toxic))
    out = set()
    orders = ["".join(p) for p in permutations("ABCDE")]
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        shapley = Counter()
        for order in orders:
            for _, fails, *_ in own:
                hit = next((c for c in order if c in fails), None)
                shapley[hit] += hit is not None
        for order in orders:
            for k, c in enumerate(order):
                gone = [bool(r[1] & set(order[:k])) for r in own]
                here = [c in r[1] and not g for r, g in zip(own, gone, strict=True)]
                out.add((part, order, k + 1, sum(not g and not h for g, h in zip(gone, here, strict=True)), sum(here), sum(c in r[1] and g for r, g in zip(own, gone, strict=True)), sum(r[1] == {c} for r in own), sum(h and r[2] for r, h in zip(own, here, strict=True)), sum(h and r[3] for r, h in zip(own, here, strict=True)), shapley[c]))
    return out


@pytest.mark.parametrize("docs", [ODD, lines(3, 40), [], [(1, None, None, None)]])
def test_filter_audit(spark, docs):
    labels = [(2, 1, 0), (2, 0, 1), (4, 1, 1), (None, 1, 1), (7, 0, 1), (9, 1, 0)]
    got = filter_audit.filter_audit(spark.createDataFrame(docs, DOCS).withColumnRenamed("source", "mask"), spark.createDataFrame(labels, LABELS))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {tuple(r) for r in got.collect()} == plain_audit(docs, labels)


def test_equal_hashes_are_verified(monkeypatch):
    texts = pa.array(["a b a c", "long" * 400 + " x " + "long" * 400, None, "b b"])
    data, offsets = words.buffers(texts)
    starts, ends, row = words.spans(data, offsets, words.BLANK)
    x, lanes = words.padded(data)
    want = [3, 2, 0, 1]
    assert list(filter_audit.distinct_words(x, lanes, starts, ends, row, 4)) == want
    monkeypatch.setattr(words, "hashes", lambda *a: np.zeros(len(a[2]), np.uint64))
    assert list(filter_audit.distinct_words(x, lanes, starts, ends, row, 4)) == want


def plain_collocations(docs: list[tuple], least: int = 10, top: int = 2_000) -> list[tuple]:
    f, n = Counter(), Counter()
    for _, t, lang, _ in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (t or "").translate({c: c + 32 for c in range(65, 91)})):
            ws = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(ws)
            f.update((lang, *ws[i : i + k]) for k in (1, 2, 3) for i in range(len(ws) - k + 1))
    cands = {g: a for g, a in f.items() if len(g) > 2 and a >= least}
    rows = []
    for g, a in cands.items():
        if len(g) == 3 and any(len(h) == 4 and h[0] == g[0] and g[1:] in (h[1:3], h[2:]) and 100 * b >= 50 * a for h, b in cands.items()):
            continue
        cuts = [(1_000_000 * a * a // (f[g[: k + 1]] * f[(g[0], *g[k + 1 :])]), k, f[g[: k + 1]], f[(g[0], *g[k + 1 :])]) for k in range(1, len(g) - 1)]
        score, _, left, right = min(cuts)
        rows.append((g[0], score, a, " ".join(g[1:]), left, right))
    out = []
    for lang in n:
        own = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[1], -r[2], r[3].encode()))
        out += [(lang, i + 1, p, a, left, right, n[lang], s) for i, (_, s, a, p, left, right) in enumerate(own[:top])]
    return sorted(out)


@pytest.mark.parametrize(("docs", "top", "step"), [(lines(5, 60), 2_000, 1 << 20), (lines(6, 40), 15, 97), (ODD, 2_000, 1 << 20), ([], 2_000, 1 << 20)])
def test_collocations(spark, monkeypatch, docs, top, step):
    monkeypatch.setattr(collocations, "STEP", step)
    monkeypatch.setattr(collocations, "SHARD", 3_000)  # frequent first words are split
    got = collocations.collocations(spark.createDataFrame(docs, DOCS).withColumnRenamed("source", "word"), top=top)
    assert sorted(tuple(r) for r in got.collect()) == plain_collocations(docs, top=top)


def test_scores_past_64_bits(spark):
    a = 3_000_000_000_000
    got = spark.createDataFrame([(a, 2 * a, 5 * a)], "a long, l long, r long").select(collocations.cohesion(*map(F.col, "alr"))).first()[0]
    assert got == 1_000_000 * a * a // (10 * a * a)


def test_ids_that_clash(monkeypatch):
    """Where an id has several words, those are counted apart under other ids."""
    true = vocabulary.Reader.hashes
    monkeypatch.setattr(vocabulary.Reader, "hashes", lambda self, lo, hi, seed: true(self, lo, hi, seed) if seed else true(self, lo, hi, seed) % np.uint64(7))
    texts = pa.table({"part": ["", ""], "text": ["a b c d e f g h a", "a k l m n o p q"]})
    r = vocabulary.Reader(texts["part"].combine_chunks(), texts["text"].combine_chunks(), words.BLANK, np.arange(7, dtype=np.uint64))
    assert len(set(r.ids(0, 17).tolist())) == 15


@pytest.mark.parametrize("key", [[], [5], [3, 1, 3, 2**64 - 1, 1], [2**63 + 4, 2**63, 2**63 + 4, 2**63 + 1], list(range(50)) * 3])
def test_runs(key):
    key = np.array(key, np.uint64)
    order, begins = vocabulary.runs(key)
    assert order.tolist() == np.argsort(key, kind="stable").tolist()
    assert key[order[begins]].tolist() == sorted(set(key.tolist()))


@pytest.mark.parametrize("top", [0, 3, 1_000, 2**40, 2**64 - 1])
def test_elias_fano(top):
    rng = np.random.default_rng(top % 97)
    for n in (0, 1, 2, 500, 4_000):
        v = np.sort(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
        e, keys = EliasFano(v), np.concatenate((v, rng.integers(0, top, 300, dtype=np.uint64, endpoint=True)))
        assert (e.get(np.arange(n)) == v).all()
        assert (e.successor(keys) == np.searchsorted(v, keys)).all()
        assert ((e.find(keys) >= 0) == np.isin(keys, v)).all()


def plain_lm(docs: list[tuple]) -> list[tuple]:
    """Contexts as tuples in dictionaries; probabilities unquantised."""
    learnt = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 5 != 1
    toks = [(i, [*lowered(t), "\x00end\x00 "]) for i, t, *_ in docs]
    c1, c2, c3, after2, after3 = Counter(), Counter(), Counter(), {}, {}
    past2, past3 = Counter(), Counter()
    for i, ws in toks:
        if learnt(i):
            c1.update(ws)
            for k in range(1, len(ws)):
                p, h = ws[k - 1], (ws[k - 2] if k > 1 else None, ws[k - 1])
                c2[p, ws[k]] += 1
                c3[h, ws[k]] += 1
                past2[p] += 1
                past3[h] += 1
                after2.setdefault(p, set()).add(ws[k])
                after3.setdefault(h, set()).add(ws[k])
    n, v, d = sum(c1.values()), len(c1), language_model.DISCOUNT
    out = []
    for i, ws in toks:
        base = [math.log10((c1[x] + 0.5) / (n + 0.5 * (v + 1))) for x in ws]
        score = 0.0
        for k, b in enumerate(base):
            p = 10**b
            if k:
                a, h = ws[k - 1], (ws[k - 2] if k > 1 else None, ws[k - 1])
                if past2[a]:
                    p = max(c2[a, ws[k]] - d, 0) / past2[a] + min(1, d * len(after2[a]) / past2[a]) * p
                if past3[h]:
                    p = max(c3[h, ws[k]] - d, 0) / past3[h] + min(1, d * len(after3[h]) / past3[h]) * p
            score += math.log10(p)
        out.append((i, not learnt(i), len(ws), sum(c1[x] > 0 for x in ws), n, sum(base), score))
    return out


@pytest.mark.parametrize(("docs", "step", "hot"), [(lines(8, 60), 1 << 20, 262_143), (lines(9, 40), 101, 12), (ODD, 1 << 20, 2), ([], 1 << 20, 9), ([(1, None, None, None)], 1 << 20, 9)])
def test_lm_scoring(spark, monkeypatch, tmp_path, docs, step, hot):
    monkeypatch.setattr(language_model, "STEP", step)
    monkeypatch.setattr(language_model, "SHARD", 2_000)
    monkeypatch.setattr(language_model, "frequent", lambda v, most: vocabulary.frequent(v, hot))
    spark.createDataFrame(docs, DOCS).withColumnRenamed("source", "digest").write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda r: (str(r[0]), r[2], r[5])
    got, want = sorted((tuple(r) for r in QUERIES["op12_lm_scoring"](spark, str(tmp_path)).collect()), key=key), sorted(plain_lm(docs), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want, strict=True):
        assert g[5] == pytest.approx(w[5], rel=1e-9)
        assert g[6] == pytest.approx(w[6], abs=1.3e-4 * w[2])  # a step of the stored probabilities for each token, at most


@pytest.mark.parametrize(("step", "hot"), [(1 << 20, 262_143), (101, 12)])
def test_scores_do_not_depend_on_classes(spark, monkeypatch, step, hot):
    """The places of frequent contexts are dealt by the word before them, and every score stays that of the whole corpus."""
    from pyspark import cloudpickle

    docs = lines(10, 80)
    monkeypatch.setattr(language_model, "STEP", step)
    monkeypatch.setattr(language_model, "SHARD", 500)
    monkeypatch.setattr(language_model, "frequent", lambda v, most: vocabulary.frequent(v, hot))
    df = spark.createDataFrame(docs, DOCS)
    cloudpickle.register_pickle_by_value(language_model)  # so that workers have the changed CLASS too
    try:
        got = []
        for size in (20, 10**9):
            monkeypatch.setattr(language_model, "CLASS", size)
            rows = language_model.lm_scores(df, F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 != 1).collect()
            got.append(sorted(((r["doc_id"], r["n_tokens"], r["base_score"], r["score"]) for r in rows), key=lambda r: (str(r[0]), r[1], r[2])))
    finally:
        cloudpickle.unregister_pickle_by_value(language_model)
    want = sorted(((r[0], r[2], r[5], r[6]) for r in plain_lm(docs)), key=lambda r: (str(r[0]), r[1], r[2]))
    for cut, uncut, plain in zip(*got, want, strict=True):
        assert cut[:2] == uncut[:2] == plain[:2]
        assert cut[3] == pytest.approx(uncut[3], rel=1e-9)
        assert cut[3] == pytest.approx(plain[3], abs=1.3e-4 * plain[1])


def test_classes_of_history_still_sum_to_one():
    """With the words before it in classes, the probabilities after a context sum to 1, but for the steps they are kept in."""
    rng = np.random.default_rng(4)
    ids = rng.integers(1, 2**63, 30).astype(np.uint64)
    w = language_model.Words(ids[:10], np.full(10, 3 * language_model.CLASS))
    seq = rng.choice(ids, 5_000, p=(x := 1 / np.arange(1, 31)) / x.sum())
    ctx = w.context(seq[1:-1], w.codes(seq[1:-1]), seq[:-2])
    assert len(np.unique(ctx)) > 30
    trie = language_model.Trie(language_model.Keys(ctx, seq[:-2], seq[2:]), np.ones(len(ctx), np.int64))
    for i in range(0, 200, 7):
        p = trie.probability(language_model.Keys(np.repeat(ctx[i], 30), np.repeat(seq[i], 30), ids), np.full(30, 1 / 30))
        assert p.sum() == pytest.approx(1, abs=2e-3)
