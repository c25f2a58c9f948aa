"""BM25 by rows against a plain version, and what its plans may hold."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.operators import lexical
from inkwell.plans.queries import QUERIES
from inkwell.sources import registry

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def plain_bm25(questions: dict, docs: list, k: int) -> list:
    """``docs`` are (id, words); those of one id and length are one."""
    merged: dict = {}
    for i, ws in docs:
        merged.setdefault((i, len(ws)), Counter()).update(ws)
    n, avgdl = len(merged), sum(dl for _, dl in merged) / len(merged)
    df = Counter(w for c in merged.values() for w in c)
    raw = {w: math.log((n - x + 0.5) / (x + 0.5)) for w, x in df.items()}
    floor = sum(raw.values()) / len(raw) * 0.25
    out = []
    for q, ws in questions.items():
        scores: dict = {}
        for (i, dl), c in merged.items():
            part = sum((floor if raw[w] < 0 else raw[w]) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * dl / avgdl)) for w in sorted(ws) if w in c)
            scores.setdefault(i, []).append(round(part, 6))
        best = sorted((-s, i) for i, x in scores.items() for s in x if s > 0)[:k]
        out += [(q, i, pytest.approx(-s, abs=2e-6), r + 1) for r, (s, i) in enumerate(best)]
    return out


def made(rng: random.Random, rows: int) -> list:
    words = [f"w{i}x" for i in range(60)]
    docs = [(i, rng.choices(words, [1 / (1 + w) for w in range(60)], k=rng.randint(0, 40))) for i in range(rows)]
    return docs + [(rows + i, docs[3 + i % 5][1]) for i in range(rows // 2)]  # copies, whose scores tie


@pytest.mark.parametrize("repeated", [False, True])
def test_bm25_gives_the_best_of_all_pairs(spark, repeated):
    r = random.Random(4)
    docs = made(r, 120)
    docs += [(5, docs[5][1]), (5, docs[6][1]), (9, [])] if repeated else []
    asked = {q: set(r.sample([f"w{i}x" for i in range(60)], 4)) | {"unknown"} for q in range(30)}
    corpus = spark.createDataFrame([(i, " ".join(ws) or None) for i, ws in docs], "d long, text string").repartition(5)
    # the items of one question in two rows count once
    questions = spark.createDataFrame([(q, " ".join(sorted(ws))) for q, ws in asked.items()] + [(0, " ".join(sorted(asked[0])[:2])), (99, None)], "q long, text string")
    got = sorted((x.q, x.rnk, x.d, x.score) for x in lexical.bm25(questions, corpus, "q", "d", 7).collect())
    want = sorted(((q, n, i, s) for q, i, s, n in plain_bm25(asked, docs, 7)), key=lambda x: x[:2])
    assert len(got) == len(want) and all(a == b for a, b in zip(got, want))


def test_blocks_give_the_same_rows(monkeypatch):
    """Whatever the cells, questions and hits that are held at once."""
    r = random.Random(8)
    docs = made(r, 90)
    r.shuffle(docs)
    text = pa.array([" ".join(ws).encode() for _, ws in docs])
    rows = list(lexical._counts([pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs]), text], ["d", "_text"])]))
    terms = sorted({w for _, ws in docs for w in ws})
    pairs = np.array(sorted((t, q) for q in range(12) for t in r.sample(range(len(terms)), 5)))

    def found(size):
        blocks = []
        for lo in range(0, 12, size):
            some = np.arange(lo, min(lo + size, 12))
            here = pairs[np.isin(pairs[:, 1], some)]
            blocks.append((some, np.searchsorted(here[:, 0], np.arange(len(terms) + 1)), np.searchsorted(some, here[:, 1])))
        model = lexical._Asked(pa.array(terms), np.linspace(0.5, 3, len(terms)), 20.0, blocks)
        best = lexical._Best(4, 12)
        for b in rows:
            for at in range(0, b.num_rows, 50):
                lexical._score(b.slice(at, 50), model, best, "d")
        q, ids, score = best.shrink()
        return list(zip(q.tolist(), ids.to_pylist(), score.tolist()))

    whole = found(12)
    assert len(whole) == 48
    monkeypatch.setattr(lexical, "CELLS", 37)
    monkeypatch.setattr(lexical, "PENDING", 10)
    assert found(5) == whole


def test_words_are_those_of_the_expressions(spark):
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["xa".join(every[i : i + 500]) for i in range(0, len(every), 500)]
    texts += ["", None, "The RATIONAL operations' payments, rings; a b cc 12 1 İstanbul Kelvin", "aational ings", "x" * 5000 + "ments"]
    x = spark.createDataFrame(list(enumerate(texts)), "d long, text string")
    got = {r.d: (r.dl, dict(zip(r.ts, r.tfs))) for r in lexical.term_rows(x, ["d"]).collect()}
    want = {r.d: (len(r.ts or []), dict(Counter(r.ts or []))) for r in x.select("d", T.tokens(F.col("text")).alias("ts")).collect()}
    assert got == want


@pytest.mark.parametrize("name", ["retrieval_quality", "hybrid_fusion", "bm25_topk"])
def test_neither_words_nor_pairs_are_shuffled(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    assert "MapInArrow" in text
    for node in ("SortMergeJoin", "ShuffledHashJoin", "BroadcastHashJoin", "BroadcastNestedLoopJoin"):
        assert node not in text


def test_registered_words_are_written_and_searched_where_they_are(spark, tmp_path):
    r = random.Random(6)
    docs = [(f"d{i % 3}", i, ws) for i, ws in made(r, 90)]
    chunks = spark.createDataFrame([(d, i, " ".join(ws)) for d, i, ws in docs] + [(None, 500, "w1x")], "doc string, item long, text string").repartition(4)
    shuffled = []
    write = lexical.term_rows
    with pytest.MonkeyPatch.context() as m:
        m.setattr(registry, "term_rows", lambda *a: shuffled.append(plan(x := write(*a))) or x)
        registry.register(chunks, str(tmp_path), "doc", "item", "text")
    assert len(shuffled) == 1 and "hashpartitioning" not in shuffled[0]  # the counts aren't dealt anew
    asked = {(q, f"d{q % 4}"): {f"w{i}x" for i in r.sample(range(60), 5)} for q in range(12)}
    asked[3, "d1"] = asked[3, "d3"]  # the same question of a second document: its best of both
    questions = spark.createDataFrame([(q, d, " ".join(ws)) for (q, d), ws in asked.items()] + [(77, None, "w1x")], "q long, doc string, text string")
    got = registry.lexical_search(questions, str(tmp_path), "q", "doc", k=6)
    hits: dict = {}
    for (q, d), ws in asked.items():
        if held := [(i, x) for e, i, x in docs if e == d]:
            hits.setdefault(q, []).extend((-s.expected, i, d) for _, i, s, _ in plain_bm25({q: ws}, held, 6))
    want = [(q, d, i, pytest.approx(-s, abs=2e-6), n + 1) for q in sorted(hits) for n, (s, i, d) in enumerate(sorted(hits[q])[:6])]
    found = sorted(((x.q, x.doc, x.item, x.score, x.rnk) for x in got.collect()), key=lambda x: (x[0], x[4]))
    assert len(found) == len(want) and all(a == b for a, b in zip(found, want))
    assert {x[1] for x in found} == {"d0", "d1", "d2"}
