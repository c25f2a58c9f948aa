"""Model calls: stores, gates, parsed replies, narratives, extraction, alignment without loss, registries."""

import json
import os
import random
import re
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from inkwell.operators import evidence, grading, models, replies, spans
from inkwell.sources import registry

ROOT = Path(__file__).resolve().parents[1]


def lcs(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def plain_place(quote: str, text: str, cutoff: float):
    """All windows of the quote's length, and the cut ones at both ends."""
    if len(text) < len(quote):
        hit = plain_place(text, quote, cutoff)
        return hit and (0, len(text), hit[2])
    m, n = len(quote), len(text)
    windows = [(s, s + m) for s in range(n - m + 1)] + [(0, k) for k in range(1, m)] + [(n - k, n) for k in range(1, m)]
    best = max((200 * lcs(quote, text[a:b]) / (m + b - a), -a, b) for a, b in windows)
    return (-best[1], best[2], best[0]) if best[0] >= cutoff else None


def test_best_place_misses_nothing():
    rng = random.Random(4)
    hits = 0
    for i in range(250):
        quote = "".join(rng.choices("abcde ", k=rng.randint(3, 24))).strip() or "a"
        noise = lambda k: "".join(rng.choices("abcdefgh ", k=k))
        edited = list(quote)
        for _ in range(rng.randint(0, len(quote) // 3)):
            j = rng.randrange(len(edited))
            edited[j] = rng.choice(["", rng.choice("xyz"), edited[j] + "z"])
        text = noise(rng.randint(0, 40)) + "".join(edited)[rng.randint(0, 3) if i % 5 == 0 else 0 :] + noise(rng.randint(0, 40))
        got, want = evidence.best_place(quote, text, 70.0), plain_place(quote, text, 70.0) if text else None
        assert (got is None) == (want is None), (quote, text)
        if got:
            hits += 1
            assert got[2] == pytest.approx(want[2]) and 200 * lcs(quote, text[got[0] : got[1]]) / (len(quote) + got[1] - got[0]) == pytest.approx(100.0 if quote in text else got[2]) or len(text) < len(quote)
    assert hits > 100


def test_an_edit_in_every_third_word(spark):
    """No run of three words is left whole; every quote is found all the same."""
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(4, 9))) for _ in range(300)]
    rows = []
    for i in range(30):
        ws = rng.choices(words, k=15)
        changed = [w[:-1] + "z" if k % 3 == 1 else w for k, w in enumerate(ws)]
        rows.append((i, " ".join(ws), "  ".join(rng.choices(words, k=40)) + "\n" + " \t".join(changed) + " " + " ".join(rng.choices(words, k=40))))
    got = evidence.align_pairs(spark.createDataFrame(rows, "id long, quote string, text string"), ["id"]).collect()
    assert len(got) == 30
    for r in got:
        quote, text = rows[r["id"]][1:]
        at = text.index("\n")
        assert r["score"] >= 88 and abs(r["start"] - at - 1) <= 3 and r["label"] in ("grounded", "partial")


def test_pairs_odd_rows(spark):
    rows = [(1, None, "text"), (1, "quote of some length", None), (2, "short", "short"), (3, "Twelve chars", "Twelve\n\n chars here"), (3, "Twelve chars", "Twelve\n\n chars here"), (4, "Twelve chars", "")]
    got = evidence.align_pairs(spark.createDataFrame(rows, "id long, quote string, text string"), ["id"]).collect()
    assert [(r["id"], r["start"], r["end"], r["score"], r["label"]) for r in got] == [(3, 0, 14, 100.0, "grounded")]


def counting(path: Path, fail=lambda p: False):
    """A model that notes each prompt that it is sent in a file of its own."""

    def model(ps: list[str]) -> list[str]:
        for p in ps:
            if fail(p):
                raise RuntimeError("down")
        for p in ps:
            with open(path, "a") as f:
                f.write(p + "\n")
        return [f"re {p}" for p in ps]

    return model


def test_store_sends_nothing_twice(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"p{i % 20}" if i % 7 else None) for i in range(60)], "id long, p string")
    gate = replies.Gate(batch=3, tries=1, wait=0.0, shut=10**6)
    half = counting(tmp_path / "log", lambda p: p.endswith("3"))
    first = replies.with_replies(rows, F.col("p"), half, str(tmp_path / "s"), gate=gate).collect()
    assert {r["p"] for r in first if r["p"] and r["reply"] is None} == {r["p"] for r in first if r["p"] and (r["p"].endswith("3") or (r["error"] and "down" in r["error"]))}
    sent = (tmp_path / "log").read_text().split()
    assert len(sent) == len(set(sent))
    again = replies.with_replies(rows, F.col("p"), counting(tmp_path / "log2"), str(tmp_path / "s"), gate=gate).collect()
    assert set((tmp_path / "log2").read_text().split()) == {r["p"] for r in first if r["p"]} - set(sent)  # only what failed
    assert all(r["reply"] == f"re {r['p']}" and r["error"] is None for r in again if r["p"]) and all(r["reply"] is None and r["error"] is None for r in again if not r["p"])
    last = replies.with_replies(rows, F.col("p"), counting(tmp_path / "log3"), str(tmp_path / "s"), gate=gate).collect()
    assert not (tmp_path / "log3").exists() and len(last) == 60
    other = replies.with_replies(rows.limit(5), F.col("p"), None, str(tmp_path / "s"), name="another").collect()
    assert {r["error"] for r in other if r["p"]} == {"no model"}


def test_store_after_a_killed_run(spark, tmp_path):
    """A worker dies in the third append; what the first two held isn't sent again."""
    rows = spark.createDataFrame([(i, f"p{i}") for i in range(40)], "id long, p string")
    slot = {r["p"]: r["s"] for r in rows.select("p", F.pmod(F.xxhash64(replies.reply_key(F.col("p"), "model")), F.lit(4)).alias("s")).collect()}
    deadly = {p for p, s in slot.items() if s == 2}

    def model(ps: list[str]) -> list[str]:
        if deadly & set(ps):
            os._exit(3)
        return [f"old {p}" for p in ps]

    with pytest.raises(Exception):  # noqa: B017, PT011
        replies.with_replies(rows, F.col("p"), model, str(tmp_path / "s"))
    got = replies.with_replies(rows, F.col("p"), counting(tmp_path / "log"), str(tmp_path / "s")).collect()
    assert set((tmp_path / "log").read_text().split()) == {p for p, s in slot.items() if s >= 2}
    assert all(r["reply"] == ("old " if slot[r["p"]] < 2 else "re ") + r["p"] for r in got)


def test_gate():
    waits: list[float] = []
    calls = {"n": 0}

    def twice(ps: list[str]) -> list[str]:
        calls["n"] += 1
        if calls["n"] <= 2:
            raise OSError("busy")
        return ps

    assert list(replies.called(twice, ["a"], replies.Gate(tries=3, wait=1.0), waits.append)) == [("a", None, 3)] and waits == [1.0, 2.0]
    gone = {"n": 0}

    def never(ps: list[str]) -> list[str]:
        gone["n"] += 1
        raise OSError("gone")

    out = list(replies.called(never, [str(i) for i in range(50)], replies.Gate(batch=4, tries=2, wait=0, shut=6), lambda _: None))
    assert [e for _, e, _ in out] == ["OSError('gone')"] * 6 + ["unavailable"] * 44 and gone["n"] == 8  # two batches and six retries
    half = lambda ps: ps[: (len(ps) + 1) // 2]
    assert [r for r, _, _ in replies.called(half, list("abcde"), replies.Gate(wait=0), lambda _: None)] == list("abcde")
    nulls = list(replies.called(lambda ps: [None if p == "b" else p for p in ps], list("abc"), replies.Gate(tries=2, wait=0), lambda _: None))
    assert nulls == [("a", None, 1), (None, "no reply", 2), ("c", None, 1)]


def test_paraphrases(spark):
    said = {"q1": json.dumps(["b", " c ", "b", 5, None, {"x": 1}, "", "q1"]), "q2": "```json\n[\"x\"]\n```", "q3": "x\ny", "q4": '{"a": ["x"]}', "q5": json.dumps([f"v{i}" for i in range(9)])}
    q = spark.createDataFrame([(k, f" {k} ") for k in said], "id string, text string")
    got = models.expanded(q, lambda ps: [said[p] for p in ps], "id").orderBy("id", "pos").collect()
    by = {k: [r["sub_query"] for r in got if r["id"] == k] for k in said}
    assert by == {"q1": ["q1", "b", "c"], "q2": ["q2", "x"], "q3": ["q3"], "q4": ["q4"], "q5": ["q5", *(f"v{i}" for i in range(9))]}


def test_answers(spark):
    said = {"c\n\na": '```json\n{"answer": "yes", "confidence_score": 0.7, "document_title": "T"}\n```', "c\n\nb": "prose", "c\n\nd": '{"answer": "x", "confidence_score": 3}'}
    q = spark.createDataFrame([("a", "c"), ("b", "c"), ("d", "c"), ("e", "c"), ("f", " ")], "q string, c string")

    def model(ps: list[str]) -> list[str | None]:
        return [said.get(p) for p in ps]

    got = {r["q"]: r["parsed"] for r in models.answered(q, model, "q", "c").collect()}
    assert (got["a"]["document_title"], got["a"]["answer"], got["a"]["confidence_score"]) == ("T", "yes", 0.7)
    assert got["b"]["document_title"] == got["d"]["document_title"] == "PARSE_ERROR" and got["b"]["confidence_score"] == 0.0 and got["b"]["answer"].endswith("prose")
    assert got["e"] is None and got["f"] is None


def plain_parts(text: str, most: int) -> list[str]:
    if len(text) <= most:
        return [text]
    out: list[list[str]] = []
    for line in text.split("\n"):
        if not out or sum(len(x) + 1 for x in out[-1]) + len(line) > most:
            out.append([])
        out[-1].append(line)
    return ["\n".join(p) for p in out]


def plain_narrative(text: str, note, most: int) -> tuple[str, int, int]:
    parts, rounds = plain_parts(text, most), 0
    passes = len(parts)
    while True:
        notes = [note(p) for p in parts]
        joined = "\n\n".join(notes)
        if len(parts) == 1:
            return joined, passes, rounds
        nxt = plain_parts(joined, most)
        if len(nxt) >= len(parts):
            return joined, passes, rounds
        parts, rounds = nxt, rounds + 1


def test_narratives(spark):
    rng = random.Random(3)
    texts = {f"q{i}": "\n".join("w" * rng.randint(0, 60) for _ in range(n)) for i, n in enumerate([1, 2, 5, 30, 80])} | {"long": "z" * 500 + "\nend", "blank": ""}
    rows = [(k, 0, t[: len(t) // 2]) for k, t in texts.items()] + [(k, 1, t[len(t) // 2 :]) for k, t in texts.items()] + [("none", 0, None)]
    parts = spark.createDataFrame(rows, "q string, no long, text string")
    for note in (lambda p: p[:20], lambda p: p):
        got = {r["q"]: (r["narrative"], r["passes"], r["rounds"]) for r in models.map_reduced(parts, lambda ps, n=note: [n(p) for p in ps], "q", "no", "text", 100).collect()}
        assert got == {k: plain_narrative(t[: len(t) // 2] + "\n" + t[len(t) // 2 :], note, 100) for k, t in texts.items()}
    assert {r["q"] for r in models.map_reduced(parts, None, "q", "no", "text", 100).collect()} == set(texts)


def test_generative_extraction(spark):
    view = "The subject must be at least eighteen years of age. Prior therapy is not allowed within four weeks."
    said = json.dumps({"title": "t", "groups": [{"heading": "H", "items": [{"text": "adult", "evidence": "at least eighteen years of age"}, {"text": "again", "evidence": "at least eighteen years of age"}]}, {"heading": "none", "items": []}, {"items": [{"text": "therapy", "evidence": "Prior therapy was not alowed within 4 weeks"}, {"text": "Bananas grow on mars"}]}]})
    q = spark.createDataFrame([("q", "p", view), ("r", "bad", view)], "q string, p string, view string")
    segs = spark.createDataFrame([("q", 1_000, 1_060, 0), ("q", 5_000, 5_100, 60)], "q string, doc_start long, doc_end long, view_start long")
    got = models.generative_extraction(q, lambda ps: [said if p == "p" else "prose" for p in ps], "q", F.col("p"), "view", segs).orderBy("item_id").collect()
    assert [(r["item_id"], r["heading"], r["text"], r["grounding"]) for r in got] == [("i0000", "H", "adult", "grounded"), ("i0001", "H", "again", "grounded"), ("i0002", "Findings", "therapy", "partial"), ("i0003", "Findings", "Bananas grow on mars", "ungrounded")]
    at = view.index("at least")
    assert (got[0]["start"], got[0]["end"], got[0]["doc_start"], got[0]["doc_end"]) == (at, at + 30, 1_000 + at, 1_030 + at) and got[1]["start"] == at
    assert got[3]["start"] is None and got[3]["doc_start"] is None and got[3]["score"] == 0.0


def test_best_document_and_rates_by_similarity(spark):
    quote = "the washout period is fourteen days before the first dose"
    pairs = spark.createDataFrame([(1, 1, quote, f"x {quote} y"), (1, 2, quote, quote.replace("fourteen", "forteen")), (1, 3, quote, "nothing at all in here that is like it")], "q long, doc long, quote string, text string")
    found = evidence.align_pairs(pairs, ["q", "doc"])
    assert {r["doc"]: r["score"] for r in found.collect()} == {1: 100.0, 2: pytest.approx(98.2, abs=0.1)}
    best = spans.best_document(found, spark.createDataFrame([(1, 2)], "q long, doc long"), "q", "doc", "score").first()
    assert (best["doc"], best["adj_score"]) == (1, 100.0)  # a preferred document's bonus of 1.5 doesn't reach it
    assert spans.best_document(found.where("doc > 1"), pairs.select("q", "doc"), "q", "doc", "score").first()["adj_score"] == pytest.approx(99.7)
    rates = spans.alignment_rates(pairs.select(F.lit(7).alias("question"), "q").distinct(), pairs.select(F.lit(7).alias("question"), "doc").distinct(), found, "question", "q", "doc", "score").first()
    assert (rates["rate"], rates["utilisation"]) == (1.0, 0.6667)


def test_registry_reads_what_is_asked(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i % 40}", i, f"word{i % 7} common text {i}", [float(i), 1.0]) for i in range(200)], "doc string, item long, text string, embedding array<double>")
    folder = str(tmp_path / "r")
    registry.register(docs.where("doc < 'd3'"), folder, "doc", "item", "text", "embedding")
    registry.register(docs.where("doc >= 'd3'"), folder, "doc", "item", "text", "embedding")
    registry.register(docs.where("doc = 'd1'").withColumn("embedding", F.array(F.lit(-1.0), F.lit(0.0))), folder, "doc", "item", "text", "embedding")
    assert registry.registered(spark, folder).agg(F.count(F.lit(1)), F.sum("chunks")).first() == (40, 200)
    q = spark.createDataFrame([(1, "d5", [1.0, 0.0], "word5 text"), (2, "d1", [1.0, 0.0], "word1"), (3, "nowhere", [1.0, 0.0], "word1")], "q long, doc string, v array<double>, text string")
    hits = registry.dense_search(q, folder, "q", "doc", "v", 3)
    assert [(r["q"], r["item"], r["score"]) for r in hits.orderBy("q", "rnk").collect()] == [(1, 165, 165.0), (1, 125, 125.0), (1, 85, 85.0), (2, 1, -1.0), (2, 41, -1.0), (2, 81, -1.0)]
    plan = hits._jdf.queryExecution().executedPlan().toString()
    slots = {r["doc"]: r["slot"] for r in registry.registered(spark, folder).collect()}
    read = re.search(r"PartitionFilters: \[[^\]]*slot#\d+ IN \(([\d,]+)\)", plan)
    assert set(map(int, read[1].split(","))) == {slots["d5"], slots["d1"]}
    words = registry.lexical_search(q, folder, "q", "doc").collect()
    assert {(r["q"], r["doc"]) for r in words} <= {(1, "d5"), (2, "d1")} and all(r["score"] > 0 for r in words)
    assert registry.registered(spark, str(tmp_path / "none")).collect() == []


def plain_bm25(chunks: dict, tokens: list[str]) -> dict:
    """One document's retriever, by its own counts."""
    import math

    n, avg = len(chunks), sum(map(len, chunks.values())) / len(chunks)
    df = {t: sum(t in c for c in chunks.values()) for c in chunks.values() for t in c}
    raw = {t: math.log((n - d + 0.5) / (d + 0.5)) for t, d in df.items()}
    low = 0.25 * sum(raw.values()) / len(raw)
    idf = {t: low if v < 0 else v for t, v in raw.items()}
    return {i: sum(idf[t] * c.count(t) * 2.5 / (c.count(t) + 1.5 * (0.25 + 0.75 * len(c) / avg)) for t in set(tokens) if t in c) for i, c in chunks.items()}


def test_registry_words_by_document(spark, tmp_path):
    rng = random.Random(1)
    vocab = ["apple", "river", "stone", "cloud", "tiger", "green", "paper"]
    docs = [(f"d{i % 3}", i, " ".join(rng.choices(vocab[i % 3 :], k=rng.randint(1, 9)))) for i in range(24)]
    registry.register(spark.createDataFrame(docs, "doc string, item long, text string"), str(tmp_path), "doc", "item", "text")
    got = registry.lexical_search(spark.createDataFrame([(1, "d0", "apple river river paper"), (2, "d2", "tiger")], "q long, doc string, text string"), str(tmp_path), "q", "doc").collect()
    for q, doc, ws in ((1, "d0", ["apple", "river", "paper"]), (2, "d2", ["tiger"])):
        want = {i: round(s, 6) for i, s in plain_bm25({i: t.split() for d, i, t in docs if d == doc}, ws).items() if s > 0}
        assert {r["item"]: r["score"] for r in got if r["q"] == q} == pytest.approx(want, abs=2e-6)


def test_reasons(spark):
    rows = [(True, 0.5, 0.25, 2, 1, 0.9, 0, False), (False, 0.9, 0.0, 0, 0, 0.9, 3, False), (True, 0.9, 0.0, 0, 0, 0.5, 0, False), (True, 0.9, 0.0, 0, 0, 0.9, 0, True), (True, 0.9, 0.0, 0, 0, 0.9, 0, False)]
    x = spark.createDataFrame(rows, "has_context boolean, grounding double, weak double, unsupported long, contradicted long, judge double, uncovered long, admits boolean")
    got = [(r["tags"], r["reasons"]) for r in grading.error_reasons(grading.error_tags(x)).collect()]
    assert got == [("partial_retrieval, contradiction", "grounding 50%, weak 25%; 1 contradicted claims"), ("retrieval_failure, coverage_gap", "no context; 3 requirements uncovered"), ("misinterpretation", "judges 50%"), ("missing_context", "the answer says that the context lacks it"), ("", "")]


def test_workers_get_the_package(tmp_path):
    """A session that knows nothing of this repository's folder runs what needs Python workers."""
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from inkwell.plans.queries import QUERIES
for name in ("align_fuzzy", "section_chunks", "align_pairs", "section_items"):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").limit(3).collect()
print("all there")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=500)
    assert "all there" in done.stdout, done.stderr[-2000:]
