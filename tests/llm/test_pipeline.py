"""Each stage of the pipeline against a plain version over its own input."""

import sys
from pathlib import Path

from plain import components, leaks, personal, targets, words

from inkwell.llm import toxicity
from inkwell.llm.common import Scratch, table

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs, at = table(spark, DATA, "documents"), Scratch(spark, "stages")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_copies", "benchmark_leaks", "personal_data", "mix"]
    items = [tuple(r) for r in table(spark, DATA, "benchmark").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        was = {r["doc_id"]: r for r in docs.collect()}
        out = at.put(stage(spark, docs, DATA), name)
        now = {r["doc_id"]: r for r in out.collect()}
        if name != "mix":
            assert out.columns == columns
        if name == "toxicity":
            scores = toxicity.toxicity(docs, toxicity.fit(docs, table(spark, DATA, "labels")))
            assert set(now) == {r["doc_id"] for r in scores.collect() if r["score"] < 0.5}
        if name == "near_copies":
            assert set(now) == {i for i, (_, c) in components({i: r["text"] for i, r in was.items()}).items() if i == c}
        if name == "benchmark_leaks":
            assert set(now) == {i for i, r in was.items() if not leaks(r["text"], items)}
        if name == "personal_data":
            assert set(now) == set(was) and all(not personal(r["text"]) for r in now.values())
            assert all(now[i]["text"] == r["text"] or personal(r["text"]) or "[" in now[i]["text"] for i, r in was.items())
        if name == "mix":
            size = {}
            for r in was.values():
                size[r["source"]] = size.get(r["source"], 0) + len(words(r["text"]))
            order = sorted(size, key=lambda s: (s is None, s))
            want = dict(zip(order, targets([size[s] for s in order]), strict=True))
            assert all(abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]]) and 0 < r["taken"] <= 3 * r["size"] for r in now.values())
            for s in size:
                assert abs(sum(r["taken"] for r in now.values() if r["source"] == s) - want[s]) <= 0.02 * want[s] + 5
        docs = out


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0
