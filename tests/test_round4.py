"""What the findings of round 3 name."""

import random
import time

from pyspark.sql import functions as F

from inkwell.operators import evidence, items, models, packing, ranking, rendering, retrieval
from inkwell.plans.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def vectors(spark):
    """Vectors in three groups, many of them copies, one null; scores that meet at the sixth decimal."""
    r = random.Random(3)
    rows = [(i, i % 3, [r.uniform(-1, 1) for _ in range(5)]) for i in range(120)]
    rows += [(i, i % 3, rows[7][2]) for i in range(120, 260)] + [(300 + i, 1, [0.5 + i * 2e-7, 0.0, 0.0, 0.0, 0.0]) for i in range(9)] + [(400, 2, None)]
    return spark.createDataFrame(rows, "id long, label long, embedding array<float>")


def test_nearest_gives_the_rows_of_all_pairs_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "VECTORS", 50)
    e = vectors(spark)
    q = e.where("id % 10 = 0").select(F.col("id").alias("q_id"), F.col("embedding").alias("q"))
    for within in (None, "label"):
        pairs = retrieval.dense(q, e, "q_id", "id").where("score is not null").join(e.select("id", "label"), "id")
        group = pairs.withColumn("g", F.concat_ws("-", "q_id", within) if within else F.col("q_id").cast("string"))
        want = retrieval.top_k(group, "g", "id", "score", 4).select("q_id", "id", "score")
        got = retrieval.nearest(q, e, "q_id", "id", 4, within).select("q_id", "id", "score")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_dense_queries_form_no_pairs_of_all(spark):
    for name in "dense_topk dense_filtered dense_precision rrf_fusion multiquery_fusion multi_doc_merge evidence_concentration subquery_agreement section_completion section_completeness neighbours agreement budget_pack hits_over_documents context_render hybrid_fusion".split():
        text = plan(QUERIES[name](spark, SMALL))
        assert "FlatMapCoGroupsInArrow" in text and "zip_with" not in text, name


def test_agreement_joins_equal_sets_once(spark):
    rows = [("k", n, i) for n in range(300) for i in (1, 2, 3)] + [("k", 300, i) for i in (3, 4)]
    x = packing.pairwise_agreement(spark.createDataFrame(rows, "k string, n long, i long"), "k", "n", "i")
    assert x.collect()[0].agreement == round((300 * 299 / 2 + 300 / 4) / (301 * 300 / 2), 4)
    assert "collect_list" in plan(x)


def test_best_scores_round_as_sql_does(spark):
    x = spark.createDataFrame([(0.38835,), (0.276450,), (-0.38835,), (2.5,)], "x double")
    assert [r[0] for r in x.select(retrieval.rounded(F.col("x"), 4)).collect()] == [0.3883, 0.2764, -0.3883, 2.5]


def test_references_show_scores_as_printf_does(spark):
    hits = spark.createDataFrame([(1, 2, 0, 0.38835, 1, "a"), (1, 3, 0, 0.5, 2, "b"), (1, 4, 0, -0.27645, 3, "c")], "q long, doc long, page long, score double, rnk long, text string")
    x = rendering.context_rows(hits, "q", "doc", "page", "score", "rnk", "text").collect()[0]
    assert x.fingerprint == "2:0:0.3883|3:0:0.5000|4:0:-0.2764"
    assert x.refs.startswith("2 p.1 (conf: 0.3883)")


def test_an_item_of_two_sections_is_taken_by_its_smallest_first(spark):
    for order in (1, -1):
        hits = spark.createDataFrame([(1, s, "a", 5.0) for s in (1, 2, 3, 4)[::order]] + [(1, 1, "b", 9.0)], "q long, sec long, item string, score double").repartition(1)
        sections = spark.createDataFrame([(1, False), (2, False), (3, True), (4, False)], "sec long, navigational boolean")
        x = ranking.section_concentration(hits, sections, "q", "sec", "item", "score", 2).collect()
        assert [tuple(r) for r in x] == [(1, 1, 1.0, 2)]


def test_contexts_are_cut_in_one_pass_in_linear_time(spark):
    x = spark.createDataFrame([(1, "\n".join(["x" * 40] * 60_000)), (2, "a\n\n" + "b" * 30), (3, ""), (4, None)], "k long, text string")
    began = time.monotonic()
    got = models.context_parts(x, ["k"], "text", 410).collect()
    assert time.monotonic() - began < 60  # hours, when places were appended to an array one by one
    assert [r.part for r in got if r.k == 1] == list(range(6_000)) and all(len(r.text) == 409 for r in got if r.k == 1)
    assert [(r.k, r.part, r.text) for r in got if r.k > 1] == [(2, 0, "a\n\n" + "b" * 30), (3, 0, "")]


def test_narratives_take_texts_in_order_and_join_stuck_notes(spark):
    rows = [("a", i, f"line {i}\nmore {i}") for i in range(40)] + [("b", 2, "second"), ("b", 1, "first"), ("b", 3, None)]
    text = "\n".join(t for k, i, t in rows if k == "a")
    x = spark.createDataFrame(rows, "q string, n long, t string").repartition(7)
    cut: list[str] = []
    for line in text.split("\n"):
        if cut and len(cut[-1]) + 1 + len(line) <= 100:
            cut[-1] += "\n" + line
        else:
            cut.append(line)
    got = {r.q: r for r in models.map_reduced(x, lambda ps: ["<" + p + ">" for p in ps], "q", "n", "t", 100).collect()}
    assert got["b"].narrative == "<first\nsecond>" and got["b"].passes == 1 and got["b"].rounds == 0
    assert got["a"].passes == len(cut) and got["a"].narrative == "\n\n".join(f"<{c}>" for c in cut)


def test_chunks_meet_their_answers_after_they_are_cut(spark):
    text = plan(QUERIES["semantic_utilisation"](spark, SMALL)).split("Join")[-1]
    assert "row_number" in text  # below the lowest join


def test_titles_are_looked_up_by_sets_of_tokens(spark):
    r = random.Random(5)
    words = [f"w{i:02d}x" for i in range(25)]
    titles = [(i, " ".join(r.choices(words, k=r.randint(1, 7)))) for i in range(300)] + [(300 + i, "w01x w02x") for i in range(40)] + [(400, None), (401, "")]
    asked = [(i, " ".join(r.choices([*words, "unknown"], k=r.randint(1, 12)))) for i in range(120)] + [(500, "w01x"), (501, "unknown"), (502, None)]
    want = []
    for q, text in asked:
        a = set((text or "").split())
        scored = []
        for t, title in titles:
            b = set((title or "").split())
            if a & b:
                scored.append((-round(0.85 * (len(a & b) / len(a)) + 0.15 * (2 * len(a & b) / (len(a) + len(b))), 6), t))
        want += [(q, t, -x, i + 1) for i, (x, t) in enumerate(sorted(scored)[:10])]
    got = ranking.title_scores(spark.createDataFrame(asked, "q long, text string"), spark.createDataFrame(titles, "t long, title string"), "q", "t")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "forall" in plan(got)


def test_a_long_text_is_split_once(spark):
    text = " ".join(f"Sentence number {i} of a very long text." for i in range(6_000))
    x = spark.createDataFrame([(1, text), (2, None), (3, "Short.")], "k long, text string").select("k", items.rebuilt_text(F.col("text")).alias("t"))
    began = time.monotonic()
    assert {r.k: r.t for r in x.collect()} == {1: text, 2: None, 3: ""}
    assert time.monotonic() - began < 12  # split again for each of 2,000 windows, it took far longer


def test_stretches_leave_out_no_window_that_reaches_the_cutoff(spark):
    r = random.Random(9)
    pairs, judged = [], 0
    for size in (20, 64, 65, 130) * 15:
        text = "".join(r.choices("abcdefgh ij", k=r.randint(size, 900)))
        at = r.randrange(len(text) - size + 1)
        quote = "".join("#" if r.random() < 0.2 else c for c in text[at : at + size])
        if quote not in text:
            pairs.append((quote, text))
    found = evidence.stretches(pairs, 70.0)
    for (quote, text), some in zip(pairs, found):
        masks = {}
        for i, c in enumerate(quote):
            masks[c] = masks.get(c, 0) | 1 << i
        m = len(quote)
        able = {s for s in range(len(text) - m + 1) if 100 * evidence._common(masks, m, text[s : s + m]) / m >= 70.0}
        kept = {s for a, b in some for s in range(a, b)}
        assert able <= kept
        judged += len(text) - m + 1 - len(kept)
        assert evidence.best_place(quote, text, 70.0, some) == evidence.best_place(quote, text, 70.0)
    assert judged > 10_000  # starts that need no look of their own
