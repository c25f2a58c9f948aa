"""Structure, alignment, models, files and streams on small tables."""

import random
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from inkwell.functions import dates
from inkwell.operators import evidence, grading, models, session, spans, structure, validation
from inkwell.sources import files
from inkwell.streaming import intake


def test_section_chunks(spark):
    body = "Intro line.\n\n" + "\n".join(f"1) item number {i} " + "x" * 200 for i in range(12)) + "\n\nshort"
    sections = spark.createDataFrame([("d", 0, "A > B", 100, 100 + len(body), body), ("d", 1, "C", 9_000, 9_005, "tiny"), ("d", 2, "D", 0, 0, "  \n ")], "doc_id string, sec_no long, path string, char_start long, char_end long, body string")
    rows = sorted((r for r in structure.section_chunks(sections).collect()), key=lambda r: (r["sec_no"], r["chunk_no"]))
    mine = [r for r in rows if r["sec_no"] == 0]
    assert [r["chunk"] for r in rows if r["sec_no"] == 1] == ["tiny"] and not [r for r in rows if r["sec_no"] == 2]
    assert all(len(r["chunk"]) <= structure.CHUNK + structure.OVERLAP and r["embed_text"] == f"A > B\n{r['chunk']}" for r in mine)
    assert all(body[r["char_start"] - 100 :].lstrip().startswith(r["chunk"].split("\n")[0]) and r["char_end"] <= 100 + len(body) for r in mine)
    assert all(a["char_end"] > b["char_start"] for a, b in zip(mine, mine[1:], strict=False))
    assert set(re.findall(r"number (\d+)", " ".join(r["chunk"] for r in mine))) == {str(i) for i in range(12)}


def test_long_blocks_are_cut_between_lines():
    text = "\n".join("y" * 300 for _ in range(10))
    blocks = structure._split(text, re.compile(r"^\d\)"))
    assert "\n".join(b for _, b in blocks) == text and all(len(b) <= structure.CHUNK for _, b in blocks)
    assert all(text[at : at + len(b)] == b for at, b in blocks)


def test_headings_and_tree(spark):
    text = "x" * 210 + "\n1 First part\nbody\n1.1 Under it\nmore\n2.3.1 Deep one\n2 Second part\nend"
    docs = spark.createDataFrame([(1, text, len(text)), (2, "no headings", 11)], "doc_id long, text string, n_chars long")
    tree = structure.section_tree(structure.headings(docs).join(docs.select("doc_id", "n_chars"), "doc_id"))
    got = {(r["doc_id"], r["sec_no"]): r for r in tree.collect()}
    assert [got[1, i]["path"] for i in range(-1, 4)] == ["Front matter", "1 First part", "1 First part > 1.1 Under it", "1 First part > 1.1 Under it > 2.3.1 Deep one", "2 Second part"]
    assert (got[1, -1]["char_end"], got[2, 0]["path"], got[2, 0]["char_end"]) == (211, "Document", 11)
    assert structure.section_text(tree, docs).where("sec_no = 1").first()["body"] == "1.1 Under it\nmore\n"


def test_items(spark):
    xs = [10.0, 10.5, 24.0, 24.0, 40.0, -1.0]
    rows = spark.createDataFrame([("s", i, x) for i, x in enumerate(xs)] + [("t", 0, -1.0), ("t", 1, 5.0)], "sec string, pos long, x double")
    got = {(r["sec"], r["pos"]): r["depth"] for r in structure.indent_levels(rows, "sec").collect()}
    assert [got["s", i] for i in range(6)] == [0, 0, 1, 1, 2, 0] and got["t", 0] is None


def test_titles_and_json(spark):
    rows = spark.createDataFrame([("A good long title | FDA", None), ("Guidance for Industry", "First line\nSecond line\nU.S. Department of X\nmore"), (None, "Draft guidance"), (None, None)], "meta string, page string")
    assert [r[0] for r in rows.select(dates.document_title(F.col("meta"), F.col("page"))).collect()] == ["A good long title", "First line Second line", "Untitled document", "Untitled document"]
    replies = spark.createDataFrame([('```json\n{"a": 1}\n```',), ('Here: {"a": [1, 2]} so',), ("nothing",), (None,)], "r string")
    assert [r[0] for r in replies.select(dates.rescued_json(F.col("r"))).collect()] == ['{"a": 1}', '{"a": [1, 2]}', None, None]
    d = spark.createDataFrame([("May\n 2019", None, None, date(2020, 1, 2)), ("may 2019", date(2021, 3, 4), None, date(2020, 1, 2)), (None, None, None, date(2020, 1, 2))], "t string, c date, m date, w date")
    assert [r[0] for r in d.select(dates.display_date(*map(F.col, "tcmw"))).collect()] == ["May 2019", "3/4/21", "1/2/20"]


def plain_best(quote: str, text: str) -> float:
    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    m = len(quote)
    return max(200 * common(quote, text[s : s + m]) / (m + len(text[s : s + m])) for s in range(max(1, len(text) - m + 1)))


def test_fuzzy_alignment(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(3, 7)))
    docs, quotes = [], []
    for i in range(12):
        ws = [word() for _ in range(60)]
        docs.append((i, "  " + "  \n".join(ws)))
        q = " ".join(ws[20:32])
        for _ in range(i % 6):
            p = rng.randrange(len(q))
            q = q[:p] + rng.choice("xyz") + q[p + 1 :]
        quotes.append((i, q))
    quotes += [(90, "short"), (91, None), (92, " ".join(word() for _ in range(9)))]
    docs += [(50, None), (51, "")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(quotes, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in evidence.align_fuzzy(d, q).collect()}
    found = 0
    for i, text in docs[:12]:
        flat, places = evidence.flattened(text)
        want = plain_best(quotes[i][1], flat)
        if want >= 78:
            r = got[i, i]
            found += 1
            assert r["score"] == pytest.approx(want, abs=0.06) and r["label"] == ("grounded" if want >= 90 else "partial")
            assert text[r["start"] : r["end"]].split()[1:-1] == flat[places.index(r["start"]) :][: len(quotes[i][1])].split()[1:-1]
    assert found >= 10 and all(a == b for a, b in got)
    exact = evidence.in_original(d.join(q.withColumnRenamed("text", "quote"), d.doc_id == q.item_id), "text", "quote").where("doc_id = 0").first()
    assert docs[0][1][exact["start"] : exact["end"]].split() == quotes[0][1].split()


def test_models(spark):
    sent = spark.sparkContext.accumulator(0)

    def model(prompts):
        sent.add(len(prompts))
        return [p.upper() for p in prompts]

    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "k long, q string")
    assert {(r["k"], r["reply"]) for r in models.replies(rows, F.col("q"), model).collect()} == {(1, "A"), (2, "A"), (3, "B"), (4, None)} and sent.value == 2

    def broken(prompts):
        raise OSError

    assert [r["reply"] for r in models.replies(rows, F.col("q"), broken).collect()] == [None] * 4
    assert [(r["k"], r["sub_query"]) for r in models.expanded(rows.where("k = 1"), None, "k", "q").collect()] == [(1, "a")]
    r = models.routed(rows.where("k = 1"), lambda ps: ['{"scope": "section", "sections": ["s1"]}'] * len(ps), F.col("q")).first()
    assert (r["scope"], r["sections"]) == ("section", ["s1"]) and models.routed(rows.where("k = 1"), lambda ps: ["?"], F.col("q")).first()["scope"] is None
    r = models.relevancy(rows.where("k = 1"), lambda ps: ["score 0.7"], "q", "q").first()
    assert (r["relevancy"], r["relevant"]) == (0.7, True)
    assert models.answered(rows.where("k = 4"), model, "q", "q").first()["reply"] is None
    embed = lambda ts: [[float(t.count(c)) for c in "abcxyz"] for t in ts]
    a = spark.createDataFrame([(1, "abc abc", "xyz. Abc and abc. zzz")], "k long, answer string, chunk string")
    assert models.fallback_sentences(a, embed, "k", "answer", "chunk").first()["sentence"] == "Abc and abc."
    parts = spark.createDataFrame([(1, 0, "x"), (1, 1, "y")], "k long, no long, t string")
    assert models.map_reduced(parts, model, "k", "no", "t").first()["narrative"] == "X\nY" and models.map_reduced(parts, None, "k", "no", "t").first()["narrative"] == "x\ny"


def test_graders_and_spans(spark):
    hits = spark.createDataFrame([("q", 0.3), ("q", 0.5), ("q", 0.9), ("flat", 0.2)], "q string, score double")
    got = {r["q"]: (r["weak_raw"], r["weak_rescaled"]) for r in grading.retrieval_quality(hits, "q").collect()}
    assert got == {"q": (0.3333, 0.6667), "flat": (1.0, 0.0)}
    views = spark.createDataFrame([("a", 5, 25)], "k string, start long, end long")
    parts = spark.createDataFrame([("a", 100, 110, 0), ("a", 200, 230, 10)], "k string, doc_start long, doc_end long, view_start long")
    assert sorted((r["start"], r["end"]) for r in spans.document_spans(views, parts, "k").collect()) == [(105, 110), (200, 215)]
    batch = spark.createDataFrame([(i, f" q{i % 50} ") for i in range(30_000)], "pos long, q string")
    assert [r["q"] for r in session.checked_batch(batch, "q", "pos").orderBy("pos").collect()] == [f"q{i}" for i in range(50)]
    for bad in (batch.where("pos < 0"), batch.withColumn("q", F.concat("q", (F.col("pos") % 3).cast("string")))):
        with pytest.raises(ValueError):
            session.checked_batch(bad, "q", "pos")
    with pytest.raises(ValueError):
        validation.flat_suite(hits, [hits], "q")
    twice = spark.createDataFrame([("q", 1), ("q", 2)], "q string, s int")
    with pytest.raises(Exception, match="two rows"):
        validation.flat_suite(hits.select("q").distinct(), [twice], "q").collect()
    suite = validation.flat_suite(hits.select("q").distinct(), [twice.where("s = 1"), twice.where("s = 2").withColumnRenamed("s", "t")], "q")
    assert sorted((r["q"], r["s"], r["t"]) for r in suite.collect()) == [("flat", None, None), ("q", 1, 2)]
    one = spark.createDataFrame([(1, 1, "x" * 12, 1, 0, 12, 95.0), (1, 2, "y" * 12, 1, 0, 12, 80.0), (1, 3, "short", 1, 5, 9, 100.0)], "answer long, no long, quote string, doc long, start long, end long, score double")
    assert [(r["span_id"], r["score"], r["label"]) for r in validation.evidence_spans(one, "answer").collect()] == [("ev1", 95.0, "grounded")]


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one\ntwo")
    (tmp_path / "bad.pdf").write_bytes(b"\xff")
    (tmp_path / "c.txt").write_bytes(b"no")
    parser = lambda b: [(0, i, -1.0, t) for i, t in enumerate(b.decode().split("\n"))]
    got = files.scanned(spark, [str(tmp_path), str(tmp_path / "gone")], parser).collect()
    assert sorted((r["path"].rsplit("/", 1)[1], r["line"]) for r in got if r["line"]) == [("a.pdf", "one"), ("a.pdf", "two")] and len(got) == 3
    assert files.scanned(spark, [str(tmp_path / "gone")], parser).count() == 0
    at = str(tmp_path / "manifest")
    assert files.manifest(spark, at).count() == 0
    files.write_manifest(spark.createDataFrame([("p", "f", "c")], "path string, fingerprint string, cache string"), at)
    assert [tuple(r) for r in files.manifest(spark, at).collect()] == [("p", "f", "c")]
    more = spark.createDataFrame([("q", "g", "d")], "path string, fingerprint string, cache string")
    files.write_manifest(files.manifest(spark, at).unionByName(more), at)
    assert {r["path"] for r in files.manifest(spark, at).collect()} == {"p", "q"}
    files.write_manifest(more.limit(0), at)
    assert files.manifest(spark, at).count() == 0
    lines = spark.createDataFrame([("f1", "x"), ("f2", "y")], "fingerprint string, line string")
    files.write_parsed(lines, str(tmp_path / "parsed"))
    assert [r["line"] for r in files.read_parsed(spark, str(tmp_path / "parsed"), lines.where("fingerprint = 'f2'")).collect()] == ["y"]
    cache = spark.createDataFrame([], "text_sha string, embedding array<double>")
    chunks = spark.createDataFrame([(1, "a"), (2, "a"), (3, "bb")], "k long, text string")
    full, new = files.embedded(chunks, cache, lambda ts: [[float(len(t))] for t in ts])
    assert new.count() == 2 and {(r["k"], r["embedding"][0]) for r in full.collect()} == {(1, 1.0), (2, 1.0), (3, 2.0)}
    assert files.embedded(chunks, new, None)[1].count() == 0


def test_streams(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "registry")
    schema = "doc_id long, label string, embedding array<double>"
    for n, rows in enumerate(([(1, "a", [1.0]), (2, "b", [2.0])], [(2, "b", [2.0]), (3, "a", [3.0])])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        intake.register_documents(spark.readStream.schema(schema).parquet(str(src)), out, str(tmp_path / "c1"), 1).awaitTermination()
        assert n or spark.read.parquet(out).count() == 2
    assert {(r["doc_id"], r["label"]) for r in spark.read.parquet(out).collect()} == {(1, "a"), (2, "b"), (3, "a (3)")}
    log = str(tmp_path / "log")
    schema = "answer string, tags array<string>"
    for k in range(2):
        spark.createDataFrame([(f"x{k}", ["p", "q"]), (f"y{k}", [])], schema).write.mode("append").parquet(str(tmp_path / "entries"))
        intake.append_audit(spark.readStream.schema(schema).parquet(str(tmp_path / "entries")), log, str(tmp_path / "c2"), ("tags",)).awaitTermination()
    got = spark.read.parquet(log).orderBy("entry_id").collect()
    assert len({r["entry_id"] for r in got}) == 4 and {r["answer"] for r in got[:2]} == {"x0", "y0"} and {r["tags"] for r in got} == {"p | q", ""}
