"""Spans that the methods add, page layouts, blocks larger than shards, and odd rows in every stage of the pipeline."""

import random
import string
import sys
from html.parser import HTMLParser
from pathlib import Path

import numpy as np
import pytest
from plain import leaks, personal, secrets
from test_operators import DATA, frame, passage

from inkwell.llm import decontaminate, html_text, mixing, pii, toxicity
from inkwell.llm import secrets as secrets_op
from inkwell.llm.common import table

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402

BODY = "<p>First paragraph of the article that is long enough to count.</p><p>Second one, which says more about it, at some length too.</p>"
TEXT = "First paragraph of the article that is long enough to count. Second one, which says more about it, at some length too."
COMMENT = "<p>A reader says a lot about this thing and that.</p>"
LINKS = "<ul><li><a href=a>One</a><li><a href=a>Two</a><li><a href=a>Three</a></ul>"
LAYOUTS = [
    (f"<nav>Menu</nav><div class='layout has-sidebar'>{BODY}</div><footer>x</footer>", TEXT),
    (f"<div id=social-science>{BODY}</div>", TEXT),
    (f"<div class='search-result article'>{BODY}</div>", TEXT),
    (f"<div class=sidebar>{BODY}</div>", TEXT),
    (f"<p title=it's>Before it.</p>{BODY}<a title='x'>y</a>", f"Before it. {TEXT}"),
    (f'<p class="x>Before it.</p>{BODY}<p class="y">Last of them.</p>', f"Before it. {TEXT} Last of them."),
    (f"{BODY}<p>Buy <span class=advert>this <span>ad</span> now</span>nothing.</p>", f"{TEXT} Buy nothing."),
    (f"{BODY}<div style='display: none'>unseen words</div><p hidden>unseen</p>", TEXT),
    (f"{BODY}{'<div></div>' * 9}<p>Short end.</p>", f"{TEXT} Short end."),
    (f"{BODY}<div class=ad>{'<p>a</p>' * 9}</div><p>Short end.</p>", f"{TEXT} Short end."),
    (f"<article>{BODY}</article><section id=comments>{COMMENT * 20}</section>", TEXT),
    (f"<div class=content>{BODY}</div><div id=comments>{COMMENT * 8}</div>", TEXT),
    (f"<div>{BODY}<p><a href=x>A linked paragraph</a></p><p>The end of it.</p></div>", f"{TEXT} A linked paragraph The end of it."),
    (f"<article>{BODY}<figure><img><figcaption>A caption</figcaption></figure></article>", f"{TEXT} A caption"),
    (f"<header>Site</header><article><header><h1>Title</h1></header>{BODY}<footer>by x</footer></article>", f"Title {TEXT}"),
    (f"{LINKS}<h1>Title</h1>{BODY}{LINKS}<p>(c) x</p>", f"Title {TEXT}"),
]


@pytest.mark.parametrize(("page", "text"), LAYOUTS)
def test_page_layouts(page, text):
    assert html_text.extract(page) == text


class Article(HTMLParser):
    """Plain version for pages with one article element: its text, block by block."""

    def __init__(self):
        super().__init__()
        self.inside, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag in html_text.BLOCK:
            self.parts.append(" ")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        if tag in html_text.BLOCK:
            self.parts.append(" ")

    def handle_data(self, data):
        if self.inside:
            self.parts.append(data)


def test_all_pages_of_the_table(spark):
    for r in html_text.html_extract(table(spark, DATA, "pages")).join(table(spark, DATA, "pages").select("page_id", "html"), "page_id").collect():
        plain = Article()
        plain.feed(r["html"] or "")
        assert r["text"] == " ".join("".join(plain.parts).split()), r["page_id"]


def test_added_secrets(spark):
    """Precision and recall of the spans that the method adds, on planted strings."""
    rng, rows, want = random.Random(5), [], {}
    some = lambda n, extra="": "".join(rng.choices(string.ascii_letters + string.digits + extra, k=n))
    for i in range(400):
        text, planted = [
            (f"the auth header is then {some(32)} for all", True),
            (f"sk_live_{some(24)}.{some(10)} is the api key of it", True),
            (f"Authorization Bearer {some(20)}/{some(18)}+{some(6)}==", True),
            (f"private signature\n{some(64, '+/')}\nend", True),
            (f"the session of 2024-10-{rng.randint(10, 31)}T10-22-{rng.randint(10, 59)} was closed", False),
            (f"see the key file report_2024_final_version{i}.pdf in docs/articles/archive/2023/index.html", False),
            (f"call getAuthenticationTokenManager of the session handler {i}", False),
            (f"number {some(30)} without that word", False),
        ][i % 8]
        rows.append((i, text))
        want[i] = planted
    got = {r["doc_id"]: r for r in secrets_op.secret_scan(frame(spark, rows)).collect()}
    assert all(got[i]["base"] == ",".join(secrets(t)) for i, t in rows)
    found = {i for i, r in got.items() if r["n_novel"]}
    right = {i for i in found if want[i]}
    assert len(right) >= 0.95 * sum(want.values()) and len(right) >= 0.95 * len(found), (len(found), len(right))


def test_added_personal_data(spark):
    """The trees take telephone numbers by what stands around them: precision and recall of the added spans."""
    rng, rows, want = random.Random(3), [], {}
    n = lambda k: "".join(rng.choices(string.digits, k=k))
    for i in range(400):
        text, planted = [
            (f"Please call or phone us at +1 {n(3)} {n(3)} {n(4)} today", False),
            (f"You can reach me by phone {n(3)}-{n(3)}-{n(4)} at night", True),
            (f"Batch number {n(3)}-{n(3)}-{n(4)} of the goods", False),
            (f"On 20{n(2)}-10-{n(2)} they met and bought part {n(2)}-{n(4)}-{n(3)} again", False),
            (f"Write mail to jo{n(2)} [at] example [dot] org please", True),
            (f"Write mail to jo{n(2)}@example.org please or from 10.0.0.{n(2)}", False),
            ("We met @ noon, all of us", False),
        ][i % 7]
        rows.append((i, text))
        want[i] = planted
    got = {r["doc_id"]: r for r in pii.personal_data(frame(spark, rows)).collect()}
    assert all(got[i]["base"] == ",".join(personal(t)) for i, t in rows)
    found = {i for i, r in got.items() if r["spans"] != r["base"]}
    right = {i for i in found if want[i]}
    assert len(right) >= 0.95 * sum(want.values()) and len(right) >= 0.95 * len(found), (len(found), len(right))


def test_many_matches_in_one_text(spark):
    (r,) = pii.personal_data(frame(spark, [(1, "call +1 555 123 4567 or me@x.org " * 500)])).collect()
    assert (r["n_phone"], r["n_email"]) == (500, 500) and r["base"] == ",".join(personal("call +1 555 123 4567 or me@x.org " * 500))


@pytest.mark.parametrize("times", [10, 100])
def test_blocks_larger_than_shards(spark, monkeypatch, times):
    rng = random.Random(7)
    rows = [(i, passage(rng, 20), rng.choice("aaab")) for i in range(1_500)]
    monkeypatch.setattr(mixing, "BLOCKS", 300)
    monkeypatch.setattr(mixing, "SHARD_WORDS", max(1, 1_500 * 20 // 300 // times))
    got = mixing.mix(frame(spark, rows)).collect()
    source = {i: s for i, _, s in rows}
    for s in "ab":
        taken, target = (sum(r["taken"] for r in got if source[r["doc_id"]] == s), next(r["target"] for r in got if source[r["doc_id"]] == s))
        assert abs(taken - target) <= 0.02 * target, (s, taken, target)


def test_similar_windows_are_within_the_radius():
    """SimHash gives no guarantee by similarity: of windows at 0.8 or a little over, how many lie within the radius."""
    rng, near, n = random.Random(8), 0, 0
    while n < 300:
        size = rng.randint(16, 200)
        a = rng.sample(range(1 << 62), size)
        b = list(a)
        for i in rng.sample(range(size), int(size * 0.11)):
            b[i] = rng.getrandbits(62)
        both = len(set(a) & set(b))
        if 0.8 <= both / (2 * size - both) < 0.9:
            n += 1
            p, q = (decontaminate.fingerprints(np.array(x, np.uint64), np.zeros(1, np.int64), size)[0] for x in (a, b))
            near += decontaminate._ONES[p ^ q].sum() <= decontaminate.RADIUS
    assert near >= 0.99 * n, near


def test_labels_of_far_more_ids_than_documents(spark):
    docs = frame(spark, [(i, ("you are an awful fool " if i % 2 else "a fine day for a walk ") * 3) for i in range(200)])
    labels = spark.range(100_000).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    got = toxicity.toxicity(docs, toxicity.fit(docs, labels, fit_rows=50)).where("held_out").collect()
    assert got and all(r["predicted"] == r["doc_id"] % 2 for r in got)


ODD = [(None, None), (None, "word " * 40), (1, None), (1, None), (2, ""), (3, "a b c"), (4, "one two three four five six seven"), (4, "one two three four five six seven"), (5, "mail me@x.org " * 3_000)]


@pytest.mark.parametrize("rows", [ODD, []])
def test_stages_take_odd_rows(spark, rows):
    """Nulls in any column, repeated rows, an empty table, clashing names: columns stay, and clean rows do."""
    docs = frame(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        if name != "mix":
            assert out.columns == docs.columns, name
        n = out.count()
        if name in ("toxicity", "benchmark_leaks", "personal_data"):
            assert n == len(rows), name
        elif name == "near_copies":
            assert n == (7 if rows else 0), name
        else:
            assert n == sum(bool((t or "").split()) for _, t in rows), name


def test_leaks_go_whatever_their_ids(spark):
    rng = random.Random(2)
    item = passage(rng, 30)
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(None, f"{passage(rng, 9)} {item}"), (7, item), (7, passage(rng, 30)), (None, passage(rng, 30)), (None, None)]
    kept = [(r["doc_id"], r["text"]) for r in decontaminate.without_contaminated(frame(spark, rows), items).collect()]
    assert sorted(kept, key=str) == sorted([r for r in rows if not leaks(r[1], [(1, item)])], key=str) and len(kept) == 3


def test_meet_splits_hot_values(spark):
    """A value that holds most rows is dealt over parts; every row meets its key once, and rows without one go."""
    from pyspark.sql import functions as F

    from inkwell.llm.common import meet

    rows = spark.range(3_000).select(F.col("id"), F.when(F.col("id") % 3 > 0, -1).otherwise(F.col("id") % 50).alias("v"))
    keys = rows.groupBy("v").agg(F.count(F.lit(1)).alias("n")).where("v < 40").withColumn("name", F.col("v") * 2)
    want = sorted((r["id"], r["v"], r["v"] * 2) for r in rows.where("v < 40").collect())
    assert sorted((r["id"], r["v"], r["name"]) for r in meet(rows, keys, ["v"], ["id"]).collect()) == want
    assert sorted(r["id"] for r in meet(rows, keys, ["v"], ["id"], "left_semi").collect()) == [w[0] for w in want]
    assert meet(rows, keys.where("false"), ["v"], ["id"]).count() == 0
