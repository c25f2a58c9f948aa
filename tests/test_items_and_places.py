"""Enumerated items, heading places and page maps against plain versions."""

import random
import re

from pyspark.sql import functions as F

from inkwell.operators import placement, segments, structure

STYLES = [("paren_num", r"\s*(\d{1,3})\)(?:\s+|\s*$)"), ("paren_alpha", r"\s*([a-z])\)(?:\s+|\s*$)"), ("roman", r"\s*((?i:x{0,3}(?:ix|iv|v?i{1,3}|v)))\.(?:\s+|\s*$)"), ("dot_num", r"\s*(\d{1,3})\.(?:\s+(?=[A-Za-z(])|\s*$)"), ("bullet", r"\s*([•●▪–\-])(?:\s+|\s*$)")]
ROMAN = [""] + "i ii iii iv v vi vii viii ix x xi xii xiii xiv xv xvi xvii xviii xix xx".split()
BODY = "intro\n1) First top\nwrapped on\n 1) disease.\na) sub one\n  i. deep item\n  ii. second deep\nb) sub two\n2) \n9) too far ahead\n• bullet one\n1) anew after the bullet\n3) third top\n\n4) fourth top\n- "


def plain_items(text: str, base: int, xs: dict[int, float] | None = None) -> list[tuple]:
    """Item by item: the last number of each depth, parents by looking back for the nearest shallower item each time."""
    lines, marks, at = text.split("\n"), [], 0
    for line in lines:
        for style, p in STYLES:
            if m := re.match(p, line):
                v = None
                if style in ("paren_num", "dot_num"):
                    v = int(m[1])
                elif style == "paren_alpha":
                    v = ord(m[1]) - 96
                elif style == "roman" and m[1].lower() in ROMAN:
                    v = ROMAN.index(m[1].lower())
                marks.append([at, style, v])
                break
        at += len(line) + 1
    order = list(dict.fromkeys(s for _, s, _ in marks))
    depths = [order.index(s) for _, s, _ in marks]
    if xs is not None:
        x = [xs.get(base + a, -1.0) for a, _, _ in marks]
        known = sorted({v for v in x if v >= 0})
        if sum(v >= 0 for v in x) >= max(2, int(0.8 * len(x))):
            levels = []
            for v in known:
                if not levels or v - levels[-1] > 6:
                    levels.append(v)
            depths = [0 if v < 0 else min(range(len(levels)), key=lambda i: abs(levels[i] - v)) for v in x]
    last, taken = {}, []
    for (a, _, v), d in zip(marks, depths, strict=True):
        if v is None:
            last[d] = None
        elif last.get(d) is None or last[d] < v <= last[d] + 3 or (d > 0 and v == 1):
            last = {k: w for k, w in last.items() if k <= d}
            last[d] = v
        else:
            continue
        taken.append((a, d))
    dense = sorted({d for _, d in taken})
    out, long = [], []
    for i, (a, d) in enumerate(taken):
        raw = text[a : taken[i + 1][0] - 1 if i + 1 < len(taken) else len(text)].rstrip()
        if len(raw.strip()) < 5:
            continue
        d, parents, need = dense.index(d), [], dense.index(d)
        for pd, label in reversed(long):
            if pd < need:
                parents.insert(0, label)
                need = pd
        label = " ".join(raw.split("\n")[0].split())
        long.append((d, label))
        out.append((len(out) + 1, d, label, tuple(parents), raw, base + a, base + a + len(raw)))
    return out


def listed(seed: int) -> str:
    rng = random.Random(seed)
    marks = ["1) ", "2) ", "3) ", "a) ", "b) ", "i. ", "iv. ", "• ", "- ", "7. ", "8. ", "", "", " ", "12) ", "c)"]
    return "\n".join(rng.choice(marks) + " ".join(rng.choices(["Alpha", "beta", "x", "gamma delta"], k=rng.randint(0, 3))) for _ in range(rng.randint(0, 60)))


def test_section_items(spark):
    bodies = [BODY, "", None, "no marks here", *[listed(i) for i in range(12)]]
    rows = [("d", i, 100 * i, b) for i, b in enumerate(bodies)] + [("d", 0, 0, BODY)]  # one section stands twice
    got = segments.section_items(spark.createDataFrame(rows, "doc string, sec long, char_start long, body string"), ["doc", "sec"]).collect()
    want = [(i, *r) for i, b in enumerate([*bodies, BODY]) for r in plain_items(b or "", 100 * (i % len(bodies)))]
    want = [(i % len(bodies), *r) for i, *r in want]
    assert sorted((r["sec"], r["index"], r["depth"], r["label"], tuple(r["parents"]), r["raw"], r["char_start"], r["char_end"]) for r in got) == sorted(want)
    first = {r["index"]: r for r in got if r["sec"] == 0}
    assert (first[1]["marker"], first[1]["text"], first[1]["style"]) == ("1)", "First top wrapped on 1) disease.", "paren_num")
    assert not any(r["text"] == "anew after the bullet" for r in got)  # the bullet is of another depth than the numbers


def test_a_bullet_ends_the_run_of_its_depth(spark):
    body = "5) fifth item\n\u2022 bullet item\n1) anew again\n9) too far on"
    sections = spark.createDataFrame([("d", 0, body)], "doc string, char_start long, body string")
    edges = spark.createDataFrame([("d", m.start(), 40.0) for m in re.finditer("(?m)^", body)], "doc string, start long, x double")
    assert [r["text"] for r in segments.section_items(sections, ["doc"], edges).orderBy("index").collect()] == ["fifth item", "bullet item", "anew again 9) too far on"]


def test_items_by_indents(spark):
    rng = random.Random(5)
    bodies = [listed(i + 50) for i in range(6)]
    places = [{100 * i + m.start(): rng.choice([10.0, 11.0, 30.0, 52.5]) for m in re.finditer("(?m)^", b) if rng.random() < 0.9} for i, b in enumerate(bodies)]
    sections = spark.createDataFrame([(i, 100 * i, b) for i, b in enumerate(bodies)], "doc long, char_start long, body string")
    indents = spark.createDataFrame([(i, p, x) for i, xs in enumerate(places) for p, x in xs.items()], "doc long, start long, x double")
    got = segments.section_items(sections, ["doc"], indents).collect()
    want = [(i, *r) for i, b in enumerate(bodies) for r in plain_items(b, 100 * i, places[i])]
    assert sorted((r["doc"], r["index"], r["depth"], r["label"], tuple(r["parents"]), r["raw"], r["char_start"], r["char_end"]) for r in got) == sorted(want)
    deep = segments.section_items(sections, ["doc"], indents, deepest=0).collect()
    assert {(r["doc"], r["char_start"]) for r in deep} == {(r["doc"], r["char_start"]) for r in got if r["depth"] == 0}


def plain_groups(depths: list[int]) -> list[tuple[int | None, int]]:
    groups, headed = [], False
    for i, d in enumerate(depths):
        if d == 0 and i + 1 < len(depths) and depths[i + 1] > 0:
            groups.append([i, 0])
            headed = True
            continue
        if not groups or (d == 0 and headed):
            groups.append([None, 0])
            headed = False
        groups[-1][1] += 1
    return [tuple(g) for g in groups if g[1]]


def test_groups(spark):
    rng = random.Random(2)
    cases = [[0, 1, 1, 0, 0, 1, 0], [1, 2, 0, 0, 1], [0], [], *[[rng.choice([0, 0, 1, 2]) for _ in range(12)] for _ in range(30)]]
    rows = [(k, i, d) for k, ds in enumerate(cases) for i, d in enumerate(ds)]
    got = segments.item_groups(spark.createDataFrame(rows, "sec long, index long, depth long"), ["sec"], label=None).orderBy("sec", "group_no").collect()
    assert [(r["sec"], r["heading"], r["n_items"]) for r in got] == [(k, *g) for k, ds in enumerate(cases) for g in plain_groups(ds)]


def test_structural_extraction(spark):
    sections = spark.createDataFrame([("d", 1, "One", "1) Head\na) first entry\nb) second entry\n2) childless top", 100), ("d", 2, "Two", "prose", 500)], "doc string, sec long, title string, body string, char_start long")
    picked = spark.createDataFrame([("q", "d", 1), ("p", "d", 2), ("r", "d", 1)], "q string, doc string, sec long")
    segs = spark.createDataFrame([("q", "d", 100, 125, 7), ("r", "d", 0, 50, 0)], "q string, doc string, doc_start long, doc_end long, view_start long")
    pages = spark.createDataFrame([("d", 0, 0), ("d", 1, 110), ("d", 2, 130)], "doc string, page long, start long")
    got = segments.structural_extraction(picked, sections, segs, "q", "doc", "sec", pages).orderBy("q", "item_id").collect()
    assert [(r["q"], r["item_id"], r["heading"], r["text"], r["page"], r["view_start"], r["view_end"], r["grounding"]) for r in got] == [
        ("q", "i0000", "1) Head", "first entry", 1, 15, 29, "grounded"), ("q", "i0001", "1) Head", "second entry", 2, 30, 32, "grounded"), ("q", "i0002", "One", "childless top", 3, None, None, "ungrounded"),
        ("r", "i0000", "1) Head", "first entry", 1, None, None, "ungrounded"), ("r", "i0001", "1) Head", "second entry", 2, None, None, "ungrounded"), ("r", "i0002", "One", "childless top", 3, None, None, "ungrounded"),
    ]


def plain_located(entries: list[tuple], text: str, pages: list[tuple[int, int]]) -> list[int]:
    out, at = [], 0
    for _, number, title, page in entries:
        page = max(0, min(len(pages) - 1, page))
        lo, hi = max(pages[max(0, page - 1)][0], at), pages[min(len(pages) - 1, page + 1)][1]
        if lo >= hi:
            lo, hi = pages[page]
        w = text[lo:hi]
        hits = [w.find(c) for c in ([f"{number}\n{title}", f"{number} {title}", f"\n{number}\n"] if number else []) + [title]] + [w.lower().find(title.lower()[:60])]
        hit = next((lo + h for h in hits if h >= 0), -1)
        at = hit if hit >= at else max(at, pages[page][0])
        out.append(at)
    return out


def test_located(spark):
    rng = random.Random(9)
    rows, marks, want = [], [], {}
    for doc in range(25):
        names = ["Scope", "Dosing plan", "End points", "scope", "Safety of all", "Annex"]
        pages = [[rng.choice(["", "1.2 ", "3\n", "2 "]) + rng.choice([*names, "plain text", "more words here"]) for _ in range(rng.randint(1, 5))] for _ in range(rng.randint(1, 6))]
        rows += [(doc, p, i, line) for p, ls in enumerate(pages) for i, line in enumerate(ls)]
        found = [(i, rng.choice(["", "1.2", "3", "2"]), rng.choice(names).upper() if rng.random() < 0.2 else rng.choice(names), rng.randint(-1, len(pages))) for i in range(rng.randint(1, 8))]
        marks += [(doc, i, 1, f"{n}  {t}" if n else t, page + 1) for i, n, t, page in found]
        texts = ["".join(line + "\n" for line in ls) + "\n" for ls in pages]
        spans, at = [], 0
        for t in texts:
            spans.append((at, at + len(t)))
            at += len(t)
        want |= {(doc, e[0]): s for e, s in zip(found, plain_located(found, "".join(texts), spans), strict=True)}
    texts = placement.page_texts(spark.createDataFrame(rows, "doc long, page long, line_no long, text string"))
    entries = placement.bookmark_entries(spark.createDataFrame(marks, "doc long, seq long, level long, title string, page long"))
    assert {(r["doc"], r["seq"]): r["start"] for r in placement.located(entries, texts).collect()} == want


def test_tied_headings_stay_apart(spark):
    rows = [(1, 0, "A", 1, 0, 50), (1, 1, "B", 2, 10, 50), (1, 2, "C", 3, 10, 50), (1, 3, "D", 2, 10, 50), (1, 4, "E", 1, 50, 50)]
    heads = spark.createDataFrame(rows, "doc_id long, seq long, full_title string, level long, start long, n_chars long")
    got = structure.section_tree(heads, order="seq").orderBy("sec_no").collect()
    assert [(r["path"], r["char_start"], r["char_end"]) for r in got] == [("A", 0, 10), ("A > B", 10, 11), ("A > B > C", 10, 11), ("A > D", 10, 50), ("E", 50, 50)]


def test_lines_of_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "ab\nc"), (1, "ab\nc"), (1, "x\n\nyz"), (2, None)], "doc_id long, text string")
    got = sorted((r["line"], r["start"]) for r in structure.text_lines(docs).collect())
    assert got == [("", 2), ("ab", 0), ("ab", 0), ("c", 3), ("c", 3), ("x", 0), ("yz", 3)]


def test_pages_there_and_back(spark):
    rows = [("d", 0, 0, "one"), ("d", 0, 1, "two"), ("d", 2, 0, "three"), ("d", 3, 0, None)]
    texts = placement.page_texts(spark.createDataFrame(rows, "doc string, page long, line_no long, text string"))
    view = placement.paged_text(texts).join(texts.select("doc", F.col("text").alias("own"), "pages"), "doc").first()
    assert view["own"] == "one\ntwo\n\nthree\n\n\n\n" and view["text"] == "[Page 1]\none\ntwo\n\n[Page 3]\nthree\n\n[Page 4]\n\n\n"
    for s in view["segments"]:
        assert view["own"][s["doc_start"] : s["doc_end"]] == view["text"][s["view_start"] : s["view_start"] + s["doc_end"] - s["doc_start"]]
    spans = spark.createDataFrame([("d", 0, 3), ("d", 7, 12), ("d", 12, 99)], "doc string, char_start long, char_end long")
    assert [(r["page_start"], r["page_end"]) for r in placement.with_page_stamps(spans, texts).orderBy("char_start").collect()] == [(0, 0), (0, 1), (1, 2)]


def test_nothing_gives_nothing(spark):
    none = spark.createDataFrame([], "doc long, char_start long, body string")
    assert segments.section_items(none, ["doc"]).collect() == []
    lines = spark.createDataFrame([], "doc long, page long, line_no long, text string")
    assert placement.page_texts(lines).collect() == []
