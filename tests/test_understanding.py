"""Question understanding against plain versions, on more rows than the small tables have."""

from inkwell.operators import understanding


def test_document_matches_of_every_question(spark):
    labels = [f"Guidance {i} on {'é' * (i % 5)}trials" for i in range(90)] + ["Guidance 7 on trials", None]
    registry = [(f"D{i}", x) for i, x in enumerate(labels)]
    texts = [None, "", " d3 ", "D91", "D400", "é", "ÉÉ", "guidance", "guidance 12 on", "guidance 12 on éétrials and more", "nce 44 on éééétr", "n", *[f"d{i}" for i in range(60)], *[f"ce {i} on" for i in range(60)]]
    want = {}
    for i, t in enumerate(texts):
        q = t if t is None else t.strip(" ").lower()
        named = max((x for r, x in registry if r.lower() == q and x), default=None)
        held = {x for _, x in registry if q is not None and x and q in x.lower()}
        want[i] = (1, named) if named else (len(held), min(held) if len(held) == 1 else None)
    got = understanding.document_matches(spark.createDataFrame(list(enumerate(texts)), "q long, text string"), spark.createDataFrame(registry, "reg_id string, label string"), "q")
    assert sorted((r["q"], r["n_matches"], r["resolved"]) for r in got.collect()) == sorted((i, *x) for i, x in want.items())
