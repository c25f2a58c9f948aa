from inkwell.sources.exports import export, export_rows, load_questions


def test_exports_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, ["a", 'b "x"'], "q,1"), (2, None, None)], "entry_id long, tags array<string>, question string")
    out = export_rows(rows, ["question", "missing", "tags"], rest=True)
    assert out.columns == ["question", "missing", "tags", "entry_id"]
    export(out, f"{tmp_path}/c", "xlsx")
    back = spark.read.csv(f"{tmp_path}/c", header=True, escape='"').orderBy("entry_id").collect()
    assert [tuple(r) for r in back] == [("q,1", None, 'a | b "x"', "1"), (None, None, None, "2")]
    export(out, f"{tmp_path}/j", "json")
    assert spark.read.json(f"{tmp_path}/j").count() == 2


def test_questions(spark, tmp_path):
    (tmp_path / "q.csv").write_text('question,who\n"What, ""exactly""?",a\nplain one,b\n\n')
    (tmp_path / "q.txt").write_text("  one \n\n two, and more\n")
    assert [r.question for r in load_questions(spark, f"{tmp_path}/q.csv").collect()] == ['What, "exactly"?', "plain one"]
    assert [r.question for r in load_questions(spark, f"{tmp_path}/q.txt").collect()] == ["one", "two, and more"]
