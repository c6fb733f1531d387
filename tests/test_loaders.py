"""Loaders, prompts and reports on tiny inputs with known results."""

import json

import pytest
from pyspark.sql import functions as F

from spanloom.functions import repair
from spanloom.functions import text as tx
from spanloom.operators import build, loaders, metrics, prompts, reports
from spanloom.sources import files


def test_annotated_articles(spark):
    paragraphs = [[{"text": "Title"}, {"text": ""}], [{"text": "By"}, {"text": "line"}]] + [[{"text": f"S{k}"}, {"text": f" says {k}. "}] for k in range(13)]
    article = json.dumps({"paragraphs": paragraphs})
    answers = [{"topic-segment-2": "level-1", "topic-segment-4": "not-in-summary", "topic-segment-6": "level-3", "comments": "x"}, {}]
    rows = [(0, "h2", article, json.dumps([answers[0]])), (1, "h1", article, json.dumps([answers[1]])), (2, "h2", article, json.dumps([answers[0]]))]
    docs, refs = loaders.annotated_articles(spark.createDataFrame(rows, "row int, task_id string, article string, answers string"), "AspectNews.x", 80)
    texts = {r["sample_id"]: r for r in docs.collect()}
    assert set(texts) == {"AspectNews.x_80", "AspectNews.x_81"}
    first = texts["AspectNews.x_80"]
    assert first["text"].split("\n") == [f"S{k} says {k}." for k in range(11)]
    assert first["chunks_pos"][-1] == len(first["text"]) and first["chunks_pos"][:2] == [11, 22]
    got = [(r["sample_id"], r["group_ord"], r["content"], r["importance"], r["start_pos"], r["end_pos"]) for r in refs.orderBy("sample_id", "group_ord", "sel_ord").collect()]
    assert got == [("AspectNews.x_80", g, *x) for g in (0, 1) for x in (("S2 says 2.", 3, 22, 32), ("S0 says 0.", 1, 0, 10))]
    assert loaders.sample_violations(refs, docs, sentences=True).count() == 0
    assert loaders.ordered_selections(refs, docs).where("sel_ord = 0").select("content").distinct().first()[0] == "S0 says 0."


def test_claims_put_evidence_first(spark):
    corpus = spark.createDataFrame([(7, "T7", ["One a. ", "Two b."]), (8, "T8", ["Three."]), (9, "T9", ["Four."])], "doc_id int, title string, abstract array<string>")
    raw = spark.createDataFrame([(1, "A claim.", [(8, [0]), (7, [1])], [9, 7, 8])], "id int, claim string, evidence array<struct<doc_id:int,sentences:array<int>>>, cited_doc_ids array<int>")
    docs, refs = loaders.claims(raw, corpus, "SciFact")
    assert [(r["doc_id"], r["filename"]) for r in docs.orderBy("doc_id").collect()] == [(0, "T8"), (1, "T7"), (2, "T9")]
    assert sorted((r["doc_id"], r["start_pos"], r["content"]) for r in refs.collect()) == [(0, 0, "Three."), (1, 7, "Two b.")]
    assert spark.range(1).select(loaders.claim_text(F.lit(" A claim. "))).first()[0] == "A claim"


def test_answer_text_is_indented_json(spark):
    kind = "array<struct<doc_id:int,start_pos:int,end_pos:int,content:string>>"
    rows = spark.createDataFrame([(0, [(0, 5, 6, 'b "q"'), (0, 0, 1, "a"), (-1, -1, -1, "lost")]), (1, [])], f"i int, s {kind}")
    got = {r["i"]: r["a"] for r in rows.select("i", build.answer(F.col("s")).alias("a")).collect()}
    assert got[0] == "Selected Content:\n\n" + json.dumps(["a", 'b "q"'], indent=4) and got[1] == "Selected Content:\n\n[]"


def test_numbered_lists_and_both_lists():
    assert repair.parse_numbered('1. "First."\n2. Second:\n') == ["First", "Second"]
    assert repair.parse_both('[["a", "b"], [["x"], ["y"]]]', 2) == {"a": ["x"], "b": ["y"]}
    assert repair.parse_both('[["a"], ["x", "y"]]', 1) == {"a": ["x", "y"]} == repair.parse_both('[["a"], [["x"], ["y"]]]', 1)
    for raw in ("nonsense", '["a"]', '[["a"], [1]]'):
        with pytest.raises(ValueError):
            repair.parse_both(raw, 1)


def test_interval_uses_students_t(spark):
    rows = spark.createDataFrame([("a", 0.2), ("a", 0.4), ("a", None), ("b", 0.5)], "k string, f1 double")
    got = {r["k"]: r for r in reports.interval(rows, "f1", ["k"]).collect()}
    sd = ((0.0**2 + 0.2**2 + 0.2**2) / 2) ** 0.5
    assert got["a"]["half_width"] == pytest.approx(metrics.t_quantile(0.95, 2) * sd / 3**0.5) and got["b"]["half_width"] is None
    assert [r[0] for r in spark.createDataFrame([(0.12345,), (0.12355,)], "x double").select(reports.percent(F.col("x"))).collect()] == pytest.approx([12.34, 12.36])


def test_tables_as_text(spark):
    table = spark.createDataFrame([("a_b", 1.234, None), ("c|d", 2.0, 3)], "name string, f1 double, n int")
    assert reports.to_markdown(table).splitlines() == ["| name | f1 | n |", "|-|-|-|", "| a_b | 1.23 |  |", "| c\\|d | 2.00 | 3 |"]
    assert r"a\_b & 1.23 &  \\" in reports.to_latex(table)


def test_unknown_data_sets_fail(spark):
    columns = ("orig_score", "ext_f1", "rouge2_p", "precision", "ext_precision", "rouge2_r", "recall", "ext_recall", "hal", "err")
    row = spark.createDataFrame([("m", "Strange")], "model string, dataset string").withColumns({c: F.lit(1.0) for c in columns})
    with pytest.raises(Exception, match="unknown data set"):
        reports.metric_row(row).collect()
    with pytest.raises(ValueError):
        loaders.answer_group(row, row, "other")


def test_unequal_instruction_lists_fail(spark):
    a = spark.createDataFrame([("s", ["x", "y"])], "sample_id string, instructions array<string>")
    with pytest.raises(Exception, match="differ in length"):
        loaders.translate_instructions(a, spark.createDataFrame([("s", ["x"])], "sample_id string, instructions array<string>")).collect()


def test_single_document_examples(spark):
    kind = "array<struct<doc_id:int,content:string>>"
    rows = spark.createDataFrame([([(0, "a"), (2, "b"), (2, "c")],)], f"s {kind}")
    assert [tuple(x) for x in rows.select(prompts.single_document(F.col("s"), F.lit(2))).first()[0]] == [(0, "b"), (0, "c")]


def test_sources(spark, tmp_path):
    (tmp_path / "12.txt").write_text("two words")
    (tmp_path / "3.txt").write_text("one")
    (tmp_path / "notes.md").write_text("x")
    assert [(r["id"], r["word_count"]) for r in files.read_books(spark, f"{tmp_path}/*.txt").collect()] == [(3, 1), (12, 2)]
    tables = {"Set/test": "/a", "all/dev": "/b"}
    assert files.resolve("SET/Test", tables) == ("/a", "SET", "Test") and files.resolve("Other/dev", tables) == ("/b", "Other", "dev")
    with pytest.raises(FileNotFoundError):
        files.resolve("none", tables, exists=lambda p: p in tables.values())
    rows = spark.createDataFrame([("x", "big", [("a",)])], "sample_id string, sample string, grounded_selection array<struct<c:string>>")
    files.write_eval_rows(rows, f"{tmp_path}/out")
    assert files.read_jsonl(spark, f"{tmp_path}/out", "sample_id string, grounded_selection string, sample string").first() == ("x", '[{"c":"a"}]', None)


def test_sentence_ends_of_many_sentences(spark):
    """Far more sentences than a block of sums holds."""
    s = [f"s{k}" * (k % 5) for k in range(9000)]
    ends = spark.createDataFrame([(s,)], "s array<string>").select(tx.chunk_ends(F.col("s"))).first()[0]
    want, at = [], 0
    for x in s:
        at += len(x) + 1
        want.append(at)
    want[-1] -= 1
    assert ends == want


def test_numbers_need_no_single_task(spark):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate([5, -3, 900, None, 17, 6, 10**12, 18])], "k int, v long")
    got = loaders.numbered(rows, "v")
    assert [r["v"] for r in sorted(got.collect(), key=lambda r: r["_p"])] == [None, -3, 5, 6, 17, 18, 900, 10**12]
    assert sorted(r["_p"] for r in got.collect()) == list(range(8))


def test_violations_of_many_spans_of_a_document(spark):
    text = "\n".join(["ab"] * 300)
    ends = [3 * k + 3 for k in range(299)] + [899]
    docs = spark.createDataFrame([("s", 0, text, ends)], "sample_id string, doc_id int, text string, chunks_pos array<int>")
    spans = [("s", 0, 3 * k, 3 * k + 2, "ab") for k in range(300)] + [("s", 0, 1, 2, "b"), ("s", 0, 0, 2, "xx"), ("s", 0, -1, 2, "ab"), ("s", 1, 0, 2, "ab"), ("s", -1, -1, -1, "q"), ("s", 0, 0, None, "ab")]
    refs = spark.createDataFrame(spans, "sample_id string, doc_id int, start_pos int, end_pos int, content string")
    found = loaders.sample_violations(refs, docs, sentences=True)
    assert {(r["sample_id"], r["rule"]): r["n"] for r in found.collect()} == {("s", "content"): 4, ("s", "edge"): 4, ("s", "grounded"): 1}
    assert "ArrayContains" not in found._jdf.queryExecution().analyzed().toString()
