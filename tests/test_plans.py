"""Stages that are made once, presets, annotation from records, hints, headers and training rows."""

import json
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanloom.functions.text import match_places
from spanloom.operators import build, spans
from spanloom.operators.fuzzy import fuzzy_match
from spanloom.operators.prompts import conversation, selection_prompt
from spanloom.plans import presets
from spanloom.plans.annotate import annotate, generate
from spanloom.plans.evaluate import ground_instructions
from spanloom.plans.stages import Stage, Stages, content_key
from spanloom.sources.files import cache_key


def test_stages_are_made_once(spark, tmp_path):
    calls = []

    def plus(rows, n):
        calls.append(("plus", n))
        return rows.withColumn("x", F.col("x") + n)

    def total(rows, other):
        calls.append(("total",))
        return rows.unionByName(other).agg(F.sum("x").alias("x"))

    a, b = spark.range(5).select(F.col("id").alias("x")), spark.range(3).select(F.col("id").alias("x"))
    plan = lambda n, v=1: [Stage("left", plus, ("a",), {"n": n}), Stage("right", plus, ("b",), {"n": 1}, v), Stage("sum", total, ("left", "right"))]

    def run(sources, *plan):
        stages = Stages(spark, str(tmp_path / "root"), sources)
        out = stages.run(*plan)["sum"].first()["x"]
        return out, stages.made, stages.read

    assert run({"a": a, "b": b}, *plan(2)) == (26, ["left", "right", "sum"], [])
    assert run({"a": a, "b": b}, *plan(2)) == (26, [], ["left", "right", "sum"])
    assert run({"a": a.repartition(3).orderBy("x", ascending=False), "b": b}, *plan(2)) == (26, [], ["left", "right", "sum"])  # the same rows
    assert run({"a": a, "b": b}, *plan(3)) == (31, ["left", "sum"], ["right"])
    assert run({"a": a, "b": b}, *plan(3, 2))[1:] == (["right"], ["left", "sum"]) or run({"a": a, "b": b}, *plan(3, 2))[0] == 31
    assert run({"a": a, "b": b.where("x > 0")}, *plan(2)) == (25, ["right", "sum"], ["left"])
    assert len(calls) == 3 + 2 + 2 + 2
    # A table without its mark was cut off and is made again.
    stages = Stages(spark, str(tmp_path / "cut"), {"a": a})
    stages.run(Stage("left", plus, ("a",), {"n": 2}))
    (mark,) = (tmp_path / "cut").glob("*.done")
    for f in mark.iterdir():
        f.unlink()
    mark.rmdir()
    again = Stages(spark, str(tmp_path / "cut"), {"a": a})
    again.run(Stage("left", plus, ("a",), {"n": 2}))
    assert again.made == ["left"]
    with pytest.raises(ValueError, match="needs nothing_there"):
        stages.run(Stage("x", plus, ("nothing_there",)))
    assert content_key(a) != content_key(a.unionByName(a)) != content_key(a.unionByName(a).unionByName(a))


TEXT = "one two three four five six"


def preset_tables(spark):
    samples = [(f"s{i}", i // 2, i, "code" if i % 4 > 1 else "text", i == 8, f"Select {i}.") for i in range(10)]
    spots = {"GPT4": [(0, 7)], "Claude3-Opus": [(0, 3)], "Gemini-1.5": [(0, 7), (14, 18)]}
    groups = [(f"s{i}", m, 0, *p) for i in range(10) for m, ps in spots.items() for p in ps if not (i == 3 and m == "GPT4")]
    return {
        "samples": spark.createDataFrame(samples, "sample_id string, set_id int, ord int, type string, is_negative boolean, instruction string"),
        "groups": spark.createDataFrame(groups, "sample_id string, group_id string, doc_id int, start_pos int, end_pos int"),
        "docs": spark.createDataFrame([(f"s{i}", 0, TEXT) for i in range(10)], "sample_id string, doc_id int, text string"),
    }


def test_presets_and_what_they_share(spark, tmp_path):
    root, tables = str(tmp_path), preset_tables(spark)
    said = lambda rows: {r["sample_id"]: [s["content"] for s in r["selections"]] for r in rows.collect()}
    first = Stages(spark, root, tables)
    out = presets.build_preset(first, "majority", "You select.")
    assert first.made == ["splits", "filtered", "answers", "conversations"]
    got = said(out["answers"])
    assert got.pop("s8") == [] and "s3" not in got and set(map(tuple, got.values())) == {("one two",)} and len(got) == 8
    talk = out["conversations"].where("sample_id = 's1'").first()["conversations"]
    assert [(t["role"]) for t in talk] == ["system", "user", "assistant"] and talk[1]["content"].startswith("Select 1.\n\nDoc #0:") and json.loads(talk[2]["content"].split("\n\n", 1)[1]) == ["one two"]
    # The same again reads all; others share what they can.
    again = Stages(spark, root, tables)
    presets.build_preset(again, "majority", "You select.")
    assert again.made == [] and len(again.read) == 4
    union = Stages(spark, root, tables)
    got = said(presets.build_preset(union, "union", "You select.")["answers"])
    assert union.read == ["splits"] and got["s1"] == ["one two", "four"]
    gpt = Stages(spark, root, tables)
    got = said(presets.build_preset(gpt, "gpt4", "You select.")["answers"])
    assert gpt.read == ["splits", "filtered"] and got["s1"] == ["one two"]
    k1 = said(presets.build_preset(Stages(spark, root, tables), "k1-union", "")["answers"])
    assert sorted(k1) == ["s0", "s2", "s4", "s6", "s8"]
    two = said(presets.build_preset(Stages(spark, root, tables), "union-gpt4-gemini", "")["answers"])
    assert two["s1"] == ["one two", "four"]
    assert said(presets.build_preset(Stages(spark, root, tables), "intersect", "")["answers"])["s1"] == ["one"]
    single = said(presets.build_preset(Stages(spark, root, {**tables, "groups": tables["groups"].where("group_id = 'GPT4'")}), "single-step", "")["answers"])
    assert single["s0"] == ["one two"] and sorted(single) == ["s0", "s2", "s4", "s6", "s8"]
    splits = out["splits"].toPandas()
    assert len(splits) == 5 and set(splits["split"]) <= {"train", "dev", "test"}


def test_best_answers(spark):
    tables = preset_tables(spark)
    kept = presets.kept_groups(tables["samples"], tables["groups"], tables["docs"])
    splits = presets.set_splits(tables["samples"], 42)
    got = {r["sample_id"]: r["group_id"] for r in presets.answers(tables["samples"], kept, tables["docs"], splits, "best").collect()}
    assert got.pop("s8") is None and set(got.values()) == {"GPT4"}


def test_annotation_from_records(spark):
    docs = [(0, "a.txt", "The cat sat on the mat. A dog ran away."), (1, "b.txt", "A dog ran away. Birds sing.")]
    kind = "sample_id string, type string, is_negative boolean, docs array<struct<id:int,filename:string,text:string>>"
    samples = spark.createDataFrame([("s1", "text", False, docs), ("s2", "code", False, docs), ("s3", "text", True, docs)], kind)
    guide = F.lit("Select as told.")
    prompt = F.concat(F.lit("Write two instructions for "), F.col("sample_id"))
    asked = samples.withColumns({"model": F.lit("Writer"), "conversations": conversation(prompt)})
    lists = {"s1": "1. Find animals.\n2. Find places.\n", "s3": "1. Find cars.\n2. Find trains.\n"}
    keyed = asked.select("sample_id", cache_key(F.struct("model", "conversations")).alias("key")).collect()
    record = [(r["key"], lists[r["sample_id"]]) for r in keyed if r["sample_id"] in lists]
    table = lambda rows: spark.createDataFrame(rows, "key string, completion string")
    written = generate(samples, table(record), "Writer", prompt)
    got = {r["sample_id"]: r["instructions"] for r in written.collect()}
    assert got == {"s1": ["Find animals", "Find places"], "s2": None, "s3": ["Find cars", "Find trains"]}

    asked = written.where("instructions is not null").withColumn("model", F.explode(F.array(*map(F.lit, ("A", "B", "C", "D"))))).withColumn("conversations", conversation(selection_prompt(guide, F.col("instructions"), F.col("docs"), F.col("type") == "code")))
    five = lambda d: json.dumps([x for kv in d.items() for x in kv])
    said = {
        "A": five({"0": ["The cat", "A dog", "a bus"], "1": ["the mat", None]}),
        "B": five({"Find all animals": ["Birds", " "], "Something else": []}),
        "C": "no idea",
        "D": five({"only one": ["x"], "two": [], "three": []}),
    }
    record = [(r["key"], said[r["model"]]) for r in asked.select("model", "sample_id", cache_key(F.struct("model", "conversations")).alias("key")).collect() if r["sample_id"] == "s1"]
    groups, report = annotate(written, table(record), ["A", "B", "C", "D", "E"], guide, n=2)
    told = {(r["sample_id"], r["model"]): (r["status"], r["n_differs"]) for r in report.collect()}
    assert told[("s1", "A")] == ("read", 0) and told[("s1", "B")] == ("read", 1) and told[("s1", "C")][0] == "unreadable" and told[("s1", "E")][0] == "missing" and told[("s3", "A")][0] == "missing"
    rows = sorted((r["inst_id"], r["group_id"], r["doc_id"], r["start_pos"], r["mode"]) for r in groups.where("doc_id is not null").collect())
    assert ("s1.inst-0", "A", 0, 0, "exact_match") in rows and ("s1.inst-0", "A", 0, 24, "exact_match") in rows and ("s1.inst-1", "A", 0, 15, "exact_match") in rows
    assert ("s1.inst-0", "A", -1, -1, "hallucination") in rows and ("s1.inst-0", "B", 1, 16, "exact_match") in rows and ("s1.inst-0", "B", -1, -1, "whitespace") in rows
    empty = {(r["inst_id"], r["group_id"]) for r in groups.where("doc_id is null").collect()}
    assert empty == {("s1.inst-1", "B"), ("s3.inst-0", "Negative"), ("s3.inst-1", "Negative")}


def test_hints_decide_between_documents(spark):
    text = "the quick brown fox jumps over the lazy dog today"
    docs = spark.createDataFrame([("s", i, text) for i in range(3)] + [("t", 0, text)], "sample_id string, doc_id int, text string")
    near = "the quick brown fox leaps over the lazy dog today"
    maps = spark.createDataFrame([("s", {"a": [("fox jumps", 2), ("fox jumps", None), ("FOX jumps", 1), (near, 1), (near, None), (near, 9), (None, 1)]}), ("t", {"a": [("fox jumps", 2)]})], "sample_id string, selections map<string,array<struct<span:string,hint:int>>>")
    got = {(r["sample_id"], r["span_ord"]): (r["doc_id"], r["mode"]) for r in ground_instructions(maps, docs).collect()}
    assert got == {("s", 0): (2, "exact_match"), ("s", 1): (0, "exact_match"), ("s", 2): (1, "normalized_match"), ("s", 3): (1, "fuzzy_match"), ("s", 4): (0, "fuzzy_match"), ("s", 5): (0, "fuzzy_match"), ("t", 0): (0, "exact_match")}
    wanted = spark.createDataFrame([(7, near)], "span_id int, span string")
    every = spark.createDataFrame([(0, text + " x"), (1, text), (2, near.replace("leaps", "leaps"))], "doc_id int, text string")
    hint = spark.createDataFrame([(7, 1)], "span_id int, doc_id int")
    assert fuzzy_match(wanted, every.where("doc_id < 2"), hints=hint).first()["doc_id"] == 1
    assert fuzzy_match(wanted, every, hints=hint).first()["doc_id"] == 2  # a nearer match wins over the hint


def test_places_of_matches(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab#é\U0001f600\n") for _ in range(rng.randrange(60))) for _ in range(200)] + ["", "###", "x" * 5000 + "#" + "y" * 5000, "#a" * 3000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i int, t string").select("i", match_places(F.col("t"), "#+|a").alias("p")).collect()
    got = {r["i"]: r["p"] and [tuple(x) for x in r["p"]] or r["p"] for r in rows}
    assert got[-1] is None
    for i, t in enumerate(texts):
        assert got[i] == [(m.start(), m.end(), m[0]) for m in re.finditer("#+|a", t)]


def test_spans_go_to_their_headers(spark):
    text = " \n=0=\n\nfirst\n=12=\n\nsecond\n=3=\n\nthird"
    texts = spark.createDataFrame([("m", text), ("one", "plain =5= text"), ("none", None)], "sample_id string, text string")
    places = [("m", text.index(w), text.index(w) + len(w), w) for w in ("first", "second", "third")] + [("m", 0, 1, "before"), ("one", 6, 9, "plain"), ("m", text.index("=12="), text.index("second"), "header's end")]
    rows = spark.createDataFrame(places, "sample_id string, start_pos int, end_pos int, w string")
    got = {r["w"]: (r["doc_id"], r["start_pos"], r["end_pos"]) for r in spans.by_header(rows, texts, r"\n?=(\d+)=\n\n").collect()}
    assert got == {"first": (0, 0, 5), "second": (12, 0, 6), "third": (3, 0, 5), "before": (None, None, None), "plain": (0, 6, 9), "header's end": (12, -6, 0)}


def test_training_rows(spark):
    ids = [f"a.{i}" for i in range(101)] + [f"b.c.{i}" for i in range(33)] + [str(i) for i in range(7)]
    rows = spark.createDataFrame([(i,) for i in ids], "sample_id string").repartition(4)
    for share in (0.1, 0.5, 1.0, 0.0):
        got = Counter(r["sample_id"].split(".")[0] if "." in r["sample_id"] else "NEG" for r in build.training_share(rows, "sample_id", share).collect())
        assert sum(got.values()) == int(len(ids) * share)
        for s, n in (("a", 101), ("b", 33), ("NEG", 7)):
            assert abs(got[s] - n * share) <= 1
    out = build.shuffled(rows, "sample_id", partitions=6)
    parts = out.rdd.glom().map(lambda p: [r["sample_id"] for r in p]).collect()
    assert sorted(x for p in parts for x in p) == sorted(ids) and [x for p in parts for x in p] == [x for p in build.shuffled(rows.repartition(9), "sample_id", partitions=6).rdd.glom().map(lambda p: [r["sample_id"] for r in p]).collect() for x in p]
    assert [x for p in parts for x in p] != sorted(ids) and max(map(len, parts)) < 3 * len(ids) / 6
