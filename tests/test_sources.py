"""Sources of raw samples, readers with rules, and worked examples end to end."""

import pytest
from pyspark.sql import functions as F

from spanloom.operators import loaders, reports, sampling
from spanloom.plans import icl
from spanloom.sources import files


def words(n, w="w"):
    return " ".join([w] * n)


def test_seven_forms_of_source(spark):
    rows = {
        "books": spark.createDataFrame([(7, words(12))], "id long, content string"),
        "emails": spark.createDataFrame([("a/b/c/d/1.", words(12), 2), ("x", words(12), 0)], "id string, content string, chain_count int"),
        "news": spark.createDataFrame([(3, [(["a b", "c"],), (["d"],)])], "instance_id long, documents array<struct<text:array<string>>>"),
        "reviews": spark.createDataFrame([(4, [("good", "“Nice”", 11), ("bad", None, 12)])], "hotel_id long, reviews array<struct<content:string,title:string,review_id:long>>"),
        "code": spark.createDataFrame([(5, "me/repo", [("x = 1", "a.py")])], "cluster_id long, repo_name string, documents array<struct<content:string,filename:string>>"),
        "wiki": spark.createDataFrame([(6, "Title", "\n\n".join(f"p{k}" for k in range(40)))], "id long, title string, text string"),
        "abstracts": spark.createDataFrame([(8, None, "only these three"), (9, "A title", None)], "id long, title string, content string"),
    }
    out = {r["id"]: r for r in sampling.sample_pool(rows, n=5, least=1, most=50).collect()}
    assert sorted((i, r["type"], r["word_count"]) for i, r in out.items()) == sorted(
        [("pg-19.7", "book", 12), ("enron.c/d/1.", "email", 12), ("enron.x", "email", 12), ("multinews.multinews.3", "news_article", 4), ("tripadvisor.4", "hotel_reviews", 2), ("github.5", "code", 3), ("wiki.6", "wiki", 30), ("pubmed.8", "abstract", 3)]
    )
    assert [d["text"] for d in out["multinews.multinews.3"]["documents"]] == ["a b\nc", "d"]
    assert [(d["id"], d["filename"], d["metadata"]["review_id"]) for d in out["tripadvisor.4"]["documents"]] == [(0, "Nice", "11"), (1, "", "12")]
    assert out["github.5"]["documents"][0]["metadata"] == {"file_id": "me/repo/a.py"} and out["wiki.6"]["documents"][0]["text"].endswith("p28")
    assert out["pubmed.8"]["documents"][0]["text"] == "\n\nonly these three"


def test_draws_and_negatives(spark):
    mails = spark.createDataFrame([(str(i), words(10 + i % 3), i % 4 // 3) for i in range(200)], "id string, content string, chain_count int")
    out = sampling.sample_source("emails", mails, n=31, least=10, most=11, negative=4, negatives_from=20).toPandas().sort_values("place")
    assert len(out) == 31 and out["place"].tolist() == list(range(31)) and out["is_negative"].tolist() == [20 <= k < 24 for k in range(31)]
    chained = {f"enron.{i}" for i in range(200) if i % 4 == 3}
    assert sum(i in chained for i in out["id"]) == 16 and set(out["word_count"]) == {10, 11}
    assert sampling.sample_source("emails", mails.repartition(7), n=31, least=10, most=11).toPandas().sort_values("place")["id"].tolist() == out["id"].tolist()


def test_claim_rules_and_splits(spark):
    corpus = spark.createDataFrame([(1, "t", ["One.", "Two.", "Two. Three."]), (2, "t", ["x"]), (4, "t", ["y"]), (4, "t", ["y"])], "doc_id long, title string, abstract array<string>")
    kind = "id long, claim string, evidence array<struct<doc_id:long,sentences:array<int>>>, cited_doc_ids array<long>"
    raw = spark.createDataFrame([(10, "c", [(1, [0])], [1, 2]), (11, "c", [(1, [1, 0])], [1]), (12, "c", [(2, [0])], [1]), (13, "c", [], [3, 1]), (14, "c", [], [4, 1, 1])], kind)
    got = {(r["sample_id"], r["rule"], r["n"]) for r in loaders.claim_violations(raw, corpus, "S").collect()}
    assert got == {("S.11", "sentence", 1), ("S.12", "cited", 1), ("S.13", "corpus", 1), ("S.14", "corpus", 1)}
    many = spark.range(41)
    splits = loaders.claim_splits(many).toPandas()
    assert sorted(splits["split"].value_counts().items()) == [("dev", 7), ("train", 34)]


def test_debate_form(spark):
    raw = spark.createDataFrame([(5, "one two three", "An\n  argument", [("two", 4, 7), ("one", 0, 3)]), (6, "empty", "x", None)], "id long, document string, abstract string, spans array<struct<content:string,start_pos:int,end_pos:int>>")
    docs, refs = loaders.debates(raw)
    assert {r["sample_id"]: r["argument"] for r in docs.collect()} == {"5": "An argument", "6": "x"}
    assert [(r["sel_ord"], r["content"], r["start_pos"]) for r in refs.orderBy("sel_ord").collect()] == [(0, "two", 4), (1, "one", 0)]


def test_topics_are_numbered_without_gaps(spark, tmp_path):
    for topic, n in (("test3", 2), ("test12", 1)):
        (tmp_path / topic).mkdir()
        for k in range(n):
            (tmp_path / topic / f"{k}.txt").write_text(f"{topic} {k}")
    (tmp_path / "test3" / "notes.md").write_text("x")
    read = lambda **kw: sorted(map(tuple, files.read_topics(spark, f"{tmp_path}/test*/*.txt", **kw).collect()))
    assert read() == [(3, 0, "test3 0"), (3, 1, "test3 1"), (12, 0, "test12 0")]
    (tmp_path / "test12" / "2.txt").write_text("gap")
    with pytest.raises(ValueError, match=r"\[12\]"):
        read()
    assert len(read(check=False)) == 4


def test_mail_addresses(spark, tmp_path):
    box = tmp_path / "maildir" / "allen-p" / "inbox"
    box.mkdir(parents=True)
    (box / "1.").write_bytes(b"Message-ID: <1>\nFrom: a@x.org, b@x.org\nTo: c@x.org,\n\td@x.org, c@x.org\nSubject: hi\n\nTwo words.\n-----Original Message-----\nold")
    (box / "2.").write_bytes(b"From: a@x.org\nSubject: none\n\nbody")
    got = {r["id"]: r for r in files.read_mail(spark, str(tmp_path / "maildir")).collect()}
    one, two = got["allen-p/inbox/1."], got["allen-p/inbox/2."]
    assert (one["user"], one["from_address"], one["to_addresses"], one["chain_count"]) == ("allen-p", "a@x.org", ["c@x.org", "d@x.org"], 1)
    assert one["word_count"] == 16 and two["to_addresses"] is None and two["word_count"] == 1


def test_sheets_side_by_side(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,rating,note\n1,4,"two\nlines"\n2,5,x\n')
    (tmp_path / "b.csv").write_text("id,rating,note\n2,3,y\n3,1,z\n")
    out = files.read_sheets(spark, {"a": str(tmp_path / "a.csv"), "b": str(tmp_path / "b.csv")}, "id int, rating int, note string", ["id"])
    assert {tuple(r) for r in out.collect()} == {(1, 4, "two\nlines", None, None), (2, 5, "x", 3, "y"), (3, None, None, 1, "z")}


def test_worked_examples(spark):
    doc = "array<struct<id:int,text:string>>"
    span = "array<struct<doc_id:int,start_pos:int,end_pos:int,content:string>>"
    pool = spark.createDataFrame([(f"p{i}", f"Item {i}", [(0, f"a{i}"), (1, f"b{i}")], [(0, 0, 2, f"a{i}"), (1, 0, 2, f"b{i}")]) for i in range(6)], f"sample_id string, item string, docs {doc}, selections {span}")
    samples = spark.createDataFrame([(s, "Do.", "It", [(0, "x " + s), (1, "y")]) for s in ("p0", "p1", "p2", "p3", "q")], f"sample_id string, instruction string, item string, docs {doc}")
    for randomize in (False, True):
        got = {r["sample_id"]: [(e["item"], [d["text"] for d in e["docs"]]) for e in r["examples"]] for r in icl.with_examples(samples, pool, 2, randomize=randomize).collect()}
        assert len(got) == 5 and all(len(v) == 2 and (f"Item {s[1:]}") not in dict(v) for s, v in got.items())
        assert (len({str(v) for v in got.values()}) > 2) == randomize or not randomize
    single = {r["sample_id"]: r["examples"] for r in icl.with_examples(samples, pool, 2, single_doc=True).collect()}
    assert all(len(e["docs"]) == 1 and e["docs"][0]["id"] == 0 and f'"{e["docs"][0]["text"]}"' in e["answer"] for es in single.values() for e in es)
    none = spark.createDataFrame([], "key string, completion string")
    whole = {r["sample_id"]: r for r in icl.predict_with_examples(samples, pool, none, "m", "sys").collect()}
    assert len(whole) == 5 and whole["q"]["selection"] is None and [t["role"] for t in whole["q"]["conversations"]] == ["system", "user"]
    known = icl.predict_with_examples(samples, pool, none, "m", "sys", single_doc=True).select("sample_id", F.posexplode("conversations").alias("k", "conversations")).where("sample_id = 'q' and k = 1")
    record = known.select(files.cache_key(F.struct(F.lit("m").alias("model"), "conversations")).alias("key"), F.lit("[]").alias("completion"))
    got = {r["sample_id"]: r for r in icl.predict_with_examples(samples, pool, record, "m", "sys", single_doc=True).collect()}
    assert got["q"]["selections"] == [None, "[]"] and len(got["q"]["conversations"]) == 2


def test_two_models_tested_at_once(spark):
    rows = [("m", "d", i, float(i % 5)) for i in range(40)] + [("n", "d", i, float(i % 5) + (0.5 if i % 4 else -0.25)) for i in range(40)] + [("o", "e", 1, 1.0), ("m", "e", 1, 2.0)]
    out = {(r["a"], r["b"], r["dataset"]): r for r in reports.paired_tests(spark.createDataFrame(rows, "model string, dataset string, sample_id int, score double"), [("n", "m"), ("m", "n"), ("o", "m")], draws=300).collect()}
    better, worse, alone = out["n", "m", "d"], out["m", "n", "d"], out["o", "m", "e"]
    assert better["p_signed_rank"] < 0.001 < 0.999 < worse["p_signed_rank"] and better["p_permutation"] == pytest.approx(1 / 301) and worse["p_permutation"] is None
    assert better["w_plus"] + worse["w_plus"] == 40 * 41 / 2 and not better["apart"]
    assert alone["n"] == 1 and alone["ci_a"] is None and alone["apart"] is None
