"""Typed selections, cards, training labels and ROUGE against plain Python."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanloom import catalog
from spanloom.functions import variants
from spanloom.operators import masking, rouge
from spanloom.sources import cards


def typed(spark, values, by_document=False):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, j string")
    got = {r["i"]: r["s"] for r in rows.select("i", variants.typed_selection(F.col("j"), by_document).alias("s")).collect()}
    return [got[i] for i in range(len(values))]


def test_selections_of_every_type(spark):
    span = '{"doc_id":1,"start_pos":2,"end_pos":4,"content":"ab","metadata":{"mode":"exact"}}'
    values = [None, "null", "[]", f"[{span}]", f'[{span},{{"doc_id":1}}]', f'[{span},"x"]', '"[\\"a\\", \\"b\\"]"', '"[\\"a\\", \\"cut off"', '"nonsense"', '["a","b"]', '["a",null]', "[null]", "[1]", "1", "true", '{"a":1}', "{broken", "", '[["a"]]', '[{"doc_id":1}]', '""']
    got = typed(spark, values)
    assert [s["kind"] for s in got] == ["missing", "missing", "empty", "grounded", "unreadable", "unreadable", "parsed", "parsed", "unreadable", "parsed", "parsed", "unreadable", "unreadable", "unreadable", "unreadable", "unreadable", "unreadable", "unreadable", "unreadable", "unreadable", "unreadable"]
    assert got[2]["texts"] == [] and got[0]["texts"] is None and got[6]["texts"] == ["a", "b"] and got[7]["texts"] == ["a", "cut off"] and got[9]["texts"] == ["a", "b"] and got[10]["texts"] == ["a", None]
    assert [tuple(x) for x in got[3]["spans"]] == [(1, 2, 4, "ab")] and got[3]["texts"] is None and got[4]["spans"] is None


def test_completions_by_document(spark):
    got = typed(spark, ['["[\\"a\\"]", "no", "[\\"b\\", \\"c\\"]"]', '"[\\"a\\"]"', "[]", "null"], by_document=True)
    assert [s["texts"] for s in got] == [["a", None, "b", "c"], ["a"], [], None]


def read(spark, pages, **kw):
    rows = spark.createDataFrame([(i, h) for i, h in enumerate(pages)], "page_id long, html string")
    return [r.asDict(recursive=True) for r in cards.cards(rows, **kw).orderBy("page_id", "card").collect()]


def test_cards_of_odd_pages(spark):
    page = "<h4>Short <b>claim</b></h4><p>Author 2010</p><p>Plain <u>marked <u>run</u> on</u> and <U>m&amp;re</u>.</p><h4>No text</h4><p>cite"
    first, second = read(spark, [page])
    assert first["abstract"] == "Short claim" and first["citation"] == "Author 2010" and first["document"] == "Plain marked run on and m&re."
    assert [(s["start_pos"], s["end_pos"], s["content"]) for s in first["spans"]] == [(6, 19, "marked run on"), (24, 28, "m&re")]
    assert (second["abstract"], second["citation"], second["document"], second["spans"]) == ("No text", "cite", None, None)
    # Headings without paragraphs of their own share the next ones; open paragraphs and marks end where a block begins.
    shared = "<h4>a</h4><h4>b</h4><p>c<u>x<p>d<u>e<div>f</div><script><p>no</p></script><h4>last</h4>"
    got = read(spark, [shared, None, "", "<p>x</p><p>y</p>"])
    assert [(r["abstract"], r["citation"], r["document"]) for r in got] == [("a", "cx", "de"), ("b", "cx", "de"), ("last", None, None)]
    assert [[s["content"] for s in r["spans"] or []] for r in got] == [["e"], ["e"], []]
    assert read(spark, ["<h1>t</h1><p>c</p><p>one <b>two</b></p>"], heading="h1", mark="b")[0]["spans"][0]["content"] == "two"


def test_cards_of_a_long_page_come_in_order(spark):
    rng = random.Random(1)
    texts = [" ".join("w" * rng.randrange(1, 9) for _ in range(400)) for _ in range(60)]
    html = "".join(f"<h4>h{k}</h4><p>c{k}</p><p>{t[: k * 9]}<u>{t[k * 9 : k * 9 + 50]}</u>{t[k * 9 + 50 :]}</p>" for k, t in enumerate(texts))
    got = read(spark, [html])
    assert [r["document"] for r in got] == texts and [r["abstract"] for r in got] == [f"h{k}" for k in range(60)]
    assert [(r["spans"][0]["start_pos"], r["spans"][0]["content"]) for r in got] == [(k * 9, t[k * 9 : k * 9 + 50]) for k, t in enumerate(texts)]


def test_card_rules_in_their_order(spark):
    words = lambda n, w="w": " ".join(f"{w}{k}" for k in range(n))
    card = lambda abstract, doc, marked: f"<h4>{abstract}</h4><p>c</p><p>{doc} <u>{marked}</u></p>"
    pages = [
        card(words(4), words(20), words(11, "m")) + "<h4>x</h4><p>only</p>",
        card(words(4), words(20), words(11, "m")),  # the same document
        card(words(3), words(25), words(11, "m")),  # short abstract
        card(words(4), words(26), words(10, "m")),  # short extract
        card(words(4), words(26), words(10, "m")),  # a copy of a card that did not pass
        card(words(40), words(20), words(12, "m")),  # abstract as long as the document
        card(words(4), "", words(30)),  # all is marked
        card(words(4), words(2), words(9, "m")) + card(words(5), words(30), words(12, "m")) + card(words(5), words(31), words(12, "m")) + "<h4>none</h4>",
    ]
    rows = spark.createDataFrame([(i, h, "user's", 5) for i, h in enumerate(pages)], "page_id long, html string, status string, card int").repartition(3)
    judged = cards.judge_cards(cards.cards(rows.select("page_id", "html")))
    got = [(r["page_id"], r["status"], r["card_id"]) for r in judged.orderBy("page_id", "card").collect()]
    assert got == [(0, "valid", 0), (0, "empty", None), (1, "duplicate", None), (2, "too_short", None), (3, "too_short", None), (4, "duplicate", None), (5, "too_long", None), (6, "too_long", None), (7, "too_short", None), (7, "valid", 0), (7, "valid", 1), (7, "no_paragraph", None)]
    assert {r["status"]: r["n"] for r in cards.skip_counts(judged).collect()} == {"valid": 3, "empty": 1, "duplicate": 2, "too_short": 3, "too_long": 2, "no_paragraph": 1, "total": 12}


def plain_labels(ids, roles, sep, length):
    """Token by token, as a training loop would mask in place."""
    ids = ids[:length]
    labels, k, ends = list(ids), 0, []
    for i in range(len(ids)):
        if ids[i : i + len(sep)] == sep:
            ends.append((roles[k], i))
            k += 1
    start = 0
    for role, end in ends:
        if role != "assistant":
            labels[start : end + len(sep)] = [-100] * (end + len(sep) - start)
        start = end
    return labels, len(roles) > len(ends)


@pytest.mark.parametrize("sep", [[9], [9, 8]])
def test_masks_like_a_loop(spark, sep):
    rng, rows = random.Random(len(sep)), []
    for i in range(120):
        roles = [rng.choice(["system", "user", "assistant"]) for _ in range(rng.randrange(6))]
        ids = [t for _ in roles for t in [*(rng.randrange(8) for _ in range(rng.randrange(5))), *sep]] + [rng.randrange(8)] * rng.randrange(3)
        rows.append((i, ids, roles, "x"))
    rows.append((900, None, ["user"], "x"))
    df = spark.createDataFrame(rows, "i int, input_ids array<int>, roles array<string>, labels_of string")
    for length in (1000, 11, 0):
        got = {r["i"]: r for r in masking.mask_labels(df, sep, length).collect()}
        for i, ids, roles, _ in rows:
            assert (got[i]["labels"], got[i]["too_long"]) == plain_labels(ids or [], roles, sep, length)
    with pytest.raises(Exception, match="more separators"):
        masking.mask_labels(df.withColumn("roles", F.array(F.lit("user"))), sep, 1000).collect()
    one = spark.createDataFrame([([1, 9, 2, 3], ["user", "user"])], "input_ids array<int>, roles array<string>")
    assert masking.mask_labels(one, [9], 10, mask_tail=True, pad_id=3).first()["labels"] == [-100] * 4
    assert masking.mask_labels(one, [9], 10, pad_id=3).first()["attention_mask"] == [True, True, True, False]


def test_conversations_keep_or_merge_the_first_turn(spark):
    rows = spark.createDataFrame([(1, 0, "system", "be brief"), (1, 1, "user", "hi"), (1, 2, "assistant", "yes")], "c long, turn long, role string, text string")
    for system, roles in (("keep", ["system", "user", "assistant"]), ("drop", ["user", "assistant"]), ("merge", ["user", "assistant"])):
        r = masking.conversation_labels(rows, ["c"], system=system).first()
        assert r["roles"] == roles and not r["too_long"]
        assert r["labels"].count(-100) == len(r["labels"]) - 4  # the answer's opening, role, word and closing
    with pytest.raises(ValueError):
        masking.turns_of(rows, ["c"], "other")


def lcs(a, b):
    t = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, t[j] = t[j], before + 1 if x == y else max(t[j], t[j - 1])
    return t[-1]


def test_rouge_like_tables(spark):
    rng = random.Random(5)
    vocabulary = ["running", "runs", "Run", "the", "nationally", "nation", "x1", "été", "ponies", "caresses", "sky", "12", "Generously"]
    text = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ",", " -", "\n"]) for _ in range(n))
    rows = [(i, text(rng.randrange(60)), text(rng.randrange(200))) for i in range(60)] + [(90, None, "a"), (91, "", ""), (92, "é", "été"), (93, "word " * 3000, "word other " * 2000)]
    got = {r["i"]: r for r in rouge.rouge(spark.createDataFrame(rows, "i int, ref string, pred string").repartition(4), ["i"], F.col("ref"), F.col("pred")).collect()}
    for i, ref, pred in rows:
        a, b = ([rouge.stem(w) if len(w) > 3 else w for w in re.findall("[a-z0-9]+", (t or "").lower())] for t in (ref, pred))
        want = []
        for n in (1, 2):
            x, y = (Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) for w in (a, b))
            want.append((sum((x & y).values()), sum(x.values()), sum(y.values())))
        if len(a) * len(b) < 10**6:
            want.append((lcs(a, b), len(a), len(b)))
        for name, (hits, n, m) in zip(("rouge1", "rouge2", "rougel"), want, strict=False):
            p, r = hits / m if m else 0.0, hits / n if n else 0.0
            assert (got[i][f"{name}_p"], got[i][f"{name}_r"], got[i][f"{name}_f"]) == pytest.approx((p, r, 2 * p * r / (p + r) if p + r else 0.0))
    assert got[93]["rougel_r"] == pytest.approx(2000 / 3000)


#: Porter's published examples and the amendments'.
STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "tie", "cats": "cat", "agreed": "agre", "feed": "feed", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat",
    "troubled": "troubl", "sized": "size", "hopping": "hop", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "relational": "relat",
    "conditional": "condit", "rational": "ration", "digitizer": "digit", "radicalli": "radic", "vietnamization": "vietnam", "predication": "predic", "operator": "oper", "feudalism": "feudal",
    "decisiveness": "decis", "hopefulness": "hope", "formaliti": "formal", "sensibiliti": "sensibl", "triplicate": "triplic", "formative": "form", "electrical": "electr", "goodness": "good", "revival": "reviv",
    "airliner": "airlin", "adjustable": "adjust", "replacement": "replac", "adoption": "adopt", "communism": "commun", "bowdlerize": "bowdler", "probate": "probat", "rate": "rate", "cease": "ceas",
    "controll": "control", "roll": "roll", "dying": "die", "skies": "sky", "enjoy": "enjoy", "spied": "spi", "died": "die", "innings": "inning", "hopefulli": "hope", "geologi": "geolog",
}


def test_stems():
    assert {w: rouge.stem(w) for w in STEMS} == STEMS


def test_filter_of_annotated_samples(spark):
    text = "one two three four five six"
    docs = spark.createDataFrame([(s, 0, text) for s in "abcdefgh"], "sample_id string, doc_id int, text string")
    samples = spark.createDataFrame([(s, s == "g", "set" if s in "abcdef" else s, i) for i, s in enumerate("abcdefgh")], "sample_id string, is_negative boolean, set_id string, ord int")
    two, one, lost, none = (0, 0, 7), (0, 0, 3), (-1, -1, -1), (None, None, None)
    spans = {
        "a": {"x": [two], "y": [one], "z": [two, lost]},  # two votes for both words
        "b": {"x": [two], "y": [lost], "z": [two]},  # a group is left empty
        "c": {"x": [one], "y": [(0, 4, 7)], "z": [(0, 8, 13)]},  # nothing in common
        "d": {"x": [one], "y": [one], "z": [one]},
        "e": {"x": [two], "y": [two], "z": [none]},  # an annotator who chose nothing
        "f": {"x": [one], "y": [one], "z": [one]},
        "g": {"x": [lost], "y": [none]},
    }
    rows = [(s, g, *p) for s, groups in spans.items() for g, places in groups.items() for p in places]
    groups = spark.createDataFrame(rows, "sample_id string, group_id string, doc_id int, start_pos int, end_pos int").repartition(3)
    from pyspark.sql import Observation

    from spanloom.operators import filtering

    seen = Observation()
    kept, decisions = filtering.filter_annotated(samples, groups, docs, least_votes=2, least_agreement=0.5, first=2, observation=seen)
    got = {r["sample_id"]: (r["n_groups"], r["n_dropped"], r["status"]) for r in decisions.collect()}
    assert got == {"a": (3, 0, None), "b": (2, 1, "partial_annotators"), "c": (3, 0, "low_agreement"), "d": (3, 0, None), "e": (2, 1, "partial_annotators"), "f": (3, 0, "beyond_first"), "g": (0, 0, None), "h": (0, 0, "partial_annotators")}
    assert seen.get == {"samples": 8, "kept": 3, "partial_annotators": 3, "low_agreement": 1, "empty_merge": 0, "beyond_first": 1, "dropped_groups": 2}
    assert {(r["sample_id"], r["group_id"], r["start_pos"], r["end_pos"]) for r in kept.collect()} == {("a", "x", 0, 7), ("a", "y", 0, 3), ("a", "z", 0, 7), ("a", "Merged", 0, 7), *(("d", g, 0, 3) for g in ("x", "y", "z", "Merged")), ("g", "x", -1, -1), ("g", "y", None, None)}
    # Emptied groups may stay, empty answers too; voters may be few.
    kept, decisions = filtering.filter_annotated(samples, groups, docs, least_votes=2, keep_emptied=True, skip_empty=False, voters=["x", "y"])
    got = {r["sample_id"]: (r["n_groups"], r["n_merged"], r["status"]) for r in decisions.collect()}
    assert got == {"a": (3, 1, None), "b": (3, 0, None), "c": (3, 0, None), "d": (3, 1, None), "e": (3, 2, None), "f": (3, 1, None), "g": (0, 0, None), "h": (0, 0, "partial_annotators")}
    rows = {(r["sample_id"], r["group_id"], r["start_pos"]) for r in kept.where("sample_id in ('b', 'e')").collect()}
    assert rows == {("b", "x", 0), ("b", "y", None), ("b", "z", 0), ("b", "Merged", None), ("e", "x", 0), ("e", "y", 0), ("e", "z", None), ("e", "Merged", 0)}
    kept, _ = filtering.filter_annotated(samples, groups, docs, drop_ungrounded=False)
    assert {(r["group_id"], r["start_pos"]) for r in kept.where("sample_id = 'b'").collect()} == {("x", 0), ("y", -1), ("z", 0), ("Merged", 0)}


def test_lengths_are_squared_beyond_integers(spark, tmp_path):
    texts = ["x" * 60_000 + "\nab\n" + "y" * 50_000, "z" * 70_000]
    rows = [(3 * k, t, "en", "s", len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["rater"]: r for r in catalog.QUERIES["dataset_stats"](spark, str(tmp_path)).collect()}
    assert got[0]["density"] == 65_000 and got[0]["n_sel"] == 2
