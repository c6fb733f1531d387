"""Small cases with known answers."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanloom import catalog
from spanloom.functions import repair
from spanloom.functions import text as tx
from spanloom.operators import agreement, fuzzy, grounding, loaders, metrics, reports, spans
from spanloom.plans.evaluate import evaluate, validate
from spanloom.sources import files
from spanloom.streaming.rowwise import parse_stream


def test_evaluate_two_samples(spark):
    long = "Hello world.\n" + "long " * 15 + "done.\n"
    docs = spark.createDataFrame([("a", 0, long), ("b", 0, "Some other text here.")], "sample_id string, doc_id int, text string")
    refs = spark.createDataFrame([("a", 0, 0, 0, 11), ("a", 0, 0, 13, 13 + 65), ("a", 1, None, None, None), ("b", 0, 0, 0, 4)], "sample_id string, group_ord int, doc_id int, start_pos int, end_pos int")
    preds = spark.createDataFrame([("a", '["Hello world", "nowhere to be found in any text"]'), ("b", "[ Invalid")], "sample_id string, selection string")
    out = evaluate(docs, refs, preds)
    scores = {r["sample_id"]: r for r in out["scores"].collect()}
    assert round(scores["a"]["f1"], 3) == 0.222
    assert scores["b"]["f1"] == 0.0
    assert {r["mode"]: r["n"] for r in out["modes"].collect()} == {"exact_match": 1, "hallucination": 1}
    assert out["errors"].first()["errors"] == 1.0


def test_validate(spark):
    samples = spark.createDataFrame([("a",), ("b",)], "sample_id string")
    one = spark.createDataFrame([("a", "[]")], "sample_id string, selection string")
    validate(samples, one, allow_partial=True)
    with pytest.raises(ValueError):
        validate(samples, one)
    with pytest.raises(ValueError):
        validate(samples, one.union(one), allow_partial=True)


def test_offsets_are_code_points(spark):
    rows = spark.createDataFrame([(0, "a\U0001f600b  c d!"), (1, ""), (2, " \n")], "doc_id int, text string")
    got = [(r["doc_id"], r["text"], r["start_pos"], r["end_pos"]) for r in spans.tokenize(rows).orderBy("doc_id", "tok").collect()]
    assert got == [(0, "a", 0, 1), (0, "\U0001f600", 1, 2), (0, "b", 2, 3), (0, "c", 5, 6), (0, "d", 7, 8), (0, "!", 8, 9)]


def test_span_edges_take_neighbours(spark):
    docs = spark.createDataFrame([(0, "aa bb cc dd")], "doc_id int, text string")
    s = spark.createDataFrame([(0, 5, 6), (0, 20, 30)], "doc_id int, start_pos int, end_pos int").limit(1)
    ids = spans.covered_tokens(s, spans.tokenize(docs), [])
    assert sorted(r["tok"] for r in ids.collect()) == [1, 2]


def test_ground_cascade(spark):
    docs = spark.createDataFrame([(0, "The quick Brown fox\njumps over the lazy dog today."), (1, "quick brown bears")], "doc_id int, text string")
    items = spark.createDataFrame([(0, "lazy dog"), (1, "brown FOX jumps"), (2, "  "), (3, "absent"), (4, "quick")], "span_id int, span string")
    hints = spark.createDataFrame([(4, 1)], "span_id int, doc_id int")
    got = {r["span_id"]: r for r in grounding.ground(items, docs, hints=hints).collect()}
    assert [got[i]["mode"] for i in range(5)] == ["exact_match", "normalized_match", "whitespace", "hallucination", "exact_match"]
    assert got[1]["content"] == "Brown fox\njumps" and got[3]["doc_id"] == -1
    assert (got[4]["doc_id"], got[4]["total_count"]) == (1, 2)


def test_fuzzy(spark):
    docs = spark.createDataFrame([(0, "he saw that the cat sat on the mat and then left the house")], "doc_id int, text string")
    items = spark.createDataFrame([(0, "the cat on the mat"), (1, "the cat on a rug"), (2, "the cat sat in the mat and then left")], "span_id int, span string")
    got = {r["span_id"]: r for r in fuzzy.fuzzy_match(items, docs, share=0.5).collect()}
    assert got[0]["content"] == "the cat sat on the mat" and got[0]["best_dist"] == 1
    default = {r["span_id"]: r for r in fuzzy.fuzzy_match(items, docs).collect()}
    assert set(default) == {2} and default[2]["best_dist"] == 1  # fewer than 7 tokens may not differ


def test_closest_of_each_is_closest():
    r = random.Random(9)
    pairs = [([r.choice("abc") for _ in range(r.randint(1, 9))], [r.choice("abc") for _ in range(r.randint(0, 14))], r.randint(0, 4)) for _ in range(400)]
    assert fuzzy.closest_of_each(*map(list, zip(*pairs, strict=True)), rows=64) == [fuzzy.closest(*p) for p in pairs]


def test_repairs():
    assert repair.parse_spans('["a", "b"') == ["a", "b"]
    assert repair.parse_spans('{"a", "b"}') == ["a", "b"]
    assert repair.parse_spans('["say "hi" now", "b"]') == ['say "hi" now', "b"]
    assert repair.parse_spans("['a', 'b']") == ["a", "b"]
    assert repair.parse_spans('Selected Content:\n\n```json\n["a"]\n```') == ["a"]
    assert repair.parse_spans("[ Invalid") is None
    assert repair.parse_spans("[]") == [] and repair.parse_spans(None) is None


KEYS = [f"Select content about topic {k}." for k in range(5)]
ITEMS = [[f"first piece {k}", f"second, piece {k}"] for k in range(5)]


def test_instruction_layouts():
    """Nine layouts of five instructions and their selections."""
    import json

    want = dict(zip(KEYS, ITEMS, strict=True))
    outline = "\n".join(f"{k + 1}. {a}\n" + "".join(f"    *   {x}\n" for x in v) for k, (a, v) in enumerate(want.items()))
    assert repair.parse_instructions(f"```\n{outline}``` \n") == want
    assert repair.parse_instructions(json.dumps(ITEMS)) == {str(k): v for k, v in enumerate(ITEMS)}
    dashed = "".join(f"- {k + 1}. {a}\n" + "".join(f'  - "{x}"\n' for x in v) for k, (a, v) in enumerate(want.items()))
    assert repair.parse_instructions(dashed) == want
    assert repair.parse_instructions("```\n" + json.dumps([[a, *v] for a, v in want.items()], indent=2) + "\n```") == want
    assert repair.parse_instructions(json.dumps([x for a, v in want.items() for x in (a, v)], indent=2)) == want
    bold = "".join(f"- **{k + 1}. {a}**\n" + "".join(f'  - "{x}" (Document #1)\n' for x in v) for k, (a, v) in enumerate(want.items()))
    assert repair.parse_instructions(bold) == {f"{a}**": [f'"{x}" (Document #1)' for x in v] for a, v in want.items()}
    assert repair.parse_instructions(json.dumps([{"instruction": a, "content": v} for a, v in want.items()])) == want
    code = "".join(f"{k + 1}. {a}\n   - ```java\n     int {k};\n     int b;\n     ```\n   - short;\n" for k, a in enumerate(KEYS))
    assert list(repair.parse_instructions(code)) == KEYS
    loose = "[\n" + "".join(f'  [\n    "{a}",\n    [\n' + "".join(f'      "{x} "quoted" here",\n' for x in v) + "    ]\n  ],\n" for a, v in want.items()) + "]"
    assert repair.parse_instructions("[\n" + loose.split("[\n", 1)[1]) is not None
    assert repair.instructions_of([[a, v] for a, v in want.items()]) == want


def test_instructions_that_do_not_fit():
    assert repair.parse_instructions("<error 500") is None and repair.parse_instructions(None) is None
    assert repair.parse_instructions('{"a": ["x"]}') is None
    assert repair.instructions_of([["x", "y"], ["z", "w"]], 2) == {"0": ["x", "y"], "1": ["z", "w"]}
    assert repair.instructions_of(["First topic", ["x", "y"], "Second", ["z", "w"]], 2) == {"First topic": ["x", "y"], "Second": ["z", "w"]}
    assert repair.instructions_of([["a", ["x"]]], 2) is None


def test_bracket_lines():
    two = '[\n[\n"Topic",\n"a "b" c",\nd\n],\n[\n"Other",\n"e"\n]\n]'
    assert repair.parse_bracket_lines(two) == {"Topic": ['a "b" c', "d"], "Other": ["e"]}
    three = '[\n[\n"Topic",\n[\n"a",\n"b"\n]\n],\n[\n"Other",\n[\n"e"\n]\n]\n]'
    assert repair.parse_bracket_lines(three) == {"Topic": ["a", "b"], "Other": ["e"]}
    with pytest.raises(ValueError):
        repair.parse_bracket_lines("no lists")


def test_unreadable_completions_are_null():
    for raw in ('[{"a"}]', '[b"x"]', "[" * 100_000, '["a" "b', "\\", '"'):
        assert repair.parse_spans(raw) is None or isinstance(repair.parse_spans(raw), list)
    assert repair.parse_spans('[{"a"}]') is None and repair.parse_spans('[b"x"]') is None
    assert repair.parse_documents(['["a"]', "[]", "no", '["b", "c"]']) == ["a", None, None, "b", "c"]
    long = '["' + 'say "hi" ' * 20_000 + '"]'
    assert len(repair.parse_spans(long)) == 1


def test_blank_spans_are_white_space(spark):
    docs = spark.createDataFrame([("a", 0, "hello world\tagain\n")], "sample_id string, doc_id int, text string")
    refs = spark.createDataFrame([("a", 0, 0, 6, 11)], "sample_id string, group_ord int, doc_id int, start_pos int, end_pos int")
    preds = spark.createDataFrame([("a", '["world", " ", "\\t", "\\u00a0\\n", ""]')], "sample_id string, selection string")
    out = evaluate(docs, refs, preds)
    assert {r["mode"]: r["n"] for r in out["modes"].collect()} == {"exact_match": 1, "whitespace": 4}
    assert out["scores"].first()["f1"] == 1.0


def test_fuzzy_stays_in_its_sample(spark):
    text = "he saw that the cat sat on the mat and then left the house at once"
    docs = spark.createDataFrame([("a", 0, "nothing of it here at all in this one"), ("b", 0, text), ("b", 1, text)], "sample_id string, doc_id long, text string")
    near = '["the cat sat in the mat and then left the house"]'
    preds = spark.createDataFrame([("a", near), ("b", near)], "sample_id string, selection string")
    refs = spark.createDataFrame([("a", 0, 0, 0, 3), ("b", 0, 0, 0, 3)], "sample_id string, group_ord int, doc_id int, start_pos int, end_pos int")
    got = {r["sample_id"]: (r["mode"], r["doc_id"]) for r in evaluate(docs, refs, preds)["grounded"].collect()}
    assert got == {"a": ("hallucination", -1), "b": ("fuzzy_match", 0)}


def test_null_is_not_empty(spark):
    rows = spark.createDataFrame([(0, "[]"), (1, "nonsense"), (2, '["a"]'), (3, None)], "i int, selection string")
    got = {r["i"]: (r["spans"], r["error"]) for r in parse_stream(rows).collect()}
    assert got == {0: ([], 0.0), 1: (None, 1.0), 2: (["a"], 0.0), 3: (None, 1.0)}


def test_t_quantile():
    assert abs(metrics.t_quantile(0.975, 10) - 2.228139) < 1e-4
    assert abs(metrics.t_quantile(0.95, 1) - 6.313752) < 1e-3


def test_lcs(spark):
    rows = spark.createDataFrame([(["a", "b", "c", "d"], ["b", "x", "d"]), ([], ["a"]), (["a"], [])], "a array<string>, b array<string>")
    assert [r[0] for r in rows.select(metrics.lcs_length(F.col("a"), F.col("b"))).collect()] == [2, 0, 0]


def test_kappa_perfect(spark):
    rows = spark.createDataFrame([(0, 0), (1, 1), (2, 2)], "x int, y int")
    assert agreement.kappa(rows, "x", "y", 3).first()["kappa"] == 1.0
    assert agreement.kappa(rows.where("x = 0"), "x", "y", 3).first()["kappa"] is None


def test_jsonl_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("x", "[]")], "sample_id string, selection string")
    files.write_jsonl(rows, str(tmp_path / "p"))
    assert files.read_jsonl(spark, str(tmp_path / "p"), "sample_id string, selection string").collect() == rows.collect()


def test_guid_keeps_plus(spark):
    row = spark.range(1).select(tx.parse_guid(F.lit("Set.test.a%2Fb+c.d")).alias("g")).first()["g"]
    assert tuple(row) == ("Set", "test", "a/b+c.d")


WHOLE = [
    (0, "en", "The first line: short.\n" + "".join(f"a long line, number {k} of an article\n" for k in range(30)) + "the END."),
    (1, "fr", "\u00c9t\u00e9 \u00e0 la plage\nDeuxi\u00e8me ligne \"entre guillemets\"\n\n\u00c7a va?\nUn, deux..\nla fin"),
    (2, "de", "Stra\u00dfe\nzwei\ndrei\nvier \\ f\u00fcnf\nsechs"),
    (3, "es", 'path C:\\dir\\\nhe said "yes", and "no"]\nthird::\n```code```\nfifth {x}'),
    (4, "en", '"quoted"\n"all", "of", "it"\nends in a backslash \\\n\\"\nlast'),
    (5, "en", "one"),
    (6, "en", ""),
    (7, "fr", "\t tabs and  blanks \n\u00a0\nmore:\n."),
]


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame([(i, t, lang, "src1", len(t)) for i, lang, t in WHOLE], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.mark.parametrize("n", [1, 2])
def test_rouge_scores_whole_texts(spark, whole, n):
    grams = lambda w: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    got = {r["doc_id"]: (r["overlap"], r["n_ref"], r["n_pred"]) for r in catalog.QUERIES[f"rouge{n}"](spark, whole).collect()}
    for i, _, t in WHOLE:
        a = grams(" ".join(x for k, x in enumerate(t.split("\n")) if x and (k * 2 + i) % 3 == 0).split(" "))
        b = grams(re.split("[ \n]", t))
        assert got[i] == ((a & b).total(), a.total(), b.total())


def digest(spans):
    return hashlib.md5("|".join(spans).encode()).hexdigest()


def test_completions_hold_all_lines(spark, whole):
    got = {r["doc_id"]: (r["n_spans"], r["digest"]) for r in catalog.QUERIES["parse_selections"](spark, whole).collect()}
    lines = {i: t.split("\n") for i, _, t in WHOLE}
    # Text with a fence of its own leaves the completion's fence alone.
    assert got == {i: (None, None) if i % 4 == 2 else (len(x), digest(x)) for i, x in lines.items()}
    e = catalog.QUERIES["parse_error_ratio"](spark, whole).first()
    assert (e["n"], e["errors"]) == (len(WHOLE), sum(i % 4 == 2 for i, _, _ in WHOLE))


def test_repair_reads_quotes_and_backslashes(spark, whole):
    got = {r["doc_id"]: (r["n_spans"], r["digest"]) for r in catalog.QUERIES["parse_repair"](spark, whole).collect()}
    assert got == {i: (len(t.split("\n")), digest(t.split("\n"))) for i, _, t in WHOLE}


def test_prompts_and_cropping_keep_whole_texts(spark, whole):
    prompt = {r["doc_id"]: r["prompt"] for r in catalog.QUERIES["prompt_format"](spark, whole).collect()}
    assert prompt == {i: f"Find {lang} text from src1.\n\nDocument #0:\n{t.strip()}\n\n" for i, lang, t in WHOLE}
    rest = {r["doc_id"]: r["rest"] for r in catalog.QUERIES["strip_preamble"](spark, whole).collect()}
    assert rest == {i: t.strip() for i, _, t in WHOLE}
    inside = {r["doc_id"]: r["inside"] for r in catalog.QUERIES["crop_fence"](spark, whole).collect()}
    fenced = {i: f"Here it is:\n```text\n{t}\n```" for i, _, t in WHOLE}
    assert inside == {i: fenced[i].strip() if len(re.findall(r"(?m)^\s*```\w*\s", fenced[i])) != 1 else t.strip() for i, _, t in WHOLE}


def test_evaluation_grounds_every_line(spark, whole):
    got = {r["sample_id"]: r for r in catalog.QUERIES["evaluate_completions"](spark, whole).collect()}
    assert len(got) == len(WHOLE)
    n = len(re.findall(r"\w+|[^\w\s]", WHOLE[0][2]))
    assert got["0"]["n_pred"] > n / 2 and got["2"]["n_pred"] == 0


def test_answers_of_all_languages(spark, whole):
    got = {r["doc_id"]: r["answer"] for r in catalog.QUERIES["normalize_answer"](spark, whole).collect()}
    plain = lambda t: re.sub(r"[!-/:-@\[-`{-~]", "", t.lower())
    assert got == {i: " ".join(re.sub(r"\b(a|an|the)\b", " ", plain(t)).split()) for i, _, t in WHOLE}
    odd = ["\u201cThe cat\u201d an\u00e9 a\u2014the b", "a a a\u00a0the theme", "the_x the\u0301 a1 \u00e9a"]
    rows = spark.createDataFrame([(t,) for t in odd], "t string").select("t", tx.normalize_answer(F.col("t")).alias("n")).collect()
    assert {r["t"]: r["n"] for r in rows} == {t: " ".join(re.sub(r"\b(a|an|the)\b", " ", plain(t)).split()) for t in odd}


def test_bags_count_repeats(spark):
    a = spark.createDataFrame([("s", 1, 0, ["a", "a", "a", "b"]), ("s", 2, 0, [])], "sample_id string, a_id int, doc_id int, content array<string>")
    b = spark.createDataFrame([("s", 1, 0, ["a", "c"]), ("s", 2, 0, []), ("s", 3, 1, ["a"])], "sample_id string, b_id int, doc_id int, content array<string>")
    got = {(r["a_id"], r["b_id"]): r["score"] for r in reports.pairwise_similarity(a, b).collect()}
    assert got == pytest.approx({(1, 1): 1 / 3, (1, 2): 0.0, (2, 1): 0.0, (2, 2): 1.0, (1, 3): 0.0, (2, 3): 0.0})
    free = reports.pairwise_similarity(a, b, by_document=False, metric=lambda x, y: F.size(F.array_intersect(x, y)))
    assert {(r["a_id"], r["b_id"]): r["score"] for r in free.collect()}[1, 3] == 1
    given = spark.createDataFrame([("s", ["find find find dates now"])], "sample_id string, instructions array<string>")
    back = spark.createDataFrame([("s", ["find x y z"])], "sample_id string, instructions array<string>")
    r = loaders.translate_instructions(given, back).first()
    assert (r["f1"], r["recall"], r["differs"]) == (pytest.approx(2 / 9), pytest.approx(0.2), True)


def test_cleaning_keeps_rows_with_quotes_and_stops(spark, whole):
    def clean(t):
        t = t.strip()
        for marks in ("```", ":.", '"', "'", ".", "```"):
            if marks in ("```", '"', "'"):
                t = t[len(marks) : -len(marks)].strip() if t.startswith(marks) and t.endswith(marks) else t
            elif t.endswith(tuple(marks)):
                t = t[:-1].strip()
        return t

    got = {r["doc_id"]: r["cleaned"] for r in catalog.QUERIES["clean_text"](spark, whole).collect()}
    assert got == {i: clean(f'```\n"{t}".\n```') for i, _, t in WHOLE}


def test_ranges_are_the_tokens_of_spans(spark):
    from spanloom.operators import ranges

    rng = random.Random(4)
    alphabet = "ab1_ \n\t .,é́あ\U0001f600​-" * 2 + "      "
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(60)] + ["", "   "]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-5, None)], "doc_id int, text string")
    rows = [(i, r, s, s + rng.randrange(12)) for i, t in enumerate(texts) for r in "xyz" for s in rng.sample(range(len(t) + 1), min(3, len(t)))] + [(0, "x", -1, -1), (-5, "x", 0, 1)]
    places = spark.createDataFrame(rows, "doc_id int, rater string, start_pos int, end_pos int").repartition(3)
    tokens = spans.tokenize(docs)
    ids = spans.covered_tokens(places, tokens, ["rater"])
    got = ranges.token_ranges(places, docs, ["rater"])
    bounds = {(r["doc_id"], r["tok"]): (r["start_pos"], r["end_pos"]) for r in tokens.collect()}
    want = {(r["rater"], r["doc_id"], r["tok"]) for r in ids.collect()}
    found = [r for r in got.collect()]
    assert {(r["rater"], r["doc_id"], t) for r in found for t in range(r["lo"], r["hi"] + 1)} == want and sum(r["hi"] - r["lo"] + 1 for r in found) == len(want)
    assert all((r["start_pos"], r["end_pos"]) == (bounds[r["doc_id"], r["lo"]][0], bounds[r["doc_id"], r["hi"]][1]) for r in found)
    for least in (0, 1, 2, 3):
        voted = spans.tokens_to_spans(spans.vote(ids, [], "rater", least), tokens, [])
        assert {(r["doc_id"], r["start_pos"], r["end_pos"]) for r in ranges.vote_ranges(got, ["doc_id"], least).select("doc_id", "start_pos", "end_pos").collect()} == {(r["doc_id"], r["start_pos"], r["end_pos"]) for r in voted.collect()}
    raters = spark.createDataFrame([(s, r) for s in range(-1, 5) for r in "wxyz"], "sample_id int, rater string")
    sample = (F.col("doc_id") % 5).alias("sample_id")
    old = agreement.pair_scores(ids.where("doc_id >= 0").select(sample, "rater", "doc_id", "tok"), raters)
    new = ranges.pair_scores(got.where("doc_id >= 0").select("*", sample), raters)
    columns = ["sample_id", "a", "b", "overlap", "n_a", "n_b", "f1"]
    assert sorted(new.select(columns).collect()) == sorted(old.select(columns).collect())


def test_scatter_over_all_other_spans(spark):
    rng = random.Random(8)
    rows = [(g, d, lo, lo + rng.randrange(9)) for g in range(25) for d in range(3) for lo in rng.choices(range(30), k=rng.randrange(6))]
    sizes = spark.createDataFrame([(d, 50 + d, 300) for d in range(3)], "doc_id int, n_tokens int, n_chars int")
    got = {r["g"]: (r["n_spans"], r["scatter"]) for r in reports.scatter(spark.createDataFrame(rows, "g int, doc_id int, lo int, hi int").repartition(3), sizes, ["g"]).collect()}
    for g in range(25):
        mine = [r for r in rows if r[0] == g]
        ways = []
        for i, (_, d, lo, hi) in enumerate(mine):
            others = [min(abs(lo - h), abs(hi - o)) for j, (_, e, o, h) in enumerate(mine) if j != i and e == d]
            ways.append(min(others) / (50 + d) / 300 if others else 1.0)
        if mine:
            assert got[g][0] == len(mine) and got[g][1] == (pytest.approx(sum(ways) / len(ways)) if len(mine) > 1 else None)
    assert set(got) == {r[0] for r in rows}


def test_ordered_pairs_of_ranges_are_those_of_tokens(spark):
    """Both ways round and with themselves, raters without a choice and a sample of two documents included."""
    from spanloom.operators import ranges

    docs = spark.createDataFrame([(0, "a b c d e"), (1, "f g"), (2, "h")], "doc_id int, text string")
    places = spark.createDataFrame([("s", 0, 0, 0, 5), ("s", 1, 0, 4, 9), ("s", 0, 1, 0, 3), ("s", 1, 1, 2, 3), ("t", 1, 2, 0, 1)], "sample_id string, rater int, doc_id int, start_pos int, end_pos int")
    raters = spark.createDataFrame([(s, r) for s in ("s", "t", "u") for r in (0, 1, 2)], "sample_id string, rater int")
    ids = spans.covered_tokens(places, spans.tokenize(docs), ["sample_id", "rater"])
    chosen = ranges.token_ranges(places, docs, ["sample_id", "rater"])
    for kind in ({}, {"ordered": True}, {"with_self": True, "ordered": True}):
        got, want = (sorted(map(tuple, x.select("sample_id", "a", "b", "overlap", "n_a", "n_b", "f1").collect())) for x in (ranges.pair_scores(chosen, raters, **kind), agreement.pair_scores(ids, raters, **kind)))
        assert got == want and len(got) == {0: 9, 1: 18, 2: 27}[len(kind)]


def test_rows_are_read_by_parts(spark):
    """Token rows and lines are made where texts stand, and no plan of them has a shuffle."""
    docs = spark.createDataFrame([(1, "a b\n\nc"), (2, ""), (3, None), (4, "\n")], "doc_id int, text string")
    for rows in (spans.tokenize(docs), catalog.line_table(docs)):
        assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in catalog.line_table(docs).orderBy("doc_id", "line_no").collect()] == [(1, 0, "a b", 0), (1, 1, "", 4), (1, 2, "c", 5), (2, 0, "", 0), (4, 0, "", 0), (4, 1, "", 1)]
