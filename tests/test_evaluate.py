import random

from spanloom.operators import fuzzy, ranges
from spanloom.plans.evaluate import evaluate, ground_predictions, score_predictions


def _case(rng):
    """Samples of several documents with exact, changed, near, lost, blank, repeated and null spans, and references of all sorts."""
    words = ["ab", "Cd", "ef.", "gh,", "été", "x_1", "(", "ij"]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs, refs, preds = [], [], []
    for s in range(60):
        texts = ["\n".join(line(rng.randint(1, 30)) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(0, 4))]
        if len(texts) > 1 and rng.random() < 0.5:
            texts[1] = texts[0] + "\n" + texts[1]
        if rng.random() < 0.1:
            texts.append(None)
        docs += [(str(s), i, t) for i, t in enumerate(texts)]
        lines = [x for t in texts if t for x in t.split("\n")]
        spans = []
        for x in rng.choices(lines, k=5) if lines else []:
            near = x.split(" ")
            near[len(near) // 2] = "zz"
            spans.append(rng.choice([x, x.upper(), x.replace(" ", "\t"), " ".join(near), "lost " + x[::-1], " \t", None]))
        preds += [] if s % 17 == 16 else [(str(s), None if s % 13 == 12 else spans)]
        for g in range(rng.randint(0, 3)):
            refs.append((str(s), g, None, None, None))
            for _ in range(rng.randint(0, 4)):
                lo = rng.randint(-1, 60)
                refs.append((str(s), g, rng.randint(-1, 4), lo, lo + rng.randint(0, 40)))
    return docs, refs, preds


def test_scores_are_those_of_grounded_spans(spark):
    docs, refs, preds = _case(random.Random(4))
    docs = spark.createDataFrame(docs, "sample_id string, doc_id int, text string")
    refs = spark.createDataFrame(refs, "sample_id string, group_ord int, doc_id int, start_pos int, end_pos int")
    parsed = spark.createDataFrame(preds, "sample_id string, spans array<string>")
    for near in (True, False):
        placed = ground_predictions(parsed, docs, near).where("doc_id >= 0")
        on = ["sample_id", "doc_id"]
        groups = refs.select("sample_id", "group_ord").distinct().join(parsed.select("sample_id"), "sample_id", "left_semi")
        want = ranges.score_groups(ranges.token_ranges(refs.where("doc_id >= 0"), docs, ["sample_id", "group_ord"], on=on), ranges.token_ranges(placed, docs, ["sample_id"], on=on), groups)
        got = score_predictions(docs, refs, parsed, near)
        assert got.columns == want.columns and got.dtypes == want.dtypes
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert {r["mode"] for r in placed.select("mode").distinct().collect()} == {"exact_match", "normalized_match"} | ({"fuzzy_match"} if near else set())


def test_nearest_is_the_match_of_the_join(spark):
    rng = random.Random(5)
    text = " ".join(rng.choice("a b c d e f".split()) for _ in range(300))
    spans = [text[2 * i : 2 * i + 2 * n - 1] for i, n in ((rng.randrange(200), rng.randint(5, 80)) for _ in range(40))]
    spans = [" ".join("z" if rng.random() < 0.08 else w for w in s.split()) for s in spans] + ["none of it stands here or there or over there", ""]
    want = {r["span_id"]: (r["best_dist"], r["start_pos"], r["end_pos"]) for r in fuzzy.fuzzy_match(spark.createDataFrame(list(enumerate(spans)), "span_id int, span string"), spark.createDataFrame([(0, text)], "doc_id int, text string")).collect()}
    got = fuzzy.nearest(spans, text, windows=7)
    assert {i: g for i, g in enumerate(got) if g} == want and 10 < len(want) < len(spans)


def test_texts_travel_once(spark):
    """Of the scores: texts, completions and references are dealt once each, then numbers by sample and by group."""
    docs = spark.createDataFrame([("a", 0, "one two three four")], "sample_id string, doc_id int, text string")
    refs = spark.createDataFrame([("a", 0, 0, 0, 7)], "sample_id string, group_ord int, doc_id int, start_pos int, end_pos int")
    preds = spark.createDataFrame([("a", '["three four"]')], "sample_id string, selection string")
    scores = evaluate(docs, refs, preds)["scores"]
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 5 and plan.count("MapInArrow") == 2
    assert scores.first()["overlap"] == 0 and scores.first()["n_pred"] == 2
