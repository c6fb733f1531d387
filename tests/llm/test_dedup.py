"""Line, near-copy and substring dedup against brute force."""

import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.llm.line_dedup import drop_similar_lines
from spanloom.llm.ngram_join import ngram_jaccard_components
from spanloom.llm.substring_dedup import drop_repeats

from .conftest import words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = words((t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def brute_repeats(rows, size=13):
    out = brute_repeat_rows(rows, size)
    return {i: r for (i, _), r in zip(rows, out, strict=True)}


def brute_repeat_rows(rows, size=13):
    first, out = {}, []
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = words(t)
        for j in range(len(w) - size + 1):
            first.setdefault(tuple(w[j : j + size]), i)
    for i, t in rows:
        w = words(t)
        keep = [True] * len(w)
        for j in range(len(w) - size + 1):
            if first[tuple(w[j : j + size])] < i:
                keep[j : j + size] = [False] * size
        out.append((len(w), keep.count(False), " ".join(x for x, k in zip(w, keep, strict=True) if k)))
    return out


def brute_lines(rows):
    seen, out = [], {}
    for i, t in sorted(rows):
        kept = []
        for line in (t or "").split("\n"):
            s = frozenset(words(line))
            if not s or not any(100 * len(s & x) >= 80 * len(s | x) for x in seen):
                kept.append(line)
            if s:
                seen.append(s)
        out[i] = None if t is None else "\n".join(kept)
    return out


def variants(seed, n=60):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(40)]
    texts = []
    for _ in range(n):
        if texts and r.random() < 0.6:
            w = r.choice(texts).split(" ")
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            texts.append(" ".join(w))
        else:
            texts.append(" ".join(r.choice(["\n", ""]) * (r.random() < 0.1) + r.choice(vocabulary) for _ in range(r.choice([3, 8, 40, 90]))))
    return list(enumerate(texts))


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_components(spark, small, edges):
    for df in (small, edges, spark.createDataFrame(variants(1), "doc_id long, text string")):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard_components(df).collect()}
        assert got == brute_components(rows_of(df))


def test_components_of_many_near_copies(spark):
    r = random.Random(3)
    base = [f"t{k}" for k in range(80)]
    rows = [(0, " ".join(base))]
    for i in range(1, 120):
        w = list(base)
        for _ in range(r.choice([1, 2, 3])):
            w[r.randrange(80)] = f"e{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngram_jaccard_components(df).collect()}
    assert got == brute_components(rows)


def test_repeats(spark, small, edges):
    for df in (small, edges.where("doc_id not in (9, 10)"), spark.createDataFrame(variants(2), "doc_id long, text string")):
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in drop_repeats(df).collect()}
        assert got == brute_repeats(rows_of(df))


def test_repeats_of_one_id(spark):
    """Rows that repeat an id with other texts keep their own places."""
    w = " ".join(f"w{k}" for k in range(20))
    r = random.Random(8)
    rows = [(1, w), (2, "q " * 30 + w), (2, w), (2, w), (2, None), (3, w + " z"), (1, "a " + w)]
    rows += [(r.randrange(12), " ".join(f"v{r.randrange(3)}" for _ in range(r.randrange(60)))) for _ in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter((x["doc_id"], x["n_words"], x["n_removed"], x["kept"]) for x in drop_repeats(df).collect())
    assert got == Counter((i, *x) for (i, _), x in zip(rows, brute_repeat_rows(rows), strict=True))
    assert got[2, 50, 20, " ".join(["q"] * 30)] == 1


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdefghijkl"), max_size=40), min_size=2, max_size=12), st.integers(0, 5))
def test_repeats_property(spark, texts, cut):
    rows = list(enumerate(" ".join(t) for t in texts))
    rows += [(len(rows) + i, "z " + " ".join(t[cut:] + ["q"])) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in drop_repeats(df).collect()} == brute_repeats(rows)


def test_lines(spark, small, edges):
    tiny = spark.createDataFrame([(0, "a b c d e\nf g"), (1, "e d c b a\ng f\n\nnew line"), (2, "a b c d x"), (3, "a b c d e z")], "doc_id long, text string")
    for df in (small.where("doc_id < 120"), edges, tiny):
        out = drop_similar_lines(df)
        assert {r["doc_id"]: r["text"] for r in out.select("doc_id", "text").collect()} == brute_lines(rows_of(df))
    assert set(out.columns) == {"doc_id", "text", "n_lines", "n_removed"}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_jaccard_components(none).count() == 0
    assert drop_repeats(none).count() == 0
    assert drop_similar_lines(none).count() == 0


def test_null_ids_keep_their_text(spark):
    text = " ".join(f"w{k}" for k in range(30))
    df = spark.createDataFrame([(None, text), (1, text), (2, text)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in drop_repeats(df).collect()} == {None: 0, 1: 0, 2: 30}
    assert {r["doc_id"]: r["text"] for r in drop_similar_lines(df).collect()} == {None: text, 1: text, 2: ""}


def test_lines_near_the_bound(spark):
    """Lines of 1 to 40 words from a small vocabulary, edited so that similarities lie around the bound."""
    r, rows, pool = random.Random(5), [], []
    for i in range(80):
        lines = []
        for _ in range(r.randint(1, 6)):
            if pool and r.random() < 0.7:
                w = list(r.choice(pool))
                for _ in range(r.randint(0, max(1, len(w) // 4))):
                    at = r.randrange(len(w) + 1)
                    w[at : at + r.randint(0, 1)] = [f"v{r.randrange(60)}"] * r.randint(0, 1)
                r.shuffle(w)
            else:
                w = r.sample([f"v{k}" for k in range(60)], r.choice([1, 2, 3, 4, 5, 6, 9, 14, 25, 40]))
            pool += [w] if w else []
            lines.append(" ".join(w))
        rows.append((i, "\n".join(lines)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {x["doc_id"]: x["text"] for x in drop_similar_lines(df).select("doc_id", "text").collect()} == brute_lines(rows)


def test_lines_in_many_tiles(spark, monkeypatch):
    """Large groups, frequent keys and tiles of few lines: nothing is lost where blocks, flushes and tiles meet."""
    from spanloom.llm import line_dedup

    for name, value in (("SMALL", 2), ("FREQUENT", 3), ("TILE_LATER", 3), ("TILE_EARLIER", 4)):
        monkeypatch.setattr(line_dedup, name, value)
    r, rows = random.Random(12), []
    passage = [f"p{k}" for k in range(12)]
    base = [f"b{k}" for k in range(20)]
    for i in range(90):
        kind = i % 3
        w = list(base if kind == 0 else passage)
        if kind == 0:  # near copies, some of them nearer to each other than to the first
            for _ in range(r.choice([1, 3, 5])):
                w[r.randrange(20)] = f"e{r.randrange(12)}"
        else:  # a passage among words of one's own
            w = [f"o{r.randrange(40)}" for _ in range(r.choice([2, 3, 4, 9]))] + w
        rows.append((i, " ".join(w) + "\n" + " ".join(f"x{r.randrange(9)}" for _ in range(r.choice([14, 15, 16, 17, 18])))))
    rows.append((95, rows[0][1]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {x["doc_id"]: x["text"] for x in drop_similar_lines(df).select("doc_id", "text").collect()} == brute_lines(rows)


def test_lines_keep_other_columns(spark):
    """Clashing names, nulls and repeated rows; extra columns stay with their rows."""
    line = " ".join(f"w{k}" for k in range(20))
    rows = [(1, line, "a", 1), (1, line, "b", 2), (2, line, None, 3), (None, line, "n", 4), (3, None, "z", 5), (3, None, "z", 5), (4, "", "e", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rest string, n_lines int").withColumn("x", F.lit(0)).withColumn("stays", F.lit("s"))
    out = drop_similar_lines(df)
    assert out.columns == ["doc_id", "text", "rest", "x", "stays", "n_lines", "n_removed"]
    got = Counter((r["doc_id"], r["text"], r["rest"], r["n_removed"]) for r in out.collect())
    assert got == Counter({(1, line, "a", 0): 1, (1, line, "b", 0): 1, (2, "", None, 1): 1, (None, line, "n", 0): 1, (3, None, "z", 0): 2, (4, "", "e", 0): 1})
