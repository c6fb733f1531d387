"""Decontamination, extraction, quality, personal data, language, sharding, packing and the pipeline."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanloom.llm import html_extract, html_training, packing, pii, quality, queries
from spanloom.llm.decontaminate import find_leaks
from spanloom.llm.html_extract import main_text, minimum_cut
from spanloom.llm.language import identify
from spanloom.llm.scratch import Scratch
from spanloom.llm.sharding import shard, write_shards

from .conftest import EDGES, SMALL, words


def test_leaks_tolerate_substitutions(spark):
    item = [f"b{k}" for k in range(30)]
    changed = [w if k not in (5, 14, 23) else "other" for k, w in enumerate(item)]
    filler = " ".join(f"f{k}" for k in range(50))
    docs = spark.createDataFrame([(1, f"{filler} {' '.join(item)}, {filler}"), (2, f"{filler} {' '.join(changed).upper()}! {filler}"), (3, filler), (4, None), (5, ""), (6, " ".join(item[:11]))], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, "too short"), (10, "five words are quite enough")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["n_equal"], r["doc_start"]) for r in find_leaks(docs, items).collect()}
    assert got == {(1, 7): (30, 50), (2, 7): (27, 50)}
    assert {(r["doc_id"], r["item_id"]) for r in find_leaks(docs, items, block_tokens=10).collect()} == set(got)
    assert find_leaks(docs, items.where("false")).count() == 0


def brute_leaks(docs, items, least=12, share=75, shortest=5):
    found = set()
    for d, text in docs:
        for i, item in items:
            doc, t = text.split(), item.split()
            for shift in range(1 - len(t), len(doc)) if len(t) >= shortest else ():
                lo, hi = max(0, -shift), min(len(t), len(doc) - shift)
                equal = np.concatenate([[0], np.cumsum([t[k] == doc[shift + k] for k in range(lo, hi)])])
                size = np.arange(len(equal))[None, :] - np.arange(len(equal))[:, None]
                if np.any((size >= min(least, len(t))) & (100 * (equal[None, :] - equal[:, None]) >= share * size)):
                    found.add((d, i))
                    break
    return found


def test_leaks_like_brute_force(spark):
    rng = np.random.default_rng(7)
    change = lambda words, same: " ".join(w if ok else f"x{rng.integers(10**9)}" for w, ok in zip(words, same, strict=True))
    sizes = [5, 6, 7, 8, 9, 10, 11, 12, 13, 16, 17, 20, 30, 54, 460]
    items = [(k, " ".join(f"i{k}w{j}" for j in range(n))) for k, n in enumerate(sizes)]
    docs = []
    for _, item in items:
        t = item.split()
        pad = " ".join(f"p{rng.integers(10**9)}" for _ in range(5))
        docs += [f"{pad} {change(t, rng.random(len(t)) >= rate)} {pad}" for rate in (0.1, 0.2, 0.25, 0.3, 0.4, 0.5) for _ in range(6)]
        docs += [f"{pad} {change(t, [j % 7 not in (2, 5) for j in range(len(t))])} {pad}", change(t, [j < 40 or j % 7 not in (2, 5) for j in range(len(t))])]
    docs += [f"a {change(items[9][1].split(), [c == '1' for c in p])} z" for p in ("1111101010101111", "1111010101011111", "1111011010101111", "1111000011111111")]
    docs = list(enumerate(docs))
    rows = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == brute_leaks(docs, items)
    for r in rows:
        doc, item = (dict(x)[r[c]].split()[r[s] :][: r["n_aligned"]] for x, c, s in ((docs, "doc_id", "doc_start"), (items, "item_id", "item_start")))
        assert sum(a == b for a, b in zip(doc, item, strict=True)) == r["n_equal"] and 100 * r["n_equal"] >= 75 * r["n_aligned"] >= 75 * min(12, r["item_words"])


def test_leaks_find_every_contained_item(spark, small):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op1_decontamination(spark, SMALL).collect()}
    held = {(r["doc_id"], i) for r in small.collect() for i, t in items.items() if t in r["text"]}
    assert held <= got


def test_leaks_of_repeated_rows(spark):
    """Rows that repeat an id have their own matches, and so have items; one item in several places gives one match."""
    item = " ".join(f"b{k}" for k in range(30))
    docs = spark.createDataFrame([(1, f"x {item}"), (1, f"x y {item} {item}"), (1, "clean words"), (1, f"x {item}"), (None, item)], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (7, "other " + item)], "item_id long, text string")
    got = Counter((r["doc_id"], r["item_id"], r["n_equal"], r["doc_start"]) for r in find_leaks(docs, items).collect())
    assert got == Counter({(1, 7, 30, 1): 4, (1, 7, 30, 2): 2, (None, 7, 30, 0): 2})


def test_leaks_of_one_word_repeated(spark):
    """A text and an item of one word, over and over, stay within bounded memory."""
    docs = spark.createDataFrame([(1, "word " * 60_000)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "word " * 40)], "item_id long, text string")
    (r,) = find_leaks(docs, items).collect()
    assert (r["n_equal"], r["doc_start"]) == (40, 0)


PAGE = """<html><head><title>T</title><script>var a="</p>";</script></head><body class="page has-sidebar"><header><a href=x>Home</a></header><nav><ul><li><a>One</a></ul></nav>
<div id=main><div class="cookie-notice">We use cookies to improve things.</div><h1>Big &amp; title</h1><p>First para with <a href=q>a link</a> and text that goes&nbsp;on.
Second   sentence here.<p>Another paragraph, long enough to be content of its own.<div class="ad-box">Buy now.</div>
<section id="comments"><article class="comment"><p>I liked this very much, it is a good read and so on.</p></article></section></div><form><p>Sign up</p></form><footer>&copy; 2024</footer></body></html>"""


def test_main_text():
    assert main_text(PAGE) == "Big & title\nFirst para with a link and text that goes on. Second sentence here.\nAnother paragraph, long enough to be content of its own."
    assert main_text(None) == "" and main_text("") == "" and main_text("<p>") == "" and main_text("<a href=") == ""
    assert main_text("<article>" + "<p>Some words of text here." * 3000 + "</article>").count("\n") == 2999


FIRST, SECOND, THIRD = (
    "The council met on Tuesday to settle what should become of the old harbour and the sheds that stand along it.",
    "Most of those who spoke wanted the sheds kept, though nobody could tell who would pay for their roofs.",
    "A decision is to be made in spring, after the engineers have looked at the walls once more.",
)
BODY = f"<p>{FIRST}</p><p>{SECOND}</p><h2>What comes next</h2><p>{THIRD}</p>"
TEXT = "\n".join([FIRST, SECOND, "What comes next", THIRD])
MENU = '<ul><li><a href="/a">Home</a></li><li><a href="/b">World news</a></li><li><a href="/c">Sport</a></li></ul>'
FOOT = '<div class="xq"><span>© 2021 The Example</span><br><a href="/p">Privacy policy</a></div>'
THREAD = "".join(f"<div><span>{who}</span> <b>{when}</b><br><p>{said}</p></div>" for who, when, said in [("ann", "3 hours ago", "I used to play in those sheds when I was a child and would hate to see them go."), ("bob k", "yesterday 12:40", "They should have been pulled down years ago, if you ask me, and so should the crane."), ("cy", "12.4.2021", "Nice.")])


@pytest.mark.parametrize("name", ["rail-travel", "reply-brief", "feedback-loops", "comment-on-trade", "navigation-history", "content", "kzzt"])
@pytest.mark.parametrize("tag", ["article", "div", "section"])
def test_names_do_not_empty_articles(name, tag):
    for head, body in (("<h1>Harbour sheds</h1>", BODY), ("", f"<h1>Harbour sheds</h1>{BODY}")):
        assert main_text(f'<html><body><div class="q">{MENU}</div>{head}<{tag} class="{name}">{body}</{tag}>{FOOT}</body></html>') == f"Harbour sheds\n{TEXT}"


@pytest.mark.parametrize("opening,closing", [('<section class="discussion"><div class="thread">', "</div></section>"), ("<section><div>", "</div></section>"), ('<div class="qqx">', "</div>"), ("<div>", "</div>")])
@pytest.mark.parametrize("article", ["article", "div"])
def test_comments_go_whatever_their_container(opening, closing, article):
    page = f"<body><div>{MENU}</div><{article}><h1>Harbour sheds</h1>{BODY}</{article}>{opening}{THREAD}{closing}{FOOT}</body>"
    assert main_text(page) == f"Harbour sheds\n{TEXT}"
    inside = f"<body><div>{MENU}</div><{article}><h1>Harbour sheds</h1>{BODY}{opening}{THREAD}{closing}</{article}>{FOOT}</body>"
    assert main_text(inside) == f"Harbour sheds\n{TEXT}"


def test_sidebars_go_inside_articles_too():
    aside = "<aside><h3>Harbour in numbers</h3><p>There are eleven sheds, the oldest of which was built in the year of the great storm.</p></aside>"
    assert main_text(f"<body><article><h1>Harbour sheds</h1><p>{FIRST}</p>{aside}<p>{SECOND}</p></article></body>") == f"Harbour sheds\n{FIRST}\n{SECOND}"


def test_dates_and_lists_of_an_article_stay():
    years = "".join(f"<li>In {y} the roof of shed {k} was mended by the town.</li>" for k, y in enumerate((1901, 1925, 1960)))
    parts = "".join(f"<section><h2>Shed {k}</h2><p>Built in {1900 + k}.</p><p>{t}</p></section>" for k, t in enumerate((FIRST, SECOND, THIRD)))
    got = main_text(f"<body><main><h1>Harbour sheds</h1><p>{FIRST}</p><ul>{years}</ul>{parts}</main>{FOOT}</body>")
    assert got.count("\n") == 13 and "Built in 1902." in got and "In 1960 the roof" in got


def test_raw_tags_without_an_end():
    for tag in ("<svg>", "<object data=x>", "<noscript>", "<svg><path d='M0'>"):
        assert main_text(f"<article><p>{FIRST}{tag}</p><p>{SECOND}</p></article>") == f"{FIRST}\n{SECOND}"
    assert main_text(f"<article><p>{FIRST}</p><p>{SECOND}</p></article><script>var x = 1; track(") == f"{FIRST}\n{SECOND}"
    assert main_text(f"<article><p>Where <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds, the sheds stand as they stood before.</p><p>{FIRST}</p></article>").startswith("Where x=1 holds, the sheds")
    assert main_text(f"<article><p>{FIRST}<svg><text>no</text></svg> And on.</p><p>{SECOND}</p></article>") == f"{FIRST} And on.\n{SECOND}"


def test_edges_change_labels():
    """A short piece without a sentence's end, between paragraphs of an unnamed container, is content by its neighbours alone."""
    long = "Some plain words that go on for long enough to be told as a text of the page, one after another."
    page = f"<body><div><p>{long}</p><div>and so</div><p>{long}</p><div>yes</div><p>{long}</p></div><div><span>Log in</span></div></body>"
    w, scale = html_training.fit()
    blocks = html_extract.blocks_of(page)
    assert scale > 0 and html_extract.content_of(blocks, w, 0.0) == [True, False, True, False, True, False]
    assert main_text(page) == "\n".join([long, "and so", long, "yes", long])


def test_labelling_is_the_best_of_all():
    w, scale = html_training.fit()
    for blocks, _ in html_training.labelled_pages(40, 9000):
        blocks = blocks[:10]
        keep, drop = html_extract.costs(blocks, w)
        edges = html_extract.smoothness(blocks, scale)

        def cost(side):
            return sum(k for k, c in zip(keep, side, strict=True) if not c) + sum(d for d, c in zip(drop, side, strict=True) if c) + sum(e for a, b, e in edges if side[a] != side[b])

        best = min(cost([bool(m >> i & 1) for i in range(len(blocks))]) for m in range(1 << len(blocks)))
        assert cost(html_extract.content_of(blocks, w, scale)) == pytest.approx(best)


def test_cut_beats_the_classifier_alone():
    w, scale = html_training.fit()
    pages = html_training.labelled_pages(200, 20000)
    wrong = {s: sum(int((np.array(html_extract.content_of(b, w, s)) != (y > 0)).sum()) for b, y in pages) for s in (0.0, scale)}
    assert wrong[scale] < wrong[0.0] < 0.02 * sum(len(y) for _, y in pages)


def test_deep_and_unclosed_tags():
    """Nesting has no limit and costs linear time; what stands in a deep advert stays out."""
    deep = "<div class=ad>" + "<div>" * 50000 + "Buy now" + "</div>" * 50001
    assert main_text(f"<article><p>First words of it.</p>{deep}<p>Last words of it.</p></article>") == "First words of it.\nLast words of it."
    assert main_text("<article>" + "<b>" * 20000 + "<p>Words of the page.</p>" * 2000).count("\n") == 1999


def test_minimum_cut_is_minimal():
    rng = np.random.default_rng(5)
    for _ in range(40):
        n = int(rng.integers(1, 7))
        source, sink = rng.integers(0, 9, n).tolist(), rng.integers(0, 9, n).tolist()
        edges = [(a, b, float(rng.integers(0, 5))) for a, b in combinations(range(n), 2) if rng.random() < 0.6]

        def cost(side):
            return sum(source[i] for i in range(n) if not side[i]) + sum(sink[i] for i in range(n) if side[i]) + sum(w for a, b, w in edges if side[a] != side[b])

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(minimum_cut(source, sink, edges)) == pytest.approx(best)


def test_extract_keeps_articles(spark):
    got = {r["page_id"]: r for r in queries.op2_html_extraction(spark, SMALL).collect()}
    for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect():
        inside = re.search("<h1>(.*?)</h1>", r["html"], re.S)[1]
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"]) > 0
        assert "<" not in inside and "track(" not in got[r["page_id"]]["text"]


def base_quality(t):
    w = words(t)
    c = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {j + d for j in range(len(w) - 2) if c[w[j], w[j + 1], w[j + 2]] > 1 for d in range(3)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t or ""), len(lines) - len(set(lines)), len(hit)


def test_quality(spark, small, edges):
    scratch = Scratch(spark, "test")
    for df in (small, edges):
        got = {r["doc_id"]: r for r in quality.judge(df.select("doc_id", "text"), save=scratch.save).collect()}
        for r in df.collect():
            want, g = base_quality(r["text"]), got[r["doc_id"]]
            assert tuple(g[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
            assert g["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
            assert not (g["base_failed"] and g["kept"])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.op3_quality_rules(spark, SMALL).collect()}
    judged = [(labels[i], got[i]["kept"]) for i in labels if not got[i]["base_failed"]]
    assert sum(q == int(k) for q, k in judged) >= 0.95 * len(judged)
    kept = quality.keep_good(edges, scratch.save)
    assert kept.columns == edges.columns
    assert quality.judge(small.where("false").select("doc_id", "text")).count() == 0


def test_quality_like_brute_force(spark):
    """Votes, the model and the verdict against plain Python, on either side of each bound of the votes."""
    r = random.Random(3)
    say = lambda n, few: " ".join(r.choice(["the", "of", "and"]) if r.random() < 0.3 and not few else "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 14))) for _ in range(n))
    texts = [say(r.choice([3, 49, 50, 79, 80, 120]), r.random() < 0.5) + " #" * r.choice([0, 1, 5, 12]) + r.choice(["", "\nsame line here\nsame line here"]) for _ in range(150)]
    texts += [" ".join(f"r{k % m}" for k in range(90)) for m in (7, 23, 24, 25, 26, 80)]  # so many windows stand twice
    texts += [t.upper() for t in texts[:20]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x for x in quality.judge(docs, save=Scratch(spark, "test").save).collect()}

    def votes(t):
        n, chars, symbols, dup, repeat = base_quality(t)
        size, lines = chars / max(1, n), len([x for x in t.split("\n") if words(x)])
        capitals, function = sum(c.isupper() for c in t), sum(w.lower() in quality.FUNCTION_WORDS for w in words(t))
        tests = [(n < 50, n >= 80), (size < 2.5 or size > 12, 3.5 <= size <= 8), (10 * symbols > n, 100 * symbols <= n), (10 * dup > 3 * lines, dup == 0), (100 * repeat > 30 * n, 100 * repeat <= 15 * n), (10 * capitals > 3 * chars, 10 * capitals <= chars), (100 * function < 2 * n, 100 * function >= 8 * n)]
        return [0 if bad else 2 if good else 1 for bad, good in tests]

    patterns = Counter(tuple(votes(t)) for t in texts)
    model = quality.LabelModel(7).fit(sorted((list(p), n) for p, n in patterns.items()))
    for i, t in enumerate(texts):
        x, p = got[i], model.posterior(votes(t))
        assert [1 if x[f"vote_{k}"] is None else 2 * x[f"vote_{k}"] for k in quality.RULES] == votes(t)
        assert x["n_repeat_words"] == base_quality(t)[4] and x["p_good"] == pytest.approx(p)
        assert x["kept"] == (p >= 0.5 and not x["base_failed"])


def test_quality_keeps_other_columns(spark):
    rows = [(1, "a b", "own", "w", 1), (1, "a b", "own", "w", 1), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string, _w string, row int").withColumn("_text", F.lit("x"))
    out = quality.judge(docs)
    assert out.columns == ["doc_id", "_w", "row", "_text", *quality.ADDED]
    assert Counter((x["doc_id"], x["_w"], x["n_words"]) for x in out.collect()) == Counter({(1, "w", 2): 2, (None, None, 0): 1})
    assert quality.keep_good(docs, Scratch(spark, "test").save).columns == docs.columns


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 13 <= len(d) <= 19 and luhn(d) or kind == "phone" and 9 <= len(d) <= 15:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


TRICKY = ["a@b.c_d@e.f", "a@b..c@d.e", "..x@y.z-@q.w", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.256 01.002.3.255", "4111-1111-1111-1111 4111  1111", "41111111111111111111111", "+1 (386) 555-3733", "+1--2", "\U0001f600 é a@b.co \U0001f600 +12 345 678 901", "x" * 3000 + "@y.z", "a@b.c@d.e.f", "9" * 5000, "+1234567890+1234567890", "a@b.c.", "12 4111 1111 1111 1111"]


def test_pii(spark, small, edges):
    tricky = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    for df in (tricky, small, edges, small.where("false")):
        got = {r["doc_id"]: r for r in pii.find_pii(df.select("doc_id", "text")).select("doc_id", pii.listed(pii.BASE).alias("base"), F.size("secret").alias("n")).collect()}
        for r in df.collect():
            assert got[r["doc_id"]]["base"] == ",".join(base_spans(r["text"]))
    r = queries.op4_pii(spark, SMALL).first()
    assert len(r["base_sha256"]) == 64


def test_pii_finds_secrets(spark):
    digits = [hashlib.sha1(str(k).encode()).hexdigest() for k in range(30)]
    rows = [(k, f'some words and token = "{x}" more of them') for k, x in enumerate(digits)] + [(100 + k, f"just plain words number {k} version 2.0 of a sentence") for k in range(60)]
    got = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"] for r in got.where(F.size("secret") > 0).collect()} == set(range(30))


def test_pii_judges_wider_kinds(spark):
    """Planted spans of each judged kind among look-alikes; most are found and no look-alike is."""
    r = random.Random(4)
    say = lambda n: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8))) for _ in range(n))
    cap = lambda: say(1).capitalize() + "el"
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def iban():
        body = digits(18)
        check = 98 - int(body + "131400") % 97  # D = 13, E = 14
        plain = f"DE{check:02d}{body}"
        return " ".join(plain[k : k + 4] for k in range(0, 22, 4))

    make = {
        "secret": lambda: (r.choice(["token = \"", "api key: "]), hashlib.sha1(say(2).encode()).hexdigest()),
        "iban": lambda: (r.choice(["IBAN: ", "pay to "]), iban()),
        "nationalid": lambda: ("SSN ", f"{r.randint(100, 599)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}"),
        "localphone": lambda: (r.choice(["Tel: ", "call "]), f"({r.randint(200, 899)}) {r.randint(200, 999)}-{r.randint(1000, 9999)}"),
        "address": lambda: ("lives at ", f"{r.randint(1, 900)} {cap()} {r.choice(['Street', 'Avenue', 'Road'])}"),
        "name": lambda: (r.choice(["Mr. ", "name: ", "with "]), f"{r.choice(pii.FIRST_NAMES)} {cap()}"),
    }
    rows, planted = [], {}
    for i in range(240):
        kind = pii.JUDGED[i % 6]
        before, span = make[kind]()
        head = f"{say(8)} {before}"
        rows.append((i, f"{head}{span} {say(6)}"))
        planted[i] = f"{kind}:{len(head)}:{len(head) + len(span)}"
    for i in range(240, 900):
        rows.append((i, f"{say(6)}. {cap()} {cap()} {say(4)}, version {digits(3)}.{digits(3)}.{digits(4)} of {digits(3)}-{digits(3)}-{digits(4)} and {say(3)}/{say(1)}{digits(9)}.html on {digits(2)} {say(1)}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {x["doc_id"]: x["spans"].split(",") for x in pii.find_pii(docs).select("doc_id", pii.listed(pii.JUDGED).alias("spans")).collect()}
    for kind in pii.JUDGED:
        mine = [i for i in planted if planted[i].startswith(kind)]
        assert sum(planted[i] in found[i] for i in mine) >= 0.9 * len(mine), kind
    assert sum(found[i] != [""] for i in range(240, 900)) <= 6


def test_pii_places_of_many_matches(spark):
    """Places of far more matches than a block holds, in code points, in near linear time; no token is too long."""
    text = "\U0001f600 " + " ".join(f"é a{k}@b{k}.co" for k in range(9000))
    long = 'token = "' + "x" * 300 + '1" token = "' + "7" * 300 + 'x"'
    got = {x["doc_id"]: x for x in pii.find_pii(spark.createDataFrame([(1, text), (2, long)], "doc_id long, text string")).select("doc_id", pii.listed(["email"]).alias("email"), pii.listed(["secret"]).alias("secret")).collect()}
    assert got[1]["email"] == ",".join(x for x in base_spans(text) if x.startswith("email"))
    assert got[2]["secret"] == ",".join(f"secret:{m.start(1)}:{m.end(1)}" for m in re.finditer('"([^"]*)"', long))


def test_pii_keeps_other_columns(spark):
    rows = [(1, "a@b.co", "x", "r", "n"), (1, None, None, None, None), (None, "a@b.co", "x", "r", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, t string, row string, m_email string").withColumn("_text", F.lit(1)).withColumn("x", F.lit(2))
    got = pii.find_pii(docs)
    assert got.columns == ["doc_id", "t", "row", "m_email", "_text", "x", *pii.BASE, *pii.JUDGED]
    assert Counter((x["doc_id"], x["t"], len(x["email"])) for x in got.collect()) == Counter([(1, "x", 1), (1, None, 0), (None, "x", 1)])


def test_language(spark, small, edges):
    got = {r["doc_id"]: r for r in queries.op5_language_id(spark, SMALL).collect()}
    truth = {r["doc_id"]: r["lang"] for r in small.collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i in got if got[i]["held_out"]} == set(held)
    assert sum(got[i]["lang_pred"] == truth[i] for i in held) >= 0.95 * len(held)
    out = {r["doc_id"]: r for r in identify(edges, F.col("lang").isNotNull()).collect()}
    assert [out[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and out[6]["lang_pred"] == "en"
    none = identify(edges, F.lit(False)).collect()
    assert {r["lang_pred"] for r in none} == {"und"} and len(none) == len(EDGES)


def test_language_of_odd_rows(spark, small):
    """Null and repeated ids, clashing columns, and texts that repeat."""
    docs = small.where("doc_id < 60").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(None, "The end of the story", "en"), (None, "The end of the story", None), (7, None, "de"), (7, "?!", None)], "doc_id long, text string, lang string")
    docs = docs.unionByName(odd).withColumn("_text", F.lit(1)).withColumn("c0", F.lit(2)).withColumn("score", F.lit("x"))
    out = identify(docs, F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    assert out.columns == ["doc_id", "_text", "c0", "lang_pred", "score", "rejected"]
    rows = out.where("doc_id is null").collect()
    assert len(rows) == 2 and rows[0] == rows[1] and rows[0]["lang_pred"] == "en"
    assert sum(r["lang_pred"] == "und" for r in out.where("doc_id = 7").collect()) == 2


def test_sharding(spark, small, edges):
    limit = 65536
    got = {r["doc_id"]: r for r in shard(small, limit, bits=3).collect()}
    h = {i: int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16) for i in got}

    def split(ids, depth, prefix):
        if sum(got[i]["n_bytes"] for i in ids) <= limit or depth == 60:
            return {i: (depth, prefix) for i in ids}
        out = {}
        for bit in (0, 1):
            out |= split(sub, depth + 1, 2 * prefix + bit) if (sub := [i for i in ids if h[i] >> (59 - depth) & 1 == bit]) else {}
        return out

    assert {i: (r["depth"], r["prefix"]) for i, r in got.items()} == split(list(got), 0, 0)
    assert shard(edges, 1000).count() == len(EDGES)
    assert shard(edges.where("false"), 1000).count() == 0


def test_shards_of_one_hash_fit(spark, edges, tmp_path):
    sizes = [600, 600, 30, 9000, 400, 400, 0, 1000, 501, 500, 1001] + [7] * 300
    rows = [(i, None if n == 0 else chr(97 + k % 26) * n, k) for i in (5, None) for k, n in enumerate(sizes)] + [(9, "solo", -1), (10, "x" * 5000, -2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part long")
    for out in (shard(docs, 1000).collect(), shard(docs, 1000, bits=7).collect()):
        assert Counter((r["doc_id"], r["n_bytes"]) for r in out) == Counter((i, len(t or "")) for i, t, _ in rows)
        filled = {}
        for r in out:
            filled.setdefault((r["depth"], r["prefix"], r["part"]), []).append(r["n_bytes"])
        assert all(sum(x) <= 1000 or len(x) == 1 for x in filled.values())
        assert len(filled) <= 30
    back = write_shards(docs, f"{tmp_path}/shards", 1000)
    assert back.columns == ["doc_id", "text", "part", "depth", "prefix", "part_"]
    assert Counter((r["doc_id"], r["text"], r["part"]) for r in back.collect()) == Counter(rows)
    files = [r[0] for r in back.select(F.input_file_name(), "depth", "prefix", "part_").distinct().select(F.count("*")).collect()]
    assert files == [back.select("depth", "prefix", "part_").distinct().count()]
    kept = write_shards(edges, f"{tmp_path}/edges", 1000)
    assert Counter(map(tuple, kept.select(*edges.columns).collect())) == Counter(map(tuple, edges.collect()))
    assert write_shards(edges.where("false"), f"{tmp_path}/none", 1000).count() == 0


def test_boundaries_are_optimal():
    rng = np.random.default_rng(2)
    for _ in range(20):
        m = int(rng.integers(1, 8))
        top = np.sort(rng.choice(np.arange(1, 50), m, replace=False))
        counts = rng.integers(1, 9, m)

        def padding(edges):
            return sum(int(c) * (min(e for e in edges if e >= t) - int(t)) for t, c in zip(top, counts, strict=True))

        for k in (1, 2, 3):
            best = min(padding([*map(int, x), int(top[-1])]) for r in range(min(k, m)) for x in combinations(top[:-1], r))
            assert padding(packing.boundaries(counts, top, counts * top, k)) == best


def test_boundaries_above_128_are_close(spark):
    n = np.random.default_rng(5).integers(1, 3000, 2000)
    top, counts = np.unique(n, return_counts=True)
    bounds = np.array(packing.boundaries(counts, top, counts * top, 16))
    best = int((bounds[np.searchsorted(bounds, n)] - n).sum())
    lengths = spark.createDataFrame([(i, int(x)) for i, x in enumerate(n)], "doc_id long, n_tokens long")
    got = packing.pack(lengths).agg(F.sum(F.col("bucket") - F.col("n_tokens"))).first()[0]
    assert best <= got <= 1.05 * best


def test_packing(spark, small, edges):
    rows = packing.pack(packing.token_lengths(small), buckets=4, budget=2000, group_rows=20).collect()
    assert len(rows) == small.count() == len({(r["bucket"], r["batch"], r["slot"]) for r in rows})
    for (bucket, _), n in Counter((r["bucket"], r["batch"]) for r in rows).items():
        assert n <= max(1, 2000 // max(1, bucket))
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {r["doc_id"]: len(words(r["text"])) for r in small.collect()}
    assert packing.pack(packing.token_lengths(edges)).count() == len(EDGES)
    assert packing.pack(packing.token_lengths(edges.where("false"))).count() == 0


def test_packing_of_odd_rows(spark):
    """Repeated and null ids and ties have slots of their own."""
    rows = [(1, "a b c")] * 7 + [(None, "a b")] * 5 + [(2, None), (2, ""), (3, "a " * 500)]
    got = packing.pack(packing.token_lengths(spark.createDataFrame(rows, "doc_id long, text string")), buckets=2, budget=9).collect()
    assert len(got) == len(rows) == len({(r["bucket"], r["batch"], r["slot"]) for r in got})
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == Counter((i, len(words(t))) for i, t in rows)


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_odd_tables(spark, small, stage):
    """Each stage: nulls, blanks, repeated rows and an empty table."""
    name, run = corpus_pipeline.STAGES[stage]
    good = small.where("length(text) > 600").orderBy("doc_id").limit(6)
    odd = spark.createDataFrame([(None, None, None, None, None), (900, "", "en", None, 0), (901, " \n", None, "s", 2), (902, None, None, None, None)], small.schema)
    docs = good.unionByName(good).unionByName(odd).unionByName(odd)
    out = run(spark, Scratch(spark, "test").save(docs), SMALL)
    assert out.count() <= docs.count()
    if name != "packing":
        assert out.columns == small.columns
    assert run(spark, Scratch(spark, "test").save(docs.where("false")), SMALL).count() == 0


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_columns_of_any_name(spark, small, stage):
    """Columns named like the stages' own come back as they were, in their places."""
    names = ["_name", "_name_", "n_lines", "n_removed", "component_id", "row", "given", "rest", "m", "n", "kept", "id", "word"]
    docs = small.orderBy("doc_id").limit(60)
    wide = docs.select(*[F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")).alias(c) for c in names], *docs.columns)
    out = corpus_pipeline.STAGES[stage][1](spark, Scratch(spark, "test").save(wide.unionByName(wide.limit(3))), SMALL)
    assert out.columns == wide.columns
    rows = out.collect()
    assert len(rows) > 5 and all(r[c] == f"{c}:{r['doc_id']}" for r in rows for c in names)


def test_pipeline(spark, small):
    from .test_dedup import brute_components, brute_lines

    docs, seen = small, []
    scratch = Scratch(spark, "test")
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        docs = scratch.save(stage(spark, docs, SMALL))
        if name != "packing":
            assert docs.columns == small.columns
            after = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "line_dedup":
            want = brute_lines(list(before.items()))
            assert after == {i: t for i, t in want.items() if t == before[i] or words(t)}
        if name == "near_copies":
            assert set(after) == {i for i, (_, c) in brute_components(list(before.items())).items() if c == i}
        seen.append(name)
    assert docs.count() == len(after) and seen == ["quality_rules", "line_dedup", "near_copies", "decontamination", "packing"]


def test_pipeline_tells_rows_apart(spark, tmp_path):
    item = " ".join(f"b{k}" for k in range(30))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    say = lambda a: " ".join(f"{a}{k}" for k in range(40))
    rows = [(None, f"x {item} y"), (None, say("n")), (3, f"x {item} z"), (3, say("c")), (4, None), (4, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = Counter(map(tuple, corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()))
    assert left == Counter([rows[1], *rows[3:]])
    rows = [(None, say("n")), (None, say("n")), (5, say("r")), (5, say("r")), (7, say("s")), (6, say("s") + " more"), (6, say("u")), (None, say("s")), (8, None), (8, None), (None, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = Counter(map(tuple, corpus_pipeline.near_copies(spark, docs, str(tmp_path)).collect()))
    assert left == Counter([rows[0], rows[2], rows[5], rows[6], *rows[8:]])
