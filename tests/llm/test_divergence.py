"""Source divergence against a plain count of everything, and the query's twin."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from spanloom.llm import divergence, queries
from spanloom.llm.divergence import Audit, source_divergence

from .conftest import SMALL

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, top):
    docs = [tuple(x or "" for x in r) for r in rows]
    df, n, groups = Counter(), Counter(), {(lang, s) for lang, s, _ in docs}
    for lang, s, text in docs:
        found = [t.translate(LOWER) for t in TERM.findall(text)]
        df.update((lang, t) for t in set(found))
        n.update((lang, s, t) for t in found)
    kept = defaultdict(list)
    for (lang, t), c in df.items():
        if c >= least:
            kept[lang].append(t)
    p = lambda c, total, v: 1 + 10**9 * (c + 5) // (total + 5 * v)
    out = []
    for lang, s in groups:
        terms, sources = kept[lang], [x for g, x in groups if g == lang]
        total = {x: sum(n[lang, x, t] for t in terms) for x in sources}
        mine = lambda x, t: p(n[lang, x, t], total[x], len(terms))  # noqa: E731, B023
        pairs = [(sum(abs(mine(s, t) - mine(o, t)) for t in terms), o) for o in sources if o != s]
        q = {t: p(sum(n[lang, x, t] for x in sources), sum(total.values()), len(terms)) for t in terms}
        above = [(mine(s, t) - q[t], t) for t in terms if n[lang, s, t] and mine(s, t) > q[t]]
        for part, found in (("pair", pairs), ("term", sorted(above, key=lambda r: (-r[0], r[1].encode()))[:top])):
            out += [(lang, s, part, item, v, k) for k, (v, item) in enumerate(sorted(found, key=lambda r: (-r[0], r[1].encode())), 1)]
    return sorted(out)


def rows_of(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


ODD = ["Éa éA b1c", "zz_ZZ zz@zz[x{y", "\x00a\x7fb", "", None, " \n", "\U0001f600 \U0001f600x Xx", "the The THE tHe", "w" * 70_000, "one " * 500]


@pytest.mark.parametrize("least,top,piece", [(1, 50, 1 << 20), (3, 2, 40), (10_000, 5, 1 << 20)])
def test_like_a_plain_count(spark, monkeypatch, least, top, piece):
    monkeypatch.setattr(divergence, "PIECE_BYTES", piece)
    rng = random.Random(least)
    words = [f"w{chr(97 + k)}" for k in range(25)] + ["Éa", "ZZ", "the"]
    rows = [(rng.choice(["en", "de", None, ""]), rng.choice(["s0"] * 5 + ["s1", "s2", "é", None]), " ".join(rng.choices(words, k=rng.randrange(12)))) for _ in range(300)]
    rows += [("en", f"s{k % 3}", t) for k, t in enumerate(ODD)] + [("alone", "only", None), ("zero", "a", ""), ("zero", "b", "!")] + rows[:30]
    df = spark.createDataFrame([(*r, 1, "t", 5, 2) for r in rows], "lang string, source string, text string, n long, term string, docs int, rank int").repartition(5)
    assert rows_of(source_divergence(df, least, top)) == plain(rows, least, top)


def test_columns_hold_the_terms_once(spark):
    rows = [("en", "a", "x y z x y z"), ("en", "b", "x y q"), ("en", "a", "r")]
    audit = Audit(spark.createDataFrame(rows, "lang string, source string, text string"), least_docs=1)
    assert sorted((tuple((c["source"], c["n"]) for c in r["counts"]), r["m"]) for r in audit.columns().collect()) == [((("a", 1),), 1), ((("a", 2),), 1), ((("a", 2), ("b", 1)), 2), ((("b", 1),), 1)]


def test_no_documents(spark):
    assert source_divergence(spark.createDataFrame([], "lang string, source string, text string")).collect() == []


def test_query_is_its_twin(spark):
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{SMALL}/documents.parquet'")
    out = db.execute(queries.ORACLE["op11_source_divergence"])
    names = [d[0] for d in out.description]
    df = queries.op11_source_divergence(spark, SMALL)
    assert sorted(names) == sorted(df.columns)
    assert sorted(df.select(*names).collect()) == sorted(map(tuple, out.fetchall()))
