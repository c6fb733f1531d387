"""Samples of raw sources for annotators: seven forms of source, one form of sample, drawn in a repeatable order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip, token_count
from .loaders import seeded_order

DOCUMENTS = "array<struct<id:int,text:string,filename:string,metadata:map<string,string>>>"
#: An article's paragraphs that are shown, behind its title; where negative samples begin in the draw.
PARAGRAPHS, NEGATIVES_FROM = 30, 200


def _documents(docs: Column, text, filename=lambda d: F.lit(None), metadata=lambda d: F.lit(None)) -> Column:
    return F.transform(docs, lambda d, i: F.struct(i.alias("id"), text(d).alias("text"), filename(d).cast("string").alias("filename"), metadata(d).cast("map<string,string>").alias("metadata"))).cast(DOCUMENTS)


def _single(text: Column) -> Column:
    return _documents(F.array(text), lambda t: t)


def _id(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(f"{prefix}."), key.cast("string"))


def books(rows: DataFrame) -> DataFrame:
    """``rows(id, content)``."""
    return rows.select(_id("pg-19", F.col("id")).alias("id"), _single(F.col("content")).alias("documents"))


def emails(rows: DataFrame) -> DataFrame:
    """``rows(id, content, chain_count)``; ids are the last three parts of paths. Half of a sample quotes other messages."""
    key = F.array_join(F.slice(F.split("id", "/"), -F.least(F.lit(3), F.size(F.split("id", "/"))), F.lit(3)), "/")
    return rows.select(_id("enron", key).alias("id"), _single(F.col("content")).alias("documents"), (F.coalesce("chain_count", F.lit(0)) > 0).alias("stratum"))


def news(rows: DataFrame) -> DataFrame:
    """``rows(instance_id, documents array<struct<text array<string>>>)``."""
    return rows.select(_id("multinews", _id("multinews", F.col("instance_id"))).alias("id"), _documents(F.col("documents"), lambda d: F.array_join(d["text"], "\n")).alias("documents"))


def reviews(rows: DataFrame) -> DataFrame:
    """``rows(hotel_id, reviews array<struct<content, title, review_id>>)``; titles lose their curly quotes."""
    title = lambda d: F.regexp_replace(F.regexp_replace(F.coalesce(d["title"], F.lit("")), "^“+|“+$", ""), "^”+|”+$", "")
    return rows.select(_id("tripadvisor", F.col("hotel_id")).alias("id"), _documents(F.col("reviews"), lambda d: d["content"], title, lambda d: F.create_map(F.lit("review_id"), d["review_id"].cast("string"))).alias("documents"))


def code(rows: DataFrame) -> DataFrame:
    """``rows(cluster_id, repo_name, documents array<struct<content, filename>>)``."""
    where = lambda d: F.create_map(F.lit("file_id"), F.concat(F.col("repo_name"), F.lit("/"), d["filename"]))
    return rows.select(_id("github", F.col("cluster_id")).alias("id"), _documents(F.col("documents"), lambda d: d["content"], lambda d: d["filename"], where).alias("documents"))


def wiki(rows: DataFrame) -> DataFrame:
    """``rows(id, title, text)``: the title and the first paragraphs, ``PARAGRAPHS`` in all."""
    parts = F.concat(F.array("title"), F.split("text", "\n\n"))
    return rows.select(_id("wiki", F.col("id")).alias("id"), _single(strip(F.array_join(F.slice(parts, 1, PARAGRAPHS), "\n\n"))).alias("documents"))


def abstracts(rows: DataFrame) -> DataFrame:
    """``rows(id, title, content)``; the words of the title do not count."""
    title, text = F.coalesce("title", F.lit("")), F.coalesce("content", F.lit(""))
    return rows.select(_id("pubmed", F.col("id")).alias("id"), _single(F.concat(title, F.lit("\n\n"), text)).alias("documents"), token_count(text).alias("word_count"))


#: The kinds of source, in the order of a pool, with the type of their samples.
SOURCES = {"books": (books, "book"), "emails": (emails, "email"), "wiki": (wiki, "wiki"), "abstracts": (abstracts, "abstract"), "news": (news, "news_article"), "reviews": (reviews, "hotel_reviews"), "code": (code, "code")}


def sample_source(kind: str, rows: DataFrame, n: int = 500, least: int = 350, most: int = 3500, negative: int = 25, negatives_from: int = NEGATIVES_FROM, seed: int = 42) -> DataFrame:
    """``(type, id, documents, word_count, place, is_negative)``: ``n`` samples of ``least`` to ``most`` words.

    Where a source has strata, half of the sample (rounded up) is of the true one. ``place`` is the order of the draw, in which
    ``negative`` samples from ``negatives_from`` on are negatives. Only ``n`` rows of each stratum reach the numbering.
    """
    form, type_ = SOURCES[kind]
    given = form(rows)
    words = F.col("word_count") if "word_count" in given.columns else F.aggregate("documents", F.lit(0), lambda s, d: s + token_count(d["text"]))
    fit = given.withColumn("word_count", words).where(F.col("word_count").between(least, most))
    if "stratum" in given.columns:
        first = lambda part, k: part.orderBy(*seeded_order("id", seed)).limit(k)
        drawn = first(fit.where("stratum"), -(-n // 2)).unionByName(first(fit.where("not stratum"), n // 2))
    else:
        drawn = fit.orderBy(*seeded_order("id", seed)).limit(n)
    packed = drawn.agg(F.array_sort(F.collect_list(F.struct(*seeded_order("id", seed)))).alias("_o"))  # n short ids
    placed = drawn.join(F.broadcast(packed.select(F.posexplode("_o").alias("place", "_x")).select("place", F.col("_x.id").alias("id"))), "id")
    flag = F.col("place").between(negatives_from, negatives_from + negative - 1)
    return placed.select(F.lit(type_).alias("type"), "id", "documents", "word_count", "place", flag.alias("is_negative"))


def sample_pool(sources: dict[str, DataFrame], **settings) -> DataFrame:
    """The samples of several sources."""
    out = None
    for kind in SOURCES:
        if kind in sources:
            part = sample_source(kind, sources[kind], **settings)
            out = part if out is None else out.unionByName(part)
    return out
