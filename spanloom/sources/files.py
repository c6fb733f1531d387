"""Readers and sinks: JSON lines, whole files, mail folders, completions and result caches."""

from __future__ import annotations

import email
import email.policy

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import split_addresses, token_count

SELECTION = "struct<doc_id:int,start_pos:int,end_pos:int,content:string,metadata:struct<total_count:int,best_dist:int,mode:string,importance:int>>"
SAMPLE = f"id string, source_dataset string, selections array<struct<id:string,selections:array<{SELECTION}>>>, docs array<struct<id:int,text:string,filename:string,chunks_pos:array<int>,metadata:map<string,string>>>, instruction_context map<string,string>, type string"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines (gzip by suffix) with a fixed schema; a broken line fails."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str, compress: bool = True) -> None:
    df.write.mode("overwrite").option("compression", "gzip" if compress else "none").json(path)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that hold one JSON array or object each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_csv(spark: SparkSession, path: str, schema: str, json_columns: dict[str, str] | None = None) -> DataFrame:
    """CSV with quoted newlines; ``json_columns`` are parsed with their schemas."""
    out = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    for c, s in (json_columns or {}).items():
        out = out.withColumn(c, F.from_json(c, s))
    return out


def read_texts(spark: SparkSession, path: str, id_pattern: str = r"([^/]+)\.txt$") -> DataFrame:
    """Whole text files as ``(id, text, path)``; the id is the pattern's group of the path."""
    raw = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))
    return raw.select(F.regexp_extract("path", id_pattern, 1).alias("id"), "text", "path")


def read_topics(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """Files ``test<topic>/<number>.txt`` as ``(topic_id, doc_id, text)``; an error if a topic's numbers are not 0, 1 and so on, each once."""
    raw = read_texts(spark, path, r"/test(\d{1,2})/[0-5]\.txt$")
    docs = raw.where("id <> ''").select(F.col("id").cast("int").alias("topic_id"), F.regexp_extract("path", r"([0-5])\.txt$", 1).cast("int").alias("doc_id"), "text")
    if check:
        broken = docs.groupBy("topic_id").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("d"), F.max("doc_id").alias("last")).where("n <> d or last <> n - 1")
        found = [r["topic_id"] for r in broken.select("topic_id").orderBy("topic_id").limit(10).collect()]
        if found:
            raise ValueError(f"documents of topics {found} are not numbered without gaps")
    return docs


def read_sheets(spark: SparkSession, paths: dict[str, str], schema: str, keys: list[str]) -> DataFrame:
    """Sheets of one form, a CSV file each, side by side: ``keys`` and every other column once a sheet, named ``<column>_<sheet>``; rows that a sheet lacks are null there."""
    out = None
    for name, path in paths.items():
        sheet = read_csv(spark, path, schema)
        sheet = sheet.select(*keys, *[F.col(c).alias(f"{c}_{name}") for c in sheet.columns if c not in keys])
        out = sheet if out is None else out.join(sheet, keys, "full")
    return out


def sample_docs(samples: DataFrame) -> DataFrame:
    return samples.select(F.col("id").alias("sample_id"), F.explode("docs").alias("d")).select("sample_id", F.col("d.id").alias("doc_id"), "d.text", "d.filename", "d.chunks_pos")


def sample_references(samples: DataFrame) -> DataFrame:
    """The long form of all reference groups; a group without selections is one row with null offsets."""
    groups = samples.select(F.col("id").alias("sample_id"), F.posexplode_outer("selections").alias("group_ord", "g"))
    each = groups.select("sample_id", "group_ord", F.col("g.id").alias("group_id"), F.posexplode_outer("g.selections").alias("sel_ord", "s"))
    return each.select("sample_id", "group_ord", "group_id", "sel_ord", "s.doc_id", "s.start_pos", "s.end_pos", "s.content")


_MAIL = "id string, user string, message_id string, subject string, sender string, recipients string, body string, chain_count int"


def read_mail(spark: SparkSession, path: str) -> DataFrame:
    """A mail folder, one message a file: headers, addresses, joined plain-text parts, words and quoted messages counted.

    ``id`` is the last three parts of the path, ``from_address`` the first address of the sender, ``to_addresses`` the distinct ones
    of the recipients (null without any).
    """

    def parse(batches):
        for df in batches:
            rows = []
            for where, content in zip(df["path"], df["content"], strict=True):
                m = email.message_from_bytes(content, policy=email.policy.compat32)
                parts = [p.get_payload(decode=True) or b"" for p in m.walk() if p.get_content_type() == "text/plain"]
                body = "\n".join(p.decode("utf-8", "replace") for p in parts)
                folder = where.rstrip("/").split("/")
                rows.append(("/".join(folder[-3:]), folder[-3] if len(folder) > 3 else "", m.get("Message-ID"), m.get("Subject"), m.get("From"), m.get("To"), body, body.count("-----Original Message-----")))
            yield pd.DataFrame(rows, columns=["id", "user", "message_id", "subject", "sender", "recipients", "body", "chain_count"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    read = files.select("path", "content").mapInPandas(parse, _MAIL)
    listed = lambda c: F.when(F.trim(c) != "", split_addresses(F.col(c)))
    return read.withColumns({"from_address": F.get(listed("sender"), F.lit(0)), "to_addresses": listed("recipients"), "word_count": token_count(F.col("body"))})


def cache_key(arguments: Column) -> Column:
    """The URL-safe base64 SHA-1 of a call's arguments."""
    return F.translate(F.base64(F.unhex(F.sha1(F.to_json(arguments)))), "+/", "-_")


def replay(requests: DataFrame, completions: DataFrame, key: str = "key") -> DataFrame:
    """Requests with their recorded completions; ``completion`` is null where none is recorded."""
    return requests.join(completions.select(key, "completion"), key, "left")


def missing(requests: DataFrame, completions: DataFrame, key: str = "key") -> DataFrame:
    return requests.join(completions.select(key), key, "left_anti")


def forget(completions: DataFrame, value: str) -> DataFrame:
    """A completion table without entries equal to ``value``."""
    return completions.where(~F.col("completion").eqNullSafe(F.lit(value)))


def failures(completions: DataFrame) -> DataFrame:
    """Entries that record an error instead of a completion."""
    return completions.where(F.col("completion").startswith("<error"))


def result_key(predictions: DataFrame, settings: Column) -> DataFrame:
    """``(file, key)`` of prediction files ``(file, content)``: SHA-256 over content and settings, under which a result is kept."""
    return predictions.select("file", F.sha2(F.concat_ws("|", F.sha2("content", 256), F.to_json(settings)), 256).alias("key"))


def write_eval_rows(rows: DataFrame, path: str) -> None:
    """Evaluation rows as JSON lines, without the sample; nested selections become JSON strings."""
    flat = rows.drop("sample")
    nested = [f.name for f in flat.schema.fields if "selection" in f.name and f.dataType.typeName() in ("array", "struct")]
    write_jsonl(flat.withColumns({c: F.to_json(c) for c in nested}), path, compress=False)


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """A folder of books ``<number>.txt`` as ``(id, text, word_count)``, by id."""
    return read_texts(spark, path, r"(\d+)\.txt$").where("id <> ''").select(F.col("id").cast("long").alias("id"), "text", token_count(F.col("text")).alias("word_count")).orderBy("id")


def first_rows(rows: DataFrame, order: list[str], n: int, where: Column | None = None) -> DataFrame:
    """The first ``n`` rows that qualify, in a fixed order."""
    return (rows if where is None else rows.where(where)).orderBy(*order).limit(n)


def random_rows(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in the order of MD5 of key and seed."""
    return rows.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), key).limit(n)


def all_sets(sets: dict[str, DataFrame]) -> DataFrame:
    """All data sets of a split as one, each row with its ``dataset``; missing columns are null."""
    out = None
    for name, rows in sets.items():
        part = rows.withColumn("dataset", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def resolve(name: str, tables: dict[str, str], exists=None) -> tuple[str, str, str]:
    """``(path, dataset, split)`` of ``dataset/split`` looked up without case, else in ``all/split``; a real path resolves to itself.

    With ``exists``, a test of paths, an unknown name or a missing file is an error.
    """
    known = {k.lower(): v for k, v in tables.items()}
    dataset, _, split = name.partition("/")
    path = known.get(name.lower()) or (known.get(f"all/{split.lower()}") if split and "." not in split else None)
    found = (path, dataset, split) if path else (name, "", "")
    if exists is not None and not exists(found[0]):
        raise FileNotFoundError(found[0])
    return found
