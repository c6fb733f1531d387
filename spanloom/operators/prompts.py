"""Prompts with examples, conversation rows, and prediction over recorded completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fill_template, format_documents, strip
from ..sources.files import cache_key
from .build import answer

#: The parts of a prompt with examples.
ONE_EXAMPLE, EXAMPLES = "Below is an example of an input and the correct selected content:\n\n", "Below are examples of an input and the correct selected content:\n\n"
INPUT, END_OF_EXAMPLES = "Input Document(s):\n\n", "--- END OF EXAMPLES ---\n\nNow, select content from the below document(s):\n\n"
YOUR_ANSWER = "You're selected content answer is:\n\n"
#: What an encoded answer without spans says.
NO_DOC, NO_SPAN = "999", "No relevant content found"
#: Model families told by a part of their name.
FAMILIES = ("mistral", "phi")


def conversation(prompt: Column, reply: Column | None = None, system: Column | None = None) -> Column:
    """``array<struct<role, content>>``: system and answer only where given (a null system or answer has no turn)."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    turns = [turn("system", system if system is not None else F.lit(None).cast("string")), turn("user", prompt), turn("assistant", reply if reply is not None else F.lit(None).cast("string"))]
    return F.filter(F.array(*turns), lambda t: t["content"].isNotNull())


def prompt_items(samples: DataFrame, system: str, paraphrases: DataFrame | None = None) -> DataFrame:
    """``(sample_id, conversations)`` of ``samples(sample_id, template, context, docs, selections)``; a paraphrase replaces the template by id."""
    rows = samples
    if paraphrases is not None:
        rows = rows.join(paraphrases.select("sample_id", "paraphrase"), "sample_id", "left").withColumn("template", F.coalesce("paraphrase", "template"))
    prompt = F.concat(fill_template(F.col("template"), F.col("context")), F.lit("\n\n"), format_documents(F.col("docs"), "Doc"))
    return rows.select("sample_id", conversation(prompt, answer(F.col("selections")), F.lit(system)).alias("conversations"))


def example_prompt(instruction: Column, item: Column, docs: Column, examples: Column) -> Column:
    """A prompt with worked examples: ``examples`` is ``array<struct<item, docs, answer>>``."""
    shown = F.transform(examples, lambda e: F.concat(e["item"], F.lit("\n" + INPUT), format_documents(e["docs"], "Doc"), F.lit("\n"), e["answer"], F.lit("\n\n")))
    opening = F.when(F.size(examples) == 1, ONE_EXAMPLE).otherwise(EXAMPLES)
    return F.concat(instruction, F.lit("\n\n"), opening, F.array_join(shown, ""), F.lit(END_OF_EXAMPLES), item, F.lit("\n" + INPUT), format_documents(docs, "Doc"), F.lit(YOUR_ANSWER))


def single_document(selections: Column, doc_id: Column) -> Column:
    """The selections of one document, as of document 0."""
    return F.transform(F.filter(selections, lambda s: s["doc_id"] == doc_id), lambda s: s.withField("doc_id", F.lit(0).cast("int")))


def files_of(docs: Column, is_code: Column) -> Column:
    """Numbered documents for annotators: ``Document #1 - "name":`` (``Source File`` for code), from ``array<struct<filename, text>>``."""
    kind = F.when(is_code, "Source File").otherwise("Document")
    named = lambda d: F.when(F.coalesce(d["filename"], F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit(' - "'), strip(d["filename"]), F.lit('"')))
    return F.array_join(F.transform(docs, lambda d, i: F.concat(F.lit("\n\n"), kind, F.lit(" #"), (i + 1).cast("string"), named(d), F.lit(":\n"), strip(d["text"]))), "")


def selection_prompt(guide: Column, instructions: Column, docs: Column, is_code: Column) -> Column:
    """The guide, the numbered instructions, and the documents."""
    numbered = F.array_join(F.transform(instructions, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x, F.lit(".\n"))), "")
    return F.concat(guide, F.lit("\n"), numbered, F.lit("\n"), F.when(is_code, "Source File").otherwise("Document"), F.lit("(s):"), files_of(docs, is_code))


def encoded_answer(selections: Column, doc_mark: str = "<D>", span_mark: str = "<S>") -> Column:
    """``id<D>content<S>`` for each selection; a message under 999 for none."""
    each = F.transform(selections, lambda s: F.concat(s["doc_id"].cast("string"), F.lit(doc_mark), s["content"], F.lit(span_mark)))
    return F.when(F.size(selections) > 0, F.array_join(each, "")).otherwise(F.lit(f"{NO_DOC}{doc_mark}{NO_SPAN}{span_mark}"))


def model_id(name: Column, known: dict[str, tuple[str, str]]) -> Column:
    """``struct<id, kind>`` of a model's name or path: known names whatever their case, then families, else ``llama3``."""
    low = F.lower(name)
    make = lambda i, k: F.struct(i.alias("id"), k.alias("kind"))
    out = make(name, F.lit("llama3"))
    for family in reversed(FAMILIES):
        out = F.when(F.contains(low, F.lit(family)), make(name, F.lit(family))).otherwise(out)
    for key, (full, kind) in known.items():
        out = F.when(low == key.lower(), make(F.lit(full), F.lit(kind))).otherwise(out)
    return out


def predict(prompts: DataFrame, completions: DataFrame, model: str) -> DataFrame:
    """``(sample_id, conversations, key, selection)`` of ``prompts(sample_id, conversations)`` from recorded ``completions(key, completion)``.

    The key names model and conversation. A prompt without a record has a null selection; nothing is sent anywhere.
    """
    keyed = prompts.withColumn("key", cache_key(F.struct(F.lit(model).alias("model"), F.col("conversations"))))
    return keyed.join(completions.select("key", F.col("completion").alias("selection")), "key", "left").select("sample_id", "conversations", "key", "selection")


def predict_by_document(prompts: DataFrame, completions: DataFrame, model: str) -> DataFrame:
    """One completion a document of ``prompts(sample_id, doc_id, conversations)``: ``(sample_id, conversations, selections)``, in document order."""
    each = predict(prompts.select(F.struct("sample_id", "doc_id").alias("sample_id"), "conversations"), completions, model)
    rows = each.groupBy("sample_id.sample_id").agg(F.array_sort(F.collect_list(F.struct("sample_id.doc_id", "conversations", "selection"))).alias("r"))
    return rows.select("sample_id", F.col("r.conversations").alias("conversations"), F.col("r.selection").alias("selections"))


def next_tokens(documents: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``(prefix_id, token)``: the distinct tokens that follow any occurrence of a prefix in ``documents(doc_id, tokens)``.

    ``prefixes(prefix_id, prefix)`` are token arrays; an empty one stands before every token. Runs of the lengths in use
    join the prefixes by hash and are compared.
    """
    widths = prefixes.agg(F.collect_set(F.size("prefix")).alias("widths"))
    runs = documents.crossJoin(F.broadcast(widths)).select("tokens", F.explode("widths").alias("w")).where("size(tokens) > w")
    runs = runs.select(F.explode(F.expr("transform(sequence(0, size(tokens) - w - 1), i -> named_struct('run', slice(tokens, i + 1, w), 'token', tokens[i + w]))")).alias("r")).select("r.run", "r.token")
    return runs.join(prefixes, F.xxhash64("run") == F.xxhash64("prefix")).where("run = prefix").select("prefix_id", "token").distinct()
