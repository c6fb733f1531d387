"""Raw source rows to the working forms: samples, documents, reference spans.

Loaders return ``(docs, refs)``: ``docs(sample_id, doc_id, text, filename, chunks_pos)``
and ``refs(sample_id, group_ord, sel_ord, doc_id, start_pos, end_pos, content,
importance)``. Offsets are code points, ends exclusive; a sample's documents are
numbered from 0.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import chunk_ends, strip, token_count

ARTICLE = "struct<paragraphs:array<array<struct<text:string>>>>"
#: An article's first two paragraphs are its title, at most eleven more are shown to annotators.
TITLE_PARAGRAPHS, SHOWN = 2, 11
#: Ranges of a number that rows are counted by.
CELLS = 4096


def annotation_ids(answers: Column) -> Column:
    """``array<struct<sentence, importance>>`` of a ``map`` with the keys topic-segment-2, -4 and so on.

    Sentences that are not in the summary are left out; the most important come first, then in order.
    """
    marks = F.map_filter(answers, lambda k, v: k != "comments")
    numbered = F.transform(F.sequence(F.lit(0), F.size(marks) - 1), lambda i: F.struct(i.alias("sentence"), F.element_at(marks, F.concat(F.lit("topic-segment-"), (2 * (i + 1)).cast("string"))).alias("mark")))
    chosen = F.filter(numbered, lambda x: x["mark"] != "not-in-summary")
    rated = F.transform(chosen, lambda x: F.struct(x["sentence"].alias("sentence"), F.get(F.split(x["mark"], "-"), F.lit(1)).cast("int").alias("importance")))
    ordered = F.array_sort(F.transform(rated, lambda x: F.struct((-x["importance"]).alias("o"), x["sentence"].alias("sentence"), x["importance"].alias("importance"))))
    return F.when(F.size(marks) > 0, F.transform(ordered, lambda x: F.struct(x["sentence"].alias("sentence"), x["importance"].alias("importance")))).otherwise(F.array().cast("array<struct<sentence:int,importance:int>>"))


def _document(sentences: str) -> list[Column]:
    return [F.array_join(sentences, "\n").alias("text"), F.coalesce(chunk_ends(F.col(sentences)), F.array().cast("array<int>")).alias("chunks_pos")]


def sentence_spans(chosen: DataFrame, docs: DataFrame) -> DataFrame:
    """``chosen(sample_id, group_ord, sel_ord, doc_id, sentence, importance)`` with the offsets and text of each sentence, without its newline."""
    both = chosen.join(docs.select("sample_id", "doc_id", "text", "chunks_pos"), ["sample_id", "doc_id"])
    start = F.when(F.col("sentence") > 0, F.get("chunks_pos", F.col("sentence") - 1)).otherwise(0)
    end = F.get("chunks_pos", "sentence") - F.when(F.col("sentence") < F.size("chunks_pos") - 1, 1).otherwise(0)
    placed = both.select("sample_id", "group_ord", "sel_ord", "doc_id", start.alias("start_pos"), end.alias("end_pos"), "importance", "text")
    content = F.expr("substr(text, start_pos + 1, end_pos - start_pos)")
    return placed.select("sample_id", "group_ord", "sel_ord", "doc_id", "start_pos", "end_pos", content.alias("content"), "importance")


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` with their place ``_p`` from 0 in the order of a number; counts of ``CELLS`` equal ranges of it spread the work."""
    span = rows.agg(F.min(order).cast("double").alias("_lo"), F.max(order).cast("double").alias("_hi"))
    celled = rows.crossJoin(F.broadcast(span)).withColumn("_c", F.coalesce(F.floor((F.col(order).cast("double") - F.col("_lo")) * CELLS / (F.col("_hi") - F.col("_lo") + 1)), F.lit(-1))).drop("_lo", "_hi")
    before = Window.partitionBy(F.lit(0)).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)  # over cells
    starts = celled.groupBy("_c").agg(F.count("*").alias("_k")).select("_c", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_first"))
    here = F.row_number().over(Window.partitionBy("_c").orderBy(order)) - 1
    return celled.withColumn("_r", here).join(starts, "_c").withColumn("_p", F.col("_first") + F.col("_r")).drop("_c", "_r", "_first")


def annotated_articles(tasks: DataFrame, prefix: str, first: int = 0) -> tuple[DataFrame, DataFrame]:
    """``tasks(row, task_id, article, answers)``, one row an annotator, both payloads as JSON.

    Samples are numbered from ``first`` in the order their task is first seen; a task's rows are its annotators in order.
    """
    parsed = tasks.select("row", "task_id", F.from_json("article", ARTICLE)["paragraphs"].alias("p"), F.from_json("answers", "array<map<string,string>>")[0].alias("a"))
    heads = parsed.groupBy("task_id").agg(F.min("row").alias("head"), F.min_by("p", "row").alias("p"))
    texts = F.transform(F.slice("p", TITLE_PARAGRAPHS + 1, SHOWN), lambda x: strip(F.concat(x[0]["text"], x[1]["text"])))
    numbers = numbered(tasks.groupBy("task_id").agg(F.min("row").alias("head")), "head")
    samples = heads.join(numbers.select("task_id", "_p"), "task_id").select("task_id", F.concat(F.lit(f"{prefix}_"), (F.col("_p") + first).cast("string")).alias("sample_id"), texts.alias("s"))
    docs = samples.select("sample_id", F.lit(0).alias("doc_id"), *_document("s"), F.lit(None).cast("string").alias("filename"))
    groups = parsed.withColumn("group_ord", F.row_number().over(Window.partitionBy("task_id").orderBy("row")) - 1).join(samples.select("task_id", "sample_id"), "task_id")
    chosen = groups.select("sample_id", "group_ord", F.lit(0).alias("doc_id"), F.posexplode(annotation_ids(F.col("a"))).alias("sel_ord", "x")).select("*", "x.sentence", "x.importance")
    return docs, sentence_spans(chosen, docs)


def aspect_topics(raw: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """``raw(topic_id, aspect_label, documents, selected_sentences)`` with given offsets; texts and contents are stripped."""
    keyed = raw.withColumn("sample_id", F.concat(F.lit(f"{prefix}."), "topic_id", F.lit("/"), "aspect_label"))
    each = keyed.select("sample_id", F.explode("documents").alias("d"))
    docs = each.select("sample_id", F.col("d.doc_id").alias("doc_id"), strip(F.col("d.doc_text")).alias("text"), F.col("d.doc_filename").alias("filename"), chunk_ends(F.split("d.doc_text", "\n")).alias("chunks_pos"))
    spans = keyed.select("sample_id", F.lit(0).alias("group_ord"), F.posexplode("selected_sentences").alias("sel_ord", "s"))
    refs = spans.select("sample_id", "group_ord", "sel_ord", F.col("s.doc_id").alias("doc_id"), F.col("s.start_char").alias("start_pos"), F.col("s.end_char").alias("end_pos"), strip(F.col("s.span_text")).alias("content"), F.lit(None).cast("int").alias("importance"))
    return docs, refs


def claims(raw: DataFrame, corpus: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """``raw(id, claim, evidence, cited_doc_ids)`` over ``corpus(doc_id, title, abstract)``.

    ``evidence`` is an ordered ``array<struct<doc_id, sentences>>``. Documents with evidence come first, then other cited
    ones; a sentence stands where it is found in its document.
    """
    keyed = raw.select(F.concat(F.lit(f"{prefix}."), F.col("id").cast("string")).alias("sample_id"), "evidence", F.array_union(F.transform("evidence", lambda e: e["doc_id"]), "cited_doc_ids").alias("all"))
    listed = keyed.select("sample_id", F.posexplode("all").alias("doc_id", "source_id")).join(corpus.select(F.col("doc_id").alias("source_id"), "title", F.transform("abstract", strip).alias("s")), "source_id")
    docs = listed.select("sample_id", "doc_id", "source_id", *_document("s"), F.col("title").alias("filename"), "s")
    wanted = keyed.select("sample_id", F.explode("evidence").alias("e")).select("sample_id", F.col("e.doc_id").alias("source_id"), F.posexplode("e.sentences").alias("sel_ord", "sentence"))
    both = wanted.join(docs, ["sample_id", "source_id"]).withColumn("content", F.get("s", "sentence"))
    start = F.call_function("locate", F.col("content"), F.col("text")) - 1
    refs = both.select("sample_id", F.lit(0).alias("group_ord"), "sel_ord", "doc_id", start.alias("start_pos"), (start + F.length("content")).alias("end_pos"), "content", F.lit(None).cast("int").alias("importance"))
    return docs.drop("source_id", "s"), refs


def claim_violations(raw: DataFrame, corpus: DataFrame, prefix: str) -> DataFrame:
    """``(sample_id, rule, n)`` of broken rules: ``sentence`` (not exactly once in its document), ``cited`` (documents are not the distinct cited ones), ``corpus`` (a cited document is missing or there more than once)."""
    docs, refs = claims(raw, corpus, prefix)
    both = refs.join(docs.select("sample_id", "doc_id", "text"), ["sample_id", "doc_id"])
    times = F.try_divide(F.length("text") - F.length(F.replace("text", F.col("content"), F.lit(""))), F.length("content"))
    rules = [both.where(~F.coalesce(times == 1, F.lit(False))).select("sample_id", F.lit("sentence").alias("rule"))]
    keyed = raw.select(F.concat(F.lit(f"{prefix}."), F.col("id").cast("string")).alias("sample_id"), "cited_doc_ids", F.array_union(F.transform("evidence", lambda e: e["doc_id"]), "cited_doc_ids").alias("all"))
    rules.append(keyed.where(F.size("all") != F.size(F.array_distinct("cited_doc_ids"))).select("sample_id", F.lit("cited").alias("rule")))
    held = corpus.groupBy("doc_id").agg(F.count("*").alias("n"))
    rules.append(keyed.select("sample_id", F.explode("all").alias("doc_id")).join(held, "doc_id", "left").where("coalesce(n, 0) <> 1").select("sample_id", F.lit("corpus").alias("rule")))
    out = rules[0].unionByName(rules[1]).unionByName(rules[2])
    return out.groupBy("sample_id", "rule").agg(F.count("*").alias("n"))


def claim_splits(raw: DataFrame, key: str = "id", share: float = 0.85, seed: int = 42) -> DataFrame:
    """``raw`` with ``split``: the first 85 % of the rows in draw order are ``train``, the others ``dev``."""
    from .build import numbered_draws

    placed = numbered_draws(raw.withColumn("_all", F.lit(0)), "_all", key, seed)
    total = raw.agg(F.floor(F.count("*") * share).alias("_t"))
    return placed.join(F.broadcast(total), F.lit(True)).withColumn("split", F.when(F.col("_p") < F.col("_t"), "train").otherwise("dev")).drop("_all", "_p", "_t")


def debates(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``raw(id, document, abstract, spans array<struct<content, start_pos, end_pos>>)``: ``(docs, refs)``, docs with the ``argument``."""
    key = F.col("id").cast("string").alias("sample_id")
    docs = raw.select(key, F.lit(0).alias("doc_id"), F.col("document").alias("text"), F.lit(None).cast("string").alias("filename"), F.lit(None).cast("array<int>").alias("chunks_pos"), F.regexp_replace("abstract", r"(?U)\s+", " ").alias("argument"))
    each = raw.select(key, F.lit(0).alias("group_ord"), F.posexplode("spans").alias("sel_ord", "s"), F.lit(0).alias("doc_id"))
    return docs, each.select("sample_id", "group_ord", "sel_ord", "doc_id", "s.start_pos", "s.end_pos", "s.content", F.lit(None).cast("int").alias("importance"))


def claim_text(c: Column) -> Column:
    """A claim without the stops and white space around it."""
    return strip(F.regexp_replace(strip(c), r"^\.+|\.+$", ""))


def alignments(rows: DataFrame, docs: DataFrame, keys: list[str], prefix: str, separator: str = "<SPAN_SEP>") -> tuple[DataFrame, DataFrame]:
    """``rows(*keys, doc_id, offsets, span_text)`` over ``docs(*keys[:1], doc_id, text)``: one sample per ``keys``.

    An alignment has one or more spans ``s,e;s,e``; ``ok`` tells whether their joined texts are the given one.
    """
    sample = F.concat_ws(".", F.lit(prefix), *[F.col(k).cast("string") for k in keys]).alias("sample_id")
    parts = F.transform(F.split("offsets", ";"), lambda x: F.struct(F.trim(F.split(x, ",")[0]).cast("int").alias("s"), F.trim(F.split(x, ",")[1]).cast("int").alias("e")))
    placed = rows.join(docs.select(keys[0], "doc_id", "text"), [keys[0], "doc_id"]).select(sample, "doc_id", "text", "span_text", parts.alias("p"))
    cut = F.transform("p", lambda x: F.substr("text", x["s"] + 1, x["e"] - x["s"]))
    placed = placed.withColumn("cut", cut).withColumn("ok", F.regexp_replace(F.array_join("cut", separator), r"\s", "") == F.regexp_replace("span_text", r"\s", ""))
    spans = placed.select("sample_id", "doc_id", "ok", F.explode(F.arrays_zip("p", "cut")).alias("x"))
    order = Window.partitionBy("sample_id").orderBy("doc_id", "x.p.s", "x.p.e")
    refs = spans.select("sample_id", F.lit(0).alias("group_ord"), (F.row_number().over(order) - 1).alias("sel_ord"), "doc_id", F.col("x.p.s").alias("start_pos"), F.col("x.p.e").alias("end_pos"), F.col("x.cut").alias("content"), F.lit(None).cast("int").alias("importance"), "ok")
    named = rows.select(*keys, sample).distinct().join(docs, keys[0])
    return named.select("sample_id", "doc_id", "text", F.lit(None).cast("string").alias("filename"), F.lit(None).cast("array<int>").alias("chunks_pos")), refs


def ordered_selections(refs: DataFrame, docs: DataFrame) -> DataFrame:
    """Selections in order of place within their group, with ``total_count``: how many of the sample's documents hold the content."""
    order = Window.partitionBy("sample_id", "group_ord").orderBy("doc_id", "start_pos", "end_pos", "sel_ord")
    held = refs.select("sample_id", "content").distinct().join(docs.select("sample_id", "text"), "sample_id").where("contains(text, content)")
    counts = held.groupBy("sample_id", "content").agg(F.count("*").alias("total_count"))
    return refs.withColumn("sel_ord", F.row_number().over(order) - 1).join(counts, ["sample_id", "content"], "left").withColumn("total_count", F.coalesce("total_count", F.lit(0)))


def _is_slice(text: str | None, start_pos: int | None, end_pos: int | None, content: str | None) -> bool:
    """Whether a span's content stands at its place."""
    return None not in (text, start_pos, end_pos, content) and start_pos >= 0 and text[start_pos : max(start_pos, end_pos)] == content


def sample_violations(refs: DataFrame, docs: DataFrame, sentences: bool = False, ungrounded_ok: bool = False) -> DataFrame:
    """``(sample_id, rule, n)`` of the broken rules: none for sound samples.

    content: a span's slice is its content. grounded: a span has a place (unless allowed). number: documents are numbered
    from 0 without gaps. For sentence samples too: edge: a span begins and ends with a sentence; rising: sentence ends
    rise; length: the last one is the text's length.
    """
    each = refs.where("doc_id >= 0").groupBy("sample_id", "doc_id").agg(F.collect_list(F.struct("start_pos", "end_pos", "content")).alias("_s"))
    both = each.join(docs.select("sample_id", "doc_id", "text", "chunks_pos", F.lit(True).alias("_d")), ["sample_id", "doc_id"], "full").select("sample_id", "_s", "text", "chunks_pos", F.coalesce("_d", F.lit(False)).alias("_d"))

    def run(batches):
        for batch in batches:
            rows, names, counts = [], [], []
            for i in range(batch.num_rows):
                spans, text, ends, known = (batch.column(c)[i].as_py() for c in (1, 2, 3, 4))
                spans = spans or []
                bad = {"content": sum(not _is_slice(text, **x) for x in spans)}
                if sentences:
                    whole = set(zip([0, *(ends or [])], [*(e - 1 for e in (ends or [])[:-1]), *(ends or [])[-1:]], strict=False))
                    bad["edge"] = sum((x["start_pos"], x["end_pos"]) not in whole for x in spans)
                    bad["rising"] = known and any(None not in (a, b) and b <= a for a, b in zip(ends or [], (ends or [])[1:], strict=False))
                    bad["length"] = known and not (ends and text is not None and ends[-1] == len(text))
                for rule, n in bad.items():
                    if n:
                        rows.append(i)
                        names.append(rule)
                        counts.append(int(n))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["sample_id", "rule", "n"])

    found = both.mapInArrow(run, T.StructType([both.schema["sample_id"], T.StructField("rule", T.StringType()), T.StructField("n", T.LongType())]))
    rules = []
    if not ungrounded_ok:
        rules.append(refs.where("doc_id < 0").select("sample_id", F.lit("grounded").alias("rule")))
    ids = docs.groupBy("sample_id").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n"), F.count_distinct("doc_id").alias("d"))
    rules.append(ids.where("lo <> 0 or hi <> n - 1 or d <> n").select("sample_id", F.lit("number").alias("rule")))
    out = found
    for r in rules:
        out = out.unionByName(r.withColumn("n", F.lit(1).cast("long")))
    return out.groupBy("sample_id", "rule").agg(F.sum("n").alias("n"))


def card_filters(cards: DataFrame, least_words: int = 20) -> DataFrame:
    """Debate cards ``(file, ord, document, extract, abstract)`` worth keeping.

    Short documents go; of equal documents the first stays (by file and place, before the filters that follow);
    then extracts of 10 words or less, abstracts of 3 or less, and extracts no shorter than their document go.
    """
    words = lambda c: token_count(F.col(c))
    long = cards.where(words("document") >= least_words)
    first = long.withColumn("_r", F.row_number().over(Window.partitionBy("document").orderBy("file", "ord"))).where("_r = 1").drop("_r")
    kept = first.where((words("extract") > 10) & (words("abstract") > 3))
    return kept.withColumn("compression", words("extract") / words("document")).where("compression < 1")


def year_splits(cards: DataFrame, year: str = "year", last_train: int = 2016, dev: int = 2017) -> DataFrame:
    """Train up to a year, dev the next, test after; a row that shares its abstract, extract or document with a later split goes."""
    split = F.when(F.col(year) <= last_train, "train").when(F.col(year) == dev, "dev").otherwise("test")
    out = cards.withColumn("split", split)
    rank = F.when(F.col("split") == "train", 0).when(F.col("split") == "dev", 1).otherwise(2)
    out = out.withColumn("_rank", rank)
    for key in ("abstract", "extract", "document"):
        out = out.join(out.groupBy(key).agg(F.max("_rank").alias(f"_{key}")), key, "left")
    return out.where("_rank >= coalesce(_abstract, _rank) and _rank >= coalesce(_extract, _rank) and _rank >= coalesce(_document, _rank)").drop("_rank", "_abstract", "_extract", "_document")


def prefixed(samples: DataFrame, prefix: str, id_col: str = "sample_id") -> DataFrame:
    """Sample ids with a prefix that tells the dataset."""
    return samples.withColumn(id_col, F.concat(F.lit(f"{prefix}."), F.col(id_col).cast("string")))


def seeded_order(id_col: str, seed: int = 42) -> list[Column]:
    """A random order that any engine repeats: MD5 of id and seed, then the id."""
    return [F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}"))), F.col(id_col)]


def word_range_sample(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text", least: int = 350, most: int = 3500, stratum: Column | None = None, seed: int = 42) -> DataFrame:
    """``n`` random documents of ``least`` to ``most`` words; with a boolean ``stratum`` half of them (rounded up) from its true rows."""
    fit = docs.withColumn("word_count", token_count(F.col(text_col))).where(F.col("word_count").between(least, most))
    if stratum is None:
        return fit.orderBy(*seeded_order(id_col, seed)).limit(n)
    yes = fit.where(stratum).orderBy(*seeded_order(id_col, seed)).limit(-(-n // 2))
    no = fit.where(~stratum).orderBy(*seeded_order(id_col, seed)).limit(n // 2)
    return yes.unionByName(no)


def filter_groups(groups: DataFrame, raters: int = 3, drop_ungrounded: bool = True, keep_emptied: bool = False) -> DataFrame:
    """Annotator spans ``(sample_id, is_negative, group_id, doc_id, start_pos, end_pos)`` of the samples worth merging.

    Negative samples stay as they are. Of others, spans without a place go, and then groups without spans; samples with
    less than ``raters`` groups left go. A group without spans is a row with a null ``doc_id``.
    """
    positive = groups.where("not is_negative")
    kept = positive.where("doc_id >= 0") if drop_ungrounded else positive.where("doc_id is not null")
    if keep_emptied:
        every = positive.select("sample_id", "is_negative", "group_id").distinct()
        kept = every.join(kept, ["sample_id", "is_negative", "group_id"], "left").select(*groups.columns)
    enough = kept.groupBy("sample_id").agg(F.count_distinct("group_id").alias("_n")).where(F.col("_n") >= raters).select("sample_id")
    return groups.where("is_negative").unionByName(kept.join(enough, "sample_id", "left_semi").select(*groups.columns))


def answer_group(groups: DataFrame, medoids: DataFrame, mode: str = "merge", annotated: str = "ReverseInstructions") -> DataFrame:
    """Which group's spans answer each sample: ``(sample_id, group_id)``; negatives of the ``annotated`` dataset have none.

    ``groups(sample_id, source_dataset, is_negative, group_id)`` has a row a group, ``medoids(sample_id, group_id)`` the
    group that agrees best with the others (``Merged`` not counted). ``best`` takes that, ``merge`` the group ``Merged``
    and ``model:X`` the group X of annotated samples; a single group answers by itself.
    """
    if mode not in ("best", "merge") and not mode.startswith("model:"):
        raise ValueError(f"unknown mode {mode}")
    wanted = "Merged" if mode in ("best", "merge") else mode.removeprefix("model:")
    sizes = groups.groupBy("sample_id").agg(F.count("*").alias("n"), F.first("source_dataset").alias("source"), F.first("is_negative").alias("neg"), F.min("group_id").alias("only"), F.max((F.col("group_id") == wanted).cast("int")).alias("has"))
    own = (F.col("source") == annotated) & F.lit(mode != "best")
    out = sizes.join(medoids.select("sample_id", F.col("group_id").alias("medoid")), "sample_id", "left")
    chosen = F.when(own, F.when(F.col("has") == 1, F.lit(wanted))).when(F.col("n") > 1, F.col("medoid")).otherwise(F.col("only"))
    return out.where(~((F.col("source") == annotated) & F.col("neg"))).select("sample_id", chosen.alias("group_id")).where("group_id is not null")


def translate_instructions(given: DataFrame, returned: DataFrame) -> DataFrame:
    """Given instructions and those a model returned, by place: ``(sample_id, ord, instruction, model_instruction, f1, recall, differs)``.

    ``given(sample_id, instructions)`` and ``returned(sample_id, instructions)`` must have equal lengths (else an error).
    A returned number 0 to 5 stands for its place; others differ if F1 and recall of their normalized words, repeats counted, are under a half.
    """
    from ..functions.bags import bag_scores, numbered
    from ..functions.text import normalize_answer

    both = given.join(returned.withColumnRenamed("instructions", "back"), "sample_id")
    zipped = F.when(F.size("instructions") == F.size("back"), F.arrays_zip(F.col("instructions").alias("a"), F.col("back").alias("b"))).otherwise(F.raise_error(F.lit("instruction lists differ in length")))
    each = both.select("sample_id", F.posexplode(zipped.cast("array<struct<a:string,b:string>>")).alias("ord", "x")).select("sample_id", "ord", F.col("x.a").alias("instruction"), F.col("x.b").alias("model_instruction"))
    words = lambda c: numbered(F.filter(F.split(normalize_answer(F.col(c)), " "), lambda w: w != ""))
    each = each.withColumn("_a", words("instruction")).withColumn("_b", words("model_instruction"))
    scores = bag_scores(F.col("_a"), F.col("_b"))
    out = each.withColumn("f1", scores["f1"]).withColumn("recall", scores["recall"]).drop("_a", "_b")
    named = F.col("model_instruction").rlike("^[0-5]$")
    return out.withColumn("differs", ~named & (F.col("f1") < 0.5) & (F.col("recall") < 0.5))


def selection_samples(annotated: DataFrame) -> DataFrame:
    """``annotated(sample_id, is_negative, instructions, results)`` to a row per instruction and group.

    ``results`` is ``map<model, map<instruction, array<string>>>``. Negative samples get one empty group ``Negative``;
    models that lack an instruction have no group for it; samples without results give nothing.
    """
    each = annotated.where("results is not null and (is_negative or size(results) > 0)").select("sample_id", "is_negative", "results", F.posexplode("instructions").alias("i", "instruction"))
    each = each.withColumn("inst_id", F.concat("sample_id", F.lit(".inst-"), F.col("i").cast("string")))
    answers = F.transform(F.map_entries("results"), lambda e: F.struct(e["key"].alias("group_id"), F.element_at(e["value"], F.col("instruction")).alias("spans")))
    groups = F.when(F.col("is_negative"), F.array(F.struct(F.lit("Negative").alias("group_id"), F.array().cast("array<string>").alias("spans")))).otherwise(F.filter(answers, lambda g: g["spans"].isNotNull()))
    return each.select("inst_id", "sample_id", "instruction", "is_negative", F.explode(groups).alias("g")).select("inst_id", "sample_id", "instruction", "is_negative", "g.group_id", "g.spans")
