"""Building datasets: first-wins dedup, decontaminating splits, stratified samples and splits, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import fill_template, format_documents


def draw_order(key: Column, seed: int) -> Column:
    """A repeatable random order: the MD5 of key and seed."""
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(seed)))


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the least ``order`` of each key (map-side combined; no window over a hot key)."""
    rest = [c for c in df.columns if c != order]
    return df.groupBy(*[F.md5(F.to_json(F.struct(*keys))).alias("_k")]).agg(F.min(F.struct(order, *rest)).alias("m")).select(*[F.col(f"m.{c}") for c in df.columns])


def drop_seen(earlier: DataFrame, later: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of ``earlier`` that share none of the columns' values with ``later``."""
    for c in columns:
        earlier = earlier.join(later.select(c).where(F.col(c).isNotNull()).distinct(), c, "left_anti").select(*earlier.columns)
    return earlier


def stratified_sample(df: DataFrame, stratum: str, key: str, size: int, seed: int = 42) -> DataFrame:
    """``size`` rows of each stratum in draw order.

    The hash's leading bits thin the strata first: rows that cannot be among the
    first ``size`` by a margin never reach the window (falling back to all rows of
    small strata), so the window sees about ``size`` rows a stratum.
    """
    keyed = df.withColumn("_o", draw_order(F.col(key), seed))
    limit = keyed.groupBy(stratum, F.substring("_o", 1, 3).alias("_b")).count()
    so_far = F.sum("count").over(Window.partitionBy(stratum).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    cells = limit.withColumn("_before", F.coalesce(so_far, F.lit(0))).where(F.col("_before") < size).select(stratum, "_b")
    near = keyed.withColumn("_b", F.substring("_o", 1, 3)).join(cells, [stratum, "_b"], "left_semi")
    return near.withColumn("_r", F.row_number().over(Window.partitionBy(stratum).orderBy("_o", key))).where(F.col("_r") <= size).drop("_r", "_o", "_b")


def stratified_split(df: DataFrame, stratum: str, key: str, shares: tuple[float, float] = (0.7, 0.1), names: tuple[str, str, str] = ("train", "dev", "test"), seed: int = 42) -> DataFrame:
    """``split`` per row: the first ``int(share * n)`` rows of a stratum in draw order, then the next, then the rest.

    Positions come from counts of hash cells, so a stratum is spread over many tasks.
    """
    counts = df.groupBy(stratum).agg(F.count("*").alias("_n"))
    placed = numbered_draws(df, stratum, key, seed).join(counts.withColumnRenamed(stratum, "_s"), F.col(stratum).eqNullSafe(F.col("_s"))).drop("_s")
    first, second = F.floor(F.col("_n") * shares[0]), F.floor(F.col("_n") * shares[1])
    split = F.when(F.col("_p") < first, names[0]).when(F.col("_p") < first + second, names[1]).otherwise(names[2])
    return placed.withColumn("split", split).drop("_n", "_p")


def flag_negatives(df: DataFrame, order: str, first: int, count: int) -> DataFrame:
    """``is_negative`` on ``count`` rows from position ``first`` in the order (a range of keys, found by a small top-k)."""
    edge = df.select(order).orderBy(order).limit(first + count)
    rows = edge.withColumn("_p", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order)) - 1).where(F.col("_p") >= first).select(order)
    return df.join(rows.withColumn("is_negative", F.lit(True)), order, "left").fillna(False, ["is_negative"])


def cluster(df: DataFrame, key: str, members: list[str], amounts: list[str]) -> DataFrame:
    """Rows of a key nested: count, sorted distinct values of ``members``, sums of ``amounts``."""
    return df.groupBy(key).agg(F.count("*").alias("n"), *[F.sort_array(F.collect_set(m)).alias(f"{m}s") for m in members], *[F.sum(a).alias(f"{a}_sum") for a in amounts])


def prompts(samples: DataFrame, template: str, context: Column, docs: Column, system: str) -> DataFrame:
    """``conversations`` per sample: system and user messages, the user's being the filled template and the documents."""
    user = F.concat(fill_template(F.lit(template), context), F.lit("\n\n"), format_documents(docs))
    return samples.withColumn("conversations", F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content"))))


def answer(selections: Column) -> Column:
    """The answer text of ``array<struct<doc_id, start_pos, end_pos, content>>``: grounded contents in order as JSON, a line each."""
    real = F.array_sort(F.filter(selections, lambda s: s["doc_id"] >= 0))
    items = F.transform(real, lambda s: F.substr(F.to_json(F.array(s["content"])), F.lit(2), F.length(F.to_json(F.array(s["content"]))) - 2))
    return F.concat(F.lit("Selected Content:\n\n"), F.when(F.size(real) > 0, F.concat(F.lit("[\n    "), F.array_join(items, ",\n    "), F.lit("\n]"))).otherwise("[]"))


def in_context_examples(queries: DataFrame, pool: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """For each query the first k pool rows in the pool's draw order other than itself.

    One row at most is skipped, so the first k + 1 of the pool serve every query: a
    broadcast of k + 1 rows.
    """
    few = pool.select(F.col(key).alias("example"), draw_order(F.col(key), seed).alias("_o")).orderBy("_o", "example").limit(k + 1)
    packed = few.agg(F.array_sort(F.collect_list(F.struct("_o", "example"))).alias("_e"))
    both = queries.join(F.broadcast(packed), F.lit(True))
    return both.withColumn("examples", F.slice(F.filter(F.transform("_e", lambda e: e["example"]), lambda e: e != F.col(key)), 1, k)).drop("_e")


def violations(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """Spans whose content is not the slice of their document."""
    both = spans.where("doc_id >= 0").join(docs.select("doc_id", "text"), "doc_id", "left")
    return both.where("text is null or not (substr(text, start_pos + 1, end_pos - start_pos) <=> content)").drop("text")


def token_cost(messages: DataFrame, key: str, n_tokens: Column, per_message: int = 3, per_conversation: int = 3) -> DataFrame:
    """Tokens of each conversation: those of its messages, three a message and three more."""
    return messages.groupBy(key).agg((F.sum(n_tokens + per_message) + per_conversation).alias("tokens"))


def restored_ok(restored: DataFrame, known: DataFrame, key: str, salt: str) -> DataFrame:
    """``(key, ok)``: whether each restored text has the salted SHA-512 digest recorded for it; a key without one is not ok."""
    both = restored.join(known, key, "left")
    return both.select(key, F.coalesce(F.sha2(F.concat(F.lit(salt), "text"), 512) == F.col("digest"), F.lit(False)).alias("ok"))


def token_totals(costs: DataFrame, total: str = "tokens") -> DataFrame:
    """Sums of ``costs(dataset, split, tokens)`` in one aggregation: ``(level, dataset, split, samples, tokens)``.

    ``level`` is ``all``, ``dataset``, ``split`` or ``both``; the rows ``both`` of the split ``test`` are each data set's test alone.
    """
    d, s = F.col("dataset"), F.col("split")
    sums = costs.groupingSets([[], [d], [s], [d, s]], d, s).agg(F.count("*").alias("samples"), F.sum(total).alias(total), F.grouping_id().alias("_g"))
    level = F.element_at(F.array(*map(F.lit, ("both", "dataset", "split", "all"))), (F.col("_g") + 1).cast("int"))
    return sums.select(level.alias("level"), "dataset", "split", "samples", total)


def id_stratum(key: Column) -> Column:
    """What stands before an id's first stop; ids without one are ``NEG``."""
    return F.when(F.contains(key, F.lit(".")), F.split(key, r"\.", 2)[0]).otherwise("NEG")


def training_share(rows: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """A share of the rows, each stratum (:func:`id_stratum`) by its part, to the row: largest remainders settle who gets the last ones.

    Of a stratum the first rows in draw order are taken; rows that repeat an id are told apart by nothing and come in any order.
    """
    named = rows.withColumn("_set", id_stratum(F.col(key)))
    sizes = named.groupBy("_set").agg(F.count("*").alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_t"))
    # A row a stratum; strata are names of data sets.
    exact = sizes.join(F.broadcast(total), F.lit(True)).withColumn("_e", F.col("_n") * F.floor(F.col("_t") * share) / F.col("_t")).withColumn("_f", F.floor("_e"))
    left = exact.agg((F.first(F.floor(F.col("_t") * share)) - F.sum("_f")).alias("_left"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.col("_e") - F.col("_f")), "_set"))
    quota = exact.withColumn("_p", place).join(F.broadcast(left), F.lit(True)).select("_set", (F.col("_f") + (F.col("_p") <= F.col("_left")).cast("int")).alias("_q"))
    return numbered_draws(named, "_set", key, seed).join(F.broadcast(quota), "_set").where("_p < _q").drop("_set", "_p", "_q")


def numbered_draws(df: DataFrame, stratum: str, key: str, seed: int) -> DataFrame:
    """``df`` with the place ``_p`` of each row in its stratum's draw order, from counts of 4,096 hash cells: no stratum lies in one task."""
    keyed = df.withColumn("_o", draw_order(F.col(key), seed)).withColumn("_b", F.substring("_o", 1, 3))
    cells = keyed.groupBy(stratum, "_b").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy(stratum).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = F.row_number().over(Window.partitionBy(stratum, "_b").orderBy("_o", key)) - 1
    placed = keyed.withColumn("_at", at).join(cells.select(F.col(stratum).alias("_s"), F.col("_b").alias("_c"), before.alias("_before")), (F.col("_b") == F.col("_c")) & F.col(stratum).eqNullSafe(F.col("_s")))
    return placed.withColumn("_p", F.col("_at") + F.col("_before")).drop("_o", "_b", "_at", "_before", "_s", "_c")


def shuffled(rows: DataFrame, key: str, seed: int = 42, partitions: int | None = None) -> DataFrame:
    """Rows in a repeatable random order over balanced partitions: ranges of the draw's hash, sorted within."""
    order = draw_order(F.col(key), seed)
    spread = rows.withColumn("_o", order)
    spread = spread.repartitionByRange(partitions, "_o", key) if partitions else spread.repartitionByRange("_o", key)
    return spread.sortWithinPartitions("_o", key).drop("_o")
