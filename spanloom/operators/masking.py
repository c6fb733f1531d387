"""Training labels of conversations: token ids with everything outside of the assistant's turns masked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import let

#: Fixed value: the label of a token that does not count.
IGNORE = -100
#: Marks around a turn, by kind of template: opening, after the role, closing (the separator).
MARKS = {"im": ("<|im_start|>", "\n", "<|im_end|>"), "header": ("<|start_header_id|>", "<|end_header_id|>\n\n", "<|eot_id|>"), "turn": ("<start_of_turn>", "\n", "<end_of_turn>")}


def token_id(token: Column) -> Column:
    """A portable id: the first 28 bits of the token's MD5."""
    return F.conv(F.substring(F.md5(token), 1, 7), 16, 10).cast("int")


def tokens_of(text: Column, marks: tuple[str, str, str]) -> Column:
    """Marks whole, runs of letters, marks, digits and underscore, other single signs."""
    quoted = "|".join(r"\Q" + m.strip() + r"\E" for m in marks if m.strip())
    return F.regexp_extract_all(text, F.lit(rf"{quoted}|[\p{{L}}\p{{M}}\p{{N}}_]+|[^\p{{L}}\p{{M}}\p{{N}}_\s\p{{Z}}]"), F.lit(0))


def turns_of(conversations: DataFrame, keys: list[str], system: str = "keep", turn: str = "turn") -> DataFrame:
    """``(*keys, turns array<struct<role, text>>)`` in order; ``system`` is ``keep``, ``drop`` the first turn, or ``merge`` it into the second."""
    listed = conversations.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(turn, "role", F.coalesce("text", F.lit("")).alias("text")))).alias("_t"))
    turns = F.transform("_t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    rest = let(turns, lambda t: F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0))))
    if system == "drop":
        turns = rest
    elif system == "merge":
        second = F.concat(F.element_at("_t", 1)["text"], F.lit("\n\n"))
        turns = F.transform(rest, lambda t, i: F.struct(t["role"].alias("role"), F.when(i == 0, F.concat(second, t["text"])).otherwise(t["text"]).alias("text")))
    elif system != "keep":
        raise ValueError(f"unknown way with the first turn: {system}")
    return listed.select(*keys, turns.alias("turns"))


def chat_ids(turns: Column, marks: tuple[str, str, str]) -> Column:
    """The token ids of a conversation set in a template."""
    opening, named, closing = (F.lit(m) for m in marks)
    text = F.array_join(F.transform(turns, lambda t: F.concat(opening, t["role"], named, t["text"], closing, F.lit("\n"))), "")
    return F.transform(tokens_of(text, marks), token_id)


def places_of(ids: Column, run: list[int]) -> Column:
    """Where a run of ids begins, 0-based."""
    want, n = F.array(*[F.lit(x).cast("int") for x in run]), len(run)
    starts = F.when(F.size(ids) >= n, F.sequence(F.lit(0), F.size(ids) - n)).otherwise(F.array().cast("array<int>"))
    return F.filter(starts, lambda i: (F.get(ids, i) == F.lit(run[0])) & ((F.slice(ids, i + 1, F.lit(n)) == want) if n > 1 else F.lit(True)))


def mask_labels(samples: DataFrame, separator: list[int], seq_length: int, ids: str = "input_ids", roles: str = "roles", trained: str = "assistant", pad_id: int | None = None, mask_tail: bool = False) -> DataFrame:
    """``samples`` with ids cut to ``seq_length``, ``labels``, ``attention_mask`` and ``too_long``.

    The separator (its occurrences must not overlap) that ends turn k belongs to that turn and also begins turn k + 1: it is
    masked if either is masked. Turns of other roles than ``trained`` are masked if their separator survived the cut; what
    follows the last separator keeps its ids as labels, as do the ids of a cut-off turn, unless ``mask_tail``. A sample with
    fewer separators than roles is ``too_long``; one with more is an error. Attention is off where a label is ``pad_id``.
    """
    size = len(separator)
    none = F.array().cast("array<int>")

    def fill(x: Column, masked: Column) -> Column:
        return F.when(masked, F.transform(x, lambda _: F.lit(IGNORE))).otherwise(x)

    def labels(x: Column, ends: Column) -> Column:
        other = lambda k: F.coalesce(F.get(F.col(roles), k) != trained, F.lit(False))

        def turn(end: Column, k: Column) -> Column:
            start = F.when(k == 0, 0).otherwise(F.get(ends, k - 1) + size)
            body, mark = F.slice(x, start + 1, end - start), F.slice(x, end + 1, F.lit(size))
            return F.concat(fill(body, other(k)), fill(mark, other(k) | ((k + 1 < F.size(ends)) & other(k + 1))))

        begun = F.when(F.size(ends) > 0, F.element_at(ends, -1) + size).otherwise(0)
        tail = F.slice(x, begun + 1, F.greatest(F.size(x) - begun, F.lit(0)))
        unfinished = F.lit(mask_tail) & (F.size(ends) < F.size(roles)) & other(F.size(ends))
        return F.concat(F.flatten(F.transform(ends, turn)), fill(tail, unfinished))

    cut = F.coalesce(F.slice(F.col(ids), F.lit(1), F.lit(seq_length)), none)
    found = samples.withColumn(ids, cut).withColumn("_ends", places_of(F.col(ids), separator))
    right = F.when(F.size("_ends") > F.size(roles), F.raise_error(F.lit("more separators than turns")).cast("array<int>")).otherwise(labels(F.col(ids), F.col("_ends")))
    out = found.withColumn("labels", right).withColumn("too_long", F.size("_ends") < F.size(roles))
    attended = (lambda y: y != pad_id) if pad_id is not None else (lambda _: F.lit(True))
    return out.withColumn("attention_mask", F.transform("labels", attended)).drop("_ends")


def conversation_labels(conversations: DataFrame, keys: list[str], kind: str = "im", seq_length: int = 4096, system: str = "keep", mask_tail: bool = False) -> DataFrame:
    """Rows of turns to masked token ids: ``(*keys, roles, input_ids, labels, attention_mask, too_long)``."""
    import hashlib

    marks = MARKS[kind]
    separator = [int(hashlib.md5(marks[2].encode()).hexdigest()[:7], 16)]
    listed = turns_of(conversations, keys, system)
    samples = listed.select(*keys, F.transform("turns", lambda t: t["role"]).alias("roles"), chat_ids(F.col("turns"), marks).alias("input_ids"))
    return mask_labels(samples, separator, seq_length, mask_tail=mask_tail)
