"""Quality rules (3) as weak supervision, in DataFrame expressions only.

Rules vote good (1), bad (0) or abstain (null). Their votes are counted by
pattern, at most 3^7 rows whatever the corpus, and expectation-maximisation on
those counts estimates each rule's vote rates among good and among bad texts
and the share of good texts. A text is kept if its posterior probability of
being good reaches ``threshold``; the estimated model, not an all-must-pass
conjunction, decides. The base rules of the contract come on top.

A null text has no words, an empty or blank one neither; they fail the base.
Words are runs outside space and 0x09-0x0D. Rows are judged one by one, so
repeated rows agree; extra columns are kept, whatever their names, unless they are
named like a result.
On an empty table nothing is estimated and the result is empty.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "[ \\t\\n\\x0B\\f\\r]+"
BLANKS = " \t\n\x0b\x0c\r"
RULES = ("length", "word_size", "symbols", "lines", "repeats", "capitals", "prose")
#: Frequent function words of the languages at hand.
FUNCTION_WORDS = (
    "the of and to in is that it on for was be with as by this are at from or an not "
    "der die das und ist mit ein eine von im den zu auf sich des für dem "
    "le la les de des et est un une du en que qui dans pour sur pas au par avec "
    "el los las del y por con para una se no lo su al es"
).split()


def words_of(text: Column) -> Column:
    """The words of a text, an empty array without any."""
    trimmed = F.expr(f"trim(BOTH ' \\t\\n\\u000B\\f\\r' FROM coalesce({text}, ''))") if isinstance(text, str) else F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, SPACE)).otherwise(F.array().cast("array<string>"))


def _covered(positions: Column) -> Column:
    """How many words windows of three at these positions cover."""
    return F.size(F.array_distinct(F.flatten(F.transform(positions, lambda p: F.array(p, p + 1, p + 2)))))


def signals(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without the text, with the counts that rules and base rules read."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    full = docs.withColumn("_w", words_of(F.col(text_col)))
    rest = [c for c in docs.columns if c != text_col]
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    marked = F.lit("[#*$%&|<>]+")
    full = full.select(
        *rest,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, marked, F.lit("")))).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        F.length(F.regexp_replace(text, F.lit("[^\\p{Lu}]+"), F.lit(""))).cast("long").alias("n_capitals"),
        F.size(F.filter("_w", lambda x: F.lower(x).isin(FUNCTION_WORDS))).cast("long").alias("n_function_words"),
        F.transform("_w", lambda x: F.xxhash64(x)).alias("_h"),
    )
    full = full.select(
        *rest, "n_words", "word_chars", "n_symbols", "n_capitals", "n_function_words",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("n_words") >= 3, F.expr("transform(sequence(0, size(_h) - 3), i -> xxhash64(_h[i], _h[i + 1], _h[i + 2]))")).otherwise(F.array().cast("array<bigint>")).alias("_t"),
    )
    full = full.withColumn("_repeats", F.size("_t") > F.size(F.array_distinct("_t")))
    full = full.withColumn("_sorted", F.when(F.col("_repeats"), F.sort_array("_t")).otherwise(F.array().cast("array<bigint>")))
    full = full.withColumn("_twice", F.expr("array_distinct(filter(_sorted, (x, i) -> i > 0 and x = _sorted[i - 1]))"))
    few = F.expr("filter(sequence(0, size(_t) - 1), i -> array_contains(_twice, _t[i]))")
    ordered = F.sort_array(F.expr("transform(_t, (x, i) -> struct(x as h, i as p))"))
    full = full.withColumn("_pairs", F.when(F.size("_twice") > 24, ordered))
    many = F.expr("transform(filter(_pairs, (x, i) -> (i > 0 and x.h = _pairs[i - 1].h) or (i < size(_pairs) - 1 and x.h = _pairs[i + 1].h)), x -> x.p)")
    count = F.when(~F.col("_repeats"), F.lit(0)).when(F.size("_twice") > 24, _covered(many)).otherwise(_covered(few))
    return full.withColumn("n_repeat_words", count.cast("long")).drop("_t", "_repeats", "_sorted", "_twice", "_pairs")


def votes() -> dict[str, Column]:
    """Each rule's vote from the signals: 1 good, 0 bad, null abstains."""
    n, size = F.col("n_words"), F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))
    vote = lambda bad, good: F.when(bad, 0).when(good, 1)
    return {
        "length": vote(n < 50, n >= 80),
        "word_size": vote((size < 2.5) | (size > 12), size.between(3.5, 8)),
        "symbols": vote(10 * F.col("n_symbols") > n, 100 * F.col("n_symbols") <= n),
        "lines": vote(10 * F.col("n_dup_lines") > 3 * F.col("n_lines"), F.col("n_dup_lines") == 0),
        "repeats": vote(100 * F.col("n_repeat_words") > 30 * n, 100 * F.col("n_repeat_words") <= 15 * n),
        "capitals": vote(10 * F.col("n_capitals") > 3 * F.col("word_chars"), 10 * F.col("n_capitals") <= F.col("word_chars")),
        "prose": vote(100 * F.col("n_function_words") < 2 * n, 100 * F.col("n_function_words") >= 8 * n),
    }


class LabelModel:
    """Two classes, independent rules, three outcomes each; fitted by expectation-maximisation on pattern counts."""

    def __init__(self, rules: int, prior: float = 0.8, start=((0.35, 0.25, 0.40), (0.04, 0.12, 0.84)), bounds: tuple[float, float] = (0.5, 0.98)):
        self.prior, self.bounds = prior, bounds
        self.rates = [[list(c) for c in start] for _ in range(rules)]  # [rule][class][bad, abstains, good]

    def posterior(self, pattern: list[int]) -> float:
        """Probability of good for votes coded 0 bad, 1 abstains, 2 good."""
        logs = [math.log(1 - self.prior), math.log(self.prior)]
        for j, v in enumerate(pattern):
            for c in (0, 1):
                logs[c] += math.log(self.rates[j][c][v])
        return 1 / (1 + math.exp(min(700, logs[0] - logs[1])))

    def fit(self, counts: list[tuple[list[int], int]], rounds: int = 50, weight: float = 4.0) -> LabelModel:
        start = [[list(c) for c in rule] for rule in self.rates]
        total = sum(n for _, n in counts)
        if not total:
            return self
        for _ in range(rounds):
            good = [n * self.posterior(p) for p, n in counts]
            sums = [[[weight * x for x in start[j][c]] for c in (0, 1)] for j in range(len(start))]
            for (p, n), g in zip(counts, good, strict=True):
                for j, v in enumerate(p):
                    sums[j][0][v] += n - g
                    sums[j][1][v] += g
            self.rates = [[[x / sum(c) for x in c] for c in rule] for rule in sums]
            for rule in self.rates:  # a rule is never worse than chance: bad votes are no commoner among good texts
                if rule[1][0] > rule[0][0]:
                    rule[0], rule[1] = [list(rule[1]) for _ in (0, 1)]
            self.prior = min(self.bounds[1], max(self.bounds[0], sum(good) / total))
        return self


def label_model(judged: DataFrame) -> LabelModel:
    """The model estimated over all rows of ``judged`` (columns vote_<rule>)."""
    coded = [F.coalesce(F.col(f"vote_{r}") * 2, F.lit(1)).alias(r) for r in RULES]
    counts = judged.select(*coded).groupBy(*RULES).count().collect()  # 3^7 rows at most
    return LabelModel(len(RULES)).fit(sorted(([int(r[x]) for x in RULES], int(r["count"])) for r in counts))


def posterior(model: LabelModel) -> Column:
    """The posterior probability of good, as an expression on the vote columns."""
    score = F.lit(math.log(model.prior) - math.log(1 - model.prior))
    for j, r in enumerate(RULES):
        gain = [math.log(model.rates[j][1][v]) - math.log(model.rates[j][0][v]) for v in range(3)]
        v = F.col(f"vote_{r}")
        score = score + F.when(v.isNull(), gain[1]).when(v == 1, gain[2]).otherwise(gain[0])
    return 1 / (1 + F.exp(-score))


#: Names of the columns that judge adds.
ADDED = ("n_words", "word_chars", "n_symbols", "n_capitals", "n_function_words", "n_lines", "n_dup_lines", "n_repeat_words", *(f"vote_{r}" for r in RULES), "p_good", "base_failed", "kept")


def judge(docs: DataFrame, text_col: str = "text", threshold: float = 0.5, save=None) -> DataFrame:
    """``docs`` without its text and without columns named like ``ADDED``, with signals, votes, ``p_good``, ``base_failed`` and ``kept``.

    ``save`` writes the signals once (they are read for the model and for the verdict).
    """
    rest = [c for c in docs.columns if c.lower() not in {text_col.lower(), *ADDED}]
    packed = docs.select(F.struct(F.lit(0).alias("_"), *[F.struct(F.col(f"`{c}`").alias("v")).alias(f"c{j}") for j, c in enumerate(rest)]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    seen = signals(packed, "text")
    seen = seen.select("*", *[v.cast("int").alias(f"vote_{r}") for r, v in votes().items()])
    seen = save(seen) if save else seen
    model = label_model(seen)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = seen.withColumn("p_good", posterior(model)).withColumn("base_failed", base)
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))
    return out.select(*[F.col(f"row.c{j}.v").alias(c) for j, c in enumerate(rest)], *ADDED)


def keep_good(docs: DataFrame, save, text_col: str = "text", threshold: float = 0.5, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, all columns as they are.

    ``save`` writes the votes once, without texts; rows go by id and the text's 64-bit
    fingerprint, on which the verdict depends, so null and repeated ids are told apart.
    """
    name = F.xxhash64(F.col(text_col))
    seen = docs.select(F.col(id_col).alias("_id"), name.alias("_name"), F.col(text_col).alias("_text"))
    bad = judge(seen, "_text", threshold, save).where(~F.col("kept")).select("_id", "_name").distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(bad["_id"]) & (name == bad["_name"]), "left_anti")
