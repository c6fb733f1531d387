"""ROUGE-1, -2 and -L of whole texts, with stemming, in Arrow batches and without a shuffle.

Words are the runs of a-z and 0-9 of the lower-cased text; those of four letters and more are stemmed by Porter's algorithm
with its later amendments (a table of irregular words, endings ``ied``, ``alli``, ``fulli``, ``logi``). A batch's distinct
words are stemmed once. Words become bit sets, so the longest common subsequence costs a few big-integer operations a word
of one text, each over all words of the other.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words whose stems no rule gives.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing",
    "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
#: Porter's endings by step, with what replaces them.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"),
    ("biliti", "ble"), ("fulli", "ful"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def shape(word: str) -> str:
    """``c`` or ``v`` for each letter; a ``y`` is a vowel after a consonant."""
    out: list[str] = []
    for ch in word:
        out.append("v" if ch in "aeiou" or ch == "y" and out[-1:] == ["c"] else "c")
    return "".join(out)


def measure(stem: str) -> int:
    """How often a vowel is followed by a consonant."""
    return shape(stem).count("vc")


def short_end(stem: str) -> bool:
    """Ends in consonant, vowel and a consonant other than w, x and y, or is a vowel and a consonant."""
    s = shape(stem)
    return s == "vc" or (s.endswith("cvc") and stem[-1] not in "wxy")


def _first(word: str, endings) -> str | None:
    return next((e for e in endings if word.endswith(e)), None)


def _plural(w: str) -> str:
    if w.endswith("ies"):
        return w[:-1] if len(w) == 4 else w[:-2]
    return w[:-2] if w.endswith("sses") else w if w.endswith("ss") else w.removesuffix("s")


def _past(w: str) -> str:
    if w.endswith("ied"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("eed"):
        return w[:-1] if measure(w[:-3]) > 0 else w
    end = _first(w, ("ed", "ing"))
    if end is None or "v" not in shape(w[: -len(end)]):
        return w
    stem = w[: -len(end)]
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if len(stem) > 1 and stem[-1] == stem[-2] and shape(stem)[-1] == "c":
        return stem if stem[-1] in "lsz" else stem[:-1]
    return stem + "e" if measure(stem) == 1 and short_end(stem) else stem


def _by_table(w: str, table) -> str:
    for end, new in table:
        if w.endswith(end):
            stem = w[: -len(end)]
            return stem + new if measure(stem) > 0 else w
    return w


def _longer(w: str) -> str:
    if w.endswith("alli") and measure(w[:-4]) > 0:
        return _longer(w[:-2])
    if w.endswith("logi") and _first(w, [e for e, _ in STEP_2]) is None:
        return w[:-1] if measure(w[:-3]) > 0 else w
    return _by_table(w, STEP_2)


def _suffix(w: str) -> str:
    end = _first(w, STEP_4)
    if end is None:
        return w
    stem = w[: -len(end)]
    return stem if measure(stem) > 1 and (end != "ion" or stem[-1:] in ("s", "t")) else w


def _final(w: str) -> str:
    if w.endswith("e"):
        m = measure(w[:-1])
        if m > 1 or m == 1 and not short_end(w[:-1]):
            w = w[:-1]
    return w[:-1] if w.endswith("ll") and measure(w[:-1]) > 1 else w


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """Porter's stem of a lower-case word."""
    if word in IRREGULAR or len(word) <= 2:
        return IRREGULAR.get(word, word)
    w = _past(_plural(word))
    if w.endswith("y") and len(w) > 2 and shape(w)[-2] == "c":
        w = w[:-1] + "i"
    return _final(_suffix(_by_table(_longer(w), STEP_3)))


def words_of(text: str, stemmed: bool = True) -> list[str]:
    found = re.findall("[a-z0-9]+", text.lower())
    return [stem(w) if len(w) > 3 else w for w in found] if stemmed else found


def common_length(a: list[str], b: list[str]) -> int:
    """The length of the longest common subsequence: a row of the table is one integer, a bit a word of the shorter text."""
    if len(a) > len(b):
        a, b = b, a
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full  # a zero bit ends a step up
    for w in b:
        hit = row & at.get(w, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def _prf(hits: int, n_ref: int, n_pred: int) -> tuple[float, float, float]:
    p, r = hits / max(n_pred, 1), hits / max(n_ref, 1)
    return p, r, 2 * p * r / (p + r) if p + r > 0 else 0.0


def scores_of(ref: str, pred: str, stemmed: bool = True) -> list[float]:
    """Precision, recall and F of ROUGE-1, -2 and -L."""
    a, b = words_of(ref, stemmed), words_of(pred, stemmed)
    out: list[float] = []
    for n in (1, 2):
        x, y = (Counter(zip(*(w[k:] for k in range(n)), strict=False)) for w in (a, b))
        out += _prf((x & y).total(), x.total(), y.total())
    return [*out, *_prf(common_length(a, b), len(a), len(b))]


COLUMNS = [f"rouge{n}_{m}" for n in ("1", "2", "l") for m in ("p", "r", "f")]


def rouge(pairs: DataFrame, keys: list[str], ref: Column, pred: Column, stemmed: bool = True) -> DataFrame:
    """``(*keys, rouge1_p .. rougel_f)`` of a reference and a prediction a row; a null text has no words, and no words score 0."""

    def run(batches):
        for batch in batches:
            k = len(keys)
            rows = [scores_of(r or "", p or "", stemmed) for r, p in zip(batch.column(k).to_pylist(), batch.column(k + 1).to_pylist(), strict=True)]
            columns = [pa.array(c, pa.float64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.float64())] * len(COLUMNS)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(k)), *columns], [*keys, *COLUMNS])

    kinds = ", ".join([*(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in keys), *(f"{c} double" for c in COLUMNS)])
    return pairs.select(*keys, ref.alias("_ref"), pred.alias("_pred")).mapInArrow(run, kinds)
