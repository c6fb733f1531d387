"""Personal data (4) by weak-supervision aggregation, in DataFrame expressions only.

Base kinds (email, ip, card, phone) come from fixed patterns with validators and
stay as they are. The judged kinds (``JUDGED``: secrets, bank accounts, national
ids, phone numbers without a country code, postal addresses, names) come from loose
patterns. Six labelers vote on every candidate or abstain: its shape (regex), a
checksum or count of its digits, a gazetteer (names, streets, countries, known
samples), the words before it, what follows it, and its form. Votes are counted by
kind and pattern over the whole corpus, a table of bounded size; for each kind
expectation-maximisation on it estimates the labelers' reliabilities, and its
posteriors train the final span classifier, a logistic regression on the votes for
a span and on features that no labeler looks at. A candidate is a span if the
classifier says so and a shape, a gazetteer or a context speaks for it.

Offsets count code points, end exclusive. A match's place is the sum of the
lengths of the pieces and matches before it (``split`` and
``regexp_extract_all`` by one pattern), added up in blocks of 64 and of 64
blocks, so no user code runs and long texts take near linear time.

Null and empty texts have no spans. Rows are judged one by one, so repeated
rows agree; other columns are kept, whatever their names, unless they are named
like a kind.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import LabelModel

#: Street words of the gazetteer, the kinds in report order and their patterns. Possessive groups
#: match what the plain patterns match leftmost, without trying a run twice.
STREETS = "Street St Avenue Ave Road Rd Lane Ln Drive Dr Boulevard Blvd Court Ct Place Pl Square Way Terrace Close".split()
STREET_ENDS = "straße strasse str\\. weg platz allee gasse ufer".split()
STREET_STARTS = "rue avenue boulevard place chemin impasse calle avenida plaza paseo camino".split()
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "secret": r"(?<=(?i:password|passwd|passwort|pwd|secret|passphrase)[ \t]{0,2}[=:][ \t]{0,2}[\"']?)[^\s\"'=:,;]{6,}+"
    r"|(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{12,}+(?!@)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3}+)?(?![A-Za-z0-9])",
    "nationalid": r"(?<![0-9.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "localphone": r"(?<![0-9+.(-])(?<!\+[0-9]{1,3} )(?:\([0-9]{2,5}\) ?|0[0-9]{1,4}[ /-]|[0-9]{3}[.-])[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}+(?![0-9])",
    "address": rf"(?<![0-9\p{{L}}.,])[0-9]{{1,5}}[A-Za-z]? (?:\p{{Lu}}\p{{Ll}}++ ){{1,3}}(?:{'|'.join(STREETS)})(?!\p{{L}})"
    rf"|(?<!\p{{L}})\p{{Lu}}\p{{Ll}}*(?:{'|'.join(STREET_ENDS)}) [0-9]{{1,4}}[a-z]?(?![0-9\p{{L}}])"
    rf"|(?<![0-9\p{{L}}])[0-9]{{1,4}},? (?:{'|'.join(STREET_STARTS)}) (?:(?:de|du|des|la|le|del|los) ){{0,2}}\p{{Lu}}\p{{L}}++"
    rf"|(?i:(?<!\p{{L}})(?:{'|'.join(STREET_STARTS)})) (?:(?:de|du|des|la|le|del|los) ){{0,2}}\p{{Lu}}\p{{L}}++,? [0-9]{{1,4}}(?![0-9])",
    "name": r"(?<![\p{L}\p{N}@._-])\p{Lu}\p{Ll}++(?: \p{Lu}\p{Ll}++){1,2}(?![\p{L}\p{N}@_-])",
}
KINDS = list(PATTERNS)
BASE, JUDGED = KINDS[:4], KINDS[4:]
#: Cheap tests that a text can hold a kind at all.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][0-9 -]{11}", "phone": r"\+[0-9]", "secret": r"[0-9]|[=:]", "iban": r"[A-Z]{2}[0-9]{2}", "nationalid": r"[0-9]-[0-9]{2}-[0-9]", "localphone": r"[0-9]{2}", "address": r"[0-9]", "name": r"\p{Lu}\p{Ll}+ \p{Lu}"}
#: Word lists, contexts and shapes the labelers look for.
FIRST_NAMES = (
    "James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Christopher Lisa Daniel Nancy Matthew Betty "
    "Anthony Sandra Mark Margaret Paul Ashley Steven Emily Andrew Donna Joshua Michelle Kevin Carol Brian Amanda George Melissa Edward Deborah Peter Anna Hans Klaus Jürgen Wolfgang Ursula Monika "
    "Sabine Petra Andreas Stefan Martin Julia Heike Jean Pierre Marie Jacques Nathalie Isabelle Philippe François Sophie Luc Antoine José Juan Carlos Luis Carmen Ana Francisco Pilar Manuel Isabel Javier Miguel Elena Pablo"
).split()
COUNTRIES = "AD AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM".split()
SAMPLES = {"nationalid": ["078-05-1120", "219-09-9999", "123-45-6789"], "secret": ["changeme", "password", "xxxxxxxx"]}
BEFORE = {
    "secret": r"(?i)(?:token|secret|passw(?:or)?(?:d|t)|passphrase|pwd|api.?key|access.?key|private.?key|auth|bearer|credential)s?[^A-Za-z0-9]{0,6}$",
    "iban": r"(?i)(?:iban|account|konto|compte|cuenta|bank)[^A-Za-z0-9]{0,6}(?:n[or°.]*|number|nummer)?[^A-Za-z0-9]{0,4}$",
    "nationalid": r"(?i)(?:ssn|social security|national id|tax id|tin|passport)[^A-Za-z0-9]{0,6}(?:n[or°.]*|number)?[^A-Za-z0-9]{0,4}$",
    "localphone": r"(?i)(?:tel|telephone|telefon|téléphone|teléfono|phone|call|fax|mobile|mobil|handy|móvil|portable)[^A-Za-z0-9]{0,6}(?:at|us|number|nummer)?[^A-Za-z0-9]{0,4}$",
    "address": r"(?i)(?:address|lives? (?:at|in)|adresse|dirección|domicile|anschrift|wohnt)[^\p{L}0-9]{0,4}$",
    "name": r"(?:\b(?:Mr|Mrs|Ms|Dr|Prof|Sir|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra)\.? |(?i:\b(?:name|contact|nombre|nom)(?: is|:) ?))$",
}
AFTER = {"secret": r"^[\"']", "iban": r"^\s*(?:BIC|\()", "nationalid": "^(?!)", "localphone": r"(?i)^,? ?(?:ext|x[0-9])", "address": r"^,? (?:[0-9]{4,5}\b|[A-Z]{2}\b|[A-Z]{1,2}[0-9])", "name": r"^(?:,? born|'s |, [0-9]{2},| <| \()"}
AGAINST_AFTER = {"name": r"^(?: [a-z]+ing\b)"}
IN_ADDRESS = r"(?i)(?:https?:|www\.|\.[a-z]{2,6}/)\S*$"
KNOWN_SHAPES = r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]+|AIza[A-Za-z0-9_-]{30,}|[0-9a-f]{32,})$"
LABELERS = ("shape", "check", "list", "before", "after", "form")
#: Votes for a span, and what no labeler looks at.
FEATURES = ("by_shape", "by_check", "by_list", "by_before", "quoted", "line_start", "assigned", "ends_clause", "hex", "upper", "many_digits", "spaced")
START = [[0.50, 0.35, 0.15], [0.08, 0.32, 0.60]]
#: Matches are placed in blocks of so many.
BLOCK = 64


def _valid(kind: str) -> str:
    digits = "regexp_replace(m, '[^0-9]', '')"
    if kind == "ip":
        return r"forall(split(m, '\\.'), o -> coalesce(try_cast(o as bigint), 999L) <= 255)"
    if kind == "card":
        digit = f"cast(substr(reverse({digits}), i, 1) as int)"
        return f"aggregate(sequence(1, length({digits})), 0, (a, i) -> a + case when i % 2 = 1 then {digit} when {digit} > 4 then 2 * {digit} - 9 else 2 * {digit} end) % 10 = 0"
    if kind == "phone":
        return f"length({digits}) between 9 and 15"
    return "true"


def spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the text and without columns named like a kind, plus a column per kind:
    ``array<struct<s, e, m, before, after>>`` of valid matches."""
    taken = {k.lower() for k in KINDS} | {text_col.lower()}
    rest = [c for c in docs.columns if c.lower() not in taken]
    row = [F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row")] if rest else []
    carried = [r.alias("row") for r in ([F.col("row")] if rest else [])]
    none = F.array().cast("array<string>")
    out = docs.select(*row, F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    matches = [F.when(F.col("t").rlike(HINTS[k]), F.regexp_extract_all("t", F.lit(p), F.lit(0))).otherwise(none).alias(f"m_{k}") for k, p in PATTERNS.items()]
    out = out.select(*carried, "t", *matches)
    # Only texts with a match are cut into the pieces between.
    out = out.select(*carried, *[f"m_{k}" for k in KINDS], *[F.when(F.size(f"m_{k}") > 0, F.split("t", p, -1)).otherwise(none).alias(f"p_{k}") for k, p in PATTERNS.items()])
    # What lies between the start of a match and of the one before, and its sums by block and by block of blocks.
    way = "transform(m_{k}, (m, i) -> length(p_{k}[i]) + case when i > 0 then length(m_{k}[i - 1]) else 0 end)"
    out = out.select("*", *[F.expr(way.format(k=k)).alias(f"w_{k}") for k in KINDS])
    level = "case when size({c}_{k}) > 0 then transform(sequence(0, (size({c}_{k}) - 1) div {n}), b -> aggregate(slice({c}_{k}, b * {n} + 1, {n}), 0L, (a, x) -> a + x)) else array() end"
    out = out.select("*", *[F.expr(level.format(c="w", k=k, n=BLOCK)).cast("array<bigint>").alias(f"b_{k}") for k in KINDS])
    out = out.select("*", *[F.expr(level.format(c="b", k=k, n=BLOCK)).cast("array<bigint>").alias(f"c_{k}") for k in KINDS])
    columns = []
    for k in KINDS:
        part = lambda c, lo, n: f"aggregate(slice({c}_{k}, {lo} + 1, {n}), 0L, (a, x) -> a + x)"  # noqa: E731, B023
        start = " + ".join([part("c", "0", f"i div {BLOCK * BLOCK}"), part("b", f"(i div {BLOCK * BLOCK}) * {BLOCK}", f"(i div {BLOCK}) % {BLOCK}"), part("w", f"(i div {BLOCK}) * {BLOCK}", f"i % {BLOCK} + 1")])
        made = f"transform(m_{k}, (m, i) -> named_struct('s', {start}, 'm', m, 'before', right(p_{k}[i], 24), 'after', left(p_{k}[i + 1], 24)))"
        made = f"case when size(w_{k}) + size(b_{k}) + size(c_{k}) + size(p_{k}) > 0 then {made} else array() end"  # a second use keeps the arrays out of the lambda
        placed = f"transform({made}, x -> named_struct('s', x.s, 'e', x.s + length(x.m), 'm', x.m, 'before', x.before, 'after', x.after))"
        columns.append(F.expr(f"filter({placed}, x -> {_valid(k).replace('(m,', '(x.m,')})").alias(k))
    return out.select(*[F.col("row").getField(c).alias(c) for c in rest], *columns)


def _digits(m: Column) -> Column:
    return F.length(F.regexp_replace(m, F.lit("[^0-9]"), F.lit("")))


def _iban_ok(m: Column) -> Column:
    """ISO 7064: the rearranged number, letters as 10 to 35, leaves 1 by 97."""
    plain = F.regexp_replace(m, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4)))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(turned, "(?<=.)(?=.)"), F.lit(0).cast("long"), lambda a, c: (a * F.when(c.between("0", "9"), 10).otherwise(100) + value(c)) % 97) == 1


def _votes(kind: str, m: Column, before: Column, after: Column) -> dict[str, Column]:
    """Each labeler's vote on a candidate: 1, 0 or null."""
    first = F.substring_index(m, " ", 1)
    last = F.substring_index(m, " ", -1)
    digits = _digits(m)
    said = F.when(before.rlike(BEFORE[kind]), 1)
    followed = F.when(after.rlike(AFTER[kind]), 1)
    if kind == "secret":
        return {
            "shape": F.when(m.rlike(KNOWN_SHAPES), 1),
            "check": F.when((10 * digits >= F.length(m)) & (10 * digits <= 9 * F.length(m)), 1).otherwise(0),
            "list": F.when(F.lower(m).isin(SAMPLES["secret"]) | m.rlike("^[0-9]{1,4}(?:[-/][0-9]{1,4}){2}"), 0),
            "before": F.coalesce(said, F.lit(0)),
            "after": F.when(before.rlike(IN_ADDRESS), 0).otherwise(followed),
            "form": F.when(F.length(m) >= 20, 1).when(F.length(m) < 16, 0),
        }
    if kind == "iban":
        return {"shape": F.when(m.rlike("^[A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4})+(?: [A-Z0-9]{1,3})?$"), 1), "check": F.when(_iban_ok(m), 1).otherwise(0), "list": F.when(F.left(m, F.lit(2)).isin(COUNTRIES), 1).otherwise(0), "before": said, "after": followed, "form": F.when(F.length(F.regexp_replace(m, " ", "")).between(15, 34), F.when(digits >= 10, 1)).otherwise(0)}
    if kind == "nationalid":
        return {"shape": F.when(m.rlike("^9"), 0), "check": F.when(m.rlike("^(?:000|666|9)|-00-|-0000$"), 0).otherwise(1), "list": F.when(m.isin(SAMPLES["nationalid"]), 0), "before": F.coalesce(said, F.lit(0)), "after": followed, "form": F.when(after.rlike("^[%€$]|^ ?(?:pages?|pp|units)"), 0)}
    if kind == "localphone":
        return {"shape": F.when(m.rlike(r"^\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}$"), 1), "check": F.when(digits.between(9, 13), 1).otherwise(0), "list": F.when(m.rlike(r"^(?:19|20)[0-9]{2}[.-]|\b(?:19|20)[0-9]{2}$"), 0), "before": F.coalesce(said, F.lit(0)), "after": followed, "form": F.when(m.rlike(r"^[0-9]{3}\.[0-9]+\.|^[0-9.]+$"), 0)}
    if kind == "address":
        return {"shape": F.when(m.rlike(r"^[0-9]{1,5}[A-Za-z]? \p{Lu}|^\p{Lu}\p{Ll}{3,}"), 1).otherwise(0), "check": F.when(digits <= 5, 1).otherwise(0), "list": F.when(last.isin(STREETS) | F.lower(m).rlike("|".join(STREET_ENDS) + "|" + "|".join(rf"\b{w}\b" for w in STREET_STARTS)), 1), "before": said, "after": followed, "form": F.when(m.rlike("^0|(?:1[89]|20)[0-9]{2} "), 0)}
    return {
        "shape": F.when(m.rlike(r"\b\p{Lu}\p{Ll}?\b"), 0),
        "check": F.when(F.length(last) >= 4, 1).when(F.length(last) < 3, 0),
        "list": F.when(first.isin(FIRST_NAMES), 1).otherwise(0),
        "before": said,
        "after": F.when(after.rlike(AGAINST_AFTER["name"]), 0).otherwise(followed),
        "form": F.when(said.isNull() & before.rlike(r"(?:^|[.!?\n]\s*)$"), 0),
    }


def _features(v: dict[str, Column], m: Column, before: Column, after: Column) -> dict[str, Column]:
    yes = lambda k: F.coalesce(v[k] == 1, F.lit(False))
    upper = F.length(F.regexp_replace(m, F.lit("[^\\p{Lu}]"), F.lit("")))
    return {
        "by_shape": yes("shape"),
        "by_check": yes("check"),
        "by_list": yes("list"),
        "by_before": yes("before"),
        "quoted": before.rlike("[\"'«“]$"),
        "line_start": before.rlike("(?:^|\\n)[ \\t]*$"),
        "assigned": before.rlike("[=:]\\s*[\"']?$"),
        "ends_clause": after.rlike("^[.,;!?]?(?:\\s|$)"),
        "hex": m.rlike("^[0-9a-f]+$"),
        "upper": 3 * upper >= F.length(m),
        "many_digits": 2 * _digits(m) >= F.length(m),
        "spaced": F.instr(m, " ") > 0,
    }


def _parts(x: Column, kind: str) -> tuple[dict[str, Column], dict[str, Column]]:
    v = _votes(kind, x["m"], x["before"], x["after"])
    return v, _features(v, x["m"], x["before"], x["after"])


def candidate_signs(found: DataFrame, kind: str) -> DataFrame:
    """One row per candidate with its votes (0 against, 1 abstains, 2 for) and features."""
    each = found.select(F.explode(kind).alias("x"))
    v, s = _parts(F.col("x"), kind)
    return each.select(F.lit(kind).alias("kind"), *[F.coalesce(2 * v[k], F.lit(1)).cast("int").alias(f"v_{k}") for k in LABELERS], *[s[f].cast("int").alias(f"f_{f}") for f in FEATURES])


def train_classifier(rows: list, rounds: int = 40, penalty: float = 0.05) -> tuple[list[float], float]:
    """Weights and bias of a kind's span classifier, from the label model's posteriors on the corpus-wide pattern counts (Newton's method, L2)."""
    model = LabelModel(len(LABELERS), prior=0.5, start=START, bounds=(0.02, 0.98))
    votes = [([int(r[f"v_{k}"]) for k in LABELERS], int(r["count"])) for r in rows]
    model.fit(votes)
    if not rows:
        return [0.0] * len(FEATURES), -1.0
    y, n = np.array([model.posterior(v) for v, _ in votes]), np.array([c for _, c in votes], dtype=float)
    x = np.array([[1.0, *(r[f"f_{f}"] for f in FEATURES)] for r in rows])
    w, ridge = np.zeros(x.shape[1]), penalty * np.eye(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge
        step = np.clip(np.linalg.solve(hessian, x.T @ (n * (y - p)) - penalty * w), -4, 4)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return [round(float(v), 9) for v in w[1:]], round(float(w[0]), 9)


def train_classifiers(found: DataFrame) -> dict[str, tuple[list[float], float]]:
    """A classifier for each judged kind."""
    columns = ["kind"] + [f"v_{k}" for k in LABELERS] + [f"f_{f}" for f in FEATURES]
    signs = None
    for k in JUDGED:
        each = candidate_signs(found, k)
        signs = each if signs is None else signs.unionByName(each)
    rows = signs.groupBy(*columns).count().orderBy(*columns).collect()  # bounded: 3^6 votes x 2^8 other features for a kind
    return {k: train_classifier([r for r in rows if r["kind"] == k]) for k in JUDGED}


def find_pii(docs: DataFrame, text_col: str = "text", threshold: float = 0.5, save=None) -> DataFrame:
    """``docs`` without the text, plus a column of spans ``array<struct<s, e, m, before, after>>`` per kind; the judged kinds as classified.

    ``save`` writes the candidates once (they are read for training and for the verdict).
    """
    found = spans(docs, text_col)
    found = save(found) if save else found
    models = train_classifiers(found)

    def chosen(kind: str):
        weights, bias = models[kind]

        def test(x: Column) -> Column:
            v, signs = _parts(x, kind)
            score = F.lit(bias)
            for f, w in zip(FEATURES, weights, strict=True):
                score = score + F.when(signs[f], w).otherwise(0.0)
            spoken = signs["by_shape"] | signs["by_list"] | signs["by_before"]
            if kind == "iban":
                spoken = signs["by_check"] & signs["by_list"] | signs["by_before"]
            return spoken & (score >= math.log(threshold / (1 - threshold)))

        return test

    return found.select(*[c for c in found.columns if c not in JUDGED], *[F.filter(k, chosen(k)).alias(k) for k in JUDGED])


def listed(kinds: list[str]) -> Column:
    """``kind:start:end`` of all spans by kind, then start, joined by commas."""
    each = [F.expr(f"transform({k}, x -> concat_ws(':', '{k}', x.s, x.e))") for k in kinds]
    return F.array_join(F.concat(*each), ",")
