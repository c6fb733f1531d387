"""Column functions over text: normalising, tokenising, cleaning and parsing of small formats.

Offsets are 0-based code points, ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .distributions import let

#: Pieces of a text: runs of letters, marks, digits and underscore; single other signs; runs of white space.
PIECES = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s\p{Z}]|[\s\p{Z}]+"
_EDGES = r"(?U)^\s+|\s+$"
#: What a completion may put before its answer.
PREAMBLES = ("assistant\n\nSelected Content:", "Selected Content:")


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, _EDGES, "")


def normalize(c: Column) -> Column:
    """Lower case, every white-space character a space; the length stays."""
    return F.regexp_replace(F.lower(c), r"(?U)\s", " ")


def token_count(text: Column) -> Column:
    """How many tokens a text has."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s\p{Z}]"))


def normalize_answer(c: Column) -> Column:
    """Lower case without ASCII punctuation, articles (between signs that are no letter, digit or underscore) and surplus white space."""
    plain = F.regexp_replace(F.lower(c), r"[!-/:-@\[-`{-~]", "")
    bare = F.regexp_replace(plain, r"(?<![\p{L}\p{N}_])(?:a|an|the)(?![\p{L}\p{N}_])", " ")
    return F.array_join(F.filter(F.split(bare, r"(?U)\s+"), lambda w: w != ""), " ")


def remove_preamble(c: Column) -> Column:
    for p in PREAMBLES:
        c = F.when(c.startswith(p), strip(F.substr(c, F.lit(len(p) + 1)))).otherwise(c)
    return c


def crop_fence(c: Column) -> Column:
    """What stands inside a text's only code fence, if the text ends with it; else the stripped text."""
    opener = r"(?m)^\s*```\w*\s"
    inside = lambda s: F.regexp_extract(s, r"(?s)(?m:^\s*```\w*\s)(.*)```$", 1)
    return let(strip(c), lambda s: F.when(s.endswith("```") & (F.regexp_count(s, F.lit(opener)) == 1) & F.rlike(s, F.lit(r"(?s)(?m:^\s*```\w*\s)(.*)```$")), strip(inside(s))).otherwise(s))


def parse_list(c: Column) -> Column:
    """A JSON array of strings, null if it is none."""
    return F.from_json(c, "array<string>", {"allowUnquotedControlChars": "true"})


def parse_selection(c: Column) -> Column:
    """The spans of a completion: preamble and fence off, then the array; null if unparsable (not the empty array)."""
    return parse_list(strip(crop_fence(remove_preamble(c))))


def parse_lenient(c: Column) -> Column:
    """Like :func:`parse_selection`, then between the outer brackets, then with a closing ``]`` or ``"]``."""
    inner = F.regexp_extract(c, r"(?s)(\[.*\])", 1)
    closed = F.when(strip(c).endswith('"'), F.concat(strip(c), F.lit("]"))).otherwise(F.concat(strip(c), F.lit('"]')))
    return F.coalesce(parse_selection(c), parse_list(inner), parse_list(remove_preamble(closed)))


def clean_text(c: Column) -> Column:
    """Fences, one closing colon or stop, and enclosing quotes off; then once more a stop and fences."""

    def inside(c: Column, mark: str) -> Column:
        n = len(mark)
        return F.when(c.startswith(mark) & c.endswith(mark), strip(F.substr(c, F.lit(n + 1), F.greatest(F.length(c) - 2 * n, F.lit(0))))).otherwise(c)

    c = inside(strip(c), "```")
    c = F.when(c.endswith(":") | c.endswith("."), strip(F.substr(c, F.lit(1), F.length(c) - 1))).otherwise(c)
    c = inside(inside(c, '"'), "'")
    c = F.when(c.endswith("."), strip(F.substr(c, F.lit(1), F.length(c) - 1))).otherwise(c)
    return inside(c, "```")


def error_share(parsed: Column) -> Column:
    """1 for null, 0 for an empty list, else the share of null entries."""
    return F.when(parsed.isNull(), 1.0).when(F.size(parsed) == 0, 0.0).otherwise(F.size(F.filter(parsed, lambda x: x.isNull())) / F.size(parsed))


def parse_guid(c: Column) -> Column:
    """``dataset.split.id`` with a URL-encoded id, as a struct; a plus sign stays one."""
    parts = F.split(c, r"\.", 3)
    return F.struct(parts[0].alias("dataset"), parts[1].alias("split"), F.url_decode(F.replace(parts[2], F.lit("+"), F.lit("%2B"))).alias("id"))


def parse_offsets(c: Column) -> Column:
    """``s,e;s,e`` as ``array<struct<start_pos, end_pos>>``."""
    return F.transform(F.split(c, ";"), lambda x: F.struct(F.split(x, ",")[0].cast("int").alias("start_pos"), F.split(x, ",")[1].cast("int").alias("end_pos")))


def document_number(name: Column) -> Column:
    """The number of a file ``0.txt`` to ``5.txt``, else null."""
    return F.when(name.rlike(r"^[0-5]\.txt$"), F.substr(name, F.lit(1), F.lit(1)).cast("int"))


def split_addresses(c: Column) -> Column:
    """The distinct addresses of a comma-separated header, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(c, ","), strip), lambda x: x != ""))


def choose_wording(c: Column, is_code: Column) -> Column:
    """``{a|b}`` becomes a for code and b for prose."""
    pattern = r"\{([\w -]+)\|([\w -]+)\}"
    return F.when(is_code, F.regexp_replace(c, pattern, "$1")).otherwise(F.regexp_replace(c, pattern, "$2"))


def prediction_file(model: Column, dataset: Column) -> Column:
    """The file name of a model's predictions; slashes become underscores."""
    return F.concat(F.lit("test-"), dataset, F.lit("-"), F.replace(model, F.lit("/"), F.lit("_")), F.lit(".jsonl.gz"))


def fill_template(template: Column, context: Column) -> Column:
    """``{key}`` replaced from a map, key by key."""
    return F.aggregate(F.map_entries(context), template, lambda t, e: F.replace(t, F.concat(F.lit("{"), e["key"], F.lit("}")), F.coalesce(e["value"], F.lit(""))))


def format_documents(docs: Column, kind: str = "Document") -> Column:
    """``Document #id:`` blocks of ``array<struct<id, text>>``."""
    return F.array_join(F.transform(docs, lambda d: F.concat(F.lit(f"{kind} #"), d["id"].cast("string"), F.lit(":\n"), strip(d["text"]), F.lit("\n\n"))), "")


def sentence_bounds(chunk_ends: Column) -> Column:
    """``array<struct<start_pos, end_pos>>`` from cumulative sentence ends."""
    return F.transform(chunk_ends, lambda e, i: F.struct(F.when(i == 0, 0).otherwise(F.get(chunk_ends, i - 1)).alias("start_pos"), e.alias("end_pos")))


def chunk_ends(sentences: Column) -> Column:
    """Cumulative ends of sentences joined by newlines; the last has none after it. Null for no sentence."""
    n = F.size(sentences)
    lengths = F.transform(sentences, lambda s, i: F.length(s) + F.when(i == n - 1, 0).otherwise(1))
    # Bound by a lambda, so that the lengths are worked out once.
    return F.when(n > 0, F.get(F.transform(F.array(lengths), lambda v: _running_of(v)), F.lit(0)))


def _running_of(v: Column, block: int = 64) -> Column:
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x)
    sums = lambda c: F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.lit(0), F.size(c) - 1) / block).cast("int")), lambda b: total(F.slice(c, b * block + 1, F.lit(block))))

    def places(s: Column) -> Column:
        i_block = lambda i: F.floor(i / block).cast("int")
        outer = lambda i: F.floor(i / (block * block)).cast("int")
        at = lambda i: total(F.slice(s["c"], F.lit(1), outer(i))) + total(F.slice(s["b"], outer(i) * block + 1, i_block(i) % block)) + total(F.slice(s["a"], i_block(i) * block + 1, i % block + 1))
        return F.transform(F.sequence(F.lit(0), F.size(s["a"]) - 1), at)

    two = F.transform(F.array(v), lambda a: F.struct(a.alias("a"), sums(a).alias("b")))
    three = F.transform(two, lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), sums(s["b"]).alias("c")))
    return F.get(F.transform(three, places), F.lit(0))


def match_places(text: Column, pattern: str) -> Column:
    """``array<struct<start_pos, end_pos, content>>`` of all matches of a pattern (none of them empty), left to right.

    Matches and the pieces between them alternate, so their lengths give all places without searching again.
    """
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    both = F.struct(found.alias("f"), F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.length(m) + F.length(g)).alias("n"))

    def placed(x: Column) -> Column:
        ends = F.when(F.size(x["f"]) > 0, _running_of(x["n"])).otherwise(F.array().cast("array<int>"))
        return F.zip_with(x["f"], ends, lambda m, e: F.struct((e - F.length(m)).alias("start_pos"), e.alias("end_pos"), m.alias("content")))

    return F.get(F.transform(F.array(both), placed), F.lit(0))
