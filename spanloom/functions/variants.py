"""Selections of any JSON type in one column, dispatched by their type.

A prediction file may hold null, an empty list, spans that are grounded already, completions as text, or lists of texts,
row by row. The column is parsed to VARIANT once and each row goes the way of its type.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import repair

GROUNDED = "array<struct<doc_id:int,start_pos:int,end_pos:int,content:string>>"
#: The keys that tell a grounded span.
KEYS = ("doc_id", "start_pos", "end_pos", "content")
KINDS = ("missing", "empty", "grounded", "parsed", "unreadable")


def typed_selection(json: Column, by_document: bool = False) -> Column:
    """``struct<kind, texts array<string>, spans array<struct<doc_id, start_pos, end_pos, content>>>`` of a JSON value.

    * null, or JSON null: ``missing``; an empty list: ``empty`` (its ``texts`` are empty, not null);
    * a list whose first entry is an object with the keys of a span: ``grounded``, if all its entries are spans, which pass
      as they are (other keys are left out); else ``unreadable``;
    * a text: parsed leniently, ``parsed`` or ``unreadable``; with ``by_document`` it is one document's completion;
    * a list of texts: the selections themselves; with ``by_document`` one completion a document;
    * anything else, invalid JSON and lists of mixed types: ``unreadable``.
    """
    v = F.try_parse_json(json)
    schema = F.schema_of_variant(v)
    is_list = schema.startswith("ARRAY<")
    size = F.size(F.try_variant_get(v, "$", "array<variant>"))
    first = F.try_variant_get(v, "$[0]", "variant")
    has_keys = F.schema_of_variant(first).startswith("OBJECT<")
    for k in KEYS:
        has_keys = has_keys & F.try_variant_get(first, f"$.{k}", "variant").isNotNull()
    spans = F.try_variant_get(v, "$", GROUNDED)
    whole = F.forall(spans, lambda s: s.isNotNull() & s["doc_id"].isNotNull() & s["start_pos"].isNotNull() & s["end_pos"].isNotNull() & s["content"].isNotNull())
    texts = F.when(schema == "ARRAY<STRING>", F.try_variant_get(v, "$", "array<string>"))
    said = F.when(schema == "STRING", F.try_variant_get(v, "$", "string"))
    if by_document:
        parsed = repair.parse_document_selections(F.coalesce(texts, F.when(said.isNotNull(), F.array(said))))
    else:
        parsed = F.coalesce(texts, repair.parse_selection_lenient(said))
    missing = json.isNull() | F.coalesce(F.is_variant_null(v), F.lit(False))
    empty = is_list & (size == 0)
    grounded = is_list & has_keys & F.coalesce(whole, F.lit(False))
    kind = F.when(missing, "missing").when(v.isNull(), "unreadable").when(empty, "empty").when(is_list & has_keys, F.when(grounded, "grounded").otherwise("unreadable")).when(parsed.isNotNull(), "parsed").otherwise("unreadable")
    listed = F.when(missing | v.isNull(), F.lit(None)).when(empty, F.array().cast("array<string>")).when(~(is_list & has_keys), parsed)
    return F.struct(kind.alias("kind"), listed.alias("texts"), F.when(grounded, spans).alias("spans"))
