"""Bags (multisets) as arrays: each item is numbered among its equals, so that set functions count repeats."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numbered_lists(lists: pa.Array) -> pa.Array:
    """Each item behind the number of equals that stand before it in its list."""
    lists = lists.cast(pa.list_(pa.string()))
    items = lists.flatten()
    size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    codes = items.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
    key = np.repeat(np.arange(len(lists)), size) * (codes.max(initial=0) + 1) + codes
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], np.diff(key[order]) > 0])[: len(key)]
    place = np.empty(len(key), dtype=np.int64)
    at = np.arange(len(key))
    place[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    named = pc.binary_join_element_wise(pa.array(place).cast(pa.string()), pc.fill_null(items, ""), ":")
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), named, mask=pc.is_null(lists) if lists.null_count else None)


@F.arrow_udf(T.ArrayType(T.StringType()))
def numbered(items: pa.Array) -> pa.Array:
    """:func:`numbered_lists` of a column; a null item counts as an empty one."""
    return numbered_lists(items)


def bag_scores(ref: Column, pred: Column) -> dict[str, Column]:
    """Precision, recall and F1 of two arrays from :func:`numbered`; two empty ones agree, one empty one scores 0."""
    overlap, n, m = F.size(F.array_intersect(ref, pred)), F.size(ref), F.size(pred)
    none = (n == 0) & (m == 0)
    of = lambda size: F.when(none, 1.0).when(overlap == 0, 0.0).otherwise(overlap / size)
    return {"precision": of(m), "recall": of(n), "f1": F.when(none, 1.0).when(overlap == 0, 0.0).otherwise(2 * overlap / (n + m))}


def bag_f1(ref: Column, pred: Column) -> Column:
    return bag_scores(ref, pred)["f1"]
