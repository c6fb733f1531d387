"""Bias-corrected and accelerated bootstrap of macro averages, in one pass over the picks.

A resample of a group's n rows takes n of them with repeats. The picks are a chain of integer operations that any engine
repeats, whatever the group's size. A group's values lie in blocks of up to ``CELL_ROWS`` rows in the order of their ids; its draws are
dealt out in up to ``PARTS`` parts, so a task makes the picks of some draws and adds up those that fall in one block. Only
vectors of the draws' sums leave it. The cost is rows x draws additions in arrays (once more for each further block of a
group), never rows x draws rows.

Rows of equal group, id and value are weighted, not repeated. Null values count as 0. Groups of one row have no spread.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.distributions import normal_cdf, normal_quantile

#: Rows of a block (8 MB of values), parts of a group's draws at most, picks that a part is worth, and tasks that the parts are dealt to.
CELL_ROWS, PARTS, PART_PICKS, TASKS = 1 << 20, 64, 1 << 24, 256
#: Picks made at a time, to stay in a core's cache.
AT_ONCE = 1 << 15
#: Vectors a task holds before it sends them on.
HELD_GROUPS = 64
#: The modulus and multipliers of the picks.
PRIME = (1 << 31) - 1
BY_SEED, BY_CELL, BY_DRAW, BY_PLACE, MIX, ADD = 48271, 69621, 1583458089, 784588716, 1226874159, 1343714438


def picks(seed: int, code: int, cell: int, draws: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` rows each pick (draw, place) takes."""
    x = (seed * BY_SEED + code + cell * BY_CELL + draws * BY_DRAW + places * BY_PLACE) % PRIME
    for _ in range(2):
        x = (x * x + MIX * x + ADD) % PRIME
    return x * size // PRIME


def cell_counts(path: list[int], cell: int, seed: int, code: int, draws: int) -> np.ndarray:
    """For shares that no other engine repeats: how many of the group's picks fall in a cell in each draw; ``path`` are the sizes of the tree's nodes from the group to the cell."""
    count, levels = np.full(draws, path[0], dtype=np.int64), len(path) - 1
    for level in range(levels):
        node, right = cell >> (levels - level), cell >> (levels - level - 1) & 1
        size, below = path[level], path[level + 1]
        left = np.random.Generator(np.random.Philox(key=[seed << 32 | code, level << 48 | node])).binomial(count, (size - below if right else below) / size)
        count = count - left if right else left
    return count


def block_sums(values: np.ndarray, weights: np.ndarray, before: int, size: int, draws: range, seed: int, code: int) -> np.ndarray:
    """Each draw's sum of the group's picks that fall in a block, whose first row is the group's row ``before``."""
    ends = np.cumsum(weights)
    total, prime, thirty = int(ends[-1]), np.uint64(PRIME), np.uint64(31)
    flat = np.repeat(values, weights) if total <= 2 * len(values) + AT_ONCE else None
    whole = before == 0 and total == size
    bases = (seed * BY_SEED + code + np.array(draws, dtype=np.int64) * BY_DRAW).astype(np.uint64) % prime
    out, many = np.zeros(len(draws)), max(1, AT_ONCE // size)
    for lo in range(0, size, AT_ONCE):
        step = np.arange(lo, min(size, lo + AT_ONCE), dtype=np.uint64) * np.uint64(BY_PLACE) % prime
        for k in range(0, len(draws), many):
            x = step[None, :] + bases[k : k + many, None]
            x = np.minimum(x, x - prime)  # what is below 0 is far above
            for _ in range(2):
                x = x * (x + np.uint64(MIX)) + np.uint64(ADD)
                x = (x & prime) + (x >> thirty)
                x = (x & prime) + (x >> thirty)
                x = np.minimum(x, x - prime)
            at = (x * np.uint64(size) // prime).astype(np.int64)
            inside = None
            if not whole:
                at -= before
                inside = (at >= 0) & (at < total)
                at = np.where(inside, at, 0)
            taken = flat[at] if flat is not None else values[np.searchsorted(ends, at, side="right")]
            out[k : k + many] += (taken if inside is None else np.where(inside, taken, 0.0)).sum(axis=1)
    return out


def draw_sums(rows: DataFrame, value: str, keys: list[str], id_col: str, draws: int, seed: int) -> DataFrame:
    """``(*keys, n, first, sums)``: sums of the draws from ``first`` on, one vector a part and block of each group; ``n`` is the group's size."""
    v = F.coalesce(F.col(value).cast("double"), F.lit(0.0))
    group = F.struct(*keys).alias("_g")
    weighed = rows.groupBy(group, F.col(id_col).alias("_id"), v.alias("_v")).agg(F.count("*").alias("_w"))
    order = Window.partitionBy("_g").orderBy("_id", "_v")
    placed = weighed.select("_g", "_v", "_w", F.row_number().over(order).alias("_r"), (F.sum("_w").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_w")).alias("_at"))
    row = F.struct("_r", "_v", "_w")
    blocks = placed.groupBy("_g", F.floor((F.col("_r") - 1) / CELL_ROWS).alias("_block")).agg(F.min("_at").alias("_before"), F.array_sort(F.collect_list(row)).alias("_x"))
    sizes = weighed.groupBy("_g").agg(F.sum("_w").alias("n"))
    named = sizes.select("_g", "n", F.least(F.lit(PARTS), F.lit(draws), F.ceil(F.col("n") * draws / PART_PICKS)).cast("int").alias("_parts"))
    code = F.conv(F.substring(F.md5(F.concat_ws(":", *[F.col(f"_g.{k}").cast("string") for k in keys])), 1, 7), 16, 10).cast("long")
    dealt = blocks.join(named, "_g").select("*", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    first = lambda k: F.floor(k * F.lit(draws) / F.col("_parts")).cast("int")
    ready = dealt.select(*[F.col(f"_g.{k}").alias(k) for k in keys], "n", first(F.col("_part")).alias("first"), first(F.col("_part") + 1).alias("_next"), code.alias("_code"), "_before", F.col("_x._v").alias("_v"), F.col("_x._w").alias("_w")).repartition(TASKS, *keys, "first", "_before")

    def run(batches):
        k = len(keys)
        for batch in batches:
            sums = []
            for i in range(batch.num_rows):
                n, lo, hi, code, before = (batch.column(k + c)[i].as_py() for c in range(5))
                values, weights = (batch.column(k + c)[i].values.to_numpy(zero_copy_only=False) for c in (5, 6))
                sums.append(block_sums(values, weights, before, n, range(lo, hi), seed, code))
            yield pa.RecordBatch.from_arrays([*batch.columns[: k + 2], pa.array(sums, pa.list_(pa.float64()))], [*keys, "n", "first", "sums"])

    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return ready.mapInArrow(run, f"{kinds}, n long, first int, sums array<double>")


def macro_draws(results: DataFrame, value: str, group: str, id_col: str, keys: list[str], draws: int, seed: int) -> DataFrame:
    """``(*keys, draw, d)``: the macro average over groups in each draw."""
    by = [*keys, group]
    sums = draw_sums(results, value, by, id_col, draws, seed).select(*by, "n", "first", F.posexplode("sums").alias("_k", "s")).withColumn("draw", F.col("first") + F.col("_k"))
    return sums.groupBy(*by, "n", "draw").agg(F.sum("s").alias("s")).groupBy(*keys, "draw").agg(F.avg(F.col("s") / F.col("n")).alias("d"))


def flip_sums(paired: DataFrame, d: str, keys: list[str], id_col: str, draws: int, seed: int) -> DataFrame:
    """``(*keys, draw, s)``: the sum of ``d`` with each row's sign thrown anew in each draw; vectors of draws are added up in each task."""
    code = F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 7), 16, 10).cast("long")
    rows = paired.select(*keys, code.alias("_code"), F.col(d).cast("double").alias("_d"))
    k = len(keys)

    def run(batches):
        held: dict[tuple, list] = {}
        draw = np.arange(draws)

        def flush():
            named = [pa.concat_arrays([h[0][c] for h in held.values()]) for c in range(k)]
            out = pa.RecordBatch.from_arrays([*named, pa.array([h[1] for h in held.values()], pa.list_(pa.float64()))], [*keys, "sums"])
            held.clear()
            return out

        for batch in batches:
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*(batch.column(c).to_pylist() for c in range(k)), strict=True) if k else [()] * batch.num_rows):
                groups.setdefault(key, []).append(i)
            codes, ds = batch.column(k).to_numpy(zero_copy_only=False), batch.column(k + 1).to_numpy(zero_copy_only=False)
            for key, at in groups.items():
                if key not in held:
                    held[key] = [[batch.column(c).slice(at[0], 1) for c in range(k)], np.zeros(draws)]
                for lo in range(0, len(at), 128):
                    part = np.array(at[lo : lo + 128])
                    sign = 1 - 2 * (picks(seed, codes[part][:, None], 0, draw[None, :], 0, PRIME) & 1)
                    held[key][1] += ds[part] @ sign
                if len(held) > HELD_GROUPS:
                    yield flush()
        if held:
            yield flush()

    kinds = "".join(f"`{c}` {paired.schema[c].dataType.simpleString()}, " for c in keys)
    vectors = rows.where("_d is not null").mapInArrow(run, f"{kinds}sums array<double>")
    return vectors.select(*keys, F.posexplode("sums").alias("draw", "s")).groupBy(*keys, "draw").agg(F.sum("s").alias("s"))


def bootstrap_bca(results: DataFrame, value: str, group: str, id_col: str, keys: list[str] | None = None, draws: int = 10_000, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """The macro average over groups and its BCa interval: ``(*keys, macro, low, high, below, acceleration, draws)``.

    ``below`` is the share of draws under the macro average (a draw equal to it counts half), from which the bias correction
    comes; the acceleration is that of the jackknife, in closed form from each group's second and third moments. Limits
    are null where all draws lie on one side, and the average itself where nothing varies.
    """
    keys = keys or []
    by = [*keys, group]
    v = F.coalesce(F.col(value).cast("double"), F.lit(0.0))
    n = F.col("n").cast("double")
    moments = results.groupBy(*by).agg(F.count("*").alias("n"), F.avg(v).alias("m"), F.var_pop(v).alias("m2"), F.coalesce(F.nanvl(F.skewness(v), F.lit(0.0)), F.lit(0.0)).alias("g1"))
    spread = lambda p, s: F.sum(F.when(n > 1, s * n / F.pow((n - 1) * n, F.lit(p))).otherwise(0.0))
    per_key = moments.groupBy(*keys).agg(F.avg("m").alias("macro"), F.count("*").alias("k"), spread(3, F.col("g1") * F.pow("m2", F.lit(1.5))).alias("top"), spread(2, F.col("m2")).alias("bot"))
    # The number of groups divides both sums alike and falls out of the ratio.
    per_key = per_key.select(*keys, "macro", F.when(F.col("bot") > 0, F.col("top") / (6 * F.pow("bot", F.lit(1.5)))).otherwise(0.0).alias("acceleration"))
    macro = macro_draws(results, value, group, id_col, keys, draws, seed)

    def joined(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.join(b, keys) if keys else a.join(F.broadcast(b), F.lit(True))  # without keys b is one row

    # Draws are a fixed number, so a key's window is bounded.
    order = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("d")
    ranked = macro.withColumn("r", F.row_number().over(order) - 1).withColumn("up", F.lead("d").over(order))
    side = (F.count_if(F.col("d") < F.col("macro") - 1e-12 * F.abs("macro")) + 0.5 * F.count_if(F.abs(F.col("d") - F.col("macro")) <= 1e-12 * F.abs("macro"))) / F.count("*")
    shares = joined(ranked, per_key).groupBy(*keys, "macro", "acceleration").agg(side.alias("below"), F.count("*").alias("draws"))
    z0 = normal_quantile(F.col("below"))
    shift = lambda z: F.col("z0") + (F.col("z0") + z) / (1 - F.col("acceleration") * (F.col("z0") + z))
    z = normal_quantile(F.lit(alpha / 2))
    levels = shares.withColumn("z0", z0).withColumn("a1", normal_cdf(shift(z))).withColumn("a2", normal_cdf(shift(-z)))
    at = lambda a: F.col(a) * (F.col("draws") - 1)

    def quantile(a: str) -> Column:
        here = F.floor(at(a)) == F.col("r")
        return F.max(F.when(here, F.col("d") + (at(a) - F.col("r")) * (F.coalesce("up", "d") - F.col("d"))))

    kept = [*keys, "macro", "acceleration", "below", "draws"]
    out = joined(ranked, levels).groupBy(*kept).agg(quantile("a1").alias("low"), quantile("a2").alias("high"))
    return out.select(*keys, "macro", "low", "high", "below", "acceleration", "draws")
