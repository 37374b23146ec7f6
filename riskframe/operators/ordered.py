"""Order-dependent work without one task holding a whole group.

Rows are range-partitioned on (keys, order), so a hot key is cut into many
partitions, and sorted inside each. Partition summaries (one row per partition
and key that crosses a border) carry the state over partition borders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.session import checkpointed

_SHIFT = 33  # monotonically_increasing_id keeps the partition above bit 33


def range_ordered(df: DataFrame, order: list[str]) -> DataFrame:
    """Sorted, range-partitioned copy with ``_part`` and ``_pos`` (position overall).

    The result is checkpointed: the position must not change when it is read
    again or when a lost task is repeated.
    """
    cols = [F.col(c) for c in order]
    placed = df.repartitionByRange(*cols).sortWithinPartitions(*cols)
    placed = placed.withColumn("_pos", F.monotonically_increasing_id())
    placed = placed.withColumn("_part", F.shiftright(F.col("_pos"), _SHIFT).cast("int"))
    return checkpointed(placed)


def global_rank(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """Row number over the whole table; ``order`` must identify a row."""
    placed = range_ordered(df, order)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition: bounded by the number of partitions.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    local = F.col("_pos") - F.shiftleft(F.col("_part").cast("bigint"), _SHIFT)
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, local + F.col("_offset") + 1).drop("_part", "_pos", "_offset")
    )


def running_sums(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Exclusive running sums per key (rows strictly before this one).

    ``order`` must identify a row within the key.
    """
    base = df.withColumns({f"_v_{n}": c for n, c in sums.items()})
    placed = range_ordered(base, [*keys, *order])
    inside = Window.partitionBy("_part", *keys).orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumns({f"_l_{n}": F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) for n in sums})
    totals = placed.groupBy("_part", *keys).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    # Only keys that cross a partition border need a carry: at most two rows per partition.
    border = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    ahead = border.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        totals.withColumn("_parts", F.count(F.lit(1)).over(border)).filter(F.col("_parts") > 1)
        .select("_part", *keys, *[F.sum(f"_t_{n}").over(ahead).alias(f"_c_{n}") for n in sums])
    )
    joined = _carried(local, carry, keys)
    return joined.select(*df.columns, *[
        (F.col(f"_l_{n}") + F.coalesce(F.col(f"_c_{n}"), F.lit(0))).alias(n) for n in sums])


def _carried(local: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the carry of their partition and key; a NULL key is a key like any other.

    The carry has at most two rows for each partition, so it is broadcast.
    """
    named = carry.withColumnsRenamed({k: f"_key_{k}" for k in ["_part", *keys]})
    same = F.col("_part") == F.col("_key__part")
    for k in keys:
        same = same & local[k].eqNullSafe(named[f"_key_{k}"])
    return local.join(F.broadcast(named), same, "left").drop(*[f"_key_{k}" for k in ["_part", *keys]])


def previous_values(df: DataFrame, keys: list[str], order: list[str], columns: list[str],
                    prefix: str = "prev_") -> DataFrame:
    """The given columns of the row just before, within the key."""
    placed = range_ordered(df, [*keys, *order])
    inside = Window.partitionBy("_part").orderBy("_pos")
    carried = [*keys, *columns]
    local = placed.withColumns({f"_p_{c}": F.lag(c).over(inside) for c in carried})
    local = local.withColumn("_first", F.row_number().over(inside) == 1)
    # The last row of each partition precedes the first row of the next one.
    last = placed.groupBy("_part").agg(F.max_by(F.struct(*carried), "_pos").alias("_last"))
    shifted = last.select(
        "_part", F.lag("_last").over(Window.orderBy("_part")).alias("_before"))
    joined = local.join(F.broadcast(shifted), "_part", "left")
    source = lambda c: F.when(F.col("_first"), F.col(f"_before.{c}")).otherwise(F.col(f"_p_{c}"))
    same = F.lit(True)
    for k in keys:
        same = same & source(k).eqNullSafe(F.col(k))
    # The very first row of the table has nothing before it.
    exists = ~(F.col("_first") & F.col("_before").isNull())
    return joined.select(*df.columns, *[
        F.when(same & exists, source(c)).alias(f"{prefix}{c}") for c in columns])


def sessions(df: DataFrame, keys: list[str], order: list[str], breaks: Column, prev: list[str],
             name: str = "session_id") -> DataFrame:
    """Number the runs of rows that no break separates.

    ``breaks`` is a condition over the columns and ``prev_<c>`` for every ``c``
    in ``prev``; a change of key always breaks. One range pass, then two
    summaries with one row per partition.
    """
    placed = range_ordered(df, [*keys, *order])
    inside = Window.partitionBy("_part").orderBy("_pos")
    carried = [*keys, *[c for c in prev if c not in keys]]
    last = placed.groupBy("_part").agg(F.max_by(F.struct(*carried), "_pos").alias("_last"))
    shifted = last.select("_part", F.lag("_last").over(Window.orderBy("_part")).alias("_before"))
    local = placed.withColumns({
        "_lagged": F.lag(F.struct(*carried)).over(inside), "_first": F.row_number().over(inside) == 1})
    joined = local.join(F.broadcast(shifted), "_part", "left").withColumn(
        "_prior", F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_lagged")))
    other = F.col("_prior").isNull()
    for k in keys:
        other = other | ~F.col(f"_prior.{k}").eqNullSafe(F.col(k))
    joined = joined.withColumns({f"prev_{c}": F.when(~other, F.col(f"_prior.{c}")) for c in prev})
    joined = joined.withColumn("_new", (other | F.coalesce(breaks, F.lit(True))).cast("int"))
    numbered = joined.withColumn(
        "_no", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ends = numbered.groupBy("_part").agg(F.max("_no").alias("_news"))
    back = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    opened = F.when(F.col("_news") > 0, F.struct(F.col("_part").alias("p"), F.col("_news").alias("n")))
    open_runs = ends.select("_part", F.last(opened, ignorenulls=True).over(back).alias("_open"))
    linked = numbered.join(F.broadcast(open_runs), "_part", "left")
    run = F.when(F.col("_no") > 0, F.struct(F.col("_part").alias("p"), F.col("_no").alias("n"))).otherwise(F.col("_open"))
    return linked.select(
        *df.columns, *[f"prev_{c}" for c in prev],
        F.concat_ws("-", run["p"].cast("string"), run["n"].cast("string")).alias(name))


#: A time after every row: the only step of a partition whose outcome does not depend on what came before it.
_ALWAYS = (1 << 63) - 1


def spaced_out(df: DataFrame, keys: list[str], ts: str, row_id: str, seconds: float,
               same: list[str] | None = None) -> DataFrame:
    """Keep a row when no kept row of the key lies less than ``seconds`` before it.

    With ``same``, only consecutive rows that agree on those columns suppress
    each other. One key, even one endless run without a gap, is many tasks:

    * Rows are range-partitioned by key and time. What a partition does to a
      run that comes from the partition before depends on one number, the time
      from which a row may be kept again. That dependence is a step function,
      of at most as many steps as rows lie within ``seconds``.
    * The functions are composed by doubling: after n rounds a partition knows
      the outcome of the 2^n partitions up to it. A gap of the full interval or
      a change of key makes the outcome constant, and ends its rounds.
    * Then every partition keeps its rows by itself.
    """
    step, group = int(seconds * 1_000_000), [*keys, *(same or [])]
    name = [x for k in group for x in (F.col(k), F.col(k).isNull())]
    marked = df.withColumns({"_run": F.xxhash64(*name) if group else F.lit(0).cast("long"), "_us": F.unix_micros(F.col(ts))})
    placed = range_ordered(marked, [*keys, "_us", row_id])
    edge = F.struct("_run", "_us")
    ends = placed.groupBy("_part").agg(F.min_by(edge, "_pos").alias("first"), F.max_by(edge, "_pos").alias("last"))
    order = Window.orderBy("_part")  # one row a partition
    ends = ends.withColumns({"_k": F.row_number().over(order), "_before": F.lag("last").over(order)})
    goes_on = (F.col("first._run") == F.col("_before._run")) & (F.col("first._us") - F.col("_before._us") < step)
    ends = checkpointed(ends.select("_part", "_k", F.when(goes_on, F.col("_before._us") + step).alias("_latest")))
    steps = placed.select("_part", "_run", "_us").join(F.broadcast(ends), "_part").select("_k", "_latest", "_run", "_us")
    steps = checkpointed(steps.mapInPandas(_partition_steps(step), "k int, lo long, exit long"))
    span = 1
    while not steps.filter(F.col("lo") < _ALWAYS).isEmpty():
        late = steps.filter(F.col("lo") < _ALWAYS).select(F.col("k").alias("at"), F.lit(1).alias("role"), "lo", "exit")
        early = steps.select((F.col("k") + span).alias("at"), F.lit(0).alias("role"), "lo", "exit")
        met = late.unionByName(early.join(late.select("at").distinct(), "at", "left_semi"))
        met = met.repartition("at").sortWithinPartitions("at", "role", "lo").mapInPandas(_composed, "k int, lo long, exit long")
        steps = checkpointed(steps.filter(F.col("lo") == _ALWAYS).unionByName(met))
        span *= 2
    free = steps.select((F.col("k") + 1).alias("_k"), F.col("exit").alias("_free"))
    start = ends.join(free, "_k", "left").select("_part", F.when(F.col("_latest").isNotNull(), F.col("_free")).alias("_free"))
    ready = placed.join(F.broadcast(start), "_part").drop("_part", "_pos")
    return ready.mapInPandas(_kept_rows(step), ready.schema).drop("_run", "_us", "_free")


def _partition_steps(step: int):
    """The step function of a partition: rows (lo, exit), for a run free again at T the first lo >= T tells when it is free after."""
    def run(batches):
        import numpy as np
        import pandas as pd

        part, latest, runs, times = None, None, [], []
        for pdf in batches:
            if len(pdf):
                part, latest = int(pdf["_k"].iloc[0]), pdf["_latest"].iloc[0]
                runs.append(pdf["_run"].to_numpy())
                times.append(pdf["_us"].to_numpy())
        if part is None:
            return
        run, us = np.concatenate(runs), np.concatenate(times)
        cuts = 1 + np.flatnonzero((run[1:] != run[:-1]) | (np.diff(us) >= step))
        tail = us[cuts[-1] if len(cuts) else 0:]
        after = np.searchsorted(tail, tail + step)
        last = np.where(after < len(tail), after, np.arange(len(tail)))
        while not (last[last] == last).all():
            last = last[last]
        exits = tail[last] + step
        if len(cuts) or pd.isna(latest):  # a run begins here: nothing before it matters
            yield pd.DataFrame({"k": [part], "lo": [_ALWAYS], "exit": [int(exits[0])]}).astype({"k": "int32"})
            return
        reach = min(len(tail), int(np.searchsorted(tail, int(latest))) + 1)
        lo, exits = tail[:reach], exits[:reach]
        ends = np.append(lo[1:] != lo[:-1], True) & np.append(exits[1:] != exits[:-1], True)
        first = np.searchsorted(lo, lo[ends])  # equal times: the first of them is kept
        yield pd.DataFrame({"k": np.full(int(ends.sum()), part, dtype=np.int32), "lo": lo[ends], "exit": exits[first]})
    return run


def _composed(batches):
    """For each ``at``: the function of role 0, then that of role 1."""
    import numpy as np
    import pandas as pd

    def compose(table):
        early, late = table[table["role"] == 0], table[table["role"] == 1]
        lo, out = early["lo"].to_numpy(), early["exit"].to_numpy()
        lo2, out2 = late["lo"].to_numpy(), late["exit"].to_numpy()
        at = np.searchsorted(lo2, out)
        out = np.where(at < len(lo2), out2[np.minimum(at, len(lo2) - 1)], out)
        beyond = lo2 > (lo[-1] if len(lo) else np.iinfo(np.int64).min)
        lo, out = np.append(lo, lo2[beyond]), np.append(out, out2[beyond])
        ends = np.append(out[1:] != out[:-1], True)
        return pd.DataFrame({"k": np.full(int(ends.sum()), table["at"].iloc[0], dtype=np.int32), "lo": lo[ends], "exit": out[ends]})

    held = []
    for pdf in batches:
        for at, own in pdf.groupby("at", sort=False):
            if held and held[0]["at"].iloc[0] != at:
                yield compose(pd.concat(held))
                held = []
            held.append(own)
    if held:
        yield compose(pd.concat(held))


def _kept_rows(step: int):
    def run(batches):
        import numpy as np

        name, free = None, None
        for pdf in batches:
            if not len(pdf):
                continue
            runs, times = pdf["_run"].to_numpy(), pdf["_us"].to_numpy()
            if name is None and not np.isnan(float(pdf["_free"].iloc[0] if pdf["_free"].iloc[0] is not None else np.nan)):
                name, free = runs[0], int(pdf["_free"].iloc[0])
            kept = np.zeros(len(pdf), dtype=bool)
            starts = np.flatnonzero(np.append(True, runs[1:] != runs[:-1]))
            for a, b in zip(starts, [*starts[1:], len(pdf)]):
                if runs[a] != name:
                    name, free = runs[a], None
                i = a if free is None else a + int(np.searchsorted(times[a:b], free))
                while i < b:
                    kept[i], free = True, int(times[i]) + step
                    i = a + int(np.searchsorted(times[a:b], free))
            yield pdf[kept]
    return run


def last_before(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Last non-null ``value`` at or before each row of the key (an as-of lookup).

    Sort-based and linear: no pairs are formed however many rows share a key
    or a moment.
    """
    placed = range_ordered(df, [*keys, *order])
    inside = Window.partitionBy("_part", *keys).orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = placed.withColumn("_l", F.last(value, ignorenulls=True).over(inside))
    ends = placed.groupBy("_part", *keys).agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.col("_pos"))).alias("_e"))
    border = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    back = border.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # Only keys that cross a partition border: at most two rows per partition.
    carry = ends.withColumn("_parts", F.count(F.lit(1)).over(border)).filter(F.col("_parts") > 1).select(
        "_part", *keys, F.last("_e", ignorenulls=True).over(back).alias("_c"))
    joined = _carried(local, carry, keys)
    return joined.select(*df.columns, F.coalesce("_l", "_c").alias(name))
