"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key, scaled by its quality weight: key = -ln(u) / weight, with u from a hash of its
id. In ascending order of keys, any prefix is a weighted sample without replacement. A source first gives as many
complete epochs as its target holds; the rest is the prefix of its documents whose sizes add up nearest to what is left.

The prefix is found without sorting a source in one place: keys become places in 4,096 x 4,096 steps, sizes are added up
by step, the step in which the target falls is found on these sums, and only the documents in it are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm import common as c
from riskframe.operators.ordered import global_rank

STEPS = 4096
PLACES = 64  # parts of a source when its documents meet the decision about it


#: A word of letters, with one sign of punctuation at most after it.
PLAIN_WORD = r"(?<![^\x20\x09-\x0D])\p{L}+[.,;:]?(?![^\x20\x09-\x0D])"


def plain_share(text: Column, size: Column) -> Column:
    """Quality weight of a text of ``size`` words: the share of plain words, from 0.05 to 1."""
    return F.coalesce(F.greatest(F.regexp_count(text, F.lit(PLAIN_WORD)) / F.when(size > 0, size), F.lit(0.05)), F.lit(0.05))


def targets(sizes: DataFrame, share: float, weights: tuple[float, ...], most: float) -> DataFrame:
    """source, source_size, target. Sources in code point order (null last) take ``weights`` in turn.

    Together they get ``share`` of all sizes, each at most ``most`` times its own; what is above is shared again by
    weight until none is above. Each turn adds up the table of sources; two numbers come to the driver.
    """
    ranked = global_rank(sizes.withColumn("_null", F.col("source").isNull()), ["_null", "source"], "rank").drop("_null")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = c.checkpointed(ranked.withColumn("weight", F.get(cycle, ((F.col("rank") - 1) % len(weights)).cast("int"))).drop("rank"))
    cap = F.col("source_size") * F.lit(float(most))
    level, held = 0.0, -1
    total = None
    while True:
        above = F.col("weight") * F.lit(level) > cap if held >= 0 else F.lit(False)
        row = ranked.agg(F.sum("source_size").alias("size"), F.sum(F.when(above, cap).otherwise(0.0)).alias("fixed"),
                         F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("weight"), F.count_if(above).alias("n")).first()
        total = (row["size"] or 0) * share
        if row["n"] == held or not row["weight"]:
            break
        held, level = row["n"], (total - row["fixed"]) / row["weight"]
    return ranked.select("source", "source_size", F.least(cap, F.col("weight") * F.lit(level)).alias("target"))


def _crossing(sums: DataFrame, step: str, budget: Column) -> DataFrame:
    """Of each source the step in which the running size reaches the budget, and the size before it."""
    earlier = Window.partitionBy("source").orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    placed = sums.withColumn("before", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    return placed.filter((F.col("before") < budget) & (F.col("before") + F.col("size") >= budget)).groupBy("source").agg(
        F.min(step).alias("at"), F.min("before").alias("before"))


def _by_source(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Join on source, where null is a source like any other."""
    other = right.withColumnRenamed("source", "_source")
    return left.join(other, left["source"].eqNullSafe(other["_source"]), how).drop("_source")


def _at_step(docs: DataFrame, step: str, crossing: DataFrame, at: str) -> DataFrame:
    """Documents of the step in which their source's budget falls; joined on source and step, so no source is one task."""
    other = crossing.withColumnRenamed("source", "_source")
    same = docs["source"].eqNullSafe(other["_source"]) & (docs[step] == other[at])
    return docs.join(other, same).drop("_source", at)


def _spread(docs: DataFrame, cut: DataFrame) -> DataFrame:
    """Documents with the row of their source; the few rows of ``cut`` are copied, so a source's documents are many tasks."""
    left = docs.withColumn("_part", F.pmod(F.xxhash64("_key", "_text"), F.lit(PLACES)).cast("int"))
    right = cut.withColumnRenamed("source", "_source").withColumn("_place_of", F.explode(F.sequence(F.lit(0), F.lit(PLACES - 1))))
    same = left["source"].eqNullSafe(right["_source"]) & (left["_part"] == right["_place_of"])
    return left.join(right, same, "left").drop("_source", "_part", "_place_of")


def _keyed(docs: DataFrame, quality: Column | None, seed: int) -> DataFrame:
    """Size, key, the key's step and a hash of the text, for every document."""
    weight = plain_share(F.col("text"), F.col("size")) if quality is None else quality
    # u in (0, 1], from 52 bits of a hash
    u = (F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(seed)), 12) + 1) / F.lit(float(1 << 52))
    keyed = docs.withColumn("size", c.n_words(F.col("text"))).withColumns({"_key": -F.log(u) / weight, "_text": F.xxhash64("text")})
    # Keys run from 0 to some hundreds where weights are small; this scale gives both ends many steps.
    place = F.floor(F.col("_key") / (1 + F.col("_key")) * (STEPS * STEPS)).cast("long")
    return keyed.withColumn("_place", F.least(place, F.lit(STEPS * STEPS - 1)))


def _numbered(joined: DataFrame) -> DataFrame:
    """``_n``: 1, 2, ... of the rows of a source that equal its border. They are counted by partition, so they need not meet in a task."""
    equal = F.coalesce(F.struct("_key", "doc_id", "_text", "size") == F.col("border"), F.lit(False))
    placed = c.checkpointed(joined.filter(equal).withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    counts = placed.groupBy("source", "_part").agg(F.count(F.lit(1)).alias("k"))
    before = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    counts = counts.withColumn("before", F.coalesce(F.sum("k").over(before), F.lit(0))).select(F.col("source").alias("_s"), F.col("_part").alias("_p"), "before")
    within = Window.partitionBy("_part", "source").orderBy("_at")
    met = placed.withColumn("_k", F.row_number().over(within)).join(counts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_p")))
    met = met.withColumn("_n", F.col("_k") + F.col("before")).drop("_at", "_part", "_k", "_s", "_p", "before")
    return joined.filter(~equal).withColumn("_n", F.lit(None).cast("long")).unionByName(met)


def _number(joined: DataFrame) -> Column:
    """The number of a row among those equal to it; 0 where all of them are taken."""
    return F.col("_n") if "_n" in joined.columns else F.lit(0)


def mix(docs: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (5, 2, 1), most: float = 2.0, quality: Column | None = None,
        seed: int = 7, texts: bool = True) -> DataFrame:
    """All columns of ``docs`` with size, source_size, target, copies (times the mix takes it) and taken (size x copies).

    docs: doc_id long, text string, source string; other columns pass through, and columns named like the new ones are
    replaced. Size is the number of words; a null or blank text has size 0. A null source is a source of its own, the
    last one. ``quality`` is a positive weight of a document (default: ``plain_share``). Keys come from the id and the
    seed, so reruns agree; rows with equal keys are ordered by a hash of their text and are interchangeable if that is
    equal too: of equal rows as many are taken as the budget holds. An empty table gives an empty result. Without ``texts`` only doc_id and source of the documents come
    back, and texts are read once instead of twice.
    """
    added = ["size", "source_size", "target", "copies", "taken"]
    own = docs.drop(*added)
    keyed = _keyed(own, quality, seed)
    sized = keyed.select("doc_id", "source", "size", "_key", "_text", "_place")
    sized = c.checkpointed(sized.withColumns({"b1": F.floor(F.col("_place") / STEPS), "b2": F.col("_place") % STEPS}))
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), share, weights, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    sources = c.checkpointed(sources.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))

    first = _by_source(sized.groupBy("source", "b1").agg(F.sum("size").alias("size")), sources.select("source", "rest"))
    first = c.checkpointed(_crossing(first, "b1", F.col("rest")).withColumnsRenamed({"at": "c1", "before": "before1"}))
    inside = _at_step(sized, "b1", _by_source(first, sources.select("source", "rest")), "c1")
    inside = c.checkpointed(inside.withColumn("rest", F.col("rest") - F.col("before1")).drop("before1"))
    second = inside.groupBy("source", "b2", "rest").agg(F.sum("size").alias("size"))
    second = c.checkpointed(_crossing(second, "b2", F.col("rest")).withColumnsRenamed({"at": "c2", "before": "before2"}))
    last = _at_step(inside, "b2", second, "c2")
    upto = Window.partitionBy("source").orderBy("_key", "doc_id", "_text", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = last.withColumn("_sum", F.sum("size").over(upto) + F.col("before2"))
    # the document on which the budget falls is taken if that comes nearer
    last = last.withColumn("_in", F.col("_sum") - F.col("size") / 2 <= F.col("rest"))
    # the last taken document of each source marks the border
    row = F.struct("_key", "doc_id", "_text", "size")
    last = c.checkpointed(last.withColumn("_row", row).select("source", "_row", "_in"))
    border = last.filter("_in").groupBy("source").agg(F.max("_row").alias("border"))
    equal = _by_source(last, border, "inner").filter("_row = border").groupBy("source").agg(F.count_if("_in").alias("room"), F.count(F.lit(1)).alias("there"))
    border = _by_source(border, equal)  # of ``there`` rows equal to the border ``room`` are taken
    cut = _by_source(_by_source(_by_source(sources, first.select("source", "c1")), second.select("source", "c2")), border)

    joined = _spread(keyed if texts else sized, cut)
    if not equal.filter("there > room").isEmpty():
        joined = _numbered(joined)
    b1, b2 = F.floor(F.col("_place") / STEPS), F.col("_place") % STEPS
    at_border = F.coalesce(row < F.col("border"), F.lit(False)) | F.coalesce((row == F.col("border")) & (_number(joined) <= F.col("room")), F.lit(False))
    part = (b1 < F.col("c1")) | ((b1 == F.col("c1")) & ((b2 < F.col("c2")) | ((b2 == F.col("c2")) & at_border)))
    copies = F.col("epochs") + F.when(F.coalesce(part, F.lit(False)) & (F.col("rest") > 0), 1).otherwise(0)
    result = joined.withColumn("copies", copies.cast("long")).withColumn("taken", F.col("copies") * F.col("size"))
    return result.select(*(own.columns if texts else ["doc_id", "source"]), *added)


def sample(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``."""
    mixed = mix(docs, **options).filter("copies > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns)
