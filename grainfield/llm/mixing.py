r"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions alone.

A source's target is its share of all words by weight, at most MOST times its own words; what is above goes to the others
by weight until none is above. A document's expected copies are target over source words (times its merit, where a merit
column is given, over the source's mean merit, at most MOST). The whole part of that is taken for certain. The rest is
its inclusion probability p: with u uniform from a hash of the row, documents are ranked by u/(1-u) over p/(1-p), the
Pareto order, and taken in that order up to the sum of size x p; documents that still fit into what is left over are
taken in further passes, in the same order. At last, up to SWAPS times, the one step that comes closest is made, if it
comes closer than none: one more document, one less, or one for another.

A tilt column (0 to 1) makes inclusion unequal without a change of the target: with t = target over source words, a row
expects t + min(t, MOST - t) x (its tilt - the source's mean tilt by words) copies, which stays within 0 and MOST.

Sources are ranked in strata of about STRATUM rows, dealt by the same hash, so that a source of any size is many groups.

Cases: a null text has size 0, an empty one too; rows of size 0 take 0 words (and count as their certain copies); a null
source is a source of its own, the last one; repeated rows are ranked side by side and each taken by itself; with no
words at all every target is 0; an empty table gives an empty result; the input row travels as one struct, so extra
columns stay as they are, whatever their names. Sums are taken in whole units, so that reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from grainfield.llm.shared import SMALL, written

MOST, STRATUM, PASSES, SWAPS = 3, 4096, 4, 4
UNIT = 1 << 20
#: Words at which a document's tilt by length is one half.
PIVOT = 256


def word_count(text: Column | str) -> Column:
    r"""Number of runs of characters other than blank and \x09 to \x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def length_tilt(size: Column | str, pivot: int = PIVOT) -> Column:
    """A tilt towards documents of more running text: 0 for none, one half at pivot words, below 1 always."""
    size = F.col(size) if isinstance(size, str) else size
    return size / (size + F.lit(pivot))


def source_targets(sized: DataFrame, weights: Sequence[float], source: str = "source", size: str = "size", most: float = MOST, merit: str | None = None) -> DataFrame:
    """One row per source: _source, source_size, rows, merits (sum of size x merit), target. The weights go round the sources in code-point order, null last.

    With the sources in order of cap over weight, those below some place are at their cap and the others share the rest;
    the place is the first where the share fits under the next cap. Only the sources' sums meet in one place.
    """
    merits = F.sum(_fixed(F.col(size) * F.col(merit).cast("double")) if merit else F.lit(0)) / float(UNIT)
    totals = sized.groupBy(F.col(source).alias("_source")).agg(F.sum(size).alias("source_size"), F.count("*").alias("rows"), merits.alias("merits"))
    place = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    caps = totals.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("_source").asc_nulls_last())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(rest)
    levels = caps.withColumn("_level", level)
    fits = F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level"))
    levels = levels.withColumn("_level", F.first(fits, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("_cap"), F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap")))
    return levels.select("_source", "source_size", "rows", "merits", target.alias("target"))


def _fixed(value: Column) -> Column:
    """The value in whole units of 1/UNIT, so that sums don't depend on the order of the rows."""
    return F.floor(value * float(UNIT))


def mix(sized: DataFrame, weights: Sequence[float], key: Sequence[str], source: str = "source", size: str = "size", merit: str | None = None, tilt: str | None = None, seed: int = 42, most: float = MOST, stratum: int = STRATUM) -> DataFrame:
    """The rows with source_size, target and copies (which replace columns of these names). key: columns that tell rows apart; equal rows rank side by side.

    merit: a column of any scale to which expected copies are proportional, up to most; tilt: a column of 0 to 1 (a null is 0, others
    are brought within) that shifts them and keeps the target. At most one of the two. The rows should be read from a table, as they are read for the sources' sums and again for the ranks.
    """
    quoted = lambda c: F.col(f"`{c}`")
    hashed = F.xxhash64(F.lit(seed), *map(quoted, key))
    if merit and tilt:
        raise ValueError("give a merit or a tilt, not both")
    own = F.coalesce(quoted(merit).cast("double"), F.lit(1.0)) if merit else F.lit(1.0)
    if tilt:
        own = F.least(F.greatest(F.coalesce(quoted(tilt).cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    rows = sized.select(F.struct(*map(quoted, sized.columns)).alias("row"), quoted(source).alias("source"), quoted(size).alias("size"), own.alias("merit"), hashed.alias("h"))
    targets = written(source_targets(rows, weights, most=most, merit="merit" if merit or tilt else None), "sources")
    small = targets.count() <= SMALL
    joined = rows.join(F.broadcast(targets) if small else targets, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    uniform = (F.shiftrightunsigned("h", 12) + 0.5) / float(1 << 52)
    dealt = joined.withColumns({"u": uniform, "s": F.pmod(F.xxhash64(F.lit(seed + 1), "h"), F.ceil(F.col("rows") / stratum))})
    part = Window.partitionBy("source", "s")
    share = F.coalesce(F.try_divide(F.col("merit") * F.col("source_size"), F.col("merits")), F.lit(1.0)) if merit else F.lit(1.0)
    even = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    expected = F.least(even * share, F.lit(float(most)))
    if tilt:
        shift = F.col("merit") - F.coalesce(F.try_divide("merits", "source_size"), F.lit(0.0))
        expected = F.least(F.greatest(even + F.least(even, float(most) - even) * shift, F.lit(0.0)), F.lit(float(most)))
    dealt = dealt.withColumn("e", expected).withColumn("c", F.floor("e")).withColumn("p", F.col("e") - F.col("c"))
    odds = F.when(F.col("p") > 0, F.col("u") / (1 - F.col("u")) * (1 - F.col("p")) / F.col("p"))
    ranked = dealt.withColumn("q", odds).withColumn("gap", F.sum(_fixed(F.col("p") * F.col("size"))).over(part) / float(UNIT)).withColumn("in", F.lit(False))
    line = part.orderBy(F.col("q").asc_nulls_last(), "h", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for k in range(PASSES):  # the first pass takes a prefix of the order, the later ones what still fits
        asks = ~F.col("in") & F.col("q").isNotNull() & (F.lit(k == 0) | (F.col("size") <= F.col("gap")))
        ranked = ranked.withColumn("t", F.sum(F.when(asks, F.col("size")).otherwise(0)).over(line))
        taken = asks & (F.col("t") <= F.col("gap"))
        ranked = ranked.withColumn("n", taken).withColumn("gap", F.col("gap") - F.sum(F.when(F.col("n"), F.col("size")).otherwise(0)).over(part)).withColumn("in", F.col("in") | F.col("n"))
    ranked = ranked.withColumn("place", F.row_number().over(part.orderBy(F.col("q").asc_nulls_last(), "h", "size")))
    for _ in range(SWAPS):
        ranked = _closer(ranked, part)
    copies = (F.col("c") + F.col("in").cast("long")).alias("copies")
    return ranked.select(*[F.col(f"row.`{c}`") for c in sized.columns if c not in ("source_size", "target", "copies")], "source_size", "target", copies)


def _closer(ranked: DataFrame, part: WindowSpec) -> DataFrame:
    """The rows after the one step that brings each stratum's words closest to what they should be, with gap (what is still missing).

    A free row of size s goes best with the taken row whose size is next to s - gap. So the free rows are put at s - gap on
    one line with the taken ones at their sizes, and look for the next one to either side; of equal sizes the first in Pareto
    order counts. No pairs are formed.
    """
    able = F.col("q").isNotNull()
    free, used = able & ~F.col("in"), able & F.col("in")
    rows = ranked.withColumn("at", F.when(free, F.col("size") - F.col("gap")).otherwise(F.col("size").cast("double")))
    below = F.max(F.when(used, F.struct("size", (-F.col("place")).alias("place")))).over(part.orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    above = F.min(F.when(used, F.struct("size", "place"))).over(part.orderBy(F.col("at").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("below", below).withColumn("above", above)

    def step(holds: Column, change: Column, add: Column, drop: Column) -> Column:
        return F.when(holds, F.struct(F.abs(F.col("gap") - change).alias("miss"), add.cast("long").alias("add"), drop.cast("long").alias("drop")))

    size, place, none = F.col("size"), F.col("place"), F.lit(0)
    steps = F.array(
        step(free, size, place, none),
        step(used, -size, none, place),
        step(free & F.col("below").isNotNull(), size - F.col("below.size"), place, -F.col("below.place")),
        step(free & F.col("above").isNotNull(), size - F.col("above.size"), place, F.col("above.place")),
    )
    rows = rows.withColumn("best", F.array_min(steps)).withColumn("best", F.min("best").over(part))
    moves = F.coalesce((F.col("best.miss") < F.abs("gap")) & ((F.col("best.add") == place) | (F.col("best.drop") == place)), F.lit(False))
    rows = rows.withColumn("moves", moves)
    moved = F.sum(F.when(F.col("moves"), F.when(F.col("in"), -size).otherwise(size)).otherwise(0)).over(part)
    rows = rows.withColumn("gap", F.col("gap") - moved).withColumn("in", F.col("in") != F.col("moves"))
    return rows.drop("at", "below", "above", "best", "moves")


def sized_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(id, source, text_hash, size) of every document, written once."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.xxhash64(text_col).alias("text_hash"), word_count(text_col).alias("size"))
    return written(rows, "sizes")
