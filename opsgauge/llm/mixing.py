"""Mixing sources to target weights by entropy balancing.

Each source should give a share of all words.  Among all document rates that meet these
constraints, entropy balancing takes the ones nearest to 1: they are the exponential of
the multipliers of the constraints, found by Newton's method on the convex dual.  With one constraint for
each source the solution is one rate for each source, its target through its size: the sums over documents
that a Newton step needs are the sources' sizes.  The rates are then rounded into whole copies whose words meet the targets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsgauge.llm.shared import col, fresh, small, text_key, word_count, written
from opsgauge.plans.ordering import ranked

# Weights of the sources in the order of their names, repeated as needed.
WEIGHTS = (5, 2, 1)
# No document is taken more often.
MAX_RATE = 3
NEWTON_STEPS = 80
# A source's documents are in a random order of 120 bits, read 10 bits at a time.
_LEVEL_BITS, _HALF_LEVELS = 10, 6
# Prefixes of this order taken one after the other, each from what still fits; what is missing then is filled by size.
PASSES = 3
# Documents of one size are numbered in so many parts first.
_PARTS = 64


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """``source, source_size, target`` from rows of ``source, size``.

    The sources (by code point, NULL last) share the sum of all sizes by the repeating ``weights``.
    A target stops at ``max_rate`` times its source's size and the excess goes to the others by
    weight, until no target is above.
    """
    sums = written(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    placed = ranked(sums, [F.col("source").asc_nulls_last()], rank="place")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights)).cast("int"))
    sources = written(placed.select("source", "source_size", weight.alias("weight")), "sources")
    most = max_rate * F.col("source_size").cast("double")
    total, all_weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    unit, stopped = (total / all_weights if total else 0.0), 0
    while total:
        above = most < F.lit(unit) * F.col("weight")
        count, taken, rest = sources.agg(
            F.count_if(above), F.sum(F.when(above, most).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight")))
        ).first()
        if count == stopped or not rest:
            break
        unit, stopped = (total - taken) / rest, count
    return sources.select("source", "source_size", F.least(most, F.lit(unit) * F.col("weight")).alias("target"))


def balanced_rates(targets: DataFrame) -> DataFrame:
    """``targets`` with ``rate``: what each word of a source is multiplied with.

    The dual of the constraint "words times rate = target" is convex in the multiplier of each
    source and separates by source, so the Newton iterations of all sources run side by side,
    on sums of the documents' sizes.
    """
    goal = F.col("target") / F.nullif(F.col("source_size"), F.lit(0))
    # The gradient is size x exp(m) - target, the second derivative size x exp(m).
    multiplier = F.aggregate(
        F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), F.lit(0.0), lambda m, _: m - 1 + goal * F.exp(-m)
    )
    return targets.withColumn("rate", F.when(goal > 0, F.exp(multiplier)).otherwise(0.0))


@dataclass(frozen=True)
class Mix:
    """A source's targets and rounding, one row per source, and documents with further copies (``high, low, more``)."""

    sources: DataFrame
    passes: int
    filled: DataFrame


def _levels(document: Column, row: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(document, 4), F.shiftrightunsigned(F.xxhash64(row, document), 4)


def _below(at: int) -> Column:
    """Whether a row lies in the prefix of pass ``at``."""
    before = (F.col("high") < F.col(f"high{at}")) | (
        (F.col("high") == F.col(f"high{at}")) & (F.col("low") < F.col(f"low{at}"))
    )
    return before & (F.col("size") <= F.col(f"fits{at}"))


def _taken(passes: int) -> Column:
    taken = F.lit(False)
    for at in range(passes):
        taken = taken | _below(at)
    return taken


def plan_mix(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    max_rate: int = MAX_RATE,
) -> Mix:
    """Targets, rates and rounding of all sources of ``docs``.

    Every document gets the whole part of its source's rate in copies.  What is then missing in
    a source is filled with one more copy of documents in a random order, as far as they fit:
    a prefix of the order, then of the documents that fit in what is left, a few times.  Where a
    prefix ends is found from sums of ever narrower ranges, so no source is sorted in one place.  The rest is filled
    with the largest sizes that fit, up to ``max_rate`` copies of a document, until no allowed copy fits.
    """
    rows = docs.select(
        col(source_column).alias("source"),
        word_count(col(text_column)).alias("size"),
        text_key(col(text_column), col(id_column), col(source_column)).alias("document"),
        F.monotonically_increasing_id().alias("row"),
    )
    high, low = _levels(F.col("document"), F.col("row"))
    rows = written(rows.select("source", "size", high.alias("high"), low.alias("low")), "sizes")
    state = balanced_rates(source_targets(rows, weights, max_rate))
    state = state.withColumn("base", F.least(F.floor(F.col("rate") + 1e-9), F.lit(max_rate)).cast("bigint"))
    missing = F.greatest(F.col("target") - F.col("base") * F.col("source_size"), F.lit(0.0))
    state = written(state.withColumn("missing", missing), "mix")
    sources = state.count()
    for at in range(PASSES):
        state = _with_prefix(rows, state, at, sources)
    return Mix(state, PASSES, _filled(rows, state, PASSES, max_rate))


def _filled(rows: DataFrame, state: DataFrame, passes: int, max_rate: int) -> DataFrame:
    """``high, low, more``: further copies of documents, until none that is allowed fits in what its source misses.

    From the largest size on each source takes as many copies of a size as there are and as fit: afterwards none of
    that size fits or is left, and what is missing only falls.  Which documents of a size is by their random order.
    """
    columns = [name for name in state.columns if name not in ("source_size", "target", "rate")]
    known = small(state.select(*columns).withColumnRenamed("source", "source0"), 300)
    left = rows.join(known, F.col("source").eqNullSafe(F.col("source0")))
    left = left.withColumn("more", F.lit(max_rate) - F.col("base") - _taken(passes).cast("bigint"))
    left = left.filter((F.col("size") > 0) & (F.col("size") <= F.col("missing")) & (F.col("more") > 0))
    left = left.select("source", "size", "high", "low", "more", "missing")
    # A source misses less than its longest document has, so its sizes are few.
    cells = left.groupBy("source", "size").agg(F.sum("more").alias("n"), F.max("missing").alias("missing"))
    quotas = written(cells.groupBy("source").applyInPandas(_largest_first, _quota_schema(rows)), "quotas")
    most = quotas.agg(F.max("quota")).first()[0] or 0
    wanted = small(quotas.withColumnsRenamed({"source": "source0", "size": "size0"}), 64)
    picked = left.join(wanted, F.col("source").eqNullSafe(F.col("source0")) & (F.col("size") == F.col("size0")))
    # No more than the largest quota are looked at of a size: of each part first, then of all.
    part = Window.partitionBy("source", "size", F.pmod("low", F.lit(_PARTS))).orderBy("high", "low")
    picked = picked.withColumn("place", F.row_number().over(part)).filter(F.col("place") <= most)
    order = Window.partitionBy("source", "size").orderBy("high", "low").rowsBetween(Window.unboundedPreceding, -1)
    room = F.greatest(F.col("quota") - F.coalesce(F.sum("more").over(order), F.lit(0)), F.lit(0))
    chosen = picked.select("high", "low", F.least("more", room).cast("bigint").alias("more"))
    return written(chosen.filter("more > 0"), "filled")


def _quota_schema(rows: DataFrame) -> str:
    kind = rows.schema["source"].dataType.simpleString()
    return f"source {kind}, size bigint, quota bigint"


def _largest_first(cells):
    """From a source's sizes, numbers of copies and missing words to the copies it takes of each size."""
    cells = cells.sort_values("size", ascending=False)
    left, quotas = int(cells["missing"].iloc[0]), []
    for size, count in zip(cells["size"], cells["n"], strict=True):
        quota = min(int(count), left // int(size))
        left -= quota * int(size)
        quotas.append(quota)
    cells = cells.assign(quota=quotas)
    return cells[cells["quota"] > 0][["source", "size", "quota"]]


def _with_prefix(rows: DataFrame, state: DataFrame, at: int, sources: int) -> DataFrame:
    """``state`` with the prefix of pass ``at`` of each source, and what is missing after it."""
    # What fits: anything at first, then only documents no larger than what is missing.
    largest = F.lit(float("inf")) if at == 0 else F.col("missing")
    names = {f"high{at}": F.lit(0).cast("bigint"), f"low{at}": F.lit(0).cast("bigint"), f"fits{at}": largest}
    state = written(state.withColumns(names).withColumn("open", F.col("missing") > 0), "mix", sources)
    left = rows
    for level in range(2 * _HALF_LEVELS):
        half, shift = ("high", "low")[level // _HALF_LEVELS], _LEVEL_BITS * (_HALF_LEVELS - 1 - level % _HALF_LEVELS)
        part = F.shiftright(F.col(half), shift).bitwiseAND(F.lit((1 << _LEVEL_BITS) - 1))
        # Rows in the range that the levels so far have left open.
        same = F.shiftright(F.col("high"), shift + _LEVEL_BITS if half == "high" else 0) == F.shiftright(
            F.col(f"high{at}"), shift + _LEVEL_BITS if half == "high" else 0
        )
        if half == "low":
            same &= F.shiftright(F.col("low"), shift + _LEVEL_BITS) == F.shiftright(F.col(f"low{at}"), shift + _LEVEL_BITS)
        known = small(
            state.filter("open").withColumnRenamed("source", "source0").drop("source_size", "target", "rate"), 200
        )
        found = left.join(known, F.col("source").eqNullSafe(F.col("source0")))
        found = found.filter(same & (F.col("size") > 0) & (F.col("size") <= F.col(f"fits{at}")) & ~_taken(at))
        sums = found.groupBy("source", part.alias("part")).agg(
            F.sum("size").alias("words"), F.count("*").alias("n"), F.first("missing").alias("missing")
        )
        order = Window.partitionBy("source").orderBy("part")
        sums = sums.withColumn("until", F.sum("words").over(order))
        # The first range that no longer fits is looked into at the next level.
        ends = sums.groupBy("source").agg(
            F.min_by(
                F.struct("part", "n", (F.col("until") - F.col("words")).alias("before")),
                F.when(F.col("until") > F.col("missing"), F.col("part")),
            ).alias("end"),
            F.max("until").alias("all"),
        )
        ends = ends.select(F.col("source").alias("source0"), "end", "all")
        joined = state.join(small(written(ends, "ends", sources), 64), F.col("source").eqNullSafe(F.col("source0")), "left")
        fits_all = F.col("open") & F.col("end").isNull()
        inside = F.col("open") & F.col("end").isNotNull()
        place = F.shiftleft(F.col("end.part").cast("bigint"), shift)
        changed = {
            half + str(at): F.when(inside, F.col(half + str(at)) + place)
            .when(fits_all & (F.lit(level) == 0), F.lit((1 << 60) if half == "high" else 0))
            .otherwise(F.col(half + str(at))),
            "missing": F.when(inside, F.col("missing") - F.col("end.before"))
            .when(fits_all, F.col("missing") - F.coalesce("all", F.lit(0)))
            .otherwise(F.col("missing")),
            "open": inside & (F.col("end.n") > 1),
        }
        state = written(joined.withColumns(changed).drop("source0", "end", "all"), "mix", sources)
        if not state.filter("open").count():
            break
    return state.drop("open")


def mixed(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    **options,
) -> DataFrame:
    """``docs`` with ``size`` (words), ``source_size``, ``target``, ``rate`` and ``copies``.

    The copies of a source's documents have at most ``target`` words and miss less than any copy that is still
    allowed has; none is taken more than ``max_rate`` times.  Choices are hashes of id, source and text: runs agree, and of equal
    rows it only matters how many get one more copy.  NULL and blank texts have size 0; NULL sources are
    a source, the last one.  Columns with the new names are replaced.  No rows: no rows.
    """
    mix = plan_mix(docs, id_column, text_column, source_column, **options)
    new = ("size", "source_size", "target", "rate", "copies")
    names = [name for name in docs.columns if name.lower() not in new]
    high, low = _levels(
        text_key(col(text_column), col(id_column), col(source_column)), F.monotonically_increasing_id()
    )
    rows = docs.select(
        F.struct(*[col(name) for name in names]).alias("columns"),
        col(source_column).alias("source"),
        word_count(col(text_column)).alias("size"),
        high.alias("high"),
        low.alias("low"),
    )
    sources = small(mix.sources.withColumnRenamed("source", "source0"), 200)
    extra = (F.col("size") > 0) & _taken(mix.passes)
    joined = rows.join(sources, F.col("source").eqNullSafe(F.col("source0")), "left")
    more = small(mix.filled.withColumnsRenamed({"high": "high_", "low": "low_"}), 24)
    joined = joined.join(more, (F.col("high") == F.col("high_")) & (F.col("low") == F.col("low_")), "left")
    return joined.select(
        *[F.col("columns")[name].alias(name) for name in names],
        "size",
        "source_size",
        "target",
        "rate",
        (F.col("base") + extra.cast("bigint") + F.coalesce("more", F.lit(0))).cast("bigint").alias("copies"),
    )


def repeated(docs: DataFrame, **options) -> DataFrame:
    """Every row of ``docs`` as often as the mix takes it, columns unchanged."""
    [row] = fresh(docs.columns, "row")
    names = {"id_column": "doc_id", "text_column": "text", "source_column": "source"}
    names.update({key: options.pop(key) for key in names if key in options})
    packed = docs.select(
        col(names["id_column"]).alias("doc_id"),
        col(names["text_column"]).alias("text"),
        col(names["source_column"]).alias("source"),
        F.struct(*[col(name) for name in docs.columns]).alias(row),
    )
    taken = mixed(packed, **options).filter("copies > 0")
    taken = taken.select(col(row), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return taken.select(*[col(row)[name].alias(name) for name in docs.columns])
