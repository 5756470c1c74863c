"""Near-duplicate documents by min-max hashing.

Each permutation of the shingles gives two signature values, its smallest and its
largest, so that a signature needs half the hash evaluations.  Both agree for two
sets with a probability equal to their similarity; bands of these values find candidates,
which are confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsgauge.llm.components import components
from opsgauge.llm.shared import bounded_batches, col, fresh, small, text_key, written
from opsgauge.llm.wordhash import LOWER, chunks, mixed, random_values, windows

SHINGLE_WORDS = 5
# 32 bands of 5 values: a pair at similarity 0.8 is missed with a probability of 3e-6.
BANDS, BAND_VALUES = 32, 5
SIMILAR_PERCENT = 80
# Members of a bucket that all others are compared with in a round; rounds go on while
# there are more pairs for each member than may be compared in blocks.
STARS, BLOCK_PAIRS = 3, 2000
# A bucket with more pairs for each member is compared in blocks of so many members.
LIGHT_PAIRS, BLOCK_ROWS = 2, 256

_SIGNED = "struct<n:bigint,key1:bigint,key2:bigint,bands:array<bigint>>"


def _shingle_sets(column: pa.Array, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """The row number and sorted distinct shingles of each row."""
    for low, high, hashes, firsts in chunks(column, LOWER):
        grams = windows(hashes, length)
        for row in range(low, high):
            start, end = firsts[row - low], firsts[row - low + 1]
            if end - start >= length:
                yield row, np.unique(grams[start : end - length + 1])
            elif end > start:
                # Fewer words than a shingle: the whole sequence is one.
                yield row, windows(hashes[start:end], int(end - start), seed=4)
            else:
                yield row, np.zeros(0, np.uint64)


def _as_rows(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(offsets, pa.array(values.view(np.int64)))


def _signer(length: int, bands: int, band_values: int):
    """An Arrow function from texts to set sizes, set keys and bands."""

    def sign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        permutations = (bands * band_values + 1) // 2
        factors = random_values(5, permutations) | np.uint64(1)
        shifts = random_values(6, permutations)
        turns = random_values(7, bands * band_values).reshape(bands, band_values) | np.uint64(1)
        names = random_values(8, bands)
        for texts in batches:
            sizes, key1, key2, signed = [], [], [], []
            for _, grams in _shingle_sets(texts, length):
                sizes.append(len(grams))
                key1.append(mixed(grams).sum(dtype=np.uint64))
                key2.append(mixed(grams ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
                if not len(grams):
                    signed.append(grams)
                    continue
                low = np.full(permutations, np.iinfo(np.uint64).max, np.uint64)
                high = np.zeros(permutations, np.uint64)
                for at in range(0, len(grams), 512):
                    turned = factors[:, None] * grams[None, at : at + 512] + shifts[:, None]
                    np.minimum(low, turned.min(axis=1), out=low)
                    np.maximum(high, turned.max(axis=1), out=high)
                both = np.concatenate([mixed(low), mixed(~high)])[: bands * band_values]
                signed.append(mixed((both.reshape(bands, band_values) * turns).sum(axis=1, dtype=np.uint64) ^ names))
            yield pa.StructArray.from_arrays(
                [
                    pa.array(sizes, pa.int64()),
                    pa.array(np.array(key1, np.uint64).view(np.int64)),
                    pa.array(np.array(key2, np.uint64).view(np.int64)),
                    _as_rows(signed),
                ],
                ["n", "key1", "key2", "bands"],
            )

    sign.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(sign, _SIGNED)


def _set_reader(length: int):
    """An Arrow function from texts to their shingle sets."""

    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield _as_rows([grams for _, grams in _shingle_sets(texts, length)])

    read.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(read, "array<bigint>")


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    percent: int = SIMILAR_PERCENT,
    bands: int = BANDS,
    band_values: int = BAND_VALUES,
) -> DataFrame:
    """One row per document: ``id, text_key, n_shingles, component_id, first``.

    Documents whose sets of word shingles have ``percent`` of their union in common are
    linked; a component is what links reach.  ``component_id`` is its smallest id, ``first``
    tells whether the row names its component.  Equal sets are one node, so copies never form
    pairs; members of a shared band are first compared with one of them, and pairs are formed only
    between members that are still apart.

    NULL text, empty text and blanks: no shingles, linked with nothing.  Fewer words than a
    shingle: the whole sequence is one.  NULL ids come last and name a component only if
    no member has an id.  Rows with equal id and text are one document, each is returned.  Other
    columns are not read.  No rows: no rows.
    """
    bounded_batches(docs.sparkSession)
    signed = docs.select(
        col(id_column).alias("id"),
        text_key(col(text_column)).alias("text_key"),
        _signer(shingle_words, bands, band_values)(col(text_column)).alias("s"),
    )
    signed = written(signed.select("id", "text_key", "s.*"), "signed")
    named = F.struct(F.col("id").isNull().alias("noid"), "id", "text_key")
    nodes = (
        signed.filter("n > 0")
        .groupBy("key1", "key2")
        .agg(F.min(named).alias("first"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands"))
    )
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    roots = _roots(docs, id_column, text_column, nodes, shingle_words, percent)
    placed = nodes.select("node", "key1", "key2", "first").join(roots, "node", "left")
    placed = placed.select("key1", "key2", "first", F.coalesce("root", "node").alias("root"))
    placed = written(placed, "placed", nodes.count())
    leaders = written(placed.groupBy("root").agg(F.min("first").alias("leader")), "leaders", placed.count())
    classes = placed.join(leaders, "root").select("key1", "key2", "leader")
    return (
        signed.select("id", "text_key", "n", "key1", "key2")
        .join(classes, ["key1", "key2"], "left")
        .select(
            "id",
            "text_key",
            F.col("n").alias("n_shingles"),
            F.when(F.col("leader").isNull(), F.col("id")).otherwise(F.col("leader.id")).alias("component_id"),
            (
                F.col("leader").isNull()
                | (F.col("id").eqNullSafe(F.col("leader.id")) & (F.col("text_key") == F.col("leader.text_key")))
            ).alias("first"),
        )
    )


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, the one of the smallest id; columns unchanged.

    Of rows with equal id and text one stays, too; texts without words are no duplicates.
    """
    found = near_duplicates(docs, id_column, text_column, **options)
    found = written(found.select(F.col("id").alias("id0"), F.col("text_key").alias("key0"), "first", "n_shingles"), "decided")
    gone = written(found.filter("NOT first").select("id0", "key0").distinct(), "gone")
    again = found.filter("first AND n_shingles > 0").groupBy("id0", "key0").agg(F.count("*").alias("n")).filter("n > 1")
    again = written(again.select("id0", "key0"), "again")
    same = col(id_column).eqNullSafe(F.col("id0")) & (text_key(col(text_column)) == F.col("key0"))
    kept = docs.join(small(gone, 24), same, "left_anti")
    if again.isEmpty():
        return kept
    [key] = fresh(docs.columns, "key")
    once = kept.join(small(again, 24), same, "left_semi").withColumn(key, text_key(col(text_column)))
    once = once.dropDuplicates([id_column, key]).drop(key)
    return kept.join(small(again, 24), same, "left_anti").union(once)


def _roots(
    docs: DataFrame, id_column: str, text_column: str, nodes: DataFrame, shingle_words: int, percent: int
) -> DataFrame:
    """``node, root``: the components that links between similar nodes make."""
    members = _members(nodes.select("node", F.explode("bands").alias("bucket")))
    involved = written(
        members.select("node").distinct().join(nodes.select("node", "first"), "node").select("node", "first.*"),
        "involved",
    )
    one, key, text = fresh([id_column, text_column], "node", "key", "text")
    texts = (
        docs.select(col(id_column).alias("id"), text_key(col(text_column)).alias("text_key"), col(text_column).alias("body"))
        .join(
            small(involved.select("node", F.col("id").alias("id0"), F.col("text_key").alias("text_key0")), 32),
            F.col("id").eqNullSafe(F.col("id0")) & (F.col("text_key") == F.col("text_key0")),
        )
        .groupBy("node")
        .agg(F.any_value("body").alias("body"))
    )
    sets = written(texts.select("node", _set_reader(shingle_words)("body").alias("grams")), "sets")

    # Two bands together hold mostly documents that are truly similar: these join first.
    evens = F.sequence(F.lit(0), F.size("bands") - 2, F.lit(2))
    fine = F.transform(evens, lambda at: F.xxhash64(F.get("bands", at), F.get("bands", at + 1), at))
    close = nodes.join(involved.select("node"), "node", "left_semi").filter(F.size("bands") > 1)
    close = _members(close.select("node", F.explode(fine).alias("bucket")))
    shared = close.filter("node != pivot").groupBy("node", "pivot").agg(F.count("*").alias("times"))
    best = shared.groupBy("node").agg(F.max_by("pivot", F.struct("times", -F.col("pivot"))).alias("pivot"))
    best = best.select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    roots = components(written(_confirmed(best, sets, percent), "confirmed"))
    # Then all that share a band.
    roots, apart = _star_rounds(members, roots, sets, percent)
    if apart is None:
        return roots
    pairs = _light_pairs(apart.filter("pairs <= size * " + str(LIGHT_PAIRS)))
    pairs = pairs.select(F.greatest("node", "node2").alias("a"), F.least("node", "node2").alias("b")).distinct()
    found = _confirmed(pairs, sets, percent)
    found = found.union(_block_links(apart.filter("pairs > size * " + str(LIGHT_PAIRS)), sets, percent))
    return _joined_roots(roots, written(found, "confirmed"))


def _light_pairs(light: DataFrame) -> DataFrame:
    """``node, node2, root, root2``: members of a bucket with different roots.

    Members outside the bucket's largest root meet all others, so those already joined in it never meet each other.
    """
    outside = light.filter("root != top").select("bucket", "node", "root", "top")
    other = light.select("bucket", F.col("node").alias("node2"), F.col("root").alias("root2"))
    return outside.join(other, "bucket").filter("root2 = top or root < root2").select("node", "node2", "root", "root2")


def _block_links(heavy: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that join what is apart in buckets with many pairs: every two blocks of members are compared in a task.

    A task holds two blocks and returns at most one link for each of their members.
    """
    blocks = F.ceil(F.col("size") / BLOCK_ROWS).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    cells = F.transform(
        F.sequence(F.lit(0), blocks - 1),
        lambda other: F.struct(F.least(own, other).alias("i"), F.greatest(own, other).alias("j")),
    )
    rows = heavy.select("bucket", "node", "root", F.explode(cells).alias("cell")).join(sets, "node")
    rows = rows.select("bucket", "cell.*", "node", "root", "grams")

    def compare(table: pa.Table) -> pa.Table:
        nodes, roots = table["node"].to_numpy(), table["root"].to_numpy()
        grams = table["grams"].combine_chunks()
        values, cuts = grams.values.to_numpy(zero_copy_only=False), grams.offsets.to_numpy()
        sizes = np.diff(cuts)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        _, place, times = np.unique(values[cuts[0] : cuts[-1]], return_inverse=True, return_counts=True)
        # What only one set has adds nothing to an intersection.
        number = np.cumsum(times > 1) - 1
        shared = times[place] > 1
        owner, place = owner[shared], number[place[shared]]
        both = np.zeros((len(sizes), len(sizes)), np.float32)
        order = np.argsort(place, kind="stable")
        owner, place = owner[order], place[order]
        for low in range(0, int(place[-1]) + 1 if len(place) else 0, 4096):
            part = slice(*np.searchsorted(place, [low, low + 4096]))
            has = np.zeros((len(sizes), 4096), np.float32)
            has[owner[part], place[part] - low] = 1
            both += has @ has.T
        both = both.astype(np.int64)
        alike = both * 100 >= (sizes[:, None] + sizes[None, :] - both) * percent
        alike &= roots[:, None] != roots[None, :]
        found: dict[int, int] = {}

        def top(root: int) -> int:
            while root in found:
                root = found[root]
            return root

        links = []
        for x, y in zip(*np.nonzero(np.triu(alike, 1)), strict=True):
            a, b = top(int(roots[x])), top(int(roots[y]))
            if a != b:
                found[max(a, b)] = min(a, b)
                links.append((int(nodes[x]), int(nodes[y])))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return rows.groupBy("bucket", "i", "j").applyInArrow(compare, "a bigint, b bigint")


def _members(listed: DataFrame) -> DataFrame:
    """The rows of ``node, bucket`` whose bucket has more than one node, with its smallest as ``pivot``."""
    pivots = listed.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count("*").alias("size")).filter("size > 1")
    return written(listed.join(written(pivots.select("bucket", "pivot"), "pivots"), "bucket"), "members")


def _star_rounds(
    members: DataFrame, roots: DataFrame, sets: DataFrame, percent: int
) -> tuple[DataFrame, DataFrame | None]:
    """Compare the members of a bucket with some of them, until few enough pairs are apart or no more join.

    The new roots, and ``bucket, node, root, size, pairs`` of the buckets whose members are still apart.
    """
    rows, before, turn = members.count(), None, 0
    while True:
        placed = members.select("bucket", "node").join(roots, "node", "left")
        placed = written(placed.select("bucket", "node", F.coalesce("root", "node").alias("root")), "placed", rows)
        groups = placed.groupBy("bucket", "root").agg(
            F.count("*").alias("size"), F.min_by("node", F.xxhash64("node", F.lit(turn))).alias("pivot")
        )
        size = F.col("size").cast("double")
        stars = [F.min_by(F.struct("pivot", "root"), F.xxhash64("pivot", F.lit(turn), F.lit(at))) for at in range(STARS)]
        apart = groups.groupBy("bucket").agg(
            F.count("*").alias("groups"),
            F.sum("size").alias("size"),
            ((F.sum(size) * F.sum(size) - F.sum(size * size)) / 2).alias("pairs"),
            F.array_distinct(F.array(F.max_by(F.struct("pivot", "root"), "size"), *stars)).alias("stars"),
        )
        apart = written(apart.filter("groups > 1"), "apart", rows)
        in_apart, pairs = apart.agg(F.sum("size"), F.sum("pairs")).first()
        if not in_apart:
            return roots, None
        if pairs <= BLOCK_PAIRS * rows or (before is not None and pairs > 0.8 * before):
            rest = placed.join(apart.select("bucket", "size", "pairs", F.get("stars", F.lit(0))["root"].alias("top")), "bucket")
            return roots, written(rest, "rest", rows)
        star = placed.join(apart.select("bucket", "stars"), "bucket")
        star = star.select("node", "root", F.explode("stars").alias("star")).filter("root != star.root")
        star = star.select(F.greatest("node", "star.pivot").alias("a"), F.least("node", "star.pivot").alias("b"))
        found = written(_confirmed(star.distinct(), sets, percent), "confirmed")
        roots = _joined_roots(roots, found)
        turn, before = turn + 1, pairs


def _joined_roots(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The components of known ones (``node, root``) and more links (``a, b``)."""
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links.select("a", "b")))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets are similar enough."""
    return (
        pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("grams_a")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("grams").alias("grams_b")), "b")
        .withColumn("both", F.size(F.array_intersect("grams_a", "grams_b")))
        .withColumn("all", F.size("grams_a") + F.size("grams_b") - F.col("both"))
        .filter(F.col("both") * 100 >= F.col("all") * percent)
        .select("a", "b")
    )
