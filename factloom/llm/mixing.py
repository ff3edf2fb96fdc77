"""Mixing sources to target weights by Pareto order sampling, with DataFrame operations only.

A mix takes ``share`` times all words. Every source gets a part of it by its weight, but at most
``most`` times its own words; what a source can't take goes to the others by their weights. A document
of e expected copies gets floor(e) certain whole copies. For the fraction p that is left, documents are
ranked by (u / (1 - u)) / (p / (1 - p)), u being a hash of seed and doc_id, and taken in that order until
the source has its target: a sample of fixed size in words. The row at which the target is passed is
taken if that brings the source nearer to it.

Nothing needs a whole source in one task: words are summed by (source, slice of the ranking) and then by groups of GROUP slices. The group in which the
target is reached is found from the groups' sums, the slice from those of its slices, and only that slice's rows are put in order.
The slice is that of q / (1 + q) for the rank q; around q = 1, where the target is reached, a slice holds
at most about 1/SLICES of a source's rows, whatever p is. The targets themselves order one row a source.

Defined results: null and empty texts have size 0; a null source is a source of its own, the last by name; rows of
one doc_id and size tie and are taken or left together, null doc_ids as well; a very long text is taken whole or left; an empty table gives an
empty mix; a source without words has target 0; other columns pass through whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import checkpointed

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SLICES, GROUP = 65536, 256
SEED = "mix"
#: A table of one row a source is broadcast up to so many rows (about 10 MB), and joined by shuffle beyond.
BROADCAST_ROWS = 100_000


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(key: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) from a hash of seed and key, the same in every run."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, weight, target from (source, source_size), one row a source.

    The capped sources are those of the least source_size / weight: in that order, a source is capped if its part
    of what the sources before it leave is at least its cap. The level at the first that isn't holds for the rest.
    The windows run over one row a source, never over documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, everything = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nth = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    level = (F.sum("source_size").over(everything) * share - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    cap = (most * F.col("source_size")).cast("double")
    return (
        sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (nth + 1).cast("int")))
        .withColumn("level", level)
        .withColumn("capped", F.col("weight") * F.col("level") >= cap)
        .withColumn("shared", F.max(F.when(~F.col("capped"), F.col("level"))).over(everything))
        .select("source", "source_size", "weight", F.when(F.col("capped"), cap).otherwise(F.col("weight") * F.col("shared")).alias("target"))
    )


def with_source(rows: DataFrame, table: DataFrame, n: int) -> DataFrame:
    """rows with the struct _mix of a table of n rows, one a source."""
    other = table.select(F.col("source").alias("_of_source"), F.struct(*[c for c in table.columns if c != "source"]).alias("_mix"))
    return rows.join(F.broadcast(other) if n <= BROADCAST_ROWS else other, rows["source"].eqNullSafe(other["_of_source"]), "left").drop("_of_source")


def whole_copies() -> Column:
    """Certain copies of each of a source's documents."""
    return F.coalesce(F.floor("_mix.expected"), F.lit(0)).cast("long")


def rank(seed: str) -> Column:
    """Odds of a random number over the odds of inclusion; null where no fraction is left to sample."""
    u, p = uniform(F.col("doc_id"), seed), F.col("_mix.expected") - F.floor("_mix.expected")
    return F.when(p > 0, F.try_divide(u / (1 - u), p / (1 - p)))


def slice_of(q: Column) -> Column:
    return F.floor(SLICES * (q / (1 + q)))


def selection(sized: DataFrame, weights: tuple[int, ...], share: float, most: int, seed: str) -> tuple[DataFrame, int]:
    """One row a source: its size, target, expected copies of a document, and the last rank that is taken; and the number of rows."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(totals, weights, share, most)
    targets = checkpointed(targets.withColumn("expected", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))))
    n = targets.count()
    ranked = with_source(sized, targets, n).withColumn("q", rank(seed)).filter("q is not null").withColumn("slice", slice_of(F.col("q")))
    sums = checkpointed(ranked.groupBy("source", "slice").agg(F.sum("size").alias("words")))
    group = F.floor(F.col("slice") / GROUP)
    need = F.col("_mix.target") - whole_copies() * F.col("_mix.source_size")

    def reached(parts: DataFrame, part: str) -> DataFrame:
        """Of each source's parts (source, part, words, start, need), the one in which the words from start on reach what it needs."""
        earlier = Window.partitionBy("source").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.withColumn("before", F.col("start") + F.coalesce(F.sum("words").over(earlier), F.lit(0)))
        return parts.filter((F.col("before") < F.col("need")) & (F.col("before") + F.col("words") >= F.col("need"))).select("source", part, "before", "need")

    groups = sums.groupBy("source", group.alias("group")).agg(F.sum("words").alias("words"))
    groups = checkpointed(reached(with_source(groups, targets, n).select("source", "group", "words", F.lit(0).cast("long").alias("start"), need.alias("need")), "group"))
    slices = with_source(sums, groups, n).filter(group == F.col("_mix.group"))
    cut = checkpointed(reached(slices.select("source", "slice", "words", F.col("_mix.before").alias("start"), F.col("_mix.need").alias("need")), "slice"))
    # of the slice in which a source reaches its target, the rows in order; equal ones stay together
    passed = Window.partitionBy("source").orderBy("q", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    last = (
        with_source(ranked.drop("_mix"), cut, n)
        .filter(F.col("slice") == F.col("_mix.slice"))
        .groupBy("source", "q", "doc_id", "size", "_mix")
        .agg(F.sum("size").alias("words"))
        .withColumn("passed", F.col("_mix.before") + F.coalesce(F.sum("words").over(passed), F.lit(0)))
        .filter((F.col("passed") < F.col("_mix.need")) & (F.col("passed") + F.col("words") - F.col("_mix.need") <= F.col("_mix.need") - F.col("passed")))
        .groupBy("source")
        .agg(F.max(F.struct("q", "doc_id", "size")).alias("last"))
    )
    found = with_source(with_source(targets, cut.select("source", "slice"), n).withColumnRenamed("_mix", "_cut"), last, n)
    return checkpointed(found.select(*targets.columns, F.col("_cut.slice").alias("cut"), F.col("_mix.last").alias("last"))), n


def copies(seed: str, size: str) -> Column:
    """Copies of a row that has doc_id, a column with its size, and _mix of selection()."""
    q = rank(seed)
    # where no slice reaches the target, rounding left nothing to cut: all fractions are taken
    more = q.isNotNull() & (
        F.col("_mix.cut").isNull() | (slice_of(q) < F.col("_mix.cut")) | ((slice_of(q) == F.col("_mix.cut")) & F.coalesce(F.struct(q.alias("q"), "doc_id", F.col(size).alias("size")) <= F.col("_mix.last"), F.lit(False)))
    )
    return whole_copies() + F.coalesce(more, F.lit(False)).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (whole copies the mix takes) for every row of docs."""
    sized = checkpointed(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    found, n = selection(sized, weights, share, most, seed)
    return with_source(sized, found, n).select("doc_id", "source", "size", "_mix.source_size", "_mix.target", copies(seed, "size").alias("copies"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The rows of docs, each as many times as the mix takes it. Texts are not shuffled."""
    # the rows themselves are one column, so that none of theirs meets one of ours
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "source", word_count(F.col("text")).alias("size"))
    found, n = selection(checkpointed(rows.select("doc_id", "source", "size")), weights, share, most, seed)
    taken = with_source(rows, found, n).select("row", copies(seed, "size").alias("n")).filter("n > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM totals
), levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 - 2 * CAST(coalesce(sum(source_size) OVER b, 0) AS DOUBLE))
    / (CAST(sum(weight) OVER () AS DOUBLE) - CAST(coalesce(sum(weight) OVER b, 0) AS DOUBLE)) AS level
  FROM weighed
  WINDOW b AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), capped AS (
  SELECT *, weight * level >= 2 * source_size AS capped FROM levels
), targets AS (
  SELECT source, source_size, CASE WHEN capped THEN CAST(2 * source_size AS DOUBLE)
    ELSE weight * max(CASE WHEN NOT capped THEN level END) OVER () END AS target FROM capped
), expected AS (
  SELECT s.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS e,
    (CAST(CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12)) AS BIGINT) AS DOUBLE) + 0.5) / 281474976710656.0 AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), ranked AS (
  SELECT *, CAST(floor(e) AS BIGINT) AS whole, e - floor(e) AS p,
    CASE WHEN e > floor(e) THEN (u / (1 - u)) / ((e - floor(e)) / (1 - (e - floor(e)))) END AS q FROM expected
), summed AS (
  SELECT *, target - whole * source_size AS need,
    CAST(sum(size) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id, size) AS DOUBLE) AS reached,
    CAST(sum(size) OVER (PARTITION BY source, q, doc_id, size) AS DOUBLE) AS words
  FROM ranked
)
SELECT doc_id, size, source_size, target,
  size * (whole + CASE WHEN q IS NOT NULL AND reached - words < need AND reached - need <= need - (reached - words) THEN 1 ELSE 0 END) AS taken
FROM summed
"""
