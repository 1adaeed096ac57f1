"""Mixing sources to target weights by capped water-filling.

Targets: sources share the total by weight; one above `max_epochs` times its size stops there and
the others share the excess by weight, until none is above. In the order of cap / weight the
sources that stop come first, so the fixed point is read off running sums, without a loop.

Sampling: each document is taken whole as often as the target holds its source's size; the rest
goes to a seeded sample without replacement. Documents of a source are ordered by a seeded hash of
id and size and taken until the rest is used up; the one at the edge is taken in part, so a
source's words meet its target to within one. No source is sorted: sums over 4096 hash ranges find
the range at the edge, sums per hash inside that range find the hash at the edge, all on rows
without texts, and one row per source tells the rest. So texts meet a table of sources, once.

Null text: no words. Null source: a source of its own, last in the order. Null or repeated ids:
such rows are sampled one by one; rows that repeat id and size, should they be at the edge, share
what is left in proportion, rounded down. A source without words has target 0. Texts of any length
are counted whole. An empty table stays empty. Columns of any name are carried, but for `copy` and
`words`, which `sample` replaces; `n_chars`, if there, follows a text that is taken in part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, long_id

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "0"
#: Parts that each source's rows are dealt in where they meet their source's target.
SALTS = 64
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size -> source, source_size, target. One row per source: the windows see sources, not documents."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    given = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("w", F.get(given, (F.row_number().over(order) - 1) % len(weights))).withColumn("cap", max_epochs * F.col("source_size"))
    # Sources in the order in which they stop: the k-th stops if the water level over the k-th and later ones exceeds cap / weight.
    stops = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy()
    before = stops.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(all_rows)
    s = s.withColumn("level", F.try_divide((total - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double"), F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    s = s.withColumn("stopped", F.col("level") * F.col("w") > F.col("cap"))
    # The stopped sources are a prefix; the first that does not stop sets the level of the rest.
    s = s.withColumn("final", F.min(F.when(~F.col("stopped"), F.struct(F.col("cap") / F.col("w"), F.col("source").isNull(), "source", "level"))).over(all_rows)["level"])
    target = F.when(F.col("stopped"), F.col("cap").cast("double")).otherwise(F.coalesce(F.col("final") * F.col("w"), F.lit(0.0)))
    return s.select("source", "source_size", target.alias("target"))


def _key(doc_id: str, size: Column) -> Column:
    parts = [F.lit(f"{SEED}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), size.cast("string")]
    return F.md5(F.concat(*parts).cast("binary"))


def _range() -> Column:
    return F.substring("key", 1, 3).alias("part")


def _shares(sized: DataFrame, weights: Sequence[float], max_epochs: int) -> DataFrame:
    """`sized` (source, size, key) -> a row per source: source_size, target, whole, and the edge: cut_key, cut_left, cut_size."""
    by_range = sized.groupBy("source", _range()).agg(F.sum("size").alias("part_size"))
    targets = water_fill(by_range.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights, max_epochs)
    targets = targets.withColumn("whole", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long"))
    targets = targets.withColumn("rest", (F.floor(F.col("target") + 0.5) - F.col("whole") * F.col("source_size")).cast("long"))

    def at_edge(df: DataFrame, size: str, left: str, order: str) -> DataFrame:
        """The first row of each source, in order, that the `left` words do not cover, with `used`, what they cover before."""
        running = Window.partitionBy("source").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        df = df.withColumn("used", F.coalesce(F.sum(size).over(running), F.lit(0)))
        return df.where((F.col("used") <= F.col(left)) & (F.col("used") + F.col(size) > F.col(left)))

    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    ranges = at_edge(by_range.alias("r").join(targets.alias("t"), same("r", "t")).select("r.*", "rest"), "part_size", "rest", "part")
    ranges = ranges.select("source", "part", (F.col("rest") - F.col("used")).alias("left"))
    inside = sized.withColumn("part", _range()).alias("d").join(ranges.alias("r"), same("d", "r") & (F.col("d.part") == F.col("r.part")))
    keys = inside.groupBy("d.source", "d.key").agg(F.sum("d.size").alias("cut_size"), F.min("r.left").alias("left"))
    cut = at_edge(keys, "cut_size", "left", "key").select("source", F.col("key").alias("cut_key"), (F.col("left") - F.col("used")).alias("cut_left"), "cut_size")
    return targets.alias("t").join(cut.alias("c"), same("t", "c"), "left").select("t.*", "cut_key", "cut_left", "cut_size")


def _taken() -> Column:
    """The words taken of a row (size, key) beside its source's shares; without an edge its rest is all or nothing."""
    before = (F.col("key") < F.col("cut_key")) | (F.col("cut_key").isNull() & (F.col("rest") > 0))
    part = F.expr("size * cut_left div cut_size")
    return F.col("whole") * F.col("size") + F.when(before, F.col("size")).when(F.col("key") == F.col("cut_key"), part).otherwise(F.lit(0))


def _with_shares(rows: DataFrame, shares: DataFrame) -> DataFrame:
    """Each row with its source's shares; every source has `SALTS` rows there, so a large one is dealt to as many tasks."""
    salt = F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")
    dealt = shares.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = rows.withColumn("salt", salt).alias("d").join(dealt.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.salt") == F.col("s.salt")))
    return met.select(*[F.col(f"d.{c}") for c in rows.columns], *[F.col(f"s.{c}") for c in shares.columns if c != "source"])


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """doc_id, size, source_size, target, taken; one row per document."""
    # Written once: counting words is most of the work, and both sums and rows need it.
    sized = keep(docs.select(long_id("doc_id"), "source", n_words().alias("size")).withColumn("key", _key("doc_id", F.col("size"))), "mix")
    return _with_shares(sized, _shares(sized, weights, max_epochs)).select("doc_id", "size", "source_size", "target", _taken().alias("taken"))


def sample(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mix itself: the columns of `docs`, one row per repetition, with `copy` (from 1) and `words` in place of any of those names.

    A partial repetition has the document's first words, joined by one space. `docs` is read twice
    rather than copied, so it should be a table or a plan that gives the same rows again."""
    own = [c for c in docs.columns if c not in ("copy", "words")]
    row = docs.select(F.struct(*own).alias("row"))
    sized = row.select("row", F.col("row.source").alias("source"), n_words("row.text").alias("size"))
    sized = sized.withColumn("key", _key("row.doc_id", F.col("size")))
    shares = _shares(keep(sized.drop("row"), "mix"), weights, max_epochs)
    taken = _with_shares(sized, keep(shares, "shares")).select("row", "size", _taken().alias("taken")).where(F.col("taken") > 0)
    copies = taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    words = F.least(F.col("size"), F.col("taken") - (F.col("copy") - 1) * F.col("size"))
    cut = F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(f"({WORD})"), F.lit(1)), 1, F.greatest(words, F.lit(1)).cast("int")), " ")
    copies = copies.withColumns({"words": words, "new": F.when(words < F.col("size"), cut).otherwise(F.col("row.text"))})
    n_chars = lambda c: F.when(F.col("words") < F.col("size"), F.char_length("new").cast(docs.schema[c].dataType)).otherwise(F.col(f"row.{c}"))
    return copies.select(*[(F.col("new") if c == "text" else n_chars(c) if c == "n_chars" else F.col(f"row.{c}")).alias(c) for c in own], "copy", "words")


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS VARCHAR)) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, 3 * source_size AS cap,
             CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM s),
l AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0) AS DOUBLE) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
      FROM w WINDOW before AS (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT level FROM l WHERE NOT level * w > cap ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN level * w > cap THEN CAST(cap AS DOUBLE) ELSE coalesce((SELECT level FROM f) * w, 0.0) END AS target FROM l),
r AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size) AS BIGINT) END AS whole FROM t),
x AS (SELECT d.doc_id, d.size, r.source_size, r.target, r.whole,
             CAST(floor(r.target + 0.5) AS BIGINT) - r.whole * r.source_size AS rest,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, rest - used)) AS BIGINT) AS taken FROM x
"""
