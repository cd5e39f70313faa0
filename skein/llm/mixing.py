"""Mixing sources to target weights: repetition rates by source, whole copies and one hash-seeded Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import SPACE_CLASS, documents, whole_text
from skein.session import checkpointed, with_ordinal

#: Weights of the sources in their order, repeating; the share of all sizes that the mix has; the most copies of a source.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Sources of a range whose sums are running ones.
PART = 1 << 16


def words(text: str = "text") -> Column:
    return F.regexp_count(whole_text(text), F.lit(f"[^{SPACE_CLASS}]+")).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sizes: source, source_size. Adds target and rate.

    The budget is share times all sizes. A source gets its weight's part of it up to most times its size; the excess is shared
    by weight among the others until none is above. With sources ordered by most * size / weight, those that stop are a prefix,
    so one pass over running sums finds the level at which the rest is shared. One row per source: a table as long as the
    number of sources, not of documents.
    """
    # Sums in an order come from sums over ranges of it: no window goes over all sources.
    everything = sizes.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("all")).first()["all"]
    ranked = with_ordinal(sizes, [F.col("source").asc_nulls_last()], "rank")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.lit(int(most)) * F.col("source_size")).withColumn("stop_at", F.col("cap") / F.col("weight"))
    placed = with_ordinal(ranked, [F.col("stop_at"), F.col("rank")], "turn").withColumn("part", F.floor(F.col("turn") / PART))
    parts = placed.groupBy("part").agg(F.sum("cap").alias("part_cap"), F.sum("weight").alias("part_weight"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("part_cap").over(before), F.lit(0)).alias("cap_before"), F.coalesce(F.sum("part_weight").over(before), F.lit(0)).alias("weight_before"))
    all_weight = placed.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("all")).first()["all"]
    within = Window.partitionBy("part").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        placed.join(parts, "part")
        .withColumn("left", F.lit(share) * F.lit(everything) - F.col("cap_before") - F.coalesce(F.sum("cap").over(within), F.lit(0)))
        .withColumn("left_weight", F.lit(all_weight) - F.col("weight_before") - F.coalesce(F.sum("weight").over(within), F.lit(0)))
    )
    # A source stops if, at its turn, its part of what is left reaches its cap. The first that doesn't sets the level;
    # further on, ever more than the level's part is taken away, so the first has the largest quotient of those.
    open_ = F.when(F.col("left") / F.col("left_weight") < F.col("stop_at"), F.col("left") / F.col("left_weight"))
    level = ranked.agg(F.max(open_).alias("level")).first()["level"]
    shared = ranked.withColumn("level", F.lit(level).cast("double"))
    capped = F.col("level").isNull() | (F.col("stop_at") <= F.col("level"))
    target = F.when(capped, F.col("cap").cast("double")).otherwise(F.least(F.col("level") * F.col("weight"), F.col("cap").cast("double")))
    rate = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.col("target") / F.col("source_size"))
    return shared.withColumn("target", target).withColumn("rate", rate).select("source", "source_size", "target", "rate")


def uniform(id: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


#: The columns that mix adds.
ADDED = ("size", "source_size", "target", "copies")


def mix(docs: DataFrame, text: str = "text", id: str = "doc_id", source: str = "source", seed: str = "mix", **how) -> DataFrame:
    """docs with the columns size, source_size, target and copies (names given to clash with columns of docs replace those).

    A document is taken floor(rate) times, and once more with the fraction's probability, decided by a hash of its id: reruns
    agree, and rows that repeat an id share the decision. Null texts have size 0; a null source is a source of its own, the last;
    a source without words has the rate 0. An empty table gives no rows.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ADDED])
    # The row is carried as one column, so that its names can't meet those used here.
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id).alias("_id"), F.col(source).alias("_source"), words(text).alias("size"))
    sizes = checkpointed(rows.groupBy(F.col("_source").alias("source")).agg(F.sum("size").alias("source_size")))
    # One row per source, as wide as a name: joined by Spark's own size rule, so many sources shuffle instead of being broadcast.
    rates = targets(sizes, **how)
    whole = F.floor("rate")
    copies = (whole + (uniform(F.col("_id"), seed) < F.col("rate") - whole).cast("long")).cast("long")
    found = rows.join(rates, F.col("_source").eqNullSafe(F.col("source")))
    return found.select(*[F.col("_row")[c].alias(c) for c in docs.columns], "size", "source_size", "target", copies.alias("copies"))


def emit(mixed: DataFrame) -> DataFrame:
    """Each document as often as the mix takes it, without the columns that mix adds."""
    shown = [c for c in mixed.columns if c not in ADDED]
    taken = mixed.filter("copies > 0").select(F.struct(*shown).alias("_row"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return taken.select(*[F.col("_row")[c].alias(c) for c in shown])


def op6(spark, sf_dir: str) -> DataFrame:
    mixed = mix(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP6_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
  FROM sizes),
running AS (
  SELECT *, 2 * source_size AS cap, (2 * source_size)::DOUBLE / weight AS stop_at,
         1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER w, 0)::DOUBLE AS left_size,
         (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::DOUBLE AS left_weight
  FROM ranked
  WINDOW w AS (ORDER BY (2 * source_size)::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
leveled AS (
  SELECT *, max(CASE WHEN left_size / left_weight < stop_at THEN left_size / left_weight END) OVER () AS level FROM running),
rates AS (
  SELECT source, source_size,
         CASE WHEN level IS NULL OR stop_at <= level THEN cap::DOUBLE ELSE least(level * weight, cap::DOUBLE) END AS target FROM leveled),
drawn AS (
  SELECT r.doc_id, r.size, t.source_size, t.target,
         CASE WHEN t.source_size = 0 THEN 0 ELSE t.target / t.source_size END AS rate,
         ('0x' || substr(md5('mix:' || coalesce(r.doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw
  FROM rows r JOIN rates t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       ((floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM drawn
"""
