"""Mixing of sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a share of the total size by its weight, at most ``most`` times its own size; what exceeds that is shared again by
weight. Whole epochs come first: a source whose target is e times its size gives every document floor(e) times. The rest of
the target is drawn without replacement: key = -ln(u) / quality weight, ascending, and a prefix sum of sizes up to the rest; a document is
drawn if at least half of it lies below the rest. u comes from an MD5 of id and text, so runs agree.

* null text: size 0, taken 0; null source: a source of its own, last in order; null id: hashed as such.
* repeated rows draw the same key and count each; ties go by text hash, then row.
* a weight that is null, NaN or not positive counts as the smallest weight, 1e-6.
* a hot source is cut into buckets of the key; prefix sums run inside a bucket and over the bucket totals. An empty table gives an empty table.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, n_words, numbered, settle, settled, unit


def targets(sizes: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), most: float = 3.0) -> DataFrame:
    """``sizes`` (source, source_size): adds ``target``. One row a source, so the windows over all sources are small."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    capped = sizes.select("source", "source_size", w.alias("w")).withColumn("cap", F.lit(most) * F.col("source_size")).withColumn("r", F.col("cap") / F.col("w"))
    by = Window.orderBy("r", F.col("source").isNull(), "source")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    lam = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    level = capped.withColumn("lam", lam)
    # the first source in order that stays below its cap fixes the level
    first = F.min(F.when(F.col("lam") <= F.col("r"), F.struct(F.col("r"), F.col("lam")))).over(whole)["lam"]
    return level.withColumn("level", first).select("source", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("w")), F.col("cap")).alias("target"))


def lexical_quality(text: Column) -> Column:
    """Weight of a document between 0.5 and 1.5: share of ASCII and Latin letters among its characters, junk weighs less."""
    t = F.coalesce(text, F.lit(""))
    return F.lit(0.5) + F.coalesce((F.length(t) - F.length(F.regexp_replace(t, r"[A-Za-z\x{C0}-\x{24F}]+", ""))).cast("double") / F.nullif(F.length(t), F.lit(0)), F.lit(0.0))


def draw(base: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), most: float = 3.0, per_bucket: int = 50_000) -> DataFrame:
    """``base`` (uid, id, source, size, quality, tie): adds source_size, target and copies. Settled input is expected."""
    sizes = settle(targets(base.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")), weights, most), "sizes")
    rows = base.count()
    buckets = max(1, -(-rows // per_bucket))
    q = F.when(F.isnan("quality") | (F.col("quality") <= 0), F.lit(1e-6)).otherwise(F.coalesce("quality", F.lit(1e-6)))
    key = -F.log(unit(F.col("id"), F.col("tie"))) / q
    keyed = base.withColumn("key", key).withColumn("bucket", F.least(F.floor((F.lit(1.0) - F.exp(-F.col("key"))) * buckets), F.lit(buckets - 1)))
    same = F.struct(F.col("source").isNull().alias("n"), F.coalesce("source", F.lit("")).alias("s"))
    keyed = keyed.withColumn("src", same)
    part = keyed.groupBy("src", "bucket").agg(F.sum("size").alias("bucket_size"))
    part = part.withColumn("start", F.coalesce(F.sum("bucket_size").over(Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # three-level sums are not needed: a source has rows / per_bucket buckets
    start = part.join(sizes.withColumn("src", same).drop("source"), "src").select("src", "bucket", "start", "source_size", "target")
    inner = Window.partitionBy("src", "bucket").orderBy("key", "tie", "uid").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.join(start, ["src", "bucket"]).withColumn("before", F.col("start") + F.coalesce(F.sum("size").over(inner), F.lit(0)))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("target") - epochs * F.col("source_size")
    drawn = (F.col("size") > 0) & (F.col("before") + F.col("size") / 2 <= rest)
    return placed.withColumn("copies", (epochs + F.when(drawn, 1).otherwise(0)).cast("int")).drop("src", "bucket", "start", "before", "key")


def _row(docs: DataFrame) -> Column:
    return F.struct(*[docs[c] for c in docs.columns]).alias("row")


def _base(held: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality: Column | None = None) -> DataFrame:
    """``quality`` is an expression over ``text``; by default ``lexical_quality``."""
    rows = held.select("uid", F.col("row")[id_col].alias("id"), F.col("row")[source_col].alias("source"), F.col("row")[text_col].alias("text"))
    return settle(rows.select("uid", "id", "source", n_words(F.col("text")).alias("size"), (lexical_quality(F.col("text")) if quality is None else quality).alias("quality"),
                              F.md5(F.coalesce("text", F.lit("\\N"))).alias("tie")), "mix")


def mix(docs: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), most: float = 3.0, **cols) -> DataFrame:
    """Per document: id, source, size, source_size, target, copies."""
    return draw(_base(docs.select(F.monotonically_increasing_id().alias("uid"), _row(docs)), **cols), weights, most)


def mixed(docs: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), most: float = 3.0, **cols) -> DataFrame:
    """The mixture itself: every document as often as it is taken."""
    held = numbered(docs, [_row(docs)], "uid", "docs")
    copies = settled(docs.sparkSession, "copies", lambda: draw(_base(held, **cols), weights, most).select("uid", "copies").where("copies > 0"))
    # grows with the documents: never broadcast, so that small inputs run the plan that large ones need
    return held.join(copies.hint("merge"), "uid").withColumn("n", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


SQL = rf"""
WITH b AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size, md5(coalesce(text, '\N')) AS tie,
                  0.5 + coalesce(len(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{24F}}]'))::DOUBLE / nullif(length(text), 0), 0.0) AS quality,
                  row_number() OVER () AS uid FROM documents),
k AS (SELECT *, -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '\N') || '|' || tie), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / quality AS key FROM b),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM b GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::DOUBLE AS w, 3.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, cap / w AS r, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lam FROM w),
t AS (SELECT source, source_size, coalesce(least(cap, w * (SELECT lam FROM l WHERE lam <= r ORDER BY r, source IS NULL, source LIMIT 1)), cap) AS target FROM l),
p AS (SELECT k.*, t.source_size, t.target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs,
             coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, tie, uid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       CAST(size * (epochs + CASE WHEN size > 0 AND before + size / 2 <= target - epochs * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM p
"""
