"""Line deduplication by overlapping three-line windows.

Non-blank lines of a document are numbered; every three consecutive ones (trimmed) form a window. Windows are grouped by a
128-bit hash; the occurrence with the smallest (doc_id with nulls last, row, position) is the first, and the lines of all later
occurrences are removed, overlapping occurrences being merged. Blank lines stay unless the whole document goes.

* null or empty text, or fewer than three non-blank lines: unchanged (no window).
* repeated rows, even with equal ids, are distinct documents: the first keeps its lines.
* very long texts: line arrays are per document; windows are rows, so a window shared by any number of documents is
  pre-aggregated before the shuffle and its occurrences are spread by the skew join.
* extra columns pass through untouched, whatever their names; an empty table gives an empty table.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash128, let, numbered, settle, settled


def line_windows(rows: DataFrame, size: int = 3) -> DataFrame:
    """(uid, id, at array<int> original positions, h) of every window of ``size`` non-blank lines."""
    blank = r"[^\x20\x09-\x0D]"
    cut = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.struct(F.trim(x).alias("x"), i.alias("i"))), lambda s: F.regexp_like(s["x"], F.lit(blank)))

    def of(lines):
        return F.transform(F.when(F.size(lines) < size, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.size(lines) - size)),
                           lambda i: F.struct(F.array(*[F.get(lines, i + k)["i"] for k in range(size)]).alias("at"), hash128(*[F.get(lines, i + k)["x"] for k in range(size)]).alias("h")))

    return rows.select("uid", "id", F.explode(let(cut, of)).alias("w")).select("uid", "id", F.col("w.at").alias("at"), F.col("w.h.a").alias("ha"), F.col("w.h.b").alias("hb"))


def later_positions(windows: DataFrame) -> DataFrame:
    """(uid, gone array<int>): positions covered by a window that has occurred before."""
    place = F.struct(F.col("id").isNull().alias("n"), F.col("id"), F.col("uid"), F.element_at("at", 1).alias("p"))
    repeated = settle(windows.groupBy("ha", "hb").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select("ha", "hb", "first"), "windows")
    later = windows.join(repeated, ["ha", "hb"]).where((F.col("uid") != F.col("first.uid")) | (F.element_at("at", 1) != F.col("first.p")))
    return later.groupBy("uid").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """Per input row: ``row`` (all its columns as a struct), ``text`` without repeated windows, ``n_lines``, ``n_removed``."""
    rows = numbered(docs, [F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.struct(*[docs[c] for c in docs.columns if c != text_col]).alias("row")], "uid", "lines")
    gone = settled(docs.sparkSession, "gone", lambda: later_positions(settle(line_windows(rows, size), "windows")))
    every = F.split("text", "\n")

    def rest(lines):
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")

    # grows with the documents: never broadcast, so that small inputs run the plan that large ones need
    joined = rows.join(gone.hint("merge"), "uid", "left")
    return joined.select("row", F.when(F.col("gone").isNull(), F.col("text")).otherwise(let(every, rest)).alias("text"),
                         F.coalesce(F.size(every), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))


def cleaned(docs: DataFrame, **kw) -> DataFrame:
    """The documents with repeated windows removed; documents of which no word is left go, those without words at first stay."""
    word = r"[^\x20\x09-\x0D]"
    out = dedup_lines(docs, **kw).where((F.col("n_removed") == 0) | F.regexp_like("text", F.lit(word)))
    text_col = kw.get("text_col", "text")
    cols = []
    for c, kind in docs.dtypes:
        if c == text_col:
            cols.append(F.col("text").alias(c))
        elif c == "n_chars":
            cols.append(F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("row")[c]).cast(kind).alias(c))
        else:
            cols.append(F.col("row")[c].alias(c))
    return out.select(*cols)
