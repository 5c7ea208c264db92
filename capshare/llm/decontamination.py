"""Benchmark decontamination: one Aho-Corasick automaton over the normalised windows of the test items, documents scanned once.

A text is normalised to its words (A-Z lower-cased; ASCII letters, digits and everything beyond ASCII form words), one space before and after each.
A window is ``size`` consecutive words of an item, or the whole item if it has fewer. Windows are patterns with their spaces, so matches begin and end
at words. Offsets of matches lead back to characters of the original text.

The automaton is built in each Python worker from a broadcast list of windows of at most about ``max_chars`` characters (50 bytes a character in
memory). A larger benchmark is dealt by hash to several such lists, and documents are scanned once for each: the time grows with the benchmark, memory does not.
Documents are not shuffled, unless there are several lists; then only found places meet by row number.

* null or empty text: no words, not contaminated. An item without words has no window; a null item_id counts as an item named ''.
* rows that repeat an item_id are one item; rows that repeat a doc_id stay separate rows.
* empty documents: empty result. Empty benchmark: nothing is contaminated. Extra columns are ignored, whatever their names.
"""
from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, settle

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What each byte of UTF-8 becomes: lower case, or a space outside words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SPAN = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
SCHEMA = "uid long, id {kind}, n_words long, spans array<struct<first: long, last: long, start: long, end: long>>, items array<string>"


def windows(benchmark: DataFrame, size: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (item, window): the window as `` w1 w2 ... wn ``."""
    found = F.regexp_extract_all(F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, UPPER.lower()), F.lit(WORD), 0)
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), found.alias("w")).where(F.size("w") > 0)
    at = items.withColumn("at", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))))
    return at.select("item", F.concat(F.lit(" "), F.array_join(F.slice("w", F.col("at"), size), " "), F.lit(" ")).alias("window")).distinct()


class Scanner:
    """The automaton of a list of (window, item)."""

    def __init__(self, pairs: list[tuple[str, str]]):
        import ahocorasick
        items: dict[str, list[str]] = {}
        for window, item in pairs:
            items.setdefault(window, []).append(item)
        self.automaton = ahocorasick.Automaton() if items else None
        for window, of in items.items():
            self.automaton.add_word(window, (window.count(" ") - 1, of))
        if items:
            self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[dict], list[str]]:
        """Number of words, maximal runs of hit words (word numbers from 0, ``last`` included; characters of the text, ``end`` excluded) and the items met."""
        raw = (text or "").encode("utf-8", "surrogatepass")
        words = raw.translate(FOLD).split()
        if not words or self.automaton is None:
            return len(words), [], []
        flat = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
        ends, lengths, met, seen = [], [], set(), set()
        for end, (n, items) in self.automaton.iter(flat):
            ends.append(end)
            lengths.append(n)
            if id(items) not in seen:       # lists live as long as the automaton
                seen.add(id(items))
                met.update(items)
        if not ends:
            return len(words), [], []
        # the space at a window's end is that behind its last word
        spaces = np.flatnonzero(np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), "<u4") == 32)
        last = np.searchsorted(spaces, np.array(ends)) - 1
        runs = merged(np.column_stack([last - np.array(lengths) + 1, last]))
        kept = np.frombuffer(raw.translate(FOLD), np.uint8) != 32
        starts = np.flatnonzero(kept & ~np.concatenate([[False], kept[:-1]]))
        stops = np.flatnonzero(kept & ~np.concatenate([kept[1:], [False]])) + 1
        char = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])     # characters before each byte
        return len(words), [{"first": int(a), "last": int(b), "start": int(char[starts[a]]), "end": int(char[stops[b]])} for a, b in runs], sorted(met)


def merged(runs: np.ndarray) -> np.ndarray:
    """Rows (first, last) as maximal disjoint runs, in order."""
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    upto = np.maximum.accumulate(runs[:, 1])
    new = np.concatenate([[True], runs[1:, 0] > upto[:-1] + 1])
    return np.column_stack([runs[new, 0], upto[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(runs) - 1]])]])


_scanners: dict[str, Scanner] = {}       # the last one that this worker built


def _scan(pairs, only_hits: bool):
    token = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if token not in _scanners:
            _scanners.clear()
            _scanners[token] = Scanner(pairs.value)
        scanner = _scanners[token]
        for batch in batches:
            found = [scanner.scan(t.as_py()) for t in batch.column("text")]
            arrays = [batch.column("uid"), batch.column("id"), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.list_(SPAN)),
                      pa.array([f[2] for f in found], pa.list_(pa.string()))]
            out = pa.RecordBatch.from_arrays(arrays, ["uid", "id", "n_words", "spans", "items"])
            yield out.filter(pa.array([bool(f[1]) for f in found], pa.bool_())) if only_hits else out

    return run


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of several scans of a text as maximal runs: characters follow from the words at their ends."""
    for batch in batches:
        spans = []
        for row in batch.column("spans").to_pylist():
            start, end = {s["first"]: s["start"] for s in row}, {s["last"]: s["end"] for s in row}
            runs = merged(np.array([(s["first"], s["last"]) for s in row])) if row else []
            spans.append([{"first": int(a), "last": int(b), "start": start[a], "end": end[b]} for a, b in runs])
        at = batch.schema.get_field_index("spans")
        yield pa.RecordBatch.from_arrays([pa.array(spans, pa.list_(SPAN)) if i == at else batch.column(i) for i in range(batch.num_columns)], batch.schema.names)


def scan(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", max_chars: int = 4_000_000) -> DataFrame:
    """One row per document: id, n_words, n_hit, spans (first and last word, start and end character of each run of hit words), items (sorted), contaminated."""
    spark = docs.sparkSession
    pairs = settle(windows(benchmark, size), "windows")
    parts = max(1, -(-(pairs.agg(F.sum(F.length("window"))).first()[0] or 0) // max_chars))
    cols = [F.col(id_col).alias("id"), F.col(text_col).alias("text")]
    schema = SCHEMA.format(kind=docs.schema[id_col].dataType.simpleString())
    listed = lambda k: spark.sparkContext.broadcast([(r.window, r.item) for r in pairs.where(F.pmod(F.xxhash64("window", "item"), F.lit(parts)) == k).collect()])
    if parts == 1:
        found = docs.select(F.lit(0).cast("long").alias("uid"), *cols).mapInArrow(_scan(listed(0), False), schema)
    else:
        rows = numbered(docs, cols, "uid", "scanned")
        passes = [settle(rows.mapInArrow(_scan(listed(k), k > 0), schema), "hits") for k in range(parts)]
        both = reduce(DataFrame.unionAll, passes).groupBy("uid").agg(
            F.max("id").alias("id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        found = both.mapInArrow(_union, schema)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + 1)
    return found.select("id", "n_words", hit.alias("n_hit"), "spans", "items", (F.size("spans") > 0).alias("contaminated"))


def _words_sql(col: str) -> str:
    return f"regexp_extract_all(translate(coalesce({col}, ''), '{UPPER}', '{UPPER.lower()}'), '{WORD}')"


SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS uid, {_words_sql('text')} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_words_sql('text')} AS w FROM benchmark),
a AS (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item, array_to_string(w[i:i + 9], ' ') AS win, len(w[i:i + 9]) AS n FROM a),
s AS (SELECT DISTINCT n FROM g),
p AS (SELECT uid, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, s WHERE len(w) >= n),
m AS (SELECT p.uid, p.i, p.n, g.item FROM p JOIN g ON array_to_string(p.w[p.i:p.i + p.n - 1], ' ') = g.win AND p.n = g.n),
h AS (SELECT uid, count(DISTINCT q) AS n_hit FROM (SELECT uid, unnest(range(i, i + n)) AS q FROM m) GROUP BY uid),
t AS (SELECT uid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT uid, item FROM m) GROUP BY uid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (uid) LEFT JOIN t USING (uid)
"""
