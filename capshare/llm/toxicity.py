"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are words (lower-case runs of letters) and word beginnings of four and five letters. Those that labelled examples show to go with the label (chi-square
and lift) span the vector space; inverse document frequencies come from all documents. The labelled examples, at most about
``max_examples`` of them, form an inverted index cut into blocks; a table of the largest weight per term and block bounds the
score of every block, and blocks are opened in the order of their bounds until none can hold a nearer neighbour: the result is exact.
Neighbours vote with their cosine; the vote is calibrated on the examples, each scored without itself.

* null or empty texts and texts without any term have no neighbour: they get the calibrated rate of such examples.
* labels that are null are no examples; repeated rows count each; with no example at all every score is 0.5 of nothing: 0.0.
* equal similarities go to the smaller example number, fixed by text and id. Texts are read whole; extra columns are ignored.
* a null id is scored like any other row. An empty table gives an empty table.
"""
from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

WORDS = re.compile(r"[^\W\d_]+")
BLOCK = 256


def terms_of(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in (4, 5) if len(word) >= n)]


def _example_terms(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in it:
        for a in range(0, len(pdf), 200):
            part = pdf.iloc[a:a + 200]
            neg, pos = Counter(), Counter()
            for text, y in zip(part["text"], part["y"]):
                (pos if y else neg).update({t for w in set(WORDS.findall((text or "").lower())) for t in terms_of(w)})
            names = list(neg.keys() | pos.keys())
            yield pd.DataFrame({"term": pd.Series(names, dtype=object), "pos": [pos[t] for t in names], "neg": [neg[t] for t in names]})


def select_terms(examples: DataFrame, most: int = 4096, chi: float = 30.0, lift: float = 2.0) -> list[str]:
    """Terms that go with the label; at most ``most``."""
    n = examples.agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")).first()
    if not n.pos or not n.neg:
        return []
    counts = examples.mapInPandas(_example_terms, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("a"), F.sum("neg").alias("b"))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    c, d, all_ = n.pos - a, n.neg - b, float(n.pos + n.neg)
    stat = all_ * (a * d - b * c) ** 2 / F.nullif((a + b) * (c + d) * (a + c) * (b + d), F.lit(0.0))
    # ``lift`` times the rate, or half of what is left above it where that is less
    rich = (a / (a + b)) >= min(lift * n.pos / all_, (1 + n.pos / all_) / 2)
    rows = counts.withColumn("chi", stat).where((F.col("chi") >= chi) & rich).orderBy(F.col("chi").desc(), "term").limit(most).collect()
    return sorted(r.term for r in rows)


class _Known(dict):
    """Numbers of a word's terms, looked up once per word; emptied when full."""

    def __init__(self, number: dict[str, int]):
        super().__init__()
        self.number = number

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 500_000:
            self.clear()
        self[word] = found = tuple(self.number[t] for t in terms_of(word) if t in self.number)
        return found


@lru_cache(maxsize=2)
def _known(terms: tuple[str, ...]) -> _Known:
    return _Known({t: i for i, t in enumerate(terms)})


def vectors(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(id, t array<int> ascending, tf array<int>) of every row."""
    names = tuple(terms)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _known(names)
        for pdf in it:
            ts, fs = [], []
            for text in pdf["text"]:
                hits = Counter(t for found in filter(None, map(known.__getitem__, WORDS.findall((text or "").lower()))) for t in found)
                order = sorted(hits)
                ts.append(order)
                fs.append([hits[t] for t in order])
            yield pd.DataFrame({"id": pdf["id"].astype(object), "t": ts, "tf": fs})

    return docs.select(F.col("id").cast("string").alias("id"), "text").mapInPandas(run, "id string, t array<int>, tf array<int>")


class Index:
    """Inverted lists of unit vectors by block, with the largest weight of each term in each block."""

    def __init__(self, rows: list[tuple[list[int], list[int], int, str]], idf: np.ndarray):
        self.idf, self.y = idf, np.array([r[2] for r in rows], np.float64)
        self.ids = [r[3] for r in rows]
        n_blocks = -(-len(rows) // BLOCK)
        self.top = np.zeros((len(idf), n_blocks), np.float64)
        lists: dict[tuple[int, int], list] = {}
        for i, (t, tf, _, _) in enumerate(rows):
            t, w = self.weights(t, tf)
            for k, x in zip(t.tolist(), w.tolist()):
                lists.setdefault((k, i // BLOCK), []).append((i % BLOCK, x))
                self.top[k, i // BLOCK] = max(self.top[k, i // BLOCK], x)
        self.lists = {k: (np.array([a for a, _ in v]), np.array([b for _, b in v])) for k, v in lists.items()}

    def weights(self, t, tf) -> tuple[np.ndarray, np.ndarray]:
        t = np.asarray(t, np.int64)
        w = (1 + np.log(np.asarray(tf, np.float64))) * self.idf[t]
        return t, w / max(math.sqrt(float(w @ w)), 1e-300)

    def nearest(self, t, tf, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest positive cosine, nearest first."""
        t, w = self.weights(t, tf)
        bound = w @ self.top[t]
        best_i, best_s = np.empty(0, np.int64), np.empty(0)
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] <= 0 or len(best_s) == k and bound[b] * (1 + 1e-9) < best_s[-1]:
                break
            score = np.zeros(BLOCK)
            for x, q in zip(t.tolist(), w.tolist()):
                hit = self.lists.get((x, b))
                if hit is not None:
                    score[hit[0]] += q * hit[1]
            if 0 <= without - b * BLOCK < BLOCK:
                score[without - b * BLOCK] = 0
            local = np.flatnonzero(score > 0)
            i, s = np.concatenate([best_i, local + b * BLOCK]), np.concatenate([best_s, score[local]])
            order = np.lexsort((i, -np.round(s, 12)))[:k]
            best_i, best_s = i[order], s[order]
        return best_i, best_s

    def vote(self, t, tf, k: int, without: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        """Share of the label among the neighbours, by cosine; -1 without neighbours."""
        if not len(t):
            return -1.0, np.empty(0, np.int64), np.empty(0)
        i, s = self.nearest(t, tf, k, without)
        return (float(s @ self.y[i] / s.sum()) if len(i) else -1.0), i, s


def calibration(votes: DataFrame, bins: int = 20) -> list[float]:
    """Rate of the label per bin of the vote (the first for no neighbour), smoothed and made monotone by pooling: ``bins`` + 2 numbers."""
    b = F.when(F.col("vote") < 0, F.lit(0)).otherwise(1 + F.floor(F.col("vote") * bins)).cast("int")
    rows = {r.b: (r.n, r.y) for r in votes.groupBy(b.alias("b")).agg(F.count("*").alias("n"), F.sum("y").alias("y")).collect()}
    pooled: list[list[float]] = []
    for i in range(1, bins + 2):
        n, y = rows.get(i, (0, 0))
        mid = min((i - 0.5) / bins, 1.0)
        pooled.append([y + 2 * mid, n + 2, 1])
        while len(pooled) > 1 and pooled[-2][0] / pooled[-2][1] > pooled[-1][0] / pooled[-1][1]:
            y2, n2, c2 = pooled.pop()
            pooled[-1] = [pooled[-1][0] + y2, pooled[-1][1] + n2, pooled[-1][2] + c2]
    n, y = rows.get(0, (0, 0))
    return [y / n if n else 0.0] + [y / n for y, n, c in pooled for _ in range(int(c))]


def score(docs: DataFrame, labels: DataFrame, learn: Column, k: int = 15, max_examples: int = 20_000, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic") -> DataFrame:
    """Per row: id, score, and as evidence the nearest examples with cosine and label. ``learn`` says of a row of ``labels`` whether it may be learned from."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    fine = labels.where(learn & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), (F.col(label_col) > 0).cast("int").alias("y"))
    n = fine.count()
    part = F.pmod(F.xxhash64(F.lit("example"), "id"), F.lit(1 << 30)) < F.lit(int(min(1.0, 0.95 * max_examples / max(n, 1)) * (1 << 30)))
    # at most about max_examples rows of two numbers
    chosen = settle(fine.where(part), "labels")
    examples = docs.join(F.broadcast(chosen), "id")
    terms = select_terms(settle(examples, "examples"))
    vecs = settle(vectors(docs, terms), "vectors")
    total = vecs.count()
    df = np.zeros(max(len(terms), 1))
    for r in vecs.select(F.explode("t").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect():
        df[r.t] = r.n
    idf = np.log((1 + total) / (1 + df)) + 1
    held = vecs.join(F.broadcast(chosen.withColumn("id", F.col("id").cast("string"))), "id").select("t", "tf", "y", "id").collect()
    held = sorted(((list(r.t), list(r.tf), r.y, r.id) for r in held), key=lambda r: (r[3], r[2]))
    index = Index(held, idf)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(index)

    def alone(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix = shared.value
        for pdf in it:
            yield pd.DataFrame([(ix.vote(held_rows[i][0], held_rows[i][1], k, i)[0], int(ix.y[i])) for i in pdf["id"].tolist()], columns=["vote", "y"])

    rows = spark.sparkContext.broadcast([(t, tf) for t, tf, _, _ in held])

    class _Rows:
        def __getitem__(self, i):
            return rows.value[i]

    held_rows = _Rows()
    rates = calibration(spark.range(len(held)).repartition(16).mapInPandas(alone, "vote double, y int")) if held else [0.0] * 22
    bins = len(rates) - 2

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix = shared.value
        # texts with the same terms have the same neighbours
        known: dict = {}
        for pdf in it:
            out = []
            for id_, t, tf in zip(pdf["id"], pdf["t"], pdf["tf"]):
                same = (t.tobytes(), tf.tobytes())
                if same not in known:
                    if len(known) > 50_000:
                        known.clear()
                    known[same] = ix.vote(t, tf, k)
                vote, i, s = known[same]
                x = rates[0] if vote < 0 else float(np.interp(vote * bins, np.arange(bins + 1) + 0.5, rates[1:]))
                out.append((None if pd.isna(id_) else id_, x, [{"id": ix.ids[a], "cosine": float(c), "toxic": int(ix.y[a])} for a, c in zip(i[:3].tolist(), s[:3].tolist())]))
            yield pd.DataFrame(out, columns=["id", "score", "evidence"]).astype({"id": object})

    return vecs.mapInPandas(run, "id string, score double, evidence array<struct<id string, cosine double, toxic int>>")
