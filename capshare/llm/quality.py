"""Quality rules by distribution divergence.

Every document gets two histograms: character classes, and common words of four languages (with all other words as one bin). References are
the summed histograms of the documents of a language that pass the base rules: every language has one that has at least 20 such documents and a
ten-thousandth of all, so there are at most 10,000. The Jensen-Shannon distance (base 2, square root of the divergence) of a document to a reference is taken
for both histograms; the nearest counts of its own language and the four, so a wrong label among these does no harm.
The verdict rejects a document whose distance exceeds the limit by more than what sampling explains: the limit is
``limit + spread / sqrt(words)``. Documents shorter than ``least`` words, and those of a language without a reference, are left to the base rules.

* null or empty text: no words, base_failed, not kept. Null lang, or a lang without a reference: the divergence rule is silent.
* empty table, or nothing passes the base rules: no reference, the divergence rule is silent.
* repeated rows each count and each get the same verdict; very long texts are handled whole, by arrays of one row. Extra columns pass.

``n_repeat_words``: three-word windows are hashed and packed with their position into one sorted array; neighbours with equal hash
are candidates, whose words are then compared exactly; covered words are counted once.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, let, settle, words

# Frequent function words of English, German, French and Spanish, of three letters at most.
COMMON = ("the of and to in der die und den zu de la le les et que el y").split()
COMMON = tuple(dict.fromkeys(COMMON))
LANGUAGES = ("en", "de", "fr", "es")
# Character classes; the last bin is everything else.
CLASSES = (r"\p{Ll}", r"[ \t\n\x0B\f\r]", r"\p{Lu}", r"\p{Nd}", r"[.,;:'\"?!()-]")
POS = 28
#: Passing documents that make a reference; words below which the divergence rule is silent.
ENOUGH, LEAST = 20, 64


def _covered(at: Column) -> Column:
    """Number of words covered by three-word windows at the sorted positions ``at``."""
    step = F.aggregate(at, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
                       lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(3), p - s["last"])).alias("n")), lambda s: s["n"])
    return step


def repeat_words(words_: Column) -> Column:
    """Words in three-word windows that occur at least twice in the array."""

    def packed(w):
        return F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.shiftleft(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), POS).bitwiseOR(i.cast("long"))))

    def candidates(s):
        high = lambda j: F.shiftright(F.get(s, j), POS)
        return F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: (high(j) == high(j - 1)) | (high(j) == high(j + 1))),
                           lambda j: F.get(s, j).bitwiseAND(F.lit((1 << POS) - 1)).cast("int"))

    def exact(w, at):
        named = F.sort_array(F.transform(at, lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("x"), i.alias("i"))))
        return let(named, lambda s: F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: (F.get(s, j)["x"] == F.get(s, j - 1)["x"]) | (F.get(s, j)["x"] == F.get(s, j + 1)["x"])),
                                                             lambda j: F.get(s, j)["i"])))

    def whole(w):
        found = let(packed(w), candidates)
        some = let(found, lambda at: F.when(F.size(at) == 0, F.lit(0)).otherwise(_covered(exact(w, at))))
        return F.when(F.size(w) < 4, F.lit(0)).otherwise(some)

    return let(words_, whole)


def line_repeats(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def class_counts(text: Column) -> Column:
    """Characters of each class, the rest, and symbols: every class is cut out before the next is counted, so the string soon gets short."""

    def strip(t, classes, counts):
        if not classes:
            return F.array(*counts, F.length(t).cast("long"), F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"))
        return let(F.regexp_replace(t, f"{classes[0]}+", ""), lambda u: strip(u, classes[1:], [*counts, (F.length(t) - F.length(u)).cast("long")]))

    return strip(text, list(CLASSES), [])


def common_counts(text: Column) -> Column:
    """Occurrences of each common word: only words of at most three letters are left, with at least two blanks between them."""
    flat = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"\p{L}{4,}[^\p{L}]*|[^\p{L}]+", "  "), F.lit(" "))
    return let(flat, lambda s: F.array(*[((F.length(s) - F.length(F.replace(s, F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)).cast("long") for w in COMMON]))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", whole: bool = False) -> DataFrame:
    """uid, id, lang, n_words, base counts, base_failed and the histograms; with ``whole``, also ``row``, all columns of the input as a struct."""
    row = [F.struct(*[docs[c] for c in docs.columns]).alias("row")] if whole else []
    more = ["row"] if whole else []
    src = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), *row)
    t, k, zero = F.col("t"), len(CLASSES) + 1, F.lit(0).cast("long")
    pair = let(words(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).cast("long").alias("r")))
    rows = src.select("uid", "id", "lang", F.length(t).cast("long").alias("chars"), line_repeats(t).alias("n_dup_lines"), pair.alias("pair"), class_counts(t).alias("counts"), common_counts(t).alias("hits"), *more)
    n, r = F.col("pair.n"), F.col("pair.r")
    other = F.greatest(zero, n - F.aggregate("hits", zero, lambda x, y: x + y))
    return rows.select("uid", "id", "lang", n.alias("n_words"), (F.col("chars") - F.element_at("counts", 2)).alias("word_chars"), F.element_at("counts", k + 1).alias("n_symbols"), "n_dup_lines",
                       r.alias("n_repeat_words"), ((n < 50) | (100 * r > 50 * n)).alias("base_failed"), F.slice("counts", 1, k).alias("classes"), F.concat("hits", F.array(other)).alias("common"), *more)


def references(feats: DataFrame) -> DataFrame:
    """(ref_lang, ref_classes, ref_common): shares by language, at most 10,000 rows."""
    sizes = {"classes": len(CLASSES) + 1, "common": len(COMMON) + 1}
    passed = feats.where(~F.col("base_failed"))
    sums = [F.sum(F.get(h, F.lit(i))).alias(f"{h}_{i}") for h, k in sizes.items() for i in range(k)]
    by_lang = passed.where(F.col("lang").isNotNull()).groupBy("lang").agg(F.count("*").alias("n"), *sums).where(
        (F.col("n") >= ENOUGH) & (F.col("n") * 10_000 >= F.lit(passed.count())))

    def shares(h, k):
        total = sum((F.col(f"{h}_{i}") for i in range(1, k)), F.col(f"{h}_0")).cast("double")
        return F.array(*[F.col(f"{h}_{i}").cast("double") / total for i in range(k)]).alias(f"ref_{h}")

    return settle(by_lang.select(F.col("lang").alias("ref_lang"), *[shares(h, k) for h, k in sizes.items()]), "references")


def distance(hist: Column, ref: list[float] | Column) -> Column:
    """Jensen-Shannon distance of a histogram of counts to shares; null for an empty histogram."""
    q = ref if isinstance(ref, Column) else F.array(*[F.lit(float(x)) for x in ref])

    def of(total):
        def term(x, y):
            p = x.cast("double") / total
            m = (p + y) / 2
            return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(y > 0, y * F.log2(y / m)).otherwise(0.0)
        return F.when(total > 0, F.sqrt(F.greatest(F.lit(0.0), F.aggregate(F.zip_with(hist, q, term), F.lit(0.0), lambda a, b: a + b) / 2)))

    return let(F.aggregate(hist, F.lit(0).cast("long"), lambda a, b: a + b), of)


def judge(docs: DataFrame, class_limit: float = 0.16, word_limit: float = 0.17, spread: float = 1.0, least: int = LEAST, **cols) -> DataFrame:
    """Per row: uid, id, the base counts, base_failed, class_distance, word_distance, kept."""
    feats = settle(features(docs, **cols), "quality")
    refs = references(feats)
    fixed = refs.where(F.col("ref_lang").isin(*LANGUAGES)).orderBy("ref_lang").collect()
    slack = F.lit(spread) / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)).cast("double"))
    own = F.col("ref_lang").isNotNull()

    def near(h):
        other = F.when(own & ~F.col("ref_lang").isin(*LANGUAGES), distance(F.col(h), F.col(f"ref_{h}")))      # the four are in any case
        return F.round(F.least(other, F.lit(None).cast("double"), *[distance(F.col(h), r[f"ref_{h}"]) for r in fixed]), 6)

    out = feats.join(F.broadcast(refs), feats["lang"] == refs["ref_lang"], "left").withColumn("class_distance", near("classes")).withColumn("word_distance", near("common"))
    far = (F.col("class_distance") > F.lit(class_limit) + slack) | (F.col("word_distance") > F.lit(word_limit) + slack)
    return out.withColumn("kept", ~F.col("base_failed") & ((F.col("n_words") < least) | ~own | ~F.coalesce(far, F.lit(False)))).drop("classes", "common", "ref_lang", "ref_classes", "ref_common")


def kept_documents(docs: DataFrame, **kw) -> DataFrame:
    """The documents that pass, with all their columns: they are written next to their counts, so nothing is shuffled or joined."""
    return judge(docs, whole=True, **kw).where("kept").select("row.*")
