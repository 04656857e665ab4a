"""Bottom-k sketches of shingle hashes, with DataFrame functions only.

A sketch is the ascending array of the ``k`` smallest distinct 64-bit hashes of a
text's word shingles, each the hash of its words' hashes.  Sketches of parts merge into the sketch of the whole, and two
of them estimate resemblance, containment and the number of distinct shingles.

Words are runs without ASCII white space, as written; a shingle is ``width`` words, or
the whole sequence of a text with fewer.  Defined cases: a null or word-free text has
an empty sketch; two empty sketches resemble each other fully, an empty and another
one not at all; equal texts have equal sketches; a set with fewer than ``k`` shingles
is held whole, and then all estimates are exact.  Ids are whole numbers, or of any type that has an order and go by their
places in it; a null id comes after all others, and an id of many rows has them in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.windows import numbered_globally
from .common import looked_up, shuffle_width, stored, text_or_empty

K, WIDTH = 256, 5
#: Bytes as signed numbers, so that half the hashes are negative: the range is 2**64.
LEAST, RANGE = -(2.0**63), 2.0**64


def sketch(text: str | Column, k: int = K, width: int = WIDTH) -> Column:
    """The bottom-k sketch of one text, an ascending array of longs."""
    words = F.filter(F.split(text_or_empty(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    # the outer transform binds the word hashes, so that they are made once for a row;
    # get() past the end is null, which the hash passes over: a shorter text is one shingle
    hashes = F.transform(
        F.array(F.transform(words, lambda w: F.xxhash64(w))),
        lambda h: F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - width, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(width)]))
        ),
    )
    return F.slice(F.sort_array(F.array_distinct(hashes[0])), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two texts' shingles."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merged_by(df: DataFrame, key: str, col: str, k: int = K) -> DataFrame:
    """(key, col): one sketch per key of those of its parts, however many there are.

    The rank filter keeps at most ``k`` rows of a key in each task before the shuffle.
    """
    hashes = df.select(key, F.explode(col).alias("_h")).distinct()
    ranked = hashes.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("_h"))).where(F.col("_r") <= k)
    held = ranked.groupBy(key).agg(F.sort_array(F.collect_list("_h")).alias(col))
    return df.select(key).distinct().join(held, key, "left").withColumn(col, F.coalesce(col, F.array().cast("array<bigint>")))


def distinct_shingles(s: Column, k: int = K) -> Column:
    """Estimated count of distinct shingles; exact below ``k``."""
    share = (F.element_at(s, k).cast("double") - F.lit(LEAST)) / F.lit(RANGE)
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) / share)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of the two shingle sets."""
    return F.transform(F.array(merged(a, b, k)), lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u)))[0]


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has; 1 for an empty ``a``."""
    union = distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * union / distinct_shingles(a, k)))


def printed(s: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(s, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def with_next(rows: DataFrame, id_col: str, cols: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """Adds ``next_<col>``: the column of the next row by descending id, cyclically.

    No window runs over the whole table: ids are cut at quantiles, and the row that
    opens a cut also visits the cut before it as a guest.  A null id orders below all
    others; rows with the same id are ordered by ``order``.
    """
    spark = rows.sparkSession
    at = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    parts = parts or 4 * shuffle_width(spark)
    shares = [i / parts for i in range(1, parts + 1)]
    found = rows.agg(F.percentile_approx(at, shares, max(10_000, 10 * parts)).alias("q"), F.max(at).alias("most")).first()
    if found["most"] is None:
        return rows.select("*", *[F.col(c).alias(f"next_{c}") for c in cols])
    cuts = sorted({*found["q"], found["most"]})  # cut i holds the ids over cuts[i - 1], up to cuts[i]
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts])
    own = rows.withColumn("_at", at)
    cut = F.size(F.filter(bounds, lambda c: c < F.col("_at")))
    # the largest id of a cut is its bound, which is the next row of the cut above (of the lowest for the largest id: cyclic)
    is_first = F.array_contains(bounds, F.col("_at"))
    visits = F.when(is_first, F.array(F.struct(cut.alias("cut"), F.lit(0).alias("guest")), F.struct(F.when(F.col("_at") == cuts[-1], F.lit(0)).otherwise(cut + 1).alias("cut"), F.lit(1).alias("guest"))))
    visits = visits.otherwise(F.array(F.struct(cut.alias("cut"), F.lit(0).alias("guest"))))
    dealt = own.select("*", F.explode(visits).alias("_v")).select("*", F.col("_v.cut").alias("_cut"), F.col("_v.guest").alias("_guest"))
    window = Window.partitionBy("_cut").orderBy("_guest", F.desc("_at"), *order)
    nexts = {f"next_{c}": F.lead(c).over(window) for c in cols}
    return dealt.withColumns(nexts).where("_guest = 0").drop("_at", "_v", "_cut", "_guest")


def with_places(docs: DataFrame, id_col: str) -> DataFrame:
    """Adds ``_place``: the place of the id among all ids, for ids that aren't whole numbers; null for none."""
    ids = docs.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias("_n"))
    places = stored(numbered_globally(ids, "_place", F.asc(id_col)), "sketch-places")
    total, keys = places.agg(F.sum("_n"), F.count(F.lit(1))).head()
    known = looked_up(docs, places, [id_col], "_n", total or 0, keys)
    return known.unionByName(docs.where(F.col(id_col).isNull()).withColumn("_place", F.lit(None).cast("long")))


def edited_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, width: int = WIDTH) -> DataFrame:
    """Sketch of each text and of its edited text, and how alike they are estimated to be.

    The edited text has its last half replaced by the first as many characters of the
    next document by descending id; an only document is followed by itself.
    """
    text = text_or_empty(text_col)
    whole = docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long")
    place = F.col(id_col).cast("long").alias("_place") if whole else F.col("_place")
    docs = docs.select(id_col, text_col) if whole else with_places(docs.select(id_col, text_col), id_col)
    rows = docs.select(F.col(id_col).alias("_id"), place, text.alias("_text"), sketch(text, k, width).alias("_fp"))
    rows = with_next(rows, "_place", ["_text", "_fp"], ["_text"])
    n = F.length("_text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("_text", F.lit(1), n - half), F.substring("next__text", F.lit(1), half))
    rows = rows.select("*", n.cast("long").alias("n_chars"), edited.alias("_edited")).withColumn("_edited_fp", sketch("_edited", k, width))
    return rows.select(
        F.col("_id").alias(id_col),
        "n_chars",
        F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        printed(F.col("_fp")).alias("fingerprint"),
        printed(F.col("_edited_fp")).alias("edited_fingerprint"),
        resemblance(F.col("_fp"), F.col("_edited_fp"), k).alias("near_edited"),
        resemblance(F.col("_fp"), F.col("next__fp"), k).alias("near_next"),
        containment(F.col("_edited_fp"), F.col("_fp"), k).alias("edited_within"),
        distinct_shingles(F.col("_fp"), k).alias("n_shingles"),
    )
