"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the k smallest distinct 48-bit hashes of a text's five-word shingles (the whole sequence
as one, where there are fewer words), ascending. Sketches of parts merge into that of the union, and
pairs of them estimate resemblance, containment and distinct shingle counts. Everything runs as
built-in column functions; nothing leaves the JVM.

Defined cases: a null or empty text, or one of white space, has an empty sketch; two empty sketches
have likeness 1, one empty and one not, 0; repeated rows are sketched alike, and rows of one doc_id
follow each other by descending text; rows without an id come after all others; an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SHINGLE, K, BITS = 5, 128, 48
_DIGITS = BITS // 4
#: Rows of a span whose neighbours are found together, on average over the range of the ids, and spans of a larger one.
SPAN, SPANS = 1024, 1024
#: Where rows without an id stand: after all others.
LAST = -(1 << 63)
_BLANK = " \t\n\x0b\f\r"


def with_sketch(docs: DataFrame, text: str, name: str, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Adds the sketch of a text column as an array of longs."""
    docs = docs.withColumn("_t", F.btrim(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(_BLANK)))
    docs = docs.withColumn("_w", F.expr(r"if(_t = '', array(), split(_t, '[ \\x09-\\x0D]+'))"))
    following = "".join(f", get(_w, i + {j})" for j in range(1, shingle))
    hashes = f"transform(slice(_w, 1, greatest(size(_w) - {shingle - 1}, 1)), (w, i) -> xxhash64(w{following}) & {(1 << BITS) - 1}L)"
    return docs.withColumn(name, F.slice(F.sort_array(F.array_distinct(F.expr(hashes))), 1, k)).drop("_t", "_w")


def merged(a: str, b: str, k: int = K) -> Column:
    """The sketch of the union of two sketched sets of one k."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: str, b: str, k: int = K) -> Column:
    """Estimated Jaccard similarity: the share of the union's sketch that both sets hold."""
    union = merged(a, b, k)
    shared = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(shared / F.size(union))


def distinct_count(a: str, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    full = (F.lit(float(k - 1)) * F.lit(float(1 << BITS)) / F.element_at(a, -1)).cast("double")
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(full)


def containment(a: str, b: str, k: int = K) -> Column:
    """Estimated share of a's shingles that b holds."""
    union = F.greatest(distinct_count(a, k), distinct_count(b, k))
    both = F.when(F.size(merged(a, b, k)) < k, F.size(merged(a, b, k)).cast("double")).otherwise(F.lit(float(k - 1)) * F.lit(float(1 << BITS)) / F.element_at(merged(a, b, k), -1))
    shared = resemblance(a, b, k) * F.greatest(both, union)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_count(a, k)))


def to_text(sketch: str) -> Column:
    """A sketch as lower-case hexadecimal digits, twelve for each hash."""
    return F.expr(f"array_join(transform({sketch}, x -> lpad(lower(hex(x)), {_DIGITS}, '0')), '')")


def _following_heads(docs: DataFrame, k: int) -> DataFrame:
    """For every span of ids: text and sketch of the first row (largest id, then largest text) of the
    next lower span that has rows, after the lowest those of the highest.

    Spans are linked within larger ones and these among themselves. Their width is that of SPAN rows where
    ids are spread evenly, however densely, so a single task sees one row for about a million. The heads' ids are written before they meet the texts: by the size of that
    table Spark sends it to all tasks or, beyond its limit for that, shuffles.
    """
    ids = docs.groupBy("span").agg(F.max("doc_id").alias("doc_id"))
    ids = stored(ids.withColumn("wide", F.expr(f"span div {SPANS}")), "heads")
    spans = ids.withColumn("next_span", F.lead("span").over(Window.partitionBy("wide").orderBy(F.desc("span"))))
    wide = ids.groupBy("wide").agg(F.max("span").alias("first"))
    outer = Window.orderBy(F.desc("wide"))
    wide = wide.withColumn("after", F.coalesce(F.lead("first").over(outer), F.first("first").over(outer.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    links = spans.join(wide.select("wide", "after"), "wide").select("span", F.coalesce("next_span", "after").alias("next_span"))
    first = docs.join(ids.select("doc_id"), "doc_id", "left_semi").groupBy("span").agg(F.max("text").alias("text"))
    heads = with_sketch(first, "text", "sketch", k).select(F.col("span").alias("next_span"), F.struct("text", "sketch").alias("head"))
    return links.join(heads, "next_span").select("span", "head")


def edited_likeness(docs: DataFrame, k: int = K) -> DataFrame:
    """Per document: its sketch, that of its edited text (its last third replaced by the beginning of
    the next document in descending id), and the likeness of its sketch to that and to the next one's."""
    plain = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = docs.agg(F.count("doc_id").alias("n"), F.min(F.col("doc_id").cast("long")).alias("low"), F.max(F.col("doc_id").cast("long")).alias("high")).first()
    width = min((1 << 63) - 1, max(SPAN, (ids.high - ids.low + 1) * SPAN // max(1, ids.n))) if ids.n else SPAN
    plain = plain.withColumn("span", F.expr(f"doc_id div {width}L"))
    rows = with_sketch(plain, "text", "sketch", k)
    order = Window.partitionBy("span").orderBy(F.desc("doc_id"), F.desc("text"))
    rows = rows.withColumn("next", F.lead(F.struct("text", "sketch")).over(order))
    rows = rows.join(_following_heads(plain, k), "span")
    rows = rows.withColumn("next", F.coalesce("next", F.struct("head.text", "head.sketch"))).drop("head", "span")
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("moved", F.expr("cast(n_chars div 3 as int)"))
    rows = rows.withColumn("edited", F.expr("concat(left(text, cast(n_chars as int) - moved), left(next.text, moved))"))
    rows = rows.withColumn("next_sketch", F.col("next.sketch")).drop("next", "text")
    rows = with_sketch(rows, "edited", "edited_sketch", k)
    return rows.select(
        F.when(F.col("doc_id") != LAST, F.col("doc_id")).alias("doc_id"),
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        to_text("sketch").alias("fingerprint"),
        to_text("edited_sketch").alias("edited_fingerprint"),
        resemblance("sketch", "edited_sketch", k).alias("near_edited"),
        resemblance("sketch", "next_sketch", k).alias("near_next"),
    )
