"""Bottom-k fingerprints: the k smallest shingle hashes of a document, in DataFrame functions only.

Sketches of parts merge into the sketch of the whole, and estimate resemblance, containment and the
number of distinct shingles. Hashes are the first 15 hex digits of an MD5, so that any engine can
make and compare them.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Words in a shingle, hashes in a sketch, and rows that share a block of the order by doc_id.
WIDTH, SIZE, BLOCK_ROWS = 5, 128, 1_000
#: Hashes lie below 16 ** DIGITS.
DIGITS = 15


def let(value: Column, then) -> Column:
    """then(value), with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def words(text: Column) -> Column:
    """The words between white space, A-Z as a-z."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def sketch(text: Column, width: int = WIDTH, size: int = SIZE) -> Column:
    """The smallest distinct hashes, ascending, of the word shingles of a text; a shorter text is one shingle, no words none."""
    def of(words):
        places = F.sequence(F.lit(0), F.greatest(F.size(words) - width, F.lit(0)))
        hashes = F.transform(places, lambda i: F.substring(F.md5(F.array_join(F.slice(words, i + 1, width), " ")), 1, DIGITS))
        least = F.transform(F.slice(F.sort_array(F.array_distinct(hashes)), 1, size), lambda h: F.conv(h, 16, 10).cast("long"))
        return F.when(F.size(words) > 0, least).otherwise(F.array().cast("array<long>"))
    return let(words(text), of)


def merged(a: Column, b: Column, size: int = SIZE) -> Column:
    """The sketch of two parts together (of all their shingles, those across the seam apart)."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, size)


def distinct(a: Column, size: int = SIZE) -> Column:
    """Estimated number of distinct shingles; exact for a sketch that is not full."""
    return F.when(F.size(a) < size, F.size(a).cast("double")).otherwise((size - 1) * float(16 ** DIGITS) / F.element_at(a, -1))


def resemblance(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimated Jaccard similarity: the part of the merged sketch that lies in both. Two empty sketches are alike."""
    return let(merged(a, b, size), lambda both: F.when(F.size(both) == 0, F.lit(1.0)).otherwise(
        F.size(F.array_intersect(both, F.array_intersect(a, b))) / F.size(both)))


def containment(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimated part of a's shingles that b has; 1 if a has none."""
    union = let(merged(a, b, size), lambda both: distinct(both, size))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), resemblance(a, b, size) * union / distinct(a, size)))


def fingerprint(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda h: F.lower(F.hex(h))), ",")


def union_all(sketches: DataFrame, keys: list[str], column: str = "sketch", size: int = SIZE) -> DataFrame:
    """One sketch for each key, of the sketches of its parts: no key gathers more than its distinct hashes that
    some part kept, and of those the `size` smallest are ranked by Spark."""
    hashes = sketches.select(*keys, F.explode(column).alias("h")).distinct()
    ranked = hashes.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy("h"))).where(F.col("rank") <= size)
    return ranked.groupBy(*keys).agg(F.sort_array(F.collect_list("h")).alias(column))


def _bounds(docs: DataFrame, block_rows: int) -> list[int]:
    """doc_ids that open blocks of about so many rows each, the first block apart; 16,383 of them at most."""
    blocks = min(1 << 14, -(-docs.count() // block_rows))
    if blocks < 2:
        return []
    got = docs.agg(F.percentile_approx("doc_id", [k / blocks for k in range(1, blocks)], 100 * blocks).alias("q"), F.min("doc_id").alias("low")).first()
    return sorted({q for q in got.q or [] if q > got.low})


def in_blocks(docs: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, W]:
    """docs (doc_id, more) dealt by `block`, a run of the order by doc_id, and the window over a block.

    The rows that open a block are also guests in the block before it, and the first of all in the last
    one, so that every row finds its next one in its own block; rows are shuffled once."""
    ids = docs.select("doc_id")
    bounds = _bounds(ids, block_rows)
    low = F.col("doc_id").isNull() if ids.where("doc_id is null").limit(1).count() else F.col("doc_id") == F.lit(ids.agg(F.min("doc_id")).first()[0])
    # binary search: the number of bounds up to doc_id, among bounds padded to one less than a power of two
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    padded = [*bounds, *[(1 << 63) - 1] * ((1 << len(steps)) - 1 - len(bounds))]
    listed = F.split(F.lit(",".join(map(str, padded))), ",").cast("array<bigint>")
    block = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: F.when(F.get(listed, at + s - 1) <= F.col("doc_id"), at + s).otherwise(at)) if steps else F.lit(0)

    def seat(block, late, guest):
        return F.struct(block.cast("int").alias("block"), F.lit(late).alias("late"), F.lit(guest).alias("guest"))

    opens = F.get(listed, F.col("block") - 1) == F.col("doc_id") if bounds else F.lit(False)
    seats = F.array(seat(F.col("block"), False, False), F.when(opens, seat(F.col("block") - 1, False, True)), F.when(low, seat(F.lit(len(bounds)), True, True)))
    dealt = (docs.withColumn("block", block).withColumn("seat", F.explode(F.filter(seats, lambda x: x.isNotNull())))
             .withColumns({"block": F.col("seat.block"), "late": F.col("seat.late"), "guest": F.col("seat.guest")}).drop("seat"))
    return dealt.repartition("block"), W.partitionBy("block").orderBy("late", F.col("doc_id").asc_nulls_first(), "text")


def edited(docs: DataFrame, width: int = WIDTH, size: int = SIZE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """docs (doc_id, text, more), one row per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, n_distinct and kept_part.

    The edited text has its last quarter (floor of n_chars / 4 code points) replaced by the first as many
    code points, or all, of the next document by doc_id, the first one's for the last. near_edited and
    near_next are the resemblances of the document's sketch to the edited text's and the next document's;
    n_distinct the estimated number of its shingles, kept_part the estimated part of them that the edited
    text has. A null text is empty; an empty text has an empty sketch, and two empty ones are alike. Rows
    that repeat a doc_id follow in order of their texts; a null doc_id comes first. Whole texts are read;
    other columns are ignored."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt, order = in_blocks(source, block_rows)
    own = dealt.withColumn("own", sketch(F.col("text"), width, size))
    seen = own.withColumns({"next": F.lead("text").over(order), "next_sketch": F.lead("own").over(order)}).where("not guest")
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    changed = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next", F.lit(1), cut))
    both = seen.withColumn("changed", changed).withColumn("other", sketch(F.col("changed"), width, size))
    return both.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("changed", 256).alias("edited_sha256"), fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("other")).alias("edited_fingerprint"), resemblance(F.col("own"), F.col("other"), size).alias("near_edited"),
        resemblance(F.col("own"), F.col("next_sketch"), size).alias("near_next"), distinct(F.col("own"), size).alias("n_distinct"),
        containment(F.col("own"), F.col("other"), size).alias("kept_part"))


def _sql_sketch(text: str) -> str:
    return f"""(SELECT CASE WHEN len(w) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(range(1, greatest(len(w) - {WIDTH - 1}, 1) + 1),
      lambda i: ('0x' || md5(array_to_string(w[i:i + {WIDTH - 1}], ' '))[1:{DIGITS}])::BIGINT)))[1:{SIZE}] END
      FROM (SELECT list_filter(string_split_regex(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
      lambda x: x <> '') AS w))"""


def _sql_near(a: str, b: str) -> str:
    both = f"list_sort(list_distinct(list_concat({a}, {b})))[1:{SIZE}]"
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect({both}, list_intersect({a}, {b})))::DOUBLE / len({both}) END"


def _sql_distinct(a: str) -> str:
    return f"CASE WHEN len({a}) < {SIZE} THEN len({a})::DOUBLE ELSE {SIZE - 1} * {float(16 ** DIGITS)!r}::DOUBLE / {a}[{SIZE}] END"


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT *, coalesce(lead(t) OVER (ORDER BY doc_id, t), first_value(t) OVER (ORDER BY doc_id, t)) AS nx, length(t) // 4 AS k FROM d),
e AS (SELECT *, substring(t, 1, length(t) - k) || substring(nx, 1, k) AS c FROM n),
s AS (SELECT *, {_sql_sketch('t')} AS a, {_sql_sketch('c')} AS b, {_sql_sketch('nx')} AS x FROM e),
u AS (SELECT *, list_sort(list_distinct(list_concat(a, b)))[1:{SIZE}] AS ab FROM s)
SELECT doc_id, length(t) AS n_chars, sha256(c) AS edited_sha256, array_to_string(list_transform(a, lambda h: lower(to_hex(h))), ',') AS fingerprint,
       array_to_string(list_transform(b, lambda h: lower(to_hex(h))), ',') AS edited_fingerprint, {_sql_near('a', 'b')} AS near_edited,
       {_sql_near('a', 'x')} AS near_next, {_sql_distinct('a')} AS n_distinct,
       CASE WHEN len(a) = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, ({_sql_near('a', 'b')}) * ({_sql_distinct('ab')}) / ({_sql_distinct('a')})) END AS kept_part
FROM u
"""
