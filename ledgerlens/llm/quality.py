"""Quality rules: hashed n-gram log-likelihood ratio of every document, in DataFrame functions only.

Word n-grams fall into hashed buckets. Two multinomials over the buckets are counted, one of a trusted
target, one of the whole raw corpus; the logarithm of their ratio is a bucket's gain. A document's gains
are summed, divided by its number of n-grams, and held against one fixed threshold, together with fixed
rules on length and repetition. Gains are whole thousandths, so sums do not depend on their order.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.fingerprints import let
from ledgerlens.llm.tables import sampled, small, stage

#: Longest n-gram, buckets (a power of two), and the least mean gain of a kept document, in thousandths.
LONGEST, BUCKETS, THRESHOLD = 2, 1 << 16, -80
#: Trusted documents that the target is learned from, at most (a sample by hash beyond that).
TRUSTED = 1_000_000
#: A document with fewer words fails; so does one with more than so many percent of its words in repeated windows.
LEAST, REPEATED, WINDOW = 20, 30, 8
SYMBOLS = r"[#*$%&|<>]"
SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def _paired(a: Column, b: Column, k: int) -> Column:
    """Codes of the n-grams that end with the k-th word and later: the code of what goes before, and the next word's."""
    n = F.greatest(F.size(b) - (k - 1), F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(k), n), lambda x, y: (x * 31 + y) % (1 << 32))


def grams(words: Column, longest: int, buckets: int, then) -> Column:
    """then(the buckets of all n-grams of 1 to `longest` words, n by n)."""
    def wider(levels, k):
        if k > longest:
            return then(F.concat(*[F.transform(x, lambda c: (c % buckets).cast("int")) for x in levels]))
        return let(_paired(levels[-1], levels[0], k), lambda x: wider([*levels, x], k + 1))
    return let(F.transform(words, lambda w: F.crc32(w)), lambda codes: wider([codes], 2))


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """The number of words that lie in a window of so many words found twice or more.
    Windows are compared by 64-bit hashes, within one text only; a window's is made of those of its two halves."""
    def counted(hashes):
        seated = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))

        def covered(seats):
            twice = F.filter(seats, lambda s, i: F.coalesce(s["h"] == F.get(seats, i + 1)["h"], F.lit(False)) | F.coalesce(s["h"] == F.get(seats, i - 1)["h"], F.lit(False)))
            places = F.sort_array(F.transform(twice, lambda s: s["at"]))
            return let(places, lambda p: F.aggregate(F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(window)), F.lit(window))),
                                                     F.lit(0).cast("long"), lambda acc, x: acc + x))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(seated, covered))

    def wider(hashes, size):
        if size == window:
            return counted(hashes)
        step = min(size, window - size)
        n = F.greatest(F.size(hashes) - step, F.lit(0))
        both = F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b))
        return let(both, lambda x: wider(x, size + step))
    return F.when(F.size(words) <= window, F.lit(0).cast("long")).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), lambda x: wider(x, 1)))


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def trusted_ids(labels: DataFrame, bound: int = TRUSTED) -> DataFrame:
    """doc_ids of the documents labelled good (quality 1 in some row), a sample by hash of about `bound` if there are more."""
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return sampled(stage(good, "trusted"), F.col("doc_id"), bound)


def fit(docs: DataFrame, trusted: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> list[int]:
    """The gain of every bucket in thousandths of a natural logarithm: smoothed by one, target over raw corpus.

    docs (doc_id, text, more): every row counts for the raw corpus, those whose doc_id is in trusted (doc_id)
    also for the target. N-grams are summed by bucket before they are shuffled: `buckets` rows a task at most."""
    if buckets & (buckets - 1):
        raise ValueError("buckets must be a power of two")
    seen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    marked = seen.join(small(trusted.select("doc_id").distinct().withColumn("good", F.lit(1))), "doc_id", "left")
    each = marked.select(F.coalesce("good", F.lit(0)).alias("good"), F.explode(grams(words(F.col("text")), longest, buckets, lambda g: g)).alias("bucket"))
    counts = stage(each.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("good").cast("long").alias("good")), "buckets")
    total = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("raw"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")).first()
    ratio = ((F.col("good") + 1.0) * float(total.raw + buckets)) / ((F.col("raw") + 1.0) * float(total.good + buckets))
    learned = {r.bucket: r.gain for r in counts.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).collect()}  # `buckets` rows at most
    blank = docs.sparkSession.range(1).select(F.floor(1000 * F.log(F.lit(float(total.raw + buckets)) / float(total.good + buckets)))).first()[0]
    return [learned.get(k, blank) for k in range(buckets)]


def judged(docs: DataFrame, gains: list[int], longest: int = LONGEST, threshold: int = THRESHOLD, least: int = LEAST, repeated: int = REPEATED) -> DataFrame:
    """docs (doc_id, text, more), one row per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, n_grams, gain (sum of the n-grams' gains) and score (gain by n-gram, in natural logarithms).

    Words lie between white space, case counts. base_failed: fewer than `least` words, or more than `repeated`
    percent of them in windows of 8 words that the text holds twice. Others are kept if the mean gain reaches
    `threshold` thousandths. A null or empty text has no words, fails, and has no score. Rows that repeat a
    doc_id, or have none, are judged each. Whole texts are read; other columns are ignored."""
    table = F.split(F.lit(",".join(map(str, gains))), ",").cast("array<bigint>")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def measured(w):
        scored = grams(w, longest, len(gains), lambda g: let(g, lambda b: F.struct(
            F.size(b).cast("long").alias("n_grams"), F.aggregate(b, F.lit(0).cast("long"), lambda acc, k: acc + F.get(table, k)).alias("gain"))))
        return F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                        repeat_words(w).alias("n_repeat_words"), scored.alias("grams"))

    read = docs.select("doc_id", text.alias("text"))
    seen = read.select("doc_id", F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"), duplicate_lines(F.col("text")).alias("n_dup_lines"),
                       let(words(F.col("text")), measured).alias("m"))
    flat = seen.select("doc_id", "m.n_words", "m.word_chars", "n_symbols", "n_dup_lines", "m.n_repeat_words", "m.grams.n_grams", "m.grams.gain")
    failed = (F.col("n_words") < least) | (100 * F.col("n_repeat_words") > repeated * F.col("n_words"))
    good = (F.col("n_grams") > 0) & (F.col("gain") >= threshold * F.col("n_grams"))
    return flat.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & good).alias("kept"),
                       "n_grams", "gain", F.when(F.col("n_grams") > 0, F.col("gain") / (1000.0 * F.col("n_grams"))).alias("score"))


#: CRC-32 in SQL: the table of its 256 steps, and the code of a word, byte by byte.
SQL_CRC = """crc_table AS (SELECT list(c ORDER BY i) AS steps FROM (
  SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)))"""


def sql_crc(source: str) -> str:
    """(w, c): the code of each distinct word w of a query."""
    return f"""SELECT w, xor(list_reduce(list_concat([4294967295], list_transform(range(length(hex(w)) // 2), lambda k: ('0x' || substr(hex(w), (2 * k + 1)::BIGINT, 2))::BIGINT)),
  lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295) AS c FROM (SELECT DISTINCT w FROM {source}), crc_table"""


SQL = f"""
WITH {SQL_CRC},
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT r, doc_id, t, list_filter(string_split_regex(t, '{SPACE}'), lambda x: x <> '') AS ws FROM d),
w AS (SELECT r, doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM l),
crc AS ({sql_crc('w')}),
c AS (SELECT r, doc_id, i, c, lead(c) OVER (PARTITION BY r ORDER BY i) AS c2 FROM w JOIN crc USING (w)),
g AS (SELECT r, doc_id, c % {BUCKETS} AS b FROM c UNION ALL SELECT r, doc_id, ((c * 31 + c2) % 4294967296) % {BUCKETS} FROM c WHERE c2 IS NOT NULL),
good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
n AS (SELECT b, count(*) AS raw, count(*) FILTER (doc_id IN (SELECT doc_id FROM good)) AS good FROM g GROUP BY b),
f AS (SELECT b, floor(1000 * ln(((good + 1)::DOUBLE * (sum(raw) OVER () + {BUCKETS})::DOUBLE) / ((raw + 1)::DOUBLE * (sum(good) OVER () + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM n),
s AS (SELECT r, count(*) AS n_grams, sum(gain)::BIGINT AS gain FROM g JOIN f USING (b) GROUP BY r),
v AS (SELECT r, unnest(range(1, len(ws) - {WINDOW - 2})) AS i, ws FROM l WHERE len(ws) > {WINDOW}),
k AS (SELECT r, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS k FROM v),
p AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + {WINDOW})) AS j FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS m FROM k) WHERE m > 1) GROUP BY r),
x AS (SELECT l.r, doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda y: length(y))), 0)::BIGINT AS word_chars,
        len(regexp_extract_all(t, '{SYMBOLS}')) AS n_symbols, coalesce(p.n, 0) AS n_repeat_words, coalesce(n_grams, 0) AS n_grams, coalesce(gain, 0) AS gain,
        list_filter(string_split(t, chr(10)), lambda y: regexp_matches(y, '[^\\x20\\x09-\\x0D]')) AS lines
      FROM l LEFT JOIN p USING (r) LEFT JOIN s USING (r)),
y AS (SELECT *, n_words < {LEAST} OR 100 * n_repeat_words > {REPEATED} * n_words AS base_failed FROM x)
SELECT doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND gain >= {THRESHOLD} * n_grams AS kept, n_grams, gain, CASE WHEN n_grams > 0 THEN gain / (1000.0::DOUBLE * n_grams) END AS score
FROM y
"""
