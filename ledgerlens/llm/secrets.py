"""Secret scan with corpus-wide ownership frequency.

Candidates come from patterns. Their hashes are counted by distinct repository and distinct owner over
the whole corpus: a value that many owners carry is a copied example, one that belongs to a few looks
live. The frequency also admits a fourth, looser kind, any long mixed token, which would be noise
without it: only tokens of few owners count. DataFrame functions only.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.tables import small, stage

#: Kinds in the order of their numbers: name, pattern, group with the value, least length of the value.
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"(AKIA[A-Z0-9]+)", 1, 18),
    ("hex", r"([0-9a-f]{16,})", 1, 16),
    ("mixed", r"([A-Za-z0-9+/_=-]{20,})", 1, 20),
)
BASE = 3
#: From so many distinct owners on a value counts as a copied example.
WIDE = 3
PLACE = "[secret]"
#: Steps of a fold that grows an array, and how often groups of so many are put together.
GROUP, LEVELS = 64, 2


def _let(value: Column, then) -> Column:
    """then(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _blocks(values: Column, size: int) -> Column:
    return F.when(F.size(values) > 0, F.transform(
        F.sequence(F.lit(0), F.floor((F.size(values) - 1) / size).cast("int")), lambda k: F.slice(values, k * size + 1, F.lit(size))))


def running(values: Column, step, zero: int, levels: int = LEVELS) -> Column:
    """For every int of an array, the fold of all ints before it. A fold that grows an array copies it at each
    step, so folds cover GROUP ints each, and start from the folds of whole groups: linear in the array's length."""
    def fold(part, start):
        state = F.struct(start.alias("at"), F.array().cast("array<int>").alias("all"))
        return F.aggregate(part, state, lambda acc, x: F.struct(step(acc["at"], x).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")), lambda acc: acc["all"])

    def grouped(parts):
        sums = F.transform(parts, lambda part: F.aggregate(part, F.lit(zero), lambda a, x: step(a, x)))
        return F.flatten(F.zip_with(parts, running(sums, step, zero, levels - 1), fold))

    if not levels:
        return fold(values, F.lit(zero))
    return _let(values, lambda v: F.when(F.size(v) <= GROUP, fold(v, F.lit(zero))).otherwise(_let(_blocks(v, GROUP), grouped)))


def pieces(text: Column, ranges: Column, at: Column | int = 0, levels: int = LEVELS) -> Column:
    """The texts of ascending ranges (start, end); text begins at `at`. A substring is found by walking from the text's
    beginning, so the text is first cut into the stretches of many ranges: linear in its length."""
    if not levels:
        return F.transform(ranges, lambda r: F.substring(text, r["start"] - at + 1, r["end"] - r["start"]))

    def stretch(part):
        first, last = F.get(part, F.lit(0))["start"], F.element_at(part, -1)["end"]
        return _let(F.struct(F.substring(text, first - at + 1, last - first).alias("text"), first.alias("at")),
                    lambda cut: pieces(cut["text"], part, cut["at"], levels - 1))

    return _let(ranges, lambda r: F.when(F.size(r) <= GROUP, pieces(text, r, at, 0)).otherwise(
        F.flatten(F.transform(_blocks(r, GROUP ** levels), stretch))))


def _found(text: Column, kind: int) -> Column:
    """The spans of one kind: leftmost matches that do not overlap, without those whose value is too short.
    Lengths of what lies between the matches and of the matches give the places."""
    _, pattern, group, least = KINDS[kind]
    p = F.lit(pattern)
    parts = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, p, F.lit(0)),
                       lambda gap, match: F.struct(F.length(gap).alias("gap"), F.coalesce(F.length(match), F.lit(0)).alias("size")))
    places = _let(parts, lambda each: F.zip_with(
        each, running(F.transform(each, lambda x: x["gap"] + x["size"]), lambda a, x: a + x, 0),
        lambda x, at: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["size"]).alias("end"))))
    values = F.regexp_extract_all(text, p, F.lit(group))
    # one part more than values: what follows the last match
    spans = F.filter(F.zip_with(places, values, lambda s, v: F.struct(
        s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"), v.alias("value"))), lambda s: s["value"].isNotNull())
    good = F.filter(spans, lambda s: F.length(s["value"]) >= least)
    if kind == BASE:
        good = F.filter(good, lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]"))
    hidden = F.transform(good, lambda s: F.struct(s["start"], s["kind"], s["end"], F.sha2(s["value"], 256).alias("hash")))
    return F.when(text.rlike(pattern), hidden).otherwise(F.array().cast(SPANS))


def _free(spans: Column) -> Column:
    """Sorted spans without mixed tokens that touch one of another kind: those before end, and those after begin, outside."""
    none = 2 ** 31 - 1
    base = lambda s: s["kind"] < BASE

    def apart(all_):
        before = running(F.transform(all_, lambda s: F.when(base(s), s["end"]).otherwise(0)), F.greatest, 0)
        after = F.reverse(running(F.transform(F.reverse(all_), lambda s: F.when(base(s), s["start"]).otherwise(none)), F.least, none))
        edges = F.zip_with(before, after, lambda x, y: F.struct(x.alias("before"), y.alias("after")))
        kept = F.zip_with(all_, edges, lambda s, e: F.when(base(s) | (e["before"] <= s["start"]) & (e["after"] >= s["end"]), s))
        return F.filter(kept, lambda s: s.isNotNull())

    mixed = F.exists(spans, lambda s: ~base(s)) & F.exists(spans, base)
    return F.when(mixed, _let(spans, apart)).otherwise(spans)


SPANS = "array<struct<start:int,kind:int,end:int,hash:string>>"


def candidates(docs: DataFrame, repository: Column | None = None, owner: Column | None = None) -> DataFrame:
    """doc_id, digest of the row's id and text, repository, owner, and the candidate spans of every row, by start
    and kind; mixed tokens that touch a span of another kind are left out. Values leave here only as hashes."""
    repository = F.col("source") if repository is None else repository
    owner = F.split_part(repository.cast("string"), F.lit("/"), F.lit(1)) if owner is None else owner
    read = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                       F.coalesce(repository.cast("string"), F.lit("")).alias("repository"), F.coalesce(owner.cast("string"), F.lit("")).alias("owner"))
    digest = F.sha2(F.concat_ws("\n", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "text"), 256)
    spans = F.array_sort(F.concat(*[_found(F.col("text"), k) for k in range(BASE + 1)]))
    split = read.select("doc_id", digest.alias("digest"), "repository", "owner", spans.alias("spans"))
    return split.withColumn("spans", _free(F.col("spans")))


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_rows, n_repositories and n_owners of every candidate value. Rows are first summed by value, owner
    and repository, so a value that a third of all rows carry is a few rows when it is shuffled."""
    each = found.select(F.explode("spans.hash").alias("hash"), "owner", "repository")
    repos = each.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"))
    owners = repos.groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("r"))
    return owners.groupBy("hash").agg(F.sum("n").alias("n_rows"), F.sum("r").alias("n_repositories"), F.count("*").alias("n_owners"))


def judged(found: DataFrame, wide: int = WIDE) -> DataFrame:
    """digest and spans (start, kind, end, live) of the rows with candidates: base spans, and mixed tokens that
    are not widely copied. found: a stage table of candidates."""
    counts = small(stage(ownership(found).select("hash", "n_owners"), "owners"))
    each = found.dropDuplicates(["digest"]).select("digest", F.explode("spans").alias("s")).select("digest", "s.*").join(counts, "hash")
    live = F.col("n_owners") < wide
    kept = each.where(live | (F.col("kind") < BASE))
    return kept.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", live.alias("live")))).alias("spans"))


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def scan(docs: DataFrame, repository: Column | None = None, owner: Column | None = None, wide: int = WIDE) -> DataFrame:
    """docs (doc_id, text, source, more), one row per row: doc_id, n_assign, n_access, n_hex, base_sha256 (of the
    base spans as kind:start:end by start and kind, comma-joined, code points), spans (all of them, joined
    likewise), n_mixed, n_live (of few owners) and n_example (widely copied).

    Whole texts are read; a null text is empty and has no spans. A null source is one nameless
    repository. Rows that repeat a doc_id are scanned each; repeated rows count once an owner. Columns
    other than doc_id, text and those the repository and owner are taken from are ignored."""
    found = stage(candidates(docs, repository, owner), "candidates")
    base = F.filter("base", lambda s: s["kind"] < BASE)

    def count(test):
        return F.size(F.filter("spans", test)).cast("long")

    def of(kind):
        return count(lambda s: s["kind"] == kind).alias(f"n_{KINDS[kind][0]}")

    out = found.select("doc_id", "digest", F.col("spans").alias("base")).join(judged(found, wide), "digest", "left")
    out = out.withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:int,kind:int,end:int,live:boolean>>")))
    return out.select("doc_id", *map(of, range(BASE)),
                      F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
                      of(BASE), count(lambda s: s["live"]).alias("n_live"),
                      count(lambda s: ~s["live"]).alias("n_example"))


def redacted(docs: DataFrame, repository: Column | None = None, owner: Column | None = None, wide: int = WIDE) -> DataFrame:
    """The documents with each live span (overlapping ones as one) replaced by a mark, and n_chars, if there is
    such a column, set to the new length. Copied examples stay. All rows and columns stay."""
    found = stage(candidates(docs, repository, owner).where(F.size("spans") > 0), "candidates")
    live = stage(judged(found, wide).select("digest", F.filter("spans", lambda s: s["live"]).alias("live")).where(F.size("live") > 0)
                 .join(found.select("digest", "doc_id").distinct(), "digest"), "live")
    marked = docs.withColumn("secret_row", F.sha2(F.concat_ws("\n", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce(F.col("text").cast("string"), F.lit(""))), 256))
    hit = marked.join(small(live.select(F.col("digest").alias("secret_row"), F.col("live").alias("secret_spans"))), "secret_row", "left")
    text, spans = F.col("text"), F.col("secret_spans")
    # what lies between the spans, those that overlap as one, and after the last
    before = F.zip_with(spans, running(F.transform(spans, lambda s: s["end"]), F.greatest, 0),
                        lambda s, end: F.struct(end.alias("start"), s["start"].alias("end")))
    rest = F.array(F.struct(F.array_max(F.transform(spans, lambda s: s["end"])).alias("start"), F.length(text).alias("end")))
    clean = F.array_join(pieces(text, F.concat(F.filter(before, lambda r: r["start"] <= r["end"]), rest)), PLACE)
    out = hit.withColumn("text", F.when(F.col("secret_spans").isNotNull(), clean).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("secret_spans").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def _sql_spans(kind: int) -> str:
    _, pattern, group, least = KINDS[kind]
    p = "'" + pattern.replace("'", "''") + "'"
    mixed = "AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')" if kind == BASE else ""
    return f"""SELECT doc_id, owner, start, {kind} AS kind, start + length(m) AS stop, sha256(v) AS hash FROM (
      SELECT doc_id, owner, m, v, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS start
      FROM (SELECT *, unnest(ms) AS m, unnest(vs) AS v, unnest(range(1, len(ms) + 1)) AS i FROM (
        SELECT doc_id, owner, regexp_extract_all(t, {p}) AS ms, regexp_extract_all(t, {p}, {group}) AS vs,
               regexp_split_to_array(t, {p}) AS gaps FROM d))) WHERE length(v) >= {least} {mixed}"""


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner FROM documents),
raw AS ({' UNION ALL '.join(_sql_spans(k) for k in range(4))}),
cand AS (SELECT * FROM raw m WHERE kind < 3 OR NOT EXISTS (
  SELECT 1 FROM raw b WHERE b.doc_id = m.doc_id AND b.kind < 3 AND b.start < m.stop AND m.start < b.stop)),
freq AS (SELECT hash, count(DISTINCT split_part(owner, '/', 1)) < {WIDE} AS live FROM cand GROUP BY hash),
kept AS (SELECT doc_id, start, kind, live, ['assign', 'access', 'hex', 'mixed'][kind + 1] || ':' || start || ':' || stop AS s
         FROM cand JOIN freq USING (hash) WHERE live OR kind < 3)
SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
       sha256(coalesce(string_agg(s, ',' ORDER BY start, kind) FILTER (kind < 3), '')) AS base_sha256,
       coalesce(string_agg(s, ',' ORDER BY start, kind), '') AS spans, count(*) FILTER (kind = 3) AS n_mixed,
       count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example
FROM documents LEFT JOIN kept USING (doc_id) GROUP BY doc_id
"""
