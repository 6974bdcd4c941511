"""Driver queries: text scalars, sectioning, chunking, similarity and tone, over whole documents."""
import re

from pyspark.sql import Window, functions as F

from checks.views import documents, filing, pages, r6, r8, sql, t, vectors
from ledgerlens import policies as P
from ledgerlens.functions import arrays as AR, strings as T
from ledgerlens.operators import aggregates as A, similarity as M, text as X
from ledgerlens.plans import text_signals as TS

Q_, S_ = {}, {}


def reg(name, oracle=None):
    def deco(fn):
        Q_[name] = fn
        if oracle:
            S_[name] = oracle
        return fn
    return deco


WORDS = ("of the", "tion", "heren")  # words that occur in the generated documents


# ---------------------------------------------------------------- AGG-23
@reg("text_concat", """SELECT conv_id, md5(string_agg(trim(text, ' '), chr(10) ORDER BY turn, trim(text, ' '))) AS digest FROM conversations WHERE trim(text, ' ')<>'' GROUP BY 1""")
def text_concat(spark, d):
    c = A.ordered_concat(t(spark, d, "conversations"), ["conv_id"], "text", ["turn"])
    return c.select("conv_id", F.md5("text").alias("digest"))


# ---------------------------------------------------------------- SRT-03 WIN-12
@reg("narrative_order", """SELECT doc_id, CASE lang WHEN 'en' THEN 10 WHEN 'fr' THEN 20 WHEN 'de' THEN 30 WHEN 'es' THEN 40 ELSE 999 END AS section_rank,
 len(string_split(text, chr(10))) AS lines FROM documents""")
def narrative_order(spark, d):
    names = F.create_map(*[F.lit(x) for kv in {"en": "business", "fr": "risk_factors", "de": "forward_looking", "es": "mda"}.items() for x in kv])
    return documents(spark, d).select("doc_id", X.section_rank(names[F.col("lang")]).alias("section_rank"),
                                           F.size(F.split("text", "\n")).alias("lines"))


# ---------------------------------------------------------------- STR-02 STR-03 STR-04 STR-08 STR-09 FIL-08
_NONPRINT = r"[\x00-\x1f\x7f-\x{a0}\x{ad}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{206f}\x{3000}\x{feff}]"


@reg("string_scalars", f"""SELECT doc_id, md5(c) AS clean, CASE WHEN length(c)>140 THEN replace(substr(c,1,140),chr(10),' ')||'...' ELSE c END AS preview,
 regexp_matches(lower(text), '{'|'.join(WORDS)}') AS forward, length(trim(substr(text,1,9)))<8 AS garbage
 FROM (SELECT *, trim(regexp_replace(regexp_replace(text, '{_NONPRINT}', ' ', 'g'), '\\s+', ' ', 'g'), ' ') AS c FROM documents)""")
def string_scalars(spark, d):
    x = documents(spark, d)
    clean = T.heading_text(F.col("text"))
    return x.select("doc_id", F.md5(clean).alias("clean"), T.preview(clean, 140).alias("preview"), T.is_forward_looking(F.col("text"), WORDS).alias("forward"),
                    T.is_garbage(F.substring("text", 1, 9), F.lit(None).cast("string")).alias("garbage"))


# ---------------------------------------------------------------- STR-07 AGG-22 SET-05
@reg("tokens", """SELECT token, count(*) AS doc_count, sum(n)::BIGINT AS total_count FROM (SELECT doc_id, lower(tok) AS token, count(*) AS n FROM
 (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9'']+')) AS tok FROM documents) GROUP BY 1,2) GROUP BY 1""")
def tokens(spark, d):
    return A.document_frequency(A.term_counts(documents(spark, d), ["doc_id"], "text"))


# ---------------------------------------------------------------- STR-06 TXT-10 TXT-11
_WS = r"trim(regexp_replace({0}, '\s+', ' ', 'g'), ' ')"


@reg("sentences", f"""SELECT doc_id, len(list_filter(s, lambda x: length(trim(x))>=40)) AS long_sentences, list_sum(list_transform(s, lambda x: length(trim(x))))::BIGINT AS chars FROM
 (SELECT doc_id, string_split(regexp_replace({_WS.format('text')}, '([.!?;:])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM documents)""")
def sentences(spark, d):
    x = documents(spark, d)
    parts = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), r"(?<=[.!?;:])\s+")
    return x.select("doc_id", F.size(F.filter(parts, lambda s: F.length(F.trim(s)) >= P.DRIFT_SENTENCE_MIN_CHARS)).alias("long_sentences"),
                    F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, s: a + F.length(F.trim(s))).alias("chars"))


@reg("paragraph_blocks", f"""SELECT doc_id, len(list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n+'), lambda b: {_WS.format('b')}), lambda b: length(b)>=50)) AS blocks FROM documents""")
def paragraph_blocks(spark, d):
    return documents(spark, d).select("doc_id", F.size(X.paragraph_blocks(F.col("text"))).alias("blocks"))


# rows only: greedy packing has carried state; brute-force tests cover it
@reg("drift_units")
def drift_units(spark, d):
    u = X.with_drift_units(documents(spark, d).select("doc_id", "text"))
    return u.select("doc_id", F.posexplode("units").alias("unit_idx", "unit"))


# ---------------------------------------------------------------- STR-11 STR-13 TXT-17 STR-12 FIL-09
@reg("url_canonical", """SELECT page_id, u AS url, sha256('url:'||lower(u)) AS dedupe_hash FROM (SELECT page_id, scheme||'://'||host||path||CASE WHEN q='' THEN '' ELSE '?'||q END AS u FROM (
 SELECT page_id, lower(regexp_extract(url,'^([A-Za-z]+)://',1)) AS scheme, lower(regexp_extract(url,'^[A-Za-z]+://([^/?#]*)',1)) AS host, regexp_extract(url,'^[A-Za-z]+://[^/?#]*([^?#]*)',1) AS path,
 array_to_string(list_sort(list_filter(string_split(regexp_extract(url,'^[^?#]*\\?([^#]*)',1),'&'), lambda p: regexp_matches(p,'^[^=]+=.+') AND NOT starts_with(lower(p),'utm_')
   AND split_part(lower(p),'=',1) NOT IN ('guccounter','guce_referrer','guce_referrer_sig','oc'))),'&') AS q FROM pages))""")
def url_canonical(spark, d):
    from ledgerlens.sources.files import normalise_news
    p = pages(spark, d)
    # the date carries the page number, so that rows can be matched after cleaning
    raw = p.select(F.lit("abc").alias("ticker"), F.concat(F.lit("Page number "), "page_id").alias("headline"), F.lit("<b>x</b> &amp; y").alias("summary"), "url",
                   F.lit(None).cast("string").alias("publisher"), F.lit("Mon, 05 Feb 2024 10:00:00 GMT").alias("published_at"))
    n = normalise_news(raw, F.lit("2024-02-05").cast("timestamp"))
    return n.select(F.regexp_extract("headline", r"(\d+)$", 1).cast("bigint").alias("page_id"), "url", "dedupe_hash")


# ---------------------------------------------------------------- TXT-01 TXT-02
# a page is a list of links, an advert, an article of a heading and paragraphs (some never closed), and a footer outside the blocks
_DECODED = "x"
for _a, _b in (("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _DECODED = f"replace({_DECODED}, '{_a}', '{_b}')"
_PAGE = f"""SELECT page_id, list_filter(list_transform(list_concat(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1), [regexp_extract(html, '<div class="ad">([^<]*)</div>', 1)],
 list_transform(string_split(regexp_replace(replace(replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<p>', chr(1)), '<h1>', chr(1)), '<[^>]*>', ' ', 'g'), chr(1)), lambda x: x)),
 lambda x: {_WS.format("regexp_replace(" + _DECODED + ", '" + _NONPRINT + "', ' ', 'g')")}), lambda x: length(x) >= 8) AS b FROM pages"""


@reg("html_blocks", f"SELECT page_id, len(b) AS blocks, coalesce(list_sum(list_transform(b, lambda x: length(x))), 0)::BIGINT AS chars, md5(array_to_string(b, chr(10))) AS digest FROM ({_PAGE})")
def html_blocks(spark, d):
    b = X.html_blocks(F.col("html"))
    return pages(spark, d).select("page_id", b.alias("b")).select("page_id", F.size("b").alias("blocks"), F.aggregate(
        "b", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)).alias("chars"), F.md5(F.array_join("b", "\n")).alias("digest"))


@reg("text_blocks", f"""SELECT doc_id, len(list_filter(list_transform(string_split(text, chr(10)), lambda x: {_WS.format("regexp_replace(x, '" + _NONPRINT + "', ' ', 'g')")}), lambda x: x<>'')) AS lines FROM documents""")
def text_blocks(spark, d):
    return documents(spark, d).select("doc_id", F.size(X.text_blocks(F.col("text"))).alias("lines"))


# ---------------------------------------------------------------- TXT-03..06 STR-05 WIN-11 SET-03 SET-04
def _filings_from_documents(spark, d):
    """Every document as a plain-text filing: its lines under the headings of an annual report."""
    x = documents(spark, d)
    body = F.regexp_replace("text", r"(?i)item\s+\d|signatures|cautionary", "word")
    text = F.concat(F.lit("ITEM 1. BUSINESS\n"), body, F.lit("\nItem 1A. Risk Factors\n"), body, F.lit("\nItem 2. Properties\nnone\nItem 7. Discussion\n"), body,
                    F.lit("\nCautionary statement\n"), body, F.lit("\nSIGNATURES\n"), body)
    return x.select(F.col("doc_id").alias("filing_id"), F.col("doc_id").alias("company_id"), F.lit("10-K").alias("form_type"), text.alias("raw_text"))


_BODY = f"""SELECT doc_id, trim(regexp_replace(regexp_replace(array_to_string(list_filter(list_transform(string_split(regexp_replace(text, '(?i)item\\s+\\d|signatures|cautionary', 'word', 'g'), chr(10)),
  lambda x: {_WS.format("regexp_replace(x, '" + _NONPRINT + "', ' ', 'g')")}), lambda x: x<>''),' '), '\\s{{2,}}', ' ', 'g'),'^$',''),' ') AS body FROM documents"""


@reg("sections", sql("""SELECT doc_id AS filing_id, s.section, s.sequence_idx::SMALLINT AS sequence_idx, length(CASE WHEN s.section='mda' THEN body||' Cautionary statement '||body ELSE body END) AS char_count,
 md5(CASE WHEN s.section='mda' THEN body||' Cautionary statement '||body ELSE body END) AS digest FROM b, (VALUES ('business',0),('risk_factors',0),('mda',0),('forward_looking',0)) s(section, sequence_idx)
 WHERE length(CASE WHEN s.section='mda' THEN body||' Cautionary statement '||body ELSE body END)>=200""", b=_BODY))
def sections(spark, d):
    s = X.section_rows(X.split_sections(_filings_from_documents(spark, d)))
    return s.select("filing_id", "section", "sequence_idx", "char_count", F.md5("text").alias("digest"))


@reg("section_warnings", sql("""SELECT doc_id AS filing_id, w.warning FROM b, (VALUES ('section_not_found:business', 1),('section_not_found:risk_factors', 1),('section_not_found:mda', 2),('short', 3)) x(n, kind),
 LATERAL (SELECT CASE kind WHEN 3 THEN 'section_too_short:forward_looking:'||length(body) ELSE n END AS warning) w
 WHERE (kind IN (1,3) AND length(body)<200) OR (kind=2 AND length(body||' Cautionary statement '||body)<200)
 UNION ALL SELECT doc_id, 'no_sections_found' FROM b WHERE length(body||' Cautionary statement '||body)<200""", b=_BODY.replace("AS body", "AS body")))
def section_warnings(spark, d):
    return X.warning_rows(X.split_sections(_filings_from_documents(spark, d))).select("filing_id", "warning")


@reg("headings", """SELECT doc_id AS filing_id, x.item_code, x.section FROM documents, (VALUES ('1','business'),('1A','risk_factors'),('2',NULL),('7','mda')) x(item_code, section)""")
def headings(spark, d):
    return X.find_headings(X.annotate_blocks(_filings_from_documents(spark, d)), ["filing_id"]).select("filing_id", "item_code", "section")


@reg("html_sections", f"""SELECT page_id AS filing_id, page_id AS company_id, 'mda' AS section, 0::SMALLINT AS sequence_idx, t AS text, length(t) AS char_count
 FROM (SELECT page_id, array_to_string(b, ' ') AS t FROM ({_PAGE})) WHERE length(t) >= 200""")
def html_sections(spark, d):
    p = pages(spark, d).select(F.col("page_id").alias("filing_id"), F.col("page_id").alias("company_id"), F.lit("10-Q").alias("form_type"),
                                    F.concat(F.lit("<div>Item 2. Management Discussion</div>"), "html", F.lit("<p>Item 6. Exhibits</p>")).alias("raw_text"))
    return X.section_rows(X.split_sections(p))


# ---------------------------------------------------------------- SET-03 SET-04 SET-05
@reg("set_ops", """SELECT lang, n_missing, missing, extra FROM (SELECT lang, 20 - count(DISTINCT source) AS n_missing,
 array_to_string(list_sort(list_filter(list_transform(range(0,20), lambda i: 'src'||i), lambda s: NOT list_contains(list(DISTINCT source), s))),',') AS missing, count(DISTINCT source) FILTER (source NOT IN ('src1','src2')) AS extra
 FROM documents GROUP BY lang)""")
def set_ops(spark, d):
    seen = documents(spark, d).select("lang", "source").distinct()
    wanted = seen.select("lang").distinct().select("lang", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("i")).select(
        "lang", F.concat(F.lit("src"), F.col("i")).alias("source"))
    missing = wanted.exceptAll(seen).groupBy("lang").agg(F.count(F.lit(1)).alias("m"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("missing"))
    items = seen.where("source IN ('src1', 'src2')").select("source").distinct()  # found by item; the rest comes from the extra extractor
    extra = seen.join(items, "source", "left_anti").groupBy("lang").agg(F.count(F.lit(1)).alias("extra"))
    return (seen.select("lang").distinct().join(missing, "lang", "left").join(extra, "lang", "left")
            .select("lang", F.coalesce("m", F.lit(0)).alias("n_missing"), F.coalesce("missing", F.lit("")).alias("missing"), F.coalesce("extra", F.lit(0)).alias("extra")))


# ---------------------------------------------------------------- TXT-07..09 MTH-23 UDF-03
@reg("chunks")
def chunks(spark, d):
    x = documents(spark, d).select(F.col("doc_id").alias("filing_id"), F.lit(0).cast("bigint").alias("company_id"), F.col("doc_id").alias("section_id"),
                                        F.lit("mda").alias("section"), F.lit(0).alias("sequence_idx"), "text")
    c = X.chunk_sections(x)
    return c.select("filing_id", "chunk_idx", "char_count", "approx_tokens", F.md5("text").alias("digest"), F.substring(X.chunk_previews(c, 40), 1, 80).alias("preview"))


# ---------------------------------------------------------------- ARR-01 ARR-02 ARR-03 ARR-05
_DOT = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@reg("cosine", f"""SELECT a.vec_id, 64 AS dimension, round(c,6)+0e0 AS cosine, round((1-c)/2,6)+0e0 AS distance, round((1+c)/2,6)+0e0 AS similarity, round(n,6)+0e0 AS unit_norm
 FROM (SELECT a.vec_id, greatest(-1.0,least(1.0,{_DOT}/sqrt(list_dot_product(a.embedding::DOUBLE[],a.embedding::DOUBLE[]))/sqrt(list_dot_product(b.embedding::DOUBLE[],b.embedding::DOUBLE[])))) AS c, 1.0::DOUBLE AS n
 FROM embeddings a JOIN embeddings b ON b.vec_id=a.vec_id-1) a""")
def cosine(spark, d):
    e = t(spark, d, "embeddings")
    prev = e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("p"))
    j = e.join(prev, "vec_id").withColumn("c", AR.cosine(F.col("embedding"), F.col("p")))
    return j.select("vec_id", F.size("embedding").alias("dimension"), r6(F.col("c")).alias("cosine"), r6(AR.cosine_distance01(F.col("embedding"), F.col("p"))).alias("distance"),
                    r6(AR.cosine_similarity01(F.col("embedding"), F.col("p"))).alias("similarity"), r6(AR.norm(AR.unit_vector(F.col("embedding")))).alias("unit_norm"))


# ---------------------------------------------------------------- TXT-14 TXT-15 JON-13 AGG-18 SRT-04 MTH-14
_BEST = dict(best="""SELECT a.filing_id, a.chunk_idx, max(greatest(-1.0,least(1.0,list_dot_product(a.embedding::DOUBLE[],b.embedding::DOUBLE[])
  /sqrt(list_dot_product(a.embedding::DOUBLE[],a.embedding::DOUBLE[]))/sqrt(list_dot_product(b.embedding::DOUBLE[],b.embedding::DOUBLE[]))))) AS best
  FROM v_vec a JOIN v_vec b ON b.filing_id=a.filing_id-1 GROUP BY 1,2""",
             ranked="SELECT *, (1-best)/2 AS nov, row_number() OVER (PARTITION BY filing_id ORDER BY best, chunk_idx) AS rn, count(*) OVER (PARTITION BY filing_id) AS n FROM best")


def _pairs(ids):
    return ids.select("filing_id", (F.col("filing_id") - 1).alias("previous_filing_id")).where(F.col("previous_filing_id") >= 0)


@reg("novelty", sql("""SELECT filing_id, round(avg(nov) FILTER (rn<=least(n,greatest(3,ceil(n*.25)))),6)+0e0 AS semantic_novelty, round(avg(nov),6)+0e0 AS novelty_mean,
 max(least(n,greatest(3,ceil(n*.25))))::INT AS novelty_top_k_count, array_to_string(list(chunk_idx ORDER BY rn) FILTER (rn<=5),',') AS top_chunks FROM ranked GROUP BY 1""", "v_vec", **_BEST))
def novelty(spark, d):
    v = vectors(spark, d)
    n = TS.semantic_novelty(_pairs(v.select("filing_id").distinct()), v)
    return n.select("filing_id", r6(F.col("semantic_novelty")).alias("semantic_novelty"), r6(F.col("novelty_mean")).alias("novelty_mean"), "novelty_top_k_count",
                    F.array_join(F.transform("top_novel_chunks", lambda x: x.cast("string")), ",").alias("top_chunks"))


@reg("section_similarity", sql("SELECT filing_id, round(avg(best),6)+0e0 AS average_best_similarity, round((1-avg(best))/2,6)+0e0 AS drift_score FROM best GROUP BY 1", "v_vec", **_BEST))
def section_similarity(spark, d):
    v = vectors(spark, d)
    s = TS.section_similarity(_pairs(v.select("filing_id").distinct()), v)
    return s.select("filing_id", *[r6(F.col(c)).alias(c) for c in ("average_best_similarity", "drift_score")])


# ---------------------------------------------------------------- SRT-05 MTH-15 (top-k over a score)
@reg("topk_mean", """SELECT vec_id//20 AS filing_id, round(avg(s) FILTER (rn<=least(n,greatest(3,ceil(n*.25)))),4)+0e0 AS top_k_mean, max(n) AS unit_count, round(avg(s),4)+0e0 AS global_mean FROM
 (SELECT *, row_number() OVER (PARTITION BY vec_id//20 ORDER BY s DESC, vec_id) AS rn, count(*) OVER (PARTITION BY vec_id//20) AS n FROM
  (SELECT vec_id, abs(embedding[1]::DOUBLE) AS s FROM embeddings)) GROUP BY 1""")
def topk_mean(spark, d):
    x = t(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 20).alias("filing_id"), "vec_id", F.abs(F.get("embedding", F.lit(0)).cast("double")).alias("s"))
    k = M.top_k_mean(x, ["filing_id"], "s", "vec_id")
    return k.select("filing_id", (F.round("top_k_mean", 4) + 0.0).alias("top_k_mean"), "unit_count", (F.round("global_mean", 4) + 0.0).alias("global_mean"))


# ---------------------------------------------------------------- TXT-12 TXT-13
_TF = dict(
    tok="SELECT doc_id, lower(tok) AS tok, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9'']+')) AS tok FROM documents) GROUP BY 1,2",
    tf="SELECT doc_id, tok, n*1.0/sum(n) OVER (PARTITION BY doc_id) AS tf FROM tok",
    pr="SELECT doc_id AS cur, doc_id-1 AS prev FROM documents WHERE doc_id>0",
    voc="""SELECT cur, prev, coalesce(a.tok,b.tok) AS tok, a.tf AS fa, b.tf AS fb FROM (SELECT cur, prev, tok, tf FROM pr JOIN tf ON tf.doc_id=cur) a
      FULL JOIN (SELECT cur, prev, tok, tf FROM pr JOIN tf ON tf.doc_id=prev) b USING (cur, prev, tok)""",
    wv="SELECT cur, prev, coalesce(fa,0)*idf AS wa, coalesce(fb,0)*idf AS wb FROM (SELECT *, ln(3.0/(1+(fa IS NOT NULL)::INT+(fb IS NOT NULL)::INT))+1 AS idf FROM voc)")


@reg("tfidf_pairs", sql("""SELECT pr.cur AS filing_id, round(coalesce(s,0),6)+0e0 AS similarity FROM pr LEFT JOIN (SELECT cur, prev, greatest(0.0,least(1.0,sum(wa*wb)/nullif(sqrt(sum(wa*wa))*sqrt(sum(wb*wb)),0))) AS s FROM wv GROUP BY 1,2) x
 ON x.cur=pr.cur AND x.prev=pr.prev""", **_TF))
def tfidf_pairs(spark, d):
    x = documents(spark, d)
    pairs = _pairs(x.select(F.col("doc_id").alias("filing_id")))
    c = A.term_counts(x, ["doc_id"], "text").withColumnRenamed("doc_id", "filing_id")
    s = M.tfidf_similarity(pairs, c, "filing_id", "previous_filing_id", "filing_id")
    return s.select("filing_id", r6(F.col("similarity")).alias("similarity"))


# unit-level drift over whole documents: too slow as SQL (all unit pairs); brute force covers it on fixtures
@reg("tfidf_drift")
def tfidf_drift(spark, d):
    x = documents(spark, d).select(F.col("doc_id").alias("filing_id"), "text")
    f = TS.tfidf_drift(_pairs(x.select("filing_id")), x)
    return f.select("filing_id", r6(F.col("tfidf_drift")).alias("tfidf_drift"), "tfidf_unit_count", "tfidf_aggregation")


# ---------------------------------------------------------------- TXT-16 SRT-06 STR-20 SIG-03 SIG-04
# every sentence is made a paragraph of its own; one over 800 characters is cut hard
_PARA = f"""SELECT doc_id, u.p AS para, u.i AS pos FROM (SELECT doc_id, flatten(list_transform(list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10) || chr(10), 'g'),
   '\\n\\s*\\n+'), lambda b: {_WS.format('b')}), lambda b: length(b) >= 50), lambda b: list_filter(list_transform(range(0, length(b), 800), lambda i: trim(substr(b, i+1, 800))), lambda x: x<>''))) AS ps FROM documents),
   LATERAL (SELECT unnest(ps) AS p, unnest(range(1, len(ps)+1)) AS i) u"""


@reg("tone", sql(f"""SELECT doc_id AS filing_id, count(*) AS paragraph_count, count(p) AS paragraphs_scored, round(avg(p),8)+0e0 AS text_sentiment,
 round((coalesce(avg(q) FILTER (fwd), avg(q)) - coalesce(avg(p) FILTER (fwd), avg(p)) + 1)/2.0,8)+0e0 AS forward_pessimism
 FROM (SELECT *, regexp_matches(lower(para), '{'|'.join(WORDS)}') AS fwd, CASE WHEN length(para)%7<>0 THEN (length(para)%100)/101.0::DOUBLE END AS p, CASE WHEN length(para)%7<>0 THEN 1-(length(para)%100)/101.0::DOUBLE END AS q
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn FROM pa)) GROUP BY 1""", pa=_PARA))
def tone(spark, d):
    x = documents(spark, d).select(F.col("doc_id").alias("filing_id"), F.lit("mda").alias("section"), F.lit(0).alias("sequence_idx"), F.col("doc_id").alias("section_id"), "text")
    x = x.withColumn("text", F.regexp_replace("text", r"([.!?])\s+", "$1\n\n"))
    p = TS.tone_paragraphs(x, keywords=WORDS)
    n = F.length("text")
    pos = F.when(n % 7 != 0, (n % 100) / 101.0)
    f = TS.tone_features(p.withColumns({"positive": pos, "negative": 1 - pos, "neutral": pos * 0}))
    return f.select("filing_id", "paragraph_count", "paragraphs_scored", *[r8(F.col(c)).alias(c) for c in ("text_sentiment", "forward_pessimism")])


# rows only: the whole text layer in one plan, documents as sections, vectors as their embeddings
@reg("drift_signal")
def drift_signal(spark, d):
    f = filing(spark, d)
    docs, vec = documents(spark, d), t(spark, d, "embeddings")
    s = docs.select(F.col("doc_id").alias("filing_id"), F.lit("risk_factors").alias("section"), F.lit(0).alias("sequence_idx"), "text")
    e = vec.select(F.floor(F.col("vec_id") / 5).alias("filing_id"), F.lit("risk_factors").alias("section"), F.lit(0).alias("sequence_idx"),
                   (F.col("vec_id") % 5).alias("chunk_idx"), "embedding")
    g = TS.drift_features(f, s, e, "risk_factors")
    return g.select("filing_id", "previous_filing_id", r6(F.col("raw_score")).alias("raw_score"), r6(F.col("signal_value")).alias("signal_value"), "scoring_mode",
                    r6(F.col("confidence")).alias("confidence"))
