from datetime import date, datetime

from pyspark.sql import functions as F

from ledgerlens import policies as P
from ledgerlens.functions import arrays as AR, dates as D, jsonpath as J, scoring as S, strings as T


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def null():
    return F.lit(None).cast("double")


def test_null_propagates_through_every_score(spark):
    x = null()
    r = one(spark, S.clip01(x), S.negative_delta_score(x, .2), S.positive_shift_score(x, .1), S.absolute_shift_score(x, 1.0),
            S.cash_flow_quality_score(x), S.conversion_weakness_score(x), S.rescale(x), S.fixed_range(x), S.growth(x, x),
            S.weighted_average({"a": x, "b": x}, {"a": .5, "b": .5}), S.price_earnings(x, F.lit(1.0), F.lit(1.0)))
    assert all(v is None for v in r)
    assert one(spark, S.risk_label(x))[0] == "UNKNOWN"


def test_scores(spark):
    d = F.lit
    r = one(spark, S.clip01(d(1.7)), S.rescale(d(0.045)), S.rescale(d(0.2)), S.top_k_count(d(2)), S.top_k_count(d(40)),
            S.weighted_average({"a": d(1.0), "b": null()}, {"a": .4, "b": .6}), S.safe_divide(d(1.0), d(0.0)),
            S.token_estimate(d("abcdef")), S.safe_float(d("NaN")), S.safe_float(d("2.5")), S.concentration_step(d(9)))
    assert r[0] == 1.0 and abs(r[1] - 0.5) < 1e-12 and r[2] == 1.0 and (r[3], r[4]) == (2, 10) and r[5] == 1.0
    assert r[6] is None and r[7] == 2 and r[8] is None and r[9] == 2.5 and r[10] == 1.0


def test_dates(spark):
    d = lambda s: F.lit(s).cast("date")
    r = one(spark, D.business_days(d("2024-01-05"), d("2024-01-09")), D.business_days(d("2024-01-09"), d("2024-01-05")),
            D.business_days(d("2024-01-05"), d("2024-01-07")), D.parse_timestamp(F.lit("Mon, 17 Apr 2026 12:30:00 GMT")),
            D.parse_timestamp(F.lit("2024-02-01T10:00:00+02:00")), D.parse_timestamp(F.lit("Fri, 5 Jan 2024 08:00:00 -0500")),
            D.iso_date(F.lit("2024-13-01")), D.quarter_token(F.lit("q3")), D.quarter_token(F.lit("FY")), D.epoch_date(F.lit(1713398400)))
    assert r[0] == 2 and r[1] == 0 and r[2] == 0 and r[3] == datetime(2026, 4, 17, 12, 30) and r[4] == datetime(2024, 2, 1, 8)
    assert r[5] == datetime(2024, 1, 5, 13) and r[6] is None and r[7] == 3 and r[8] is None and r[9] == date(2024, 4, 18)


def test_strings(spark):
    L = F.lit
    r = one(spark, T.tagged_number(L("(50.0)"), L(None).cast("string"), L("6")), T.tagged_number(L("$1,250"), L("-"), L(None).cast("string")),
            T.tagged_number(L("—"), L(None).cast("string"), L("0")), T.unit_token(L("iso4217:USD")), T.item_code(L("Item 1A. Risk")),
            T.item_code(L("ITEM 10 x")), T.item_code(L("see item 1")), T.pad10(L("12345678901")), T.number_text(L(1200.50)),
            T.role_name(L("Executive Vice President"), L(False)), T.role_name(L("President and CEO"), L(True)),
            T.storage_key(L("1"), L("10-K/A"), L("x")), T.ownership_nature(L("D")), T.flag(L("Yes")), T.plain_number(L("1,200")),
            T.plain_number(L("N/A")), T.unescape_entities(L("a &eacute; &#39;b&#39;")))
    assert r[0] == -50e6 and r[1] == -1250 and r[2] is None and r[3] == "USD" and r[4] == "1A" and r[5] == "10" and r[6] is None
    assert r[7] == "12345678901" and r[8] == "1200.5" and r[9] == "Other Officer" and r[10] == "CEO"
    assert r[11] == "1/10-K_A/x.txt" and r[12] == "direct" and r[13] is True and r[14] == 1200 and r[15] is None and r[16] == "a é 'b'"
    h, p = T.headline_and_publisher(L("Big - move - Wire"), L(None).cast("string"))
    assert tuple(one(spark, h, p)) == ("Big - move", "Wire")
    u = one(spark, T.canonical_url(L("HTTPS://Ex.com:8/a?utm_x=1&b=2&a=1&c=#f")), T.canonical_url(L("no scheme")))
    assert u[0] == "https://ex.com:8/a?a=1&b=2" and u[1] is None


def test_keywords_match_as_substrings(spark):
    words = spark.createDataFrame([(k.upper(),) for k in P.FORWARD_LOOKING_KEYWORDS], "w string")
    assert words.where(~T.is_forward_looking(F.col("w"))).count() == 0


def test_vectors(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    r = one(spark, AR.cosine(v(1, 0), v(0, 0)), AR.cosine(v(1, 0), v(2, 0)), AR.cosine_distance01(v(1, 0), v(-1, 0)), AR.at(v(1, 2), 5))
    assert r[0] == 0.0 and r[1] == 1.0 and r[2] == 1.0 and r[3] is None


def test_json(spark):
    v = J.variant(F.lit('{"a": 0.5, "b": "0.5", "c": true, "raw_score": 0.2, "convergence_boost": 0.1, "status": " ok "}'))
    r = one(spark, J.number_at(v, "$.a"), J.number_at(v, "$.b"), J.number_at(v, "$.c"), J.raw_total(v), J.signal_status(v, F.lit("LOW")),
            J.detail_shape(F.lit("[1]")), J.detail_shape(F.lit('"x"')))
    assert r[0] == 0.5 and r[1] is None and r[2] == 1.0 and abs(r[3] - 0.3) < 1e-12 and r[4] == "ok" and r[5] == '{"items":[1]}' and r[6] == "{}"


def test_character_references_equal_the_standard(spark):
    import html
    import random
    rng = random.Random(11)
    bits = ["&", "&#", "&#x", "&#X", ";", "amp", "amp;", "lt;", "lt", "038", "38;", "160", "65", "0000000065;", "x41;", "0", "1114112;", "55296;", "128", "150;", "129;", "11;", "xFFFF;", "xfdd0;",
            "nbsp;", "notit;", "copy", "eacute;", "Eacute", "CounterClockwiseContourIntegral;", "unknown;", " ", "<", "=", "é", "😀", "\ue0ff", "12345678901234567890;", "frac12", "\n", "&#13;", "&#x80;", "&NotEqualTilde;"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 9))) for _ in range(1500)]
    texts += ["&#038;lt; and &lt;", "\ue0ff &amp;", "&#0000000065;", "&amp;amp;lt;", "", "no reference", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r.k: r.u for r in df.select("k", T.unescape_entities(F.col("t")).alias("u")).collect()}
    assert all(got[k] == (None if t is None else html.unescape(t)) for k, t in enumerate(texts)), [
        (t, got[k], html.unescape(t)) for k, t in enumerate(texts) if t is not None and got[k] != html.unescape(t)][:5]
