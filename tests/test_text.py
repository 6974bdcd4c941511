"""Text operators against direct definitions on small inputs."""
import math
import random
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerlens import policies as P
from ledgerlens.functions import strings as T
from ledgerlens.operators import aggregates as A, similarity as M, text as X
from ledgerlens.plans import text_signals as TS

FILLER = "The company sells tools to many customers in several regions and reports results. " * 4


def split(spark, raw, form="10-K"):
    return X.split_sections(spark.createDataFrame([(1, 1, form, raw)], "filing_id long, company_id long, form_type string, raw_text string")).first()


def test_annual_text_sections(spark):
    raw = "\n".join(["Item 1. Business", FILLER, "Item 1A. Risk Factors", FILLER, "Item 7. MD&A", FILLER, "Item 8. Statements", FILLER])
    r = split(spark, raw)
    assert [(s.section, s.sequence_idx) for s in r.sections] == [("business", 0), ("risk_factors", 0), ("mda", 0)]
    assert r.sections[0].text == FILLER.strip() and r.status == "extracted" and r.warnings == []


def test_quarterly_html_sections_and_hidden_parts(spark):
    raw = (f"<html><head><title>Item 2. no</title></head><body><div style='display:none'>Item 1A. hidden {FILLER}</div><ix:header>Item 2. x</ix:header>"
           f"<p>Item 2. Management&#8217;s Discussion</p><p>{FILLER}</p><script>var a='<p>Item 6</p>'</script><p>Item 1A. Risk Factors</p><p>{FILLER}</p><p>Item 6. Exhibits</p></body></html>")
    r = split(spark, raw, "10-Q")
    assert [s.section for s in r.sections] == ["mda", "risk_factors"] and "hidden" not in r.sections[1].text


def test_table_of_contents_gives_no_short_sections(spark):
    raw = "\n".join(["Item 1. Business 3", "Item 1A. Risk Factors 9", "Item 7. MD&A 20", "Item 1. Business", FILLER, "Item 1A. Risk Factors", FILLER, "SIGNATURES", FILLER])
    r = split(spark, raw)
    assert [(s.section, s.sequence_idx) for s in r.sections] == [("business", 0), ("risk_factors", 0)]
    assert r.warnings == ["section_not_found:mda"]


def test_forward_looking_section_and_failure(spark):
    r = split(spark, "\n".join(["Cautionary Statement", FILLER, "Exhibit Index", FILLER]))
    assert [s.section for s in r.sections] == ["forward_looking"] and "text_item_headings_not_found" in r.warnings
    bad = split(spark, "nothing here at all")
    assert bad.status == "failed" and bad.warnings[-1] == "no_sections_found" and bad.sections == []
    assert split(spark, "").warnings[0] == "text_empty"


def test_body_cap_keeps_the_crossing_block(spark):
    df = spark.createDataFrame([(1, 1, "10-K", "\n".join(["Item 1. Business"] + [f"line {i} " + "x" * 90 for i in range(50)]))],
                               "filing_id long, company_id long, form_type string, raw_text string")
    s = X.split_sections(df, cap=1000).first().sections[0].text
    n = len(s.split("line ")) - 1
    assert sum(len(f"line {i} " + "x" * 90) for i in range(n)) >= 1000 > sum(len(f"line {i} " + "x" * 90) for i in range(n - 1))


# ---------------------------------------------------------------- chunks
def brute_chunks(text, target, limit, low, overlap):
    """Straight reading of the packing rule with list lengths recomputed each time."""
    size = lambda us: sum(map(len, us)) + max(0, len(us) - 1)
    units = []
    for para in (re.sub(r"\s+", " ", p).strip() for p in re.split(r"\n\s*\n+", text)):
        if not para:
            continue
        if len(para) <= limit:
            units.append(para)
            continue
        ss = re.split(r"(?<=[.!?])\s+(?=[\"'(\[]?[A-Z0-9])", para)
        ss = ss if len(ss) > 1 else re.split(r";\s+", para)
        for s in ss:
            words, line = s.split(), ""
            if len(s) <= limit:
                units.append(s)
                continue
            for w in words:
                if len(w) > limit:
                    units += [line] if line else []
                    units += [w[i:i + limit] for i in range(0, len(w), limit)]
                    line = ""
                elif line and len(line) + 1 + len(w) > limit:
                    units.append(line)
                    line = w
                else:
                    line = f"{line} {w}" if line else w
            units += [line] if line else []
    out, cur = [], []
    for u in units:
        n = size(cur + [u])
        if cur and (n > limit or (size(cur) >= low and n > target)):
            out.append(" ".join(cur))
            k = 0
            while overlap > 0 and k < len(cur) and (k == 0 or size(cur[len(cur) - k - 1:]) <= overlap):
                k += 1
            cur = cur[len(cur) - k:] if k else []
            while cur and size(cur + [u]) > limit:
                cur = cur[1:]
        cur = cur + [u]
    return out + ([" ".join(cur)] if cur else [])


def random_text(r):
    words = lambda n: " ".join("".join(r.choice("abcdefg") for _ in range(r.randint(1, 9))) for _ in range(n))
    sent = lambda: words(r.randint(2, 30)).capitalize() + r.choice(".!?;")
    return "\n\n".join(" ".join(sent() for _ in range(r.randint(1, 12))) for _ in range(r.randint(1, 8))) + (" " + "z" * 150 if r.random() < .3 else "")


@pytest.mark.parametrize("sizes", [(200, 260, 60, 40), (120, 120, 30, 0), (80, 200, 10, 90)])
def test_chunks_equal_brute_force(spark, sizes):
    r = random.Random(sum(sizes))
    texts = [random_text(r) for _ in range(12)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    target, limit, low, overlap = sizes
    got = df.select("i", X.chunk_text(F.col("text"), target, limit, low, overlap).alias("c")).collect()
    for row in got:
        assert row.c == brute_chunks(texts[row.i], *sizes)


def test_chunk_arguments_and_rows(spark):
    for bad in ((10, 20, 0, 1), (5, 20, 10, 1), (30, 20, 10, 1), (15, 20, 10, 20)):
        with pytest.raises(ValueError):
            X.check_chunk_arguments(*bad)
    s = spark.createDataFrame([(1, 1, 7, "mda", 0, FILLER), (1, 1, 8, "business", 0, FILLER), (1, 1, 9, "business", 1, "")],
                              "filing_id long, company_id long, section_id long, section string, sequence_idx int, text string")
    c = X.chunk_sections(s, target=150, max_chars=200, min_chars=50, overlap=20)
    first = X.narrative_order(c).first()
    assert first.section == "business" and first.chunk_idx == 0 and first.char_count == len(first.text)
    assert X.chunk_sections(s, include=[" MDA "]).select("section").distinct().collect()[0][0] == "mda"
    assert [r.warning for r in X.chunk_warnings(s, c).collect()] == ["empty_section:business:1"]


def test_drift_units_and_paragraphs(spark):
    long = " ".join(f"sentence number {i} of the long block goes on for a while." for i in range(20))
    df = spark.createDataFrame([(1, long + "\n\n" + "short one"), (2, "x" * 900), (3, "")], "i int, text string")
    p = {r.i: r.paragraphs for r in X.with_paragraphs(df).collect()}
    assert all(50 <= len(x) <= 800 for x in p[1]) and " ".join(p[1]) == long and [len(x) for x in p[2]] == [800, 100] and p[3] == []
    u = {r.i: r.units for r in X.with_drift_units(df).collect()}
    assert len(u[1]) == 20 and [len(x) for x in u[2]] == [400, 400, 100] and u[3] == []


# ---------------------------------------------------------------- similarity
def tfidf(a, b):
    tok = lambda s: Counter(w.lower() for w in re.findall(r"[A-Za-z][A-Za-z0-9']+", s))
    ca, cb = tok(a), tok(b)
    voc = set(ca) | set(cb)
    idf = {t: math.log(3 / (1 + (t in ca) + (t in cb))) + 1 for t in voc}
    vec = lambda c: {t: c[t] / sum(c.values()) * idf[t] for t in c}
    va, vb = vec(ca), vec(cb)
    na, nb = (math.sqrt(sum(x * x for x in v.values())) for v in (va, vb))
    return 0.0 if not na or not nb else max(0.0, min(1.0, sum(x * vb.get(t, 0) for t, x in va.items()) / na / nb))


def test_tfidf_drift_equals_brute_force(spark):
    r = random.Random(11)
    words = ["risk", "market", "supply", "chain", "loss", "growth", "cost", "demand", "rate", "debt", "cash", "sale"]
    doc = lambda: " ".join(" ".join(r.choice(words) for _ in range(9)).capitalize() + "." for _ in range(r.randint(4, 14)))
    docs = [doc() for _ in range(6)] + ["tiny text here."]
    df = spark.createDataFrame(list(enumerate(docs)), "filing_id long, text string")
    pairs = spark.createDataFrame([(i, i - 1) for i in range(1, len(docs))], "filing_id long, previous_filing_id long")
    got = {x.filing_id: x for x in TS.tfidf_drift(pairs, df).collect()}
    unit = lambda s: [u for u in re.split(r"(?<=[.!?;:])\s+", s) if len(u) >= 40]
    for i in range(1, len(docs)):
        cur, prev = unit(docs[i]), unit(docs[i - 1])
        if not cur or not prev:
            assert got[i].tfidf_aggregation == "global_fallback" and got[i].tfidf_drift == pytest.approx(1 - tfidf(docs[i], docs[i - 1]))
            continue
        d = sorted((1 - max(tfidf(c, p) for p in prev) for c in cur), reverse=True)
        k = min(len(d), max(3, math.ceil(len(d) * .25)))
        assert got[i].tfidf_drift == pytest.approx(sum(d[:k]) / k, abs=1e-9) and got[i].tfidf_unit_count == len(cur)


def test_blocks_do_not_change_best_match(spark):
    r = random.Random(2)
    rows = [(f, i, [r.gauss(0, 1) for _ in range(4)] if i % 7 else [0.0] * 4) for f in (1, 2) for i in range(23)]
    v = spark.createDataFrame(rows, "filing_id long, chunk_idx long, embedding array<double>")
    p = spark.createDataFrame([(2, 1)], "filing_id long, previous_filing_id long")
    best = lambda b: {x.chunk_idx: round(x.best, 12) for x in M.best_cosine(p, v, ["filing_id"], ["previous_filing_id"], ["filing_id"], block=b).collect()}
    assert best(4) == best(512) and best(4)[0] == 0.0
    top = lambda hot: [tuple(x) for x in M.top_k_mean(v.select("filing_id", "chunk_idx", F.abs(F.get("embedding", F.lit(0)) / 9).alias("s")), ["filing_id"], "s", "chunk_idx", hot_rows=hot)
                       .orderBy("filing_id").collect()]
    for a, b in zip(top(None), top(5)):
        assert a[0] == b[0] and a[1:5] == pytest.approx(b[1:5]) and a[5] == b[5]


def test_exact_median(spark):
    import statistics
    r = random.Random(1)
    rows = [(k, float(r.randint(0, 30))) for k in "ab" for _ in range(41 if k == "a" else 30)]
    df = spark.createDataFrame(rows + [("c", float(i * i % 977)) for i in range(600)], "k string, v double")
    rows += [("c", float(i * i % 977)) for i in range(600)]
    for hot in (None, 100, 400):
        got = {x.k: x.median for x in A.exact_median(df, ["k"], "v", hot_rows=hot).collect()}
        assert got == {k: statistics.median(v for q, v in rows if q == k) for k in "abc"}


def test_hidden_subtrees_loose_text_and_references(spark):
    import html as H
    pages = ['<div style="display:none"><div>inner one</div>outer hidden</div><p>shown text</p>loose text here<table><td>cell cell cell</td></table>',
             "<div>before it <b>bold</b> after<p>para one two</p>tail of div</div>",
             "<article><p>never closed one<p>never closed two</article><footer>the footer text</footer>",
             "<!-- a long licence --><p hidden>not shown at all</p><h1>A heading &amp; more</h1><br><li>list item one<li>list item two"]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, x string")
    got = {r.i: r.b for r in df.select("i", X.html_blocks(F.col("x")).alias("b")).collect()}
    assert got == {0: ["shown text"], 1: ["before it bold after", "para one two", "tail of div"], 2: ["never closed one", "never closed two"],
                   3: ["A heading & more", "list item one", "list item two"]}
    texts = ["a &eacute; &#39;b&#39;", "&amp;lt; &lt; &#38;amp; &copy 2020 &copy; AT&T &#8212; &#x1F600; &#150; &bogus; &#0; &notin; &not in &amp", "none", "&&amp;&"]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    assert [r[0] for r in df.select(T.unescape_entities(F.col("x"))).collect()] == [H.unescape(t) for t in texts]


def test_markup_after_a_long_prefix_is_found(spark):
    long = "x" * 9000
    df = spark.createDataFrame([(f"<!-- {long} --><html>", True), (long + " <DIV class=a>", True), (long + " a < b <tablet", False)], "x string, want boolean")
    assert all(r[0] == r[1] for r in df.select(T.looks_like_html(F.col("x")), "want").collect())


def test_long_sections_are_whole(spark):
    body = " ".join(f"sentence {i} of a very long section." for i in range(12_000))
    df = spark.createDataFrame([(1, 1, "10-K", f"Item 1. Business\n{body}\nItem 2. Properties\n")], "filing_id long, company_id long, form_type string, raw_text string")
    row = X.section_rows(X.split_sections(df)).first()
    assert row.char_count == len(body) > 300_000
    assert X.section_rows(X.split_sections(df, cap=500)).first().char_count == len(body)  # the block that crosses the cap is the last one


def brute_sections(raw, cap=None):
    """Annual report as plain text: every line looked at by itself, every body walked block by block."""
    blank = lambda c: c != " " and unicodedata.category(c)[0] in "CZ"
    blocks = [re.sub(" +", " ", "".join(" " if blank(c) else c for c in line)).strip(" ") for line in re.split(r"\r\n|\r|\n", raw)]
    blocks = [b for b in blocks if b]
    code, stop, forward = [], [], []
    for b in blocks:
        short = len(b) <= P.HEADING_MAX_CHARS
        m = re.match(r"\s*item\s*(" + "|".join(sorted(P.ITEM_CODES, key=len, reverse=True)) + r")\b", b, re.I | re.A) if short else None
        code.append(m and m[1].upper())
        stop.append(bool(m or short and re.search("|".join(P.STOP_PHRASES), b, re.I | re.A)))
        forward.append(bool(short and re.search("|".join(P.FORWARD_SECTION_PHRASES), b, re.I | re.A)))

    def body(i):
        out = []
        while i < len(blocks) and not stop[i] and not (cap and sum(map(len, out)) >= cap):
            out.append(blocks[i])
            i += 1
        return " ".join(out)
    found = [(P.ANNUAL_ITEMS[c], body(i + 1)) for i, c in enumerate(code) if c in P.ANNUAL_ITEMS]
    found = [f for f in found if len(f[1]) >= P.SECTION_MIN_CHARS]
    rows = [(s, sum(f[0] == s for f in found[:i]), text) for i, (s, text) in enumerate(found)]
    extra = body(forward.index(True) + 1) if True in forward else ""
    return rows + [("forward_looking", 0, extra)] * (len(extra) >= P.SECTION_MIN_CHARS)


@pytest.mark.parametrize("cap", [None, 300])
def test_sections_equal_brute_force(spark, cap):
    r = random.Random(5)
    marks = ["Item 1. Business", "ITEM 1A. Risk", " item 7 Discussion", "Item 7A. Rates", "Item 71", "“Cautionary statement”", "Forward-looking statements, signatures",
             "The signatures below", "exhibit \t index", "designatures", "Item 2. " + "x" * 230, "Item 9A. " + "é" * 200]
    words = ["tools", "é ü", "a  b", "​x", "\x85", "’s", "\U0001f600", "item 3", "\x7f", "growth of the company", " " * 5, "\t", "sales and costs " * 4]
    line = lambda: r.choice(marks) if r.random() < .3 else " ".join(r.choice(words) for _ in range(r.randint(0, 12)))
    texts = ["".join(line() + r.choice(["\n", "\n\n", "\r\n", "\r", " \n "]) for _ in range(r.randint(0, 60))) for _ in range(150)] + ["Item 1.", "\n", ""]
    df = spark.createDataFrame([(i, i, "10-K", t) for i, t in enumerate(texts)], "filing_id long, company_id long, form_type string, raw_text string")
    got = {x.filing_id: [tuple(s) for s in x.sections] for x in X.split_sections(df, cap=cap).collect()}
    assert got == {i: brute_sections(t, cap) for i, t in enumerate(texts)} and sum(map(len, got.values())) > 100


def test_lines_are_normalised_in_one_pass_over_the_text(spark):
    plan = spark.range(1).select(X.text_blocks(F.col("id").cast("string")).alias("b"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace") == 1 and plan.index("regexp_replace") < plan.index("lambda")  # not line by line
