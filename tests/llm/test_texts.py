"""Language, toxicity, decontamination and main text: held-out accuracy, fixtures and odd inputs."""
import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import decontamination, language, main_text, toxicity


@pytest.fixture(scope="module")
def tongues(spark):
    rng = random.Random(2)
    parts = {"xx": "ka lo mi ru ten sha".split(), "yy": "bré ço né quai lou sté".split(), "zz": "schu tzen ver lich ung heit".split()}
    rows = []
    for i in range(240):
        lang = rng.choice(sorted(parts))
        rows.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 40))), lang))
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_languages_of_held_out_rows(tongues):
    rows, df = tongues
    df = df.withColumn("held", language.held_out(F.col("doc_id"), 4, 2))
    got = language.languages(df, language.fit(df.where("not held"))).collect()
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(r.lang == r.lang_pred and 0.5 < r.score <= 1 for r in got if r.held) and sum(r.held for r in got) > 30


def test_scores_equal_bayes_by_hand(tongues):
    rows, df = tongues
    model = language.fit(df.where("doc_id < 100"))
    counts = {k: Counter() for k in model.labels}
    for i, t, lang in rows:
        if i < 100:
            for place, _ in language.grams([t]):
                counts[lang].update(place.tolist())
    for i, t, _ in rows[100:110]:
        logs = []
        for k in model.labels:
            total = sum(counts[k].values()) + language.SMOOTH * language.PLACES
            logs.append(sum(math.log((counts[k][p] + language.SMOOTH) / total) for place, _ in language.grams([t]) for p in place.tolist()))
        want = np.exp(np.array(logs) - max(logs))
        assert np.allclose(model.score([t])[0], want / want.sum(), atol=1e-4)
    assert (model.score(["ka lo", rows[3][1]])[1] == model.score([rows[3][1]])[0]).all()


def test_odd_languages(odd, none, tongues):
    model = language.fit(tongues[1])
    got = language.languages(odd, model)
    assert got.columns == [*odd.columns, "lang_pred"] and {r.doc_id: r.lang_pred for r in got.collect() if r.doc_id in (1, 2, 3)} == {1: "und", 2: "und", 3: "und"}
    assert language.languages(none, model).count() == 0
    empty = language.fit(none)
    assert {r.lang_pred for r in language.languages(odd, empty).collect()} == {"und"}
    kept = language.spoken(odd, model)
    assert kept.columns == odd.columns and 1 not in [r.doc_id for r in kept.collect()]


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(4)
    plain = ["".join(rng.choice("aeioutnrsl") for _ in range(rng.randint(3, 8))) for _ in range(500)]
    rows, labels = [], []
    for i in range(400):
        w = [rng.choice(plain) for _ in range(rng.randint(10, 60))]
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["blurghface", "zokwit", "blurghface."])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


@pytest.fixture(scope="module")
def machine(judged):
    docs, labels = judged
    return toxicity.fit(docs, labels.where(~language.held_out(F.col("doc_id"), 3, 1)))


def test_toxic_documents_held_out(judged, machine):
    docs, labels = judged
    got = toxicity.toxicity(docs, machine).join(labels, "doc_id").withColumn("held", language.held_out(F.col("doc_id"), 3, 1)).where("held").collect()
    assert len(got) > 80 and sum((r.score >= 0.7) == bool(r.toxic) for r in got) >= 0.98 * len(got)


def test_gapped_and_inserted_characters(machine):
    clean, whole, *bent = machine.score(["an aeon eats nuts", "you zokwit", "you zok-wit", "you zokxwit", "you z o k w i t !", "you blur.ghface", "BLURGHFACE"])
    assert clean < 0.1 and whole > 0.6 and all(b > 1.5 * clean for b in bent), (clean, whole, bent)


def test_kernel_equals_subsequences_counted_by_hand():
    words = ["idiot", "idxiot", "abcabc", "no"]
    marks = toxicity.Landmarks(["idiot", "cab"])
    points, number = toxicity._joined(words)

    def features(w):
        out = []
        for i in range(len(w)):
            for a, b in toxicity.STEPS:
                if i + a + b < len(w):
                    out.append((w[i] + w[i + a] + w[i + a + b], toxicity.GAP ** (a + b - 2)))
        return out

    got = marks.kernel(points, number, len(words))
    for k, w in enumerate(words):
        for j, m in enumerate(["idiot", "cab"]):
            f, g = features(w), features(m)
            dot = sum(x * y for a, x in f for b, y in g if a == b)
            norm = math.sqrt(sum(x * x for _, x in f) * sum(y * y for _, y in g))
            assert abs(got[k, j] - (dot / norm if norm else 0) ** toxicity.POWER) < 1e-5


def test_sentences():
    texts = ['You are an I d i o t! ok "moron"...\nNew line', "", "... !!", "x. y"]
    found = [(("".join(map(chr, c))[a:b]), s, t) for c, begin, se, te in toxicity.sentences(texts)
             for a, b, s, t in zip(begin.tolist(), [*begin[1:].tolist(), len(c)], se.tolist(), te.tolist())]
    assert [(w, t) for w, _, t in found] == [("you", 0), ("are", 0), ("an", 0), ("idiot", 0), ("ok", 0), ("moron", 0), ("new", 0), ("line", 0), ("x", 3), ("y", 3)]
    assert [s for _, s, _ in found] == [0, 0, 0, 0, 1, 1, 2, 2, found[8][1], found[8][1] + 1]


def test_odd_toxicity(odd, none, judged, machine):
    got = {r.doc_id: r.score for r in toxicity.toxicity(odd, machine).collect()}
    assert got[1] == got[2] == got[3] and all(0 <= v <= 1 for v in got.values())
    assert toxicity.toxicity(none, machine).count() == 0
    docs, labels = judged
    assert toxicity.fit(docs, labels.limit(0)).score(["a"]).tolist() == [0.0]
    assert toxicity.fit(none, labels).score(["a", ""]).tolist() == [0.0, 0.0]


ITEM = "Alice Smith sold 3 apples to Bob at 2.50 euros each and then walked 12 km home with Alice Smith in the rain."


def test_templates():
    b = decontamination.Benchmark([1, 2], [ITEM, "short one here"], 8)
    texts = [f"zzz in town. {ITEM} END", ITEM.replace("Alice Smith", "Carol Jones").replace("12", "99").replace("Bob", "Dan"),
             ITEM.replace("home with Alice Smith", "home with Eve Black").replace("Bob", "Alice"), "a short one here", "", "short one", "in the rain"]
    got = {(t, i): (cover, changed) for t, i, _, _, cover, changed in decontamination.matches(b, texts, 0.5)}
    assert got[0, 1] == (1.0, False) and got[1, 1][0] > 0.9 and got[1, 1][1] and got[3, 2] == (1.0, False)
    assert got[2, 1][0] < 1.0 and set(got) == {(0, 1), (1, 1), (2, 1), (3, 2)}


def test_leaks_equal_containment(spark, odd, none):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(15, 40)))) for k in range(30)]
    rows = []
    for i in range(120):
        text = " ".join(rng.choice(words) for _ in range(60))
        rows.append((i, f"{text}\n{items[i % 30][1]}\n{text}" if i % 4 == 0 else text))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(i, k) for i, t in rows for k, x in items if x in t}
    for size in (decontamination.PASS, 500):  # one pass, and many
        got = decontamination.leaks(docs, bench, per_pass=size).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
        assert all(dict(rows)[r.doc_id][r.start:r.end] == dict(items)[r.item_id] for r in got)
    kept = decontamination.decontaminated(docs, bench)
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {i for i, _ in want}
    assert decontamination.leaks(none, bench).count() == 0 and decontamination.leaks(docs, bench.limit(0)).count() == 0
    some = odd.where("doc_id = 4").selectExpr("9 item_id", "text").unionByName(spark.createDataFrame([(7, None), (8, "")], "item_id int, text string"))
    assert {r.doc_id for r in decontamination.leaks(odd, some).collect()} == {4, 5, 6, None}


@pytest.mark.parametrize("item", [
    "Solve 3x + 4 = 19, 5x - 2 = 13, 7x + 1 = 22 for x.", "Compute 12 + 34 - 56 + 78 - 90 + 11.",
    "Find the mean of 4, 8, 15, 16, 23, 42, 40, 41, 43, 44.", "7 8 9"])
def test_items_of_numbers_are_found_word_for_word(item):
    b = decontamination.Benchmark([1], [item], 8)
    other = "".join(str(9 - int(c)) if c.isdigit() else c for c in item)
    got = [(t, cover, changed) for t, _, _, _, cover, changed in decontamination.matches(b, [f"we read. {item} It ends.", other], 0.9)]
    assert got == [(0, 1.0, False)]


NAMES = "Tom has 3 apples. Sarah has 4 pears. Tom gives 2 away. How many are left?"


@pytest.mark.parametrize("item,text,cover,changed", [
    (NAMES, "Anna has 7 apples. Peter has 9 pears. Anna gives 5 away. How many are left?", 1.0, True),
    (NAMES, "Anna has 7 apples. Peter has 9 pears. Eve gives 5 away. How many are left?", 15 / 16, True),
    (NAMES, "so tom has 3 apples. Sarah has 4 pears. Tom gives 2 away. How many are left?", 1.0, False),
    (NAMES, NAMES.upper(), 1.0, False),
    ("Name the largest planet", "asked to Name the largest planet, they wait", 1.0, False),
    ("Paris is where they live", "we know that Paris is where they live", 1.0, False),
    ("The train left. Tom went home early", "so the train left. Anna went home early", 1.0, True)])
def test_words_that_open_sentences(item, text, cover, changed):
    b = decontamination.Benchmark([1], [item], 8)
    got = [(round(x[4], 9), x[5]) for x in decontamination.matches(b, [text], 0.5)]
    assert got == [(round(cover, 9), changed)]


def test_long_runs_count_whatever_part_of_the_item_they_are():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(300)]
    b = decontamination.Benchmark([1, 2], [" ".join(words), "Ann has 1 cat, Ben has 2 dogs. " * 10], 8)
    runs = [" ".join(words[k:k + n]) for k, n in ((20, 140), (100, 13), (100, 12))]
    texts = [f"zz yy {r} xx ww" for r in runs] + [" ".join(words[50:62]) + " uu " + " ".join(words[90:102])]
    got = {(t, i): (texts[t][x:y], c) for t, i, x, y, c, _ in decontamination.matches(b, texts, 0.5)}
    assert got == {(0, 1): (runs[0], 140 / 300), (1, 1): (runs[1], 13 / 300)}
    other = decontamination.Benchmark([1], ["Add 1 to 2 and 3 and 4 and 5 and 6 and 7 and 8 and 9. " + " ".join(words)], 8)
    changed = "Add 3 to 5 and 6 and 8 and 11 and 12 and 13 and 14 and 15. It is so."
    assert [x[5] for x in decontamination.matches(other, [changed], 0.5)] == [True]


PAGES = [
    ("", ""), (None, ""), ("<!-- x --><script>var t='</p>';</script>", ""),
    ("<html><head><title>T</title></head><body><nav><ul><li><a href=/a>Home</a></li></ul></nav><div class=\"ad\">Buy this now, it is the best of all.</div>"
     "<article><h1>Title</h1><p><b>First &amp; best<br>line.<p>Second.</article><footer>&copy; all rights reserved, by us.</footer>", "Title\nFirst & best line.\nSecond."),
    ("<main><p>x &lt; y</p><table><tr><td>1<td>2<tr><td>3</table><p hidden>no</p><div style='display:none'><div>in</div>out</div>fin</main>", "x < y\n1 2\n3\nfin"),
    ("<article><p>One line that is here.</p><aside>See also</aside><form>Name</form><section class=comments><p>I disagree, my friend.</p></section></article>", "One line that is here."),
    ("<body><article><p>never closed, 1 < 2", "never closed, 1 < 2"),
]


def test_main_text(spark):
    df = spark.createDataFrame([(k, f"u{k}", h, "clash", 5) for k, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, text string, n_chars int")
    got = {r.page_id: r for r in main_text.extract(df).collect()}
    assert [got[k].text for k in range(len(PAGES))] == [t for _, t in PAGES]
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert main_text.extract(df.limit(0)).count() == 0


LONG = "".join(f"<p>Some words of a long text that is here for number {k}, and so it ends.</p>" for k in range(5))
LINKS = "<div class=sidebar><ul>" + "".join(f"<li><a href=/{k}>Link {k}</a></li>" for k in range(5)) + "</ul></div>"
NOTES = "<div id=comments>" + "".join(f"<p>I think that this is a good text for number {k}.</p>" for k in range(3)) + "</div>"


@pytest.mark.parametrize("page", [
    f'<body class="single has-sidebar"><nav><a href=/>Home</a></nav><div>{LONG}</div>{LINKS}{NOTES}', f'<div class="page with-header"><div>{LONG}</div>{LINKS}</div>',
    f"<div id=wrap class=no-sidebar>{LONG}{LINKS}</div>", f"<div id=wrap class=sidebar-right>{LONG}{LINKS}</div>",
    f"<div class=menu-layout><article>{LONG}</article>{LINKS}</div>", f"<div id=header><main><div class=share-layout><article>{LONG}</article></div></main></div>",
    f"<article>{LONG}</article>{NOTES}{LINKS}", f"<main><article>{LONG}</article><section class=comments><article>{LONG}</article></section></main>"])
def test_words_of_class_do_not_decide_alone(page):
    weight = np.zeros(main_text.FEATURES)
    weight[11:13], weight[13], weight[15], weight[10] = (-1, 1), 2, -1, -2  # sentences and paragraphs against items and links
    assert main_text.main_text(page, weight) == LONG.replace("<p>", "").replace("</p>", "\n").strip()


@pytest.mark.parametrize("page,want", [
    ("<p hidden>x<p>A</p><p>B</p>", "A|B"), ("<div><p hidden>x<b>y</b></div><p>A", "A"), ("<p hidden>x<div>A</div>B", "A|B"),
    ("<ul><li hidden>x<li>A<li>B</ul>C", "A|B|C"), ("<ul><li hidden>x<ul><li>y</ul>z<li>A</ul>", "A"),
    ("<dl><dt hidden>x<dd>A<dt>B</dl>", "A|B"), ("<table><tr><td hidden>x<td>A<tr hidden><td>y<td>z<tr><td>B</table>C", "A|B|C"),
    ("<table><tbody hidden><tr><td>x<tbody><tr><td>A</table>", "A"), ("<div><span hidden>x</div><p>A <span>B</span>", "A B|"),
    ("<button>x<p>A</p><p>B</p>", "A|B"), ("<div><button>x</div>A<div><button>y</button>B</div>", "A|B"), ("<button>x<button>y</button>A", "A"),
    ("<select><option>x<p>A</p><p>B</p>", "A|B"), ("<object data=x><param name=a><p>A</p>", "A"), ("<div hidden>x<p>A</p><p>B</p>", "A|B"),
    ("<head><title>T</title><body><p>A", "A"), ("<p>A<span hidden>x<br>y</span>B</p>", "AB"), ("<p>A<span hidden>x</p>B", "A|B"),
    ("A<svg><title/><path d=x><g></svg>B", "AB"), ("<div hidden><div>x</div><p>y</div>A", "A"), ("<button><p>x</p><div>y</div></button>A", "A")])
def test_left_out_elements_end(page, want):
    assert "|".join(b.text for b in main_text.blocks(page)) == want.strip("|")


def test_cut_is_minimal():
    rng = random.Random(7)
    for _ in range(200):
        n = rng.randint(1, 8)
        gain = [rng.choice([-2, -1, -0.5, 0.3, 0.7, 1.5]) for _ in range(n)]
        edges = [(a, b, rng.choice([0.2, 0.6, 1.1])) for a in range(n) for b in range(a) if rng.random() < 0.4]

        def cost(side):
            return sum(max(g, 0) if not s else max(-g, 0) for g, s in zip(gain, side)) + sum(w for a, b, w in edges if side[a] != side[b])

        best = min(cost([bool(m >> k & 1) for k in range(n)]) for m in range(1 << n))
        assert abs(cost(main_text.minimum_cut(gain, edges)) - best) < 1e-9


def test_long_page_with_many_blocks():
    page = "<body>" + "<div><p>word word</p><p>more, of it.</p></div>" * 5000 + '<a title="un'
    assert len(main_text.blocks(page)) == 10_000
    assert isinstance(main_text.main_text(page, np.zeros(main_text.FEATURES)), str)


def test_leaks_need_more_than_a_stock_phrase(spark):
    items = [(1, "Yes."), (2, "What is?"), (3, "Which of the following is not true about the red kangaroo of the northern plains?"), (4, "Name the river that runs past Basel.")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, "yes and yes, what is that"), (2, "Now which of the following is not true about our new plan for the town?"), (3, f"Some words. {items[2][1]} More."),
            (None, f"Here: {items[2][1]}"), (None, "nothing"), (4, f"and {items[3][1]}"), (4, "another text of that id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, bench).collect()} == {(3, 3), (None, 3), (4, 4)}
    kept = {(r.doc_id, r.text) for r in decontamination.decontaminated(docs, bench).collect()}
    assert kept == {rows[0], rows[1], rows[4], rows[6]}


def test_ill_formed_pages_take_linear_time():
    """Deep, unclosed and hidden elements and long networks: eight times the input, at most some twenty times the time."""
    weight, rng = np.zeros(main_text.FEATURES), random.Random(3)

    def network(n):
        gain = [rng.uniform(-1.2, 1.2) for _ in range(n)]
        return gain, [(k - 1, k, rng.choice([0.25, 0.5, 1.0])) for k in range(1, n)] + [(k - 3, k, 1.0) for k in range(3, n) if rng.random() < 0.6]

    runs = [lambda n, page=page: main_text.main_text(page(n), weight) for page in (
        lambda n: "<div>" * n + "x", lambda n: "<b><i>x" * n, lambda n: "<p><b>word</p>" * n, lambda n: "<table>" + "<tr><td>x" * n,
        lambda n: "".join(f"<t{k} hidden>a" for k in range(n)))] + [lambda n: main_text.minimum_cut(*network(n))]
    for run in runs:
        times = []
        for n in (2_000, 16_000):
            start = time.perf_counter()
            run(n)
            times.append(time.perf_counter() - start)
        assert times[1] < 20 * times[0] + 1
