"""Near-duplicate operators against all pairs compared one by one."""
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from ledgerlens.llm import codes, links, near_dedup, repeats
from ledgerlens.llm.near_dedup import near_duplicates

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()


def components(items, percent):
    """items (key, set): smallest key reachable, by comparing all pairs."""
    parent = {k: k for k, _ in items}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, (a, x) in enumerate(items):
        for b, y in items[:i]:
            both = len(x & y)
            if x and y and 100 * both >= percent * (len(x) + len(y) - both):
                a1, b1 = find(a), find(b)
                parent[max(a1, b1)] = min(a1, b1)
    return {k: find(k) for k, _ in items}


def test_components_equal_all_pairs(prose):
    rows, df = prose
    want = components([(i, shingle_set(t, 3)) for i, t in rows], 85)
    got = {r.doc_id: r for r in near_duplicates(df).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) and r.n_shingles == len(shingle_set(t, 3)) for (i, t), r in ((x, got[x[0]]) for x in rows))
    assert 20 < sum(not r.kept for r in got.values()) < 280


def test_a_hot_group_without_a_common_neighbour(spark):
    """A hundred edits of one text, many of them linked only through others; few pairs are checked."""
    rng = np.random.RandomState(3)
    base = [f"w{k}" for k in range(140)]
    rows = []
    for k in range(100):
        w = list(base)
        for p in rng.choice(140, rng.randint(2, 7), replace=False):
            w[p] = f"x{rng.randint(0, 3)}" if p < 12 else f"y{k}{p}"
        rows.append((k, " ".join(w)))
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components([(i, shingle_set(t, 3)) for i, t in rows], 85)


def test_odd_documents(odd, none):
    got = defaultdict(list)
    for r in near_duplicates(odd).collect():
        got[r.doc_id].append(tuple(r)[1:])
    assert got[1] == got[2] == got[3] or all(x[0][0] == 0 and x[0][2] for x in (got[1], got[2], got[3]))
    assert got[4] == [(58, 4, True)] and got[5] == [(58, 4, False)] * 2 and got[6] == [(59, 4, False)]
    assert got[7][0][1:] == (7, True) and got[8][0][1:] == (7, False)
    assert got[10] == [(1, 10, True)] and got[11] == [(1, 10, False)] and got[12] == [(1, 12, True)]
    assert sorted(x[0] for x in got[None]) == [0, 58] and all(x[1] is None and x[2] for x in got[None])
    assert near_duplicates(none).count() == 0
    kept = near_dedup.deduplicated(odd)
    assert kept.columns == odd.columns and kept.count() == 10


def test_chain_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 50), (50, 70), (5, 5)], "x long, y long")
    got = {r.id: r.comp for r in links.components(edges).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 50, 50: 50, 70: 50}


def test_circulant_estimates_similarity():
    rng = np.random.RandomState(1)
    a = rng.randint(0, 1 << 62, 2000).astype(np.uint64)
    b = np.concatenate([a[:1500], rng.randint(0, 1 << 62, 500).astype(np.uint64)])
    same = (near_dedup.signature(a, 512) == near_dedup.signature(b, 512)).mean()
    assert abs(same - 1500 / 2500) < 0.08
    assert (near_dedup.signature(a, 64) == near_dedup.slices(a, 64).min(axis=0)).all()


def test_words_in_blocks_equal_words_at_once():
    text = "ab  cd\tÉf " * 50
    whole = codes.words([text, "", "x y"])
    codes_block, codes.BLOCK = codes.BLOCK, 16
    try:
        parts = [np.concatenate([codes.words([p])[2] for _, p in codes.blocks(text, 16)])]
    finally:
        codes.BLOCK = codes_block
    assert (parts[0] == whole[2][:150]).all() and whole[3].tolist() == [0, 150, 150, 152]
    assert "".join(p for _, p in codes.blocks(text, 7)) == text
    assert [t for _, ts in codes.text_blocks(["a", "b" * 30, "c", ""], 10) for t in ts] == ["a", "b" * 30, "c", ""]


def brute_repeats(rows, least=50):
    paras = []
    for i, t in rows:
        at = no = 0
        for line in (t or "").split("\n"):
            if line.strip(" \t\n\v\f\r"):
                paras.append((i, no, at, at + len(line), line))
                no += 1
            at += len(line) + 1
    kinds = {}
    for p in paras:
        kinds.setdefault(tuple(re.findall(r"[^\x20\x09-\x0D]+", p[4].translate(LOW))), len(kinds))
    comp = components([(n, frozenset(w[k:k + 5] for k in range(max(1, len(w) - 4)))) for w, n in kinds.items()], 80)
    groups = defaultdict(list)
    for p in paras:
        w = tuple(re.findall(r"[^\x20\x09-\x0D]+", p[4].translate(LOW)))
        groups[comp[kinds[w]]].append((*p[:4], len(w)))
    rep = {}
    for ps in groups.values():
        docs = {p[0] for p in ps}
        if len(docs) > 1:
            first = min((p[0], p[2]) for p in ps)
            rep.update({p[:2]: (p, len(ps), len(docs), (p[0], p[2]) != first) for p in ps})
    name = {p[:2]: comp[kinds[tuple(re.findall(r"[^\x20\x09-\x0D]+", p[4].translate(LOW)))]] for p in paras}
    follow = defaultdict(set)
    for i, no in rep:
        if (i, no + 1) in rep:
            follow[name[i, no], name[i, no + 1]].add(i)

    def goes_on(i, no):
        return (i, no) in rep and (i, no + 1) in rep and len(follow[name[i, no], name[i, no + 1]]) > 1
    out = set()
    for (i, no), (p, places, docs, removed) in rep.items():
        a = b = no
        while goes_on(i, a - 1):
            a -= 1
        while goes_on(i, b):
            b += 1
        total = sum(rep[i, k][0][4] for k in range(a, b + 1))
        if total >= least:
            out.add((i, p[2], p[3], p[4], places, docs, rep[i, a][0][2], total, removed))
    return out


def test_repeated_paragraphs_equal_all_pairs(prose):
    rows, df = prose
    found = repeats.repeated(df)
    got = {(r.doc_id, r.start, r.end, r.n_words, r.n_places, r.n_docs, r.passage_start, r.passage_words, r.removed) for r in found.where("kind = 'paragraph'").collect()}
    assert got == brute_repeats(rows) and len(got) > 50
    text, cut = dict(rows), defaultdict(set)
    for r in found.where("removed").collect():
        cut[r.doc_id].update(range(r.start, r.end + (r.kind == "paragraph")))
    for r in repeats.without_repeats(df, found).collect():
        assert r.text == "".join(c for k, c in enumerate(text[r.doc_id]) if k not in cut[r.doc_id])


def word_spans(text):
    return [(m.group().translate(LOW), m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")]


def brute_runs(rows, least):
    """Characters of each document in windows of `least` words that another document has, and in those of them that it has first."""
    where = defaultdict(set)
    spans = {i: word_spans(t) for i, t in rows}
    for i, w in spans.items():
        for k in range(len(w) - least + 1):
            where[tuple(x[0] for x in w[k:k + least])].add((i, k))
    every, first = defaultdict(set), defaultdict(set)
    for places in where.values():
        if len({i for i, _ in places}) > 1:
            for i, k in places:
                seen = range(spans[i][k][1], spans[i][k + least - 1][2])
                every[i].update(seen)
                if i == min(places)[0]:
                    first[i].update(seen)
    return every, first


@pytest.mark.parametrize("least", [12, 51])
def test_runs_equal_all_windows(spark, least):
    rng = random.Random(least)
    words = ["".join(rng.choice("abcdeABÉ") for _ in range(rng.randint(1, 5))) for _ in range(60 if least == 12 else 300)]

    def prose(n):
        return [rng.choice(words) for _ in range(n)]
    stock = [prose(n) for n in (least - 1, least, least + 4, 2 * least, 30, 200)]
    rows = []
    for k in range(120):
        text = prose(rng.randint(0, 80))
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(stock)
            a = rng.randint(0, len(s) // 3)
            text += s[a:] + prose(rng.randint(0, 20))
        if k % 10 == 9:
            text = rows[-4][1].split()  # a copy with white space of its own
        if k % 10 == 8 and len(text) > 3:
            text = rows[-3][1].split()
            text[len(text) // 2:len(text) // 2 + 1] = prose(2)
        rows.append((1000 - k, "".join(w + rng.choice(" \n\t ") for w in text)))
    rows += [(2000, rows[5][1]), (2001, rows[5][1]), (3, "same " * 300), (4, "x " + "same " * 200), (5, "a b " * 100), (6, "q " + "a b " * 70), (7, "")]
    got = repeats.repeated_runs(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), least).collect()
    every, first = brute_runs(rows, least)
    seen, kept = defaultdict(set), defaultdict(set)
    for r in got:
        assert r.n_words >= least and r.n_words == len(word_spans(dict(rows)[r.doc_id][r.start:r.end]))
        seen[r.doc_id].update(range(r.start, r.end))
        if not r.removed:
            kept[r.doc_id].update(range(r.start, r.end))
    text = dict(rows)
    for i, t in rows:  # white space between two windows that touch goes with them
        assert {k for k in seen[i] if not t[k].isspace()} == {k for k in every[i] if not t[k].isspace()}, i
    # what a document has first is not all removed: each repeated window stays in one place
    gone = defaultdict(set)
    for r in got:
        if r.removed:
            gone[r.doc_id].update(range(r.start, r.end))
    assert all(kept[i] for i in first if i == min(every)) and sum(map(len, gone.values())) < sum(map(len, seen.values()))


def test_passages_inside_lines(spark):
    rng = random.Random(8)
    def prose(n):
        return " ".join("".join(rng.choice("abcdefghijkl") for _ in range(6)) for _ in range(n))
    passage, lines = prose(60), [prose(11) for _ in range(5)]
    rows = [(1, f"{prose(40)} {passage} {prose(30)}"), (2, f"{prose(7)} {passage} {prose(90)}"), (3, "\n".join(lines))]
    rows += [(10 + k, prose(20) + "\n" + x) for k, x in enumerate(lines)]  # each line elsewhere, never two of them
    got = repeats.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.kind, r.doc_id, r.n_words, r.removed) for r in got} == {("run", 1, 60, False), ("run", 2, 60, True)}
    assert all(dict(rows)[r.doc_id][r.start:r.end] == passage for r in got)


def test_odd_paragraphs(odd, none):
    got = repeats.repeated(odd)
    assert {(r.doc_id, r.removed) for r in got.collect()} == {(4, False), (5, True), (6, True), (7, False), (8, True)}
    assert repeats.repeated(none).count() == 0


@pytest.mark.parametrize("percent, rows, miss", [(80, 3, 1e-4), (85, 6, 1e-6), (50, 2, 1e-2)])
def test_bands_reach_their_recall(percent, rows, miss):
    bands = repeats.bands_for(percent, rows, miss)
    assert (1 - (percent / 100) ** rows) ** bands <= miss < (1 - (percent / 100) ** rows) ** (bands - 1)


def test_no_text_is_lost_with_a_repeated_id(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(3, a, "x"), (5, a, "y"), (5, b, "z"), (7, b, "u"), (7, b, "u"), (9, "alone here", "v"), (9, "alone here", "w"), (None, a, "n"), (None, a, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, near_key string")
    got = sorted((r.doc_id or 0, r.text) for r in near_dedup.deduplicated(docs).collect())
    assert got == [(0, a), (0, a), (3, a), (5, b), (9, "alone here")]
    assert near_dedup.deduplicated(docs).columns == docs.columns
