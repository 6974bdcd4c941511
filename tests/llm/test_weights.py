"""Quality by log-likelihood ratio, whitening and importance resampling: against brute force and odd inputs."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ledgerlens.llm import quality, resampling, whitening

WORD = re.compile("[^\x20\x09-\x0D]+")


def grams(text, longest, buckets):
    c = [zlib.crc32(w.encode()) for w in WORD.findall(text or "")]
    out, level = [x % buckets for x in c], c
    for k in range(2, longest + 1):
        level = [(a * 31 + b) % (1 << 32) for a, b in zip(level, c[k - 1:])]
        out += [x % buckets for x in level]
    return out


def repeat_words(text, window=8):
    w = WORD.findall(text or "")
    spans = [tuple(w[i:i + window]) for i in range(len(w) - window + 1)]
    often = Counter(spans)
    return len({j for i, s in enumerate(spans) if often[s] > 1 for j in range(i, i + window)})


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_quality_by_hand(spark, longest):
    rng = random.Random(longest)
    good, bad = [f"g{k}" for k in range(60)], [f"b{k}###" for k in range(60)]
    texts = [None, "", " \n\t", "one", "a\n\na \nb\na\n \na", "x # * $ % & | < > y"]
    texts += [" ".join(rng.choice(good) for _ in range(rng.randint(15, 60))) + "\n" + "last line" * (k % 2) for k in range(40)]
    texts += [" ".join(rng.choice(bad) for _ in range(rng.randint(15, 60))) for _ in range(20)]
    texts += [" ".join(rng.choice(good[:2]) for _ in range(80)) for _ in range(5)] + ["é 😀 " + " ".join(good[:7] + good[:8] + good[:7] + good[3:12])]
    texts += [(" ".join(good[:9]) + "\n") * 3, " ".join(good[:8] + ["mid"] + good[:8]), " ".join(["s"] * 30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    trusted = spark.createDataFrame([(k,) for k in range(6, 46, 2)], "doc_id long")
    buckets = 256
    gains = quality.fit(docs, trusted, longest, buckets)
    raw, target = Counter(), Counter()
    for k, t in enumerate(texts):
        raw.update(grams(t, longest, buckets))
        if 6 <= k < 46 and k % 2 == 0:
            target.update(grams(t, longest, buckets))
    s, t = sum(raw.values()), sum(target.values())
    assert gains == [math.floor(1000 * math.log((target[k] + 1.0) * float(s + buckets) / ((raw[k] + 1.0) * float(t + buckets)))) for k in range(buckets)]
    got = {r.doc_id: r for r in quality.judged(docs, gains, longest).collect()}
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        w, r = WORD.findall(text or ""), got[k]
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        g = [gains[b] for b in grams(text, longest, buckets)]
        again = repeat_words(text)
        failed = len(w) < 20 or 100 * again > 30 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")))
        assert (r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(lines) - len(set(lines)), again, failed), text
        assert (r.n_grams, r.gain, r.kept) == (len(g), sum(g), not failed and sum(g) >= quality.THRESHOLD * len(g))
        assert r.score is None if not g else abs(r.score - sum(g) / 1000 / len(g)) < 1e-12
    if longest < 3:  # longer n-grams of so few texts fill all buckets alike
        assert not any(got[k].kept for k in range(46, 66)) and sum(got[k].kept for k in range(6, 46)) > 20


def test_odd_quality(odd, none, spark):
    trusted = spark.createDataFrame([(4,), (4,), (99,), (None,)], "doc_id long")
    gains = quality.fit(odd, trusted, buckets=64)
    got = quality.judged(odd, gains)
    assert got.count() == odd.count() and not got.where("doc_id in (1, 2, 3)").where("not base_failed or kept or n_words > 0 or score is not null").count()
    assert len({(r.gain, r.kept) for r in got.where("doc_id in (4, 5) or (doc_id is null and n_words > 0)").collect()}) == 1
    assert got.where("doc_id = 7").first().n_words == 40_000
    assert set(quality.fit(none, trusted.limit(0), buckets=4)) == {0} and quality.judged(none, gains).count() == 0
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, None), (None, 1), (4, 1)], "doc_id long, quality int")
    assert sorted(r.doc_id for r in quality.trusted_ids(labels).collect()) == [1, 4]
    many = spark.range(5000).selectExpr("id as doc_id", "1 as quality")
    assert 300 < quality.trusted_ids(many, 500).count() < 700


def brute_resample(rows, target, longest=1, buckets=97, least=20, percent=10, seed=2024):
    def found(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
        return len(w), [zlib.crc32(" ".join(w[i:i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]
    s, t = Counter(), Counter()
    each = [found(x) for _, x in rows]
    for _, f in each:
        s.update(f)
    for x in target:
        t.update(found(x)[1])
    a, b = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[k] + 1.0) * float(a + buckets) / ((s[k] + 1.0) * float(b + buckets)))) for k in range(buckets)]
    out = []
    for (i, _), (n, f) in zip(rows, each):
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[k] for k in f)
        out.append([i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], (1 << 63) - 1 if r[0] is None else r[0]))
    drawn = able[:len(able) * percent // 100]
    return out, drawn


@pytest.mark.parametrize("longest,percent,part", [(1, 10, 7), (2, 35, 1000), (3, 100, 40)])
def test_resampling_by_hand(spark, longest, percent, part):
    rng = random.Random(percent)
    vocabulary = [f"w{k}é" if k % 5 == 0 else f"W{k}" for k in range(50)]
    rows = [(k * 7 % 401, "-".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for k in range(400)]
    target = [" ".join(rng.choice(vocabulary[:9]) for _ in range(30)), None, ""]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(docs, bench, longest=longest, buckets=97, percent=percent, part=part).collect()
    every, drawn = brute_resample(rows, target, longest=longest, percent=percent)
    rank = {r[0]: k + 1 for k, r in enumerate(drawn)}
    assert sorted((r.doc_id, r.n_features, r.weight, r.score, r["rank"] or 0) for r in got) == sorted((*r[:4], rank.get(r[0], 0)) for r in every)


def test_resampling_draws_towards_the_target(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(f"{'near' if k % 10 == 0 else 'far'}{rng.randint(0, 30)}" for _ in range(40))) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = resampling.resample(docs, spark.createDataFrame([(" ".join(f"near{k}" for k in range(30)),)], "text string")).where("rank is not null")
    assert got.count() == 60 and got.where("doc_id % 10 = 0").count() == 60


def test_cutoff_by_sorting(spark):
    rng = np.random.RandomState(1)
    keys = [(int(a), int(b), k) for k, (a, b) in enumerate(zip(rng.randint(0, 4, 900), rng.randint(0, 3, 900)))]  # ties everywhere
    df = spark.createDataFrame(keys, "low long, id long, row long").repartition(7)
    for want in (1, 2, 449, 450, 899, 900):
        assert resampling.cutoff(df, want, part=50) == sorted(keys)[want - 1]


def test_odd_resampling(odd, none, spark):
    bench = spark.createDataFrame([(7, "one abc"), (8, None)], "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = resampling.resample(odd, bench, percent=50, buckets=97)
    every, drawn = brute_resample(rows, ["one abc", None], percent=50)
    assert sorted(str((r.doc_id, r.n_features, r.weight, r.score)) for r in got.collect()) == sorted(str(tuple(r[:4])) for r in every)
    assert [(r.doc_id, r.score) for r in got.where("rank is not null").orderBy("rank").collect()] == [(r[0], r[3]) for r in drawn]
    assert resampling.resample(none, bench).count() == 0
    assert resampling.resample(odd, bench.limit(0)).where("rank is not null").count() == 0  # a tenth of six rows


def brute_whiten(vectors, components, counts=False):
    x = {}
    for v in vectors:
        x.setdefault(tuple(math.floor(64 * c) + 1_000_000 for c in v), 0)
        x[tuple(math.floor(64 * c) + 1_000_000 for c in v)] += 1
    m = np.array(list(x), dtype=np.int64)
    w = np.array(list(x.values())) if counts else np.ones(len(m), np.int64)
    n, s = int(w.sum()), (m * w[:, None]).sum(axis=0)
    y = m - s / n
    v = (y * w[:, None]).T @ y / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    return {t: (n, int(((n * np.array(t, dtype=object) - s) ** 2).sum()), ((np.array(t) - s / n) @ u / np.sqrt(e))[:components]) for t in x}, e / e.sum()


@pytest.mark.parametrize("weights", ["one", "counts"])
def test_whitening_by_hand(spark, weights):
    rng = np.random.RandomState(3)
    base = rng.randn(300, 5) @ rng.randn(5, 5) * 3 + 7
    vectors = [base[k] for k in [*range(300), *[0] * 150, *range(40)]]
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(vectors)]
    junk = [(900, None), (901, []), (902, [1.0, None, 2.0, 3.0, 4.0]), (903, [1.0, float("nan"), 0.0, 0.0, 0.0]), (904, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (905, [1.0, 2.0])]
    df = spark.createDataFrame(rows + junk, "vec_id long, embedding array<double>").repartition(5)
    got = whitening.whiten(df, components=4, weights=weights).collect()
    want, explained = brute_whiten([r[1] for r in rows], 4, weights == "counts")
    assert len(got) == 4 * len(rows) and {r.vec_id for r in got} == {k for k, _ in rows}
    sign = {}
    for r in got:
        n, deviation, scores = want[tuple(math.floor(64 * c) + 1_000_000 for c in rows[r.vec_id][1])]
        assert (r.n, r.deviation) == (n, deviation) and abs(r.explained - explained[r.component - 1]) < 1e-9 and r.identity_error < 1e-9
        value = scores[r.component - 1]
        if abs(value) > 1e-3:
            sign.setdefault(r.component, np.sign(value * r.whitened))
        assert abs(value * sign.get(r.component, 1) - r.whitened) < 1e-8


def test_odd_whitening(spark):
    schema = "vec_id long, embedding array<float>, x string, component string, n int, dim int"
    def made(vectors):
        return spark.createDataFrame([(k if k else None, v, "x", "c", 1, 2) for k, v in enumerate(vectors)], schema)
    assert whitening.whiten(made([[1.0]]).limit(0)).count() == 0
    assert whitening.whiten(made([[1.0, 2.0]] * 5)).count() == 0  # no variance, nothing to whiten by
    flat = whitening.whiten(made([[0.0, 5.0], [1.0, 5.0], [1.0, 5.0], None])).collect()  # one dimension varies
    assert [(r.component, r.n, r.deviation) for r in flat] == [(1, 2, 64 * 64)] * 3 and {abs(round(r.whitened, 9)) for r in flat} == {1.0}
    huge = whitening.whiten(made([[3e38, 0.0], [-3e38, 1.0], [0.0, 2.0]])).collect()
    assert len(huge) >= 3 and sum(r.deviation is None for r in huge) >= 2
