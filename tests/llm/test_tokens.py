"""Ids, packing and id files against the library applied to whole texts."""
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
from ledgerlens.llm import id_files, packing, token_ids  # noqa: E402

CASES = ["", " ", "a", "it's we'll 'sabc ''s \"'s '", "x 's y'll'd 'relax", "  a  b \n\n c\t d \n", "abc \n", "\n\nabc", "don't <|endoftext|> it",
         "é1²x ½ __init__ 12ab!!?", "日本語 text", "a\x00b", "😀 hi 'm", "'", "''", "'re're", "x\x85y \x1c z", "a" * 3000]


@pytest.fixture(scope="module")
def whole():
    e = token_ids.Encoder(token_ids.default_vocabulary())
    e.by_parts = False
    return e


def test_parts_give_the_ids_of_the_whole(whole):
    rng = random.Random(1)
    texts = CASES + ["".join(rng.choice("ab's tlredvm 19'.,\n \t é!’ ") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    e = token_ids.Encoder(token_ids.default_vocabulary())
    assert e.by_parts
    for size in (1, 50, 3018):
        for at in range(0, 200 if size == 1 else len(texts), size):
            (a, i), (b, j) = e(texts[at:at + size]), whole(texts[at:at + size])
            assert np.array_equal(a, b) and np.array_equal(i, j)


def expected(rows, whole):
    return {i: np.append(whole([t or ""])[0], 0).astype("<u4") for i, t in rows}


def test_pieces_cover_every_id_once(prose, whole):
    rows, df = prose
    ids, pieces = expected(rows, whole), defaultdict(list)
    got = packing.pack(df, longest=64).collect()
    assert len({r.sequence_id for r in got}) == len(got)
    for r in got:
        pieces[r.doc_id].append(r)
    for i, own in ids.items():
        at = 0
        for r in sorted(pieces.pop(i), key=lambda r: r.start):
            assert r.start == at and r.offset == 0 and r.doc_tokens == len(own) and r.length in (1, 2, 4, 8, 16, 32, 64)
            assert bytes(r.ids) == own[at:at + r.length].tobytes()
            at += r.length
        assert at == len(own)
    assert not pieces
    assert packing.piece_lengths(2048 + 1024 + 13, 1024) == [1024] * 3 + [8, 4, 1]


def test_odd_pieces_and_buckets(odd, none, tmp_path):
    got = packing.pack(odd).collect()
    assert sorted((r.doc_id or 0, r.doc_tokens) for r in got if r.doc_tokens == 1) == [(0, 1), (1, 1), (2, 1)]
    assert packing.pack(none).count() == 0
    with pytest.raises(ValueError):
        packing.pack(odd, longest=1000)
    packing.write_buckets(packing.pack(odd), str(tmp_path / "b"))
    assert sum(r["count"] for r in odd.sparkSession.read.parquet(str(tmp_path / "b")).groupBy("bucket").count().collect()) == len(got)


@pytest.mark.parametrize("values", [[], [0], [255, 256, 65535, 65536, (1 << 24) - 1, 1 << 24, (1 << 32) - 1, 3], list(range(1000))])
def test_ranks_round_trip(values):
    ranks = np.array(values, dtype=np.uint32)
    control, data = id_files.rank_bytes(ranks)
    assert len(control) == -(-len(ranks) // 4) and np.array_equal(id_files.byte_ranks(control, data, len(ranks)), ranks)


def test_files_round_trip(prose, whole, tmp_path, spark):
    rows, df = prose
    rows = rows + [(5000, None)]
    df = df.unionByName(spark.createDataFrame([(5000, None)], "doc_id long, text string"))
    id_files.write_ids(df, str(tmp_path / "f"))
    ids = expected(rows, whole)
    got = {r.doc_id: r for r in id_files.read_ids(spark, str(tmp_path / "f")).collect()}
    at = 0
    for i in sorted(ids):
        assert got[i].start == at and got[i].n_tokens == len(ids[i]) and bytes(got[i].ids) == ids[i].tobytes()
        at += len(ids[i])
    files = spark.read.parquet(str(tmp_path / "f" / "ids")).selectExpr("_metadata.file_name f", "ordinal o", "doc_id d").orderBy("f", "o").collect()
    assert [r.d for r in files] == sorted(ids)
    ranks = spark.read.parquet(str(tmp_path / "f" / "ranks")).orderBy("rank").collect()
    count = np.bincount(np.concatenate(list(ids.values())))
    assert [(-count[r.id], r.id) for r in ranks] == sorted((-count[k], k) for k in np.flatnonzero(count))


def test_odd_files(odd, none, whole):
    got = id_files.round_trip(odd).collect()
    assert len(got) == odd.count() and [r.start for r in sorted(got, key=lambda r: r.start)][0] == 0
    for r in got:
        if r.doc_id in (4, 9, 12):
            text = odd.where(f"doc_id = {r.doc_id}").first().text
            assert r.ids_crc32 == zlib.crc32(np.append(whole([text])[0], 0).astype("<u4").tobytes())
    assert id_files.round_trip(none).count() == 0
