"""Packing and byte-level BPE against the public tokenizers themselves."""

import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidepool.llm import byte_bpe, packing

ODD = [None, "", " ", "<|endoftext|> a", "É é İ ı ǅ ſ K Å ﬁ ½ ² Ⅷ", "\x00a\x1cb\x85c d e​f", "naïve café's 'S 'LL don'T", "a" * 3000, "ab" * 2500, "日本語 テキスト", "🙂👍🏽" * 50, "1234.56", "é é", "</w> a</w>b", "ß ẞ …—‘’“”", "\t\n \r\n  x", "Σίσυφος ΣΑΣ", " " * 9000 + "x" + "\n" * 9000]


def texts():
    rnd = random.Random(8)
    words = ["The", "quick", "naïve", "fox's", "1999", "e.g.", "http://x.y/z?a=1", "ÄÖÜ", "don't", "\n", "\n\n", "  ", "…", "re-use"]
    return ODD + [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 600))) for _ in range(80)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string").repartition(5)


def test_pieces_hold_the_tokenizers_ids(spark):
    rows = texts()
    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = set()
    for i, t in enumerate(rows):
        ids = np.array([*coder.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for k, at in enumerate(range(0, len(ids), 512)):
            part = ids[at : at + 512]
            expected.add((i, k, at, len(part), zlib.crc32(part.tobytes())))
    got = packing.pieces(frame(spark, rows), capacity=512).collect()
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)


def test_packing_places_every_piece_once_without_gaps(spark):
    rnd = random.Random(1)
    sizes = [min(512, int(rnd.paretovariate(0.7) * 8)) for _ in range(6000)]
    items = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "doc_id long, length long").repartition(20)
    got = packing.pack(packing.cut(items), 512).collect()
    assert sorted((r["doc_id"], r["length"]) for r in got) == list(enumerate(sizes))
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 512
    assert len(bins) <= math.ceil(1.005 * math.ceil(sum(sizes) / 512)) + 1


def test_packing_nothing_and_only_full_pieces(spark):
    empty = spark.createDataFrame([], "doc_id long, length long")
    assert packing.pack(packing.cut(empty), 512).count() == 0
    full = spark.createDataFrame([(i, 512) for i in range(9)], "doc_id long, length long")
    assert {r["offset"] for r in packing.pack(packing.cut(full), 512).collect()} == {0}


def test_bpe_is_the_librarys_and_decodes_back(spark):
    rows = texts()
    vocabulary = byte_bpe.default_vocabulary()
    coder = byte_bpe.codec(*vocabulary).coder
    got = {r["doc_id"]: r for r in byte_bpe.digests(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, t in enumerate(rows):
        ids = np.array(coder.encode(t or "", disallowed_special=()), dtype="<u4")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()), i


def test_bpe_joins_at_any_border():
    whole = byte_bpe.codec(*byte_bpe.default_vocabulary())
    small = byte_bpe.Codec(whole.ranks, byte_bpe.default_vocabulary()[1], leaf=24, leaf_bytes=6, long_run=30)
    for t in texts():
        t = (t or "")[:4000]
        ids = small.encode(t)
        assert ids.tolist() == whole.coder.encode(t, disallowed_special=())
        assert small.decode(ids) == t.encode()


def test_other_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b", "x", 3), (1, "a b", "x", 3)], "doc_id int, text string, ids string, piece int")
    assert byte_bpe.encode(df).count() == 2 and packing.pieces(df).count() == 2
    assert byte_bpe.digests(df.limit(0)).count() == 0 and packing.pieces(df.limit(0)).count() == 0
