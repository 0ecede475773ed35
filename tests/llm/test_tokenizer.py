import os
import random

import pytest

from logweave.llm import tokenizer as t
from logweave.llm.packing import CAPACITY, SumOfSquares, pack_documents, pack_items

pytestmark = pytest.mark.skipif(not os.path.exists(t.VOCABULARY), reason="no vocabulary")
TEXTS = ["", None, " ", "Hello world", "it's  42\n\n\tgrüße 信号故障 🚉<|endoftext|>", "ab" * 4000, "\x00\x1b", "x" * 170 + " y", "word " * 3000]


@pytest.fixture(scope="module")
def known():
    tiktoken = pytest.importorskip("tiktoken")
    with open(t.VOCABULARY, "rb") as f:
        ranks = t.read_ranks(f.read())
    return tiktoken.Encoding("own", pat_str=t.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_as_the_public_library(spark, known):
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice("abcde'st 12\n.é信") for _ in range(rng.randrange(300))) for _ in range(200)]
    frame = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(texts)] + [(0, "", "again")], "doc_id bigint, text string, ids string")
    got = t.encode_corpus(frame).collect()
    assert len(got) == len(texts) + 1
    for row in got:
        assert list(row.ids) == (known.encode_ordinary(texts[row.doc_id]) if texts[row.doc_id] else [])
    assert t.encode_corpus(frame.limit(0)).count() == 0


def test_long_words_by_both_ways(known):
    ranks = t.read_ranks(t._file(t.VOCABULARY))
    rng = random.Random(4)
    for _ in range(60):
        word = bytes(rng.choice(b"abtheinr\xc3\xa9") for _ in range(rng.randrange(1, 400)))
        assert t.merge_short(word, ranks) == t.merge_long(word, ranks)


def test_packing(spark):
    rng = random.Random(6)
    sizes = [rng.choice([0, 1, 7, 30, 500, 1024, 1025, 2047, 2048, 2049, 5000, rng.randrange(2048)]) for _ in range(5000)]
    frame = spark.createDataFrame([(i, s, "clash") for i, s in enumerate(sizes)] + [(9999, None, "clash")], "item_id bigint, size int, bin_no string").repartition(6)
    got = pack_items(frame).collect()
    bins, whole = {}, {}
    for r in got:
        bins[r.bin_no] = bins.get(r.bin_no, 0) + r.size
        whole.setdefault(r.item_id, []).append(r.size)
    assert max(bins.values()) <= CAPACITY
    assert {k: sum(v) for k, v in whole.items()} == dict(enumerate(sizes)) | {9999: 0}
    assert all(len(v) == 1 for k, v in whole.items() if k == 9999 or sizes[k] <= CAPACITY)
    assert sum(sizes) / CAPACITY / len([b for b in bins.values() if b]) > 0.97
    assert pack_items(frame.limit(0)).count() == 0


def test_documents(spark):
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(TEXTS)], "doc_id bigint, text string")
    assert {r.doc_id for r in pack_documents(frame).collect()} == set(range(len(TEXTS)))


def test_sum_of_squares_prefers_least_change():
    packer = SumOfSquares(10)
    assert [packer.place(s) for s in (5, 5, 10, 7, 3)] == [0, 0, 1, 2, 2]
