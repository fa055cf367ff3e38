"""Balance against a plain search, and texts without white space."""

import random
import resource

import pytest

from unskew.llm import packing

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")


def plain_balance(sizes, capacities):
    room, cost, placed, rest = list(capacities), [0.0] * len(capacities), [], []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at, left = 0, sizes[i]
        while left:
            able = [s for s in range(len(room)) if room[s] >= left] or [s for s in range(len(room)) if room[s]]
            if not able:
                rest.append((i, at, left))
                break
            s = min(able, key=lambda s: (cost[s], s))
            put = min(left, room[s])
            placed.append((i, at, put, s))
            room[s], cost[s], at, left = room[s] - put, cost[s] + packing.LINEAR * put + packing.QUADRATIC * put * put, at + put, left - put
    return placed, rest


def test_pieces_go_to_the_cheapest_sequence_with_room():
    rng = random.Random(1)
    for _ in range(100):
        sizes = [rng.randint(1, 60) for _ in range(rng.randint(0, 60))]
        capacities = [64] * (sum(sizes) // 64)
        assert packing.balance(sizes, capacities) == plain_balance(sizes, capacities)
    # thirty cheap sequences with too little room, and a dear one that has it
    placed, _ = packing.balance([40] * 30 + [50, 10], [40] * 30 + [64])
    assert [p for p in placed if p[0] == 30] == [(30, 0, 50, 30)]


def test_long_words_match_the_tokenizer():
    rng, w = random.Random(2), packing.Words(PATH)
    long = ["".join(rng.choices("abcdefghij", k=300)), "".join(rng.choices("的一是不了人我", k=400)), "a1-" * 100]
    texts = [" ".join([long[0], "the cat", long[1], long[2]]), long[2], "the end", f"{long[1]} {long[1]}", ""]
    for t, ids in zip(texts, w.ids(texts), strict=True):
        assert ids.tolist() == w.tokenizer.encode(t, add_special_tokens=False).ids
    assert not any(len(x) > packing.LONG for x in w.known)


def test_memory_of_unspaced_texts():
    rng, w = random.Random(3), packing.Words(PATH)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for k in range(6):
        w.ids(["".join(rng.choices("的一是不了人我在有他这中大来上" if k % 2 else "abcdefghijklmno", k=20_000)) for _ in range(100)])
    assert w.held < packing.CACHE and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500 << 10


def test_equal_rows_of_many_partitions_go_apart(spark):
    made = spark.createDataFrame([(1, "the same text again and again")] * 2000, "doc_id long, text string").repartition(8)
    got = packing.pack_documents(made, PATH).collect()
    assert sum(r["length"] for r in got) == 2000 * got[0]["doc_tokens"]
    assert len({r["sequence_id"] >> 40 for r in got}) > 1
