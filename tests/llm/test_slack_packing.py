"""Operator 12: exact sums, whole plans, and every row of the query against the library."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from spanframe.llm import queries
from spanframe.llm import slack_packing as S
from tests.llm.tables import write_tables


def test_closest_sum_is_the_best_one():
    rng = random.Random(1)
    for _ in range(300):
        left = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(rng.randrange(1, 6))}
        gap = rng.randrange(0, 60)
        reach = {0}
        for x, n in left.items():
            reach = {s + x * k for s in reach for k in range(n + 1)}
        found = S.closest(sorted(left, reverse=True), left, Counter(), gap)
        assert sum(x * n for x, n in found.items()) == max(s for s in reach if s <= gap)
        assert all(n <= left[x] for x, n in found.items())


def test_plans_use_every_token_once_and_leave_no_padding():
    rng = random.Random(2)
    for _ in range(200):
        capacity = rng.choice([8, 64, 256])
        counts = {rng.randrange(1, capacity + 1): rng.randrange(1, rng.choice([3, 40, 10**7])) for _ in range(rng.randrange(0, 15))}
        runs = S.Planner(dict(counts), capacity).plan()
        assert sum(n * tokens for _, _, n, _, _, _, tokens in runs) == sum(x * n for x, n in counts.items())
        if sum(counts.values()) > 3000:
            continue
        places, sequences = defaultdict(list), defaultdict(list)
        for length, rank, n, sequence, offset, start, tokens in runs:
            for k in range(n):
                places[length, rank + k].append((start, tokens))
                sequences[sequence + k].append((offset, tokens))
        assert Counter(x for x, _ in places) == Counter(counts)
        for (length, _), own in places.items():
            assert sum(t for _, t in own) == length and all(sum(t for s2, t in own if s2 < s) == s for s, _ in own)
        for own in sequences.values():
            total = sum(t for _, t in own)
            assert all(sum(t for o2, t in own if o2 < o) == o for o, _ in own)
            assert total == capacity or total & (total - 1) == 0


def test_query_rows(spark, tmp_path):
    path = write_tables(spark, str(tmp_path))
    rows = queries.op12_slack_packing(spark, path).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    documents = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    ids = [(d, np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")) for d, t in documents]
    assert sum(r["length"] for r in rows) == sum(len(x) for _, x in ids)
    by_id = defaultdict(list)
    for d, x in ids:
        by_id[d].append(x)
    for r in rows:  # ids repeat in this table: any of their texts may stand behind a piece
        assert any(len(x) == r["doc_tokens"] and zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for x in by_id[r["doc_id"]])
    once = {d for d, n in Counter(d for d, _ in ids).items() if n == 1}
    for d in once:
        own = sorted((r["start"], r["length"]) for r in rows if r["doc_id"] == d)
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and own[0][0] == 0 and sum(n for _, n in own) == len(by_id[d][0])
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    padding = 0
    for own in sequences.values():
        total = sum(n for _, n in own)
        assert total <= 4096 and all(sum(n for o2, n in own if o2 < o) == o for o, _ in own)
        padding += 0 if total & (total - 1) == 0 else 4096 - total
    assert padding == 0
