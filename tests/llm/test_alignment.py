"""Operator 13: encoders against the libraries, the hash, and every row of the query against a plain merge of token ends."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from spanframe.llm import alignment, perfect_hash, piece_tokens, queries
from spanframe.llm.common import shared_path
from tests.llm.tables import texts, write_tables

FIRST, SECOND = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["  ", "\n\n", " \n", "\t", " ", "\n", "\x1c", "<s>", "é", "'s", "ﬁ", "123 45", ".", "a.", "\x00", "\r\n", "🙂", "don't", "##", "　", "ab", "Cd", "▁", "日本", "<0x41>", "<|endoftext|>"]


def own_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(0, 10))) for _ in range(n)] + [t for t in texts() if t]


def test_piece_ids_equal_those_of_whole_texts():
    encoder = piece_tokens.piece_encoder(SECOND)[0]
    assert encoder.cuts and encoder.lines
    own = own_texts(1500, 2)
    want = encoder.model.encode(own, num_threads=1)
    for _ in range(2):
        flat, edges = encoder.encode(pa.array([t.encode() for t in own], pa.large_binary()))
        assert [flat[a:b].tolist() for a, b in zip(edges, edges[1:])] == want
    encoder._forget()
    encoder.cuts = False
    try:
        flat, edges = encoder.encode(pa.array([t.encode() for t in own[:60]], pa.large_binary()))
        assert [flat[a:b].tolist() for a, b in zip(edges, edges[1:])] == want[:60]
    finally:
        encoder.cuts = True


def test_perfect_hash_is_minimal_and_knows_strangers():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 60_000):
        keys = np.unique(rng.integers(0, 1 << 47, n))
        function = perfect_hash.PerfectHash.build(keys)
        assert sorted(function.index(keys).tolist()) == list(range(len(keys)))
        others = np.setdiff1d(rng.integers(0, 1 << 47, 500), keys)
        assert (function.index(others) == perfect_hash.MISSING).all()


def plain(documents):
    """Rows by a merge of token ends, in plain Python."""
    library = Tokenizer.from_file(FIRST)
    library.encode_special_tokens = True
    model = piece_tokens.piece_encoder(SECOND)[0].model
    tables = piece_tokens.byte_level_bytes(library), piece_tokens.piece_bytes(model)
    entry = lambda t, i: t.data[t.starts[i] : t.starts[i] + t.sizes[i]].tobytes()
    counts, kept = Counter(), []
    for doc, text in documents:
        a = library.encode(" " + text, add_special_tokens=False).ids if text else []
        b = model.encode(text) if text else []
        parts = [[entry(t, i) for i in ids] for t, ids in zip(tables, (a, b))]
        if not text or any(b"".join(p) != (" " + text).encode() for p in parts):
            kept.append((doc, 0, 0, [], []))
            continue
        links, groups, i, j, end_a, end_b, group = [], [], 0, 0, len(parts[0][0]), len(parts[1][0]), ([a[0]], [b[0]])
        while True:
            links.append((a[i], b[j]))
            both = end_a == end_b
            step_a, step_b = end_a <= end_b, end_b <= end_a
            if both:
                groups.append(group)
                group = ([], [])
            i, j = i + step_a, j + step_b
            if i == len(a):
                break
            if step_a:
                end_a += len(parts[0][i])
                group[0].append(a[i])
            if step_b:
                end_b += len(parts[1][j])
                group[1].append(b[j])
        counts.update(links)
        kept.append((doc, len(a), len(b), groups, links))
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    out = []
    for doc, n_a, n_b, groups, links in kept:
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        out.append((doc, n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return out, counts, best


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r))


def test_query_equals_brute_force(spark, tmp_path):
    path = write_tables(spark, str(tmp_path))
    documents = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    assert ordered(queries.op13_tokenizer_alignment(spark, path).collect()) == ordered(plain(documents)[0])


def test_many_buckets_and_a_tree_of_sums(spark, monkeypatch):
    monkeypatch.setattr(perfect_hash, "BUCKET_KEYS", 50)
    monkeypatch.setattr(alignment, "FAN", 2)
    monkeypatch.setattr(alignment, "HELD", 300)
    documents = list(enumerate(own_texts(400, 5)))
    df = spark.createDataFrame(documents, "doc_id long, text string").repartition(7)
    rows, counts, best = plain(documents)
    assert ordered(alignment.align_documents(df, FIRST, SECOND).collect()) == ordered(rows)
    tokens = alignment.encoded(df, FIRST, SECOND)
    tokens.write.parquet(path := shared_path(spark, "tokens-test"))
    made = alignment.count_pairs(spark.read.parquet(path), FIRST, SECOND)
    assert made.buckets > 3
    assert {(r["a_id"], r["b_id"]): (r["links"], r["best"]) for r in made.table(spark).collect()} == {k: (n, n == best[k[1]]) for k, n in counts.items()}
    assert made.of(np.array([5 << 32 | 31_999])).tolist() == [counts[5, 31_999]]
