"""The methods against brute force, the libraries themselves, exact round trips and held-out accuracy."""

import bisect
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from spanframe.llm import arrays, decontaminate, jaccard, langid, packing, pii, queries, stats, token_files, toxicity, warc
from spanframe.llm.common import shared_path
from spanframe.llm.tokens import Encoder
from tests.llm.tables import texts

SF = "/root/testdata/sf0.01"


def column(values):
    return pa.array([v.encode() for v in values], pa.large_binary())


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_like"])
def test_ids_equal_those_of_whole_texts(file, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json" if file == "piece_like" else file)
    encoder = Encoder(path)
    if file == "piece_like":
        encoder.kind = "whole"
    rng = random.Random(2)
    parts = ["  ", "\n\n", " \n", "\t", " ", "\n", "\x1c", "<|endoftext|>", "é", "'s", "Σ ς", "ﬁ", "́", "123 45", ".", "a.", "İ.", "\x00", "\r\n", "🙂", "don't", "X!?", "##", "%,", "a-", "'", " ", "　", "×.", "H̱", "ab", "Cd"]
    own = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 10))) for _ in range(1500)] + [t for t in texts() if t]
    want = [e.ids for e in encoder.tokenizer.encode_batch(own, add_special_tokens=False)]
    for _ in range(2):
        flat, offsets = encoder.encode(column(own))
        assert [flat[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == want
    encoder._forget()
    flat, offsets = encoder.encode(column(own[:50]))
    assert [flat[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == want[:50]


def test_token_files_round_trip(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    path = shared_path(spark, "round-trip")
    token_files.write_token_files(spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "doc_id long, text string"), public_tokenizers.path("word_bpe_49k.json"), path, 2)
    files, library = token_files.TokenFiles(path), Encoder(public_tokenizers.path("word_bpe_49k.json")).tokenizer
    assert len(files) == len(rows)
    for i, text in rows:
        assert files.ids(i).tolist() == library.encode(text or "", add_special_tokens=False).ids + [2]
    got = {r["doc_id"]: r for r in token_files.read_token_files(spark, path).collect()}
    assert all(got[i]["ids_crc32"] == zlib.crc32(files.ids(i).astype("<u4").tobytes()) for i, _ in rows)


def test_counts():
    own = [t or "" for t in texts()] + ["a b c d e a b c d e f\nx\nx\n \nx\r", "one|two\n\none|two $ %"]
    got = stats.counts(*arrays.raw(column(own)))
    for i, t in enumerate(own):
        w = re.findall("[^\x20\x09-\x0D]+", t)
        windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        often, covered, seen, lines = Counter(windows), set(), set(), 0
        for k, x in enumerate(windows):
            if often[x] > 1:
                covered.update(range(k, k + 5))
        for line in t.split("\n"):
            if re.search("[^\x20\x09-\x0D]", line):
                lines += line in seen
                seen.add(line)
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), lines, len(covered))
        assert tuple(int(got[n][i]) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want


def edit_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != x), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_edit_matching():
    rng = random.Random(3)
    for _ in range(300):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randrange(a, b))) for a, b in ((1, 12), (0, 25)))
        assert decontaminate.distance(p, t)[0] == edit_distance(p, t)
    for _ in range(150):
        item = decontaminate.normal("".join(rng.choice("abcde ") for _ in range(rng.randrange(24, 70))))
        if len(item) < decontaminate.LEAST:
            continue
        allowed, x = decontaminate.budget(len(item)), list(item)
        for _ in range(rng.randrange(0, allowed + 3)):
            i = rng.randrange(len(x))
            x[i : i + 1] = rng.choice([[], [rng.choice("abcde")], [x[i], rng.choice("abcde")]])
        text = decontaminate.normal("".join(rng.choice("abcde ") for _ in range(40)) + "".join(x) + item[3:12])
        assert bool(decontaminate.Finder([(1, item)]).hits(text)) == (edit_distance(item, text) <= allowed)


def best_fit(counts):
    """Sequences that best-fit decreasing needs."""
    gaps, total = [], 0
    for x in range(len(counts) - 1, 0, -1):
        for _ in range(int(counts[x])):
            i = bisect.bisect_left(gaps, x)
            gap = gaps.pop(i) if i < len(gaps) else len(counts) - 1
            total += gap == len(counts) - 1
            if gap > x:
                bisect.insort(gaps, gap - x)
    return total


def test_packing_plan():
    rng = np.random.default_rng(1)
    for _ in range(20):
        counts = np.zeros(129, np.int64)
        np.add.at(counts, rng.integers(1, 129, 400), rng.integers(1, 50))
        used, total = Counter(), 0
        for copies, one in packing.fill(counts):
            assert copies > 0 and sum(k * n for k, n in one.items()) <= 128
            total += copies
            for k, n in one.items():
                used[k] += copies * n
        assert all(used[k] == counts[k] for k in range(129))
        assert total <= 1.003 * best_fit(counts) + 1


def test_cut_puts_the_short_piece_first():
    assert packing.cut(2500, 1024) == [(0, 452), (452, 1024), (1476, 1024)]
    assert packing.cut(2048, 1024) == [(0, 1024), (1024, 1024)] and packing.cut(1, 1024) == [(0, 1)]


def test_sequences_hold_the_documents(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "doc_id long, text string")
    packed = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 256, 2, with_ids=True)
    rows = packing.sequences(packed).collect()
    assert sum(len(r["ids"]) for r in rows) == sum(r["length"] for r in packed.collect()) and max(len(r["ids"]) for r in rows) <= 256


def test_salvage():
    members = [warc.member(warc.page_record(i, f"http://a/{i}", f"<p>{i}</p>" * 200, None)) for i in range(6)]
    data = bytearray(b"".join(members))
    data[len(members[0]) + len(members[1]) + 40] ^= 255
    found = [(k, a, b) for k, a, b, _, _ in warc.salvage(bytes(data[:-20]))]
    ends = np.cumsum([0, *map(len, members)]).tolist()
    assert found == [("record", 0, ends[1]), ("record", ends[1], ends[2]), ("gap", ends[2], ends[3]), ("record", ends[3], ends[4]), ("record", ends[4], ends[5]), ("gap", ends[5], ends[6] - 20)]
    plain = bytearray(b"".join(warc.page_record(i, "http://a", f"<p>{i}</p>" * 9, None) for i in range(4)))
    plain[plain.find(b"<p>2") + 1] ^= 1
    kinds = [k for k, *_ in warc.salvage(bytes(plain))]
    assert kinds == ["record", "record", "gap", "record"]
    assert [k for k, *_ in warc.salvage(b"junk" + warc.page_record(1, "u", "x", None))] == ["gap", "record"]
    assert [k for k, *_ in warc.salvage(b"nothing to see")] == ["gap"]


def test_surrogates():
    replace = pii.Replacer(b"key")
    text = "Mr. John Smith (john.smith@mail.example.org, +1 (415) 555-0101, 123-45-6789) wrote Mrs. Smith; card 4111 1111 1111 1111, DE89 3704 0044 0532 0130 00, 10.1.2.3, JOHN. Иван Петров. password=abcdef12"
    new, n = replace(text)
    assert n >= 10 and replace(text)[0] == new and pii.Replacer(b"other")(text)[0] != new
    for a, b, kind in pii.entities(text):
        assert text[a:b] not in new, kind
    assert re.search(r"Mr\. (\w+) (\w+) .*Mrs\. \2;", new)
    card = re.search(r"card ([\d ]+),", new)[1]
    assert [len(x) for x in card.split()] == [4] * 4 and pii.luhn(card.replace(" ", "")[:-1]) == int(card[-1])
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}, \d{3}-\d{2}-\d{4}\)", new) and re.search(r"DE\d\d( \d{4}){4} \d\d,", new)
    assert len({pii.permuted(b"k", f"{i:04d}", "t") for i in range(10_000)}) == 10_000
    assert replace("No. 5 of 12 things, 2024-01-02, 3.14 and 1234567890123456.")[1] == 0


def test_jaccard_against_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 6, 11, 13, 21, 24, 40, 90, 200]))]
        rows.append(base)
        for _ in range(rng.randrange(0, 8)):
            x = list(rng.choice(rows[-3:]))
            for _ in range(rng.randrange(0, 3)):
                k = rng.randrange(len(x))
                x[k : k + 1] = rng.choice([[], [rng.choice(vocabulary)], [x[k], rng.choice(vocabulary)]])
            rows.append(x or ["one"])
    docs = [(i, " ".join(x).upper() if i % 5 == 0 else " ".join(x)) for i, x in enumerate(rows)]
    sets = [set(zip(x, x[1:], x[2:])) if len(x) >= 3 else {tuple(x)} for x in (t.lower().split() for _, t in docs)]
    for percent in (60, 90):
        root = list(range(len(sets)))

        def find(a, root=root):
            while root[a] != a:
                a = root[a]
            return a

        for i, x in enumerate(sets):
            for j in range(i):
                both = len(x & sets[j])
                if 100 * both >= percent * len(x | sets[j]):
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), 3, percent).collect()}
        assert got == {i: (len(x), find(i)) for i, x in enumerate(sets)}


def test_boundary_follows_cost():
    sizes = np.zeros(1 << 14, np.int64)
    sizes[5:60] = 100
    assert jaccard.boundary(sizes, 90) == 19 and jaccard.boundary(sizes * 0, 90) == 0


def test_codewords_are_apart():
    for k in (2, 3, 4, 5, 9, 30, 250):
        words = langid.codewords(k)
        assert len(words) == k
        least = min(int((a != b).sum()) for i, a in enumerate(words) for b in words[:i])
        assert least >= max(1, words.shape[1] // 5)


def test_every_language_is_learnt(spark):
    names = [f"l{k:03}" for k in range(250)]
    spell = lambda k: "".join(chr(97 + (k * 7 + j * (1 + k // 26)) % 26) for j in range(6))
    rows = [(k * 4 + c, f"{spell(k)} {spell(k)}", name) for k, name in enumerate(names) for c in range(4)] + [(5000, "abc", None), (5001, None, "l000")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    codes = langid.learn(docs, 1, 1)
    assert codes.languages == names and codes.words.shape[0] == 250
    got = langid.identify(docs, codes, "doc_id").collect()
    assert len(got) == len(rows) and {r["lang_pred"] for r in got} <= {*names, "und"}
    assert len({r["lang_pred"] for r in got}) > 200


def test_threshold_separates():
    p, y = np.array([0.1, 0.2, 0.6, 0.9]), np.array([0, 0, 1, 1])
    assert 0.2 < toxicity.best_threshold(p, y, np.ones(4)) < 0.6


def accuracy(spark, name, label, folder):
    pred = queries.QUERIES[name](spark, folder).where("held_out")
    truth = queries.table(spark, folder, "labels").select("doc_id", label).where(f"{label} is not null")
    rows = pred.join(truth, "doc_id").select("predicted", label).collect()
    return sum(r[0] == r[1] for r in rows) / len(rows), len(rows)


def test_held_out_accuracy(spark):
    quality, n = accuracy(spark, "op1_quality_classifier", "quality", SF)
    assert n > 50 and quality > 0.95
    rows = queries.QUERIES["op5_language_id"](spark, SF).where("held_out").join(queries.table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").where("lang is not null").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) / len(rows) > 0.98
    toxic, n = accuracy(spark, "op10_toxicity", "toxic", "/root/testdata/sf0.1")
    assert n > 500 and toxic > 0.95
