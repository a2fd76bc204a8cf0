"""Small input tables with every odd case: nulls, empty and long texts, ties, repeated rows, extra columns with clashing names."""

from __future__ import annotations

import random

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

EXTRA = ("score", "label", "weight", "size", "name", "key", "kind", "part", "rank", "length", "piece", "base", "margin", "kept", "n_words", "digest", "first", "file", "root", "node", "a", "b")


def words(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice("the of and river stone light walk green seven paper house wind road").capitalize() if rng.random() < 0.1 else rng.choice("the of and river stone light walk green seven paper house wind road".split()) + str(rng.randrange(40)) for _ in range(n))


def texts() -> list[str | None]:
    rng = random.Random(4)
    base = [words(rng, rng.randrange(12, 60)) for _ in range(12)]
    near = [b.rsplit(" ", 1)[0] + " other" for b in base[:6]]
    odd = [None, "", " ", "\n\n", "one", "one two", "ONE two", "!!! ###", "12 34", "é ñ ü ß", "日本語 テキスト", "a b c", "\x00 nul", "x" * 5000, "mail me: anna.b@site.example.org or +1 (415) 555-0101", words(rng, 20_000), "word\tword\r\nword\x0bword", "<|endoftext|> end"]
    return base + near + odd + base[:3] + [base[0]] * 4


def write_tables(spark: SparkSession, path: str, rows: bool = True) -> str:
    """All tables of a data folder; without rows if asked."""
    docs = [(i if t is not None and i != 5 else i, t, ["en", "de", None][i % 3], f"s{i % 2}") for i, t in enumerate(texts())]
    docs += [(None, "no id at all, but some words follow here", "en", "s0"), (None, None, None, None), docs[1], docs[1]]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    for name in EXTRA:
        df = df.withColumn(name, F.lit("clash"))
    labels = [(i, int(i % 4 != 0), int(i % 3 == 0), "clash") for i in range(len(docs) - 4)] + [(1, 0, 0, None), (None, 1, 1, None), (3, None, None, None), (3, None, None, None)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    bench = spark.createDataFrame([(1, texts()[0][:120], "x"), (2, None, "x"), (None, "short", "x"), (3, "", "x"), (3, texts()[1][:90].upper(), "x")], "item_id long, text string, doc_id string")
    pages = spark.createDataFrame(
        [(1, "http://a/1", "<p>same</p>", "x"), (2, "http://a/2", "<p>same</p>", "x"), (2, "http://a/2", "<p>same</p>", "x"), (3, None, None, None), (4, "http://a/ b\r\n4", "", "x"), (None, "u", "<p>own</p>", None), (None, "u", "<p>same</p>", None), (5, "ü", "é" * 3000, "x")],
        "page_id long, url string, html string, digest string",
    )
    rng = random.Random(3)
    vectors = [(i, [rng.choice([rng.gauss(0, 0.2), -0.1, 0.25]) for _ in range(6)], rng.randrange(3), "x") for i in range(160)]
    vectors += [(200, [0.1] * 6, 1, None), (250, [0.1] * 6, 1, "x"), (251, [0.1] * 6, 2, "x"), (252, [0.1] * 6, 1, "x"), vectors[50], vectors[7], (300, [0.0] * 6, 1, "x"), (350, [-0.3] * 6, 1, "x"), (301, [1e30, -1e30, 1.0, 1.0, 1.0, 1.0], 2, "x")]
    vectors += [(400, None, 1, "x"), (401, [None, *[0.1] * 5], 1, "x"), (450, [float("nan"), *[0.1] * 5], 1, "x"), (451, [float("inf")] * 6, 1, "x"), (500, [0.2] * 6, None, "x"), (None, [0.2] * 6, 1, "x"), (550, [], 1, "x"), (551, [], 1, "x"), (552, [], 2, "x"), (600, [0.5, 0.5], 1, "x"), (601, [0.5, 0.4], 1, "x"), (602, [0.5, 0.1], 2, "x")]
    emb = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int, score string")
    for name, table in (("embeddings", emb), ("documents", df), ("labels", lab), ("benchmark", bench), ("pages", pages)):
        (table if rows else table.limit(0)).coalesce(2).write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return path
