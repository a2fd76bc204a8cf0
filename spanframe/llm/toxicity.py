"""Operator 10: toxicity by a convolutional text classifier trained in numpy.

Words (runs of letters, lower case for A-Z) are hashed to embeddings, once whole and once by their first four bytes, and the two are added;
filters one, two and three words wide, a rectifier and the largest value over the whole text feed a logistic output. All labelled rows outside the held fold
take part: three in four train, dealt to shards of bounded size that start from one model; their changes are averaged, summed by slices of the model; the rest calibrate. Embeddings start from the smoothed log odds of their bucket in all training rows, so rare words start near zero. Scoring adds up tables of
embedding times filter, in blocks of texts. Slope, base and the thresholds of each language come from counts of all rows left out by language, label and logit
(in steps of 1/64); the language is the one predicted from the text (operator 5), and the score is shifted so that 0.5 is the language's threshold.

Defined results: null texts and texts without letters have no windows and get the score of the output's bias; rows with a null or
repeated doc_id are scored each; contradicting and null labels are not learnt from; without labels of both classes every score is
the share of label 1 (0 without labels); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanframe.llm import arrays as A
from spanframe.llm import langid, linear
from spanframe.llm.common import fold, labelled_ids, stored, text_blocks
from spanframe.llm.calibrate import platt

#: Rows of a training shard, about.
SHARD_ROWS = 6000
#: Numbers of a slice when models are summed.
SLICE = 1 << 14
#: Steps of a logit unit and the largest logit by which rows left out are counted.
STEPS, MOST = 64, 32
#: Hash bits of words, numbers of an embedding, filters of each width, widths.
BITS, SIZE, FILTERS, WIDTHS = 15, 12, 12, (1, 2, 3)
PAD = 2 << BITS
#: Bytes of a word's beginning that have an embedding of their own.
HEAD = 4
#: Least calibration rows of each class for a threshold of a language's own.
LEAST_ROWS = 20


def words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two buckets of each word, of the whole and of its beginning, and where each text's begin."""
    starts, stops, docs = A.runs(A.LETTER[data], ends)
    sums, shift = A.prefix_hash(A.LOWER[data]), np.uint64(64 - BITS)
    ids = np.empty((len(starts), 2), np.int64)
    ids[:, 0] = A.span_hash(sums, starts, stops) >> shift
    ids[:, 1] = (A.span_hash(sums, starts, np.minimum(starts + HEAD, stops)) >> shift) + np.uint64(1 << BITS)
    return ids, np.searchsorted(docs, np.arange(len(ends)))


def padded(ids: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids with padding after each text, so that no window reaches the next; first place and end of each text in that list."""
    more = max(WIDTHS) - 1
    n = np.diff(places)
    starts = places[:-1] + more * np.arange(len(n))
    out = np.full((len(ids) + more * (len(n) + 1), 2), PAD, np.int64)
    out[np.arange(len(ids)) + np.repeat(more * np.arange(len(n)), n)] = ids
    return out, starts, starts + n


@dataclass
class Net:
    embedding: np.ndarray  # buckets of words, of beginnings and the padding, x SIZE
    filters: list[np.ndarray]  # width x SIZE x FILTERS
    shifts: list[np.ndarray]
    output: np.ndarray
    bias: float
    slope: float = 1.0
    base: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.5
    tables: list[np.ndarray] | None = None

    def pooled(self, ids: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Largest rectified value of every filter, texts x filters."""
        if self.tables is None:
            self.tables = [np.concatenate([self.embedding @ f for f in own], 1).astype(np.float32) for own in self.filters]
        at, starts, ends = padded(ids, places)
        n, cuts, out = len(starts), np.stack([starts, ends], 1).ravel(), []
        for width, table, shift in zip(WIDTHS, self.tables, self.shifts):
            rows = table[at[:, 0]] + table[at[:, 1]]
            m = len(at) - width + 1
            z = rows[:m, :FILTERS]
            for j in range(1, width):
                z = z + rows[j : m + j, j * FILTERS : (j + 1) * FILTERS]
            z = np.concatenate([z, np.zeros((max(WIDTHS), FILTERS), z.dtype)])
            top = np.maximum.reduceat(z, cuts, axis=0)[::2] if n else np.zeros((0, FILTERS), np.float32)
            out.append(np.where((ends > starts)[:, None], np.maximum(top + shift, 0), 0))
        return np.concatenate(out, 1)

    def logits(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self.pooled(*words(data, ends)) @ self.output + self.bias

    def chance(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logits + self.base, -500, 500)))

    def scores(self, logits: np.ndarray, languages: list[str]) -> np.ndarray:
        t = np.array([self.thresholds.get(x, self.threshold) for x in languages])
        return 1 / (1 + np.exp(-np.clip(self.slope * logits + self.base - np.log(t / (1 - t)), -500, 500)))


class _Step:
    """AdaGrad for one array, or some of its rows."""

    def __init__(self, values: np.ndarray, rate: float):
        self.values, self.rate, self.squares = values, rate, np.full_like(values, 1e-4)

    def __call__(self, grad: np.ndarray, rows=slice(None)) -> None:
        self.squares[rows] += grad * grad
        self.values[rows] -= self.rate * grad / np.sqrt(self.squares[rows])


def begin(seen: np.ndarray, n0: float, n1: float) -> Net:
    """The model that training starts from: ``seen`` counts the texts of either label with each bucket, n0 and n1 all texts."""
    rng = np.random.default_rng(5)
    odds = np.log((seen[1] + 0.5) / (n1 + 1)) - np.log((seen[0] + 0.5) / (n0 + 1))
    many = seen[0] + seen[1]
    embedding = rng.normal(0, 0.02, (PAD + 1, SIZE)).astype(np.float32)
    embedding[:, 0] = np.clip(odds * many / (many + 4), -2, 2)
    embedding[PAD] = 0
    filters = [rng.normal(0, 0.15, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, 0, : FILTERS // 2] = 1 / len(f)
    return Net(embedding, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32), 0.0)


def fit(net: Net, texts: list[np.ndarray], y: np.ndarray, n0: float, n1: float, epochs: int = 6, batch: int = 32) -> None:
    """Train a model further on arrays of word buckets and 0/1 labels, both classes (n0 and n1 rows in all) weighing the same."""
    rng, embedding, filters, bias = np.random.default_rng(6), net.embedding, net.filters, np.array([net.bias])
    steps = [_Step(f, 0.03) for f in filters], [_Step(s, 0.03) for s in net.shifts], _Step(net.output, 0.1), _Step(embedding, 0.05), _Step(bias, 0.1)
    weight = np.where(y == 1, (n0 + n1) / (2 * n1), (n0 + n1) / (2 * n0))
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), batch):
            own = [j for j in order[i : i + batch] if len(texts[j])]
            if not own:
                continue
            at, starts, ends = padded(np.concatenate([texts[j] for j in own]), np.cumsum([0, *(len(texts[j]) for j in own)]))
            rows = embedding[at].sum(1)
            tops, spots = [], []
            for width, f, s in zip(WIDTHS, filters, net.shifts):
                m = len(at) - width + 1
                z = sum(rows[k : m + k] @ f[k] for k in range(width))
                spot = np.stack([a + z[a:b].argmax(0) for a, b in zip(starts, ends)])
                tops.append(np.maximum(np.take_along_axis(z, spot, 0) + s, 0))
                spots.append(spot)
            h = np.concatenate(tops, 1)
            g = ((1 / (1 + np.exp(-np.clip(h @ net.output + bias[0], -40, 40))) - y[own]) * weight[own] / len(own)).astype(np.float32)
            gh = np.where(h > 0, g[:, None] * net.output, 0)
            touched, grads = [], []
            for k, (width, f, spot) in enumerate(zip(WIDTHS, filters, spots)):
                part = gh[:, k * FILTERS : (k + 1) * FILTERS]
                grad = np.zeros_like(f)
                for j in range(width):
                    ids = at[spot + j]
                    grad[j] = np.einsum("bfd,bf->df", embedding[ids].sum(2), part)
                    touched += [ids[..., 0].ravel(), ids[..., 1].ravel()]
                    grads += [(part[:, :, None] * f[j].T[None]).reshape(-1, SIZE)] * 2
                steps[0][k](grad)
                steps[1][k](part.sum(0))
            steps[2](h.T @ g + 1e-4 * net.output)
            steps[4](np.array([g.sum()]))
            ids, where = np.unique(np.concatenate(touched), return_inverse=True)
            total = np.zeros((len(ids), SIZE), np.float32)
            np.add.at(total, where, np.concatenate(grads))
            real = ids < PAD
            steps[3](total[real], ids[real])
    net.bias = float(bias[0])


def best_threshold(p: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """The threshold with the most weighted F1, in the middle of the gap it lies in."""
    order = np.argsort(-p)
    hit, all_ = np.cumsum((w * y)[order]), np.cumsum(w[order])
    f1 = 2 * hit / (all_ + (w * y).sum())
    ties = np.append(p[order][1:] == p[order][:-1], False)
    k = int(np.argmax(np.where(ties, -1, f1)))
    low = p[order][k + 1] if k + 1 < len(p) else 0.0
    return float(np.clip((p[order][k] + low) / 2, 0.02, 0.98))


def _flat(net: Net) -> np.ndarray:
    return np.concatenate([v.ravel() for v in (net.embedding, *net.filters, *net.shifts, net.output, np.array([net.bias]))]).astype(np.float64)


def _unflat(values: np.ndarray) -> Net:
    shapes = [(PAD + 1, SIZE), *((w, SIZE, FILTERS) for w in WIDTHS), *((FILTERS,) for _ in WIDTHS), (FILTERS * len(WIDTHS),)]
    cuts = np.cumsum([int(np.prod(s)) for s in shapes])
    parts = [v.reshape(s).astype(np.float32) for v, s in zip(np.split(values[:-1], cuts[:-1]), shapes)]
    k = len(WIDTHS)
    return Net(parts[0], parts[1 : k + 1], parts[k + 1 : 2 * k + 1], parts[-1], float(values[-1]))


#: What tasks yield of an array: its numbers other than 0 and their places, by slices.
SPARSE = "slice int, at binary, part binary"


def _slices(values: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(values)
    cuts = np.flatnonzero(np.diff(at // SLICE, prepend=-1))
    some = [*zip(cuts, [*cuts[1:], len(at)])]
    columns = [[at[i] // SLICE for i, _ in some], [(at[i:j] % SLICE).astype(np.int32).tobytes() for i, j in some], [values[at[i:j]].astype(np.float32).tobytes() for i, j in some]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary()))], names=["slice", "at", "part"])


def _summed(parts: DataFrame, size: int) -> np.ndarray:
    """Sum of the arrays of ``size`` numbers that tasks yield by slices: a task adds up the parts of some slices, the driver gets one array."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, at, part in zip(batch.column("slice").to_pylist(), batch.column("at"), batch.column("part")):
                own = sums.setdefault(i, np.zeros(SLICE))
                own[np.frombuffer(at.as_buffer(), np.int32)] += np.frombuffer(part.as_buffer(), np.float32)
        if sums:
            yield pa.RecordBatch.from_pydict({"slice": pa.array([*sums], pa.int32()), "part": pa.array([v.tobytes() for v in sums.values()], pa.binary())})

    out = np.zeros(-(-size // SLICE) * SLICE)
    for r in parts.repartition("slice").mapInArrow(add, "slice int, part binary").collect():
        out[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["part"], np.float64)
    return out[:size]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, int]]:
    for block in text_blocks(batches):
        ids, places = words(*A.raw(block.column("text")))
        yield from zip(np.split(ids, places[1:-1]), block.column("label").to_pylist())


def train(rows: DataFrame, n0: int, n1: int) -> Net:
    """Train on all rows (doc_id, text, label) of both classes, n0 and n1 of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, PAD + 1))
        for ids, label in _texts(batches):
            seen[label][np.unique(ids)] += 1
        yield _slices(seen.ravel())

    seen = _summed(rows.select("text", "label").mapInArrow(count, SPARSE), 2 * (PAD + 1)).reshape(2, -1)
    shards, start = -(-(n0 + n1) // SHARD_ROWS), _flat(begin(seen, n0, n1)).astype(np.float32)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, y = [], []
        for ids, label in _texts(batches):
            texts.append(ids)
            y.append(label)
        if texts:
            own = _unflat(start)
            fit(own, texts, np.array(y), n0, n1)
            yield _slices((_flat(own) - start) * (len(y) / (n0 + n1)))

    dealt = rows.repartition(shards, F.xxhash64("doc_id", "text")).sortWithinPartitions("doc_id", "text")
    return _unflat(start + _summed(dealt.select("text", "label").mapInArrow(shard, SPARSE), len(start)))


def learn(documents: DataFrame, labels: DataFrame, codes: langid.Codes, folds: int, held: int) -> Net:
    """Train on the labelled rows outside the held fold, all but one in four, then calibrate on those."""
    fits = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(4)) > 0
    asked = documents.select("doc_id", "text").where("text is not null").where(fold("doc_id", folds) != held)
    ids = labelled_ids(labels, "toxic", folds, held).hint("merge")  # as many as the table has: no broadcast at any size
    rows = stored(asked.join(ids, "doc_id").withColumn("fits", fits), "toxic-rows")
    counts = {(r["fits"], r["label"]): r["count"] for r in rows.groupBy("fits", "label").count().collect()}
    n0, n1 = (counts.get((True, label), 0) for label in (0, 1))
    if not (n0 and n1):
        n = sum(counts.values())
        share = sum(c for (_, label), c in counts.items() if label) / n if n else 0.0
        base = float(np.log((share + 1e-9) / (1 - share + 1e-9)))
        return Net(np.zeros((PAD + 1, SIZE), np.float32), [np.zeros((w, SIZE, FILTERS), np.float32) for w in WIDTHS], [np.zeros(FILTERS)] * len(WIDTHS), np.zeros(FILTERS * len(WIDTHS)), base)
    net = train(rows.where("fits"), n0, n1)

    def left(_: pa.Array, data: np.ndarray, ends: np.ndarray) -> dict:
        steps = np.rint(np.clip(net.logits(data, ends), -MOST, MOST) * STEPS).astype(np.int32)
        return {"step": steps, "lang": pa.array(_languages(codes, data, ends), pa.string())}

    rest = linear.apply_blocks(rows.where("not fits"), "text", ("label",), left, "step int, lang string").groupBy("lang", "label", "step").agg(F.count(F.lit(1)).cast("double").alias("rows"))
    rest = rest.toArrow().sort_by([("lang", "ascending"), ("step", "ascending"), ("label", "ascending")])
    y, w, z, lang = (rest[n].to_numpy() for n in ("label", "rows", "step", "lang"))
    if len(set(y.tolist())) == 2:
        net.slope, net.base = platt(z / STEPS, y, w)
        p = net.chance(z / STEPS)
        net.threshold = best_threshold(p, y, w)
        for x in sorted(set(lang)):
            own = lang == x
            if min((w * y)[own].sum(), (w * (1 - y))[own].sum()) >= LEAST_ROWS:
                net.thresholds[x] = best_threshold(p[own], y[own], w[own])
    return net


def _languages(codes: langid.Codes, data: np.ndarray, ends: np.ndarray) -> list[str]:
    if not codes.languages:
        return ["und"] * (len(ends) - 1)
    return [codes.languages[i] for i in codes.probabilities(data, ends).argmax(1)]


def score(documents: DataFrame, net: Net, codes: langid.Codes, *keep: str) -> DataFrame:
    """The kept columns and ``score`` of every row."""
    net.pooled(np.zeros((0, 2), np.int64), np.zeros(1, np.int64))  # makes the tables once

    def scored(_: pa.Array, data: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
        return {"score": net.scores(net.logits(data, ends).astype(float), _languages(codes, data, ends))}

    return linear.apply_blocks(documents, "text", keep, scored, "score double")
