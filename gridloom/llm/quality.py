"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` bytes. Each passage is encoded by its
character-class histogram and bigrams, how many different trigrams it holds and how
much of the document's lines repeat; a learned layer turns that into an embedding.
Gated attention, learned from document labels alone, weights the passages, and the
weighted sum is scored by a logistic output (Ilse, Tomczak and Welling, 2018).

The network is fitted by Adam on about ``per_label`` documents of each label, taken
by the id's hash (a documented bound), of which at most ``max_passages`` passages are
fitted, whole documents in hash order. Samples are weighted back to the labels'
frequencies, so the output estimates the share of label 1.

Null and empty texts are one passage of zeros and get a score like any other. Repeated
rows agree. If labels are missing, or of one kind, the score is that kind's share (1
without any labels), so that nothing is dropped for lack of evidence.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import append_columns, bounded_sample, fold, id_and_text, unit_hash, unused

PASSAGE = 1000
_KINDS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:", b"!?", b"#$%&*@^~=+<>", b"|", b"'\"()[]{}-_/\\"]
_CLASS = np.full(256, len(_KINDS), np.int32)
for _k, _chars in enumerate(_KINDS):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = len(_KINDS) + 1
_N = len(_KINDS) + 2
_TRIGRAM_BITS = 11
WIDTH = _N + _N * _N + 4


def passages(text: bytes | None) -> np.ndarray:
    """Passages by features, float32."""
    if not text:
        return np.zeros((1, WIDTH), np.float32)
    raw = np.frombuffer(text, np.uint8)
    n = max(1, round(len(raw) / PASSAGE))
    part = np.minimum(np.arange(len(raw)) // PASSAGE, n - 1)
    kind = _CLASS[raw]
    size = np.bincount(part, minlength=n).astype(np.float32)
    one = np.bincount(part * _N + kind, minlength=n * _N).reshape(n, _N) / size[:, None]
    two = np.bincount(part[:-1] * (_N * _N) + kind[:-1] * _N + kind[1:], minlength=n * _N * _N).reshape(n, _N * _N) / size[:, None]
    seen = np.zeros(n << _TRIGRAM_BITS, bool)
    if len(raw) > 2:
        wide = raw.astype(np.uint32)
        mixed = (wide[:-2] * np.uint32(0x9E3779B1) + wide[1:-1] * np.uint32(0x85EBCA77) + wide[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - _TRIGRAM_BITS)
        seen[(part[:-2] << _TRIGRAM_BITS) + mixed] = True
    variety = seen.reshape(n, -1).sum(1) / np.minimum(size, 1 << _TRIGRAM_BITS)
    lines = text.split(b"\n")
    whole = np.tile(np.float32([len(set(lines)) / len(lines), min(1.0, np.log1p(len(raw)) / 12), np.log1p(len(raw) / len(lines)) / 12]), (n, 1))
    return np.concatenate([np.sqrt(one), np.sqrt(two), variety[:, None], whole], axis=1).astype(np.float32)


class Network:
    """Embedding, gated attention and output; ``p`` holds the weights."""

    def __init__(self, width: int, embed: int = 32, gate: int = 16, seed: int = 7):
        r = np.random.default_rng(seed)
        init = lambda a, b: (r.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.p = {"E": init(width, embed), "e": np.zeros(embed, np.float32), "V": init(embed, gate), "U": init(embed, gate), "a": init(gate, 1)[:, 0], "c": init(embed, 1)[:, 0], "b": np.zeros(1, np.float32)}
        self.mean, self.scale = np.zeros(width, np.float32), np.ones(width, np.float32)

    def forward(self, x: np.ndarray, starts: np.ndarray) -> tuple:
        p = self.p
        x = (x - self.mean) / self.scale
        counts = np.diff(np.append(starts, len(x)))
        h = np.tanh(x @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        s = (t * g) @ p["a"]
        w = np.exp(s - np.repeat(np.maximum.reduceat(s, starts), counts))
        w /= np.repeat(np.add.reduceat(w, starts), counts)
        z = np.add.reduceat(w[:, None] * h, starts)
        out = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"], -30, 30)))
        return x, counts, h, t, g, w, z, out

    def gradient(self, x, starts, y, weight) -> dict:
        p = self.p
        x, counts, h, t, g, w, z, out = self.forward(x, starts)
        d = (out - y) * weight / weight.sum()
        dz = np.repeat(d[:, None] * p["c"], counts, axis=0)
        pull = (dz * h).sum(1)
        ds = w * (pull - np.repeat(np.add.reduceat(w * pull, starts), counts))
        dt, dg = ds[:, None] * p["a"] * g * (1 - t * t), ds[:, None] * p["a"] * t * g * (1 - g)
        dh = (dz * w[:, None] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        return {"E": x.T @ dh, "e": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "a": (t * g).T @ ds, "c": z.T @ d, "b": d.sum(keepdims=True)}

    def fit(self, x, starts, y, weight, epochs: int = 60, batch: int = 256, rate: float = 3e-3, decay: float = 1e-4) -> Network:
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-2)
        r, ends = np.random.default_rng(11), np.append(starts[1:], len(x))
        m, v, step = {k: 0 * a for k, a in self.p.items()}, {k: 0 * a for k, a in self.p.items()}, 0
        for _ in range(epochs):
            order = r.permutation(len(starts))
            for s in range(0, len(order), batch):
                pick = order[s : s + batch]
                rows = np.concatenate([np.arange(starts[i], ends[i]) for i in pick])
                size = ends[pick] - starts[pick]
                grad = self.gradient(x[rows], np.cumsum(size) - size, y[pick], weight[pick])
                step += 1
                for k, g in grad.items():
                    g = g + decay * self.p[k]
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def train(sample: DataFrame, counts: dict, *, max_passages: int = 60_000) -> Network | float:
    """From :func:`labelled_sample`. A number if there is nothing to tell apart."""
    if len(counts) < 2:
        return float(next(iter(counts), 1))
    field = T.StructField("bag", T.BinaryType())

    def make():
        return lambda values: [pa.array([passages(v).astype(np.float16).tobytes() for v in values], pa.binary())]

    bags = append_columns(sample, "text", make, [field]).select("label", "bag", unit_hash(F.col("doc_id"), "quality").alias("h"), "doc_id").orderBy("h", "doc_id", "bag")
    rows, held = [], 0
    for r in bags.toLocalIterator():
        held += len(r.bag) // (2 * WIDTH)
        if held > max_passages and len({k for k, _ in rows}) == 2:
            break
        rows.append((r.label, np.frombuffer(bytes(r.bag), np.float16).astype(np.float32).reshape(-1, WIDTH)))
    y = np.array([k for k, _ in rows], np.float32)
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 1.0
    sizes = np.array([len(b) for _, b in rows])
    weight = np.array([counts[int(k)] / max(1, (y == k).sum()) for k in y], np.float32)
    return Network(WIDTH).fit(np.concatenate([b for _, b in rows]), np.cumsum(sizes) - sizes, y, weight / weight.mean())


def score(docs: DataFrame, model: Network | float, *, text: str = "text", name: str = "score") -> DataFrame:
    """Columns of ``docs`` plus the score under ``name``, and ``<name>_passages`` and ``<name>_attention``: how many passages, and the highest weight."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = held.value

        def work(values, batch=256):
            scores, sizes, most = [], [], []
            for s in range(0, len(values), batch):
                bags = [passages(v) for v in values[s : s + batch]]
                count = np.array([len(b) for b in bags])
                sizes += count.tolist()
                if isinstance(model, float):
                    scores += [model] * len(bags)
                    most += [1.0 / c for c in count]
                    continue
                starts = np.cumsum(count) - count
                *_, w, _, out = model.forward(np.concatenate(bags), starts)
                scores += out.astype(float).tolist()
                most += np.maximum.reduceat(w, starts).astype(float).tolist()
            return [pa.array(scores, pa.float64()), pa.array(sizes, pa.int64()), pa.array(most, pa.float64())]

        return work

    return append_columns(docs, text, make, [T.StructField(unused(docs, name), T.DoubleType()), T.StructField(unused(docs, f"{name}_passages"), T.LongType()), T.StructField(unused(docs, f"{name}_attention"), T.DoubleType())])


def known_labels(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) of every labelled document outside the held-out fold. Of several labels of a document the greatest counts."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).filter(fold(F.col("doc_id"), 5) != 0)
    return known.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, per_label: int, seed: str) -> tuple[DataFrame, dict]:
    """(doc_id, text, label) of about ``per_label`` documents of each label outside the held-out fold, and how many labels there are of each.

    The sample is drawn from the labels, so that what is broadcast to the documents
    has a bounded number of rows and no text is shuffled.
    """
    known = known_labels(labels, label)
    counts = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    drawn = bounded_sample(known, "doc_id", "label", per_label, seed)
    return id_and_text(documents).join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "label"), counts


def score_documents(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, per_label: int = 3000, **options) -> DataFrame:
    """doc_id, held_out, score, predicted, passages and highest attention for every document."""
    model = train(*labelled_sample(documents, labels, "quality", per_label, "quality"), **options)
    out = score(id_and_text(documents), model)
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), F.col("score_passages").alias("n_passages"), F.col("score_attention").alias("top_attention"))


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, per_label: int = 3000, **options) -> DataFrame:
    """The documents that score at least ``threshold``; same columns as ``documents``."""
    model = train(*labelled_sample(documents, labels, "quality", per_label, "quality"), **options)
    name = "_quality"
    while any(c.lower().startswith(name) for c in documents.columns):
        name = f"_{name}"
    return score(documents, model, name=name).filter(F.col(name) >= threshold).select(*[F.col(f"`{c}`") for c in documents.columns])
