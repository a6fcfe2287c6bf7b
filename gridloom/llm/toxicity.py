"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Every word of the examples is a term; words are compared by 52-bit hashes. A term's inverse document frequency is counted over all
documents; its tie to the label is counted over all labelled documents (equal texts once)
and enters as a smooth factor: the log ratio of its frequencies under both labels, drawn to a
small floor as far as its chi-square is small. So the cosine follows the label and not the topic,
but no word of the examples is without weight. Examples are labelled documents as unit vectors,
held in an inverted index that is cut into blocks with the highest weight of each term in each
block. A search goes through the blocks by falling upper bound and ends when no bound can reach
the k-th best cosine, so its result is exact. Similarity-weighted votes of the neighbours are
calibrated by a logistic curve fitted on the examples themselves, each left out of its own vote.

Examples are about ``per_label`` labelled documents of each label by the id's hash
(a documented bound), weighted back to the labels' frequencies. Words that no example has
match nothing but count in a text's length, as words without a tie and in no other document.
A search's cost is that of the postings in blocks whose bound passes, whatever the table's size.

A text without any term (null and empty texts too) has no neighbours; its vote is the
share of label 1 among examples without a term. Equal cosines are ordered by example id.
Repeated rows agree. Without labels of both kinds the score is the known share, else 0.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import counted, durable, fold, id_and_text, lists_of, unused, word_hashes
from gridloom.llm.quality import known_labels, labelled_sample

EVIDENCE = T.ArrayType(T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("similarity", T.DoubleType())]))


def example_words(sample: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids and labels of the examples, all their words' hashes in order, and of each example from ``starts`` on its terms with their counts."""

    def run(batches):
        for batch in batches:
            for s, e, rows, hashes in word_hashes(batch.column(1)):
                row, word, n = counted(rows, hashes)
                yield pa.RecordBatch.from_arrays([batch.column(0)[s:e], batch.column(2)[s:e], lists_of(row, e - s, pa.array(word, pa.int64())), lists_of(row, e - s, pa.array(n, pa.int32()))], names=["doc_id", "label", "word", "n"])

    table = sample.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("label").cast("int").alias("label")).mapInArrow(run, "doc_id long, label int, word array<long>, n array<int>").toArrow()
    table = table.take(np.lexsort((table["label"].to_numpy(), table["doc_id"].to_numpy())))
    flat = lambda c: np.concatenate([np.zeros(0, np.int64), *[x.flatten().to_numpy() for x in table[c].chunks]])
    starts = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *[np.diff(x.offsets.to_numpy()) for x in table["word"].chunks]]))]).astype(np.int64)
    terms, term = np.unique(flat("word"), return_inverse=True)
    return table["doc_id"].to_numpy(), table["label"].to_numpy(), terms, starts, term, flat("n")


def found_terms(column: pa.Array, terms: np.ndarray):
    """(row, next row, rows, terms) of slices of a column of texts: each distinct term of each row."""
    for s, e, rows, hashes in word_hashes(column):
        row, word, _ = counted(rows, hashes)
        at = np.minimum(np.searchsorted(terms, word), len(terms) - 1)
        held = terms[at] == word
        yield s, e, row[held], at[held]


def label_counts(docs: DataFrame, known: DataFrame, held) -> tuple[np.ndarray, np.ndarray, int, int]:
    """In how many of the distinct texts of label 1 and of label 0 each term of the broadcast ``held`` is, and how many such texts there are; over all labelled documents.

    Texts are told apart by a 64-bit hash. No text is shuffled, only the numbers of its terms.
    """

    def run(batches):
        for batch in batches:
            for s, e, row, term in found_terms(batch.column(2), held.value):
                yield pa.RecordBatch.from_arrays([batch.column(0)[s:e], batch.column(1)[s:e], lists_of(row, e - s, pa.array(term, pa.int32()))], names=["doc_id", "h", "terms"])

    def add(batches):
        size = len(held.value)
        n = np.zeros((2, size), np.int64)
        for batch in batches:
            label = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(1)
            which = np.repeat(label, np.diff(lists.offsets.to_numpy()))
            n += np.bincount(which * size + lists.flatten().to_numpy(zero_copy_only=False), minlength=2 * size).reshape(2, size)
        at = np.nonzero(n.any(0))[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[1][at], pa.int64()), pa.array(n[0][at], pa.int64())], names=["term", "a", "b"])

    keyed = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    # Of equal texts with one label the least id stands for all.
    one = durable(keyed.select("doc_id", "h").join(known, "doc_id").groupBy("h", "label").agg(F.min("doc_id").alias("doc_id")))
    sizes = {r[0]: r[1] for r in one.groupBy("label").count().collect()}
    labelled = keyed.mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("h", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType()))])).join(one.hint("merge"), ["doc_id", "h"]).select("label", "terms")
    got = labelled.mapInArrow(add, "term int, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).toArrow()
    a, b = np.zeros(len(held.value)), np.zeros(len(held.value))
    a[got["term"].to_numpy()], b[got["term"].to_numpy()] = got["a"].to_numpy(), got["b"].to_numpy()
    return a, b, sizes.get(1, 0), sizes.get(0, 0)


def tie(a: np.ndarray, b: np.ndarray, n1: float, n0: float, half: float, floor: float) -> np.ndarray:
    """The smooth factor of terms in ``a`` of ``n1`` texts with label 1 and ``b`` of ``n0`` others: over 0 for all, half the log ratio where chi-square is ``half``.

    The label that a term leans to has one text less: what a word that no other text holds says of its own text is no evidence.
    """
    n, leans = n1 + n0, a * n0 > b * n1
    a, b = np.where(leans, np.maximum(a - 1, 0), a), np.where(leans, b, np.maximum(b - 1, 0))
    chi = n * (a * (n0 - b) - b * (n1 - a)) ** 2 / np.maximum((a + b) * (n - a - b) * n1 * n0, 1)
    return floor + np.abs(np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1))) * chi / (chi + half)


def document_frequencies(docs: DataFrame, held) -> tuple[np.ndarray, int]:
    """How many of all documents hold each term of the broadcast ``held``, and how many documents there are."""

    def run(batches):
        terms, n = held.value, 0
        counts = np.zeros(len(terms), np.int64)
        for batch in batches:
            n += batch.num_rows
            for _, _, _, term in found_terms(batch.column(0), terms):
                counts += np.bincount(term, minlength=len(terms))
        at = np.nonzero(counts)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, len(counts)), pa.int32()), pa.array(np.append(counts[at], n), pa.int64())], names=["term", "n"])

    got = docs.select("text").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(held.value) + 1)
    out[got["term"].to_numpy()] = got["n"].to_numpy()
    return out[:-1], int(out[-1])


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class Examples:
    """Unit TF-IDF vectors of the examples with at least one term, by blocks.

    ``vectors`` are a matrix, or its rows as (starts, terms, values, number of terms). The ``n_dense``
    most frequent terms have a row of ``dense`` each, which many texts are multiplied with at once.
    Of all others, sorted by term, block and example, ``example`` and ``value`` are the postings; an
    entry is the postings of one term in one block, with the highest value there.
    """

    def __init__(self, vectors, ids: np.ndarray, labels: np.ndarray, weights: np.ndarray, block: int = 64, n_dense: int = 256):
        if isinstance(vectors, np.ndarray):
            row, term = np.nonzero(vectors)
            vectors = np.searchsorted(row, np.arange(len(ids) + 1)), term, vectors[row, term], vectors.shape[1]
        starts, term, value, n_terms = vectors
        row = np.repeat(np.arange(len(ids)), np.diff(starts))
        # Examples with the same strongest term side by side keep the bounds tight.
        strongest = np.lexsort((-term, value, row))[starts[1:] - 1] if len(term) else np.zeros(0, int)
        order = np.lexsort((ids, -value[strongest], term[strongest])) if len(strongest) else np.arange(len(ids))
        self.ids, self.labels, self.weights, self.block = ids[order], labels[order], weights[order], block
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        row, term, value = place[row], np.asarray(term, np.int64), np.asarray(value, float)
        at = np.lexsort((term, row))
        self.rows, self.row_terms, self.row_values = np.searchsorted(row[at], np.arange(len(ids) + 1)), term[at], value[at]
        often = np.argsort(-np.bincount(term, minlength=n_terms), kind="stable")[:n_dense]
        self.n_blocks = -(-len(ids) // block)
        self.dense_row = np.full(n_terms, -1, np.int32)
        self.dense_row[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), self.n_blocks * block))
        in_row = self.dense_row[term]
        self.dense[in_row[in_row >= 0], row[in_row >= 0]] = value[in_row >= 0]
        row, term, value = row[in_row < 0], term[in_row < 0], value[in_row < 0]
        at = np.lexsort((row, term))
        self.example, self.value, term = row[at].astype(np.int32), value[at], term[at]
        entry = term * max(1, self.n_blocks) + self.example // block
        first = np.nonzero(np.diff(entry, prepend=-1))[0]
        self.entries = np.append(first, len(entry))
        self.entry_block = (self.example[first] // block).astype(np.int32)
        self.entry_most = np.maximum.reduceat(self.value, first) if len(first) else np.zeros(0)
        self.term_entries = np.searchsorted(term[first], np.arange(n_terms + 1))

    def search(self, terms: np.ndarray, values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and cosines of the k nearest, by cosine then example id; only cosines over 0."""
        return next(self.search_many(np.array([0, len(terms)]), terms, values, k))

    def search_many(self, starts: np.ndarray, terms: np.ndarray, values: np.ndarray, k: int, batch: int = 64):
        """The same for each of the texts whose terms begin at ``starts``."""
        for s in range(0, len(starts) - 1, batch):
            of = starts[s : s + batch + 1]
            t, v = terms[of[0] : of[-1]], values[of[0] : of[-1]]
            row = np.repeat(np.arange(len(of) - 1), np.diff(of))
            place = self.dense_row[t]
            often = place >= 0
            query = np.zeros((len(of) - 1, len(self.dense)))
            query[row[often], place[often]] = v[often]
            scores = query @ self.dense
            bounds = scores.reshape(len(query), self.n_blocks, self.block).max(2)
            rare, rare_values = t[~often], v[~often]
            edge = np.searchsorted(row[~often], np.arange(len(of)))
            for i in range(len(query)):
                r = slice(edge[i], edge[i + 1])
                yield self._nearest(scores[i], bounds[i], rare[r], rare_values[r], k)

    def _nearest(self, score: np.ndarray, bound: np.ndarray, terms: np.ndarray, values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """From the scores by frequent terms and the blocks' highest: first the blocks of highest bound, then all that may still hold one of the k best."""
        sizes = self.term_entries[terms + 1] - self.term_entries[terms]
        entry, value = _ranges(self.term_entries[terms], sizes), np.repeat(values, sizes)
        blocks = self.entry_block[entry]
        bound = bound + np.bincount(blocks, value * self.entry_most[entry], self.n_blocks)
        first = np.argpartition(-bound, 7)[:8] if len(bound) > 8 else np.arange(len(bound))
        wanted = np.zeros(self.n_blocks, bool)
        wanted[first] = True
        best_at, best = self._top(score, wanted, blocks, entry, value, k, 0.0)
        least = best[-1] - 1e-11 if len(best) == k else 0.0
        more = (bound > least) & ~wanted
        if more.any():
            at, cosine = self._top(score, more, blocks, entry, value, k, least)
            best_at, best = np.append(best_at, at), np.append(best, cosine)
            top = np.lexsort((self.ids[best_at], -best))[:k]
            best_at, best = best_at[top], best[top]
        return best_at, best

    def _top(self, score: np.ndarray, wanted: np.ndarray, blocks: np.ndarray, entry: np.ndarray, value: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """The k best over ``least`` of the wanted blocks."""
        taken = np.flatnonzero(wanted[blocks])
        e = entry[taken]
        sizes = self.entries[e + 1] - self.entries[e]
        posting = _ranges(self.entries[e], sizes)
        every = np.bincount(self.example[posting], np.repeat(value[taken], sizes) * self.value[posting], len(score)) + score
        at = np.flatnonzero((every > max(least, 5e-13)) & np.repeat(wanted, self.block))
        if len(at) > 4 * k:
            # All that may tie with the k-th stay.
            at = at[every[at] >= -np.partition(-every[at], k - 1)[k - 1] - 1e-11]
        cosine = np.round(every[at], 12)
        top = np.lexsort((self.ids[at], -cosine))[:k]
        return at[top], cosine[top]

    def vote(self, at: np.ndarray, cosine: np.ndarray, prior: float, strength: float = 2.0) -> float:
        """Weighted share of label 1, drawn to ``prior`` as by ``strength`` neighbours of that share: a few copies of one example are little evidence."""
        power = cosine * self.weights[at]
        return float(((power * self.labels[at]).sum() + strength * prior) / (power.sum() + strength))


def logistic(votes: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Slope and offset of a logistic curve, by Newton steps."""
    x, p = np.stack([votes, np.ones_like(votes)], 1), np.zeros(2)
    for _ in range(50):
        m = 1 / (1 + np.exp(-x @ p))
        hessian = (x * (weight * m * (1 - m))[:, None]).T @ x + ridge * weight.sum() * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (weight * (m - y)) + ridge * weight.sum() * p)
        p = p - step
        if np.abs(step).max() < 1e-9:
            break
    return p


def unit_vectors(column: pa.Array, terms: np.ndarray, weight: np.ndarray, unknown: float):
    """(row, next row, starts, terms, values) of slices of a column of texts: unit vectors over all words, of which words that are no terms weigh ``unknown`` and are left out."""
    for s, e, rows, hashes in word_hashes(column):
        row, word, n = counted(rows, hashes)
        at = np.minimum(np.searchsorted(terms, word), len(terms) - 1)
        held = terms[at] == word
        value = (1 + np.log(n)) * np.where(held, weight[at], unknown)
        value /= np.sqrt(np.bincount(row, value * value, e - s))[row]
        yield s, e, np.searchsorted(row[held], np.arange(e - s + 1)), at[held], value[held]


def leave_one_out(spark, held, k: int, share: float, empty_vote: float) -> np.ndarray:
    """The vote on each example by the others, shared out over the cluster."""

    def run(batches):
        index = held.value
        for batch in batches:
            votes = []
            i = batch.column(0).to_numpy()
            of, at = index.rows[i], index.rows[i + 1]
            every = _ranges(of, at - of)
            starts = np.concatenate(([0], np.cumsum(at - of)))
            for own, (near, cosine) in zip(i.tolist(), index.search_many(starts, index.row_terms[every], index.row_values[every], k + 1), strict=True):
                others = near != own
                near, cosine = near[others][:k], cosine[others][:k]
                votes.append(index.vote(near, cosine, share) if len(near) else empty_vote)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(votes, pa.float64())], names=["id", "vote"])

    n = len(held.value.ids)
    got = spark.range(0, n, 1, max(1, min(64, n // 50))).mapInArrow(run, "id long, vote double").toArrow()
    out = np.zeros(n)
    out[got["id"].to_numpy()] = got["vote"].to_numpy()
    return out


def classify(docs: DataFrame, sample: DataFrame, totals: dict, labelled: DataFrame, *, text: str = "text", name: str = "score", k: int = 25, half_chi: float = 40.0, floor: float = 0.05) -> DataFrame:
    """Columns of ``docs`` (doc_id, text, ...) plus the score under ``name`` and ``<name>_evidence``, the nearest examples with their cosines; with an underscore in front where ``docs`` has such a column."""
    spark = docs.sparkSession
    share = totals.get(1, 0) / max(1, sum(totals.values()))
    terms = np.zeros(0, np.int64)
    if len(totals) == 2:
        ids, label, terms, starts, term, n = example_words(sample)
        terms = terms if len(set(label.tolist())) == 2 else terms[:0]
    index, weight, unknown, curve, empty_vote = None, np.zeros(0), 0.0, None, share
    if len(terms):
        held_terms = spark.sparkContext.broadcast(terms)
        given = docs.select("doc_id", F.col(f"`{text}`").alias("text"))
        frequency, n_docs = document_frequencies(given, held_terms)
        a, b, n1, n0 = label_counts(given, labelled, held_terms)
        held_terms.unpersist()
        weight = (np.log((1 + n_docs) / (1 + frequency)) + 1) * tie(a, b, n1, n0, half_chi, floor)
        unknown = (np.log(1 + n_docs) + 1) * floor
        y = label.astype(float)
        taken = np.bincount(label, minlength=2)
        counts_for = np.array([totals[v] / taken[v] for v in label])
        values = (1 + np.log(n)) * weight[term]
        norm = np.sqrt(np.bincount(np.repeat(np.arange(len(ids)), np.diff(starts)), values**2, len(ids)))
        some = norm > 0
        none = ~some
        empty_vote = float((counts_for * y)[none].sum() / counts_for[none].sum()) if none.any() else share
        values = values / np.repeat(norm, np.diff(starts))
        # Examples without a term have no values, so the others' starts stay.
        index = Examples((np.append(starts[:-1][some], starts[-1]), term, values, len(terms)), ids[some], y[some], counts_for[some])
        held_index = spark.sparkContext.broadcast(index)
        votes = leave_one_out(spark, held_index, k, share, empty_vote)
        held_index.unpersist()
        curve = logistic(np.append(votes, np.full(none.sum(), empty_vote)), np.append(index.labels, y[none]), np.append(index.weights, counts_for[none]))
        index.rows = index.row_terms = index.row_values = None
    held = spark.sparkContext.broadcast((index, terms, weight, unknown, curve, empty_vote, share))
    score_name, evidence_name = unused(docs, name), unused(docs, f"{name}_evidence")
    schema = T.StructType([*docs.schema.fields, T.StructField(score_name, T.DoubleType()), T.StructField(evidence_name, EVIDENCE)])
    at_text = docs.columns.index(text)

    def run(batches):
        index, terms, weight, unknown, curve, empty_vote, share = held.value
        cache: dict = {}

        def judged(at, cosine):
            vote = index.vote(at, cosine, share) if len(at) else empty_vote
            score = vote if curve is None else float(1 / (1 + np.exp(-(curve[0] * vote + curve[1]))))
            return score, [{"doc_id": int(index.ids[i]), "similarity": float(c)} for i, c in zip(at[:3], cosine[:3], strict=True)]

        for batch in batches:
            if index is None:
                slices = ((s, min(s + 1000, batch.num_rows), None, None, None) for s in range(0, batch.num_rows, 1000))
            else:
                slices = unit_vectors(batch.column(at_text), terms, weight, unknown)
            for s, e, first, t, v in slices:
                if index is None:
                    out = [judged((), ())] * (e - s)
                else:
                    keys = [hashlib.blake2b(t[first[i] : first[i + 1]].tobytes() + v[first[i] : first[i + 1]].tobytes(), digest_size=16).digest() for i in range(e - s)]
                    if len(cache) > 20_000:
                        cache.clear()
                    new = {key: i for i, key in enumerate(keys) if key not in cache}
                    i = np.fromiter(new.values(), np.int64, len(new))
                    sizes = first[i + 1] - first[i]
                    every = _ranges(first[i], sizes)
                    for key, near in zip(new, index.search_many(np.concatenate(([0], np.cumsum(sizes))), t[every], v[every], k), strict=True):
                        cache[key] = judged(*near)
                    out = [cache[key] for key in keys]
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(s, e - s).columns, pa.array([x for x, _ in out], pa.float64()), pa.array([x for _, x in out], pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64())])))],
                    names=schema.names,
                )

    return docs.mapInArrow(run, schema)


def score_documents(documents: DataFrame, labels: DataFrame, threshold: float = 0.5, per_label: int = 2000, **options) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence for every document."""
    out = classify(id_and_text(documents), *labelled_sample(documents, labels, "toxic", per_label, "toxicity"), known_labels(labels, "toxic"), **options)
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), F.col("score_evidence").alias("evidence"))
