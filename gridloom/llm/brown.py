"""Language-model scoring with Brown class-based bigrams.

A token's probability is that of its class after the last token's class, times that of the
token in its class. The ``n_words`` most frequent words are put into ``n_classes`` classes by
the exchange algorithm, which moves one word at a time to the class that most raises the
likelihood of the training bigrams. Every other word of the training texts is then put into
the class in which its own neighbours are likeliest, whatever its count. A word never seen
is taken for one of the class that most seen words with its last two bytes have. End of text
is a class of its own and also what a text starts after.

Transitions between classes are counted over all training texts once every word has its
class, and interpolated with class frequencies. In a class every seen word gives up half a
count, and the sum is spread over one more unseen word than there are seen ones.

Word counts, neighbours and classes cover the whole training corpus and stay distributed: the
``n_lookup`` most frequent words are a bounded dictionary on every executor, all others are
joined by word, token by token. Class sequences take one byte for a token.

Null texts are empty; an empty text is one end token. Rows are scored one by one, so
repeated rows agree and none are merged. Ties between words go by their bytes, ties between
classes to the first. An empty table gives an empty result; without training documents all
tokens are unknown.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import durable, fold, lists_of, tokens

#: No token holds white space, so this stands for the end of a text.
END = b"\n"
#: Cells for the last two bytes of words.
ENDINGS = 4096
#: In a class sequence, a token whose class is not in the dictionary.
OPEN = 255


def count_words(texts: DataFrame, flush: int = 300_000) -> DataFrame:
    """word, n over the column ``text``, with ends. Each task adds up what it has seen, ``flush`` words at a time."""

    def run(batches):
        counts: dict[bytes, int] = {}

        def emit():
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for value in batch.column(0).cast(pa.binary()).to_pylist():
                for w in tokens(value):
                    counts[w] = counts.get(w, 0) + 1
                counts[END] = counts.get(END, 0) + 1
                if len(counts) >= flush:
                    yield emit()
        yield emit()

    return texts.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def count_bigrams(texts: DataFrame, frequent: list[bytes]) -> np.ndarray:
    """Counts of unit pairs, units squared, a bounded matrix. Units are the frequent words, any other word and the end, which a text starts after."""
    other = len(frequent)
    size = other + 2
    held = texts.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(frequent)})

    def run(batches):
        get, total = held.value.get, np.zeros(size * size, np.int64)
        for batch in batches:
            chunk: list[int] = []
            values = batch.column(0).cast(pa.binary()).to_pylist()
            for i, value in enumerate(values):
                chunk += [get(w, other) for w in tokens(value)]
                chunk.append(other + 1)
                if len(chunk) > 500_000 or i == len(values) - 1:
                    unit = np.array([other + 1, *chunk], np.int64)
                    pair, n = np.unique(unit[:-1] * size + unit[1:], return_counts=True)
                    total[pair] += n
                    chunk = []
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["pair", "n"])

    return _matrix(texts.select("text").mapInArrow(run, "pair long, n long"), size)


def _matrix(pairs: DataFrame, size: int) -> np.ndarray:
    table = pairs.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size)
    out[table["pair"].to_numpy()] = table["n"].to_numpy()
    return out.reshape(size, size)


def neighbours(texts: DataFrame, lookup: list[bytes], of: np.ndarray, flush: int = 300_000) -> DataFrame:
    """word and cells: how often words without a class stand next to each class.

    ``of`` holds the classes of the first words of ``lookup``, then that of any other word and of the end.
    A cell is the class before, or the number of classes plus the class after; its count times the number of cells is added to it.
    Each task adds up what it has seen, so a word has at most a few rows of each.
    """
    classed, kinds = len(of) - 2, int(of.max()) + 1
    cells, end = 2 * kinds, len(lookup)
    held = texts.sparkSession.sparkContext.broadcast(lookup)

    def run(batches):
        first = {w: i for i, w in enumerate([*held.value, END])}
        class_of = np.full(len(first) + 1, of[classed], np.int64)
        class_of[:classed], class_of[end] = of[:classed], of[classed + 1]
        ids, found, seen, chunk = dict(first), [], 0, [end]

        def fold_in():
            unit = np.array(chunk, np.int64)
            kind = class_of[np.minimum(unit, len(first))]
            at = np.flatnonzero((unit >= classed) & (unit != end))
            found.append(np.unique(np.concatenate((unit[at] * cells + kind[at - 1], unit[at] * cells + kinds + kind[at + 1])), return_counts=True))

        def emit():
            key, n = np.concatenate([k for k, _ in found]), np.concatenate([n for _, n in found])
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order]
            begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))[: len(key)]
            key, n = key[begin], np.add.reduceat(n, begin) if len(key) else n
            word = key // cells
            own, at = np.unique(word, return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(list(ids), pa.binary()).take(pa.array(own)), lists_of(at, len(own), pa.array(key % cells + cells * n, pa.int64()))], names=["word", "cells"])

        for batch in batches:
            for value in batch.column(0).cast(pa.binary()).to_pylist():
                for w in tokens(value):
                    if (u := ids.get(w)) is None:
                        u = ids[w] = len(ids)
                    chunk.append(u)
                chunk.append(end)
                if len(chunk) > 500_000:
                    fold_in()
                    seen += len(chunk)
                    chunk = [end]
                    if len(ids) - len(first) > flush or seen > 20_000_000:
                        yield emit()
                        ids, found, seen = dict(first), [], 0
        fold_in()
        yield emit()

    return texts.select("text").mapInArrow(run, "word binary, cells array<long>")


def place(near: DataFrame, trans: np.ndarray, class_n: np.ndarray) -> DataFrame:
    """word, n and cls, the class that makes the word and its neighbours likeliest, of every word of ``neighbours``.

    ``trans`` (log10) and ``class_n`` are those of the exchanged words. Words arrive sorted; only the last one is held back.
    """
    kinds, classes = len(trans), len(class_n)
    weight = np.concatenate((trans[:, :classes], trans[:classes].T))

    def rows(words, counts):
        n = counts[:, :kinds].sum(1)
        gain = counts @ weight - n[:, None] * np.log10(class_n + n[:, None])
        return pa.RecordBatch.from_arrays([words, pa.array(n.astype(np.int64)), pa.array(np.round(gain, 6).argmax(1).astype(np.int32))], names=["word", "n", "cls"])

    def run(batches):
        word, held = None, None
        for batch in (b.slice(s, 2000) for b in batches for s in range(0, b.num_rows, 2000)):
            words, lists = batch.column(0), batch.column(1)
            new = np.concatenate(([True], pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False))) if len(words) > 1 else np.ones(1, bool)
            at = np.repeat(np.cumsum(new) - 1, lists.value_lengths().to_numpy())
            value = lists.flatten().to_numpy()
            own = words.take(pa.array(np.flatnonzero(new)))
            counts = np.bincount(at * 2 * kinds + value % (2 * kinds), value // (2 * kinds), len(own) * 2 * kinds).reshape(len(own), -1)
            if word is not None:
                if own[0].as_py() == word:
                    counts[0] += held
                else:
                    yield rows(pa.array([word], pa.binary()), held[None])
            yield rows(own[:-1], counts[:-1])
            word, held = own[-1].as_py(), counts[-1]
        if word is not None:
            yield rows(pa.array([word], pa.binary()), held[None])

    return near.repartition("word").sortWithinPartitions("word").mapInArrow(run, "word binary, n long, cls int")


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(bigrams: np.ndarray, n_words: int, n_classes: int, rounds: int) -> np.ndarray:
    """Class of each unit. Words (the first ``n_words`` units) move; every later unit keeps a class of its own."""
    units = len(bigrams)
    n_classes = min(n_classes, n_words)
    of = np.concatenate([np.arange(n_words) % max(1, n_classes), n_classes + np.arange(units - n_words)])
    total = n_classes + units - n_words
    member = np.zeros((units, total))
    member[np.arange(units), of] = 1
    after, before = bigrams @ member, bigrams.T @ member  # by word and class
    between = member.T @ after
    for _ in range(rounds):
        moved = 0
        for w in range(n_words):
            old, self_n = of[w], bigrams[w, w]
            right, left = after[w].copy(), before[w].copy()
            right[old] -= self_n
            left[old] -= self_n
            # Take the word out of its class; right and left now count its neighbours but itself.
            between[old] -= right
            between[:, old] -= left
            between[old, old] -= self_n
            rows, columns, ends = between[:n_classes], between[:, :n_classes].T, np.arange(n_classes)
            gain = (_xlogx(rows + right) - _xlogx(rows)).sum(1) + (_xlogx(columns + left) - _xlogx(columns)).sum(1)
            corner = between[ends, ends]
            gain += _xlogx(corner + right[ends] + left[ends] + self_n) - _xlogx(corner + right[ends]) - _xlogx(corner + left[ends]) + _xlogx(corner)
            out_n, in_n = rows.sum(1), columns.sum(1)
            gain -= _xlogx(out_n + right.sum() + self_n) - _xlogx(out_n) + _xlogx(in_n + left.sum() + self_n) - _xlogx(in_n)
            new = int(gain.argmax())
            if gain[new] <= gain[old] + 1e-9:
                new = int(old)
            between[new] += right
            between[:, new] += left
            between[new, new] += self_n
            if new != old:
                moved += 1
                of[w] = new
                after[:, old] -= bigrams[:, w]
                after[:, new] += bigrams[:, w]
                before[:, old] -= bigrams[w]
                before[:, new] += bigrams[w]
        if not moved:
            break
    return of


def transitions(bigrams: np.ndarray, of: np.ndarray, pull: float) -> np.ndarray:
    """log10 of the probability of a class after a class."""
    total = of.max() + 1
    member = np.zeros((len(of), total))
    member[np.arange(len(of)), of] = 1
    between = member.T @ bigrams @ member
    alone = (between.sum(0) + 1) / (between.sum() + total)
    return np.log10((between + pull * alone) / (between.sum(1, keepdims=True) + pull))


@dataclass
class Model:
    """What is learned: the dictionary (words, counts, classes), all other words as a table, and statistics of classes."""

    words: list[bytes]
    counts: np.ndarray
    of: np.ndarray
    placed: DataFrame  # word, n, cls of words beyond the dictionary
    class_n: np.ndarray  # tokens by class
    class_v: np.ndarray  # words by class
    endings: np.ndarray  # class by cell of endings
    total_n: int
    total_v: int
    end_n: int

    def emission(self, n: np.ndarray, of: np.ndarray) -> np.ndarray:
        """log10 of the probability of a word with ``n`` training tokens (0: one never seen) in its class."""
        spare = np.maximum(0.5 * self.class_v / (self.class_v + 1), 0.25)
        return np.log10(np.where(n > 0, n - 0.5, spare[of]) / np.maximum(self.class_n[of], 1))

    def base(self, n: np.ndarray) -> np.ndarray:
        return np.log10((n + 1) / float(self.total_n + self.total_v + 1))


def ending(word: Column) -> Column:
    return (F.crc32(F.substring(word, -2, 2)) % ENDINGS).cast("int")


def learn(training: DataFrame, n_words: int, n_classes: int, rounds: int, pull: float, n_lookup: int) -> Model:
    """Counts and classes of the words of ``training`` (text)."""
    vocabulary = durable(count_words(training))
    total_n, total_v = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # A histogram of counts by powers of two shows from where on there are enough words, so that each task sends few.
    words = vocabulary.filter(F.col("word") != F.lit(END))
    enough, seen = 0, 0
    for power, held_n in words.groupBy(F.floor(F.log2("n")).alias("power")).count().orderBy(F.desc("power")).collect():
        enough, seen = power, seen + held_n
        if seen >= max(n_words, n_lookup):
            break
    top = words.filter(F.col("n") >= 2**enough).orderBy(F.desc("n"), "word").limit(max(n_words, n_lookup)).toArrow()
    lookup, counts = top["word"].to_pylist(), top["n"].to_numpy().astype(float)
    end_n = (vocabulary.filter(F.col("word") == F.lit(END)).first() or (0, 0))[1]
    frequent = lookup[:n_words]
    bigrams = count_bigrams(training, frequent)
    of = exchange(bigrams, len(frequent), n_classes, rounds)
    classes = max(1, int(of[len(frequent)]))
    class_n = np.bincount(of[: len(frequent)], counts[: len(frequent)], minlength=classes)[:classes]
    placed = durable(place(neighbours(training, lookup, of), transitions(bigrams, of, pull), class_n))
    # The dictionary's classes come back to the driver, bounded by n_lookup.
    known = dict(zip(lookup, of[: len(frequent)].tolist(), strict=False))
    if len(lookup) > len(frequent):
        # By the words themselves: as many as one likes may share the last one's count.
        wanted = placed.sparkSession.createDataFrame(top.select(["word"]))
        mine = placed.join(F.broadcast(wanted), "word", "left_semi").select("word", "cls").toArrow()
        known |= dict(zip(mine["word"].to_pylist(), mine["cls"].to_pylist(), strict=True))
    class_v = np.bincount(of[: len(frequent)], minlength=classes)[:classes].astype(float)
    for c, n, v in placed.groupBy("cls").agg(F.sum("n"), F.count("*")).collect():
        class_n[c] += n
        class_v[c] += v
    endings = np.full(ENDINGS, int(class_v.argmax()), np.int64)
    usual = placed.groupBy(ending(F.col("word")).alias("cell"), "cls").count().groupBy("cell").agg(F.max_by("cls", F.struct("count", -F.col("cls"))))
    for cell, c in usual.collect():
        endings[cell] = c
    return Model(lookup, counts, np.array([known[w] for w in lookup], np.int64), placed, class_n, class_v, endings, int(total_n), int(total_v), int(end_n))


def class_sequences(docs: DataFrame, model: Model) -> DataFrame:
    """Of ``docs`` (doc_id, text, train): these but the text, n_tokens, n_known, base, emit (sums over tokens) and kinds, one byte for each token's class."""
    classes, spark = len(model.class_n), docs.sparkSession
    ends = np.array([0.0])
    table = (
        {w: i for i, w in enumerate(model.words)},
        np.concatenate((model.of, [classes, OPEN])).astype(np.uint8),
        np.concatenate((np.ones(len(model.words), np.int64), [int(model.end_n > 0), 0])),
        np.concatenate((model.base(model.counts), model.base(np.array([float(model.end_n)])), ends)),
        np.concatenate((model.emission(model.counts, model.of), ends, ends)),
    )
    held = spark.sparkContext.broadcast(table)
    rare_type = pa.list_(pa.struct([("pos", pa.int32()), ("word", pa.binary())]))

    def look_up(batches):
        known, of, is_known, base, emit = held.value
        get, end = known.get, len(known)
        for batch in (b.slice(s, 500) for b in batches for s in range(0, b.num_rows, 500)):
            units, sizes, rare, places, rare_sizes = [], [], [], [], []
            for value in batch.column(3).cast(pa.binary()).to_pylist():
                own = tokens(value)
                unit = np.array([get(w, end + 1) for w in own] + [end], np.int32)
                at = np.flatnonzero(unit > end)
                rare += [own[i] for i in at]
                units.append(unit)
                sizes.append(len(unit))
                places.append(at)
                rare_sizes.append(len(at))
            unit = np.concatenate(units)
            begin = np.concatenate(([0], np.cumsum(sizes)))
            kinds = of[unit]
            split = pa.array(np.concatenate(([0], np.cumsum(rare_sizes))), pa.int32())
            pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(places), pa.int32()), pa.array(rare, pa.binary())], names=["pos", "word"])
            yield pa.RecordBatch.from_arrays([
                *batch.columns[:3],
                pa.array(sizes, pa.int64()),
                *(pa.array(np.add.reduceat(x[unit], begin[:-1])) for x in (is_known, base, emit)),
                pa.array([kinds[s:e].tobytes() for s, e in zip(begin[:-1], begin[1:], strict=True)], pa.binary()),
                pa.ListArray.from_arrays(split, pairs).cast(rare_type),
            ], names=["row", "doc_id", "train", "n_tokens", "n_known", "base", "emit", "kinds", "rare"])

    columns = "row long, doc_id long, train boolean, n_tokens long, n_known long, base double, emit double, kinds binary"
    # Row numbers are fixed by the table written here; all joins read them from it.
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "train", "text")
    parts = durable(numbered.mapInArrow(look_up, f"{columns}, rare array<struct<pos: int, word: binary>>"))
    rare = parts.select("row", F.explode("rare").alias("r")).select("row", "r.pos", "r.word")
    # A word never seen has n 0 and its ending in place of a class.
    found = rare.join(model.placed, "word", "left").select("row", F.struct("pos", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("cls", ending(F.col("word"))).alias("cls")).alias("r"))
    whole = parts.drop("rare").join(found.groupBy("row").agg(F.collect_list("r").alias("rare")), "row", "left").select(*parts.columns)

    def fill(batches):
        for batch in (b.slice(s, 500) for b in batches for s in range(0, b.num_rows, 500)):
            sizes = batch.column(3).to_numpy()
            kinds = np.frombuffer(b"".join(batch.column(7).to_pylist()), np.uint8).copy()
            lists = batch.column(8)
            at = np.repeat(np.arange(batch.num_rows), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            pos, n, of = (c.to_numpy(zero_copy_only=False) for c in lists.flatten().flatten())
            of = np.where(n > 0, of, model_endings[of])
            order = np.lexsort((pos, at))  # sums do not depend on the order of the lists
            at, pos, n, of = at[order], pos[order], n[order], of[order]
            kinds[(np.cumsum(sizes) - sizes)[at] + pos] = of
            add = [np.bincount(at, x, batch.num_rows) for x in (n > 0, model_base(n), model_emission(n, of))]
            begin = np.concatenate(([0], np.cumsum(sizes)))
            yield pa.RecordBatch.from_arrays([
                *batch.columns[:4],
                pa.array(batch.column(4).to_numpy() + add[0].astype(np.int64)),
                *(pa.array(batch.column(c).to_numpy() + add[c - 4]) for c in (5, 6)),
                pa.array([kinds[s:e].tobytes() for s, e in zip(begin[:-1], begin[1:], strict=True)], pa.binary()),
            ], names=["row", "doc_id", "train", "n_tokens", "n_known", "base", "emit", "kinds"])

    small = Model([], model.counts[:0], model.of[:0], None, model.class_n, model.class_v, model.endings, model.total_n, model.total_v, model.end_n)
    model_endings, model_base, model_emission = small.endings, small.base, small.emission
    return whole.mapInArrow(fill, columns)


def score(docs: DataFrame, training: Column, *, n_words: int = 1000, n_classes: int = 64, rounds: int = 4, pull: float = 20.0, n_lookup: int = 200_000) -> DataFrame:
    """Of ``docs`` (doc_id, text), learning from its rows where ``training`` holds: doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    ``n_classes`` is at most 250, so that a class takes a byte.
    """
    if n_classes > 250:
        raise ValueError("n_classes is at most 250")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(training, F.lit(False)).alias("train"), "text")
    model = learn(docs.filter("train").select("text"), n_words, n_classes, rounds, pull, n_lookup)
    size = len(model.class_n) + 1
    sequences = durable(class_sequences(docs, model))

    def pairs_of(batch):
        """Class pairs of all texts, and where each text's pairs start; a text starts after an end."""
        kinds = np.frombuffer(b"".join(batch.column("kinds").to_pylist()), np.uint8).astype(np.int64)
        # Each text ends in an end, so the last text's end is what the next one starts after.
        return np.concatenate(([size - 1], kinds[:-1]))[: len(kinds)] * size + kinds

    def count(batches):
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            total += np.bincount(pairs_of(batch), minlength=size * size)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["pair", "n"])

    trans = transitions(_matrix(sequences.filter("train").select("kinds").mapInArrow(count, "pair long, n long"), size), np.arange(size), pull).ravel()

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                sizes = batch.column("n_tokens").to_numpy()
                full = np.add.reduceat(trans[pairs_of(batch)], np.cumsum(sizes) - sizes) + batch.column("emit").to_numpy()
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(full)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    scored = sequences.select("doc_id", "n_tokens", "n_known", F.col("base").alias("base_score"), "emit", "kinds").mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(model.total_n).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def score_documents(documents: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity; the fold with remainder 2 of 7 is never learned from."""
    out = score(documents.select("doc_id", "text"), fold(F.col("doc_id").cast("long"), 7) != 2, **options)
    return out.select("doc_id", (fold(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
