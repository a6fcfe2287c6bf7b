"""Near-duplicate classes by Order MinHash and banded alignment.

Shingles are ``SHINGLE`` successive words, numbered by occurrence. Each of ``TABLES`` hash
functions samples the ``PICK`` least shingles of a document and hashes them in the order in
which they stand in the text, which is sensitive to edits and not only to the sets
(Marcais et al., 2019). Documents that agree in a table share a bucket. Short documents
have tables of their own with fewer picks; the two ranges of lengths overlap by so much
that no pair at the threshold falls between them.

Two documents are near copies if 1 - L / (a + b - L) is at most 1 - ``threshold``, where a
and b count shingles and L is the length of their longest common subsequence of shingles:
the ordered form of the Jaccard similarity. It is computed by bit-parallel alignment inside
the band that the threshold allows. Shingles are compared by 32-bit hashes there.

Classes are connected components of near copies, so within a group it is enough to find
links that join components. Exact copies are first reduced to one representative. Then every
document proposes, in each of its buckets, its likeliest partner in another component by
one-permutation codes; proposals are verified and components joined. A last round verifies
all pairs left in a bucket that lie in different components and whose codes do not rule out
the threshold by more than ``SURE`` standard deviations. Buckets over ``block`` members are dealt
over pairs of blocks, so the last round still meets every pair of different components, and
no task holds more than about two blocks of a bucket.

Null texts are never copies of anything. Texts without a word are copies only of equal texts.
Texts of fewer than ``SHINGLE`` words are one shingle. Rows that repeat an id are copies of
each other; the class is named by its least id. Result: one row per row of the input.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import _WORD_BYTES, durable, fresh

SHINGLE = 5
TABLES, PICK = 40, 5
SHORT_TABLES, SHORT_PICK = 24, 2
#: Documents of at most SHORT_MOST shingles use the short tables, of at least LONG_LEAST the long ones. LONG_LEAST / 0.8 < SHORT_MOST.
SHORT_MOST, LONG_LEAST = 32, 24
CODES = 256
#: Standard deviations by which codes must miss the threshold to rule a pair out.
SURE = 3.5
#: Ids above this number are found by a join with shuffle and not by a broadcast.
BROADCAST_IDS = 2_000_000

_BASE = np.uint64(0x100000001B3)
_BASE_INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))
_r = np.random.default_rng(20240607)
_FACTORS = _r.integers(1, 1 << 63, TABLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def shingles(text: bytes | None) -> np.ndarray:
    """Hashes of the text's shingles in order: words are hashed as polynomials over the bytes, all at once."""
    if not text:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(text.translate(_WORD_BYTES), np.uint8)
    inside = np.concatenate(([False], raw != 32, [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(raw) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)))
    word = _mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    n = max(1, len(word) - SHINGLE + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(SHINGLE, len(word))):
        out = out * np.uint64(0x9E3779B97F4A7C15) + word[i : i + n]
    return _mix(out)


def labelled(s: np.ndarray) -> np.ndarray:
    """Shingles made different by their occurrence number."""
    order = np.argsort(s, kind="stable")
    run = s[order]
    first = np.concatenate(([True], run[1:] != run[:-1]))
    if first.all():
        return s
    at = np.arange(len(s))
    number = np.empty(len(s), np.uint64)
    number[order] = (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64)
    return np.where(number > 0, _mix(s + number * np.uint64(0x9E3779B97F4A7C15)), s)


def bucket_keys(x: np.ndarray) -> np.ndarray:
    """One key per table: the picked shingles, hashed in text order."""
    out = []
    n = len(x)
    for tables, pick, family, wanted in ((SHORT_TABLES, SHORT_PICK, 1, 0 < n <= SHORT_MOST), (TABLES, PICK, 2, n >= LONG_LEAST)):
        if not wanted:
            continue
        for s in range(0, tables, step := max(1, min(tables, 400_000 // n))):
            values = x[None, :] * _FACTORS[s : min(s + step, tables), None]
            values ^= values >> np.uint64(32)
            values *= np.uint64(0xD6E8FEB86659FD93)
            least = np.sort(np.argpartition(values, pick - 1, axis=1)[:, :pick], axis=1) if n > pick else np.broadcast_to(np.arange(n), (len(values), n))
            key = np.full(len(values), family, np.uint64) + np.arange(s, s + len(values), dtype=np.uint64) * np.uint64(4)
            for i in range(least.shape[1]):
                key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + x[least[:, i]])
            out.append(key)
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def fragments(keys: np.ndarray, n: int) -> bytes:
    """32 bits of each table's key in a fixed place, 0 where a table is not used."""
    out = np.zeros(SHORT_TABLES + TABLES, np.uint32)
    short = SHORT_TABLES if 0 < n <= SHORT_MOST else 0
    out[:short] = keys[:short].view(np.uint64).astype(np.uint32)
    if n >= LONG_LEAST:
        out[SHORT_TABLES:] = keys[short:].view(np.uint64).astype(np.uint32)
    return out.tobytes()


def codes(x: np.ndarray) -> bytes:
    """One byte for each bin of hash values: of the bin's least value, 0 if the bin is empty."""
    out = np.zeros(CODES, np.uint8)
    v = np.sort(_mix(x ^ np.uint64(0xA0761D6478BD642F)))
    bins = (v >> np.uint64(56)).astype(np.int64)
    first = np.concatenate(([True], bins[1:] != bins[:-1])) if len(v) else np.zeros(0, bool)
    out[bins[first]] = (v[first] >> np.uint64(8)).astype(np.uint64) % np.uint64(255) + np.uint64(1)
    return out.tobytes()


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, text hash, number of shingles, keys, codes for every row with a text, in one pass without a shuffle."""

    def run(batches):
        for batch in (b.slice(s, 1000) for b in batches for s in range(0, b.num_rows, 1000)):
            values = batch.column(1).cast(pa.binary()).to_pylist()
            digests, sizes, keys, code, frags = [], [], [], [], []
            for v in values:
                x = labelled(shingles(v))
                digests.append(hashlib.md5(v).digest())
                sizes.append(len(x))
                keys.append(bucket_keys(x))
                code.append(codes(x))
                frags.append(fragments(keys[-1], len(x)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(code, pa.binary()), pa.array(frags, pa.binary())], names=["id", "digest", "n", "keys", "code", "frags"])

    return docs.filter("text is not null").select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(run, "id long, digest binary, n int, keys array<long>, code binary, frags binary")


def _possible(a: np.ndarray, b: np.ndarray, total: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated similarity by row, and whether it may reach the threshold.

    The bins that either has are a sample, without replacement, of the shingles that
    either has; those are ``total`` / (1 + threshold) at the threshold. So the variance has a
    finite-population factor: codes of short documents are nearly a full count.
    """
    either = np.maximum(((a != 0) | (b != 0)).sum(-1), 1)
    estimate = ((a == b) & (a != 0)).sum(-1) / either
    rest = np.clip(1 - either * (1 + threshold) / np.maximum(total, 1), 0, 1)
    return estimate, estimate >= threshold - SURE * np.sqrt(threshold * (1 - threshold) / either * rest + 1e-4)


def pairs_in_buckets(rows: DataFrame, threshold: float, exhaustive: bool) -> DataFrame:
    """Candidate pairs (a < b) of different components from (bucket, part, id, n, code, comp, and frags if exhaustive).

    Proposals: for each member its likeliest partner. Exhaustive: all that are possible,
    each in the first of the tables that put both into one bucket.
    A bucket's part is bounded by the block size; rows arrive sorted by it.
    """

    def here(a, b, bucket):
        same = (a == b) & (a != 0)
        return a[np.arange(len(a)), same.argmax(1)] == np.asarray(bucket).astype(np.int64).view(np.uint64).astype(np.uint32)

    def group(ids, n, code, comp, frag, bucket):
        size = len(ids)
        for s in range(0, size, step := max(1, 4_000_000 // (size * CODES // 16 + 1))):
            e = min(size, s + step)
            short, long = np.minimum(n[s:e, None], n[None]), np.maximum(n[s:e, None], n[None])
            ok = (comp[s:e, None] != comp[None]) & (short >= threshold * long - 1e-9)
            i, j = np.nonzero(ok)
            for p in range(0, len(i), 10_000):
                x, y = i[p : p + 10_000] + s, j[p : p + 10_000]
                estimate, possible = _possible(code[x], code[y], n[x] + n[y], threshold)
                if exhaustive:
                    at = np.flatnonzero(possible & (x < y))
                    possible = np.zeros(len(x), bool)
                    possible[at] = here(frag[x[at]], frag[y[at]], np.full(len(at), bucket))
                yield x[possible], y[possible], estimate[possible]

    def run(batches):
        held: list[pa.RecordBatch] = []
        out_a, out_b = [], []

        def flush(table: pa.Table):
            bucket, part = table["bucket"].to_numpy(), table["part"].to_numpy()
            ids, n, comp = table["id"].to_numpy(), table["n"].to_numpy().astype(np.int64), table["comp"].to_numpy()
            code = np.frombuffer(b"".join(table["code"].to_pylist()), np.uint8).reshape(-1, CODES)
            frag = np.frombuffer(b"".join(table["frags"].to_pylist()), np.uint32).reshape(len(ids), -1) if exhaustive else None
            start = np.flatnonzero(np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1]))))
            size = np.diff(np.append(start, len(ids)))
            twos = start[size == 2]
            x, y = twos, twos + 1
            keep = (comp[x] != comp[y]) & (np.minimum(n[x], n[y]) >= threshold * np.maximum(n[x], n[y]) - 1e-9)
            x, y = x[keep], y[keep]
            _, possible = _possible(code[x], code[y], n[x] + n[y], threshold)
            if exhaustive:
                possible &= here(frag[x], frag[y], bucket[x])
            out_a.append(ids[x[possible]])
            out_b.append(ids[y[possible]])
            for s, k in zip(start[size > 2], size[size > 2], strict=True):
                found = list(group(ids[s : s + k], n[s : s + k], code[s : s + k], comp[s : s + k], frag[s : s + k] if exhaustive else None, bucket[s]))
                if not found:
                    continue
                x, y, estimate = (np.concatenate(c) for c in zip(*found, strict=True))
                if not exhaustive:
                    order = np.lexsort((ids[s + y], -estimate, x))
                    best = order[np.concatenate(([True], x[order][1:] != x[order][:-1]))] if len(order) else order
                    x, y = x[best], y[best]
                out_a.append(ids[s + x])
                out_b.append(ids[s + y])

        def emit():
            a, b = np.concatenate(out_a or [np.zeros(0, np.int64)]), np.concatenate(out_b or [np.zeros(0, np.int64)])
            out_a.clear()
            out_b.clear()
            pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            bucket, part = table["bucket"].to_numpy(), table["part"].to_numpy()
            last = np.flatnonzero((bucket != bucket[-1]) | (part != part[-1]))
            if len(last):
                cut = int(last[-1]) + 1
                flush(table.slice(0, cut))
                held = table.slice(cut).to_batches()
                yield emit()
        if held:
            flush(pa.Table.from_batches(held))
        yield emit()

    dealt = rows.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "id")
    return dealt.mapInArrow(run, "a long, b long").filter("a < b").distinct()


def common_subsequence(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence whose pairs are at most ``band`` places apart; bit-parallel over ``a``."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(differ[0]) if len(differ) else n
    x, y = a[: len(a) - tail].tolist(), b[: len(b) - tail].tolist()
    if not x or not y:
        return head + tail
    places: dict[int, int] = {}
    for i, v in enumerate(x):
        places[v] = places.get(v, 0) | (1 << i)
    full = (1 << len(x)) - 1
    window = (1 << (2 * band + 1)) - 1
    row = full
    for j, v in enumerate(y):
        m = places.get(v)
        if m is None:
            continue
        m &= window << (j - band) if j > band else window >> (band - j)
        u = row & m
        row = ((row + u) | (row - u)) & full
    return head + tail + len(x) - row.bit_count()


def similar(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether the ordered similarity of two shingle sequences reaches the threshold."""
    total = len(a) + len(b)
    need = threshold * total / (1 + threshold) - 1e-9
    if min(len(a), len(b)) < need:
        return False
    # Common shingles with their numbers bound the common subsequence.
    one, many = np.unique(a, return_counts=True)
    two, more = np.unique(b, return_counts=True)
    _, p, q = np.intersect1d(one, two, assume_unique=True, return_indices=True)
    if np.minimum(many[p], more[q]).sum() < need:
        return False
    return common_subsequence(a, b, int(total - 2 * need) + 1) >= need


def _only(df: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """Rows of ``df`` whose id is in ``ids``; the ids are broadcast only up to a size that was counted."""
    return df.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, "id", "left_semi")


def shingle_table(docs: DataFrame, reps: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """id and shingle sequence (32-bit hashes as bytes) of the representatives among ``ids``, each once."""

    def run(batches):
        for batch in batches:
            values = batch.column(1).cast(pa.binary()).to_pylist()
            for s in range(0, len(values), 500):
                part = values[s : s + 500]
                packed = [(shingles(v) >> np.uint64(32)).astype(np.uint32).tobytes() for v in part]
                yield pa.RecordBatch.from_arrays([batch.column(0)[s : s + 500], pa.array([hashlib.md5(v).digest() for v in part], pa.binary()), pa.array(packed, pa.binary())], names=["id", "digest", "s"])

    texts = _only(docs.filter("text is not null").select(F.col("doc_id").alias("id"), "text"), ids, n)
    table = durable(texts.mapInArrow(run, "id long, digest binary, s binary"))
    if table.count() > n:  # rows that repeat an id
        table = durable(table.join(reps, ["id", "digest"], "left_semi").dropDuplicates(["id"]))
    return table.select("id", "s")


def verify(pairs: DataFrame, table: DataFrame, threshold: float) -> DataFrame:
    """The pairs that are near copies. Each pair meets its two shingle sequences by joins on the ids."""
    n = pairs.count()
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    few = _only(table, ids, 2 * n)

    def run(batches):
        for batch in (b.slice(s, 1000) for b in batches for s in range(0, b.num_rows, 1000)):
            keep = [similar(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), threshold) for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = pairs.join(few.withColumnsRenamed({"id": "a", "s": "x"}), "a")
    both = one.join(few.withColumnsRenamed({"id": "b", "s": "y"}), "b").select("a", "b", "x", "y")
    return both.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """id and comp, the least id of its component, of every id in ``edges`` (a, b).

    Large-star and small-star steps in turn (Kiveris et al., 2014): each step hangs
    neighbours on a lesser one until all hang on the least. Tables are written in as
    many parts as their edges need.
    """
    now = durable(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    parts = max(6, now.count() // 500_000)
    if now.isEmpty():
        return edges.sparkSession.createDataFrame([], "id long, comp long")
    total = None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("w"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("w").alias("v")).distinct()
        down = durable(large.coalesce(parts))
        small = down.join(down.groupBy("u").agg(F.min("v").alias("w")), "u")
        stars = small.filter("v <> w").select(F.col("v").alias("u"), F.col("w").alias("v")).union(small.select("u", F.col("w").alias("v"))).filter("u <> v").distinct()
        now = durable(stars.coalesce(parts))
        # Done when a step changes nothing: the sums stay.
        state = now.agg(F.count("*"), F.sum("v"), F.sum("u")).first()
        if state == total:
            break
        total = state
    hung = now.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("id"), "comp")
    return durable(hung.union(hung.select(F.col("comp").alias("id"), "comp").distinct()).coalesce(parts))


def joined_components(comps: DataFrame | None, found: DataFrame) -> DataFrame:
    """Components after more links: only the links between components are worked on."""
    if comps is None:
        return components(found)
    of = lambda c: comps.select(F.col("id").alias(c), F.col("comp").alias(f"{c}_comp"))
    between = found.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b"))
    more = components(between)
    moved = comps.join(more.select(F.col("comp").alias("to"), F.col("id").alias("comp")), "comp", "left").select("id", F.coalesce("to", "comp").alias("comp"))
    return durable(moved.union(more.join(moved.select("id"), "id", "left_anti")))


def group_of(size: Column, block: int) -> Column:
    """A number below the blocks that ``size`` members fill, by the id's hash."""
    return F.pmod(F.xxhash64("id"), F.ceil(size / block).cast("long"))


def dealt(large: DataFrame, block: int) -> DataFrame:
    """Members of large buckets with a ``part`` for each meeting, so that all pairs of different components meet in parts of about two blocks.

    Those of the bucket's largest component (insiders) never meet one another. Few others (outsiders) go to all blocks of
    insiders. Where they are more than a block, each block of them meets each block of insiders and of outsiders once.
    """
    by = large.groupBy("bucket", "comp").agg(F.count("*").alias("k")).groupBy("bucket").agg(F.max_by("comp", F.struct("k", "comp")).alias("largest"), F.max("k").alias("n_in"), F.sum("k").alias("n_all"))
    placed = large.join(by, "bucket")
    inside, n_out = F.col("comp") == F.col("largest"), F.col("n_all") - F.col("n_in")
    ins, outs = F.ceil(F.col("n_in") / block).cast("long"), F.ceil(n_out / block).cast("long")
    mine = F.when(inside, group_of(F.col("n_in"), block)).otherwise(group_of(F.greatest(n_out, F.lit(1)), block))
    placed = placed.withColumns({"ins": ins, "outs": outs, "mine": mine})
    # Meetings with insiders are numbered by (outsiders' block, insiders' block), those of outsiders come after them.
    with_out = F.when(F.col("outs") > 0, F.expr("transform(sequence(0L, outs - 1), o -> o * ins + mine)")).otherwise(F.expr("array(mine)"))
    with_in = F.expr("transform(sequence(0L, ins - 1), i -> mine * ins + i)")
    among = F.expr("transform(sequence(0L, outs - 1), o -> outs * ins + least(o, mine) * outs + greatest(o, mine))")
    # With one block of outsiders, they meet each other wherever they meet insiders.
    parts = F.when(inside, with_out).when(F.col("outs") == 1, with_in).otherwise(F.concat(with_in, among))
    return placed.withColumn("part", F.explode(parts)).drop("largest", "n_in", "n_all", "ins", "outs", "mine")


def classes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8, rounds: int = 2, block: int = 2048) -> DataFrame:
    """doc_id, class_id and copy_of (the first document with the same text), one row per row of ``docs``."""
    given = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    sketched = durable(sketch(given))
    copies = durable(sketched.groupBy("digest").agg(F.min("id").alias("rep")))
    # An id that stands for several texts is compared by the one with the least digest.
    reps = copies.groupBy(F.col("rep").alias("id")).agg(F.min("digest").alias("digest"))
    distinct = durable(sketched.filter("n > 0").join(reps, ["id", "digest"], "left_semi").dropDuplicates(["id"]))
    rows = distinct.select(F.explode("keys").alias("bucket"), "id")
    shared = rows.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    kept = durable(rows.join(shared, "bucket"))
    ids = durable(kept.select("id").distinct())
    n_ids = ids.count()
    about = durable(_only(distinct.select("id", "n", "code", "frags"), ids, n_ids))
    table = shingle_table(given, reps, ids, n_ids)
    tested, comps = None, None
    for number in range(rounds + 1):
        last = number == rounds
        state = about.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id")) if comps is not None else about.withColumn("comp", F.col("id"))
        members = kept.join(state, "id")
        if last:
            large = dealt(members.filter(F.col("size") > block), block)
            members = members.filter(F.col("size") <= block).withColumn("part", F.lit(0).cast("long")).unionByName(large)
        else:
            members = members.withColumn("part", group_of(F.col("size"), block))
        pairs = pairs_in_buckets(members.select("bucket", "part", "id", "n", "code", "comp", *(["frags"] if last else [])), threshold, last)
        pairs = durable(pairs.join(tested, ["a", "b"], "left_anti") if tested is not None else pairs)
        found = durable(verify(pairs, table, threshold))
        tested = pairs if tested is None else tested.union(pairs)
        comps = joined_components(comps, found)
    out = sketched.select("id", "digest").join(copies, "digest").withColumnRenamed("rep", "copy_of").join(comps.withColumnRenamed("id", "copy_of"), "copy_of", "left")
    alone = given.filter("text is null").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_of"))
    return out.select(F.col("id").alias("doc_id"), F.coalesce("comp", "copy_of").alias("class_id"), "copy_of").union(alone)


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each class: that with the class's id, or of rows that repeat it the first text. Same columns as ``docs``, whatever their names; rows with a null id stay."""
    keep = fresh(docs, "keep")
    again, times = fresh(docs, "again"), fresh(docs, "times")
    found = classes(docs, doc_id=doc_id, text=text, **options).filter("doc_id = class_id").select(F.col("doc_id").alias(keep)).distinct()
    key = F.col(f"`{doc_id}`")
    kept = docs.join(found, key.cast("long") == F.col(keep), "left_semi")
    more = kept.groupBy(key.alias(again)).agg(F.count("*").alias(times)).filter(F.col(times) > 1)
    repeated = kept.join(more, key == F.col(again), "left_semi")
    single = kept.join(more, key == F.col(again), "left_anti")
    return single.unionByName(repeated.dropDuplicates([doc_id])).unionByName(docs.filter(key.isNull()))
