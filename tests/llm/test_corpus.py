"""Fingerprints, personal data, near copies, language model and pipeline against plain versions."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import brown, fingerprint, neardup, pii
from gridloom.llm.common import durable, tokens


def docs_of(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_edited_texts_and_order(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = docs_of(spark, [None, "", "héllo wörld ünd", "x" * 5000, "a " * 3000], 90_000)
    every = docs.unionByName(odd)
    out = {r.doc_id: r for r in fingerprint.compare_with_edits(every.repartition(5)).collect()}
    texts = {r.doc_id: r.text or "" for r in every.collect()}
    ids = sorted(texts)
    assert sorted(out) == ids
    near = []
    for i, nxt in zip(ids, ids[1:] + ids[:1], strict=True):
        t, k = texts[i], len(texts[i]) // 4
        edited = t[: len(t) - k] + texts[nxt][:k]
        r = out[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_next <= 1 and (r.fingerprint == r.edited_fingerprint) >= (t == edited)
        if len(t) > 400:
            near.append((r.near_edited, r.near_next))
        if t == texts[nxt]:
            assert r.near_next == 1
    assert np.mean([a for a, _ in near]) > 0.5 and np.mean([b for _, b in near]) < 0.2
    assert np.mean([a > b for a, b in near]) > 0.95


def test_fingerprint_follows_order_and_repeats(spark):
    base = " ".join(f"w{i}" for i in range(300))
    turned = " ".join(f"w{i}" for i in [*range(150, 300), *range(150)])
    twice = f"{base} {base}"
    rows = docs_of(spark, [base, base, turned, twice, None, ""])
    sig = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(rows).collect()}
    assert sig[0] == sig[1] and sig[4] == sig[5] == "" and len({sig[0], sig[2], sig[3]}) == 3
    assert fingerprint.fingerprints(rows.limit(0)).count() == 0
    one = fingerprint.compare_with_edits(docs_of(spark, ["one two three four five six seven eight"])).collect()
    assert len(one) == 1 and one[0].near_next == 1


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def base_text(t):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind != "ip" or all(int(x) < 256 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


ODD = [
    None, "", "a@b.co_x@y.de", "x@y", "mail é.ü@ex.com, b+c@d-e.f.g!", "1.2.3.4.5.6.7.8", "300.1.1.1 007.008.009.010", "4111 1111 1111 1111", "4111-1111-1111-1111 5", "4111  1111 1111 1111", "0" * 16, "0" * 25, "+1 (743) 555-3824", "+1 ( 2", "+12345678901234567",
    "call +49 30 1234567. or +44(20)7946-0958", "9" * 5000 + "@", "a" * 20000, "1." * 4000, "🙂 x@y.zz 🙂 10.0.0.1", "4000 0000 0000 0000 02 and 4111111111111111", "a@b.c@d.e",
]


def test_base_spans_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(docs_of(spark, ODD, 90_000))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.find_personal_data(docs).collect():
        want = base_text(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (texts[r.doc_id] or "")[:80]
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))
        assert r.n_email == want.count("email:") and r.n_card == want.count("card:")


def test_redaction(spark):
    out = pii.redact(docs_of(spark, ["write to a@b.com or +1 (743) 555-3824 now", None, "clean"]).withColumn("_pii_spans", F.lit(1)), pii.Detector()).orderBy("doc_id")
    assert [r.text for r in out.collect()] == ["write to [EMAIL] or [PHONE] now", None, "clean"] and "_pii_spans" in out.columns
    assert pii.redact(docs_of(spark, ["x"]).limit(0)).count() == 0


PLANTED = [
    ("write to anna (at) mail dot com please", "anna (at) mail dot com", 0), ("contact: j.smith [at] firma [dot] de", "j.smith [at] firma [dot] de", 0), ("mail k-lee @ uni.org soon", "k-lee @ uni.org", 0),
    ("host ip 10[.]20[.]30[.]40 is down", "10[.]20[.]30[.]40", 1), ("server 192 dot 168 dot 7 dot 21", "192 dot 168 dot 7 dot 21", 1),
    ("pay with visa 4111.1111.1111.1111 now", "4111.1111.1111.1111", 2), ("card 4111/1111/1111/1111", "4111/1111/1111/1111", 2), ("and 5500 / 0000 / 0000 / 0004 it was", "5500 / 0000 / 0000 / 0004", 2),
    ("tel. 0049 30 555 1234 thanks", "0049 30 555 1234", 3), ("call me on 1 743 555-3824", "1 743 555-3824", 3),
]
#: Forms that no training example has: upper case, other brackets, a bracketed sign, other dashes, other groups.
UNSEEN = [
    ("write to anna AT mail DOT com", "anna AT mail DOT com", 0), ("mail anna<at>mail.com today", "anna<at>mail.com", 0), ("see anna.smith(@)mail.com", "anna.smith(@)mail.com", 0), ("to j.lee {at} uni {dot} edu", "j.lee {at} uni {dot} edu", 0),
    ("server 10{.}20{.}30{.}40", "10{.}20{.}30{.}40", 1), ("host 10 DOT 20 DOT 30 DOT 40", "10 DOT 20 DOT 30 DOT 40", 1),
    ("card 41111111/11111111", "41111111/11111111", 2), ("visa 4111\u20131111\u20131111\u20131111", "4111\u20131111\u20131111\u20131111", 2), ("pay 411111/1111111111", "411111/1111111111", 2),
]
CLEAN = [
    "on 2024-05-17 it was", "order no. 123456789", "we met at home.Then we left", "isbn 978-3-16-148410-0", "total 1 234 567", "version 1.2.3.999", "card 4111.1111.1111.1112", "x@y x@y", "pages 1999-2004", "between 12/05/2023 and 13/06/2024",
    "he looked at us.However it was late", "he works at example.com", "it was reported at bbc.co.uk today", "find me at example.org", "look at figure.one", "we arrived at noon.It rained", "tax id 12/345/67890", "shop at store.example.net or call", "file 77/204/3311 was closed", "id 7536784127813051 and 9807915762804491", "", None,
]


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_trees_find_what_the_base_rules_do_not(spark, size):
    docs = spark.read.parquet(f"/root/testdata/{size}/documents.parquet").select("doc_id", "text")
    found = pii.Detector.fit(docs)
    assert found.model is not None and set(found.thresholds) == {0, 1, 2, 3} and all(0.5 <= v <= 1 for v in found.thresholds.values())
    planted = PLANTED + UNSEEN
    rows = docs_of(spark, [t for t, _, _ in planted] + CLEAN)
    base, spans = pii.span_names(rows)
    out = {r.doc_id: r for r in found.mark(rows).collect()}
    hits = [any((s.kind, t[s.start : s.end]) == (kind, want) for s in out[i][spans]) for i, (t, want, kind) in enumerate(planted)]
    false = [out[i] for i in range(len(planted), len(out)) if out[i][spans]]
    assert sum(hits[: len(PLANTED)]) >= 0.9 * len(PLANTED) and sum(hits[len(PLANTED) :]) >= 0.7 * len(UNSEEN) and not false, (hits, false)
    assert not any(r[base] for r in out.values())
    # In the documents themselves, which hold none of these forms, nearly nothing is added.
    sums = found.mark(docs).agg(F.sum(F.size(base)), F.sum(F.size(spans))).first()
    assert sums[0] <= sums[1] <= 1.02 * sums[0] + 1
    text = pii.redact(rows, found).filter("doc_id = 0").first().text
    assert text == "write to [EMAIL] please"


def test_positions_of_many_matches(spark):
    n = 5000
    docs = docs_of(spark, ["é a@b.cd " * n])
    start = time.time()
    out = pii.Detector().mark(docs).select(F.col(pii.span_names(docs)[0]).alias("s")).first().s
    assert [(s.start, s.end) for s in out] == [(9 * i + 2, 9 * i + 8) for i in range(n)] and time.time() - start < 30


def near_texts():
    r = np.random.default_rng(8)
    words = [f"t{i}" for i in range(5000)]
    texts = []
    for n in (60, 200, 900, 9, 14):
        base = r.choice(words, n).tolist()
        texts.append(" ".join(base))
        for edits in (0, 1, 2, max(3, n // 60), n // 4):
            copy = base[:]
            for at in r.integers(0, n, edits):
                copy[at] = str(r.choice(words))
            texts.append(" ".join(copy))
    passage = " ".join(r.choice(words, 60))
    texts += [passage + " " + " ".join(r.choice(words, 40)) for _ in range(60)]
    return texts + [None, None, "", "", "...", "one two", "one two", "One, two!", "word " * 3000, "word " * 2990]


def test_near_copies_equal_brute_force(spark):
    texts = near_texts()
    docs = docs_of(spark, texts).repartition(4)
    got = {r.doc_id: r.class_id for r in neardup.classes(docs, block=8).collect()}
    seq = {i: (neardup.shingles(t.encode()) >> np.uint64(32)).astype(np.uint32) for i, t in enumerate(texts) if t is not None}
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in seq:
        for j in seq:
            if i < j and (texts[i] == texts[j] or len(seq[i]) and len(seq[j]) and neardup.similar(seq[i], seq[j], 0.8)):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    assert got == {i: find(i) for i in range(len(texts))}
    kept = {r.doc_id for r in neardup.keep_one(docs).collect()}
    assert kept == {i for i in range(len(texts)) if find(i) == i}
    assert neardup.classes(docs.limit(0)).count() == 0


def test_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (3, "q r s t u v w x"), (3, "other words in this one here")], "doc_id long, text string")
    out = neardup.classes(docs).collect()
    assert len(out) == 5 and {r.class_id for r in out if r.doc_id < 3} == {1}
    assert neardup.keep_one(docs).count() == 2


def test_alignment_equals_dynamic_programming():
    r = np.random.default_rng(2)
    for _ in range(60):
        a, b = r.integers(0, 6, r.integers(1, 40)), r.integers(0, 6, r.integers(1, 40))
        d = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                d[i + 1, j + 1] = d[i, j] + 1 if a[i] == b[j] else max(d[i, j + 1], d[i + 1, j])
        assert neardup.common_subsequence(a, b, 50) == d[-1, -1]
        assert neardup.similar(a, b, 0.6) == (d[-1, -1] / (len(a) + len(b) - d[-1, -1]) >= 0.6 - 1e-12)


def test_base_scores_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(docs_of(spark, [None, "", "Never\x0bseen\tWORDS ÉÉ"], 90_000))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    tok = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for i, t in texts.items()}
    train = Counter()
    for i, w in tok.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            train.update(w)
            train["\n"] += 1
    n, v = sum(train.values()), len(train)
    out = brown.score_documents(docs, n_words=200, n_classes=16, n_lookup=400).toPandas().set_index("doc_id")
    assert len(out) == len(texts) and (out.train_tokens == n).all()
    for i, w in tok.items():
        r, every = out.loc[i], [*w, "\n"]
        assert r.n_tokens == len(every) and r.n_known == sum(train[x] > 0 for x in every)
        assert r.base_score == pytest.approx(sum(math.log10((train[x] + 1) / (n + v + 1)) for x in every))
    held = out[out.held_out]
    assert held.score.sum() > held.base_score.sum()


def test_every_word_has_its_likeliest_class(spark, sf):
    """Classes of words beyond the exchanged ones, and scores, against plain loops over the texts."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.substring("text", 1, 600).alias("text")).limit(120)
    docs = durable(docs.unionByName(docs_of(spark, [None, "", "never seeninanytext ² zz"], 90_000)))
    train = F.col("doc_id") % 3 > 0
    options = {"n_words": 60, "n_classes": 8, "rounds": 2, "pull": 20.0, "n_lookup": 150}
    texts = {r.doc_id: tokens((r.text or "").encode()) for r in docs.collect()}
    learned = [[*w, brown.END] for i, w in texts.items() if i % 3 > 0]
    counts = Counter(w for t in learned for w in t)
    m = brown.learn(docs.filter(train).select("text"), *options.values())
    assert m.words == sorted((w for w in counts if w != brown.END), key=lambda w: (-counts[w], w))[:150]
    of = {bytes(r.word): r.cls for r in m.placed.collect()}
    first = dict(zip(m.words[:60], m.of[:60].tolist(), strict=True))
    assert set(of) == set(counts) - set(first) - {brown.END} and all(of[w] == c for w, c in zip(m.words[60:], m.of[60:].tolist(), strict=True))
    # Transitions of the exchanged words, any other word (8) and the end (9).
    kind = {**dict.fromkeys(of, 8), **first, brown.END: 9}
    pairs = Counter((kind[a], kind[b]) for t in learned for a, b in zip([brown.END, *t], t, strict=False))
    own = [sum(counts[w] for w in first if first[w] == c) for c in range(8)]

    def chances(pairs, size):
        n = [[pairs[a, b] for b in range(size)] for a in range(size)]
        alone = [(sum(r[b] for r in n) + 1) / (sum(map(sum, n)) + size) for b in range(size)]
        return [[math.log10((n[a][b] + 20 * alone[b]) / (sum(n[a]) + 20)) for b in range(size)] for a in range(size)]

    t10 = chances(pairs, 10)
    gain = {w: [-counts[w] * math.log10(own[c] + counts[w]) for c in range(8)] for w in of}
    for t in learned:
        for a, w, b in zip([brown.END, *t], t, t[1:], strict=False):
            if w in gain:
                for c in range(8):
                    gain[w][c] += t10[kind[a]][c] + t10[c][kind[b]]
    assert all(g[of[w]] == pytest.approx(max(g), abs=1e-5) for w, g in gain.items())
    # Scores with every word in its class.
    of |= first | {brown.END: 8}
    usual = Counter((zlib.crc32(w[-2:]) % brown.ENDINGS, c) for w, c in of.items() if w not in first and w != brown.END)
    types, sums = Counter(of[w] for w in counts), Counter()
    for w, n in counts.items():
        sums[of[w]] += n
    most = max(range(8), key=lambda c: (types[c], -c))

    def guess(w):
        here = [(n, -c) for (cell, c), n in usual.items() if cell == zlib.crc32(w[-2:]) % brown.ENDINGS]
        return -max(here)[1] if here else most

    final = chances(Counter((of[a], of[b]) for t in learned for a, b in zip([brown.END, *t], t, strict=False)), 9)
    out = {r.doc_id: r.score for r in brown.score(docs, train, **options).collect()}
    for i, t in texts.items():
        want, last = 0.0, 8
        for w in [*t, brown.END]:
            c = of[w] if w in of else guess(w)
            n = counts[w] - 0.5 if w in counts else max(0.5 * types[c] / (types[c] + 1), 0.25)
            want += final[last][c] + (0 if w == brown.END else math.log10(n / sums[c]))
            last = c
        assert out[i] == pytest.approx(want)


def test_large_buckets_without_a_large_component(spark):
    """Many texts share a passage and few are copies: whatever the block size, the classes are those of a plain comparison of all pairs."""
    r = np.random.default_rng(4)
    words = lambda n: " ".join(f"w{i}" for i in r.integers(0, 5000, n))
    shared, texts = words(60), []
    for i in range(40):
        texts.append(f"{shared} {words(35)}")
        if i % 4 == 0:
            texts.append(texts[-1] + " " + words(3))
    seq = [neardup.labelled(neardup.shingles(t.encode())) for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if neardup.similar(seq[j], seq[i], 0.8) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    assert len(set(group)) == 40
    for block in (4, 16, 2048):
        got = {x.doc_id: x.class_id for x in neardup.classes(docs_of(spark, texts), block=block).collect()}
        assert [got[i] for i in range(len(texts))] == group
    rows = spark.createDataFrame([(1, i, 0 if i < 9 else i, 30) for i in range(30)], "bucket long, id long, comp long, size long")
    parts: dict = {}
    for x in neardup.dealt(rows, 4).collect():
        parts.setdefault(x.part, []).append(x.id)
    met = {(a, b) for ids in parts.values() for a in ids for b in ids if a < b}
    assert all((a, b) in met for a in range(30) for b in range(max(9, a + 1), 30)) and max(map(len, parts.values())) < 24


def test_classes_make_a_distribution():
    r = np.random.default_rng(0)
    n = r.integers(0, 9, (45, 45)).astype(float)
    of = brown.exchange(n, 20, 6, 3)
    assert of[:20].max() < 6 and (of[20:] == np.arange(6, 31)).all()
    assert (10.0 ** brown.transitions(n, of, 5.0)).sum(1) == pytest.approx(np.ones(31))

    def likelihood(of):
        m = np.zeros((45, of.max() + 1))
        m[np.arange(45), of] = 1
        b = m.T @ n @ m
        f = lambda x: (x[x > 0] * np.log(x[x > 0])).sum()
        return f(b) - f(b.sum(0)) - f(b.sum(1))

    start = np.concatenate([np.arange(20) % 6, 6 + np.arange(25)])
    assert likelihood(of) >= likelihood(start)
    assert brown.exchange(np.zeros((25, 25)), 0, 6, 2).tolist() == list(range(25))


def test_pipeline_stages(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, durable(stage(spark, docs, d))
        sizes.append(docs.count())
        ids = lambda x: {r[0] for r in x.select("doc_id").collect()}
        assert ids(docs) <= ids(before)
        if name == "near_dedup":
            assert docs.count() == docs.select("text").distinct().count()
        if name == "redact":
            assert sizes[-1] == sizes[-2] and not any(base_text(r.text) for r in docs.select("text").collect())
        if name != "mix":
            assert docs.columns == columns
    assert sizes[1] < sizes[0] and sizes[2] < sizes[1] and "mix_copies" in docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "redact", "mix"]


def test_looked_up_words_have_their_own_class_where_counts_tie(spark):
    """All words but a few stand once: the last looked-up word's count is that of thousands."""
    r = np.random.default_rng(2)
    texts = [" ".join(["the", "a", "of"][i % 3] if r.random() < 0.5 else f"w{r.integers(0, 4000)}" for _ in range(60)) for i in range(100)]
    training = docs_of(spark, texts).select("text")
    model = brown.learn(training, 20, 4, 3, 0.5, 60)
    assert len(model.words) == 60 == len(model.of)
    placed = {bytes(row.word): row.cls for row in model.placed.select("word", "cls").collect()}
    assert len(placed) > 1000 and all(c == placed[bytes(w)] for w, c in zip(model.words[20:], model.of[20:].tolist(), strict=True))
