"""License scans, hard negatives and lexical search against plain versions."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm import lexical, licenses, negatives
from gridloom.llm.common import word_pieces, words


def word_list(t):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def filled(name):
    """A template's text with every optional region taken and every replaceable one filled."""
    text = next(t.text for t in licenses.TEMPLATES if t.name == name)
    text = re.sub(r"<<(\d+)-(\d+)>>", lambda m: " ".join(["Foo"] * int(m[2])), text)
    return re.sub(r"\[\[|\]\]", " ", re.sub(r"<<([^|>]*)[^>]*>>", r"\1", text))


def accepted(text):
    return {t.name for _, t, _ in licenses.Scanner().scan(text.encode())[1]}


@pytest.mark.parametrize("name", [t.name for t in licenses.TEMPLATES])
def test_every_template_accepts_itself_and_no_changed_word(name):
    template = next(t for t in licenses.TEMPLATES if t.name == name)
    whole = filled(name)
    assert name in accepted(f"before. {whole.upper()}! after")
    least = re.sub(r"\[\[.*?\]\]", " ", template.text) if "[[<<" not in template.text and "by <<0-12>>]]" not in template.text else whole
    least = re.sub(r"<<(\d+)-(\d+)>>", lambda m: " ".join(["foo"] * int(m[1])), least)
    least = re.sub(r"<<([^|>]*)[^>]*>>", r"\1", least)
    assert name in accepted(least)
    must = [w.decode() for kind, *x in licenses.parse(template.text) if kind == "word" for w in x]
    w = whole.split()
    at = next(i for i, x in enumerate(w) if words(x.encode()) == [must[-1].encode()] and i == max(j for j, y in enumerate(w) if words(y.encode()) == [must[-1].encode()])) if must else None
    if at is not None:
        assert name not in accepted(" ".join([*w[:at], "other", *w[at + 1 :]]))


def test_marks_and_phrases():
    mit = filled("mit-text")
    assert "mit-text" in accepted(mit.replace('"as is"', "“AS IS” —").replace('"software"', "‘Software’"))
    assert "mit-text" not in accepted(mit.replace("merge", "—")) and "mit-text" not in accepted(mit.replace("merge", "merge and"))
    assert "mit-text" not in accepted(mit.replace(" ".join(["Foo"] * 12), " ".join(["Foo"] * 13)))
    # Exact phrases read words as they are.
    assert accepted("the “mit license”") == set() and accepted("MIT-License") == {"phrase-mit"} and "phrase-mit" not in accepted("mit — license")


def test_random_texts_equal_regular_expressions():
    r = random.Random(5)
    small = (
        licenses.Template("a", "a", "x y [[z [[x]]]] x"), licenses.Template("b", "b", "y <<0-2>> y [[x]] z"), licenses.Template("c", "c", "<<x y|z>> <<1-3>> x x"),
        licenses.Template("d", "d", "x y", True), licenses.Template("e", "e", "z z z", True),
    )
    scanner = licenses.Scanner(small)
    scanner.sorts[1][1].MOST = 5
    for _ in range(400):
        w = [r.choice("xyzq") for _ in range(r.randrange(30))]
        n, found = scanner.scan(" ".join(w).encode(), size=r.choice([3, 1 << 20]))
        assert n == len(w)
        want = []
        for s in range(len(w)):
            for t in small:
                rest = "".join(f" {x}" for x in w[s:])
                ends = [e for e in range(s + 1, len(w) + 1) if re.fullmatch(licenses.expression(licenses.parse(t.text)), "".join(f" {x}" for x in w[s:e]))]
                if ends and rest:
                    want.append((s, t.name, max(ends)))
        assert [(s, t.name, e) for s, t, e in found] == sorted(want), w


def test_templates_that_cannot_be():
    for text in ("[[a", "a]]", "<<0-2>> a", "[[a]]"):
        with pytest.raises(ValueError):
            licenses.Scanner((licenses.Template("t", "t", text),))
    with pytest.raises(ValueError):
        licenses.Scanner((licenses.PHRASES[0], licenses.PHRASES[0]))


def test_license_columns(spark):
    rows = [(1, None), (2, ""), (3, "..."), (4, "Licensed under CC BY-NC 4.0, MIT license; mit License"), (4, "gnu general public license"), (5, "x " * 60_000 + "apache license, version 2.0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_license_places", F.lit("own")).repartition(3)
    out = licenses.find_licenses(docs)
    assert out.columns[:3] == docs.columns and out.filter("_license_places = 'own'").count() == 6
    got = {(r.doc_id, r.n_words): r for r in licenses.scan_documents(docs).collect()}
    assert [tuple(got[k])[2:] for k in ((1, 0), (2, 0), (3, 0))] == [(0, None, None, "", "", 0.0)] * 3
    r = got[4, 11]
    assert (r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == (3, 2, 9, "cc-by,mit", "cc-by,cc-by-nc-4.0,mit", 5 / 9)
    assert got[4, 4].labels == "gpl" and (got[5, 60_005].first_word, got[5, 60_005].labels) == (60_000, "apache,apache-2.0")


def test_words_in_pieces():
    t = ("Ab é-c " * 500 + "y" * 300).encode()
    for overlap in (0, 5):
        out = [w for _, found, new in word_pieces(t, overlap, 17) for w in found[:new]]
        assert out == words(t)
    assert list(word_pieces(None)) == list(word_pieces(b"")) == []


def plain_negatives(rows, positives=5, negatives=3):
    """Brute force over distinct (id, label, vector)."""
    rows = sorted(set(rows))
    score = lambda a, b: sum(x * y for x, y in zip(a[2], b[2], strict=False))
    out = []
    for a in rows:
        if a[0] % 50 == 0:
            others = sorted([(-score(a, b), b[0], b[1]) for b in rows if b[0] != a[0]])
            for s, p, _ in [x for x in others if x[2] == a[1]][:positives]:
                good = [(n, i) for n, i, label in others if label != a[1] and 50 * -s <= 100 * -n <= 95 * -s][:negatives]
                out += [(a[0], p, rank, i, -s, -n) for rank, (n, i) in enumerate(good, 1)]
    return sorted(out)


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 64)
    monkeypatch.setattr(negatives, "PACK", 4)
    r = np.random.default_rng(3)
    centres = r.integers(-200, 200, (12, 8))
    rows = [(i, int(r.integers(0, 4)), tuple(int(x) for x in centres[i % 12] + r.integers(-15, 15, 8))) for i in range(1200)]
    rows += [(2000 + i, i % 3, (90, 80, 70, 60, 50, 40, 30, 20)) for i in range(500)]  # a third are one vector: ties go to the smaller id
    rows += [(50, 1, (5, 5)), (50, 1, (5, 5)), (3000, 2, (7,) * 8), (3050, 9, ()), (3100, 1, (10**9, 0, 0, 0, 0, 0, 0, -(10**9)))]
    df = spark.createDataFrame(rows + [(None, 1, (1,) * 8), (4000, None, (1,) * 8), (4050, 1, None), (4100, 1, (1, None))], "id long, label long, v array<long>").repartition(5)
    held = [(i, label, tuple(max(-negatives.MOST, min(negatives.MOST, x)) for x in v)) for i, label, v in rows]
    got = sorted(tuple(x) for x in negatives.hard_negatives(df.withColumn("anchor", F.lit("clash")), F.col("id") % 50 == 0).collect())
    assert got == plain_negatives(held) and len(got) > 100


def test_the_tree_rules_leaves_out(spark, monkeypatch):
    r = np.random.default_rng(4)
    x = np.concatenate([c + r.integers(-10, 10, (300, 16)) for c in r.integers(-200, 200, (20, 16))]).astype(np.int64)
    rows = spark.createDataFrame([(i, i % 5, v.tolist()) for i, v in enumerate(x)], "id long, label long, v array<long>")
    monkeypatch.setattr(negatives.Tree.fit.__func__, "__defaults__", (256,))
    index = negatives.build_index(rows)
    assert index.tree.leaves > 8 and index.rows.count() == len(x) and index.rows.select("leaf").distinct().count() <= index.tree.leaves
    leaf = {v.id: v.leaf for v in index.rows.select("id", "leaf").collect()}
    q = x[::97].astype(float)
    score = q @ x.T
    top = np.sort(score, 1)[:, -20]
    # Two windows for each row: its best rows, and a band further out.
    of = np.repeat(np.arange(len(q)), 2)
    low, high = np.stack([top, top * 0.5], 1).ravel(), np.stack([np.full(len(q), np.inf), top * 0.6], 1).ravel()
    first, rows, leaves = index.tree.visits(q, of, low, high)
    for i, s in enumerate(score):
        inside = np.flatnonzero((s >= top[i]) | ((s >= top[i] * 0.5) & (s <= top[i] * 0.6)))
        assert {leaf[k] for k in inside} <= set(leaves[rows == i])
        assert first[i] in set(leaf.values())
    best = index.tree.visits(q, np.arange(len(q)), top, np.full(len(q), np.inf))
    assert len(best[1]) < 0.3 * index.tree.leaves * len(q) and len(set(zip(rows.tolist(), leaves.tolist(), strict=True))) == len(rows)
    assert np.mean(first == [leaf[97 * i] for i in range(len(q))]) > 0.9 or len(q) == 0


def plain_ranks(docs, items, k=10):
    found = [(i, word_list(t)) for i, t in docs]
    found = [(i, Counter(w), len(w)) for i, w in found if w]
    n, total = len(found), sum(x[2] for x in found)
    out = []
    for item, t in items:
        asked, scores = Counter(word_list(t)), []
        df = {w: sum(w in d for _, d, _ in found) for w in asked}
        for i, d, size in found:
            m = 25 + 75 * size * n // total
            s = sum(c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * d[w] // (1000 * d[w] + 8 * m)) for w, c in asked.items() if w in d)
            scores += [(-s, i is None, i)] if s > 0 else []
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("options", [{}, {"few": 0, "block_chars": 60}, {"k": 3}])
def test_search_equals_brute_force(spark, options):
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "x-y", "Foo"]
    texts = [" ".join(r.choices(vocabulary, weights=[1 / (j + 1) for j in range(len(vocabulary))], k=r.choice([1, 3, 20, 90, 400]))) for _ in range(150)]
    docs = list(enumerate(texts)) + [(900, None), (901, ""), (902, "?!"), (None, texts[3]), (None, texts[3]), (7, texts[7])] + [(1000 + i, texts[5]) for i in range(70)]
    items = [(1, texts[5]), (2, "w0 w1 w50"), (3, "foo FOO x"), (4, None), (5, ""), (6, "nowhere"), (1, texts[5]), (None, texts[9][:200]), (8, "w0")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"key": F.lit(1), "id": F.lit("clash")}).repartition(6)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = lexical.search(df, bench, **options).collect()
    assert sorted(map(tuple, got), key=repr) == plain_ranks(docs, items, options.get("k", 10))


def test_bounds_are_never_too_low(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    table = pa.table({"key": [d.doc_id for d in docs], "text": [d.text for d in docs]})
    index = lexical.build_signatures(spark.createDataFrame(table.to_pandas())).collect()
    found = {d.doc_id: words((d.text or "").encode()) for d in docs}
    n, total = sum(bool(w) for w in found.values()), sum(map(len, found.values()))
    assert sum(len(b["keys"]) for b in index) == n and sum(sum(b.sizes) for b in index) == total
    items = [(i, Counter(found[d.doc_id][:40])) for i, d in enumerate(docs[::9])]
    df = Counter(w for x in found.values() for w in set(x))
    queries = lexical.Queries.of(items, {w: df[w] for _, c in items for w in c}, n, total)
    hashed = np.array([next(lexical.word_hashes(pa.array([w], pa.binary())))[3][0] >> np.uint64(12) for w in queries.terms], np.uint64)
    above = 0
    for b in index:
        at = np.array([lexical._positions(lexical._hashed(hashed, k), b.width) for k in range(lexical.LEVELS)])
        for (_, asked), bounds in zip(items, lexical.upper_bounds(queries, np.array(b.sizes), b.width, bytes(b.slices), at), strict=True):
            for key, bound in zip(b["keys"], bounds, strict=True):
                times, length = Counter(found[key]), queries.length(len(found[key]))
                score = sum(c * lexical.weight(n, df[w]) * lexical.gain(times[w], length) for w, c in asked.items() if w in times)
                assert bound >= score
                above += bound > 3 * score + 1
    assert above < 0.4 * n * len(items)
