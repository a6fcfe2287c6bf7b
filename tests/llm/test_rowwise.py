"""Decontamination, mixing, language, quality, toxicity and page text on small fixtures."""

import hashlib
import re
import time
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm import decontam, html_text, langid, mixing, quality, toxicity
from gridloom.llm import queries as q
from gridloom.llm.common import bounded_sample, counted, word_hashes, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"


def word_list(t):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def plain_hits(text, items):
    w, hit, found = word_list(text), set(), set()
    for name, t in items:
        v = word_list(t)
        size = min(13, len(v))
        for s in range(len(v) - size + 1 if v else 0):
            for i in range(len(w) - size + 1):
                if w[i : i + size] == v[s : s + size]:
                    hit.update(range(i, i + size))
                    found.add(str(name))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block_chars", [4_000_000, 40])
def test_decontamination_equals_brute_force(spark, block_chars):
    texts = [None, "", "...", f"x {LONG} y", LONG.upper(), f"{LONG} {LONG}", "short item here", "a short item here and more " * 3, " ".join(LONG.split()[:12]), "é École " + LONG, "one one one one " * 20] + [f"x {LONG} y"]
    items = [(1, LONG), (2, "Short item here"), (3, ""), (4, None), (10, "one " * 20), (11, LONG + " fifteen")]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, contam_words int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    n_words, ranges, found = decontam.names(docs)
    out = {r.doc_id: r for r in decontam.contamination(docs, bench, block_chars=block_chars).withColumn("hit", decontam.hit_words(F.col(ranges))).collect()}
    for i, t in enumerate(texts):
        n, hit, names = plain_hits(t, [x for x in items if x[1]])
        assert (out[i][n_words], out[i].hit, out[i][found]) == (n, hit, names), t
    kept = {r.doc_id for r in decontam.decontaminate(docs, bench, block_chars=block_chars).collect()}
    assert kept == {i for i, t in enumerate(texts) if not (plain_hits(t, [x for x in items if x[1]])[1] * 20 >= plain_hits(t, [x for x in items if x[1]])[0] and plain_hits(t, [x for x in items if x[1]])[1])}
    assert decontam.decontaminate(docs, bench.limit(0)).count() == len(texts) and decontam.decontaminate(docs.limit(0), bench).count() == 0


def test_mix_meets_targets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(9001, None, "en", None, 0), (9002, "", "en", None, 0), (9003, "a b\tc", "en", None, 5), (9003, "a b\tc", "en", None, 5)], docs.schema)
    out = mixing.mix(docs.unionByName(extra)).toPandas()
    assert (out["taken"] <= 3 * out["size"]).all() and len(out) == docs.count() + 4
    assert out["target"].groupby(out["source"].fillna("~")).first().sum() == pytest.approx(out["size"].sum())
    for _, g in out.groupby(out["source"].fillna("~")):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 2 * g["size"].max()
    again = mixing.mix(docs.unionByName(extra).repartition(7)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert sorted(map(tuple, out[key].values.tolist())) == sorted(map(tuple, again[key].values.tolist()))
    assert mixing.mix(docs.limit(0)).count() == 0
    kept = mixing.mixed_documents(docs).toPandas()
    assert (kept["mix_copies"] > 0).all() and list(kept.columns) == [*docs.columns, "mix_copies"] and 0 < len(kept) < docs.count()


def test_mix_splits_rows_without_an_id(spark):
    rows = [(None, f"{'w ' * (1 + i % 7)}t{i}", "a") for i in range(200)] + [(i, "x " * 40, "b") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("mix_copies", F.lit("old"))
    out = mixing.mix(docs).toPandas()
    for _, g in out.groupby("source"):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= g["size"].max()
    kept = mixing.mixed_documents(docs)
    assert kept.columns == [*docs.columns, "_mix_copies"] and kept.filter("mix_copies <> 'old'").isEmpty()


def test_sample_leaves_no_stratum_out(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 400).alias("lang"))
    got = bounded_sample(df, "doc_id", "lang", 600, "s", most=2000)
    assert got.columns == df.columns and got.select("lang").distinct().count() > 380 and 1700 < got.count() < 2300


def test_language(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = spark.createDataFrame([(9001, None, None, "s", 0), (9002, "", "en", "s", 0), (9003, "123 -- !!", "fr", "s", 9), (9004, "² ½ ① ٣", "fr", "s", 9)], docs.schema)
    out = langid.predict_documents(docs.unionByName(odd)).toPandas().set_index("doc_id")
    assert {out.loc[i].lang_pred for i in (9001, 9002, 9003, 9004)} == {"und"}
    truth = docs.toPandas().set_index("doc_id")["lang"]
    held = out[out.held_out].index.intersection(truth.index)
    assert (out.loc[held].lang_pred == truth[held]).mean() > 0.97 and out.score.between(0, 1).all()
    assert all(bool(h) == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in out.held_out.items())
    assert set(langid.predict_documents(odd).toPandas().lang_pred) == {"und"}


def test_quality(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    odd = spark.createDataFrame([(9001, None, None, "s", 0), (9002, "", "en", "s", 0), (9003, "word " * 50_000, "fr", "s", 9)], docs.schema)
    out = quality.score_documents(docs.unionByName(odd), labels).toPandas()
    m = out.merge(labels.toPandas(), on="doc_id")
    held = m[m.held_out]
    assert (held.predicted == held.quality).mean() > 0.95 and out.score.between(0, 1).all() and len(out) == docs.count() + 3
    assert (quality.score_documents(docs, labels.limit(0)).toPandas().score == 1).all()
    assert quality.score_documents(docs.limit(0), labels).count() == 0
    clash = docs.withColumn("_quality", F.lit(1)).withColumn("score", F.lit("x"))
    assert quality.keep_good(clash, labels).columns == clash.columns


def test_toxicity(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = toxicity.score_documents(docs, labels).toPandas()
    held = out.merge(labels.toPandas(), on="doc_id")
    held = held[held.held_out]
    assert (held.predicted == held.toxic).mean() > 0.97
    odd = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert toxicity.score_documents(odd, labels).count() == 2
    assert (toxicity.score_documents(docs.limit(5), labels.filter("toxic = 0")).toPandas().score == 0).all()


def test_toxicity_learns_words_of_few_examples(spark):
    # Of 400 labelled texts three are toxic in a rare language; all words of all examples have some weight.
    common = [f"w{i}" for i in range(60)]
    r = np.random.default_rng(1)
    texts = [" ".join([*r.choice(common, 20), *(["slur"] if i % 10 == 0 else [])]) for i in range(400)]
    texts[11:14] = [" ".join([*[f"rare{j}" for j in r.choice(40, 8)], "oskolar"]) for _ in range(3)]
    ids = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 5 != 0][:400]
    toxic = [int(i % 10 == 0 or 11 <= i < 14) for i in range(400)]
    new = [(9001, "oskolar rare1 rare2"), (9002, "w1 w2 w3"), (9003, "nothing of this is known")]
    docs = spark.createDataFrame([*zip(ids, texts, strict=True), *new], "doc_id long, text string")
    labels = spark.createDataFrame([*zip(ids, toxic, strict=True)], "doc_id long, toxic int")
    out = {x.doc_id: x for x in toxicity.score_documents(docs, labels).collect()}
    assert out[9001].predicted == 1 and {x.doc_id for x in out[9001].evidence} == set(ids[11:14])
    assert out[9002].predicted == 0 and len(out[9002].evidence) == 3 and out[9003].evidence == []
    a, b, n = np.array([0, 1, 3, 30]), np.array([1, 0, 0, 60]), toxicity.tie
    factor = n(a, b, 43, 357, 40.0, 0.05)
    assert (factor > 0).all() and factor[2] > factor[1]
    # Statistics are over all labelled rows, whatever the sample is.
    hashed = [int(next(word_hashes(pa.array([w])))[3][0]) >> 12 for w in ("oskolar", "slur", "w1")]
    order = np.argsort(hashed)
    count = toxicity.label_counts(docs, labels.withColumnRenamed("toxic", "label"), spark.sparkContext.broadcast(np.array(hashed)[order]))
    assert [x[np.argsort(order)].tolist() for x in count[:2]] == [[3, 40, sum("w1" in t.split() for t, y in zip(texts, toxic, strict=True) if y)], [0, 0, sum("w1" in t.split() for t, y in zip(texts, toxic, strict=True) if not y)]] and count[2:] == (43, 357)


def test_words_by_hash_are_the_words():
    texts = [None, "", "A", "a b" * 3, "É é x", "AbC abc", "x" * 3000, "word and " * 400, "...", " lead", "trail "] * 2
    column = pa.array(["cut off", *texts])[1:]
    for most in (1_000_000, 500, 7):
        seen: dict = {}
        for s, e, row, value in word_hashes(column, most):
            for i in range(s, e):
                want = words((texts[i] or "").encode())
                got = value[row == i - s].tolist()
                assert len(got) == len(want) and all(seen.setdefault(w, h) == h for w, h in zip(want, got, strict=True))
            at, _, n = counted(row, value)
            assert [Counter(n[at == i - s].tolist()) for i in range(s, e)] == [Counter(Counter(words((texts[i] or "").encode())).values()) for i in range(s, e)]
        assert len(set(seen.values())) == len(seen)


def test_cosines_over_whole_vocabularies_equal_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = {r.doc_id: r for r in toxicity.score_documents(docs, labels).collect()}
    texts = {r.doc_id: Counter(words((r.text or "").encode())) for r in docs.collect()}
    label = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 != 0 and r.doc_id in texts}
    n = len(texts)
    held = Counter(w for t in texts.values() for w in t)
    first: dict = {}
    for i in sorted(label):
        first.setdefault((label[i], frozenset(texts[i].items())), i)
    distinct = {1: [texts[i] for (y, _), i in first.items() if y == 1], 0: [texts[i] for (y, _), i in first.items() if y == 0]}
    by = {y: Counter(w for t in of for w in t) for y, of in distinct.items()}
    known = sorted({w for i in label for w in texts[i]})
    factor = toxicity.tie(np.array([by[1][w] for w in known], float), np.array([by[0][w] for w in known], float), len(distinct[1]), len(distinct[0]), 40.0, 0.05)
    weight = {w: (np.log((1 + n) / (1 + held[w])) + 1) * f for w, f in zip(known, factor, strict=True)}
    vector = {}
    for i, t in texts.items():
        v = {w: (1 + np.log(c)) * weight.get(w, (np.log(1 + n) + 1) * 0.05) for w, c in t.items()}
        size = np.sqrt(sum(x * x for x in v.values()))
        vector[i] = {w: x / size for w, x in v.items() if w in weight}
    for i in list(texts)[:40]:
        cosine = {j: round(sum(x * vector[j].get(w, 0) for w, x in vector[i].items()), 9) for j in label}
        want = sorted(((c, -j) for j, c in cosine.items() if c > 0), reverse=True)[:3]
        assert [round(e.similarity, 9) for e in out[i].evidence] == pytest.approx([c for c, _ in want], abs=1e-8)
    clean = [r.score for i, r in out.items() if not r.predicted]
    assert len(set(clean)) > 0.5 * len({frozenset(texts[i].items()) for i, r in out.items() if not r.predicted})


def test_blocked_search_is_exact():
    r = np.random.default_rng(4)
    v = np.where(r.random((300, 12)) < 0.2, r.integers(1, 4, (300, 12)), 0).astype(float)
    v = v[v.any(1)]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    index = toxicity.Examples(v, np.arange(len(v)) * 3, np.ones(len(v)), np.ones(len(v)), block=16, n_dense=3)
    for row in v[:40]:
        t = np.nonzero(row)[0]
        at, cosine = index.search(t, row[t], 7)
        want = np.round(v @ row, 12)
        order = np.lexsort((np.arange(len(v)), -want))[:7]
        order = order[want[order] > 0]
        assert index.ids[at].tolist() == (order * 3).tolist() and cosine == pytest.approx(want[order])


PAGES = [
    ("<html><head><title>T</title><script>var a='<p>no</p>';</script><style>p{}</style></head><body><nav><a href='/'>Home</a></nav><div class='ad'>Buy now</div><article><h1>Head &amp; more</h1><p><b>One  two<br>three<p>Four&nbsp;five &lt;tag&gt;</p></article><footer>&copy; x</footer>", "Head & more One two three Four five <tag>"),
    ("<body><header>Site</header><main><p>Text body.</p><aside>Side</aside><form><input><button>Go</button></form><div id='comments'><article><p>First!</p></article></div></main></body>", "Text body."),
    ("<div class='sidebar'><p>The the the of and to in a is that</p></div><div><p>" + "This is the text of the page and it is for the people that read it with care, as they do. " * 3 + "</p><p>Short one.</p></div><div class='cookie-notice'>We use cookies</div>", ("This is the text of the page and it is for the people that read it with care, as they do. " * 3).strip() + " Short one."),
    (None, ""), ("", ""), ("<p", ""), ("<!-- only a comment", ""), ("<article><p>a<!-- b -->c</p><ul><li>x<li>y</ul>", "ac x y"),
]


@pytest.mark.parametrize("page,text", PAGES)
def test_page_text(page, text):
    assert html_text.main_text(page)[0] == text


PROSE = "<p>" + "This is the text of the page and it is for the people that read it with care. " * 3 + "</p>"


@pytest.mark.parametrize("around", [
    '<main class="with-sidebar">%s</main>', '<article class="post comments-open">%s</article>', '<div class="content-with-sidebar">%s</div>', '<div class="sidebar"><article>%s</article></div>', "<form><main>%s</main></form>",
    '<div class="layout no-nav">%s</div>', "<article>%s</article><article><p>A teaser of the other one, and the rest.</p></article>", '<article>%s<div id="comments"><article><p>I think that it is the best of the lot, and so on and on it goes for a line.</p></article></div></article>',
    '<nav><a href="/">Home</a></nav>%s<div class="x"><a href="/a">Some link to the other page of this site</a></div><footer>All of the rights are reserved by us.</footer>', '<article>%s<ul><li><a href="/1">One</a></li><li><a href="/2">Two</a></li><li><a href="/3">Three</a></li></ul></article>',
])
def test_only_what_surrounds_the_text_goes(around):
    assert html_text.main_text(around % PROSE)[0] == PROSE[3:-4].strip()


def test_short_blocks_follow_their_neighbours():
    page = f"<div><p>Menu</p><p><a href='/'>A long list of links to all the other pages that this site has</a></p><h2>Title</h2>{PROSE}<p>Yes.</p>{PROSE}</div>"
    out = html_text.judged(page)
    assert [(b.label, b.by) for b in out] == [("bad", "neighbours"), ("bad", "links"), ("good", "neighbours"), ("good", "density"), ("good", "neighbours"), ("good", "density")]
    assert html_text.main_text("<nav>Home</nav><p>Hello there.</p><footer>Us</footer>")[0] == "Hello there."
    assert html_text.main_text("<article><h1>Head</h1><p>Oui.</p><p><a href='/'>See it all here</a></p></article>")[0] == "Head Oui. See it all here"


@pytest.mark.parametrize("page", ["<a " + '""' * 50_000, '<a "' * 30_000, '<a "' * 30_000 + ">", "<a b=" * 30_000 + ">", "<b>" * 40_000 + "</i>" * 40_000, "<b>" * 20_000 + "<li>x</li>" * 20_000, "<div a='" * 20_000, "<!--" * 30_000, "<svg>" * 20_000, '<div class="sidebar">x' * 20_000])
def test_odd_pages_take_linear_time(page):
    start = time.time()
    html_text.main_text(page)
    assert time.time() - start < 5


class Inner(HTMLParser):
    """The text inside the article element, a space at each tag but inline ones: a plain reading of the given pages."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.out = False, []

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        self.out.append("" if tag in ("a", "b") else " ")

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        self.out.append("" if tag in ("a", "b") else " ")

    def handle_data(self, data):
        self.out += [data] if self.inside else []


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_pages_equal_a_plain_reading(spark, size):
    d = f"/root/testdata/{size}"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{d}/pages.parquet").select("page_id", "html").collect()}
    out = {r.page_id: r for r in q.op8_html_text(spark, d).collect()}
    assert out.keys() == pages.keys()
    by = Counter()
    for i, page in pages.items():
        reader = Inner()
        reader.feed(page or "")
        assert out[i].text == " ".join("".join(reader.out).split()) and out[i].n_chars == len(out[i].text)
        by.update(b.by for b in html_text.judged(page) if b.label == "good")
    # Neither the place alone nor one pass alone decides what is kept.
    assert by["density"] > len(pages) and by["neighbours"] > len(pages) and by["place"] == 0


def test_page_columns_that_clash(spark):
    pages = spark.createDataFrame([(1, "u", "<p>x</p>", "old", 3)], "page_id long, url string, html string, Text string, text_blocks int")
    out = html_text.extract(pages)
    assert out.columns == ["page_id", "url", "Text", "text_blocks", "_text", "_text_blocks"] and out.first()["_text"] == "x"


def test_digest_of_no_items():
    assert decontam.item_digest([]) == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize(("page", "text"), [
    ('<article><div class="search-engine-history">The text is here.</div></article>', "The text is here."),
    ('<article><p>The start is here.</p><p class="notice-of-meeting">A notice of the meeting.</p></article>', "The start is here. A notice of the meeting."),
    ('<article><p>The start is here.</p><div class="share-buttons"><p>Share it</p></div><div id="related-posts">More of the same</div></article>', "The start is here."),
])
def test_only_whole_names_throw_text_away(page, text):
    assert html_text.main_text(page)[0] == text


def test_nested_articles_in_linear_time():
    start = time.time()
    html_text.main_text("<nav><article>" * 40_000)
    assert time.time() - start < 8


@pytest.fixture(scope="module")
def bare_pages(spark):
    """(pages without any element or name that says where the article is, the text that the whole pages give)."""
    whole = [r.html for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").orderBy("page_id").limit(400).collect()]

    def bare(page):
        page = re.sub(r"<(/?)(article|main|nav|header|footer|aside|section|form)\b", r"<\1div", page, flags=re.I)
        return re.sub(r"\s(class|id|role)=(\"[^\"]*\"|'[^']*'|[^\s>]+)", "", page, flags=re.I)

    return [bare(p) for p in whole], [html_text.main_text(p)[0] for p in whole]


def shared_words(got, want):
    """Precision and recall by words."""
    both = sum(sum((Counter(a.split()) & Counter(b.split())).values()) for a, b in zip(got, want, strict=True))
    return both / sum(len(a.split()) for a in got), both / sum(len(b.split()) for b in want)


def test_figures_find_the_text_without_tags(bare_pages, monkeypatch):
    pages, want = bare_pages
    got = [html_text.main_text(p)[0] for p in pages]
    precision, recall = shared_words(got, want)
    assert precision > 0.95 and recall > 0.95, (precision, recall)
    # Each part of the method decides: without it most pages come out otherwise.
    for name, value in (("STOP_WORDS", frozenset()), ("second_pass", lambda found: None), ("MANY_LINKS", 2.0), ("SHORT", 0)):
        with monkeypatch.context() as patch:
            patch.setattr(html_text, name, value)
            changed = sum(html_text.main_text(p)[0] != g for p, g in zip(pages, got, strict=True))
        assert changed > (0.5 if name in ("STOP_WORDS", "second_pass") else 0.0) * len(pages), (name, changed)
