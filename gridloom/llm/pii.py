"""Personal data: candidate generators, boosted trees, calibrated thresholds.

Four base rules find e-mail addresses, IP addresses, card and phone numbers that pass
their checks; these spans always stand. In what they leave, high-recall generators propose
overlapping spans: addresses and dotted quads with written-out or bracketed signs, runs of
digits with separators, and unbroken runs inside such runs. A candidate is described by its
format and by its context.

Boosted trees learn from examples whose label the base rules do not give: base matches
rewritten into forms that the rules do not know (``a (at) b dot c``, regrouped cards, phone
numbers without their plus) are positive; candidates of the texts as they are, base
matches broken so that their check fails, and words before a plain domain (``works at b.com``) are negative. ``seeds`` made-up examples of the same
forms are always added, so that there is a model whatever the table holds; it is fitted in
the same way at every size. On other examples the score is calibrated: a kind's threshold is
the lowest score from which at least ``precision`` of its candidates are positive. What
reaches it is added.

Everything is DataFrame expressions; the fitted trees are one such expression, so texts
are read row by row and never shuffled, in time linear in the text. Learning takes about
``fit_docs`` documents by the id's hash (a documented bound).

Null and empty texts have no spans. Rows are read one by one, so repeated rows agree. Candidates of equal
score are all added or all left out. Positions
count code points from 0, ends are exclusive; spans are in order of kind, start and end, and
added ones may overlap each other. Other columns pass through; names that clash are avoided
by underscores in front.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import durable, fresh, unit_hash

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. Quantifiers are possessive and runs start at their first character, which finds the same matches in linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # Whole runs of digits with single separators, of 16 to 19 digits.
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT = r"(?:\x20?@\x20?|\x20?[(\[{<](?:@|\x20?(?i:at)\x20?)[)\]}>]\x20?|\x20(?i:at)\x20)"
_DOT = r"(?:\.|\x20?[(\[{<](?:\.|\x20?(?i:dot)\x20?)[)\]}>]\x20?|\x20(?i:dot)\x20)"
_QUAD_DOT = r"(?:\x20?\.\x20?|\x20?[(\[{<](?:\.|\x20?(?i:dot)\x20?)[)\]}>]\x20?|\x20(?i:dot)\x20)"
GENERATORS = {
    "address": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++",
    "quad": rf"(?<![0-9A-Za-z])[0-9]{{1,3}}(?:{_QUAD_DOT}[0-9]{{1,3}}){{3}}(?![0-9A-Za-z])",
    "digits": r"(?<![0-9A-Za-z])[+(]?[0-9](?:[().\x20/_–-]{0,3}+[0-9]){6,}+(?![0-9A-Za-z])",
    "run": r"(?:(?<=[0-9][\x20/.-])[0-9]{15,19}+(?![0-9A-Za-z])|(?<![0-9A-Za-z])[0-9]{15,19}+(?=[\x20/.-][0-9]))",
}
#: What a text must hold for a generator to have a chance.
HINTS = {"address": r"(?i)@|[(\[{<]\x20?at\x20?[)\]}>]|\x20at\x20", "quad": r"(?i)[0-9](?:\x20?\.|\x20?[(\[{<]|\x20dot)", "digits": "[0-9]", "run": "[0-9]{15}"}
MASK = "\u0001"
SPAN = "array<struct<kind:int,start:int,end:int>>"
CONTEXT = 24
#: Words before personal data.
CUES = r"(?i)(mail|contact|phone|tel|call|fax|mobile|card|visa|account|iban|\bip\b|host|server|addr|reach)"


PIECE = 128


def located(docs: DataFrame, text: Column, pattern: str, name: str, hint: Column) -> DataFrame:
    """Add ``name``, the matches of a pattern as structs (match, start): the gaps between them, split out, give the positions.

    Lengths are summed up piece by piece, so that no array grows with each match. Each step is a
    column of its own that the next one names more than once, so that the planner keeps them apart.
    """
    found, gaps, sizes, pieces, ends = (fresh(docs, f"{name}_{x}") for x in ("m", "g", "n", "p", "e"))
    none = F.array().cast("array<string>")
    # Texts without a match are not split.
    out = docs.withColumn(found, F.when(hint & F.regexp_like(text, F.lit(pattern)), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    some = F.size(found) > 0
    out = out.withColumn(gaps, F.when(some, F.split(text, pattern, -1)).otherwise(none))
    out = out.withColumn(sizes, F.zip_with(F.col(found), F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.length(g) + F.length(m)))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / PIECE).cast("int")), lambda c: F.slice(sizes, c * PIECE + 1, F.lit(PIECE)))
    out = out.withColumn(pieces, F.when(F.size(sizes) > 0, cut).otherwise(F.array().cast("array<array<int>>")))
    running = lambda values, first: F.aggregate(values, F.array(first), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    sums = F.transform(F.col(pieces), lambda piece: F.aggregate(piece, F.lit(0), lambda n, x: n + x))
    upto = F.flatten(F.zip_with(F.col(pieces), F.slice(running(sums, F.lit(0)), F.lit(1), F.size(pieces)), lambda piece, at: F.slice(running(piece, at), F.lit(2), F.size(piece))))
    out = out.withColumn(ends, F.when(some, upto).otherwise(F.array().cast("array<int>")))
    spans = F.zip_with(F.col(found), F.col(ends), lambda m, end: F.struct(m.alias("match"), (end - F.length(m)).alias("start")))
    return out.withColumn(name, spans).drop(found, gaps, sizes, pieces, ends)


def with_rest(docs: DataFrame, text: Column, base: Column, name: str) -> DataFrame:
    """Add ``name``, the text with every valid base match overwritten, kind by kind, at the same length. Each kind is a column of its own."""
    steps = [fresh(docs, f"{name}_{kind}") for kind in ("text", *KINDS)]
    out = docs.withColumn(steps[0], F.when(F.size(base) > 0, text))

    def overwritten(kind: str, before: Column) -> Column:
        pattern = PATTERNS[kind]
        found, gaps = F.regexp_extract_all(before, F.lit(pattern), F.lit(0)), F.split(before, pattern, -1)
        pieces = F.zip_with(F.concat(found, F.array(F.lit(""))), gaps, lambda m, g: F.concat(g, F.when((m != "") & _valid(kind, m), F.repeat(F.lit(MASK), F.length(m))).otherwise(m)))
        return F.when(_hint(kind, before) & F.regexp_like(before, F.lit(pattern)), F.array_join(pieces, "")).otherwise(before)

    for kind, before, after in zip(KINDS, steps, steps[1:], strict=False):
        out = out.withColumn(after, overwritten(kind, F.col(before))).drop(before)
    return out.withColumn(name, F.coalesce(F.col(steps[-1]), text)).drop(steps[-1])


def _hint(kind: str, text: Column) -> Column:
    return text.contains({"email": "@", "phone": "+"}[kind]) if kind in ("email", "phone") else F.lit(True)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check."""
    return _luhn_sum(digits) % 10 == 0


def _luhn_sum(digits: Column) -> Column:
    spread = F.split(F.reverse(digits), "")
    doubled = F.transform(spread, lambda d, i: F.when(i % 2 == 1, (d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")).otherwise(d.cast("int")))
    return F.aggregate(F.filter(doubled, lambda d: d.isNotNull()), F.lit(0), lambda a, d: a + d)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.regexp_like(p, F.lit("^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$")))
    if kind == "card":
        return luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    return F.lit(True)


def with_base(docs: DataFrame, text: Column, name: str) -> DataFrame:
    """Add ``name``: the spans that match a base pattern and pass its check, by kind and start."""
    out, parts = docs, []
    for i, kind in enumerate(KINDS):
        found = fresh(docs, f"{name}_{kind}")
        out = located(out, text, PATTERNS[kind], found, _hint(kind, text))
        parts.append((found, F.transform(F.filter(F.col(found), _checked(kind)), _span(i))))
    return out.withColumn(name, F.concat(*[p for _, p in parts]).cast(SPAN)).drop(*[f for f, _ in parts])


def _checked(kind: str):
    return lambda x: _valid(kind, x["match"])


def _span(kind: int):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), (x["start"] + F.length(x["match"])).alias("end"))


#: What the trees see of a candidate.
FEATURES = (
    "n_chars", "n_digits", "n_groups", "first", "last", "last_2", "last_3", "most", "n_dots", "n_dashes", "n_spaces", "n_slashes", "n_brackets", "generator", "n_letters", "n_labels", "tld", "at_sign", "dot_sign",
    "zeros", "luhn_ok", "cue", "digits_before", "alnum_after",
)


def with_features(docs: DataFrame, found: str, name: str) -> DataFrame:
    """Add ``name``, an array of (start, end, kind, f) with the features of each candidate in ``found``: (source, match, start, before, after)."""
    first, second = (fresh(docs, f"{name}_{x}") for x in "ab")
    each = lambda column, f: F.when(F.size(column) > 0, F.transform(F.col(column), f))

    def plain(c):
        text = F.regexp_replace(c["match"], r"^[+(]+", "")
        return F.struct(c.alias("c"), text.alias("plain"), _digits(c["match"]).alias("digits"), F.regexp_replace(c["match"], rf"^.*?{_AT}", "").alias("domain"))

    def grouped(x):
        groups = F.filter(F.split(x["plain"], "[^0-9]+"), lambda g: F.length(g) > 0)
        return F.struct(x["c"].alias("c"), x["plain"].alias("plain"), x["digits"].alias("digits"), x["domain"].alias("domain"), groups.alias("groups"))

    def about(x):
        m, source, plain, digits, groups, domain = x["c"]["match"], x["c"]["source"], x["plain"], x["digits"], x["groups"], x["domain"]
        address, quad = source == 0, source == 1
        n = F.size(groups)
        size_of = lambda back: F.when(n >= back, F.length(F.element_at(groups, F.lit(-back)))).otherwise(0)
        most = F.coalesce(F.array_max(F.transform(groups, lambda g: F.when(F.length(g) <= 4, g.cast("int")).otherwise(9999))), F.lit(0))
        count = lambda chars: F.length(m) - F.length(F.translate(m, chars, ""))
        marks = lambda word, sign: F.when(F.regexp_like(m, F.lit(rf"(?i)[(\[{{<]\x20?(?:{word}|{sign})")), 2).when(F.regexp_like(m, F.lit(rf"(?i)\x20{word}\x20")), 1).otherwise(0)
        kind = F.when(address, 0).when(quad, 1).when(F.length(digits) >= 15, 2).otherwise(3)
        values = {
            "n_chars": F.length(plain), "n_digits": F.length(digits), "n_groups": n, "first": F.coalesce(F.length(F.try_element_at(groups, F.lit(1))), F.lit(0)), "last": size_of(1), "last_2": size_of(2), "last_3": size_of(3), "most": most,
            "n_dots": F.when(address, 0).otherwise(count(".")), "n_dashes": count("-\u2013"), "n_spaces": count(" "), "n_slashes": count("/_"), "n_brackets": count("()[]{}<>"), "generator": source,
            "n_letters": F.length(F.regexp_replace(m, "[^A-Za-z]", "")), "n_labels": F.when(address, F.size(F.split(domain, _DOT))).otherwise(0), "tld": F.when(address, F.length(F.regexp_extract(m, "([A-Za-z0-9-]*)$", 1))).otherwise(0),
            "at_sign": F.when(address, marks("at", "@")).otherwise(0), "dot_sign": F.when(address | quad, marks("dot", r"\.")).otherwise(0), "zeros": F.when(plain.startswith("00"), 2).when(plain.startswith("0"), 1).otherwise(0),
            "luhn_ok": (F.length(digits).between(12, 19) & luhn(digits)).cast("int"), "cue": F.regexp_like(x["c"]["before"], F.lit(CUES)).cast("int"),
            "digits_before": F.length(_digits(x["c"]["before"])), "alnum_after": F.regexp_like(x["c"]["after"], F.lit("[0-9A-Za-z]")).cast("int"),
        }
        return F.struct(x["c"]["start"].alias("start"), (x["c"]["start"] + F.length(m)).alias("end"), kind.alias("kind"), F.array(*[values[f].cast("double") for f in FEATURES]).alias("f"))

    out = docs.withColumn(first, each(found, plain))
    out = out.withColumn(second, each(first, grouped)).drop(first)
    return out.withColumn(name, each(second, about)).drop(second)


def _around(text: Column, start: Column, n: Column) -> tuple[Column, Column]:
    """What stands before and after a span."""
    return F.substring(text, F.greatest(start - CONTEXT, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT))), F.substring(text, start + n + 1, F.lit(1))


def with_proposals(docs: DataFrame, text: Column, left: str, name: str) -> DataFrame:
    """Add ``name``: what all generators propose in ``left``, what the base rules leave of ``text``, as structs (source, match, start, before, after)."""

    def placed(source: int):
        def of(x):
            before, after = _around(text, x["start"], F.length(x["match"]))
            return F.struct(F.lit(source).alias("source"), x["match"].alias("match"), x["start"].alias("start"), before.alias("before"), after.alias("after"))

        return of

    out, found = docs, []
    for source, (generator, pattern) in enumerate(GENERATORS.items()):
        found.append(fresh(docs, f"{name}_{generator}"))
        out = located(out, F.col(left), pattern, found[-1], F.regexp_like(F.col(left), F.lit(HINTS[generator])))
    return out.withColumn(name, F.concat(*[F.transform(F.col(f), placed(i)) for i, f in enumerate(found)])).drop(*found)


def _pick(draw: Column, *values: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(draw, F.lit(len(values))) + 1).cast("int"))


def _grouping(draw: Column) -> Column:
    """A pattern for the groups into which digits are cut: mostly of four, some of eight."""
    return F.when(draw % 4 == 0, F.lit("(.{8})(?=.)")).otherwise(F.lit("(.{4})(?=.)"))


def rewritten(kind: int, m: Column, draw: Column) -> tuple[int, Column]:
    """A generator's number and a form of the base match ``m`` that it proposes and the base rule does not know."""
    more = F.floor(draw / 64)
    if kind == 0:
        local, domain = F.split(m, "@")[0], F.split(m, "@")[1]
        # A bare "at" before a plain domain is how prose speaks of places; it is no address unless its dots are written out too.
        dots = F.when(draw % 6 == 0, _pick(more, " dot ", "[dot]", " (dot) ", "[.]")).otherwise(_pick(more, " dot ", ".", "[dot]", " (dot) ", "[.]"))
        return 0, F.concat(local, _pick(draw, " at ", " (at) ", "[at]", " @ ", "(at)", " [at] "), F.replace(domain, F.lit("."), dots))
    if kind == 1:
        return 1, F.replace(m, F.lit("."), _pick(draw, "[.]", "(.)", " . ", " dot ", "[dot]", ". "))
    if kind == 2:
        return 2, F.regexp_replace(_digits(m), _grouping(more), F.concat(F.lit("$1"), _pick(draw, ".", "/", "  ", " / ", "_", " - ", ". ")))
    plain = F.substring(m, F.lit(2), F.length(m))
    return 2, F.when(draw % 4 == 0, F.concat(F.lit("00"), plain)).when(draw % 4 == 1, plain).when(draw % 4 == 2, F.regexp_replace(plain, "[^0-9]+", ".")).otherwise(F.concat(F.lit("00 "), F.regexp_replace(plain, "[^0-9]+", "/")))


def broken(kind: int, m: Column, draw: Column) -> tuple[int, Column]:
    """A generator's number and a look-alike of the base match ``m`` that fails its check."""
    digits = _digits(m)
    if kind == 0:
        local, domain = F.split(F.split(m, "@")[0], "[^A-Za-z]")[0], F.split(m, "@")[1]
        sentence = F.concat(local, F.lit("x at "), F.split(domain, r"\.")[0], F.lit("."), _pick(draw, "Then", "This", "However", "Nothing", "When", "Everything", "it", "a"))
        word = F.when(draw % 2 == 0, local).otherwise(_pick(F.floor(draw / 8), "buy", "offices", "they", "published", "and"))
        return 0, F.when(draw % 3 == 0, sentence).otherwise(F.concat(word, F.lit(" at "), domain))
    if kind == 1:
        return 1, F.concat(F.regexp_replace(F.regexp_replace(m, "[0-9]+$", ""), r"\.", _pick(draw, ".", ". ", " . ", "[.]")), (F.pmod(draw, F.lit(700)) + 256).cast("string"))
    if kind == 2:
        other = F.concat(F.substring(digits, F.lit(1), F.length(digits) - 1), F.pmod(F.substring(digits, -1, 1).cast("int") + 1 + draw % 9, F.lit(10)).cast("string"))
        return 2, F.regexp_replace(other, _grouping(F.floor(draw / 128)), F.concat(F.lit("$1"), _pick(F.floor(draw / 16), "", "", " ", "-", ".", "/", " - ")))
    return 2, F.when(draw % 2 == 0, F.concat_ws(_SEPARATOR, F.substring(digits, 1, 4), F.substring(digits, 5, 3))).otherwise(F.concat(digits, digits))


_SEPARATOR = "-"


def seed_examples(spark, n: int) -> DataFrame:
    """``n`` made-up base matches of each kind with a context, half of them after a cue: k, m, before, after, draw."""
    draw = lambda salt: F.abs(F.xxhash64(F.col("id"), F.lit(salt)) % 1_000_000_007)
    digits = lambda salt, size: F.substring(F.concat(*[F.lpad(F.pmod(draw(salt + i), F.lit(10**9)).cast("string"), 9, "0") for i in range(2)]), 1, size)
    word = lambda salt: _pick(draw(salt), "anna", "j.smith", "info", "office2", "k-lee", "maria_r", "tom77", "sales", "d.keller", "post")
    body = F.concat(F.lit("4"), digits(11, 14))
    card = F.concat(body, F.pmod(10 - _luhn_sum(F.concat(body, F.lit("0"))) % 10, F.lit(10)).cast("string"))
    octet = lambda salt: (F.pmod(draw(salt), F.lit(255)) + 1).cast("string")
    matches = [
        F.concat(word(1), F.lit("@"), _pick(draw(2), "mail", "firma", "web-post", "uni", "example"), _pick(draw(3), ".com", ".org", ".co.uk", ".de", ".net")),
        F.concat_ws(".", octet(4), octet(5), octet(6), octet(7)),
        card,
        F.concat(F.lit("+"), _pick(draw(8), "1", "44", "49", "33", "351"), F.lit(" "), digits(21, 3), F.lit(" "), digits(23, 3), F.lit("-"), digits(25, 4)),
    ]
    cued = F.when(draw(31) % 2 == 0, _pick(draw(32), "please mail ", "contact: ", "my phone is ", "call me on ", "tel. ", "card no. ", "pay with visa ", "host ip ", "server addr ", "reach us: ", "fax "))
    plain = _pick(draw(33), "and then it was ", "the of that ", "see also ", "in the text ", "for all of ", "")
    rows = spark.range(n).select(F.posexplode(F.array(*matches)).alias("k", "m"), F.coalesce(cued, plain).alias("before"), _pick(draw(34), " ", "", ",", ".").alias("after"), draw(35).alias("draw"))
    return rows


def seed_negatives(spark, n: int) -> DataFrame:
    """``n`` made-up numbers of other sorts: dates, times, amounts, book and order numbers; m, before, after, draw."""
    draw = lambda salt: F.abs(F.xxhash64(F.col("id"), F.lit(salt)) % 1_000_000_007)
    part = lambda salt, low, high: (F.pmod(draw(salt), F.lit(high - low)) + low).cast("string")
    two = lambda salt, most: F.lpad((F.pmod(draw(salt), F.lit(most)) + 1).cast("string"), 2, "0")
    forms = F.array(
        F.concat_ws("-", part(1, 1950, 2030), two(2, 12), two(3, 28)), F.concat_ws("/", two(3, 28), two(2, 12), part(1, 1950, 2030)), F.concat_ws(".", two(3, 28), two(2, 12), part(1, 1950, 2030)),
        F.concat_ws(" ", part(4, 1, 900), part(5, 100, 999), part(6, 100, 999)), F.concat_ws("-", F.lit("978"), part(7, 1, 9), part(8, 10, 99), part(9, 100000, 999999), part(10, 1, 9)),
        part(11, 10**6, 10**9), F.concat(part(12, 10**6, 10**9), part(13, 10**5, 10**6)), F.concat(F.lit("7"), part(12, 10**7, 10**8), part(13, 10**6, 10**7)), F.concat(part(12, 10**8, 10**9), part(13, 10**8, 10**9)), F.concat_ws("-", part(14, 1800, 1999), part(15, 2000, 2030)),
        F.concat_ws(" ", *[part(20 + i, 1, 99) for i in range(5)]), F.concat_ws("/", part(41, 10, 999), part(42, 100, 1000), part(43, 1000, 10**5)), F.concat_ws(".", part(44, 1, 999), part(45, 100, 1000), part(46, 100, 1000)),
    )
    before = _pick(draw(16), "on ", "in the year ", "about ", "order no. ", "the of that ", "and then ", "total ", "pages ", "isbn ", "")
    # A number that happens to pass the card check is no negative.
    return spark.range(n).select(F.element_at(forms, (F.pmod(F.col("id"), F.size(forms)) + 1).cast("int")).alias("m"), before.alias("before"), _pick(draw(17), " ", "", ",", ".").alias("after"), draw(18).alias("draw")).filter(~(F.length(_digits(F.col("m"))).between(15, 19) & luhn(_digits(F.col("m")))))


def _margin(model, value) -> Column:
    """The trees' weighted sum at a candidate, as one expression."""

    def walk(node) -> Column:
        if node.subtreeDepth() == 0:
            return F.lit(node.prediction())
        split = node.split()
        return F.when(value(split.featureIndex()) <= split.threshold(), walk(node.leftChild())).otherwise(walk(node.rightChild()))

    return sum((F.lit(float(w)) * walk(t._call_java("rootNode")) for t, w in zip(model.trees, model.treeWeights, strict=True)), F.lit(0.0))


class Detector:
    """Fitted trees and one threshold for each kind; without them only base spans are found."""

    def __init__(self, model=None, thresholds: dict[int, float] | None = None):
        self.model, self.thresholds = model, thresholds or {}

    @classmethod
    def fit(cls, docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", fit_docs: int = 20_000, seeds: int = 1000, precision: float = 0.95, trees: int = 12, depth: int = 5) -> Detector:
        spark, n = docs.sparkSession, docs.count()
        key, value = F.col(f"`{doc_id}`"), F.coalesce(F.col(f"`{text}`"), F.lit(""))
        part = docs.filter(unit_hash(key, "pii") < fit_docs / max(n, 1)).select(value.alias("t")).filter("t <> ''")
        # Spans and proposals are written first, so that no later expression holds the generators again.
        part = with_rest(with_base(part, F.col("t"), "base"), F.col("t"), F.col("base"), "left")
        # No filter before that: pushed down, it would repeat all of them.
        some = (F.size("base") > 0) | (F.size("found") > 0)
        part = durable(with_proposals(part, F.col("t"), "left", "found").select(F.when(some, F.col("t")).alias("t"), "base", "found")).filter("t is not null")
        draw = lambda *c: F.abs(F.xxhash64(*c) % 1_000_000_007)

        def in_context(start: Column, m: Column) -> list[Column]:
            before, after = _around(F.col("t"), start, F.length(m))
            return [m.alias("m"), before.alias("before"), after.alias("after"), draw("t", start).alias("draw")]

        left_over = part.select("t", F.explode("found").alias("c")).select(F.lit(0).alias("label"), F.col("c.source").alias("source"), F.col("c.match").alias("m"), "c.before", "c.after", draw("t", "c.start").alias("draw"))
        spans = part.select("t", F.explode("base").alias("b"))
        found = spans.select(F.col("b.kind").alias("k"), *in_context(F.col("b.start"), F.substring("t", F.col("b.start") + 1, F.col("b.end") - F.col("b.start"))))
        forms = []
        for kind in range(len(KINDS)):
            for label, form in ((1, rewritten), (0, broken)):
                source, m = form(kind, F.col("m"), F.col("draw"))
                forms.append(F.when(F.col("k") == kind, F.struct(F.lit(label).alias("label"), F.lit(source).alias("source"), m.alias("m"))))
        made = found.unionByName(seed_examples(spark, seeds)).select(F.explode(F.filter(F.array(*forms), lambda x: x.isNotNull())).alias("x"), "before", "after", "draw").select("x.*", "before", "after", "draw")
        numbers = seed_negatives(spark, seeds).select(F.lit(0).alias("label"), F.lit(2).alias("source"), "m", "before", "after", "draw")
        rows = durable(left_over.unionByName(made).unionByName(numbers))
        one = F.array(F.struct("source", F.col("m").alias("match"), F.lit(0).alias("start"), "before", "after"))
        rows = with_features(rows.select("label", (F.pmod(F.xxhash64("draw", "m"), F.lit(1000)) / 1000).alias("u"), one.alias("one")), "one", "about")
        rows = durable(rows.select("label", "u", F.col("about")[0].alias("a")).select("label", "u", "a.kind", "a.f"))
        ready = rows.withColumn("features", array_to_vector("f"))
        model = GBTClassifier(labelCol="label", maxIter=trees, maxDepth=depth, maxBins=32, seed=7, minInstancesPerNode=5).fit(ready.filter("u >= 0.3").select("features", "label").coalesce(4))
        judged = model.transform(ready.filter("u < 0.3")).withColumn("score", F.floor(vector_to_array("probability")[1] * 100).cast("int"))
        tally = judged.groupBy("kind", "score").agg(F.sum("label").alias("good"), F.count("*").alias("n")).orderBy("kind", F.desc("score")).collect()
        thresholds: dict[int, float] = {}
        seen: dict[int, list[int]] = {}
        for r in tally:
            good, n = seen.setdefault(r.kind, [0, 0])
            seen[r.kind] = [good + r.good, n + r.n]
            # Never below one half: what is added is likelier personal than not.
            if seen[r.kind][0] >= precision * seen[r.kind][1] and r.score >= 50:
                thresholds[r.kind] = r.score / 100
        return cls(model, thresholds)

    def mark(self, docs: DataFrame, *, text: str = "text", name: str = "pii") -> DataFrame:
        """Columns of ``docs`` and, under names from :func:`span_names`, base spans and all spans, ordered by kind and start."""
        base_name, all_name = span_names(docs, name)
        value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
        out = with_base(docs, value, base_name)
        if not self.thresholds:
            return out.withColumn(all_name, F.col(base_name))
        left, found, about = (fresh(out, x) for x in ("left", "found", "about"))
        out = with_features(with_proposals(with_rest(out, value, F.col(base_name), left), value, left, found), found, about)
        enough = F.create_map(*[F.lit(x) for kv in self.thresholds.items() for x in kv])
        accepted = F.filter(F.col(about), lambda c: F.coalesce(1 / (1 + F.exp(-2 * _margin(self.model, lambda i: c["f"][i]))) >= F.element_at(enough, c["kind"]), F.lit(False)))
        added = F.transform(accepted, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
        both = F.when(F.size(found) == 0, F.col(base_name)).otherwise(F.array_sort(F.array_distinct(F.concat(F.col(base_name), added))).cast(SPAN))
        return out.withColumn(all_name, both).drop(left, found, about)


def span_names(docs: DataFrame, name: str = "pii") -> tuple[str, str]:
    return fresh(docs, f"{name}_base"), fresh(docs, f"{name}_spans")


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first in the text names the gap that all leave."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, s):
        fresh_part = F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.element_at(names, s["kind"] + 1))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["out"], fresh_part)).otherwise(acc["out"]).alias("out"))

    whole = F.aggregate(ordered, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def redact(docs: DataFrame, detector: Detector | None = None, *, text: str = "text", **options) -> DataFrame:
    """The same columns, personal data in the text replaced."""
    detector = detector or Detector.fit(docs, text=text, **options)
    _, spans = span_names(docs)
    marked = detector.mark(docs, text=text)
    return marked.withColumn(text, redacted(F.col(f"`{text}`"), F.col(spans))).select(*[F.col(f"`{c}`") for c in docs.columns])


def find_personal_data(documents: DataFrame, **options) -> DataFrame:
    """doc_id, counts of base spans, base_sha256 and all spans as text, for every document."""
    docs = documents.select("doc_id", "text")
    base, spans = span_names(docs)
    marked = Detector.fit(docs, **options).mark(docs)

    def count(i: int) -> Column:
        return F.size(F.filter(F.col(base), lambda s: s["kind"] == i)).cast("long")

    counts = [count(i).alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    return marked.select("doc_id", *counts, F.sha2(as_text(F.col(base)), 256).alias("base_sha256"), as_text(F.col(spans)).alias("spans"), F.size(spans).cast("long").alias("n_spans"))
