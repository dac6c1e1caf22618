"""Personal data by patterns, and information-theoretic sanitisation of terms that reveal it.

Base spans are e-mail addresses, IP addresses, card and phone numbers. Protected entities are these values and, for
addresses, their domains. A term t reveals an entity e as far as knowing t tells that e is there:

    disclosure(e, t) = PMI(e; t) / IC(e) = log(p(e, t) / (p(e) p(t))) / -log p(e),

with document frequencies over the whole corpus, all of them over distinct texts, so that copies of one text count once; it
is 1 where t occurs with e only. Two kinds of terms co-occur with e: words of a window around it, where fewer than `support`
distinct windows are no evidence; and the names that an address is written with, for which the address itself is the
evidence. A window is up to six words on each side, and ends at the next base span. In all documents, those that do not
spell e out included, terms with a disclosure of `generalise` or more are replaced by a general label, and those of
`remove` or more are removed. Everything is DataFrame functions; no Python runs on the executors.

The patterns are written with possessive loops and look-behinds, which match just what the plain ones do, in time linear
in the text and without recursion. Running totals over a text's spans are carried from block to block, and pieces of text
are cut from its UTF-32 bytes, where a place is found without counting, so that time is linear in the spans too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, unique_name

KINDS = ("email", "ip", "card", "phone", "term")
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Whole runs of digits with single separators that have 14 to 19 digits.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_PART = r"^0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?)?$"
SPANS = "array<struct<start:bigint,kind:int,end:bigint,value:string>>"
#: Elements of one block of running totals.
STEP = 64
#: Rows that are broadcast at most; more are joined by shuffles.
FEW = 200_000


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, also where the body uses it within a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(values: Column, combine: Callable[[Column, Column], Column], zero: int = 0) -> Column:
    """For each element of an array of longs, the combination of all elements before it; zero for the first."""
    first = F.lit(zero).cast("long")
    none = F.array().cast("array<bigint>")

    def carry(part: Column, start: Column) -> Column:
        begin = F.struct(start.alias("at"), none.alias("all"))
        return F.aggregate(part, begin, lambda acc, x: F.struct(combine(acc.at, x).alias("at"), F.concat(acc.all, F.array(acc.at)).alias("all")), lambda acc: acc.all)

    def whole(v: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / STEP).cast("int"))
        part = lambda b: F.slice(v, b * STEP + 1, STEP)
        totals = F.transform(blocks, lambda b: F.aggregate(part(b), first, combine))
        return _let(carry(totals, first), lambda starts: F.flatten(F.transform(blocks, lambda b: carry(part(b), F.get(starts, b)))))

    return F.when(F.size(values) > 0, _let(values, whole)).otherwise(none)


def _max(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _least(a: Column, b: Column) -> Column:
    return F.least(a, b)


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _with_matches(df: DataFrame, text: str, pattern: str | Column, gate: Column, kind: int, valid, out: str) -> DataFrame:
    """Adds out: the spans of all valid matches of pattern in text; texts that fail the gate have none."""
    found = unique_name(df, f"found_{out}")
    none = F.array().cast("array<string>")
    df = df.withColumn(found, F.when(gate, F.regexp_extract_all(F.col(text), pattern if isinstance(pattern, Column) else F.lit(pattern), F.lit(0))).otherwise(none))
    # before match i come the pieces up to i and the matches up to i - 1
    pieces = F.transform(F.split(F.col(text), pattern, -1), lambda p: F.length(p).cast("long"))

    def spans(p: Column, matches: Column) -> Column:
        both = F.zip_with(F.slice(p, F.lit(1), F.size(matches)), matches, lambda n, m: n + F.length(m))

        def span(m: Column, i: Column, before: Column) -> Column:
            start = F.get(before, i) + F.get(p, i)
            return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(m)).alias("end"), m.alias("value"))

        return _let(_running(both, _sum), lambda before: F.transform(matches, lambda m, i: span(m, i, before)))

    whole = _let(pieces, lambda p: _let(F.col(found), lambda m: spans(p, m)))
    return df.withColumn(out, F.when(F.size(found) > 0, F.filter(whole, lambda s: valid(s.value)).cast(SPANS)).otherwise(F.array().cast(SPANS))).drop(found)


def _points(text: Column) -> Column:
    """The text's code points, four bytes each."""
    return F.encode(text, "UTF-32")


def _cut(points: Column, start: Column, end: Column) -> Column:
    """The text from code point `start` to before `end`; empty where there is none between."""
    return F.decode(F.substring(points, (start * 4 + 1).cast("int"), (F.greatest(end - start, F.lit(0)) * 4).cast("int")), "UTF-32")


def _reached(spans: Column) -> Column:
    """For each span, by start, the greatest end of the spans before it."""
    return _running(F.transform(spans, lambda s: s.end), _max)


def _luhn(match: Column) -> Column:
    digits = F.regexp_replace(match, r"[\x20-]", "")
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def with_base_spans(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds out: base spans (start, kind, end in code points, value) by start, then kind. A null text has none."""
    names = {k: unique_name(df, f"{k}_spans") for k in KINDS[:4]}
    t = F.col(text)
    digit = t.rlike("[0-9]")
    df = _with_matches(df, text, EMAIL, t.contains("@"), 0, lambda m: F.lit(True), names["email"])
    df = _with_matches(df, text, IP, digit & t.contains("."), 1, lambda m: F.forall(F.split(m, r"\."), lambda p: p.rlike(IP_PART)), names["ip"])
    df = _with_matches(df, text, CARD, digit, 2, _luhn, names["card"])
    df = _with_matches(df, text, PHONE, t.contains("+"), 3, lambda m: F.length(F.regexp_replace(m, "[^0-9]", "")).between(10, 15), names["phone"])
    return df.withColumn(out, F.sort_array(F.concat(*[F.col(n) for n in names.values()]))).drop(*names.values())


def _entity(span: Column) -> Column:
    """A value of a kind, however written."""
    return F.concat(span.kind.cast("string"), F.lit(":"), F.when(span.kind == 0, F.lower(span.value)).when(span.kind == 1, span.value).otherwise(F.regexp_replace(span.value, "[^0-9]", "")))


def _text_key(text: Column) -> Column:
    """Equal for equal texts only; null for a null text."""
    return F.when(text.isNotNull(), F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b")))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: F.length(w) > 2)


def _domain(span: Column) -> Column:
    return F.concat(F.lit("0:@"), F.lower(F.substring_index(span.value, "@", -1)))


def _entities(span: Column) -> Column:
    return F.when(span.kind == 0, F.array(_entity(span), _domain(span))).otherwise(F.array(_entity(span)))


def _windows(found: DataFrame, window: int) -> DataFrame:
    """(key, entities, names, terms) of each base span: the entities it is of, the names it is written with, and the words of
    its window."""
    n = F.size("spans")

    def around(points: Column, reached: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            after = F.when(i + 1 < n, F.get(F.col("spans"), i + 1).start).otherwise(F.lit(1 << 28).cast("long"))
            left, right = _words(_cut(points, F.get(reached, i), s.start)), _words(_cut(points, F.greatest(s.end, F.get(reached, i)), after))
            terms = F.concat(F.reverse(F.slice(F.reverse(left), 1, window)), F.slice(right, 1, window))
            names = F.when(s.kind == 0, _words(F.substring_index(s.value, "@", 1))).otherwise(F.array().cast("array<string>"))
            return F.struct(_entities(s).alias("entities"), F.array_distinct(names).alias("names"), F.array_distinct(terms).alias("terms"))

        return F.transform("spans", one)

    all_ = _let(_points(F.col("text")), lambda p: _let(_reached(F.col("spans")), lambda r: around(p, r)))
    return found.select("key", F.explode(all_).alias("w")).select("key", "w.*")


def disclosing_terms(found: DataFrame, docs: DataFrame, text_col: str, window: int = 6, support: int = 3, generalise: float = 0.8) -> tuple[DataFrame, DataFrame] | None:
    """(entity, term, disclosure) for the terms that reveal an entity by `generalise` or more, and (term, key) for the
    distinct texts among all documents that have such a term or one that came near it; None where no term comes near.

    found: key, text and spans of the documents with base spans; docs: all documents, for the terms' frequencies. All
    counts are of distinct texts.
    """
    found = materialize(found.dropDuplicates(["key"]))
    near = materialize(_windows(found, window))
    each = near.select("key", F.explode("entities").alias("entity"), F.xxhash64("terms").alias("window"), "terms").select("key", "entity", "window", F.explode("terms").alias("term"))
    beside = each.groupBy("entity", "term").agg(F.count_distinct("window").alias("windows"), F.count_distinct("key").alias("joint")).filter(F.col("windows") >= support).drop("windows")
    within = near.select("key", F.get("entities", F.lit(0)).alias("entity"), F.explode("names").alias("term")).groupBy("entity", "term").agg(F.count_distinct("key").alias("joint"))
    # a name may also be a window's word: the address itself is the better evidence, and counts no less
    pairs = beside.unionByName(within).groupBy("entity", "term").agg(F.max("joint").alias("joint"))
    n = docs.select(_text_key(F.col(text_col)).alias("key")).filter("key IS NOT NULL").distinct().count()
    holders = found.select(F.explode(F.array_distinct(F.flatten(F.transform("spans", _entities)))).alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    # a disclosure of `generalise` needs n_term <= joint * (n / n_entity) ** (1 - generalise). The texts with base spans
    # that have the term are some of n_term already, so this drops no term that could reach it
    own = found.select(F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_least"))
    pairs = pairs.join(holders, "entity").join(own, "term").filter(F.col("n_least") <= F.col("joint") * F.pow(F.lit(float(n)) / F.col("n_entity"), F.lit(1 - generalise)) * 1.000001)
    pairs = materialize(pairs.select("entity", "term", "joint", "n_entity"))
    terms = pairs.select("term").distinct()
    few = pairs.count()
    if few == 0:
        return None
    every = docs.select(_text_key(F.col(text_col)).alias("key"), F.explode(F.array_distinct(F.split(F.lower(F.col(text_col)), r"[^\p{L}]+"))).alias("term"))
    hits = materialize(every.join(F.broadcast(terms) if few <= FEW else terms, "term", "left_semi").distinct())
    frequency = hits.groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    rated = pairs.join(frequency, "term")
    joint = F.least(F.col("joint"), F.col("n_term"), F.col("n_entity"))
    ic = F.greatest(-F.log(F.col("n_entity") / n), F.lit(1e-9))
    pmi = F.log(joint * F.lit(float(n)) / (F.col("n_entity") * F.col("n_term")))
    return rated.select("entity", "term", (pmi / ic).alias("disclosure")).filter(F.col("disclosure") >= generalise), hits


def _outside(base: Column, marked: Column) -> Column:
    """The marked spans that overlap no base span."""
    far = 1 << 40

    def kept(spans: Column) -> Column:
        is_base = lambda s: s.kind < 4
        before = _running(F.transform(spans, lambda s: F.when(is_base(s), s.end).otherwise(F.lit(0).cast("long"))), _max)
        after = F.reverse(_running(F.transform(F.reverse(spans), lambda s: F.when(is_base(s), s.start).otherwise(F.lit(far).cast("long"))), _least, far))
        return _let(before, lambda b: _let(after, lambda a: F.filter(spans, lambda s, i: ~is_base(s) & (F.get(b, i) <= s.start) & (F.get(a, i) >= s.end))))

    return F.when((F.size(base) == 0) | (F.size(marked) == 0), marked).otherwise(_let(F.sort_array(F.concat(base, marked)), kept))


def find_personal_data(docs: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), generalise: float = 0.8, remove: float = 0.95, keep_text: bool = False) -> DataFrame:
    """The columns `carry` of each document with base, terms (arrays of spans) and text: the whole text where keep_text
    is set, else only that of documents with base spans.

    Null and empty texts have no spans. Repeated rows each keep a row. Base spans of different kinds may overlap, and all
    stay; a term that overlaps one goes. Columns outside `carry` and text are not read, so their names do not matter.
    Texts may have any length and any number of spans; an empty table gives an empty one.
    """
    row = docs.select(F.struct(*[docs[f"`{c}`"] for c in carry]).alias("row"), F.col(text_col).alias("text"))
    row = with_base_spans(row, "text", "base")
    text = F.col("text") if keep_text else F.when(F.size("base") > 0, F.col("text"))
    scanned = materialize(row.select("row", "base", text.alias("text"), _text_key(F.col("text")).alias("key")))
    found = scanned.filter(F.size("base") > 0)
    rated = disclosing_terms(found.select("key", "text", F.col("base").alias("spans")), docs, text_col, generalise=generalise)
    terms = materialize(rated[0].groupBy("term").agg(F.max("disclosure").alias("d"))) if rated else None
    if terms is None or terms.isEmpty():
        return scanned.select("row", "base", F.array().cast(SPANS).alias("terms"), "text")
    # a term reveals its entity most where the text does not spell that out, so it is looked for in every text
    few = F.broadcast(terms) if terms.count() <= FEW else terms
    revealed = materialize(rated[1].join(few, "term").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("term", "d"))).alias("words")))
    small = revealed.agg(F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("n")).first().n <= FEW
    hit = docs.select(_text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text")).join(F.broadcast(revealed) if small else revealed, "key")
    # only the text's own terms are matched: to match all words of a long text would cost far more
    own = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.map_keys("words"), "|"), F.lit(r")(?!\p{L})"))
    hit = _with_matches(hit, "text", own, F.lit(True), 4, lambda m: F.map_contains_key(F.col("words"), F.lower(m)), "terms")
    # where the disclosure asks for removal, the value is empty; else it is the label that stands for the term
    hit = hit.withColumn("terms", F.transform("terms", lambda s: F.struct(s.start, s.kind, s.end, F.when(F.element_at(F.col("words"), F.lower(s.value)) >= remove, F.lit("")).otherwise(F.lit("[TERM]")).alias("value"))).cast(SPANS))
    marks = materialize(hit.select(F.col("key").alias("k"), F.col("terms").alias("marked")).distinct())
    small = marks.agg(F.coalesce(F.sum(F.size("marked")), F.lit(0)).alias("n")).first().n <= FEW
    marked = scanned.join(F.broadcast(marks) if small else marks, scanned.key == F.col("k"), "left").withColumn("marked", F.coalesce("marked", F.array().cast(SPANS)))
    return marked.select("row", "base", _outside(F.col("base"), F.col("marked")).alias("terms"), "text")


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start.cast("string"), s.end.cast("string"))), ",")


def sanitise(docs: DataFrame) -> DataFrame:
    """The documents, all columns, with base spans replaced by their kind's label and disclosing terms generalised or
    removed; a column n_chars is brought up to date where text changes. Other texts stay as they are.

    Null and empty texts stay so; repeated rows stay repeated. Of overlapping spans the one that starts first is replaced
    (at one place: in the order e-mail, ip, card, phone), and the rest of the others stays out of the text only as far as
    that one reaches."""
    rows = find_personal_data(docs, carry=tuple(c for c in docs.columns if c != "text"), keep_text=True)
    labels = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    rows = rows.withColumn("spans", F.sort_array(F.concat("base", "terms")))
    spans = F.col("spans")

    def pieces(points: Column, reached: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            label = F.when(s.kind == 4, s.value).otherwise(F.get(labels, s.kind))
            return F.when(s.start >= F.get(reached, i), F.concat(_cut(points, F.get(reached, i), s.start), label)).otherwise(F.lit(""))

        rest = _cut(points, F.array_max(F.transform(spans, lambda s: s.end)), F.lit(1 << 28).cast("long"))
        return F.concat(F.array_join(F.transform(spans, piece), ""), rest)

    clean = _let(_points(F.col("text")), lambda p: _let(_reached(spans), lambda r: pieces(p, r)))
    rows = rows.withColumn("changed", F.size(spans) > 0).withColumn("clean", F.when(F.col("changed"), clean).otherwise(F.col("text")))
    cols = [F.col("clean").alias("text") if c == "text" else F.when(F.col("changed"), F.length("clean").cast("long")).otherwise(F.col("row")[c]).alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in docs.columns]
    return rows.select(*cols)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find_personal_data(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("long")
    return rows.select(
        F.col("row.doc_id").alias("doc_id"),
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.sort_array(F.concat("base", "terms"))).alias("spans"),
    )
