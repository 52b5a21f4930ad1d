"""Personal data: found by pattern, and terms that give it away found by information theory.

A protected entity is a value that the patterns find. A term near it discloses it as far as meeting the term
makes the entity likelier: PMI(term; entity) over the entity's own information content, both
estimated from counts over the whole corpus. How likely the entity is near the term is taken at the lower end of what the texts allow, so
a term met near it once says less than one that is met near it again and again, and nowhere else. Terms over the first threshold
are generalised, those over the second removed, wherever they stand in a text that has the entity.

DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from seqwatch.llm.common import free_name, store

# The base patterns. Possessive quantifiers and the look at what is before a match (or its being
# where the last one ended) find the same matches in linear time, without recursion.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = [*PATTERNS, "term"]
#: Code points on either side of an entity in which terms are counted as near.
CONTEXT = 120
#: Different texts in which a term must be met near an entity. In fewer it is judged only if it is written with a capital or a digit, as names and codes
#: are: of the words that a single text has by chance these are few.
SUPPORT = 2
#: Standard errors between the share of a term's places that are near an entity and the lower end that is counted on.
CONFIDENCE = 1.96
#: Disclosure from which terms are generalised, and from which they are removed.
GENERALISE, REMOVE = 0.8, 0.95
TERM = r"[\p{L}\p{M}\p{N}]++"
#: Words that are no terms of an entity near which they are always written so: mostly function words, which no count tells from names.
SMALL = r"^\p{Ll}{1,3}$"
MARKED = r"[\p{Lu}\p{Lt}\p{N}]"

SPAN = "struct<place:int,start:bigint,end:bigint,kind:string,token:string>"


@dataclass(frozen=True)
class Thresholds:
    """When a term near an entity is judged, and from which disclosure on it is generalised or removed."""

    support: int = SUPPORT
    confidence: float = CONFIDENCE
    generalise: float = GENERALISE
    remove: float = REMOVE


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", thresholds: Thresholds = Thresholds()) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term.

    Spans are kind:start:end in code points, the end exclusive, by kind (email, ip, card, phone, term) and start. ``base_sha256``
    is over those of the first four kinds. A null or empty text has none. Null and repeated ids are rows of their own; equal texts have equal spans.
    An empty table gives an empty result. Other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    scanned = scan(rows)
    spans = all_spans(rows, scanned, thresholds)
    joined = scanned.select("doc_id", "key").join(spans, "key", "left")
    base = F.filter("spans", lambda s: s["place"] < len(PATTERNS))

    def count(place: int) -> Column:
        found = F.size(F.filter("spans", lambda s: s["place"] == place))
        return F.when(F.col("spans").isNull(), 0).otherwise(found).cast("long")

    counts = {f"n_{kind}": count(place) for place, kind in enumerate(KINDS)}
    return joined.select(
        "doc_id", *[counts[f"n_{kind}"].alias(f"n_{kind}") for kind in PATTERNS],
        F.sha2(F.coalesce(_written(base), F.lit("")), 256).alias("base_sha256"),
        F.coalesce(_written(F.col("spans")), F.lit("")).alias("spans"), counts["n_term"].alias("n_term"),
    )


def sanitise(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: str = "n_chars", thresholds: Thresholds = Thresholds()
) -> DataFrame:
    """The documents with personal data replaced by its kind in brackets, and terms that disclose it generalised or removed.

    Texts without any keep as they are, null ones too; ``length``, if there is such a column, follows the new text.
    """
    names, key, found = docs.columns, free_name(docs, "_pii_key"), free_name(docs, "_pii_spans")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    spans = all_spans(rows, scan(rows), thresholds).withColumnsRenamed({"key": key, "spans": found})
    # Every base kind has an @ or a digit, so other texts need not be moved.
    may_have = F.coalesce(F.col(text).rlike("[@0-9]"), F.lit(False))
    touched = docs.where(may_have).withColumn(key, F.md5(text)).join(spans, key, "left")
    touched = touched.withColumn(text, F.when(F.col(found).isNull(), F.col(text)).otherwise(replaced(F.col(text), F.col(found))))
    if length in names:
        kind = docs.schema[length].dataType
        touched = touched.withColumn(length, F.when(F.col(found).isNull(), F.col(length)).otherwise(F.length(text).cast(kind)))
    return touched.drop(key, found).select(*[F.col(f"`{name}`") for name in names]).unionByName(docs.where(~may_have))


def replaced(text: Column, spans: Column) -> Column:
    """The text with the spans' tokens in their place. Where spans overlap the first has its token and the others lengthen it."""

    def step(acc: Column, span: Column) -> Column:
        free = span["start"] >= acc["at"]
        added = F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (span["start"] - acc["at"]).cast("int")), span["token"])
        return F.struct(F.when(free, added).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], span["end"]).alias("at"))

    in_order = F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["place"], s["end"], s["token"]))), lambda s: s)
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    return F.aggregate(
        in_order, start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))
    )


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


# Patterns


def scan(rows: DataFrame) -> DataFrame:
    """doc_id, key and, where a pattern matches, the text with the gaps and matches of each kind. The key stands for the text."""
    scanned = rows.withColumn("key", F.md5("text"))
    guard = {
        "email": F.col("text").contains("@"), "ip": F.col("text").contains("."),
        "card": F.lit(True), "phone": F.col("text").contains("+"),
    }
    scanned = scanned.select("*", *[
        F.when(guard[kind], F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias(kind) for kind, pattern in PATTERNS.items()
    ])
    # Most numbers are too short for a card; where all are, they need no places.
    long_enough = F.exists("card", lambda m: F.length(m) >= 16)
    wanted = {kind: F.size(kind) > 0 for kind in PATTERNS} | {"card": long_enough}
    wanted = {kind: F.coalesce(column, F.lit(False)) for kind, column in wanted.items()}
    pieces = {
        kind: F.when(wanted[kind], F.arrays_zip(F.split("text", pattern, -1).alias("gap"), F.col(kind).alias("value")))
        for kind, pattern in PATTERNS.items()
    }
    lengths = {
        kind: F.filter(
            F.transform(column, lambda p: F.struct(F.length(p["gap"]).alias("gap"), p["value"].alias("value"))), lambda p: p["value"].isNotNull()
        )
        for kind, column in pieces.items()
    }
    found = F.coalesce(*[F.when(column, True) for column in wanted.values()], F.lit(False))
    scanned = scanned.select("doc_id", "key", F.when(found, F.col("text")).alias("text"), *[column.alias(kind) for kind, column in lengths.items()])
    return store(scanned, "pii-scanned")


def base_spans(texts: DataFrame) -> DataFrame:
    """key, place (of the kind), start, end, value: the matches that pass their test, of different texts."""
    kinds = F.array(*[F.struct(F.lit(i).alias("place"), F.col(kind).alias("matches")) for i, kind in enumerate(PATTERNS)])
    matches = texts.select("key", F.explode(kinds).alias("k")).where("k.matches is not null")
    matches = matches.select("key", "k.place", F.posexplode("k.matches").alias("n", "m")).select("key", "place", "n", "m.gap", "m.value")
    before = Window.partitionBy("key", "place").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    matches = matches.withColumn("end", F.sum(F.col("gap") + F.length("value")).over(before))
    matches = matches.withColumn("start", F.col("end") - F.length("value"))
    digits = F.regexp_replace("value", "[^0-9]", "")
    matches = matches.withColumn("digits", digits).withColumn("n_digits", F.length("digits"))
    parts = F.transform(F.split("value", r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    passes = (
        F.when(F.col("place") == 0, True)
        .when(F.col("place") == 1, F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255"))))
        .when(F.col("place") == 2, F.when(F.col("n_digits").between(16, 19), luhn(F.col("digits"))).otherwise(False))
        .otherwise(F.col("n_digits").between(8, 15))
    )
    return matches.where(passes).select("key", "place", "start", "end", "value")


def luhn(digits: Column) -> Column:
    def worth(i: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return F.when(i % 2 == 1, twice).otherwise(digit)

    places = F.sequence(F.lit(0), F.length(digits) - 1)
    return F.aggregate(F.transform(places, worth), F.lit(0), lambda a, b: a + b) % 10 == 0


# Disclosure


def all_spans(rows: DataFrame, scanned: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """key, spans: for each text with personal data its base spans and those of disclosing terms, in order."""
    copies = F.count(F.lit(1)).alias("copies")
    texts = scanned.where("text is not null").groupBy("key").agg(copies, *[F.first(name).alias(name) for name in ("text", *PATTERNS)])
    texts = store(texts, "pii-texts")
    base = store(base_spans(texts), "pii-base")
    terms = disclosing_terms(rows, texts, base, thresholds)
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("place") + 1)
    token = F.coalesce(F.col("token"), F.concat(F.lit("["), F.upper(kind), F.lit("]")))
    spans = base.withColumn("token", F.lit(None).cast("string")).unionByName(terms, allowMissingColumns=True)
    span = F.struct("place", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), kind.alias("kind"), token.alias("token"))
    gathered = spans.select("key", span.alias("span")).groupBy("key").agg(F.array_sort(F.collect_list("span")).alias("spans"))
    # A term within a base span is part of it.
    bases = F.filter("spans", lambda s: s["place"] < len(PATTERNS))
    apart = F.filter(
        "spans", lambda s: (s["place"] < len(PATTERNS)) | ~F.exists(bases, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    )
    return store(gathered.select("key", apart.alias("spans")), "pii-spans")


def _entity() -> Column:
    value = F.when(F.col("place") == 0, F.lower("value")).otherwise(F.regexp_replace("value", "[^0-9.]", ""))
    return F.concat_ws(":", F.col("place").cast("string"), value)


def contexts(texts: DataFrame, base: DataFrame) -> DataFrame:
    """key, copies, entity, term, named, marked, start, end: the terms on either side of each entity, without words that the context's end cuts.

    A term that stands near an entity's value twice is there once.
    """
    near = base.withColumn("entity", _entity()).join(texts.select("key", "copies", "text"), "key")
    size = F.length("text")
    left_from, right_to = F.greatest(F.col("start") - CONTEXT, F.lit(0)), F.least(F.col("end") + CONTEXT, size)
    sides = F.array(
        F.struct(left_from.alias("from"), F.substring("text", (left_from + 1).cast("int"), (F.col("start") - left_from).cast("int")).alias("part"),
                 (left_from > 0).alias("cut_first"), F.lit(False).alias("cut_last")),
        F.struct(F.col("end").alias("from"), F.substring("text", (F.col("end") + 1).cast("int"), (right_to - F.col("end")).cast("int")).alias("part"),
                 F.lit(False).alias("cut_first"), (right_to < size).alias("cut_last")),
    )
    sides = near.select("key", "copies", "entity", F.explode(sides).alias("s")).select("key", "copies", "entity", "s.*")
    words, gaps = F.regexp_extract_all("part", F.lit(TERM), F.lit(0)), F.split("part", TERM, -1)
    # A context has few words, so that their places can be added up in it.
    ends = F.transform(
        F.sequence(F.lit(1), F.size(words)),
        lambda i: F.aggregate(F.slice(F.zip_with(gaps, words, lambda g, w: F.length(g) + F.coalesce(F.length(w), F.lit(0))), F.lit(1), i), F.lit(0), lambda a, b: a + b),
    )
    placed = sides.withColumn("words", words).where(F.size("words") > 0)
    placed = placed.select("key", "copies", "entity", "from", F.length("part").alias("n"), "cut_first", "cut_last", F.explode(F.arrays_zip(F.col("words").alias("w"), ends.alias("e"))).alias("t"))
    placed = placed.withColumn("end", F.col("from") + F.col("t.e")).withColumn("start", F.col("end") - F.length("t.w"))
    whole = ~(F.col("cut_first") & (F.col("start") == F.col("from"))) & ~(F.col("cut_last") & (F.col("t.e") == F.col("n")))
    told = {"named": ~F.rlike("t.w", F.lit(SMALL)), "marked": F.rlike("t.w", F.lit(MARKED))}
    return placed.where(whole).select("key", "copies", "entity", F.lower("t.w").alias("term"), *[c.alias(n) for n, c in told.items()], "start", "end").distinct()


def places(texts: DataFrame) -> DataFrame:
    """key, term, start, end: all terms of different texts."""
    gaps = F.transform(F.split("text", TERM, -1), lambda g: F.length(g))
    words = texts.select("key", F.posexplode(F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all("text", F.lit(TERM), F.lit(0)).alias("word"))).alias("n", "m"))
    words = words.select("key", "n", "m.gap", "m.word").where("word is not null")
    before = Window.partitionBy("key").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    words = words.withColumn("end", F.sum(F.col("gap") + F.length("word")).over(before))
    return words.select("key", F.lower("word").alias("term"), (F.col("end") - F.length("word")).alias("start"), "end")


def disclosing_terms(rows: DataFrame, texts: DataFrame, base: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """key, place, start, end, token: the terms whose disclosure of an entity of their text is over a threshold."""
    near = store(contexts(texts, base), "pii-contexts")
    # Different texts first, so that a hot entity gathers no more than these. They are the support, and what the entity's own information is
    # taken from; a term's places near an entity and elsewhere are counted over the corpus as it is, copies included.
    told = [F.max(name).alias(name) for name in ("named", "marked")]
    pairs = near.groupBy("entity", "term", "key").agg(F.count(F.lit(1)).alias("once"), F.first("copies").alias("copies"), *told)
    joint = F.sum(F.col("once") * F.col("copies")).alias("joint")
    pairs = pairs.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("texts"), joint, F.sum("once").alias("once"), *told)
    pairs = store(pairs, "pii-pairs")
    about = pairs.groupBy("entity").agg(F.sum("once").alias("entity_n"))
    candidates = store(pairs.where(F.col("named") & ((F.col("texts") >= thresholds.support) | F.col("marked"))), "pii-candidates")
    counts = store(term_counts(rows), "pii-terms")
    total = counts.agg(F.coalesce(F.sum("term_n"), F.lit(0))).scalar()
    judged = candidates.join(store(about, "pii-entities"), "entity").join(counts, "term").withColumn("total", total)
    content = F.log(F.col("total") / F.col("entity_n"))
    pmi = content + F.log(least_share(F.col("joint") / F.col("term_n"), F.col("texts"), thresholds.confidence))
    judged = judged.withColumn("disclosure", F.when(content > 0, pmi / content).otherwise(0.0)).where(F.col("disclosure") >= thresholds.generalise)
    judged = store(judged.select("entity", "term", "disclosure"), "pii-disclosing")
    # Terms are looked up before entities are, so that a hot entity's texts never meet all of its terms.
    held = base.select("key", _entity().alias("entity")).distinct().join(judged.select("entity").distinct(), "entity", "left_semi")
    held = store(held, "pii-held")
    placed = places(texts.select("key", "text").join(held.select("key").distinct(), "key", "left_semi")).join(judged, "term")
    told = placed.join(held, ["key", "entity"], "left_semi").groupBy("key", "start", "end").agg(F.max("disclosure").alias("disclosure"))
    token = F.when(F.col("disclosure") >= thresholds.remove, "").otherwise("[TERM]")
    return told.select("key", F.lit(len(PATTERNS)).alias("place"), "start", "end", token.alias("token"))


def least_share(share: Column, texts: Column, confidence: float) -> Column:
    """The lower end of Wilson's interval for the share of a term's places near an entity.

    Evidence is counted in different texts: those with the term near the entity, and in proportion those with it elsewhere. Copies add none.
    """
    share = F.least(share, F.lit(1.0))
    n, z2 = texts / share, confidence * confidence
    half = confidence * F.sqrt(share * (1 - share) / n + z2 / (4 * n * n))
    return (share + z2 / (2 * n) - half) / (1 + z2 / n)


def term_counts(rows: DataFrame) -> DataFrame:
    """term, term_n: how often each term is in the corpus, copies of texts included."""
    words = rows.select(F.explode(F.regexp_extract_all("text", F.lit(TERM), F.lit(0))).alias("word")).select(F.lower("word").alias("term"))
    return words.groupBy("term").agg(F.count(F.lit(1)).alias("term_n"))
