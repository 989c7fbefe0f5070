"""PII and information-theoretic sanitisation (operator 2), in DataFrame functions only.

Personal data is found by pattern and forms the protected entities. Beside each mention stand terms; how much a term t
discloses about an entity e is their pointwise mutual information over the corpus,
    PMI(e, t) = log2(N * n(e, t) / (n(e) * n(t))),
held against the entity's own information IC(e) = log2(N / n(e)). The share PMI / IC is 1 if the term occurs nowhere but
with the entity. Terms that stand with the entity in at least SUPPORT different texts are removed where the share reaches REMOVE and
generalised where it reaches GENERALISE, wherever they stand in a document that mentions the entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

# \G continues where the last match ended and the look-behind skips starts in the middle of a run; possessive repeats
# (++) never give back. Both leave the matches as they are and the time linear in the text's length.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to occur; the others need a digit.
NEEDS = {"email": "@", "phone": "+"}
TAGS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "generalise": "[TERM]", "remove": ""}
KINDS = list(TAGS)
#: Words on either side of a mention that count as standing with it.
NEAR = 6
SUPPORT, GENERALISE, REMOVE = 3, 0.8, 0.95
#: Characters of a piece of text: a power of two.
PIECE_BITS = 10
PIECE = 1 << PIECE_BITS
#: Parts an entity from a term; neither holds it.
_BREAK = "\u0001"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
_WORD = r"[\p{L}\p{M}]{3,}"


def _let(value: Column, f) -> Column:
    """f(value), with the value computed once: what a lambda refers to is else computed again for each element."""
    return F.get(F.transform(F.array(value), f), 0)


def _scan(values: Column, op, zero: int = 0) -> Column:
    """Inclusive running results of op over an array, by doubling: each round takes in the value 1, 2, 4, ... places before."""
    rounds = lambda a: F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(a), F.lit(1)).cast("double"))).cast("int"))
    step = lambda a, r: F.transform(a, lambda x, i: op(x, F.coalesce(F.get(a, i - F.call_function("shiftleft", F.lit(1), r)), F.lit(zero))))
    return _let(values, lambda a: F.aggregate(rounds(a), a, step))


def _spans(text: Column, pattern: Column | str) -> Column:
    """(start, end, value) of each match, in code points: a text is its matches and the parts between them."""
    regex = F.lit(pattern) if isinstance(pattern, str) else pattern
    parts = F.arrays_zip(F.regexp_extract_all(text, regex, F.lit(0)).alias("v"), F.split(text, regex, -1).alias("b"))

    def placed(found: Column) -> Column:
        ends = _scan(F.transform(found, lambda z: F.length(z["b"]) + F.length(z["v"])), lambda x, y: x + y)
        return F.transform(F.arrays_zip(ends.alias("e"), found.alias("z")), lambda y: F.struct((y["e"] - F.length(y["z"]["v"])).alias("start"), y["e"].alias("end"), y["z"]["v"].alias("value")))

    return _let(F.filter(parts, lambda z: z["v"].isNotNull()), placed)


def _pieces(text: Column) -> Column:
    """A text in pieces of PIECE characters, so that a part of it is found without counting from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def _part(pieces: Column, start: Column, end: Column) -> Column:
    """The characters from start up to end."""
    first = F.call_function("shiftright", start, F.lit(PIECE_BITS))
    count = F.call_function("shiftright", end, F.lit(PIECE_BITS)) - first + 1
    return F.substring(F.array_join(F.slice(pieces, first + 1, count), ""), start - first * PIECE + 1, end - start)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    backwards = F.split(F.reverse(_digits(x)), "")
    value = F.transform(backwards, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int") + 1)))
    return F.aggregate(value, F.lit(0), lambda a, v: a + v) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return x.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.length(_digits(x)).between(14, 19) & _luhn(x)
    if kind == "phone":
        return F.length(_digits(x)).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """The base rules' spans of a text: an array of (start, kind, end, value) by start, then kind in the order of KINDS."""
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    parts = []
    for i, kind in enumerate(PATTERNS):
        possible = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else text.rlike("[0-9]")
        parts.append(F.when(possible, _of_kind(text, i, kind)).otherwise(empty))
    return F.sort_array(F.concat(*parts))


def _of_kind(text: Column, i: int, kind: str) -> Column:
    fine = F.filter(_spans(text, PATTERNS[kind]), lambda z: _valid(kind, z["value"]))
    return F.transform(fine, lambda z: F.struct(z["start"].alias("start"), F.lit(i).alias("kind"), z["end"].alias("end"), z["value"].alias("value")))


def _entity(kind: Column, value: Column) -> Column:
    return F.concat(kind.cast("string"), F.lit(":"), F.when(kind == 0, F.lower(value)).when(kind == 1, value).otherwise(_digits(value)))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda z: F.concat_ws(":", F.element_at(names, z["kind"] + 1), z["start"], z["end"])), ",")


def _words(text: Column) -> Column:
    """A text's terms: runs of three or more letters, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))


def masked(text: Column, spans: Column) -> Column:
    """The text with spans, which are in order, blank; every other character stays at its place."""

    def joined(p: Column, s: Column, at: Column) -> Column:
        begin = lambda z: F.greatest(z["s"]["start"], z["at"])
        before = F.arrays_zip(s.alias("s"), at.alias("to"), F.concat(F.array(F.lit(0)), F.slice(at, 1, F.size(at) - 1)).alias("at"))
        parts = F.transform(before, lambda z: F.concat(_part(p, z["at"], begin(z)), F.repeat(F.lit(" "), z["to"] - begin(z))))
        return F.concat(F.array_join(parts, ""), F.substring(text, F.element_at(at, -1) + 1, F.length(text)))

    furthest = _scan(F.transform(spans, lambda z: z["end"]), lambda x, y: F.greatest(x, y))
    return _let(_pieces(text), lambda p: _let(furthest, lambda at: joined(p, spans, at)))


def mentions(found: DataFrame) -> DataFrame:
    """(th, e, t), once for each row of found: the terms t up to NEAR words to either side of a mention of e, however long."""

    def near(w: Column, z: Column, n: Column) -> Column:
        terms = F.concat(F.slice(w, F.greatest(n - NEAR, F.lit(0)) + 1, F.least(n, F.lit(NEAR))), F.slice(w, n + 1, NEAR))
        return F.struct(_entity(z["kind"], z["value"]).alias("e"), F.array_distinct(terms).alias("t"))

    def beside(w: Column, base: Column) -> Column:
        places = lambda spans, i: F.transform(spans, lambda z: F.struct(z["start"].alias("at"), F.lit(i).alias("word")))
        order = F.sort_array(F.concat(places(base, 0), places(w, 1)))
        mine = F.filter(F.transform(order, lambda y, j: F.struct(y["word"].alias("word"), j.alias("j"))), lambda y: y["word"] == 0)
        # how many words come before each mention
        rank = F.transform(mine, lambda y, i: y["j"] - i)
        return _let(F.transform(w, lambda z: F.lower(z["value"])), lambda v: F.transform(F.arrays_zip(base.alias("z"), rank.alias("n")), lambda y: near(v, y["z"], y["n"])))

    # a pair counts once for each row; as one string, which array_distinct takes in linear time
    pairs = lambda m: F.transform(m["t"], lambda t: F.concat(m["e"], F.lit(_BREAK), t))
    of_row = F.array_distinct(F.flatten(_let(_spans(F.col("masked"), _WORD), lambda w: F.transform(beside(w, F.col("base")), pairs))))
    parts = F.split(F.col("p"), _BREAK)
    return found.select("th", F.explode(of_row).alias("p")).select("th", parts[0].alias("e"), parts[1].alias("t"))


def disclosing(docs: DataFrame, found: DataFrame, pairs: DataFrame) -> DataFrame:
    """(e, t, kind) of the terms that disclose too much; kind is their place in KINDS.

    Counts are of rows in the whole table, all four of them, so that a table that is repeated as a whole gives the same shares.
    SUPPORT is of different texts: a text that is copied a thousand times is evidence once.
    """
    joint = pairs.groupBy("e", "t").agg(F.count("*").alias("n_et"), F.count_distinct("th").alias("texts")).filter(F.col("texts") >= SUPPORT)
    entities = found.select(F.explode(F.array_distinct(F.transform("base", lambda z: _entity(z["kind"], z["value"])))).alias("e")).groupBy("e").agg(F.count("*").alias("n_e"))
    texts = docs.filter(F.col("text").isNotNull()).select(F.col("text").cast("string").alias("text"))
    words = texts.select(F.explode(F.array_distinct(_words(F.col("text")))).alias("t"))
    # words that only personal data joins to other letters
    parted = found.select(F.explode(F.array_except(_words(F.col("masked")), _words(F.col("text")))).alias("t"))
    words = words.unionAll(parted).groupBy("t").agg(F.count("*").alias("n_t"))
    total = texts.agg(F.count("*").alias("n"))
    n = float(total.first()[0])
    scored = joint.join(entities, "e").join(words, "t")
    pmi = F.log2(F.lit(n) * F.col("n_et") / (F.col("n_e") * F.col("n_t")))
    own = F.log2(F.lit(n) / F.col("n_e"))
    share = F.when(own > 0, F.least(pmi / own, F.lit(1.0)))
    kind = F.when(share >= REMOVE, KINDS.index("remove")).when(share >= GENERALISE, KINDS.index("generalise"))
    return scored.select("e", "t", kind.alias("kind")).filter("kind IS NOT NULL")


def _pattern(terms: Column) -> Column:
    return F.concat(F.lit(r"(?iu)(?<![\p{L}\p{M}])(?:"), F.array_join(terms, "|"), F.lit(r")(?![\p{L}\p{M}])"))


def _as_kind(spans: Column, i: int | None) -> Column:
    return F.transform(spans, lambda z: F.struct(z["start"].alias("start"), z["kind"].alias("kind") if i is None else F.lit(i).alias("kind"), z["end"].alias("end")))


def analysed(docs: DataFrame) -> DataFrame:
    """doc_id, th, base (the base spans) and spans (all of them) of every row; its text where there are any, else null."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("th", F.xxhash64("text"))
    rows = rows.withColumn("base", base_spans(F.col("text")))
    found = stored(rows.select("doc_id", "th", "base", *[F.when(F.size("base") > 0, c).alias(k) for k, c in (("text", F.col("text")), ("masked", masked(F.col("text"), F.col("base"))))]), "personal")
    with_any = found.filter(F.size("base") > 0)
    terms = stored(disclosing(docs, with_any, mentions(with_any)), "disclosing")
    of_kind = lambda k: F.collect_set(F.when(F.col("kind") == KINDS.index(k), F.col("t"))).alias(k)
    by_entity = terms.groupBy("e").agg(of_kind("generalise"), of_kind("remove"))
    entities = with_any.select("doc_id", "th", F.explode(F.array_distinct(F.transform("base", lambda z: _entity(z["kind"], z["value"])))).alias("e")).distinct()
    together = lambda k: F.array_distinct(F.flatten(F.collect_list(k))).alias(k)
    flagged = entities.join(by_entity, "e").groupBy("doc_id", "th").agg(together("generalise"), together("remove"))
    # where two entities differ, a term is removed
    flagged = flagged.withColumn("generalise", F.array_except("generalise", "remove"))
    # null-safe: a row with a null doc_id is named by its text
    key = F.struct(F.coalesce("doc_id", F.lit(0)).alias("i"), F.col("doc_id").isNull().alias("n"), "th")
    joined = with_any.withColumn("key", key).join(flagged.select(key.alias("key"), "generalise", "remove"), "key", "left")
    held = _let(_words(F.col("masked")), lambda w: F.struct(*[F.sort_array(F.array_intersect(w, F.col(k))).alias(k) for k in ("generalise", "remove")]))
    joined = joined.withColumn("held", held).select("doc_id", "th", "text", "masked", "base", "held.*")
    more = []
    for k in ("generalise", "remove"):
        none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
        more.append(F.when(F.size(k) > 0, _as_kind(_spans(F.col("masked"), _pattern(F.col(k))), KINDS.index(k))).otherwise(none))
    plain = _as_kind(F.col("base"), None)
    hit = joined.select("doc_id", "th", "text", plain.alias("base"), *[m.alias(k) for m, k in zip(more, ("generalise", "remove"), strict=True)])
    hit = hit.select("doc_id", "th", "text", "base", F.sort_array(F.concat("base", "generalise", "remove")).alias("spans"))
    clean = found.filter(F.size("base") == 0).select("doc_id", "th", "text", plain.alias("base"), plain.alias("spans"))
    return hit.unionAll(clean)


def _count(spans: Column, i: int) -> Column:
    return F.size(F.filter(spans, lambda z: z["kind"] == i)).cast("long")


def sanitise(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms and sanitised of every row.

    `spans` has the base spans and those of disclosing terms, of kinds generalise and remove; `sanitised` is the text with
    its spans replaced, null where there are none and the text stays as it is. Null text counts as empty. A null doc_id is
    kept; repeated rows each give a row; other columns are ignored; an empty table gives no rows. Offsets are code points.
    """
    rows = analysed(docs).withColumn("sanitised", F.when(F.size("spans") > 0, replaced(F.col("text"), F.col("spans"))))
    counts = [_count(F.col("base"), i).alias(f"n_{k}") for i, k in enumerate(PATTERNS)]
    return rows.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_terms"), "sanitised")


def replaced(text: Column, spans: Column) -> Column:
    """The text with each span as its kind's tag; spans that overlap become one, with the tag of the first."""
    tags = F.array(*[F.lit(t) for t in TAGS.values()])

    def joined(p: Column, s: Column, at: Column) -> Column:
        part = lambda z: F.concat(_part(p, z["at"], z["s"]["start"]), F.element_at(tags, z["s"]["kind"] + 1))
        before = F.arrays_zip(s.alias("s"), F.concat(F.array(F.lit(0)), F.slice(at, 1, F.size(at) - 1)).alias("at"))
        parts = F.transform(F.filter(before, lambda z: z["s"]["start"] >= z["at"]), part)
        return F.concat(F.array_join(parts, ""), F.substring(text, F.element_at(at, -1) + 1, F.length(text)))

    furthest = lambda s: _scan(F.transform(s, lambda z: z["end"]), lambda x, y: F.greatest(x, y))
    new = _let(_pieces(text), lambda p: _let(spans, lambda s: _let(furthest(s), lambda at: joined(p, s, at))))
    return F.when(F.size(spans) > 0, new).otherwise(text)


def sanitised(docs: DataFrame) -> DataFrame:
    """docs with the sanitised text, and its n_chars, where a text has spans."""
    rows = analysed(docs).filter(F.size("spans") > 0).select("doc_id", "th", replaced(F.col("text"), F.col("spans")).alias("__new")).dropDuplicates(["doc_id", "th"])
    key = lambda i, th: F.struct(F.coalesce(i.cast("long"), F.lit(0)).alias("i"), i.isNull().alias("n"), th.alias("th"))
    names = docs.columns
    th = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    out = docs.withColumn("__key", key(F.col("doc_id"), th)).join(rows.select(key(F.col("doc_id"), F.col("th")).alias("__key"), "__new"), "__key", "left")
    out = out.withColumn("text", F.coalesce("__new", "text"))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("__new").isNotNull(), F.length("__new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*names)


def op2_information_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise(table(spark, sf_dir, "documents"))
