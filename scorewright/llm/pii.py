"""Personal data by pattern, and the terms around it that give it away.

Base: e-mail, IP, card and phone by pattern. Method: information-theoretic sanitisation. A protected entity e is a
value that a pattern finds; a term t is a word anywhere in a document that holds it. Over the corpus, PMI(e; t) = log2(p(e, t) / p(e) p(t))
says how much of the entity's information IC(e) = -log2 p(e) the term reveals. A term that reveals at least
GENERALISE of it is generalised wherever it stands in such a document; from REMOVE on it is removed. Every pair is judged, also one seen once: p(e | t)
is smoothed by SUPPORT further sightings of the term in which the entity is as frequent as everywhere, so that few
sightings say less than many.
Entities, terms, pairs and the corpus are all counted in documents, copies included. Entities of exactly the same documents are
one in all these counts, so a document of thousands of addresses that no other holds costs one row a term. All of it is
SQL expressions, and their folds take chunks of about the square root of their length, so no array grows element by element
over a whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, let, read_table

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns with possessive repeats, which match the same and never backtrack, and with a look behind
#: where a match can only begin at the start of a run or where the last one ended, so that long runs are read once.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must match, cheaply, before its pattern is tried.
HINTS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
#: Sightings of a term that are added at p(e).
SUPPORT = 1.0
GENERALISE, REMOVE = 0.9, 0.97
#: A term: a word of at least three letters, outside base spans; of these only e-mails hold letters, so where a text has
#: an "@", e-mails are matched along with the words and left out.
TERM = r"\p{L}{3,}+"
TERM_OR_MAIL = rf"(?:{PATTERNS['email']})|(?:(?!{PATTERNS['email']})\p{{L}}){{3,}}+"
#: At most so many rows of 16 bytes are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
SPAN = "array<struct<start:int,ord:int,end:int,kind:string,value:string>>"


def luhn(digits: Column) -> Column:
    n = F.char_length(digits)

    def step(a: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        return a + F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0


def valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(v, r"\."), lambda p: F.coalesce(p.try_cast("bigint") <= 255, F.lit(False)))
    if kind == "card":
        return let(F.translate(v, " -", ""), lambda d: F.when(F.char_length(d).between(14, 19), luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.char_length(F.translate(v, "+ ().-", "")).between(10, 15)
    return F.lit(True)


def fold(items: Column, start: Column, kind: str, after, wanted, value) -> Column:
    """array<kind> of value(state, item) for the items of a walk that are wanted(state, item); after gives the next state.

    Items are taken in chunks; a value is appended to its chunk's, a chunk to the whole, so n items move n ** 1.5 elements at most.
    """

    def walk(all_: Column) -> Column:
        chunk = F.greatest(F.ceil(F.sqrt(F.size(all_))), F.lit(32)).cast("int")
        none, nothing = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")

        def one(a: Column, x: Column) -> Column:
            out = F.when(wanted(a["s"], x), F.concat(a["out"], F.array(value(a["s"], x)))).otherwise(a["out"])
            return F.struct(after(a["s"], x).alias("s"), out.alias("out"))

        def part(a: Column, k: Column) -> Column:
            inner = F.aggregate(F.slice(all_, k * chunk + 1, chunk), F.struct(a["s"].alias("s"), none.alias("out")), one)
            return let(inner, lambda r: F.struct(r["s"].alias("s"), F.concat(a["out"], F.array(r["out"])).alias("out")))

        return F.aggregate(F.sequence(F.lit(0), (F.size(all_) / chunk).cast("int")), F.struct(start.alias("s"), nothing.alias("out")), part, lambda a: F.flatten(a["out"]))

    return let(items, walk)


def matches(text: Column, pattern: str, ordinal: int, kind: str, ok) -> Column:
    """SPAN of the pattern's matches in text that are ok. The pieces between matches give the places; only matches
    that are ok are gathered, so a text full of numbers costs no more than its length."""
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.char_length(g))
    parts = F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("val"))
    end = lambda pos, z: pos + z["gap"] + F.coalesce(F.char_length(z["val"]), F.lit(0))

    def span(pos: Column, z: Column) -> Column:
        return F.struct((pos + z["gap"]).alias("start"), F.lit(ordinal).alias("ord"), end(pos, z).alias("end"), F.lit(kind).alias("kind"), z["val"].alias("value"))

    return fold(parts, F.lit(0), SPAN[6:-1], end, lambda _, z: z["val"].isNotNull() & ok(z["val"]), span)


def with_spans(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with __spans: the base spans by start, then kind. Null text has none."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = {}
    for i, k in enumerate(KINDS):
        hit = F.contains(text, F.lit("@")) & text.rlike(HINTS[k]) if k == "email" else F.contains(text, F.lit("+")) & text.rlike(HINTS[k]) if k == "phone" else text.rlike(HINTS[k])
        found[f"__{k}"] = F.when(hit, matches(text, PATTERNS[k], i, k, lambda v, k=k: valid(k, v))).otherwise(F.array().cast(SPAN))
    at = docs.withColumns(found)
    n = {f"__n_{k}": F.size(f"__{k}").cast("long") for k in KINDS}
    return at.withColumns(n | {"__spans": F.array_sort(F.concat(*(f"__{k}" for k in KINDS)))}).drop(*found)


def normal(kind: Column, value: Column) -> Column:
    """The entity: a hash of its kind and its value without separators and case."""
    return F.xxhash64(kind, F.lower(F.when(kind.isin("card", "phone"), F.translate(value, " ().-", "")).otherwise(value)))


def is_word(v: Column) -> Column:
    return ~F.contains(v, F.lit("@"))


def term(v: Column) -> Column:
    return F.xxhash64(F.lower(v))


def terms_of(text: Column) -> Column:
    """The distinct terms of a text, hashed."""
    mail = F.filter(F.regexp_extract_all(text, F.lit(TERM_OR_MAIL), F.lit(0)), is_word)
    words = F.when(F.contains(text, F.lit("@")), mail).otherwise(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)))
    return F.array_distinct(F.transform(words, term))


def places_of(text: Column) -> Column:
    """SPAN of every term of a text."""
    n = len(KINDS)
    return F.when(F.contains(text, F.lit("@")), matches(text, TERM_OR_MAIL, n, "term", is_word)).otherwise(matches(text, TERM, n, "term", lambda v: F.lit(True)))


def slim() -> Column:
    return F.transform("__spans", lambda s: F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["end"].alias("end"), s["kind"].alias("kind")))


def few(df: DataFrame) -> bool:
    return df.count() <= BROADCAST_ROWS


def find(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A written table, one row for each of docs: __id, __text (hash), __n_<kind>, __spans and, where there are spans,
    __entities (distinct) and __t, the text."""
    at = with_spans(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t")), "__t")
    entities = F.array_distinct(F.transform("__spans", lambda s: normal(s["kind"], s["value"])))
    some = F.size("__spans") > 0
    return checkpoint(at.select("__id", F.xxhash64("__t").alias("__text"), *(f"__n_{k}" for k in KINDS), slim().alias("__spans"), F.when(some, entities).alias("__entities"), F.when(some, F.col("__t")).alias("__t")))


def classed(found: DataFrame) -> DataFrame:
    """A written table, one row for each row that holds an entity: __id, __text, __t and __classes, each with __n_entity, the
    rows that hold it. A class is the entities of exactly the same rows, known by two sums of hashes over them, and
    named by the least of them."""
    near = found.where(F.size("__entities") > 0).select("__id", "__text", "__t", "__entities")
    held = near.select("__id", "__text", F.explode("__entities").alias("__entity"))
    sums = (F.sum(F.xxhash64(F.lit(k), "__id", "__text").cast("decimal(20,0)")).alias(f"__s{k}") for k in (1, 2))
    each = checkpoint(held.groupBy("__entity").agg(F.count(F.lit(1)).alias("__n_entity"), *sums))
    named = each.groupBy("__n_entity", "__s1", "__s2").agg(F.min("__entity").alias("__class"))
    which = each.join(named, ["__n_entity", "__s1", "__s2"]).select("__entity", "__class", "__n_entity")
    own = held.join(which, "__entity").groupBy("__id", "__text").agg(F.collect_set(F.struct("__class", "__n_entity")).alias("__classes"))
    own = checkpoint(own.select(F.col("__id").alias("__i"), F.col("__text").alias("__x"), "__classes"))
    at = near.join(F.broadcast(own) if own.count() <= BROADCAST_ROWS // 10 else own, near["__id"].eqNullSafe(own["__i"]) & (near["__text"] == own["__x"]))
    return checkpoint(at.select("__id", "__text", "__t", "__classes"))


def disclosing(found: DataFrame, near: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """A written table: (__class, __term, __share) of the pairs whose share PMI / IC reaches GENERALISE.

    Every count is of documents, each row one, so copies raise all of them alike. Counts are partial aggregates, so
    an entity, term or pair found everywhere is one row a task. Terms too common to reach GENERALISE with any entity
    are left out before they are paired, as far as they can be broadcast; that changes no result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = checkpoint(docs.select(F.explode(terms_of(text)).alias("__term")).groupBy("__term").agg(F.count(F.lit(1)).alias("__n_term")))
    n = float(found.count())
    most = near.select(F.max(F.array_max(F.transform("__classes", lambda c: c["__n_entity"])))).first()[0] or 0
    top = (most + most / n) * (n / most) ** (1 - GENERALISE) + 1 if most else 0.0
    common = counted.where(F.col("__n_term") > top).orderBy(F.desc("__n_term")).limit(BROADCAST_ROWS).select("__term")
    each = near.select("__classes", F.explode(terms_of(F.col("__t"))).alias("__term")).join(F.broadcast(common), "__term", "left_anti")
    pairs = each.select("__term", F.inline("__classes")).groupBy("__class", "__n_entity", "__term").agg(F.count(F.lit(1)).alias("__n_pair"))
    total = F.lit(n)
    p_entity = F.col("__n_entity") / total
    p_given = (F.col("__n_pair") + SUPPORT * p_entity) / (F.col("__n_term") + SUPPORT)
    share = F.log2(p_given / p_entity) / -F.log2(p_entity)
    out = pairs.where(F.col("__n_entity") < total).join(counted, "__term")
    return checkpoint(out.select("__class", "__term", share.alias("__share")).where(F.col("__share") >= GENERALISE))


def term_spans(near: DataFrame, pairs: DataFrame) -> DataFrame:
    """A written table (__term_id, __term_text, __more): the spans of the terms to generalise or remove in each document that has some."""
    small = few(pairs)
    each = near.select("__id", "__text", "__classes", F.explode(terms_of(F.col("__t"))).alias("__term"))
    terms = pairs.select("__term").distinct()
    each = each.join(F.broadcast(terms) if small else terms, "__term", "left_semi").select("__id", "__text", "__term", F.inline("__classes")).drop("__n_entity")
    hit = each.join(F.broadcast(pairs) if small else pairs, ["__class", "__term"]).groupBy("__id", "__text", "__term").agg(F.max("__share").alias("__share"))
    hit = checkpoint(hit.select(F.col("__id").alias("__i"), F.col("__text").alias("__x"), F.col("__term").alias("__w"), "__share"))
    at = near.select("__id", "__text", F.explode(places_of(F.col("__t"))).alias("__m")).withColumn("__term", term(F.col("__m.value")))
    at = at.join(hit, at["__id"].eqNullSafe(hit["__i"]) & (at["__text"] == hit["__x"]) & (at["__term"] == hit["__w"]))
    kind = F.when(F.col("__share") >= REMOVE, "removed").otherwise("term")
    span = F.struct(F.col("__m.start").alias("start"), F.col("__m.ord").alias("ord"), F.col("__m.end").alias("end"), kind.alias("kind"))
    return checkpoint(at.groupBy(F.col("__id").alias("__term_id"), F.col("__text").alias("__term_text")).agg(F.collect_set(span).alias("__more")))


def same_row(left: DataFrame, terms: DataFrame) -> Column:
    return left["__id"].eqNullSafe(terms["__term_id"]) & (left["__text"] == terms["__term_text"])


def every_span() -> Column:
    return F.array_sort(F.concat("__spans", F.coalesce("__more", F.array().cast("array<struct<start:int,ord:int,end:int,kind:string>>"))))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each of docs: id, n_email, n_ip, n_card, n_phone, base_spans and all_spans (arrays of start, ord, end, kind).

    Null and empty texts have no spans. Repeated rows get the same spans; a null id is a value like any other.
    An empty table gives an empty table.
    """
    found = find(docs, id_col, text_col)
    near = classed(found)
    terms = term_spans(near, disclosing(found, near, docs, text_col))
    at = found.drop("__t").join(terms, same_row(found, terms), "left")
    return at.select(F.col("__id").alias(id_col), *(F.col(f"__n_{k}").alias(f"n_{k}") for k in KINDS), F.col("__spans").alias("base_spans"), every_span().alias("all_spans"))


#: Characters of the pieces that a text is cut in before spans are replaced.
PIECE = 1024


def replaced(text: Column, spans: Column) -> Column:
    """text with a label for each span, or the first one's for spans that overlap."""
    label = lambda k: F.coalesce(F.create_map(*(F.lit(x) for kv in (LABELS | {"term": "[TERM]", "removed": ""}).items() for x in kv))[k], F.lit(""))

    def whole(cut: Column) -> Column:
        def between(a: Column, b: Column) -> Column:
            """The text from a to b: the rest of a's piece, the pieces between, the head of b's."""
            first, last = F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")
            head = F.substring(F.coalesce(F.get(cut, first), F.lit("")), a % PIECE + 1, F.when(first == last, b - a).otherwise(F.lit(PIECE)))
            middle = F.array_join(F.slice(cut, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
            return F.when(first == last, head).otherwise(F.concat(head, middle, F.substring(F.coalesce(F.get(cut, last), F.lit("")), F.lit(1), b % PIECE)))

        end = F.struct(F.char_length(text).alias("start"), F.lit(0).alias("ord"), F.char_length(text).alias("end"), F.lit("").alias("kind"))
        return F.array_join(fold(F.concat(spans, F.array(end)), F.lit(0), "string", lambda pos, s: F.greatest(pos, s["end"]), lambda pos, s: s["start"] >= pos, lambda pos, s: F.concat(between(pos, s["start"]), label(s["kind"]))), "")

    return let(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}+"), F.lit(0)), whole)


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every base span replaced by its label, disclosing terms by [TERM] or by nothing, other text kept.

    Where spans overlap the first one's label stands for all. Null text stays null.
    """
    found = find(docs, id_col, text_col)
    near = classed(found)
    terms = term_spans(near, disclosing(found, near, docs, text_col))
    known = found.where(F.size("__spans") > 0).dropDuplicates(["__id", "__text"]).drop("__t")
    known = known.join(terms, same_row(known, terms), "left").select(F.col("__id").alias("__i"), F.col("__text").alias("__x"), every_span().alias("__all"))
    known = checkpoint(known)
    here = docs.withColumn("__x0", F.xxhash64(F.col(text_col)))
    at = here.join(known, here[id_col].eqNullSafe(known["__i"]) & (here["__x0"] == known["__x"]), "left")
    text = F.col(text_col)
    return at.withColumn(text_col, F.when(F.size("__all") > 0, replaced(text, F.col("__all"))).otherwise(text)).select(*docs.columns)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = detect(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return at.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(joined(F.col("base_spans")), 256).alias("base_sha256"), joined(F.col("all_spans")).alias("spans"))
