"""Quality rules whose thresholds follow each language and source.

The quantile sketch is a log-linear histogram of integers: a value keeps its eight leading bits, so a bucket is at most
1/128 wide of its value, a group has a few thousand buckets at most, and two sketches merge by adding counts. It
is exact to that width, does not depend on the order of rows, and is made by plain group-bys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, let, read_table

WINDOW = 5
#: A limit is FENCE interquartile ranges of the group's sketch beyond its quartile. A range counts as at least this wide, in
#: thousandths, so that a group whose values hardly differ keeps its clean tail; there are no other cutoffs.
WIDTH = {"symbols": 30, "dup_lines": 100, "repeats": 45, "word_chars": 100}
#: Rules with a lower limit too.
LOWER = ("word_chars",)
FENCE = 4
#: Every source's sketch holds the language's as well, with the weight of so many documents: a small source leans on its language, a large one hardly.
PRIOR = 50
#: Thresholds of at most so many groups (under 100 bytes each) are broadcast; more are joined by a salted key.
BROADCAST_ROWS = 50_000
SALTS = 32


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1), "")


def repeated_words(words: Column) -> Column:
    """Words inside windows of five that the text holds twice or more, the first one included.

    Windows are 64-bit hashes. Texts without a repeated hash, nearly all, end at a hash set. Others sort
    (hash, position), keep positions with an equal neighbour and measure the union of their windows, so the cost
    is n log n for any text.
    """

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*(w[i + k] for k in range(WINDOW))))

    def union(p: Column) -> Column:
        gaps = F.transform(p, lambda x, i: F.when(i == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), x - p[i - 1])))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def marked(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: ((i > 0) & (s[F.greatest(i - 1, F.lit(0))]["h"] == x["h"])) | ((i < F.size(s) - 1) & (s[F.least(i + 1, F.size(s) - 1)]["h"] == x["h"])))
        return let(F.array_sort(F.transform(twice, lambda x: x["p"])), union)

    def slow(h: Column) -> Column:
        return let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))), marked)

    def counted(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(slow(h))

    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(let(windows(words), counted))


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with __n_words, __word_chars, __n_symbols, __n_dup_lines, __n_repeat_words, __n_text_lines (longs); null text has no words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    full = F.filter(F.split(text, "\n", -1), lambda x: F.char_length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    at = docs.withColumns({"__words": words_of(F.col(text_col)), "__full": full})
    counts = {
        "__n_words": F.size("__words"),
        "__word_chars": F.char_length(F.translate(text, " \t\n\x0b\x0c\r", "")),
        "__n_symbols": F.char_length(text) - F.char_length(F.translate(text, "#*$%&|<>", "")),
        "__n_dup_lines": F.size("__full") - F.size(F.array_distinct("__full")),
        "__n_text_lines": F.size("__full"),
        "__n_repeat_words": let(F.col("__words"), repeated_words),
    }
    # A generator of one row: a filter on the counts is not pushed below it, where each use would count again.
    once = F.inline(F.array(F.struct(*(c.cast("long").alias(k) for k, c in counts.items()))))
    at = at.select(*(c for c in docs.columns if c not in counts), once)
    return at.withColumn("__base_failed", (F.col("__n_words") < 10) | (100 * F.col("__n_repeat_words") > 20 * F.col("__n_words")))


def values() -> dict[str, Column]:
    """The rules' measures in thousandths, as integers."""
    words, lines = F.greatest(F.col("__n_words"), F.lit(1)), F.greatest(F.col("__n_text_lines"), F.lit(1))
    div = lambda a, b: F.call_function("div", 1000 * F.col(a), b)
    return {"symbols": div("__n_symbols", words), "dup_lines": div("__n_dup_lines", lines), "repeats": div("__n_repeat_words", words), "word_chars": div("__word_chars", words)}


def bucket(v: Column) -> Column:
    shift = F.greatest(F.length(F.bin(v)) - 8, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift)


def sketches(measured: DataFrame, lang_col: str, source_col: str) -> DataFrame:
    """(__lang, __source, __rule, __bucket, __count): one mergeable histogram for each language, source and rule.

    Only documents that pass the base rules count. A source of any size leaves one row for each bucket and task.
    """
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), v.alias("v")) for k, v in values().items())))
    return (
        measured.where(~F.col("__base_failed"))
        .select(F.col(lang_col).alias("__lang"), F.col(source_col).alias("__source"), each.alias("__x"))
        .groupBy("__lang", "__source", F.col("__x.rule").alias("__rule"), bucket(F.col("__x.v")).alias("__bucket"))
        .agg(F.count(F.lit(1)).alias("__count"))
    )


def merge(sketch: DataFrame, *by: str) -> DataFrame:
    return sketch.groupBy(*by, "__rule", "__bucket").agg(F.sum("__count").alias("__count"))


def leaning(sketch: DataFrame) -> DataFrame:
    """(__lang, __source, __rule, __bucket, __weight): each source's sketch with PRIOR documents of its language's mixed in.

    Weights are whole numbers: a source's counts by the language's total, the language's counts by PRIOR.
    """
    wide = merge(sketch, "__lang").select(F.col("__lang").alias("__l"), F.col("__rule").alias("__r"), "__bucket", F.col("__count").alias("__c"))
    total = wide.groupBy("__l", "__r").agg(F.sum("__c").cast("decimal(19,0)").alias("__t"))
    same = lambda x: sketch["__lang"].eqNullSafe(x["__l"]) & (sketch["__rule"] == x["__r"])
    own = sketch.join(total, same(total)).select("__lang", "__source", "__rule", "__bucket", (F.col("__count") * F.col("__t")).cast("decimal(38,0)").alias("__weight"))
    groups = sketch.select("__lang", "__source", "__rule").distinct()
    lent = groups.join(wide, groups["__lang"].eqNullSafe(wide["__l"]) & (groups["__rule"] == wide["__r"])).select("__lang", "__source", "__rule", "__bucket", (F.col("__c") * PRIOR).cast("decimal(38,0)").alias("__weight"))
    return own.union(lent).groupBy("__lang", "__source", "__rule", "__bucket").agg(F.sum("__weight").cast("decimal(38,0)").alias("__weight"))


def quartiles(weighted: DataFrame) -> DataFrame:
    """(__lang, __source, __rule, __q1, __q3) of each sketch: the first bucket that a quarter, or three, of the weight reach."""
    over = Window.partitionBy("__lang", "__source", "__rule")
    total = lambda w: F.sum("__weight").over(w).cast("decimal(38,0)")
    at = weighted.withColumns({"__n": total(over), "__cum": total(over.orderBy("__bucket"))})
    reach = lambda k: F.min(F.when((4 * F.col("__cum")).cast("decimal(38,0)") >= (k * F.col("__n")).cast("decimal(38,0)"), F.col("__bucket")))
    return at.groupBy("__lang", "__source", "__rule").agg(reach(1).alias("__q1"), reach(3).alias("__q3"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """One row for each language and source: __hi_<rule> and __lo_<rule>, the fences of its sketch."""
    width = F.create_map(*(F.lit(x) for kv in WIDTH.items() for x in kv))[F.col("__rule")].cast("long")
    wide = F.greatest(F.col("__q3") - F.col("__q1"), width)
    limit = quartiles(leaning(sketch)).select("__lang", "__source", "__rule", (F.col("__q3") + FENCE * wide).alias("__hi"), (F.col("__q1") - FENCE * wide).alias("__lo"))
    pick = lambda rule, col: F.max(F.when(F.col("__rule") == rule, F.col(col)))
    return limit.groupBy("__lang", "__source").agg(*(pick(k, "__hi").alias(f"__hi_{k}") for k in WIDTH), *(pick(k, "__lo").alias(f"__lo_{k}") for k in LOWER))


def judge(measured: DataFrame, limits: DataFrame, lang_col: str, source_col: str, salt: Column) -> DataFrame:
    """measured with __kept, by a join of each row to the limits of its language and source.

    limits is a written table; its rows are counted before it is broadcast. A larger one is joined by a key
    salted over SALTS values, so that a source with a third of all rows is spread.
    """
    at = (F.col(lang_col).eqNullSafe(F.col("__lang"))) & (F.col(source_col).eqNullSafe(F.col("__source")))
    if limits.count() <= BROADCAST_ROWS:
        joined = measured.join(F.broadcast(limits), at, "left")
    else:
        many = limits.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = measured.withColumn("__own_salt", F.pmod(salt, F.lit(SALTS)).cast("int")).join(many, at & (F.col("__own_salt") == F.col("__salt")), "left").drop("__salt", "__own_salt")
    v = values()
    odd = F.lit(False)
    for k in WIDTH:
        odd = odd | (v[k] > F.col(f"__hi_{k}"))
    for k in LOWER:
        odd = odd | (v[k] < F.col(f"__lo_{k}"))
    return joined.withColumn("__kept", ~F.col("__base_failed") & ~F.coalesce(odd, F.lit(False))).drop("__lang", "__source", *(f"__hi_{k}" for k in WIDTH), *(f"__lo_{k}" for k in LOWER))


def fit(measured: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The limits of every language and source of measured rows, as a written table."""
    return checkpoint(thresholds(checkpoint(sketches(measured, lang_col, source_col))))


def filter_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of docs that pass, with the columns of docs.

    Null text has no words and fails. Null languages and sources are groups of their own. Repeated rows are judged
    alike, each counting in the sketch. An empty table gives an empty table.
    """
    measured = checkpoint(measures(docs, text_col))  # with the texts, which costs less than to measure them twice
    judged = judge(measured, fit(measured, lang_col, source_col), lang_col, source_col, F.xxhash64(id_col))
    return judged.where("__kept").select(*docs.columns)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    measured = checkpoint(measures(docs).drop("text"))
    limits = fit(measured)
    return judge(measured, limits, "lang", "source", F.xxhash64("doc_id")).select(
        "doc_id",
        *(F.col(f"__{k}").alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")),
    )


ORACLE_OP4 = r"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT doc_id, unnest(range(1, len(words) - 3)) AS p, words FROM w WHERE len(words) >= 5),
grams AS (SELECT doc_id, p, words[p] || ' ' || words[p+1] || ' ' || words[p+2] || ' ' || words[p+3] || ' ' || words[p+4] AS g FROM win),
twice AS (SELECT doc_id, p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + 5)) AS q FROM twice) GROUP BY doc_id),
m AS (SELECT w.doc_id, lang, source, len(words)::BIGINT AS n_words,
             length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines,
             coalesce(rep.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
             (1000 * n_symbols) // greatest(n_words, 1) AS v_symbols, (1000 * n_dup_lines) // greatest(n_lines, 1) AS v_dup_lines,
             (1000 * n_repeat_words) // greatest(n_words, 1) AS v_repeats, (1000 * word_chars) // greatest(n_words, 1) AS v_word_chars FROM m),
x AS (SELECT lang, source, unnest([{'r': 'symbols', 'v': v_symbols}, {'r': 'dup_lines', 'v': v_dup_lines},
             {'r': 'repeats', 'v': v_repeats}, {'r': 'word_chars', 'v': v_word_chars}]) AS e FROM b WHERE NOT base_failed),
s AS (SELECT lang, source, e.r AS rule, (e.v >> greatest(length(bin(e.v)) - 8, 0)) << greatest(length(bin(e.v)) - 8, 0) AS bucket, count(*) AS c FROM x GROUP BY ALL),
wide AS (SELECT lang, rule, bucket, sum(c)::HUGEINT AS c FROM s GROUP BY ALL),
total AS (SELECT lang, rule, sum(c)::HUGEINT AS n FROM wide GROUP BY ALL),
lean AS (SELECT s.lang, source, s.rule, bucket, c * n AS w FROM s JOIN total ON s.lang IS NOT DISTINCT FROM total.lang AND s.rule = total.rule
  UNION ALL SELECT g.lang, source, g.rule, bucket, 50 * c FROM (SELECT DISTINCT lang, source, rule FROM s) g JOIN wide ON g.lang IS NOT DISTINCT FROM wide.lang AND g.rule = wide.rule),
own_c AS (SELECT *, sum(w) OVER (PARTITION BY lang, source, rule) AS n, sum(w) OVER (PARTITION BY lang, source, rule ORDER BY bucket) AS cum FROM (SELECT lang, source, rule, bucket, sum(w)::HUGEINT AS w FROM lean GROUP BY ALL)),
q AS (SELECT lang, source, rule, min(bucket) FILTER (4 * cum >= n) AS q1, min(bucket) FILTER (4 * cum >= 3 * n) AS q3 FROM own_c GROUP BY ALL),
f AS (SELECT *, greatest(q3 - q1, CASE rule WHEN 'symbols' THEN 30 WHEN 'dup_lines' THEN 100 WHEN 'repeats' THEN 45 ELSE 100 END) AS r FROM q),
t AS (SELECT lang, source, max(q3 + 4 * r) FILTER (rule = 'symbols') AS hi_s, max(q3 + 4 * r) FILTER (rule = 'dup_lines') AS hi_d, max(q3 + 4 * r) FILTER (rule = 'repeats') AS hi_r,
             max(q3 + 4 * r) FILTER (rule = 'word_chars') AS hi_w, max(q1 - 4 * r) FILTER (rule = 'word_chars') AS lo_w FROM f GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(v_symbols > hi_s OR v_dup_lines > hi_d OR v_repeats > hi_r OR v_word_chars > hi_w OR v_word_chars < lo_w, FALSE) AS kept
FROM b LEFT JOIN t ON b.lang IS NOT DISTINCT FROM t.lang AND b.source IS NOT DISTINCT FROM t.source
"""
