"""Quality rules with thresholds learned from the corpus, in DataFrame operations only.

Fixed base rules come first. For the documents that pass them, a quantile sketch is
kept for each language, source and measure: a histogram over buckets of six
significant binary digits, so a quantile read from it is at most 1/32 below the true
one. Such sketches merge by adding counts, which the partial aggregation does within
each task, so a hot source costs a bounded number of rows.

Measures are rates that are never zero (one more occurrence than counted, or one more window of three words), so
every group has a spread, and outliers are told on the scale of ratios: a document is
rejected where a measure is above q3 by more than the square of q3 / q1, that is by twice the spread of the
middle half. To each source's sketch ``PRIOR`` points are added, spread evenly over the ranks of its language's
merged sketch, so a small source has sound thresholds as well, without a switch between the two.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import SPACE, frozen

SYMBOLS = "#*$%&|<>"
#: measure: (numerator, denominator, least factor between quartile and fence, judged from below too). Each
#: measure is one more than a rate in millionths; a group of nearly equal documents has fences at the least factor.
MEASURES = {
    "symbol_rate": ("n_symbols + 1", "n_words + 1", 6.0, False),
    "dup_line_odds": ("n_dup_lines + 1", "n_lines - n_dup_lines + 1", 6.0, False),
    "repeat_odds": ("n_repeat_words + 3", "n_words - n_repeat_words + 3", 16.0, False),
    "upper_rate": ("n_upper + 1", "word_chars + 1", 6.0, False),
    "word_length": ("word_chars + 1", "n_words + 1", 1.75, True),
}
#: Points of its language's sketch that each source's own gets.
PRIOR = 50
#: Languages and sources whose thresholds are sent to all tasks; more are joined.
BROADCAST = 100_000


def _bucket(v: str) -> str:
    """The lower edge of the bucket of a long >= 0: its six highest binary digits."""
    sh = f"greatest(length(bin({v})) - 6, 0)"
    return f"shiftleft(shiftright({v}, {sh}), {sh})"


def measures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", whole: bool = False) -> DataFrame:
    """The counts of every text and the measures made of them, one row for each row of ``df``; with ``whole``
    also that row, as a struct ``row``."""
    row = [F.struct("*").alias("row")] * whole
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = df.select(F.col(id_col).cast("long").alias("doc_id"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for c, k in ((lang_col, "lang_key"), (source_col, "source_key"))], text.alias("t"), *row)
    row = ["row"] * whole
    d = d.select("*", F.expr(f"filter(split(t, r'{SPACE}'), w -> w != '')").alias("w"), F.expr("filter(split(t, '\\n'), l -> l rlike r'[^\\x20\\x09-\\x0D]')").alias("l"))
    d = d.select("doc_id", "lang_key", "source_key", *row, "t", "w", "l", F.expr("transform(slice(w, 1, greatest(size(w) - 2, 0)), (x, i) -> xxhash64(x, w[i + 1], w[i + 2]))").alias("h"))
    # Only texts in which a window repeats are sorted.
    d = d.withColumn("s", F.expr("if(size(array_distinct(h)) = size(h), array(), sort_array(transform(h, (x, i) -> struct(x as h, i as i))))"))
    d = d.withColumn("p", F.expr("if(size(s) = 0, array(), array_sort(transform(filter(s, (e, k) -> coalesce(e.h = get(s, k - 1).h, false) or coalesce(e.h = get(s, k + 1).h, false)), e -> e.i)))"))
    d = d.select(
        "doc_id", "lang_key", "source_key", *row,
        F.expr("cast(size(w) as long)").alias("n_words"),
        F.expr(f"cast(length(regexp_replace(t, r'{SPACE}', '')) as long)").alias("word_chars"),
        F.expr(f"cast(length(t) - length(translate(t, '{SYMBOLS}', '')) as long)").alias("n_symbols"),
        F.expr("cast(size(l) - size(array_distinct(l)) as long)").alias("n_dup_lines"),
        F.expr("if(size(p) = 0, 0L, 3L + aggregate(zip_with(slice(p, 2, size(p) - 1), slice(p, 1, size(p) - 1), (a, b) -> least(3, a - b)), 0L, (x, y) -> x + y))").alias("n_repeat_words"),
        F.expr("cast(size(l) as long)").alias("n_lines"),
        F.expr("cast(length(regexp_replace(t, r'[^\\p{Lu}]+', '')) as long)").alias("n_upper"),
    )
    rates = [F.expr(f"1L + 1000000L * ({a}) div ({b})").alias(k) for k, (a, b, _, _) in MEASURES.items()]
    return d.select("*", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words").alias("base_failed"), *rates)


def sketches(measured: DataFrame) -> DataFrame:
    """``lang_key, source_key, measure, bucket, n`` over the documents that pass the base rules.

    ``measured`` must have been written, or come from ``_once``, as each measure is used several times.
    """
    m = measured.where("NOT base_failed")
    rows = m.select("lang_key", "source_key", F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), F.expr(_bucket(k)).alias("bucket")) for k in MEASURES])).alias("x"))
    return rows.groupBy("lang_key", "source_key", "x.measure", "x.bucket").agg(F.count("*").alias("n"))


def _running(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``upto``, the documents up to each bucket, and ``total``."""
    by = ", ".join([*keys, "measure"])
    return sketch.select("*", F.expr(f"sum(n) over (partition by {by} order by bucket)").alias("upto"), F.expr(f"sum(n) over (partition by {by})").alias("total"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """For each language and source a ``low_`` and a ``high_`` fence of each measure."""
    merged = _running(sketch.groupBy("lang_key", "measure", "bucket").agg(F.sum("n").alias("n")), ["lang_key"])
    points = merged.select("lang_key", "measure", "bucket", F.expr(f"{PRIOR} * upto div total - {PRIOR} * (upto - n) div total").alias("n")).where("n > 0")
    points = sketch.select("lang_key", "source_key", "measure").distinct().join(points, ["lang_key", "measure"])
    mixed = sketch.unionByName(points).groupBy("lang_key", "source_key", "measure", "bucket").agg(F.sum("n").alias("n"))
    # Quartiles: the first buckets that reach a quarter and three.
    q = _running(mixed, ["lang_key", "source_key"]).groupBy("lang_key", "source_key", "measure").agg(F.expr("min(if(4 * upto >= total, bucket, null))").alias("q1"), F.expr("min(if(4 * upto >= 3 * total, bucket, null))").alias("q3"))
    fences = []
    for k, (_, _, least, below) in MEASURES.items():
        of = lambda e, k=k: F.expr(f"max(if(measure = '{k}', {e}, null))")
        factor = f"greatest((q3 / q1) * (q3 / q1), {least}D)"
        fences.append(of(f"q3 * {factor}").alias(f"high_{k}"))
        if below:
            fences.append(of(f"q1 / {factor}").alias(f"low_{k}"))
    return q.groupBy("lang_key", "source_key").agg(*fences)


def _once(measured: DataFrame) -> DataFrame:
    """The same rows, for a single use: the optimizer evaluates each measure once, below, though it is used several times above."""
    return measured.withColumn("once", F.monotonically_increasing_id()).where("once >= 0")


def _judged(measured: DataFrame, sketch: DataFrame) -> DataFrame:
    """``measured`` with ``kept``, by the thresholds that follow from the sketches."""
    fences = frozen(thresholds(frozen(sketch)))
    if fences.count() <= BROADCAST:
        fences = F.broadcast(fences)
    within = " and ".join(f"{k} <= high_{k}" + f" and {k} >= low_{k}" * below for k, (*_, below) in MEASURES.items())
    return measured.join(fences, ["lang_key", "source_key"], "left").withColumn("kept", F.expr(f"not base_failed and coalesce({within}, true)"))


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``doc_id``, the counts, ``base_failed`` and ``kept``, then the measures, one row for each row of ``df``.

    Null, empty and blank texts have zero words and fail the base rules. Null
    languages and sources count as the empty string, a group of its own. Repeated
    rows count, and come out, as often as they occur; null ids stay null; further
    columns, whatever their names, are not read. An empty table gives an empty table.
    """
    m = frozen(measures(df, id_col, text_col, lang_col, source_col))
    judged = _judged(m, sketches(m))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *MEASURES)


def filtered(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, each judged by itself, in their order.

    Texts are measured twice, for the sketches and where they are judged, and neither exchanged nor written between.
    """
    return _judged(_once(measures(docs, whole=True)), sketches(_once(measures(docs)))).where("kept").select("row.*")


#: The same in DuckDB over ``documents``.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lk, coalesce(source, '') AS sk, coalesce(text, '') AS t FROM documents),
e AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
win AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM e WHERE len(w) > 2),
win2 AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM win),
cov AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM win2 WHERE n > 1) GROUP BY r),
m AS (SELECT e.r, doc_id, lk, sk, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines,
        length(regexp_replace(t, '[^\\p{{Lu}}]+', '', 'g')) AS n_upper
      FROM e LEFT JOIN cov ON e.r = cov.r),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        {", ".join(f"1 + 1000000 * ({a}) // ({b}) AS {k}" for k, (a, b, _, _) in MEASURES.items())} FROM m),
x AS (SELECT r, lk, sk, base_failed, unnest([{", ".join(f"{{'measure': '{k}', 'v': {k}::BIGINT, 'least': {z}::DOUBLE, 'below': {str(z2).lower()}}}" for k, (_, _, z, z2) in MEASURES.items())}]) AS m FROM f),
v AS (SELECT lk, sk, m.measure AS measure, m.v >> greatest(length(bin(m.v)) - 6, 0) << greatest(length(bin(m.v)) - 6, 0) AS b FROM x WHERE NOT base_failed),
own AS (SELECT lk, sk, measure, count(*) AS total, list(b ORDER BY b) AS s FROM v GROUP BY ALL),
mer AS (SELECT lk, measure, count(*) AS total, list(b ORDER BY b) AS s FROM v GROUP BY ALL),
mix AS (SELECT own.lk, sk, own.measure, own.total + {PRIOR} AS total,
        list_sort(own.s || list_transform(range(1, {PRIOR} + 1), lambda j: mer.s[(j * mer.total + {PRIOR - 1}) // {PRIOR}])) AS s
      FROM own JOIN mer ON own.lk = mer.lk AND own.measure = mer.measure),
q AS (SELECT lk, sk, measure, s[(total + 3) // 4] AS q1, s[(3 * total + 3) // 4] AS q3 FROM mix),
bad AS (SELECT DISTINCT r FROM x JOIN q ON x.lk = q.lk AND x.sk = q.sk AND x.m.measure = q.measure
      WHERE m.v > q3 * greatest((q3 / q1) * (q3 / q1), m.least) OR m.below AND m.v < q1 / greatest((q3 / q1) * (q3 / q1), m.least))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND r NOT IN (SELECT r FROM bad) AS kept,
  {", ".join(f"{k}::BIGINT AS {k}" for k in MEASURES)} FROM f
"""
