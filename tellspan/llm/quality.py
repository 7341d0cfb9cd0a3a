"""Line-first quality rules in built-in SQL functions only.

Each line is judged alone: whether its symbols, separators, repeated words, missing sentence ends
or boilerplate wording mark it as something other than text. Lines that fail are removed, and a
document is rejected if too much of it goes with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space between words, as a fixed pattern.
SPACE = r"[\x20\x09-\x0D]+"
#: Fixed values of the line rules.
SYMBOLS = r"[#*$%&|<>]"
SENTENCE_END = r"[.!?…。]"
BOILERPLATE = (
    r"(?i)(all rights reserved|terms of (use|service)|privacy policy|cookie|javascript|lorem ipsum|click here|sign (in|up)|log ?in|"
    r"subscribe|licen[cs]ed under|copyright|powered by|skip to content|read more|share this)"
)


def _line_fails(line: Column) -> Column:
    """Whether a line with a word breaks a rule."""
    n = F.size(F.split(F.trim(line), SPACE))
    symbols = F.regexp_count(line, F.lit(SYMBOLS))
    return (
        (symbols * 10 > F.length(line))  # symbols in place of letters
        | (F.regexp_count(line, F.lit(r"\|")) >= 3)  # navigation: separated links
        | ((n > 10) & ~line.rlike(SENTENCE_END))  # no sentence ends
        | ((n >= 8) & (F.size(F.array_distinct(F.split(F.trim(line), SPACE))) * 5 < n * 2))  # the same words again and again
        | ((F.length(line) < 200) & line.rlike(BOILERPLATE))
    )


def clean_lines(text: Column) -> Column:
    """``text`` without the lines that fail; lines without a word stay. Null stays null."""
    lines = F.split(text, "\n", -1)
    return F.array_join(F.filter(lines, lambda x: (F.trim(F.regexp_replace(x, SPACE, " ")) == "") | ~_line_fails(x)), "\n")


def assess(docs: DataFrame, most_lost: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_failed_lines, kept).

    ``kept`` is false if base_failed, or if failing lines hold more than ``most_lost`` percent of
    the characters of lines with words. A row for each row of ``docs``, without a shuffle; null
    texts count as empty, and empty ones fail for having under 20 words.
    """
    text = F.make_valid_utf8(F.coalesce(F.col(text_col), F.lit("")))
    d = docs.select(F.col(id_col), text.alias("t"))
    d = d.withColumns({"w": F.filter(F.split("t", SPACE, -1), lambda x: x != ""), "lines": F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    n = F.size("w")
    d = d.withColumns(
        {
            "n": n,
            "chars": F.length(F.array_join("w", "")),
            "symbols": F.regexp_count("t", F.lit(SYMBOLS)),
            "dup": F.size("lines") - F.size(F.array_distinct("lines")),
            # a number for each window of 8 words; equal windows have equal numbers
            "keys": F.when(n >= 9, F.transform(F.sequence(F.lit(1), F.greatest(n - 7, F.lit(1))), lambda i: F.xxhash64(F.slice("w", i, 8)))),
            "bad": F.filter("lines", _line_fails),
        }
    ).drop("w", "t")
    d = d.withColumn("sorted", F.when(F.size(F.array_distinct("keys")) < F.size("keys"), F.sort_array(F.transform("keys", lambda k, i: F.struct(k.alias("k"), i.alias("i"))))))
    same = lambda x, j: F.coalesce(F.get("sorted", j)["k"] == x["k"], F.lit(False))
    d = d.withColumn("at", F.sort_array(F.filter(F.transform("sorted", lambda x, i: F.when(same(x, i - 1) | same(x, i + 1), x["i"])), lambda p: p.isNotNull())))
    covered = F.aggregate(
        "at",
        F.struct(F.lit(0).alias("n"), F.lit(-8).alias("p")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(8), p - a["p"])).alias("n"), p.alias("p")),
        lambda a: a["n"],
    )
    d = d.withColumns({"rep": F.coalesce(covered, F.lit(0)).cast("long"), "lost": F.length(F.array_join("bad", "")), "held": F.length(F.array_join("lines", "")), "gone": F.size("bad")})
    failed = (F.col("n") < 20) | (100 * F.col("rep") > 30 * F.col("n"))
    return d.select(
        F.col(id_col),
        F.col("n").cast("long").alias("n_words"),
        F.col("chars").cast("long").alias("word_chars"),
        F.col("symbols").cast("long").alias("n_symbols"),
        F.col("dup").cast("long").alias("n_dup_lines"),
        F.col("rep").alias("n_repeat_words"),
        failed.alias("base_failed"),
        F.col("gone").cast("long").alias("n_failed_lines"),
        (~failed & (100 * F.col("lost") <= most_lost * F.col("held"))).alias("kept"),
    )


#: The base columns by definition, for DuckDB. The line rules are written out in the same terms.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
x AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines,
        row_number() OVER () AS r FROM d),
wins AS (SELECT r, i, array_to_string(w[i : i + 7], chr(1)) AS k FROM x, unnest(range(1, len(w) - 6)) AS u(i) WHERE len(w) >= 8),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM wins) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT i + j) AS n FROM twice, unnest(range(0, 8)) AS u(j) GROUP BY r),
y AS (SELECT doc_id, t, w, lines, coalesce(cov.n, 0) AS rep,
        list_filter(lines, lambda l: len(regexp_extract_all(l, '[#*$%&|<>]')) * 10 > length(l) OR len(regexp_extract_all(l, '\|')) >= 3
          OR (len(regexp_split_to_array(trim(l), '[\x20\x09-\x0D]+')) > 10 AND NOT regexp_matches(l, '[.!?…。]'))
          OR (len(regexp_split_to_array(trim(l), '[\x20\x09-\x0D]+')) >= 8 AND len(list_distinct(regexp_split_to_array(trim(l), '[\x20\x09-\x0D]+'))) * 5 < len(regexp_split_to_array(trim(l), '[\x20\x09-\x0D]+')) * 2)
          OR (length(l) < 200 AND regexp_matches(l, '__BOILERPLATE__'))) AS bad
      FROM x LEFT JOIN cov USING (r))
SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, rep::BIGINT AS n_repeat_words, (len(w) < 20 OR 100 * rep > 30 * len(w)) AS base_failed, len(bad)::BIGINT AS n_failed_lines,
  (NOT (len(w) < 20 OR 100 * rep > 30 * len(w)) AND 100 * coalesce(length(array_to_string(bad, '')), 0) <= 50 * coalesce(length(array_to_string(lines, '')), 0)) AS kept
FROM y
""".replace("__BOILERPLATE__", BOILERPLATE)
