"""Licence scans by canonical digest, with DataFrame functions only.

A text is put in canonical form (case, punctuation, copyright lines and equivalent spellings are evened out) and its
digest is joined to those of known licence texts. The same is done for each line, as licences are often given by a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import SPELLINGS, STATEMENTS, TEXTS, WHOLE
from .shared import hot_join, materialise

#: A line that states a copyright: the word with a sign or a year, or a sign at the line's beginning; rights reserved.
COPYRIGHT_LINE = r"(?m)^[ \t#*/;-]*(copyright[ \t]+(\(c\)|©|[0-9]{4}|\[|<)|\(c\)[ \t]|©|all rights reserved)[^\n]*$"
PUNCTUATION = r"[^\p{L}\p{N}]+"
FIRST_WORD = r"^[^\p{L}\p{N}]*+([\p{L}\p{N}]++)"

#: What a line may say besides: a defined term, where the text is to be found.
DEFINED_TERM = r"(?i)[ \t]*\((?:the[ \t]+)?[\"'“]?licen[cs]e[\"'”]?\)"
WHERE_TO_FIND = r"(?i)[ \t,;:.–—-]*\(?(?:please[ \t]+)?(?:see|refer to|as found in|as described in)[ \t]+(?:the[ \t]+)?(?:accompanying[ \t]+|enclosed[ \t]+)?[`'\"*\[]*(?:licen[cs]e|copying)[^\n]*$"
#: A line with an expression of identifiers, and what parts these.
IDENTIFIERS = r"(?i)^[^\p{L}\p{N}]*spdx-license-identifier:[ \t]*([^\n]+)$"
IDENTIFIER_ENDS = r"[() \t]+"
OPERATORS = ("or", "and", "with")

#: So many digests at most (about 100 bytes each) are sent to every executor whatever the session's limit.
SENT_LICENCES = 100_000

#: Cheap test for words that have another spelling; texts without any skip the replacements.
VARIANT = " (?:" + "|".join(variant for variant, _ in SPELLINGS) + ") "


def with_canonical(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the text's words in lower case, one space between them; copyright lines are dropped, spellings evened out.

    Null is empty. It is made in steps of a column each, so that no step is computed twice.
    """
    step = [f"{out}_{i}" for i in range(3)]
    lower = F.col(step[0])
    marked = F.contains(lower, F.lit("copyright")) | F.contains(lower, F.lit("(c)")) | F.contains(lower, F.lit("©")) | F.contains(lower, F.lit("rights reserved"))
    replaced = F.col(step[2])
    for variant, word in SPELLINGS:
        replaced = F.replace(replaced, F.lit(f" {variant} "), F.lit(f" {word} "))
    return (
        df.withColumn(step[0], F.lower(F.coalesce(F.col(text), F.lit(""))))
        .withColumn(step[1], F.when(marked, F.regexp_replace(lower, COPYRIGHT_LINE, "")).otherwise(lower))
        .withColumn(step[2], F.concat(F.lit(" "), F.regexp_replace(step[1], PUNCTUATION, "  "), F.lit(" ")))  # each word has a space of its own on each side
        .withColumn(out, F.trim(F.replace(F.when(F.col(step[2]).rlike(VARIANT), replaced).otherwise(F.col(step[2])), F.lit("  "), F.lit(" "))))
        .drop(*step)
    )


def with_digest(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the digest of the text's canonical form."""
    return with_canonical(df, text, f"{out}_words").withColumn(out, F.sha2(f"{out}_words", 256)).drop(f"{out}_words")


def known_licences(spark: SparkSession, texts: tuple[tuple[str, str], ...] = WHOLE, statements: tuple[tuple[str, str], ...] = STATEMENTS) -> DataFrame:
    """(digest, licence, whole) of known texts (whole) and of what only states a licence; of licences with the same
    canonical text the first by name."""
    rows = spark.createDataFrame([(*t, True) for t in texts] + [(*t, False) for t in statements], "licence string, licence_text string, whole boolean")
    found = with_digest(rows, "licence_text", "digest").groupBy("digest").agg(F.max("whole").alias("whole"), F.min(F.when(F.col("whole"), F.col("licence"))).alias("text"), F.min("licence").alias("any"))
    return found.select("digest", F.coalesce("text", "any").alias("licence"), "whole")


def statements_of(line: Column) -> Column:
    """What a line may state: the line itself, without a defined term and without where the text is to be found; of an
    expression of identifiers a line for each of them."""
    short = F.regexp_replace(F.regexp_replace(line, DEFINED_TERM, ""), WHERE_TO_FIND, "")
    expression = F.regexp_extract(short, IDENTIFIERS, 1)
    names = F.filter(F.split(expression, IDENTIFIER_ENDS), lambda t: t.rlike("[A-Za-z0-9]") & ~F.lower(t).isin(*OPERATORS))
    each = F.transform(names, lambda t: F.concat(F.lit("SPDX-License-Identifier: "), t))
    return F.array_distinct(F.when(expression != "", F.concat(F.array(line), each)).otherwise(F.array(line, short)))


def first_words(spark: SparkSession, texts: tuple[tuple[str, str], ...] = TEXTS) -> list[str]:
    """Words that the canonical form of a known text begins with, in each of their spellings."""
    rows = with_canonical(spark.createDataFrame(list(texts), "licence string, licence_text string"), "licence_text", "words")
    found = {r[0] for r in rows.select(F.substring_index("words", " ", 1)).distinct().collect()}
    for variant, word in reversed(SPELLINGS):  # the replacements are made in order
        if word in found:
            found.add(variant)
    return sorted(found)


def scan_licences(docs: DataFrame, known: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, digest (of the canonical text), licence (whose text it is, or null), notices.

    notices: licences that a line of the text states, or the text as a whole without being the licence's, sorted and
    comma-joined; empty where there are none. Null and empty texts have the digest of the empty text, which is no
    licence's. Repeated rows each get a row, null ids stay. An empty table gives an empty one. Only the two named columns
    are read. known: (digest, licence) and, if some are only statements, whole; one row for each digest.
    """
    begin = first_words(docs.sparkSession) if known is None else None
    known = known_licences(docs.sparkSession) if known is None else known.select("digest", "licence", *(["whole"] if "whole" in known.columns else [F.lit(True).alias("whole")]))
    known = materialise(known, "licences")  # so that Spark knows its size when it chooses the join
    if known.count() <= SENT_LICENCES:
        known = F.broadcast(known)
    read = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    digested = with_digest(read.withColumn("of", F.md5("body")), "body", "digest")
    found = digested.select("id", "of", "digest").join(known, "digest", "left")
    whole = materialise(found.select("id", "of", "digest", F.when(F.col("whole"), F.col("licence")).alias("licence"), F.when(~F.col("whole"), F.col("licence")).alias("stated")), "licences-of-texts")
    lines = read.select("body", F.explode(F.split("body", "\n")).alias("line")).filter(F.trim("line") != "")
    if begin:  # lines that begin with another word have no known digest; this spares most of them the canonical form
        lines = lines.filter(F.regexp_extract(F.lower("line"), FIRST_WORD, 1).isin(begin))
    lines = lines.select("body", F.explode(statements_of(F.col("line"))).alias("line"))
    stated = with_digest(lines, "line", "digest").select("body", "digest").join(known, "digest").select(F.md5("body").alias("of"), "licence")
    stated = stated.unionByName(whole.filter("stated IS NOT NULL").select("of", F.col("stated").alias("licence")))
    # What lines state depends on the text alone: one row for each distinct text, however often it is copied.
    notices = stated.groupBy("of").agg(F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("notices"))
    copies = whole.groupBy("of").agg(F.count("*").alias("copies"))
    notices = materialise(notices.join(copies, "of"), "licence-notices")
    both = hot_join(whole, notices, ["of"], "copies")
    return both.select(F.col("id").alias(id_col), "digest", "licence", F.coalesce("notices", F.lit("")).alias("notices"))
