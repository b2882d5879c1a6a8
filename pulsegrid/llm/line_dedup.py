"""Line dedup by windows of three consecutive lines, repeated anywhere in the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import materialise

_BLANK_CHARS = " \t\n\x0b\x0c\r"
#: Between the end of a sentence of 24 characters or more and a blank; shorter ones say too little to be lines.  Its first part fails at once in most places.
_SENTENCE_END = r"(?<=[.!?])(?=[ \t])(?<=[^.!?]{24}[.!?])"


def _lines(text):
    """All lines of a text, in order, as (at, row, s): a line's number, the number of newlines before it, and its text."""
    rows = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    cut = F.flatten(F.transform(rows, lambda row, i: F.transform(F.split(row, _SENTENCE_END, -1), lambda s: F.struct(i.alias("row"), s.alias("s")))))
    return F.transform(cut, lambda x, k: F.struct(k.alias("at"), x["row"].alias("row"), x["s"].alias("s")))


def _solid(lines):
    """The (at, stripped text) of the lines that have a word."""
    return F.filter(F.transform(lines, lambda x: F.struct(x["at"].alias("at"), F.btrim(x["s"], F.lit(_BLANK_CHARS)).alias("s"))), lambda x: x["s"] != "")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, positions): the numbers of a row's lines that later occurrences of repeated windows cover.

    docs has doc_id, row_key and solid (see _solid).  The first occurrence of a
    window is the one with the smallest (doc_id, line number).  Windows are
    known by 128 bits of hash.  Counts and first occurrences are partial
    aggregates, so a window that a third of all documents share costs a row
    from each task; the join that then finds its later occurrences is one that
    adaptive execution can split.
    """
    s = F.col("solid")

    def window(i):
        three = [s[i]["s"], s[i + 1]["s"], s[i + 2]["s"]]
        return F.struct(
            F.xxhash64(*three).alias("h1"),
            F.xxhash64(F.lit("second"), *three).alias("h2"),
            *[s[i + k]["at"].alias(n) for k, n in enumerate("abc")],
        )

    windows = (
        docs.where(F.size("solid") >= 3)
        .select("doc_id", "row_key", F.explode(F.transform(F.sequence(F.lit(0), F.size("solid") - 3), window)).alias("w"))
        .select("doc_id", "row_key", "w.*")
    )
    windows = materialise(windows, "line-windows")
    place = F.struct("doc_id", "a", "row_key")
    first = (
        windows.groupBy("h1", "h2")
        .agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .where(~F.col("first").eqNullSafe(F.col("last")))
        .drop("last")
    )
    first = materialise(first, "first-windows")  # so both sides of the join are shuffles, which it takes to split a hot key
    later = windows.join(first.hint("merge"), ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    return (
        later.groupBy("doc_id", "row_key")
        .agg(F.collect_set(F.struct("a", "b", "c")).alias("w"))
        .select("doc_id", "row_key", F.array_distinct(F.flatten(F.transform("w", lambda w: F.array(w["a"], w["b"], w["c"])))).alias("positions"))
    )


def line_dedup(docs: DataFrame) -> DataFrame:
    """Every row of docs (doc_id, text, ...) with the later occurrences of repeated three-line windows taken out of text.

    A line ends at a newline, or where a blank follows a sentence's end (. ! ?)
    that has 24 characters without one before it, so a paragraph without
    newlines is several lines, and a short sentence is one with the next.  Lines without a word are
    neither counted in windows nor removed; the others are compared without
    blanks at their ends.  A row with fewer than three such lines has no window
    and stays as it is, as do null and empty texts.  All lines that later
    occurrences cover go, so overlapping windows merge; what stays of a
    paragraph stays together, and a paragraph of which nothing stays goes with
    its newline.  Rows equal in doc_id and text count as one occurrence and come
    out alike; rows with a null doc_id take part as the smallest id.  A text of
    which all lines go becomes empty.  Added columns: n_lines and n_removed
    (long) and removed, the line numbers that went, ascending; columns of docs
    by these names are replaced.
    """
    keyed = docs.withColumn("row_key", F.xxhash64("doc_id", "text"))
    gone = repeated_lines(keyed.select("doc_id", "row_key", _lines(F.col("text")).alias("lines")).select("doc_id", "row_key", _solid(F.col("lines")).alias("solid")))
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key"), F.col("positions").alias("_positions"))
    gone = gone.hint("merge")  # a plan for any share of rows: what goes grows with docs
    here = keyed.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row_key") == F.col("_key")), "left")
    out = here.withColumn("_lines", _lines(F.col("text")))
    out = out.withColumn("removed", F.coalesce(F.array_sort("_positions"), F.array().cast("array<int>")))
    rest = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "removed")
    out = out.withColumn("_stays", F.when(F.size("removed") > 0, F.transform(rest, lambda k: F.col("_lines")[k])))
    ahead = F.slice(F.concat(F.slice("_stays", 1, 1), F.col("_stays")), 1, F.size("_stays"))
    pieces = F.zip_with("_stays", ahead, lambda x, before: F.concat(F.when(x["row"] != before["row"], "\n").otherwise(""), x["s"]))
    text = F.when(F.size("removed") == 0, F.col("text")).otherwise(F.array_join(pieces, ""))
    keep = [c for c in docs.columns if c not in ("n_lines", "n_removed", "removed")]
    return out.select(
        *[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in keep],
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size("_lines")).cast("long").alias("n_lines"),
        F.size("removed").cast("long").alias("n_removed"),
        "removed",
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS rows_ FROM documents),
q AS (SELECT doc_id, r, unnest(string_split(regexp_replace(rows_[r], '([.!?])([ \t])', '\1' || chr(10) || '\2', 'g'), chr(10))) AS s, generate_subscripts(string_split(regexp_replace(rows_[r], '([.!?])([ \t])', '\1' || chr(10) || '\2', 'g'), chr(10)), 1) AS u
      FROM (SELECT doc_id, rows_, unnest(range(1, len(rows_) + 1)) AS r FROM d)),
e AS (SELECT *, sum(CASE WHEN regexp_matches(s, '[^.!?]{24}[.!?]$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, r ORDER BY u) - CASE WHEN regexp_matches(s, '[^.!?]{24}[.!?]$') THEN 1 ELSE 0 END AS v FROM q),
p AS (SELECT doc_id, r, v AS u, string_agg(s, '' ORDER BY u) AS s FROM e GROUP BY doc_id, r, v),
l AS (SELECT doc_id, r, s, row_number() OVER (PARTITION BY doc_id ORDER BY r, u) AS pos, trim(s, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM p),
w AS (SELECT doc_id, pos AS a, lead(pos, 1) OVER o AS b, lead(pos, 2) OVER o AS c, t || chr(10) || lead(t, 1) OVER o || chr(10) || lead(t, 2) OVER o AS k FROM l WHERE t <> '' WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, a) AS n FROM w WHERE c IS NOT NULL),
g AS (SELECT DISTINCT doc_id, pos FROM (SELECT doc_id, unnest([a, b, c]) AS pos FROM f WHERE n > 1)),
h AS (SELECT l.*, g.pos IS NOT NULL AS gone FROM l LEFT JOIN g USING (doc_id, pos)),
k AS (SELECT doc_id, r, string_agg(s, '' ORDER BY pos) AS s FROM h WHERE NOT gone GROUP BY doc_id, r),
t AS (SELECT doc_id, string_agg(s, chr(10) ORDER BY r) AS text FROM k GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  md5(CASE WHEN coalesce(n_removed, 0) = 0 THEN d.text ELSE coalesce(t.text, '') END) AS text_md5
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""
