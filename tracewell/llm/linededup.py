"""Line dedup over windows of three consecutive lines.

Every run of three lines of every document is hashed. A run that occurs more than once in the corpus stays
where it occurs first (lowest doc_id, then lowest line) and its lines are removed wherever it occurs again;
overlapping later runs merge, so each line is covered or not. The earliest copy of a line is never covered, since
the run that would cover it has an earlier copy of that line.

Texts and their lines stay inside their rows: only the hashes of runs and the covered positions are shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, let

#: Lines of a window.
WINDOW = 3
BLANKS = " \t\n\x0b\f\r"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _runs(text: Column, window: int) -> Column:
    """Array of (pos, a, b, has_word): two independent hashes of each run of lines. A line is hashed once, a run from its lines' hashes."""
    line = lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit("second"), x).alias("b"), (F.ltrim(x, F.lit(BLANKS)) != "").alias("w"))

    def runs(h: Column) -> Column:
        of = lambda i, field: [F.get(h, i + j)[field] for j in range(window)]
        run = lambda i: F.struct(i.alias("pos"), F.xxhash64(*of(i, "a")).alias("a"), F.xxhash64(*of(i, "b")).alias("b"), reduce(Column.__or__, of(i, "w")).alias("has_word"))
        return F.when(F.size(h) >= window, F.transform(F.sequence(F.lit(0), F.size(h) - window), run))

    return let(F.transform(lines_of(text), line), runs)


def covered_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, covered: the sorted line numbers (from 0) that a later copy of a repeated run covers."""
    runs = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.explode(_runs(F.col("text"), window)).alias("r")).where("r.has_word").select("doc_id", "r.pos", "r.a", "r.b")
    runs = cut(runs, "runs")  # some bytes a line, so that texts are read once for them
    first = runs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "pos")).alias("first")).where("n > 1").select("a", "b", "first")
    later = runs.join(first, ["a", "b"]).where(F.struct("doc_id", "pos") != F.col("first")).select("doc_id", "pos")
    lines = later.select("doc_id", F.explode(F.sequence(F.col("pos"), F.col("pos") + (window - 1))).alias("line"))
    return lines.groupBy("doc_id").agg(F.array_sort(F.collect_set("line")).alias("covered"))


def _deduped(docs: DataFrame, window: int) -> DataFrame:
    """docs with their text cut and __n_lines, __n_removed."""
    covered = covered_lines(docs, window).select(F.col("doc_id").alias("__of"), F.col("covered").alias("__covered"))
    lines = lines_of(F.col("text"))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__covered"))
    kept = let(lines, lambda each: F.transform(left, lambda i: F.get(each, i)))
    out = docs.join(covered, F.col("doc_id") == F.col("__of"), "left")
    n_removed = F.when(F.col("text").isNull() | F.col("__covered").isNull(), 0).otherwise(F.size(lines) - F.size(left))
    out = out.withColumns({"__n_lines": F.coalesce(F.size(lines), F.lit(0)).cast("long"), "__n_removed": n_removed.cast("long")})
    text = F.when(F.col("__covered").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return out.withColumn("text", text).drop("__of", "__covered")


def dedup_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with text cut to the lines that are not covered, and n_lines, n_removed.

    Every row is returned. A null text stays null, with no lines; a text of fewer than three lines has no run and
    stays as it is; runs without a word are not compared. Rows with a null doc_id have no place in the order of
    documents: they stay as they are and are not compared. Rows that share a doc_id have the same covered lines, so
    a repeated row loses what its twin loses; runs at the same doc_id and line count as one place. Columns beyond
    doc_id and text pass through; own columns named n_lines or n_removed are replaced.
    """
    return _deduped(docs.drop("n_lines", "n_removed"), window).withColumnsRenamed({"__n_lines": "n_lines", "__n_removed": "n_removed"})


def stage(docs: DataFrame) -> DataFrame:
    """The columns of docs with the lines that are left. A document of which only blanks are left goes; one that lost nothing stays."""
    has_word = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return _deduped(docs, WINDOW).where((F.col("__n_removed") == 0) | has_word).select(*docs.columns)


SQL = f"""
WITH lines AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
runs AS (SELECT doc_id, pos, array_to_string(l[pos + 1 : pos + {WINDOW}], chr(10)) AS run
  FROM (SELECT doc_id, l, unnest(range(0, len(l) - {WINDOW - 1})) AS pos FROM lines WHERE len(l) >= {WINDOW})),
worded AS (SELECT * FROM runs WHERE regexp_matches(run, '[^\\x20\\x09-\\x0D]')),
ranked AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) AS k FROM worded),
covered AS (SELECT DISTINCT doc_id, pos + unnest(range(0, {WINDOW})) AS line FROM ranked WHERE k > 1),
each AS (SELECT doc_id, unnest(l) AS line_text, unnest(range(0, len(l))) AS line FROM lines),
kept AS (SELECT e.doc_id, string_agg(e.line_text, chr(10) ORDER BY e.line) AS text, count(*) AS n
  FROM each e LEFT JOIN covered c ON e.doc_id = c.doc_id AND e.line = c.line WHERE c.line IS NULL GROUP BY e.doc_id)
SELECT d.doc_id, coalesce(len(d.l), 0) AS n_lines, coalesce(len(d.l) - coalesce(k.n, 0), 0) AS n_removed,
  CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM lines d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
