"""Divergence of sources: how far the term frequencies of the sources of a language lie apart, and which terms a source has more of.

Counting and pairing are SQL that DuckDB runs inside the tasks, over shards that Spark deals out. Each task counts the terms of some megabytes of text at a time;
Spark adds the counts up. The counts are then dealt by a hash of language and term into shards of a bounded number of rows, so that a shard has all counts of its
terms, and a language, a source or a term is never in one task as a whole: one pass of SQL keeps the terms that enough documents have, and one takes for each
shard the partial sums of all pairs of sources and its best terms. Spark adds up the sums, and ranks. The arithmetic is that of whole numbers throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, of_bytes

#: A term is a run of ASCII letters and characters beyond ASCII, A-Z in lower case.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Documents of its language that a term is kept from, what is added to each count, parts that 1 is divided into, and terms of a report.
DOCUMENTS, ADDED, WHOLE, TOP = 30, 5, 1_000_000_000, 50
#: Text that a task counts at once, about, in bytes, rows of a shard, about, and what a task's SQL may hold before it goes to disk.
SLICE, SHARD, MEMORY = 16 << 20, 500_000, "500MB"

#: A row of `texts` is a document.
COUNTS = f"""
WITH words AS (SELECT lang, source, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term, row FROM texts),
     of_texts AS (SELECT lang, source, row, term, count(*) AS n FROM words GROUP BY ALL)
SELECT lang, source, term, sum(n)::BIGINT AS n, count(*) AS documents FROM of_texts GROUP BY ALL"""

#: What is kept of a shard: `counts` has all rows of its terms.
KEPT = f"SELECT lang, source, term, n FROM (SELECT *, sum(documents) OVER (PARTITION BY lang, term) AS in_all FROM counts) WHERE in_all >= {DOCUMENTS}"

_P = f"1 + ({WHOLE}::HUGEINT * (n + {ADDED})) // (total + {ADDED} * terms)"
#: `groups`: all sources of the shard's languages with the sums of their counts, and a row with a null source for the language; `counts`: kept counts of the shard.
_SHARES = f"""
WITH shares AS (
  SELECT g.lang, g.source, t.term, coalesce(c.n, 0) AS n, ({_P.replace("(n +", "(coalesce(c.n, 0) +")})::BIGINT AS p
  FROM (SELECT DISTINCT lang, term FROM counts) t JOIN groups g ON g.lang = t.lang AND g.source IS NOT NULL LEFT JOIN counts c ON c.lang = t.lang AND c.term = t.term AND c.source = g.source)"""
PAIRS = f"""{_SHARES}
SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source GROUP BY ALL"""
TERMS = f"""
WITH wholes AS (SELECT lang, term, sum(n) AS n FROM counts GROUP BY ALL),
     of_lang AS (SELECT w.lang, w.term, ({_P.replace("(n +", "(w.n +")})::BIGINT AS q FROM wholes w JOIN groups g ON g.lang = w.lang AND g.source IS NULL),
     of_source AS (SELECT c.lang, c.source, c.term, ({_P.replace("(n +", "(c.n +")})::BIGINT AS p FROM counts c JOIN groups g ON g.lang = c.lang AND g.source = c.source WHERE c.n > 0)
SELECT s.lang, s.source, s.term AS item, p - q AS value FROM of_source s JOIN of_lang l ON l.lang = s.lang AND l.term = s.term WHERE p > q
QUALIFY row_number() OVER (PARTITION BY s.lang, s.source ORDER BY value DESC, item) <= {TOP}"""


def _sql(query: str, **tables: pa.Table) -> pa.Table:
    """The result of a query over Arrow tables, in this task's thread."""
    import duckdb

    with duckdb.connect(config={"threads": 1, "memory_limit": MEMORY}) as con:
        for name, rows in tables.items():
            con.register(name, rows)
        return con.sql(query).to_arrow_table()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, documents: occurrences of each term in the group, and rows of docs that have it. Null text, lang and source are empty ones."""
    texts = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            yield from _sql(COUNTS, texts=table.append_column("row", pa.array(range(table.num_rows), pa.int64()))).to_batches()

        for batch in of_bytes(batches, "text", SLICE):
            held.append(batch)
            size += batch.nbytes
            if size >= SLICE:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return texts.mapInArrow(run, "lang string, source string, term string, n long, documents long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))


def kept_counts(docs: DataFrame) -> DataFrame:
    """shard, lang, source, term, n of the terms that are kept, all rows of a term in one shard."""
    counts = cut(term_counts(docs), "counts")
    shards = -(-counts.count() // SHARD) or 1
    sharded = counts.withColumn("shard", F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int"))

    def keep(group: pa.Table) -> pa.Table:
        shard = group["shard"][0]
        found = _sql(KEPT, counts=group)
        return found.add_column(0, "shard", pa.repeat(shard, found.num_rows))

    return cut(sharded.groupBy("shard").applyInArrow(keep, "shard int, lang string, source string, term string, n long"), "kept")


def divergence(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank of docs.

    part `pair`: item is each other source of the language, value the sum of differences of the two over all kept terms; part `term`: item is a term that the source
    has a larger share of than the language, value the difference, the first TOP. A group without terms has pairs, too; a source that is alone in its language has
    none. Null text, lang and source are empty ones; a repeated row is a document more; other columns are not read; an empty table gives an empty one."""
    kept = kept_counts(docs)
    sources = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    terms = kept.groupBy("lang", "term").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("whole"))
    of_sources = sources.join(totals, ["lang", "source"], "left").join(terms, "lang", "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"))
    groups = cut(of_sources.unionByName(terms.select("lang", F.lit(None).cast("string").alias("source"), F.col("whole").alias("total"), "terms")), "groups")
    # each shard gets the groups of its languages
    dealt = groups.join(kept.select("lang", F.col("shard").alias("to")).distinct(), "lang")

    def one(counts: pa.Table, groups: pa.Table) -> pa.Table:
        if not counts.num_rows:
            return pa.table({c: pa.array([], kind) for c, kind in (("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64()))})
        found = [(part, _sql(query, counts=counts, groups=groups)) for part, query in (("pair", PAIRS), ("term", TERMS))]
        return pa.concat_tables(t.add_column(2, "part", pa.repeat(part, t.num_rows).cast(pa.string())) for part, t in found)

    partial = cut(kept.groupBy("shard").cogroup(dealt.groupBy("to")).applyInArrow(one, "lang string, source string, part string, item string, value long"), "partial")
    once = partial.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = once.unionByName(once.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    others = sources.join(sources.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = others.join(both, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = pairs.unionByName(partial.where("part = 'term'")).withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= TOP))


SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS row, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
words AS (SELECT row, lang, source, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM docs),
chosen AS (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT row) >= {DOCUMENTS}),
kept AS (SELECT lang, source, term, count(*) AS n FROM words JOIN chosen USING (lang, term) GROUP BY ALL),
size_of AS (SELECT lang, count(*) AS v FROM chosen GROUP BY lang),
sources AS (SELECT DISTINCT lang, source FROM docs),
shares AS (
  SELECT s.lang, s.source, c.term, coalesce(k.n, 0) AS n, sum(coalesce(k.n, 0)) OVER (PARTITION BY s.lang, s.source) AS total, v
  FROM sources s JOIN chosen c ON c.lang = s.lang JOIN size_of z ON z.lang = s.lang LEFT JOIN kept k ON k.lang = s.lang AND k.source = s.source AND k.term = c.term),
p AS (SELECT *, (1 + ({WHOLE}::HUGEINT * (n + {ADDED})) // (total + {ADDED} * v))::BIGINT AS p FROM shares),
of_lang AS (SELECT lang, term, v, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang) AS total FROM shares GROUP BY lang, term, v),
q AS (SELECT lang, term, (1 + ({WHOLE}::HUGEINT * (n + {ADDED})) // (total + {ADDED} * v))::BIGINT AS q FROM of_lang),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT p.lang, p.source, 'term', p.term, p.p - q.q FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE n > 0 AND p.p > q.q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}"""
