"""Quality rules: robust multivariate outliers.

Each text gets a vector of transformed statistics. Per language and source, centre and scatter of the vectors are the
minimum covariance determinant estimates: of three deterministic starts (quartiles, plain moments, spatial signs), each is
taken through concentration steps, in which the half of the rows nearest to the centre gives the next mean and covariance,
until the determinants stand still; the start with the least determinant counts, and one reweighting step by the 0.975
quantile follows. A document whose squared Mahalanobis distance is beyond the cutoff is rejected, as is one that fails the
base rules. Up to half of a group may be junk before junk can move its estimates.

Everything is DataFrame expressions: a group is only ever seen as partial sums and as counts of a bounded number of
distance bins, so a group may hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD_BREAK, cut, let, release

#: Transformed statistics of a text.
STATS = ("length", "word_length", "symbols", "duplicate_lines", "repeated_words")
#: Most concentration steps, the change of a group's log determinant at which it stands still, and the fewest rows of a group for estimates of its own.
STEPS, STILL, LEAST = 8, 0.01, 40
#: Of chi-squared with five degrees of freedom: the 0.9999 quantile, at which a document is rejected, and the 0.975 quantile of the reweighting step.
CUTOFF, REWEIGHT = 25.745, 12.8325
#: The inverse of the share of variance that five-dimensional normal data keep in their nearest half, and within the 0.975 quantile: for consistency.
HALF_FACTOR, REWEIGHT_FACTOR = 1.9122, 1.0555
#: Distance bins an octave. The rows of the bin in which a half ends count in part, so that the weights add up to the half.
BINS = 16
#: Least variance of each statistic. Most clean texts have no symbols and no repeats at all, so their own variance there is near 0; one repeated line or a few symbols are not yet outliers.
LEAST_VARIANCE = (0.05, 0.01, 0.04, 0.25, 0.75)


def word_statistics(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; a null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    repeated_lines = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    out = docs.withColumn("__words", F.array_remove(F.split(text, WORD_BREAK, -1), ""))
    out = out.withColumns({"n_words": F.size("__words").cast("long"), "__h": F.transform("__words", lambda w: F.xxhash64(w))})
    n = F.col("n_words").cast("int")
    # hashes of runs of two, four and eight words: each of two runs of half the length
    joined = lambda runs, step, left: let(runs, lambda h: F.zip_with(F.slice(h, F.lit(1), left), F.slice(h, F.lit(step + 1), left), lambda a, b: F.xxhash64(a, b)))
    eights = joined(joined(joined(F.col("__h"), 1, n - 1), 2, n - 3), 4, n - 7)
    out = out.withColumn("__h", F.when(n >= 8, eights))
    # only a text that repeats a run has its runs sorted: a run is repeated if a neighbour has its hash
    repeats = F.size(F.array_distinct("__h")) < F.size("__h")
    out = out.withColumn("__runs", F.when(repeats, F.array_sort(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda i, j: F.coalesce(F.get("__runs", j)["h"] == F.get("__runs", i)["h"], F.lit(False))
    at = F.filter(F.transform("__runs", lambda r, i: F.when(same(i, i + 1) | (F.when(i > 0, same(i, i - 1)).otherwise(F.lit(False))), r["i"])), lambda x: x.isNotNull())
    out = out.withColumn("__at", F.array_sort(at))
    reach = F.transform("__at", lambda p, i: F.least(F.lit(8), F.coalesce(F.get("__at", i + 1) - p, F.lit(8))))
    n_repeat = F.coalesce(F.aggregate(reach, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")
    return out.withColumns({
        "word_chars": F.length(F.array_join("__words", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": repeated_lines.cast("long"),
        "n_repeat_words": n_repeat,
    }).drop("__words", "__h", "__runs", "__at")


def _vector() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "length": F.log1p(F.col("n_words").cast("double")),
        "word_length": F.log1p(F.col("word_chars") / words),
        "symbols": F.log1p(100.0 * F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        "duplicate_lines": F.log1p(F.col("n_dup_lines").cast("double")),
        "repeated_words": F.log1p(100.0 * F.col("n_repeat_words") / words),
    }


def _pairs(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i + 1)]


def _distance(p: int) -> str:
    """Squared Mahalanobis distance of x0.. from m0..; w00.. is the inverse of the covariance's Cholesky factor."""
    whitened = ["(" + " + ".join(f"w{i}{j} * (x{j} - m{j})" for j in range(i + 1)) + ")" for i in range(p)]
    return " + ".join(f"{y} * {y}" for y in whitened)


def _moments(p: int, weight: str) -> list[Column]:
    """Aggregates n, s0.., q00..: weighted sums of rows, values and products."""
    sums = {"n": weight} | {f"s{i}": f"{weight} * x{i}" for i in range(p)} | {f"q{i}{j}": f"{weight} * x{i} * x{j}" for i, j in _pairs(p)}
    return [F.expr(f"sum({v}) AS {k}") for k, v in sums.items()]


def _scatter(p: int, factor: float) -> list[str]:
    """From moments to means m0.. and covariances c00.. times a factor."""
    return [f"s{i} / n AS m{i}" for i in range(p)] + [f"{factor}D * (q{i}{j} / n - s{i} / n * s{j} / n) AS c{i}{j}" for i, j in _pairs(p)]


def _factored(scatter: DataFrame, p: int, *keys: str) -> DataFrame:
    """From means m and covariances c, with the least variances added to their diagonal, to means, w (the inverse of the Cholesky factor) and log_det."""
    out = scatter
    for j in range(p):  # column by column of the factor l, and then row by row of its inverse
        rest = lambda i, j=j: f"c{i}{j}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
        variance = rest(j).replace(f"c{j}{j}", f"greatest(c{j}{j}, 0D) + {LEAST_VARIANCE[j]}D", 1)
        out = out.withColumn(f"l{j}{j}", F.expr(f"sqrt(greatest({variance}, {LEAST_VARIANCE[j] / 10}D))"))
        out = out.withColumns({f"l{i}{j}": F.expr(f"({rest(i)}) / l{j}{j}") for i in range(j + 1, p)})
    for i in range(p):
        inverse = {f"w{i}{j}": F.expr("-(" + " + ".join(f"l{i}{k} * w{k}{j}" for k in range(j, i)) + f") / l{i}{i}") for j in range(i)}
        out = out.withColumns(inverse | {f"w{i}{i}": F.expr(f"1D / l{i}{i}")})
    return out.selectExpr(*keys, *(f"m{i}" for i in range(p)), *(f"w{i}{j}" for i, j in _pairs(p)), " + ".join(f"2D * ln(l{i}{i})" for i in range(p)) + " AS log_det")


def _few(groups: DataFrame) -> bool:
    """Groups of estimates are broadcast only while there are at most 10,000 (3 kB each with all starts); beyond, they are joined by shuffle."""
    return groups.limit(10_001).count() <= 10_000


def _starts(vectors: DataFrame, p: int) -> DataFrame:
    """g, start, means and whitening: from quartiles; from plain moments; from spatial signs, which weigh every row by its direction alone."""
    quartiles = cut(vectors.groupBy("g").agg(*(F.expr(f"percentile_approx(x{i}, array(0.25, 0.5, 0.75), 1000) AS p{i}") for i in range(p)), *_moments(p, "1D")), "mcd")
    scales = [f"greatest((p{i}[2] - p{i}[0]) / 1.349, sqrt({LEAST_VARIANCE[i]}D))" for i in range(p)]
    apart = [f"0D AS c{i}{j}" if i != j else f"{scales[i]} * {scales[i]} - {LEAST_VARIANCE[i]}D AS c{i}{i}" for i, j in _pairs(p)]
    robust = _factored(quartiles.selectExpr("g", "0 AS start", *(f"p{i}[1] AS m{i}" for i in range(p)), *apart), p, "g", "start")
    plain = _factored(quartiles.selectExpr("g", "1 AS start", *_scatter(p, 1.0)), p, "g", "start")
    u = [f"((x{i} - p{i}[1]) / {scales[i]})" for i in range(p)]
    size = f"greatest({' + '.join(f'{v} * {v}' for v in u)}, 1e-12D)"
    turned = vectors.join(F.broadcast(quartiles) if _few(quartiles) else quartiles, "g").selectExpr("g", *(f"p{i}[1] AS m{i}" for i in range(p)), *(f"{p} * ({x} * {y} / {size}) * ({scales[i]}) * ({scales[j]}) AS c{i}{j}" for (i, j) in _pairs(p) for x, y in [(u[i], u[j])]))
    signs = turned.groupBy("g").agg(*(F.expr(f"first(m{i}) AS m{i}") for i in range(p)), *(F.expr(f"avg(c{i}{j}) AS c{i}{j}") for i, j in _pairs(p)))
    return robust.unionByName(plain).unionByName(_factored(signs.withColumn("start", F.lit(2)), p, "g", "start"))


def _concentrated(vectors: DataFrame, now: DataFrame, p: int, few: bool) -> DataFrame:
    """One concentration step of every group and start."""
    binned = vectors.join(F.broadcast(now) if few else now, "g").withColumn("bin", F.expr(f"cast(floor(log2({_distance(p)} + 1e-6D) * {BINS}) AS int)"))
    counts = binned.groupBy("g", "start", "bin").agg(F.count(F.lit(1)).alias("in_bin"))
    group = Window.partitionBy("g", "start")
    upto = counts.select("*", F.sum("in_bin").over(group.orderBy("bin")).alias("upto"), F.floor((F.sum("in_bin").over(group) + p + 1) / 2).alias("half"))
    last = upto.where("upto >= half").groupBy("g", "start").agg(F.min_by(F.expr("struct(bin AS most, (half - upto + in_bin) / in_bin AS part)"), "bin").alias("last")).select("g", "start", "last.*")
    near = binned.join(F.broadcast(last) if few else last, ["g", "start"]).where("bin <= most").withColumn("v", F.expr("if(bin < most, 1D, part)"))
    return _factored(near.groupBy("g", "start").agg(*_moments(p, "v")).selectExpr("g", "start", *_scatter(p, HALF_FACTOR)), p, "g", "start")


def estimates(vectors: DataFrame, p: int, steps: int = STEPS) -> DataFrame:
    """g, means m, whitening w and log_det of the covariance. vectors: g, x0.., one row each."""
    now = cut(_starts(vectors, p), "mcd")
    few = _few(now)
    for _ in range(steps):
        after = cut(_concentrated(vectors, now, p, few), "mcd")
        change = now.select("g", "start", F.col("log_det").alias("before")).join(after, ["g", "start"]).agg(F.max(F.abs(F.col("log_det") - F.col("before")))).first()[0]
        release(now)
        now = after
        if change is None or change < STILL:
            break
    best = now.groupBy("g").agg(F.min_by(F.struct(*(c for c in now.columns if c not in ("g", "start"))), F.struct("log_det", "start")).alias("best")).select("g", "best.*")
    inside = vectors.join(F.broadcast(best) if few else best, "g").where(f"{_distance(p)} <= {REWEIGHT}D")
    return cut(_factored(inside.groupBy("g").agg(*_moments(p, "1D")).selectExpr("g", *_scatter(p, REWEIGHT_FACTOR)), p, "g"), "mcd")


def quality_verdicts(docs: DataFrame, cutoff: float = CUTOFF, least: int = LEAST) -> DataFrame:
    """doc_id, the statistics, base_failed, distance and kept, one row for each row of docs.

    lang and source may be null (a group of its own). A group of fewer than `least` rows has no estimate of its own and
    takes that of its language, or of all rows if that too is small. An empty table gives an empty one. Repeated rows count
    as often as they occur. Other columns of docs are not read. Estimates are made of the rows that the base rules keep, so
    short and repetitive texts do not stretch them; if a group has none, nothing in it is kept anyway.
    """
    named = docs.select("doc_id", "lang", "source", "text")
    stats = word_statistics(named).drop("text")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    p = len(STATS)
    # The statistics are computed once and kept: the steps read a few numbers a row, not texts.
    name = lambda *c: F.to_json(F.struct(*c), {"ignoreNullFields": "false"})
    own, language, every = name(F.col("lang"), F.col("source")), name(F.col("lang")), F.lit("all")
    rows = cut(stats.withColumns({f"x{i}": v for i, v in enumerate(_vector().values())}).withColumns({"base_failed": failed, "own": own, "language": language}), "stats")
    good = rows.where(~F.col("base_failed"))
    sizes = good.groupBy("own", "language").agg(F.count(F.lit(1)).alias("n"))
    by_language = Window.partitionBy("language")
    chosen = cut(sizes.select("own", F.when(F.col("n") >= least, F.col("own")).when(F.sum("n").over(by_language) >= least, F.col("language")).otherwise(every).alias("g")), "mcd")
    # Each row counts in its group, in its language and among all, as far as any group takes its estimate from there.
    used = chosen.select("g").distinct()
    few = _few(chosen)
    vectors = good.select(F.explode(F.array("own", "language", every)).alias("g"), *(f"x{i}" for i in range(p))).join(F.broadcast(used) if few else used, "g", "left_semi")
    by_own = cut(chosen.join(estimates(vectors, p), "g").drop("g", "log_det"), "mcd")
    judged = rows.join(F.broadcast(by_own) if few else by_own, "own", "left")
    distance = F.expr(f"if(m0 IS NOT NULL, {_distance(p)}, NULL)")
    return judged.withColumn("distance", distance).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= cutoff)).alias("kept"), "distance")
