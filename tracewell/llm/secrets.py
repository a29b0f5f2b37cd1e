"""Secret scans: three fixed patterns, and a battery of randomness tests for strings that no pattern names.

Candidates are whole runs of key-like characters with a letter that no base span touches. The encoding is inferred (hex,
base32, base36, base62, base64); its symbols become numbers, and three tests ask whether they look drawn uniformly:
chi-squared over equal cells of the alphabet, runs above and below its middle, and correlation of neighbours. The least of
their p-values, times three, says how random a string looks.

What is reported are rejections of the opposite hypothesis, that a string is ordinary text. How random ordinary text looks is
measured: every document gives decoys, strings of hashed place, encoding and length cut from its own text, which pass the same
battery. Within an encoding and length class, a candidate's p-value is the share of decoys that look at least as random, and
the Benjamini-Hochberg step-up over the candidates' p-values bounds the expected share of ordinary strings among those
reported by `rate`. Where a length gives the tests too little to tell a key from text, decoys look random as well and nothing
is reported, so the lengths that are found follow from the data.

Texts are scanned inside their rows; afterwards only the lengths of matches move, keyed by row, and the corpus-wide step
sees counts of a fixed number of bins for a fixed number of classes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

KINDS = ("assign", "access", "hex", "random")
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
#: Fewest characters: of an assigned value; of an access key and a hex string, whose patterns take whole runs and so can ask for the length themselves.
LEAST_VALUE = 8
ACCESS, HEX = r"AKIA[A-Z0-9]{12,}", r"[0-9a-f]{32,}"
#: Fewest characters of a candidate.
SHORTEST = 16
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,}+={0,2}"
#: Alphabets in order of their symbols' values, and the pattern that a whole candidate has to match; the first that does is its encoding.
ENCODINGS = {
    "hex": ("0123456789abcdef", r"^([0-9a-f]+|[0-9A-F]+)$"),
    "base32": ("abcdefghijklmnopqrstuvwxyz234567", r"^[A-Z2-7]+=*$"),
    "base36": ("0123456789abcdefghijklmnopqrstuvwxyz", r"^([0-9a-z]+|[0-9A-Z]+)$"),
    "base62": ("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", r"^[0-9A-Za-z]+$"),
    "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", r"^[0-9A-Za-z+/_=-]+$"),
}
FOLDED = ("hex", "base32", "base36")
#: The rate of false findings, bins of p an octave, and decoys that a document gives.
RATE, BINS, DECOYS = 0.05, 8, 1
#: Half octaves of length, from SHORTEST on, that have a class of their own; longer strings share the last.
CLASSES = 7


def _normal_tail(z: Column) -> Column:
    """P(Z > z), by the logistic approximation (error below 2e-4)."""
    return 1.0 / (1.0 + F.exp(F.least(F.lit(700.0), 1.5976 * z + 0.07056 * z * z * z)))


def _two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2.0 * _normal_tail(F.abs(z)))


def _encoding(token: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, (_, pattern) in reversed(ENCODINGS.items()):
        out = F.when(token.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def _by_encoding(encoding: Column, value) -> Column:
    out = F.lit(None)
    for name in ENCODINGS:
        out = F.when(encoding == name, value(name)).otherwise(out)
    return out


def battery(strings: DataFrame) -> DataFrame:
    """strings (with token and encoding) and symbols, length_class, p_chi, p_runs, p_serial, p: the least of the three p-values times three."""
    bare = F.regexp_replace("token", "=+$", "")
    alphabet = _by_encoding(F.col("encoding"), lambda e: F.lit(ENCODINGS[e][0]))
    folded = F.when(F.col("encoding").isin(*FOLDED), F.lower(bare)).otherwise(F.translate(bare, "-_", "+/"))
    out = strings.withColumn("__alphabet", alphabet).withColumn("__folded", folded)
    out = out.withColumn("__x", F.transform(F.split("__folded", ""), lambda c: F.instr(F.col("__alphabet"), c).cast("double") - 1))
    n, size = F.size("__x").cast("double"), F.length("__alphabet").cast("double")
    length_class = F.least(F.floor(F.log2(n / SHORTEST) * 2), F.lit(CLASSES - 1))
    out = out.withColumns({"symbols": F.size("__x"), "length_class": length_class.cast("int")})
    # chi-squared over cells of equal size: 4 or, from 40 symbols on, 8. Symbols that do not divide evenly share out as their cell has them.
    cells = F.when(n >= 40, 8).otherwise(4)
    out = out.withColumn("__cells", F.transform("__x", lambda v: F.floor(v * cells / size).cast("int")))
    of_cell = lambda c: F.size(F.filter("__cells", lambda v: v == c)).cast("double")
    share = lambda c: (F.ceil((c + 1) * size / cells) - F.ceil(c * size / cells)).cast("double") / size
    chi = F.aggregate(F.sequence(F.lit(0), cells - 1), F.lit(0.0), lambda a, c: a + F.pow(of_cell(c) - n * share(c), F.lit(2.0)) / (n * share(c)))
    out = out.withColumn("__chi", chi)
    freedom = (cells - 1).cast("double")
    cube = (F.pow(F.col("__chi") / freedom, F.lit(1 / 3)) - (1.0 - 2.0 / (9.0 * freedom))) / F.sqrt(2.0 / (9.0 * freedom))
    out = out.withColumn("__high", F.transform("__x", lambda v: (v >= size / 2).cast("int")))
    ones = F.aggregate("__high", F.lit(0), lambda a, v: a + v).cast("double")
    zeros = n - ones
    runs = 1.0 + F.size(F.filter(F.sequence(F.lit(1), F.size("__x") - 1), lambda i: F.get("__high", i) != F.get("__high", i - 1))).cast("double")
    expected = 1.0 + 2.0 * ones * zeros / n
    spread = 2.0 * ones * zeros * (2.0 * ones * zeros - n) / (n * n * (n - 1.0))
    run_z = F.when(spread > 0, (runs - expected) / F.sqrt(spread)).otherwise(F.lit(9.0))
    out = out.withColumns({"__run_z": run_z, "__mean": F.aggregate("__x", F.lit(0.0), lambda a, v: a + v) / n})
    power = F.aggregate("__x", F.lit(0.0), lambda a, v: a + (v - F.col("__mean")) * (v - F.col("__mean")))
    lagged = F.aggregate(F.sequence(F.lit(1), F.size("__x") - 1), F.lit(0.0), lambda a, i: a + (F.get("__x", i) - F.col("__mean")) * (F.get("__x", i - 1) - F.col("__mean")))
    out = out.withColumns({"__power": power, "__lagged": lagged})
    serial_z = F.when(F.col("__power") > 0, (F.col("__lagged") / F.col("__power") + 1.0 / n) * F.sqrt(n)).otherwise(F.lit(9.0))
    out = out.withColumns({"p_chi": _normal_tail(cube), "p_runs": _two_sided(F.col("__run_z")), "p_serial": _two_sided(serial_z)})
    out = out.withColumn("p", F.least(F.lit(1.0), 3.0 * F.least("p_chi", "p_runs", "p_serial")))
    return out.drop(*(c for c in out.columns if c.startswith("__")))


def decoys(docs: DataFrame, each: int = DECOYS) -> DataFrame:
    """token, encoding: strings of ordinary text, `each` of every row of docs with enough of it.

    Place, encoding and length follow from a hash of the text. Words are joined as identifiers join them, each with a capital first letter where
    the encoding has both cases, and cut to the length; what the encoding's alphabet lacks is left out. A string of fewer than SHORTEST symbols is none."""
    names = list(ENCODINGS)
    numbered = docs.where(F.length("text") >= SHORTEST).select("text", F.explode(F.sequence(F.lit(1), F.lit(each))).alias("k")).withColumn("h", F.xxhash64("text", "k"))
    part = lambda shift, n: F.pmod(F.shiftrightunsigned("h", shift), F.lit(n))
    length = F.floor(SHORTEST * F.pow(F.lit(2.0), part(8, CLASSES * 8) / 16.0)).cast("int")
    placed = numbered.select("text", "h", F.element_at(F.array(*map(F.lit, names)), (part(0, len(names)) + 1).cast("int")).alias("encoding"), length.alias("n"))
    # of the letters of text, hex takes about a third
    room = F.col("n") * F.when(F.col("encoding") == "hex", 8).otherwise(3)
    piece = F.substring(F.col("text"), (F.pmod(F.shiftrightunsigned("h", 16), F.greatest(F.length("text") - room + 1, F.lit(1))) + 1).cast("int"), room.cast("int"))
    placed = placed.select("encoding", "n", piece.alias("piece"))
    only = {"hex": "[^0-9a-f]+", "base32": "[^A-Z2-7]+", "base36": "[^0-9a-z]+", "base62": "[^0-9A-Za-z]+", "base64": "[^0-9A-Za-z+/_-]+"}
    cased = lambda e: F.upper("piece") if e == "base32" else F.lower("piece") if e in FOLDED else F.initcap("piece")
    token = _by_encoding(F.col("encoding"), lambda e: F.regexp_replace(cased(e), only[e], ""))
    return placed.select("encoding", F.substring(token, F.lit(1), F.col("n")).alias("token")).where(F.length("token") >= SHORTEST)


def _bin(p: Column) -> Column:
    """Bins of p: the higher, the more random a string looks."""
    return F.floor(F.log2(F.greatest(p, F.lit(1e-12))) * BINS).cast("int")


def thresholds(tested: DataFrame, null: DataFrame, rate: float = RATE) -> DataFrame:
    """encoding, length_class, least: candidates from the bin `least` on are reported, by the step-up over the bins' counts.

    tested and null: encoding, length_class, p of candidates and of decoys. A bin's p-value is the share of decoys in it or above, each class counting
    one decoy more than it has in every bin."""
    counted = lambda df, c, n: df.groupBy("encoding", "length_class", _bin(F.col("p")).alias("bin")).agg(F.count(F.lit(1)).alias("n")).select("encoding", "length_class", "bin", F.col("n").alias(c), F.lit(0).cast("long").alias(n))
    bins = counted(tested, "t", "d").unionByName(counted(null, "d", "t")).groupBy("encoding", "length_class", "bin").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
    group = Window.partitionBy("encoding", "length_class")
    above = group.orderBy(F.desc("bin"))
    ranked = bins.select("encoding", "length_class", "bin", "t", F.sum("t").over(above).alias("rank"), F.sum("t").over(group).alias("all"), ((F.sum("d").over(above) + 1) / (F.sum("d").over(group) + 1)).alias("p_text"))
    return ranked.where((F.col("t") > 0) & (F.col("p_text") <= rate * F.col("rank") / F.col("all"))).groupBy("encoding", "length_class").agg(F.min("bin").alias("least"))


def _matches(text: Column, pattern: str, kind: str, found: Column, keep=None) -> Column:
    """Array of (kind, i, gap, len, token): the i-th match's length and the characters between it and the one before."""
    parts = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), 0).alias("m"), F.slice(F.split(text, pattern, -1), F.lit(1), F.size(F.regexp_extract_all(text, F.lit(pattern), 0))).alias("g"))
    row = lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("len"), (keep(x["m"]) if keep else F.lit(None).cast("string")).alias("token"))
    return F.when(found, F.transform(parts, row)).otherwise(F.array().cast("array<struct<kind:string,i:int,gap:int,len:int,token:string>>"))


def spans(docs: DataFrame, rate: float = RATE, each: int = DECOYS) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): rows has row and doc_id of each row of docs, spans has row, kind, start, end of each secret in it, in code points."""
    text = F.coalesce(F.col("text"), F.lit(""))
    value = lambda m: F.when(F.length(F.regexp_extract(m, ASSIGN, 2)) >= LEAST_VALUE, F.lit("")).otherwise(F.lit(None))
    token = lambda m: F.when(m.rlike("[A-Za-z]"), m)
    every = [
        _matches(text, ASSIGN, "assign", text.rlike(ASSIGN), value),
        _matches(text, ACCESS, "access", text.contains("AKIA"), lambda m: F.lit("")),
        _matches(text, HEX, "hex", text.rlike(HEX), lambda m: F.lit("")),
        _matches(text, CANDIDATE, "random", text.rlike(CANDIDATE), token),
    ]
    rows = cut(docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.flatten(F.array(*every)).alias("found")), "secrets")
    one = rows.where(F.size("found") > 0).select("row", F.explode("found").alias("f")).select("row", "f.*")
    order = Window.partitionBy("row", "kind").orderBy("i")
    end = F.sum(F.col("gap") + F.col("len")).over(order)
    placed = one.select("row", "kind", "token", (end - F.col("len")).alias("start"), end.alias("end")).where(F.col("token").isNotNull())
    # a candidate that a base span touches is found already, and no candidate
    by_start = Window.partitionBy("row").orderBy("start")
    base_end = F.max(F.when(F.col("kind") != "random", F.col("end"))).over(by_start.rangeBetween(Window.unboundedPreceding, 0))
    base_start = F.min(F.when(F.col("kind") != "random", F.col("start"))).over(by_start.rangeBetween(0, Window.unboundedFollowing))
    placed = placed.select("*", (F.coalesce(base_end > F.col("start"), F.lit(False)) | F.coalesce(base_start < F.col("end"), F.lit(False))).alias("touched"))
    placed = cut(placed.where((F.col("kind") != "random") | ~F.col("touched")).drop("touched"), "secrets")
    base = placed.where(F.col("kind") != "random").select("row", "kind", "start", "end")
    tested = cut(battery(placed.where(F.col("kind") == "random").withColumn("encoding", _encoding(F.col("token")))), "secrets")
    null = battery(decoys(docs.select("text"), each)).select("encoding", "length_class", "p")
    # A string counts once, however often it occurs. There are at most five encodings times seven length classes.
    limits = F.broadcast(thresholds(tested.dropDuplicates(["token"]), null, rate))
    random = tested.join(limits, ["encoding", "length_class"]).where(_bin(F.col("p")) >= F.col("least"))
    return rows.select("row", "doc_id"), base.unionByName(random.select("row", "kind", "start", "end"))


def scan(docs: DataFrame, rate: float = RATE, each: int = DECOYS) -> DataFrame:
    """One row for each row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Null and empty texts have no spans: counts 0, spans "" and the hash of "". A repeated row is scanned as often as it
    occurs. doc_id may be null. Other columns of docs are not read. A match of a kind ends where the pattern ends; base spans of
    different kinds may overlap; a span of kind random overlaps none of them. In a table with so little text that no class has
    1 / rate decoys, only base spans are found.
    """
    rows, found = spans(docs, rate, each)
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    said = F.concat_ws(":", "kind", "start", "end")
    lists = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), number.alias("number"), said.alias("said")))).alias("spans"))
    every = F.coalesce(F.col("spans"), F.array().cast("array<struct<start:bigint,number:int,said:string>>"))
    base = F.filter(every, lambda x: x["number"] <= 3)
    joined = lambda a: F.array_join(F.transform(a, lambda x: x["said"]), ",")
    of_kind = lambda k: F.size(F.filter(every, lambda x: x["number"] == k)).cast("long")
    return rows.join(lists, "row", "left").select("doc_id", of_kind(1).alias("n_assign"), of_kind(2).alias("n_access"), of_kind(3).alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(every).alias("spans"))
