"""Secrets by exact patterns and by a battery of randomness tests.

Candidate tokens are those whose characters fit an encoding of random bytes. A battery tests
each distinct token for what random text of that encoding would show: uniform use of the
alphabet (chi-squared), runs above and below its middle, and no correlation of neighbours. The
tests' p-values are combined; tokens are held to be not random where the false-discovery rate
of saying so, within tokens of like length, is controlled. The rest are secrets. Only DataFrame
functions are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwatch.llm.common import ready, wide_hash, written

KINDS = ("assign", "access", "hex", "random")
ASSIGN = (
    r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]+"
# Runs of 16 or more are the runs of any length that are kept.
HEX = r"[0-9a-f]{16,}"
TOKEN = r"[A-Za-z0-9+/_-]{16,}"

# Encodings by what a token holds: name, pattern, alphabet. Letters stand by their frequency in
# words: any order is uniform under random text, but with this one words crowd in a few cells.
DIGITS, LOWER = "0123456789", "etaoinshrdlucmfwypvbgkjqxz"
UPPER = LOWER.upper()
ENCODINGS = (
    ("hex", r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", DIGITS + "abcdef"),
    ("HEX", r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("base32", r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$", UPPER + "234567"),
    ("BASE36", r"^(?=.*[0-9])(?=.*[A-Z])[A-Z0-9]+$", DIGITS + UPPER),
    ("base36", r"^(?=.*[0-9])(?=.*[a-z])[a-z0-9]+$", DIGITS + LOWER),
    ("base62", r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9]+$", DIGITS + UPPER + LOWER),
    ("base64", r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/"),
    ("url64", r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_"),
)
# A run that fits no encoding is cut into pieces of these characters: at each kind of separator
# alone and at all of them.
PIECES = (
    r"[A-Za-z0-9+/]{16,}",
    r"[A-Za-z0-9_-]{16,}",
    r"[A-Za-z0-9-]{16,}",
    r"[A-Za-z0-9_]{16,}",
    r"[A-Za-z0-9]{16,}",
)
# Rate of random tokens among those held to be not random.
FALSE_DISCOVERIES = 0.01
# Fewer bits than this are too short to be told from chance.
LEAST_BITS = 80.0
# Tokens are compared with those of like length: classes by these lower ends.
LENGTHS = (16, 24, 32, 48, 96)
# p-values are counted in bins of equal steps of their logarithm.
BINS, PER_DECADE = 1024, 32


def segments(text: Column, pattern: str) -> Column:
    """The text cut behind each match of a leftmost search: every piece ends with one match.
    Anchored at the end of the last, so that the text behind the last match is passed once."""
    return F.regexp_extract_all(text, F.lit(r"\G[\s\S]*?" + f"(?:{pattern})"), F.lit(0))


def located(text: Column, pattern: str, kind: str, keep) -> Column:
    """Spans, in code points, of the matches that ``keep(match)`` holds for."""
    empty = F.array().cast("array<struct<start:long,kind:string,end:long,token:string>>")

    def add(acc: Column, piece: Column) -> Column:
        match = F.regexp_extract(piece, pattern + "$", 0)
        end = acc["at"] + F.length(piece)
        span = F.struct(
            (end - F.length(match)).cast("long").alias("start"),
            F.lit(kind).alias("kind"),
            end.cast("long").alias("end"),
            match.alias("token"),
        )
        spans = F.when(keep(match), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct(end.cast("long").alias("at"), spans.alias("spans"))

    start = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("spans"))
    return F.aggregate(segments(text, pattern), start, add, lambda acc: acc["spans"])


def base_spans(text: Column) -> Column:
    long_value = lambda m: F.length(F.regexp_extract(m, "^" + ASSIGN, 2)) >= 12
    return F.concat(
        located(text, ASSIGN, "assign", long_value),
        located(text, ACCESS, "access", lambda m: F.length(m) >= 18),
        located(text, HEX, "hex", lambda m: F.length(m) >= 16),
    )


def ordered(spans: Column) -> Column:
    """By start, then kind as listed, then end."""
    rank = lambda k: F.array_position(F.array(*map(F.lit, KINDS)), k)
    keyed = F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"),
            rank(s["kind"]).alias("rank"),
            s["end"].alias("end"),
            s["kind"].alias("kind"),
        ),
    )
    return F.transform(
        F.array_sort(keyed),
        lambda s: F.struct(
            s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")
        ),
    )


def upper_tail(z: Column) -> Column:
    """Upper tail of the normal distribution: the logistic form z (1.5976 + 0.070566 z^2) of
    its logarithmic odds, within 2e-4 everywhere."""
    z = F.greatest(F.lit(-12.0), F.least(z, F.lit(12.0)))
    return 1.0 / (1.0 + F.exp(z * (1.5976 + 0.070566 * z * z)))


def fits_any(token: Column) -> Column:
    return reduce(lambda a, b: a | b, [token.rlike(pattern) for _, pattern, _ in ENCODINGS])


def with_pieces(able: DataFrame) -> DataFrame:
    """``able(k1, k2, start, end, token)`` with ``run``, the start of the run: runs that fit an
    encoding as they are, others by their pieces. Pieces that fit none themselves are tested
    with ``-`` and ``_`` left out; their spans hold the separators."""
    able = able.withColumn("run", F.col("start"))
    fits = fits_any(F.col("token"))
    has_digit = lambda t: t.rlike("[0-9]")
    pieces = F.flatten(F.array(*[located(F.col("token"), p, "random", has_digit) for p in PIECES]))
    pieces = able.where(~fits).select("k1", "k2", "run", F.explode(F.array_distinct(pieces)).alias("s"))
    token = F.col("s.token")
    pieces = pieces.select(
        "k1",
        "k2",
        (F.col("run") + F.col("s.start")).alias("start"),
        (F.col("run") + F.col("s.end")).alias("end"),
        F.when(fits_any(token), token).otherwise(F.regexp_replace(token, "[_-]", "")).alias("token"),
        "run",
    )
    return able.where(fits).unionByName(pieces)


def merged(spans: Column) -> Column:
    """Spans (start, end) of one run, those that overlap as one."""
    empty = F.array().cast("array<struct<start:long,end:long>>")

    def add(acc: Column, span: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        both = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
        rest = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        touches = (F.size(acc) > 0) & (span["start"] < last["end"])
        return F.when(touches, F.concat(rest, F.array(both))).otherwise(F.concat(acc, F.array(span)))

    return F.aggregate(F.array_sort(spans), empty, add)


def battery(tokens: DataFrame) -> DataFrame:
    """Adds ``encoding``, ``bits`` and the combined ``p`` to ``tokens(token)``; tokens that fit
    no encoding are left out."""
    encoding = F.lit(None).cast("string")
    alphabet = F.lit(None).cast("string")
    for name, pattern, letters in reversed(ENCODINGS):
        fits = F.col("token").rlike(pattern)
        encoding = F.when(fits, name).otherwise(encoding)
        alphabet = F.when(fits, letters).otherwise(alphabet)
    rows = tokens.withColumn("encoding", encoding).withColumn("alphabet", alphabet)
    rows = rows.where("encoding is not null")
    n, m = F.length("token").cast("double"), F.length("alphabet").cast("double")
    rows = rows.select(
        *tokens.columns,
        "encoding",
        n.alias("n"),
        m.alias("m"),
        (n * F.log2(m)).alias("bits"),
        F.transform(
            F.split("token", ""), lambda c: (F.instr(F.col("alphabet"), c) - 1).cast("double")
        ).alias("x"),
        F.when(n < 24, 4.0).when(n < 64, 8.0).otherwise(16.0).alias("k"),
    )
    return _tested(rows, tokens.columns)


def _tested(rows: DataFrame, keep: list[str]) -> DataFrame:
    x, n, m, k = (F.col(c) for c in ("x", "n", "m", "k"))
    zero = F.lit(0.0)
    cells = F.transform(
        F.sequence(F.lit(0), (k - 1).cast("int")),
        lambda j: F.size(F.filter(x, lambda v: F.floor(v * k / m) == j)).cast("double"),
    )
    # Cells of an alphabet whose size is no multiple of k are not of one size.
    share = F.transform(
        F.sequence(F.lit(0), (k - 1).cast("int")),
        lambda j: (F.ceil((j + 1) * m / k) - F.ceil(j * m / k)).cast("double") / m,
    )
    chi = F.aggregate(
        F.zip_with(cells, share, lambda c, s: (c - n * s) * (c - n * s) / (n * s)),
        zero,
        lambda a, b: a + b,
    )
    df = k - 1
    chi_z = (F.pow(chi / df, 1.0 / 3.0) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    high = F.transform(x, lambda v: (v >= m / 2).cast("double"))
    pair = lambda a: F.zip_with(
        F.slice(a, 1, F.size(a) - 1), F.slice(a, 2, F.size(a) - 1), lambda p, q: F.struct(p.alias("one"), q.alias("two"))
    )
    add = lambda a, b: a + b
    ups = F.aggregate(high, zero, add)
    changes = F.size(F.filter(pair(high), lambda p: p["one"] != p["two"])).cast("double")
    rows = rows.withColumn("ups", ups).withColumn("runs", changes + 1).withColumn("chi_z", chi_z)
    middle, spread = (m - 1) / 2, (m * m - 1) / 12
    product = F.transform(pair(x), lambda p: (p["one"] - middle) * (p["two"] - middle))
    serial = F.aggregate(product, zero, add) / spread / F.sqrt(n - 1)
    rows = rows.withColumn("serial_z", serial)
    a, b = F.col("ups"), n - F.col("ups")
    expected = 2 * a * b / n + 1
    variance = (expected - 1) * (expected - 2) / (n - 1)
    runs_z = F.when(variance > 0, (F.col("runs") - expected) / F.sqrt(variance)).otherwise(12.0)
    two_sided = lambda z: F.least(F.lit(1.0), 2 * upper_tail(F.abs(z)))
    half = -(
        F.log(upper_tail(F.col("chi_z"))) + F.log(two_sided(runs_z)) + F.log(two_sided(F.col("serial_z")))
    )
    # Fisher's sum of three: the chi-squared tail with six degrees of freedom.
    p = F.exp(-half) * (1 + half + half * half / 2)
    return rows.select(*keep, "encoding", "bits", "n", p.alias("p"))


def not_random(tested: DataFrame, rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """(length_class, least_bin) by the step-up rule of Benjamini and Hochberg over each class
    of like length: p-values in bins from ``least_bin`` on are discoveries.

    p-values are counted in bins; a bin is judged by its largest p-value, which never admits
    more than the exact rule. The bins of a class are few, so a window over them is small.
    """
    binned = tested.groupBy("length_class", "bin").agg(F.count("*").alias("own"))
    by_class = Window.partitionBy("length_class")
    falling = by_class.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    steps = binned.select(
        "length_class",
        "bin",
        F.sum("own").over(falling).alias("upto"),
        F.sum("own").over(by_class).alias("all"),
        F.pow(F.lit(10.0), -F.col("bin") / PER_DECADE).alias("largest_p"),
    )
    ok = steps.where(F.col("largest_p") <= rate * F.col("upto") / F.col("all"))
    return ok.groupBy("length_class").agg(F.min("bin").alias("least_bin"))


def random_tokens(tokens: DataFrame) -> DataFrame:
    """(token) of those in ``tokens(token)`` that are held to be random."""
    tested = battery(tokens.distinct()).where(F.col("bits") >= LEAST_BITS)
    length_class = F.lit(0)
    for i, low in enumerate(LENGTHS):
        length_class = F.when(F.col("n") >= low, i).otherwise(length_class)
    depth = F.floor(-F.log10(F.greatest(F.col("p"), F.lit(1e-300))) * PER_DECADE)
    tested = tested.select(
        "token",
        length_class.alias("length_class"),
        F.least(F.greatest(depth, F.lit(0)), F.lit(BINS - 1)).cast("int").alias("bin"),
    )
    tested = written(tested, "tested")
    cut = not_random(tested)
    return (
        tested.join(F.broadcast(cut), "length_class", "left")  # one row per length class
        .where(F.col("least_bin").isNull() | (F.col("bin") < F.col("least_bin")))
        .select("token")
    )


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans) for every row of ``docs(doc_id, text)``: spans in code points,
    ends exclusive. ``spans`` are the base spans and those of random tokens that touch none.

    Null and empty texts have no spans. Repeated rows are judged alike, and a token is tested
    once however often it stands anywhere. Long texts are searched whole. Further columns are
    ignored; an empty table gives an empty result.
    """
    ready(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long"), text.alias("text"))
    key1, key2 = wide_hash(F.col("text"))
    has_digit = lambda t: t.rlike("[0-9]")
    rows = docs.select(
        "doc_id",
        key1.alias("k1"),
        key2.alias("k2"),
        base_spans(F.col("text")).alias("base"),
        located(F.col("text"), TOKEN, "random", has_digit).alias("able"),
    )
    touches = lambda s: F.exists(
        "base", lambda b: (s["start"] < b["end"]) & (b["start"] < s["end"])
    )
    rows = rows.withColumn("able", F.filter("able", lambda s: ~touches(s)))
    rows = written(rows.withColumn("base", F.transform("base", lambda s: s.dropFields("token"))), "base")
    able = rows.where(F.size("able") > 0).select("k1", "k2", F.explode("able").alias("s"))
    able = written(able.select("k1", "k2", "s.start", "s.end", "s.token").distinct(), "able")
    able = written(with_pieces(able), "pieces")
    secret = random_tokens(able.select("token"))
    found = able.join(secret, "token").groupBy("k1", "k2", "run")
    found = found.agg(merged(F.collect_list(F.struct("start", "end"))).alias("own"))
    kind = lambda s: F.struct(s["start"].alias("start"), F.lit("random").alias("kind"), s["end"].alias("end"))
    found = found.groupBy("k1", "k2").agg(F.flatten(F.collect_list("own")).alias("more"))
    found = found.withColumn("more", F.transform("more", kind))
    found = written(found, "found")
    joined = rows.select("doc_id", "k1", "k2", "base").join(found, ["k1", "k2"], "left")
    every = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.concat("base", "more"))
    return joined.select(
        "doc_id", ordered(F.col("base")).alias("base"), ordered(every).alias("spans")
    )
