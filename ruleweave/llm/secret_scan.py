"""Secrets in texts: fixed patterns, and strings that a battery of randomness tests can't tell from chance.

Candidate strings (20 or more token characters with a letter and a digit) get an encoding by their characters; a run
that has signs of both base64 alphabets is tested over all of them jointly. Three tests ask whether the symbols look
drawn at random from that alphabet: chi-squared uniformity of its symbols (neighbours pooled only as far as each pool
must expect five), the runs test about the alphabet's middle, and the lag-1 serial correlation; Fisher's method joins
them to one p-value. A string that this rejects at the level ``reject`` is ordinary and never reported. True random
strings have uniform p-values while ordinary ones pile up near 0, so within each stratum of encoding and length the share
of random strings follows from the upper half of the p-values (of different strings: copies of one count once), and going
up from ``reject`` the first threshold is taken at which the expected share of ordinary strings among those reported is
at most ``fdr``. Length is the covariate: short strata, where the tests are weak, get stricter thresholds than long
ones. Spans are code points, end exclusive.

Cases: a null or empty text has no spans; null ids, repeated rows and ties give one output row for each input row; an
empty table gives an empty result; other columns of the input are ignored. A span reported as ``random`` that lies within
a span of a fixed pattern is not repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleweave.llm.common import let, settle

#: Kind, pattern of a match, least length: of group 2 for assign, of the whole match else.
BASE_KINDS = (
    ("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 20),
    ("hex", r"[0-9a-f]{24,}", 24),
)
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: Encoding, pattern, alphabet; the first that fits counts.
ENCODINGS = (
    ("hex_lower", r"^[0-9a-f]+$", "0123456789abcdef"),
    ("hex_upper", r"^[0-9A-F]+$", "0123456789ABCDEF"),
    ("base32", r"^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("alphanumeric", r"^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", r"^[A-Za-z0-9+/]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", r"^[A-Za-z0-9_-]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    ("mixed", r"^[A-Za-z0-9+/_-]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
)
LENGTHS = (20, 28, 40, 64)
#: Steps of the thresholds: the counts by step, encoding and length are all that reaches the driver.
P_BINS = 1000
SPAN = "struct<s:bigint,k:int,e:bigint>"


def _matches(text: Column, pattern: str) -> Column:
    """Array of (s, e, m) of the leftmost non-overlapping matches: the texts between them give the places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(parts: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<s:bigint,e:bigint,m:string>>").alias("out"))

        def step(acc: Column, i: Column) -> Column:
            s = acc["at"] + F.length(F.get(parts["gaps"], i))
            m = F.get(parts["found"], i)
            return let(F.struct(s.alias("s"), (s + F.length(m)).alias("e"), m.alias("m")), lambda x: F.struct(x["e"].alias("at"), F.concat(acc["out"], F.array(x)).alias("out")))

        every = F.sequence(F.lit(0), F.size(parts["found"]) - 1)
        return F.when(F.size(parts["found"]) == 0, start["out"]).otherwise(F.aggregate(every, start, step, lambda acc: acc["out"]))

    return let(F.struct(found.alias("found"), F.split(text, pattern, -1).alias("gaps")), placed)


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal, by a logistic polynomial (error below 0.0002)."""
    z = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), z))
    return 1.0 / (1.0 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def _chi_tail(x: Column, df: Column) -> Column:
    """P(chi-squared > x), by the cube-root normal approximation."""
    v = 2.0 / (9.0 * df)
    return _upper_tail((F.pow(F.greatest(x, F.lit(0.0)) / df, F.lit(1.0 / 3)) - (1.0 - v)) / F.sqrt(v))


def p_random(token: Column, alphabet: Column) -> Column:
    """Joint p-value of the three tests for one token of ``alphabet``; padding signs don't count."""

    def tests(of: Column) -> Column:
        x, size = of["x"], of["size"]
        n, middle = F.size(x).cast("double"), F.floor(of["size"] / 2)
        # Symbol v is in pool floor(v * pools / size); pool b starts with symbol ceil(b * size / pools).
        pools = F.greatest(F.lit(2), F.least(size, F.floor(n / 5))).cast("long")
        edge = lambda b: F.ceil(b * size / pools)
        counts = F.transform(F.sequence(F.lit(0).cast("long"), pools - 1), lambda b: F.struct(F.size(F.filter(x, lambda v: (v >= edge(b)) & (v < edge(b + 1)))).alias("seen"), ((edge(b + 1) - edge(b)) / size * n).alias("due")))
        chi = F.aggregate(counts, F.lit(0.0), lambda acc, c: acc + (c["seen"] - c["due"]) * (c["seen"] - c["due"]) / c["due"])
        pairs = F.transform(F.sequence(F.lit(1), F.size(x) - 1), lambda i: F.struct(F.get(x, i - 1).alias("a"), F.get(x, i).alias("b")))
        high = F.size(F.filter(x, lambda v: v >= middle)).cast("double")
        runs = 1.0 + F.size(F.filter(pairs, lambda p: (p["a"] >= middle) != (p["b"] >= middle)))
        both = 2.0 * high * (n - high)
        spread = F.greatest(both * (both - n) / (n * n * (n - 1.0)), F.lit(1e-9))
        mean = (size - 1) / 2.0  # of the alphabet, as the null says
        cross = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + (p["a"] - mean) * (p["b"] - mean))
        z_runs = (runs - (both / n + 1.0)) / F.sqrt(spread)
        z_serial = cross / ((size * size - 1) / 12.0) / F.sqrt(n - 1.0)
        ps = F.array(_chi_tail(chi, pools - 1.0), 2.0 * _upper_tail(F.abs(z_runs)), 2.0 * _upper_tail(F.abs(z_serial)))
        return _chi_tail(F.aggregate(ps, F.lit(0.0), lambda acc, p: acc - 2.0 * F.ln(F.greatest(p, F.lit(1e-12)))), F.lit(6.0))

    symbols = F.transform(F.split(F.rtrim(token, F.lit("=")), ""), lambda c: F.position(c, alphabet) - 1)
    return let(F.struct(symbols.alias("x"), F.length(alphabet).alias("size")), lambda of: F.when(F.size(of["x"]) > 2, tests(of)))


def _candidates(text: Column) -> Column:
    """Array of (s, e, h, cls, p): h is a hash of the string, class is the encoding's place times the number of lengths plus the length's."""
    kept = F.filter(_matches(text, CANDIDATE), lambda x: x["m"].rlike("[0-9]") & x["m"].rlike("[A-Za-z]"))
    alphabets = F.array(*[F.lit(a) for _, _, a in ENCODINGS])

    def judged(x: Column) -> Column:
        which = F.lit(-1)
        for k, (_, pattern, _) in reversed(list(enumerate(ENCODINGS))):
            which = F.when(x["m"].rlike(pattern), k).otherwise(which)
        length = sum((F.when(x["e"] - x["s"] >= n, 1).otherwise(0) for n in LENGTHS[1:]), F.lit(0))
        return let(which, lambda k: F.struct(x["s"], x["e"], F.xxhash64(x["m"]).alias("h"), (k * len(LENGTHS) + length).alias("cls"), F.when(k >= 0, p_random(x["m"], F.get(alphabets, k))).alias("p")))

    return F.filter(F.transform(kept, judged), lambda x: x["p"].isNotNull())


def thresholds(found: DataFrame, fdr: float, reject: float) -> dict[int, float]:
    """Least p that is reported, by class, from the counts of different strings in at most classes x P_BINS cells."""
    each = found.select(F.explode("candidates").alias("c")).groupBy(F.col("c.cls").alias("cls"), F.col("c.h").alias("h")).agg(F.min("c.p").alias("p"))
    cells = each.groupBy("cls", F.least(F.lit(P_BINS - 1), F.floor(F.col("p") * P_BINS)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    by: dict[int, list[int]] = {}
    for r in cells.collect():
        by.setdefault(r["cls"], [0] * P_BINS)[r["bin"]] = r["n"]
    return {cls: t for cls, n in by.items() if (t := step_up(n, fdr, reject)) is not None}


def step_up(n: list[int], fdr: float, reject: float) -> float | None:
    """Least threshold, ``reject`` or more, with at most ``fdr`` ordinary strings expected among those at or above it."""
    bins = len(n)
    random = min(sum(n), 2 * sum(n[bins // 2 :]) + 1)
    first = round(reject * bins)
    reported = sum(n[first:])
    for b in range(first, bins):
        if reported and 1 - min(1.0, random * (1 - b / bins) / reported) <= fdr:
            return b / bins
        reported -= n[b]
    return None


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = 0.1, reject: float = 0.01) -> DataFrame:
    """One row per document: id, ``base`` and ``added`` arrays of (s, kind, e), kinds numbered as in KINDS."""
    text = F.coalesce(F.col("_text"), F.lit(""))

    def base_spans(k: int, pattern: str, least: int) -> Column:
        found = _matches(text, pattern)
        if k == 0:
            found = F.filter(found, lambda x: F.length(F.regexp_extract(x["m"], pattern, 2)) >= least)
        spans = F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))
        return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(f"array<{SPAN}>"))

    columns = [base_spans(k, pattern, least).alias(kind) for k, (kind, pattern, least) in enumerate(BASE_KINDS)]
    none = F.array().cast("array<struct<s:bigint,e:bigint,h:bigint,cls:int,p:double>>")
    columns.append(F.when(text.rlike(CANDIDATE), _candidates(text)).otherwise(none).alias("candidates"))
    found = settle(docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("_text")).select(id_col, *columns))
    least = thresholds(found, fdr, reject)
    base = F.sort_array(F.concat(*[k for k, _, _ in BASE_KINDS]))
    passing = lambda c: sum((F.when((c["cls"] == cls) & (c["p"] >= p), 1).otherwise(0) for cls, p in sorted(least.items())), F.lit(0)) > 0
    alone = lambda c, b: ~F.exists(b, lambda x: (x["s"] <= c["s"]) & (x["e"] >= c["e"]))
    added = let(base, lambda b: F.transform(F.filter("candidates", lambda c: passing(c) & alone(c, b)), lambda c: F.struct(c["s"].alias("s"), F.lit(len(BASE_KINDS)).alias("k"), c["e"].alias("e"))))
    return found.select(id_col, *[F.size(k).cast("long").alias(f"n_{k}") for k, _, _ in BASE_KINDS], base.alias("base"), added.alias("added"))


KINDS = (*[k for k, _, _ in BASE_KINDS], "random")


def joined(spans: Column) -> Column:
    """kind:start:end of sorted ``spans``, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
