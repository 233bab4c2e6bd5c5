"""Secret scan with DataFrame functions only: three fixed kinds, and random-looking tokens found by a test battery.

A candidate token gets an inferred encoding (the smallest alphabet that holds it). Three tests of "symbols are drawn uniformly and independently from that alphabet" give
p-values: chi-squared uniformity over equal parts of the alphabet, the runs test around the alphabet's middle, and lag-1 serial correlation. Fisher's
method joins them. Benjamini-Hochberg at `rate`, within each encoding and length band and over all documents, rejects structured tokens (long words,
identifiers, paths); what survives at a length where the tests have power is kept as kind "random". The p-values of a band meet as counts in fixed bins, so
nothing that grows with the data reaches the driver: at most 10 encodings x 5 bands x 121 bins.

Positions are code points, end exclusive. Defined cases: null or empty text: no spans, counts 0, the hash of the empty string. Repeated rows and repeated
or null doc_ids: a row each. No rows: no rows. Only doc_id and text are read; `redacted` passes all other columns through.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import new_name

#: Fixed values of the contract, in the order in which kinds are listed.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # runs are maximal, so a minimum in the pattern drops just the failing matches
HEX = r"[0-9a-f]{24,}"
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"

#: Encoding: what it holds, its alphabet, parts for the chi-squared test (a divisor of or about the alphabet's size), least length with power.
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = {
    "digits": ("[0-9]+", DIGITS, 10, 32),
    "hex": ("[0-9a-f]+", DIGITS + LOWER[:6], 16, 24),
    "HEX": ("[0-9A-F]+", DIGITS + UPPER[:6], 16, 24),
    "base32": ("[A-Z2-7]+=*", UPPER + "234567", 8, 32),
    "lower": ("[a-z]+", LOWER, 13, 48),
    "upper": ("[A-Z]+", UPPER, 13, 48),
    "letters": ("[A-Za-z]+", UPPER + LOWER, 13, 40),
    "base36": ("[0-9a-z]+", DIGITS + LOWER, 12, 24),
    "base62": ("[0-9A-Za-z]+", DIGITS + UPPER + LOWER, 8, 20),
    "base64": (".+", UPPER + LOWER + DIGITS + "+/-_", 8, 24),
}
BANDS = (32, 48, 64, 96)
SPAN = "array<struct<start:int,end:int,token:string>>"
#: Places of an array, and characters of a text, that are worked on at once.
BLOCK, STRETCH = 64, 4096


def _running(values: Column, op: Callable[[Column, Column], Column], start: int = 0) -> Column:
    """What op makes of all values before each place of an int array, from `start` on. In blocks, as appending to an array copies it: the work is that of an array of n / BLOCK."""
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(values) / BLOCK).cast("int") - 1), lambda i: F.slice(values, i * BLOCK + 1, F.lit(BLOCK)))

    def before(xs: Column, first: Column) -> Column:
        got = F.aggregate(xs, F.struct(first.alias("at"), F.array().cast("array<int>").alias("out")), lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))
        return got["out"]

    whole = F.transform(blocks, lambda xs: F.aggregate(xs, F.lit(start), op))
    return F.when(F.size(values) > 0, F.flatten(F.zip_with(blocks, before(whole, F.lit(start)), before))).otherwise(F.array().cast("array<int>"))


def _found(text: Column, pattern: str, keep: Column | None = None) -> Column:
    """Matches from the left, with their places, from the gaps that split leaves and the matches between them. keep: boolean array, one for each match."""
    match = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(match)), match, lambda g, m: F.struct(g.alias("gap"), m.alias("m"), (g + F.length(m)).alias("step")))
    offsets = _running(F.transform(pairs, lambda x: x["step"]), lambda a, b: a + b)
    span = lambda x, at: F.struct((at + x["gap"]).alias("start"), (at + x["step"]).alias("end"), x["m"].alias("token"))
    got = F.zip_with(pairs, offsets, span)
    if keep is not None:
        got = F.transform(F.filter(F.zip_with(got, keep, lambda s, k: F.struct(s.alias("span"), k.alias("ok"))), lambda x: x["ok"]), lambda x: x["span"])
    return F.when(text.rlike(pattern), got).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    long = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda x: F.length(x) >= 6)
    return {"assign": _found(text, ASSIGN, long), "access": _found(text, ACCESS), "hex": _found(text, HEX)}


def _tail(z: Column) -> Column:
    """P(Z > z) for z >= 0 by a rational approximation of erfc (error below 1.5e-7 of the value range)."""
    x = z / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = reduce(lambda acc, c: (acc + F.lit(c)) * t, [1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592], F.lit(0.0))
    return 0.5 * poly * F.exp(-x * x)


def _upper(z: Column) -> Column:
    return F.when(z >= 0, _tail(z)).otherwise(1 - _tail(-z))


def _by_encoding(enc: Column, i: int) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for k, v in ENCODINGS.items() for x in (k, v[i])]), enc)


def candidates(text: Column) -> Column:
    """array<struct(start, end, band, p)>: tokens long enough for their encoding, with the joint p-value of randomness."""
    infer = lambda t: reduce(lambda other, k: F.when(t.rlike(f"^{ENCODINGS[k][0]}$"), F.lit(k)).otherwise(other), reversed(list(ENCODINGS)), F.lit("base64"))
    found = F.transform(_found(F.coalesce(text, F.lit("")), TOKEN), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["token"].alias("token"), infer(s["token"]).alias("enc")))
    found = F.filter(found, lambda s: F.length(F.rtrim(s["token"], F.lit("="))) >= _by_encoding(s["enc"], 3))

    def symbols(s: Column) -> Column:
        v = F.transform(F.split(F.rtrim(s["token"], F.lit("=")), ""), lambda c: (F.position(c, _by_encoding(s["enc"], 1)) - 1).cast("double"))
        v = F.filter(v, lambda x: x >= 0)
        size = F.length(_by_encoding(s["enc"], 1)).cast("double")
        return F.struct(*[s[k].alias(k) for k in ("start", "end", "enc")], v.alias("v"), F.size(v).cast("double").alias("n"), size.alias("a"), _by_encoding(s["enc"], 2).alias("k"), (F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x) / F.size(v)).alias("mean"))

    def counted(s: Column) -> Column:
        of = lambda b: F.size(F.filter(s["v"], lambda x: F.floor(x * s["k"] / s["a"]) == b)).cast("double")
        squares = F.aggregate(F.transform(F.sequence(F.lit(0), s["k"] - 1), of), F.lit(0.0), lambda acc, o: acc + o * o)
        head, rest = F.slice(s["v"], F.lit(1), F.size(s["v"]) - 1), F.slice(s["v"], F.lit(2), F.size(s["v"]))
        turns = F.aggregate(F.zip_with(head, rest, lambda x, y: ((x * 2 >= s["a"]) != (y * 2 >= s["a"])).cast("double")), F.lit(1.0), lambda acc, x: acc + x)
        cross = F.aggregate(F.zip_with(head, rest, lambda x, y: (x - s["mean"]) * (y - s["mean"])), F.lit(0.0), lambda acc, x: acc + x)
        spread = F.aggregate(s["v"], F.lit(0.0), lambda acc, x: acc + (x - s["mean"]) * (x - s["mean"]))
        high = F.size(F.filter(s["v"], lambda x: x * 2 >= s["a"])).cast("double")
        return F.struct(*[s[k].alias(k) for k in ("start", "end", "enc", "n", "k")], (s["k"] / s["n"] * squares - s["n"]).alias("chi"), turns.alias("runs"), high.alias("high"), F.when(spread > 0, cross / spread).otherwise(F.lit(1.0)).alias("r"))

    def tested(s: Column) -> Column:
        df = (s["k"] - 1).cast("double")
        chi = _upper((F.cbrt(s["chi"] / df) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))
        n, hi, lo = s["n"], s["high"], s["n"] - s["high"]
        mean = 2 * hi * lo / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        runs = F.when((hi > 0) & (lo > 0) & (var > 0), 2 * _tail(F.abs(s["runs"] - mean) / F.sqrt(var))).otherwise(F.lit(0.0))
        serial = 2 * _tail(F.abs(s["r"] + 1 / n) * F.sqrt(n))
        safe = lambda p: F.ln(F.greatest(F.lit(1e-12), F.least(F.lit(1.0), p)))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["enc"].alias("enc"), s["n"].alias("n"), (-(safe(chi) + safe(runs) + safe(serial))).alias("half"))

    def joined(s: Column) -> Column:
        band = reduce(lambda acc, x: acc + (s["n"] >= x).cast("int"), BANDS, F.lit(0))
        p = F.exp(-s["half"]) * (1 + s["half"] + s["half"] * s["half"] / 2)
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat_ws(":", s["enc"], band.cast("string")).alias("band"), F.greatest(F.lit(1e-12), p).alias("p"))

    return reduce(F.transform, [symbols, counted, tested, joined], found)


def thresholds(docs: DataFrame, rate: float = 0.05) -> dict[str, float]:
    """For each band the p-value up to which Benjamini-Hochberg rejects randomness, from counts in bins of a tenth of a decade over all documents."""
    each = docs.select(F.explode(candidates(F.col("text"))).alias("c")).select("c.band", F.floor(F.log10("c.p") * 10).cast("int").alias("bin"))
    counts: dict[str, dict[int, int]] = {}
    for band, at, n in each.groupBy("band", "bin").agg(F.count(F.lit(1)).alias("n")).collect():  # bounded: bands x bins
        counts.setdefault(band, {})[at] = n
    cut = {}
    for band, bins in counts.items():
        total, below, best = sum(bins.values()), 0, 0.0
        for at in sorted(bins):
            below += bins[at]
            edge = 10 ** ((at + 1) / 10)
            if edge <= rate * below / total:
                best = edge
        cut[band] = best
    return cut


def scan(docs: DataFrame, cut: dict[str, float], name: str = "found") -> DataFrame:
    """docs with a new column (`found`): all spans by start, then kind as listed; added ones never overlap base ones. Narrow: no shuffle."""
    text = F.col("text")
    base = base_spans(text)
    struct = lambda kind: lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].alias("end"))
    out = docs.withColumn(name, F.array_sort(F.concat(*[F.transform(c, struct(k)) for k, c in base.items()])))
    if not cut:
        return out
    limit = F.create_map(*[F.lit(x) for k, v in sorted(cut.items()) for x in (k, float(v))])
    free = lambda s: ~F.exists(F.col(name), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    added = F.filter(candidates(text), lambda s: (s["p"] > F.coalesce(F.element_at(limit, s["band"]), F.lit(0.0))) & free(s))
    return out.withColumn(name, F.array_sort(F.concat(name, F.transform(added, struct("random")))))


def _named(spans: Column) -> Column:
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["rank"] + 1)
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))))


def secrets(docs: DataFrame, rate: float = 0.05) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans."""
    docs = docs.select("doc_id", "text")
    out = scan(docs, thresholds(docs, rate))
    of = lambda k: F.size(F.filter("found", lambda s: s["rank"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    base = F.filter("found", lambda s: s["rank"] < 3)
    return out.select("doc_id", *map(of, KINDS), F.sha2(_named(base), 256).alias("base_sha256"), _named(F.col("found")).alias("spans"))


def redacted(docs: DataFrame, rate: float = 0.05, mark: str = "[secret]") -> DataFrame:
    """docs with each stretch of secrets in text replaced by `mark`; every row and column stays (null text stays null)."""
    columns, name, text = docs.columns, new_name(docs, "found"), F.col("text")
    found = F.col(name)
    before = _running(F.transform(found, lambda s: s["end"]), lambda a, b: F.greatest(a, b))  # where the spans before each end
    gaps = F.filter(F.zip_with(found, before, lambda s, at: F.struct(at.alias("start"), s["start"].alias("end"), F.lit(mark).alias("mark"))), lambda g: g["start"] <= g["end"])
    last = F.struct(F.array_max(F.transform(found, lambda s: s["end"])).alias("start"), F.length(text).alias("end"), F.lit("").alias("mark"))
    stretches = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0))

    def kept(stretch: Column, i: Column, gaps: Column) -> Column:
        """What is left of one stretch: the parts of the gaps in it, each with the mark of the secret behind it if that begins here."""
        low, high = i * STRETCH, (i + 1) * STRETCH
        here = lambda g: (g["end"] >= low) & (g["end"] < high)
        near = F.filter(gaps, lambda g: ((g["start"] < high) & (g["end"] > low)) | here(g))
        part = lambda g: F.substring(stretch, F.greatest(g["start"], low) - low + 1, F.greatest(F.lit(0), F.least(g["end"], high) - F.greatest(g["start"], low)))
        return F.array_join(F.transform(near, lambda g: F.concat(part(g), F.when(here(g), g["mark"]).otherwise(""))), "")

    cuts = new_name(docs, "gaps")
    marked = scan(docs, thresholds(docs, rate), name).withColumn(cuts, F.when(F.size(found) > 0, F.concat(gaps, F.array(last))))
    cut = F.array_join(F.transform(stretches, lambda x, i: kept(x, i, F.col(cuts))), "")
    return marked.withColumn("text", F.when(F.col(cuts).isNotNull(), cut).otherwise(text)).select(*[F.col(f"`{c}`") for c in columns])
