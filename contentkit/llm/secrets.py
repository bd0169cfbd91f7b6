"""Secret scans with Spark SQL functions only: fixed patterns and a randomness test battery.

The battery looks at every token of 16 or more characters that no pattern covers.  Its encoding (decimal, hex, base32, base64)
is inferred from its characters; digits alone are a number.  Three statistics measure how far it is from uniform noise over that alphabet:
chi-squared of the character counts, a runs test about the middle of the alphabet, and the lag-one serial correlation.
Ordinary text is the null hypothesis.  Long words are rare, so besides tokens that are letters only it is seen in pieces of
every length glued from all short words of all documents and of a fixed passage, and the null of numbers is any number; mean and spread of the statistic are
fitted per encoding as functions of the length.  A token's p-value is the chance of ordinary text of its length and
encoding to look as random.  Benjamini-Hochberg within each length band decides which tokens are reported.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentkit.llm.storage import stage

# The base patterns and the order of kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
KINDS = ["assign", "access", "hex", "random"]
ALPHABETS = {
    "decimal": "0123456789",
    "hex": "0123456789abcdef",
    "base32": "234567ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base64": "+-/0123456789=ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz",
}
#: Upper ends of the length bands.
BANDS = [20, 24, 32, 48, 64, 128]
#: Lengths of the pieces of ordinary text.
LEAST, MOST = 16, 128
#: Ordinary text that every null holds, so that a corpus of a few lines has one too.
PASSAGE = """
The harbour lies at the end of a narrow valley, and most of the houses were built before there was a road. Boats brought
everything that people could not grow or make, and they took away fish, wool and cheese twice a week. When the first engineers
came to measure the slope, nobody believed that a railway could climb it; but eleven years later the station was opened by a
minister who had never seen the sea. The old trade did not end at once. Families who owned boats kept using them for
heavy goods, because the price of carriage by rail was fixed far away and changed without warning. What did change quickly was the
market: buyers from the city could now look at the catch in the morning and be home again for supper. A school, a post office
and two inns followed, then a bank, and finally the long wall that keeps the winter storms out of the lower street. Visitors
often ask why the church faces inland. The usual answer is that the builders wanted shelter, yet the records of the parish
suggest a simpler reason: the ground on the other side belonged to a man who refused to sell. His grandchildren gave it to the
village as a garden, and every June the band plays there between the apple trees until it is too dark to read the music.
"""
SPAN = "array<struct<start:long,kind:int,stop:long>>"


@dataclass(frozen=True)
class Battery:
    """Per length band the cut of the standardized log statistic, and per encoding the curves of its mean and variance."""

    bands: dict[int, float]
    nulls: dict[str, tuple[float, float, float, float]] = field(default_factory=dict)

    def z(self, kind: Column, size: Column, distance: Column) -> Column:
        """How many deviations *distance* is above ordinary text of the same encoding and length."""
        out = F.lit(None).cast("double")
        for name, (level, slope, fixed, falling) in sorted(self.nulls.items()):
            dev = F.greatest(F.sqrt(F.greatest(F.lit(fixed) + falling / size, F.lit(0.0))), F.lit(0.05))
            out = F.when(kind == name, (distance - (level + slope * F.log(size))) / dev).otherwise(out)
        return F.round(out, 2)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _spans(text: Column, pattern: str, kind: int, group: int | None = None, least: int = 0) -> Column:
    """Spans in code points of the leftmost non-overlapping matches whose *group* has at least *least* characters."""
    empty = F.lit(None).cast(SPAN)

    def located(found: Column) -> Column:
        pieces = F.split(text, pattern, -1)
        groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
        steps = F.transform(F.arrays_zip(found.alias("m"), groups.alias("g"), pieces.alias("p")), lambda x: F.struct(
            F.length(x["p"]).cast("long").alias("gap"), F.length(x["m"]).cast("long").alias("size"), F.length(x["g"]).alias("inner")))
        walked = F.aggregate(
            steps, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("spans")),
            lambda acc, x: F.struct(
                (acc["at"] + x["gap"] + F.coalesce(x["size"], F.lit(0))).alias("at"),
                F.when(x["size"].isNotNull() & (x["inner"] >= least), F.concat(acc["spans"], F.array(F.struct(
                    (acc["at"] + x["gap"]).alias("start"), F.lit(kind).alias("kind"), (acc["at"] + x["gap"] + x["size"]).alias("stop")))))
                .otherwise(acc["spans"]).alias("spans")))
        return walked["spans"]

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.coalesce(_let(found, lambda m: F.when(F.size(m) > 0, located(m)).otherwise(empty)), F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """All spans of the base patterns by start, then kind."""
    return F.array_sort(F.concat(
        F.when(text.rlike("(?i)pass|secret|token|api_?key"), _spans(text, ASSIGN, 0, 2, 8)).otherwise(F.array().cast(SPAN)),
        F.when(text.contains("AKIA"), _spans(text, ACCESS, 1)).otherwise(F.array().cast(SPAN)),
        _spans(text, HEX, 2)))


def _band(size: Column) -> Column:
    out = F.lit(len(BANDS))
    for k in reversed(range(len(BANDS))):
        out = F.when(size < BANDS[k], k).otherwise(out)
    return out


def _kind(token: Column) -> Column:
    return F.when(token.rlike("^[0-9]+$"), "decimal").when(token.rlike("^[0-9a-f]+$"), "hex").when(token.rlike("^[2-7A-Z]+=*$"), "base32").otherwise("base64")


def _size(token: Column) -> Column:
    """Length of a token; above MOST in steps of two per cent, so that there are few."""
    n = F.length(token).cast("double")
    return F.when(n <= MOST, n).otherwise(F.round(MOST * F.exp(F.round(F.log(n / MOST) * 50) / 50)))


def _by_kind(kind: Column, one) -> Column:
    """``one(letters)`` for the alphabet of *kind*."""
    out = one(ALPHABETS["base64"])
    for name in ("decimal", "hex", "base32"):
        out = F.when(kind == name, one(ALPHABETS[name])).otherwise(out)
    return out


def _values(token: Column, kind: Column) -> Column:
    """Places of the characters in the alphabet, as twice the distance from its middle; an array of literals is indexed, as searching the alphabet is slow."""
    def one(letters: str) -> Column:
        middle = F.array(*[F.lit(2 * letters.find(chr(c)) - (len(letters) - 1)).cast("long") for c in range(1, 128)])
        return F.transform(F.split(token, ""), lambda c: F.element_at(middle, F.ascii(c)))

    return _by_kind(kind, one)


#: Characters of a token whose counts fit the long of _squares: the pairs in 34 bits, the run in 20.
PACKED = 1 << 17


def _squares(token: Column, ordered: Column) -> Column:
    """Sum of the squared counts of the characters; *ordered* are the sorted values.

    One long is carried along the values: the value in its highest bits, then the pairs of equal characters, then how many
    characters the run has so far.  A run goes on where the next value is not above the carried one.
    """
    def step(acc: Column, x: Column) -> Column:
        run, pairs = F.lit((1 << 20) - 1).cast("long"), F.lit((1 << 54) - (1 << 20)).cast("long")
        top = F.shiftleft(x, 54)
        return F.when(acc >= top, acc + F.shiftleft(acc.bitwiseAND(run), 20) + F.lit(1)).otherwise(acc.bitwiseAND(pairs) + top + F.lit(1))

    packed = F.aggregate(ordered, F.shiftleft(F.element_at(ordered, 1), 54), step)
    pairs = F.shiftright(packed, 20).bitwiseAND(F.lit((1 << 34) - 1).cast("long"))
    # Equal characters lie together in the sorted token.
    groups = F.regexp_extract_all(F.array_join(F.sort_array(F.split(token, "")), ""), F.lit(r"(.)\1*"), F.lit(0))
    counted = F.aggregate(groups, F.lit(0.0), lambda acc, g: acc + F.length(g).cast("double") * F.length(g))
    return F.when(F.length(token) <= PACKED, (pairs * 2 + F.length(token)).cast("double")).otherwise(counted)


def _statistic(token: Column, kind: Column, values: Column, ordered: Column) -> Column:
    """Log of the squared test statistics: small for noise over the inferred alphabet, large for text.

    *ordered* are the sorted *values*; as a column of its own, numbers are sorted many times faster than inside an expression.
    """
    n = F.length(token).cast("double")
    squares = _squares(token, ordered)
    before = F.size(values) - 1
    products = F.zip_with(F.slice(values, F.lit(1), before), F.slice(values, F.lit(2), before), lambda a, b: a * b)
    product = F.aggregate(products, F.lit(0).cast("long"), lambda acc, x: acc + x) / F.lit(4.0)

    def chi(letters: str) -> Column:
        m = float(len(letters))
        return (squares * m / n - n - (m - 1)) / F.sqrt(F.lit(2 * (m - 1)))

    def changes(letters: str) -> Column:
        # Runs of one half less one: what is in no half, as the end of base32, follows all others.
        halves = [re.escape("".join(c for k, c in enumerate(letters) if (k > len(letters) / 2) == upper)) for upper in (False, True)]
        return F.size(F.regexp_extract_all(token, F.lit("[{}]+|[{}]+".format(*halves)), F.lit(0))) - 1

    runs = (_by_kind(kind, changes) - (n - 1) / 2) / F.sqrt((n - 1) / 4)
    serial = product / (_by_kind(kind, lambda letters: F.lit((len(letters) ** 2 - 1) / 12)) * F.sqrt(n))
    return F.log(F.pow(F.greatest(_by_kind(kind, chi), F.lit(0.0)), F.lit(2.0)) + runs * runs + serial * serial + 1)


def _distance(token: Column) -> Column:
    """The statistic of a token inside an expression; over many rows, columns for the kind and the values are faster."""
    return _let(_kind(token), lambda kind: _let(_values(token, kind), lambda values: _statistic(token, kind, values, F.sort_array(values))))


def _p_value(z: Column) -> Column:
    """Lower normal tail of the statistic under ordinary text (a logistic approximation of the normal integral)."""
    return 1 / (1 + F.exp(-(1.5976 * z + 0.070565966 * z * z * z)))


#: What is left of ordinary text in each encoding: characters that stay, and whether they are in upper (1) or lower (-1) case.
LEFT = {"base64": ("A-Za-z", 0), "base32": ("A-Za-z", 1), "hex": ("0-9A-Fa-f", -1)}


def _pieces(text: Column) -> Column:
    """All short words of a text, glued and cut into pieces once per encoding, of a length given by the text's hash.

    What is left at the end of a text is a piece too, if it has LEAST characters.
    """
    def pieces(k: int, rest: Column) -> Column:
        size = F.pmod(F.xxhash64(F.lit(k), text), F.lit(MOST - LEAST + 1)) + LEAST
        return F.regexp_extract_all(rest, F.concat(F.lit(f".{{{LEAST},"), size.cast("string"), F.lit("}")), F.lit(0))

    def glued(short: Column, stays: str) -> Column:
        # Runs of what stays are joined: removing what goes is several times slower where most goes.
        rest = F.array_join(F.regexp_extract_all(short, F.lit(f"[{stays}]+"), F.lit(0)), "")
        cases = [(k, case) for k, (kept, case) in enumerate(LEFT.values()) if kept == stays]
        return _let(rest, lambda rest: F.concat(*[pieces(k, F.upper(rest) if case > 0 else F.lower(rest) if case < 0 else rest) for k, case in cases]))

    def cut(short: Column) -> Column:
        return F.concat(*[glued(short, stays) for stays in dict.fromkeys(stays for stays, _ in LEFT.values())])

    return _let(F.regexp_replace(text, CANDIDATE, " "), cut)


def _passage_pieces() -> list[str]:
    """Pieces of the fixed passage, every length from another place of it, and as many plain numbers of every length.

    A number is no secret however evenly its digits fall, so numbers drawn at random are the ordinary text of the decimal encoding.
    """
    draw = random.Random(16)
    out = ["".join(draw.choice(ALPHABETS["decimal"]) for _ in range(n)) for n in range(LEAST, MOST + 1) for _ in range(4)]
    for stays, case in LEFT.values():
        rest = re.sub(f"[^{stays}]", "", PASSAGE)
        rest = rest.upper() if case > 0 else rest.lower() if case < 0 else rest
        out += [rest[at:at + n] for n in range(LEAST, MOST + 1) for at in [n * 37 % (len(rest) - n)]]
    return out


def _fit_null(rows: list[tuple[float, float, float]]) -> tuple[float, float, float, float]:
    """Curves of (size, distance, count) rows: mean = level + slope * log(size), variance = fixed + falling / size.

    The variance is that below the mean: runs of one letter, far above it, say nothing about texts that look random.
    """
    size, d, n = np.array(rows, float).T
    slope, level = np.polyfit(np.log(size), d, 1, w=np.sqrt(n))
    rest = d - (level + slope * np.log(size))
    low = rest < 0
    size, square, n = size[low], rest[low] ** 2, n[low]
    falling, fixed = np.polyfit(1 / size, square, 1, w=np.sqrt(n))
    if falling < 0 or fixed < 0:  # neither may pull the variance below nothing at some length
        falling, fixed = (0.0, (n * square).sum() / n.sum()) if falling < 0 else ((n * square / size).sum() / (n / size**2).sum(), 0.0)
    return float(level), float(slope), float(fixed), float(falling)


def fit_battery(docs: DataFrame, text_col: str = "text", rate: float = 0.001) -> Battery:
    """Measure ordinary text and set the cuts, on all tokens of all documents.

    Tokens are reduced to counts per (encoding, length, bin of the statistic), so the decision is a table of bounded size; a
    bin is accepted as a whole, by its upper end.  Every length has a null.
    """
    from pyspark.sql import Window

    def row(ordinary: bool):
        return lambda x: F.struct(x.alias("token"), F.lit(ordinary).alias("ordinary"))

    text = F.col(f"`{text_col}`")
    tokens = docs.filter(text.isNotNull()).select(F.explode(F.concat(
        F.transform(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), row(False)), F.transform(_pieces(text), row(True)))).alias("x")).select("x.*")
    fixed = docs.sparkSession.createDataFrame([(x, True) for x in _passage_pieces()], "token string, ordinary boolean")
    # Each column is one projection of its own and no filter refers to it, so that none is computed twice.
    token, kind = F.col("token"), F.col("kind")
    valued = tokens.unionByName(fixed).select("ordinary", "token", _kind(token).alias("kind")).select("*", _values(token, kind).alias("values")).select(
        "*", F.sort_array("values").alias("ordered"))
    measured = valued.select(
        "ordinary", "kind", _band(F.length("token")).alias("band"), _size(token).alias("size"),
        F.round(_statistic(token, kind, F.col("values"), F.col("ordered")), 2).alias("bin"), token.rlike("^([A-Za-z]+|[0-9]+)$").alias("letters"))
    # The statistic is a logarithm rounded to 0.01 and lengths come in steps, so the grid is bounded whatever the input.
    grid = stage(measured.groupBy("ordinary", "letters", "kind", "band", "size", "bin").agg(F.count(F.lit(1)).alias("n")), "battery").filter("bin IS NOT NULL")
    ordinary = grid.filter("ordinary OR letters")
    # Per length the mean, and the mean below it, would not give the residuals of the curve; the bins do, in steps of 0.1.
    seen = ordinary.groupBy("kind", "size", F.round("bin", 1).alias("step")).agg(
        (F.sum(F.col("bin") * F.col("n")) / F.sum("n")).alias("d"), F.sum("n").alias("n")).collect()
    battery = Battery({}, {k: _fit_null([(r["size"], r.d, r.n) for r in seen if r.kind == k]) for k in ALPHABETS})
    cells = grid.filter("NOT ordinary").groupBy("band", battery.z(F.col("kind"), F.col("size"), F.col("bin")).alias("z")).agg(F.sum("n").alias("n"))
    cells = cells.withColumn("p", _p_value(F.col("z") + 0.005))
    ranked = cells.withColumn("rank", F.sum("n").over(Window.partitionBy("band").orderBy("z"))).withColumn(
        "all", F.sum("n").over(Window.partitionBy("band")))
    cuts = ranked.groupBy("band").agg(F.max(F.when(F.col("p") <= rate * F.col("rank") / F.col("all"), F.col("z"))).alias("cut"))
    return Battery({r.band: r.cut for r in cuts.collect() if r.cut is not None}, battery.nulls)


def random_spans(text: Column, base: Column, battery: Battery) -> Column:
    """Spans of tokens the battery reports, without those that touch a base span."""
    if not battery.bands:
        return F.array().cast(SPAN)

    def reported(token: Column) -> Column:
        cut = F.lit(None).cast("double")
        for band, value in sorted(battery.bands.items()):
            cut = F.when(_band(F.length(token)) == band, F.lit(float(value))).otherwise(cut)
        return battery.z(_kind(token), _size(token), F.round(_distance(token), 2)) <= cut

    def chosen(found: Column) -> Column:
        return F.filter(found, lambda s: reported(F.substring(text, s["start"].cast("int") + 1, (s["stop"] - s["start"]).cast("int")))
                        & ~F.exists(base, lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])))

    return F.when(text.rlike(CANDIDATE), chosen(_spans(text, CANDIDATE, 3))).otherwise(F.array().cast(SPAN))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan(docs: DataFrame, battery: Battery, text_col: str = "text") -> DataFrame:
    """Add base (array of spans), secrets (base and random spans) and the columns of the digest.

    Null texts count as empty and have no spans; every row is judged by itself, so repeated rows and ids do not matter.
    """
    # One row, one struct: generators keep the optimizer from repeating the scan in later filters.
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    both = _let(text, lambda t: _let(base_spans(t), lambda b: F.struct(
        b.alias("base"), F.array_sort(F.concat(b, random_spans(t, b, battery))).alias("secrets"))))
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("base", "secrets")]
    packed = docs.select(*kept, F.explode(F.array(both)).alias("_found"))
    return packed.select(*kept, F.col("_found.base").alias("base"), F.col("_found.secrets").alias("secrets"))


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts per kind, the hash of the base spans and all spans as text."""
    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return scanned.select(
        F.col(id_col), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("secrets")).alias("spans"))


def redact(docs: DataFrame, battery: Battery, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The rows of *docs* with every secret of the text replaced by *mark*; overlapping spans are replaced as one."""
    scanned = scan(docs.withColumn("_source_text", F.coalesce(F.col(f"`{text_col}`"), F.lit(""))), battery, "_source_text")
    text = F.col("_source_text")

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        return F.struct(
            F.when(fresh, F.concat(acc["out"], F.array(F.substring(text, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")), F.lit(mark))))
            .otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["stop"]).alias("at"))

    walked = F.aggregate("secrets", F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).cast("long").alias("at")), step)
    rest = F.array_join(_let(walked, lambda w: F.concat(w["out"], F.array(F.substring(text, w["at"].cast("int") + 1, 2**31 - 1)))), "")
    new = F.when(F.size("secrets") > 0, rest).otherwise(F.col(f"`{text_col}`")).alias(text_col)
    return scanned.select(*[new if c == text_col else F.col(f"`{c}`") for c in docs.columns])
