"""Secret scans: three fixed patterns, and a battery of randomness tests. SQL functions only.

The patterns find assignments, access keys and long hex strings. The battery looks at every other
long token with letters and digits: its encoding is inferred from the characters it uses, and
three tests ask whether its characters could be drawn at random: chi-squared for an even use of
the alphabet, runs above and below the middle, and serial correlation. Their smallest p-value,
times three, goes into a false-discovery control (Benjamini and Hochberg) within classes of
encoding and length, which rejects tokens that aren't random: how small a p-value has to be is
decided by all tokens of that class in the corpus. What isn't rejected is a finding.

The control needs counts of p-values by class and bin only, so a few thousand numbers are summed
over the corpus and at most a few dozen thresholds reach the driver.

Null text counts as empty; texts are scanned whole; repeated rows are scanned alike; an empty
table gives an empty result. Positions are code points, ends exclusive. Finding positions takes
time proportional to the square of the number of matches in one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm.common import stored

#: Fixed patterns of the contract; `least` is the shortest accepted group. Runs of hex digits and
#: access keys are maximal, so asking for the length in the pattern drops the same matches.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 8
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")

#: `=` belongs to a token as padding at its end only: in NAME=value the value is a token of its own.
TOKEN = r"[A-Za-z0-9+/_-]{20,}(?:=+(?![A-Za-z0-9+/_=-]))?"
#: Shortest token a test can tell from words, and letters, for each encoding.
SHORTEST = {"hex": 24, "base32": 24, "base36": 24, "base64": 20}
LETTERS = {"hex": 16.0, "base32": 32.0, "base36": 36.0, "base64": 64.0}
LENGTH_CLASSES = (24, 32, 48, 64, 128)
FALSE_DISCOVERY = 0.05
BINS_PER_DECADE = 10
MOST_BINS = 400


def bound(value: Column, use) -> Column:
    """`use(value)` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def matches(text: Column, pattern: str, least_group: tuple[int, int] | None = None) -> Column:
    """Start, end and text of all matches, leftmost and not overlapping."""
    group, least = least_group or (0, 0)
    empty = F.array().cast("array<struct<start:int,end:int,hit:string>>")
    first = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        found = F.array(F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit")))
        return F.struct(end.alias("at"), F.when(F.length(x["part"]) >= least, F.concat(state["out"], found))
                        .otherwise(state["out"]).alias("out"))

    def walk(hits: Column) -> Column:
        part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(hits))
        return F.aggregate(F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), part.alias("part")), first, step,
                           lambda s: s["out"])

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(text.rlike(pattern), bound(hits, walk)).otherwise(empty)


# ---- Tests --------------------------------------------------------------------------------


def _upper_normal(z: Column) -> Column:
    """P(Z > z): the rational approximation of Abramowitz and Stegun, 26.2.17."""

    def tail(a: Column) -> Column:
        t = 1.0 / (1.0 + 0.2316419 * a)
        poly = lambda t: t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        return F.exp(-a * a / 2.0) * 0.3989422804014327 * bound(t, poly)

    return bound(z, lambda v: F.when(v >= 0, bound(v, tail)).otherwise(1.0 - bound(-v, tail)))


def _encoding(token: Column) -> Column:
    mixed = token.rlike("[0-9]") & token.rlike("[A-Za-z]")
    return (
        F.when(~mixed, F.lit(None).cast("string"))
        .when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(token.rlike("^[A-Z2-7]+=*$"), "base32")
        .when(token.rlike("^([0-9a-z]+|[0-9A-Z]+)=*$"), "base36")
        .when(token.rlike("[a-z]") & token.rlike("[A-Z]") & token.rlike("^[A-Za-z0-9+/_-]+=*$"), "base64")
    )


def _value(c: Column) -> Column:
    """Place of a character in a common order: digits, capitals, small letters, the rest."""
    code = F.ascii(c)
    return (
        F.when(code.between(48, 57), code - 48).when(code.between(65, 90), code - 55)
        .when(code.between(97, 122), code - 61).otherwise(F.lit(62) + code % 2)
    )


def _sum(array: Column, what) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda total, x: total + what(x).cast("double"))


def _even_use(values: Column, letters: Column) -> Column:
    """Chi-squared against an even use of the alphabet, by the Wilson-Hilferty approximation."""
    n = F.size(values).cast("double")
    squares = _sum(F.array_distinct(values), lambda v: F.pow(F.size(F.filter(values, lambda x: x == v)).cast("double"), 2.0))
    free = letters - 1.0
    spread = 2.0 / (9.0 * free)
    chi = F.greatest(letters / n * squares - n, F.lit(1e-9))
    return _upper_normal((F.pow(chi / free, 1.0 / 3.0) - (1.0 - spread)) / F.sqrt(spread))


def _neighbours(values: Column) -> Column:
    less = F.size(values) - 1
    return F.arrays_zip(F.slice(values, 1, less).alias("a"), F.slice(values, 2, less).alias("b"))


def _runs(values: Column) -> Column:
    """Runs above and below the median, against the normal approximation of their number."""
    n = F.size(values).cast("double")
    middle = F.element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int"))

    def test(high: Column) -> Column:
        runs = 1.0 + _sum(_neighbours(high), lambda x: x["a"] != x["b"])

        def against(ones: Column) -> Column:
            zeros = n - ones
            more = 2.0 * ones * zeros / n
            variance = F.greatest(F.lit(1e-9), more * (more - 1.0) / (n - 1.0))
            z = F.abs(runs - 1.0 - more) / F.sqrt(variance)
            return F.when((ones == 0) | (zeros == 0), F.lit(0.0)).otherwise(2.0 * _upper_normal(z))

        return bound(_sum(high, lambda x: x), against)

    return bound(bound(middle, lambda m: F.transform(values, lambda v: (v >= m).cast("int"))), test)


def _serial(values: Column) -> Column:
    """Correlation of neighbours, against the normal approximation."""
    n = F.size(values).cast("double")

    def test(centred: Column) -> Column:
        square = _sum(centred, lambda v: v * v)
        product = _sum(_neighbours(centred), lambda x: x["a"] * x["b"])
        z = F.abs(product / F.greatest(square, F.lit(1e-9)) + 1.0 / n) * F.sqrt(n)
        return F.when(square <= 0, F.lit(0.0)).otherwise(2.0 * _upper_normal(z))

    return bound(bound(_sum(values, lambda v: v) / n, lambda mean: F.transform(values, lambda v: v - mean)), test)


def p_value(values: Column, letters: Column) -> Column:
    """Three times the smallest p-value of the battery, for values drawn from so many letters."""
    return bound(values, lambda v: F.least(
        F.lit(1.0), 3.0 * F.least(_even_use(v, letters), _runs(v), _serial(v))))


def candidates(text: Column) -> Column:
    """Tokens of an inferred encoding that are long enough, with class and p-value."""
    kinds = F.transform(matches(text, TOKEN), lambda t: F.struct(
        t["start"].alias("start"), t["end"].alias("end"), t["hit"].alias("hit"), _encoding(t["hit"]).alias("encoding")))
    least = F.create_map(*[F.lit(x) for kv in SHORTEST.items() for x in kv])
    fit = F.filter(kinds, lambda t: t["encoding"].isNotNull() & (t["end"] - t["start"] >= least[t["encoding"]]))
    letters = F.create_map(*[F.lit(x) for kv in LETTERS.items() for x in kv])

    def judge(t: Column) -> Column:
        length = t["end"] - t["start"]
        size = sum(((length >= x).cast("int") for x in LENGTH_CLASSES), F.lit(0))
        body = F.filter(F.split(F.rtrim(t["hit"], F.lit("=")), ""), lambda c: c != "")
        # Digits and letters of one case are 0 to 35 in the common order, less the gap of capitals.
        values = F.transform(body, lambda c: F.when(
            t["encoding"].isin("hex", "base36"), F.conv(c, 36, 10).cast("int")).otherwise(_value(c)))
        return F.struct(t["start"].alias("start"), t["end"].alias("end"),
                        F.concat(t["encoding"], F.lit("-"), size.cast("string")).alias("of"),
                        p_value(values, letters[t["encoding"]]).alias("p"))

    return F.transform(fit, judge)


def _bin(p: Column) -> Column:
    return F.least(F.lit(MOST_BINS), F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) * BINS_PER_DECADE)).cast("int")


def rejected_from(found: DataFrame, rate: float = FALSE_DISCOVERY) -> dict[str, int]:
    """For each class the first bin of p-values that the false-discovery control rejects."""
    counts = (
        found.select(F.explode("candidates").alias("c")).groupBy(F.col("c.of").alias("of"), _bin(F.col("c.p")).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    smaller = Window.partitionBy("of").orderBy(F.desc("bin"))
    passed = (
        counts.withColumn("rank", F.sum("n").over(smaller))
        .withColumn("m", F.sum("n").over(Window.partitionBy("of")))
        # The bin's largest p-value against its rank's share of the rate.
        .filter(F.pow(F.lit(10.0), -F.col("bin") / float(BINS_PER_DECADE)) <= F.col("rank") / F.col("m") * rate)
    )
    return {r["of"]: r["bin"] for r in passed.groupBy("of").agg(F.min("bin").alias("bin")).collect()}


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id and `spans`, an array of (start, kind, end, kind_no) in order."""
    clean = F.coalesce(F.col(text), F.lit(""))
    found = stored(
        docs.select(
            F.col(doc_id).alias("doc_id"), matches(clean, ASSIGN, (2, ASSIGN_LEAST)).alias("assign"),
            matches(clean, ACCESS).alias("access"), matches(clean, HEX).alias("hex"),
            candidates(clean).alias("candidates"),
        ).withColumns({k: F.transform(k, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))
                       for k in KINDS[:3]}),
        "secrets-found",
    )
    limits = rejected_from(found)
    limit = F.create_map(*[x for kv in limits.items() for x in map(F.lit, kv)]) if limits else None
    first = (lambda c: F.coalesce(limit[c["of"]], F.lit(MOST_BINS + 1))) if limits else (lambda c: F.lit(MOST_BINS + 1))
    fixed = F.concat("assign", "access", "hex")
    random = F.filter("candidates", lambda c: (_bin(c["p"]) < first(c)) & ~F.exists(
        fixed, lambda m: (m["start"] < c["end"]) & (c["start"] < m["end"])))

    def tagged(spans: Column, no: int) -> Column:
        return F.transform(spans, lambda s: F.struct(
            s["start"].alias("start"), F.lit(no).alias("kind_no"), s["end"].alias("end"), F.lit(KINDS[no]).alias("kind")))

    parts = [tagged(F.col(k), i) for i, k in enumerate(KINDS[:3])] + [tagged(random, 3)]
    return found.select("doc_id", F.array_sort(F.concat(*parts)).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: Column, kind_no: int) -> Column:
    """How many spans are of a kind. The kind is no parameter of the lambda: a second one is the index."""
    return F.size(F.filter(spans, lambda s: s["kind_no"] == kind_no)).cast("long")
