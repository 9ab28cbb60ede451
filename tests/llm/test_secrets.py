import math
import random
from collections import Counter
from statistics import NormalDist

import reference
from pyspark.sql import functions as F

from skyledger.llm import secrets
from skyledger.llm.queries import QUERIES

BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def scan(df):
    return {r.doc_id: r.spans for r in secrets.scan(df).collect()}


def test_fixed_patterns_against_brute_force(spark):
    draw = random.Random(8)
    parts = ["password", "Token", "api_key", "APIKEY", "secret", "=", ":", " ", "  ", '"', "'", "\n", "abcdefgh", "abc",
             "AKIA", "AKIA1234567890AB", "0123456789abcdef", "deadbeef" * 5, "é", "😀", "x=y", "/+_.-", "_", "AKIAAKIA"]
    rows = [(i, "".join(draw.choice(parts) for _ in range(draw.randint(0, 25)))) for i in range(400)]
    rows += [(400, None), (401, ""), (402, "token=abcdefgh1 " * 500)]
    got = scan(spark.createDataFrame(rows, "doc_id long, text string"))
    for i, text in rows:
        fixed = [(s.start, s.kind_no, s.end) for s in got[i] if s.kind_no < 3]
        assert fixed == reference.base_spans(text), repr(text)


def test_random_strings_are_found_and_others_not(spark):
    draw = random.Random(3)
    rows = [(i, "x " + "".join(draw.choices(BASE64, k=draw.choice([24, 32, 40, 64]))) + " y") for i in range(60)]
    rows += [(i, "HelloWorld2000HelloWorld2000HelloWorld") for i in range(60, 80)]
    rows += [(i, "AAAAAAAAAAAAAAAaaaaaaaaaaaaa1111111111111111") for i in range(80, 90)]
    rows += [(i, BASE64[:62]) for i in range(90, 95)]
    got = scan(spark.createDataFrame(rows, "doc_id long, text string"))
    hit = {i for i, spans in got.items() if any(s.kind == "random" for s in spans)}
    assert len([i for i in hit if i < 60]) >= 54 and max(hit) < 60


def test_assigned_values_are_tested_apart_from_their_names(spark):
    draw = random.Random(11)
    forms = ["AWS_ACCESS_KEY={}", "Endpoint=x;AccountKey={}==;Suffix=net", "https://a.b/c?sv=1&sig={}=&se=2",
             "a_long_name_of_a_setting_2={}", "A==B=={}"]
    rows, want = [], {}
    for i in range(80):
        form, value = forms[i % len(forms)], "".join(draw.choices(BASE64[:62], k=40))
        at = form.index("{}")
        rows.append((i, "é " + form.format(value)))
        want[i] = (2 + at, 42 + at + (form[at + 2 :] + ";").index(next(c for c in form[at + 2 :] + ";" if c != "=")))
    rows += [(100 + i, f"key_{i}=HelloWorld2000HelloWorld2000HelloWorld") for i in range(20)]
    got = scan(spark.createDataFrame(rows, "doc_id long, text string"))
    hits = {i: [(s.start, s.end) for s in spans if s.kind == "random"] for i, spans in got.items()}
    assert sum(hits[i] == [want[i]] for i in range(80)) >= 72
    assert all(x in ([], [want.get(i)]) for i, x in hits.items())


def test_letters_of_one_case_and_digits(spark):
    draw = random.Random(12)
    lower = "0123456789abcdefghijklmnopqrstuvwxyz"
    rows = [(i, "key " + "".join(draw.choices(lower.upper() if i % 2 else lower, k=draw.choice([25, 32, 40])))) for i in range(60)]
    rows += [(i, "the " + "helloworld2000" * 3) for i in range(60, 80)] + [(i, lower) for i in range(80, 85)]
    got = scan(spark.createDataFrame(rows, "doc_id long, text string"))
    hit = {i for i, spans in got.items() if any(s.kind == "random" for s in spans)}
    assert len([i for i in hit if i < 60]) >= 54 and max(hit) < 60


def plain_p_value(values, letters):
    """The battery by its definitions, with exact normal tails."""
    n, tail = len(values), NormalDist().cdf
    counts = Counter(values)
    chi = max(letters / n * sum(c * c for c in counts.values()) - n, 1e-9)
    free = letters - 1
    even = tail(-(((chi / free) ** (1 / 3)) - (1 - 2 / (9 * free))) / (2 / (9 * free)) ** 0.5)
    middle = sorted(values)[n // 2]
    high = [v >= middle for v in values]
    ones, zeros = sum(high), n - sum(high)
    runs = 1 + sum(a != b for a, b in zip(high, high[1:], strict=False))
    more = 2 * ones * zeros / n
    variance = max(1e-9, more * (more - 1) / (n - 1))
    run = 2 * tail(-abs(runs - 1 - more) / variance**0.5) if ones and zeros else 0.0
    mean = sum(values) / n
    square = sum((v - mean) ** 2 for v in values)
    product = sum((a - mean) * (b - mean) for a, b in zip(values, values[1:], strict=False))
    serial = 2 * tail(-abs(product / max(square, 1e-9) + 1 / n) * n**0.5) if square > 0 else 0.0
    return min(1.0, 3 * min(even, run, serial)), even, chi, free


def chi_squared_tail(x, free):
    """P(chi-squared > x) by the series of the lower incomplete gamma function."""
    a, h = free / 2, x / 2
    term = total = 1 / a
    for i in range(1, 2000):
        term *= h / (a + i)
        total += term
    return 1 - total * math.exp(-h + a * math.log(h) - math.lgamma(a))


def test_p_values_against_plain_formulas(spark):
    draw = random.Random(5)
    rows = []
    for letters in (16, 32, 36, 64):
        for n in (20, 33, 64, 200):
            rows += [([draw.randrange(letters) for _ in range(n)], letters), ([i % letters for i in range(n)], letters),
                     ([0] * n, letters), ([draw.randrange(letters // 4) for _ in range(n)], letters)]
    df = spark.createDataFrame(rows, "v array<int>, letters int")
    got = df.select("v", "letters", secrets.p_value(F.col("v"), F.col("letters").cast("double")).alias("p")).collect()
    for r in got:
        p, even, chi, free = plain_p_value(r.v, r.letters)
        assert abs(r.p - p) < 1e-6, (r.v, r.letters)
        if 0.5 * free < chi < 2 * free:
            assert abs(even - chi_squared_tail(chi, free)) < 0.005
    assert min(r.p for r in got) < 1e-6 < 0.5 < max(r.p for r in got)


def test_digest_and_odd_tables(odd, twice, none):
    got = secrets.scan(odd).select("doc_id", F.sha2(secrets.joined(F.col("spans")), 256).alias("s")).collect()
    assert {r.s for r in got} == {reference.sha("")} and len(got) == odd.count()
    assert secrets.scan(twice).count() == 141 and secrets.scan(none).count() == 0
    plan = secrets.scan(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_counts_of_every_kind(spark, tmp_path):
    hexes = "0123456789abcdef" * 3
    texts = ["AKIA1234567890AB", f"{hexes} {hexes} token=abcdefgh AKIA1234567890AB", f'token = "{hexes}"',
             "secret: abcdefgh, password=12345678 and " + hexes, "nothing", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in QUERIES["op9_secret_scan"](spark, str(tmp_path)).collect():
        kinds = Counter(no for _, no, _ in reference.base_spans(texts[r.doc_id]))
        assert (r.n_assign, r.n_access, r.n_hex) == (kinds[0], kinds[1], kinds[2]), texts[r.doc_id]
        assert r.base_sha256 == reference.base_sha(texts[r.doc_id])
