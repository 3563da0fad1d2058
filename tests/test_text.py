"""Names, personal data patterns and product labels against a plain Python reading of the same rules."""

import re

import pytest
from pyspark.sql import functions as F

from harborlight.functions import taxonomy
from harborlight.functions import text as T

TEXTS = [
    "write to a.b+c@mail.example.org or call (555) 123-4567, ssn 123-45-6789", "card 4111 1111 1111 1111 and 4111 1111 1111 1112", "4111111111111111 4111111111111111", "x4111111111111111, ref 94111-1111111111111111",
    "I live at 12 Old Oak Street. and 5 days a week at work way", "Mr. John Smith and DR Who, Ms Ann", "account 12345678 or 1234567 or 123456789012345678", "+1 555-123-4567 and 555.123.4567", "", None, "nothing here", "1 2 3 4 Main ST and 77 A b c d e Road",
]


def _luhn(s):
    d = [int(c) for c in re.sub(r"\D", "", s)][::-1]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def _redact(text):
    counts, out = {}, text
    for name, pattern, mark in T.PII:
        if name == "card":
            hits = [m for m in re.finditer(pattern, out) if _luhn(m.group())]
            for m in reversed(hits):
                out = out[: m.start()] + mark + out[m.end() :]
            counts[name] = len(hits)
        else:
            out, counts[name] = re.subn(pattern, mark, out)
    return out, counts


def test_patterns_in_order(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    clean, counts = T.redact(F.col("t"))
    one = df.select("i", clean.alias("clean"), *(c.alias(f"n_{k}") for k, c in counts.items())).collect()
    staged = T.redacted(df, "t").drop("t").collect()
    assert sorted(one) == sorted(staged)
    for r in one:
        want = (None, {}) if TEXTS[r.i] is None else _redact(TEXTS[r.i])
        assert r.clean == want[0] and all(r[f"n_{k}"] == v for k, v in want[1].items()), TEXTS[r.i]
        if r.clean:
            assert _redact(r.clean)[0] == r.clean  # once is enough


@pytest.mark.parametrize(
    ("raw", "normal", "filing"),
    [
        ("Acme Financial Services, Inc.", "ACME FINANCIAL SERVICES", "ACME FINANCIAL SERVICES"), ("WELLS FARGO & COMPANY", "WELLS FARGO", "WELLS FARGO"), ("Bank of X, N.A.", "BANK OF X", "BANK OF X"),
        ("LLC", "LLC", ""), ("Acme Corp Inc", "ACME", "ACME"), ("X NATIONAL ASSOCIATION", "X", "X NATIONAL ASSOCIATION"), ("Smith PLLC", "SMITH PLLC", "SMITH"), ("Old Savings FSB", "OLD SAVINGS", "OLD SAVINGS FSB"),
        ("Crédit Ünion Co", "CRÉDIT ÜNION", "CR DIT NION"), ("", "", ""), (None, None, None), ("INC HOLDINGS", "INC", ""),
    ],
)
def test_company_names(spark, raw, normal, filing):
    r = spark.createDataFrame([(raw,)], "n string").select(T.company_normal(F.col("n")).alias("a"), T.filing_normal(F.col("n")).alias("b")).first()
    assert (r.a, r.b) == (normal, filing)


def test_filing_names(spark):
    df = spark.createDataFrame([("Acme, Inc., Beta LLC and Acme Corp",), (None,), ("Sandy Land Co",)], "n string")
    assert [r.x for r in df.select(T.filing_names(F.col("n")).alias("x")).collect()] == [["ACME", "BETA"], [], ["SANDY LAND"]]


def test_boilerplate_markers(spark):
    yes, no = ["under 15 U.S.C. 1681", "section 611 says", "the FCRA", "e-OSCAR and Metro 2", "validation of the debt"], ["according to them", "section 7", None, "metro 21"]
    got = spark.createDataFrame([(t,) for t in yes + no], "t string").select(F.coalesce(F.col("t").rlike(T.BOILERPLATE), F.lit(False)).alias("b")).collect()
    assert [r.b for r in got] == [True] * len(yes) + [False] * len(no)


def test_crosswalk_prefers_the_exact_sub_product(spark):
    rows = [(1, "Credit card or prepaid card", "Gift card"), (2, "Credit card or prepaid card", None), (3, "Consumer Loan", "Vehicle lease"), (4, "Consumer Loan", "other"), (5, "unknown", "x"), (6, None, None), (7, "Home loans", "x")]
    got = {r.id: r.product_family for r in taxonomy.with_family(spark.createDataFrame(rows, "id int, product string, sub_product string")).collect()}
    assert got == {1: "prepaid_card", 2: "credit_card", 3: "vehicle_loan", 4: "personal_loan", 5: None, 6: None, 7: "mortgage"}
    assert len({(p, s) for p, s, _, _ in taxonomy.CROSSWALK}) == len(taxonomy.CROSSWALK)
