"""Text expressions, all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Legal suffixes of company names, one and two tokens long.
SUFFIXES = (
    "NATIONAL ASSOCIATION", "INCORPORATED", "CORPORATION", "COMPANY", "LIMITED", "HOLDINGS", "INC", "LLC", "LLP", "PLC", "LTD", "CORP", "LP", "NA", "SA", "CO", "FSB",
)
# Legal suffixes of names in filings.
FILING_SUFFIXES = ("INC", "LLC", "LP", "LTD", "CORP", "CORPORATION", "CO", "NA", "PLLC", "PC", "COMPANY", "HOLDINGS")
# Statutory and legal markers of template letters.
BOILERPLATE_MARKERS = (
    r"15\s*u\.?\s*s\.?\s*c", r"15\s*u\.?s\.?\s*code", r"\b1681[a-z]?\b", r"\b1692[a-z]?\b", r"\bsection\s*6(0[49]|1[1-3]|23)\b", r"fair\s+credit\s+reporting\s+act", r"\bfcra\b", r"\bfdcpa\b",
    r"federally\s+protected\s+consumer\s+rights", r"willful\s+non[- ]?compliance", r"estoppel\s+by\s+silence", r"under\s+penalty\s+of\s+perjury", r"permissible\s+purpose",
    r"validation\s+of\s+(the\s+)?debt", r"cease\s+and\s+desist", r"metro\s*2\b", r"e[-\s]?oscar",
)
BOILERPLATE = "(?i)(" + "|".join(BOILERPLATE_MARKERS) + ")"
# Street types, in title or upper case.
STREET_TOKENS = (
    "Street", "St", "Avenue", "Ave", "Road", "Rd", "Boulevard", "Blvd", "Drive", "Dr", "Lane", "Ln", "Court", "Ct", "Circle", "Cir", "Way", "Place", "Pl", "Terrace", "Ter", "Parkway", "Pkwy",
    "Highway", "Hwy", "Suite", "Ste", "Apt", "Apartment",
)
_STREET = "|".join(sorted({*STREET_TOKENS, *(t.upper() for t in STREET_TOKENS)}, key=lambda t: (-len(t), t)))
# Personal data patterns in the order they are applied, with their placeholders. A card has to pass the Luhn check too.
PII = (
    ("email", r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", "[EMAIL]"),
    ("ssn", r"(?<!\d)\d{3}[- \u00a0]\d{2}[- \u00a0]\d{4}(?!\d)", "[SSN]"),
    ("card", r"(?<![\d-])(?:\d{4}[ -]?){3}\d{1,4}(?![\d-])", "[CARD]"),
    ("phone", r"(?<![\d\-.])(?:\+?1[ .\-])?(?:\(\d{3}\)\s?|\d{3}[ .\-])\d{3}[ .\-]\d{4}(?![\d\-])", "[PHONE]"),
    ("address", rf"(?<!\d)\d{{1,6}}\s+(?:[A-Za-z][A-Za-z.'\-]*\s+){{1,4}}(?:{_STREET})\b\.?", "[ADDRESS]"),
    ("name", r"\b(?:Mr|Mrs|Ms|Miss|Dr|Prof)\.?\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?", "[NAME]"),
    ("account", r"(?<![\d\-])\d{8,}(?![\d\-])", "[ACCOUNT]"),
)


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.nullif(c, F.lit("")), F.lit("None"))


def iso_date(c: Column) -> Column:
    """The date at the start of an ISO or plain date string; null if it isn't one."""
    return F.to_date(F.try_to_timestamp(F.substring(c, 1, 10), F.lit("yyyy-MM-dd")))


def yes_no(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.when(low == "yes", True).when(low == "no", False)


def normalize(c: Column) -> Column:
    """Lower case, no punctuation, # for each run of digits, single blanks, trimmed."""
    kept = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(kept, r"\p{Nd}+", "#"), r"\s+", " "))


def text_hash(c: Column) -> Column:
    return F.sha2(normalize(c), 256)


def _ends(suffixes: tuple[str, ...]) -> str:
    return "|".join(sorted(suffixes, key=lambda s: (-len(s), s)))


def company_normal(c: Column) -> Column:
    """Upper case, dots left out, other punctuation as blanks, trailing legal suffixes taken off as long as something is left."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.upper(c), r"\.", ""), r"[^\p{L}\p{N}_]", " "), r" +", " "))
    return F.regexp_replace(plain, rf"^(.+?)(?: (?:{_ends(SUFFIXES)}))+$", "$1")


def filing_normal(c: Column) -> Column:
    """A name as filings write it: only letters A to Z and digits, all trailing suffixes off, even if nothing is left."""
    plain = F.trim(F.regexp_replace(F.upper(F.regexp_replace(F.regexp_replace(c, r"\.", ""), r"[^A-Za-z0-9 ]+", " ")), r" +", " "))
    return F.regexp_replace(plain, rf"(?:(?:^| )(?:{_ends(FILING_SUFFIXES)}))+$", "")


def filing_names(c: Column) -> Column:
    """The distinct normalised names of a filing's company string, cut at commas and "and", in order."""
    each = F.transform(F.split(F.coalesce(c, F.lit("")), r"(?i),|\band\b"), filing_normal)
    return F.array_distinct(F.filter(each, lambda x: x != ""))


def slug(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.when(s == "", F.lit("unknown")).otherwise(s)


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"([a-z0-9]+(?:[-'][a-z0-9]+)*)"), F.lit(1))


def shingles(c: Column, k: int) -> Column:
    """Distinct k-character pieces; a shorter text is one piece, an empty one has none."""
    n = F.length(c)
    many = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(k))))
    return F.when(n == 0, F.array().cast("array<string>")).when(n <= k, F.array(c)).otherwise(many)


def jaccard(a: Column, b: Column) -> Column:
    """|both| / |either| of two sets; two empty sets are alike."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / either)


def word_ngrams(words: Column, n: int) -> Column:
    last = F.size(words) - n + 1
    return F.when(last < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " ")))


def windows(c: Column, size: int = 2000) -> Column:
    """The whole text, or the first and last `size` characters of a longer one."""
    return F.when(F.length(c) <= size, F.array(c)).otherwise(F.array(F.substring(c, 1, size), F.substring(c, -size, size)))


def display_safe(c: Column) -> Column:
    """No terminal escapes, controls or direction marks; single blanks."""
    t = F.regexp_replace(c, "\x1b\\][^\x07\x1b]*(?:\x07|\x1b\\\\)?", " ")
    t = F.regexp_replace(t, "\x1b\\[[0-9;?]*[ -/]*[@-~]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[\p{Cc}‎‏‪-‮⁦-⁩]", " "), r"\s+", " "))


def spreadsheet_safe(c: Column, cap: int = 1200) -> Column:
    """Text that a spreadsheet won't run as a formula, at most cap characters."""
    return F.substring(F.when(c.rlike(r"^\s*[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c), 1, cap)


def strip_html(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), r"\s+", " "))


def _card(c: Column, pattern: str, mark: str) -> tuple[Column, Column]:
    """c with the runs that pass the Luhn check replaced, and their number. Marks that no text has, put around each run, tell it from equal digits elsewhere."""
    runs = F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1))
    good = F.filter(runs, lambda r: F.call_function("luhn_check", F.regexp_replace(r, "[ -]", "")))
    marked = F.regexp_replace(c, f"({pattern})", "\ue000$1\ue001")
    done = F.aggregate(F.array_distinct(good), marked, lambda acc, r: F.replace(acc, F.concat(F.lit("\ue000"), r, F.lit("\ue001")), F.lit(mark)))
    return F.when(F.size(good) > 0, F.translate(done, "\ue000\ue001", "")).otherwise(c), F.coalesce(F.size(good), F.lit(0))


def redact(c: Column) -> tuple[Column, dict[str, Column]]:
    """(text with placeholders, matches by pattern), each pattern applied to what the earlier ones left. Null text has no matches."""
    counts: dict[str, Column] = {}
    out = c
    for name, pattern, mark in PII:
        if name == "card":
            out, counts[name] = _card(out, pattern, mark)
        else:
            counts[name] = F.coalesce(F.regexp_count(out, F.lit(pattern)), F.lit(0))
            out = F.regexp_replace(out, pattern, mark)
    return out, counts


def redacted(df: DataFrame, text: str, to: str = "clean") -> DataFrame:
    """df plus `to` and n_<pattern> for each pattern: redact() a stage a projection, so that no stage is computed again for its count."""
    names = [f"n_{name}" for name, _, _ in PII]
    out = df.withColumn(to, F.col(text))
    for name, pattern, mark in PII:
        if name == "card":
            new, counts = _card(F.col(to), pattern, mark)
        else:
            new, counts = F.regexp_replace(F.col(to), pattern, mark), F.coalesce(F.regexp_count(F.col(to), F.lit(pattern)), F.lit(0))
        out = out.select(*(F.col(x) for x in out.columns if x != to), new.alias(to), counts.alias(f"n_{name}"))
    return out.select(*df.columns, to, *names)


def scoped_id(run: Column, scope: Column, local: Column) -> Column:
    return F.concat_ws(":", run, scope, local.cast("string"))
