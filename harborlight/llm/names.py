"""Variant spellings of company and lawyer names, linked by suffix blocking and longest-common-subsequence ratio.

A spelling is read into keys: (kind, line of business or given name, core), where the core is the squashed rest once legal
forms, articles and the line are taken off. A trade name after "d/b/a" is a second key of the same spelling. Equal keys
collapse first; only distinct keys are compared. Blocks are the suffixes of the core (and of the reversed core, so that an edit
near the end is met from the front), refined by kind and line; a suffix that is still common after that is not discarded
but refined further, by the core's first letters with any one of them left out (so that an edit there, too, is met). Suffixes need length
and an unedited end, so cores are also met by their forms with one or two letters left out, whatever their length and however common
their suffixes: no pair is lost of which neither core has more than two letters outside the common subsequence (two letters
changed, added, left out or exchanged). Candidates are verified by LCS ratio, and links consolidated into groups.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborlight.llm.components import connected_components
from harborlight.llm.consistent import consistent
from harborlight.session import cut

MIN_SUFFIX, COMMON, RATIO = 5, 200, 0.86
#: Letters at the far end that refine a common suffix; cores from so many letters on may differ by a letter, though that takes more than 1 - RATIO of a short one.
REFINE, MIN_EDITED = 4, 5
#: Cores of which forms with two letters left out are made: the shortest that may lack two letters of another (14 / 16 >= RATIO), and the longest, as
#: there are n * n / 2 of them. Longer ones are met by their first or last END letters with one left out; two lengths have both.
MIN_TWICE, MAX_TWICE, END = 9, 26, 12
# Legal forms and articles; lines of business; what marks a lawyer; short forms of given names.
LEGAL = frozenset("""inc incorporated llc corp corporation co company na national association ltd limited liability lp llp plc pc pllc the a of and
holdings usa us""".split())  # fmt: skip
LINES = [tuple(x.split()) for x in """auto finance;bank;card issuers;capital management;credit union;financial services;information bureau;insurance group;mortgage;
payments;recovery services;student servicing;home loans;student loans;collections;debt collection;credit reporting;loan servicing;lending;trust""".replace("\n", "").split(";")]  # fmt: skip
SHORT_LINES = {"cu": ("credit", "union"), "fcu": ("credit", "union"), "fs": ("financial", "services"), "bk": ("bank",)}
LAW = re.compile(r"\b(?:law\s*off\w*\s+of|law\s+off[a-z]{1,5}|law\s+firm\s+of|attorneys?\s+at\s+law|attorneys?|esquire|esq|law\s+office|law\s+offices|law\s+firm|law\s+group|lawyer|law)\b")
DBA = re.compile(r"\b(?:d\s*[/.]?\s*b\s*[/.]?\s*a|doing\s+business\s+as|trading\s+as|t/a|a/k/a|aka|also\s+known\s+as|operating\s+as|f/k/a|formerly\s+known\s+as)\b[.:]?")
NICKNAMES = {
    short: full for full, shorts in {
        "abigail": "abby abbie gail", "alexander": "alex xander sasha", "andrew": "andy drew", "anthony": "tony", "arthur": "art", "barbara": "barb barbie", "benjamin": "ben benny benji",
        "catherine": "cathy", "charles": "charlie chuck chas", "christina": "tina", "christopher": "chris kit", "cynthia": "cindy", "daniel": "dan danny", "david": "dave davey",
        "deborah": "deb debbie debra", "donald": "don donnie", "dorothy": "dot dottie", "douglas": "doug", "edward": "ed eddie ned ted", "elizabeth": "liz beth betty eliza lizzie betsy libby",
        "eugene": "gene", "frances": "fran frannie", "francis": "frank", "frederick": "fred freddie", "gerald": "gerry", "gregory": "greg", "harold": "hal harry", "henry": "hank",
        "jacob": "jake", "james": "jim jimmy jamie", "jeffrey": "jeff", "jennifer": "jen jenny", "jessica": "jess jessie", "john": "johnny jack", "jonathan": "jon", "joseph": "joe joey",
        "joshua": "josh", "katherine": "kate katie kathy kathryn kat kay", "kenneth": "ken kenny", "kimberly": "kim", "lawrence": "larry", "leonard": "len lenny", "margaret": "maggie peggy meg marge",
        "matthew": "matt", "michael": "mike mikey mick", "nancy": "nan", "nathan": "nate", "nicholas": "nick nicky", "pamela": "pam", "patricia": "pat patty tricia trish", "patrick": "paddy",
        "peter": "pete", "philip": "phil", "rachel": "rach", "raymond": "ray", "rebecca": "becky becca", "richard": "rick dick rich ricky", "robert": "bob rob bobby robbie bert", "ronald": "ron ronnie",
        "samuel": "sam sammy", "sandra": "sandy", "stephanie": "steph", "stephen": "steve steven", "susan": "sue susie", "theodore": "theo teddy", "theresa": "terri tess", "thomas": "tom tommy",
        "timothy": "tim timmy", "victoria": "vicky vicki", "vincent": "vince vinny", "walter": "walt", "william": "bill will billy willie liam", "zachary": "zach zack",
    }.items() for short in shorts.split()
}
#: Short forms of several names: kept open like an initial until the like surnames decide.
OPEN = {"ted": ("theodore", "edward"), "pat": ("patricia", "patrick"), "chris": ("christopher", "christina"), "sam": ("samuel", "samantha")}
GIVEN = frozenset(NICKNAMES) | frozenset(NICKNAMES.values())


def _plain(text: str) -> str:
    t = unicodedata.normalize("NFD", consistent(text).lower())
    return "".join(c for c in t if not unicodedata.combining(c))


def _subsequence(short: str, word: str) -> bool:
    it = iter(word)
    return all(c in it for c in short)


def _close(a: str, b: str) -> bool:
    """At most one letter changed, added, left out, or two neighbours exchanged."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x == y or x[1:] == y[1:] or x[1:] == y or x == y[1:] or (x[:2] == y[1::-1] and x[2:] == y[2:])


def _means(token: str, word: str, alone: bool) -> bool:
    """token is the line word, written out, shortened or mistyped; a word that is a whole line needs three letters."""
    if token == word:
        return True
    if token[0] == word[0]:
        if (3 if alone else 2) <= len(token) < len(word) and _subsequence(token, word):
            return True
        if len(word) >= 4 and token.startswith(word) and token[len(word) :] in ("s", "ing", "motive", "es"):
            return True
    return len(word) >= 5 and len(token) >= 5 and _close(token, word)


def _take_line(tokens: list[str]) -> tuple[str, list[str]]:
    """(line, other tokens); '' if the name states no line."""
    for i, t in enumerate(tokens):
        if t in SHORT_LINES and len(tokens) > 1:
            return " ".join(SHORT_LINES[t]), tokens[:i] + tokens[i + 1 :]
    best = None
    for line in LINES:
        for i in range(len(tokens) - len(line) + 1):
            window = tokens[i : i + len(line)]
            if len(window) < len(tokens) and all(_means(t, w, len(line) == 1) for t, w in zip(window, line)):
                score = (len(line), sum(a == b for a, b in zip(window, line)), i)
                if best is None or score > best[0]:
                    best = score, line, i
    if best:
        _, line, i = best
        return " ".join(line), tokens[:i] + tokens[i + len(line) :]
    whole = "".join(tokens)
    for line in LINES:  # run together, or cut in two
        word = "".join(line)
        if len(word) >= 7 and len(whole) > len(word) + 3:
            if whole.endswith(word):
                return " ".join(line), [whole[: -len(word)]]
            if whole.startswith(word):
                return " ".join(line), [whole[len(word) :]]
    return "", tokens


def _firm(text: str) -> tuple[str, str] | None:
    """(line, core) of a company's name."""
    t = re.sub(r"(?<=[a-z])[.'’](?=[a-z]|\s|$|,)", "", text)
    t = re.sub(r"(?<=[a-z])-(?=[a-z])", "", t)
    tokens = re.findall(r"[a-z0-9]+", t)
    kept = [x for x in tokens if x not in LEGAL] or tokens
    if not kept:
        return None
    line, rest = _take_line(kept)
    core = "".join(rest)
    return (line, core) if core else None


def keys_of(alias: str | None) -> list[tuple[str, str, str, str]]:
    """(kind, field, core, middle) of a spelling: kind 'firm' with its line, 'law' with the given name."""
    if not alias:
        return []
    text = _plain(alias)
    if LAW.search(text) and not DBA.search(text):
        body = LAW.sub(" ", text)
        body = re.sub(r"[()]", " ", body)
        swapped = re.match(r"\s*([a-z'’-]+)\s*,\s*([a-z][\w.\s]*)", body)
        rest = f"{swapped[2]} {swapped[1]}" if swapped and swapped[2].strip(" .") else body
        rest = re.sub(r"(?<=[a-z])['’-](?=[a-z])", "", rest)
        tokens = [x for x in re.findall(r"[a-z]+", rest) if x not in LEGAL or len(x) == 1]
        if len(tokens) >= 2:
            if tokens[-1] in GIVEN and tokens[0] not in GIVEN and len(tokens[0]) > 1:
                tokens = [*tokens[1:], tokens[0]]  # surname first
                tokens = sorted(tokens[:-1], key=lambda x: x not in GIVEN) + tokens[-1:]
            given, surname = tokens[0], tokens[-1]
            middle = tokens[1][0] if len(tokens) > 2 else ""
            return [("law", given if given in OPEN else NICKNAMES.get(given, given), surname, middle)]
    sides = [s for s in DBA.split(text.replace("(", " ").replace(")", " ")) if s.strip(" .,:-")]
    out = []
    for side in sides:
        f = _firm(side)
        if f and (key := ("firm", f[0], f[1], "")) not in out:
            out.append(key)
    return out


def lcs_ratio(a: str, b: str) -> float:
    """2 LCS / (|a| + |b|), bit-parallel."""
    if not a or not b:
        return 0.0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & masks.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return 2 * (len(a) - s.bit_count()) / (len(a) + len(b))


def _parse(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in it:
        rows = [(a, *k) for a in pdf["alias"] for k in keys_of(a)]
        yield pd.DataFrame(rows, columns=["alias", "kind", "field", "core", "middle"])


def least_ratio(a: str, b: str, ratio: float) -> float:
    """What the LCS ratio of two cores has to reach: ratio, or one letter changed in a short core whose first letter is the same."""
    n = min(len(a), len(b))
    return min(ratio, 1 - 1 / n) if n >= MIN_EDITED and a[0] == b[0] and abs(len(a) - len(b)) <= 1 else ratio


def _verify(ratio: float):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            keep = [lcs_ratio(a, b) >= least_ratio(a, b, ratio) - 1e-12 for a, b in zip(pdf["core_a"], pdf["core_b"])]
            yield pdf[pd.Series(keep, index=pdf.index, dtype=bool)]

    return run


def _meet(a: DataFrame, b: DataFrame, on, how: str = "inner") -> DataFrame:
    """a.join(b, on, how), never by a broadcast: forms and blocks that are exploded from a table are estimated at the size of its compressed file,
    a hundredth of what they take in the driver's memory."""
    return a.join(b.hint("merge"), on, how)


def _left_out(c, n):
    """All forms of the string column c of n characters with one character left out."""
    return F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, n)))


def _similar_cores(cores: DataFrame, ratio: float) -> DataFrame:
    """(scope, core_a < core_b) of distinct (scope, core) at or above the ratio, by suffix blocks and left-out forms within a scope."""
    n = F.length("core")
    # every length up to 32, then doubling: a longer shared suffix is a refinement of a shorter one
    steps = F.concat(F.sequence(F.lit(MIN_SUFFIX), F.greatest(F.least(n, F.lit(32)), F.lit(MIN_SUFFIX))), F.array(*(F.lit(1 << k) for k in range(6, 21))), F.array(n))
    lengths = F.when(n >= MIN_SUFFIX, F.array_distinct(F.filter(steps, lambda k: k <= n))).otherwise(F.array().cast("array<int>"))
    ends = F.transform(lengths, lambda k: F.concat(F.lit(">"), F.substring("core", n - k + 1, k)))
    starts = F.transform(lengths, lambda k: F.concat(F.lit("<"), F.substring("core", F.lit(1), k)))
    blocks = cores.select("scope", "core", F.explode(F.array_distinct(F.concat(ends, starts))).alias("suffix"))
    size = blocks.groupBy("scope", "suffix").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized = _meet(blocks, size, ["scope", "suffix"])
    far = F.when(F.col("suffix").startswith(">"), F.substring("core", 1, REFINE)).otherwise(F.substring("core", F.greatest(n - REFINE + 1, F.lit(1)), F.lit(REFINE)))
    finer = F.transform(_left_out(far, F.length(far)), lambda x: F.concat_ws("|", F.col("suffix"), x))
    refined = sized.select("scope", "core", F.explode(F.when(F.col("n") <= COMMON, F.array("suffix")).otherwise(F.array_distinct(finer))).alias("block"))
    none = F.array().cast("array<string>")
    tagged = lambda forms, tag: F.transform(forms, lambda x: F.concat(F.lit(tag), x))
    once = F.when(n <= MAX_TWICE, F.concat(F.array("core"), _left_out(F.col("core"), n))).otherwise(none)
    twice = F.when(n.between(MIN_TWICE, MAX_TWICE), F.flatten(F.transform(_left_out(F.col("core"), n), lambda x: _left_out(x, n - 1)))).otherwise(none)
    first, last = F.substring("core", 1, END), F.substring("core", F.greatest(n - END + 1, F.lit(1)), F.lit(END))
    halves = F.when(n >= MAX_TWICE - 3, F.concat(tagged(_left_out(first, F.lit(END)), "(-"), tagged(_left_out(last, F.lit(END)), ")-"))).otherwise(none)
    forms = F.array_distinct(F.concat(tagged(F.concat(once, twice), "-"), halves))
    short = cores.select("scope", "core", F.explode(forms).alias("block"))
    every = refined.unionByName(short)
    a, b = (every.select("scope", "block", F.col("core").alias(f"core_{s}")) for s in "ab")
    pairs = _meet(a, b, ["scope", "block"]).where("core_a < core_b")
    la, lb = F.length("core_a"), F.length("core_b")
    edited = (F.least(la, lb) >= MIN_EDITED) & (F.abs(la - lb) <= 1)
    pairs = pairs.where((2 * F.least(la, lb) >= F.lit(ratio) * (la + lb)) | edited).select("scope", "core_a", "core_b").distinct()
    return pairs.mapInPandas(_verify(ratio), "scope string, core_a string, core_b string")


def _id(*cols):
    return F.xxhash64(*[F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in cols])


def _stands_for(short: str, full: str):
    """The initial or open short form may mean the full given name."""
    by_name = F.lit(False)
    for form, names in OPEN.items():
        by_name = by_name | ((F.col(short) == form) & F.col(full).isin(*names))
    return by_name | ((F.length(short) == 1) & (F.col(short) == F.substring(full, 1, 1)))


def link_variants(aliases: DataFrame, column: str, ratio: float = RATIO) -> DataFrame:
    """(alias, group_id): one row for each distinct non-null spelling that names something; spellings of one entity share group_id.

    Spellings are compared as typed, after the consistent form. Blank spellings and those of nothing but legal forms have no key
    and are left out; repeated rows count once; other columns are ignored.
    """
    spelled = aliases.where(F.col(column).isNotNull()).select(F.col(column).alias("alias")).distinct()
    parsed = cut(spelled.mapInPandas(_parse, "alias string, kind string, field string, core string, middle string"))
    keyed = parsed.withColumn("initial", (F.col("kind") == "law") & ((F.length("field") == 1) | F.col("field").isin(*OPEN)))
    firm_scope, law_scope = F.concat(F.lit("firm:"), F.col("field")), F.lit("law")
    scope = F.when(F.col("kind") == "firm", firm_scope).otherwise(law_scope)
    cores = keyed.select(scope.alias("scope"), "core").distinct()
    similar = cut(_similar_cores(cores, ratio))
    # a spelling and its keys
    own = keyed.where("not initial").select(_id(F.lit("alias"), "alias").alias("x"), _id("kind", "field", "core").alias("y"))
    firm = similar.where(F.col("scope").startswith("firm:")).select(F.expr("substring(scope, 6)").alias("field"), "core_a", "core_b")
    firm = firm.select(_id(F.lit("firm"), "field", "core_a").alias("x"), _id(F.lit("firm"), "field", "core_b").alias("y"))
    # lawyers: like surnames and the same given name, or one that differs by an edit
    surnames = similar.where("scope = 'law'").select("core_a", "core_b")
    both = surnames.unionByName(surnames.select(F.col("core_b").alias("core_a"), F.col("core_a").alias("core_b")))
    law = keyed.where("kind = 'law'").select("field", "core", "middle", "initial").distinct()
    reach = both.unionByName(law.select(F.col("core").alias("core_a"), F.col("core").alias("core_b")).distinct())
    full = law.where("not initial").select("field", "core").distinct()
    fa, fb = full.select(F.col("field").alias("field_a"), F.col("core").alias("core_a")), full.select(F.col("field").alias("field_b"), F.col("core").alias("core_b"))
    people = _meet(_meet(reach, fa, "core_a"), fb, "core_b")
    typo = (F.least(F.length("field_a"), F.length("field_b")) >= 4) & (F.levenshtein("field_a", "field_b") <= F.when(F.length("field_a") == F.length("field_b"), 2).otherwise(1)) & (F.substring("field_a", 1, 1) == F.substring("field_b", 1, 1))
    known = sorted(set(NICKNAMES.values()))
    differ = F.col("field_a").isin(known) & F.col("field_b").isin(known)
    people = people.where((F.col("field_a") == F.col("field_b")) | (typo & ~differ)).select(_id(F.lit("law"), "field_a", "core_a").alias("x"), _id(F.lit("law"), "field_b", "core_b").alias("y"))
    # initials: the only given name with that initial (and a middle initial that doesn't contradict) among like surnames
    short = law.where("initial").select(F.col("field").alias("letter"), F.col("core").alias("core_a"), F.col("middle").alias("mid"))
    long = law.where("not initial").select("field", F.col("core").alias("core_b"), "middle")
    fits = _meet(_meet(short, reach, "core_a"), long, "core_b").where(_stands_for("letter", "field"))
    fits = fits.where("mid = '' or middle = '' or mid = middle").withColumn("exact", F.expr("mid <> '' and mid = middle"))
    best = fits.groupBy("letter", "core_a", "mid").agg(
        F.collect_set("field").alias("given"), F.collect_set(F.when(F.col("exact"), F.col("field"))).alias("sure"), F.min(F.struct(~F.col("exact"), "core_b", "field")).alias("at")
    )
    best = best.where((F.size("given") == 1) | (F.size("sure") == 1))
    chosen = best.select(_id(F.lit("initial"), "letter", "core_a", "mid").alias("x"), _id(F.lit("law"), "at.field", "at.core_b").alias("y"))
    shorts = keyed.where("initial").select(_id(F.lit("alias"), "alias").alias("x"), _id(F.lit("initial"), F.col("field"), F.col("core"), F.col("middle")).alias("y"))
    sa = short.select(F.col("letter"), F.col("mid"), "core_a").distinct()
    sb = sa.select(F.col("letter").alias("l2"), F.col("mid").alias("m2"), F.col("core_a").alias("core_b"))
    alike = _meet(_meet(sa, reach, "core_a"), sb, "core_b").where("letter = l2 and mid = m2 and core_a < core_b")
    alike = alike.select(_id(F.lit("initial"), "letter", "core_a", "mid").alias("x"), _id(F.lit("initial"), "l2", "core_b", "m2").alias("y"))
    links = own
    for more in (firm, people, chosen, shorts, alike):
        links = links.unionByName(more)
    groups = connected_components(cut(links), "x", "y", peel=False)
    at = parsed.select("alias", _id(F.lit("alias"), "alias").alias("id")).distinct()
    return _meet(at, groups, "id").select("alias", "group_id")


def variant_pairs(groups: DataFrame, salts: int = 16) -> DataFrame:
    """(alias_a < alias_b): all pairs within groups; the left side of a group is salted, so that a large one is many tasks."""
    a = groups.select("group_id", F.col("alias").alias("alias_a"), F.pmod(F.xxhash64("alias"), F.lit(salts)).alias("salt"))
    b = groups.select("group_id", F.col("alias").alias("alias_b"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
    return _meet(a, b, ["group_id", "salt"]).where("alias_a < alias_b").select("alias_a", "alias_b")
