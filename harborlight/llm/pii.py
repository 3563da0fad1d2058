"""Personal data in free text: detection, typed placeholders, and keyed surrogates.

Detection reads the consistent form of a text (so look-alike letters and invisible characters hide nothing) and reports spans of the
original. What a number is follows from how it is introduced; names come from introductions, titles, and given names
followed by a surname.

Surrogates: each part of an entity (given name, surname, digits, mailbox, domain, house and street) is replaced by a value keyed
with HMAC-SHA256, of the same type, gender, script, letter case and layout. Equal parts get equal surrogates wherever they occur,
so coreference stays; collision checks over all distinct parts re-draw those that share a surrogate or drew
some real part, until none is left, so different parts stay different and no real part comes back. Single letters and unit numbers have too
small a space for that: they go through a keyed permutation, which keeps them distinct and moves every one.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harborlight.llm.consistent import consistent_with_offsets

TYPES = ("email", "phone", "ssn", "card", "account", "address", "name")
# Common given names, by the gender they are mostly given to.
FEMALE = """Abigail Alice Amanda Amy Andrea Angela Anna Ashley Barbara Betty Brenda Carol Carolyn Catherine Christina Christine Cynthia Deborah
Debra Diane Donna Dorothy Elena Elizabeth Emily Emma Fatima Frances Hannah Heather Helen Ingrid Irene Jacqueline Janet Jennifer Jessica Joyce
Judith Julia Julie Karen Katherine Kathleen Kimberly Laura Lauren Leila Linda Lisa Margaret Maria Martha Mary Megan Mei Melissa Michelle Nancy Natalie Nicole Noor
Olivia Pamela Patricia Priya Rachel Rebecca Ruth Samantha Sandra Sarah Sharon Shirley Sofia Sophia Stephanie Susan Teresa Theresa Victoria Virginia Yuki Alexandra Dolores
Aisha Amelia Amina Ana Anita Ava Chloe Charlotte Ella Eleanor Evelyn Gloria Isabella Layla Marie Mia Ngozi Olga Rosa Svetlana Zoe""".split()  # fmt: skip
MALE = """Aaron Adam Ahmed Alan Albert Alexander Andrew Anthony Arthur Benjamin Brandon Brian Bruce Carlos Charles Christopher Daniel David Dennis Diego
Donald Douglas Edward Eric Eugene Francis Frank Frederick Gary George Gerald Gregory Harold Henry Ivan Jack Jacob James Jason Jeffrey Jeremy John Jonathan Jose
Joseph Joshua Juan Justin Keith Kenneth Kevin Kofi Larry Lawrence Luis Mark Matthew Michael Mohammed Nathan Nicholas Omar Patrick Paul Paulo Peter Philip Ralph
Raymond Richard Robert Roger Ronald Roy Russell Ryan Samuel Scott Stephen Steven Terry Theodore Thomas Timothy Tomas Tyler Victor Vincent Walter Wei William Yusuf Zachary Leonard Akira
Ali Amit Antonio Boris Chidi Dmitri Eduardo Fernando Giovanni Hassan Hiroshi Kenji Kwame Lucas Marco Mateo Miguel Pedro Rafael Ravi Ricardo Sanjay""".split()  # fmt: skip
GENDER = {n.lower(): "f" for n in FEMALE} | {n.lower(): "m" for n in MALE}
_GIVEN_NAMES, _LETTERS = frozenset(GENDER), re.compile(r"[^\W\d_]+")
_GIVEN = "|".join(sorted(map(re.escape, GENDER), key=len, reverse=True))

_AT = r"(?:\s?@\s?|\s?[\[({<]\s?at\s?[\])}>]\s?)"
_DOT = r"(?:\.|\s?[\[({<]\s?dot\s?[\])}>]\s?|\sdot\s)"
EMAIL = re.compile(
    rf"[A-Za-z0-9][\w.%+-]*{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*?{_DOT}[A-Za-z]{{2,}}(?:\.[A-Za-z]{{2,}}\b)*"
    r"|[A-Za-z0-9][\w.%+-]*\s+at\s+[A-Za-z0-9-]+(?:\s+dot\s+[A-Za-z0-9-]+)*\s+dot\s+[A-Za-z]{2,}\b",
    re.I,
)
NUMBER = re.compile(r"(?<![\w$#/])(?:\+\s?)?\(?\d(?:(?:\s?-\s?|\.|\s?\(|\)\s?-?|\s)?\d)*(?![\w/%]|[.,]\d)")
#: What an address without the sign has: a bracketed "at", or "dot" as a word.
_WRITTEN_AT = re.compile(r"[\[({<]\s?at\s?[\])}>]|\sdot\s", re.I)
EXTENSION = re.compile(r",?\s?(?:ext\.?|extension|x)\s?\d{1,6}\b", re.I)
_INTRO = r"\W*(?:no\b|number\b|num\b|nr\b)?\W*(?:is|was|as|to|used|ending in)?\W*(?:no\b|number\b)?\W*$"
SSN_INTRO = re.compile(r"(?:\bssn|\bss\s?#|\bsocial(?:\s+security)?)" + _INTRO, re.I)
CARD_INTRO = re.compile(r"\b(?:card|visa|mastercard|amex)\b" + _INTRO, re.I)
ACCOUNT_INTRO = re.compile(r"\b(?:account|accounts|acct|a/c|loan|iban|checking|savings)\b" + _INTRO, re.I)
PHONE_INTRO = re.compile(
    r"(?:\b(?:phone|cell|mobile|tel|telephone|fax|call(?:ed)?(?: me)?|reach(?:ed)?(?: me)?|text(?:ed)?(?: me)?|dial(?:ed)?|rang|ring)\b)(?:\W+(?:at|on|from|is|was|number|no|me|again|a))*\W*$", re.I
)
PHONE_SHAPE = re.compile(r"^(?:\+?\s?1[-. ]{0,2})?\(?\d{3}\)?[-. ]{1,2}\d{3}[-. ]\d{4}$|^(?:\+?\s?1[-. ]{0,2})?\(\d{3}\)[-. ]?\d{3}[-. ]?\d{4}$")
SSN_SHAPE = re.compile(r"^\d{3}\s?-\s?\d{2}\s?-\s?\d{4}$")

_STREET = (
    r"street|st|avenue|ave|road|rd|lane|ln|drive|dr|boulevard|blvd|court|ct|circle|cir|terrace|ter|parkway|pkwy|place|pl|way|highway|hwy|trail|trl|square|sq|alley|loop|row"
)
_UNIT = r"(?:,?\s?(?:(?:apt|apartment|unit|suite|ste|floor|fl|rm|room)\b\.?\s?#?\s?\w{1,5}|#\s?\w{1,5}))?"
ADDRESS = re.compile(
    rf"(?<![\w$.,/#-])\d{{1,6}}\s+(?:(?:[NSEW]|NE|NW|SE|SW)\b\.?\s+|(?:north|south|east|west)\s+)?((?:[A-Za-z0-9'’-]+\s+){{1,3}}?)(?:{_STREET})\b{_UNIT}",
    re.I,
)
ADDRESS_INTRO = re.compile(r"\b(?:live[sd]?|living|reside[sd]?|home|house|property|refund|mail(?:ed)?|went|listed|address|moved|located|sent|lease|rent(?:ed)?)\b(?:\W+(?:\w+)){0,3}?\W*$", re.I)
# Words that stand in no street name.
NOT_STREET = frozenset("""a an the of in on at to for and or but so day days week weeks month months hour hours minute minutes year years time times point points
page pages percent dollars dollar inquiries pulls payments accounts account calls fees late from by with my their his her our this that is was were i we they it""".split())  # fmt: skip

# Words of company names and places, which are no surnames.
NOT_SURNAME = frozenset("""inc llc corp corporation company co bank bureau insurance mortgage auto student credit union financial services servicing card issuers
information group capital management recovery payments finance incorporated limited ltd association national law office offices attorney xxxx the a an and of for from
street avenue road lane drive desk team unit line branch center department being has was is my his her their our your period""".split())  # fmt: skip
_W = r"[^\W\d_][^\W\d_'’-]+"
_INIT = r"[^\W\d_]\.?"
_FULL = rf"(?:{_W})(?:\s+(?:{_INIT})(?=\s))?\s+(?:{_W})"
NAME_INTROS = [
    re.compile(rf"\b(?:named|called|representative\s+(?:was|is)|supervisor\s+(?:was|is)|agent\s+(?:was|is)|manager\s+(?:was|is)|spoke\s+(?:with|to)|sincerely,?|regards,?|thank\s+you,|thanks,|signed,?(?:\s+by)?|(?:my|his|her|their)\s+name\s+is|this\s+is|(?:my|our)\s+(?:late\s+)?(?:wife|husband|spouse|father|mother|son|daughter|brother|sister|aunt|uncle|niece|nephew|cousin|grandmother|grandfather|friend|neighbor|landlord|roommate|partner|stepfather|stepmother)|attn:?|attention:?|account\s+holder:?|consumer:|borrower:|customer:|re:|(?<![\w'’])i,)\s+(?P<n>{_FULL})", re.I),
]
TITLED = re.compile(rf"\b(?P<t>Mr|Mrs|Ms|Miss|Dr|Prof)\b\.?\s+(?P<n>(?:{_W})(?:(?:\s+{_INIT}(?=\s))?\s+[A-Z][^\W\d_]+)?)", re.I)
REVERSED = re.compile(rf"\b(?P<n>(?:{_W}),\s+(?:{_GIVEN})\b(?:\s+[A-Z]\.)?)", re.I)
GIVEN_FIRST = re.compile(rf"\b(?P<n>(?:{_GIVEN})(?:\s+[A-Za-z]\.)?\s+(?:{_W}))", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _numbers(text: str) -> Iterator[tuple[int, int, str]]:
    for m in NUMBER.finditer(text):
        raw = m.group()
        digits = re.sub(r"\D", "", raw)
        if len(digits) < 8:
            continue
        a, b = m.span()
        before = text[max(0, a - 45) : a]
        bare = raw.isdigit()
        phone = len(digits) == 10 or (len(digits) == 11 and digits[0] == "1")
        kind = None
        if SSN_INTRO.search(before):
            kind = "ssn" if len(digits) == 9 else None
        elif CARD_INTRO.search(before):
            kind = "card" if len(digits) == 16 and luhn(digits) else None
        elif ACCOUNT_INTRO.search(before):
            kind = "account" if bare and 8 <= len(digits) <= 12 else None
        elif PHONE_INTRO.search(before):
            kind = "phone" if phone else None
        elif len(digits) == 16 and luhn(digits):
            kind = "card"
        elif phone and PHONE_SHAPE.match(raw):
            kind = "phone"
        elif SSN_SHAPE.match(raw):
            kind = "ssn"
        if kind == "phone":
            ext = EXTENSION.match(text, b)
            b = ext.end() if ext else b
        if kind:
            yield a, b, kind


def _addresses(text: str) -> Iterator[tuple[int, int, str]]:
    for m in ADDRESS.finditer(text):
        words = m.group(1).split()
        if any(w.lower() in NOT_STREET for w in words):
            continue
        introduced = ADDRESS_INTRO.search(text[max(0, m.start() - 45) : m.start()])
        if introduced or all(w[0].isupper() or w[0].isdigit() for w in words):
            yield *m.span(), "address"


def _is_name(name: str, introduced: str) -> bool:
    tokens = [t for t in re.split(r"[\s,.]+", name) if len(t) > 1]
    if not tokens or any(t.lower() in NOT_SURNAME for t in tokens):
        return False
    if any(t.lower() in GENDER for t in tokens):
        return len(tokens) > 1 and (introduced or all(t[0].isupper() for t in tokens))
    if all(t.isupper() for t in tokens):
        return introduced == "label" and not all(t == "X" * len(t) for t in tokens)
    return bool(introduced) and all(t[0].isupper() and not t.isupper() for t in tokens)


#: What follows a company's first two words: a name that goes on is no person's.
_GOES_ON = re.compile(r"\s+(?:[A-Z][\w.]+\s+)*(?:I(?i:nc)|LLC|C(?i:orp)|C(?i:ompany)|B(?i:ank)|B(?i:ureau)|U(?i:nion)|N\.A|G(?i:roup)|S(?i:ervices)|S(?i:ervicing)|F(?i:inance)|M(?i:ortgage)|I(?i:ssuers)|I(?i:nsurance)|M(?i:anagement)|A(?i:uto)|S(?i:tudent)|C(?i:redit)|P(?i:ayments)|C(?i:ard)|I(?i:nformation))\b")


def _names(text: str) -> Iterator[tuple[int, int, str]]:
    for pattern in NAME_INTROS:
        for m in pattern.finditer(text):
            label = re.match(r"(?:account\s+holder|consumer|borrower|customer|re)\b", m.group(), re.I)
            if _is_name(m["n"], "label" if label else "phrase") and not _GOES_ON.match(text, m.end("n")):
                yield *m.span("n"), "name"
    for m in TITLED.finditer(text):
        tokens = m["n"].split()
        surname = tokens[-1][0].isupper() and (not tokens[-1].isupper() or tokens[0].isupper()) and tokens[-1].lower() not in NOT_SURNAME
        keep = tokens if len(tokens) == 1 or surname or tokens[0].lower() in GENDER else [tokens[0]]
        name = " ".join(keep) if len(keep) < len(tokens) else m["n"]
        first = keep[0]
        if first.strip("Xx") and (first[0].isupper() or m["t"][0].islower()) and first.lower() not in NOT_SURNAME and first.lower() not in NOT_STREET:
            yield m.start("n"), m.start("n") + len(name), "name"
    # without a given name among its words a text can't match these
    for pattern in () if _GIVEN_NAMES.isdisjoint(_LETTERS.findall(text.lower())) else (REVERSED, GIVEN_FIRST):
        for m in pattern.finditer(text):
            if _is_name(m["n"], "") and not _GOES_ON.match(text, m.end("n")):
                yield *m.span("n"), "name"


def spans(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, type, consistent form of the span) without overlaps, offsets in the original text, in order."""
    if not text:
        return []
    form, at = consistent_with_offsets(text)
    found: list[tuple[int, int, str]] = []
    taken: list[tuple[int, int]] = []

    def add(it):
        for a, b, kind in it:
            if all(b <= x or a >= y for x, y in taken):
                taken.append((a, b))
                found.append((a, b, kind))

    if "@" in form or _WRITTEN_AT.search(form):
        add((*m.span(), "email") for m in EMAIL.finditer(form))
    if any(c.isdigit() for c in form):
        add(_numbers(form))
        add(_addresses(form))
    add(_names(form))
    place = (lambda i: i) if at is None else (lambda i: at[i])
    return [(place(a), place(b - 1) + 1, kind, form[a:b]) for a, b, kind in sorted(found)]


def redact(text: str | None) -> str | None:
    """Each span replaced by its type in brackets; the rest is unchanged."""
    if not text:
        return text
    out, last = [], 0
    for a, b, kind, _ in spans(text):
        out += [text[last:a], f"[{kind.upper()}]"]
        last = b
    return "".join(out) + text[last:]


# --- surrogates

_ONSETS, _VOWELS, _CODAS = "b br d dr f fl g gr h k kl l m n p pr r s st t tr v w z".split(), "a e i o u".split(), "ck ll m n nd r rn s st t th x".split()
#: Endings that let an invented given name pass for a woman's or a man's.
_ENDINGS = {"f": ("a", "ia", "ina", "elle", "ette"), "m": ("o", "us", "an", "ard", "ek")}
STREETS = "Alder Birch Cedar Dogwood Elder Fir Hazel Ivy Jasmine Laurel Maple Oak Pine Quince Rowan Spruce Thistle Umber Violet Willow Yarrow".split()
# Letters of two other scripts for the Latin letters that syllables are made of; and the long forms of street types.
SCRIPTS = {
    "CYRILLIC": dict(zip("abcdefghijklmnoprstuvwxyz", "абкдефгхийклмнопрстуввкыз", strict=True)),
    "GREEK": dict(zip("abcdefghijklmnoprstuvwxyz", "αβκδεφγχιικλμνοπρστυββξυζ", strict=True)),
}
STREET_TYPES = {
    "st": "street", "ave": "avenue", "rd": "road", "ln": "lane", "dr": "drive", "blvd": "boulevard", "ct": "court", "cir": "circle", "ter": "terrace",
    "pkwy": "parkway", "pl": "place", "hwy": "highway", "trl": "trail", "sq": "square",
}
#: Classes that go through a keyed permutation: their spaces are too small to avoid real parts.
PERMUTED = ("initial", "unit", "extension")
_SPLIT_AT = re.compile(_AT + r"|\s+at\s+", re.I)
_SPLIT_DOT = re.compile(_DOT, re.I)
_ADDRESS_PARTS = re.compile(
    rf"(?P<number>\d{{1,6}})(?P<gap>\s+)(?P<way>(?:[NSEW]|NE|NW|SE|SW|north|south|east|west)\b\.?\s+)?(?P<name>.+?)(?P<before>\s+)(?P<type>{_STREET})\b(?P<dot>\.?)"
    rf"(?P<unit>,?\s?(?:(?:apt|apartment|unit|suite|ste|floor|fl|rm|room)\b\.?\s?#?\s?|#\s?))?(?P<id>\w{{1,5}})?$", re.I,
)
_EXTENSION_AT = re.compile(r",?\s?(?:ext|x)", re.I)


def _script(text: str) -> str:
    """The script of the first letter that isn't Latin; LATIN if there is none."""
    for c in text:
        if c.isalpha() and not c.isascii():
            name = unicodedata.name(c, "LATIN").split()[0]
            if name != "LATIN":
                return name
    return "LATIN"


def _phone(value: str) -> tuple[str, str]:
    """(national number, extension), digits only: a leading 1 of eleven digits is the country's."""
    cut = _EXTENSION_AT.search(value)
    main, ext = (value[: cut.start()], value[cut.end() :]) if cut else (value, "")
    digits = re.sub(r"\D", "", main)
    return digits[1:] if len(digits) == 11 and digits[0] == "1" else digits, re.sub(r"\D", "", ext)


def parts(kind: str, value: str) -> list[tuple[str, str]]:
    """(class, normalised part) of an entity: what is kept consistent across mentions."""
    if kind == "name":
        tokens = [t for t in re.split(r"[^\w'’-]+", value) if t]
        return [("initial" if len(t) == 1 else "given_" + GENDER[t.lower()] if t.lower() in GENDER else "surname", t.lower()) for t in tokens]
    if kind == "email":
        box, domain = (*_SPLIT_AT.split(value.lower(), maxsplit=1), "")[:2]
        return [("mailbox", box.strip()), ("domain", _SPLIT_DOT.sub(".", domain).strip())]
    if kind == "address":
        m = _ADDRESS_PARTS.match(value)
        if not m:
            return [("address", re.sub(r"\W+", " ", value.lower()).strip())]
        kept = [m["number"], (m["way"] or "").strip(" ."), *m["name"].split(), STREET_TYPES.get(m["type"].lower(), m["type"].lower())]
        return [("address", " ".join(w for w in kept if w).lower())] + ([("unit", m["id"].lower())] if m["id"] else [])
    if kind == "phone":
        number, ext = _phone(value)
        return [("phone", number)] + ([("extension", ext)] if ext else [])
    return [(kind, re.sub(r"\D", "", value))]


def _permuted(key: bytes, cls: str, part: str) -> str:
    """Each digit and letter moved along a keyed cycle of its kind: no two parts meet and none stays."""
    out = []
    for c in part:
        script = _script(c)
        kind = "0123456789" if c.isdigit() and c.isascii() else "abcdefghijklmnopqrstuvwxyz" if c.isascii() and c.isalpha() else "".join(dict.fromkeys(SCRIPTS.get(script, {}).values()))
        if c not in kind:
            out.append(_neighbour(key, cls, c))
            continue
        cycle = sorted(kind, key=lambda x: hmac.new(key, f"{cls}\0{x}".encode(), hashlib.sha256).digest())
        out.append(cycle[(cycle.index(c) + 1) % len(cycle)])
    return "".join(out)


def _neighbour(key: bytes, salt: str, c: str) -> str:
    """Another letter of c's row of 32 code points, so of its script; c itself if the row has no other."""
    row = [x for x in map(chr, range(ord(c) & ~31, (ord(c) & ~31) + 32)) if x.isalpha() and x == x.lower() and unicodedata.category(x) == unicodedata.category(c)]
    order = sorted(row, key=lambda x: hmac.new(key, f"{salt}\0{x}".encode(), hashlib.sha256).digest())
    return order[(order.index(c) + 1) % len(order)] if c in order else c


def _draw(key: bytes, cls: str, part: str, attempt: int) -> str:
    """The surrogate of a part at an attempt; later attempts draw from an ever larger space, but for numbers of a fixed length."""
    if cls in PERMUTED:
        return _permuted(key, cls, part)
    n = int.from_bytes(hmac.new(key, f"{cls}\0{part}\0{attempt}".encode(), hashlib.sha512).digest(), "big")

    def pick(seq):
        nonlocal n
        n, i = divmod(n, len(seq))
        return seq[i]

    def syllables(k, end=_CODAS):
        return "".join(pick(_ONSETS) + pick(_VOWELS) for _ in range(k)) + pick(end)

    def number(like):
        return pick("23456789") + "".join(pick("0123456789") for _ in like[1:])

    if cls.startswith("given_") or cls == "surname":
        script = _script(part)
        if script not in ("LATIN", *SCRIPTS):  # letter by letter within the part's own rows, longer with each attempt
            return "".join(_neighbour(key, f"{part}\0{attempt}\0{i}", c) if c.isalpha() else c for i, c in enumerate(part + part[:1] * attempt))
        name = "".join(pick(_ONSETS) + pick(_VOWELS) for _ in range(1 + attempt)) + pick(_ONSETS) + pick(_ENDINGS[cls[-1]]) if cls != "surname" else syllables(3 + attempt)
        return name.translate(str.maketrans(SCRIPTS[script])) if script in SCRIPTS else name
    if cls == "mailbox":
        return syllables(3 + attempt) + pick("0123456789") + pick("0123456789") + pick("0123456789")
    if cls == "domain":
        return syllables(2 + attempt) + ".example"
    if cls == "address":
        return f"{number(part.split()[0] if part[:1].isdigit() else '000')} {pick(STREETS)} {syllables(1 + attempt)}".lower()
    if cls == "card":
        body = "9" + "".join(pick("0123456789") for _ in part[2:])
        return next(body + c for c in "0123456789" if luhn(body + c))
    return "9" + number(part)[1:] if cls == "ssn" else number(part)


def _cased(like: str, value: str) -> str:
    return value.upper() if like.isupper() and len(like) > 1 else value if like.islower() else value.title()


def _digits_in(value: str, digits: str) -> str:
    """value with its last digits replaced in order: separators, and a country's 1 in front, stay."""
    skip, it = sum(c.isdigit() for c in value) - len(digits), iter(digits)
    out = []
    for c in value:
        if c.isdigit() and skip > 0:
            skip -= 1
        elif c.isdigit():
            c = next(it)
        out.append(c)
    return "".join(out)


def substitute(kind: str, value: str, to: dict[tuple[str, str], str]) -> str:
    """value with its parts replaced; layout, separators, street type and letter case stay."""
    own = parts(kind, value)
    if kind == "name":
        by = {p: to[c, p] for c, p in own}
        return re.sub(r"[\w'’-]+", lambda m: _cased(m.group(), by[m.group().lower()]) if m.group().lower() in by else m.group(), value)
    new = [to[x] for x in own]
    if kind == "email":
        sep = _SPLIT_AT.search(value)
        head, tail = (value[: sep.start()], value[sep.end() :]) if sep else (value, "")
        dot = _SPLIT_DOT.search(tail)
        case = str.upper if head.isupper() else str
        return case(new[0]) + (sep.group() if sep else "@") + case(new[1].split(".")[0]) + (dot.group() if dot else ".") + case("example")
    if kind == "address":
        number, _, name = new[0].partition(" ")
        m = _ADDRESS_PARTS.match(value)
        if not m:
            return f"{number} {_cased('Aa', name)}"
        shown = _cased(m["name"] if m["name"].isupper() or m["name"].islower() else "Aa", name)
        return f"{number}{m['gap']}{m['way'] or ''}{shown}{m['before']}{m['type']}{m['dot']}{m['unit'] or ''}" + (_cased(m["id"], new[1]) if m["id"] else "")
    if kind == "phone" and (cut := _EXTENSION_AT.search(value)):
        return _digits_in(value[: cut.start()], new[0]) + cut.group() + (_digits_in(value[cut.end() :], new[1]) if len(new) > 1 else value[cut.end() :])
    return _digits_in(value, new[0])


def _detect(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in it:
        rows = []
        for k, t in zip(pdf["k"], pdf["t"]):
            for a, b, kind, v in spans(t):
                cls, part = zip(*parts(kind, v))
                rows.append((k, a, b, kind, v, list(cls), list(part)))
        yield pd.DataFrame(rows, columns=["k", "start", "end", "pii_type", "value", "cls", "part"])


def detect(df: DataFrame, key: str, text: str) -> DataFrame:
    """(k, start, end, pii_type, value, cls, part): one row for each span. Null and empty texts have none."""
    base = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    return base.mapInPandas(_detect, "k long, start int, end int, pii_type string, value string, cls array<string>, part array<string>")


def surrogates(entities: DataFrame, key: bytes, rounds: int = 64) -> DataFrame:
    """(cls, part, surrogate): distinct within names and within each other class, and none of them some real part of it.

    All distinct parts draw; of those that drew the same, all but the first (in order of the part), and all that drew a real
    part, draw again from a larger space until none is left. If the numbers of a fixed length are so many that
    `rounds` rounds leave some, that is an error. Initials, units and extensions are permuted and need no check.
    """
    from harborlight.session import cut, drop_cut

    def draw(it):
        for pdf in it:
            yield pdf.assign(surrogate=[_draw(key, c, p, int(a)) for c, p, a in zip(pdf["cls"], pdf["part"], pdf["attempt"])])

    schema = "cls string, part string, attempt int, surrogate string"
    pairs = entities.select(F.explode(F.arrays_zip("cls", "part")).alias("p")).select("p.cls", "p.part").distinct()
    # given names and surnames are one space: a surrogate of one mustn't be a real one of the other
    space = F.when(F.col("cls").startswith("given_"), F.lit("surname")).otherwise(F.col("cls")).alias("space")
    drawn = cut(pairs.withColumn("attempt", F.lit(0)).mapInPandas(draw, schema))
    real = drawn.select(space, F.col("part").alias("surrogate"), F.lit(True).alias("real")).distinct()
    firsts = drawn
    for _ in range(rounds):
        w = Window.partitionBy("space", "surrogate").orderBy("attempt", "cls", "part")
        ranked = drawn.withColumn("space", space).join(real, ["space", "surrogate"], "left").withColumn("nth", F.row_number().over(w))
        ranked = ranked.withColumn("again", ~F.col("cls").isin(*PERMUTED) & (F.col("real").isNotNull() | (F.col("nth") > 1)))
        if not ranked.where("again").limit(1).count():
            return drawn.select("cls", "part", "surrogate")
        kept = ranked.where("not again").select("cls", "part", "attempt", "surrogate")
        redone = ranked.where("again").select("cls", "part", (F.col("attempt") + 1).alias("attempt")).mapInPandas(draw, schema)
        old, drawn = drawn, cut(kept.unionByName(redone))
        if old is not firsts:
            drop_cut(old)
    raise ValueError(f"parts still share a surrogate or hold a real one after {rounds} rounds")


def pseudonymised(df: DataFrame, key: str, text: str, secret: bytes) -> tuple[DataFrame, DataFrame]:
    """Texts and their replaced spans.

    spans: (key, start, end, pii_type, surrogate), one row for each span. texts: (key, text_placeholder, text_surrogate), one row for each
    row of df; null texts stay null, texts without personal data come out unchanged.
    """
    from harborlight.session import cut

    found = cut(detect(df, key, text))
    table = surrogates(found, secret)
    each = found.select("k", "start", "end", "pii_type", "value", F.explode(F.arrays_zip("cls", "part")).alias("p")).select("k", "start", "end", "pii_type", "value", "p.cls", "p.part")
    joined = each.join(table, ["cls", "part"], "left").groupBy("k", "start", "end", "pii_type", "value").agg(F.collect_list(F.struct("cls", "part", "surrogate")).alias("to"))

    def fill(it):
        for pdf in it:
            new = [substitute(kind, v, {(r["cls"], r["part"]): r["surrogate"] for r in to}) for kind, v, to in zip(pdf["pii_type"], pdf["value"], pdf["to"])]
            yield pdf[["k", "start", "end", "pii_type"]].assign(surrogate=new)

    replaced = joined.mapInPandas(fill, "k long, start int, end int, pii_type string, surrogate string")
    edits = replaced.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("start", "end", "pii_type", "surrogate"))).alias("edits"))

    def splice(it):
        for pdf in it:
            held, drawn = [], []
            for t, e in zip(pdf["t"], pdf["edits"]):
                h, d, last = [], [], 0
                for r in e if t is not None and e is not None else []:
                    h += [t[last : r["start"]], f"[{r['pii_type'].upper()}]"]
                    d += [t[last : r["start"]], r["surrogate"]]
                    last = r["end"]
                held.append(None if t is None else "".join(h) + t[last:])
                drawn.append(None if t is None else "".join(d) + t[last:])
            yield pd.DataFrame({"k": pdf["k"], "text_placeholder": pd.Series(held, dtype=object), "text_surrogate": pd.Series(drawn, dtype=object)})

    base = df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    hit = base.join(edits, "k")
    texts = hit.mapInPandas(splice, "k long, text_placeholder string, text_surrogate string")
    untouched = base.join(edits, "k", "left_anti").select("k", F.col("t").alias("text_placeholder"), F.col("t").alias("text_surrogate"))
    return texts.unionByName(untouched).withColumnRenamed("k", key), replaced.withColumnRenamed("k", key)
