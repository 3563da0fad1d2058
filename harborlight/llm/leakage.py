"""Test passages in training text: one Aho-Corasick automaton over the normalised test items.

Both sides are cut into words (runs of letters or digits of the consistent, lower-cased text). Words of the test items get
a character each, all others one that no item has; a text becomes a string of such characters, and every window of
`min_words` of an item is one key of the automaton. A document is scanned once; a hit maps through word and
character offsets back to the original text. The items are a fixed evaluation set; a task holds one automaton of at most MAX_ITEM_CHARS
characters of them. A larger set goes through several automata, one after the other, each over all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborlight.llm.consistent import WORD, consistent, consistent_with_offsets
from harborlight.session import cut

MIN_WORDS = 12
#: An automaton takes about 150 bytes a character of test text; this bounds it at about 300 MB a worker.
MAX_ITEM_CHARS = 2_000_000
#: Markup, which stands between words without being one: tags, entities, link targets and speakers at the start of a line.
MARKUP = re.compile(r"<[/!]?[a-zA-Z][^<>]*>|&(?:[a-zA-Z]{2,8}|#\d{1,6});|\]\([^()\s]*\)")


def _code(i: int) -> str:
    """The character that stands for the i-th word of the items: any but \\0 and the surrogates, so there are 1,112,063 of them.

    More than MAX_ITEM_CHARS characters can hold, with a character between words, unless most words are single letters, which are fewer.
    """
    return chr(i + 1 if i + 1 < 0xD800 else i + 0x801)


class Automaton:
    """Windows of all items. Picklable: it travels as the items and is built once in a worker."""

    def __init__(self, items: list[tuple[int, str]], min_words: int = MIN_WORDS):
        self.items, self.min_words, self._built = sorted(items), min_words, None

    def __getstate__(self):
        return {"items": self.items, "min_words": self.min_words, "_built": None}

    def build(self):
        if self._built is None:
            codes: dict[str, str] = {}
            windows: dict[str, list[int]] = {}
            for item, text in self.items:
                words = words_of(text)
                line = "".join(codes.setdefault(w, _code(len(codes))) for w in words)
                for i in range(len(line) - self.min_words + 1):
                    owners = windows.setdefault(line[i : i + self.min_words], [])
                    if item not in owners:
                        owners.append(item)
            auto = ahocorasick.Automaton()
            for w, owners in windows.items():
                auto.add_word(w, tuple(owners))
            auto.make_automaton()
            self._built = codes, auto if windows else None
        return self._built

    def scan(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item, start, end, words) of each maximal passage, with offsets in the original text."""
        codes, auto = self.build()
        if not text or auto is None:
            return []
        form = consistent(text)
        plain = MARKUP.sub(lambda m: " " * len(m.group()), form) if "<" in form or "&" in form or "](" in form else form
        low = plain.lower()
        if len(low) != len(plain):  # a few letters get longer in lower case; offsets need equal lengths
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in plain)
        get = codes.get
        line = "".join([get(w, "\0") for w in WORD.findall(low)])
        open_: dict[int, list[int]] = {}
        found: list[tuple[int, int, int]] = []
        for end, owners in auto.iter(line):
            for item in owners:
                run = open_.get(item)
                if run and end <= run[1] + 1:
                    run[1] = end
                else:
                    if run:
                        found.append((item, run[0], run[1]))
                    open_[item] = [end - self.min_words + 1, end]
        found += [(item, *run) for item, run in open_.items()]
        if not found:
            return []
        spans = [m.span() for m in WORD.finditer(low)]
        at = consistent_with_offsets(text)[1]
        place = (lambda i: i) if at is None else (lambda i: at[i])
        return sorted((item, place(spans[a][0]), place(spans[b][1] - 1) + 1, b - a + 1) for item, a, b in found)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(MARKUP.sub(" ", consistent(text)).lower()) if text else []


def leaked_passages(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, min_words: int = MIN_WORDS) -> DataFrame:
    """(key, item_id, start, end, n_words): each maximal passage of at least min_words consecutive words of an item.

    start and end are code point offsets in the document's own text. Null texts and items hold nothing; items shorter than
    min_words can't be found. Repeated document rows give repeated passages.
    """
    held = items.where(F.col(item_key).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_key).cast("long").alias("i"), F.col(item_text).alias("t")).distinct()
    cols = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    context = docs.sparkSession.sparkContext
    shards = _shards(held)
    parts = []
    for shard in shards:
        rows = [tuple(r) for r in (held if len(shards) == 1 else held.where(shard)).collect()]
        automaton = context.broadcast(Automaton(rows, min_words))
        found = cols.mapInPandas(_scanner(automaton), "k long, item_id long, start int, end int, n_words int")
        if len(shards) > 1:  # hold one automaton at a time
            found = cut(found)
            automaton.destroy()
        parts.append(found)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumnRenamed("k", key)


def _shards(items: DataFrame, most: int | None = None) -> list:
    """Conditions that part the items (i, t) by hash into sets of at most MAX_ITEM_CHARS characters, halved as often as needed.

    An item longer than that is a set of its own.
    """
    most = most or MAX_ITEM_CHARS
    whole = F.lit(True)
    todo, done = [(1, 0)], []
    while todo:
        of, nth = todo.pop()
        at = F.pmod(F.xxhash64("i"), F.lit(of)) == nth if of > 1 else whole
        size, n = items.where(at).agg(F.coalesce(F.sum(F.length("t")), F.lit(0)), F.count_distinct("i")).first()
        if size <= most or n <= 1:
            if n or of == 1:
                done.append(at)
        else:
            todo += [(of * 2, nth), (of * 2, nth + of)]
    return done


def _scanner(automaton):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scan = automaton.value.scan
        for pdf in it:
            rows = [(k, *hit) for k, t in zip(pdf["k"], pdf["t"]) for hit in scan(t)]
            yield pd.DataFrame(rows, columns=["k", "item_id", "start", "end", "n_words"])

    return run
