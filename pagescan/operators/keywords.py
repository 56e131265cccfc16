"""Keywords of any number, found in one look at a page.

An Aho-Corasick automaton over folded text gives every place of every keyword, so the time for a page does not
grow with the list.  It is built once, on the driver, and travels as a broadcast of bounded size.
"""

import ahocorasick
import pyarrow as pa
from pyspark.sql import SparkSession

from pagescan.functions.folding import folded
from pagescan.functions.linear import Fact

#: Characters of the keywords of one automaton; some 60 bytes each in a worker.  Longer lists are matched in several passes.
MOST_CHARS = 2_000_000
#: Characters shown on both sides of a keyword.
MARGIN = 60
_FIELDS = {"text": ("string", pa.string()), "start": ("int", pa.int32()), "stop": ("int", pa.int32()), "before": ("string", pa.string()),
           "after": ("string", pa.string()), "label": ("string", pa.string()), "note": ("string", pa.string()), "level": ("int", pa.int32())}
_DDL = "array<struct<" + ", ".join(f"{n}: {d}" for n, (d, _) in _FIELDS.items()) + ">>"
_KIND = pa.list_(pa.struct([(n, k) for n, (_, k) in _FIELDS.items()]))


def blocks(keywords: list[dict]) -> list[list[dict]]:
    """The keywords in lists of bounded size."""
    out, size = [[]], 0
    for k in keywords:
        if out[-1] and size + len(k["folded"]) > MOST_CHARS:
            out.append([])
            size = 0
        out[-1].append(k)
        size += len(k["folded"])
    return out


def automaton(keywords: list[dict]) -> tuple:
    """(the automaton or None, what the matches of each keyword carry)."""
    rows = [(k["keyword"], k["category_name"], k["weight"], len(k["folded"]), k["whole"]) for k in keywords]
    owners, out = {}, ahocorasick.Automaton()
    for number, k in enumerate(keywords):
        owners.setdefault(k["folded"], []).append(number)
    for word, numbers in owners.items():
        out.add_word(word, tuple(numbers))
    if owners:
        out.make_automaton()
    return out if owners else None, rows


def find(words: tuple, text: str | None) -> list[dict]:
    """Every keyword's matches, those of one keyword apart from each other, leftmost first."""
    (tree, rows), out, free = words, [], {}
    if not text or tree is None:
        return out
    for last, numbers in tree.iter(folded(text)):
        stop = last + 1
        for number in numbers:
            label, note, level, length, whole = rows[number]
            start = stop - length
            if start < free.get(number, 0) or whole and not _stands_alone(text, start, stop):
                continue
            free[number] = stop
            out.append({"text": text[start:stop], "start": start, "stop": stop, "before": text[max(0, start - MARGIN):start],
                        "after": text[stop:stop + MARGIN], "label": label, "note": note, "level": level})
    return out


def _stands_alone(text: str, start: int, stop: int) -> bool:
    """Whether neither neighbour is a word character."""
    return not (start and (text[start - 1].isalnum() or text[start - 1] == "_")) and not (
        stop < len(text) and (text[stop].isalnum() or text[stop] == "_"))


def keyword_fact(spark: SparkSession, keywords: list[dict]) -> Fact:
    sent = spark.sparkContext.broadcast(automaton(keywords))
    return Fact("keywords", _DDL, _KIND, lambda texts: [find(sent.value, text) for text in texts.to_pylist()])
