"""All matches of patterns that a backtracking engine can be held up by, found in linear time.

Open repetitions such as ``[^>]+`` followed by more cost a backtracking engine the square or the cube of a
page that repeats the beginning and never the end.  RE2, which Arrow's string kernels use, looks at a page
once.  A page is taken apart by marking its matches and cutting at the marks.
"""

import random
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from pagescan.functions.dialect import to_re2

#: Texts of a batch are looked at in slices of so many bytes and rows: what they hold takes many times their size as Python objects.
SLICE_BYTES, SLICE_ROWS = 1_000_000, 500

#: The matches of a pattern, as ``functions.text.pieces`` has them.
PIECES = "struct<found: array<string>, gaps: array<string>, g1: array<string>, g2: array<string>>"
_PIECES = pa.struct([(name, pa.list_(pa.string())) for name in ("found", "gaps", "g1", "g2")])


@dataclass(frozen=True)
class Pattern:
    """A pattern in Python syntax; ``before`` is text that must stand ahead and does not count."""

    pattern: str
    flags: str = ""
    groups: tuple = ()
    before: str = ""
    at_least: int = 1

    def regex(self) -> str:
        return to_re2(f"({self.before})({self.pattern})", self.flags)


def _mark(texts: pa.Array) -> str:
    """Text that occurs in none of the texts: a private-use character, or two of them where the first ones are taken.

    Two different characters cannot overlap with themselves, so cutting at them is as safe as at one.
    """
    for c in map(chr, range(0xE000, 0xE004)):
        if not pc.any(pc.match_substring(texts, c)).as_py():
            return c
    while True:
        pair = "".join(map(chr, random.sample(range(0xE000, 0xF900), 2)))
        if not pc.any(pc.match_substring(texts, pair)).as_py():
            return pair


def marked(texts: pa.Array, p: Pattern, first_group: int) -> list[list[str]]:
    """Each text as [gap, match, group 1, group 2, gap, ...]; groups that are not asked for are empty."""
    mark = _mark(texts)
    groups = "".join(mark + (f"\\{first_group + g - 1}" if g in p.groups else "") for g in (1, 2))
    out = pc.replace_substring_regex(texts, pattern=p.regex(), replacement=f"\\1{mark}\\2{groups}{mark}")
    return pc.split_pattern(out, mark).to_pylist()


@dataclass(frozen=True)
class Fact:
    """Something else a page's text is asked for: a field with its SQL and Arrow type, and a function from
    texts to values."""

    name: str
    ddl: str
    kind: pa.DataType
    of: object


def _each(texts: pa.Array, of, name: str) -> list[tuple]:
    """(value, error) for each text: all at once or, if that fails, one by one, so that a text that
    breaks something loses just that."""
    try:
        return [(value, None) for value in of(texts)]
    except Exception as error:
        if len(texts) == 1:
            return [(None, f"{name}: {type(error).__name__}: {error}")]
        return [one for i in range(len(texts)) for one in _each(texts.slice(i, 1), of, name)]


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first row, rows) of consecutive slices; a text longer than a slice is one of its own.  One empty slice of no texts."""
    begin, held = 0, 0
    for row, size in enumerate(pc.binary_length(texts).fill_null(0).to_pylist()):
        if row > begin and (held + size > SLICE_BYTES or row - begin >= SLICE_ROWS):
            yield begin, row - begin
            begin, held = row, 0
        held += size
    yield begin, len(texts) - begin


def matcher(patterns: list[Pattern], facts: tuple[Fact, ...] = ()):
    """A column function of (text, bits): a struct with a field ``p0, p1, ...`` for each pattern, its ``PIECES`` or NULL,
    one for each fact, and ``failed``, what failed on the text.

    Pattern number k is tried on rows with bit k set; the facts have the bits behind.  Marked as not
    deterministic, so that Spark evaluates it once.  A batch is taken and given back in slices, so a worker's memory does not
    follow the size of batches.
    """
    counts = [3 + p.before.count("(") - p.before.count("(?") for p in patterns]

    def cuts(p, first_group):
        def of(texts):
            return [{"found": cut[1::4], "gaps": cut[0::4], "g1": cut[2::4], "g2": cut[3::4]} if len(cut) > 4 * p.at_least - 4 + 1 else None
                    for cut in marked(texts, p, first_group)]
        return of

    asked_for = [(f"p{k}", cuts(p, first), _PIECES, p.pattern) for k, (p, first) in enumerate(zip(patterns, counts))]
    asked_for += [(f.name, f.of, f.kind, f.name) for f in facts]

    def look(texts: pa.Array, bits: pa.Array) -> pa.Array:
        fields, rows, failed = [], len(texts), {}
        asked = bits.fill_null(0).to_numpy(zero_copy_only=False)
        for k, (_, of, kind, name) in enumerate(asked_for):
            values, places = [None] * rows, (asked >> k & 1).nonzero()[0]
            if len(places):
                for place, (value, error) in zip(places.tolist(), _each(texts.take(pa.array(places)), of, name)):
                    values[place] = value
                    if error:
                        failed.setdefault(place, []).append(error)
            fields.append(pa.array(values, kind))
        fields.append(pa.array([failed.get(i) for i in range(rows)], pa.list_(pa.string())))
        return pa.StructArray.from_arrays(fields, [name for name, *_ in asked_for] + ["failed"])

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, bits in batches:
            for begin, rows in slices(texts):
                yield look(texts.slice(begin, rows), bits.slice(begin, rows))

    kind = ", ".join([f"p{k}: {PIECES}" for k in range(len(patterns))] + [f"{f.name}: {f.ddl}" for f in facts] + ["failed: array<string>"])
    return F.arrow_udf(run, f"struct<{kind}>").asNondeterministic()
