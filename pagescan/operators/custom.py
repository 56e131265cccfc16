"""User-defined regular expressions, within the one pass over the pages.

What a page must contain for a rule to match is taken from the rule's parsed pattern; all those texts are one
automaton, so a page costs about the rules that can match on it.  Rules without look-around, back-references and
the like run in RE2, which looks at a page once; the others run in Python's ``re``, each page and rule for a limited
time.  A rule that fails on a page costs that rule's matches on that page and nothing else.
"""

import re
import signal
from contextlib import contextmanager
from dataclasses import replace
from re import _constants as K
from re import _parser as parser

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from pagescan.functions.folding import caseless, folded
from pagescan.functions.linear import Fact, Pattern, marked
from pagescan.operators import catalog as C
from pagescan.schema import FINDINGS

#: Seconds that one rule may take on one page in ``re``; then it counts as failed there.
TIME_LIMIT = 60.0
MARGIN = 80
_FLAGS = {"i": re.I, "s": re.S, "m": re.M}
_FIELDS = {"rule": ("int", pa.int32()), "text": ("string", pa.string()), "start": ("int", pa.int32()), "stop": ("int", pa.int32()),
           "before": ("string", pa.string()), "after": ("string", pa.string()), "error": ("string", pa.string())}
_DDL = "array<struct<" + ", ".join(f"{n}: {d}" for n, (d, _) in _FIELDS.items()) + ">>"
_KIND = pa.list_(pa.struct([(n, k) for n, (_, k) in _FIELDS.items()]))


def custom_findings(pages: DataFrame, rules) -> DataFrame:
    """Every match of every user rule."""
    from pagescan.operators.textrules import text_findings
    rules = as_custom(rules)
    if not rules:
        return pages.sparkSession.createDataFrame([], FINDINGS)
    return text_findings(pages, rules)


def as_custom(rules) -> list[C.Rule]:
    """Rules of a user's own making as rules of this kind."""
    return [replace(r, kind="custom", cut=r.cut or 200) for r in rules]


# --- what a pattern tells ------------------------------------------------------------------

def required(pattern: str, flags: str = "") -> tuple[str, ...]:
    """Texts of which a page must hold one, folded, for the pattern to match; none where nothing is sure."""
    best = _required(parser.parse(pattern, _as_flags(flags)))
    return tuple(sorted(best)) if best else ()


def _as_flags(flags: str) -> int:
    return sum(_FLAGS[f] for f in set(flags) if f in _FLAGS)


def _weight(found: frozenset) -> int:
    return min(map(len, found)) if found else 0


def _required(items) -> frozenset:
    """The alternatives with the longest shortest text among what the parts of a sequence need."""
    best, run = frozenset(), ""

    def offer(found):
        nonlocal best
        if _weight(found) > _weight(best):
            best = found

    for op, value in items:
        if op is K.LITERAL and caseless(chr(value)):
            run += chr(value)
            continue
        if run:
            offer(frozenset([folded(run)]))
            run = ""
        if op is K.SUBPATTERN:
            offer(_required(value[3]))
        elif op is K.BRANCH:
            each = [_required(b) for b in value[1]]
            if all(each):
                offer(frozenset().union(*each))
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT) and value[0] > 0:
            offer(_required(value[2]))
        elif op is K.ATOMIC_GROUP:
            offer(_required(value))
    if run:
        offer(frozenset([folded(run)]))
    return best


#: What RE2 and ``re`` take alike on any text, and what only on ASCII text.
_PLAIN = {"LITERAL", "NOT_LITERAL", "ANY", "IN", "BRANCH", "SUBPATTERN", "MAX_REPEAT", "MIN_REPEAT", "AT"}


def linear(pattern: str, flags: str = "") -> str:
    """Whether RE2 finds what ``re`` finds: ``yes``, ``ascii`` (on ASCII pages only) or ``no``."""
    tree = parser.parse(pattern, _as_flags(flags))
    if not tree.getwidth()[0] or tree.state.flags & ~(re.U | _as_flags(flags)):
        return "no"
    marks = _alike(tree)
    if "no" in marks or "i" in flags and (not pattern.isascii() or re.search(r"\\[uUxN0-9]", pattern)):
        return "no"
    try:
        Pattern(pattern, flags).regex()
    except ValueError:
        return "no"
    return "ascii" if "ascii" in marks or "i" in flags else "yes"


def _alike(items) -> set[str]:
    marks = set()
    for op, value in items:
        if op.name not in _PLAIN:
            return {"no"}
        if op is K.AT:
            marks.add({K.AT_BEGINNING: "yes", K.AT_BEGINNING_STRING: "yes", K.AT_END_STRING: "yes", K.AT_BOUNDARY: "ascii"}.get(value, "no"))
        elif op is K.IN:
            # Classes of whitespace, digits and words differ in a few characters beyond ASCII.
            marks |= {"ascii" for kind, _ in value if kind is K.CATEGORY}
        elif op is K.BRANCH:
            for b in value[1]:
                marks |= _alike(b)
        elif op is K.SUBPATTERN:
            marks |= {"no"} if value[1] or value[2] else _alike(value[3])
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT):
            low, high, inner = value
            marks |= _alike(inner)
            if max(low, 0 if high is K.MAXREPEAT else high) > 1000 or not inner.getwidth()[0]:
                marks.add("no")
    return marks


# --- matching ------------------------------------------------------------------------------

@contextmanager
def _limited(seconds: float):
    """Ends what runs inside after so many seconds, where the thread can be interrupted."""
    def stop(*_):
        raise TimeoutError(f"more than {seconds:g} seconds")

    try:
        before = signal.signal(signal.SIGALRM, stop)
    except ValueError:  # not the main thread
        yield
        return
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


class Matcher:
    """User rules ready to run: number, key, pattern, flags, engine, and the automaton of what they require."""

    def __init__(self, rules, first: int):
        self.rules, self.always, owners = [], [], {}
        for n, r in enumerate(rules):
            try:
                needed, engine = required(r.pattern, r.flags), linear(r.pattern, r.flags)
            except Exception:  # no pattern at all; it fails on every page
                needed, engine = (), "no"
            self.rules.append((first + n, r.key, r.pattern, _as_flags(r.flags), engine, Pattern(r.pattern, r.flags)))
            for text in needed:
                owners.setdefault(text, set()).add(n)
            if not needed:
                self.always.append(n)
        self.automaton = ahocorasick.Automaton()
        for text, numbers in owners.items():
            self.automaton.add_word(text, tuple(numbers))
        self.any = bool(owners)
        if self.any:
            self.automaton.make_automaton()

    def possible(self, text: str) -> set[int]:
        """The rules that can match."""
        found = set(self.always)
        if self.any:
            for _, numbers in self.automaton.iter(folded(text)):
                found.update(numbers)
        return found

    def find(self, texts: pa.Array) -> list[list[dict]]:
        pages = [text or "" for text in texts.to_pylist()]
        out, tries = [[] for _ in pages], {}
        for place, text in enumerate(pages):
            for n in self.possible(text):
                tries.setdefault(n, []).append(place)
        for n in sorted(tries):
            number, key, pattern, flags, engine, linear_form = self.rules[n]
            for place in tries[n]:
                text = pages[place]
                try:
                    if engine == "yes" or engine == "ascii" and text.isascii():
                        spans = _re2_spans(text, linear_form)
                    else:
                        with _limited(TIME_LIMIT):
                            spans = [m.span() for m in re.finditer(pattern, text, flags)]
                except Exception as error:  # this rule, on this page
                    out[place].append(dict.fromkeys(_FIELDS) | {"rule": number, "error": f"{key}: {type(error).__name__}: {error}"})
                    continue
                out[place] += [{"rule": number, "text": text[a:b], "start": a, "stop": b, "before": text[max(0, a - MARGIN):a],
                                "after": text[b:b + MARGIN], "error": None} for a, b in spans]
        return out


def _re2_spans(text: str, pattern: Pattern) -> list[tuple[int, int]]:
    cut, at, spans = marked(pa.array([text], pa.string()), pattern, 3)[0], 0, []
    for gap, found in zip(cut[0::4], cut[1::4]):
        spans.append((at + len(gap), at + len(gap) + len(found)))
        at = spans[-1][1]
    return spans


def custom_fact(rules, first: int) -> Fact:
    """The matches of user rules, which are numbered from ``first``."""
    matcher = Matcher(rules, first)
    return Fact("custom", _DDL, _KIND, matcher.find)


def is_custom(rule: C.Rule) -> bool:
    return rule.kind == "custom"
