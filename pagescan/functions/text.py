"""SQL expressions for text: folding, match extraction with offsets, context windows.

Helpers take and return Spark SQL text.  One ``F.expr`` per page array keeps plans with
many rules quick to build, which a tree of Column calls does not.
"""

from itertools import count

from pagescan.functions.dialect import to_java

_names = count()


def lit(value) -> str:
    """A SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int | float):
        return str(value)
    text = value.replace("\\", "\\\\").replace("'", "\\'").replace("$", "\\u0024")
    return f"'{text}'"


def lits(values) -> str:
    return ", ".join(lit(v) for v in values)


def struct(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{name}', {value}" for name, value in fields.items()) + ")"


def each(function: str, array: str, body, indexed: bool = False) -> str:
    """``transform``/``filter``/``exists`` with a fresh variable name."""
    n = next(_names)
    if indexed:
        return f"{function}({array}, (x{n}, i{n}) -> {body(f'x{n}', f'i{n}')})"
    return f"{function}({array}, x{n} -> {body(f'x{n}')})"


def let(body, **values: str) -> str:
    """Evaluate ``values`` once and hand them to ``body`` as fields of one variable.

    Inside a lambda Spark evaluates again whatever the lambda captures, so anything costly
    has to be bound first.
    """
    return f"get({each('transform', f'array({struct(**values)})', body)}, 0)"


def when(condition: str | None, value: str) -> str:
    return value if condition is None else f"CASE WHEN {condition} THEN {value} END"


def only(*rows: str) -> str:
    """The array of those rows that are not NULL."""
    return f"array_compact(array({', '.join(rows)}))"


def fold(text: str) -> str:
    """Lower-case for literal guards, including the letters that case-insensitive
    matching treats as i, s and sigma but ``lower`` leaves alone."""
    odd = text
    for letter, plain in (("İ", "i"), ("ı", "i"), ("ſ", "s"), ("ς", "σ"), ("Σ", "σ")):
        odd = f"replace({odd}, '{letter}', '{plain}')"
    return f"lower(IF(octet_length({text}) = char_length({text}), {text}, {odd}))"


def valid(column: str) -> str:
    """A string column fit for Python and RE2: what is no UTF-8 becomes U+FFFD."""
    return f"make_valid_utf8(CAST({column} AS STRING)) AS {column}"


def contains_any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {lit(w)})" for w in words) + ")"


def first_word(text: str, words) -> str:
    """The first word, in list order, that the text contains; NULL if none."""
    return "CASE " + " ".join(f"WHEN contains({text}, {lit(w)}) THEN {lit(w)}" for w in words) + " END"


def one_line(text: str) -> str:
    return f"translate({text}, '\n\r', '  ')"


def from_char(text: str, start: str) -> str:
    return f"substring({text}, {start}, length({text}))"


def total(numbers: str) -> str:
    n = next(_names)
    return f"aggregate({numbers}, 0, (a{n}, b{n}) -> a{n} + b{n})"


def running_totals(steps: str) -> str:
    """For each position the sum of all steps before it.

    Works in blocks of sqrt(n), so a page with very many matches does not cost n * n.
    """
    def from_blocks(v):
        def from_sums(s):
            def place(b):
                def before(_, i):
                    block = f"CAST({i} div {v}.width AS INT)"
                    return (f"get({b}.bases, {block}) + "
                            + total(f"slice({v}.steps, {block} * {v}.width + 1, {i} % {v}.width)"))
                return each("transform", f"{v}.steps", before, indexed=True)
            return let(place, bases=each(
                "transform", f"{s}.sums", lambda _, i: total(f"slice({s}.sums, 1, {i})"), indexed=True))
        blocks = f"sequence(0, CAST((size({v}.steps) - 1) div {v}.width AS INT))"
        return let(from_sums, sums=each(
            "transform", blocks, lambda b: total(f"slice({v}.steps, {b} * {v}.width + 1, {v}.width)")))
    return let(lambda v: let(from_blocks, steps=f"{v}.steps",
                             width=f"CAST(ceil(sqrt(size({v}.steps))) AS INT)"), steps=steps)


def pieces(content: str, rx: str, groups=(), at_least: int = 1, rest: str | None = None, **extra: str) -> str:
    """The matches of a Java pattern (SQL text) and the gaps between them, as one struct.

    The pattern must not match the empty string.  NULL unless there are ``at_least``
    matches; the gaps are only cut out where there are.  ``rest`` is text that follows
    ``content`` on the page, known to hold no match.
    """
    def cut(v):
        gaps = f"split({content}, {rx}, -1)"
        if rest is not None:
            gaps = let(lambda g: each("transform", f"{g}.pieces", lambda gap, i: (
                f"IF({i} = size({g}.pieces) - 1, concat({gap}, {rest}), {gap})"), indexed=True), pieces=gaps)
        captured = {f"g{g}": f"regexp_extract_all({content}, {rx}, {g})" if g in groups
                    else "CAST(NULL AS ARRAY<STRING>)" for g in (1, 2)}
        return when(f"size({v}.found) >= {at_least}", struct(found=f"{v}.found", gaps=gaps, **captured, **extra))

    return let(cut, found=f"regexp_extract_all({content}, {rx}, 0)")


def spans(p: str, margin: str, until: str = "CAST(NULL AS INT)", keep=()) -> str:
    """``array<struct<text, start, stop, before, after, g1, g2, n>>`` of ``pieces``.

    Offsets count code points; ``before``/``after`` hold up to ``margin`` characters around
    the match.  Where ``until`` is not NULL there is one span only, from the first match up
    to match number ``until``.  Offsets and contexts are put together from the pieces, so
    the work stays linear in the size of the page.  ``keep`` names fields of ``p`` to repeat.
    """
    def build(b):
        def span(text, i, last):
            left = f"slice({b}.lefts, greatest({i} - {margin} + 2, 1), least({i} + 1, {margin}))"
            start = f"get({b}.totals, {i}) + length(get({p}.gaps, {i}))"
            return struct(
                text=text, start=start, stop=f"{start} + length({text})",
                before=f"right(array_join({left}, ''), {margin})",
                after=f"left(array_join(slice({b}.rights, {last} + 1, {margin}), ''), {margin})",
                g1=f"get({p}.g1, {i})", g2=f"get({p}.g2, {i})", n=f"size({p}.found)",
                **{name: f"{p}.{name}" for name in keep})

        last = f"least({until}, size({p}.found) - 1)"
        n = next(_names)
        stretch = (f"array_join(concat(slice({p}.found, 1, 1), flatten(zip_with(slice({p}.gaps, 2, {last}), "
                   f"slice({p}.found, 2, {last}), (g{n}, m{n}) -> array(g{n}, m{n})))), '')")
        every = each("transform", f"{p}.found", lambda text, i: span(text, i, i), indexed=True)
        return f"IF({until} IS NULL, {every}, array({span(stretch, '0', last)}))"

    # lefts[i]: text from the previous match up to match i; rights[i]: text after match i up to
    # the end of the next match; each cut to what a context can still show.
    return let(
        build,
        lefts=each("transform", f"{p}.found", lambda _, i: (
            f"right(concat(coalesce(get({p}.found, {i} - 1), ''), get({p}.gaps, {i})), {margin})"), indexed=True),
        rights=each("transform", f"{p}.found", lambda _, i: (
            f"left(concat(get({p}.gaps, {i} + 1), coalesce(get({p}.found, {i} + 1), '')), {margin})"), indexed=True),
        totals=running_totals(each("transform", f"{p}.found", lambda text, i: (
            f"length(get({p}.gaps, {i})) + length({text})"), indexed=True)))


def around(span: str) -> str:
    """The context of a span: its text with the neighbouring characters."""
    return f"concat({span}.before, {span}.text, {span}.after)"


def matches(content: str, pattern: str, flags: str = "", groups=(), margin: int = 50) -> str:
    """``spans`` of a pattern in Python syntax; NULL where nothing matches."""
    return let(lambda v: when(f"{v}.p IS NOT NULL", spans(f"{v}.p", str(margin))),
               p=pieces(content, lit(to_java(pattern, flags)), groups))


def has_match(content: str, pattern: str, flags: str = "") -> str:
    return f"rlike({content}, {lit(to_java(pattern, flags))})"
