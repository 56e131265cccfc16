"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Everything is Spark expressions.  Patterns are possessive, so each looks at a text once; offsets
come from the pieces between matches.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagescan.functions.text import each, let, lit, running_totals

#: Kinds in the order of the contract, then those the method adds.
KINDS = ("email", "ip", "card", "phone", "iban", "local_phone", "private_key", "access_key", "secret")
_LOCAL = "A-Za-z0-9._%+-"
#: Java forms of the patterns; each begins where a run begins or the last match ended.
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9](?:[\x20().-]*+[0-9])++",
    # Only the beginning; where an account number ends is for _accounts to find.
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]){11})",
    "local_phone": r"(?<![0-9A-Za-z+.])\(?[0-9]{2,4}\)?[\x20-][0-9]{3,4}[\x20-][0-9]{3,4}(?![0-9A-Za-z])",
    "private_key": r"-----BEGIN(?:\x20[A-Z]{1,20}){0,3}\x20PRIVATE\x20KEY-----(?:[^-]++-----END[A-Z\x20]{1,60}+-----)?",
    "access_key": r"(?<![A-Za-z0-9_])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[opsru]_[A-Za-z0-9]{36}|xox[abpr]-[A-Za-z0-9-]{9,99}[A-Za-z0-9])(?![A-Za-z0-9_])",
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+",
}
#: From its beginning, an account number is within this run: 34 characters with a blank before each.
_ACCOUNT_RUN, _ACCOUNT_CHARS = r"^[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+", 68
#: Score of a confirmed span, what a context word adds, how far it may be, and what is wanted.
SCORES = {"email": 0.9, "ip": 0.8, "card": 0.9, "phone": 0.8, "iban": 0.9, "local_phone": 0.3, "private_key": 0.9,
          "access_key": 0.9, "secret": 0.3}
CONTEXT_WORDS = {
    "email": ["mail", "contact"], "ip": ["ip", "address", "host"], "card": ["card", "visa", "credit"],
    "phone": ["phone", "tel", "call", "mobile"], "iban": ["iban", "account", "bank"],
    "local_phone": ["phone", "tel", "telefon", "call", "mobile", "fax", "teléfono", "téléphone"],
    "private_key": ["key"], "access_key": ["key", "token"],
    "secret": ["token", "secret", "password", "passwd", "key", "apikey", "api_key", "credential", "credentials", "bearer", "authorization"]}
CONTEXT_BONUS, CONTEXT_CHARS, WANTED = 0.4, 40, 0.5


def _digits(span: str) -> str:
    return f"regexp_replace({span}, '[^0-9]++', '')"


def _mod97(span: str) -> str:
    """Remainder of an account number by 97: first four characters last, letters as 10 to 35."""
    plain = f"replace({span}, ' ', '')"
    turned = f"concat(substring({plain}, 5), left({plain}, 4))"
    return (f"aggregate(split({turned}, ''), 0, (a, c) -> CASE WHEN c = '' THEN a WHEN c <= '9' "
            f"THEN (a * 10 + ascii(c) - 48) % 97 ELSE (a * 100 + ascii(c) - 55) % 97 END)")


def _valid(kind: str, span: str) -> str:
    if kind == "ip":
        # Leading zeros aside, no part has more than three digits or is above 255.
        return f"NOT exists(split({span}, '[.]'), p -> length(ltrim('0', p)) > 3 OR CAST(right(p, 3) AS INT) > 255)"
    if kind == "card":
        return f"length({_digits(span)}) BETWEEN 14 AND 19 AND luhn_check({_digits(span)})"
    if kind == "phone":
        return f"length({_digits(span)}) BETWEEN 10 AND 15"
    if kind == "secret":
        # Letters and digits mixed, and not a repeated few.
        return (f"length({span}) <= 200 AND length({_digits(span)}) >= 4 AND length(regexp_replace({span}, '[^A-Za-z]++', '')) >= 2 "
                f"AND size(array_distinct(split({span}, ''))) >= 8")
    if kind == "iban":
        return f"length(replace({span}, ' ', '')) BETWEEN 15 AND 34 AND {_mod97(span)} = 1"
    return "true"


def _spans(text: str, kind: str) -> str:
    """SQL array of (kind, start, stop, score) of the confirmed matches, NULL where nothing matches."""
    pattern = lit(PATTERNS[kind])
    heard = lit(r"(?i)\b(?:" + "|".join(CONTEXT_WORDS[kind]) + r")\b")

    def place(v):
        def with_starts(w):
            def one(span, i):
                start = f"CAST(get({w}.totals, {i}) + length(get({v}.gaps, {i})) AS BIGINT)"
                near = (f"concat(right(get({v}.gaps, {i}), {CONTEXT_CHARS}), ' ', "
                        f"left(get({v}.gaps, {i} + 1), {CONTEXT_CHARS}))")
                return (f"IF({_valid(kind, span)}, named_struct('start', {start}, 'rank', {KINDS.index(kind)}, "
                        f"'stop', {start} + length({span}), 'score', {SCORES[kind]}D + "
                        f"IF({near} rlike {heard}, {CONTEXT_BONUS}D, 0D)), NULL)")
            spans = each("transform", f"{v}.found", one, indexed=True)
            return f"filter({spans}, s -> s.score >= {WANTED}D)"
        return let(with_starts, totals=running_totals(each("transform", f"{v}.found", lambda span, i: (
            f"length(get({v}.gaps, {i})) + length({span})"), indexed=True)))

    matched = let(place, found=f"regexp_extract_all({text}, {pattern}, 0)", gaps=f"split({text}, {pattern}, -1)")
    return f"IF({text} rlike {pattern}, {matched}, array())"


def _accounts(text: str) -> str:
    """As ``_spans`` for account numbers: of each run the longest prefix that ends with a word and is valid.

    A run goes on over blanks into the words behind the number, so its end says nothing; only the beginning is
    matched, and a number inside another one is left out.
    """
    pattern = lit(PATTERNS["iban"])
    heard = lit(r"(?i)\b(?:" + "|".join(CONTEXT_WORDS["iban"]) + r")\b")
    chars = _ACCOUNT_CHARS + CONTEXT_CHARS

    def place(v):
        def ahead(i):
            # The text from a beginning on; pieces have five characters or more.
            return (f"left(aggregate(sequence({i}, least({i} + {chars // 5 + 1}, size({v}.found) - 1)), '', (t, j) -> "
                    f"IF(length(t) >= {chars}, t, concat(t, get({v}.found, j), left(get({v}.gaps, j + 1), {chars})))), {chars})")

        def stops(c):
            return (f"filter(sequence(greatest(length({c}.run), 15), 15, -1), p -> substring({c}.ahead, p, 1) != ' ' "
                    f"AND NOT substring({c}.ahead, p + 1, 1) rlike '[A-Za-z0-9]' AND {_valid('iban', f'left({c}.ahead, p)')})")

        def with_starts(w):
            def one(_, i):
                def span(s):
                    near = (f"concat(right(get({v}.gaps, {i}), {CONTEXT_CHARS}), ' ', "
                            f"substring({s}.ahead, {s}.chars + 1, {CONTEXT_CHARS}))")
                    return (f"IF({s}.chars IS NULL, NULL, named_struct('start', {s}.start, 'rank', {KINDS.index('iban')}, 'stop', "
                            f"{s}.start + {s}.chars, 'score', {SCORES['iban']}D + IF({near} rlike {heard}, {CONTEXT_BONUS}D, 0D)))")
                start = f"CAST(get({w}.totals, {i}) + length(get({v}.gaps, {i})) AS BIGINT)"
                return let(lambda a: let(lambda c: let(span, ahead=f"{c}.ahead", start=start, chars=f"get({stops(c)}, 0)"),
                                         ahead=f"{a}.ahead", run=f"regexp_extract({a}.ahead, {lit(_ACCOUNT_RUN)}, 0)"), ahead=ahead(i))
            return let(lambda f: f"aggregate({f}.spans, filter({f}.spans, s -> false), (a, s) -> "
                                 f"IF(size(a) > 0 AND s.start < get(a, size(a) - 1).stop, a, concat(a, array(s))))",
                       spans=f"filter({each('transform', f'{v}.found', one, indexed=True)}, s -> s.score >= {WANTED}D)")
        return let(with_starts, totals=running_totals(each("transform", f"{v}.found", lambda span, i: (
            f"length(get({v}.gaps, {i})) + length({span})"), indexed=True)))

    matched = let(place, found=f"regexp_extract_all({text}, {pattern}, 0)", gaps=f"split({text}, {pattern}, -1)")
    return f"IF({text} rlike {pattern}, {matched}, array())"


def find(docs: DataFrame, keep=("doc_id",)) -> DataFrame:
    """``keep`` and ``spans``: array of (start, rank, stop, score) by start, then kind; a row per row.

    Offsets count code points, the stop is exclusive, rank is the place in ``KINDS``.  Account numbers
    (mod 97), phone numbers without a country code and secrets (long runs of mixed letters and digits), which both need a
    context word, private keys and access keys of known forms are found besides the four base kinds; one that overlaps
    a base span, or one found before it, is left out.  NULL and empty texts hold
    nothing.  Other columns are not read.
    """
    text = "coalesce(CAST(text AS STRING), '')"

    def apart(found, others, but_cards=True):
        cards = "y.rank != 2 AND " if but_cards else ""
        return f"filter({found}, x -> NOT exists({others}, y -> {cards}x.start < y.stop AND y.start < x.stop))"

    def gather(v):
        # Each kind the method adds gives way to what is there before it.
        def from_base(b):
            def from_firm(c):
                def from_known(d):
                    return let(lambda e: f"array_sort(concat({e}.sure, {apart(f'{v}.local_phone', f'{e}.sure', False)}))",
                               sure=f"concat({d}.known, {apart(f'{v}.secret', f'{d}.known')})")
                return let(from_known, known=f"concat({c}.firm, {apart(f'concat({v}.private_key, {v}.access_key)', f'{c}.firm')})")
            return let(from_firm, firm=f"concat({b}.base, {apart(f'{v}.iban', f'{b}.base')})")
        return let(from_base, base=f"concat({', '.join(f'{v}.{k}' for k in KINDS[:4])})")

    spans = let(lambda t: let(gather, **{k: _accounts(f"{t}.t") if k == "iban" else _spans(f"{t}.t", k) for k in KINDS}), t=text)
    return docs.select(*keep, F.expr(f"{spans} AS spans"))


def redact(docs: DataFrame, keep=("doc_id",)) -> DataFrame:
    """``keep`` and the text with each span replaced by its kind in square brackets.

    Of overlapping spans the one that begins first (then the first kind) is replaced.
    """
    names = ", ".join(f"'[{k}]'" for k in KINDS)
    out = ("aggregate(spans, named_struct('at', 0L, 'done', array('')), (a, s) -> IF(s.start < a.at, a, named_struct("
           f"'at', s.stop, 'done', concat(a.done, array(substring(_text, CAST(a.at AS INT) + 1, CAST(s.start - a.at AS INT)), "
           f"array({names})[s.rank])))), a -> array_join(concat(a.done, array(substring(_text, CAST(a.at AS INT) + 1))), ''))")
    found = find(docs.select(F.struct(*keep).alias("_row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")),
                 ["_row", F.col("text").alias("_text")])
    return found.select("_row.*", F.expr(f"{out} AS text"))


def digest(found: DataFrame, keep=("doc_id",)) -> DataFrame:
    """The spans of ``find`` as counts and strings ``kind:start:stop``, comma-joined."""
    kinds = "array(" + ", ".join(map(lit, KINDS)) + ")"
    joined = lambda spans: (f"array_join(transform({spans}, s -> concat({kinds}[s.rank], ':', s.start, ':', s.stop)), ',')")
    return found.select(*keep, *[F.expr(f"CAST(size(filter(spans, s -> s.rank = {i})) AS BIGINT) AS n_{k}")
                                 for i, k in enumerate(KINDS[:4])],
                        F.expr(f"sha2({joined('filter(spans, s -> s.rank < 4)')}, 256) AS base_sha256"),
                        F.expr(f"{joined('spans')} AS spans"))
