"""Quality rules: statistics of each text, and lines that too many documents of a host share.

Lines are normalised and hashed, distinct documents are counted per host and line, lines
above the limit are removed, and a document of which too little is left is rejected.
Everything is Spark expressions; only hashes and counts are shuffled, never texts.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagescan.functions.text import let
from pagescan.llm.common import SPACE, kept, small, word_count

#: A line is frequent above this many distinct documents of its host, whatever the size of the host.
LEAST_DOCUMENTS = 10
#: Rejected if less than this share of the words of its distinct lines is left.
LEFT = 0.5

_SPLIT = SPACE.replace("\\", "\\\\")
_BLANK = "[\\\\x20\\\\x09-\\\\x0D]"
_WORD_CHARS = "[^\\\\x20\\\\x09-\\\\x0D]++"


def _repeat_words(words: str) -> str:
    """Words inside three-word windows that occur twice or more, as SQL over an array of words.

    Windows are hashed and sorted with their places, so equal ones become neighbours.
    """
    def windows(v):
        return (f"sort_array(transform(sequence(0, size({v}.w) - 3), "
                f"i -> named_struct('h', xxhash64({v}.w[i], {v}.w[i + 1], {v}.w[i + 2]), 'i', i)))")

    def starts(s):
        return (f"array_sort(transform(filter({s}.s, (x, i) -> (i > 0 AND x.h = get({s}.s, i - 1).h) OR "
                f"(i < size({s}.s) - 1 AND x.h = get({s}.s, i + 1).h)), x -> x.i))")

    covered = ("aggregate({}, named_struct('last', -3, 'n', 0L), (a, x) -> named_struct("
               "'last', x, 'n', a.n + CAST(least(3, x - a.last) AS BIGINT)), a -> a.n)")
    return let(lambda v: f"IF(size({v}.w) < 3, 0L, "
                         + let(lambda s: covered.format(starts(s)), s=windows(v)) + ")", w=words)


def statistics(docs: DataFrame, keep=()) -> DataFrame:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed`` per row, with ``keep``."""
    t = "coalesce(CAST(text AS STRING), '')"
    words = f"filter(split({t}, '{_SPLIT}'), x -> x != '')"
    lines = f"filter(split({t}, '\\n'), x -> x rlike '{_WORD_CHARS}')"
    return docs.select(
        *keep, word_count(F.col("text")).alias("n_words"),
        F.expr(f"CAST(length(regexp_replace({t}, '{_BLANK}++', '')) AS BIGINT) AS word_chars"),
        F.expr(f"CAST(length(regexp_replace({t}, '[^#*$%&|<>]++', '')) AS BIGINT) AS n_symbols"),
        F.expr(let(lambda v: f"CAST(size({v}.l) - size(array_distinct({v}.l)) AS BIGINT)", l=lines)).alias("n_dup_lines"),
        F.expr(_repeat_words(words)).alias("n_repeat_words")
    ).withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))


def _normal(line: str) -> str:
    return f"xxhash64(lower(trim(regexp_replace({line}, '{_SPLIT}', ' '))))"


def _line_words(line: str) -> str:
    return f"length(regexp_replace(regexp_replace({line}, '{_WORD_CHARS}', 'x'), '{_BLANK}++', ''))"


#: Distinct normalised lines of a text, with their words.
_LINES = (f"array_distinct(transform(filter(split(coalesce(CAST(text AS STRING), ''), '\\n'), x -> x rlike '{_WORD_CHARS}'), "
          f"x -> named_struct('line', {_normal('x')}, 'n', {_line_words('x')})))")


def _keyed(docs: DataFrame, host: str) -> list:
    """Host (NULL as the empty name) and the text's hash: rows equal in both are one document."""
    return [F.coalesce(F.col(host).cast("string"), F.lit("")).alias("_host"),
            F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_text")]


def frequent_lines(docs: DataFrame, host: str = "source",
                   least: int = LEAST_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """(``_host, _text, line, n``: the lines of every document; ``_host, line``: the frequent ones).

    Equal texts of a host are one document, so copies do not make their own lines frequent.
    """
    lines = kept(docs.select(*_keyed(docs, host), F.inline(F.expr(_LINES))).distinct())
    counts = lines.groupBy("_host", "line").agg(F.count("*").alias("_in")).where(F.col("_in") > least)
    return lines, kept(counts.select("_host", "line"))


def _judged(docs: DataFrame, keep, host: str, least: int, left: float) -> DataFrame:
    """``_row`` (struct of the columns in ``keep``), the text, statistics, removed_words, kept and the
    hashes of the document's frequent lines."""
    lines, frequent = frequent_lines(docs, host, least)
    removed = kept(lines.join(small(frequent), ["_host", "line"]).groupBy("_host", "_text").agg(
        F.sum("n").cast("long").alias("removed_words"), F.collect_set("line").alias("_lines")))
    wrapped = docs.select(F.struct(*keep).alias("_row"), "text", *_keyed(docs, host))
    rows = statistics(wrapped, ["_row", "text", "_host", "_text", F.expr(
        f"aggregate({_LINES}, 0L, (a, x) -> a + CAST(x.n AS BIGINT)) AS _all")])
    return rows.join(small(removed, "1 + size(_lines)"), ["_host", "_text"], "left").withColumn(
        "removed_words", F.coalesce("removed_words", F.lit(0).cast("long"))).withColumn(
        "kept", ~F.col("base_failed") & (F.col("_all") - F.col("removed_words") >= left * F.col("_all")))


def judge(docs: DataFrame, host: str = "source", keep=("doc_id",), least: int = LEAST_DOCUMENTS,
          left: float = LEFT) -> DataFrame:
    """``keep``, the statistics, ``removed_words`` and ``kept``, a row for each row of ``docs``.

    removed_words counts the words of the document's distinct frequent lines; kept is false where
    the base rules fail or less than ``left`` of the words of its distinct lines would stay.  NULL
    and empty texts have no words and fail; a NULL host is the host of empty name; a blank line is
    no line.  Equal texts of a host share a verdict.  Other columns are not read.
    """
    return _judged(docs, keep, host, least, left).select(
        "_row.*", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "removed_words")


def clean(docs: DataFrame, host: str = "source", least: int = LEAST_DOCUMENTS,
          left: float = LEFT) -> DataFrame:
    """The rows that ``judge`` keeps, all columns, with frequent lines taken out of ``text``.

    ``n_chars``, where there is such a column, counts the new text; texts without a frequent line
    are as they were.
    """
    rest = F.expr(f"array_join(filter(split(text, '\\n'), x -> NOT (x rlike '{_WORD_CHARS}' AND "
                  f"array_contains(_lines, {_normal('x')}))), '\n')")
    text = F.when(F.col("_lines").isNull(), F.col("_row.text")).otherwise(rest)
    out = _judged(docs, docs.columns, host, least, left).where("kept").select(
        "_row", text.alias("_new"))
    return out.select(*[F.col("_new").alias("text") if c == "text"
                        else F.length("_new").cast("long").alias(c) if c == "n_chars"
                        else F.col("_row")[c].alias(c) for c in docs.columns])
