"""WARC derivatives: a metadata record and a plain-text conversion record for each response record.

Records are strings: header lines, an empty line, the block.  Derivatives are Spark expressions; one pass, no
shuffle.  Files are read by the lengths that records state.
"""

import re
from collections.abc import Callable
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements whose ends break a line of text.
BREAKS = ("p|div|br|li|ul|ol|tr|td|th|table|h[1-6]|title|section|article|header|footer|nav|aside|main|"
          "blockquote|pre|hr|dl|dt|dd|form|option")
#: A character reference: decimal, hexadecimal, or a name with its semicolon.
REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
#: Numbers that pages from one old code page use for its characters.
OLD_NUMBERS = {n: bytes([n]).decode("cp1252") for n in range(128, 160) if n not in (129, 141, 143, 144, 157)}
END = "\r\n"


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


#: Names that pages use most, in any order; the others are looked up in one long text.
COMMON = ("nbsp lt gt quot apos copy reg trade middot bull hellip mdash ndash laquo raquo lsquo rsquo sbquo ldquo rdquo bdquo euro pound "
          "sect deg times eacute egrave agrave aacute iacute oacute uacute ntilde ccedil auml ouml uuml Auml Ouml Uuml szlig iexcl iquest").split()


def _referred() -> Callable[[Column], Column]:
    """What a name or number between ``&`` and ``;`` stands for; NULL for anything else."""
    # A map built in an expression is built for every value; a text is not.
    names = F.lit("\0" + "".join(f"{name[:-1]}\1{text}\0" for name, text in sorted(html5.items()) if name.endswith(";")))
    old = F.lit("".join(OLD_NUMBERS.get(n, chr(n)) for n in range(128, 160)))

    def of_number(n):
        return (F.when((n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), F.lit("\ufffd"))
                .when(n.between(128, 159), F.substr(old, n - F.lit(127), F.lit(1)))
                .otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")))

    def of_name(e):
        def cut(at):
            return F.when(at > 0, F.substring_index(F.substr(names, at + F.length(e) + F.lit(2), F.lit(4)), "\0", 1))
        return F.when(e.rlike("^[A-Za-z][A-Za-z0-9]+$"), _bound(F.position(F.concat(F.lit("\0"), e, F.lit("\1")), names), cut))

    def of(e):
        number = F.when(e.rlike("^#[0-9]{1,7}$"), F.substr(e, F.lit(2))).when(
            e.rlike("^#[xX][0-9A-Fa-f]{1,6}$"), F.conv(F.substr(e, F.lit(3)), 16, 10)).cast("int")
        known = F.when(e == "amp", F.lit("&"))
        for name in COMMON:
            known = known.when(e == name, F.lit(html5[f"{name};"]))
        return known.when(F.startswith(e, F.lit("#")), _bound(number, of_number)).otherwise(of_name(e))

    return of


def resolved(text: Column) -> Column:
    """A text with its character references resolved, each once.

    It is cut at each ``&``; what stands between that and a semicolon close behind is looked up.
    """
    of = _referred()

    def piece(p, i):
        def told(v):
            return _bound(F.when(F.contains(v["near"], F.lit(";")), of(v["e"])), lambda t: F.when(
                t.isNotNull(), F.concat(t, F.substr(p, F.length(v["e"]) + F.lit(2)))).otherwise(F.concat(F.lit("&"), p)))
        near = F.substr(p, F.lit(1), F.lit(33))
        return F.when(i == 0, p).otherwise(_bound(F.struct(near.alias("near"), F.substring_index(near, ";", 1).alias("e")), told))

    def cut(t):
        return F.when(F.contains(t, F.lit("&")), F.array_join(F.transform(F.split(t, "&", -1), piece), "")).otherwise(t)

    return _bound(text, cut)


def html_text(html) -> Column:
    """The text of a page: comments, scripts, styles and tags out, block ends as line ends, character references resolved.

    What is left open (a comment, a script, a tag) goes on to the end, so each pattern looks at a page once.  Blanks and line
    ends that are one already are not touched.
    """
    text = F.regexp_replace(html, r"(?s)<!--.*?(?:-->|\z)", "")
    # One beginning for both, so that other characters are passed by at once.
    text = F.regexp_replace(text, "(?is)<(?:" + "|".join(
        rf"{name}\b[^>]*+(?:>.*?(?:</{name}\s*+>|\z)|\z)" for name in ("script", "style")) + ")", "")
    text = F.regexp_replace(text, rf"(?i)</?(?:{BREAKS})\b[^>]*+(?:>|\z)", "\n")
    text = F.regexp_replace(text, r"<[/!?A-Za-z][^>]*+(?:>|\z)", "")
    return _joined(resolved(text))


def _joined(text: Column) -> Column:
    """A text whose runs of blanks are one blank, and runs with a line end one line end, none at either end."""
    text = _bound(text, lambda t: F.when(t.rlike(r"[\t\r\f\x0B]"), F.translate(t, "\t\r\f\x0b", "    ")).otherwise(t))
    text = F.regexp_replace(text, "  ++", " ")
    text = F.replace(F.replace(text, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n"))
    return F.btrim(F.regexp_replace(text, "\n\n++", "\n"), F.lit(" \n"))


def digest(block) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def urn(*parts) -> Column:
    """A record id that depends on the parts only, so reruns give the same ids."""
    h = F.sha2(F.concat_ws(" ", *parts), 256)
    cut = [F.substring(h, start, n) for start, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def header(head, name: str) -> Column:
    """The value of a header line, names in any case; NULL if it is not there."""
    value = F.regexp_extract(F.concat(F.lit("\n"), head), rf"(?i)\n{name}:[ \t]*+([^\r\n]*+)", 1)
    return F.when(value != "", F.rtrim(value))


def page_responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """``page_id, warc``: pages as response records.  NULL urls and bodies count as empty."""
    url, body = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    block = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=UTF-8{END}Content-Length: "),
                     F.octet_length(body), F.lit(END + END), body)
    head = [("WARC-Type", F.lit("response")), ("WARC-Record-ID", urn(F.lit("response"), F.col("page_id").cast("string"), url)),
            ("WARC-Date", F.lit(date)), ("WARC-Target-URI", url), ("WARC-Payload-Digest", digest(body)),
            ("WARC-Block-Digest", digest(block)), ("Content-Type", F.lit("application/http; msgtype=response")),
            ("Content-Length", F.octet_length(block).cast("string"))]
    return pages.select("page_id", _record(head, block).alias("warc"))


def _record(head, block) -> Column:
    """A record; header lines without a value are left out."""
    lines = [F.when(F.col(v).isNotNull() if isinstance(v, str) else v.isNotNull(), F.concat(F.lit(f"{k}: "), v, F.lit(END)))
             for k, v in head]
    return F.concat(F.lit(f"WARC/1.1{END}"), F.concat_ws("", *lines), F.lit(END), block, F.lit(END + END))


def _parts(records: DataFrame, keep=()) -> DataFrame:
    """``keep, head, block``; the block is as many bytes as the header says, or all up to the record's end."""
    cut = "locate('\\r\\n\\r\\n', warc)"
    parts = records.where(f"{cut} > 0").select(*keep, F.expr(f"left(warc, {cut} - 1) AS head"),
                                               F.expr(f"substring(warc, {cut} + 4) AS rest"))
    return parts.withColumn("bytes", header(F.col("head"), "Content-Length").try_cast("int")).withColumn("block", F.expr(
        "IF(bytes >= 0, CAST(substring(CAST(rest AS BINARY), 1, bytes) AS STRING), regexp_replace(rest, '(?:\\r\\n)++$', ''))"))


def derive(records: DataFrame, keep=()) -> DataFrame:
    """``keep, record_type, record_id, refers_to, concurrent_to, target_uri, content_type, content_length,
    block_digest, source_digest, warc``: the derivatives of ``records(warc)``.

    Each response gives a metadata record, and a conversion record where its payload is HTML or plain text.  Both
    refer to the response by WARC-Refers-To and repeat its target and date; the metadata record
    names the conversion in WARC-Concurrent-To.  The metadata block holds the status line, the payload's and the
    block's digest (of the response as it states them, else computed) and every HTTP header
    of the source.  Records of other types, NULLs and records without an id give nothing; a
    response without an HTTP head is all payload.  Equal records give equal derivatives.
    """
    # Kept columns travel as one, so that their names meet no other.
    parts = _parts(records.select(F.struct(F.lit(0).alias("_"), *keep).alias("_keep"), "warc"), ["_keep"])
    end = "locate('\\r\\n\\r\\n', block)"
    http = f"startswith(block, 'HTTP/') AND {end} > 0"
    source = parts.where(F.lower(header(F.col("head"), "WARC-Type")) == "response").select(
        "_keep", header(F.col("head"), "WARC-Record-ID").alias("id"), header(F.col("head"), "WARC-Target-URI").alias("uri"),
        header(F.col("head"), "WARC-Date").alias("date"), header(F.col("head"), "WARC-Payload-Digest").alias("stated"),
        header(F.col("head"), "WARC-Block-Digest").alias("block_stated"), "block",
        F.expr(f"IF({http}, left(block, {end} - 1), '') AS http"), F.expr(f"IF({http}, substring(block, {end} + 4), block) AS payload"),
    ).where("id IS NOT NULL")
    kind = F.lower(F.coalesce(header(F.col("http"), "Content-Type"), F.lit("text/html")))
    text = F.when(F.startswith(kind, F.lit("text/html")) | F.startswith(kind, F.lit("application/xhtml")), html_text(F.col("payload"))) \
        .when(F.startswith(kind, F.lit("text/plain")), F.col("payload"))
    # A step of its own, since the text is asked for twice and must be made once.
    source = source.withColumn("text", text).select(
        "_keep", "id", "uri", "date", F.coalesce("stated", digest(F.col("payload"))).alias("digest"),
        F.coalesce("block_stated", digest(F.col("block"))).alias("block_of"), "http", "text",
        urn(F.lit("metadata"), F.col("id")).alias("metadata_id"),
        F.when(F.col("text").isNotNull(), urn(F.lit("conversion"), F.col("id"))).alias("conversion_id"))
    status = F.when(F.col("http") != "", F.concat(F.lit("source-status: "), F.substring_index("http", END, 1), F.lit(END)))
    headers = F.array_join(F.transform(F.filter(F.slice(F.split("http", END), 2, 1_000_000_000), lambda x: x != ""),
                                       lambda x: F.concat(F.lit("source-header: "), x, F.lit(END))), "")
    fields = F.concat_ws("", status, F.lit("source-payload-digest: "), F.col("digest"), F.lit(END + "source-block-digest: "),
                         F.col("block_of"), F.lit(END), headers)
    both = source.select("_keep", "id", "uri", "date", "digest", F.inline(F.filter(F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.col("metadata_id").alias("record_id"),
                 F.col("conversion_id").alias("concurrent_to"), F.lit("application/warc-fields").alias("content_type"),
                 fields.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.col("conversion_id").alias("record_id"),
                 F.lit(None).cast("string").alias("concurrent_to"), F.lit("text/plain; charset=UTF-8").alias("content_type"),
                 F.col("text").alias("block"))), lambda r: r["block"].isNotNull())))
    head = [("WARC-Type", F.col("record_type")), ("WARC-Record-ID", F.col("record_id")), ("WARC-Refers-To", F.col("id")),
            ("WARC-Concurrent-To", F.col("concurrent_to")), ("WARC-Date", F.col("date")), ("WARC-Target-URI", F.col("uri")),
            ("WARC-Block-Digest", digest(F.col("block"))), ("Content-Type", F.col("content_type")),
            ("Content-Length", F.octet_length("block").cast("string"))]
    return both.select(*[F.col("_keep")[c].alias(c) for c in keep], "record_type", "record_id", F.col("id").alias("refers_to"), "concurrent_to",
                       F.col("uri").alias("target_uri"), "content_type", F.octet_length("block").cast("long").alias("content_length"),
                       digest(F.col("block")).alias("block_digest"), F.col("digest").alias("source_digest"),
                       _record(head, F.col("block")).alias("warc"))


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """WARC files, one for each task: the records of ``warc`` one after the other."""
    # The writer ends each value with a line end, which is the record's last.
    records.select(F.expr("substring(warc, 1, length(warc) - 2) AS warc")).write.option("lineSep", END).option(
        "compression", compression).text(path)


_LENGTH = re.compile(rb"(?im)^content-length:[ \t]*([0-9]+)[ \t]*\r?$")
_SEPARATOR = b"\r\n\r\nWARC/1."


def _whole(batches):
    """Records from the pieces of files, put together until they have the length they state."""
    at, parts, missing = None, [], 0

    def record():
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        stated = _LENGTH.search(head)
        block = rest[:int(stated[1])] if stated else rest.rstrip(b"\r\n")
        return head + b"\r\n\r\n" + block + b"\r\n\r\n"

    for batch in batches:
        out = []
        for file, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if parts and file == at and missing > 0:
                parts += [_SEPARATOR, piece]
                missing -= len(_SEPARATOR) + len(piece)
                continue
            if parts:
                out.append(record())
            at, parts, missing = file, [], 0
            if piece.startswith(b"WARC/1."):  # only the first piece of a file has its own beginning
                piece = piece[len(b"WARC/1."):]
            if piece:
                parts = [b"WARC/1.", piece]
                cut = piece.find(b"\r\n\r\n")
                stated = _LENGTH.search(piece[:cut]) if cut >= 0 else None
                missing = int(stated[1]) - (len(piece) - cut - 4) if stated else 0
        if out:
            yield pa.record_batch([pa.array(out, pa.binary())], names=["warc"])
    if parts:
        yield pa.record_batch([pa.array([record()], pa.binary())], names=["warc"])


def read_warc(spark, path: str) -> DataFrame:
    """``warc``: the records of WARC files, plain or compressed, by their Content-Length.

    Files are cut where a record may end; a block that holds such a place is put together again, so each file is read in its
    order by one task, as a stream.  Blocks are kept byte by byte, whether or not they are text; a record without a
    length goes to the next one.  Empty files give no rows.
    """
    rows = spark.read.option("lineSep", _SEPARATOR.decode()).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("no"), F.col("value").cast("binary").alias("piece"))
    in_order = rows.repartition("file").sortWithinPartitions("file", "start", "no").select("file", "piece")
    return in_order.mapInArrow(_whole, "warc BINARY").select(F.col("warc").cast("string").alias("warc"))
