"""WARC derivatives: each response gives a metadata record and a plain-text conversion record that refer to it.

``responses`` has one row a response: ``key``, ``record_id``, ``date``, ``target_uri``, ``http_headers`` (the source's header
block, lines ended by CRLF) and ``payload``.  ``read_responses`` takes them from WARC files; ``responses_of_pages`` makes them
of a table of pages, with ids derived from what a row holds, so the same row gives the same ids wherever it is converted.
Both derivatives carry WARC-Refers-To, WARC-Refers-To-Target-URI, the source's date and their own block digest; the metadata
record keeps the source's headers, payload digest and length.  ``response_records`` are the records referred to.

The text of a page is read in one pass (``read_html``): time is linear in the page's length, whatever is left unclosed.

Null payloads convert as empty ones; null URIs leave the URI out of header and metadata.  Ids differ wherever key, URI, date
or payload do; rows that repeat all of them are the same capture and give the same records again.  Extra columns of a table
are ignored, an empty table gives an empty result, and long pages travel in batches of bounded bytes.
"""

from __future__ import annotations

import gzip
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices

DATE = "1970-01-01T00:00:00Z"  # the date of the crawl is not in the table; a parameter of every function
HEADERS = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"

# Fixed values of HTML: elements whose content is no text, and elements that stand on lines of their own.
UNREAD = ("script", "style", "noscript", "template")
BLOCKS = (
    "p", "div", "br", "hr", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "table", "tr", "nav", "article", "section",
    "header", "footer", "blockquote", "pre", "title", "body", "html",
)
TAG = re.compile(r"<(?:(!--)|(/?)([A-Za-z][A-Za-z0-9:-]*)|[!?])")
TAG_END = re.compile(r"""(?:[^"'>]|"[^"]*"|'[^']*')*+>""")
CLOSER = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in (*UNREAD, "head", "title")}
LANG = re.compile(r"""\slang\s*=\s*["']?([A-Za-z-]+)""", re.IGNORECASE)
LONG_NUMBER = re.compile(r"&#(?:[0-9]{9,}|[xX][0-9a-fA-F]{9,});?")


def unescaped(text: str) -> str:
    """Entities as characters; a no-break space as a space, a number of no character as the replacement character."""
    return html.unescape(LONG_NUMBER.sub("�", text.replace("&nbsp;", " "))) if "&" in text else text


#: White space to be made one space (a single space is left as it is), and line ends to be made one.
WIDE, LINES = re.compile(r"[\t\r\f][ \t\r\f]*| [ \t\r\f]+"), re.compile(r" \n[ \n]*|\n[ \n]+")


def tidy(text: str) -> str:
    return LINES.sub("\n", WIDE.sub(" ", text)).strip(" \n")


def read_html(page: str) -> tuple[str, str, str]:
    """Title, language and text of a page, in one pass.

    What is open at the end runs to the end, as browsers have it: a comment, a script.  A quote that is not closed opens
    nothing, and from there on tags end at the next ``>``.  A head without an end is no head.
    """
    out, title, lang = [], None, ""
    at, quotes, heads, head_end = 0, True, True, 0
    while m := TAG.search(page, at):
        start = m.start()
        if at < start and start > head_end:
            out.append(page[max(at, head_end) : start])
        if m[1]:
            end = page.find("-->", start + 2)
            at = end + 3 if end >= 0 else len(page)
            out.append(" ")
            continue
        ended = TAG_END.match(page, m.end()) if quotes else None
        if ended:
            at = ended.end()
        else:
            quotes = False
            at = page.find(">", m.end()) + 1
            if not at:  # no tag ends any more
                at = start
                break
        name = (m[3] or "").lower()
        if start >= head_end and name in BLOCKS:
            out.append("\n")
        if m[2] or not name:
            continue
        if name in UNREAD:
            found = CLOSER[name].search(page, at)
            at = found.start() if found else len(page)
            out.append(" ")
        elif name == "head" and heads and start >= head_end:
            found = CLOSER[name].search(page, at)
            heads, head_end = bool(found), found.start() if found else head_end
        elif name == "html" and not lang and (found := LANG.search(page[m.end() : at])):
            lang = found[1]
        elif name == "title" and title is None:
            found = CLOSER[name].search(page, at)
            title = page[at : found.start()] if found else ""
    if at < len(page):
        out.append(page[max(at, head_end) :])
    return re.sub(r"\s+", " ", unescaped(title or "")).strip(), lang, tidy(unescaped("".join(out)))


def urn(*parts: Column) -> Column:
    """A record id from what the record is about."""
    h = F.sha2(F.concat_ws("|", *parts), 256)
    return F.concat(F.lit("<urn:uuid:"), *(x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.lit("-" if a > 1 else ""), F.substring(h, a, n))), F.lit(">"))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def responses_of_pages(pages: DataFrame, headers: str = HEADERS, date: str = DATE) -> DataFrame:
    """The table ``pages`` as responses."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    own = urn(F.lit("response"), text("page_id"), text("url"), F.lit(date), digest(text("html")))
    uri = F.translate(F.col("url").cast("string"), "\r\n", "")  # no line of a header can end within a value
    return pages.select(F.col("page_id").alias("key"), own.alias("record_id"), F.lit(date).alias("date"), uri.alias("target_uri"), F.lit(headers).alias("http_headers"), F.col("html").cast("string").alias("payload"))


def line(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(name + ": "), value, F.lit("\r\n")), F.lit(""))


def pages_read(source: DataFrame) -> DataFrame:
    """``source`` with ``title``, ``lang`` and ``plain`` in place of ``payload``, its last column."""
    last, kept = len(source.columns) - 1, source.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, last, 2 << 20):
            done = [read_html(t) for t in part.column(last).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(c, pa.string()) for c in zip(*done, strict=True))], names=[*kept, "title", "lang", "plain"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{schema}, title string, lang string, plain string")


RECORD = ("key", "record_type", "record_id", "refers_to", "target_uri", "content_type", "content_length", "block_digest", "header", "content")


def with_header(rows: DataFrame) -> DataFrame:
    """Records with their length, digest and header block."""
    rows = rows.withColumns({"block_digest": digest(F.col("content")), "content_length": F.octet_length("content").cast("long")})
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Date", F.col("date")),
        line("WARC-Refers-To", F.col("refers_to")),
        line("WARC-Refers-To-Target-URI", F.when(F.col("refers_to").isNotNull(), F.col("target_uri"))),
        line("WARC-Target-URI", F.col("target_uri")),
        line("WARC-Block-Digest", F.col("block_digest")),
        line("Content-Type", F.col("content_type")),
        line("Content-Length", F.col("content_length").cast("string")),
    )
    return rows.withColumn("header", header).select(*RECORD)


def response_records(responses: DataFrame) -> DataFrame:
    """The responses themselves as records, of the columns that ``derivatives`` gives; they refer to nothing."""
    content = F.concat(F.coalesce("http_headers", F.lit("")), F.lit("\r\n"), F.coalesce("payload", F.lit("")))
    rows = responses.select("key", F.lit("response").alias("record_type"), "record_id", F.lit(None).cast("string").alias("refers_to"), "date", "target_uri", F.lit("application/http; msgtype=response").alias("content_type"), content.alias("content"))
    return with_header(rows)


def derivatives(responses: DataFrame) -> DataFrame:
    """``key, record_type, record_id, refers_to, target_uri, content_type, content_length, block_digest, header, content``."""
    payload = F.coalesce(F.col("payload"), F.lit(""))
    source = responses.select("key", F.col("record_id").alias("refers_to"), "date", "target_uri", "http_headers", digest(payload).alias("payload_digest"), F.octet_length(payload).alias("payload_length"), payload.alias("payload"))
    about = F.concat(
        line("source-record", F.col("refers_to")),
        line("source-uri", F.col("target_uri")),
        line("source-payload-digest", F.col("payload_digest")),
        line("source-payload-length", F.col("payload_length").cast("string")),
        line("title", F.nullif(F.col("title"), F.lit(""))),
        line("language", F.nullif(F.col("lang"), F.lit(""))),
        F.coalesce(F.regexp_replace("http_headers", F.lit("(?m)^([^\r\n]+)"), F.lit("source-header: $1")), F.lit("")),
    )
    both = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), about.alias("content")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("plain").alias("content")),
    )
    rows = pages_read(source).select("key", "date", "target_uri", "refers_to", F.inline(both))
    return with_header(rows.withColumn("record_id", urn(F.col("record_type"), F.col("refers_to"))))


def serialised(records: DataFrame) -> DataFrame:
    """``key`` and ``record``: header block, empty line, content, two line ends, ready to be joined into a WARC file."""
    return records.select("key", "record_type", F.encode(F.concat("header", F.lit("\r\n"), "content", F.lit("\r\n\r\n")), "utf-8").alias("record"))


def parse(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """Headers and content of the records in an uncompressed WARC file's bytes."""
    records, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = dict(re.split(r":\s*", x, maxsplit=1) for x in lines)
        start = end + 4
        at = start + int(headers["Content-Length"])
        records.append((headers, data[start:at]))
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"the record before byte {at} has another length")
        at += 4
    return records


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """The response records of WARC files (plain or gzip), as ``responses``; a file is read whole by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                data = data.as_py()
                rows = []
                for headers, content in parse(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                    if headers.get("WARC-Type") == "response":
                        block, _, payload = content.partition(b"\r\n\r\n")
                        found = re.search(rb"(?i)charset=[\"']?([A-Za-z0-9_-]+)", block)
                        try:
                            text = payload.decode(found[1].decode() if found else "utf-8", "replace")
                        except LookupError:
                            text = payload.decode("utf-8", "replace")
                        rows.append((headers["WARC-Record-ID"], headers["WARC-Record-ID"], headers.get("WARC-Date"), headers.get("WARC-Target-URI"), block.decode("utf-8", "replace") + "\r\n", text))
                names = ["key", "record_id", "date", "target_uri", "http_headers", "payload"]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(len(names))], names=names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "key string, record_id string, date string, target_uri string, http_headers string, payload string")


#: The SQL form of ``read_html`` for pages whose tags are all closed: (pattern, replacement) in the order of their use.
TO_TEXT = (
    *((rf"(?is)<{name}[^>]*>.*?</{name}>", " ") for name in UNREAD),
    (r"(?s)<!--.*?-->", " "),
    (r"(?is)<head[^>]*>.*?</head>", " "),
    (rf"(?i)</?({'|'.join(BLOCKS)})(\s[^>]*)?/?>", "\n"),
    (r"<[A-Za-z/!?][^>]*>", ""),
    (r"[ \t\r\f]+", " "),
    (r" ?\n[ \n]*", "\n"),
    (r"^[ \n]+|[ \n]+$", ""),
)
#: Entities that the SQL form knows.
ENTITIES = ((r"&nbsp;", " "), (r"&lt;?", "<"), (r"&gt;?", ">"), (r"&quot;?", '"'), (r"&#39;?|&apos;", "'"), (r"&copy;?", "©"), (r"&middot;?", "·"), (r"&amp;?", "&"))


def derivatives_sql(date: str = DATE, headers: str = HEADERS) -> str:
    """DuckDB SQL for the derivatives of the table ``pages``."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    lit = lambda s: q(s).replace("\r\n", "' || chr(13) || chr(10) || '")
    end = "chr(13) || chr(10)"
    ln = lambda name, value: f"coalesce({q(name + ': ')} || {value} || {end}, '')"
    uid = lambda e: f"'<urn:uuid:' || substr({e}, 1, 8) || '-' || substr({e}, 9, 4) || '-' || substr({e}, 13, 4) || '-' || substr({e}, 17, 4) || '-' || substr({e}, 21, 12) || '>'"

    def replaced(text: str, rules) -> str:
        for pattern, new in rules:
            text = f"regexp_replace({text}, {q(pattern)}, {'chr(10)' if new == chr(10) else q(new)}, 'g')"
        return text

    text = replaced(replaced(replaced("payload", TO_TEXT[:-3]), ENTITIES), TO_TEXT[-3:])
    title = replaced("regexp_extract(payload, '(?is)<title[^>]*>(.*?)</title>', 1)", ENTITIES)
    title = f"nullif(trim(regexp_replace({title}, '\\s+', ' ', 'g'), ' '), '')"
    lang = f"nullif(regexp_extract(payload, {q('(?i)<html[^>]*' + LANG.pattern)}, 1), '')"
    kept = "".join(f"source-header: {x}\r\n" for x in headers.split("\r\n") if x)
    about = " || ".join([
        ln("source-record", "refers_to"), ln("source-uri", "target_uri"), ln("source-payload-digest", "payload_digest"),
        ln("source-payload-length", "CAST(strlen(payload) AS VARCHAR)"), ln("title", title), ln("language", lang), lit(kept),
    ])
    header = " || ".join([
        lit("WARC/1.1\r\n"), ln("WARC-Type", "record_type"), ln("WARC-Record-ID", "record_id"), ln("WARC-Date", q(date)), ln("WARC-Refers-To", "refers_to"),
        ln("WARC-Refers-To-Target-URI", "target_uri"), ln("WARC-Target-URI", "target_uri"), ln("WARC-Block-Digest", "block_digest"),
        ln("Content-Type", "content_type"), ln("Content-Length", "CAST(content_length AS VARCHAR)"),
    ])
    return f"""
        WITH p AS (SELECT page_id, url, translate(url, chr(13) || chr(10), '') AS target_uri, coalesce(html, '') AS payload, 'sha256:' || sha256(coalesce(html, '')) AS payload_digest FROM pages),
        r AS (SELECT *, sha256('response|' || coalesce(CAST(page_id AS VARCHAR), '') || '|' || coalesce(url, '') || '|{date}|' || payload_digest) AS h FROM p),
        s AS (SELECT *, {uid('h')} AS refers_to FROM r),
        d AS (
            SELECT page_id, target_uri, refers_to, 'metadata' AS record_type, 'application/warc-fields' AS content_type, {about} AS content FROM s
            UNION ALL
            SELECT page_id, target_uri, refers_to, 'conversion', 'text/plain; charset=utf-8', {text} FROM s),
        e AS (SELECT *, sha256(record_type || '|' || refers_to) AS g FROM d),
        f AS (SELECT *, {uid('g')} AS record_id, CAST(strlen(content) AS BIGINT) AS content_length, 'sha256:' || sha256(content) AS block_digest FROM e)
        SELECT page_id, record_type, record_id, refers_to, target_uri, content_type, content_length, block_digest, {header} AS header, content FROM f"""
