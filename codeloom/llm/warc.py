"""WARC derivative builder: responses become linked metadata and plain-text conversion records.

Every derived record names the response it was made from (WARC-Refers-To, its target URI and date), keeps the source's
headers and payload digest, and has an identifier and a digest of its own, which depend on the source alone, so that a
task that runs again makes the same record. All of it is Spark expressions; only reading WARC files needs Python.
"""

from __future__ import annotations

import gzip
import html.entities
import io
import json
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import kept

#: Elements whose tags end a line of text.
BLOCK_TAGS = "address|article|aside|blockquote|br|dd|div|dl|dt|figcaption|figure|footer|form|h1|h2|h3|h4|h5|h6|header|hr|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul"
#: Elements that go with all that they hold.
UNSEEN = ("script", "style", "noscript", "template", "head")
#: Patterns, in order, with what takes their place; the same in the SQL that the query is compared with.
STRIP = (
    (r"(?i)<(?:!--[\s\S]*?--" + "".join(rf"|{e}(?:\s[^>]*)?>[\s\S]*?</{e}\s*" for e in UNSEEN) + ")>", ""),
    (rf"(?i)</?(?:{BLOCK_TAGS})(?:\s[^>]*)?/?>", "\n"),
    (r"</?[A-Za-z!?][^>]*>", ""),
)
#: Runs of white space in a line become a space, and lines that are empty or begin or end with a space lose that.
SPACES = ((r"[ \t\r\f\x0B]{2,}|[\t\r\f\x0B]", " "), (r" ?\n[ \n]*", "\n"))
TITLE = r"(?i)<title(?:\s[^>]*)?>([\s\S]*?)</title"
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"'<>]*)["']"""
LANG = r"""(?i)<html\s[^>]*?lang\s*=\s*["']([^"'<>]*)["']"""
#: What may follow an ampersand: a decimal, a hexadecimal or a named reference.
REFERENCE = r"^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{0,31});"
#: Every named reference that ends with a semicolon, by its name.
NAMED = {k[:-1]: v for k, v in html.entities.html5.items() if k.endswith(";")}


def resolved(text: Column) -> Column:
    """text with its character references as characters, each once: `&amp;lt;` is `&lt;`.

    Decimal, hexadecimal and all named references of HTML with their semicolon; what is none of these stays as it is.
    Numbers outside Unicode become U+FFFD. The text is evaluated once, as it may be long to make.
    """
    names = F.from_json(F.lit(json.dumps(NAMED)), "map<string,string>")

    def one(part: Column, i: Column) -> Column:
        name = F.regexp_extract(part, REFERENCE, 1)
        code = F.when(name.rlike("^#[xX]"), F.conv(F.substr(name, F.lit(3)), 16, 10).cast("long")).otherwise(F.substr(name, F.lit(2)).cast("long"))
        sound = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code <= 0x10FFFF))
        number = F.decode(F.unhex(F.lpad(F.hex(F.when(sound, code).otherwise(F.lit(0xFFFD))), 8, "0")), "UTF-32")
        after = F.substr(part, F.length(name) + 2)
        named = F.coalesce(F.concat(F.try_element_at(names, name), after), F.concat(F.lit("&"), part))
        made = F.when(part.startswith("amp;"), F.concat(F.lit("&"), F.substr(part, F.lit(5)))).when(name == "", F.concat(F.lit("&"), part))
        return F.when(i == 0, part).otherwise(made.when(name.startswith("#"), F.concat(number, after)).otherwise(named))

    return F.array_join(F.transform(F.split(text, "&"), one), "")


def plain_text(html: Column) -> Column:
    """The text of a page: without head, scripts, comments and tags, one line a block, references resolved, spaces folded."""
    t = F.coalesce(html, F.lit(""))
    for pattern, to in STRIP:
        t = F.regexp_replace(t, pattern, to)
    t = resolved(t)
    for pattern, to in SPACES:
        t = F.regexp_replace(t, pattern, to)
    return F.btrim(t, F.lit(" \n"))


def urn(*parts: Column) -> Column:
    """<urn:uuid:...> of a digest of the parts, where a null differs from an empty string."""
    h = F.md5(F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")) for p in parts]))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def responses_of_pages(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of pages (page_id, url, html): a null html is an empty payload, a null url stays null."""
    html = F.coalesce("html", F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html))
    return pages.select(
        "page_id", urn(F.lit("response"), F.col("page_id"), F.col("url"), F.col("html")).alias("record_id"), F.col("url").alias("target_uri"),
        F.lit(date).alias("date"), http.alias("source_headers"), F.col("html").alias("payload"),
    )


DERIVED = ["record_type", "record_id", "refers_to", "target_uri", "refers_to_date", "content_type", "content_length", "block_digest", "payload_digest", "source_headers", "block"]


def derive(responses: DataFrame, keep: list[str]) -> DataFrame:
    """Two records for each response (record_id, target_uri, date, source_headers, payload), after the columns in keep.

    Equal responses give equal records; a null payload is an empty page; null headers stay null. The text is made once
    a response. Other columns are ignored, and so is one of keep with the name of one that is made here.
    """
    keep = kept(keep, DERIVED)
    given = [F.col(c).alias(f"__{i}") for i, c in enumerate(keep)]
    payload = F.coalesce("payload", F.lit(""))
    source = responses.select(*given, F.col("record_id").alias("refers_to"), "target_uri", "date", "source_headers", payload.alias("payload"), digest(payload).alias("payload_digest"))
    payload = F.col("payload")
    title = F.trim(F.regexp_replace(resolved(F.regexp_extract(payload, TITLE, 1)), r"\s+", " "))
    links = F.regexp_extract_all(payload, F.lit(LINK), 1)
    fields = F.concat(
        F.lit("title: "), title, F.lit("\r\nlanguage: "), F.regexp_extract(payload, LANG, 1), F.lit("\r\nsource-payload-digest: "), F.col("payload_digest"),
        F.lit("\r\noutlink-count: "), F.size(links), resolved(F.array_join(F.transform(links, lambda x: F.concat(F.lit("\r\noutlink: "), x)), "")),
    )
    both = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), plain_text(payload).alias("block")),
    )
    made = source.select(*[f"__{i}" for i in range(len(keep))], "refers_to", "target_uri", "date", "source_headers", "payload_digest", F.explode(both).alias("r"))
    return made.select(
        *[F.col(f"__{i}").alias(c) for i, c in enumerate(keep)], F.col("r.record_type").alias("record_type"), urn(F.col("r.record_type"), F.col("refers_to")).alias("record_id"), "refers_to",
        "target_uri", F.col("date").alias("refers_to_date"), F.col("r.content_type").alias("content_type"),
        F.octet_length("r.block").cast("long").alias("content_length"), digest(F.col("r.block")).alias("block_digest"), "payload_digest",
        "source_headers", F.col("r.block").alias("block"),
    )


def serialised(records: DataFrame, keep: list[str]) -> DataFrame:
    """The columns in keep and warc: each derived record as the text of a WARC/1.1 record, source headers as a folded field."""

    def line(name: str, c: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), c, F.lit("\r\n")), F.lit(""))

    headers = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", F.col("record_id")), line("WARC-Date", F.col("refers_to_date")),
        line("WARC-Refers-To", F.col("refers_to")), line("WARC-Refers-To-Target-URI", F.col("target_uri")), line("WARC-Refers-To-Date", F.col("refers_to_date")),
        line("WARC-Target-URI", F.col("target_uri")), line("Content-Type", F.col("content_type")), line("Content-Length", F.col("content_length").cast("string")),
        line("WARC-Block-Digest", F.col("block_digest")), line("X-Source-Payload-Digest", F.col("payload_digest")),
        line("X-Source-Headers", F.regexp_replace("source_headers", "\r?\n", "\r\n ")),
    )
    return records.select(*keep, F.concat(headers, F.lit("\r\n"), F.col("block"), F.lit("\r\n\r\n")).alias("warc"))


def parse_records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an uncompressed WARC stream, read one record at a time.

    What stands between records is passed over, and so is the block of a record without a sound Content-Length: reading
    goes on at the next line that opens a record. A block cut short by the end of the stream is given as far as it goes.
    """
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        head: dict[str, str] = {}
        name = ""
        while (line := stream.readline()).strip():
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if text[0] in " \t" and name:
                head[name] += "\n" + text[1:]
            else:
                name, _, value = text.partition(":")
                name = name.strip().lower()
                head[name] = value.strip()
        size = head.get("content-length", "")
        yield head, stream.read(int(size)) if size.isascii() and size.isdigit() else b""


def unpacked_body(http: str, body: bytes) -> bytes:
    """A response's body without its chunks and its gzip or deflate coding; as it stands, where it isn't coded as the headers say."""
    fields = {k.strip().lower(): v.strip().lower() for k, _, v in (line.partition(":") for line in http.split("\r\n")[1:])}
    if fields.get("transfer-encoding", "").endswith("chunked"):
        parts, at = [], 0
        while (end := body.find(b"\r\n", at)) >= 0:
            try:
                size = int(body[at:end].split(b";")[0], 16)
            except ValueError:
                break
            if size <= 0:
                at = len(body)
                break
            parts.append(body[end + 2 : end + 2 + size])
            at = end + 4 + size
        if at >= len(body):
            body = b"".join(parts)
    kind = fields.get("content-encoding", "")
    for bits in {"gzip": (31,), "x-gzip": (31,), "deflate": (15, -15)}.get(kind, ()):
        try:
            return zlib.decompress(body, bits)
        except zlib.error:
            continue
    return body


def read_responses(spark: SparkSession, path: str, batch: int = 256) -> DataFrame:
    """Response records (record_id, target_uri, date, source_headers, payload) of WARC files, plain or gzipped.

    A file is read by one task, as a gzip stream can't be split, and is at most 2 GB as stored; its records are unpacked and
    handed on `batch` at a time. Payloads lose their chunks and codings and are decoded as UTF-8 with replacements. A file
    that breaks off gives the records before that place.
    """
    names = ["record_id", "target_uri", "date", "source_headers", "payload"]

    def responses(data: bytes) -> Iterator[tuple]:
        stream = io.BytesIO(data)
        try:
            for head, block in parse_records(gzip.GzipFile(fileobj=stream) if data[:2] == b"\x1f\x8b" else stream):
                if head.get("warc-type") == "response":
                    http, _, body = block.partition(b"\r\n\r\n")
                    http = http.decode("utf-8", "replace")
                    yield head.get("warc-record-id"), head.get("warc-target-uri"), head.get("warc-date"), http, unpacked_body(http, body).decode("utf-8", "replace")
        except (EOFError, OSError, zlib.error):
            return

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], names)

        for files in batches:
            for data in files.column(0):
                out = []
                for row in responses(data.as_py()):
                    out.append(row)
                    if len(out) == batch:
                        yield made(out)
                        out = []
                if out:
                    yield made(out)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(rows, ", ".join(f"{c} string" for c in names))


def _sql() -> str:
    """The query over pages in SQL for DuckDB."""

    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''").replace("\n", "'||chr(10)||'") + "'"

    def referred(t: str) -> str:
        code = "(CASE WHEN n[2] IN ('x', 'X') THEN ('0x' || n[3:])::bigint ELSE n[2:]::bigint END)"
        number = f"chr((CASE WHEN {code} BETWEEN 1 AND 55295 OR {code} BETWEEN 57344 AND 1114111 THEN {code} ELSE 65533 END)::int)"
        made = f"CASE WHEN n = '' THEN '&' || p WHEN n[1] = '#' THEN {number} || p[length(n) + 2:] ELSE coalesce(named[n] || p[length(n) + 2:], '&' || p) END"
        one = f"list_transform([regexp_extract(p, {quoted(REFERENCE)}, 1)], lambda n: {made})[1]"
        return f"array_to_string(list_transform(string_split({t}, '&'), lambda p, i: CASE WHEN i = 1 THEN p ELSE {one} END), '')"

    def replaced(t: str, patterns: tuple[tuple[str, str], ...]) -> str:
        for pattern, to in patterns:
            t = f"regexp_replace({t}, {quoted(pattern)}, {quoted(to)}, 'g')"
        return t

    def uuid(*parts: str) -> str:
        h = "md5(concat_ws('|', " + ", ".join(f"coalesce('=' || {p}::varchar, '-')" for p in parts) + "))"
        return "'<urn:uuid:' || " + " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'"

    nl = "chr(13)||chr(10)"
    text = f"trim({replaced(referred(replaced('payload', STRIP)), SPACES)}, ' ' || chr(10))"
    links = f"array_to_string(list_transform(links, lambda x: {nl} || 'outlink: ' || x), '')"
    return f"""
WITH names AS (SELECT map([{", ".join(map(quoted, NAMED))}], [{", ".join(map(quoted, NAMED.values()))}]) AS named),
p AS (SELECT page_id, url, coalesce(html, '') AS payload, {uuid("'response'", "page_id", "url", "html")} AS refers_to, named,
  'HTTP/1.1 200 OK'||{nl}||'Content-Type: text/html; charset=utf-8'||{nl}||'Content-Length: '||octet_length(encode(coalesce(html, '')))::varchar AS source_headers
  FROM pages, names),
l AS (SELECT *, 'sha256:' || sha256(payload) AS payload_digest, regexp_extract_all(payload, {quoted(LINK)}, 1) AS links FROM p),
r AS (
  SELECT * EXCLUDE (named), 'metadata' AS record_type, 'application/warc-fields' AS content_type,
    'title: ' || trim(regexp_replace({referred(f"regexp_extract(payload, {quoted(TITLE)}, 1)")}, '\\s+', ' ', 'g')) || {nl} || 'language: ' || regexp_extract(payload, {quoted(LANG)}, 1)
    || {nl} || 'source-payload-digest: ' || payload_digest || {nl} || 'outlink-count: ' || len(links)::varchar || coalesce({referred(f"coalesce({links}, '')")}, '') AS block FROM l
  UNION ALL SELECT * EXCLUDE (named), 'conversion', 'text/plain; charset=utf-8', {text} FROM l)
SELECT page_id, record_type, {uuid("record_type", "refers_to")} AS record_id, refers_to, url AS target_uri, '2024-01-01T00:00:00Z' AS refers_to_date, content_type,
  octet_length(encode(block))::bigint AS content_length, 'sha256:' || sha256(block) AS block_digest, payload_digest, source_headers, block FROM r"""


ORACLE_SQL = _sql()
