"""WARC derivatives: metadata and plain-text conversion records made from responses.

A response record yields one metadata record (what was found in the page) and one conversion
record (its plain text). Both refer to the response by WARC-Refers-To and keep its target URI,
date and source headers; digests of blocks and payloads are SHA-1 in base 32.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import re
import uuid
from collections.abc import Iterator
from functools import reduce
from typing import BinaryIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of blocks that a reading task gives out together.
BATCH_CHARS = 1 << 22
#: In the field of source headers, in the order of writing.
ESCAPES = (("\\", "\\\\"), ("\r", "\\r"), ("\n", "\\n"))
#: Header names that are read, and their columns.
FIELDS = {"warc-type": "record_type", "warc-record-id": "record_id", "warc-refers-to": "refers_to", "warc-target-uri": "target_uri", "warc-date": "record_date", "content-type": "content_type", "warc-payload-digest": "payload_digest", "warc-block-digest": "block_digest", "x-source-headers": "source_headers"}
#: Ends a record in a WARC file.
RECORD_END = "\r\n\r\n"
_OPEN = re.compile(r"<!--|<(script|style|noscript|template|svg)\b", re.I)
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "noscript", "template", "svg", "title")}
_TAG = re.compile(r"<([/!?]?)([A-Za-z][A-Za-z0-9]*)?[^>]*>")
#: Elements that begin or end a line of text, and cells of a row.
_BREAKS = frozenset("p div br hr li ul ol dl dt dd tr table thead tbody h1 h2 h3 h4 h5 h6 section article header footer main nav aside form fieldset pre blockquote figure figcaption address title body head html option select".split())
_CELLS = frozenset(("td", "th"))
_LANG = re.compile(r"""\blang\s*=\s*["']?([A-Za-z-]+)""", re.I)
_HREF = re.compile(r"""\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_SPACES = re.compile(r"[^\S\n]+")

RECORD = "record_type string, record_id string, refers_to string, target_uri string, record_date string, content_type string, payload_digest string, block_digest string, source_headers string, content_length long, block string"


def digest(data: bytes) -> str:
    """SHA-1 in base 32, labelled as WARC headers have it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def derived_id(*parts: str) -> str:
    """A record id that depends on the parts alone, so that reruns agree."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(parts))}>"


def shown_part(page: str) -> str:
    """The page without comments and hidden elements; one that is never closed hides the rest. Each
    step goes on behind what it found, so the time is linear in the page's length."""
    out, at = [], 0
    while (m := _OPEN.search(page, at)) is not None:
        out.append(page[at : m.start()])
        if m[1] is None:
            end = page.find("-->", m.end())
            at = end + 3
        else:
            end = page.find(">", m.end())
            if end < 0:  # not a tag, and no tag follows
                at = m.start()
                break
            closed = _CLOSE[m[1].lower()].search(page, end)
            end = at = closed.end() if closed else -1
        out.append(" ")
        if end < 0:
            return "".join(out)
    return "".join([*out, page[at:]])


def without_tags(text: str, line: str = "\n", cell: str = " ") -> str:
    """The text with tags of lines and cells turned to the given separators, and other tags gone."""

    def separator(m: re.Match) -> str:
        name = (m[2] or "").lower()
        if not name and not m[1]:
            return m[0]  # "<" before something that is no name
        return line if name in _BREAKS else cell if name in _CELLS else ""

    last = text.rfind(">") + 1  # behind it nothing is a tag, so that every search for an end succeeds
    return _TAG.sub(separator, text[:last]) + text[last:]


def plain_text(page: str) -> str:
    """Text of a page: hidden elements gone, block elements as line breaks, entities resolved."""
    lines = (_SPACES.sub(" ", line).strip() for line in html.unescape(without_tags(shown_part(page))).split("\n"))
    return "\n".join(line for line in lines if line)


def page_fields(page: str, text: str) -> list[tuple[str, str]]:
    """What the metadata record tells about a page."""
    title = lang = None
    links = []
    for m in _TAG.finditer(page, 0, page.rfind(">") + 1):
        name = (m[2] or "").lower()
        if m[1]:
            continue
        if name == "a" and (href := _HREF.search(m[0])):
            links.append(html.unescape(next(filter(None, href.groups()), "")))
        elif name == "html" and lang is None and (found := _LANG.search(m[0])):
            lang = found[1].lower()
        elif name == "title" and title is None:
            end = _CLOSE["title"].search(page, m.end())
            title = " ".join(html.unescape(without_tags(page[m.end() : end.start()], "", "")).split()) if end else ""
    fields = [("title", title or ""), ("declaredLanguage", lang or ""), ("textLength", str(len(text))), ("linkCount", str(len(links)))]
    return fields + [("outlink", " ".join(x.split())) for x in links if x.strip()]


def responses_from_pages(pages: DataFrame) -> DataFrame:
    """Response records of the given pages: (record_id, target_uri, record_date, source_headers, payload).

    The date is derived from the page's number; a null html is an empty payload, a null url an
    empty target URI.
    """
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("-"))
    seed = F.sha2(F.concat_ws("|", page, F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))), 256)
    urn = F.concat(F.lit("<urn:uuid:"), F.substring(seed, 1, 8), F.lit("-"), F.substring(seed, 9, 4), F.lit("-5"), F.substring(seed, 14, 3), F.lit("-a"), F.substring(seed, 18, 3), F.lit("-"), F.substring(seed, 21, 12), F.lit(">"))
    payload = F.coalesce("html", F.lit(""))
    date = F.date_format(F.timestamp_seconds(F.lit(1672531200) + F.pmod(F.coalesce(F.col("page_id"), F.lit(0)), F.lit(31536000))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n"))
    return pages.select("page_id", urn.alias("record_id"), F.coalesce("url", F.lit("")).alias("target_uri"), date.alias("record_date"), headers.alias("source_headers"), payload.alias("payload"))


def build_derivatives(responses: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Two records for each response: "metadata" and "conversion", in the columns of RECORD.

    responses: (record_id, target_uri, record_date, source_headers, payload), nulls as empty texts.
    payload_digest is the response's payload digest in both records, block_digest that of the
    record's own block. Record ids depend on the response alone. Repeated responses give repeated
    records (ties have no order); very long pages are converted whole, in linear time; an empty table
    gives an empty result; columns named in `keep` are carried, whatever their names, others ignored.
    """
    wanted = ["record_id", "target_uri", "record_date", "source_headers", "payload"]
    kept = "".join(f"_keep_{c} {responses.schema[c].dataType.simpleString()}, " for c in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            extra = [batch[f"_keep_{c}"].tolist() for c in keep]
            for i, (source, uri, date, headers, page) in enumerate(zip(*(batch[c].tolist() for c in wanted), strict=True)):
                text, payload = plain_text(page), digest(page.encode())
                fields = [("refersToPayloadDigest", payload), *page_fields(page, text)]
                for kind, mime, block in (("metadata", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in fields)), ("conversion", "text/plain", text)):
                    data = block.encode()
                    out.append((*(e[i] for e in extra), kind, derived_id(kind, source, payload), source, uri, date, mime, payload, digest(data), headers, len(data), block))
            yield pd.DataFrame(out, columns=[*(f"_keep_{c}" for c in keep), *(x.split()[0] for x in RECORD.split(", "))])

    plain = responses.select(*(F.col(c).alias(f"_keep_{c}") for c in keep), *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in wanted))
    return plain.mapInPandas(run, kept + RECORD).withColumnsRenamed({f"_keep_{c}": c for c in keep})


def record_text() -> Column:
    """A record as it stands in a WARC/1.1 file, up to the end of its block.

    Line ends and other control characters inside header values are percent-encoded (as URIs have
    them); the source's headers are one field, with escapes for backslash, CR and LF.
    """
    coded = lambda c: reduce(lambda x, code: F.replace(x, F.lit(chr(code)), F.lit(f"%{code:02X}")), (0, 9, 10, 13), F.col(c))
    line = lambda name, c: F.when(F.col(c) != "", F.concat(F.lit(f"{name}: "), coded(c), F.lit("\r\n"))).otherwise("")
    escaped = reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), ESCAPES, F.col("source_headers"))
    source = F.when(F.col("source_headers") != "", F.concat(F.lit("X-Source-Headers: "), escaped, F.lit("\r\n"))).otherwise("")
    return F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", "record_type"), line("WARC-Record-ID", "record_id"), line("WARC-Refers-To", "refers_to"), line("WARC-Target-URI", "target_uri"), line("WARC-Date", "record_date"),
        line("WARC-Payload-Digest", "payload_digest"), line("WARC-Block-Digest", "block_digest"), source, line("Content-Type", "content_type"), F.lit("Content-Length: "), F.col("content_length").cast("string"), F.lit("\r\n\r\n"), F.col("block"),
    )


def write_warc(records: DataFrame, path: str) -> None:
    """Write records as gzipped WARC/1.1 part files through Spark's text writer."""
    records.select(record_text().alias("value")).write.option("lineSep", RECORD_END).option("compression", "gzip").text(path)


def records_in(stream: BinaryIO) -> Iterator[dict[str, str | int]]:
    """The records of an open WARC file, one after the other."""
    while (first := stream.readline()):
        if not first.startswith(b"WARC/"):
            continue
        fields: dict[str, str | int] = dict.fromkeys(FIELDS.values(), "")
        length = 0
        while (row := stream.readline().rstrip(b"\r\n").decode("utf-8", "replace")):
            key, _, value = row.partition(":")
            if key.lower() == "content-length":
                length = int(value)
            elif key.lower() in FIELDS:
                fields[FIELDS[key.lower()]] = value.strip()
        fields["source_headers"] = re.sub(r"\\(.)", lambda m: {"r": "\r", "n": "\n"}.get(m[1], m[1]), str(fields["source_headers"]))
        yield fields | {"content_length": length, "block": stream.read(length).decode("utf-8", "replace")}


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files in the columns of RECORD. A file, as compressed, is one task's input; its
    records are read one by one and given out in batches of about BATCH_CHARS."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [x.split()[0] for x in RECORD.split(", ")]
        for batch in batches:
            for data in batch["content"].tolist():
                raw = io.BytesIO(data)
                out, size = [], 0
                for record in records_in(gzip.GzipFile(fileobj=raw) if data[:2] == b"\x1f\x8b" else raw):
                    out.append(record)
                    size += len(record["block"])
                    if size > BATCH_CHARS:
                        yield pd.DataFrame(out, columns=columns)
                        out, size = [], 0
                yield pd.DataFrame(out, columns=columns)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInPandas(run, RECORD)
