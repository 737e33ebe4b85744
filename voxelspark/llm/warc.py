"""WARC derivatives: a metadata and a plain-text conversion record for every response, linked to it.

Narrow work without a shuffle: each response gives its two records in place, whatever the size of a host. The text is taken
from the HTML in Arrow batches, as a chain of patterns over whole pages costs the JVM several times as much.

Nulls: a null payload is an empty one, null headers and URI are left out of the record. Repeated responses give repeated
records. Whole pages are read, however long; a script, style, head or comment that is never closed ends with its page, and a
"<" without a ">" before the next "<" is text. An empty table gives none. Other columns are not read.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is cut from HTML with its content, what is put behind a page to close what it leaves open, the tags that
#: end a line, and the entities that are resolved. A tag holds no "<" and all is closed, so no pattern reads a page again and again.
CUT = re.compile(r"<(?:script[^<>]*>.*?</script>|style[^<>]*>.*?</style>|head[^<>]*>.*?</head>|!--.*?-->)", re.A | re.I | re.S)
CLOSERS = "<!----></script></style></head>"
BREAKS = re.compile(r"</?(?:p|br|div|h[1-6]|li|ul|ol|tr|td|th|table|article|nav|section|body|html)(?:[\s/][^<>]*)?>", re.A | re.I)
TAGS = re.compile(r"<[^<>]*>")
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}
BLANKS, LINES = re.compile(r"[ \t\r\f]+"), re.compile(r" ?\n[ \n]*")


def _text_of(html: str) -> str:
    out = TAGS.sub("", BREAKS.sub("\n", CUT.sub("", html + CLOSERS)))
    for entity, char in ENTITIES.items():
        out = out.replace(entity, char)
    return LINES.sub("\n", BLANKS.sub(" ", out)).strip(" \n")


def plain_text(html: Column) -> Column:
    """The text of a page: no scripts, styles, head, comments or tags; block tags end lines; no blank lines."""

    def texts(pages: pd.Series) -> pd.Series:
        return pages.map(_text_of)

    return F.pandas_udf(texts, "string")(html)


def urn(kind: Column, *parts: Column) -> Column:
    """A record id made of its source, the same in every run."""
    h = F.md5(F.concat_ws("|", kind, *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.encode(block, "UTF-8"), 256))


def responses_of_pages(pages: DataFrame) -> DataFrame:
    """record_id, target_uri, warc_date, http_headers, payload_digest, payload: response records of pages (page_id, url, html)."""
    html = F.coalesce("html", F.lit(""))
    date = F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + F.coalesce("page_id", F.lit(0)) * 61), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html))
    return pages.select("page_id", urn(F.lit("response"), F.col("page_id"), F.col("url")).alias("record_id"), F.col("url").alias("target_uri"), date.alias("warc_date"), headers.alias("http_headers"), digest(html).alias("payload_digest"), html.alias("payload"))


def derive(responses: DataFrame, *, id_col: str = "page_id") -> DataFrame:
    """Two records for each response, with their fields as columns and the whole record in `record` (without the two line ends that close it).

    The responses are read once; the payload's digest is taken over from them.
    """
    payload = F.coalesce("payload", F.lit(""))
    # up to the last title that is closed, so that none before it is read to the end of the page in vain
    closed = F.regexp_extract(payload, r"(?is)^.*</title>", 0)
    title = F.regexp_extract(closed, r"(?is)<title[^<>]*>(.*?)</title>", 1)
    facts = F.concat_ws("\r\n", F.concat(F.lit("title: "), F.regexp_replace(title, r"\s+", " ")), F.concat(F.lit("outlinks: "), F.regexp_count(payload, F.lit(r"<[aA]\s"))), F.concat(F.lit("source-payload-length: "), F.octet_length(payload)), F.concat(F.lit("source-http-headers: "), F.replace(F.coalesce("http_headers", F.lit("")), F.lit("\r\n"), F.lit(" | "))))
    made = [F.struct(F.lit(kind).alias("kind"), F.lit(mime).alias("mime"), block.alias("block")) for kind, mime, block in (("metadata", "application/warc-fields", facts), ("conversion", "text/plain; charset=utf-8", plain_text(payload)))]
    source = ("record_id", "target_uri", "warc_date", "http_headers", "payload_digest")
    each = responses.select(F.col(id_col).alias("_id"), *(F.col(c) for c in source), F.explode(F.array(*made)).alias("_r"))
    both = each.select(F.col("_id").alias(id_col), F.col("_r.kind").alias("warc_type"), urn(F.col("_r.kind"), F.col("record_id")).alias("record_id"), F.col("record_id").alias("refers_to"), "target_uri", "warc_date", "http_headers", F.col("payload_digest").alias("source_digest"), F.col("_r.mime").alias("content_type"), digest(F.col("_r.block")).alias("block_digest"), F.octet_length("_r.block").cast("long").alias("content_length"), F.col("_r.block").alias("block"))
    field = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))).otherwise("")
    head = F.concat(F.lit("WARC/1.1\r\n"), field("WARC-Type", F.col("warc_type")), field("WARC-Record-ID", F.col("record_id")), field("WARC-Refers-To", F.col("refers_to")), field("WARC-Refers-To-Target-URI", F.col("target_uri")), field("WARC-Refers-To-Date", F.col("warc_date")), field("WARC-Target-URI", F.col("target_uri")), field("WARC-Date", F.col("warc_date")), field("X-Source-Payload-Digest", F.col("source_digest")), field("WARC-Block-Digest", F.col("block_digest")), field("Content-Type", F.col("content_type")), field("Content-Length", F.col("content_length")))
    return both.withColumn("record", F.concat(head, F.lit("\r\n"), F.col("block")))


def write_warc(records: DataFrame, path: str) -> None:
    """The records as gzipped WARC files, as many as the table has partitions."""
    records.select("record").write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)
