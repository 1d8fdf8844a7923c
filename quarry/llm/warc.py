"""WARC derivatives of captured pages: linked metadata and plain-text conversion records.

Every page is a response record, an HTTP message with the page as its payload; from it come a metadata record, with what its
source says of itself and its digests, and a conversion record, with the page as plain text. Record ids are UUIDs derived from
the page's id, url and block, so a page that is built again keeps them; derivatives name the response in refers_to, repeat its
target and date, and carry its payload's digest as the source's; their own digests are of their own blocks. Only DataFrame
functions are used and nothing is shuffled.

White space and control characters in a url are percent-encoded or dropped, so it can't add header lines; a title is one line.
Numeric and named character references of HTML are resolved in plain text and titles, with the semicolon only; numbers that are no
character, however long, give U+FFFD, names that HTML doesn't know stay. Tags are told from left to right: a quoted value after an
equals sign may hold anything, scripts and styles end with their own end tag or the page, comments with theirs or the page, and a
``<`` that begins none of these is text. A tag whose quoted values leave no end ends at its first ``>``; without one it is text.
U+FFFE and U+FFFF are no characters and left out. Null html is an empty page; a null url is an empty target. Repeated
rows give the same records again. An empty table gives an empty result. Other columns than page_id, url and html don't matter.
"""

from __future__ import annotations

import json
from functools import lru_cache
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The capture date that pages without one of their own are given.
DATE = "2024-01-01T00:00:00Z"
BLOCKS = "p|div|br|li|ul|ol|h1|h2|h3|h4|h5|h6|tr|table|section|article|header|footer|nav|aside|main|title|head|body|html"
REFERENCE = "&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]{1,31});"
#: What follows a tag's name: attributes, whose values may be quoted after an equals sign, and the end.
REST = "(?:[\\s/][^>=]*+(?:=(?:\\s*+(?:\"[^\"]*+\"|'[^']*+'))?+[^>=]*+)*+)?+>"
RAW = "|".join(f"{name}(?:{REST}|[\\s/][^>]*>).*?(?:</{name}(?:[\\s/][^>]*)?>|\\z)" for name in ("script", "style", "noscript"))
TAG = f"(?:/?[a-z][^\\s/>]*+(?:{REST}|[\\s/][^>]*>)|[!?][^>]*>)"
#: Marks around what is no text.
OPEN, CLOSE = "\uffff", "\ufffe"
SPACE = "[\\t\\n\\x0B\\f\\r ]+"


@lru_cache(1)
def characters() -> str:
    """What each name, and each number that HTML reads as Windows-1252, stands for, as JSON."""
    named = {name[:-1]: text for name, text in html5.items() if name.endswith(";")}
    odd = {f"#{b}": bytes([b]).decode("cp1252", "ignore") for b in range(128, 160)}
    return json.dumps(named | {n: text for n, text in odd.items() if text})


def resolved(text: Column) -> Column:
    """The text with its character references resolved."""
    table = F.from_json(F.lit(characters()), "map<string,string>")

    def character(ref: Column) -> Column:
        number = F.when(F.lower(F.substring(ref, 2, 1)) == "x", F.conv(F.substr(ref, F.lit(3)), 16, 10)).otherwise(F.substr(ref, F.lit(2))).try_cast("long")
        valid = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        own = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise("�")
        numeric = F.when(number.between(128, 159), F.coalesce(F.try_element_at(table, F.concat(F.lit("#"), number.cast("string"))), own)).otherwise(own)
        return F.when(F.startswith(ref, F.lit("#")), numeric).otherwise(F.coalesce(F.try_element_at(table, ref), F.concat(F.lit("&"), ref, F.lit(";"))))

    refs = F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(1)), character)
    whole = F.array_join(F.zip_with(F.split(text, REFERENCE, -1), F.array_append(refs, F.lit("")), lambda part, ref: F.concat(part, ref)), "")
    return F.when(F.contains(text, F.lit("&")), whole).otherwise(text)


def tagless(html: Column) -> Column:
    """The page without scripts, styles, comments and tags; a line feed for each block.

    One pass from left to right puts marks around every tag and in place of the rest, so that no later one takes text for a tag.
    """
    plain = F.replace(F.replace(html, F.lit(OPEN), F.lit("")), F.lit(CLOSE), F.lit(""))
    out = F.regexp_replace(plain, f"(?is)<(?:!--.*?(?:-->|\\z)|{RAW}|({TAG}))", f"{OPEN}<$1{CLOSE}")
    # nothing between the marks: no tag
    out = F.replace(out, F.lit(f"{OPEN}<{CLOSE}"), F.lit(" "))
    out = F.regexp_replace(out, f"(?i){OPEN}</?(?:{BLOCKS})[\\s/>][^{CLOSE}]*+{CLOSE}", "\n")
    return F.regexp_replace(out, f"{OPEN}<[^{CLOSE}]*+{CLOSE}", "")


def tidy(text: Column) -> Column:
    """Spaces collapsed, no empty lines."""
    out = F.regexp_replace(text, "[ \\t\\r\\f\\xA0]+", " ")
    out = F.regexp_replace(out, " ?\\n[ \\n]*", "\n")
    return F.regexp_replace(out, "^[ \\n]+|[ \\n]+$", "")


def one_line(url: Column) -> Column:
    """A url as a header line can hold it."""
    out = url
    for character, code in ((" ", "%20"), ("\t", "%09"), ("\r", "%0D"), ("\n", "%0A")):
        out = F.replace(out, F.lit(character), F.lit(code))
    return F.regexp_replace(out, "[\\x00-\\x1F\\x7F]", "")


def record_id(*parts: Column) -> Column:
    """A urn:uuid of version 8 from a digest of the parts."""
    h = F.sha2(F.concat_ws("\n", *parts), 256)
    cut = lambda a, n: F.substring(h, a, n)
    variant = F.translate(cut(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(F.lit("<urn:uuid:"), cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-8"), cut(14, 3), F.lit("-"), variant, cut(18, 3), F.lit("-"), cut(21, 12), F.lit(">"))


def build_derivatives(pages: DataFrame) -> DataFrame:
    """Three rows per page: page_id, warc_type, record_id, refers_to, headers, payload_digest, block_digest, content_length and block.

    headers are the record's WARC header lines; content_length and block_digest are those of its block in UTF-8, payload_digest
    that of the page or of its plain text.
    """
    digest = lambda c: F.concat(F.lit("sha256:"), F.sha2(F.col(c), 256))
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    size = lambda c: F.octet_length(c).cast("string")
    page = pages.select("page_id", one_line(F.coalesce(F.col("url").cast("string"), F.lit(""))).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    page = page.withColumn("bare", tagless(F.col("html"))).withColumn("text", tidy(resolved(F.col("bare")))).drop("bare")
    page = page.withColumns({"source_digest": digest("html"), "message": text("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: ", size("html"), "\r\n\r\n", F.col("html"))})
    page = page.withColumn("response", record_id(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("url"), F.col("source_digest")))
    title = F.regexp_replace(resolved(F.regexp_extract("html", f"(?is)<title(?:{REST}|[\\s/][^>]*>)(.*?)</title", 1)), SPACE, " ")
    host = F.regexp_extract("url", "^[a-zA-Z]+://([^/:?#]*)", 1)
    metadata = text("via: ", F.col("url"), "\r\nhost: ", host, "\r\ntitle: ", title, "\r\nsource-content-type: text/html\r\nsource-payload-digest: ", F.col("source_digest"), "\r\nsource-length: ", size("html"), "\r\ntext-length: ", size("text"), "\r\n")
    none = F.lit(None).cast("string")
    kinds = F.array(
        F.struct(F.lit("response").alias("warc_type"), F.lit("application/http; msgtype=response").alias("content_type"), F.col("source_digest").alias("payload_digest"), F.col("message").alias("block")),
        F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/warc-fields").alias("content_type"), none.alias("payload_digest"), metadata.alias("block")),
        F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), none.alias("payload_digest"), F.col("text").alias("block")),
    )
    rows = page.select("page_id", "url", "source_digest", "response", F.inline(kinds))
    source = F.col("warc_type") == "response"
    rows = rows.withColumns({"content_length": F.octet_length("block").cast("long"), "block_digest": digest("block")})
    rows = rows.withColumns(
        {
            "payload_digest": F.when(F.col("warc_type") == "conversion", F.col("block_digest")).otherwise(F.col("payload_digest")),
            "record_id": F.when(source, F.col("response")).otherwise(record_id(F.col("warc_type"), F.col("response"), F.col("block_digest"))),
            "refers_to": F.when(~source, F.col("response")),
        }
    )
    lines = [
        F.lit("WARC/1.1"),
        text("WARC-Type: ", F.col("warc_type")),
        text("WARC-Record-ID: ", F.col("record_id")),
        F.lit(f"WARC-Date: {DATE}"),
        text("WARC-Target-URI: ", F.col("url")),
        text("WARC-Refers-To: ", F.col("refers_to")),
        F.when(~source, text("WARC-Refers-To-Target-URI: ", F.col("url"))),
        F.when(~source, F.lit(f"WARC-Refers-To-Date: {DATE}")),
        F.when(~source, text("X-Source-Payload-Digest: ", F.col("source_digest"))),
        text("WARC-Payload-Digest: ", F.col("payload_digest")),
        text("WARC-Block-Digest: ", F.col("block_digest")),
        text("Content-Type: ", F.col("content_type")),
        text("Content-Length: ", F.col("content_length").cast("string")),
    ]
    return rows.select("page_id", "warc_type", "record_id", "refers_to", F.concat_ws("\r\n", *lines).alias("headers"), "payload_digest", "block_digest", "content_length", "block")
