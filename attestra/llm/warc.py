"""WARC derivatives: linked metadata and plain-text conversion records for response records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm.text import or_empty

VERSION = "WARC/1.1"
CRLF = "\r\n"
#: Date of records made from a table that has none.
NO_DATE = "1970-01-01T00:00:00Z"

# What is dropped from HTML with its content, what ends a line, and the entities that are resolved.
DROPPED = [r"(?is)<!--.*?-->", r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>", r"(?is)<noscript\b.*?</noscript\s*>", r"(?is)<template\b.*?</template\s*>"]
LINE_TAGS = r"(?i)</?(?:p|div|br|hr|li|ul|ol|dl|dt|dd|h[1-6]|tr|td|th|table|section|article|header|footer|nav|main|aside|form|blockquote|pre|title|head|body|html)\b[^>]*>"
OTHER_TAGS = r"<[^>]*>"
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")]
TITLE = r"(?is)<title[^>]*>(.*?)</title\s*>"
LANGUAGE = r"(?is)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z0-9-]+)"
LINK = r"(?i)<a\b[^>]*\bhref\s*="


def _entities(c: Column) -> Column:
    for name, character in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(character))
    return c


def plain_text(html: Column) -> Column:
    """The text of a page: one line for each block, single spaces, no empty lines."""
    c = or_empty(html)
    for pattern in DROPPED:
        c = F.regexp_replace(c, pattern, " ")
    c = _entities(F.regexp_replace(F.regexp_replace(c, LINE_TAGS, "\n"), OTHER_TAGS, ""))
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t\r\f\x0b]+", " "), r" ?\n[ \n]*", "\n")
    return F.btrim(c, F.lit(" \n"))


def _one_line(c: Column) -> Column:
    return F.btrim(F.regexp_replace(_entities(F.regexp_replace(c, OTHER_TAGS, "")), r"[ \t\r\n\f\x0b]+", " "))


def record_id(*parts: Column) -> Column:
    """A stable identifier in the form of a UUID, from the hash of what names the record."""
    h = F.sha2(F.concat_ws("|", *parts), 256)
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4)) for x in (F.substring(h, a, n), F.lit("-"))], F.substring(h, 21, 12), F.lit(">"))


def digest(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def responses(pages: DataFrame, date: str = NO_DATE) -> DataFrame:
    """Response records (record_id, target_uri, date, content_type, payload, payload_digest, page_id) from (page_id, url, html)."""
    payload = or_empty(F.col("html"))
    return pages.select(
        "page_id",
        record_id(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), or_empty(F.col("url"))).alias("record_id"),
        or_empty(F.col("url")).alias("target_uri"),
        F.lit(date).alias("date"),
        F.lit("text/html").alias("content_type"),
        payload.alias("payload"),
        digest(payload).alias("payload_digest"),
    )


def derivatives(source: DataFrame) -> DataFrame:
    """Two records for each response: its metadata and its text, both with all other columns of source kept as they are.

    Columns: record_type (metadata or conversion), record_id, refers_to (the response's id, as it stands there),
    concurrent_to (the other record), target_uri, date, content_type and content_length of the block, block_digest,
    source_content_type and source_digest (as the response gives them), block. Lengths are in bytes of UTF-8.

    One scan and no shuffle: a response's records are made side by side, so hot hosts and long pages burden no other
    task. A null payload is an empty page; a null type or digest is an empty value in the metadata block and stays null in
    the columns. Equal responses get equal records. An empty table gives an empty result.
    """
    own = ["record_id", "target_uri", "date", "content_type", "payload", "payload_digest"]
    rest = [c for c in source.columns if c not in own and c not in ("record_type", "refers_to", "concurrent_to", "content_length", "block_digest", "source_content_type", "source_digest", "block")]
    html, response = or_empty(F.col("payload")), F.col("record_id")
    ids = {kind: record_id(F.lit(kind), or_empty(response)) for kind in ("metadata", "conversion")}
    fields = [
        ("title", _one_line(F.regexp_extract(html, TITLE, 1))),
        ("language", F.regexp_extract(html, LANGUAGE, 1)),
        ("outlinks", F.regexp_count(html, F.lit(LINK)).cast("string")),
        ("source-content-type", or_empty(F.col("content_type"))),
        ("source-payload-digest", or_empty(F.col("payload_digest"))),
        ("source-length", F.octet_length(html).cast("string")),
    ]
    facts = F.concat(*[x for name, value in fields for x in (F.lit(f"{name}: "), value, F.lit(CRLF))])
    one = lambda kind, other, content_type, block: F.struct(
        F.lit(kind).alias("record_type"), ids[kind].alias("record_id"), ids[other].alias("concurrent_to"), F.lit(content_type).alias("content_type"), block.alias("block")
    )
    records = F.array(
        one("metadata", "conversion", "application/warc-fields", facts), one("conversion", "metadata", "text/plain; charset=utf-8", plain_text(F.col("payload")))
    )
    out = source.select(*[F.col(f"`{c}`") for c in rest], response.alias("refers_to"), "target_uri", "date", F.col("content_type").alias("source_content_type"), F.col("payload_digest").alias("source_digest"), F.explode(records).alias("r"))
    return out.select(
        *[F.col(f"`{c}`") for c in rest],
        "r.record_type", "r.record_id", "refers_to", "r.concurrent_to", "target_uri", "date", "r.content_type",
        F.octet_length("r.block").cast("long").alias("content_length"),
        digest(F.col("r.block")).alias("block_digest"),
        "source_content_type", "source_digest", "r.block",
    )


def warc_text(records: DataFrame) -> DataFrame:
    """One column, value: each record as it stands in a WARC file, without the two line ends behind it."""
    header = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), F.regexp_replace(value, "[\r\n]+", " "), F.lit(CRLF))).otherwise(F.lit(""))
    named = [
        ("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Concurrent-To", "concurrent_to"),
        ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"), ("WARC-Block-Digest", "block_digest"),
        ("X-Source-Content-Type", "source_content_type"), ("X-Source-Payload-Digest", "source_digest"),
        ("Content-Type", "content_type"), ("Content-Length", "content_length"),
    ]
    parts = [header(name, F.col(c).cast("string")) for name, c in named]
    return records.select(F.concat(F.lit(VERSION + CRLF), *parts, F.lit(CRLF), "block").alias("value"))


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Writes a folder of WARC files, one for each partition."""
    warc_text(records).write.option("lineSep", CRLF + CRLF).option("compression", compression).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(headers map, block, whole) of the records in WARC files of UTF-8 text, of any version 1; whole: the block has its
    stated length.

    Files are split at version lines, so a large file that is not compressed is read by many tasks. A block that holds an
    empty line and a version line itself is cut there, and its row says whole = false. A header is split at its first
    colon; a line without one is left out, a repeated header's values are joined by a comma. A record without a length, or
    with one that is no number, has all its text as its block and whole = null.
    """
    raw = spark.read.option("lineSep", CRLF + "WARC/1.").text(path)
    value = F.regexp_replace("value", "^(?:WARC/1\\.)?[0-9]+\r\n", "")
    at = F.instr("value", CRLF + CRLF)
    rows = raw.select(value.alias("value")).withColumn("at", at).filter("at > 0")
    rows = rows.select(F.expr("left(value, at - 1)").alias("head"), F.expr("substring(value, at + 4)").alias("body"))
    lines = F.filter(F.split("head", CRLF), lambda x: F.instr(x, ":") > 1)
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v")))
    rows = rows.select(pairs.alias("pairs"), "body")
    names = F.array_distinct(F.transform("pairs", lambda p: p["k"]))
    values = F.transform(names, lambda k: F.array_join(F.transform(F.filter("pairs", lambda p: p["k"] == k), lambda p: p["v"]), ", "))
    rows = rows.select(F.map_from_arrays(names, values).alias("headers"), "body")
    length = F.try_element_at("headers", F.lit("Content-Length")).try_cast("int")
    bare = F.decode(F.substring(F.encode("body", "UTF-8"), F.lit(1), length), "UTF-8")
    return rows.select("headers", F.when(length.isNull(), F.col("body")).otherwise(bare).alias("block"), (F.octet_length("body") >= length).alias("whole"))


def derivatives_report(pages: DataFrame) -> DataFrame:
    return derivatives(responses(pages.select("page_id", "url", "html")))


def _duck(pattern: str) -> str:
    return pattern.replace("'", "''")


def oracle() -> str:
    """The same in DuckDB's SQL, from the same fixed values."""
    text = "coalesce(html, '')"
    for p in DROPPED:
        text = f"regexp_replace({text}, '{_duck(p)}', ' ', 'g')"
    text = f"regexp_replace(regexp_replace({text}, '{_duck(LINE_TAGS)}', chr(10), 'g'), '{OTHER_TAGS}', '', 'g')"
    title = f"regexp_replace(regexp_extract(coalesce(html, ''), '{_duck(TITLE)}', 1), '{OTHER_TAGS}', '', 'g')"
    for name, character in ENTITIES:
        text, title = (f"replace({x}, '{name}', '{_duck(character)}')" for x in (text, title))
    text = rf"trim(regexp_replace(regexp_replace({text}, '[ \t\r\f\x0b]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10))"
    title = rf"trim(regexp_replace({title}, '[ \t\r\n\f\x0b]+', ' ', 'g'))"
    uuid = lambda x: f"(SELECT '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>' FROM (SELECT sha256({x}) AS h))"
    end = "chr(13) || chr(10)"
    return f"""
WITH r AS (SELECT page_id, html, coalesce(url, '') AS target_uri, {uuid("'response|' || coalesce(cast(page_id AS varchar), '') || '|' || coalesce(url, '')")} AS refers_to,
                  'sha256:' || sha256(coalesce(html, '')) AS source_digest FROM pages),
d AS (SELECT *, {uuid("'metadata|' || refers_to")} AS mid, {uuid("'conversion|' || refers_to")} AS cid FROM r),
u AS (SELECT page_id, 'metadata' AS record_type, mid AS record_id, refers_to, cid AS concurrent_to, target_uri, 'application/warc-fields' AS content_type, source_digest,
             'title: ' || {title} || {end} || 'language: ' || regexp_extract(coalesce(html, ''), '{_duck(LANGUAGE)}', 1) || {end} ||
             'outlinks: ' || len(regexp_extract_all(coalesce(html, ''), '{_duck(LINK)}')) || {end} || 'source-content-type: text/html' || {end} ||
             'source-payload-digest: ' || source_digest || {end} || 'source-length: ' || strlen(coalesce(html, '')) || {end} AS block FROM d
      UNION ALL
      SELECT page_id, 'conversion', cid, refers_to, mid, target_uri, 'text/plain; charset=utf-8', source_digest, {text} FROM d)
SELECT page_id, record_type, record_id, refers_to, concurrent_to, target_uri, '{NO_DATE}' AS date, content_type, cast(strlen(block) AS bigint) AS content_length,
       'sha256:' || sha256(block) AS block_digest, 'text/html' AS source_content_type, source_digest, block FROM u
"""


SQL = oracle()
