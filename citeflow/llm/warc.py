"""WARC derivatives: responses become linked metadata and plain-text conversion records.

Both records of a response name it in ``WARC-Refers-To``, with its target, date and digests, so that a derivative can be
traced and checked without the archive it came from. Everything is a column expression; records are written as
WARC/1.1 files by Spark's text writer.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeflow.llm.frames import col, free_name

#: Named character references that count without a semicolon too, the longer ones first.
SHORT_NAMES = sorted((name for name in html5 if name[-1] != ";"), key=lambda name: (-len(name), name))
#: What numeric references to 0x80 up to 0x9F stand for: the characters of Windows-1252, where it has one.
CONTROLS = {chr(c): shown for c in range(0x80, 0xA0) if (shown := bytes([c]).decode("cp1252", "ignore"))}
#: What is taken out first, in one pass from the left, so that none is looked for inside another: comments; scripts and
#: styles, to the end of the page where their end is missing; other hidden elements that have an end. Titles and text
#: areas hold no markup and are stepped over. A hidden element leaves ``<!name>``, a line end.
HIDDEN = (
    "<!--(?:-?>|.*?(?:--!?>|\\z))"
    "|<(script|style)(?:\\s[^>]*)?>.*?(?:</\\1\\s*>|\\z)"
    "|<(noscript|template|svg(?![^>]*/>))(?:\\s[^>]*)?>.*?</\\2\\s*>"
    "|(<(title|textarea)(?:\\s[^>]*)?>.*?</\\4\\s*>)"
)
#: A head, to its end tag or to the first thing that belongs in the body.
HEAD = (
    "<head(?:\\s[^>]*)?>"
    "(?:\\s++|<!(?!doctype)[^>]*>|</?(?:base|basefont|bgsound|link|meta|noframes)(?:[\\s/][^>]*)?>|<title(?:\\s[^>]*)?>.*?</title\\s*>)*+"
    "(?:</head\\s*>)?"
)
#: Elements that end a line.
BREAKING = (
    "address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figure|footer|form|h1|h2|h3|h4|h5|h6|header|hr|li|main|"
    "nav|ol|p|pre|section|table|td|th|title|tr|ul|head|!script|!style|!noscript|!template|!svg"
)
#: The target of an anchor as written, with its quotes: all attributes before it are stepped over.
HREF = (
    "(?is)<a(?=[\\s/])(?:[\\s/]*+(?!href\\s*=)[^\\s=>/]+(?:\\s*=\\s*(?:\"[^\"]*\"|'[^']*'|[^\\s\"'>][^\\s>]*))?)*+"
    "[\\s/]*href\\s*=\\s*(\"[^\"]*\"|'[^']*'|[^\\s\"'>][^\\s>]*)"
)
SPACES = "[ \\t\\x0B\\f\\r\\u00A0]+"


def record_id(*parts: Column) -> Column:
    """A ``urn:uuid`` made from a SHA-256 of the parts: the same record always gets the same id."""
    shown = [F.concat(F.octet_length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")) for p in parts]
    text = F.sha2(F.concat_ws("|", *[F.coalesce(s, F.lit("-")) for s in shown]), 256)
    return F.regexp_replace(text, "^(.{8})(.{4}).(.{3}).(.{3})(.{12}).*$", "<urn:uuid:$1-$2-5$3-a$4-$5>")


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.coalesce(block, F.lit("")), 256))


def plain_text(html: Column) -> Column:
    """Visible text: comments and hidden elements dropped, breaking tags as line ends, other tags dropped, character
    references decoded, white space squeezed, empty lines dropped. Null gives empty text.

    A script, a style or a comment without its end runs to the end of the page, a head without it to the first thing
    that belongs in the body; of other hidden elements without an end only the tag is dropped.
    """
    return _decoded(_without_markup(_without_hidden(html)))


def _without_hidden(html: Column) -> Column:
    return F.regexp_replace(F.coalesce(html, F.lit("")), f"(?is){HIDDEN}", "<!$1$2>$3")


def _without_markup(text: Column) -> Column:
    text = F.regexp_replace(text, f"(?is){HEAD}", "\n")
    text = F.regexp_replace(text, f"(?i)</?(?:{BREAKING})(?:\\s[^>]*)?/?>", "\n")
    return F.regexp_replace(text, "</?[A-Za-z!?][^>]*>", "")


def _decoded(text: Column) -> Column:
    """Character references decoded and white space squeezed."""
    text = F.regexp_replace(_references(text), SPACES, " ")
    text = F.regexp_replace(text, " ?\\n[ \\n]*", "\n")
    return F.regexp_replace(text, "^[ \\n]+|[ \\n]+\\z", "")


def _references(text: Column) -> Column:
    """Decode ``&eacute;``, ``&eacute``, ``&#233;`` and ``&#xE9;`` as HTML does, each once: the text is cut at each
    ``&``, and each piece begins with its own reference. What names nothing stays."""
    pieces = F.split(text, "&")

    def decode(piece: Column) -> Column:
        def put(reference: str, shown) -> Column:
            found = F.regexp_extract(piece, reference, 0)
            return F.concat(shown(found), F.substring(piece, F.length(found) + 1, F.length(piece)))

        number = put("^#(?:[0-9]+|[xX][0-9A-Fa-f]+);?", _numbered)
        name = F.coalesce(put("^[A-Za-z][A-Za-z0-9]*;", _named), put(f"^(?:{'|'.join(SHORT_NAMES)})", _short_named))
        return F.coalesce(F.when(piece.startswith("#"), number).otherwise(name), F.concat(F.lit("&"), piece))

    later = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), decode)
    return F.when(text.contains("&"), F.concat(F.get(pieces, F.lit(0)), F.array_join(later, ""))).otherwise(text)


def _table(names: list[str]) -> Column:
    return F.str_to_map(F.lit("\x02".join(f"{name}\x01{html5[name]}" for name in names)), F.lit("\x02"), F.lit("\x01"))


def _named(name: Column) -> Column:
    """What a name of HTML's table with its semicolon stands for, null for others. The table is one literal, an array of
    a map for each first letter."""
    letters = [chr(c) for c in range(ord("A"), ord("z") + 1)]
    table = F.array(*[_table([n for n in html5 if n[0] == letter and n[-1] == ";"]) for letter in letters])
    return F.try_element_at(F.get(table, F.ascii(name) - ord("A")), name)


def _short_named(name: Column) -> Column:
    return F.try_element_at(_table(SHORT_NAMES), name)


def _numbered(reference: Column) -> Column:
    """The character of ``#233;`` or ``#xE9;``, U+FFFD for those that no character has, null for an empty text."""
    decimal = F.regexp_extract(reference, "^#(?:0+(?=[0-9]))?([0-9]+)", 1)
    hexadecimal = F.regexp_extract(reference, "^#[xX](?:0+(?=[0-9A-Fa-f]))?([0-9A-Fa-f]+)", 1)
    code = F.when(F.length(decimal).between(1, 7), decimal.cast("int"))
    code = code.when(F.length(hexadecimal).between(1, 6), F.conv(hexadecimal, 16, 10).cast("int"))
    usable = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    # the mark of the byte order comes first, so that U+FEFF is not taken for one
    shown = F.decode(F.unhex(F.concat(F.lit("0000feff"), F.lpad(F.hex(code), 8, "0"))), "UTF-32")
    shown = F.translate(shown, "".join(CONTROLS), "".join(CONTROLS.values()))
    return F.when(usable, shown).when(reference != "", F.lit("\ufffd"))


def title(html: Column) -> Column:
    """Text of the first title element, empty without one."""
    return _decoded(_without_markup(_title(_without_hidden(html))))


def _title(html: Column) -> Column:
    return F.regexp_extract(html, "(?is)<title(?:\\s[^>]*)?>(.*?)</title\\s*>", 1)


def links(html: Column) -> Column:
    """Targets of all anchors outside of comments and scripts, in order, as written but for ``&amp;``."""
    return _links(_without_hidden(html))


def _links(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(HREF), 1)
    bare = lambda x: F.when(x.rlike("^[\"']"), F.substring(x, F.lit(2), F.length(x) - 2)).otherwise(x)
    return F.transform(found, lambda x: F.replace(bare(x), F.lit("&amp;"), F.lit("&")))


def responses(
    pages: DataFrame, url: str = "url", html: str = "html", date: str | None = None, headers: str | None = None
) -> DataFrame:
    """Response records of crawled pages: ``record_id``, ``target_uri``, ``warc_date``, ``http_headers``, ``payload``.

    Without a column of dates or of header texts they are null. The id follows from the target, the date and the
    payload's digest; repeated pages are one response each, with the same id.
    """
    at = col(date) if date else F.lit(None).cast("string")
    head = col(headers) if headers else F.lit(None).cast("string")
    return pages.select(
        "*",
        record_id(F.lit("response"), col(url), at, digest(col(html))).alias("record_id"),
        col(url).alias("target_uri"),
        at.alias("warc_date"),
        head.alias("http_headers"),
        col(html).alias("payload"),
    )


def derive(records: DataFrame, keep: list[str] = ()) -> DataFrame:
    """A metadata and a conversion record of every response record.

    ``records`` has ``record_id``, ``target_uri``, ``warc_date``, ``http_headers`` and ``payload``; ``keep`` names
    columns to carry along. Each derivative has ``warc_type``, its own ``record_id``, ``refers_to`` (the response),
    ``refers_to_target_uri``, ``refers_to_date``, ``source_headers``, ``source_digest`` (of the payload), ``content_type``,
    ``content``, ``content_length`` (bytes) and ``block_digest``. The conversion holds the plain text, the metadata record
    ``name: value`` lines (title, number of links, charset and language where given, the links, and the conversion's id
    and digest). A null payload is an empty one, null targets, dates and headers stay null; repeated responses give
    repeated records. No shuffle: both records come from one pass over the payload.
    """
    shown = free_name(records, "_shown")
    parts = records.withColumn(shown, _without_hidden(F.col("payload"))).select(
        *[col(c) for c in keep],
        "record_id",
        "target_uri",
        "warc_date",
        "http_headers",
        digest(F.col("payload")).alias("source_digest"),
        _without_markup(F.col(shown)).alias("text"),
        _without_markup(_title(F.col(shown))).alias("title"),
        _links(F.col(shown)).alias("links"),
        F.regexp_extract(F.coalesce("payload", F.lit("")), "(?i)<meta\\s[^>]*charset\\s*=\\s*\"?([A-Za-z0-9_-]+)", 1).alias("charset"),
        F.regexp_extract(F.coalesce("payload", F.lit("")), "(?i)<html\\s[^>]*lang\\s*=\\s*\"?([A-Za-z0-9-]+)", 1).alias("lang"),
    )
    # in a step of its own: what the step before made is computed once for all its uses
    parts = parts.withColumns({"text": _decoded(F.col("text")), "title": _decoded(F.col("title"))})
    parts = parts.withColumn("conversion_id", record_id(F.lit("conversion"), F.col("record_id")))

    def line(name: str, value: Column) -> Column:
        return F.when(value != "", F.concat(F.lit(f"{name}: "), value))

    facts = F.concat_ws(
        "\r\n",
        line("title", F.regexp_replace("title", "\\s+", " ")),
        line("charset", F.lower("charset")),
        line("language", F.lower("lang")),
        F.concat(F.lit("links: "), F.size("links").cast("string")),
        F.array_join(F.transform("links", lambda x: F.concat(F.lit("outlink: "), F.regexp_replace(x, "[\\r\\n]+", " "))), "\r\n"),
        F.concat(F.lit("conversion: "), F.col("conversion_id")),
        F.concat(F.lit("conversion-digest: "), digest(F.col("text"))),
    )
    record = lambda kind, own, media, content: F.struct(
        F.lit(kind).alias("warc_type"), own.alias("own_id"), F.lit(media).alias("content_type"), content.alias("content")
    )
    both = F.array(
        record("metadata", record_id(F.lit("metadata"), F.col("record_id")), "application/warc-fields", facts),
        record("conversion", F.col("conversion_id"), "text/plain", F.col("text")),
    )
    made = parts.select("*", F.inline(both))
    return made.select(
        *[col(c) for c in keep],
        "warc_type",
        F.col("own_id").alias("record_id"),
        F.col("record_id").alias("refers_to"),
        F.col("target_uri").alias("refers_to_target_uri"),
        F.col("warc_date").alias("refers_to_date"),
        F.col("http_headers").alias("source_headers"),
        "source_digest",
        "content_type",
        "content",
        F.octet_length("content").cast("bigint").alias("content_length"),
        digest(F.col("content")).alias("block_digest"),
    )


def as_text(derivatives: DataFrame, date: Column) -> DataFrame:
    """One column ``value``: each record as WARC/1.1 text without the two line ends that close it.

    ``date`` is the derivatives' own date. Source headers travel as ``X-Source-Header`` lines, one per header.
    """

    def line(name: str, value: Column | str) -> Column:
        value = F.col(value) if isinstance(value, str) else value
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))).otherwise(F.lit(""))

    sources = F.filter(F.split(F.coalesce("source_headers", F.lit("")), "\r?\n"), lambda x: x != "")
    return derivatives.select(
        F.concat(
            F.lit("WARC/1.1\r\n"),
            line("WARC-Type", "warc_type"),
            line("WARC-Record-ID", "record_id"),
            line("WARC-Date", date),
            line("WARC-Refers-To", "refers_to"),
            line("WARC-Refers-To-Target-URI", "refers_to_target_uri"),
            line("WARC-Refers-To-Date", "refers_to_date"),
            line("WARC-Target-URI", "refers_to_target_uri"),
            line("WARC-Block-Digest", "block_digest"),
            line("X-Source-Payload-Digest", "source_digest"),
            F.array_join(F.transform(sources, lambda x: F.concat(F.lit("X-Source-Header: "), x, F.lit("\r\n"))), ""),
            line("Content-Type", "content_type"),
            line("Content-Length", "content_length"),
            F.lit("\r\n"),
            F.col("content"),
        ).alias("value")
    )


def write_warc(derivatives: DataFrame, path: str, date: Column, compression: str = "gzip") -> None:
    """Write the records as WARC files below ``path``, one file per task."""
    as_text(derivatives, date).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)
