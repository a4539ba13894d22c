"""Pages and sitemaps by regular expressions inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters below which an article is not trusted, and the most that a page's text keeps.
LEAST_TEXT, LONGEST_TEXT = 400, 12_000
#: Elements whose end breaks a line; elements that part blocks; elements that are no text; elements that blocks are not looked for in, and that a page's body goes without.
BLOCK_END = r"(?i)</(p|div|section|article|header|footer|li|ul|ol|h[1-6]|tr|table|blockquote|pre|dd|dt|figure|aside|main|nav)>|<br\s*/?>"
BLOCK_TAG = r"(?i)</?(p|div|section|article|header|footer|li|ul|ol|dl|h[1-6]|tr|td|th|table|blockquote|pre|dd|dt|figure|aside|main|nav|form)\b[^>]*>"
UNSEEN = ("script", "style", "noscript")
FRAME = ("svg", "template", "nav", "footer", "form", "iframe")
ASIDE = ("svg", "template", "nav", "header", "footer", "form", "iframe")
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&middot;": "·", "&copy;": "©", "&amp;": "&"}


def decoded(text: Column) -> Column:
    for entity, character in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(character))
    return text


def visible_text(html: Column) -> Column:
    """Text without scripts, styles, comments and tags; runs of white space become one space."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1\s*>", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(decoded(bare), r"\s+", " "))


def _lines(text: Column) -> Column:
    """Lines trimmed, their white space single, at most one blank line in a row, none at the ends."""
    lines = F.transform(F.split(text, "\n"), lambda line: F.trim(F.regexp_replace(line, r"[ \t\u00a0\r\f]+", " ")))
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def _without(html: Column, *tags: str) -> Column:
    for tag in tags:
        html = F.regexp_replace(html, rf"(?is)<{tag}\b.*?</{tag}\s*>", "")
    return F.regexp_replace(html, r"(?s)<!--.*?-->", "")


def body_of(html: Column) -> Column:
    body = F.regexp_extract(html, r"(?is)<body\b[^>]*>(.*?)(?:</body\s*>|$)", 1)
    return F.when(body != "", body).otherwise(html)


def block_text(html: Column) -> Column:
    """The text of HTML with a line break where a block ends. Tags within a line leave nothing behind; hidden panels are text as any other."""
    broken = F.regexp_replace(_without(html, *UNSEEN), BLOCK_END, "$0\n")
    return _lines(decoded(F.regexp_replace(broken, r"(?s)<[^>]*>", "")))


def text_blocks(html: Column) -> Column:
    """The blocks of a page's body that hold text, outside of navigation, footers and forms, in order: ``text``, ``words``, ``linked`` (words within links) and ``content``.

    Whether a block is content is told by the words and the share of linked words of itself and the blocks before and after it (Kohlschütter, Fankhauser and Nejdl, 2010: the
    classifier by numbers of words). Before the first and after the last block is an empty one.
    """
    marked = F.regexp_replace(F.regexp_replace(_without(body_of(html), *UNSEEN, *FRAME), r"(?i)<a\b[^>]*>", "\u0001"), r"(?i)</a\s*>", "\u0002")
    pieces = F.split(F.regexp_replace(F.regexp_replace(marked, BLOCK_TAG, "\u0003"), r"(?s)<[^>]*>", ""), "\u0003")
    size = lambda text: F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    # a link that goes over the end of a block is closed with it
    linked = lambda piece: F.array_join(F.regexp_extract_all(piece, F.lit("\u0001([^\u0001\u0002]*)"), F.lit(1)), " ")
    plain = lambda piece: F.regexp_replace(piece, "[\u0001\u0002]", "")
    blocks = F.transform(pieces, lambda p: F.struct(_lines(decoded(plain(p))).alias("text"), size(decoded(plain(p))).alias("words"), size(decoded(linked(p))).alias("linked")))
    named = F.filter(blocks, lambda b: b["words"] > 0)

    def judged(all_: Column) -> Column:
        count = lambda i: F.coalesce(F.get(all_, i)["words"], F.lit(0))
        dense = lambda i: F.coalesce(F.get(all_, i)["linked"] / F.get(all_, i)["words"], F.lit(0.0))

        def content(b: Column, i: Column) -> Column:
            few = F.when(dense(i - 1) <= 0.555556, (b["words"] > 16) | (count(i + 1) > 15) | (count(i - 1) > 4)).otherwise((b["words"] > 40) | (count(i + 1) > 17))
            return (dense(i) <= 0.333333) & few

        return F.transform(all_, lambda b, i: F.struct(b["text"].alias("text"), b["words"].alias("words"), b["linked"].alias("linked"), content(b, i).alias("content")))

    # a one-element array gives the blocks a name, so that they are worked out once
    return F.get(F.transform(F.array(named), judged), F.lit(0))


def dense_text(html: Column) -> Column:
    """The text of a page's content blocks, one after the other, or of its whole body without navigation and forms where that has under LEAST_TEXT characters or a quarter of the body's; at most LONGEST_TEXT characters."""
    content = F.array_join(F.transform(F.filter(text_blocks(html), lambda b: b["content"]), lambda b: b["text"]), "\n")
    rest = block_text(_without(body_of(html), *ASIDE))
    return F.substring(F.when((F.length(content) >= LEAST_TEXT) & (F.length(content) >= F.length(rest) * 0.25), content).otherwise(rest), 1, LONGEST_TEXT)


def main_text(html: Column) -> Column:
    """The text of the article, or of the whole body without navigation and forms if the article has under LEAST_TEXT characters or a quarter of the body; at most LONGEST_TEXT characters."""
    article = visible_text(F.regexp_extract(html, r"(?is)<(article|main)\b[^>]*>(.*?)</\1\s*>", 2))
    body = F.regexp_extract(html, r"(?is)<body\b[^>]*>(.*?)(?:</body\s*>|$)", 1)
    rest = visible_text(F.regexp_replace(F.when(body != "", body).otherwise(html), r"(?is)<(svg|template|nav|header|footer|form|iframe)\b.*?</\1\s*>", " "))
    whole = (F.length(article) >= LEAST_TEXT) & (F.length(article) >= F.length(rest) * 0.25)
    return F.substring(F.when(whole, article).otherwise(rest), 1, LONGEST_TEXT)


def pdf_text(text: Column) -> Column:
    """The text of a PDF: lines trimmed, their white space single, at most one blank line in a row, at most LONGEST_TEXT characters."""
    lines = F.transform(F.split(text, "\n"), lambda line: F.regexp_replace(F.regexp_replace(line, "[ \t\u00a0]+", " "), r"^\s+|\s+$", ""))
    joined = F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n")
    return F.substring(F.regexp_replace(joined, r"^\s+|\s+$", ""), 1, LONGEST_TEXT)


def title(html: Column) -> Column:
    return F.trim(decoded(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title\s*>", 1)))


def plain_title(html: Column) -> Column:
    """The text of the first ``<title>`` that is written so and ends on its line, as it stands but for ampersands."""
    return F.replace(F.trim(F.regexp_extract(html, r"(?d)<title>(.*?)</title>", 1)), F.lit("&amp;"), F.lit("&"))


def links(html: Column) -> Column:
    """Each link's address and text, in order."""
    tag = r"(?is)<a\s[^>]*href=[\"']([^\"']*)[\"'][^>]*>(.*?)</a\s*>"
    return F.zip_with(F.regexp_extract_all(html, F.lit(tag), F.lit(1)), F.regexp_extract_all(html, F.lit(tag), F.lit(2)), lambda href, text: F.struct(decoded(href).alias("href"), F.substring(visible_text(text), 1, 300).alias("text")))


def json_ld(html: Column) -> Column:
    """The bodies of a page's JSON-LD blocks, without CDATA marks and control characters."""
    blocks = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script\s*>"), F.lit(1))
    return F.transform(blocks, lambda b: F.trim(F.regexp_replace(F.regexp_replace(b, r"<!\[CDATA\[|\]\]>", ""), r"[\x00-\x1f]", " ")))


def sitemap_addresses(xml: Column) -> Column:
    return F.transform(F.regexp_extract_all(xml, F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1)), decoded)


def is_sitemap_index(xml: Column) -> Column:
    return xml.rlike(r"(?i)<sitemapindex\b")


def is_html(content_type: Column, body: Column) -> Column:
    return F.coalesce(content_type.rlike(r"(?i)\bhtml\b"), F.lit(False)) | body.rlike(r"^\s*<")


def is_pdf(content_type: Column, body: Column) -> Column:
    return F.coalesce(content_type.rlike(r"(?i)\bapplication/pdf\b"), F.lit(False)) | body.startswith("%PDF-")
