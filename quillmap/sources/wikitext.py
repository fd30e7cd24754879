"""A plain reading of wikitext by patterns: lead, counts, short description, links.

Templates are taken out from the inside, so nesting of any depth is met; no parser
package is needed. Where a full parser would differ (templates that make headings,
broken markup), this reading keeps the visible text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.text import NAMESPACES, TIDY

SCHEMA = "title string, lead_text string, lead_word_count int, article_word_count int, article_section_count int, article_ref_count int, short_description string, links array<string>"
INNER = re.compile(r"\{\{([^{}]*)\}\}")
LINK = re.compile(r"\[\[([^\[\]|]*)(?:\|([^\[\]]*))?\]\]")
REF = re.compile(r"<ref\b[^>/]*(?:/>|>.*?</ref\s*>)", re.S | re.I)
HEAD = re.compile(r"^==[^=].*?==\s*$", re.M)
GALLERY = re.compile(r"<gallery\b[^>]*>.*?</gallery\s*>", re.S | re.I)
SHORT = re.compile(r"\{\{\s*short[ _]description\s*\|\s*([^{}|]*)", re.I)
COMMENT, TABLE, URL = re.compile(r"<!--.*?-->", re.S), re.compile(r"\{\|.*?\|\}", re.S), re.compile(r"\[https?://\S+\s*([^\]]*)\]")
MARKS, NOTE = re.compile(r"'{2,}|<[^>]+>"), re.compile(r"<ref\b", re.I)
LOOSE = [(re.compile(pattern), put.replace("$1", r"\1")) for pattern, put in TIDY]
#: Templates that stand for characters, and those that stand for a vague year.
PLAIN = {"snd": " – ", "spaced ndash": " – ", "ndash": "–", "endash": "–", "en dash": "–", "mdash": "—", "emdash": "—", "em dash": "—", "nbsp": " ", "'": "'", "=": "="}
CIRCA = ("circa", "c.", "ca.", "ca", "c")
FLORUIT = ("floruit", "fl.", "fl")


def _template(body: str) -> str:
    name, *rest = [x.strip() for x in body.split("|")]
    name = name.lower()
    if name in PLAIN:
        return PLAIN[name]
    sign = "c." if name in CIRCA else "fl." if name in FLORUIT else ""
    return f"{sign} {rest[0]}" if sign and rest and rest[0] else sign


def skipped(target: str) -> bool:
    """Whether a link leads to a namespace that holds no articles."""
    space, colon, _ = target.strip().removeprefix(":").replace("_", " ").partition(":")
    return bool(colon) and space.strip().lower() in NAMESPACES


def strip(text: str, lead: bool = False) -> str:
    """Visible text: no comments, references, galleries, templates, tables, tags or quotes of markup, and in a lead no links to other namespaces."""
    if "<" in text:  # a pattern is tried where its first signs stand
        text = GALLERY.sub("", REF.sub("", COMMENT.sub("", text)))
    while "{{" in text and (new := INNER.sub(lambda m: _template(m[1]), text)) != text:
        text = new
    if "{|" in text:
        text = TABLE.sub("", text)
    while "[[" in text and (new := LINK.sub(lambda m: "" if lead and skipped(m[1]) else (m[2] if m[2] is not None else m[1]), text)) != text:
        text = new
    if "[http" in text:
        text = URL.sub(r"\1", text)
    return html.unescape(MARKS.sub("", text) if "''" in text or "<" in text else text)


def tidy(text: str) -> str:
    for pattern, put in LOOSE:
        text = pattern.sub(put, text)
    return text.strip()


def article(title: str, text: str | None) -> dict:
    """An article's fields; nulls and no links where the text can't be read."""
    try:
        return _article(title, text or "")
    except (ValueError, re.error, RecursionError):
        return dict.fromkeys(x.strip().split()[0] for x in SCHEMA.split(", ")) | {"title": title, "links": []}


def links_of(text: str) -> list[str]:
    """Targets of a text's links, each once, in order; none to namespaces that hold no articles."""
    return list(dict.fromkeys(t for m in LINK.finditer(text) if (t := m[1].strip()) and not skipped(t)))


def _article(title: str, text: str) -> dict:
    heads = HEAD.findall(text)
    lead = tidy(strip(HEAD.split(text, maxsplit=1)[0], lead=True))
    short = SHORT.search(text)
    return {"title": title, "lead_text": lead, "lead_word_count": len(lead.split()), "article_word_count": len(strip(text).replace("=", " ").split()), "article_section_count": max(0, len(heads) - 1), "article_ref_count": len(NOTE.findall(text)), "short_description": short[1].strip() if short else None, "links": links_of(text)}


def parse_articles(pages: DataFrame) -> DataFrame:
    """Measures of pages(title, text), in Arrow batches; null text reads as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"lead_word_count": pa.int32(), "article_word_count": pa.int32(), "article_section_count": pa.int32(), "article_ref_count": pa.int32(), "links": pa.list_(pa.string())}
        names = [x.strip().split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            rows = [article(t, x) for t, x in zip(batch.column("title").to_pylist(), batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], types.get(k, pa.string())) for k in names], names)

    return pages.select("title", "text").mapInArrow(run, SCHEMA)


def parse_links(pages: DataFrame) -> DataFrame:
    """(title, redirect, links) of pages(title, redirect, text), in Arrow batches: a text's links alone, none of a redirect's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[] if r is not None else links_of(x or "") for r, x in zip(batch.column("redirect").to_pylist(), batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("title"), batch.column("redirect"), pa.array(found, pa.list_(pa.string()))], ["title", "redirect", "links"])

    return pages.select("title", "redirect", "text").mapInArrow(run, "title string, redirect string, links array<string>")
