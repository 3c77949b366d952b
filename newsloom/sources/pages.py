"""Pages: fetching (an adapter), extraction of text, title and date from HTML, and the ladder of rescues."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import settings as S
from ..functions import text as T
from ..plans.storage import small_batches

NOISE = {"script", "style", "nav", "header", "footer", "aside", "form", "noscript", "template", "svg"}
BREAKS = {"p", "br", "div", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "blockquote"}
VOID = {"br", "img", "meta", "link", "input", "hr", "source", "wbr"}


class _Reader(HTMLParser):
    """Text outside noise. Open elements are kept on a stack; an end tag closes all that was opened since its start tag, so that elements left open (li, p) do no harm."""

    def __init__(self, inside: str | None):
        super().__init__(convert_charrefs=True)
        self.inside = inside
        self.open: list[tuple[str, bool]] = []  # tag, and whether it or one around it is noise
        self.text: list[str] = []
        self.title = ""
        self.date: str | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = dict(attrs)
        if tag == "meta" and (a.get("property") or a.get("name") or "").lower() in {"article:published_time", "date", "pubdate", "og:published_time"}:
            self.date = self.date or a.get("content")
        if tag == "time" and a.get("datetime"):
            self.date = self.date or a["datetime"]
        if tag in BREAKS:
            self.text.append("\n")
        if tag not in VOID:
            around = bool(self.open) and self.open[-1][1]
            self.open.append((tag, around or tag in NOISE or "ad" in (a.get("class") or "").split()))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        if tag in BREAKS:
            self.text.append("\n")
        if any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][0] == "title":
            self.title += data
        elif not (self.open and self.open[-1][1]) and (self.inside is None or any(t == self.inside for t, _ in self.open)):
            self.text.append(data)


def _read(html: str, inside: str | None) -> tuple[str, str, str | None]:
    reader = _Reader(inside)
    reader.feed(html)
    lines = (re.sub(r"\s+", " ", x).strip() for x in "".join(reader.text).split("\n"))
    date = re.search(r"\d{4}-\d{2}-\d{2}", reader.date or "")
    return "\n".join(x for x in lines if x), re.sub(r"\s+", " ", reader.title).strip(), date.group(0) if date else None


def extract(html: str, least: int = S.MIN_TEXT_CHARS) -> tuple[str | None, str | None, str | None]:
    """Text, title and date: the article alone first, the whole page where that is short; no text from pages of bot shields."""
    text, title, date = _read(html, "article")
    if len(text) < least:
        wide, title, date = _read(html, None)
        text = max(wide, text, key=len)
    if re.search("|".join(T.ANTIBOT), f"{title} {text[:1500]}", re.I):
        return None, title or None, date
    return text or None, title or None, date


def read_pages(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """url, text, title, publish_date of each page. A worker holds a small batch of pages, whatever the table's size."""
    small_batches(pages.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [extract(h) if h else (None, None, None) for h in part["html"]]
            yield pd.DataFrame({"url": part["url"], "text": [r[0] for r in rows], "title": [r[1] for r in rows], "publish_date": [r[2] for r in rows]})

    return pages.select(F.col(url).alias("url"), F.col(html).alias("html")).mapInPandas(run, "url string, text string, title string, publish_date string")


def fetch(urls: DataFrame, get: Callable[[str], bytes | None], url: str = "url") -> DataFrame:
    """url and html by the caller's function, a partition at a time; bytes are decoded by the page's own charset, else as UTF-8."""

    def decode(raw: bytes | None) -> str | None:
        if raw is None:
            return None
        named = re.search(rb"charset=[\"']?([\w-]+)", raw[:2000])
        for charset in (named.group(1).decode() if named and named.group(1).lower() not in (b"iso-8859-1", b"latin-1") else "utf-8", "utf-8"):
            try:
                return raw.decode(charset)
            except (LookupError, UnicodeDecodeError):
                continue
        return raw.decode("utf-8", "replace")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"url": part["url"], "html": [decode(get(u)) for u in part["url"]]})

    return urls.select(F.col(url).alias("url")).mapInPandas(run, "url string, html string")


def rescue(pages: DataFrame, *steps: DataFrame, least: int = S.MIN_TEXT_CHARS, url: str = "url") -> DataFrame:
    """pages (url, text) with short texts replaced by the first step's text that is long enough, and `rescued_by` (1 for the first step; 0: not needed; null: in vain)."""
    out = pages.select("*", F.when(F.char_length(F.coalesce("text", F.lit(""))) >= least, 0).alias("rescued_by"))
    for i, step in enumerate(steps, 1):
        out = out.join(step.select(url, F.col("text").alias("__t")), url, "left")
        use = F.col("rescued_by").isNull() & (F.char_length(F.coalesce("__t", F.lit(""))) >= least)
        out = out.withColumn("text", F.when(use, F.col("__t")).otherwise(F.col("text"))).withColumn("rescued_by", F.when(use, i).otherwise(F.col("rescued_by"))).drop("__t")
    return out


def sift(pages: DataFrame) -> DataFrame:
    """pages (url, text, title) with `verdict` of the rules: short, non_event, or null for those to be judged."""
    short = F.char_length(F.coalesce("text", F.lit(""))) < S.MIN_TEXT_CHARS
    return pages.withColumn("verdict", F.when(short, "short").when(T.is_non_event(F.col("url"), F.col("title"), F.col("text")), "non_event"))
