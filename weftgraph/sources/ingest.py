"""Pages, papers and posts as notes: fetched bodies become Markdown with a head that says where they are from.

Shaping is done by columns, for a table of fetched pages, and by add_url for one
address; the fetching itself is a function that is passed in, so that a cluster
without a way out, and tests, bring their own.
"""

from __future__ import annotations

import json
import re
import time
import urllib.request
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import text as T
from weftgraph.sources.guards import check_url

MAX_BINARY, MAX_TEXT, BODY = 50_000_000, 10_000_000, 12_000
Fetch = Callable[[str, int], bytes]


def fetch(url: str, most: int) -> bytes:
    """The body at a URL; each stop on the way is checked, and more than `most` bytes are an error."""

    class Checked(urllib.request.HTTPRedirectHandler):
        def redirect_request(self, req, fp, code, msg, headers, newurl):
            check_url(newurl)
            return super().redirect_request(req, fp, code, msg, headers, newurl)

    check_url(url)
    with urllib.request.build_opener(Checked).open(url, timeout=15) as r:
        body = r.read(most + 1)
    if len(body) > most:
        raise ValueError(f"{url} has more than {most} bytes")
    return body


def page_note(url: Column, html: Column, captured: Column, contributor: Column) -> Column:
    title = T.page_title(html, url)
    head = F.concat(F.lit('---\nsource_url: "'), T.yaml_quote(url), F.lit('"\ntype: webpage\ntitle: "'), T.yaml_quote(title), F.lit('"\ncaptured_at: '), captured, F.lit('\ncontributor: "'), T.yaml_quote(contributor), F.lit('"\n---\n\n'))
    return F.concat(head, F.lit("# "), title, F.lit("\n\nSource: "), url, F.lit("\n\n---\n\n"), F.substring(T.html_to_text(html), 1, BODY), F.lit("\n"))


def page_notes(pages: DataFrame, captured: str, contributor: str = "unknown") -> DataFrame:
    """(page_id, name, content): a note for each page (page_id, url, html)."""
    return pages.select("page_id", T.url_file_name(F.col("url"), ".md").alias("name"), page_note(F.col("url"), F.coalesce("html", F.lit("")), F.lit(captured), F.lit(contributor)).alias("content"))


def _quoted(x: str) -> str:
    return x.replace("\\", "\\\\").replace('"', '\\"').replace("\n", " ").replace("\r", " ")


def plain(html: str) -> str:
    return " ".join(re.sub(r"<[^>]+>", " ", html).split())


def _head(pairs: list[tuple[str, str]]) -> str:
    bare = ("type", "captured_at")
    return "---\n" + "".join(f"{k}: {v}\n" if k in bare else f'{k}: "{_quoted(v)}"\n' for k, v in pairs) + "---\n\n"


def post_note(url: str, reply: str | None, captured: str, contributor: str) -> str:
    """A post of a short-message service from its embedding record; one that couldn't be had is named as such."""
    try:
        data = json.loads(reply or "")
        said, author = plain(data.get("html") or ""), data.get("author_name") or "unknown"
    except (ValueError, AttributeError):
        said, author = f"Post at {url} (content couldn't be fetched)", "unknown"
    return _head([("source_url", url), ("type", "tweet"), ("author", author), ("captured_at", captured), ("contributor", contributor)]) + f"# Tweet by @{author}\n\n{said}\n\nSource: {url}\n"


def paper_note(url: str, paper: str, html: str, captured: str, contributor: str) -> str:
    def part(pattern: str) -> str:
        m = re.search(pattern, html, re.I | re.S)
        return plain(m[1]) if m else ""

    title, authors = part(r'class="title[^"]*"[^>]*>(.*?)</h1>') or paper, part(r'class="authors"[^>]*>(.*?)</div>')
    abstract = part(r'class="abstract[^"]*"[^>]*>(.*?)</blockquote>')
    head = _head([("source_url", url), ("arxiv_id", paper), ("type", "paper"), ("title", title), ("paper_authors", authors), ("captured_at", captured), ("contributor", contributor)])
    return head + f"# {title}\n\n**Authors:** {authors}\n**arXiv:** {paper}\n\n## Abstract\n\n{abstract}\n\nSource: {url}\n"


def web_note(url: str, html: str, captured: str, contributor: str) -> str:
    m = re.search(r"<title[^>]*>(.*?)</title>", html, re.I | re.S)
    title = " ".join(m[1].split()) if m and m[1].split() else url
    body = plain(re.sub(r"(?is)<(script|style)[^>]*>.*?</\1>", " ", html))[:8000]
    return _head([("source_url", url), ("type", "webpage"), ("title", title), ("captured_at", captured), ("contributor", contributor)]) + f"# {title}\n\nSource: {url}\n\n---\n\n{body[:BODY]}\n"


def kind_of(url: str) -> str:
    """The kind of a URL, tested as the column version tests it."""
    low = url.lower()
    path = re.sub(r"^[^/]*", "", low.split("://", 1)[-1])
    for kind, parts in (("tweet", ("twitter.com", "x.com")), ("arxiv", ("arxiv.org",)), ("github", ("github.com",)), ("youtube", ("youtube.com", "youtu.be"))):
        if any(p in low for p in parts):
            return kind
    if path.endswith(".pdf"):
        return "pdf"
    return "image" if path.endswith((".png", ".jpg", ".jpeg", ".webp", ".gif")) else "webpage"


def file_name(url: str, suffix: str) -> str:
    bare = re.sub(r"^[A-Za-z][A-Za-z0-9+.\-]*://", "", url)
    return re.sub(r"_+", "_", re.sub(r"[^\w\-]", "_", bare).strip("_"))[:80] + suffix


def free_name(folder: Path, name: str) -> Path:
    """The name, or the first of name_1, name_2 ... that isn't taken."""
    out, k = folder / name, 0
    while out.exists():
        k += 1
        out = folder / f"{Path(name).stem}_{k}{Path(name).suffix}"
    return out


def add_url(url: str, folder: str | Path, author: str | None = None, contributor: str | None = None, get: Fetch = fetch, captured: str | None = None, check: Callable = check_url) -> tuple[Path, str]:
    """(file, kind): what is at a URL, saved in a folder.  Sound and film need another program and are refused."""
    _, path = check(url)
    kind, folder = kind_of(url), Path(folder)
    who, when = contributor or author or "unknown", captured or time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
    folder.mkdir(parents=True, exist_ok=True)
    if kind == "youtube":
        raise NotImplementedError("sound is not downloaded here")
    if kind in ("pdf", "image"):
        out = free_name(folder, file_name(url, ".pdf" if kind == "pdf" else Path(path.split("?")[0]).suffix or ".jpg"))
        out.write_bytes(get(url, MAX_BINARY))
        return out, kind
    text = lambda u: get(u, MAX_TEXT).decode("utf-8", "replace")
    paper = re.search(r"([0-9]{4}\.[0-9]{4,5})", url) if kind == "arxiv" else None
    name = file_name(url, ".md")
    if kind == "tweet":
        try:
            reply = text("https://publish.twitter.com/oembed?omit_script=true&url=" + urllib.request.quote(url.replace("x.com", "twitter.com"), safe=""))
        except (OSError, ValueError):
            reply = None
        note = post_note(url, reply, when, who)
    elif paper:
        try:
            html = text(f"https://export.arxiv.org/abs/{paper[1]}")
        except (OSError, ValueError):
            html = ""
        note, name = paper_note(url, paper[1], html, when, who), f"arxiv_{paper[1].replace('.', '_')}.md"
    else:
        note = web_note(url, text(url), when, who)
    out = free_name(folder, name)
    out.write_text(note)
    return out, kind
