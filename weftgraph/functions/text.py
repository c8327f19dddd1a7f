"""Column builders for ids, labels, paths, pages and notes.

All of them are built-in expressions, so they stay inside code generation and
cost no Python.  A null in gives a null out unless the docstring says more.
Patterns use explicit classes, so that other engines read them alike.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"[ \t\n\x0B\f\r]+"


def slug(x: Column) -> Column:
    """Id form: runs of anything but ASCII letters and digits become one underscore; ends are trimmed; lower case last."""
    return F.lower(F.regexp_replace(F.regexp_replace(x, r"[^A-Za-z0-9]+", "_"), r"^_+|_+$", ""))


def sanitize_label(x: Column) -> Column:
    """Without ASCII control characters, 256 characters at most; null gives the empty text."""
    return F.substring(F.regexp_replace(F.coalesce(x, F.lit("")), r"[\x00-\x1f\x7f]", ""), 1, 256)


def note_name(x: Column) -> Column:
    """A file name for a note: no characters that file systems refuse, no Markdown ending, never empty."""
    flat = F.regexp_replace(F.regexp_replace(x, r"\r\n|\r|\n", " "), r'[\\/*?:"<>|#^\[\]]', "")
    name = F.regexp_replace(F.trim(flat), r"(?i)(\.md|\.mdx|\.markdown)$", "")
    return F.when(name == "", F.lit("unnamed")).otherwise(name)


def wiki_name(x: Column) -> Column:
    return F.translate(x, "/ :", "-_-")


def xml_escape(x: Column) -> Column:
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, x)


def html_escape(x: Column) -> Column:
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, x)


def script_safe(json: Column) -> Column:
    """JSON that may stand inside a script element: no tag can end there, no line separator splits a string."""
    pairs = (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029"))
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, json)


def percent_escape(x: Column) -> Column:
    """Bytes of UTF-8 as %XX, all but letters, digits and - _ . ~ (a form encoder differs on blanks, * and ~)."""
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), (("+", "%20"), ("*", "%2A"), ("%7E", "~")), F.url_encode(x))


def svg_escape(x: Column) -> Column:
    return F.replace(xml_escape(x), F.lit("&apos;"), F.lit("&#39;"))


def cypher_quote(x: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))


def cypher_key(x: Column) -> Column:
    key = F.regexp_replace(x, "[^A-Za-z0-9_]", "_")
    return F.when(key == "", F.lit("_prop")).when(key.rlike("^[0-9]"), F.concat(F.lit("_"), key)).otherwise(key)


def yaml_quote(x: Column) -> Column:
    return F.replace(F.replace(F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(" "))


def thousands(x: Column) -> Column:
    return F.format_number(x, 0)


def two_digits(x: Column) -> Column:
    """Rounded to two digits by x * 100, which all engines do alike."""
    return F.round(x * F.lit(100.0)) / F.lit(100.0)


def trim_float(x: Column) -> Column:
    """Two digits at most, without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.2f", x), "0+$", ""), r"\.$", "")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """The text after the last dot, lower case; the whole text if it has none."""
    return F.lower(F.substring_index(path, ".", -1))


def top_folder(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


_KINDS = {
    "code": "c cc cpp cs cxx dart ex exs go h hpp java jl js jsx kt kts lua m mjs mm php ps1 py rb rs scala sv svelte svh swift toc ts tsx v vue zig".split(),
    "paper": ["pdf"],
    "image": "gif jpeg jpg png svg webp".split(),
}


def file_category(path: Column) -> Column:
    """code, paper, image or doc, by the extension."""
    ext = extension(path)
    return reduce(lambda w, k: w.when(ext.isin(_KINDS[k]), F.lit(k)), list(_KINDS)[1:], F.when(ext.isin(_KINDS["code"]), F.lit("code"))).otherwise(F.lit("doc"))


CODE = sorted(set(_KINDS["code"]) - {"svh"} | {"ejs"})
VIDEO = "avi m4a m4v mkv mov mp3 mp4 ogg wav webm".split()
DOCUMENT, OFFICE = "html md mdx rst txt".split(), ["docx", "xlsx"]
ASSETS = r"\.(appiconset|colorset|imageset|launchimage|xcassets)(/|$)"

#: Marks of a scientific paper; three of them make one.
PAPER_SIGNALS = (
    r"\b(?i:arxiv)\b", r"\b(?i:doi)\s*:", r"\b(?i:abstract)\b", r"\b(?i:proceedings)\b", r"\b(?i:journal)\b", r"\b(?i:preprint)\b", r"\\cite\{",
    r"\[[0-9]+\]", r"\[\n[0-9]+\n\]", r"(?i:eq\.\s*[0-9]+|equation\s+[0-9]+)", r"[0-9]{4}\.[0-9]{4,5}", r"\b(?i:we propose)\b", r"\b(?i:literature)\b",
)


def paper_signals(text: Column) -> Column:
    """How many marks of a paper the first 3 000 characters hold (a classifier's header rule); 0 for null."""
    head = F.substring(F.coalesce(text, F.lit("")), 1, 3000)
    return reduce(lambda a, b: a + b, [head.rlike(p).cast("int") for p in PAPER_SIGNALS])


def file_type(path: Column, text: Column | None = None) -> Column:
    """code, document, paper, image or video; null for other files and for PDFs in asset catalogs."""
    name, ext = F.lower(basename(path)), F.regexp_extract(F.lower(basename(path)), r"[^.]\.([^.]+)$", 1)
    document = F.when(paper_signals(text) >= 3, F.lit("paper")).otherwise(F.lit("document")) if text is not None else F.lit("document")
    return (
        F.when(name.endswith(".blade.php") | ext.isin(CODE), F.lit("code"))
        .when(ext == "pdf", F.when(~F.lower(path).rlike(ASSETS), F.lit("paper")))
        .when(ext.isin(_KINDS["image"]), F.lit("image"))
        .when(ext.isin(DOCUMENT), document)
        .when(ext.isin(OFFICE), F.lit("document"))
        .when(ext.isin(VIDEO), F.lit("video"))
    )


_SECRETS = r"\.(env|envrc|p8|p12|pfx|pem|der|crt|cert|key|netrc|pgpass|htpasswd)|credential|secret|passw(d|ord)|token|private_key|id_(rsa|dsa|ecdsa|ed25519)|service\.account"
LOCKS = sorted(["Cargo.lock", "composer.lock", "Gemfile.lock", "go.sum", "go.work.sum", "package-lock.json", "pnpm-lock.yaml", "poetry.lock", "yarn.lock"])
NOISE = r"(^|/)(\.(eggs|env|git|mypy_cache|pytest_cache|ruff_cache|tox|venv)|__pycache__|build|dist|env|kg-out|lib64|node_modules|out|site-packages|target|venv|[^/]*_v?env|[^/]*\.egg-info)/"


def is_sensitive(path: Column) -> Column:
    """Whether any part of the path, folders included, hints at secrets."""
    return F.lower(path).rlike(_SECRETS)


def in_noise_folder(path: Column) -> Column:
    """Whether a folder of a relative path holds build results, packages or caches."""
    return path.rlike(NOISE)


def is_hidden(path: Column) -> Column:
    return path.rlike(r"(^|/)\.[^/]")


def is_lock_file(path: Column) -> Column:
    return basename(path).isin(LOCKS)


def word_count(text: Column) -> Column:
    """Words between white space; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(text, WHITE), lambda w: w != "")), F.lit(0))


def html_to_text(html: Column) -> Column:
    """Text of a page: scripts and styles go, tags become blanks, blanks collapse, 8 000 characters at most."""
    out = F.regexp_replace(F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", ""), r"(?is)<style[^>]*>.*?</style>", "")
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(out, r"<[^>]+>", " "), WHITE, " ")), 1, 8000)


def page_title(html: Column, url: Column) -> Column:
    """The title's text, or the URL if it has none."""
    found = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    title = F.trim(F.regexp_replace(found, WHITE, " "))
    return F.when(title == "", url).otherwise(title)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, lower case and without user or port, and the rest of the URL, query included."""
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    host = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, r"^([^/?#]*)", 1), r"^.*@", ""), r":[0-9]*$", ""))
    return host, F.regexp_extract(rest, r"^[^/?#]*(.*)$", 1)


def url_type(url: Column) -> Column:
    """tweet, arxiv, github, youtube, pdf, image or webpage; sites are found by text anywhere in the URL."""
    low = F.lower(url)
    path = F.lower(host_and_path(url)[1])
    return (
        F.when(low.contains("twitter.com") | low.contains("x.com"), F.lit("tweet"))
        .when(low.contains("arxiv.org"), F.lit("arxiv"))
        .when(low.contains("github.com"), F.lit("github"))
        .when(low.contains("youtube.com") | low.contains("youtu.be"), F.lit("youtube"))
        .when(path.endswith(".pdf"), F.lit("pdf"))
        .when(path.rlike(r"\.(png|jpe?g|webp|gif)$"), F.lit("image"))
        .otherwise(F.when(url.isNotNull(), F.lit("webpage")))
    )


def url_file_name(url: Column, suffix: str = "") -> Column:
    """A file name for a URL: 80 characters at most, ends trimmed before runs collapse."""
    name = F.concat(*host_and_path(url))
    name = F.regexp_replace(F.regexp_replace(name, r"(?U)[^\w\-]", "_"), r"^_+|_+$", "")
    return F.concat(F.substring(F.regexp_replace(name, "_+", "_"), 1, 80), F.lit(suffix))


def arxiv_id(url: Column) -> Column:
    return F.regexp_extract(url, r"([0-9]{4}\.[0-9]{4,5})", 1)


def github_repo(url: Column) -> Column:
    """owner/name of a repository's URL; the empty text if it is none."""
    return F.regexp_extract(url, r"github\.com[/:]([A-Za-z0-9_.\-]+/[A-Za-z0-9_\-]+(?:\.[A-Za-z0-9_\-]+)*?)(?:\.git)?/?$", 1)


def question_slug(x: Column) -> Column:
    """50 characters, each but ASCII letters, digits and underscores as an underscore; ends trimmed; never empty."""
    out = F.regexp_replace(F.lower(F.substring(F.regexp_replace(x, "[^A-Za-z0-9_]", "_"), 1, 50)), r"^_+|_+$", "")
    return F.when(out == "", F.lit("query")).otherwise(out)


def token_estimate(x: Column) -> Column:
    """A quarter of the bytes, 1 at least."""
    return F.greatest(F.lit(1).cast("bigint"), F.floor(F.octet_length(x) / F.lit(4)))


def content_hash(x: Column) -> Column:
    return F.sha2(x, 256)


def strip_front_matter(text: Column) -> Column:
    """Without a leading block between lines of three dashes."""
    return F.regexp_replace(text, r"^---\n(?s:.*?)\n---[ \t]*(\n|$)", "")


def preview(x: Column, most: int = 80) -> Column:
    """White space collapsed; beyond `most` characters cut, with an ellipsis."""
    flat = F.trim(F.regexp_replace(x, WHITE, " "))
    return F.when(F.length(flat) > most, F.concat(F.rtrim(F.substring(flat, 1, most - 1)), F.lit("…"))).otherwise(flat)


def heading_label(line: Column) -> Column:
    """The text of a Markdown heading of one to six signs; null if the line is none."""
    text = F.trim(F.regexp_extract(F.trim(line), r"^#{1,6}[ \t]+(.*)$", 1))
    return F.when(text != "", text)


def call_keys(callee: Column) -> Column:
    """Names under which a call may be known: the whole and what follows its last separators, without repeats."""

    def norm(x: Column) -> Column:
        out = F.regexp_replace(F.trim(x), r"!+$", "")
        return F.lower(F.regexp_replace(F.regexp_replace(out, r"^[()]+|[()]+$", ""), r"^\.+", ""))

    whole = F.trim(callee)
    tails = [F.when(whole.contains(s), F.substring_index(whole, s, -1)) for s in ("::", "->", ".", "/")]
    return F.array_distinct(F.filter(F.array(*[norm(k) for k in (whole, *tails)]), lambda k: k.isNotNull() & (k != "")))


def result_type(signature: Column) -> Column:
    """The last type named in a Rust return type, without keywords and wrappers' own names of Self; null if none is left."""
    words = F.filter(F.regexp_extract_all(signature, F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)), lambda w: ~w.isin("Self", "crate", "dyn", "impl", "mut", "self", "static", "super"))
    return F.when(F.size(words) > 0, F.element_at(words, -1))


def fenced_json(reply: Column) -> Column:
    """A model's reply without the code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(reply), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))


PALETTE = ["#1F5AA6", "#D9822B", "#B83A4B", "#3B8F8A", "#5E8C31", "#C9A227", "#7D4E9E", "#E27DA0", "#80613F", "#8A8F98"]


def colour(cid: Column) -> Column:
    """A colour of ten by community; nodes without one count as community 0."""
    return F.element_at(F.array(*map(F.lit, PALETTE)), (F.coalesce(cid, F.lit(0)) % 10 + 1).cast("int"))


def utc_stamp(seconds: Column) -> Column:
    """2024-03-01T12:00:00Z of seconds since 1970, whatever the session's zone is."""
    return F.date_format(_utc(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def utc_date(seconds: Column) -> Column:
    return F.date_format(_utc(seconds), "yyyy-MM-dd")


def utc_file_stamp(seconds: Column) -> Column:
    """20240301_120000, as it may stand in a file's name."""
    return F.date_format(_utc(seconds), "yyyyMMdd_HHmmss")


def _utc(seconds: Column) -> Column:
    day = F.floor(seconds / F.lit(86400)).cast("int")
    return F.date_add(F.lit("1970-01-01").cast("date"), day).cast("timestamp_ntz") + F.make_dt_interval(secs=F.pmod(seconds, F.lit(86400)))


def normal_path(path: Column) -> Column:
    """A path without `.` and with `..` taken back, as far as there is something to take; no file is looked at."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    empty = F.array().cast("array<string>")
    go = lambda acc, p: F.when((p == "..") & (F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("")), acc), -1) != ".."), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    return F.concat(F.when(path.startswith("/"), F.lit("/")).otherwise(F.lit("")), F.array_join(F.aggregate(parts, empty, go), "/"))


def resolve_import(file: Column, module: Column) -> Column:
    """The path that a relative import means from a file's folder, `.js` read as `.ts` and `.jsx` as `.tsx`; other modules keep their last part."""
    there = F.regexp_replace(F.regexp_replace(module, r"\.js$", ".ts"), r"\.jsx$", ".tsx")
    folder = F.when(file.contains("/"), F.regexp_replace(file, "/[^/]*$", "/")).otherwise(F.lit(""))
    return F.when(module.startswith("."), normal_path(F.concat(folder, there))).otherwise(F.substring_index(module, "/", -1))
