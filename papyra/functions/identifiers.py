"""Identifiers, years and version types found in texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What identifiers, years and lines that end a header look like, and the words that decide a version's type.
DOI = r"(?i)10\.\d{4,9}/[-._;()/:A-Z0-9]+"
NBER = r"(?i)NBER\s+Working\s+Paper\s+(?:No\.?\s*)?(\d{3,6})"
ARXIV = r"(?i)arXiv\s*:\s*([0-9]{4}\.[0-9]{4,5}(?:v\d+)?)"
REPEC = r"(?i)(RePEc:[A-Za-z0-9:_\-\.]+)"
SSRN_URL = r"(?i)(?:papers\.)?ssrn\.com/[^\s]*?(?:abstract_id=|abstract=)(\d{5,10})"
SSRN_TEXT = r"(?i)SSRN\s+(?:ID\s*)?(\d{5,10})"
SSRN_STEM = r"(?i)^ssrn[-_ ](\d{5,10})$"
YEAR_LABELLED = r"(?i)(?:published|publication|revised|revision|draft|date|copyright|©)\s*[:;,\-]?\s*((?:19|20)\d{2})"
YEAR_MONTH = r"(?i)(?:january|february|march|april|may|june|july|august|september|october|november|december)\s+((?:19|20)\d{2})"
WORKING_PAPER, PREPRINT, ANNOTATED = "working paper", "preprint", "annotated"
ANCHORS = ("first version:", "this version:", "latest version:", "revised:", "draft:")


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def normalized_doi(value: Column) -> Column:
    """A DOI in lower case without prefix and closing punctuation; null if it doesn't start with 10."""
    low = F.lower(F.trim(value))
    low = F.regexp_replace(low, r"^https://doi\.org/", "")
    low = F.regexp_replace(low, r"^http://doi\.org/", "")
    low = F.regexp_replace(low, r"^doi:", "")
    low = F.regexp_replace(low, r"^[ .,:;)\]}>\n\t]+|[ .,:;)\]}>\n\t]+$", "")
    return F.when(low.startswith("10."), low)


def extract_doi(text: Column) -> Column:
    return normalized_doi(_first(text, DOI, 0))


def extract_nber(text: Column) -> Column:
    return _first(text, NBER)


def extract_arxiv(text: Column) -> Column:
    return _first(text, ARXIV)


def extract_repec(text: Column) -> Column:
    return _first(text, REPEC)


def extract_ssrn(text: Column, stem: Column) -> Column:
    return F.coalesce(_first(text, SSRN_URL), _first(text, SSRN_TEXT), _first(stem, SSRN_STEM))


def publication_year(text: Column, this_year: int) -> Column:
    """The first labelled year, else the first after a month's name, from 1900 to next year; of 20,000 characters."""
    head = F.substring(text, 1, 20_000)
    valid = lambda y: F.when(y.between(1900, this_year + 1), y)
    return F.coalesce(*[valid(_first(head, p).cast("int")) for p in (YEAR_LABELLED, YEAR_MONTH)])


def version_type(text: Column, doi: Column, working_ids: Column, arxiv: Column) -> Column:
    """annotatedCopy, workingPaper, preprint, published or unknown, in this order; of 30,000 characters.

    ``working_ids`` is not null where an NBER or SSRN number is known.
    """
    head = F.lower(F.substring(F.coalesce(text, F.lit("")), 1, 30_000))
    working = working_ids.isNotNull() | head.contains(WORKING_PAPER)
    preprint = arxiv.isNotNull() | head.contains(PREPRINT)
    return F.when(head.contains(ANNOTATED), "annotatedCopy").when(working, "workingPaper").when(preprint, "preprint").when(doi.isNotNull(), "published").otherwise("unknown")


def identifier_key(kind: str, value: Column) -> Column:
    from papyra.functions.text import fold

    return F.when(F.trim(value) != "", F.concat(F.lit(f"{kind}:"), fold(F.trim(value))))


def is_placeholder_title(title: Column, stem: Column) -> Column:
    return (F.lower(title) == F.lower(stem)) | title.rlike(r"(?i)^ssrn[-_ ]\d+$")


def valid_workspace_id(value: Column) -> Column:
    return value.rlike(r"^[A-Za-z0-9-]{1,128}$")


def path_is_safe(path: Column, pdf_only: bool = False) -> Column:
    """Relative, without ~ and without empty, . or .. components."""
    bad = F.exists(F.split(path, "/"), lambda c: c.isin("", ".", ".."))
    safe = path.isNotNull() & (path != "") & ~path.startswith("/") & ~path.startswith("~") & ~bad
    return safe & F.lower(path).endswith(".pdf") if pdf_only else safe


def needs_path_normalization(path: Column, category: Column, year: Column, folder: Column, filename: Column) -> Column:
    parts = F.split(path, "/")
    return (F.size(parts) < 4) | (F.slice(parts, F.greatest(F.size(parts) - 3, F.lit(1)), 4) != F.array(category, year, folder, filename))


def _trimmed(value: Column) -> Column:
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def _once(value: Column, then) -> Column:
    """then(value), with the value made once: a column that others are built on is otherwise made again for each use, in a lambda for each element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def header_title_authors(page: Column, stem: Column | None = None) -> Column:
    """struct(title, authors) of a page's header: the lines above the first anchor line, or the first eight.

    An anchor is a line that is "abstract" or begins with a version label.  The last header line with a
    dagger, or that begins with "by ", is the authors; the first four of the others are the
    title, unless it is the file's stem.
    """
    lines = F.filter(F.transform(F.split(page, r"\r\n|[\n\r\x0B\x0C\u0085\u2028\u2029]"), _trimmed), lambda x: x != "")
    anchor = lambda x: F.lower(x).rlike("^(?:abstract$|" + "|".join(ANCHORS) + ")")
    names = lambda x: x.contains("†") | x.contains("‡") | F.lower(x).startswith("by ")
    first = lambda own: F.get(F.filter(F.transform(own, lambda x, i: F.when(anchor(x), i)), lambda i: i.isNotNull()), F.lit(0))
    last = lambda own: F.array_max(F.transform(own, lambda x, i: F.when(names(x), i)))
    cut = lambda own: F.slice(own, 1, F.coalesce(first(own), F.least(F.size(own), F.lit(8))))

    def found(head: Column, at: Column) -> Column:
        title = F.slice(F.filter(head, lambda x, i: at.isNull() | (i != at)), 1, 4)
        title = F.regexp_replace(F.array_join(title, " "), r"^[\s*]+|[\s*]+$", "")
        named = lambda t: (t != "") & (F.lit(True) if stem is None else ~F.coalesce(F.lower(t) == F.lower(stem), F.lit(False)))
        return F.struct(_once(title, lambda t: F.when(named(t), t)).alias("title"), _once(F.get(head, at), header_authors).alias("authors"))

    return _once(lines, lambda own: _once(cut(own), lambda head: _once(last(head), lambda at: found(head, at))))


def header_authors(line: Column) -> Column:
    """The names of an author line: those before a dagger or an asterisk, or else the whole line without "by"."""
    plain = F.regexp_replace(line, r"(?i)^by\s+", "")
    marked = F.filter(F.transform(F.regexp_extract_all(plain, F.lit("([^†‡*]+)[†‡*]"), 1), _trimmed), lambda x: x != "")
    cleaned = F.nullif(_trimmed(F.regexp_replace(plain, "[†‡*]", "")), F.lit(""))
    return F.when(F.size(marked) > 0, F.array_join(marked, "; ")).otherwise(cleaned)


def header_score(page: Column, title: Column, authors: Column) -> Column:
    """How much a page looks like a title page: 2 for a title, 4 for authors, and words of its first 10,000 characters."""
    low = F.lower(F.substring(page, 1, 10_000))
    has = lambda p, n: F.when(p, n).otherwise(0)
    named = low.contains("doi") | low.contains("ssrn") | low.contains("nber")
    return has(title.isNotNull(), 2) + has(authors.isNotNull(), 4) + has(low.contains("abstract"), 2) + has(low.contains("isbn"), 2) + has(named, 1)
