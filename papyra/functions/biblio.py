"""Bibliographic records: names, keys, file names, BibTeX fields and their comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyra.functions.identifiers import normalized_doi
from papyra.functions.text import MARKED, PLAIN, fold, jaccard, token_set

# Words that a citation key's title word skips.
TITLE_STOPWORDS = ("a", "an", "the", "of", "on", "in", "and", "for", "to", "from", "with", "by")
# How a LaTeX special is escaped.
LATEX = {"\\": r"\textbackslash{}", "{": r"\{", "}": r"\}", "$": r"\$", "&": r"\&", "%": r"\%", "#": r"\#", "_": r"\_", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}
# How types are called in file names and in what the library shows.
VERSION_LABELS = {"published": "正式发表版", "workingPaper": "工作论文", "acceptedManuscript": "录用稿", "preprint": "预印本", "supplement": "补充材料", "annotatedCopy": "带标注副本"}
DOCUMENT_TYPES = {"article": "article 期刊论文", "workingPaper": "working paper 工作论文", "book": "book 书籍", "bookChapter": "book chapter 书籍章节", "report": "report 研究报告", "thesis": "thesis 学位论文", "other": "other 其他"}
VERSION_TYPES = {"published": "published 发表版", "workingPaper": "working paper 工作论文", "acceptedManuscript": "accepted manuscript 录用稿", "preprint": "preprint 预印本", "supplement": "supplement 补充材料", "annotatedCopy": "annotated copy 批注副本"}


def split_authors(authors: Column) -> Column:
    """Authors at semicolons where there are any, else at ' and ' and ' & '."""
    at = F.when(authors.contains(";"), F.split(authors, ";")).otherwise(F.split(authors, r"\s+and\s+|\s+&\s+"))
    return F.filter(F.transform(at, lambda x: F.trim(x)), lambda a: a != "")


def surname(author: Column) -> Column:
    return F.when(author.contains(","), F.trim(F.split_part(author, F.lit(","), F.lit(1)))).otherwise(F.element_at(F.split(F.trim(author), r"\s+"), -1))


def author_year(authors: Column, year: Column, limit: int = 2) -> Column:
    """'A & B (2020)', 'A, B & C (2020)', 'A, B et al (2020)' beyond the limit; null without authors or year."""
    names = F.transform(split_authors(authors), surname)
    n = F.size(names)
    several = F.concat(F.array_join(F.slice(names, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(" & "), F.element_at(names, -1))
    text = F.when(n == 1, names[0]).when(n <= limit, several).otherwise(F.concat(F.array_join(F.slice(names, 1, limit), ", "), F.lit(" et al")))
    return F.when((n > 0) & year.isNotNull(), F.concat(text, F.lit(" ("), year.cast("string"), F.lit(")")))


def author_prefix(authors: Column) -> Column:
    names = F.transform(split_authors(F.coalesce(authors, F.lit(""))), surname)
    n = F.size(names)
    return F.when(n == 0, "Unknown Author").when(n == 1, F.get(names, F.lit(0))).when(n == 2, F.concat_ws(" & ", names)).otherwise(F.concat(F.get(names, F.lit(0)), F.lit(" et al.")))


def sanitized(value: Column, fallback: str, longest: int = 80) -> Column:
    """A path component: signs that file systems refuse become spaces, collapsed; dots trimmed; cut."""
    text = F.trim(F.regexp_replace(F.regexp_replace(value, r'[/\\:*?"<>|\x00-\x1F\x7F]', " "), r"\s+", " "))
    text = F.trim(F.substring(F.regexp_replace(text, r"^[. ]+|[. ]+$", ""), 1, longest))
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(fallback))


def archive_filename(title: Column, authors: Column, year: Column, confirmed: Column, original: Column, suffix: Column) -> Column:
    structured = F.concat(author_prefix(authors), F.lit(" - "), F.coalesce(year.cast("string"), F.lit("n.d.")), F.lit(" - "), sanitized(title, "Untitled", 120), suffix, F.lit(".pdf"))
    return F.when(confirmed, structured).otherwise(F.concat(sanitized(F.regexp_replace(original, r"(?i)\.pdf$", ""), "Untitled", 120), F.lit(".pdf")))


def _named(names: dict[str, str], raw: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[raw]


def version_label(raw: Column) -> Column:
    """A version's type as file names have it."""
    return F.coalesce(_named(VERSION_LABELS, raw), F.lit("其他版本"))


def document_type_name(raw: Column) -> Column:
    return F.coalesce(_named(DOCUMENT_TYPES, raw), raw, F.lit(""))


def version_type_name(raw: Column) -> Column:
    return F.coalesce(_named(VERSION_TYPES, raw), raw)


def identifier_notes(nber: Column, ssrn: Column, arxiv: Column, repec: Column) -> Column:
    """An array of 'NBER n', 'SSRN n', 'arXiv n', 'RePEc h' for the identifiers that are there, each on one line."""
    one = lambda label, c: F.when(F.coalesce(F.trim(c), F.lit("")) != "", F.concat(F.lit(label + " "), F.trim(F.regexp_replace(c, r"\s+", " "))))
    return F.array_compact(F.array(one("NBER", nber), one("SSRN", ssrn), one("arXiv", arxiv), one("RePEc", repec)))


def latin(value: Column) -> Column:
    """ASCII letters and digits only, marks folded, case kept."""
    both = F.translate(F.translate(value, MARKED, PLAIN), MARKED.upper(), PLAIN.upper())
    return F.regexp_replace(both, r"[^A-Za-z0-9]", "")


def citation_key(authors: Column, year: Column, title: Column) -> Column:
    """First surname, initials of the other surnames' authors, year, first title word that counts."""
    names = F.transform(split_authors(authors), lambda a: latin(surname(a)))
    initials = F.array_join(F.transform(F.slice(names, 2, F.greatest(F.size(names) - 1, F.lit(0))), lambda n: F.upper(F.substring(n, 1, 1))), "")
    words = F.filter(F.transform(F.split(title, r"[^\p{L}\p{N}]+"), latin), lambda w: (w != "") & ~F.lower(w).isin(*TITLE_STOPWORDS))
    return F.concat(F.get(names, F.lit(0)), initials, year.cast("string"), F.initcap(F.get(words, F.lit(0))))


def latex_escaped(value: Column) -> Column:
    """LaTeX specials escaped in one pass: each character is replaced once."""
    table = F.create_map(*[F.lit(x) for kv in LATEX.items() for x in kv])
    return F.array_join(F.transform(F.split(value, ""), lambda c: F.coalesce(table[c], c)), "")


def plain_text(value: Column) -> Column:
    """A BibTeX value without braces and TeX commands."""
    text = F.regexp_replace(value, r"\\[\"'`^~=.uvHcdbkr]\s*\{?([A-Za-z])\}?", "$1")
    text = F.regexp_replace(F.regexp_replace(text, r"\\([&%$#_{}])", "$1"), r"\\[A-Za-z]+\s*", "")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[{}]", ""), r"\s+", " "))


def entry_type(journal: Column, isbn: Column, nber: Column, ssrn: Column) -> Column:
    filled = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    return F.when(filled(journal), "article").when(filled(isbn), "book").when(filled(nber) | filled(ssrn), "techreport").otherwise("misc")


def bibtex_entry(key: Column, kind: Column, title: Column, authors: Column, year: Column, journal: Column, doi: Column) -> Column:
    """A rendered entry; null where a field that it cannot do without is missing (see entry_problem)."""
    field = lambda name, v: F.when(F.coalesce(F.trim(v), F.lit("")) != "", F.concat(F.lit(f"  {name} = {{"), latex_escaped(v), F.lit("}")))
    body = F.concat_ws(",\n", field("title", title), field("author", F.array_join(split_authors(authors), " and ")), field("year", year.cast("string")), field("journal", journal), field("doi", doi))
    return F.when(entry_problem(title, authors, year, kind, journal).isNull(), F.concat(F.lit("@"), kind, F.lit("{"), key, F.lit(",\n"), body, F.lit("\n}")))


def entry_problem(title: Column, authors: Column, year: Column, kind: Column, journal: Column) -> Column:
    """The first reason why no entry can be made, or null."""
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return F.when(empty(title), "missing title").when(empty(authors), "missing authors").when(year.isNull(), "missing year").when((kind == "article") & empty(journal), "missing journal")


def record_differences(local: dict[str, Column], online: dict[str, Column], same_title: float = 0.96) -> Column:
    """Fields that differ between two records: array of struct(field, local, online).

    Titles are equal from a token Jaccard of 0.96, authors by their surnames in order.  A
    value missing locally counts; blank online titles and authors don't, other missing
    online values count where the local one is there.
    """
    blank = lambda c: F.coalesce(F.trim(c.cast("string")), F.lit("")) == ""
    names = lambda c: F.transform(split_authors(c), lambda a: fold(surname(a)))
    folded = lambda c: fold(F.trim(c))
    tests = {
        "title": ~blank(online["title"]) & (blank(local["title"]) | (jaccard(token_set(local["title"]), token_set(online["title"])) < same_title)),
        "authors": ~blank(online["authors"]) & (blank(local["authors"]) | (names(local["authors"]) != names(online["authors"]))),
        "year": ~local["year"].eqNullSafe(online["year"]),
        "doi": ~normalized_doi(local["doi"]).eqNullSafe(normalized_doi(online["doi"])),
        "journal": ~F.nullif(folded(local["journal"]), F.lit("")).eqNullSafe(F.nullif(folded(online["journal"]), F.lit(""))),
    }
    one = lambda f: F.struct(F.lit(f).alias("field"), local[f].cast("string").alias("local"), online[f].cast("string").alias("online"))
    return F.filter(F.array(*[F.when(t, one(f)) for f, t in tests.items()]), lambda x: x.isNotNull())


def alphabetic_suffix(n: Column) -> Column:
    """0 -> '', 1 -> a ... 26 -> z, 27 -> aa ... 702 -> zz, 703 -> aaa ...: bijective base 26, of seven letters at most."""
    out = F.lit("")
    for size in range(1, 8):
        first = (26**size - 1) // 25  # the least number of so many letters
        out = F.when(n >= first, F.concat(*[F.char(F.lit(97) + F.floor((n - first) / 26**k) % 26) for k in reversed(range(size))])).otherwise(out)
    return out


def suffix_number(suffix: Column) -> Column:
    """The number whose alphabetic_suffix() this is; suffix has small letters only."""
    return F.aggregate(F.filter(F.split(suffix, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda n, c: n * 26 + F.ascii(c) - 96)
