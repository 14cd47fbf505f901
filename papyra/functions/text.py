"""Text columns: folding, terms, tokens, excerpts, page text, CJK bigrams."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters with marks and the letters they fold to.
MARKED = "áàâäãåāăąçćčďéèêëēėęěíìîïīįñńňóòôöõōőřśšťúùûüūůűýÿźżž"
PLAIN = "aaaaaaaaacccdeeeeeeeeiiiiiinnnooooooorsstuuuuuuuyyzzz"
#: Full-width forms, which lie at a fixed distance from ASCII.
WIDE = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))
NARROW = "".join(chr(c) for c in range(0x21, 0x7F))
DASHES = "–—"
QUOTES = {'"': '"', "“": "”", "”": "”"}


def fold(value: Column) -> Column:
    """Lower case, without marks, full-width forms made narrow; plain ASCII is only lower-cased."""
    # translate() looks every character up, so it is left out where none of its own occurs
    narrow = F.when(value.rlike(f"[{WIDE[0]}-{WIDE[-1]}]"), F.translate(value, WIDE, NARROW)).otherwise(value)
    return F.when(value.rlike(r"[^\x00-\x7F]"), F.translate(F.lower(narrow), MARKED, PLAIN)).otherwise(F.lower(value))


def normalize(value: Column) -> Column:
    """fold(), dashes as hyphens, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.translate(fold(value), DASHES, "-" * len(DASHES)), r"\s+", " "))


def tokens(value: Column, longer_than: int = 0) -> Column:
    """Folded runs of letters and digits with more than ``longer_than`` characters, in order."""
    return F.filter(F.split(fold(value), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) > longer_than)


def token_set(value: Column, longer_than: int = 0, without: tuple[str, ...] = ()) -> Column:
    own = F.array_distinct(tokens(value, longer_than))
    return F.array_except(own, F.array(*[F.lit(w) for w in without])) if without else own


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all members of two sets; 0 where either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return shared / F.greatest(F.size(a) + F.size(b) - shared, F.lit(1))


def plain_normalize(value: str) -> str:
    """normalize() of a Python string, for query literals."""
    table = str.maketrans(WIDE + MARKED + DASHES, NARROW + PLAIN + "-" * len(DASHES))
    return " ".join(value.translate(table).lower().translate(table).split())


def query_terms(query: str) -> list[str]:
    """White-space terms of a query; a quoted run, straight or curly, is one term.  Repeats stay."""
    found = re.findall(r'"([^"]*)"|“([^”]*)”|([^\s"“]+)', query)
    return [t for t in (plain_normalize("".join(groups)) for groups in found) if t]


def phrase_of(query: str) -> str:
    """The query as one phrase: outer quotes and white space trimmed."""
    return plain_normalize(query.strip().strip('"“”'))


def scoring_terms(query: str, mode: str) -> list[str]:
    phrase = phrase_of(query)
    return ([phrase] if phrase else []) if mode == "exactPhrase" else query_terms(query)


def cjk_bigrams(value: Column) -> Column:
    """Neighbouring pairs of all CJK characters (U+3400 to U+9FFF), joined across gaps; a single one alone."""
    own = F.filter(F.split(F.regexp_replace(value, r"[^\u3400-\u9FFF]", ""), ""), lambda c: c != "")
    n = F.size(own)
    pairs = F.zip_with(F.slice(own, 1, F.greatest(n - 1, F.lit(0))), F.slice(own, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, b))
    return F.when(n <= 1, own).otherwise(pairs)


def searchable(value: Column) -> Column:
    """Folded text followed by its CJK bigrams."""
    return F.concat_ws(" ", F.array(normalize(value)), cjk_bigrams(value))


def index_tokens(value: Column) -> Column:
    """The tokens of searchable(): those of the text, then its CJK bigrams, looked for only where there is such a character."""
    pairs = F.when(value.rlike(r"[\u3400-\u9FFF]"), cjk_bigrams(value)).otherwise(F.array().cast("array<string>"))
    return F.concat(tokens(value, 0), pairs)


def page_text(value: Column) -> Column:
    """Unix line ends, words hyphenated over a line end joined, lines trimmed, one pass of blank-line collapsing."""
    text = F.regexp_replace(value, "\r\n?", "\n")
    text = F.replace(text, F.lit("-\n"), F.lit(""))
    text = F.array_join(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), "\n")
    return F.trim(F.replace(text, F.lit("\n\n\n"), F.lit("\n\n")))


def excerpt(value: Column, terms: list[str], limit: int = 240) -> Column:
    """At most ``limit`` characters around the first term of the list that occurs, with … on cut sides."""
    text = F.trim(F.regexp_replace(value, r"\s+", " "))
    low = fold(text)
    at = F.coalesce(*[F.nullif(F.instr(low, t), F.lit(0)) for t in terms], F.lit(1)) - 1 if terms else F.lit(0)
    start = F.greatest(F.lit(0), F.least(at - limit // 3, F.length(text) - limit))
    cut = F.concat(F.when(start > 0, "…").otherwise(""), F.substring(text, start + 1, F.lit(limit)), F.when(start + limit < F.length(text), "…").otherwise(""))
    return F.when(F.length(text) <= limit, text).otherwise(cut)


def strip_markup(value: Column) -> Column:
    """A title or abstract without superscripts and tags, white space collapsed."""
    text = F.regexp_replace(value, r"(?is)<sup\b[^>]*>.*?</sup>", "")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", " "), r"\s+", " "))


def tag_names(values: Column, longest: int = 48, most: int = 8) -> Column:
    """Names collapsed, trimmed, cut, without case-insensitive repeats (the first stays), ``most`` at most."""
    clean = F.filter(F.transform(values, lambda v: F.substring(F.trim(F.regexp_replace(v, r"\s+", " ")), 1, longest)), lambda v: v != "")
    first = F.filter(clean, lambda v, i: F.array_position(F.transform(clean, F.lower), F.lower(v)) == i + 1)
    return F.slice(first, 1, most)


def palette_index(name: Column, colours: int = 6) -> Column:
    """(hash * 31 + code point) & 0x7fffffff over the characters, modulo ``colours``."""
    codes = F.transform(F.filter(F.split(name, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 31 + c).bitwiseAND(0x7FFFFFFF)) % colours


def edit_issue_notes(notes: Column, note: str, add: bool) -> Column:
    """A ；-separated list with ``note`` appended (once) or removed."""
    own = F.filter(F.transform(F.split(F.coalesce(notes, F.lit("")), "；"), lambda x: F.trim(x)), lambda x: (x != "") & (x != note))
    own = F.array_append(own, F.lit(note)) if add else own
    return F.array_join(own, "；")


def natural_key(value: Column) -> Column:
    """A sort key in the order that people expect: letters by their folded form, runs of digits by their number.

    Digits sort before letters, as their code points do; equal keys are the caller's to tell apart.
    """
    runs = F.regexp_extract_all(fold(F.coalesce(value, F.lit(""))), F.lit(r"(\d+|\D+)"), F.lit(1))
    number = lambda r: F.regexp_replace(r, "^0+(?=.)", "")
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), F.concat(F.lpad(F.length(number(r)).cast("string"), 3, "0"), number(r))).otherwise(r)), "")


def natural_tags(values: Column) -> Column:
    """Names collapsed and trimmed, without case-insensitive repeats (the first stays), in natural order."""
    clean = F.filter(F.transform(values, lambda v: F.trim(F.regexp_replace(v, r"\s+", " "))), lambda v: v != "")
    first = F.filter(clean, lambda v, i: F.array_position(F.transform(clean, F.lower), F.lower(v)) == i + 1)
    return F.transform(F.array_sort(F.transform(first, lambda v: F.struct(natural_key(v).alias("k"), v.alias("v")))), lambda x: x["v"])
