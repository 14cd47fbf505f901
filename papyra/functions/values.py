"""Money, dates, nested values, outlines and small state rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyra.functions.identifiers import normalized_doi
from papyra.functions.text import tokens

MILLION = 1_000_000.0


def card_cost(input_tokens: Column, output_tokens: Column, input_rate: float, output_rate: float) -> Column:
    """Dollars for tokens at rates per million."""
    return input_tokens / MILLION * input_rate + output_tokens / MILLION * output_rate


def billed_output(candidates: Column, total: Column, prompt: Column) -> Column:
    zero = F.lit(0)
    return F.greatest(F.coalesce(candidates, zero), F.coalesce(total, zero) - F.coalesce(prompt, zero))


def largest_cost(input_tokens: Column, input_rate: float, output_rate: float, output_tokens: int = 8192) -> Column:
    return card_cost(input_tokens, F.lit(output_tokens), input_rate, output_rate)


def note_cost(input_tokens: Column, cached: Column, output_tokens: Column, storage_hours: Column, rates: dict[str, tuple[float, float, float]], source: Column, large_from: int = 200_000, storage_rate: float = 4.5) -> Column:
    """Tiered cost: rates has (input, cached input, output) per million for lite, regular and large.

    Inputs above ``large_from`` tokens pay the large tier; cached tokens are clamped to the input.
    """
    cached = F.greatest(F.lit(0), F.least(cached, input_tokens))
    price = lambda r: ((input_tokens - cached) * r[0] + cached * r[1] + output_tokens * r[2]) / MILLION
    tier = F.when(source == "lite", price(rates["lite"])).when(input_tokens > large_from, price(rates["large"])).otherwise(price(rates["regular"]))
    return tier + storage_hours * storage_rate / MILLION


def within_budget(spent: Column, budget: Column) -> Column:
    return (budget <= 0) | (spent < budget)


def evidence_pages(pages: Column, n: Column) -> Column:
    """Pages from 1 to n, without repeats, sorted."""
    return F.array_sort(F.array_distinct(F.filter(pages, lambda p: p.between(1, n))))


def has_invalid_pages(pages: Column, n: Column) -> Column:
    return F.exists(pages, lambda p: (p < 1) | (p > n))


def explicit_value(value: Column, status: Column, confidence: Column) -> Column:
    text = F.trim(value)
    return F.when((status == "explicit") & (confidence >= 0.8) & ~F.lower(text).isin("", "unknown"), text)


def latest_year(parts: Column) -> Column:
    """Year of a nested date: date-parts[0][0]."""
    return F.get(F.get(parts, F.lit(0)), F.lit(0))


def author_list(authors: Column) -> Column:
    """array<struct<given, family>> as 'given family; given family'."""
    return F.array_join(F.transform(authors, lambda a: F.concat_ws(" ", a["given"], a["family"])), "; ")


def set_priority(json: Column, key: Column, value: Column, ranks: tuple[int, int] = (1, 4)) -> Column:
    """A JSON map of priorities with one key set; a null value removes it, invalid values are dropped."""
    own = F.coalesce(F.from_json(json, "map<string,int>"), F.create_map().cast("map<string,int>"))
    rest = F.map_filter(own, lambda k, v: (k != key) & v.between(*ranks))
    return F.when(value.isNull(), rest).otherwise(F.map_concat(rest, F.create_map(key, value)))


def merged_priority(a: Column, b: Column) -> Column:
    """Completed dominates; else the higher rank."""
    return F.when((a == "completed") | (b == "completed"), "completed").when(priority_rank(a) >= priority_rank(b), a).otherwise(b)


def priority_rank(p: Column) -> Column:
    return F.when(p == "three", 3).when(p == "two", 2).when(p == "one", 1).when(p == "completed", -1).otherwise(0)


def part_count(outline: Column) -> Column:
    """Parts of an outline whose level-1 headings are numbered exactly 1 to n; else null."""
    heads = F.regexp_extract_all(outline, F.lit(r"(?m)^#\s+Part\s+(\d+)\b"), 1)
    items = F.regexp_extract_all(outline, F.lit(r"(?m)^\s*(\d+)[.)]\s+\S"), 1)
    found = F.transform(F.when(F.size(heads) > 0, heads).otherwise(items), lambda x: x.cast("int"))
    n = F.size(found)
    return F.when((n > 0) & (F.array_sort(F.array_distinct(found)) == F.sequence(F.lit(1), F.greatest(n, F.lit(1)))), n)


def is_valid_part(text: Column, number: Column) -> Column:
    """Exactly one level-1 heading, which has the part's number."""
    heads = F.regexp_extract_all(text, F.lit(r"(?m)^#\s+(.*)$"), 1)
    return (F.size(heads) == 1) & (F.regexp_extract(F.get(heads, F.lit(0)), r"(\d+)", 1) == number.cast("string"))


def part_count_reply(reply: Column) -> Column:
    """A reply that is a whole number from 1 to 99; else null."""
    n = F.trim(reply).try_cast("int")
    return F.when(F.trim(reply).rlike(r"^\d+$") & n.between(1, 99), n)


def minmax(value: Column, over) -> Column:
    """(v - min) / (max - min) over a window; 1 where the range is nil."""
    low, high = F.min(value).over(over), F.max(value).over(over)
    return F.when(high - low <= 2.220446049250313e-16, F.lit(1.0)).otherwise((value - low) / (high - low))


def simhash_similarity(a: Column, b: Column) -> Column:
    """1 - hamming / 64 of two 16-digit hex strings; 0 where one is none."""
    ok = a.rlike("^[0-9a-fA-F]{16}$") & b.rlike("^[0-9a-fA-F]{16}$")
    number = lambda h, k: F.conv(F.substring(h, 1 + 8 * k, 8), 16, 10).cast("long")
    bits = sum(F.bit_count(number(a, k).bitwiseXOR(number(b, k))) for k in (0, 1))
    return F.when(ok, 1 - bits / 64).otherwise(F.lit(0.0))


def page_description(first: Column, last: Column) -> Column:
    return F.when(first == last, F.format_string("第 %d 页", first)).otherwise(F.format_string("第 %d–%d 页", first, last))


def strength_schedule(steps: Column, start: int = 1, most: int = 5, every: int = 3) -> Column:
    """The strength after each successful part of an ordered array of strengths used.

    ``every`` successes at the current strength raise it by one, up to ``most``; a step with a
    greater strength jumps there and counts anew.
    """
    state = lambda s, n: F.struct(s.alias("strength"), n.alias("run"))

    def step(acc: Column, used: Column) -> Column:
        jumped = used > acc["strength"]
        run = F.when(jumped, F.lit(1)).otherwise(acc["run"] + 1)
        base = F.greatest(acc["strength"], used)
        up = (run >= every) & (base < most)
        return state(F.when(up, base + 1).otherwise(base), F.when(up, F.lit(0)).otherwise(run))

    return F.aggregate(steps, state(F.lit(start), F.lit(0)), step)["strength"]


def clamped(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def fraction_completed(done: Column, total: Column) -> Column:
    return F.when(total > 0, clamped(done / total, 0.0, 1.0)).otherwise(F.lit(0.0))


def evidence_fields(*fields: Column) -> Column:
    """The present ones of a record's evidence fields."""
    return F.array_compact(F.array(*fields))


def only_pages_differ(original: Column, corrected: Column) -> Column:
    """Whether two records, maps of field -> struct(value, status, confidence, pages, evidence), differ in pages alone."""
    rest = lambda m: F.array_sort(F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("key"), e["value"]["value"].alias("v"), e["value"]["status"].alias("s"), e["value"]["confidence"].alias("c"), e["value"]["evidence"].alias("e"))))
    pages = lambda m: F.array_sort(F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("key"), e["value"]["pages"].alias("p"))))
    return (rest(original) == rest(corrected)) & (pages(original) != pages(corrected))


def chosen_correction(original: Column, corrected: Column, n: Column) -> Column:
    """The corrected record where it differs in pages alone and all its pages exist; else the original."""
    valid = ~F.exists(F.map_values(corrected), lambda f: F.coalesce(has_invalid_pages(f["pages"], n), F.lit(False)))
    return F.when(corrected.isNotNull() & only_pages_differ(original, corrected) & valid, corrected).otherwise(original)


def long_document(pages: Column, threshold: int = 200, policy: str = "excerpt", excerpt: int = 60) -> Column:
    """struct(skip, page_limit) for a document of so many pages: beyond the threshold it is skipped, or only its first pages are read."""
    long = pages > (threshold if threshold > 0 else 200)
    limit = F.when(long & F.lit(policy != "skip"), F.lit(excerpt if excerpt > 0 else 60))
    return F.struct((long & F.lit(policy == "skip")).alias("skip"), limit.alias("page_limit"))


def crossref_checked(verified: Column, doi: Column, source: Column) -> Column:
    """Whether the current DOI is the verified one; where either is missing, whether the metadata came from Crossref."""
    a, b = normalized_doi(verified), normalized_doi(doi)
    return F.coalesce(a == b, F.lower(source) == "crossref")


def metrics_match(asked_doi: Column, asked_journal: Column, doi: Column, journal: Column) -> Column:
    """Whether journal metrics that were asked for still belong to a record: by DOI, or by journal name where none was asked for."""
    name = lambda c: F.array_join(F.filter(tokens(F.coalesce(c, F.lit(""))), lambda t: t != ""), " ")
    return F.when(asked_doi.isNotNull(), F.coalesce(normalized_doi(doi) == asked_doi, F.lit(False))).otherwise(F.coalesce(name(journal) == name(asked_journal), F.lit(False)) & asked_journal.isNotNull())


#: Smart lists without an id, and those that carry one.
SMART_LISTS = ("all", "needsReview", "possibleDuplicates", "aiQueue", "recent", "multipleVersions", "missingDOI", "unanalyzed")
KEYED_LISTS = ("category", "project")


def smart_list_value(kind: Column, key: Column) -> Column:
    """The stored form of a smart list: its name, or category:<id> and project:<id>."""
    return F.when(kind.isin(*KEYED_LISTS), F.concat(kind, F.lit(":"), F.upper(key))).otherwise(kind)


def smart_list_of(value: Column) -> Column:
    """struct(kind, key) of a stored form; null where it names no list or carries no UUID."""
    kind, key = F.split_part(value, F.lit(":"), F.lit(1)), F.substr(value, F.instr(value, ":") + 1)
    keyed = kind.isin(*KEYED_LISTS) & value.contains(":") & key.rlike("^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$")
    return F.when(value.isin(*SMART_LISTS), F.struct(value.alias("kind"), F.lit(None).cast("string").alias("key"))).when(keyed, F.struct(kind.alias("kind"), F.upper(key).alias("key")))
