"""Text functions as Column expressions: nothing here leaves the JVM."""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
BODY_STOP_PHRASES = ["next steps", "market report", "weekly review", "morning reflection", "team 1 1s"]
LISTING_PREFIXES = [
    "Session ",
    "Workshop ",
    "Lead Story ",
    "Item ",
    "Brief ",
    "Editor's Pick ",
    "Episode ",
    "New Release ",
    "Vendor ",
    "Candidate ",
    "Result ",
    "Listing ",
]
ALIAS_MIN_CHARS, ALIAS_MIN_WORDS = 8, 2


@cache
def case_folds() -> dict[str, str]:
    """Every code point that case folding changes and what it becomes, from the Unicode data of this Python."""
    every = (chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    return {c: folded for c in every if (folded := c.casefold()) != c}


def _character_class(chars: list[str]) -> str:
    """A regular expression for any of the characters, as ranges."""
    points = sorted(map(ord, chars))
    cuts = [i for i, p in enumerate(points) if i == 0 or p != points[i - 1] + 1]
    spans = zip(cuts, [*cuts[1:], len(points)])
    return "[" + "".join(rf"\x{{{points[i]:x}}}-\x{{{points[j - 1]:x}}}" for i, j in spans) + "]"


def _replaced(text: Column, folds: dict[str, str]) -> Column:
    for old, new in folds.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def casefold(text: Column) -> Column:
    """Full case folding, as of str.casefold: one pass maps code points to one other, and only texts
    that hold a character which becomes several (other than the sharp s) pass through those."""
    folds = case_folds()
    one = {c: f for c, f in folds.items() if len(f) == 1}
    many = {c: f for c, f in folds.items() if len(f) > 1 and c != "ß"}
    out = F.replace(F.translate(text, "".join(one), "".join(one.values())), F.lit("ß"), F.lit("ss"))
    out = F.when(text.rlike(_character_class(list(many))), _replaced(out, many)).otherwise(out)
    return F.when(text.rlike(r"[^\x00-\x7f]"), out).otherwise(F.lower(text))


@cache
def _alphanumeric_folds() -> dict[str, str]:
    """What lower() leaves out of the folds that hold a letter a-z or a digit."""
    return {c: f for c, f in case_folds().items() if not c.isascii() and c.lower() != f and re.search("[a-z0-9]", f)}


def folded_for_tokens(text: Column) -> Column:
    """Folded so far as a-z and 0-9 go, which costs no more than lower() for most texts. Null: empty."""
    folds = _alphanumeric_folds()
    text = F.coalesce(text, F.lit(""))
    low = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    return F.when(text.rlike(_character_class([c for c in folds if c != "ß"])), _replaced(low, folds)).otherwise(low)


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 after case folding; other letters separate. Null: no tokens."""
    return F.regexp_extract_all(folded_for_tokens(text), F.lit("[a-z0-9]+"), F.lit(0))


def normalize_query(text: Column) -> Column:
    return F.trim(F.regexp_replace(casefold(text), r"(?U)\s+", " "))


def normalize_surface(text: Column) -> Column:
    """Tokens joined by spaces; empty below two characters."""
    joined = F.trim(F.regexp_replace(folded_for_tokens(text), "[^a-z0-9]+", " "))
    return F.when(F.length(joined) >= 2, joined).otherwise("")


def contains_phrase(normalized_text: Column, normalized_phrase: Column) -> Column:
    padded = F.concat(F.lit(" "), normalized_text, F.lit(" "))
    return (normalized_phrase != "") & F.contains(padded, F.concat(F.lit(" "), normalized_phrase, F.lit(" ")))


def slug_tail(slug: Column) -> Column:
    return F.translate(F.element_at(F.split(slug, "/"), -1), "-_", "  ")


def title_slug_surfaces(title: Column, slug: Column) -> Column:
    return F.array_distinct(F.array(title, slug_tail(slug)))


def keep_body_surface(surface: Column) -> Column:
    """2 to 6 tokens, no stop phrase, and a digit or a word that starts upper-case."""
    normalized = F.array_join(tokens(surface), " ")
    size = F.size(tokens(surface))
    return size.between(2, 6) & ~normalized.isin(BODY_STOP_PHRASES) & (normalized.rlike("[0-9]") | surface.rlike(r"(?U)(^|\s)\p{Lu}"))


def normalize_choice(text: Column) -> Column:
    """Letters and digits case-folded, everything else one space."""
    return F.trim(F.regexp_replace(casefold(text), r"[^\p{L}\p{N}]+", " "))


def choice_aliases(choice: Column) -> Column:
    """The full label; a descriptive title after the first spaced dash; a locator with a digit before it."""
    full = normalize_choice(choice)
    parts = F.split(choice, r"(?U)\s+[—–-]\s+", 2)
    locator, title = normalize_choice(F.element_at(parts, 1)), normalize_choice(F.try_element_at(parts, F.lit(2)))
    two = F.size(parts) == 2
    by_title = F.when(two & (F.length(title) >= ALIAS_MIN_CHARS) & (F.size(F.split(title, " ")) >= ALIAS_MIN_WORDS), title)
    by_locator = F.when(two & locator.rlike(r"\p{Nd}"), locator)
    return F.array_distinct(F.filter(F.array(full, by_title, by_locator), lambda a: a.isNotNull()))


def matches_choice(response: Column, choice: Column) -> Column:
    padded = F.concat(F.lit(" "), normalize_choice(response), F.lit(" "))
    return F.exists(choice_aliases(choice), lambda alias: F.contains(padded, F.concat(F.lit(" "), alias, F.lit(" "))))


def render_context(texts: Column) -> Column:
    """'1. text' blocks separated by a blank line."""
    return F.array_join(F.transform(texts, lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), t)), "\n\n")


def render_input(prompt: Column, kind: Column, observation: Column, memory: Column) -> Column:
    """The sections a model sees; absent ones are left out, the task never is."""

    def section(head: Column, body: Column) -> Column:
        return F.when(F.coalesce(body, F.lit("")) != "", F.concat(head, F.lit(":\n"), body))

    return F.concat_ws(
        "\n\n",
        F.concat(F.lit("Task:\n"), F.coalesce(prompt, F.lit(""))),
        section(F.concat(F.lit("Observed "), F.replace(kind, F.lit("_"), F.lit(" "))), observation),
        section(F.lit("Retrieved personal memory"), memory),
    )


def fold_replacements(text: Column, replacements: Column) -> Column:
    """Replace the first occurrence of each ``old`` in turn; null as soon as one is absent."""

    def step(acc: Column, r: Column) -> Column:
        at = F.instr(acc, r["old"])
        return F.when(at > 0, F.concat(F.substring(acc, F.lit(1), at - 1), r["new"], F.substring(acc, at + F.length(r["old"]), F.length(acc))))

    return F.aggregate(replacements, text, step)


def count_occurrences(text: Column, phrase: Column) -> Column:
    """Non-overlapping occurrences after case folding; 0 for an empty phrase."""
    t, p = casefold(text), casefold(phrase)
    return F.when(F.length(p) > 0, ((F.length(t) - F.length(F.replace(t, p, F.lit("")))) / F.length(p)).cast("int")).otherwise(0)


def listing_labels(text: Column) -> Column:
    """Text before the first full stop of every line with a listing prefix."""
    pattern = "^(" + "|".join(LISTING_PREFIXES) + ")"
    return F.transform(F.filter(F.split(text, "\r\n|\n|\r"), lambda line: line.rlike(pattern)), lambda line: F.trim(F.substring_index(line, ".", 1)))


def lf_sha256(text: Column) -> Column:
    return F.sha2(F.replace(text, F.lit("\r\n"), F.lit("\n")), 256)


# Collections that stand for others, and the page types of collections.
SLUG_PREFIXES = {
    "company": "companies",
    "doc": "source",
    "docs": "source",
    "events": "concepts",
    "fund": "deal",
    "org": "companies",
    "organizations": "companies",
    "orgs": "companies",
    "person": "people",
    "processes": "concepts",
    "tool": "concepts",
    "tools": "concepts",
    "user": "people",
}
SLUG_TYPES = {"companies": "company", "concepts": "concept", "deal": "deal", "entities": "concept", "people": "person", "source": "source"}


def mapped(value: Column, table: dict[str, str]) -> Column:
    """The table's value, or null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), value)


def canonical_slug(slug: Column, prefixes: dict[str, str] | None = None) -> Column:
    """Map the first path segment; slugs without a known one stay."""
    head = F.substring_index(slug, "/", 1)
    tail = F.substring(slug, F.length(head) + 1, F.length(slug))
    return F.when(F.contains(slug, F.lit("/")), F.concat(F.coalesce(mapped(head, prefixes or SLUG_PREFIXES), head), tail)).otherwise(slug)


def canonical_source_id(source_id: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(source_id, "^notes/", "note/"), "^meetings/", "meeting/")


# Links to pages, and the line that lists attendees.
LINK_PATTERN = r"\[([^\]]+)\]\(([a-z][a-z0-9_-]*/[a-z0-9][a-z0-9/-]*)\)"
ATTENDEES_PATTERN = r"(?m)^(attendees\s*:\s*)(.+)$"
USER_PATTERN = r"\buser/([a-z0-9][a-z0-9/-]*)"


def markdown_links(text: Column) -> Column:
    """(label, slug) of every [label](collection/name) link."""
    parts = [F.regexp_extract_all(text, F.lit(LINK_PATTERN), F.lit(i)) for i in (1, 2)]
    return F.transform(F.arrays_zip(parts[0].alias("a"), parts[1].alias("b")), lambda x: F.struct(x["a"].alias("label"), x["b"].alias("slug")))


def rewrite_links(text: Column, prefixes: dict[str, str] | None = None) -> Column:
    """Canonical collections inside Markdown links, and people on the attendees line."""
    out = text
    for old, new in (prefixes or SLUG_PREFIXES).items():
        out = F.regexp_replace(out, rf"(\[[^\]]+\]\(){old}(/[a-z0-9][a-z0-9/-]*\))", rf"$1{new}$2")
    found = F.regexp_extract_all(out, F.lit(ATTENDEES_PATTERN), F.lit(0))
    return F.aggregate(F.array_distinct(found), out, lambda acc, line: F.replace(acc, line, F.regexp_replace(line, USER_PATTERN, "people/$1")))


def upsert_frontmatter(text: Column, key: str, value: Column) -> Column:
    """Add ``key`` if absent; make a block if there is none; leave an unterminated one."""
    entry = F.concat(F.lit(f"{key}: "), value, F.lit("\n"))
    closes = F.locate("\n---", text, 5)
    has = F.substring(text, F.lit(5), closes - 5).rlike(rf"(?m)^{key}\s*:")
    added = F.concat(F.lit("---\n"), entry, F.substring(text, F.lit(5), F.length(text)))
    return F.when(~text.startswith("---\n"), F.concat(F.lit("---\n"), entry, F.lit("---\n"), text)).when((closes == 0) | has, text).otherwise(added)


def case_label(base_case_id: Column, variant: Column, prefixes: tuple[str, ...] = ()) -> Column:
    """Subject and variant of a case; the first of ``prefixes`` that the id starts with is left out."""
    base = base_case_id
    for prefix in reversed(prefixes):
        base = F.when(base_case_id.startswith(prefix), F.substring(base_case_id, F.lit(len(prefix) + 1), F.length(base_case_id))).otherwise(base)
    subject = F.replace(F.initcap(F.replace(base, F.lit("-"), F.lit(" "))), F.lit("Ai "), F.lit("AI "))
    shown = F.when(variant == "positive", "Cue present").when(variant == "memory-included", "Memory included").otherwise("Cue ablated")
    return F.concat(subject, F.lit(" — "), shown)


def coarse_correct(response: Column, output_choice: Column, memory_choice: Column, control: Column) -> Column:
    """Plain case-folded containment, without aliases."""
    low = casefold(response)
    has_memory, has_output = F.contains(low, casefold(memory_choice)), F.contains(low, casefold(output_choice))
    return F.when(control, has_output).otherwise(has_memory & ~has_output)


def run_name(file: Column, prefix: str) -> Column:
    """(flow, mode) of '<prefix><flow>-<mode>.<ext>'."""
    stem = F.substring(F.substring_index(F.element_at(F.split(file, "/"), -1), ".", 1), F.lit(len(prefix) + 1), F.length(file))
    mode = F.substring_index(stem, "-", -1)
    return F.struct(F.substring(stem, F.lit(1), F.length(stem) - F.length(mode) - 1).alias("flow"), mode.alias("mode"))


#: Tokens that keep every character: a run of other than white space with what stands before it.
UNIT = "[ \\t\\n\\r]*[^ \\t\\n\\r]+|[ \\t\\n\\r]+"


def token_windows(text: Column, size: int, unit: str = UNIT) -> Column:
    """Contiguous windows of at most ``size`` units; joined they are the text again. A short text is its own only window."""
    units = F.regexp_extract_all(text, F.lit(unit), F.lit(0))
    starts = F.sequence(F.lit(1), F.greatest(F.size(units), F.lit(1)), F.lit(size))
    cut = F.transform(starts, lambda s: F.array_join(F.slice(units, s, F.lit(size)), ""))
    return F.when(F.size(units) <= size, F.array(text)).otherwise(cut)


def usage_fields(usage: Column, fields: tuple[str, ...] = ("input_tokens", "output_tokens", "total_tokens")) -> Column:
    """A map of the counts that are known."""
    pairs = F.filter(F.array(*[F.struct(F.lit(f).alias("k"), usage[f].cast("bigint").alias("v")) for f in fields]), lambda p: p["v"].isNotNull())
    return F.coalesce(F.map_from_entries(pairs), F.create_map().cast("map<string,bigint>"))


def parse_vector(text: Column) -> Column:
    """'[1, 2]' or '(1,2)' as doubles; null where a part is no finite number."""
    parts = F.split(F.regexp_replace(text, r"[\[\]()\s]", ""), ",")
    numbers = F.transform(parts, lambda p: p.try_cast("double"))
    return F.when(F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), numbers)
