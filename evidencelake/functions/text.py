"""Column expressions for cleaning and keying text, cells, names and labels."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidencelake.functions import patterns as P
from evidencelake.functions.binding import let
from evidencelake.functions.literals import with_items

#: Values that count as missing (fixed values).
MISSING_VALUES = ("", "nan", "none", "n/a", "na", "not applicable", "not specified", "none specified", "-")
#: White space in any script, with the four separators that count as such.
WS = r"[\s\x1C-\x1F]"
OPEN, SHUT = r"(?U)^" + WS + "+", WS + "+$"


def plain_key(value: str) -> str:
    """token_key of a constant."""
    plain = unicodedata.normalize("NFKD", value).encode("ascii", "ignore").decode().replace("&", " and ").lower()
    return " ".join(re.findall("[a-z0-9]+", plain))


def missing_keys(values: Iterable[str] = MISSING_VALUES) -> list[str]:
    return sorted({plain_key(v) for v in values})


@lru_cache(maxsize=1)
def _folds() -> tuple[str, str, str]:
    """Of all characters: those whose NFKD form has one ASCII character, and these; those with longer forms, with the forms, as JSON."""
    single, letter, longer = [], [], []
    for n in chain(range(128, 0xD800), range(0xE000, 0x110000)):
        c = chr(n)
        plain = unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            single.append(c)
            letter.append(plain)
        elif plain:
            longer.append({"c": c, "plain": plain})
    return "".join(single), "".join(letter), json.dumps(longer, ensure_ascii=False)


def fold_ascii(c: Column) -> Column:
    """What is ASCII in the compatibility decomposition (NFKD): letters without accents, ligatures and symbols spelled out; ASCII texts are left alone."""
    single, letter, longer = _folds()
    table = F.from_json(F.lit(longer), "array<struct<c:string,plain:string>>")
    held = lambda x: F.array_distinct(F.regexp_extract_all(F.regexp_replace(x, r"[\x00-\x7F]+", ""), F.lit("(?s)."), F.lit(0)))
    replaced = lambda x, found: F.aggregate(F.filter(table, lambda e: F.array_contains(found, e["c"])), x, lambda text, e: F.replace(text, e["c"], e["plain"]))
    spelled = lambda x: let(held(x), lambda found: replaced(x, found))
    return let(c, lambda x: F.when(x.rlike(r"[^\x00-\x7F]"), F.regexp_replace(F.translate(spelled(x), single, letter), r"[^\x00-\x7F]", "")).otherwise(x))


def _ascii_key(c: Column) -> Column:
    spelled = F.lower(F.replace(c, F.lit("&"), F.lit(" and ")))
    return F.trim(F.regexp_replace(spelled, "[^a-z0-9]+", " "))


def token_key(c: Column) -> Column:
    """Lower-case ASCII words parted by one space, '&' read as 'and'."""
    return _ascii_key(fold_ascii(c))


def is_missing(c: Column, values: Iterable[str] = MISSING_VALUES) -> Column:
    return c.isNull() | token_key(c).isin(missing_keys(values))


def strip(c: Column) -> Column:
    """Without white space at either end, in any script."""
    return F.regexp_replace(c, f"{OPEN}|{SHUT}", "")


def strip_chars(c: Column, chars: str) -> Column:
    """Without any of the characters at either end."""
    one = "[" + re.escape(chars) + "]"
    return F.regexp_replace(c, f"^{one}+|{one}+$", "")


def clean_whitespace(c: Column) -> Column:
    """One kind of line end, no runs of blanks or of empty lines, even spacing at bars and semicolons."""
    c = F.regexp_replace(c, "\r\n?", "\n")
    c = F.regexp_replace(c, "[ \t]+", " ")
    c = F.regexp_replace(c, "\n{3,}", "\n\n")
    c = F.regexp_replace(c, f"(?U){WS}*\\|{WS}*", " | ")
    return strip(F.regexp_replace(c, f"(?U){WS}*;{WS}*", "; "))


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, f"(?U){WS}+", " "))


def authors_text(c: Column) -> Column:
    """A list of names as one string."""
    return F.array_join(F.filter(F.transform(c, strip), lambda x: x != ""), ", ")


def split_authors(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ";"), strip), lambda x: x != "")


def doi_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(strip(c)), r"^https?://(dx\.)?doi\.org/", "")


def status_key(c: Column) -> Column:
    return F.lower(strip(c))


def casefold(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def apply_fixes(c: Column, fixes: dict[str, str]) -> Column:
    """Case-insensitive replacements in order, written as Python has them."""
    for pattern, new in fixes.items():
        c = F.regexp_replace(c, P.ANY_CASE + P.java(pattern), P.java_replacement(new, pattern))
    return c


def map_value(c: Column, values: dict[str, str]) -> Column:
    """The mapped value where the cell's key, in lower case with - and _ as spaces, has one."""
    if not values:
        return c
    table = F.create_map(*(F.lit(x) for pair in values.items() for x in pair))
    return let(c, lambda x: F.coalesce(F.try_element_at(table, collapse(F.lower(F.translate(x, "-_", "  ")))), x))


def normalize_cell(c: Column, fixes: dict[str, str] | None = None, values: dict[str, str] | None = None) -> Column:
    return map_value(apply_fixes(clean_whitespace(c), fixes or {}), values or {})


def unquoted(c: Column) -> Column:
    """A term without the quotation marks around it; marks at one end only stay."""
    c = strip_chars(F.regexp_replace(strip(c), '"{2,}', '"'), "“”‘’")
    for _ in range(3):
        c = let(c, lambda x: F.when((F.length(x) >= 2) & x.startswith('"') & x.endswith('"'), strip(F.substring(x, F.lit(2), F.length(x) - 2))).otherwise(x))
    return strip(c)


def search_string(c: Column, fixes: dict[str, str] | None = None, values: dict[str, str] | None = None) -> Column:
    """A boolean search string with distinct terms, quoted and sorted; AND wins over OR. Without either, the bare term."""
    plain = F.translate(normalize_cell(c, fixes, values), "“”‘’\n", "\"\"'' ")
    order = lambda a, b: F.when(F.lower(a) < F.lower(b), -1).when(F.lower(a) > F.lower(b), 1).otherwise(0)

    def sorted_terms(text: Column) -> Column:
        terms = F.filter(F.transform(F.split(text, f"(?iU){WS}+(?:AND|OR){WS}+"), unquoted), lambda x: x != "")
        once = let(terms, lambda own: let(F.transform(own, F.lower), lambda low: F.filter(own, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)))
        return F.transform(F.array_sort(once, order), lambda x: F.concat(F.lit('"'), x, F.lit('"')))

    def canonical(text: Column) -> Column:
        joined = let(sorted_terms(text), lambda own: F.when(text.rlike(r"(?iU)\bAND\b"), F.array_join(own, " AND ")).otherwise(F.array_join(own, " OR ")))
        return F.when(text.rlike(r"(?iU)\b(?:AND|OR)\b"), joined).otherwise(F.coalesce(blank_to_null(unquoted(text)), text))

    return let(F.regexp_replace(strip(plain), '"{2,}', '"'), canonical)


def drop_fragments(c: Column) -> Column:
    """Lines joined, without the sentence parts that break off in an ellipsis; one within a list of numbers stays."""
    dotted = F.replace(c, F.lit("..."), F.lit("…"))
    lines = F.filter(F.transform(F.split(dotted, r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"), strip), lambda x: x != "")
    numbers = r"(?U)\d\s*,\s*\d\s*,?\s*…\s*,?\s*\d"

    def kept(joined: Column) -> Column:
        parts = F.filter(F.transform(F.split(joined, f"(?U)(?<=[.;]){WS}+"), strip), lambda x: x != "")
        whole = F.filter(parts, lambda x: ~x.endswith("…") | x.rlike(numbers))
        return let(whole, lambda w: clean_whitespace(F.when(F.size(w) > 0, F.array_join(w, " ")).otherwise(strip(F.regexp_replace(clean_whitespace(joined), "…+$", "")))))

    return let(F.array_join(lines, " "), kept)


def plain_display(c: Column) -> Column:
    """A text without list brackets, quotation marks and broken-off sentences."""
    bare = strip_chars(strip_chars(strip_chars(clean_whitespace(c), "[]"), "'"), '"')
    return F.coalesce(drop_fragments(clean_whitespace(bare)), F.lit(""))


#: Texts that display leaves as they are: single spaces, nothing of a written list, no bars, quotes or dots in a row, semicolons before a space.
TIDY = (
    r"^(?=[^,]*\z|[A-EG-MO-SU-Za-z])"  # a written list has a comma or a bracket, and begins with no other letter
    r"(?! )(?!.*(?:  |\.\.|;[^ ]| ;))"
    r"[A-Za-z0-9.,;:=#%/+&@?!*^~<>_ -]+(?<! )\z"
)


def display(c: Column, missing: Iterable[str] = MISSING_VALUES) -> Column:
    """What is shown of a cell: the values of a written list but for missing ones, joined by '; ', or its text, tidied up."""
    def shown(items: Column) -> Column:
        return F.array_join(F.transform(F.filter(items, lambda x: ~is_missing(x, missing)), plain_display), "; ")

    tidied = lambda x: F.when(x.rlike(TIDY), x).otherwise(with_items(clean_whitespace(x), shown, plain_display))
    return F.coalesce(let(c, tidied), F.lit(""))


def display_key(c: Column, missing: Iterable[str] = MISSING_VALUES) -> Column:
    """The key of what is shown of a cell; null if that is empty, or the cell is missing. For a column, as it is mentioned several times."""
    tidy = F.when(~_ascii_key(c).isin(missing_keys(missing)), _ascii_key(c))
    return blank_to_null(F.when(c.rlike(TIDY), tidy).when(~is_missing(c, missing), token_key(display(c))))


def shorten(c: Column, most: int | Column, cleaned: bool = False) -> Column:
    """Cut at the last space before the limit, unless that comes too early, and marked by '...'. White space is cleaned, if that isn't done yet."""
    most = F.lit(most) if isinstance(most, int) else most

    def cut(text: Column) -> Column:
        head = F.substring(text, F.lit(1), most + 1)
        space = F.length(head) - F.locate(" ", F.reverse(head))  # characters before the last space
        at = F.when((F.locate(" ", head) > 0) & (space >= F.greatest(F.lit(60), F.floor(most * 0.55))), space).otherwise(most)
        return F.when(F.length(text) <= most, text).otherwise(F.concat(F.regexp_replace(F.substring(text, F.lit(1), at), "[ ;,.]+$", ""), F.lit("...")))

    return let(c if cleaned else clean_whitespace(c), cut)


def is_shortened(c: Column, most: int | Column) -> Column:
    return F.length(clean_whitespace(c)) > most


def dedupe(items: Column) -> Column:
    """The items with the first display form of each key, in order; blank ones are left out. For the few items of one cell."""
    clean = F.filter(F.transform(items, clean_whitespace), lambda x: x != "")
    keyed = F.transform(clean, lambda x: F.struct(x.alias("item"), token_key(x).alias("key")))
    first = F.aggregate(
        keyed, F.struct(F.array().cast("array<string>").alias("items"), F.array().cast("array<string>").alias("keys")),
        lambda s, x: F.when(F.array_contains(s["keys"], x["key"]), s).otherwise(F.struct(F.array_append(s["items"], x["item"]).alias("items"), F.array_append(s["keys"], x["key"]).alias("keys"))),
    )
    return first["items"]


def combined(parts: list[Column], most: int) -> Column:
    """Display forms of the parts that have one, once each, joined by ' - ' and cut to size."""
    shown = F.filter(F.array(*map(display, parts)), lambda x: x != "")
    return shorten(F.array_join(dedupe(shown), " - "), most)


def limited(items: Column, n_items: Column, most: int | Column | None) -> Column:
    """At most so many items joined by '; ', and how many more of the n there are."""
    if most is None:
        return F.array_join(items, "; ")
    most = F.lit(most) if isinstance(most, int) else most
    shown = F.array_join(F.slice(items, F.lit(1), F.coalesce(most, F.size(items))), "; ")
    return F.when(n_items > most, F.concat(shown, F.lit("; +"), (n_items - most).cast("string"), F.lit(" more"))).otherwise(shown)


def metric_snippets(c: Column, labels: dict[str, str]) -> Column:
    """'name: 0.91 - model' as 'label=0.91 (model)', for every one in the text; labels are looked up by key."""
    pattern = r"([A-Za-z][A-Za-z0-9@/_+\- ]{0,35})\s*[:=]\s*([+-]?\d+(?:\.\d+)?%?)(?:\s*-\s*([^,;}\n]+))?"
    names, values, models = (F.regexp_extract_all(c, F.lit(pattern), F.lit(g)) for g in (1, 2, 3))
    table = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair)) if labels else None
    name = lambda x: F.coalesce(F.try_element_at(table, token_key(x)), clean_whitespace(x)) if labels else clean_whitespace(x)
    model = lambda c: let(clean_whitespace(c), lambda x: F.when(x != "", F.concat(F.lit(" ("), x, F.lit(")"))).otherwise(F.lit("")))
    return F.transform(F.arrays_zip(names.alias("a"), values.alias("b"), models.alias("c")), lambda s: F.concat(name(s["a"]), F.lit("="), s["b"], model(s["c"])))


def year_in(c: Column) -> Column:
    return F.try_to_number(blank_to_null(F.regexp_extract(c, r"\b((?:19|20)\d{2})\b", 1)), F.lit("9999")).cast("int")


def citation(authors: Column, year: Column, title: Column, journal: Column) -> Column:
    """Names (up to three, else the first et al.), (year), title with a full stop, journal."""
    names = F.when(F.size(authors) > 3, F.concat(F.get(authors, F.lit(0)), F.lit(" et al."))).when(F.size(authors) > 0, F.array_join(authors, ", "))
    return F.concat_ws(" ", names, F.concat(F.lit("("), year.cast("string"), F.lit(")")), F.concat(blank_to_null(title), F.lit(".")), blank_to_null(journal))


def study_label(authors: Column, year: Column, title: Column) -> Column:
    """First author with 'et al.' for more than one, and the year; else the title."""
    first = F.get(authors, F.lit(0))
    name = F.when(F.size(authors) > 1, F.concat(first, F.lit(" et al."))).otherwise(first)
    dated = F.when(year.isNotNull(), F.concat(name, F.lit(" ("), year.cast("string"), F.lit(")"))).otherwise(name)
    return F.coalesce(blank_to_null(dated), blank_to_null(title), F.lit("Unknown study"))


def paper_study(authors: Column, year: Column, title: Column) -> Column:
    """First author and year of a manuscript row; else the title."""
    first = strip(F.get(F.split(F.get(F.split(authors, ";"), F.lit(0)), ","), F.lit(0)))
    name = F.coalesce(blank_to_null(first), blank_to_null(authors), blank_to_null(title))
    dated = F.concat(name, F.lit(" ("), blank_to_null(year), F.lit(")"))
    return F.coalesce(dated, name, F.lit("Unknown study"))


def short_id(prefix: str, *parts: Column, length: int = 8) -> Column:
    """Prefix and the first hex digits of the version-5 UUID of the parts in the URL namespace; up to 12 digits."""
    namespace = F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8"))
    key = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("None")) for p in parts))
    digest = F.sha1(F.concat(namespace, F.encode(key, "UTF-8")))
    return F.concat(F.lit(f"{prefix}_"), F.substring(digest, 1, length))


def slugify(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}]", "_"), "^_+|_+$", ""))


def workflow_state(c: Column, states: dict[str, str]) -> Column:
    key = F.lower(strip(c))
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in states.items() for x in pair)), key), key)


def content_hash(*columns: Column) -> Column:
    return F.sha2(F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)), 256)
