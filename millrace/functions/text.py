"""Names, titles and slugs as Column expressions: no Python runs per row."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folding() -> tuple[str, str]:
    """Letters that decompose into one ASCII letter and marks, and those ASCII letters."""
    pairs = []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = [c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)]
        if len(base) == 1 and base[0].isascii():
            pairs.append((chr(code), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ACCENTED, _PLAIN = _folding()
#: Words that a comparison of names leaves out; they differ by what is compared.
LEGAL_WORDS = ["INC", "INCORPORATED", "CORP", "CORPORATION", "CO", "LLC", "LTD", "THE", "OF", "AND", "FOR"]
COURSE_WORDS = ["golf", "club", "clubs", "country", "cc", "gc", "course", "courses", "links", "the"]
SLUG_WORDS = ["golf", "club", "country", "cc", "gc", "course", "links", "the", "and", "of", "at"]
REGISTER_WORDS = ["INC", "THE", "OF", "AND", "FOR", "CO", "CORP", "LLC", "FUND", "FOUNDATION"]
GENERIC_WORDS = ["alumni", "council", "foundation", "association", "club", "inc", "the", "and", "for"]
CITY_WORDS = {"st": "saint", "ste": "sainte", "mt": "mount", "ft": "fort", "pt": "point"}
SHORT_SLUG_LENGTH = 40
#: Patterns by which titles, organizers and texts are told apart.
ORDINALS = (
    r"(?i)\b(first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth|eleventh|twelfth|thirteenth|fourteenth|fifteenth|sixteenth|seventeenth|eighteenth|nineteenth"
    r"|twentieth|twenty|thirtieth|thirty|fortieth|forty|fiftieth|fifty|sixtieth|sixty)(-\w+)?\b"
)
YEARLY = [r"\b\d+(st|nd|rd|th)\b", r"\b(19|20)\d{2}\b", r"\bannual\b"]
INITIALS = r"\b([a-z])\.([a-z])\.?(?=\s|$)"
SCHOOL = r"(?i)\b(school|schools|university|college|academy|prep|preparatory|elementary|pta|pto|ptsa|parent[- ]teacher|boosters?|alumni association)\b"
PLAYABLE = r"(?i)\b(scramble|outing|classic|tournament|shamble|pro[- ]?am|fundraiser|benefit)\b"
WATCHED = [
    r"(?i)\b(pga|senior pga) championship\b",
    r"(?i)\bu\.?s\.? (women's |senior |senior women's )?open\b",
    r"(?i)\b(ryder|presidents|solheim|walker|curtis|world champions) cup\b",
    r"(?i)\b(spectators?|volunteers?) (opportunit|tickets?|registration)",
    r"(?i)\bvolunteer (&|and) spectator\b",
    r"(?i)\bleague$",
    r"(?i)\b(mon|tues|wednes|thurs|fri|satur|sun)day (spring |summer |fall |winter )?league\b",
    r"(?i)\bgala$",
]
OUTING_WORD = r"(?i)\b(outings?|tournaments?|scrambles?|classics?|invitationals?)\b"
GOLF_WORD = r"(?i)\bgolf"
NO_LESSON = r"(?i)golf(?!\s*lesson)"
OTHER_GOLF = r"(?i)\b(mini[\s-]?golf|miniature golf|putt[\s-]?putt|disc golf|foot ?golf|topgolf)\b"


def let(value: Column, use) -> Column:
    """use(value), with the value worked out once: a one-element array gives it a name."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fold(text: Column) -> Column:
    """Accented Latin letters as plain ones; loose combining marks go."""
    return F.regexp_replace(F.translate(text, _ACCENTED, _PLAIN), "[̀-ͯ]", "")


def words(text: Column, apart: str) -> Column:
    return F.filter(F.split(text, apart), lambda w: w != "")


def _without(tokens: Column, dropped: list[str]) -> Column:
    return F.filter(tokens, lambda w: ~w.isin(*dropped))


def without_or_all(tokens: Column, dropped: list[str]) -> Column:
    """The tokens that are not dropped, or all of them if none is left."""
    return let(tokens, lambda every: let(_without(every, dropped), lambda kept: F.when(F.size(kept) > 0, kept).otherwise(every)))


def kebab(text: Column) -> Column:
    """Lower-case ASCII words joined by hyphens."""
    plain = F.lower(F.regexp_replace(F.replace(fold(text), F.lit("&"), F.lit(" and ")), "['’]", ""))
    return F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def cut_at_hyphen(slug: Column, most: int) -> Column:
    """At most ``most`` characters, cut before a hyphen if there is one."""
    head = F.substring(slug, 1, most + 1)
    at_hyphen = F.regexp_extract(head, "^(.+)-[^-]*$", 1)
    return F.when(F.length(slug) <= most, slug).otherwise(F.regexp_replace(F.when(at_hyphen != "", at_hyphen).otherwise(F.substring(slug, 1, most)), "^-+|-+$", ""))


def short_slug(name: Column) -> Column:
    return let(F.array_join(without_or_all(words(kebab(name), "-"), SLUG_WORDS), "-"), lambda slug: cut_at_hyphen(slug, SHORT_SLUG_LENGTH))


def name_tokens(name: Column) -> Column:
    """Sorted, distinct upper-case words of an organization's name, without words of its legal form unless it has no others."""
    plain = F.regexp_replace(F.replace(F.upper(fold(name)), F.lit("&"), F.lit(" AND ")), "['’`.]", "")
    return F.array_sort(F.array_distinct(without_or_all(words(plain, "[^A-Z0-9]+"), LEGAL_WORDS)))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 0 if either is empty."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) > 0) & (F.length(b) > 0), 1 - F.levenshtein(a, b) / longer).otherwise(F.lit(0.0))


def token_set_similarity(a: Column, b: Column) -> Column:
    return similarity(F.array_join(name_tokens(a), " "), F.array_join(name_tokens(b), " "))


def _place_words(text: Column) -> Column:
    lower = F.replace(F.lower(fold(text)), F.lit("&"), F.lit(" and "))
    initials = F.regexp_replace(lower, INITIALS, "$1$2")
    return words(F.regexp_replace(initials, "['’`]", ""), "[^a-z0-9]+")


def course_name(name: Column) -> Column:
    return F.array_join(without_or_all(_place_words(name), COURSE_WORDS), " ")


def course_name_variants(name: Column) -> Column:
    """The normalized name, and where it has a part in brackets also the name without it."""
    full, bare = course_name(name), course_name(F.regexp_replace(name, r"\s*\([^)]*\)\s*", " "))
    return F.array_compact(F.array(full, F.when(name.rlike(r"\([^)]*\)") & (bare != "") & (bare != full), bare)))


def city_name(city: Column) -> Column:
    def long(word: Column) -> Column:
        out = F.lit(None).cast("string")
        for short, full in CITY_WORDS.items():
            out = F.when(word == short, full).otherwise(out)
        return F.coalesce(out, word)

    return F.array_join(F.transform(_place_words(city), long), " ")


def register_tokens(name: Column) -> Column:
    """Words by which a register of organizations is searched; accents are not folded."""
    plain = F.regexp_replace(F.replace(F.upper(name), F.lit("&"), F.lit(" AND ")), "[^A-Z0-9 ]+", " ")
    return _without(words(plain, r"\s+"), REGISTER_WORDS)


def title_words(title: Column) -> Column:
    """Words of a title without years, ordinals and "annual"; repeated words stay."""
    text = F.regexp_replace(F.lower(title), ORDINALS, " ")
    for pattern in YEARLY:
        text = F.regexp_replace(text, pattern, " ")
    return words(text, "[^a-z0-9]+")


def title_key(title: Column, *organizers: Column) -> Column:
    """``title_words`` without the telling words of the organizers' names."""
    telling = [F.filter(words(F.lower(F.coalesce(o, F.lit(""))), "[^a-z0-9]+"), lambda w: (F.length(w) > 2) & ~w.isin(*GENERIC_WORDS)) for o in organizers]
    dropped = F.concat(*telling) if telling else F.array().cast("array<string>")
    return F.array_join(F.filter(title_words(title), lambda w: ~F.array_contains(dropped, w)), " ")


def _course_slug_words(name: Column) -> Column:
    return F.array_distinct(_without(words(kebab(name), "-"), SLUG_WORDS))


def slug_title(title: Column, course: Column) -> Column:
    """A title for a slug that ends with the course: without "at" and the course's words at its end, or without the course's whole name."""
    pattern = r"(?i)^(.*\S)\s+at\s+(.+)$"
    bare = F.trim(title)
    tail = _course_slug_words(F.regexp_extract(bare, pattern, 2))
    ends = bare.rlike(pattern) & (F.size(tail) > 0) & (F.size(F.array_except(tail, _course_slug_words(course))) == 0)
    at = F.position(F.lower(course), F.lower(title))
    rest = F.trim(F.concat(F.substring(title, F.lit(1), at - 1), F.lit(" "), F.substring(title, at + F.length(course), F.length(title))))
    return F.when(ends, F.regexp_extract(bare, pattern, 1)).when((at > 0) & (kebab(rest) != ""), rest).otherwise(title)


def is_school(name: Column) -> Column:
    return F.coalesce(name.rlike(SCHOOL), F.lit(False))


def is_not_playable(title: Column) -> Column:
    t = F.trim(title)
    watched = F.lit(False)
    for pattern in WATCHED:
        watched |= t.rlike(pattern)
    return ~t.rlike(PLAYABLE) & watched


def is_outing_text(text: Column) -> Column:
    t = F.regexp_replace(text, "[-_/+]+", " ")
    return ~t.rlike(OTHER_GOLF) & t.rlike(GOLF_WORD) & t.rlike(NO_LESSON) & t.rlike(OUTING_WORD)


def markdown_cell(text: Column, most: int) -> Column:
    """A text for a table cell: one line, bars escaped, cut with an ellipsis."""
    flat = F.replace(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit("|"), F.lit("\\|"))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 1), F.lit("…"))).otherwise(flat)


def clip(text: Column, most: int) -> Column:
    """At most ``most`` characters with an ellipsis, cut after a word unless that loses over two fifths."""
    head = F.substring(text, 1, most - 1)
    last = F.length(head) - F.length(F.substring_index(head, " ", -1)) - 1
    kept = F.when(last > most * 0.6, F.substring(head, F.lit(1), last)).otherwise(head)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(kept), F.lit("…")))


def estimated_tokens(chars: Column) -> Column:
    return F.ceil(chars / 3)


def redacted(text: Column, secrets: list[str]) -> Column:
    for secret in sorted(filter(None, secrets), key=len, reverse=True):
        text = F.replace(text, F.lit(secret), F.lit("[redacted]"))
    return text
