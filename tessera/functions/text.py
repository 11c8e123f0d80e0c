"""Names, tags and words as Column expressions.

All functions are null-safe: null in, null out. Keys that fold to nothing are
null, so that names without Latin letters never match each other.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.html import basic_entities

# Accented Latin letters and their base letters, place by place.
ACCENTED = "àáâãäåāăąçćĉċčďèéêëēĕėęěĝğġģĥìíîïĩīĭįĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżžø"
BASE = "aaaaaaaaacccccdeeeeeeeeegggghiiiiiiiijklllnnnnoooooooorrrssssttuuuuuuuuuuwyyyzzzo"
# Letters that fold to two letters or to one beyond the accents.
LIGATURES = {"ß": "ss", "æ": "ae", "œ": "oe", "đ": "d", "ð": "d", "ł": "l", "þ": "th", "ı": "i", "ħ": "h", "ŧ": "t", "ĸ": "k"}
# English words that say nothing about a name.
STOP_WORDS = ("the", "and", "for", "with", "from", "that", "this", "of", "a", "an", "in", "on", "at", "to", "by")


def fold(c: Column) -> Column:
    """Lower case without accents or combining marks."""
    low = F.lower(c)
    one = {k: v for k, v in LIGATURES.items() if len(v) == 1}
    out = F.translate(F.regexp_replace(low, r"[̀-ͯ]", ""), ACCENTED + "".join(one), BASE + "".join(one.values()))
    for letter, plain in LIGATURES.items():
        if letter not in one:
            out = F.replace(out, F.lit(letter), F.lit(plain))
    return F.when(low.rlike(r"[^\x00-\x7F]"), out).otherwise(low)


def search_key(c: Column) -> Column:
    """Letters a-z and digits only; null when nothing is left."""
    key = F.regexp_replace(fold(c), "[^a-z0-9]", "")
    return F.when(key != "", key)


def spaceless_key(c: Column) -> Column:
    return F.replace(fold(c), F.lit(" "), F.lit(""))


def words_key(c: Column) -> Column:
    """Words kept apart by single blanks."""
    key = F.trim(F.regexp_replace(fold(c), "[^a-z0-9]+", " "))
    return F.when(key != "", key)


def handle_key(c: Column, least: int = 3) -> Column:
    key = search_key(c)
    return F.when(F.length(key) >= least, key)


def tag_key(c: Column) -> Column:
    return F.trim(F.replace(fold(c), F.lit("-"), F.lit(" ")))


def collapse_spaced(c: Column) -> Column:
    """``t e c h n o`` becomes ``techno``: three single characters or more with blanks or hyphens between."""
    return F.when(c.rlike(r"^\S([\s-]+\S){2,}$"), F.regexp_replace(c, r"[\s-]+", "")).otherwise(c)


def tokens(c: Column, least: int = 1, stop: tuple[str, ...] = ()) -> Column:
    """Distinct folded words of ``least`` letters or more."""
    found = F.array_distinct(F.regexp_extract_all(fold(c), F.lit(f"([a-z0-9]{{{least},}})"), F.lit(1)))
    return F.array_except(found, F.array(*map(F.lit, stop))) if stop else found


def trigrams(key: Column) -> Column:
    """Distinct trigrams of a key padded with two blanks before and one behind."""
    padded = F.concat(F.lit("  "), key, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 if either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def overlap(a: Column, b: Column) -> Column:
    """Shared values over the smaller array; null if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b)))


def trigram_similarity(a: Column, b: Column) -> Column:
    """1 for equal keys, 0 for empty ones, else the Jaccard of their trigrams."""
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(jaccard(trigrams(a), trigrams(b)))


def levenshtein_ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise((longest - F.levenshtein(a, b)) / longest)


def token_set_ratio(a: Column, b: Column) -> Column:
    """Best ratio among the shared words, and the shared words with the rest of either side."""
    x, y = tokens(a), tokens(b)
    shared = F.array_join(F.array_sort(F.array_intersect(x, y)), " ")
    left = F.trim(F.concat_ws(" ", shared, F.array_join(F.array_sort(F.array_except(x, y)), " ")))
    right = F.trim(F.concat_ws(" ", shared, F.array_join(F.array_sort(F.array_except(y, x)), " ")))
    return F.greatest(levenshtein_ratio(shared, left), levenshtein_ratio(shared, right), levenshtein_ratio(left, right))


def token_f1(a: Column, b: Column) -> Column:
    shared, total = F.size(F.array_intersect(tokens(a), tokens(b))), F.size(tokens(a)) + F.size(tokens(b))
    return F.when(total == 0, 0.0).otherwise(2 * shared / total)


def name_score(a: Column, b: Column) -> Column:
    return token_set_ratio(a, b) * token_f1(a, b)


def normalise_tag(c: Column, fixes: list[tuple[str, str]], aliases: dict[str, str], discard: tuple[str, ...]) -> Column:
    """Word fixes in order, spaced letters joined, discarded tags null, then an alias of the tag or of its key, else the key. The rules are small tables that people keep."""
    out = F.lower(F.trim(c))
    for word, by in fixes:
        out = F.regexp_replace(out, rf"(?<![a-z0-9]){word}(?![a-z0-9])", by)
    out = collapse_spaced(out)
    key = tag_key(out)
    for tag, canonical in sorted(aliases.items(), reverse=True):
        key = F.when((out == tag) | (tag_key(out) == tag), canonical).otherwise(key)
    return F.when(~tag_key(out).isin(*discard), key)


def tag_reason(c: Column, dictionaries: dict[str, tuple[str, ...]], patterns: dict[str, str]) -> Column:
    """Why a tag is no genre: a decade, a year, a word of a dictionary, a pattern; first reason wins, '' if none."""
    key = tag_key(c)
    out = F.when(key.rlike(r"^(19|20)?[0-9]0s$"), "decade").when(key.rlike(r"^(19|20)[0-9]{2}$"), "year")
    for reason, words in dictionaries.items():
        out = out.when(key.isin(*words), reason)
    for reason, pattern in patterns.items():
        out = out.when(key.rlike(pattern), reason)
    return out.otherwise("")


def emails(c: Column) -> Column:
    """Distinct e-mail addresses in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})"), F.lit(1)), lambda x: F.lower(x)))


def first_uuid(c: Column) -> Column:
    found = F.lower(F.regexp_extract(c, r"(?i)([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})", 1))
    return F.when(found != "", found)


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def escape_like(c: Column) -> Column:
    for x in ("\\", "%", "_"):
        c = F.replace(c, F.lit(x), F.lit("\\" + x))
    return c


def escape_xml(c: Column) -> Column:
    for x, y in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(x), F.lit(y))
    return c


def fill_template(template: Column, query: Column) -> Column:
    """``{query}`` filled with the percent-encoded text, blanks as %20."""
    return F.replace(template, F.lit("{query}"), F.replace(F.url_encode(query), F.lit("+"), F.lit("%20")))


def count_word(c: Column, word: str) -> Column:
    """Whole-word occurrences, with ASCII word limits."""
    return F.regexp_count(F.lower(c), F.lit(rf"(?<![a-z0-9_]){word}(?![a-z0-9_])"))


def strip_markup(c: Column) -> Column:
    """Wiki-like markup to plain text: [a=Name], [url=x]label[/url], [b], [i], [u]."""
    c = F.regexp_replace(c, r"\[(?:a|l|m|r)=([^\]]+)\]", "$1")
    c = F.regexp_replace(c, r"(?i)\[url=[^\]]*\]([\s\S]*?)\[/url\]", "$1")
    return F.trim(F.regexp_replace(c, r"(?i)\[/?(?:b|i|u)\]", ""))


def add_at(c: Column, link: str) -> Column:
    """``@`` before anchors of a link prefix that lack it; running it again changes nothing."""
    return F.regexp_replace(c, rf"(?<!@)(<a [^>]*href=\"{link}[^\"]*\"[^>]*>)", "@$1")


def round4(c: Column) -> Column:
    """Half up on the product, as binary numbers have it."""
    return F.floor(c * 10000 + 0.5) / 10000


def is_generic(c: Column) -> Column:
    """Boilerplate instead of a description."""
    return c.rlike(r"(?i)^\s*(?:listen to|stream) .{0,80}(?:for free|on (?:desktop|mobile))") | (F.trim(c) == "")


def without_label_lines(c: Column, link: str) -> Column:
    """Lines without the first link that holds ``link``; lines that are only a label (``Links:``) go."""
    lines = F.split(F.regexp_replace(c, rf"https?://\S*{link}\S*", ""), "\n")
    kept = F.filter(lines, lambda x: ~x.rlike(r"(?i)^\s*(?:links?|more|all links)\s*:?\s*$") | (F.trim(x) == ""))
    return F.trim(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"))


def contacts(c: Column) -> Column:
    """Struct of booking, management and contact lines of a biography: what follows a label on its line, else the lines below it up to a blank one or the next label."""
    lines = F.split(c, "\n")
    label = r"(?i)^\s*(booking|bookings|management|mgmt|contact|press|news)\b[^:]{0,20}:\s*(.*)$"

    def step(s, x):
        name = F.lower(F.regexp_extract(x, label, 1))
        key = F.when(name.startswith("book"), "booking").when(name.isin("management", "mgmt"), "management").when(name == "contact", "contact").when(name != "", "none")
        value = F.when(name != "", F.regexp_extract(x, label, 2)).otherwise(F.trim(x))
        now = F.when(name != "", key).when(F.trim(x) == "", "none").otherwise(s["now"])
        add = lambda k: F.when((now == k) & (value != ""), F.concat(s[k], F.array(value))).otherwise(s[k]).alias(k)
        return F.struct(now.alias("now"), add("booking"), add("management"), add("contact"))

    empty = F.array().cast("array<string>")
    start = F.struct(F.lit("none").alias("now"), empty.alias("booking"), empty.alias("management"), empty.alias("contact"))
    out = F.aggregate(lines, start, step)
    said = lambda k: F.when(F.size(out[k]) > 0, F.array_join(out[k], " ")).alias(k)
    return F.struct(said("booking"), said("management"), said("contact"))


def natural_key(c: Column) -> Column:
    """An array that sorts names as people do: without case and accents, and numbers by value. Numbers are written with their length before them."""
    parts = F.regexp_extract_all(fold(c), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    number = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.concat(F.lit("0"), F.lpad(F.length(number(p)).cast("string"), 6, "0"), number(p))).otherwise(p))


def name_or_set_score(a: Column, b: Column) -> Column:
    """``name_score`` without words that say nothing; the token-set ratio alone where a side has no other words."""
    x, y = tokens(a, 1, STOP_WORDS), tokens(b, 1, STOP_WORDS)
    f1 = 2 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), token_set_ratio(a, b)).otherwise(token_set_ratio(a, b) * f1)


def biography(raw: Column, link: str) -> Column:
    """Struct of bio, link and contacts of a description: boilerplate gives nothing, entities are decoded once, the first ``link`` and label lines come off."""
    said = F.when(~is_generic(raw), basic_entities(raw))
    plain = without_label_lines(said, link)
    first = F.regexp_extract(said, rf"(https?://\S*{link}\S*)", 1)
    return F.struct(F.when(plain != "", plain).alias("bio"), F.when(first != "", first).alias("link"), contacts(plain).alias("contacts"))


def collated(c: Column, collation: str = "UNICODE_CI_AI", numbers: bool = True) -> Column:
    """A text that sorts, groups and joins as the language's order says (without case and accents by default), with numbers by value: each is written with its length before it and without leading zeros."""
    if numbers:
        plain = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        parts = F.regexp_extract_all(c, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
        c = F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.concat(F.lpad(F.length(plain(p)).cast("string"), 6, "0"), plain(p))).otherwise(p)), "")
    return F.collate(c, collation)


def escape_regex(c: Column) -> Column:
    """A text as a pattern that matches just it."""
    return F.regexp_replace(c, r"([^\w\s])", r"\\$1")


def sql_text(c: Column) -> Column:
    """A text as a literal of SQL; NULL for null."""
    return F.coalesce(F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL"))


def csv_field(c: Column) -> Column:
    """Quoted where a comma, a quote or a line end stands in it; empty for null."""
    quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(c.rlike('[",\\r\\n]'), quoted).otherwise(c), F.lit(""))


def preview(c: Column, most: int = 30) -> Column:
    """One line of a text in quotes, cut after ``most`` characters; (none) for nothing."""
    flat = F.trim(F.regexp_replace(c, r"\s+", " "))
    shown = F.concat(F.lit('"'), F.left(flat, F.lit(most)), F.when(F.length(flat) > most, "…").otherwise(""), F.lit('"'))
    return F.when(c.isNull() | (c == ""), "(none)").otherwise(shown)


def status_label(c: Column, acronyms: tuple[str, ...] = ("sc", "mb")) -> Column:
    """``not_eligible`` as people read it: Not eligible."""
    words = F.split(c, "_")
    said = F.transform(words, lambda w, i: F.when(w.isin(*acronyms), F.upper(w)).when(i == 0, F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, F.lit(2), F.length(w)))).otherwise(w))
    return F.array_join(said, " ")


def replace_each(c: Column, pattern: str, f, group: int = 0) -> Column:
    """Each match of a pattern replaced by ``f`` (of the match's ``group``); where that is null the match stays."""
    between, whole, part = F.split(c, pattern, -1), F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.regexp_extract_all(c, F.lit(pattern), F.lit(group))
    put = F.transform(part, lambda x, i: F.concat(F.coalesce(f(x), F.get(whole, i)), F.get(between, i + 1)))
    return F.concat(F.get(between, F.lit(0)), F.array_join(put, ""))


def without_wrappers(c: Column, host: str) -> Column:
    """Links of a click counter within a text become the links that they wrap in ``url=``; those that don't decode stay."""
    pattern = rf'https?://{host}\?url=([^&\s"<>]+)(?:&[^\s"<>]*)*'
    return replace_each(c, pattern, lambda x: F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), 1)


def number_entities(c: Column) -> Column:
    """Numeric entities, decimal and hexadecimal, as their characters; numbers that are none become U+FFFD."""

    def char(x: Column) -> Column:
        hexed = x.rlike("^[xX]")
        digits = F.regexp_replace(x, "^[xX]?0*", "")
        n = F.when(F.length(digits).between(1, 7), F.when(hexed, F.conv(digits, 16, 10)).otherwise(digits)).cast("long")
        real = (n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
        return F.when(real, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise("\ufffd")

    return replace_each(c, "&#([xX][0-9a-fA-F]+|[0-9]+);", char, 1)
