"""URL parts, normal forms and rule tables as Column expressions.

Parts come from regular expressions: a strict parser gives nothing for hosts
with underscores or paths with blanks, and real links hold both.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only follow visitors.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "fbclid", "gclid", "igshid", "igsh", "si", "ref", "mc_cid", "mc_eid")


def host(c: Column) -> Column:
    """Lower-case host, null where there is none."""
    found = F.lower(F.regexp_extract(c, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", found)


def bare_host(c: Column) -> Column:
    return F.regexp_replace(host(c), r"^www\.", "")


def path(c: Column) -> Column:
    return F.regexp_extract(c, r"^[^:]+://[^/?#]*([^?#]*)", 1)


def query_string(c: Column) -> Column:
    return F.regexp_extract(c, r"\?([^#]*)", 1)


def normal_url(c: Column) -> Column:
    """Without scheme, www, query, fragment and closing slashes, in lower case."""
    out = F.regexp_replace(F.trim(c), r"(?i)^https?://(www\.)?", "")
    return F.lower(F.regexp_replace(F.regexp_replace(out, r"[?#].*$", ""), "/+$", ""))


def host_path(c: Column) -> Column:
    """Host without www and path without closing slash; what is no URL stays, in lower case."""
    return F.coalesce(F.concat(bare_host(c), F.regexp_replace(path(c), "/+$", "")), F.lower(F.trim(c)))


def canonical_url(c: Column) -> Column:
    """https, lower-case host, no fragment, no closing slash; the query stays."""
    q = query_string(c)
    return F.concat(F.lit("https://"), host(c), F.regexp_replace(path(c), "/+$", ""), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))


def strip_tracking(c: Column, params: tuple[str, ...] = TRACKING) -> Column:
    """The canonical URL without www and without tracking parameters."""
    kept = F.array_join(F.filter(F.split(query_string(c), "&"), lambda kv: (kv != "") & ~F.lower(F.regexp_extract(kv, "^([^=]*)", 1)).isin(*params)), "&")
    return F.concat(F.lit("https://"), bare_host(c), F.regexp_replace(path(c), "/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def domain(c: Column) -> Column:
    """The last two labels of the host."""
    labels = F.split(bare_host(c), r"\.")
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")


def subdomain(c: Column) -> Column:
    labels = F.split(bare_host(c), r"\.")
    return F.array_join(F.slice(labels, 1, F.greatest(F.size(labels) - 2, F.lit(0))), ".")


def upgrade_https(c: Column) -> Column:
    return F.regexp_replace(c, "^http:", "https:")


def classify(c: Column, rules: list[tuple[str, str]], skip: tuple[str, ...] = (), fallback: Column | None = None) -> Column:
    """The first rule whose pattern finds the host; null for what is no URL or is skipped; ``fallback`` (a Column) else."""
    h = host(c)
    out = F.when(h.isNull(), None)
    for pattern in skip:
        out = out.when(h.rlike(pattern), None)
    for name, pattern in rules:
        out = out.when(h.rlike(pattern), name)
    return out.otherwise(fallback if fallback is not None else F.lit(None).cast("string"))


def reclassify(current: Column, found: Column, generic: str = "other") -> Column:
    """What a resolved link becomes: null stays refused, a generic class keeps the current one."""
    return F.when(found.isNull(), None).when(found == generic, current).otherwise(found)


def let(c: Column, f) -> Column:
    """f of a column that stands in the expression once, however often f names it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def unwrap(c: Column, wrappers: tuple[str, ...], rounds: int = 5) -> Column:
    """The target of links that wrap links in a ``u`` or ``url`` parameter."""

    def step(x: Column) -> Column:
        target = F.try_url_decode(F.regexp_extract(x, r"[?&](?:u|url)=([^&#]+)", 1))
        return F.when(bare_host(x).isin(*wrappers) & target.rlike("(?i)^https?://"), target).otherwise(x)

    for _ in range(rounds):
        c = let(c, step)
    return c


def is_search_page(c: Column) -> Column:
    first = F.regexp_extract(F.regexp_replace(path(c), "^/[a-z]{2}(?=/)", ""), "^/([^/]*)", 1)
    return first.isin("search", "results", "explore")


def handle(c: Column, kind: str = "path") -> Column:
    """First path segment, or the subdomain for hosts that name profiles there."""
    found = subdomain(c) if kind == "subdomain" else F.regexp_replace(F.regexp_extract(path(c), "^/([^/]+)", 1), "^@", "")
    return F.when(found != "", found)


def last_segment(c: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(path(c), "/+$", ""), "([^/]*)$", 1)


def numeric_id(c: Column) -> Column:
    found = F.regexp_extract(path(c), "/([0-9]+)(?:[^0-9/][^/]*)?/?$", 1)
    return F.when(found != "", found.cast("long"))


def kind_and_slug(c: Column) -> Column:
    """Struct of the first two path segments after a locale; percent codes are undone up to three times."""
    parts = F.split(F.regexp_replace(F.regexp_replace(path(c), "^/", ""), "^[a-z]{2}/", ""), "/")
    slug_ = F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
    for _ in range(3):
        slug_ = F.coalesce(F.try_url_decode(slug_), slug_)
    return F.struct(F.get(parts, F.lit(0)).alias("kind"), slug_.alias("slug"))


def in_text(c: Column) -> Column:
    """URLs in running text without the punctuation behind them."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"(https?://[^\s<>\"]+)"), F.lit(1)), lambda u: F.regexp_replace(u, r"[.,;:!?)\]]+$", ""))


def issues(c: Column) -> Column:
    """Names of what is wrong with a link."""
    checks = {"empty": F.trim(c) == "", "white space": c.rlike(r"\s"), "several": F.regexp_count(F.lower(c), F.lit("https?://")) > 1, "no host": host(c).isNull(), "http": c.rlike("(?i)^http://"), "protocol": c.rlike("(?i)^(?!https?:)[a-z]+:")}
    return F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()]), lambda x: x.isNotNull())


def without_size(c: Column) -> Column:
    """Image links without a -WxH suffix."""
    return F.regexp_replace(c, r"-[0-9]+x[0-9]+(?=\.[A-Za-z]+$)", "")


def link_keys(url: Column, platform: Column, profile: Column) -> Column:
    """Keys under which equal profiles meet: platform and URL, platform and handle."""
    return F.filter(F.array(F.concat_ws("|", platform, F.lit("url"), normal_url(url)), F.when(profile.isNotNull(), F.concat_ws("|", platform, F.lit("handle"), F.lower(profile)))), lambda k: k.isNotNull())


def swap_host(c: Column, old: str, new: str) -> Column:
    """Another host for an old one, on https."""
    return F.regexp_replace(c, rf"(?i)^https?://(?:www\.)?{old}(?=[/?#]|$)", f"https://{new}")


def left_site(before: Column, after: Column) -> Column:
    """Whether a redirect ended on another domain; true where either is no URL."""
    return ~F.coalesce(domain(before) == domain(after), F.lit(False))


def mismatched(c: Column, platform: Column, domains: dict[str, tuple[str, ...]]) -> Column:
    """Whether a link's domain is none of its platform's; null for platforms without a list."""
    out = F.when(F.lit(False), F.lit(False))
    for name, own in domains.items():
        out = out.when(platform == name, ~F.coalesce(domain(c).isin(*own), F.lit(False)))
    return out


def profile_link(raw: Column, home: str, kind: str = "path") -> Column:
    """Struct (url, handle, warning) from what people type: a bare handle, a link of the platform, a search link or a foreign one. ``home`` is the platform's domain."""
    text = F.trim(raw)
    bare = text.rlike(r"^@?[A-Za-z0-9._-]+$") & ~text.rlike(rf"(?i){home}")
    full = F.when(bare, F.concat(F.lit(f"https://{home}/"), F.regexp_replace(text, "^@", ""))).when(text.rlike("(?i)^https?://"), text).otherwise(F.concat(F.lit("https://"), text))
    warning = F.when(text == "", "empty").when(domain(full) != home, "foreign").when(is_search_page(full), "search")
    own = handle(full, kind)
    clean = F.concat(F.lit("https://"), bare_host(full), F.regexp_replace(path(full), "/+$", ""))
    return F.struct(F.when(warning.isNull(), clean).otherwise(text).alias("url"), F.when(warning.isNull(), own).alias("handle"), warning.alias("warning"))


@dataclass(frozen=True)
class LinkRule:
    """How a platform's links without a template are cleaned. ``whole``: paths whose query says everything; ``params``: the parameters that count on a path; ``number``: whether a path ends at its first numeric segment; ``profiles``: (pattern of the first segment, segments that make a profile)."""

    whole: tuple[str, ...] = ()
    params: tuple[tuple[str, tuple[str, ...]], ...] = ()
    number: bool = False
    profiles: tuple[tuple[str, int], ...] = ()


def _parameter(pairs: Column, name: str) -> Column:
    """The first ``name=value`` of an array, else an empty text."""
    return F.element_at(F.concat(F.filter(pairs, lambda kv: kv.startswith(f"{name}=")), F.array(F.lit(""))), 1)


def clean_link(c: Column, platform: Column, rules: dict[str, LinkRule]) -> Column:
    """A link without what only follows visitors, by its platform's rule, else without its query. Links typed without a scheme stay so."""
    text = F.trim(c)
    typed = text.rlike("(?i)^https?://")
    full = F.when(typed, text).otherwise(F.concat(F.lit("https://"), text))
    where, base = path(full), F.regexp_extract(text, "^[^?#]*", 0)
    head = F.when(typed, F.regexp_replace(F.lower(F.regexp_extract(text, r"^[^/]+//[^/?#]*", 0)), "(?<=//)[^/@]*@", "")).otherwise(host(full))
    parts = F.filter(F.split(where, "/"), lambda s: s != "")
    upto = lambda n: F.concat_ws("/", head, F.array_join(F.slice(parts, F.lit(1), n), "/"))
    out = F.regexp_extract(text, r"^[^?]*", 0)
    for name, rule in rules.items():
        own = platform == name
        for first, n in rule.profiles:
            out = F.when(own & host(full).isNotNull() & F.get(parts, F.lit(0)).rlike(first) & (F.size(parts) > n), upto(F.lit(n))).otherwise(out)
        if rule.number:
            at = F.array_position(F.transform(parts, lambda s: s.rlike("^[0-9]+$")), True).cast("int")
            out = F.when(own & (at > 0) & (at < F.size(parts)), upto(at)).otherwise(out)
        for prefix, names in rule.params:
            pairs = F.split(query_string(full), "&")
            kept = F.array_join(F.filter(F.array(*[_parameter(pairs, n) for n in names]), lambda kv: kv != ""), "&")
            out = F.when(own & where.startswith(prefix), F.when(kept != "", F.concat(base, F.lit("?"), kept)).otherwise(base)).otherwise(out)
        for prefix in rule.whole:
            out = F.when(own & where.startswith(prefix), text).otherwise(out)
    return out


def resolve_link(c: Column, platform: Column, wrappers: tuple[str, ...], rules: dict[str, LinkRule]) -> Column:
    """Out of its wrappers, cleaned, and without closing slashes."""
    return F.regexp_replace(let(unwrap(c, wrappers), lambda u: clean_link(u, platform, rules)), "/+$", "")


# Parameters that two links to one thing may differ in.
COMPARED = ("si", "nd", "context", "utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "igsh", "igshid", "fbclid", "gclid", "feature", "pp")


def comparable(c: Column, params: tuple[str, ...] = COMPARED) -> Column:
    """A link as it is compared with others: https, no www, no closing slash but the first, without ``params``; the fragment counts. What is no URL stays as it is."""
    where = F.regexp_replace(path(c), "(?<=.)/$", "")
    kept = F.array_join(F.filter(F.split(query_string(c), "&"), lambda kv: (kv != "") & ~F.regexp_extract(kv, "^([^=]*)", 1).isin(*params)), "&")
    out = F.concat(F.lit("https://"), bare_host(c), F.when(where == "", "/").otherwise(where), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""), F.regexp_extract(c, "(#.+)$", 1))
    return F.coalesce(out, c)


def same_link(a: Column, b: Column) -> Column:
    return (a == b) | (comparable(a) == comparable(b))


def _on(c: Column, site: str) -> Column:
    return (host(c) == site) | host(c).endswith(f".{site}")


def core_url(c: Column, site: str) -> Column:
    """The front page of a link's host; null off the site."""
    return F.when(_on(c, site), F.concat(F.lit("https://"), host(c)))


def is_deep(c: Column, markers: tuple[str, ...]) -> Column:
    """Whether a link leads to something within a profile: it holds one of the markers."""
    low, out = F.lower(c), F.lit(False)
    for m in markers:
        out = out | low.contains(m)
    return out


def own_subdomain(c: Column, site: str) -> Column:
    """Whether the host is a subdomain of the site; false for what is no URL."""
    return F.coalesce(host(c).endswith(f".{site}"), F.lit(False))


def landed_off(c: Column, site: str) -> Column:
    """Whether a redirect ended elsewhere than on a subdomain of the site; true for what is no URL."""
    return ~own_subdomain(c, site)


def resized(c: Column, old: str, new: str) -> Column:
    """An image link with another size suffix in place of ``-old``; null for none."""
    return F.when(c != "", F.regexp_replace(c, rf"-{old}(?=(?:\.\w+)?$)", f"-{new}"))


def is_placeholder(c: Column, patterns: tuple[str, ...] = (r"(?i)/default_avatar[_.]",)) -> Column:
    """Whether an image link is a site's stand-in; false for none."""
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(p)
    return F.coalesce(out, F.lit(False))
