"""Identifiers and fields found in page text and markup, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, collapse, host, is_falsy, let, split_lines, strip

#: Patterns and words that decide what counts as a find.
EMAIL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
PHONE = r"(?:\+91[\s-]?)?[6-9]\d{4}[\s-]?\d{5}\b"
GSTIN = r"(?i)\b\d{2}[A-Z]{5}\d{4}[A-Z][1-9A-Z]Z[0-9A-Z]\b"
GSTIN_IN_SEARCH_TEXT = r"(?i)\b\d{2}[A-Z]{5}\d{4}[A-Z][A-Z0-9]Z[A-Z0-9]\b"
CIN = r"(?i)\b[LU]\d{5}[A-Z]{2}\d{4}[A-Z]{3}\d{6}\b"
PIN_CODE = r"\b\d{6}\b"
GSTIN_SIGNS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ADDRESS_WORDS = ("road", "street", "nagar", "estate", "industrial", "layout", "floor", "building", "complex", "colony", "phase", "block", "marg", "sector")
CONTACT_LINK_WORDS = ("contact", "about", "team", "management", "leadership", "legal", "privacy", "terms", "gst", "company-info")
FIRST_LINK_WORDS = ("gst", "legal", "contact")
NOT_IN_NAMES = (
    "pvt", "ltd", "limited", "private", "industries", "enterprises", "company", "corporation", "llp", "inc", "solutions", "technologies",
    "email", "phone", "contact", "address", "products", "services", "engineers", "engineering", "about", "us", "home", "careers", "our",
    "more", "read", "learn", "view", "get", "india", "manufacturing", "coimbatore", "who", "are", "automation", "valves", "butterfly",
    "online", "retail", "channel", "customer", "centric", "approach", "major", "market", "bengaluru", "karnataka", "tamil", "nadu",
)
HOURS_WORDS = ("open", "closed", "closes", "opens")
DOT = " · "


def found(text: Column | str, pattern: str) -> Column:
    """The first match, or null."""
    return F.regexp_substr(col(text), F.lit(pattern))


def link_targets(html: Column | str, scheme: str) -> Column:
    """What follows the scheme in the hrefs that have it."""
    return F.transform(F.regexp_extract_all(col(html), F.lit(rf"""(?i)<a\s[^>]*href\s*=\s*["']{scheme}:([^"']*)["']"""), F.lit(1)), strip)


def email(text: Column | str, html: Column | str | None = None) -> Column:
    """The first mailto link, else the first address in the text."""
    seen = found(text, EMAIL)
    if html is None:
        return seen
    linked = F.nullif(strip(F.substring_index(F.try_element_at(link_targets(html, "mailto"), F.lit(1)), "?", 1)), F.lit(""))
    return F.coalesce(linked, seen)


def phones(text: Column | str, html: Column | str | None = None) -> Column:
    """tel links, then numbers in the text; each once, in order."""
    seen = F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(PHONE), F.lit(0))
    if html is not None:
        linked = F.coalesce(F.filter(link_targets(html, "tel"), lambda x: x != ""), F.array().cast("array<string>"))
        seen = F.concat(linked, seen)
    return F.array_distinct(seen)


def cin(text: Column | str) -> Column:
    return F.upper(found(text, CIN))


def gstin_is_valid(gst: Column) -> Column:
    """Whether the fifteenth sign is the check sign of the first fourteen."""
    def weighed(i: Column) -> Column:
        value = (F.position(F.substr(gst, i, F.lit(1)), F.lit(GSTIN_SIGNS)) - 1) * F.when(i % 2 == 1, 1).otherwise(2)
        return F.floor(value / 36) + value % 36

    total = F.aggregate(F.sequence(F.lit(1), F.lit(14)), F.lit(0).cast("long"), lambda a, i: a + weighed(i))
    return F.substr(gst, F.lit(15), F.lit(1)) == F.substr(F.lit(GSTIN_SIGNS), F.pmod(36 - total % 36, F.lit(36)).cast("int") + 1, F.lit(1))


def gstin(text: Column | str, pattern: str = GSTIN) -> Column:
    """The first number in the text with a right check sign."""
    every = F.transform(F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(pattern), F.lit(0)), F.upper)
    return F.try_element_at(F.filter(every, gstin_is_valid), F.lit(1))


def is_address_like(line: Column) -> Column:
    low = F.lower(line)
    hint = F.contains(line, F.lit(","))
    for word in ADDRESS_WORDS:
        hint = hint | F.contains(low, F.lit(word))
    return hint


def address_block(text: Column | str) -> Column:
    """The first address-like line with a PIN code, after those of the two lines before it that are address-like."""
    def block(lines: Column) -> Column:
        def fits(i: Column) -> Column:
            return let(F.element_at(lines, i), lambda line: line.rlike(PIN_CODE) & is_address_like(line))

        def joined(at: Column) -> Column:
            before = F.filter(F.slice(lines, F.greatest(at - 2, F.lit(1)), F.least(at - 1, F.lit(2))), is_address_like)
            return F.when(at.isNotNull(), F.array_join(F.concat(before, F.array(F.element_at(lines, at))), ", "))

        hits = F.filter(F.sequence(F.lit(1), F.size(lines)), fits)
        return let(F.try_element_at(F.when(F.size(lines) > 0, hits), F.lit(1)), joined)

    return let(split_lines(text), block)


def slab_label(text: Column | str) -> Column:
    """A turnover slab without its prefix and year; null where none is given."""
    t = strip(col(text))
    label = F.regexp_extract(t, r"(?i)^Slab:\s*(.+?)(?:\s+FY\s*\d{4}-\d{4})?\s*$", 1)
    usable = ~is_falsy(t) & ~F.contains(F.lower(t), F.lit("not available"))
    return F.when(usable, F.coalesce(F.nullif(strip(label), F.lit("")), t))


def is_company_name(c: Column | str) -> Column:
    name = collapse(F.coalesce(col(c), F.lit("")))
    letters = F.length(F.regexp_replace(name, r"[^\p{L}]", ""))
    return F.length(name).between(2, 160) & ~F.contains(name, F.lit("@")) & ~F.contains(F.lower(name), F.lit("http")) & (F.size(F.split(name, " ")) <= 16) & (letters >= 3)


def is_person_name(c: Column | str) -> Column:
    words = F.transform(F.split(collapse(col(c)), " "), lambda w: F.regexp_replace(w, r"^[.,()]+|[.,()]+$", ""))
    usual = F.forall(words, lambda w: F.regexp_replace(w, "-", "").rlike(r"^\p{L}+$") & ~F.lower(w).isin(*NOT_IN_NAMES))
    return F.size(words).between(2, 5) & usual


def person_name(c: Column | str) -> Column:
    return F.initcap(collapse(c))


def category_and_address(lines: Column) -> Column:
    """struct(category, address) of the first single line whose dotted parts are a category and an address."""
    def parts(line: Column) -> Column:
        return F.transform(F.filter(F.split(line, DOT), lambda s: s.rlike(r"[\p{L}\p{N}]")), strip)

    def fits(line: Column) -> Column:
        p = parts(line)
        opens = F.lit(False)
        for word in HOURS_WORDS:
            opens = opens | F.lower(F.try_element_at(p, F.lit(1))).startswith(word)
        return ~F.contains(line, F.lit("\n")) & F.contains(line, F.lit(DOT)) & (F.size(p) >= 2) & ~opens

    chosen = parts(F.try_element_at(F.filter(lines, fits), F.lit(1)))
    return F.struct(F.try_element_at(chosen, F.lit(1)).alias("category"), F.try_element_at(chosen, F.lit(-1)).alias("address"))


def links(html: Column | str) -> Column:
    """array of struct(href, label) of a page's anchors, in order."""
    raw = F.regexp_extract_all(col(html), F.lit(r"(?is)<a\s[^>]*>.*?</a>"), F.lit(0))
    return F.transform(raw, lambda a: F.struct(F.regexp_extract(a, r"""(?is)href\s*=\s*["']([^"']*)["']""", 1).alias("href"), collapse(F.regexp_replace(F.regexp_replace(a, r"(?s)<[^>]*>", ""), "&amp;", "&")).alias("label")))


def without_dots(path: Column) -> Column:
    """A rooted path whose "." and ".." steps are taken; what would climb above the root stays there. Query and fragment are kept."""
    tail = F.regexp_extract(path, r"([?#].*)$", 1)

    def walked(steps: Column) -> Column:
        none = F.array().cast("array<string>")

        def step(done: Column, s: Column) -> Column:
            up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
            return F.when(s == ".", done).when(s == "..", up).otherwise(F.concat(done, F.array(s)))

        folder = F.when(F.element_at(steps, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(none)
        return F.concat(F.lit("/"), F.array_join(F.concat(F.aggregate(F.slice(steps, F.lit(2), F.size(steps)), none, step), folder), "/"))

    return F.when(path.rlike(r"^[^?#]*/\.\.?(?:[/?#]|$)"), F.concat(let(F.split(F.regexp_replace(path, r"[?#].*$", ""), "/"), walked), tail)).otherwise(path)


def absolute_url(base: Column, href: Column) -> Column:
    """href against base, for absolute, scheme-relative, rooted and plain relative hrefs; the latter two without dot steps."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*((?:/[^?#]*)?)", 1)
    folder = F.when(F.contains(folder, F.lit("/")), F.regexp_extract(folder, r"^(.*/)", 1)).otherwise(F.lit("/"))
    page = F.regexp_replace(base, r"[?#].*$", "")
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, without_dots(href)))
        .when(href.startswith("?") | href.startswith("#"), F.concat(page, href))
        .when(href == "", base)
        .otherwise(F.concat(root, without_dots(F.concat(folder, href))))
    )


def is_same_site(base: Column, url: Column) -> Column:
    return url.rlike("^https?://") & (host(url) == host(base))


def is_organic(url: Column | str) -> Column:
    """A web address outside the search engine's own hosts."""
    u = col(url)
    h = F.lower(F.regexp_extract(u, r"^https?://([^/?#]*)", 1))
    return F.coalesce(u.rlike("^https?://") & (h != "") & ~F.contains(h, F.lit("google.")), F.lit(False))


def is_blocked(text: Column | str) -> Column:
    return F.contains(F.lower(F.coalesce(col(text), F.lit(""))), F.lit("unusual traffic"))


def website_of_listing(href: Column | str) -> Column:
    """Null for a listing's own and advertisement links."""
    h = col(href)
    return F.when(~(is_falsy(h) | h.startswith("/") | F.contains(h, F.lit("google.com/aclk"))), h)


def profile_url(hrefs: Column) -> Column:
    return F.try_element_at(F.filter(hrefs, lambda h: F.contains(h, F.lit("linkedin.com")) & F.contains(h, F.lit("/in/"))), F.lit(1))


def official_name(html: Column | str) -> Column:
    """From og:site_name, application-name or the first heading, whichever first looks like a company's name."""
    def meta(kind: str, name: str) -> Column:
        tag = F.regexp_extract(col(html), rf"""(?is)(<meta\s[^>]*{kind}\s*=\s*["']{name}["'][^>]*>)""", 1)
        return F.regexp_extract(tag, r"""(?is)content\s*=\s*["']([^"']*)["']""", 1)

    heading = F.regexp_replace(F.regexp_extract(col(html), r"(?is)<h1[^>]*>(.*?)</h1>", 1), r"(?s)<[^>]*>", "")
    every = (meta("property", "og:site_name"), meta("name", "application-name"), heading)
    return F.coalesce(*[F.when(is_company_name(c), collapse(c)) for c in every])


#: Fixed values.
LEGAL_SUFFIXES = ("private", "limited", "ltd", "pvt", "llp")


def matches_company_terms(text: Column, name: Column) -> Column:
    """Whether some word of the name, longer than two signs and no legal suffix, is in the text; a name without such words fits all."""
    terms = F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda t: (F.length(t) > 2) & ~t.isin(*LEGAL_SUFFIXES))
    return (F.size(terms) == 0) | F.exists(terms, lambda t: F.contains(F.lower(text), t))


def gstin_of_site(html: Column | str, pdf_texts: Column | None = None, most_pdfs: int = 3) -> Column:
    """The number in the markup, else in the first documents linked from it."""
    if pdf_texts is None:
        return gstin(html)
    numbers = F.filter(F.transform(F.slice(F.coalesce(pdf_texts, F.array().cast("array<string>")), 1, most_pdfs), lambda t: gstin(t)), lambda g: g.isNotNull())
    return F.coalesce(gstin(html), F.try_element_at(numbers, F.lit(1)))


def size_text(size: Column | str) -> Column:
    """Whole kilobytes, at least 1, below a megabyte; megabytes with one decimal above."""
    b = col(size)
    return F.when(b < 1 << 20, F.concat(F.greatest(F.lit(1), F.ceil(b / 1024)).cast("string"), F.lit(" KB"))).otherwise(F.concat(F.replace(F.format_number(b / (1 << 20), 1), F.lit(","), F.lit("")), F.lit(" MB")))


def time_text(iso: Column | str) -> Column:
    """An ISO time as day, month, year and minute."""
    return F.date_format(F.to_timestamp(col(iso)), "d MMM yyyy, HH:mm")


#: The fields of a director in registry documents.
_DIRECTOR = "array<struct<" + ",".join(f"{n}:string" for n in "directorName name fullName FirstName MiddleName LastName designation role MCAUserRole".split()) + ">>"


def first_director(c: Column | str) -> Column:
    """struct(name, designation) of the first director who has a name, from a JSON list."""
    def texts(x: Column, *keys: str) -> Column:
        return F.filter(F.array(*[F.nullif(strip(x[k]), F.lit("")) for k in keys]), lambda t: t.isNotNull())

    def named(x: Column) -> Column:
        parts = F.nullif(F.array_join(texts(x, "FirstName", "MiddleName", "LastName"), " "), F.lit(""))
        name = F.coalesce(F.try_element_at(texts(x, "directorName", "name", "fullName"), F.lit(1)), parts)
        role = F.coalesce(F.try_element_at(texts(x, "designation", "role", "MCAUserRole"), F.lit(1)), F.lit("Director"))
        return F.struct(name.alias("name"), role.alias("designation"))

    return F.try_element_at(F.filter(F.transform(F.from_json(col(c), _DIRECTOR), named), lambda x: x["name"].isNotNull()), F.lit(1))
