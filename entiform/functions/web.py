"""URL, email and HTML expressions."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from entiform import fixed
from entiform.functions.names import literal_map
from entiform.functions.text import BLANK, EDGE, clean, collapse, fold, let, trim

# scheme, user info, host, port, path, query; the fragment is dropped
_URL = r"(?is)^(https?)://([^/?#@\\]*@)?([^/?#:@\\]*)(?::([0-9]*))?([/\\][^?#]*)?(\?[^#]*)?(?:#.*)?$"
_HOST = r"^[^\x00-\x20#%/:<>?@\[\\\]^|\x7F]+$"
_NUMERIC_HOST = r"(?:^|\.)[0-9]+\.?$"
_IPV4 = r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
_EMAIL_SHAPE = r"^[A-Za-z0-9_'+.-]*[A-Za-z0-9_+-]@(?:[A-Za-z0-9][A-Za-z0-9-]*\.)+[A-Za-z]{2,}$"


# characters that are percent-encoded in a path, a query and a fragment
_PATH_UNSAFE = "[^\\x21-\\x7E]|[\"<>`{}]"
_QUERY_UNSAFE = "[^\\x21-\\x7E]|[\"<>']"


def _escape(c: Column, unsafe: str) -> Column:
    """Percent-encode the unsafe characters; texts without one pass unchanged."""
    one = lambda ch: F.when(F.rlike(ch, F.lit(unsafe)), F.replace(F.url_encode(ch), F.lit("+"), F.lit("%20"))).otherwise(ch)
    return F.when(F.rlike(c, F.lit(unsafe)), F.array_join(F.transform(F.split(c, ""), one), "")).otherwise(c)


def escape_path(c: Column) -> Column:
    return let(F.replace(c, F.lit("\\"), F.lit("/")), lambda p: _escape(p, _PATH_UNSAFE))


def _url_parts(url: Column) -> Column:
    """Scheme, user info, host, port, path and query (array); the whole text where it is no http(s) URL."""
    return F.split(F.regexp_replace(url, _URL, "$1\u0001$2\u0001$3\u0001$4\u0001$5\u0001$6"), "\u0001")


def canonical_url(url: Column) -> Column:
    """Canonical form of an absolute http(s) URL without fragment; NULL when it is not one."""
    return let(_url_parts(url), _rebuild)


def is_url(url: Column) -> Column:
    """Whether the text has a canonical form."""
    return F.coalesce(let(_url_parts(url), lambda parts: _good(parts) & F.get(parts, F.lit(5)).isNotNull()), F.lit(False))


def _good(parts: Column) -> Column:
    """Whether host and port are those of a URL."""
    port = F.get(parts, F.lit(3))
    return let(F.lower(F.get(parts, F.lit(2))), lambda host: (
        F.rlike(host, F.lit(_HOST))
        & (~F.rlike(host, F.lit(_NUMERIC_HOST)) | F.rlike(host, F.lit(_IPV4)))
        & ((port == "") | F.coalesce(port.try_cast("int") <= 65535, F.lit(False)))))


def _rebuild(parts: Column) -> Column:
    """URL from scheme, user info, host, port, path and query."""
    def part(i: int) -> Column:
        return F.get(parts, F.lit(i))

    scheme, host, port = F.lower(part(0)), F.lower(part(2)), part(3)
    default_port = F.when(scheme == "https", F.lit("443")).otherwise(F.lit("80"))
    shown_port = F.when((port == "") | (port == default_port), F.lit("")).otherwise(F.concat(F.lit(":"), port))
    path = F.when(part(4) == "", F.lit("/")).otherwise(let(escape_path(part(4)), without_dots))
    return F.when(_good(parts), F.concat(
        scheme, F.lit("://"), part(1), host, shown_port, path, _escape(part(5), _QUERY_UNSAFE)))


def without_dots(path: Column) -> Column:
    """A path from `/` on with its `.` and `..` segments carried out."""
    dot, up = r"(?i)^(?:\.|%2e)$", r"(?i)^(?:\.|%2e){2}$"
    segments = F.split(F.regexp_replace(path, r"(?i)/((?:\.|%2e){1,2})$", "/$1/"), "/")
    walked = F.aggregate(
        segments, F.array().cast("array<string>"),
        lambda done, s: F.when(F.rlike(s, F.lit(dot)), done)
        .when(F.rlike(s, F.lit(up)), F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.concat(done, F.array(s))))
    dotted = F.rlike(path, F.lit(r"(?i)/(?:\.|%2e){1,2}(?:/|$)"))
    return F.when(dotted, F.array_join(walked, "/")).otherwise(path)


def clean_url(raw: Column) -> Column:
    """https:// added when no scheme is given; canonical; NULL on failure or empty input."""
    whole = let(trim(raw), lambda t: F.when(F.rlike(t, F.lit("(?i)^https?://")), t).otherwise(F.concat(F.lit("https://"), t)))
    return F.when(F.length(raw) > 0, canonical_url(whole))


def clean_record_url(raw: Column) -> Column:
    """As clean_url on a cleaned value, without one final slash."""
    return F.regexp_replace(clean_url(clean(raw)), "/$", "")


def url_host(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@\\]*@)?([^/?#:@\\]*)", 1)
    return F.nullif(F.lower(host), F.lit(""))


def domain_of(url: Column) -> Column:
    return F.regexp_replace(url_host(url), r"^www\.", "")


def url_origin(url: Column) -> Column:
    return F.regexp_extract(url, r"(?i)^([a-z][a-z0-9+.-]*://[^/?#\\]*)", 1)


def url_path(url: Column) -> Column:
    """Path without a final slash; '' for the home page."""
    path = F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.regexp_replace(path, "/+$", "")


def resolve_url(href: Column, base: Column) -> Column:
    """Absolute form of a link found on a site with the given base URL; a link that cannot be resolved stays."""
    origin = url_origin(base)
    plain_base = F.regexp_replace(base, "(?s)[?#].*$", "")
    base_path = F.substring(plain_base, F.length(origin) + 1, F.length(plain_base))
    folder = F.when(F.contains(base_path, F.lit("/")), F.regexp_replace(base_path, "[^/]*$", "")).otherwise(F.lit("/"))
    tail = F.regexp_extract(href, r"(?s)([?#].*)$", 1)
    local = F.regexp_replace(href, r"(?s)[?#].*$", "")
    other_scheme = F.rlike(href, F.lit("(?i)^[a-z][a-z0-9+.-]*:")) & ~F.rlike(href, F.lit("(?i)^https?:"))
    safe_tail = _escape(tail, _QUERY_UNSAFE)
    target = (
        F.when(F.rlike(href, F.lit("(?i)^https?://")), _with_fragment(href))
        .when(href.startswith("//"), _with_fragment(F.concat(F.regexp_extract(base, "^([^:]*:)", 1), href)))
        .when(local == "", F.concat(F.when(tail.startswith("?"), plain_base)
                                    .otherwise(F.regexp_replace(base, "(?s)#.*$", "")), safe_tail))
        .when(local.startswith("/"), F.concat(origin, without_dots(escape_path(local)), safe_tail))
        .otherwise(F.concat(origin, without_dots(escape_path(F.concat(folder, local))), safe_tail))
    )
    return F.when(other_scheme, href).otherwise(F.coalesce(target, href))


def _with_fragment(url: Column) -> Column:
    return F.concat(canonical_url(url), _escape(F.regexp_extract(url, "(?s)(#.*)$", 1), _QUERY_UNSAFE))


def clean_email(raw: Column) -> Column:
    """First address in the lower-cased text."""
    return F.nullif(F.regexp_extract(F.lower(raw), EMAIL, 0), F.lit(""))


def email_ok(email: Column) -> Column:
    return (~email.startswith(".")) & (~F.contains(email, F.lit(".."))) & F.rlike(email, F.lit(_EMAIL_SHAPE))


def email_domain(email: Column) -> Column:
    return F.lower(F.regexp_extract(email, "^[^@]*@([^@]*)", 1))


def usable_email(email: Column, longest: int | None = fixed.EMAIL_MAX_LENGTH) -> Column:
    """Not an asset name, placeholder domain, hash or escaped bracket; at most `longest` characters (None: any)."""
    return ~(
        F.rlike(email, F.lit(fixed.EMAIL_ASSET)) | F.rlike(email, F.lit(fixed.EMAIL_PLACEHOLDER))
        | F.rlike(email, F.lit(fixed.EMAIL_HASH)) | F.rlike(email, F.lit(fixed.EMAIL_ESCAPED))
    ) & (F.lit(True) if longest is None else F.length(email) <= longest)


def emails_in(text: Column) -> Column:
    """Usable addresses in a text, lower case, distinct, in order (array)."""
    found = F.transform(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0)), F.lower)
    return F.array_distinct(F.filter(found, lambda e: usable_email(e)))


# --- HTML ---------------------------------------------------------------------------------------

_HIDDEN = ("script", "style", "nav", "footer", "noscript", "header", "svg")
# Entities short enough to replace one by one; the rest goes through the map below.
_COMMON = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "#39": "'", "nbsp": " "}
_NAMED = {n: chr(c) for n, c in name2codepoint.items() if n not in _COMMON and n != "amp"}


def _decode_piece(piece: Column) -> Column:
    name = F.regexp_extract(piece, "^(#?[A-Za-z0-9]+);", 1)
    decimal = F.try_to_number(F.regexp_extract(name, "^#([0-9]{1,7})$", 1), F.lit("9999999")).cast("bigint")
    hexa = F.conv(F.regexp_extract(name, "^#[xX]([0-9A-Fa-f]{1,6})$", 1), 16, 10).cast("bigint")
    code = F.coalesce(decimal, hexa)
    char = F.when((code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF),
                  F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    value = F.coalesce(F.try_element_at(literal_map(_NAMED), name), char)
    rest = F.substring(piece, F.length(name) + 2, F.length(piece))
    return F.coalesce(F.concat(value, rest), F.concat(F.lit("&"), piece))


def decode_entities(c: Column) -> Column:
    out = c
    for name, char in _COMMON.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    rare = F.rlike(out, F.lit("&(?!amp;)#?[A-Za-z0-9]+;"))
    pieces = F.transform(
        F.split(out, "&(?!amp;)"), lambda p, i: F.when(i == 0, p).otherwise(_decode_piece(p)))
    decoded = F.when(rare, F.array_join(pieces, "")).otherwise(out)
    return F.replace(decoded, F.lit("&amp;"), F.lit("&"))


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, r"(?s)</?[A-Za-z][^>]*>|<![^>]*>", "")


def _drop_elements(html: Column, names: tuple[str, ...]) -> Column:
    pattern = rf"(?is)<({'|'.join(names)})(?![\w-])[^>]*>.*?(?:</\1\s*>|\z)"
    return F.regexp_replace(html, pattern, "")


def body_text(html: Column) -> Column:
    """Text of the page body, scripts and styles included as the page's own text nodes are."""
    inner = F.regexp_replace(F.regexp_replace(html, "(?s)<!--.*?(?:-->|\\z)", ""),
                             r"(?is)<head(?![\w-])[^>]*>.*?</head\s*>", "")
    return decode_entities(strip_tags(inner))


def visible_text(html: Column, max_chars: int | None = fixed.PAGE_TEXT_CUT) -> Column:
    """Readable text of a page: hidden parts dropped, blanks collapsed, NULL when empty, cut to `max_chars` (None: whole)."""
    inner = _drop_elements(html, ("script", "style"))
    inner = F.regexp_replace(inner, "(?s)<!--.*?(?:-->|\\z)", "")
    inner = _drop_elements(inner, tuple(n for n in _HIDDEN if n not in ("script", "style")))
    inner = F.regexp_replace(inner, r"(?is)<head(?![\w-])[^>]*>.*?</head\s*>", "")
    text = collapse(decode_entities(strip_tags(inner)))
    whole = F.nullif(text, F.lit(""))
    return whole if max_chars is None else F.substring(whole, 1, max_chars)


_HREF = r"""(?is)<a(?![\w-])[^>]*?\shref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def raw_hrefs(html: Column) -> Column:
    """href values of a page's links in order (array)."""
    return F.transform(
        F.regexp_extract_all(html, F.lit(_HREF), F.lit(1)),
        lambda h: trim(decode_entities(F.regexp_replace(h, "^[\"']|[\"']$", ""))),
    )


# --- people, companies, networks ------------------------------------------------------------------

_UPPER = "A-ZÀ-Ÿ"
_PERSON = rf"[{_UPPER}][\p{{L}}'’-]+(?:\s+[{_UPPER}][\p{{L}}'’.-]+){{1,2}}"
_TITLE = "(?:" + "|".join(fixed.PERSON_TITLES) + ")"
_NAME_TITLE = rf"({_PERSON})\s*[,–—-]\s*({_TITLE})"
_TITLE_NAME = rf"({_TITLE})\s*[:–—-]\s*({_PERSON})"
_LEGAL = rf"(?=[{_UPPER}]){EDGE}([{_UPPER}][\w&'.\- ]{{2,60}}?)\s+({fixed.LEGAL_FORMS}){EDGE}"


def legal_name(text: Column) -> Column:
    """First `Name FORM` in a text; NULL when there is none."""
    def named(flat: Column) -> Column:
        name = trim(F.regexp_extract(flat, _LEGAL, 1))
        return let(F.upper(F.replace(F.regexp_extract(flat, _LEGAL, 2), F.lit("."), F.lit(""))), lambda form: F.when(
            form != "", trim(F.concat(name, F.lit(" "), form))))

    return let(F.regexp_replace(text, f"{BLANK}+", " "), named)


def people_in(text: Column) -> Column:
    """`Name, Title` pairs, then `Title: Name` pairs (array of struct<full_name,title_raw>)."""
    flat = F.regexp_replace(text, f"{BLANK}+", " ")

    def pairs(pattern: str, name_group: int, title_group: int) -> Column:
        return F.arrays_zip(
            F.regexp_extract_all(flat, F.lit(pattern), F.lit(name_group)).alias("full_name"),
            F.regexp_extract_all(flat, F.lit(pattern), F.lit(title_group)).alias("title_raw"),
        )

    both = F.concat(pairs(_NAME_TITLE, 1, 2), pairs(_TITLE_NAME, 2, 1))
    trimmed = F.transform(both, lambda p: F.struct(
        trim(p["full_name"]).alias("full_name"), trim(p["title_raw"]).alias("title_raw")))
    return F.filter(trimmed, lambda p: F.size(F.split(p["full_name"], " ")) <= 4)


def _matches(pattern: str):
    return lambda text: F.rlike(text, F.lit(pattern))


def social_links(links: Column, strict_hosts: bool = False) -> Column:
    """First link per network out of an array of links (struct of the seven networks)."""
    web = F.filter(links, lambda h: F.rlike(h, F.lit("(?i)^https?://")))
    host = "(?i)(?://|[.])" if strict_hosts else "(?i)"
    fields = []
    for name, pattern, unwanted in fixed.SOCIAL_NETWORKS:
        full = host + pattern + (f"(?!{unwanted})" if unwanted else "")
        first = F.get(F.filter(web, _matches(full)), F.lit(0))
        fields.append(F.regexp_replace(F.split(first, "[?]", 2)[0], "/$", "").alias(name))
    numbers = F.filter(
        F.transform(web, lambda h: F.regexp_extract(h, "(?i)" + fixed.WHATSAPP_LINK, 1)), lambda n: n != "")
    fields.append(F.concat(F.lit("+"), F.get(numbers, F.lit(0))).alias("whatsapp"))
    return F.struct(*fields)


def guess_email(full_name: Column, emails: Column) -> Column:
    """First address whose local part is built from the person's first and last name."""
    parts = F.split(fold(full_name), f"{BLANK}+")
    first, last = F.coalesce(F.get(parts, F.lit(0)), F.lit("")), F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
    initial = F.substring(first, 1, 1)
    shapes = F.array(
        first, F.concat(first, F.lit("."), last), F.concat(initial, F.lit("."), last),
        F.concat(first, last), F.concat(initial, last))
    return F.get(F.filter(
        emails, lambda e: F.array_contains(shapes, F.split(e, "@", 2)[0])), F.lit(0))
