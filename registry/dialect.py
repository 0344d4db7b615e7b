"""DuckDB SQL snippets for the scalar rules."""

from __future__ import annotations

from entiform import fixed
from entiform.functions.text import BLANKS
from registry.views import VIEWS


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_BLANK_LIT = lit(BLANKS)


def with_(*parts: str, views: tuple[str, ...] = ()) -> str:
    """WITH clause of the named views and the given `name AS (...)` parts."""
    return "WITH " + ",\n".join([*(f"{v} AS ({VIEWS[v]})" for v in views), *parts]) + "\n"


def trim(x: str) -> str:
    return f"trim({x}, {_BLANK_LIT})"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, {lit('[' + BLANKS + ']+')}, ' ', 'g'), ' ')"


def blank_null(x: str) -> str:
    return f"nullif({trim(x)}, '')"


def fold(x: str) -> str:
    return f"lower(strip_accents({x}))"


def alnum(x: str) -> str:
    return f"regexp_replace({x}, '[^a-z0-9]', '', 'g')"


def title(x: str) -> str:
    return f"array_to_string(list_transform(string_split(lower({x}), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


def city(x: str) -> str:
    cut = f"trim(regexp_replace({collapse(x)}, ' *[,–-].*$', ''))"
    names = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in fixed.CITY_ALIASES.items())
    return f"coalesce(CASE {fold(cut)} {names} ELSE {title(cut)} END, '')"


def city_key(x: str) -> str:
    return alnum(fold(city(x)))


def without(x: str, words) -> str:
    return f"regexp_replace({fold(x)}, {lit(chr(92) + 'b(' + '|'.join(words) + ')' + chr(92) + 'b')}, '', 'g')"


def company_key(x: str) -> str:
    return f"coalesce({alnum(without(x, fixed.COMPANY_WORDS))}, '')"


def brand_key(x: str) -> str:
    return f"coalesce({alnum(without(x, fixed.BRAND_WORDS))}, '')"


def words(x: str) -> str:
    stop = ", ".join(lit(w) for w in fixed.SLUG_WORDS)
    split = f"regexp_split_to_array(regexp_replace({fold(x)}, '[''’]', '', 'g'), '[^a-z0-9]+')"
    return f"list_filter({split}, lambda w: length(w) >= 2 AND w NOT IN ({stop}))"


def slug(name: str, place: str) -> str:
    return (f"({alnum(fold(place))} || '-' || coalesce(nullif(array_to_string({words(name)}, ''), ''), "
            f"{lit(fixed.EMPTY_SLUG)}))")


def clean(x: str) -> str:
    return f"CASE WHEN lower({trim(x)}) IN ('', 'null', 'n/a') THEN NULL ELSE {trim(x)} END"


def url(x: str) -> str:
    """Canonical URL for plain ASCII http(s) addresses."""
    whole = f"regexp_replace(CASE WHEN regexp_matches({trim(x)}, '^(?i)https?://') THEN {trim(x)} ELSE 'https://' || {trim(x)} END, '#.*$', '')"
    host = f"lower(regexp_extract({whole}, '^[^:]*://([^/?]*)', 1))"
    rest = f"regexp_extract({whole}, '^[^:]*://[^/?]*(.*)$', 1)"
    return (f"CASE WHEN {x} IS NULL OR {host} = '' OR contains({host}, ' ') THEN NULL ELSE lower(regexp_extract({whole}, '^[^:]*')) || '://' || {host} || "
            f"CASE WHEN {rest} = '' THEN '/' ELSE {rest} END END")


def domain(x: str) -> str:
    return f"regexp_replace(nullif(lower(regexp_extract({x}, '^[^:]*://([^/?#:]*)', 1)), ''), '^www\\.', '')"


def phone_digits(raw: str) -> str:
    chunk = trim(f"regexp_split_to_array({raw}, {lit('[/;]|[' + BLANKS + ']{2,}')})[1]")
    return f"CASE WHEN regexp_full_match({chunk}, '[+]?[0-9][0-9 ().-]+') THEN regexp_replace({chunk}, '[^+0-9]', '', 'g') END"


def e164(raw: str, code: str) -> str:
    d = phone_digits(raw)
    return (f"CASE WHEN {d} LIKE '+%' THEN {d} WHEN {d} LIKE '00%' THEN '+' || substr({d}, 3) ELSE '+' || {code} || {d} END")


CM_VALID = "[+]237(2(22|33|4[23])[0-9]{6}|6([25-9][0-9]|40)[0-9]{6}|88[0-9]{6,7})"


def first_email(x: str) -> str:
    return f"nullif(regexp_extract(lower({x}), '[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{{2,}}'), '')"


def unaccented_title_role(x: str) -> str:
    t = f"strip_accents({x})"
    cases = []
    for name, anywhere, alone in fixed.ROLE_PATTERNS:
        pattern = "(?i)" + anywhere + (f"|\\b({alone})\\b" if alone else "")
        cases.append(f"WHEN regexp_matches({t}, {lit(pattern)}) OR regexp_matches({x}, {lit(pattern)}) THEN {lit(name)}")
    return f"CASE {' '.join(cases)} ELSE 'OTHER' END"


def brand(x: str) -> str:
    return "CASE " + " ".join(
        f"WHEN regexp_matches({x}, {lit('(?i)' + chr(92) + 'b' + p + chr(92) + 'b')}) THEN {lit(n)}"
        for n, p in fixed.KNOWN_BRANDS) + " END"


# --- shared chains of subqueries -----------------------------------------------------------------------

_SEGMENTS = f"""list_filter(list_transform(list_filter(list_transform(string_split(address, ','), lambda s: {trim('s')}),
 lambda s: s <> '' AND lower(s) NOT IN ({', '.join(lit(w) for w in fixed.COUNTRY_WORDS)})),
 lambda s: {collapse("regexp_replace(s, '" + chr(92) + "b[0-9]{4,6}" + chr(92) + "b', '', 'g')")}), lambda s: NOT regexp_full_match(s, '[0-9]*'))"""

RAW = f"""raw AS (SELECT ord, search_id, 'google-maps' AS source, place_url AS source_url, {trim('name')} AS company_name,
 {trim('category')} AS category, ({_SEGMENTS})[-1] AS city, 'CM' AS country, {trim('address')} AS address,
 CAST(regexp_extract(place_url, '@(-?[0-9.]+),', 1) AS DOUBLE) AS latitude,
 CAST(regexp_extract(place_url, '@-?[0-9.]+,(-?[0-9.]+)', 1) AS DOUBLE) AS longitude,
 {trim('phone')} AS phone_raw, {trim('website')} AS website_url,
 CASE WHEN CAST(regexp_extract(replace(rating_text, ',', '.'), '[0-9]+(\\.[0-9]+)?') AS DOUBLE) <= 5
  THEN CAST(regexp_extract(replace(rating_text, ',', '.'), '[0-9]+(\\.[0-9]+)?') AS DOUBLE) END AS google_rating,
 CAST(nullif(regexp_replace(reviews_text, '[^0-9]', '', 'g'), '') AS BIGINT) AS reviews_count FROM places_v)"""

LEADS = f"""leads AS (SELECT ord, search_id,
 source || '_' || substr(sha1(source || '|' || lower({trim('company_name')}) || '|' || {city_key('city')}), 1, 16) AS id,
 source, {url('source_url')} AS source_url, {collapse('company_name')} AS company_name, {blank_null('category')} AS category,
 {city('city')} AS city, country, nullif({collapse('address')}, '') AS address, latitude, longitude,
 {blank_null('phone_raw')} AS phone_raw, {e164('phone_raw', lit('237'))} AS phone_normalized,
 {url('website_url')} AS website_url, google_rating, reviews_count,
 coalesce(regexp_full_match({e164('phone_raw', lit('237'))}, {lit(CM_VALID)}), FALSE) AS phone_valid FROM raw)"""

KEYS = f"""keys AS MATERIALIZED (SELECT ord, id, CASE WHEN {company_key('company_name')} <> '' THEN {company_key('company_name')} || '::' || {city_key('city')} END AS k1,
 phone_normalized AS k2, {domain('website_url')} AS k3 FROM leads)"""


def rounds(n: int = 12) -> list[str]:
    """Greedy rounds over keys(ord, id, k1, k2, k3): `owners(s, k, owner_ord)` and `accepted(ord)`."""
    parts = [
        "lk AS MATERIALIZED (SELECT ord, 1 AS s, k1 AS k FROM keys WHERE k1 IS NOT NULL UNION ALL "
        "SELECT ord, 2, k2 FROM keys WHERE k2 IS NOT NULL UNION ALL SELECT ord, 3, k3 FROM keys WHERE k3 IS NOT NULL)",
        "nk AS MATERIALIZED (SELECT ord, count(*) AS n FROM lk GROUP BY ord)",
        "l0 AS MATERIALIZED (SELECT * FROM lk)",
    ]
    for i in range(n):
        parts += [
            f"m{i} AS MATERIALIZED (SELECT s, k, min(ord) AS ord FROM l{i} GROUP BY s, k)",
            f"w{i} AS MATERIALIZED (SELECT m.ord FROM m{i} m JOIN nk USING (ord) GROUP BY m.ord, nk.n HAVING count(*) = nk.n)",
            f"h{i} AS MATERIALIZED (SELECT DISTINCT l.ord FROM l{i} l JOIN l{i} o USING (s, k) SEMI JOIN w{i} w ON o.ord = w.ord)",
            f"l{i + 1} AS MATERIALIZED (SELECT * FROM l{i} l ANTI JOIN h{i} h ON l.ord = h.ord)",
        ]
    won = " UNION ALL ".join(f"SELECT ord FROM w{i}" for i in range(n))
    parts += [
        f"won AS MATERIALIZED (SELECT ord FROM ({won}) WHERE CASE WHEN (SELECT count(*) FROM l{n}) > 0 THEN error('open rows left') ELSE TRUE END)",
        "accepted AS MATERIALIZED (SELECT ord FROM won UNION ALL SELECT ord FROM keys WHERE coalesce(k1, k2, k3) IS NULL)",
        "owners AS MATERIALIZED (SELECT lk.s, lk.k, lk.ord AS owner_ord, keys.id AS owner_id FROM lk SEMI JOIN won ON lk.ord = won.ord JOIN keys USING (ord))",
        "decisions AS MATERIALIZED (SELECT a.ord, a.id, o1.owner_ord < a.ord AS h1, o2.owner_ord < a.ord AS h2, o3.owner_ord < a.ord AS h3, "
        "o1.owner_id AS i1, o2.owner_id AS i2, o3.owner_id AS i3 FROM keys a LEFT JOIN owners o1 ON o1.s = 1 AND o1.k = a.k1 "
        "LEFT JOIN owners o2 ON o2.s = 2 AND o2.k = a.k2 LEFT JOIN owners o3 ON o3.s = 3 AND o3.k = a.k3)",
    ]
    return parts
