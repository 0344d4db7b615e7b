"""Contact details out of page and document tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entiform import fixed, schemas
from entiform.functions import names, web
from entiform.functions.phone import PLANS, standardize_phone
from entiform.functions.storage import tasks_for
from entiform.functions.text import BLANK, let, ordered_union
from entiform.operators.lookups import lookup_join
from entiform.operators.merge import fill_socials, merge_contacts
from entiform.operators.ordering import keep_per_key, page_budget


def extract_emails(pages: DataFrame, text: str = "html", key: str = "page_id") -> DataFrame:
    """(key, pos, email): usable addresses of a text, lower case, distinct, in order."""
    with_at = pages.filter(F.contains(F.col(text), F.lit("@")))
    return with_at.select(key, F.posexplode(web.emails_in(F.col(text))).alias("pos", "email"))


def relevant_emails(found: DataFrame, host: str = "host", email: str = "email") -> DataFrame:
    """Addresses of the site's own domain or of a free mail provider."""
    domain = web.email_domain(F.col(email))
    own = F.regexp_replace(F.col(host), r"^www\.", "")
    return found.filter((domain == own) | F.rlike(domain, F.lit(fixed.FREE_MAIL)))


def _chunks(text: Column) -> Column:
    """Pieces of a text that hold enough digits to be a number."""
    pieces = F.split(text, f"[,;/]|{BLANK}{{2,}}")
    return F.filter(pieces, lambda p: F.rlike(p, F.lit("[0-9].?[0-9]|[0-9][^0-9]*[0-9]")))


def _dialled(links: Column) -> Column:
    """Numbers of the `tel:` links (array)."""
    calls = F.filter(links, lambda h: h.startswith("tel:"))
    return F.transform(calls, lambda h: F.coalesce(
        F.try_url_decode(F.replace(F.substr(h, F.lit(5)), F.lit("+"), F.lit("%2B"))), F.substr(h, F.lit(5))))


def phones_in(texts: Column, country: Column, plans=PLANS) -> Column:
    """Valid numbers in an array of texts, distinct, in order (array)."""
    chunks = F.flatten(F.transform(texts, _chunks))
    read = F.transform(chunks, lambda c: standardize_phone(c, country, plans))
    return F.array_distinct(F.transform(F.filter(read, lambda n: n["valid"]), lambda n: n["e164"]))


def extract_phones(pages: DataFrame, country: str = fixed.DEFAULT_COUNTRY, text: str = "text", key: str = "page_id",
                   links: str | None = None, plans=PLANS) -> DataFrame:
    """(key, pos, e164): valid numbers, `tel:` links first, then the text; distinct, in order."""
    texts = F.array(F.col(text))
    if links:
        texts = F.concat(_dialled(F.col(links)), texts)
    return pages.select(key, F.posexplode(phones_in(texts, F.lit(country), plans)).alias("pos", "e164"))


def page_links(pages: DataFrame, base: str | None = None, key: str = "page_id") -> DataFrame:
    """(key, pos, href, url): every link resolved against the site's base URL (default: the page's origin)."""
    root = F.col(base) if base else F.concat(web.url_origin(F.col("url")), F.lit("/"))
    rows = pages.select(key, root.alias("_base"), F.posexplode(web.raw_hrefs(F.col("html"))).alias("pos", "href"))
    return rows.withColumn("url", web.resolve_url(F.col("href"), F.col("_base"))).drop("_base")


def extract_socials(pages: DataFrame, links: str = "links", key: str = "page_id", strict_hosts: bool = False
                    ) -> DataFrame:
    """(key, seven networks): the first matching link of each."""
    return pages.select(key, web.social_links(F.col(links), strict_hosts).alias("s")).select(key, "s.*")


def extract_legal_names(pages: DataFrame, text: str = "text", key: str = "site", rank: str = "path_rank") -> DataFrame:
    """(key, legal_name): the first page of a site that shows a registered name."""
    found = pages.select(key, rank, web.legal_name(F.col(text)).alias("legal_name")).filter("legal_name IS NOT NULL")
    return keep_per_key(found, key, rank).drop(rank)


def extract_people(pages: DataFrame, text: str = "text", key: str = "page_id") -> DataFrame:
    """(key, pos, full_name, title_raw, role, confidence): first mention of each person on a page."""
    rows = pages.select(key, F.posexplode(web.people_in(F.col(text))).alias("pos", "p")).select(
        key, "pos", "p.*", F.lower("p.full_name").alias("_name"))
    first = keep_per_key(rows, [key, "_name"], "pos").drop("_name")
    return first.withColumns({
        "role": names.infer_role(F.col("title_raw")), "confidence": F.lit(fixed.PERSON_CONFIDENCE)})


def visible_text(pages: DataFrame, max_chars: int | None = fixed.PAGE_TEXT_CUT, key: str = "page_id") -> DataFrame:
    """(key, text): readable text of each page, cut to `max_chars` (None: whole)."""
    return pages.select(key, web.visible_text(F.col("html"), max_chars).alias("text"))


def _contact_pages(pages: DataFrame) -> DataFrame:
    paths = F.array(*[F.lit(p) for p in fixed.SITE_PATHS])
    rank = F.nullif(F.array_position(paths, F.lower(web.url_path(F.col("url")))), F.lit(0)) - 1
    ranked = pages.withColumns({
        "site": web.url_host(F.col("url")), "path_rank": rank.cast("int"), "ok": F.col("html").isNotNull()})
    return ranked.filter("path_rank IS NOT NULL")


def site_pages(pages: DataFrame, max_pages: int = fixed.MAX_PAGES, parts: int | None = None) -> DataFrame:
    """Pages of the contact paths within each site's budget: adds site and path_rank. A NULL html is a failed visit."""
    return page_budget(_contact_pages(pages), max_pages=max_pages, parts=parts)


def pages_for_leads(leads: DataFrame, pages: DataFrame) -> DataFrame:
    """(ord, id, site, page_id): the crawled pages of each lead's web host."""
    sites = leads.select("ord", "id", web.url_host(F.col("website_url")).alias("site")).filter("site IS NOT NULL")
    return lookup_join(sites, pages.select("site", "page_id"), ["site"]).filter("page_id IS NOT NULL")


def site_facts(pages: DataFrame, country: str = fixed.DEFAULT_COUNTRY, max_pages: int = fixed.MAX_PAGES,
               plans=PLANS, parts: int | None = None) -> DataFrame:
    """(site, emails, phones, socials, legal_name, people): what the budgeted pages of a site show.

    Each site is read once, however many leads name it. `parts`: number of tasks, by default as many as the pages' html needs.
    """
    visited = site_pages(pages, max_pages, parts or tasks_for(_contact_pages(pages), ["html"]))
    base = F.concat(web.url_origin(F.col("url")), F.lit("/"))
    links = F.transform(web.raw_hrefs(F.col("html")), lambda h: web.resolve_url(h, base))
    read = visited.select(
        "site", "path_rank", "html", web.body_text(F.col("html")).alias("text"), links.alias("links"))
    rows = read.select(
        "site", "path_rank", web.emails_in(F.col("html")).alias("emails"),
        phones_in(F.concat(_dialled(F.col("links")), F.array("text")), F.lit(country), plans).alias("phones"),
        web.social_links(F.col("links")).alias("socials"), web.legal_name(F.col("text")).alias("legal_name"),
        web.people_in(F.col("text")).alias("people"))
    # at most max_pages rows per site meet here
    by_page = F.array_sort(F.collect_list(
        F.struct("path_rank", "emails", "phones", "socials", "legal_name", "people")))
    joined = rows.groupBy("site").agg(by_page.alias("pages"))
    own = F.regexp_replace("site", r"^www\.", "")

    def relevant(e: Column) -> Column:
        domain = web.email_domain(e)
        return (domain == own) | F.rlike(domain, F.lit(fixed.FREE_MAIL))

    # the first page that shows a network counts
    networks = F.struct(*[
        F.try_element_at(F.filter(F.transform("pages", lambda p: p["socials"][n]), lambda v: v.isNotNull()), F.lit(1))
        .alias(n) for n in fixed.SOCIAL_FIELDS])
    names_found = F.filter(F.transform("pages", lambda p: p["legal_name"]), lambda v: v.isNotNull())
    return joined.select(
        "site",
        F.filter(F.array_distinct(F.flatten("pages.emails")), relevant).alias("emails"),
        F.array_distinct(F.flatten("pages.phones")).alias("phones"),
        networks.cast(schemas.SOCIALS).alias("socials"),
        F.get(names_found, F.lit(0)).alias("legal_name"),
        F.flatten("pages.people").alias("people"))


def site_contacts(existing: Column, people: Column, emails: Column) -> Column:
    """People found on a site merged into the known contacts; an address is guessed for those without one."""
    none = F.lit(None).cast("string")

    def as_contacts(found: Column) -> Column:
        return let(F.transform(found, lambda p: F.lower(p["full_name"])), lambda lowered: F.transform(
            F.filter(found, lambda p, i: F.array_position(lowered, F.get(lowered, i)) == i + 1),
            lambda p: F.struct(
                p["full_name"].alias("full_name"), names.infer_role(p["title_raw"]).alias("role"),
                p["title_raw"].alias("title_raw"), none.alias("email_direct"), none.alias("phone_direct"),
                none.alias("linkedin_url"), F.lit(fixed.PERSON_CONFIDENCE).alias("confidence"))))

    merged = merge_contacts(existing, let(people, as_contacts).cast(f"array<{schemas.CONTACT}>"))
    return F.transform(merged, lambda c: c.withField("email_direct", F.coalesce(
        F.nullif(c["email_direct"], F.lit("")), web.guess_email(c["full_name"], emails))))


def primary_email(own: Column, emails: Column) -> Column:
    """The lead's own address, else the first general mailbox, else the first address."""
    general = F.filter(emails, lambda e: F.rlike(e, F.lit(fixed.PRIMARY_MAILBOXES)))
    return F.coalesce(F.nullif(own, F.lit("")), F.get(general, F.lit(0)), F.get(emails, F.lit(0)))


def enrich_from_pages(leads: DataFrame, pages: DataFrame, country: str = fixed.DEFAULT_COUNTRY,
                      max_pages: int = fixed.MAX_PAGES, plans=PLANS) -> DataFrame:
    """Patch rows from the pages of each lead's site. Leads without a website have no row."""
    page_tasks = tasks_for(_contact_pages(pages), ["html"])
    facts = site_facts(pages, country, max_pages, plans, page_tasks).withColumnsRenamed(
        {n: f"_{n}" for n in ("emails", "phones", "socials", "legal_name", "people")})
    sites = leads.filter(F.length("website_url") > 0).select(
        "ord", "id", "email", "emails", "phones", "socials", "contacts", web.url_host(F.col("website_url")).alias("site"))
    joined = lookup_join(sites, facts, ["site"], parts=max(page_tasks, tasks_for(leads)))
    people = F.coalesce("_people", F.array().cast("array<struct<full_name:string,title_raw:string>>"))
    every = ordered_union(F.col("emails"), F.col("_emails"))
    staged = joined.withColumns({"_every": every, "_all_people": people})
    chosen = primary_email(F.col("email"), F.col("_every"))
    return staged.select(
        "ord", "id", F.col("_every").alias("emails"), ordered_union(F.col("phones"), F.col("_phones")).alias("phones"),
        fill_socials(F.col("socials"), F.col("_socials")).cast(schemas.SOCIALS).alias("socials"),
        site_contacts(F.col("contacts"), F.col("_all_people"), F.col("_every")).alias("contacts"),
        F.when(~chosen.eqNullSafe(F.col("email")), chosen).alias("email"), F.col("_legal_name").alias("legal_name"))
