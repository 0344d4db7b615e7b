"""Email verdicts from tables of domain and address facts.

`domain_facts(domain, has_mx, probed, catch_all)`: what is known of a mail domain; `probed` is false when
its server could not be asked. `address_facts(email, accepted)`: the server's answer for one address.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entiform import fixed
from entiform.functions import web
from entiform.operators.lookups import lookup_join


def lead_addresses(leads: DataFrame) -> DataFrame:
    """(ord, pos, email): every address of a lead once, in order: own, listed, contacts'."""
    every = F.concat(
        F.array("email"), F.col("emails"), F.transform("contacts", lambda c: c["email_direct"]))
    distinct = F.array_distinct(F.filter(every, lambda e: e.isNotNull() & (e != "")))
    return leads.select("ord", F.posexplode(distinct).alias("pos", "email"))


def attach_email_facts(addresses: DataFrame, domain_facts: DataFrame, address_facts: DataFrame | None = None
                       ) -> DataFrame:
    """Adds domain, has_mx, probed, catch_all and accepted to rows with an `email`."""
    rows = addresses.withColumn("domain", web.email_domain(F.col("email")))
    facts = domain_facts.select(
        "domain", "has_mx",
        (F.col("probed") if "probed" in domain_facts.columns else F.lit(True)).alias("probed"), "catch_all")
    rows = lookup_join(rows, facts, ["domain"])
    if address_facts is None:
        return rows.withColumn("accepted", F.lit(None).cast("boolean"))
    return lookup_join(rows, address_facts.select("email", "accepted"), ["email"])


def email_status() -> Column:
    """Status from the columns of attach_email_facts; the cheap checks come first."""
    domain = F.col("domain")
    shaped = F.rlike(domain, F.lit("^[a-z0-9.-]+[.][a-z]{2,}$"))
    return (
        F.when(~F.coalesce(shaped, F.lit(False)), "invalid")
        .when(domain.isin(*fixed.DISPOSABLE_DOMAINS), "invalid")
        .when(~F.coalesce(F.col("has_mx"), F.lit(False)), "invalid")
        .when(~F.coalesce(F.col("probed"), F.lit(False)), "unknown")
        .when(F.col("catch_all"), "risky")
        .when(F.col("accepted").isNull(), "unknown")
        .when(F.col("accepted"), "valid").otherwise("invalid")
    )


def _known_catch_all() -> Column:
    """The domain's catch-all flag, when its server had to be asked for the status."""
    asked = F.col("has_mx") & F.col("probed") & ~F.col("domain").isin(*fixed.DISPOSABLE_DOMAINS)
    return F.when(asked, F.col("catch_all"))


def address_statuses(addresses: DataFrame, domain_facts: DataFrame, address_facts: DataFrame | None = None
                     ) -> DataFrame:
    """(email, status, known_catch_all, uses): one row per distinct address with the rows that hold it."""
    distinct = addresses.groupBy("email").agg(F.count("*").alias("uses"))
    facts = attach_email_facts(distinct, domain_facts, address_facts)
    return facts.select(
        "email", email_status().alias("status"), _known_catch_all().alias("known_catch_all"), "uses")


def email_verdicts(leads: DataFrame, domain_facts: DataFrame, address_facts: DataFrame | None = None) -> DataFrame:
    """Patch rows (ord, id): email_status, email_catch_all, email_checks and contacts with a lowered confidence.

    The status is that of the lead's own address, else the best of all. Leads without an address have no row.
    """
    addresses = lead_addresses(leads)
    statuses = address_statuses(addresses, domain_facts, address_facts)
    judged = lookup_join(addresses, statuses, ["email"], weight="uses")
    rank = F.array_position(F.array(*[F.lit(s) for s in fixed.EMAIL_STATUSES]), F.col("status")).cast("int")
    per_lead = judged.groupBy("ord").agg(
        F.min(rank).alias("best"),
        F.max_by("known_catch_all", F.when(F.col("known_catch_all").isNotNull(), F.col("pos"))).alias("email_catch_all"),
        # an address list is as long as its lead's own arrays
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("email", "status")))).alias("email_checks"))
    joined = leads.select("ord", "id", "email", "contacts").join(per_lead, "ord")
    own = F.try_element_at("email_checks", F.col("email"))
    best = F.get(F.array(*[F.lit(s) for s in fixed.EMAIL_STATUSES]), F.col("best") - 1)

    def lowered(c: Column) -> Column:
        bad = F.try_element_at(F.col("email_checks"), c["email_direct"]) == "invalid"
        value = F.least(c["confidence"], F.lit(fixed.INVALID_EMAIL_CONFIDENCE))
        return c.withField("confidence", F.when(bad, value).otherwise(c["confidence"]))

    return joined.select(
        "ord", "id", F.coalesce(own, best).alias("email_status"), "email_catch_all", "email_checks",
        F.transform("contacts", lowered).alias("contacts"))
