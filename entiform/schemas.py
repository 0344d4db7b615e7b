"""Explicit schemas of the input and output tables."""

PLACES_RAW = (
    "ord bigint, search_id string, name string, place_url string, category string, address string, "
    "phone string, website string, rating_text string, reviews_text string, latitude double, longitude double"
)
CONTACT = (
    "struct<full_name:string,role:string,title_raw:string,email_direct:string,"
    "phone_direct:string,linkedin_url:string,confidence:double>"
)
SOCIALS = (
    "struct<linkedin:string,facebook:string,instagram:string,twitter:string,"
    "youtube:string,tiktok:string,whatsapp:string>"
)
CHAIN = "struct<is_chain:boolean,name:string>"
REVIEWS = "struct<count:bigint,average:double,summary:string,sentiment:string,highlights:array<string>>"

# Column -> type, in order. `phone_valid`, `enrich_attempted` and `email_checks` are the typed metadata keys.
LEAD_FIELDS = {
    "ord": "bigint",
    "id": "string",
    "source": "string",
    "source_url": "string",
    "company_name": "string",
    "category": "string",
    "city": "string",
    "country": "string",
    "address": "string",
    "latitude": "double",
    "longitude": "double",
    "phone_raw": "string",
    "phone_normalized": "string",
    "email": "string",
    "website_url": "string",
    "google_rating": "double",
    "reviews_count": "bigint",
    "emails": "array<string>",
    "phones": "array<string>",
    "socials": SOCIALS,
    "email_status": "string",
    "email_catch_all": "boolean",
    "legal_name": "string",
    "employee_range": "string",
    "chain": CHAIN,
    "reviews": REVIEWS,
    "enriched_by": "array<string>",
    "contacts": f"array<{CONTACT}>",
    "metadata": "map<string,string>",
    "phone_valid": "boolean",
    "enrich_attempted": "boolean",
    "email_checks": "map<string,string>",
    "scraped_at": "timestamp",
}
LEAD = ", ".join(f"{n} {t}" for n, t in LEAD_FIELDS.items())

# Fields a stage may contribute; NULL means absent.
PATCH_FIELDS = {
    n: LEAD_FIELDS[n] for n in (
        "emails", "phones", "socials", "contacts", "email", "email_status", "email_catch_all",
        "legal_name", "employee_range", "chain", "reviews", "category", "metadata", "email_checks",
    )
}

ANSWER_FIELDS = {
    "name": "string", "category": "string", "phone": "string", "email": "string", "website": "string",
    "district": "string", "address": "string", "latitude": "double", "longitude": "double",
    "owner": "string", "management": "string", "governance_confidence": "double",
}
ANSWER = "struct<" + ",".join(f"{n}:{t}" for n, t in ANSWER_FIELDS.items()) + ">"

RECORD_FIELDS = {
    "slug": "string", "input_name": "string", "name": "string", "city": "string", "country": "string",
    "category": "string", "phone": "string", "phone_e164": "string", "email": "string", "website": "string",
    "district": "string", "address": "string", "latitude": "double", "longitude": "double", "owner": "string",
    "management": "string", "governance_confidence": "double", "sources": "array<string>", "status": "string",
    "model": "string", "enriched_at": "timestamp",
}
RECORD = ", ".join(f"{n} {t}" for n, t in RECORD_FIELDS.items())
RECORD_STRUCT = "struct<" + ",".join(f"{n}:{t}" for n, t in RECORD_FIELDS.items()) + ">"

TASK_LISTS = "map<string,struct<country:string,hotels:array<string>>>"
