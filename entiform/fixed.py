"""Fixed values that results depend on: word lists, lookup tables, limits, labels."""

# City spellings -> readable city name (key: accent-free lower case).
CITY_ALIASES = {
    "dla": "Douala",
    "douala": "Douala",
    "yde": "Yaoundé",
    "yaounde": "Yaoundé",
    "kribi": "Kribi",
    "limbe": "Limbé",
    "buea": "Buéa",
    "bafoussam": "Bafoussam",
    "bamenda": "Bamenda",
    "garoua": "Garoua",
    "maroua": "Maroua",
    "ngaoundere": "Ngaoundéré",
    "bertoua": "Bertoua",
    "ebolowa": "Ebolowa",
    "edea": "Édéa",
    "kumba": "Kumba",
    "dschang": "Dschang",
    "nkongsamba": "Nkongsamba",
}

# Country name (lower case) -> ISO code.
COUNTRY_ISO = {
    "cameroun": "CM",
    "cameroon": "CM",
    "côte d'ivoire": "CI",
    "cote d'ivoire": "CI",
    "ivory coast": "CI",
    "senegal": "SN",
    "sénégal": "SN",
    "gabon": "GA",
    "benin": "BJ",
    "bénin": "BJ",
    "togo": "TG",
    "burkina faso": "BF",
    "mali": "ML",
    "nigeria": "NG",
}

# Address segments that are a country, not a city.
COUNTRY_WORDS = ("cameroun", "cameroon", "nigeria", "gabon", "tchad", "chad")

# Words dropped from the company key, the brand key and the record slug.
COMPANY_WORDS = ("hotel", "sarl", "sa", "snc", "gie", "et", "ets", "the", "le", "la", "les")
BRAND_WORDS = (
    "hotel", "resort", "residence", "auberge", "motel", "sarl", "sa",
    "the", "le", "la", "les", "de", "du", "des",
)
SLUG_WORDS = (
    "hotel", "lhotel", "the", "les", "le", "la", "residence", "residences", "suite", "suites",
    "spa", "complexe", "complex", "resort", "group", "groupe", "sa", "sarl", "sas", "luxury",
    "by", "and", "de", "des", "du",
)
FORM_WORDS = ("hotel", "l'hotel", "les", "residence", "residences", "spa", "complex", "sa", "sarl", "luxury")
EMPTY_SLUG = "inconnu"

# Known brands in priority order: name, words of which one must stand alone in the company name.
# A blank in a pattern is any single blank; `?` makes the previous character optional.
KNOWN_BRANDS = (
    ("Hilton", "hilton"),
    ("Ibis / Accor", "(?:ibis|novotel|mercure|pullman|sofitel|accor)"),
    ("Radisson", "radisson"),
    ("Marriott", "marriott"),
    ("Best Western", "best western"),
    ("Onomo", "onomo"),
    ("Azalaï", "azala[iï]"),
    ("La Falaise", "la falaise"),
    ("Krystal Palace", "krystal"),
    ("Star Land", "star ?land"),
    ("Résidence La Roseraie", "la roseraie"),
)

# Contact roles, tried in this order; `|dg|`-like entries in ROLE_WORDS must stand alone.
ROLE_PATTERNS = (
    ("GENERAL_MANAGER", "directeur general|directrice generale|general manager", r"g\.?m|dg"),
    ("OWNER", "propri[ée]taire|owner|g[ée]rant|fondat", None),
    ("DIRECTOR", "directeur|directrice|responsable", "head of"),
    ("EXECUTIVE", "manager|cadre|chef de", None),
)
ROLES = ("GENERAL_MANAGER", "OWNER", "DIRECTOR", "EXECUTIVE", "OTHER")
DEFAULT_ROLE = "OTHER"

EMAIL_STATUSES = ("valid", "risky", "unknown", "invalid")  # best first
SENTIMENTS = ("positive", "mixed", "negative")
RECORD_STATUSES = ("auto", "needs_review", "verified")
DISPOSABLE_DOMAINS = (
    "mailinator.com", "yopmail.com", "guerrillamail.com",
    "trashmail.com", "10minutemail.com", "tempmail.com",
)
FREE_MAIL = "(?:gmail|yahoo|hotmail|outlook|icloud)[.][a-z]+$"
PRIMARY_MAILBOXES = "^(?:contact|info|reservation|reservations|hello|welcome)@"

# Addresses that look like emails but are not.
EMAIL_ASSET = "[.](?:png|jpe?g|gif|svg|webp|css|js|ico)$"
EMAIL_PLACEHOLDER = "@(?:sentry|wix|wixpress|example|domain|email|2x|3x)(?:[^a-z0-9_]|$)"
EMAIL_HASH = "^[a-f0-9]{16,}@"
EMAIL_ESCAPED = "(?:^|[^a-z0-9_])u003[ec]"
EMAIL_MAX_LENGTH = 100

# Social networks: column, URL pattern, what may not follow the pattern.
SOCIAL_NETWORKS = (
    ("linkedin", "linkedin[.]com/(?:company|in|pub)/", None),
    ("facebook", "facebook[.]com/", "sharer|share[.]php|tr[?]"),
    ("instagram", "instagram[.]com/", "p/"),
    ("twitter", "(?:twitter|x)[.]com/", "intent|share"),
    ("youtube", "youtube[.]com/(?:channel|c|user|@)", None),
    ("tiktok", "tiktok[.]com/@", None),
)
SOCIAL_FIELDS = ("linkedin", "facebook", "instagram", "twitter", "youtube", "tiktok", "whatsapp")
WHATSAPP_LINK = "(?:wa[.]me/|api[.]whatsapp[.]com/send[?]phone=)[+]?([0-9]{6,15})"

# Legal forms that end a registered company name (longest spelling first).
LEGAL_FORMS = "S[.]?A[.]?R[.]?L[.]?|S[.]?A[.]?|SNC|GIE|E[.]?U[.]?R[.]?L[.]?|SUARL|SAS"

# Job titles found next to a person's name.
PERSON_TITLES = (
    "Directeur[a-zà-ÿ ]*Générale?",
    "Directrice[a-zà-ÿ ]*Générale",
    "Directeur[a-zà-ÿ]*",
    "Directrice[a-zà-ÿ]*",
    "General Manager",
    "Général Manager",
    "G[ée]rante?",
    "Propriétaire",
    "Fondat[a-zà-ÿ]+",
    "Manager",
    "Responsable[a-zà-ÿ ]*",
)
PERSON_CONFIDENCE = 0.55

# Site paths visited for contact details, in order.
SITE_PATHS = (
    "", "/contact", "/contact-us", "/contactez-nous", "/nous-contacter", "/about", "/a-propos",
    "/a-propos-de-nous", "/equipe", "/notre-equipe", "/team", "/mentions-legales", "/impressum",
)
MAX_PAGES = 4
EXTRA_ATTEMPTS = 2

# A longer text is not read as one phone number (rule of the numbering library whose results are matched).
PHONE_MAX_TEXT = 250

# A place category may not be one of the page's action buttons.
ACTION_WORDS = (
    "ajouter", "add", "suggest", "modifier", "claim", "revendiquer",
    "propose", "edit", "write a review", "rédiger",
)
CATEGORY_MAX_LENGTH = 40
PLACE_SOURCE = "google-maps"
PLACE_LINK = "google[.][a-z.]+/maps/place/"
SEARCH_SOURCE_CAP = 115

DEFAULT_COUNTRY = "CM"
DEFAULT_CITY_COUNTRY = "Cameroun"
REVIEWS_READ = 40
MAX_REVIEWS = 25
REVIEW_TEXT_CUT = 500
EXCERPTS = 3
EXCERPT_MIN = 40
EXCERPT_CUT = 200
MAX_HIGHLIGHTS = 5
MAX_CITED = 8
PAGE_TEXT_CUT = 3000
# Links of a stored result page are relative to this.
RESULT_BASE = "https://duckduckgo.com/"
DELIVERY_TEXT_CUT = 1900
CONFIDENCE_WITHOUT_SOURCES = 0.4
INVALID_EMAIL_CONFIDENCE = 0.3
REVIEW_THRESHOLD = 0.6

STAGES = ("website", "email", "reviews")

# Delivery columns: key and header, in order.
FLAT_COLUMNS = (
    ("company_name", "Establishment name"),
    ("legal_name", "Legal name"),
    ("category", "Category"),
    ("chain", "Chain"),
    ("city", "City"),
    ("country", "Country"),
    ("address", "Full address"),
    ("phone_normalized", "Phone"),
    ("phones", "Phones (all)"),
    ("email", "General email"),
    ("email_status", "Email status"),
    ("emails", "Emails (all)"),
    ("website_url", "Website"),
    ("linkedin", "LinkedIn"),
    ("facebook", "Facebook"),
    ("instagram", "Instagram"),
    ("whatsapp", "WhatsApp"),
    ("google_rating", "Google rating"),
    ("reviews_count", "Reviews count"),
    ("reviews_sentiment", "Reviews sentiment"),
    ("reviews_summary", "Reviews summary"),
    ("contact_name", "Decision-maker contact"),
    ("contact_role", "Decision-maker role"),
    ("contact_email", "Decision-maker email"),
    ("contact_linkedin", "Decision-maker LinkedIn"),
    ("source", "Source"),
    ("source_url", "Source link"),
    ("id", "ID"),
)

# Record delivery columns: key and label, in order.
DELIVERY_COLUMNS = (
    ("name", "Nom de l'Hôtel"),
    ("city", "Ville"),
    ("category", "Catégorie"),
    ("phone", "Téléphone"),
    ("owner", "Propriétaire / Promoteur"),
    ("management", "Direction / Gouvernance"),
    ("confidence", "Confiance gouvernance"),
    ("district", "Quartier"),
    ("geo", "Géolocalisation"),
    ("address", "Adresse / BP"),
    ("email", "Email / Contact"),
    ("website", "Site web"),
    ("sources", "Sources"),
    ("status", "Statut"),
    ("slug", "Slug"),
)
STATUS_LABELS = {"auto": "Auto", "needs_review": "À vérifier", "verified": "Vérifié"}
UNKNOWN_PERSON = "Non identifié"

# Web context layout.
RESULT_LABEL = "[Résultat "
URL_LABEL = "URL: "
SNIPPET_LABEL = "Extrait: "
NO_SNIPPET = "(pas d’extrait)"
PAGE_LABEL = "[Contenu complet de "
