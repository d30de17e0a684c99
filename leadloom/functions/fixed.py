"""Word lists, tables and patterns that results depend on."""

#: Hosts and local parts whose addresses are no contacts.
IGNORED_MAIL_HOSTS = [
    "example.com", "domain.com", "email.com", "yoursite.com", "sentry.io", "googleapis.com", "schema.org", "w3.org",
    "wixpress.com", "squarespace.com", "wordpress.com", "cloudflare.com", "jsdelivr.net", "googleusercontent.com",
]
IGNORED_MAIL_NAMES = ["noreply", "no-reply", "mailer-daemon", "postmaster", "webmaster", "hostmaster", "abuse"]
#: Local parts that do not name a person.
GENERIC_MAIL_NAMES = ["info", "contact", "hello", "admin", "office", "support", "sales", "enquiries", "inquiries"]

#: Host endings of social networks, with the name each is listed under.
SOCIAL = {
    "linkedin.com": "linkedin", "twitter.com": "twitter", "x.com": "twitter", "facebook.com": "facebook",
    "instagram.com": "instagram", "github.com": "github", "youtube.com": "youtube",
}

#: Host endings that are no business sites.
SKIPPED_HOSTS = [
    "duckduckgo.com", "google.com", "googleapis.com", "gstatic.com", "youtube.com", "schema.org", "w3.org", "wikipedia.org",
    "yelp.com", "yelp.ca", "facebook.com", "twitter.com", "instagram.com", "linkedin.com", "pinterest.com", "tiktok.com",
    "reddit.com", "mapquest.com", "yellowpages.com", "yellowpages.ca", "bbb.org", "angi.com", "angieslist.com",
    "homeadvisor.com", "thumbtack.com", "nextdoor.com", "manta.com", "chamberofcommerce.com", "forbes.com", "usnews.com",
    "nytimes.com", "cnn.com", "bobvila.com", "thisoldhouse.com", "architecturaldigest.com", "expertise.com", "porch.com",
    "bark.com", "networx.com", "airconditioningup.com", "fixr.com", "buildzoom.com", "todayshomeowner.com",
    "superpages.com", "citysearch.com", "bing.com", "microsoft.com", "msn.com", "brave.com", "search.brave.com",
    "amazon.com", "ebay.com",
]

BUSINESS_TYPES = [
    "localbusiness", "organization", "store", "restaurant", "medicalclinic", "dentist", "attorney", "autobody",
    "autodealer", "autorepair", "professionalservice",
]
CONTACT_WORDS = ["contact", "about", "team", "staff", "location", "service", "our-team", "meet", "office", "reach", "connect", "directions"]
ASSET_ENDINGS = [".pdf", ".jpg", ".png", ".gif", ".css", ".js", ".svg"]
SUB_PAGES = ["/contact", "/contact-us", "/about", "/about-us"]
#: Where contact forms are looked for, words of the path of a contact page, words of links to one.
CONTACT_PATHS = ["/contact", "/contact-us", "/get-in-touch", "/get-a-quote", "/reach-out"]
CONTACT_PAGE_WORDS = ["contact", "reach", "get-in-touch"]
CONTACT_LINK_WORDS = ["contact", "reach", "connect", "message", "get-in-touch", "quote"]
#: What tells a captcha, in the address of a frame or as a class.
CAPTCHA_FRAMES = ["recaptcha", "hcaptcha", "turnstile"]
CAPTCHA_CLASSES = ["g-recaptcha", "h-captcha", "cf-turnstile"]
#: Kinds of form field in the order in which they are tried, with their patterns.
FIELD_WORDS = {
    "email": r"(?i)e[\-_]?mail",
    "name": r"(?iU)\b(name|full[\s_-]?name|your[\s_-]?name|first[\s_-]?name)\b",
    "phone": r"(?iU)\b(phone|tel|mobile|cell)\b",
    "company": r"(?iU)\b(company|organization|business|firm)\b",
    "subject": r"(?iU)\bsubject\b",
    "message": r"(?iU)\b(message|comment|inquiry|details|question|how can we help)\b",
}
SUFFIXES = ["", "near me", "company", "services", "reviews", "best", "top rated", "affordable", "emergency", "licensed", "local", "certified", "professionals"]
TITLE_BREAKS = [" | ", " - ", " — ", " · ", " :: ", " » "]
LINE_BREAKS = [" | ", " - ", " — ", " \\ "]

EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
IMAGE_NAME = r".+\.(png|jpg|jpeg|gif|svg|webp)$"
MAILTO = r"(?i)mailto:([a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,})"
PHONE = r"(?<!\d)(?:\+?1[-.\s]?)?\(?[2-9]\d{2}\)?[-.\s]?[2-9]\d{2}[-.\s]?\d{4}(?!\d)"
LINK = r"https?://[^\s)\]>\"']+"
STREET = r"(?iU)\d{1,5}\s[\w\s.]+(?:St|Street|Ave|Avenue|Blvd|Boulevard|Dr|Drive|Rd|Road|Ln|Lane|Way|Ct|Court|Pl|Place)[.,]?\s*[\w\s]*,?\s*[A-Z]{2}\s*\d{5}(?:-\d{4})?"
SITE_NAME = (
    r"(?i)<meta[^>]+property=[\"']og:site_name[\"'][^>]+content=[\"']([^\"']+)[\"']",
    r"(?i)<meta[^>]+content=[\"']([^\"']+)[\"'][^>]+property=[\"']og:site_name[\"']",
)
TITLE = r"(?i)<title[^>]*>([^<]+)</title>"
NOT_A_NAME = r"(?i)^(\d+\.\d|!\[|skip to|cookie|menu|nav)"
JSON_LD = r"(?is)<script[^>]+type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
HOURS = (
    r"(?iU)(?:hours|open|schedule)[:\s]*((?:mon|tue|wed|thu|fri|sat|sun|weekday|weekend)[\w\s,\-:;aApPmM./]+)",
    r"(?iU)((?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)\w*[\s\-–]+\w+day\s*:?\s*\d{1,2}[:\d]*\s*[aApP][mM]\s*[-–]\s*\d{1,2}[:\d]*\s*[aApP][mM])",
)
HREF = r"(?i)href=[\"']([^\"'#]+)[\"']"
COORDINATES = r"@(-?\d+\.\d+),(-?\d+\.\d+)"
PLACE_ID = r"ChIJ[\w-]+"
PLUS_CODE = r"(?i)[23456789CFGHJMPQRVWX]{4}\+[23456789CFGHJMPQRVWX]{2,3}\s+\w+"
RATING_COUNT = r"(?i)([\d.]+)\s*(?:stars?)?\s*\((\d[\d,]*)\)"
REVIEW_COUNT = r"(?i)(\d[\d,]*)\s*(?:Google\s+)?reviews?\b"
RATING_OF_FIVE = r"(?i)([\d.]+)\s+out\s+of\s+5"
DIRECTORY_PAGE = r"(?iU)https?://(?:www\.)?homestars\.com/companies/([\w][\w-]*)"
STATE_ZIP = r"^([A-Z]{2})\s*(\d{5}(?:-\d{4})?)?"

#: Other terms of a trade, by the trade's keyword, in order of preference.
TRADE_TERMS = {
    "dentist": [
        "dental clinic", "dental office", "dental practice", "dental group", "dental care", "family dentist",
        "cosmetic dentist", "pediatric dentist", "orthodontist", "oral surgeon", "endodontist", "periodontist",
        "dental implants", "dental hygienist", "teeth whitening", "emergency dentist", "denture clinic", "prosthodontist",
    ],
    "hvac": [
        "heating and cooling", "air conditioning", "furnace repair", "ac repair", "heat pump", "ductwork", "boiler repair",
        "heating contractor", "cooling contractor", "refrigeration", "ventilation", "indoor air quality", "duct cleaning",
    ],
    "plumber": [
        "plumbing", "plumbing company", "drain cleaning", "sewer repair", "water heater", "pipe repair", "emergency plumber",
        "plumbing contractor", "backflow testing", "sump pump", "gas line repair",
    ],
    "electrician": [
        "electrical contractor", "electrical service", "wiring", "electrical repair", "panel upgrade",
        "lighting installation", "emergency electrician", "commercial electrician", "residential electrician",
    ],
    "roofer": [
        "roofing", "roofing company", "roof repair", "roof replacement", "roofing contractor", "shingle repair",
        "flat roof", "metal roofing", "gutter installation", "roof inspection",
    ],
    "lawyer": [
        "attorney", "law firm", "legal services", "law office", "family lawyer", "criminal lawyer",
        "personal injury lawyer", "immigration lawyer", "real estate lawyer", "corporate lawyer", "divorce attorney",
        "estate planning attorney",
    ],
    "accountant": [
        "accounting firm", "cpa", "bookkeeper", "bookkeeping", "tax preparer", "tax accountant", "payroll services",
        "financial advisor", "auditing services",
    ],
    "realtor": [
        "real estate agent", "real estate broker", "real estate office", "property management", "realty", "home sales",
        "commercial real estate",
    ],
    "auto": [
        "auto repair", "mechanic", "auto body shop", "car repair", "transmission repair", "brake repair", "oil change",
        "tire shop", "auto detailing", "collision repair",
    ],
    "restaurant": ["catering", "cafe", "diner", "bistro", "eatery", "food delivery", "takeout", "banquet hall"],
}
