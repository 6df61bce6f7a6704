"""The word lists and limits that the predicates match, in natural order.

Every predicate takes its list as a parameter; these are the defaults.
"""

# Phrases of unsubscribe rows and legal footers.
FOOTER_PHRASES = (
    "unsubscribe", "manage preferences", "email preferences", "update subscription", "preference center", "opt out", "do not wish to receive",
    "privacy policy", "terms of service", "terms & conditions", "you are receiving this email", "this email was sent to", "list-unsubscribe",
)
# Anchor texts of a link to the mail's own page.
VIEW_IN_BROWSER_PHRASES = (
    "view in browser", "open in browser", "see this email in your browser", "read online", "view online", "open online",
    "can't see this email?", "can’t see this email?", "having trouble viewing",
)
NAVIGATION_PHRASES = (*VIEW_IN_BROWSER_PHRASES, "read in app", "share this", "read this email")
SUBSCRIPTION_PHRASES = ("become a paid subscriber", "upgrade your subscription", "upgrade to paid", "subscribe to read", "sign up to read", "subscribe", "sign up")
TRACKING_PREFIXES = ("utm_", "spm", "_hsenc", "_hsmi")
TRACKING_NAMES = (
    "mc_cid", "mc_eid", "mkt_tok", "igshid", "fbclid", "gclid", "msclkid", "pk_campaign", "pk_kwd", "oref", "ref", "ref_src", "spm", "si",
    "subscriber_id", "subscriberid", "token", "verification", "campaign_id",
)
TRACKING_HOSTS = (
    "googletagmanager", "google-analytics", "doubleclick", "facebook.com/tr", "pxl.", "open.", "clicks.mail", "click.", "track.", "trk.",
    "link.mail.", "list-manage.com", "preference-center", "subscriptions.",
)
SOCIAL_FRAGMENTS = (
    "facebook.com/", "fb.com/", "twitter.com/", "x.com/", "linkedin.com/", "instagram.com/", "youtube.com/", "tiktok.com/", "/share?url=", "addtoany", "/widgets/share",
)
LOGO_FRAGMENTS = ("logo", "avatar", "favicon", "badge", "/icon", "_icon.", "-icon.", "social-share", "twitter", "facebook", "linkedin")
PIXEL_FRAGMENTS = ("pixel", "/spacer", "/track", "/open/", "tracking", "analytics", "_px.", "1x1")
SPONSOR_FRAGMENTS = ("sponsor", "native-ad", "promoted", "advertisement")
FOOTER_FRAGMENTS = ("footer", "mastfoot", "email-footer", "mail_footer")
UNSUBSCRIBE_PATHS = ("unsubscribe", "opt-out", "optout", "preferences", "preference", "/sub/", "subscription", "lists", "/public/unsub", "list-unsubscribe")
UNSUBSCRIBE_QUERIES = ("action=unsubscribe", "unsubscribe_token", "list_unsubscribe", "preference_token")
UNSUBSCRIBE_ANCHORS = ("unsubscribe", "manage preferences", "email preferences")
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg", ".ico", ".avif")
HEADING_CLASSES = ("md-heading", "markdown-heading", "markdown-h1", "markdown-h2", "markdown-h3")
# Two hits of these make a section promotional; the shorter list leaves out the last one.
PROMO_KEYWORDS = (
    "register", "enroll", "cohort", "webinar", "workshop", "masterclass", "bootcamp", "rsvp", "limited seats", "apply now", "tickets", "early bird", "join us", "sign up", "sponsor",
)
PROMO_KEYWORDS_SHORT = tuple(k for k in PROMO_KEYWORDS if k != "sponsor")
PROMO_HEADINGS = ("(sponsored)", "sponsor:", "paid partnership", "advertisement", "promoted by")
PROMO_BODIES = ("(sponsored)", "paid partnership", "promoted by")
TEASER_PHRASES = (
    "become a paid subscriber", "unlock this piece", "get more out of your subscription", "what is included in a subscription", "what did you think of this post",
    "start free trial", "subscribe to read", "upgrade to paid", "sign up to read",
)
RECAP_EXACT = ("recap", "links", "ai news recap")
RECAP_PARTS = ("ai twitter recap", "ai reddit recap", "ai discord recap", "quick hits")
RECAP_PATTERN = r"^(ai\s+)?(twitter|reddit|discord)\s+recap$"
COPYRIGHT_PATTERN = r"©\s*20\d{2}"
NUMBERED_PATTERN = r"^\s*\d+\.\s+"
FACT_NOISE_PATTERN = r"(?i)\b(sponsor(?:ed)?|advertisement|subscribe\s+to|unsubscribe|referral\s+link)\b"

# Limits.
SECTION_CHARS, SHORT_SECTION_CHARS, SECTIONS_PER_EMAIL, PATHOLOGICAL_SECTIONS = 8000, 300, 8, 48
CHUNK_CHARS, CHUNKS_PER_EMAIL = 14000, 6
LINE_CHARS, MIN_IMAGE_EDGE, MAX_PIXEL_EDGE, DEFAULT_IMAGE_AREA = 140, 8, 3, 10_000
LONG_FORM_CHARS, GRAY_ZONE, SPLIT_URLS, SUBSTANTIVE_CHARS, ARTICLE_CHARS = 1800, (3, 8), 3, 400, 200
CONFIDENCE_MIN, CONFIDENCE_PROCESS = 0.55, 0.75
MAX_FACTS, FALLBACK_FACTS, MAX_CARDS, MAX_RECAP_CARDS, SHOWN_KEY_POINTS = 80, 10, 3, 2, 5
