"""Term lists and weights of the content rules. All operators take them as arguments; these are the defaults."""

from __future__ import annotations

# The rules' word lists, categories, weights and scores.
JURISDICTIONS = ("Malaysia", "Singapore", "Hong Kong", "Australia", "New Zealand", "India")
CATEGORIES = ("Press Release/Judiciary Updates", "Case Summary", "Recent Judgments", "Policy/Regulatory News", "Legal News", "Legislation News")
DEFAULT_CATEGORY, POLICY_CATEGORY = "Legal News", "Policy/Regulatory News"
PINNED_CATEGORIES = ("Press Release/Judiciary Updates", "Case Summary", "Recent Judgments")
LEGACY_CATEGORIES = {
    "Judgment": "Recent Judgments",
    "Court News": "Press Release/Judiciary Updates",
    "Practice Direction": "Press Release/Judiciary Updates",
    "Court News/Legal News": "Legal News",
    "Legal News": "Legal News",
    "Legislation & Regulation": "Legislation News",
    "Profession": "Legal News",
}
POLICY_TERMS = ("policy", "policies", "regulatory", "regulator", "monetary authority", "mas", "insurance association", "guidelines", "consultation paper")
CATEGORY_RULES = (
    ("Legislation News", ("bill", "act", "regulation", "amendment", "law reform", "legislative", "parliament", "statute")),
    ("Policy/Regulatory News", POLICY_TERMS),
    ("Case Summary", ("case summary", "press summary", "summary review", "grounds of decision")),
    (
        "Press Release/Judiciary Updates",
        ("press release", "media release", "media advisory", "chief justice", "judicial appointment", "judge appointed", "practice direction", "registrar's circular", "registrar circular", "court circular", "rules of court"),
    ),
)
COUNTRY_SIGNALS = {
    "Malaysia": ("malaysia", "malaysian", "kuala lumpur", "putrajaya", "malaysian bar"),
    "Singapore": ("singapore", "singaporean", "ministry of law", "state courts", "elitigation"),
    "Hong Kong": ("hong kong", "hk", "hksar", "hkba", "hkiac"),
    "Australia": ("australia", "australian", "high court of australia", "asic", "sydney", "melbourne"),
    "New Zealand": ("new zealand", "nz", "auckland", "wellington", "law society news"),
    "India": ("india", "indian", "new delhi", "supreme court of india", "sebi", "rbi", "meity", "ibbi"),
}
LEGAL_TERMS = (
    "appeals court", "apex court", "arbitration", "attorney-general", "bar association", "bar council", "bill", "case summary", "civil suit", "chief justice", "constitutional", "court",
    "court of appeal", "courts", "court ruling", "doj", "federal court", "grounds of decision", "hearing", "high court", "judicial", "judicial review", "judiciary", "judge", "judges",
    "judgment", "judgement", "law council", "law reform", "law society", "lawsuit", "legal action", "legal aid", "legal challenge", "legal counsel", "legal practice", "legal proceedings",
    "legal profession", "legal services", "legislation", "legislative", "leave to appeal", "litigation", "magistrate", "practice direction", "public prosecutor", "prosecution",
    "patent infringement", "circular", "notification", "regulation", "regulatory", "rules of court", "solicitor", "statute", "supreme court", "trial", "tribunal", "acquitted", "convicted",
    "conviction", "sentence", "sentencing", "mahkamah", "hakim", "kehakiman", "pendakwa", "perbicaraan", "penghakiman",
)
ENFORCEMENT_TERMS = ("arrest", "arrested", "cops", "crime", "criminal record", "detained", "drug bust", "investigation", "law enforcement", "police", "police chief", "raid", "seized", "suspect", "suspects", "syndicate")
COURT_CONTEXT_TERMS = ("court", "courts", "judge", "judgment", "judgement", "trial", "hearing", "acquitted", "convicted", "sentence", "sentencing", "prosecution")
NOISE_TITLES = (
    "audio", "bookmark", "bookmarks", "change password", "contact us", "download now", "discover the courts", "faqs", "for you", "hearing list", "home", "judgments", "log in", "log out",
    "manage logins", "news and resources", "privacy statement", "profile", "search", "self-help guides", "services", "skip", "subscriptions", "terms & conditions", "terms of use",
    "toggle navigation", "trusted websites",
)
NOISE_PHRASES = ("best viewed on chrome", "government agencies communicate via", "official website links end with", "we would love to keep you posted")
MALFORMED_GAZETTE_PHRASES = (
    "gazettes on demand bills acts election by election land acquisition",
    "directorate of printing department of publication",
    "state gazettes important links",
    "recent extra ordinary gazettes",
    "recent weekly gazettes",
    "this gazette may contains multiple ministries",
    "this gazette may contains multiple subjects",
)
TRACKING_PARAMS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid")
MOJIBAKE = {"â\u0080\u0098": "'", "â\u0080\u0099": "'", "â\u0080\u009c": '"', "â\u0080\u009d": '"', "â\u0080\u0093": "-", "â\u0080\u0094": "-", "â\u0080¦": "...", "Â": ""}
RETIRED_SOURCES = ("Federal Court of Australia", "news.gov.hk - Law & Order RSS", "SCMP - Hong Kong Law and Crime", "Malay Mail - Malaysia", "CNA - Singapore", "The Star - Nation", "The Star - Nation RSS")

# Risk domains in order: id, label, business weight, terms.
RISK_DOMAINS = (
    ("litigation_spikes", "Litigation Spikes", 11, ("case law", "court", "courts", "dispute", "disputes", "enforcement", "judgment", "judgement", "judicial", "litigation", "tribunal")),
    ("ai_regulation", "AI Regulation Activity", 15, ("ai", "ai governance", "ai regulation", "artificial intelligence", "automation", "generative ai", "legal ai", "machine learning")),
    ("cyber_privacy", "Cyber / Privacy Changes", 15, ("breach", "cyber", "cybersecurity", "data protection", "digital personal data", "gdpr", "pdpa", "privacy", "privacy law")),
    ("employment", "Employment Law Movement", 10, ("dismissal", "employees", "employment", "hr regulation", "labour", "unions", "wages", "workers", "workplace")),
    ("sanctions_trade", "Sanctions / Trade Restrictions", 15, ("customs", "embargo", "export controls", "import/export", "sanctions", "tariffs", "trade restrictions")),
)
OFFICIAL_NAMES = ("attorney-general", "commission", "court", "courts", "gazette", "government", "judiciary", "ministry", "regulator", "reserve bank", "sebi", "supreme court", "tribunal")
SPECIALIST_NAMES = ("law watch", "livelaw", "bar & bench", "scc online", "malaysian bar", "law council")
TIER_ONE_NAMES = ("cna", "channel newsasia", "straits times", "reuters", "bloomberg")
AUTHORITY_WEIGHTS = {"High": "1.0", "Medium-High": "0.8", "Medium": "0.65", "Medium-Low": "0.5", "Low": "0.35"}

#: Routing topics: pattern and, where one applies, categories that also decide. First match wins.
# Topics in order: name, pattern, categories.
TOPIC_RULES = (
    ("AI Regulation", r"ai|artificial intelligence|machine learning|algorithm|automation|hallucination|model governance|aiverify|meity", ()),
    ("Privacy/Data Protection", r"privacy|data protection|personal data|pdpa|gdpr|cyber|breach|cross-border|transfer", ()),
    ("API/Data Licensing", r"api|licen[cs]ing|data access|scraping|bulk|database|reuse|metadata", ()),
    ("Judiciary Modernization", r"court|judiciar|e-?litigation|ecourt|remote hearing|electronic filing|digital evidence|case management|judgment metadata", ()),
    ("Precedent-Setting Judgment", r"judgment|appeal|court of appeal|supreme court|high court|tribunal|case summary|precedent|ruling", ("Recent Judgments", "Case Summary")),
    ("Citation Spike", r"citation|cited|annotation|appellate courts highlights", ()),
    ("Legislative Development", r"bill|act|gazette|legislation|regulation|rules|parliament|consultation|notification|rbi|sebi|cci|ibbi", ("Legislation News",)),
    ("Legal Tech Market Intelligence", r"legal tech|competitor|product|platform|vendor|launch|market", ()),
)
ACTION_PATTERN = r"deadline|consultation|mandatory|required|enforcement|penalt|sanction|breach|notification|gazette|rules"
STRATEGIC_TOPICS = ("AI Regulation", "API/Data Licensing", "Legal Tech Market Intelligence", "Precedent-Setting Judgment")
OFFICIAL_SOURCE_PATTERN = r"official|judiciary|court|ministry|gazette|supreme|rbi|sebi|cci|ibbi"
URGENCY_WEIGHTS = {"ACTION REQUIRED": 100, "STRATEGIC": 86, "WATCH": 62, "INFORMATIONAL": 38, "LOW PRIORITY": 18}
#: Departments in order: id, name, short name, topic weights, jurisdictions.
# Department profiles.
DEPARTMENTS = (
    ("product", "PAL (Practice Area Lead)", "PAL", {"AI Regulation": 95, "API/Data Licensing": 92, "Privacy/Data Protection": 78, "Judiciary Modernization": 72, "Legal Tech Market Intelligence": 82, "Legislative Development": 88, "Precedent-Setting Judgment": 82}, ("Singapore", "India", "Australia", "Hong Kong")),
    ("legislation", "Legislation Team", "Legislation", {"Legislative Development": 96, "AI Regulation": 90, "Privacy/Data Protection": 84, "Precedent-Setting Judgment": 66}, JURISDICTIONS),
    ("sales", "SLT", "SLT", {"AI Regulation": 88, "Legal Tech Market Intelligence": 94, "API/Data Licensing": 78, "Privacy/Data Protection": 70}, ("Singapore", "Hong Kong", "Australia", "India")),
    ("editorial", "Editorial Teams", "Editorial", {"Citation Spike": 98, "Precedent-Setting Judgment": 90, "Legislative Development": 72, "Judiciary Modernization": 64, "AI Regulation": 60}, JURISDICTIONS),
)
#: Strategic signals: points, reason, pattern, topics that also count.
# Strategic signals: points, reason, pattern, topics.
SIGNAL_RULES = (
    (20, "AI relevance", r"ai|artificial intelligence|machine learning|algorithm|model governance|aiverify|automation", ("AI Regulation",)),
    (18, "privacy/data protection relevance", r"privacy|data protection|personal data|pdpa|gdpr|cyber|breach|cross-border transfer", ("Privacy/Data Protection",)),
    (14, "judiciary modernization significance", r"e-?filing|remote hearing|case management|court digit|electronic bundle|online filing", ("Judiciary Modernization",)),
    (16, "market/commercial impact", r"api|licen[cs]ing|competitor|platform|vendor|launch|commercial|enterprise", ("Legal Tech Market Intelligence", "API/Data Licensing")),
    (15, "precedent importance", r"landmark|precedent|constitutional|court of appeal|supreme court|high court|test case|seminal", ("Precedent-Setting Judgment",)),
    (18, "regulatory change magnitude", r"bill|act|draft|rules|regulation|consultation|mandatory|required|enforcement|commencement|guidance|reform|amendment", ("Legislative Development",)),
)
URGENCY_POINTS = {"ACTION REQUIRED": (18, "action required"), "STRATEGIC": (14, "strategic urgency"), "WATCH": (6, None)}
# Patterns of routine and strategic texts.
ROUTINE_INTAKE_PATTERN = (
    r"department of publication|gazette id download|ministry subject publish date|recent extra ordinary gazettes|ordinary gazettes|publication of gazette notification"
    r"|state gazettes important links|directorate of printing|(?:agms and egms|in memoriam)$|(?<![a-z0-9_])download ministry(?![a-z0-9_])"
)
STRATEGIC_COURT_WORDS = r"landmark|precedent|constitutional|public interest|test case|novel|privacy|ai|data protection|regulatory|competition|sanction|trade|employment"
CAUSE_LIST_WORDS = r"diary number|crl\.?a\.?|c\.?a\.?\s+no|s\.?l\.?p\.?|w\.?p\.?|civil appeal|criminal appeal|vs\.?"
ROUTINE_OUTCOME_WORDS = r"acquitted|dismissed|quash|inquest|trafficking charge|sentenced|convicted|appeal dismissed|high court rules|court rules"
COURT_TOPIC_WORDS = r"supreme court|high court|court of appeal|judgment|appeal"
PRECEDENT_WORDS = r"landmark|precedent|constitutional|court of appeal|supreme court|test case|public interest|novel"
NOTICE_WORDS = r"announcement|notice|appointment|holiday|opening hours|publication list"
NOTICE_EXCUSE_WORDS = r"ai|privacy|data protection|reform|mandatory|enforcement|bill|act|regulation"
OPINION_WORDS = r"opinion|commentary|viewpoint|perspective|editorial"
ANALYSIS_WORDS = r"analysis|explainer|feature"
ANALYSIS_EXCUSE_WORDS = r"bill|act|gazette|regulation|rules|judgment|ruling|appointment|consultation|guidance|notification|commencement|published|issued"
PRODUCT_CATEGORY_ORDER = ("Legislation News", "Recent Judgments", "Legal News")
# Movements: keywords, priority, courts, patterns.
MOVEMENT_KEYWORDS = {
    "retirement": ("retirement of judge", "retires from", "retired from", "judicial retirement"),
    "honour": ("judicial award", "judicial honour", "judicial honor", "honoured", "honored", "senior counsel appointed"),
    "leadership_change": ("assumes office", "takes office", "court leadership"),
    "elevation": ("elevated to", "elevation", "promoted to", "promotion to higher court"),
    "appointment": ("judge appointed", "justice appointed", "appointed as judge", "appointed to", "sworn in", "oath of office", "judicial appointment", "court appointment", "bench appointment", "judicial commissioner"),
}
MOVEMENT_PRIORITY = ("retirement", "leadership_change", "elevation", "appointment", "honour")
COURTS = ("Supreme Court", "Federal Court", "Court of Appeal", "High Court", "District Court", "Family Court", "Magistrates Court", "Constitutional Court", "Commercial Court", "Syariah Court")
JUDGE_WORDS = r"chief justice|justice|judge|judicial commissioner"
SPEECH_WORDS = r"speech|speaks|remarks|address|lecture|keynote|message|dialogue|conference|forum|interview|commentary|opinion"
MOVE_WORDS = r"appoint|appointed|appointment|elevated|elevation|promoted|promotion|sworn in|oath of office|assumes office|takes office|retires|retirement|honour|honor|award"

# Political notes that are legal news only beside a strong signal, and those signals.
POLITICAL_TERMS = ("dap", "ph meeting", "political party", "state assembly", "state legislative assembly", "legislative assembly")
STRONG_TERMS = (
    "bill", "case summary", "civil suit", "court", "court of appeal", "courts", "federal court", "hearing", "high court", "judicial", "judiciary", "judge", "judgment", "judgement",
    "law reform", "lawsuit", "legal action", "legal challenge", "legal proceedings", "litigation", "prosecution", "regulation", "regulatory", "rules of court", "statute", "supreme court", "trial", "tribunal",
)
# Commercial and editorial markers, the gazette's id.
COMMERCIAL_PHRASES = ("early bird tickets", "open for pre sale", "pre order", "pre sale", "presale", "snag your early bird")
COMMERCIAL_HOSTS = ("store.lawnet.com",)
EVENT_HOST, EVENT_PATH, EVENT_WORD = "techlawfest.com", "/event/", "ticket"
EDITORIAL_SUFFIXES = ("opinion", "forum")
EDITORIAL_PHRASES = ("says the writer",)
GAZETTE_ID = r"\b[A-Z]{2}(?:-[A-Z]{2})?-[A-Z]-\d{8}-\d{6}\b"
GAZETTE_SIZE = r"(?i)^(?:download\s*)?\d+(?:\.\d+)?\s*mb$"
GAZETTE_LABELS = ("download", "view", "pdf", "gazette id", "publish date", "subject", "ministry")
# Named character references that feeds use, by code point.
REFERENCES = {
    "lt": 60, "gt": 62, "quot": 34, "apos": 39, "nbsp": 160, "copy": 169, "reg": 174, "trade": 8482, "hellip": 8230, "mdash": 8212, "ndash": 8211, "lsquo": 8216, "rsquo": 8217, "ldquo": 8220, "rdquo": 8221,
    "bull": 8226, "middot": 183, "laquo": 171, "raquo": 187, "pound": 163, "euro": 8364, "yen": 165, "cent": 162, "sect": 167, "para": 182, "deg": 176, "times": 215, "eacute": 233, "egrave": 232, "uuml": 252,
    "ouml": 246, "auml": 228, "szlig": 223, "ntilde": 241, "ccedil": 231, "amp": 38,
}
# Names and roles of people who move, and what is cut from a name.
NAME = r"[A-Z][A-Za-z.'-]+"
NAME_PATTERNS = (
    rf"\b(?:Justice|Judge|Judicial Commissioner|Chief Justice)\s+({NAME}(?:\s+{NAME}){{0,4}})\b",
    rf"\b({NAME}(?:\s+{NAME}){{1,4}})\s+(?:has been|was|is)\s+(?:appointed|elevated|promoted|sworn in)\b",
    rf"\b(?i:appointment of)\s+(?:(?i:justice|judge)\s+)?({NAME}(?:\s+{NAME}){{1,4}})\b",
)
#: For each of these patterns, parts in lower case of which a text that it matches has one.
NAME_PARTS = (("justice", "judge", "judicial commissioner"), ("appointed", "elevated", "promoted", "sworn in"), ("appointment of",))
NAME_ENDS = (
    r"[.;:,]+$",
    r"(?i)\b(?:Singapore|Malaysia|India|Australia|Hong Kong|New Zealand)?\s*(?:Legal News|News Sources|Judiciary Updates|Press Release).*$",
    r"(?i)\b(?:as|to|at|of|the|court)\b.*$",
)
NAME_REFUSED = r"Court|Justice$|Judge$|President$"
ROLE_LEADS = ("appointed as", "appointed to", "elevated to", "promoted to", "assumes office as", "takes office as")
ROLE_ENDS = r"\s+([^.,;]+?)(?:\s+at|\s+of|\.|,|;|$)"
CHIEF_ROLES = r"(?i)\b(Chief Justice|President of the Court|Deputy President)\b"
