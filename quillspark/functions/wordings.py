"""Wordings that readers of briefings see, and the lists of the AI-news branch, each in its natural order."""

# Why a topic matters to a department.
IMPLICATIONS = {
    "product": {
        "AI Regulation": "May affect AI explainability, audit trail, model governance and post-deployment monitoring features.",
        "Privacy/Data Protection": "May require tighter data minimisation, consent, retention and cross-border transfer controls in product workflows.",
        "Judiciary Modernization": "Can inform court workflow integrations, filing metadata and user-facing litigation productivity features.",
        "Legal Tech Market Intelligence": "Signals product gaps, packaging moves or benchmark claims that may need roadmap response.",
        "Legislative Development": "May create new workflow requirements, alerts or statutory-tracking product opportunities.",
        "Precedent-Setting Judgment": "Could require updating legal research signals, classification models or practice-area content surfaces.",
        "Citation Spike": "May indicate rising demand for citation analytics, alerting and research relevance tuning.",
        "API/Data Licensing": "Could affect ingestion strategy, API rights, caching, downstream use and data-product architecture.",
    },
    "sales": {
        "AI Regulation": "Creates a client conversation opportunity around trusted legal AI, governance controls and defensible adoption.",
        "Privacy/Data Protection": "Supports board-level conversations about compliant data handling, privacy readiness and risk reduction.",
        "Judiciary Modernization": "Can position workflow automation and litigation efficiency as practical client value drivers.",
        "Legal Tech Market Intelligence": "Requires updated objection handling, competitor positioning and executive account messaging.",
        "Legislative Development": "Creates timely outreach themes for clients exposed to regulatory change.",
        "Precedent-Setting Judgment": "May create account-specific advisory moments for clients in affected sectors.",
        "Citation Spike": "Can support renewal and upsell conversations around authoritative research and litigation analytics.",
        "API/Data Licensing": "Highlights client demand for compliant legal data access and enterprise integration options.",
    },
    "legislation": {
        "AI Regulation": "Requires monitoring for consultation deadlines, draft instruments, gazette developments and implementation guidance.",
        "Privacy/Data Protection": "Needs tracking across bills, regulator guidance, commencement dates and compliance obligations.",
        "Judiciary Modernization": "May affect rules of court, procedural amendments and official practice directions.",
        "Legal Tech Market Intelligence": "Useful market context, but should be checked for legal information coverage implications.",
        "Legislative Development": "Requires legislative tracking, version comparison, commencement monitoring and stakeholder briefing.",
        "Precedent-Setting Judgment": "May alter interpretation notes or require linkage to relevant statutory materials.",
        "Citation Spike": "May indicate an emerging interpretive issue requiring deeper statutory analysis.",
        "API/Data Licensing": "Could affect official-source access, reuse permissions, data availability and update cadence.",
    },
    "editorial": {
        "AI Regulation": "May signal future demand for AI governance explainers, annotations, practical guidance and issue trackers.",
        "Privacy/Data Protection": "May need practical explainers, comparative notes and compliance checklists for affected users.",
        "Judiciary Modernization": "Can generate workflow explainers and practical court procedure notes for practitioners.",
        "Legal Tech Market Intelligence": "Useful for market awareness and potential legal technology trend coverage.",
        "Legislative Development": "May require explainers, amendment trackers, commencement notes and jurisdiction comparison content.",
        "Precedent-Setting Judgment": "Likely requires case note, annotation updates and downstream precedent monitoring.",
        "Citation Spike": "Strong signal for annotation priority, legal research explainers and related-content surfacing.",
        "API/Data Licensing": "May support coverage of legal-data access, public legal information and platform policy issues.",
    },
}
IMPLICATION_OTHERWISE = "May require review for team-specific workflow, content or client impact."
# What a department is advised to do, by urgency; the empty urgency is its default.
ACTIONS = {
    "product": {"": "Assess roadmap impact and identify any feature, governance or data-dependency changes.", "ACTION REQUIRED": "Open a product-risk review and confirm whether roadmap or controls need adjustment."},
    "sales": {"": "Prepare account messaging and note client segments likely to ask about this issue.", "STRATEGIC": "Create an executive talking point for senior leadership and priority client conversations."},
    "legislation": {"": "Track source developments and map deadlines, affected instruments and amendment status.", "ACTION REQUIRED": "Escalate for monitoring calendar entry and owner assignment."},
    "editorial": {"": "Assess whether the signal warrants an explainer, annotation update or watchlist item.", "STRATEGIC": "Prioritise editorial triage and check related content for update opportunities."},
}
ACTION_OTHERWISE = "Review and route to the responsible owner."
# Labels.
TOPIC_LABELS = {
    "ai_ethics": "AI Ethics", "ai_governance": "AI Governance", "ai_regulation": "AI Regulation", "competitor_intelligence": "Competitor Intelligence",
    "judiciary_ai": "Judiciary AI", "legal_ai": "Legal AI", "legal_market": "Legal Market", "legal_tech": "Legal Tech",
}
REGION_LABELS = {"apac": "APAC", "eu": "EU", "global": "Global", "singapore": "Singapore", "uk": "UK", "us": "US"}
DATE_RANGE_LABELS = {"All": "All", "7d": "Last 7 days", "30d": "Last 30 days", "90d": "Last 90 days"}
# The AI-news branch.
AI_TERMS = (
    "ai", "artificial intelligence", "automation", "chatgpt", "copilot", "generative ai", "genai", "hallucination", "legal ai", "legal tech", "legal technology", "law firm", "law firms",
    "lawyer", "lawyers", "llm", "machine learning", "regulation", "governance",
)
AI_FOCUSED_SOURCES = ("ai_artificial_lawyer", "ai_lawsites", "ai_legaltech_news", "ai_aba_legal_technology")
AI_FEEDS = {"ai_artificial_lawyer": "https://www.artificiallawyer.com/feed/", "ai_lawsites": "https://www.lawnext.com/feed/"}
AI_GROUP = "legal_ai_news"
AI_GENERIC_TITLES = ("Law Firm Business", "AI & Future Technologies", "Legal Technology", "Law Firm Profitability", "Risk & Compliance", "Legal Industry")
AI_TOPIC_PATTERNS = (
    (r"competitor|vendor|harvey|vlex|openai|clio|imanage|launch|platform|market", "Legal Tech Market Intelligence"),
    (r"regulation|governance|policy|act|official|dsit|oecd|imda|verify", "AI Regulation"),
    (r"privacy|security|risk|ethics|hallucination|assurance", "Privacy/Data Protection"),
    (r"api|data|licen[cs]", "API/Data Licensing"),
)
AI_TOPIC_OTHERWISE = "Legal Tech Market Intelligence"
AI_STRATEGIC_CATEGORIES = ("Official", "Vendor", "Market Intelligence")
# Page text that says nothing.
PARAGRAPH_BOILERPLATE = ("cookie settings", "subscribe to our newsletter", "sign up", "javascript is disabled", "enable browser")
# The instructions' input, line by line, and what stands for a missing field, with the characters kept.
SUMMARY_FIELDS = (("Title", "title", "Selected legal update", 220), ("Source", "source", "Unknown source", 160), ("Jurisdiction", "jurisdiction", "Unknown", 80), ("Category", "category", "Unknown", 80))
# Letters to people who move.
TONES = {
    "Warm professional": "Please accept our warmest congratulations on this important milestone.",
    "Executive concise": "Congratulations on this significant appointment.",
    "Ceremonial": "It is a privilege to mark this distinguished milestone in your judicial career.",
    "Formal judiciary": "I would like to extend our sincere congratulations on this important appointment.",
}
REVIEW_NOTE = "AI-generated draft. Requires human review before use."
# Mails of the day.
MAIL_SUBJECT = "APAC Legal Updates - "
MAIL_ONE = "Please find today's legal update below."
MAIL_MANY = "Please find today's {n} legal updates below."
PASTE_BODY = "Dear team,\n\nThe full update email body has been copied to your clipboard.\nPlease paste it here before sending.\n\nBest regards,"
# What a summary of an item without a public address reports.
NO_PUBLIC_SOURCE = "Only public http(s) source URLs can be summarized."
