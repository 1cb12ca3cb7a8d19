"""Phrases, names and limits that decide results, stated plainly."""

JUNK = [
    "verify you are human", "are you a robot", "cloudflare", "pardon our interruption", "enable javascript", "javascript is required",
    "please enable cookies", "cookie preferences", "privacy policy", "terms of service", "newsletter sign up", "subscribe to our newsletter", "advertisement",
]
AUTH = [
    "subscribe to continue", "subscription required", "log in to continue", "log in to keep reading", "sign in to continue", "already a subscriber",
    "members-only", "this content is for subscribers", "you have reached your article limit", "metered paywall", "support our journalism",
]
BOT = [
    "bot not allowed", "bots are not allowed", "automated access is not allowed", "automated traffic", "unusual traffic", "request blocked", "access denied",
    "forbidden for bots", "your request has been blocked", "temporarily blocked", "why did this happen", "we have detected unusual activity",
]
LABELS = ["full_text", "partial_text", "low_confidence", "failed", "url_only", "bot_blocked", "auth_required", "rate_limited", "robots_disallowed"]
URL_NAMES = ["url", "article_url", "link", "source_url", "web_url", "website"]
TITLE_NAMES = ["title", "headline", "article_title", "article headline", "name", "hed"]
SUMMARY_NAMES = ["summary", "snippet", "abstract", "description", "teaser", "dek"]
US_NAMES = ["us", "u.s.", "u.s.a.", "usa", "united states", "united states of america", "america"]
UK_NAMES = ["uk", "u.k.", "great britain", "britain"]
GOOD_WORDS = ["full", "verified", "passed", "complete", "success", "connected", "entered", "manual"]
WARN_WORDS = ["partial", "manual", "low", "truncated", "needs", "testing", "environment", "local"]
BAD_WORDS = ["failed", "error", "auth", "paywall", "rate", "robots", "bot", "missing", "blocked"]
TRUE_NAMES = ["true", "yes", "1", "y", "national"]
#: Columns a result has besides those of its manifest, with their empty values.
RESULT_DEFAULTS = {
    "fetched_text": "", "quality_label": "failed", "error_message": "", "extracted_headline": "", "extracted_author": "", "extracted_date": "",
    "extracted_site_name": "", "canonical_url": "", "recovery_route": "none", "http_status": "", "source_url_used": "", "word_count": 0, "char_count": 0,
    "paragraph_count": 0, "extraction_score": 0.0, "robots_note": "", "elapsed_s": 0.0, "candidate_count": 0, "winning_candidate_route": "none",
    "candidate_routes": "", "extraction_confidence_label": "blocked_or_failed", "boilerplate_ratio": 0.0, "duplicate_paragraph_ratio": 0.0, "extraction_trace_json": "[]",
}
EVIDENCE_CHARS = 22_000
#: White space and characters to drop, as inside a character class of Java and RE2 alike.
WS = "\\t\\n\\x0B\\f\\r    -     　﻿"
DROP = "\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F\\x{10000}-\\x{10FFFF}\\x{FDD0}-\\x{FDEF}\\x{FFFE}\\x{FFFF}"
