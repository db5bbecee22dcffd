"""Patterns, word lists, weights and limits.

Everything in this module must equal the published behaviour for results to be
right, so it is stated plainly as data. ``\\b`` means an ASCII word boundary; use
:func:`attestry.functions.text.pattern` before handing a pattern to Spark, because
Java's ``\\b`` also counts accented letters as word characters.
Product names of one's own organisation are parameters of the functions that need
them, not part of these lists.
"""

# ---------------------------------------------------------------- fixed values
# Identifiers
TASK_ID = r"\b[A-Z][A-Z0-9]{1,9}-\d+\b"
RECORD_ID = r"\b[A-Z][A-Z0-9]*(?:-[A-Z0-9]+)*-\d+\b"
ACTION_ID = r"\b[A-Z][A-Z0-9]+-\d+\b"
LOOKUP_ID = r"(?i)\b(?:[A-Z][A-Z0-9]*(?:-[A-Z0-9]+)*-\d+|[0-9a-f]{8}-[0-9a-f-]{27,})\b"
PRODUCT_NAME = r"\b[A-Z][a-z]{2,}[A-Z][A-Za-z0-9]{2,}\b"
CAPITALISED_PHRASE = r"\b[A-Z][A-Za-z0-9]+(?:\s+[A-Z][A-Za-z0-9]+){0,2}\b"

# Secret redaction, in order: (name, pattern, replacement)
_VENDORS = (
    "auth0|vercel|turso|oauth|slack|github|gitlab|linear|attio|stripe|google|openai|"
    "notion|intercom|jira|posthog|dropbox|gmail"
)
_CREDENTIAL_WORDS = (
    "api[_-]?(?:key|token)|auth[_-]?token|access[_-]?token|bot[_-]?token|refresh[_-]?token|"
    "oauth[_-]?client[_-]?secret|client[_-]?secret|encryption[_-]?key|token|secret|password"
)
_CAMEL_CREDENTIALS = (
    "apiKey|apiToken|authToken|accessToken|botToken|refreshToken|oauthClientSecret|"
    "clientSecret|encryptionKey|token|secret|password"
)
SECRET_RULES = [
    ("bearer", r"(?i)(\bBearer\s+)[A-Za-z0-9._~+/-]+=*", "$1[REDACTED]"),
    (
        "credential",
        rf"(?i)(\b(?:(?:[a-z0-9]+[_-])*(?:{_CREDENTIAL_WORDS})|(?:{_VENDORS})(?:{_CAMEL_CREDENTIALS}))"
        r"[\"']?\s*[:=]\s*[\"']?)[^\"',;\s&#{}\[\]]+",
        "$1[REDACTED]",
    ),
    ("userinfo", r"(?i)(\b(?:https?|libsql)://[^\s/@:]+:)[^\s/@]+(@[^\s]+)", "$1[REDACTED]$2"),
    ("vcp", r"\bvcp_[A-Za-z0-9_-]{20,}\b", "[REDACTED]"),
    ("xox", r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b", "[REDACTED]"),
    ("gh", r"\bgh[pousr]_[A-Za-z0-9_]{20,}\b", "[REDACTED]"),
    ("lin", r"\blin_api_[A-Za-z0-9_-]{12,}\b", "[REDACTED]"),
    ("qp", r"\bqp_(?:live|test)_[A-Za-z0-9_-]{12,}\b", "[REDACTED]"),
    ("attio", r"(?i)\battio_[A-Za-z0-9_-]{12,}\b", "[REDACTED]"),
    ("aiza", r"\bAIza[0-9A-Za-z_-]{20,}\b", "[REDACTED]"),
]
# What a text must hold for a rule to find anything: a stem beside ":" or "=", a mark as it is, a word in any case.
CREDENTIAL_STEMS = ["key", "token", "secret", "password"]
SECRET_MARKS = ["://", "vcp_", "xox", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "lin_api_", "qp_", "AIza"]
SECRET_WORDS = ["bearer", "attio_"]
SENSITIVE_FIELDS = [
    "apikey", "apitoken", "authtoken", "accesstoken", "bottoken", "refreshtoken",
    "oauthclientsecret", "clientsecret", "token", "secret", "password",
]
SENSITIVE_FIELD_SUFFIX = rf"(?i)(?:^|[_-])(?:{_CREDENTIAL_WORDS})$"
SENSITIVE_VENDOR_FIELD = rf"^(?:{_VENDORS})(?:{_CAMEL_CREDENTIALS.lower()})$"
COMPONENT_LABELS = {
    "urgency_deadline": "urgency / deadline",
    "customer_operational_impact": "customer / operational impact",
    "explicit_commitment": "explicit commitment",
    "dependency_blocking": "dependency / blocking effect",
    "source_corroboration": "source corroboration",
    "recency": "recency",
}

HIDDEN_FIELDS = [
    "workspace_id", "workspaceId", "request_id", "requestId", "token_hash",
    "idempotency_key", "provider_cursor_hash", "cursor_evidence_hash", "canary_query_hash",
]

# Hostile or instruction-like text
INJECTION = (
    r"(?i)(?:ignore|override|forget)\s+(?:all\s+)?(?:previous|prior|system|developer)\s+instructions"
    r"|reveal\s+(?:secrets?|credentials?|system prompts?|environment variables?)"
    r"|execute\s+(?:shell|command)"
)
CREDENTIAL_MENTION = (
    r"(?i)\b(?:secrets?|credentials?|passwords?|api[ _-]?keys?|access[ _-]?tokens?|"
    r"auth(?:entication)?[ _-]?(?:codes?|tokens?)|bearer tokens?|system prompts?|environment variables?)\b"
)
DISCLOSURE_VERB = r"(?i)\b(?:reveal|show|print|dump|export|send|upload|transmit|exfiltrat(?:e|ion))\b"
INSTRUCTION_OVERRIDE = (
    r"(?i)\b(?:ignore|override|forget)\s+(?:all\s+)?(?:previous|prior|system|developer)\s+instructions\b"
)
REASON_DISCLOSURE = "credential disclosure or transmission"
REASON_OVERRIDE = "instruction override combined with sensitive data access"

# Release chatter
NOISE_PATTERNS = [
    r"(?i)\b(?:TypeScript|ESLint|Vitest|Webpack|Vinext)\b",
    r"(?i)\b\d+\s+tests?\s+passed\b",
    r"(?i)\b(?:exact preview|benchmark artifact|secret scans?|diff whitespace check)\b",
    r"(?i)/api/health/live\b",
    r"(?i)\bdeployment:\s*(?:dpl_|https://)\S*",
    r"(?i)\b(?:production|preview)\s+build\s+passed\b",
]

# Provider labels
PROVIDER_ALIASES = {
    "google": "gmail", "google_mail": "gmail", "googlemail": "gmail",
    "google_drive": "google_drive", "msteams": "microsoft_teams", "ms_teams": "microsoft_teams",
}
SPOKEN_ALIASES = {
    "gmail": ["email"], "google_calendar": ["google calendar", "gcal"],
    "google_drive": ["google drive"], "github": ["git hub"], "gitlab": ["git lab"],
}
TRACKER_ORDER = ["linear", "jira", "shortcut", "asana", "github", "gitlab", "notion"]
DELIVERY_REPAIR_ORDER = [
    "github", "gitlab", "linear", "jira", "shortcut", "slack", "notion", "confluence",
]
DELIVERY_RECORD_PROVIDERS = [
    "github", "gitlab", "linear", "jira", "shortcut", "slack", "notion", "confluence", "document",
]

# Document kinds
DOCUMENT_KIND = r"(?i)^(?:file|document|uploaded_document|pdf)$"
DOCUMENT_MIME = (
    r"(?i)^(?:application/(?:pdf|msword|rtf|vnd\.(?:ms-|openxmlformats-officedocument))|text/rtf)"
)
DOCUMENT_EXTENSION = (
    r"(?i)\.(?:pdf|docx?|md|markdown|txt|rtf|odt|csv|tsv|json|ya?ml|toml|html?|pptx?|xlsx?)$"
)
GENERIC_TITLE = r"(?i)^(message|email|thread|record|untitled|slack|gmail|linear)(\s|$)"
URL_SECRET_PARAM = r"(?i)(?:token|secret|password|api[_-]?key|auth|signature|sig|code)"

# Keyword signals
NEGATION = (
    r"(?i)\b(no|not|non|never|without|zero|isn't|aren't|wasn't|weren't|lacks?|excluding)\b"
    r"[\s\-]*(?:\w+[\s\-]+){0,2}$"
)
SIGNALS = {
    "security": r"\b(security|vulnerability|breach|incident|outage|sev[ -]?[01])\b",
    "customer": r"\b(customer|client|enterprise|renewal|revenue|contract|churn)\b",
    "urgent": r"\b(today|urgent|asap|immediately|blocking|deadline|overdue|before (?:monday|tuesday|wednesday|thursday|friday))\b",
    "dependency": r"\b(blocked|blocking|unblock|depends? on|prerequisite)\b",
}
COMMITMENT = r"(?i)\b(i will|we will|promised|committed|must|need(?:s)? to|please)\b"
ACTIONABLE = (
    r"(?i)\b(will|must|need(?:s)? to|should|please|todo|action|follow[ -]?up|blocked|unblock|due|"
    r"deadline|urgent|asap|ship|send|review|fix|investigate|resolve|renewal|incident|outage|escalat|"
    r"deliver|approve)\b"
)
CLOSED_STATUS = r"(?i)\b(completed|resolved|closed|cancelled)\b"
QUICK_WIN = r"(?i)\b(send|review|approve|reply|merge|fix)\b"
REPORTS_COMPLETE = r"(?i)\b(merged|shipped|resolved|closed|completed)\b"
REPORTS_OPEN = r"(?i)\b(still\s+(?:showing\s+as\s+)?open|remains?\s+open|ticket\s+still\s+open)\b"
TRACKED_ENTITY = r"(?i)\b(?:issue|ticket)\s+([A-Z][A-Z0-9]*(?:-[A-Z0-9]+)*-\d+)\b"

# Task spans
_TASK_VERBS = (
    "review|fix|send|ship|deliver|approve|resolve|investigate|renew|reply|merge|unblock|report|"
    "raise|schedule|confirm|complete|provide|update|unsubscribe"
)
_MONTHS_LONG = (
    "january|february|march|april|may|june|july|august|september|october|november|december"
)
ACTOR_COMMITMENTS = [
    r"(?i)\b(?:i|we|engineering|the team|support|security|operations)\s+(?:will|'ll|must|should|need(?:s)? to|commit(?:s|ted)?|promis(?:e[sd]?|ed))\b",
    r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?\s+(?:will|must|should|needs? to|commits?|committed|promises?|promised)\b",
]
STRONG_TASK_SIGNALS = ACTOR_COMMITMENTS + [
    r"(?i)\b(?:committed|promised)\b",
    r"(?i)\b(?:blocked|blocking|overdue|still\s+(?:showing\s+as\s+)?open|remains?\s+open|escalat(?:ed|ion))\b",
    r"(?i)\bdeadline\b[^.!?]{0,90}\b(?:moved|changed|before|by|on|is|was|to)\b",
    rf"(?i)\b(?:slipped|delayed|postponed|moved)\b[^.!?]{{0,90}}\b(?:today|tomorrow|monday|tuesday|wednesday|thursday|friday|saturday|sunday|\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}\s+(?:{_MONTHS_LONG}))\b",
    r"(?i)\b(?:is|are|remains?)\s+(?:(?:being\s+)(?:fixed|investigated|reviewed|worked)|open|blocked|in\s+progress)\b",
    rf"(?i)^(?:action\s*:\s*)?(?:please\s+)?(?:{_TASK_VERBS})\b",
    rf"(?i)^(?:must|need to|should)\s+(?:{_TASK_VERBS})\b",
    rf"(?i)\b(?:can|could|would)\s+you\s+(?:please\s+)?(?:{_TASK_VERBS})\b",
    rf"(?i)\bplease\s+(?:{_TASK_VERBS})\b",
    rf"(?i)\b(?:action|required action)\s*:\s*(?:{_TASK_VERBS})\b",
    r"(?i)\b[A-Z][A-Z0-9]{1,9}-\d+\b[^.!?]{0,80}\b(?:will|must|need(?:s)? to|is\s+due|remains?\s+open|is\s+blocked)\b",
    r"(?i)\b(?:[A-Z][A-Z0-9]{1,9}-\d+|task|issue|renewal|follow[ -]?up)\b[^.!?]{0,80}\b(?:is|are)?\s*due\b",
    r"(?i)\b(?:reported|active|ongoing|unresolved)\b[^.!?]{0,90}\b(?:incident|outage)\b",
    r"(?i)\b(?:incident|outage)\b[^.!?]{0,90}\b(?:reported|active|ongoing|blocking|unresolved)\b",
]
# Every strong signal holds one of these words.
STRONG_TASK_WORDS = (
    r"(?i)(?<!\w)(?:will|'ll|must|should|need|commit|promis|block|overdue|open|escalat|deadline|slipped|delayed|postponed|moved|"
    rf"being|progress|(?:is|are)?due|incident|outage|{_TASK_VERBS})"
)
NEGATIVE_OBLIGATION = r"(?i)\b(?:must|should|need(?:s)? to)\s+not\b"
NON_TASK_CONTEXT = (
    r"(?i)\b(?:(?:recipients?|employee|agreement|information).{0,100}(?:confidential|proprietary|jurisdiction|unauthori[sz]ed)"
    r"|(?:agreement|parties).{0,100}(?:operation of law|automatically|binding|governed|jurisdiction)"
    r"|students?.{0,100}(?:assignment|coursework|homework|submit)"
    r"|(?:academic|assignment|coursework|homework|essay|thesis|dissertation).{0,100}(?:submit|complete|deadline)"
    r"|example (?:issue|task|answer)|question\s+\d+.{0,100}provide|help (?:you|your)|business grow"
    r"|achieve (?:your|their) goals|special offer|student pricing|for internal use only|must not be shared"
    r"|all rights reserved)\b"
)
TASK_ACTION = (
    r"(?i)\b(?:review|fix|send|ship|deliver|deploy|launch|approve|resolve|investigate|renew|reply|respond|response|"
    r"merge|unblock|report|raise|schedule|confirm|complete|finish|provide|update|write|prepare|submit|rotate|book|"
    r"call|refund|own|unsubscribe)\b"
)
LIVE_TASK_STATE = (
    r"(?i)\b(?:blocked|blocking|overdue|due|still\s+(?:showing\s+as\s+)?open|remains?\s+open|(?:is|are)\s+open|"
    r"(?:is|are|remains?)\s+being\s+(?:fixed|investigated|reviewed|worked)|in\s+progress|escalat(?:ed|ion)|incident|"
    r"outage|deadline|slipped|delayed|postponed|moved)\b"
)
TEMPORAL_ANCHOR = (
    r"(?i)\b(?:today|tomorrow|monday|tuesday|wednesday|thursday|friday|saturday|sunday|this\s+(?:week|month|quarter)|"
    r"next\s+(?:week|month|quarter)|end\s+of\s+(?:day|week|month|quarter)|eod|cob|close\s+of\s+business|"
    rf"\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}\s+(?:{_MONTHS_LONG}))\b"
)
# Pairs of patterns that together mark a passage as not live work
NON_LIVE_PAIRS = [
    (
        r"(?i)\bhomework\b",
        r"(?i)\b(?:question\s+\d+|provide (?:the )?subject and body|based on the above findings|section\s+\d+)\b",
    ),
    (
        r"(?i)\b(?:academic support|academic writing)\b",
        r"(?i)\b(?:student pricing|assignment help|thesis|dissertation|our services?)\b",
    ),
    (
        r"(?i)\b(?:employment agreement|successful application)\b",
        r"(?i)\b(?:exclusive jurisdiction|confidential and proprietary|for internal use only)\b",
    ),
    (
        r"(?i)\b(?:successful application|pre-contract documentation|right to work|photo identification|passport|e-?visa|national insurance)\b",
        r"(?i)\b(?:written offer|onboarding|identity documents?|payroll employment)\b",
    ),
]
NO_PAYMENT = r"(?i)\bno payment(?: of any kind)?\b[\s\S]{0,180}\b(?:equipment|training|software|onboarding)\b"
TRAINING_PAIR = (
    r"(?i)\b(?:codelabs?|mcq assessment|workshops? completed)\b",
    r"(?i)\b(?:submission deadline|complete|finish|assessment|workshops?)\b",
)
TRAINING_CANDIDATE = r"(?i)\b(?:codelabs?|mcq assessment|workshops?|assessment)\b"
NON_LIVE_MARKER = (
    r"(?i)\b(?:homework|question\s+\d+|academic support|academic writing|student pricing|assignment help|"
    r"employment agreement|successful application|pre-contract documentation|right to work|photo identification|"
    r"passport|e-?visa|national insurance|written offer|onboarding|identity documents?|payroll employment|codelabs?|"
    r"mcq assessment|workshops? completed)\b"
)
SPAN_SCORE = [
    (3, r"(?i)\b(?:committed|commits?|promised|will|must|need(?:s)? to)\b"),
    (2, r"(?i)\b(?:customer|enterprise|incident|outage|blocked|deadline|overdue|escalat)\b"),
    (1, rf"(?i)\b(?:\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}\s+(?:{_MONTHS_LONG}))\b"),
]

# Dates
MONTHS = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4,
    "may": 5, "jun": 6, "june": 6, "jul": 7, "july": 7, "aug": 8, "august": 8, "sep": 9, "sept": 9,
    "september": 9, "oct": 10, "october": 10, "nov": 11, "november": 11, "dec": 12, "december": 12,
}
WEEKDAYS = ["sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday"]
MONTH_WORD = (
    "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|"
    "sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
)
ISO_DATE = r"\b\d{4}-\d{2}-\d{2}\b"
DATE_LITERAL = rf"(?i)\b(?:\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}\s+(?:{_MONTHS_LONG})(?:\s+\d{{4}})?)\b"
MOVED_FROM = rf"(?i)\bmoved\s+from\s+(\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}\s+(?:{_MONTHS_LONG})(?:\s+\d{{4}})?)\b"
UNRESOLVED_DATE = (
    r"(?i)\b(?:next\s+(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday)|(?:this|next)\s+(?:week|month|quarter)|"
    r"end\s+of\s+(?:day|week|month|quarter)|eod|cob|close\s+of\s+business|\d{1,2}[./-]\d{1,2}(?:[./-]\d{2,4})?)\b"
)

# Word lists
ANSWER_STOP_WORDS = [
    "about", "after", "again", "also", "already", "and", "are", "been", "before", "being", "but",
    "can", "could", "did", "does", "for", "from", "had", "has", "have", "he", "her", "him", "how",
    "into", "it", "its", "not", "our", "out", "said", "say", "she", "that", "the", "their", "them",
    "then", "there", "these", "they", "this", "those", "was", "were", "what", "when", "where",
    "which", "who", "why", "will", "with", "would", "you", "your",
]
GENERIC_QUESTION_TOKENS = [
    "against", "answer", "appear", "commit", "committ", "context", "deadline", "disagree",
    "elsewhere", "engineer", "exact", "fil", "fix", "issue", "merge", "open", "project", "promi",
    "resolv", "source", "sourc", "track", "work", "document", "email", "github", "gmail", "jira",
    "linear", "notion", "slack",
]
BRIDGE_GENERIC_TOKENS = GENERIC_QUESTION_TOKENS + [
    "authentication", "customer", "engineering", "incident", "outage", "reported", "team",
]
SEARCH_STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "did", "do", "does", "for", "from",
    "had", "has", "have", "how", "i", "in", "is", "it", "its", "me", "of", "on", "or", "our", "so",
    "than", "that", "the", "their", "them", "then", "there", "these", "they", "this", "to", "was",
    "we", "were", "what", "when", "where", "which", "who", "why", "will", "with", "you", "your",
]
WORDING_STOP_WORDS = [
    "about", "after", "against", "before", "being", "between", "could", "from", "have", "into",
    "must", "need", "needs", "please", "should", "someone", "that", "their", "there", "these",
    "this", "those", "through", "under", "until", "very", "what", "when", "where", "which", "while",
    "will", "with", "would", "your",
]
PHRASE_STOP_WORDS = [
    "a", "an", "and", "april", "august", "document", "february", "friday", "github", "gmail",
    "heads up", "i", "january", "july", "june", "linear", "march", "may", "monday", "november",
    "october", "saturday", "september", "slack", "sunday", "the", "this", "thursday", "tuesday",
    "wednesday", "we",
]
GENERIC_SCOPES = [
    "action", "access", "billing", "customer", "client", "document", "email", "engineering",
    "enterprise", "followup", "github", "gmail", "important", "incident", "issue", "linear",
    "mortem", "operations", "please", "post", "request", "renewal", "security", "slack", "status",
    "support", "task", "team", "the", "this", "today", "tomorrow", "update", "there",
]
WORDING_ACTION = (
    r"(?i)\b(?:approve|call|commit(?:ted)?|complete|confirm|deliver|finish|fix|investigate|launch|need(?:s)? to|prepare|"
    r"promis(?:e[sd]?|ed)|raise|report|resolve|review|send|ship|should|update|will|write)\b"
)
BROAD_DELIVERY_TOKENS = [
    "and", "are", "as", "been", "did", "do", "does", "had", "has", "have", "is", "it", "most",
    "deliver", "delivered", "deploy", "deployed", "launch", "launched", "newest", "latest", "open",
    "our", "recent", "recently", "release", "released", "ship", "shipped", "shipping", "show",
    "showing", "shows", "still", "that", "the", "thing", "things", "tracker", "tracking", "was",
    "we", "were", "what", "which", "work",
]

# Question planning: lower-cased question text
PLAN_SIGNALS = {
    "temporal": (
        r"\b(since|before|after|changed|yesterday|today|latest|newest|timeline|most\s+recent(?:ly)?|since monday|this week)\b"
        r"|\b(desde|antes|despu[eé]s|cambi[oó]|lunes|hoy|ayer)\b"
    ),
    "explicit_conflict": r"\b(conflict(?:ing|ed|s)?|contradict(?:ory|ing|ed|s)?|disagree(?:ment|ments|d|s)?|inconsistent|inconsistency)\b",
    "implied_conflict": r"\b(despite|still .* open|already .* (?:shipped|merged|resolved)|appears?(?:\s+\w+){0,4}\s+resolved elsewhere)\b",
    "absence": (
        r"\b(?:no|without|missing|lacks?)\b[^?]{0,50}\b(?:issue|ticket|track(?:ed|ing)?)\b"
        r"|\b(?:issue|ticket)\b[^?]{0,35}\b(?:missing|absent|not tracked)\b"
    ),
    "counterfactual": r"\b(what if|would move|if .* resolved|why .* above)\b",
    "cross_source": r"\b(across|cross[- ]source|multiple systems|every system)\b",
    "multi_hop": r"\bwhy\b|\band (?:what|which|who|whose|where|when|how|is|are|was|were|does|do|did|has|have|can|should|will)\b",
    "entity": r"\b(same person|same (?:company|project|entity)|duplicate|dedup|merge .* into one|alias)\b",
    "attribution_who": r"\bwho (?:committed|promised|said|wrote|filed|owns?)\b",
    "attribution_what": r"\b(which|what|where|message|thread|project)\b",
    "priority": r"\b(what should .* (?:first|next)|work on first|prioriti[sz]e|rank the|most important|deserves attention)\b",
    "spanish": r"\b(qu[eé]|qui[eé]n|cu[aá]l|desde|lunes|cambi[oó])\b",
    "thread": r"\b(thread|conversation|discussion)\b",
    "provenance": r"\b(source of|trace .* from .* to|compare .* (?:with|against)|vendor email|liability cap|layoff)\b",
    "scope_words": r"\b(across|slack|gmail|linear|github|email|document)\b",
}
PLAN_PROVIDERS = ["slack", "gmail", "linear", "github", "email", "document"]
RECENCY_QUESTION = r"(?i)\b(?:most\s+recent(?:ly)?|latest|newest)\b"
DELIVERY_QUESTION = (
    r"(?i)\b(?:ship|shipped|shipping|release|released|deliver|delivered|launch|launched|deploy|deployed)\b"
)
DELIVERY_ASSERTION = (
    r"(?i)\b(?:was|were|has been|have been)\s+(?:successfully\s+)?(?:shipped|released|deployed|merged|launched|delivered|rolled out)\b"
    r"|\bready to (?:ship|release|deploy)\b|\bwent live\b|\bcut the release\b"
    r"|\b(?:shipped|released|deployed|merged|launched)\s+(?:on|in|to|last|this)\s"
)
IMPEDIMENT_QUESTION = (
    r"(?i)\b(?:blocking|blocked|blockers?|holding up|held up|stalled|stalling|waiting on|in the way)\b"
)
IMPEDIMENT_ASSERTION = (
    r"(?i)\b(?:is|are|was|were|remains?|stays?|still)\s+blocked\b|\bblocked\s+(?:on|by)\b|\bblockers?\b"
    r"|\b(?:is|are|were|keeps?|kept)\s+blocking\b|\bwaiting\s+(?:on|for)\b"
    r"|\b(?:cannot|can\s?not|can't|could\s?not|couldn't)\s+(?:be\s+)?(?:start|started|ship|shipped|proceed|land|deploy|deployed|release|released|launch|launched|continue|go\s+live)\b"
    r"|\bheld\s+up\s+by\b|\bholding\s+up\b|\bdepends?\s+on\b|\bblocks\s+\w"
)
COMMITTED_GA_QUESTION = (
    r"(?i)\bcommitt\w*\b[^?]{0,80}\b(?:general\s+availability|GA)\b"
    r"|\b(?:general\s+availability|GA)\b[^?]{0,80}\bcommitt\w*\b"
)
GA_ASSERTION = r"(?i)\b(?:general\s+availability|generally\s+available|GA(?:\s+date)?)\b"
CALENDAR_DATE = (
    rf"(?i)\b(?:\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}\s+(?:{_MONTHS_LONG})\s+\d{{4}}|(?:{_MONTHS_LONG})\s+\d{{1,2}},\s+\d{{4}})\b"
)
MISSING_TRACKER_QUESTION = (
    r"(?i)\b(?:no|without|missing|lacks?)\b[^?]{0,70}\b(?:issue|ticket|track(?:ed|ing)?)\b"
    r"|\b(?:issue|ticket)\b[^?]{0,50}\b(?:missing|absent|not tracked)\b"
)
MISSING_TRACKER_ASSERTION = (
    r"(?i)\b(?:no (?:linear )?(?:issue|ticket)|not tracked(?: in [a-z0-9_-]+)?|without (?:an? )?(?:issue|ticket)|lacks? (?:an? )?(?:issue|ticket))\b"
)
STALE_STATE_QUESTION = (
    r"(?i)\bopen\s+(?:issue|ticket)\b[^?]{0,100}\b(?:resolved|complete|completed|closed|merged|shipped|elsewhere)\b"
    r"|\bappears?(?:\s+\w+){0,5}\s+resolved\s+elsewhere\b"
    r"|\b(?:tracker|tracking|issue|ticket)\b[^?]{0,90}\b(?:still\s+)?(?:show(?:s|ing)?|remain(?:s|ing)?|stay(?:s|ing)?)?[^?]{0,30}\bopen\b"
)
TRACKER_OPEN = (
    r"(?i)\b(?:still\s+(?:showing\s+as\s+)?open|remains?\s+open|issue\s+is\s+open|ticket\s+still\s+open|status(?:\s+is|:)?\s+open)\b"
)
TRACKER_WORDS = r"(?i)\b(?:against|filed|issue|record|ticket|track(?:ed|ing)?)\b"
FILING_QUESTION = r"(?i)\bwho\s+filed\b|\bwhich\s+project\b|\bproject\b[^?]{0,80}\bagainst\b"
# (question pattern, candidate pattern, boost)
INTENT_BOOSTS = [
    (r"(?i)\b(merge|merged|ship|shipped|resolved|closed|fix)\b", r"(?i)\b(merge|merged|ship|shipped|resolved|closed|fix)\b", 7),
    (r"(?i)\b(commit|committed|promise|promised|deadline|when)\b", r"(?i)\b(commit|committed|promise|promised|deadline|before|due|will)\b", 7),
    (r"(?i)\b(escalat|who)\w*\b", r"(?i)\b(escalat|filed|reported|owner|assigned)\w*\b", 5),
    (r"(?i)\b(disagree|conflict|inconsistent|changed|moved)\w*\b", r"(?i)\b(disagree|conflict|inconsistent|changed|moved|from|to)\w*\b", 6),
    (r"(?i)\b(project|work|working)\b", r"(?i)\b(project|working|against|assigned)\b", 3),
    (r"(?i)\b(still in force|single approver|still valid)\b", r"(?i)\b(supersed|withdrawn|must not|no longer|two approver)\w*\b", 12),
    (r"(?i)\b(programme code|project alias|alias)\b", r"(?i)\b(programme code|HR-P\d+|field autonomy toolkit|alias)\b", 10),
    (r"(?i)\b(require|requirement|what does)\w*\b", r"(?i)\b(english translation|reduc\w* to fifteen minute|fifteen minute|will be reduc)\w*\b", 12),
    (r"(?i)\b(role|programme does|which programme|own)\w*\b", r"(?i)\b(staff reliability engineer|customer escalation manager|engineering owner|HR-\d+)\b", 9),
    (r"(?i)\b(severity|impact window|acknowledgement target|approves)\b", r"(?i)\b(SEV-\d|impact|minute|duty operations lead|approver)\w*\b", 8),
]
AUTHORITY_QUESTION = r"(?i)\b(?:authority|binding|current|draft|force|govern|original(?:ly)?|permit(?:ted)?|policy|ratif\w*|replac\w*|rule|still|supersed\w*|today|valid|withdrawn)\b"
AUTHORITY_RELATION = r"(?i)\b(?:binding|controlling|current|govern\w*|must|no longer|operational authority|ratif\w*|replac\w*|requires?|shall|supersed\w*|withdrawn)\b"
STRONG_AUTHORITY_LINK = r"(?i)\b(?:(?:binding|controlling|current)\s+(?:decision|policy|rule|standard)|governed\s+by|replaced\s+by|supersed\w*\s+by)\b"
NON_AUTHORITY_STATE = r"(?i)\b(?:carries? no (?:operational )?authority|must not be relied on|never ratified|no longer (?:binding|in force|valid)|not (?:binding|in force|ratified|valid)|superseded|withdrawn)\b"
CURRENT_AUTHORITY_STATE = r"(?i)\b(?:(?:binding|controlling|current)\s+(?:decision|policy|rule|standard)|governs?|in force|requires?|must|shall)\b"
AUTHORITY_DESIGNATION = r"(?i)\b(?:binding|controlling|current)\s+(?:decision|policy|rule|standard)\b"
NORMATIVE_REQUIREMENT = r"(?i)\b(?:approvals?|approvers?|requires?|must|shall)\b"
HISTORICAL_PERMISSION = r"(?i)\b(?:at issue|formerly|historical|originally|previously|used to|was permitted|were permitted|allowed|could|may)\b"
ORIGINAL_QUESTION = r"(?i)\boriginal(?:ly)?\b"
REPLACEMENT = r"(?i)\b(?:replac\w*|supersed\w*)\b"

# Value intents: (name, question pattern, needs a named record, value patterns)
VALUE_INTENTS = [
    (
        "release",
        r"(?i)\b(release|released|fixed in|fix was|merged on|merged|ratified|when was|when did|shipped)\b",
        True,
        [
            rf"(?i)\b\d{{1,2}}\s+(?:{_MONTHS_LONG})\s+\d{{4}}\b",
            r"(?i)\b[A-Z][A-Za-z]*\s+SDK\s+\d+(?:\.\d+)+\b",
            r"(?i)\bfixed\s+in\s+[^.!?\n]{0,80}",
            r"(?i)\bmerged\s+on\s+[^.!?\n]{0,80}",
            r"(?i)\breleased?\s+(?:in|on)\s+[^.!?\n]{0,80}",
            r"(?i)\bratified\s+on\s+[^.!?\n]{0,80}",
        ],
    ),
    (
        "authority",
        r"(?i)\b(still in force|supersed|withdrawn|single approver|binding rule|originally permit|original permission|permit|permitted|rule|policy|draft)\b",
        False,
        [
            r"(?i)\b(?:supersed\w*|withdrawn|no longer in force|no longer valid)[^.!?\n]{0,130}",
            r"(?i)\btwo(?:-|\s+)approver\w*[^.!?\n]{0,150}",
            r"(?i)\bSafety Case Owner[^.!?\n]{0,110}",
            r"(?i)\bbinding rule[^.!?\n]{0,130}",
            r"(?i)\bmust not be relied on[^.!?\n]{0,90}",
            r"(?i)\bnever ratified[^.!?\n]{0,90}",
            r"(?i)\bcarries no operational authority[^.!?\n]{0,70}",
        ],
    ),
    (
        "duration",
        r"(?i)\b(impact|how long|duration)\b",
        False,
        [
            r"(?i)\b\d{1,4}\s+(?:minutes?|min\b|hours?)\s+of\s+[^.!?\n]{0,90}",
            r"(?i)\bcustomer\s+(?:impact|visible)\s+lasted\s+[^.!?\n]{0,90}",
            r"(?i)\bimpact\s+lasted\s+[^.!?\n]{0,90}",
            r"(?i)\bimpact\s+window\s+[^.!?\n]{0,90}",
        ],
    ),
    (
        "summary",
        r"(?i)\b(what happened|what was|describe|summary|occurred|record)\b",
        True,
        [r"(?i)\b[A-Z][A-Z0-9]*(?:-[A-Z0-9]+)*-\d+\s+was\s+a\s+[^.!?\n]{0,140}"],
    ),
    ("desk", r"(?i)\bescalat\w*|\b(?:desk|runs?)\b", False, [r"(?i)\bescalation desk[^.!?\n]{0,60}"]),
]
# The alias intent is the one that needs no anchor in the question.
ALIAS_INTENT = ("alias", r"(?i)\b(programme code|project alias|alias)\b", r"(?i)\bHR-P\d+\b")
# A permission question about the past adds these to the authority intent.
PAST_PERMISSION_QUESTION = r"(?i)\b(?:original(?:ly)?|previously|what did)\b"
PAST_PERMISSION_VALUES = [
    r"(?i)\bsingle\s+Tier\s+\d+\s+engineer[^.!?\n]{0,150}",
    r"(?i)\bcould\s+flash[^.!?\n]{0,130}",
]

# Facets: (label, requested by, supported by)
FACETS = [
    ("escalation actor", r"(?i)\bwho\b[^?]{0,100}\bescalat\w*\b|\bwho\s+escalat\w*\b", r"(?i)\b(?:escalat|reported|raised)\w*\b"),
    ("engineering commitment", r"(?i)\b(?:commit|promise)\w*\b", r"(?i)\b(?:commit|promise)\w*\b|\bhard customer commitment\b"),
    ("completion state", r"(?i)\b(?:already\s+)?(?:merged|shipped|resolved|closed)\b|\bis\s+the\s+fix\b", r"(?i)\b(?:merged|shipped|resolved|closed|completed)\b"),
    ("date or deadline", r"(?i)\bwhen\b|\bdue\b|\bdeadline\b", rf"(?i)\b(?:\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}\s+(?:{_MONTHS_LONG})\s+\d{{4}})\b"),
    ("general availability date", COMMITTED_GA_QUESTION, None),
    ("filing actor", r"(?i)\bwho\s+filed\b", r"(?i)\bfiled\b"),
    ("owner", r"(?i)\bwho\s+owns\b|\bwho\s+(?:is|are)\s+the\s+owners?\b|\bwho\s+owns?\s+it\b", r"(?i)\bowner\b|\bowns\b|\bowned\s+by\b|\bassigned\s+to\b"),
    ("project association", r"(?i)\bwhich\s+project\b|\bproject\b[^?]{0,80}\bagainst\b", r"(?i)\b(?:against|project|programme)\b"),
]

# Ranking policy
POLICY_VERSION = "default-2.0.0"
POLICY_WEIGHTS = {
    "urgency_deadline": 25.0,
    "customer_operational_impact": 25.0,
    "explicit_commitment": 15.0,
    "dependency_blocking": 15.0,
    "source_corroboration": 10.0,
    "recency": 10.0,
}
COMPONENT_LABELS = {
    "urgency_deadline": "urgency / deadline",
    "customer_operational_impact": "customer / operational impact",
    "explicit_commitment": "explicit commitment",
    "dependency_blocking": "dependency / blocking effect",
    "source_corroboration": "source corroboration",
    "recency": "recency",
}
PENALTIES = [
    "likely_resolved", "duplicate", "unresolved_dependency", "weak_evidence",
    "conflicting_evidence", "stale_evidence", "missing_owner", "low_actionability",
]
QUEUE_SIZE = 18
CONTEXT_MAX = 420
UNIT_MIN = 18
PROOF_MAX_AGE_HOURS = 168
MAX_DOCUMENT_BYTES = 25 * 1024 * 1024
RECENCY_WEIGHT = 28.0
FACET_MESSAGE = "Insufficient evidence for the requested "

# Evaluation
COVERAGE_DIMENSIONS = {
    "multi_hop": ["multi-hop", "entity-dedup", "knowledge-update", "attribution", "thread", "conflict", "priority"],
    "temporal_update": ["temporal", "knowledge-update", "conflict"],
    "contradiction_stale": ["conflict", "knowledge-update", "counterfactual"],
    "entity_dedup": ["entity-dedup", "actor"],
    "exact_metadata": ["exact-id", "metadata"],
}
EVAL_CATEGORIES = [
    "exact-id", "actor", "thread", "temporal", "metadata", "entity-dedup", "knowledge-update",
    "attribution", "multilingual", "multi-hop", "conflict", "priority", "counterfactual",
    "adversarial", "large-pdf",
]
EVAL_PROVIDERS = ["slack", "gmail", "linear", "github", "document"]
CONNECTOR_STATES = [
    "not_configured", "credentials_submitted", "connector_created", "resources_discovered",
    "resources_selected", "initial_sync_requested", "sync_in_progress", "data_verified", "degraded",
    "authentication_expired", "permission_insufficient", "rate_limited", "failed", "deleted",
]
CANARY_KINDS = {
    "beginning": "beginning_load_bearing", "middle": "middle_load_bearing", "end": "end_load_bearing",
}
OMITTED_KEYS = [
    "workspaceid", "database", "databases", "databaseid", "databaseids", "collection", "collections",
    "collectionid", "collectionids", "accountscope", "storageid", "storageids", "storagekey",
    "storagekeys", "fingerprint", "metadata", "metadatajson", "metadatafilters",
    "additionalmetadata", "lineagemetadatafilters", "externalid", "externalids", "requestid",
    "providerresponseid", "sha256", "sha1", "md5", "checksum", "digest", "etag",
    "deduplicatedtasks", "error", "errors", "lasterror", "rawerror", "executionerror",
    "failurereason",
]

# Dates in prose
DAY_FIRST_DATE = rf"\b(\d{{1,2}})(?:st|nd|rd|th)?\s+({MONTH_WORD})\.?(?:,?\s+(\d{{4}}))?\b"
MONTH_FIRST_DATE = rf"\b({MONTH_WORD})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?(?:,?\s+(\d{{4}}))?\b"
RELATIVE_DAY = r"\b(?:next\s+)?(?:today|tomorrow|monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b"
ISO_DATE = r"(?<!\d)\d{4}-\d{2}-\d{2}(?!\d)"
# Words that name no topic, states, and words around a conflict
NON_TOPICAL = [
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november",
    "december", "open", "closed", "merged", "shipped", "released", "resolved", "latest", "newest", "recent", "still",
    "remains", "showing", "source", "sources", "says", "said", "tracked", "issue", "deadline", "promise", "promised",
    "commitment", "committed",
]
STATE_TOKENS = [
    "active", "approved", "blocked", "cancelled", "canceled", "closed", "complete", "completed", "disabled", "enabled",
    "failed", "fixed", "merged", "open", "pending", "rejected", "resolved", "shipped",
]
CONFLICT_STOP = [
    "according", "cited", "claim", "claims", "contain", "contains", "date", "dates", "deadline", "different", "disagree",
    "disagrees", "evidence", "record", "records", "report", "reports", "said", "says", "source", "sources", "state",
    "states", "while", "with",
]
# A completion request without an object
COMPLETION_SUBJECT = (
    r"(?:(?:action\s*:\s*)?(?:please\s+)?|(?:can|could|would)\s+you\s+(?:please\s+)?|(?:must|need to|should)\s+"
    r"|(?:i|we|you|engineering|the team|support|security|operations|[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\s+"
    r"(?:will|must|should|need(?:s)? to)\s+)"
)
COMPLETION_TIME = (
    r"(?:(?:by|on)\s+)?(?:today|tomorrow|monday|tuesday|wednesday|thursday|friday|saturday|sunday"
    r"|(?:this|next)\s+(?:week|month|quarter)|end\s+of\s+(?:day|week|month|quarter)|eod|cob|close\s+of\s+business"
    r"|\d{4}-\d{2}-\d{2}(?:t\d{2}:\d{2}(?::\d{2})?(?:\.\d+)?z?)?"
    rf"|\d{{1,2}}(?:st|nd|rd|th)?\s+(?:{MONTH_WORD})(?:,?\s+\d{{4}})?|(?:{MONTH_WORD})\s+\d{{1,2}}(?:st|nd|rd|th)?(?:,?\s+\d{{4}})?"
    r"|\d{1,2}[./-]\d{1,2}(?:[./-]\d{2,4})?)"
)
OBJECTLESS_COMPLETION = rf"(?i)^{COMPLETION_SUBJECT}(?:complete|finish)(?:\s+(?:it|this|them))?\s*(?:{COMPLETION_TIME})?[.!?]?$"
EXPLAINING_START = r"(?i)^(?:this|that|it|these|those)\s+(?:is|are|was|were|means?|follows?|relates?|refers?|concerns?|covers?)\b"
UNRELATED = r"(?i)\b(?:separate|unrelated|independent|different|not\s+related)\b"
# Sources that describe no live work: patterns that must all hold, each with where it is looked for
ARTIFACTS = [
    [
        ("body", r"(?i)\b(?:agreement for work finding services|recruitment services agreement)\b"),
        ("body", r"(?i)\b(?:hirer|work opportunit(?:y|ies)|candidate suitability|introduce you to)\b"),
    ],
    [
        ("header", r"(?i)^(?:how (?:to\b|.+\bcan\b)|planning and reasoning\b|(?:a |the )?(?:guide|introduction) to\b|what (?:is|are)\b|why\b)"),
        ("body", r"(?i)\b(?:for example|consider an?|best predictor|look for|avoid (?:vendors?|providers?)|may trigger|can (?:help|support)|tell (?:an? )?(?:assistant|ai|gemini|chatgpt|claude)|tips?\b)\b"),
    ],
    [("header", r"(?i)\bpre-contract documentation\b"), ("header", r"(?i)\bsuccessful application\b")],
    [("header", r"(?i)\bcodelabs?\b"), ("header", r"(?i)\bmcq assessment\b")],
    [("header", r"(?i)\bhomework\b"), *[("body", p) for p in NON_LIVE_PAIRS[0]]],
    [
        ("header", r"(?i)\b(?:your receipt|receipt from)\b"),
        ("body", r"(?i)\b(?:invoice number|date of issue|bill to)\b"),
        ("body", r"(?i)\b(?:amount due|date due|subtotal|payment address|vat)\b"),
    ],
    [
        ("header", r"(?i)\b(?:academy|codelabs?|certificate|complete milestones?|hackathon|mcq assessment|team formation)\b"),
        ("body", r"(?i)\b(?:codelabs?|mcq assessment)\b"),
        ("body", r"(?i)\b(?:academy|certificate|hackathon|program progression)\b"),
    ],
    [
        ("header", r"(?i)^vol\.\s*\d+\b"),
        ("body", r"(?i)\b(?:advertising channel|come into the community|newsletter|subscribe)\b"),
        ("body", r"(?i)(?:#[a-z][a-z0-9]+|\bprimary source for this issue\b|\bsources\b)"),
    ],
]
FILED_UNDER = r"(?i)\b(?:attachment|file(?:name)?|invoice(?: number)?|receipt)\b[^.!?\n]{0,60}$"
INDEPENDENT_START = r"(?i)^(?:[-*]\s*)?(?:separately|independently|on a separate note|separate action)\b"
WITHOUT_ISSUE = r"(?i)\b(?:no|without|missing|lacks?)\b[^?]{0,60}\b(?:issue|ticket|track(?:ed|ing)?)\b"
# ------------------------------------------------------------ end fixed values
