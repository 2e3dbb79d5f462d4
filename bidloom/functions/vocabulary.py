"""Fixed values of the domain: names, word lists and closed sets."""

from __future__ import annotations

# Canonical document names and the other names they go by.
DOCUMENT_ALIASES: dict[str, list[str]] = {
    "gst registration certificate": [
        "gst certificate",
        "gstin certificate",
        "goods and services tax certificate",
        "goods & services tax certificate",
        "gst registration",
        "certificate of gst registration",
    ],
    "pan card": ["permanent account number", "pan", "pan copy", "income tax pan"],
    "audited balance sheet": [
        "audited financial statements",
        "audited annual accounts",
        "balance sheet and profit and loss account",
        "audited accounts",
        "annual audited statements",
    ],
    "emd demand draft": [
        "earnest money deposit",
        "emd",
        "emd proof",
        "bid security",
        "demand draft towards emd",
        "earnest money",
    ],
    "iso 9001 certificate": [
        "iso 9001:2015 certificate",
        "iso 9001:2015",
        "quality management system certificate",
        "iso certification",
    ],
    "power of attorney": ["authorisation letter", "board resolution", "authority letter"],
    "work experience certificate": [
        "experience certificate",
        "completion certificate",
        "performance certificate",
        "work order copy",
        "satisfactory completion certificate",
    ],
    "solvency certificate": ["bank solvency certificate", "banker's certificate"],
    "non blacklisting declaration": [
        "self declaration of non blacklisting",
        "affidavit of non debarment",
        "declaration regarding blacklisting",
        "undertaking of non blacklisting",
    ],
    "provident fund registration": ["epf registration", "pf registration certificate"],
    "esi registration": ["employees state insurance registration"],
    "tender fee receipt": ["cost of tender document", "tender document fee"],
    "turnover certificate": ["ca certificate for turnover", "chartered accountant certificate"],
    "incorporation certificate": [
        "certificate of incorporation",
        "registration certificate of the firm",
        "partnership deed",
        "company registration certificate",
    ],
    "labour licence": ["contract labour licence", "labour registration"],
}

# Words a document name does not need.
STOPWORDS = [
    "the", "of", "a", "an", "for", "and", "copy", "copies", "attested",
    "self", "duly", "valid", "latest", "original", "photocopy", "scanned",
]

# Spellings folded at the end of a word, in this order.
SPELLINGS = [("ization", "isation"), ("izing", "ising"), ("ized", "ised"), ("ize", "ise"), ("ce", "se")]

# Phrases that mean the same in tenders.
SYNONYMS: dict[str, str] = {
    "statutory auditor": "chartered accountant",
    "documentary evidence": "proof",
    "past performance record": "experience",
    "purchase order": "work order",
    "income tax return": "it return",
    "digital signature certificate": "dsc",
    "manufacturer authorisation form": "maf",
    "bid securing": "bid security",
    "earnest money deposit": "emd",
    "bid security deposit": "emd",
    "forwarding letter": "covering letter",
    "shareholder fund": "net worth",
    "yearly revenue": "annual turnover",
    "oem": "manufacturer",
    "nil": "no",
    "undertaking": "declaration",
    "affidavit": "declaration",
    "enrolment": "registration",
}

# Words that occur in most document names and identify none.
GENERIC = [
    "certificate", "certification", "form", "format", "document", "letter",
    "proof", "evidence", "statement", "sheet", "report", "declaration",
    "no", "nos", "number", "as", "per", "in", "on", "at", "with", "by", "to",
    "from", "its", "their", "our", "shall", "be", "is", "such", "etc",
    "required", "relevant", "submitted", "enclosed", "along", "regarding",
    "bid", "bidder", "bids", "tender", "jv", "joint", "venture", "consortium",
    "partner", "each", "any", "all", "firm", "company", "work", "works",
    "above", "said", "this", "that", "we", "us", "he", "him",
]

# Fixed value: the share of identifying words a lexical match needs, and embedding thresholds.
LEXICAL_SHARE, EMBEDDING_MATCH, EMBEDDING_REVIEW, EMBEDDING_CERTAIN = 0.8, 0.86, 0.72, 0.90

# Forms of a term that mean the same.
EQUIVALENTS: list[list[str]] = [
    ["earnest money deposit", "earnest money", "emd", "bid security"],
    ["estimated contract value", "ecv", "estimated cost put to tender"],
    ["initial security deposit", "isd"],
    ["performance guarantee", "performance bank guarantee"],
    ["bank guarantee", "bg"],
    ["bill of quantities", "boq"],
    ["notice inviting tender", "nit"],
    ["operation and maintenance", "o&m"],
    ["defect liability period", "dlp"],
    ["joint venture", "jv"],
    ["letter of intent", "loi"],
    ["memorandum of understanding", "mou"],
    ["goods and services tax", "gst"],
    ["permanent account number", "pan"],
    ["micro small and medium enterprises", "msme"],
    ["engineering procurement and construction", "epc"],
    ["pre-qualification", "prequalification", "pq"],
    ["turnover", "annual turnover", "average annual turnover"],
    ["blacklisted", "debarred", "blacklisting"],
]

# Words that send a question to a route.
AUDIT = ["why", "eliminated", "rejected", "reason", "disqualif", "exclusion", "excluded", "audit trail", "grounds", "knocked out", "went wrong", "justify", "did not qualify", "fail"]
QUALITATIVE = [
    "approach", "methodology", "scalability", "quality", "narrative", "propose", "proposal", "plan", "describe", "summaris", "summariz",
    "risks", "staffing", "safety", "phase", "explains", "explain how", "reads as", "thought through", "credible", "assurance",
]
STRUCTURED = ["turnover", "price", "quoted", "experience", "project value", "shortlisted", "pending", "status", "how many", "count", "list", "lowest", "highest", "average", "blacklisted", "threshold", "name the"]
COMPARATIVE = ["compare", "comparison", "stack up", "rank", "contrast", "versus", " vs ", "side by side", "next to each other", "differences", "better value", "against vendor"]

# When a requirement binds.
JV = ["jv", "j.v", "joint venture", "consortium", "consortia", "lead member", "member of the jv", "partner in the jv"]
CONDITIONAL = ["if applicable", "wherever applicable", "as applicable", "if any", "in case of", "if the bidder", "where applicable", "if required", "if claimed", "should the bidder"]
CONCESSION = ["msme", "mse ", "startup", "start-up", "nsic", "udyam", "exemption", "concession", "preference under"]
JV_YET_ALWAYS = r"(?i)\b(?:each|every|the)\s+bidder\b|\bbidder\s*/\s*jv\b|\bbidder\s*/"

# What shows that a requirement names no enclosure.
NOT_A_DOCUMENT = ["pass-phrase", "passphrase", "password", "user id", "login credential", "digital signature certificate class"]
CATCH_ALL = ["any other", "all other", "relevant documents", "as may be required", "as required in", "and other documents", "other relevant", "among others"]
INSTRUCTION = ["documentary evidence to prove", "evidence to prove", "produce documentary", "establishing the qualification", "to the satisfaction of", "to establish that", "in support of the claim"]
CONDITION = [
    "not less than", "at least", "minimum of", "shall not be less", "experience of having", "legal entity:", "the bidder could be",
    "should be either of", "must have", "shall have a", "shall be a ", "turnover on works", "annual turnover for", "annual turnover on",
]
DOCUMENT_NOUNS = [
    "certificate", "declaration", "letter", "form", "affidavit", "undertaking",
    "statement", "copy", "card", "deed", "receipt", "challan", "bill",
    "sheet", "report", "licence", "license", "order", "agreement",
    "resolution", "attorney", "return", "invoice", "voucher", "draft",
    "balance sheet", "profit and loss", "registration", "authorisation",
    "authorization", "annexure", "proforma", "schedule", "bond", "guarantee",
]
OPTIONS = r"(?i)\((?:i|1)\)[^)]{0,400}?\((?:ii|2)\)"

# Which fact a criterion is compared with.
TURNOVER_HINTS = ["turnover", "revenue", "annual receipt", "gross receipt"]
EXPERIENCE_HINTS = ["experience", "years in business", "operating", "established"]
PROJECT_HINTS = ["project", "work", "contract", "assignment", "order"]
LIQUIDITY_HINTS = ["liquid asset", "credit facilit", "working capital", "solvency", "line of credit", "cash flow", "bid capacity"]
NET_WORTH_HINTS = ["net worth", "networth"]
CREDENTIAL_HINTS = ["empanel", "registration", "registered", "licence", "license", "certif", "authorised", "authorized", "invited"]
NEGATIVE_HINTS = ["blacklist", "debar", "liquidation", "banned", "insolven"]
BARRED_WORDS = ["blacklist", "debar", "liquidation", "banned"]
YEAR_UNITS = ["", "year", "years", "yr", "yrs"]
COUNT_UNITS = [
    "", "project", "projects", "work", "works", "no", "nos", "number", "numbers", "order", "orders",
    "contract", "contracts", "assignment", "assignments", "job", "jobs", "count",
]
NARRATIVE = r"(?i)\b(?:technical man\s*power|key personnel|staff deployment|method statement|technical proposals?|technical approach|work methodology)\b"
FORMAL = r"(?i)\b(?:certificat\w*|licen[cs]\w*|registration|authori[sz]ation|affidavit|undertaking|test report)\b"

# Closed sets.
CHECK_STATUS = ["match", "partial", "missing", "manual_check", "not_assessable"]
SEVERITY = ["disqualifying", "action_needed", "review", "info"]
ACTION_GROUP = ["hard_fail", "upload", "clarify", "verify"]
VENDOR_STATUS = ["eliminated", "pending", "shortlisted"]

# Words of a question that BM25 leaves out.
BM25_STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "do", "does", "for", "from", "has", "have", "how", "i", "if", "in", "into", "is", "it",
    "its", "me", "must", "my", "of", "on", "or", "shall", "should", "that", "the", "this", "to", "under", "was", "what", "when",
    "which", "who", "will", "with", "would", "you", "your",
]
