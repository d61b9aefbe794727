"""Fixed values of the domain: enumerations, word lists, patterns and limits.

Everything here must hold exactly these values for results to be right. Regular
expressions use Java syntax; ``(?iUd)`` means case-insensitive, Unicode classes,
and ``\\n`` as the only line end.
"""

from __future__ import annotations

# --- enumerations (fixed values) -------------------------------------------

FIELDS = (
    "shipper",
    "consignee",
    "notify_party",
    "port_of_loading",
    "port_of_discharge",
    "container_count",
    "gross_weight_kg",
)
PARTY_FIELDS = ("shipper", "consignee", "notify_party")
PORT_FIELDS = ("port_of_loading", "port_of_discharge")
NUMERIC_FIELDS = ("container_count", "gross_weight_kg")
SIDES = ("SI", "BL")
ROLES = ("UNKNOWN", "SI", "BL", "OTHER")
CATEGORIES = ("BL_COMPARISON", "SI_REQUEST", "INVOICE_QUERY", "GENERAL", "SPAM")
STATUSES = ("OK", "MISMATCH", "NEEDS_REVIEW")
REVIEW_REASONS = ("wrong_doc_type", "missing_attachment", "unreadable", "missing_value")
# Most severe first.
REASON_PRIORITY = ("missing_attachment", "wrong_doc_type", "unreadable", "missing_value")
WORKFLOWS = ("PROCESSING", "AWAITING_HUMAN", "BLOCKED_EXTERNAL", "COMPLETED", "FAILED")
RUN_KINDS = ("EVAL", "DEMO")
REGISTRIES = ("participant", "synthetic_demo")
CONSENT_REQUIRED_REGISTRIES = ("participant",)
NONE_OF_THESE = "NONE_OF_THESE"

FIELD_LABELS = {
    "shipper": "shipper",
    "consignee": "consignee",
    "notify_party": "notify party",
    "port_of_loading": "port of loading",
    "port_of_discharge": "port of discharge",
    "container_count": "container count",
    "gross_weight_kg": "gross weight in kg",
}

# Private cause -> public cause of a comparison that could not be made.
PUBLIC_CAUSE = {
    "MISSING_VALUE": "MISSING_VALUE",
    "MISSING_UNIT": "UNREADABLE",
    "AMBIGUOUS_SEPARATOR": "AMBIGUOUS",
    "COMPETING_CANDIDATES": "AMBIGUOUS",
    "UNGROUNDED": "UNGROUNDED",
    "INVALID_VALUE": "INVALID_VALUE",
    "UNREADABLE_DOCUMENT": "UNREADABLE",
    "DOCUMENT_LEVEL": "DOCUMENT_LEVEL",
    "SEMANTIC_UNCERTAIN": "SEMANTIC_UNCERTAIN",
}
# Private cause -> review reason.
CAUSE_REASON = {
    "MISSING_VALUE": "missing_value",
    "MISSING_UNIT": "unreadable",
    "AMBIGUOUS_SEPARATOR": "unreadable",
    "COMPETING_CANDIDATES": "unreadable",
    "UNGROUNDED": "unreadable",
    "INVALID_VALUE": "unreadable",
    "UNREADABLE_DOCUMENT": "unreadable",
    "SEMANTIC_UNCERTAIN": "unreadable",
    "DOCUMENT_LEVEL": "missing_attachment",
}
CAUSE_EXPLANATION = {
    "MISSING_VALUE": "the document has this field but no value was supplied",
    "MISSING_UNIT": "a number was found but the document does not state its unit",
    "AMBIGUOUS_SEPARATOR": "the number uses a separator that could be a thousands or a decimal mark, "
    "and the document does not establish which",
    "COMPETING_CANDIDATES": "the document supports more than one value",
    "UNGROUNDED": "the located value could not be verified against its source",
    "INVALID_VALUE": "the located value is not a usable value for this field",
    "UNREADABLE_DOCUMENT": "the source document could not be read",
    "DOCUMENT_LEVEL": "no usable document is assigned to this side",
    "SEMANTIC_UNCERTAIN": "the value could not be interpreted with confidence",
}

# --- limits (fixed values) --------------------------------------------------

MAX_SAFE_INTEGER = 9007199254740991
MAX_SOURCE_BYTES = 25 * 1024 * 1024
MAX_PDF_PAGES = 200
MAX_SHEET_CELLS = 200_000
HEADING_LINES = 6
CONVENTION_MIN_EVIDENCE = 3
PORT_CODE_MIN_OBSERVATIONS = 3
MAX_REVIEW_FIELDS = 2
MAX_DECISIONS_PER_FIELD = 2
MAX_DECISIONS_PER_FIELD_SIDE = 1
MAX_DOCUMENT_CHOICES_PER_ROLE = 1
MAX_DOCUMENT_CHOICES_PER_RUN = 2
MAX_ATTEMPTS = 2
INVALID_LIMIT = 12
INVALID_WINDOW_MS = 60_000
DIGEST_MIN_BACKLOG = 3
DIGEST_RESEND_MS = 60_000
QUEUE_PAGE_SIZE = 10
RECENT_CASES = 8
SCORE_WEIGHTS = {"stage1": 0.30, "stage3": 0.20, "end_to_end": 0.50}

# --- white space and characters (fixed values) -------------------------------

# What Unicode-aware str.strip() removes, as a character list and as the inside
# of a regex class (with and without the line feed).
WS_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
WS = r"\t-\r\x1c-\x20\x85\xa0  -     　"
HS = r"\t\x0b-\r\x1c-\x20\x85\xa0  -     　"
QUOTE_VARIANTS = "‘’‛ʼ´′`"
CJK = r"[　-鿿豈-﫿＀-￯]+"

# --- block shapes (fixed values) ----------------------------------------------

LABEL_LINE = r"[^" + WS + r":][^:\n]{0,79}?[ \t]*:"
RULE_LINE = r"[=\-_*~]{3,}[" + HS + r"]*(?:\n|\z)"
BLANK_LINE = r"[" + HS + r"]*(?:\n|\z)"
COLUMN_LINE = r"^([^" + WS + r"](?:[^:\n]*[^" + WS + r"])?)[ \t]{3,}([^" + WS + r"].*)$"

# --- label aliases (fixed values) ---------------------------------------------

FIELD_ALIASES = {
    "shipper": (
        "shipper",
        "shipper/exporter",
        "shipper (principal or seller)",
        "shipper (principal/seller)",
        "exporter",
    ),
    "consignee": (
        "consignee",
        "consignee (non-negotiable)",
        "consignee (non negotiable)",
        "to the order of",
        "to order of",
    ),
    "notify_party": (
        "notify",
        "notify party",
        "notify party/intermediate consignee",
        "notify party / intermediate consignee",
        "intermediate consignee",
    ),
    "port_of_loading": (
        "port of loading",
        "port of loading (pol)",
        "load port",
        "loading port",
        "pol",
    ),
    "port_of_discharge": (
        "port of discharge",
        "port of discharge (pod)",
        "discharge port",
        "pod",
    ),
    "container_count": (
        "container count",
        "total containers",
        "no. of containers",
        "no of containers",
        "number of containers",
        "no. of containers or packages",
        "no of containers or packages",
        "containers or packages",
    ),
    "gross_weight_kg": (
        "gross weight",
        "gross weight (kg)",
        "gross weight (kgs)",
        "gross wt",
        "gross wt (kg)",
        "gross wt (kgs)",
        "gross weight(kgs)",
        "total gross weight",
        "total gross weight (kg)",
        "total gross weight (kgs)",
        "gross weight total",
    ),
}
NEGATIVE_LABELS = {
    "gross_weight_kg": (
        "net weight",
        "net wt",
        "nett weight",
        "tare weight",
        "weight per container",
        "unit weight",
        "invoice amount",
        "total amount",
        "seal no",
        "seal number",
        "container no",
        "container number",
    ),
    "container_count": (
        "packages",
        "no. of packages",
        "kinds of packages",
        "package count",
        "container no",
        "container number",
        "seal no",
    ),
}
AMBIGUOUS_COUNT_LABELS = (
    "no. of containers or packages",
    "no of containers or packages",
    "containers or packages",
)
TOTAL_MARKERS = ("total", "aggregate", "sum")
LABEL_KG = r"(?U)\b(?:kg|kgs|kilogram|kilograms|kilogramme|kilogrammes)\b"
LABEL_TONNES = r"(?U)\b(?:mt|mts|metric ton|metric tons|metric tonne|metric tonnes|tonne|tonnes)\b"

# --- scalar values (fixed values) ---------------------------------------------

PLACEHOLDERS = (
    "n/a", "na", "n.a.", "n/a.", "nil", "none", "-", "--", "---",
    "tba", "tbd", "tbc", "?", "n/k", "unknown",
)
PLACEHOLDER_RUN = r"^[_" + WS + r".\-–—*]+$"
SAME_AS_CONSIGNEE = (
    r"(?iUd)^\s*(?:same\s+as\s+(?:the\s+)?consignee|as\s+per\s+consignee|"
    r"consignee\s+as\s+above|same\s+as\s+above)\s*[.]?\s*$"
)
PORT_ALIASES: dict[str, str] = {}
PORT_ALTERNATIVES = r"(?U)[A-Za-z]{2,}\s*/\s*[A-Za-z]{2,}"
PORT_CODE = r"\(([A-Za-z]{5})\)"
PORT_CODE_UPPER = r"\(([A-Z]{5})\)"
# Off until the team records the decision to treat a code as mere formatting.
PORT_TABLE_APPROVED = False
COUNTRY_ALPHA2 = {
    "australia": "AU",
    "chile": "CL",
    "china": "CN",
    "guinea": "GN",
    "india": "IN",
    "indonesia": "ID",
    "israel": "IL",
    "jordan": "JO",
    "kenya": "KE",
    "lithuania": "LT",
    "malaysia": "MY",
    "myanmar": "MM",
    "nigeria": "NG",
    "pakistan": "PK",
    "peru": "PE",
    "philippines": "PH",
    "poland": "PL",
    "singapore": "SG",
    "slovenia": "SI",
    "south korea": "KR",
    "korea": "KR",
    "turkey": "TR",
    "uae": "AE",
    "united arab emirates": "AE",
    "us": "US",
    "usa": "US",
    "united states": "US",
    "vietnam": "VN",
    "viet nam": "VN",
}
PORT_CODES = {
    "apapa, nigeria": "NGAPP",
    "aqaba, jordan": "JOAQB",
    "ashdod, israel": "ILASH",
    "baltimore, us": "USBAL",
    "brisbane, australia": "AUBNE",
    "buatan, indonesia": "IDBUA",
    "busan, south korea": "KRPUS",
    "callao, peru": "PECLL",
    "conakry, guinea": "GNCKY",
    "fremantle, australia": "AUFRE",
    "gdansk, poland": "PLGDN",
    "hochiminh city, vietnam": "VNSGN",
    "houston, us": "USHOU",
    "jebel ali, uae": "AEJEA",
    "karachi, pakistan": "PKKHI",
    "klaipeda, lithuania": "LTKLJ",
    "koper, slovenia": "SIKOP",
    "long beach, us": "USLGB",
    "mersin, turkey": "TRMER",
    "mombasa, kenya": "KEMBA",
    "nantong, china": "CNNTG",
    "new york, us": "USNYC",
    "nhava sheva, india": "INNSA",
    "port klang (westport), malaysia": "MYPKG",
    "pyeongtaek, south korea": "KRPTK",
    "rugao/nantong/shanghai, china": "CNSHA",
    "savannah, us": "USSAV",
    "singapore": "SGSIN",
    "valparaiso, chile": "CLVAP",
    "yangon, myanmar": "MMRGN",
}
# Lines a port value may be read from when learning codes.
PORT_LINE = (
    r"(?imd)^(?:POL|POD|Port of Loading[^:\n]*|Port of Discharge[^:\n]*|Load Port|"
    r"Discharge Port|PORT OF \w+)[ \t]*:[ \t]*(\S.*)$"
)

NUMBER_TOKEN = r"[+-]?\d(?:[\d.,\xa0 ']*\d)?"
GROUPED_EN = (r"\d{1,3}(?:,\d{3})+\.\d+", r"\d{1,3}(?:,\d{3}){2,}(?!\d)")
GROUPED_EU = (r"\d{1,3}(?:\.\d{3})+,\d+", r"\d{1,3}(?:\.\d{3}){2,}(?!\d)")
COUNT_TERM = r"(\d{1,6})[WS]*[xX×*][WS]*(?:\d{2}[WS]*'?[WS]*[A-Za-z]{2,4}|[A-Za-z]{2,5})".replace("WS", WS)
COUNT_BARE = r"(?i)^(\d{1,6})(?:[WS]*(?:x|units?|pcs?))?$".replace("WS", WS)
CONTAINER_TYPE = (
    r"(?iU)\b(?:\d{2})\s*'?\s*(?:HC|HQ|GP|DV|RF|RH|FR|OT|TK|FCL|STD)\b"
    r"|\bFCL\b|\bTEU\b|\bFEU\b|\bCNTRS?\b|\bCONTAINERS?\b"
)
UNIT_TOKEN = r"[A-Za-z][A-Za-z." + WS + r"]*$"
KILOGRAM_UNITS = (
    "kg", "kgs", "kgm", "kilo", "kilos", "kilogram", "kilograms", "kilogramme", "kilogrammes",
)
TONNE_UNITS = (
    "mt", "mts", "tonne", "tonnes", "metricton", "metrictons", "metrictonne", "metrictonnes",
)
AMBIGUOUS_UNITS = ("t", "ton", "tons", "lb", "lbs", "pound", "pounds")

# --- document roles (fixed values) ----------------------------------------------

SI_HEADING = (
    r"(?iUd)\b(?:shipping\s+instructions?|shipment\s+instructions?|b/?l\s+instructions?|"
    r"bl\s+instruction|bill\s+of\s+lading\s+instructions?|booking\s+instructions?)\b"
)
BL_HEADING = (
    r"(?iUd)\b(?:(?:draft\s+)?bill\s+of\s+lading(?!\s+instruction)|b/?l\s+draft|"
    r"ocean\s+bill\s+of\s+lading(?!\s+instruction)|"
    r"house\s+bill\s+of\s+lading(?!\s+instruction)|sea\s+waybill)\b"
)
OTHER_HEADING = (
    r"(?iUd)\b(?:commercial\s+invoice|proforma\s+invoice|packing\s+list|"
    r"certificate\s+of\s+origin|certificate\s+of\s+analysis|insurance\s+certificate|"
    r"debit\s+note|credit\s+note|delivery\s+order)\b"
)
BL_BODY = (
    r"(?iUd)\b(?:b/?l\s*(?:no|number)|bill\s+of\s+lading\s+no|export\s+carrier|"
    r"on\s+board\s+date|freight\s+(?:prepaid|collect))\b"
)
SI_BODY = (
    r"(?iUd)\b(?:booking\s+(?:ref|reference|no)|oc\s+no|shipping\s+mark|"
    r"kinds\s+of\s+packages)\b"
)
NEGATED = r"(?iUd)\b(?:not|isn'?t|is\s+not|never)\b[^.\n]{0,30}$"
NEGATION_WORD = r"(?iU)\b(?:not|isn'?t|never)\b"
NEGATION_WINDOW = 40

# --- mail view (fixed values) -----------------------------------------------------

QUOTE_BOUNDARY = (
    r"(?imUd)^\s*(?:"
    r"-{2,}\s*original message\s*-{2,}"
    r"|from:\s.+"
    r"|on .{0,80}\bwrote:\s*$"
    r"|_{5,}\s*$"
    r"|>{1,}\s"
    r")"
)
BANNER = r"(?imUd)^\s*(?:\[?\s*(?:external|caution|warning)\b.{0,160})$"
SIGNATURE = (
    r"(?imUd)^\s*(?:best regards|kind regards|regards|thanks(?: and regards)?|sincerely|br)\s*[,.]?\s*$"
)

# --- intent rules (fixed values) ---------------------------------------------------

SPAM = (
    r"(?iUd)(?:"
    r"\bunsubscribe\b|click\s+here\s+to\s+(?:claim|win|verify)"
    r"|business\s+proposal\s+involving\s+(?:usd|eur|gbp|\$)"
    r"|reply\s+with\s+your\s+bank\s+details"
    r"|next\s+of\s+kin|transfer\s+of\s+funds\s+to\s+your\s+account"
    r"|verify\s+your\s+(?:account|password|credentials|mailbox)"
    r"|mailbox\s+has\s+exceeded\s+its\s+storage\s+limit"
    r"|to\s+avoid\s+(?:deactivation|suspension|account\s+closure)"
    r"|could\s+not\s+be\s+delivered\s+due\s+to\s+unpaid"
    r"|confirm\s+payment\s+within\s+\d+\s+hours"
    r"|you(?:'ve|\s+have)\s+won\b|congratulations[,!]?\s+you(?:'ve| have)\s+won"
    r"|limited[- ]time\s+offer|act\s+now\b|risk[- ]free\s+trial"
    r"|guaranteed\s+\d+\s*%\s+returns?|(?:bitcoin|crypto)\s+investment"
    r"|\d{2,3}\s*%\s+off\b|this\s+week\s+only|one\s+weird\s+trick"
    r"|seo\s+services|boost\s+your\s+(?:sales|ranking|revenue)"
    r")"
)
COMPARE_REQUEST = (
    r"(?iUd)\b(?:"
    r"compare\s+(?:the\s+)?(?:si|s\.i\.|shipping\s+instructions?)"
    r"|(?:check|verify|confirm|review|cross[- ]?check)\s+(?:the\s+)?(?:attached\s+)?"
    r"(?:draft\s+)?(?:b/?l|bill\s+of\s+lading)\s+(?:against|vs\.?|versus|with|to)\s+"
    r"(?:the\s+)?(?:si|shipping\s+instructions?)"
    r"|compare\s+(?:the\s+)?(?:attached\s+)?(?:documents?|si\s+and\s+(?:the\s+)?(?:draft\s+)?b/?l)"
    r"|(?:si|shipping\s+instructions?)\s+(?:and|vs\.?|versus|against)\s+"
    r"(?:the\s+)?(?:draft\s+)?(?:b/?l|bill\s+of\s+lading)"
    r"|verify\s+(?:the\s+)?(?:shipment\s+)?details\s+(?:agree|match)"
    r"|confirm\s+(?:the\s+)?(?:b/?l|bill\s+of\s+lading)\s+is\s+in\s+order"
    r")"
)
CHECK_AND_CONFIRM = (
    r"(?iUd)\b(?:check|verify|confirm)\b.{0,60}\b(?:details?|discrepanc\w+|figures?|particulars?)\b"
)
SI_REQUEST = (
    r"(?iUd)\b(?:"
    r"please\s+(?:find|see)\s+(?:the\s+|our\s+|attached\s+)*(?:new\s+|revised\s+|updated\s+)?"
    r"shipping\s+instructions?\b"
    r"|(?:new|revised|updated)\s+shipping\s+instructions?\s+(?:for|below|attached|follow)\b"
    r"|(?:issue|prepare|draw\s+up|raise|send)\s+(?:the\s+|a\s+)?(?:draft\s+)?"
    r"(?:b/?l|bill\s+of\s+lading)\s+(?:based\s+on|per|from|using)\b"
    r"|kindly\s+prepare\s+the\s+draft\b"
    r"|below\s+are\s+the\s+shipping\s+instructions?\b"
    r")"
)
DRAFT_REQUESTED = (
    r"(?iUd)\b(?:please\s+)?(?:assist\s+to\s+)?(?:send|issue|share|provide|forward)\s+"
    r"(?:me\s+|us\s+)?(?:the\s+|a\s+)?draft\s+(?:b/?l|bill\s+of\s+lading)\b"
)
INLINE_BLOCK = (
    r"(?imUd)^\s*(?:pol|port\s+of\s+loading|pod|port\s+of\s+discharge|shipper|consignee|notify)\s*:"
)
INVOICE_QUERY = (
    r"(?iUd)\b(?:"
    r"invoice\s+(?:amount|total|number|query|discrepanc\w+|question)"
    r"|(?:query|question|clarif\w+|dispute)\s+(?:on|about|regarding)\s+(?:the\s+)?invoice"
    r"|(?:freight|charge|billing|payment)\s+(?:breakdown|clarification|query|discrepanc\w+)"
    r"|overcharg\w+|double[- ]?bill\w*|remittance\s+advice"
    r"|why\s+(?:were|was|are|is)\s+(?:we|i)\s+(?:charged|billed)"
    r"|\bd\s*&\s*d\b|detention\s+charges?|demurrage"
    r"|confirm\s+the\s+amount\s+before\s+(?:we\s+)?release\s+payment"
    r"|(?:missing|outstanding)\s+gr\b.{0,60}\binvoice\b"
    r"|\binvoice\b.{0,60}(?:missing|outstanding)\s+gr\b"
    r"|proceed\s+with\s+billing|arrange\s+to\s+post\s+the\s+gr"
    r")"
)
GENERAL_OPERATIONAL = (
    r"(?iUd)(?:"
    r"berthing\s+report|update\s+summary|outstanding\s+(?:bl|list|items)"
    r"|list\s+of\s+outstanding\b|pending\s+items\b"
    r"|this\s+is\s+an\s+automated\s+notification|no\s+action\s+required"
    r"|has\s+completed\s+successfully"
    r"|\breminder\s*:|kindly\s+(?:action|note)\b"
    r"|office\s+(?:resumes|will\s+be\s+closed)|happy\s+and\s+prosperous"
    r"|public\s+holiday|out\s+of\s+office"
    r"|(?:vessel|schedule)\s+(?:update|change|delay|omission)"
    r")"
)
BL_MENTION = r"(?iU)\b(?:b/?l|bill\s+of\s+lading)\b"
SI_MENTION = r"(?iU)\b(?:s\.?i\.?|shipping\s+instructions?)\b"

RULES = {
    "R-SPAM-1": ("SPAM", "unsolicited or credential-harvesting content"),
    "R-CMP-1": ("BL_COMPARISON", "the message asks for the draft BL to be checked against the SI"),
    "R-CMP-2": (
        "BL_COMPARISON",
        "both documents are named and the message asks for the details to be checked",
    ),
    "R-SI-1": ("SI_REQUEST", "the message supplies or requests shipping instructions for a new draft"),
    "R-SI-2": ("SI_REQUEST", "the message carries an inline shipment block for a new instruction"),
    "R-SI-3": (
        "SI_REQUEST",
        "the message asks for a draft BL to be produced; no draft is supplied to compare",
    ),
    "R-INV-1": ("INVOICE_QUERY", "the message raises a billing or invoice question"),
    "R-GEN-1": ("GENERAL", "an operational update or report with no comparison task requested"),
    "R-GEN-DEFAULT": (
        "GENERAL",
        "no explicit comparison, instruction, or billing request was found",
    ),
}

# --- relevance of incoming mail (fixed values) -----------------------------------------

SHIPPING_KEYWORDS = (
    r"(?iUd)\b(?:"
    r"bill\s+of\s+lading|b/?l\b|shipping\s+instructions?|s/?i\b|draft\s+b/?l|final\s+b/?l"
    r"|seaway\s+bill|air\s*waybill|awb\b|booking\s*(?:confirmation|advice|no|ref|number)"
    r"|ocean\s+freight|freight|vessel|voyage|feeder|container|fcl|lcl|teu|feu"
    r"|twenty[- ]foot|forty[- ]foot|40\s*h[cq]|20\s*gp|gross\s+weight|tare\s+weight|cbm\b|measurement"
    r"|port\s+of\s+loading|port\s+of\s+discharge|pol\b|pod\b|place\s+of\s+delivery|place\s+of\s+receipt"
    r"|shipper|consignee|notify\s+party|consignor|carrier|forwarder|freight\s+forwarder"
    r"|packing\s+list|commercial\s+invoice|customs\s+(?:clearance|declaration|entry|manifest)"
    r"|cargo\s+manifest|demurrage|detention|discrepanc\w+|seal\s+no|container\s+no"
    r"|hs\s*code|commodity|shipping\s+order|mate['’]?s\s+receipt|cargo\s+release"
    r"|maersk|msc|cma\s*cgm|cosco|hapag[- ]lloyd|ocean\s+network\s+express|\bone\s+line\b|evergreen"
    r"|yang\s+ming|oocl|zim|wan\s+hai|pil|hmt"
    r")"
)
ATTACHMENT_HINTS = (
    r"(?iUd)(?:"
    r"\b(?:si|bl|b_l|b-l|draft|bill|lading|instruction|shipping|invoice|packing|manifest|booking|vessel"
    r"|freight|cargo|container|customs)\b"
    r"|shipping[-_ ]instruction"
    r"|bill[-_ ]of[-_ ]lading"
    r"|draft[-_ ]bl"
    r")"
)
IRRELEVANT_SENDERS = (
    r"(?iU)(?:"
    r"noreply|no-reply|notifications?@|alerts?@|newsletter@|marketing@|promotions?@"
    r"|google\.com|apple\.com|amazon\.|netflix\.com|spotify\.com|linkedin\.com"
    r"|facebookmail\.com|twitter\.com|x\.com|github\.com|uber\.com|paypal\.com"
    r"|grab\.com|foodpanda|doordash|stripe\.com|slack\.com|atlassian\.com"
    r")"
)
IRRELEVANT_SUBJECTS = (
    r"(?iU)(?:"
    r"security\s+alert|password\s+reset|verify\s+your\s+email|verification\s+code"
    r"|two-factor|2fa|login\s+attempt|sign-in|new\s+login"
    r"|your\s+order\s+(?:has\s+been|is\s+confirmed|receipt)|receipt\s+for\s+your"
    r"|subscription\s+(?:confirmed|renewed|cancelled)|statement\s+ready"
    r"|welcome\s+to\b|friend\s+request|invitation\s+to\s+connect"
    r"|weekly\s+digest|newsletter|daily\s+summary"
    r")"
)
DOCUMENT_SUFFIX = r"(?i)\.(?:pdf|docx|xlsx|txt|csv)$"
SHIPMENT_WORDS = r"(?iU)\b(?:shipment|cargo|goods|docs|check\s+docs|attached\s+docs)\b"

# --- sources (fixed values) ----------------------------------------------------------------

MEDIA_TYPES = {
    ".txt": "text/plain",
    ".pdf": "application/pdf",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
}
OCTET_STREAM = "application/octet-stream"
EMAIL_ID = r"^[A-Za-z0-9_.-]{1,128}$"
ISO_UTC = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?Z$"
CLEARABLE_CASE = r"^(?:(?:case_)?email_(?:gmail|custom)_|test_email_)"
