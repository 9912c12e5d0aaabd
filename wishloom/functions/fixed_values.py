"""Fixed values.

Word lists, thresholds, messages and formats that results depend on. They are
data, not logic: change them and the outputs change with them.
"""

# --- fixed values: language profiles -------------------------------------
STOPWORDS = {
    "en": ["the", "and", "to", "for", "with", "from", "of", "in", "on", "at", "this", "that",
           "trip", "holiday", "travel", "looking", "need", "want", "around", "family", "book"],
    "nl": ["de", "het", "een", "naar", "vanaf", "vakantie", "op", "voor", "nachten", "dagen",
           "flexibiliteit", "ik", "zoek", "met", "uit"],
    "fr": ["je", "cherche", "des", "vacances", "pour", "avec", "jours", "nuits", "départ",
           "vers", "flexibilité", "les", "au", "de"],
}
ASCII_RATIO_FOR_ENGLISH = 0.6

# --- fixed values: negation ----------------------------------------------
NEGATION_ALTERNATIVES = {"catering": "room only"}

# --- fixed values: preference scoring ------------------------------------
RULES_THRESHOLD = 0.6
NEGATION_PENALTY = 0.25
SEMANTIC_THRESHOLD = 0.35
SEMANTIC_TOP_K = 5

# --- fixed values: embedding quality gates -------------------------------
PURITY_MIN_SCORE = 0.38
PURITY_MARGIN = 0.10

# --- fixed values: search configuration ----------------------------------
DEFAULT_PARTY = {"adults": 2, "nonAdults": 0}
PARTY_LIMITS = {"minAdults": 1, "maxAdults": 9, "maxNonAdults": 8}
AIRPORT_SELECTION = {"multi": True, "max": 10}
DESTINATION_SELECTION = {"multi": True, "max": 100}
DURATIONS = [
    ("2007", "7 nights"), ("2002", "2 nights"), ("2010", "10 nights"), ("2011", "11 nights"),
    ("2012", "12 nights"), ("2013", "13 nights"), ("2014", "14 nights"),
    ("2099", "More than 14 nights"), ("2003", "3 nights"), ("2004", "4 nights"),
    ("2005", "5 nights"), ("2006", "6 nights"), ("2008", "8 nights"), ("2009", "9 nights"),
]
DEFAULT_DURATION_ID = "2007"
DURATION_ALIASES_EN = [("a week", "7 nights"), ("one week", "7 nights")]
FLEXIBILITY = [("3", "+- 3 days"), ("0", "Not flexible"), ("7", "+- 7 days"), ("14", "+- 14 days")]
DEFAULT_FLEX_ID = "3"
FLEXIBILITY_ALLOWED = True
ROOMS = {"auto": True, "default": 1, "max": 9}
REQUIRED_COMBINATIONS = [["from", "departureDate"], ["to", "departureDate"]]

# --- fixed values: replay thresholds -------------------------------------
LATENCY_BUCKETS = [(0, 100), (100, 250), (250, 500), (500, 1000), (1000, 2000), (2000, 5000),
                   (5000, None)]
PERCENTILES = [("p50", 0.50), ("p90", 0.90), ("p95", 0.95), ("p99", 0.99)]
OUTLIER_MS = 10000.0
P95_TARGET_MS = 750.0
ACCURACY_TARGET = 0.85
ALPHA = 0.05
MIN_SAMPLE = 1000
PROCESSING_BUDGET_MS = 1000.0
SUCCESS_STATUSES = ["success", "ok", "passed"]
METHOD_KEYS = ["method", "methodId", "method_id", "methodUsed"]
TOTAL_MS_KEYS = ["totalMs", "pipelineTotalMs", "total", "totalMilliseconds"]
USAGE_METRICS = ["tokensIn", "tokensOut", "apiCalls", "cpuMs", "ramMbSeconds"]
USAGE_CONTAINER_MARKERS = ["usage", "metric", "footprint", "resource", "component", "summary",
                           "total", "aggregate"]

# --- fixed values: message classification --------------------------------
FIELD_PATTERNS = [
    (r"departure\s+date", "departureDate"), (r"departure(?!\s+date)", "from"),
    (r"airport", "from"), (r"destination", "to"), (r"arrival", "to"),
    (r"duration", "durationId"), (r"night", "durationId"), (r"room", "rooms"),
    (r"adult", "party"), (r"child", "party"), (r"infant", "party"), (r"flex", "flexibility"),
]
MISSING_KEYWORDS = ["require", "missing", "must include", "need"]
INVALID_KEYWORDS = ["unavailable", "not allowed", "not supported", "too many", "exceed",
                    "cannot", "not available"]
CLARIFICATION_RULES = [
    ("departureDate", "I still need your departure date. When would you like to depart?",
     ["departure date is required", "include departure date"]),
    ("departureDate", "That departure date is unavailable. Could you pick another travel date?",
     ["departure date", "is not available"]),
    ("from", "Please choose a single departure airport so I can continue.",
     ["multiple departure airports", "departure airport"]),
    ("from", "That departure airport isn't available. Could you select a different one?",
     ["airport", "unavailable"]),
    ("to", "That destination isn't available. Please pick another holiday destination.",
     ["destination", "unavailable"]),
    ("to", "Please pick just one destination so I know where you'd like to travel.",
     ["multiple destinations", "too many destinations"]),
    ("durationId", "How many nights would you like to stay?", ["duration is not supported"]),
    ("party", "Can you confirm how many adults and children are travelling?",
     ["adult", "children", "infant"]),
    ("rooms", "How many rooms should I book for your stay?", ["number of rooms", "rooms must be"]),
]
GENERAL_PROMPT = ("general",
                  "Could you clarify the missing details so I can finish the search?")
VALIDATION_MESSAGES = {
    "many_airports": "Multiple departure airports are not allowed",
    "max_airports": "Too many departure airports selected",
    "many_destinations": "Multiple destinations are not allowed",
    "max_destinations": "Too many destinations selected",
    "date_required": "Departure date is required",
    "duration": "Duration is not supported",
    "destination_required": "Destination is required",
    "min_adults": "At least one adult is required",
    "max_adults": "Too many adults requested",
    "max_non_adults": "Too many children/infants requested",
    "unaccompanied": "Children cannot travel without an adult",
    "rooms_required": "Number of rooms must be provided",
    "rooms_min": "At least one room must be requested",
    "rooms_max": "Requested number of rooms exceeds the limit",
    "combination": "Utterance must include departure date with departure or destination",
}

# --- fixed values: lexicon building --------------------------------------
CODE_FILTER_IDS = ["DEPARTUREAIRPORTS", "CARRIER"]
CODE_WHITELIST = ["AI", "HB", "BB", "RO"]
COMBINATION_WEIGHTS = {2: 0.5, 3: 0.3, 4: 0.2}

# --- fixed values: log and export headers --------------------------------
AUDIT_LOG_HEADER = [
    "Timestamp (UTC)", "User input", "Request type", "Method", "Interaction Mode",
    "Pipeline Status", "Language Detection", "Processing Time", "Language Detection",
    "Extraction", "Mapping", "Validation", "Transcription", "Network Latency", "Output",
]
SUMMARY_LOG_HEADER = [
    "Timestamp (UTC)", "Mode", "Status", "Requests", "Succeeded", "Failed", "Errored",
    "Job Duration (ms)", "Processing Duration (ms)", "Latency p50 (ms)", "Latency p95 (ms)",
    "Peak CPU (%)", "Peak Memory (MB)", "Throttle Count", "Guardrail Breaches", "Started At",
    "Finished At",
]
PAYLOAD_LABELS = [
    ("language", "Language"), ("from", "From"), ("to", "To"),
    ("departureDate", "Departure date range"), ("durationId", "Duration"),
    ("party", "Participants"), ("rooms", "Rooms"),
]

# --- fixed values: columns of datasets, timing names, usage containers ----
SCORED_COLUMNS = [
    "Utterance", "filterId", "filterName", "optionId", "optionName", "target_similarity",
    "top_option_id", "top_option_name", "top_similarity", "best_non_target_similarity",
    "similarity_gap", "target_rank", "is_target_top_match",
]
SAMPLED_COLUMNS = ["Utterance", "filterId", "filterName", "optionId", "optionName"]
AUDIT_TIMINGS = {
    "language": ["languageMs", "languageDetectionMs", "language"],
    "total": ["totalTimingMs", "totalMs", "total", "totalMilliseconds"],
    "extraction": ["extractionMs", "extraction"],
    "mapping": ["normalizationMs", "normalisationMs", "mappingMs", "mapping"],
    "validation": ["validationMs", "validation"],
    "transcription": ["sttMs", "transcriptionMs", "voiceMs"],
    "network": ["networkLatencyMs", "llmNetworkMs", "networkMs", "network"],
}
USAGE_CONTAINERS = ["usage", "usageMetadata", "usageFootprint", "metrics", "resources"]
USAGE_COMPONENT_HOLDERS = ["usage", "usageFootprint", "metrics", "pipeline", "resources", "details"]

# --- fixed values: headers of the files that are read -----------------------
CATALOGUE_COLUMNS = ["filterId", "filterLabel", "optionId", "optionLabel"]
CATALOGUE_ALIASES = {"filterName": "filterLabel", "optionName": "optionLabel"}
LEXICON_COLUMNS = ["filterId", "filterName", "optionId", "optionName", "synonyms"]
UTTERANCE_COLUMNS = ["Utterance", "filterId", "filterName", "optionId", "optionName"]
SYNONYM_INPUT_COLUMNS = ["ID", "filterName", "filterId", "optionId", "optionName"]
REPLAY_COLUMNS = ["User input", "Expected values"]
