"""Word lists, code tables and thresholds.

Everything in this module is data that results depend on. Every operator takes
these as arguments and only uses them as defaults.
"""

# --- fixed values: drugs the reports and reviews are filtered to, in match order
TARGET_DRUGS = [
    "ibuprofen", "naproxen", "aspirin", "diclofenac", "celecoxib", "rofecoxib",
    "amlodipine", "lisinopril", "metformin", "atorvastatin", "metoprolol",
]

# --- fixed values: stems that mark a review as mentioning an adverse event
EVENT_STEMS = [
    "side effect", "adverse", "reaction", "allerg", "nausea", "vomit", "dizziness",
    "headache", "pain", "bleeding", "rash", "swelling", "fatigue", "diarrhea",
    "constipation",
]

# --- fixed values: salt words dropped from a drug name before fuzzy matching
SALT_WORDS = [
    "hydrochloride", "hcl", "sodium", "potassium", "calcium", "sulfate", "phosphate",
    "succinate", "tartrate", "maleate", "acetate", "citrate", "fumarate", "mesylate",
    "besylate", "dihydrate", "monohydrate", "trihydrate", "magnesium", "propanediol",
    "dl-lysine", "diethylamine",
]

# --- fixed values: keyword vocabulary (generic name, concept id, keywords)
DRUG_KEYWORDS = [
    ("aspirin", "1191",
     ["aspirin", "acetylsalicylic", "asa ", "st. joseph aspirin", "bayer", "ecotrin"]),
    ("ibuprofen", "5640", ["ibuprofen", "advil", "motrin", "burana", "nurofen"]),
    ("naproxen", "7258",
     ["naproxen", "aleve", "naprosyn", "anaprox", "naproxeno", "nalgesin", "miranax"]),
    ("diclofenac", "3355",
     ["diclofenac", "voltaren", "voltadol", "voltrex", "reactin", "naboal"]),
    ("celecoxib", "140587", ["celecoxib", "celebrex", "meticel"]),
    ("rofecoxib", "54552", ["rofecoxib", "vioxx"]),
    ("amlodipine", "17767", ["amlodipine", "norvasc", "norvask", "nordex", "s-amlodipine"]),
    ("lisinopril", "29046",
     ["lisinopril", "prinivil", "zestril", "prinil", "novatec", "prinzide"]),
    ("metformin", "6809",
     ["metformin", "glucophage", "riomet", "fortamet", "metforminum", "metforming"]),
    ("atorvastatin", "83367",
     ["atorvastatin", "lipitor", "zarator", "ridlip", "novostat", "suvast", "stator",
      "teva- atorvastatin", "mint atorvastatin"]),
    ("metoprolol", "6918",
     ["metoprolol", "toprol", "lopressor", "beloc", "sandoz-metoprolol", "pms-metoprolol"]),
]

# --- fixed values: years per unit code, as (code, multiplier, divisor)
AGE_UNITS = [
    ("YR", 1.0, 1.0), ("DEC", 10.0, 1.0), ("MON", 1.0, 12.0),
    ("WK", 1.0, 52.0), ("DY", 1.0, 365.0), ("HR", 1.0, 8760.0),
]
MAX_AGE_YEARS = 150

# --- fixed values: outcome codes that make a case serious
SERIOUS_OUTCOMES = ["DE", "LT", "HO", "DS", "CA", "RI"]

# --- fixed values: markup replaced in review text, in this order
MARKUP = [
    (r"<br\s*/?>", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#039;", "'"),
    ("&lt;", "<"), ("&gt;", ">"), ("<[^>]+>", " "),
]

# --- fixed values: column names in order of preference
DATE_COLUMNS = ["fda_dt", "rept_dt", "event_dt", "receivedate"]
COUNTRY_COLUMNS = ["reporter_country", "occr_country"]
REVIEW_DRUG_COLUMNS = ["drugname", "drug_name"]
REVIEW_TEXT_COLUMNS = ["review", "review_text", "reviewtext"]
REVIEW_FILES = [
    ("drugsComTrain_raw.csv", "train"), ("drugsComTest_raw.csv", "test"),
    ("drugsComTrain_raw.tsv", "train"), ("drugsComTest_raw.tsv", "test"),
]
QUARTER_DIR_PREFIX = "faers_ascii_"
QUARTER_FILE_TYPES = ["DEMO", "DRUG", "REAC", "OUTC"]

# --- fixed values: known drug and reaction pairs, and the one that may be weak
POSITIVE_CONTROLS = [
    ("ibuprofen", "Gastrointestinal haemorrhage"),
    ("rofecoxib", "Myocardial infarction"),
    ("metformin", "Lactic acidosis"),
    ("amlodipine", "Oedema peripheral"),
    ("lisinopril", "Cough"),
]
OPTIONAL_CONTROLS = ["rofecoxib"]
COLLAPSE_DRUGS = ["atorvastatin", "metoprolol", "metformin"]
SEVERITIES = ["serious", "non-serious", "unknown"]
SIGNAL_FLAGS = ["high", "medium", "low", "noise"]

# --- fixed values: thresholds
MIN_CASES = 3
MIN_PRR = 2.0
MIN_CHI2 = 3.84
MASKING_SHARE = 0.20
HIGH_PRR = 10
MEDIUM_PRR = 5
MIN_REVIEW_WORDS = 20
MIN_CONFIDENCE = 0.75
MAX_ATTEMPTS = 3
MIN_TERM_SIMILARITY = 0.85
MIN_NAME_SCORE = 80.0
MIN_INGESTED_CASES = 1000
