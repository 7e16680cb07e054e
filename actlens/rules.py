"""Fixed dictionaries.

FIXED VALUES: the entries below must equal the reference's published
behaviour for results to match (label names, keyword sets, lookup tables).
They are stated plainly, in the reference's natural order.  Where "first
match wins", list order is the rank.
"""

from __future__ import annotations

SOURCES = ["PARLIAMENT", "LEGISLATION", "GAZETTE", "BEEHIVE"]

# --- FIXED VALUES: predefined labels --------------------------------------
LABELS = [
    "Housing",
    "Health",
    "Education",
    "Infrastructure",
    "Environment",
    "Economy",
    "Justice",
    "Immigration",
    "Defence",
    "Transport",
    "Social Welfare",
    "Tax",
    "Local Government",
    "Treaty of Waitangi",
    "Agriculture",
]

# --- FIXED VALUES: keyword sets per label (whole-word, case-insensitive) --
LABEL_KEYWORDS = {
    "Housing": [
        "housing", "homes", "residential", "property", "rent", "rental",
        "accommodation", "tenancy", "landlord", "tenant", "mortgage",
        "affordable housing", "social housing", "public housing",
        "kainga ora", "kāinga ora", "building consent", "construction",
        "development", "urban planning", "zoning", "density",
    ],
    "Health": [
        "health", "healthcare", "medical", "hospital", "clinic", "doctor",
        "nurse", "patient", "treatment", "medicine", "pharmaceutical",
        "mental health", "public health", "wellbeing", "wellness",
        "health nz", "te whatu ora", "pharmac", "covid", "pandemic",
        "disability", "aged care", "elder care",
    ],
    "Education": [
        "education", "school", "student", "teacher", "university",
        "college", "learning", "curriculum", "scholarship", "exam",
        "qualification", "training", "skill", "literacy", "numeracy",
        "early childhood", "tertiary", "vocational", "apprenticeship",
        "education funding",
    ],
    "Infrastructure": [
        "infrastructure", "road", "bridge", "tunnel", "highway",
        "motorway", "rail", "railway", "public transport", "water",
        "sewage", "electricity", "power", "broadband", "internet",
        "telecommunications", "energy", "utility", "construction",
        "development", "maintenance", "upgrade", "investment",
    ],
    "Environment": [
        "environment", "environmental", "climate", "carbon", "emissions",
        "renewable", "sustainability", "conservation", "biodiversity",
        "pollution", "waste", "recycling", "water quality", "air quality",
        "forest", "marine", "coastal", "national park", "reserve",
        "climate change", "greenhouse gas", "clean energy", "green",
        "nature", "wildlife", "ecosystem",
    ],
    "Economy": [
        "economy", "economic", "business", "industry", "commerce",
        "trade", "export", "import", "investment", "employment",
        "job", "work", "productivity", "growth", "development",
        "innovation", "technology", "digital", "manufacturing",
        "tourism", "agriculture", "fisheries", "forestry",
        "small business", "enterprise",
    ],
    "Justice": [
        "justice", "court", "judge", "law", "legal", "crime", "police",
        "prison", "corrections", "bail", "sentence", "trial", "jury",
        "solicitor", "barrister", "lawyer", "attorney", "prosecution",
        "defence", "civil", "criminal", "offence", "penalty", "fine",
        "legal aid", "family court", "youth justice",
    ],
    "Immigration": [
        "immigration", "migrant", "visa", "residence", "citizenship",
        "border", "refugee", "asylum", "deportation", "work permit",
        "student visa", "family reunion", "skilled migrant",
        "points system", "immigration nz", "customs", "passport",
    ],
    "Defence": [
        "defence", "defense", "military", "army", "navy", "air force",
        "nzdf", "security", "national security", "peacekeeping",
        "veteran", "deployment", "equipment", "training",
        "international relations", "alliance", "treaty",
    ],
    "Transport": [
        "transport", "transportation", "road", "rail", "bus", "ferry",
        "aviation", "airport", "port", "shipping", "logistics",
        "public transport", "cycling", "walking", "safety",
        "traffic", "vehicle", "driver", "license", "registration",
        "waka kotahi", "nzta",
    ],
    "Social Welfare": [
        "welfare", "benefit", "pension", "allowance", "support",
        "social development", "family", "child", "youth", "senior",
        "disability", "poverty", "hardship", "assistance", "community",
        "social service", "msd", "work and income", "winz",
        "superannuation", "accommodation supplement",
    ],
    "Tax": [
        "tax", "taxation", "gst", "income tax", "company tax",
        "ird", "inland revenue", "customs duty", "excise",
        "tax credit", "tax relief", "tax rate", "tax policy",
        "provisional tax", "fringe benefit", "working for families",
        "family boost", "rates", "levy",
    ],
    "Local Government": [
        "local government", "council", "mayor", "councillor", "rates",
        "district", "city", "regional", "local authority", "bylaw",
        "planning", "consent", "resource management", "three waters",
        "waste management", "community facility", "library", "park",
        "local road", "water supply", "wastewater",
    ],
    "Treaty of Waitangi": [
        "treaty", "waitangi", "iwi", "māori", "maori", "tangata whenua",
        "settlement", "claim", "tribunal", "partnership", "sovereignty",
        "tino rangatiratanga", "biculturalism", "te tiriti",
        "indigenous rights", "cultural heritage", "land rights",
        "co-governance", "co-management",
    ],
    "Agriculture": [
        "agriculture", "farming", "farm", "farmer", "livestock",
        "dairy", "beef", "sheep", "crop", "harvest", "rural",
        "primary sector", "food production", "meat", "milk",
        "wool", "horticulture", "fruit", "vegetable", "wine",
        "viticulture", "pastoral", "irrigation", "drought",
        "biosecurity", "animal welfare",
    ],
}

# --- FIXED VALUES: portfolio -> label (labeller rule 2) -------------------
PORTFOLIO_LABEL = [
    ("Finance", "Economy"),
    ("Housing", "Housing"),
    ("Health", "Health"),
    ("Education", "Education"),
    ("Transport", "Transport"),
    ("Justice", "Justice"),
    ("Environment", "Environment"),
    ("Defence", "Defence"),
    ("Immigration", "Immigration"),
    ("Internal Affairs", "Local Government"),
    ("Social Development", "Social Welfare"),
    ("Agriculture", "Agriculture"),
    ("Prime Minister", "Economy"),
]

# --- FIXED VALUES: validator tables ---------------------------------------
SOURCE_ALIASES = [
    ("parliament", "PARLIAMENT"),
    ("legislation", "LEGISLATION"),
    ("gazette", "GAZETTE"),
    ("beehive", "BEEHIVE"),
    ("bills", "PARLIAMENT"),
    ("acts", "LEGISLATION"),
    ("notices", "GAZETTE"),
    ("announcements", "BEEHIVE"),
    ("press releases", "BEEHIVE"),
]

# URL substring -> source, in test order; default BEEHIVE.
URL_SOURCE = [
    ("bills.parliament.nz", "PARLIAMENT"),
    ("parliament.nz", "PARLIAMENT"),
    ("legislation.govt.nz", "LEGISLATION"),
    ("gazette.govt.nz", "GAZETTE"),
    ("beehive.govt.nz", "BEEHIVE"),
]

ID_PREFIX = [
    ("PARLIAMENT", "parl"),
    ("LEGISLATION", "leg"),
    ("GAZETTE", "gaz"),
    ("BEEHIVE", "bee"),
]

PORTFOLIO_MINISTER = [
    ("Prime Minister", "Rt Hon Christopher Luxon"),
    ("Finance", "Hon Nicola Willis"),
    ("Housing", "Hon Chris Bishop"),
    ("Health", "Hon Dr Shane Reti"),
    ("Education", "Hon Erica Stanford"),
    ("Transport", "Hon Simeon Brown"),
    ("Justice", "Hon Mark Mitchell"),
]

SOURCE_ENTITY = [
    ("PARLIAMENT", "Parliament"),
    ("LEGISLATION", "Parliament"),
    ("GAZETTE", "Government"),
    ("BEEHIVE", "Government"),
]

# Leading title words the validator strips (case-insensitive, repeated).
TITLE_PREFIXES = ["New Zealand ", "NZ ", "Government ", "Official "]

# --- FIXED VALUES: act title keyword -> responsible person ---------------
ACT_ENTITY = [
    ("taxation", "Hon Nicola Willis"),
    ("tax", "Hon Nicola Willis"),
    ("budget", "Hon Nicola Willis"),
    ("appropriation", "Hon Nicola Willis"),
    ("education", "Hon Erica Stanford"),
    ("health", "Hon Dr Shane Reti"),
    ("housing", "Hon Chris Bishop"),
    ("building", "Hon Chris Bishop"),
    ("transport", "Hon Simeon Brown"),
    ("road", "Hon Simeon Brown"),
    ("justice", "Hon Paul Goldsmith"),
    ("crime", "Hon Mark Mitchell"),
    ("police", "Hon Mark Mitchell"),
    ("environment", "Hon Penny Simmonds"),
    ("immigration", "Hon Erica Stanford"),
    ("defence", "Hon Judith Collins"),
    ("treaty", "Hon David Seymour"),
]

# --- FIXED VALUES: notice type codes --------------------------------------
NOTICE_TYPES = [
    ("vr", "Vice Regal"),
    ("go", "General"),
    ("al", "Advertising"),
    ("dl", "Deaths and Legacies"),
    ("co", "Corporate"),
    ("la", "Land"),
]

# --- FIXED VALUES: notice portfolio keywords ------------------------------
NOTICE_PORTFOLIO = [
    ("justice", "Justice"),
    ("health", "Health"),
    ("education", "Education"),
    ("transport", "Transport"),
    ("environment", "Environment"),
    ("housing", "Housing"),
    ("economic development", "Economic Development"),
    ("internal affairs", "Internal Affairs"),
    ("social development", "Social Development"),
    ("defence", "Defence"),
    ("foreign affairs", "Foreign Affairs"),
    ("immigration", "Immigration"),
    ("agriculture", "Agriculture"),
    ("forestry", "Forestry"),
    ("fisheries", "Fisheries"),
    ("energy", "Energy"),
    ("customs", "Customs"),
    ("police", "Police"),
    ("corrections", "Corrections"),
]

# --- FIXED VALUES: notice department keywords -----------------------------
NOTICE_DEPARTMENT = [
    ("internal affairs", "Department of Internal Affairs"),
    ("justice", "Ministry of Justice"),
    ("health", "Ministry of Health"),
    ("education", "Ministry of Education"),
    ("transport", "Ministry of Transport"),
]

# --- FIXED VALUES: release portfolio keywords -----------------------------
RELEASE_PORTFOLIO = [
    ("prime minister", "Prime Minister"),
    ("deputy prime minister", "Deputy Prime Minister"),
    ("finance", "Finance"),
    ("treasury", "Finance"),
    ("health", "Health"),
    ("education", "Education"),
    ("housing", "Housing"),
    ("transport", "Transport"),
    ("justice", "Justice"),
    ("defence", "Defence"),
    ("foreign affairs", "Foreign Affairs"),
    ("trade", "Trade"),
    ("environment", "Environment"),
    ("climate", "Climate Change"),
    ("energy", "Energy"),
    ("agriculture", "Agriculture"),
    ("fisheries", "Fisheries"),
    ("forestry", "Forestry"),
    ("immigration", "Immigration"),
    ("customs", "Customs"),
    ("internal affairs", "Internal Affairs"),
    ("social development", "Social Development"),
    ("women", "Women"),
    ("māori development", "Māori Development"),
    ("pacific peoples", "Pacific Peoples"),
    ("seniors", "Seniors"),
    ("disability issues", "Disability Issues"),
    ("workplace relations", "Workplace Relations"),
    ("commerce", "Commerce and Consumer Affairs"),
    ("sport", "Sport and Recreation"),
    ("arts", "Arts, Culture and Heritage"),
    ("conservation", "Conservation"),
    ("emergency management", "Emergency Management"),
]

# --- FIXED VALUES: minister surname keys (release titles) -----------------
MINISTER_SURNAMES = [
    ("luxon", "Rt Hon Christopher Luxon"),
    ("peters", "Rt Hon Winston Peters"),
    ("seymour", "Hon David Seymour"),
    ("bishop", "Hon Chris Bishop"),
    ("willis", "Hon Nicola Willis"),
    ("mitchell", "Hon Mark Mitchell"),
    ("brown", "Hon Simeon Brown"),
    ("stanford", "Hon Erica Stanford"),
    ("reti", "Hon Dr Shane Reti"),
    ("jones", "Hon Shane Jones"),
    ("doocey", "Hon Matt Doocey"),
    ("van velden", "Hon Brooke van Velden"),
    ("costley", "Hon Andrew Costley"),
]

# --- FIXED VALUES: release document types ---------------------------------
DOCUMENT_TYPES = [
    ("release", "Press Release"),
    ("speech", "Speech"),
    ("feature", "Feature Article"),
    ("announcement", "Press Release"),
]

# --- FIXED VALUES: per-person feed term ids -------------------------------
PERSON_FEEDS = [
    ("prime_minister", 6794),
    ("finance", 6795),
    ("health", 6797),
    ("education", 6799),
    ("housing", 6820),
]

# --- FIXED VALUES: bill stage codes ----------------------------------------
STAGE_CODES = [
    ("1", "First Reading"),
    ("2", "Second Reading"),
    ("SC", "Select Committee"),
    ("COWH", "Committee of Whole House"),
    ("3", "Third Reading"),
    ("RA", "Royal Assent"),
]

DEFAULT_PARLIAMENT_NUMBER = 54
