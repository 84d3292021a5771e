"""Word lists, lookup tables, rates and limits that results must match."""

# --- Fixed values: clock, calendar and route limits -------------------------------------------
DAY_MINUTES = 1440
WEEKDAYS = ["MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN"]
WEEKDAY_SHORT = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
MONTH_SHORT = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
EARTH_KM = 6371.0
PREFS = ["confirmed", "cheapest", "fastest"]
PLACE_MAX_CHARS = 120
ROUTE_JSON_MAX_CHARS = 64_000
ROUTE_ID_MAX_CHARS = 200

# --- Fixed values: search limits ---------------------------------------------------------------
HUB_MIN_TRAINS = 80
TOP_HUBS = 40
MIN_BUFFER = 30
MAX_BUFFER = 90
MAX_WAIT = 360
DETOUR_GUARD_KM = 150.0
HEADS_NEAR = 6
HEADS_HUBS = 6
HEAD_HUB_MIN_TRAINS = 60
HEAD_HUB_KM = 500.0
ORIGIN_LADDER_KM = [200.0, 400.0, 600.0]
DEST_LADDER_KM = [60.0, 150.0]
TOP_JOURNEYS = 8
RAIL_FACTOR = 1.25
RAIL_KMPH = 50.0

# --- Fixed values: road access -----------------------------------------------------------------
ROAD_FACTOR = 1.3
ROAD_KMPH = 40.0
ROAD_FARE_PER_KM = 3.0
ROAD_FARE_MIN = 20
ROAD_ONLY_MAX_KM = 500.0
ROAD_RELIABILITY = 68

# --- Fixed values: coach classes and fares -----------------------------------------------------
CLASS_ORDER = ["2S", "SL", "CC", "3A", "2A", "1A"]
CLASS_LABEL = {
    "SL": "Sleeper", "3A": "AC 3-tier", "2A": "AC 2-tier", "1A": "AC First",
    "CC": "Chair Car", "2S": "Second sitting",
}
CLASS_RATE = {"SL": 0.58, "3A": 1.48, "2A": 2.10, "1A": 3.57, "CC": 1.58, "2S": 0.45}
CLASS_RESERVATION = {"2S": 15, "SL": 20, "3A": 40, "CC": 40, "2A": 50, "1A": 60}
CLASS_SUPERFAST = {"2S": 15, "SL": 30, "3A": 45, "CC": 45, "2A": 45, "1A": 75}
CLASS_EASE = {"2S": 84, "SL": 74, "CC": 72, "3A": 66, "2A": 58, "1A": 54}
AC_CLASSES = ["1A", "2A", "3A", "3E", "CC", "EC", "EA", "EV"]
SITTING_CLASSES = ["CC", "EC", "2S", "EA", "EV"]
SLEEPER_AC_CLASSES = ["1A", "2A", "3A", "3E", "EA"]
AC_TAX = 0.05
CLASSES_BY_TYPE = {
    "RAJ": "1A,2A,3A", "SHT": "CC,EC", "T18": "CC,EC", "GRB": "3A",
    "PRM": "SL,3A,2A", "SF": "2S,SL,3A,2A", "EXP": "2S,SL,3A,2A", "PASS": "2S",
}
CLASSES_DEFAULT = "SL,3A,2A"

# --- Fixed values: train tiers, delays, demand -------------------------------------------------
PREMIUM_WORDS = [
    "RAJDHANI", "SHATABDI", "VANDE BHARAT", "VANDE", "DURONTO", "TEJAS", "GATIMAAN",
    "HUMSAFAR", "GARIB RATH",
]
SUPERFAST_PREFIXES = ["12", "22", "20", "02"]
TIER_RANK = {"premium": 3, "superfast": 2, "express": 1, "passenger": 0}
TIER_CODE = {"premium": 0, "superfast": 1, "express": 2, "passenger": 3}
TIER_BASE_DELAY = {"premium": 10, "superfast": 22, "express": 33, "passenger": 48}
TIER_DEMAND = {"premium": -12, "superfast": -4, "express": 0, "passenger": 8}
ON_TIME_MINUTES = 30
MIN_OBSERVATIONS = 15
PEAK_MONTHS = [5, 6, 10, 11, 12]
QUANTILE_LEVELS = [0.1, 0.25, 0.5, 0.75, 0.9, 0.99]
MODEL_STALE_DAYS = 180
MODEL_MAX_DAY_OFFSET = 1

# --- Fixed values: place spellings -------------------------------------------------------------
PLACE_ALIASES = {
    "kanyakumari": "kanniyakumari", "kanya kumari": "kanniyakumari",
    "banaras": "varanasi", "benares": "varanasi", "calcutta": "kolkata",
    "bombay": "mumbai", "madras": "chennai", "bangalore": "bengaluru",
    "pondicherry": "puducherry", "trivandrum": "thiruvananthapuram",
    "cochin": "kochi", "gauhati": "guwahati", "poona": "pune",
}

# --- Fixed values: admin code to state ---------------------------------------------------------
STATE_BY_ADMIN = {
    "01": "Andaman and Nicobar", "02": "Andhra Pradesh", "03": "Assam",
    "05": "Chandigarh", "07": "Delhi", "09": "Gujarat", "10": "Haryana",
    "11": "Himachal Pradesh", "12": "Jammu and Kashmir", "13": "Kerala",
    "14": "Lakshadweep", "16": "Maharashtra", "17": "Manipur",
    "18": "Meghalaya", "19": "Karnataka", "20": "Nagaland", "21": "Odisha",
    "22": "Puducherry", "23": "Punjab", "24": "Rajasthan", "25": "Tamil Nadu",
    "26": "Tripura", "28": "West Bengal", "29": "Sikkim",
    "30": "Arunachal Pradesh", "31": "Mizoram", "33": "Goa", "34": "Bihar",
    "35": "Madhya Pradesh", "36": "Uttar Pradesh", "37": "Chhattisgarh",
    "38": "Jharkhand", "39": "Uttarakhand", "40": "Telangana", "41": "Ladakh",
    "52": "Dadra and Nagar Haveli and Daman and Diu",
}

# --- Fixed values: station name to code --------------------------------------------------------
STATION_ALIASES = {
    "HAZRAT NIZAMUDDIN": "NZM", "H NIZAMUDDIN": "NZM",
    "MGR CHENNAI CTR": "MAS", "MGR CHENNAI CENTRAL": "MAS", "CHENNAI CENTRAL": "MAS",
    "VIRANGANA LAKSHMIBAI": "JHS", "VIRANGANA LAKSHMIBAI JHANSHI": "JHS",
    "YASVANTPUR JN": "YPR", "YESVANTPUR JN": "YPR",
    "TIRUCHCHIRAPPALLI JN": "TPJ", "TIRUCHCHIRAPALLI": "TPJ",
    "C SHIVAJI MAHARAJ T": "CSTM", "CHHATRAPATI SHIVAJI MAHARAJ T": "CSTM",
    "MUMBAI CENTRAL": "BCT", "PT DD UPADHYAYA JN": "MGS", "PANDIT DEEN DAYAL UPADHYAYA JN": "MGS",
    "RANI KAMLAPATI": "HBJ", "PRAYAGRAJ JN": "ALD", "PRAYAGRAJ": "ALD",
    "EKTA NAGAR": "KDCY", "KALABURAGI JN": "GR", "BANARAS": "BSBS",
    "SMVT BENGALURU": "BNC", "SIR M VISVESVARAYA TERMINAL": "BNC",
    "UDHNA JN": "UDN", "AYODHYA CANTT": "FD", "AYODHYA DHAM JN": "AY",
    "BHUSAWAL JN": "BSL", "NAGPUR JN": "NGP", "ITARSI JN": "ET",
    "LOKMANYATILAK": "LTT", "LOKMANYA TILAK T": "LTT",
    "ANAND VIHAR TERMINAL": "ANVT", "DEHRI ON SON": "DOS",
    "CHANDRAPUR MAHARASHTRA": "CD", "SIRPUR KAGHAZNAGAR": "SKZR",
    "HUBBALLI JN": "UBL", "HUBLI JN": "UBL",
    "THIRUVANANTHAPURAM CENTRAL": "TVC", "LONAVLA": "LNL",
    "DHARWAD": "DWR", "VRIDDHACHALAM JN": "VRI",
    "AHILYANAGAR": "ANG", "C SAMBHAJINAGAR": "AWB", "CHH SAMBHAJINAGAR": "AWB",
    "MAA BELHA DEVI DHAM PRATAPGARH JN": "PBH", "MANGALORE CENTRAL": "MAQ",
    "NAGARCOIL JN": "NCJ", "MANTHRALAYAM ROAD": "MALM",
    "GANDHIDHAM JN": "GIMB", "ANUGRAH NARAYAN ROAD": "AUBR",
    "ICHCHAPURAM": "IPM", "MELMARUVATHUR": "MLMR",
}

# --- Fixed values: renamed station codes, new to the code that carries coordinates --------------
CODE_RENAMES = {
    "PRYJ": "ALD", "PRRB": "ALY", "PYGS": "SFG", "MMCT": "BCT", "CSMT": "CSTM",
    "SMVT": "BNC", "SMVB": "BNC", "VGLJ": "JHS", "VGLB": "JHS", "DDU": "MGS",
}

# --- Fixed values: demand calendar (date, name, kind) -------------------------------------------
DEMAND_CALENDAR = [
    ("2025-01-14", "Makar Sankranti / Pongal", "festival"),
    ("2025-01-26", "Republic Day", "holiday"),
    ("2025-03-13", "Holi", "festival"),
    ("2025-03-14", "Holi", "festival"),
    ("2025-03-31", "Eid al-Fitr", "festival"),
    ("2025-04-06", "Ram Navami", "festival"),
    ("2025-06-07", "Bakrid (Eid al-Adha)", "festival"),
    ("2025-08-09", "Raksha Bandhan", "festival"),
    ("2025-08-15", "Independence Day", "holiday"),
    ("2025-08-16", "Janmashtami", "festival"),
    ("2025-08-27", "Ganesh Chaturthi", "festival"),
    ("2025-10-02", "Gandhi Jayanti / Dussehra", "festival"),
    ("2025-10-20", "Diwali", "festival"),
    ("2025-10-21", "Diwali", "festival"),
    ("2025-10-22", "Diwali (Govardhan)", "festival"),
    ("2025-10-27", "Chhath Puja", "festival"),
    ("2025-10-28", "Chhath Puja", "festival"),
    ("2025-11-05", "Guru Nanak Jayanti", "festival"),
    ("2025-12-25", "Christmas", "holiday"),
    ("2025-12-31", "New Year's Eve", "festival"),
    ("2026-01-01", "New Year's Day", "holiday"),
    ("2026-01-14", "Makar Sankranti / Pongal", "festival"),
    ("2026-01-26", "Republic Day", "holiday"),
    ("2026-03-03", "Holi", "festival"),
    ("2026-03-04", "Holi", "festival"),
    ("2026-03-21", "Eid al-Fitr", "festival"),
    ("2026-03-26", "Ram Navami", "festival"),
    ("2026-05-27", "Bakrid (Eid al-Adha)", "festival"),
    ("2026-08-15", "Independence Day", "holiday"),
    ("2026-08-28", "Raksha Bandhan", "festival"),
    ("2026-09-04", "Janmashtami", "festival"),
    ("2026-09-14", "Ganesh Chaturthi", "festival"),
    ("2026-10-02", "Gandhi Jayanti", "holiday"),
    ("2026-10-20", "Dussehra", "festival"),
    ("2026-11-08", "Diwali", "festival"),
    ("2026-11-09", "Diwali", "festival"),
    ("2026-11-10", "Diwali (Govardhan)", "festival"),
    ("2026-11-15", "Chhath Puja", "festival"),
    ("2026-11-16", "Chhath Puja", "festival"),
    ("2026-11-24", "Guru Nanak Jayanti", "festival"),
    ("2026-12-25", "Christmas", "holiday"),
    ("2026-12-31", "New Year's Eve", "festival"),
]

# --- Fixed values: departure windows (key, first hour, hour after the last; the last wraps) ------
DEPARTURE_WINDOWS = [
    ("early-morning", 4, 10), ("afternoon", 10, 17), ("evening", 17, 22), ("late-night", 22, 4),
]

# --- Fixed values: corridors with a known fastest time in hours ----------------------------------
CORRIDOR_HOURS = [
    ("Delhi", "Mumbai", 15.5), ("Delhi", "Kolkata", 17.0), ("Delhi", "Madgaon", 24.5),
    ("Mumbai", "Madgaon", 8.0), ("Delhi", "Jaipur", 4.5), ("Delhi", "Bengaluru", 34.0),
    ("Chennai", "Bengaluru", 4.7), ("Kolkata", "Puri", 7.5), ("Rourkela", "Ranchi", 4.5),
    ("Lucknow", "Delhi", 6.5),
]

# --- Fixed values: texts and scores of the demand advice ------------------------------------------
ADVICE_MODERATE, ADVICE_HIGH = 35, 60
ADVICE_HIGH_NOTE = (
    "Premium (flexi-fare) trains like Rajdhani/Shatabdi run pricier, and "
    "sleeper/cheaper classes sell out first — book early or expect AC-only."
)
ADVICE_MODERATE_NOTE = "Slightly busier travel day — cheaper classes may fill up faster than usual."
ADVICE_DEFAULT_LABEL = "Peak travel dates"

# --- Fixed values: base risk by month, all other months, weekend and spike additions, limits ------
SEASON_BASE = {7: 60, 8: 60, 6: 42, 9: 42, 5: 28, 10: 28}
SEASON_OTHER, SEASON_WEEKEND, SEASON_SPIKE = 16, 14, 22
SEASON_LIMITS = (4, 96)

# --- Fixed values: the warning of journeys over several days --------------------------------------
MULTI_DAY_WARNING = "Multi-day journey — harder to predict, build in extra buffer."
