"""Controlled vocabularies and rule tables. All fixed values: codes are the exact strings that records hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Vocabularies.
SERVICE_TYPES = [
    "Acute-care/general hospital beds",
    "Psychiatric inpatient beds",
    "Substance-abuse beds",
    "Skilled nursing/LTC beds",
    "Comprehensive inpatient rehabilitation beds",
    "Ambulatory surgery — single-specialty",
    "Ambulatory surgery — multi-specialty",
    "Open-heart/cardiac surgery",
    "Cardiac catheterization",
    "Megavoltage radiation therapy",
    "PET",
    "MRI",
    "CT",
    "Other diagnostic imaging",
    "Obstetrical services",
    "NICU/perinatal",
    "Organ transplant",
    "Lithotripsy",
    "Renal dialysis/ESRD",
    "Home health",
    "Hospice/palliative",
    "New/replacement hospital",
    "Freestanding ED",
    "Birthing center",
    "Major medical equipment",
    "Capital expenditure / new institutional health service (catch-all)",
]
MATTER_TYPES = ["CON Application", "Determination/Reviewability (DET)", "Administrative Appeal", "Judicial Review", "Other/Administrative"]
ACTION_TYPES = ["New service/facility", "Bed or capacity addition", "Relocation", "Replacement", "Change of ownership (CHOW)", "Cost overrun/capital amendment", "Determination request", "Other"]
DOC_TYPES = [
    "Application/Request",
    "Decision/Determination",
    "Hearing Officer Decision",
    "Final Agency Decision",
    "Order",
    "Notice",
    "Transcript",
    "Exhibit",
    "Brief/Memorandum",
    "Correspondence",
    "HFR Opinion",
    "Court Order/Opinion",
    "Settlement/Withdrawal",
    "Other",
]
PHASES = ["Initial Application", "Administrative Appeal", "Judicial Review – Superior Court", "Judicial Review – Court of Appeals", "Judicial Review – Supreme Court of GA"]
OUTCOMES = ["Approved", "Approved with conditions", "Partially approved", "Denied", "Withdrawn", "Dismissed", "Remanded", "Settled", "Affirmed (appeal)", "Reversed (appeal)", "Vacated (appeal)", "Pending", "Unknown"]
DECISION_LEVELS = {1: "Desk Decision", 2: "Hearing Officer Decision", 3: "Superior Court Decision", 4: "Appellate Court Decision", 5: "Initial Application"}
VALIDATION_STATUSES = ["Unvalidated", "Validated", "Corrected", "Rejected"]
REPORT_SECTIONS = [
    "LETTER_OF_INTENT",
    "LOI_EXPIRED",
    "NEW_APPLICATION",
    "WITHDRAWN_APPLICATION",
    "PENDING_APPLICATION",
    "APPROVED",
    "DENIED",
    "DISQUALIFIED",
    "APPEALED",
    "APPEALED_DETERMINATION",
    "LETTER_OF_DETERMINATION",
    "DET_REVIEW",
    "LNR_CONVERSION",
    "EXTENDED_IMPLEMENTATION",
    "OTHER",
]
DOCKET_FAMILIES = ["CON", "DET", "DET-EQT", "DET-ASC", "LNR-ASC", "LNR-EQT"]
EVENT_TYPES = ["Filing", "Order", "Opinion", "Hearing", "Brief", "Notice"]
COUNSEL_SIDES = ["Applicant", "Petitioner", "Respondent", "Appellant", "Appellee", "Intervenor", "Amicus", "Agency"]
TREATMENT_LEVELS = {"Followed": "positive", "Distinguished": "caution", "Criticized": "caution", "Reversed": "negative", "Overruled": "negative", "Cited": "neutral", "Neutral": "neutral"}
LEVELS = ["positive", "caution", "negative", "neutral"]

# The counties a record may name.
COUNTIES = [
    "Appling", "Atkinson", "Bacon", "Baker", "Baldwin", "Banks", "Barrow", "Bartow", "Ben Hill", "Berrien", "Bibb",
    "Bleckley", "Brantley", "Brooks", "Bryan", "Bulloch", "Burke", "Butts", "Calhoun", "Camden", "Candler",
    "Carroll", "Catoosa", "Charlton", "Chatham", "Chattahoochee", "Chattooga", "Cherokee", "Clarke", "Clay",
    "Clayton", "Clinch", "Cobb", "Coffee", "Colquitt", "Columbia", "Cook", "Coweta", "Crawford", "Crisp", "Dade",
    "Dawson", "Decatur", "DeKalb", "Dodge", "Dooly", "Dougherty", "Douglas", "Early", "Echols", "Effingham",
    "Elbert", "Emanuel", "Evans", "Fannin", "Fayette", "Floyd", "Forsyth", "Franklin", "Fulton", "Gilmer",
    "Glascock", "Glynn", "Gordon", "Grady", "Greene", "Gwinnett", "Habersham", "Hall", "Hancock", "Haralson",
    "Harris", "Hart", "Heard", "Henry", "Houston", "Irwin", "Jackson", "Jasper", "Jeff Davis", "Jefferson",
    "Jenkins", "Johnson", "Jones", "Lamar", "Lanier", "Laurens", "Lee", "Liberty", "Lincoln", "Long", "Lowndes",
    "Lumpkin", "Macon", "Madison", "Marion", "McDuffie", "McIntosh", "Meriwether", "Miller", "Mitchell", "Monroe",
    "Montgomery", "Morgan", "Murray", "Muscogee", "Newton", "Oconee", "Oglethorpe", "Paulding", "Peach", "Pickens",
    "Pierce", "Pike", "Polk", "Pulaski", "Putnam", "Quitman", "Rabun", "Randolph", "Richmond", "Rockdale", "Schley",
    "Screven", "Seminole", "Spalding", "Stephens", "Stewart", "Sumter", "Talbot", "Taliaferro", "Tattnall", "Taylor",
    "Telfair", "Terrell", "Thomas", "Tift", "Toombs", "Towns", "Treutlen", "Troup", "Turner", "Twiggs", "Union",
    "Upson", "Walker", "Walton", "Ware", "Warren", "Washington", "Wayne", "Webster", "Wheeler", "White", "Whitfield",
    "Wilcox", "Wilkes", "Wilkinson", "Worth",
]

# Deadline rules (id, family, trigger, days, statute).
DEADLINE_RULES = [
    ("con-challenge-window", "CON", "Letter of determination", 30, "31-6-44"),
    ("con-ho-appointment", "CON", "Challenge filed", 30, "31-6-44"),
    ("con-hearing-window-open", "CON", "Hearing officer appointed", 60, "31-6-44"),
    ("con-hearing-window-close", "CON", "Hearing officer appointed", 120, "31-6-44"),
    ("con-ho-decision", "CON", "Hearing concluded", 30, "31-6-44"),
    ("con-judicial-petition", "CON", "Final agency decision", 30, "31-6-44.1"),
    ("con-finality-default", "CON", "Superior court docketing", 120, "50-13-19"),
    ("det-sufficiency", "DET", "Request filed", 11, "31-6-2"),
    ("det-letter", "DET", "Request filed", 60, "31-6-2"),
    ("det-challenge-window", "DET", "Letter of determination", 30, "31-6-44"),
    ("det-ho-appointment", "DET", "Challenge filed", 30, "31-6-44"),
    ("det-hearing-window-open", "DET", "Hearing officer appointed", 60, "31-6-44"),
    ("det-hearing-window-close", "DET", "Hearing officer appointed", 120, "31-6-44"),
    ("det-ho-decision", "DET", "Hearing concluded", 30, "31-6-44"),
    ("det-judicial-petition", "DET", "Final agency decision", 30, "31-6-44.1"),
    ("det-finality-default", "DET", "Superior court docketing", 120, "50-13-19"),
]

# Folder names that tell a file's document type and phase.
FOLDERS = {
    "main application": ("Application/Request", "Initial Application"),
    "appendices": ("Application/Request", "Initial Application"),
    "acknowledgement & completeness": ("Notice", "Initial Application"),
    "60 day meeting": ("Notice", "Initial Application"),
    "additional info & amendment": ("Application/Request", "Initial Application"),
    "letters of support": ("Correspondence", "Initial Application"),
    "letters of opposition": ("Correspondence", "Initial Application"),
    "extension of review": ("Notice", "Initial Application"),
    "withdrawal correspondence": ("Correspondence", "Initial Application"),
    "decision": ("Decision/Determination", "Initial Application"),
    "public notices": ("Notice", "Initial Application"),
    "other": ("Other", "Initial Application"),
    "evaluation": ("Decision/Determination", "Initial Application"),
    "determination file": ("Decision/Determination", "Initial Application"),
    "initial hearing officer appeal": ("Hearing Officer Decision", "Administrative Appeal"),
    "apa appeal": ("Hearing Officer Decision", "Administrative Appeal"),
    "commissioner review": ("Final Agency Decision", "Administrative Appeal"),
    "judicial review": ("Court Order/Opinion", "Judicial Review – Superior Court"),
    "post-approval files": ("Correspondence", "Initial Application"),
    "status reporting": ("Correspondence", "Initial Application"),
    "review board": ("Hearing Officer Decision", "Administrative Appeal"),
    "challenger correspondence": ("Correspondence", "Administrative Appeal"),
    "department correspondence": ("Correspondence", "Initial Application"),
    "respondent correspondence": ("Correspondence", "Administrative Appeal"),
}

NAMED = {
    "service-types": SERVICE_TYPES,
    "matter-types": MATTER_TYPES,
    "action-types": ACTION_TYPES,
    "doc-types": DOC_TYPES,
    "phases": PHASES,
    "outcomes": OUTCOMES,
    "counties": COUNTIES,
    "validation-statuses": VALIDATION_STATUSES,
}


def vocabulary(spark: SparkSession, name: str) -> DataFrame:
    """Codes of one vocabulary in order; decision levels carry their number. Unknown names raise ``KeyError``."""
    if name == "decision-levels":
        return spark.createDataFrame(list(DECISION_LEVELS.items()), "level int, code string")
    return spark.createDataFrame([(k, code) for k, code in enumerate(NAMED[name])], "position int, code string")


def deadline_rules(spark: SparkSession) -> DataFrame:
    rows = [(k, *rule) for k, rule in enumerate(DEADLINE_RULES)]
    return spark.createDataFrame(rows, "position int, rule_id string, docket_family string, trigger_event string, offset_days int, basis_statute string")
