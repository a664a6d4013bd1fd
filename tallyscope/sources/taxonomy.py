"""Fixed dimension tables: the classes and the triage tiers.

Seven and five rows, so joining them is always a broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ---- fixed values -----------------------------------------------------------
# Class order is alphabetical by code and equals the label index.
CLASS_CODES = ("akiec", "bcc", "bkl", "df", "mel", "nv", "vasc")
CRITICAL_CODE = "mel"

CLASS_NAMES = {
    "akiec": "Actinic Keratosis / Intraepithelial Carcinoma",
    "bcc": "Basal Cell Carcinoma",
    "bkl": "Benign Keratosis-like Lesion",
    "df": "Dermatofibroma",
    "mel": "Melanoma",
    "nv": "Melanocytic Nevus",
    "vasc": "Vascular Lesion",
}
SHORT_NAMES = {
    "akiec": "Actinic Keratosis",
    "bcc": "Basal Cell Carcinoma",
    "bkl": "Benign Keratosis",
    "df": "Dermatofibroma",
    "mel": "Melanoma",
    "nv": "Melanocytic Nevus",
    "vasc": "Vascular Lesion",
}
MALIGNANCY = {
    "akiec": "premalignant",
    "bcc": "malignant",
    "bkl": "benign",
    "df": "benign",
    "mel": "malignant",
    "nv": "benign",
    "vasc": "benign",
}
BASE_RISK = {
    "akiec": "moderate",
    "bcc": "moderate",
    "bkl": "low",
    "df": "low",
    "mel": "high",
    "nv": "low",
    "vasc": "low",
}
RISK_WEIGHTS = {
    "akiec": 0.55,
    "bcc": 0.70,
    "bkl": 0.10,
    "df": 0.05,
    "mel": 1.00,
    "nv": 0.02,
    "vasc": 0.05,
}
UNKNOWN_RISK_WEIGHT = 0.1
PUBLISHED_COUNTS = {
    "akiec": 327,
    "bcc": 514,
    "bkl": 1099,
    "df": 115,
    "mel": 1113,
    "nv": 6705,
    "vasc": 142,
}
CLASS_COLORS = {
    "akiec": "#f39c12",
    "bcc": "#e67e22",
    "bkl": "#16a085",
    "df": "#27ae60",
    "mel": "#c0392b",
    "nv": "#2ecc71",
    "vasc": "#8e44ad",
}
DESCRIPTIONS = {
    "akiec": "Sun-induced keratinocyte dysplasia (actinic keratosis and Bowen's disease). "
    "Considered a carcinoma in situ that can progress to invasive squamous cell carcinoma "
    "if untreated.",
    "bcc": "The most common human cancer. Locally invasive and destructive but very rarely "
    "metastasises. Dermoscopy typically shows arborising vessels and shiny white structures.",
    "bkl": "Group covering solar lentigo, seborrhoeic keratosis and lichen planus-like "
    "keratosis. Benign, though regressing lesions can mimic melanoma on dermoscopy.",
    "df": "Benign fibrohistiocytic proliferation, often post-traumatic. Classic dermoscopy "
    "shows a central white scar-like patch with a delicate peripheral pigment network.",
    "mel": "Malignant melanocytic tumour with genuine metastatic potential and the dominant "
    "cause of skin cancer mortality. Prognosis depends steeply on Breslow depth at excision, "
    "so early detection matters.",
    "nv": "Ordinary mole: a benign proliferation of melanocytes. By far the largest class in "
    "HAM10000 (67% of images), which is why plain accuracy is a misleading metric on this "
    "dataset.",
    "vasc": "Angiomas, angiokeratomas, pyogenic granulomas and haemorrhage. Benign, with "
    "characteristic red-purple lacunae on dermoscopy.",
}
MANAGEMENT = {
    "akiec": "Dermatology review. Commonly treated with cryotherapy, topical field therapy or "
    "curettage; biopsy if indurated or ulcerated.",
    "bcc": "Dermatology referral for biopsy and definitive excision or Mohs surgery depending "
    "on site and subtype.",
    "bkl": "Reassurance and routine monitoring. Removal is cosmetic or for symptomatic "
    "irritation only.",
    "df": "Reassurance. Excision only if symptomatic or diagnostically unclear.",
    "mel": "Urgent dermatology referral for excision biopsy. Do not delay: staging and "
    "definitive wide local excision follow histology.",
    "nv": "Routine self-monitoring. Re-present if the lesion changes in size, shape, colour, "
    "or begins to itch or bleed.",
    "vasc": "Reassurance. Laser or excision for cosmetic reasons; exclude amelanotic melanoma "
    "if the lesion is rapidly growing.",
}

# tier -> (rank, time frame, action, colour)
TIERS = {
    "INDETERMINATE": (
        0, "repeat assessment",
        "Retake the image or seek in-person review; automated result unusable", "#7f8c8d",
    ),
    "LOW": (
        1, "routine", "Routine self-monitoring; re-present if the lesion changes", "#2ecc71",
    ),
    "MODERATE": (
        2, "within 4-8 weeks",
        "Dermatology consultation advised; photograph and monitor meanwhile", "#f39c12",
    ),
    "HIGH": (
        3, "within 2-4 weeks",
        "Dermatology referral for specialist assessment and likely biopsy", "#e74c3c",
    ),
    "CRITICAL": (
        4, "within 1-2 weeks", "Urgent dermatology referral for excision biopsy", "#b3202b",
    ),
}
# ---- end of fixed values ----------------------------------------------------

MALIGNANT_FLAGS = [MALIGNANCY[c] in ("malignant", "premalignant") for c in CLASS_CODES]
CRITICAL_INDEX = CLASS_CODES.index(CRITICAL_CODE)
URGENT_TIERS = ("HIGH", "CRITICAL")

CLASS_SCHEMA = (
    "class_idx INT, code STRING, name STRING, short_name STRING, malignancy STRING, "
    "is_malignant BOOLEAN, base_risk STRING, risk_weight DOUBLE, description STRING, "
    "management STRING, published_count INT, color STRING"
)
TIER_SCHEMA = "tier STRING, tier_rank INT, timeframe STRING, action STRING, tier_color STRING"


def classes(spark: SparkSession) -> DataFrame:
    rows = [
        (
            i, c, CLASS_NAMES[c], SHORT_NAMES[c], MALIGNANCY[c], MALIGNANT_FLAGS[i], BASE_RISK[c],
            RISK_WEIGHTS[c], DESCRIPTIONS[c], MANAGEMENT[c], PUBLISHED_COUNTS[c], CLASS_COLORS[c],
        )
        for i, c in enumerate(CLASS_CODES)
    ]
    return spark.createDataFrame(rows, CLASS_SCHEMA)


def tiers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, *v) for t, v in TIERS.items()], TIER_SCHEMA)
