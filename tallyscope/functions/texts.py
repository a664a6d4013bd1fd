"""Report wording. Every string here is a fixed value: results are compared by text."""

# ---- fixed values -----------------------------------------------------------
# Grading: reasons for human review.
REVIEW_UNTRAINED = (
    "The classifier has no trained weights, so the neural prediction was excluded from "
    "grading. Only image morphometry was used."
)
REVIEW_OUT_OF_DOMAIN = (
    "This image does not appear to be a dermoscopic photograph of skin, so the neural "
    "prediction was excluded from grading rather than shown as a diagnosis."
)
REVIEW_ATTENTION = "The model's visual evidence does not overlap the detected lesion."
REVIEW_LOW_CONFIDENCE = "Model confidence is below 50%."
REVIEW_UNSTABLE = "The prediction is unstable across augmented views of the same image."
REVIEW_UNRELIABLE = "Lesion segmentation was unreliable, so ABCD geometry is approximate."

# Grading: overrides. Numbers are filled in by format_string.
OVERRIDE_UNTRAINED = "No trained weights: tier forced to INDETERMINATE."
OVERRIDE_OUT_OF_DOMAIN = (
    "Input does not appear to be a dermoscopic image of skin: tier forced to INDETERMINATE."
)
OVERRIDE_CRITICAL_TOP = "Melanoma is the top prediction (%.1f%%)."
OVERRIDE_CRITICAL_25 = (
    "Melanoma probability %.1f%% exceeds the 25%% safety-net threshold even though it is not "
    "the top class."
)
OVERRIDE_CRITICAL_10 = "Non-trivial melanoma probability (%.1f%%)."
OVERRIDE_MALIGNANT_TOP = "%s is a malignant or premalignant diagnosis."
OVERRIDE_LOW_CONFIDENCE = (
    "Top-class confidence is only %.1f%%, below the 50%% threshold for an actionable automated "
    "result."
)
OVERRIDE_TDS = (
    "ABCD total dermoscopy score %.2f is above the 5.45 highly-suspicious cut-point."
)

# Grading: audit trail.
DRIVER_NEURAL = "%s at %.1f%% confidence; combined malignant probability %.1f%%"
DRIVER_MORPHOLOGY = "TDS %.2f (%s): A=%d/2, B=%d/8, C=%d/6, D=%d/5"
DRIVER_STABILITY = "%s: entropy %.2f, %.0f%% of augmented views agree"
DRIVER_QUALITY = "%s (%.0f/100)"
DRIVER_ATTENTION_OK = "Grad-CAM evidence is concentrated on the segmented lesion"
DRIVER_ATTENTION_OFF = (
    "Grad-CAM evidence falls largely outside the lesion, so the prediction may be driven by "
    "background artefacts"
)

# Grading: headlines.
HEADLINE_OUT_OF_DOMAIN = (
    "Indeterminate - image does not appear to be a dermoscopic photo of skin"
)
HEADLINE_UNTRAINED = "Indeterminate - classifier not trained, morphometry only"
HEADLINE_UNSUITABLE = "Indeterminate - input unsuitable for automated assessment"
HEADLINES = {
    "LOW": "Low concern - %s at %.0f%% confidence",
    "MODERATE": "Moderate concern - %s at %.0f%% confidence",
    "HIGH": "High concern - %s at %.0f%% confidence",
    "CRITICAL": "Critical concern - %s at %.0f%% confidence",
}

# Quality issues: code -> message (numbers are filled in where marked).
QUALITY_MESSAGES = {
    "resolution_too_low": "Image is only %dx%d px. At least 64x64 is required for a meaningful "
    "result.",
    "resolution_low": "Image is %dx%d px and will be upscaled to 224px, which loses fine "
    "dermoscopic detail.",
    "out_of_focus": "The image is heavily blurred. Border and texture measurements will be "
    "unreliable; retake with the dermatoscope in contact.",
    "soft_focus": "The image is slightly soft. Fine structures such as dots and globules may be "
    "missed.",
    "underexposed": "The image is very dark, which exaggerates apparent pigmentation.",
    "overexposed": "The image is washed out; pigment network detail is likely lost.",
    "low_contrast": "Very low contrast between lesion and surrounding skin.",
    "specular_glare": "%.0f%% of the frame is specular glare. Add immersion fluid or use a "
    "polarised dermatoscope.",
    "no_dermoscopic_structure": "The image has almost no local texture variation - it looks "
    "flat, blank or uniformly patterned rather than a close-up photograph of skin or a lesion. "
    "The classification below is not trustworthy.",
    "not_color_image": "The image is effectively greyscale. This model expects a colour "
    "dermoscopic photograph.",
    "out_of_distribution": "Only %.0f%% of the frame matches skin tones, so this probably is not "
    "a dermoscopic image of skin. The classification below is not trustworthy.",
}

# Change report.
CHANGE_RECOMMENDATIONS = {
    "significant_change": "Documented change of this magnitude warrants prompt in-person "
    "dermatological review, ideally within 2-4 weeks, regardless of the single-image "
    "classification.",
    "minor_change": "Some measurable change. Re-photograph in 4-8 weeks under matched "
    "conditions, and seek review if the trend continues.",
    "stable": "No meaningful change detected. Continue routine self-monitoring.",
}
CHANGE_CAVEATS = {
    "scale": "Apparent size change is only meaningful if both photographs were taken at the same "
    "magnification and distance. Include a ruler or a fixed-diameter dermatoscope aperture in "
    "both captures for reliable measurement.",
    "light": "Lighting differences shift colour metrics. Colour constancy is applied, but it "
    "cannot fully compensate for a different light source.",
    "no_field": "No field-of-view width was supplied, so no absolute millimetre measurement is "
    "reported.",
    "unreliable": "Segmentation was unreliable in at least one capture; geometric comparisons "
    "are approximate.",
    "no_dates": "No capture dates supplied, so growth rate is not computed.",
}

# Leakage audit.
LEAK_VERDICT = (
    "The image-wise split leaks %.2f%% of %s images, so any accuracy measured on it is "
    "optimistically biased. The lesion-grouped split leaks %.2f%%."
)

# Narrative.
COLOR_LABELS = {
    "white": "white / depigmented areas",
    "red": "red or vascular areas",
    "light_brown": "light brown pigment",
    "dark_brown": "dark brown pigment",
    "blue_gray": "blue-gray pigment",
    "black": "black pigment",
}
STRUCTURE_LABELS = {
    "structureless_area": "a broad structureless (homogeneous) area",
    "dots_globules": "dots and globules",
    "pigment_network": "a reticular pigment network",
    "streaks": "peripheral streaks or branched extensions",
    "blue_white_veil": "a blue-white veil",
}
SYMMETRY_WORDS = {
    0: "symmetric about both principal axes",
    1: "asymmetric about one principal axis",
    2: "asymmetric about both principal axes",
}
BORDER_WORDS = {
    6: "markedly irregular, with notching across most of the periphery",
    3: "irregular in several segments",
    1: "mildly irregular in one or two segments",
    0: "smooth and well demarcated",
}
IMPRESSION = "%s favoured at %.1f%% confidence. Severity grade: %s (%.0f/100). %s, %s."
IMPRESSION_UNTRAINED = (
    "Automated classification unavailable (model has no trained weights). Morphometric "
    "assessment alone: %s."
)
IMPRESSION_OUT_OF_DOMAIN = (
    "Automated classification unavailable: this image does not appear to be a dermoscopic "
    "photograph of skin, so the classifier's output was excluded rather than shown as a "
    "diagnosis. Retake with a genuine close-up image of the lesion."
)
SUMMARY_SCORES = (
    "The classifier ranks %s highest at %.1f%%, with a combined malignant or premalignant "
    "probability of %.1f%%."
)
SUMMARY_UNTRAINED = (
    "No trained checkpoint was loaded, so the class probabilities below are the output of an "
    "untrained network and carry no diagnostic meaning. The geometric and colour measurements "
    "are unaffected and are reported on their own merits."
)
SUMMARY_OUT_OF_DOMAIN = (
    "This image does not appear to be a dermoscopic photograph of skin, so the classifier's "
    "probabilities carry no diagnostic meaning and are not shown as a diagnosis. Any geometric "
    "and colour measurements below come from whatever the segmenter found in the frame and "
    "should be treated with the same caution."
)
SUMMARY_MORPHOLOGY = (
    "ABCD morphometry gives a total dermoscopy score of %.2f, which falls in the '%s' band."
)
SUMMARY_STABILITY = (
    "The prediction is %s: %.0f%% of augmented views of the same image agree, with normalised "
    "entropy %.2f."
)
FINDING_ASYMMETRY = "Lesion is %s (A=%d/2)."
FINDING_BORDER = "Border is %s (B=%d/8)."
FINDING_QUALITY = "Image quality %s (%.0f/100)."
DIFFERENTIAL = "%s - %.1f%%. %s"
LIMIT_CLASSES = (
    "Only seven diagnostic categories are modelled. Any lesion outside those seven - including "
    "squamous cell carcinoma, amelanotic melanoma and infectious or inflammatory conditions - "
    "cannot be reported correctly and will be forced into the nearest of the seven classes."
)
LIMIT_STRUCTURES = (
    "The D component of the ABCD score is approximated with classical texture filters, not "
    "expert annotation, and should be read as a weak signal."
)
LIMIT_QUALITY = (
    "Critical image-quality problems were detected; see the findings above. The result should "
    "not be relied on."
)
LIMIT_GEOMETRY = (
    "Automatic lesion segmentation was unreliable for this image, so all geometric measurements "
    "are approximate."
)
FINDING_COLORS = "%d of 6 diagnostic colours present (C=%d/6): %s."
FINDING_MANY_COLORS = " Five or more colours is itself a recognised melanoma-specific feature."
FINDING_NO_COLOR = "No single colour occupies more than 5% of the lesion (C=0/6)."
FINDING_STRUCTURES = "Detected structures (D=%d/5): %s."
FINDING_NO_STRUCTURE = "No distinct dermoscopic structures were detected (D=0/5)."
OVERRIDE_PREFIX = "Grading override - "
LIMIT_WITHHELD = (
    "This image was judged not to be a dermoscopic photograph of skin, so classification was "
    "withheld rather than reported as a random guess."
)
ATTENTION_INSIDE = (
    "Grad-CAM places %.0f%% of its activation inside the segmented lesion, so the prediction is "
    "anchored to the lesion itself."
)
ATTENTION_OUTSIDE = (
    "Only %.0f%% of Grad-CAM activation falls inside the segmented lesion. The prediction may be "
    "responding to background skin, hair or frame artefacts rather than the lesion, and should be "
    "weighted accordingly."
)
LIMIT_UNTRAINED = "No trained model weights were loaded. Classification output is random."
ADVICE_ACTION = "%s (%s)."
ADVICE_CLASS = "Class-specific guidance: %s"
ADVICE_REVIEW = "Flagged for human review: %s"
ADVICE_TIER = "Flagged for human review because of the assigned severity tier."
ADVICE_SELF_CHECK = (
    "Advise the patient on the ABCDE self-check rule and photograph the lesion with a scale "
    "marker so future change can be measured objectively."
)
# ---- end of fixed values ----------------------------------------------------
