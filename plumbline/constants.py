"""Operating points, rule cut-offs, word lists and messages.

They must equal the published ones for results to agree, so they are stated
plainly and only here.
"""

# Locked operating point.
LOCKED_T = 1.5914955557015147
LOCKED_THR = 0.6104530692100525
LOCKED_LOW = 0.20
LOCKED_SEED = 7
LOCKED_CAL_FRAC = 0.20

# Escalation rules.
BORDERLINE_LOW = 0.35
BORDERLINE_HIGH = 0.6105
SCAR_ESCALATE = 0.7126
EVIDENCE_P_LOW = 0.20
EVIDENCE_BOX_HIGH = 0.88
EVIDENCE_PATH_HIGH = 0.44
VERIFIER_LOW = 0.20
VERIFIER_HIGH = 0.65
RECORD_SCORE_FLOOR = 0.25
RECORD_SCAR_CUT = 0.5
SEQ_HIGH = 0.5

# Screening policy and guardrails.
POLICY_FLAG = 0.30
POLICY_CLEAR = 0.15
POLICY_CLEAR_U = 0.15
GUARD_MIN_CONFIDENCE = 75
GUARD_MAX_STD = 0.2
GUARD_MIN_TOP1 = 0.6
GUARD_MAX_DISAGREE = 0.3
GUARD_MAX_FALLBACKS = 2

# Ensemble members and their fixed weights.
MEMBER_WEIGHTS = {"tb": 0.2, "general": 0.0, "vlm": 0.8}

# Report gates.
GATE_PASS_MULTIPLIER = 3.0
GATE_FAIL_MULTIPLIER = 5.0
GATE_MIN_N = 10
STRESS_MIN_N = 50
DEPLOYED_AUC = 0.781
GAIN_MARGIN = 0.05
FORGETTING_FLOOR = 0.846
PREVALENCES = (0.01, 0.02, 0.09, 0.12, 0.15)

# Reasons attached by the rules.
SCAR_REASON = "scar-shape pattern flagged for re-read (high s_inactive in the borderline tb_prob band)"
EVIDENCE_REASON = (
    "model sees pathology in lung region but does not match learned TB-pattern — second-opinion required"
)
RECORD_SCAR_REASON = "VLM scar/mimic heuristic flagged for re-read — uncalibrated"

# Tags matched as case-insensitive substrings.
SCAR_TAGS = ("fibrosis", "pleural_thickening", "pleural thickening", "healed_scar", "healed scar", "scar")

# Map keys that count as relevant evidence.
RELEVANT_FINDINGS = ("Lung Opacity", "Effusion", "Lung Lesion", "Infiltration", "Consolidation")

# Zone names in display order.
ZONES = ("upper_r", "mid_r", "lower_r", "upper_l", "mid_l", "lower_l", "hilar")

# Class index -> finding name.
FINDING_NAMES = (
    "No Finding", "Atelectasis", "Cardiomegaly", "Effusion", "Infiltration", "Mass", "Nodule", "Pneumonia",
    "Pneumothorax", "Consolidation", "Edema", "Emphysema", "Fibrosis", "Pleural_Thickening", "Hernia",
)

# Record fields that have a closed domain, with the value used when out of domain.
QUALITY_VALUES = ("diagnostic", "limited", "nondiagnostic")
PROJECTION_VALUES = ("pa_ap", "lateral", "unknown")
SCREEN_VALUES = ("screen_positive", "screen_negative", "abstain")
BAND_VALUES = ("low", "medium", "high")
LIKELIHOOD_VALUES = ("primary", "consider", "less_likely")

# Report defaults.
REPORT_DEFAULTS = {
    "headline": "Chest radiograph reviewed; see impression below.",
    "technique": "Single frontal chest radiograph; AI-assisted TB triage pipeline.",
    "comparison": "No prior studies available for comparison.",
    "image_quality": "Adequate single frontal projection.",
    "recommendation": "(no recommendation returned)",
}
FINDINGS_DEFAULTS = {
    "lungs_and_airways": "(no parenchymal description returned)",
    "pleura": "The pleural spaces are clear.",
    "cardiomediastinum": "The cardiomediastinal silhouette is unremarkable.",
    "bones_and_soft_tissues": "No osseous abnormality is identified on this projection.",
}
REPORT_LIMITATIONS = (
    "Single-view frontal radiograph; lateral and CT may yield additional information.",
    "Radiographic features are not diagnostic of microbiological status.",
)
