"""Defaults a user of the published model expects.

They are parameters everywhere; nothing in the operators depends on them.
"""

# 5-year age bands, in order. Three labels have no suffix.
AGE_BANDS = [
    "<5 years", "5-9 years", "10-14 years", "15-19 years", "20-24 years",
    "25-29 years", "30-34 years", "35-39 years", "40-44 years", "45-49 years",
    "50-54 years", "55-59 years", "60-64 years", "65-69 years", "70-74 years",
    "75-79 years", "80-84", "85-89", "90-94", "95+ years",
]

# Modelled causes.
CAUSES = [
    "Asthma",
    "Chronic kidney disease due to diabetes mellitus type 1",
    "Chronic kidney disease due to diabetes mellitus type 2",
    "Chronic kidney disease due to hypertension",
    "Chronic obstructive pulmonary disease",
    "Diabetes mellitus type 1",
    "Diabetes mellitus type 2",
    "Esophageal cancer",
    "Hypertensive heart disease",
    "Intracerebral hemorrhage",
    "Ischemic heart disease",
    "Ischemic stroke",
    "Larynx cancer",
    "Lip and oral cavity cancer",
    "Nasopharynx cancer",
    "Other pharynx cancer",
    "Stomach cancer",
    "Tracheal, bronchus, and lung cancer",
]

# Cause groups of the share report; every other cause is Cancer.
CAUSE_GROUPS = {
    "CVD": [
        "Ischemic heart disease", "Ischemic stroke", "Intracerebral hemorrhage",
        "Hypertensive heart disease", "Chronic kidney disease due to hypertension",
    ],
    "Respiratory diseases": ["Asthma", "Chronic obstructive pulmonary disease"],
    "Diabetes": [
        "Diabetes mellitus type 1", "Diabetes mellitus type 2",
        "Chronic kidney disease due to diabetes mellitus type 1",
        "Chronic kidney disease due to diabetes mellitus type 2",
    ],
}

ALL_CAUSES = "All causes"
SEXES = ["Female", "Male"]

# Model parameters.
PER = 100_000             # rates are per 100,000
TRANSITION_CAP = 0.9      # upper limit of a yearly transition rate
INPUT_RATE_CAP = 0.8      # limit of the rates entering calibration
GROWTH_CAP = 0.99         # replacement for a growth rate above 1
BIRTH_SCALE = 0.7         # births series scaled to the historic level
TAX_ELASTICITY = 0.48     # effect of a tax equal to the base price
BASE_PRICE = 28.0         # pack price without tax
TAX_EFFECT_CAP = 0.95
SMOKE_SHARE = 0.0042      # share of deaths under 20 used in the share check
INCREMENT_FLOOR = 0.00001  # smallest coverage increment that counts
