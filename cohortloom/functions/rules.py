"""Rule tables of the cohort: which words, prefixes and drugs make which class."""

from __future__ import annotations

# Class -> (words of which one must occur, words none of which may occur), first match wins.
LAB_RULES = {
    "creatinine": (["CREATININE"], ["URINE", "CLEARANCE", "RATIO", "/CREAT", "BODY FLUID"]),
    "gfr": (["GFR", "GLOMERULAR FILTRATION"], []),
    "bun": (["UREA NITROGEN", "BUN"], ["RATIO", "/CREAT", "URINE"]),
    "sodium": (["SODIUM"], ["URINE", "BODY FLUID", "FECAL"]),
    "potassium": (["POTASSIUM"], ["URINE", "BODY FLUID"]),
    "calcium": (["CALCIUM"], ["URINE", "IONIZED"]),
    "magnesium": (["MAGNESIUM"], ["URINE"]),
    "glucose": (["GLUCOSE"], ["URINE", "CSF", "TOLERANCE", "BODY FLUID", "MEAN", "AVERAGE"]),
    "hba1c": (["A1C", "GLYCOHEMOGLOBIN", "GLYCATED HEMOGLOBIN", "HEMOGLOBIN A1"], []),
    "cholesterol_total": (["CHOLESTEROL"], ["HDL", "LDL", "VLDL", "NON", "RATIO", "/"]),
    "ldl": (["LDL"], ["VLDL", "RATIO", "/"]),
    "hdl": (["HDL"], ["NON", "RATIO", "/"]),
    "triglycerides": (["TRIGLYCERIDE"], []),
}
VITAL_RULES = {
    "height": (["HEIGHT"], []),
    "weight": (["WEIGHT/SCALE"], ["IDEAL", "DRY", "BIRTH", "CHANGE", "GOAL"]),
    "bmi": (["BMI", "BODY MASS INDEX"], []),
    "bp": (["BP", "BLOOD PRESSURE"], ["MAP", "MEAN ARTERIAL", "ARTERIAL LINE", "GOAL", "ORTHOSTATIC NOTE"]),
}
# Curated diagnosis groups and their code prefixes.
DIAGNOSIS_PREFIXES = {
    "has_heart_failure": ["I50", "I11.0", "I13.0", "I13.2"],
    "has_diabetes": ["E08-E13"],
    "has_ckd": ["N18", "I12", "I13"],
    "has_ischemic_heart_disease": ["I20-I25"],
    "has_atrial_fibrillation": ["I48"],
    "has_hyperlipidemia": ["E78"],
    "has_cerebrovascular": ["I60-I69", "G45"],
    "has_pvd": ["I70", "I73"],
    "has_valvular": ["I05-I08", "I34-I39"],
    "has_cardiomyopathy": ["I42"],
    "has_obesity": ["E66"],
    "has_copd": ["J40-J47"],
    "has_osa": ["G47.3"],
    "has_tobacco_use": ["F17", "Z87.891"],
}
# Diagnosis groups and words of a code category's description.
CATEGORY_KEYWORDS = {
    "has_hypertension": ["hypertension"], "has_heart_failure": ["heart failure"], "has_diabetes": ["diabetes"], "has_ckd": ["chronic kidney disease"],
    "has_ischemic_heart_disease": ["coronary atherosclerosis", "myocardial infarction", "angina"], "has_arrhythmia_afib": ["dysrhythmia"], "has_hyperlipidemia": ["lipid"],
    "has_cerebrovascular": ["cerebrovascular", "transient cerebral ischemia"], "has_pvd": ["peripheral and visceral atherosclerosis", "aortic"], "has_valvular": ["heart valve", "valvular"],
    "has_cardiomyopathy": ["cardiomyopathy"], "has_obesity": ["obesity", "overweight"], "has_copd": ["chronic obstructive", "bronchiectasis"], "has_osa": ["sleep"],
}
# Drug groups and the names that a drug's text may hold.
DRUG_GROUPS = {
    "med_diuretic": ["furosemide", "bumetanide", "torsemide", "ethacrynic", "amiloride", "hydrochlorothiazide", "hctz", "indapamide", "triamterene", "chlorthalidone", "chlorothiazide", "metolazone", "spironolactone", "eplerenone"],
    "med_beta_blocker": ["metoprolol", "atenolol", "carvedilol", "bisoprolol", "propranolol", "labetalol", "nebivolol", "nadolol", "sotalol", "esmolol", "betaxolol", "acebutolol", "pindolol", "timolol", "penbutolol"],
    "med_ace_inhibitor": ["lisinopril", "enalapril", "ramipril", "benazepril", "captopril", "fosinopril", "quinapril", "perindopril", "trandolapril", "moexipril"],
    "med_arb": ["losartan", "valsartan", "olmesartan", "telmisartan", "candesartan", "irbesartan", "azilsartan", "eprosartan"],
    "med_ccb": ["amlodipine", "nifedipine", "felodipine", "nicardipine", "isradipine", "nisoldipine", "clevidipine", "diltiazem", "verapamil"],
    "med_alpha_blocker": ["doxazosin", "prazosin", "terazosin"],
    "med_central_alpha2_agonist": ["clonidine", "methyldopa", "guanfacine", "guanabenz", "reserpine"],
    "med_vasodilator": ["hydralazine", "minoxidil", "nitroprusside"],
    "med_statin": ["atorvastatin", "simvastatin", "rosuvastatin", "pravastatin", "lovastatin", "pitavastatin", "fluvastatin"],
    "med_other_lipid_lowering": ["ezetimibe", "evolocumab", "alirocumab", "fenofibrate", "fenofibric", "gemfibrozil", "niacin", "cholestyramine", "colesevelam", "bempedoic", "icosapent"],
    "med_antiplatelet": ["aspirin", "clopidogrel", "prasugrel", "ticagrelor", "dipyridamole", "cilostazol"],
    "med_anticoagulant": ["warfarin", "apixaban", "rivaroxaban", "dabigatran", "edoxaban", "enoxaparin", "fondaparinux", "heparin"],
    "med_nitrate": ["nitroglycerin", "isosorbide"],
    "med_antiarrhythmic": ["amiodarone", "dronedarone", "digoxin", "dofetilide", "flecainide", "propafenone", "mexiletine", "quinidine", "disopyramide", "ibutilide"],
    "med_antidiabetic_oral": ["metformin", "glipizide", "glyburide", "glibenclamide", "gliclazide", "glimepiride", "pioglitazone", "rosiglitazone", "sitagliptin", "linagliptin", "saxagliptin", "alogliptin", "repaglinide", "nateglinide", "acarbose"],
    "med_sglt2_inhibitor": ["empagliflozin", "dapagliflozin", "canagliflozin", "ertugliflozin"],
    "med_glp1_agonist": ["liraglutide", "semaglutide", "dulaglutide", "exenatide", "lixisenatide", "tirzepatide"],
    "med_insulin": ["insulin"],
}
# Race by the beginning of the lower-cased text; anything else is Unknown/Other.
RACE_GROUPS = {
    "d. asian": "Asian", "f. multiracial": "Multiracial", "e. pacific islander": "Pacific Islander", "a. white": "White", "b. black": "Black or African American",
    "c. american indian": "American Indian or Alaska Native", "hispanic": "Hispanic",
}
# Other names of a vital after normalising.
VITAL_SYNONYMS = {
    "height": ["ht", "height", "height_cm", "height_in"],
    "weight": ["wt", "weight", "weight_kg", "weight_lb", "weight_lbs"],
    "bmi": ["bmi", "body_mass_index", "body_mass_index_bmi"],
    "bp_systolic": ["systolic", "systolic_bp", "systolic_blood_pressure", "blood_pressure_systolic", "bp_systolic"],
    "bp_diastolic": ["diastolic", "diastolic_bp", "diastolic_blood_pressure", "blood_pressure_diastolic", "bp_diastolic"],
}
