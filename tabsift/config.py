"""Every threshold, weight, marker and pattern, plus metadata defaults.

The values below are fixed values: they decide results and have to be exactly these.
"""

from __future__ import annotations

import copy

# --- fixed values -----------------------------------------------------------------------------
TECHNICAL_MARKERS = ["", " ", "na", "n/a", "nan", "null", "none", "missing", "unknown", "unk", "-", "--", "."]
SEMANTIC_MARKERS = ["not tested", "not performed", "not measured", "pending", "indeterminate",
                    "not available", "not applicable", "not recorded"]

BINARY_SETS = [["0", "1"], ["true", "false"], ["yes", "no"], ["y", "n"], ["male", "female"], ["m", "f"]]

DATE_LIKE = r"\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{2,4}"

ANOMALY_ROLES = ["continuous_measurement", "continuous_measurement_high_missingness",
                 "continuous_numeric", "ordinal_or_categorical"]
CATEGORY_ROLES = ["categorical_nominal", "ordinal_or_categorical", "free_text",
                  "free_text_or_high_cardinality", "binary"]
AMBIGUOUS_ROLES = ["mixed_numeric_requires_review", "free_text_or_high_cardinality"]
TEXT_LIKE_ROLES = ["free_text", "categorical_nominal", "date_time"]

DOC_NAME_HINTS = ["readme", "codebook", "code_book", "code book", "dictionary", "data_dictionary",
                  "datadictionary", "description", "documentation", "notes"]
SCAFFOLDING_FILES = ["metadata_guide.md", "metadata_template.json"]
STEM_NOISE = ["metadata", "code book", "codebook", "readme", "dictionary"]
DATA_EXTENSIONS = [".csv", ".xlsx", ".xls"]
LOADABLE_EXTENSIONS = [".csv", ".tsv"]
ROUTABLE_DATA_EXTENSIONS = [".csv", ".xlsx", ".xls", ".tsv"]
ROUTABLE_METADATA_EXTENSIONS = [".json", ".txt", ".md", ".pdf", ".docx"]
DOCUMENT_EXTENSIONS = [".json", ".txt", ".md", ".csv", ".tsv"]

DOCUMENTATION_KEYS = ["title", "description", "abstract", "dataset_type", "methodology", "provenance",
                      "etl_description", "license", "usage_conditions", "standards", "vocabularies",
                      "versioning", "reproducibility", "privacy", "documentation_text"]

# English stop words of Spark ML's StopWordsRemover that a two-letter word pattern can produce.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
herself it its itself they them their theirs themselves what which who whom this that these those am is are
was were be been being have has had having do does did doing a an the and but if or because as until while of
at by for with about against between into through during before after above below to from up down in out on
off over under again further then once here there when where why how all any both each few more most other
some such no nor not only own same so than too very s t can will just don should now cannot could ought would
""".split()

ISSUE_REASONS = {
    "critical_field_missingness": "a clinically critical field is incomplete and may bias analysis",
    "semantic_unusable_values": "values use placeholder/exclusion codes that are unusable as numbers",
    "high_missingness": "the missing rate is high enough to affect downstream use",
    "non_numeric_observed_value": "a measurement column contains values that do not parse as numbers",
    "identifier_duplicate": "an identifier is expected to be unique but repeats",
    "duplicate_rows": "identical records may indicate accidental duplication",
    "range_violation": "values fall outside the metadata-defined plausible range",
    "allowed_value_violation": "values are outside the permitted category set",
    "inconsistent_category_encoding": "one real category is split across several spellings",
    "low_k_anonymity_records": "records are rare on quasi-identifiers, raising re-identification risk",
    "direct_identifier_present": "a direct personal identifier is present in the data",
    "ensemble_anomaly_candidate": "multiple detectors agree the record is anomalous",
    "low_semantic_role_confidence": "the variable's semantic role is uncertain",
    "semantic_role_disagreement": "rule-based and embedding evidence assign different semantic roles",
}
DEFAULT_REASON = "the value needs expert judgement to confirm"
DIMENSION_WORDS = {"C": "Completeness", "A": "Accuracy", "R": "Reuse readiness"}

CONFIG = {
    "random_seed": 42,
    "max_datasets": None,
    "missingness": {
        "technical_markers": TECHNICAL_MARKERS,
        "semantic_markers": SEMANTIC_MARKERS,
        "sentinels": {"enabled": True, "min_numeric_fraction": 0.20, "max_token_fraction": 0.85,
                      "max_distinct_tokens": 5, "min_token_count": 2, "max_token_length": 20},
    },
    "roles": {
        "id_patterns": ["(^|_)id$", "identifier", "subject", "record", "case", "visit", "mrn"],
        "target_patterns": ["target", "outcome", "label", "diagnosis", "class", "status", "cancer", "disease",
                            "death", "mortality", "result", "positive", "readmission", "event"],
        "date_patterns": ["date", "time", "timestamp", "admission", "discharge", "visit"],
        "text_patterns": ["note", "text", "comment", "description", "history", "summary"],
        "measurement_patterns": ["age", "height", "weight", "score", "rate", "level", "value", "index",
                                 "pressure", "temperature", "count", "bmi", "glucose"],
        "numeric_parse": 0.98, "mixed_numeric": 0.50, "low_cardinality": 30, "high_uniqueness": 0.85,
        "low_confidence": 0.65, "embedding_min_similarity": 0.30,
    },
    "anomaly": {
        "min_rows": 30, "min_columns": 2,
        "proposed": {"iqr_multiplier": 3.0, "z_threshold": 4.5},
        "baseline": {"iqr_multiplier": 1.5, "z_threshold": 3.5},
        "isolation_forest": {"enabled": True, "contamination_min": 0.01, "contamination_max": 0.04,
                             "expected_cases": 25, "trees": 100, "subsample": 256},
        "local_outlier_factor": {"enabled": True, "min_neighbors": 10, "max_neighbors": 35, "divisor": 20},
        "ensemble": {"min_methods": 2, "require_ml_method": True},
    },
    "scoring": {
        "thresholds": {"C": 0.95, "A": 0.95, "R": 0.80, "composite": 0.85},
        "A": {"structural": 0.20, "domain": 0.25, "anomaly": 0.25, "inconsistency": 0.15,
              "schema_confidence": 0.15},
        "C": {"technical_cell": 0.25, "semantic_cell": 0.20, "required_fields": 0.25,
              "critical_fields": 0.20, "complete_rows": 0.10},
        "R": {"documentation": 0.40, "standardisation": 0.20, "privacy": 0.25, "machine_readability": 0.15},
        "composite": {"A": 0.40, "C": 0.30, "R": 0.30},
        "scenarios": {
            "expert_original": {"A": 0.40, "C": 0.30, "R": 0.30},
            "equal_dimensions": {"A": 0.3334, "C": 0.3333, "R": 0.3333},
            "conservative_health_data": {"A": 0.45, "C": 0.35, "R": 0.20},
            "reuse_focused_open_science": {"A": 0.30, "C": 0.25, "R": 0.45},
        },
    },
    "auto_inference": {
        "enabled": True,
        "direct_identifier_patterns": [
            "(^|_)name$",
            "first_?name|last_?name|full_?name|surname|patient_?name",
            "(^|_)ssn$|social_security",
            "(^|_)mrn$|medical_record",
            "e-?mail|(^|_)email",
            "phone|mobile|telephone",
            "passport|national_id|nhs_number|insurance_number",
            "address|street|postcode_full|full_postcode",
        ],
        "quasi_identifier_patterns": [
            "age|birth|dob|yob",
            "sex|gender",
            "race|ethnic|nationality|country|region|state|county|city|zip|postal|postcode",
            "marital|education|occupation|employment|income",
            "admission|discharge|visit|encounter|date",
            "weight|height",
        ],
        "cardinality_min": 2, "cardinality_max_ratio": 0.50, "max_quasi_identifiers": 8,
        "near_unique": 0.98,
    },
    "reuse": {
        "checklist_weight": 0.55, "similarity_weight": 0.45, "checklist_rule_weight": 1.0,
        "tfidf_range": (0.05, 0.45), "embedding_range": (0.15, 0.55),
        "logit_midpoint": 0.0, "logit_scale": 4.0,
        "privacy": {"k_min": 5, "risk_cap": 0.50,
                    "weights": {"direct_identifier_handling": 0.40, "k_anonymity": 0.40,
                                "privacy_documentation": 0.20}},
        "machine_readability": {"confident_typing": 0.40, "clean_headers": 0.30, "parseable_values": 0.30},
    },
    "injection": {"enabled": True, "rates": [0.05],
                  "error_types": ["set_missing", "numeric_sentinel", "high_outlier"]},
    "review": {
        "anomaly_rows": 30, "incomplete_rows": 30, "control_rows": 30,
        "severity_rank": {"high": 3, "medium": 2, "low": 1},
        "critical_boost": 1, "role_review_boost": 1,
        "decisions": ["true_issue", "valid_extreme", "false_positive", "uncertain_requires_domain_review"],
    },
}

DOCUMENTATION_COMPONENTS = {
    "metadata_or_data_dictionary": {
        "prompts": ["dataset metadata data dictionary variable list column description",
                    "data dictionary describes the variables and dataset structure"],
        "keywords": ["data dictionary", "codebook", "code book", "variable list", "column description",
                     "dataset description", "metadata", "variables in this dataset", "variable name",
                     "field description"],
    },
    "variable_descriptions": {
        "prompts": ["each variable has a clear meaning and description",
                    "variables are explained for secondary users"],
        "keywords": ["variable description", "column description", "each variable", "variable name",
                     "describes the variable", "variable label", "field name", "column name",
                     "variable definitions", "codebook", "code book"],
    },
    "units_or_value_labels": {
        "prompts": ["measurement units value labels coding scheme allowed categories",
                    "units and allowed values are documented"],
        "keywords": ["unit", "value label", "coding scheme", "allowed values", "categories",
                     "measurement unit", "kg", "kcal", "mg", "encoded as", "coded as", "response option"],
    },
    "licence_or_usage_conditions": {
        "prompts": ["license usage conditions access restrictions reuse permissions",
                    "terms of use for dataset reuse are specified"],
        "keywords": ["license", "licence", "terms of use", "usage conditions", "access conditions", "reuse",
                     "copyright", "permitted use", "data sharing", "open data", "creative commons", "cc by",
                     "ethics", "informed consent", "data access"],
    },
    "provenance_or_etl": {
        "prompts": ["data provenance source extraction transformation cleaning ETL process",
                    "data origin and processing steps are documented"],
        "keywords": ["data collection", "data processing", "provenance", "etl", "data source",
                     "collected from", "sampling", "survey", "instrument", "methodology", "data cleaning",
                     "quality control", "missing data", "exclusion criteria", "inclusion criteria",
                     "protocol"],
    },
}
STANDARDISATION_COMPONENTS = {
    "standards_or_vocabularies": {
        "prompts": ["standard terminology controlled vocabulary coding system ontology",
                    "standards or vocabularies are specified"],
        "keywords": ["iso ", "icd", "loinc", "snomed", "controlled vocabulary", "ontology",
                     "coding standard", "standard terminology", "nutridata", "efsa", "fao",
                     "standard method", "validated instrument", "validated questionnaire"],
    },
    "versioning_or_reproducibility": {
        "prompts": ["versioning reproducibility scripts software environment package versions random seed",
                    "analysis can be reproduced with code and documented computational environment"],
        "keywords": ["version", "reproducib", "script", "software", "package", "random seed", "github",
                     "repository", "environment", "r version", "python version", "spss", "stata"],
    },
}

METADATA_DEFAULTS = {
    "dataset_type": "unspecified_tabular_dataset",
    "id_fields": [], "target_fields": [], "required_fields": [], "critical_fields": [],
    "semantic_roles": {}, "allowed_values": {}, "valid_ranges": {}, "consistency_rules": [],
    "direct_identifiers": [], "quasi_identifiers": [], "reuse_readiness": {},
    "variable_descriptions": {}, "documentation_text": "",
}
# --- end of fixed values ----------------------------------------------------------------------


def merge_metadata(metadata: dict | None) -> dict:
    """User metadata over the defaults; an explicit null falls back to the default."""
    given = {k: v for k, v in (metadata or {}).items() if v is not None or k not in METADATA_DEFAULTS}
    return {**copy.deepcopy(METADATA_DEFAULTS), **given}


def with_config(**sections) -> dict:
    """A copy of ``CONFIG`` with whole sections replaced or dictionaries updated one level deep."""
    config = copy.deepcopy(CONFIG)
    for key, value in sections.items():
        if isinstance(value, dict):
            config[key].update(value)
        else:
            config[key] = value
    return config
