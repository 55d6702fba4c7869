"""Closed vocabularies of the data model, in their order."""

from __future__ import annotations

# Fixed values.
LEVELS = ("MIE", "Molecular", "Cellular", "Tissue", "Organ", "Individual", "Population")
ADJACENCY = ("Adjacent", "Non-adjacent")
DIRECTIONS = ("positive", "negative", "none", "unclear")
RELATION_KINDS = ("causal", "marker", "definitional")
#: Strongest first.
EVIDENCE_TYPES = ("rescue", "perturbation", "common_stressor", "correlation", "reverse_only", "not_stated")
CAUSAL_EVIDENCE = ("rescue", "perturbation")
CONFIDENCES = ("High", "Medium", "Low")
STUDY_DESIGNS = ("In vivo", "In vitro", "In silico", "Ex vivo", "Epidemiological", "Review / meta-analysis")
SEXES = ("Male", "Female", "Mixed", "Not specified")
STATES = ("raw", "normalized", "curated", "approved", "synthesized")
DEFAULT_LEVEL = "Molecular"

#: Multiplier of a confidence score by the strongest kind of evidence (fixed values).
EVIDENCE_FACTOR = {"rescue": 1.15, "perturbation": 1.0, "common_stressor": 0.85, "correlation": 0.7, "reverse_only": 0.4, "not_stated": 0.6}
#: Weights of a confidence score (fixed values).
SCORE_WEIGHTS = {"papers": 0.30, "essentiality": 0.20, "quantitative": 0.15, "verified": 0.15, "extraction": 0.10, "registry": 0.10}
#: Text that stands for nothing (fixed values).
MISSING_WORDS = ("", "nan", "nat", "none", "null", "<na>")
