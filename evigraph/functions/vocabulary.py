"""Column expressions over names of genes, cells, organs and ontology terms, and over words of a vocabulary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from evigraph.schemas import MISSING_WORDS

UNSPECIFIED, UNRESOLVED = "unspecified", "unresolved"
# Labels of ontology terms and the lineage that each decides, the first found among a cell's ancestors counts.
LINEAGE_POLICY = (
    ("oligodendrocyte precursor cell", "oligodendroglial"), ("oligodendrocyte", "oligodendroglial"), ("astrocyte", "astroglial"), ("microglial cell", "microglial"), ("neuron", "neuronal / axonal"), ("glial cell", "glial"),
    ("macrophage", "macrophage"), ("lymphocyte", "lymphoid"), ("granulocyte", "granulocytic"), ("leukocyte", "leukocyte"), ("hepatocyte", "hepatocyte"), ("kidney tubule cell", "renal tubular"), ("podocyte", "podocyte"),
    ("cardiac muscle cell", "cardiomyocyte"), ("sertoli cell", "sertoli"), ("germ line cell", "germ line"), ("endothelial cell", "endothelial"), ("fibroblast", "fibroblast"), ("epithelial cell", "epithelial"), ("muscle cell", "muscle"))
# How a lineage reads after the name of an event.
SUFFIXES = {
    "oligodendroglial": "in oligodendrocytes", "astroglial": "in astrocytes", "microglial": "in microglia", "neuronal / axonal": "in neurons/axons", "glial": "in glia", "macrophage": "in macrophages", "lymphoid": "in lymphocytes",
    "granulocytic": "in granulocytes", "leukocyte": "in leukocytes", "hepatocyte": "in hepatocytes", "renal tubular": "in renal tubular cells", "podocyte": "in podocytes", "cardiomyocyte": "in cardiomyocytes", "sertoli": "in Sertoli cells",
    "germ line": "in germ cells", "endothelial": "in endothelial cells", "fibroblast": "in fibroblasts", "epithelial": "in epithelial cells", "muscle": "in muscle cells", "vascular": "in vascular cells"}
# Patterns of cells for use without an ontology, in their order.
CELL_PATTERNS = (
    ("oligodendroglial", r"oligodendro|\bOPC\b|\bOPCs\b|\bOL\b|\bOLs\b|pre-?OL|NG2\+?|myelinating cell|myelin-forming"), ("microglial", r"microglia|\bIba1\b"), ("astroglial", r"astrocyt|\bGFAP\b"), ("macrophage", r"macrophage|kupffer"),
    ("hepatocyte", r"hepatocyt|\bHepG2\b"), ("renal tubular", r"proximal tubul|renal tubul|\bPTEC\b|\bHK-?2\b"), ("podocyte", r"podocyt"), ("cardiomyocyte", r"cardiomyocyt|cardiac myocyt"), ("sertoli", r"sertoli"),
    ("neuronal / axonal", r"\baxon|neuron|calyx|nerve terminal|presynap|postsynap|synapse|node of ranvier|heminode|internode|\bMNTB\b|\bsoma\b|dendrit|granule cell|pyramidal"), ("endothelial", r"endotheli|blood-brain"),
    ("fibroblast", r"fibroblast|stellate cell"), ("vascular", r"pericyte|vascular smooth muscle"), ("epithelial", r"epitheli|alveolar type"))
# Words in names of events and the organ that each is of, in their order.
ANATOMY = (
    (r"\bhepat\w*|\bliver\b", "liver"), (r"\brenal\b|\bkidney\b|\bnephro\w*", "kidney"), (r"\bcardiac\b|\bheart\b|\bmyocard\w*", "heart"), (r"\bpulmonary\b|\blung\b|\balveol\w*", "lung"), (r"\bneur\w*|\bbrain\b|\bcerebr\w*|\bcortex\b", "brain"),
    (r"\bhepatocyte\b", "hepatocyte"), (r"\bthyroid\b", "thyroid gland"), (r"\bgonad\w*|\btestis\b|\btestic\w*", "gonad"), (r"\bovar\w*", "ovary"), (r"\bintestin\w*|\bgut\b|\bcolon\b", "intestine"), (r"\bpancrea\w*", "pancreas"),
    (r"\bskin\b|\bdermal\b|\bepiderm\w*", "skin"), (r"\bblood\b|\bplasma\b|\bserum\b", "blood"), (r"\bvascular\b|\bendotheli\w*|\bartery\b", "blood vessel"), (r"\bbone\b|\bskelet\w*", "bone element"),
    (r"\bmuscle\b|\bmyocyte\b|\bskeletal muscle\b", "muscle organ"), (r"\bimmune\b|\blymph\w*|\bspleen\b", "spleen"), (r"\bplacenta\w*", "placenta"), (r"\bretina\w*|\bocular\b|\beye\b", "eye"), (r"\bgill\b", "gill"), (r"\bswim bladder\b", "swim bladder"))
ANATOMY_PREFIXES = ("uberon", "cl", "ma", "emapa", "fma")
# Words that look like symbols of genes and aren't, and what symbols look like.
NOT_SYMBOLS = (
    "the", "and", "for", "not", "all", "any", "may", "can", "was", "are", "cell", "cells", "gene", "genes", "type", "types", "data", "mice", "rat", "rats", "human", "mouse", "test", "control", "wild", "level", "levels", "dna", "rna")
SYMBOL = r"^[A-Za-z][A-Za-z0-9]*(?:[.\-]?[0-9]+)*[A-Za-z0-9]*$"
SHORT_ALIAS = 4
# Endings, in the order in which they are tried, and how much of a word must stay.
ENDINGS, LEAST_STEM = ("ation", "ations", "ing", "ed", "es", "s", "ion", "ions"), 5
# Fixed value: characters that a search engine reads as syntax.
SYNTAX = r'[+\-!(){}\[\]^"~*?:\\/&|]'


def _first(text: Column, cases: tuple, flags: str = "(?i)") -> Column:
    """The value of the first pattern found, or null; cases are (pattern, value)."""
    return reduce(lambda rest, c: F.when(text.rlike(flags + c[0]), c[1]).otherwise(rest), reversed(cases), F.lit(None).cast("string"))


def lineage_by_pattern(cell: Column) -> Column:
    return _first(F.coalesce(cell, F.lit("")), tuple((p, n) for n, p in CELL_PATTERNS))


def lineage_by_policy(labels: Column) -> Column:
    """The lineage that the labels of a term and its ancestors decide, or null."""
    low = F.transform(labels, lambda x: F.lower(F.trim(x)))
    return reduce(lambda rest, c: F.when(F.array_contains(low, c[0]), c[1]).otherwise(rest), reversed(LINEAGE_POLICY), F.lit(None).cast("string"))


def lineage(cell: Column, resolved: Column | None = None) -> Column:
    """A cell type's lineage: as an ontology resolved it, else by patterns; blank ones are unspecified, others unresolved."""
    found = F.coalesce(*([resolved] if resolved is not None else []), lineage_by_pattern(cell), F.lit(UNRESOLVED))
    return F.when(F.trim(F.coalesce(cell, F.lit(""))) == "", UNSPECIFIED).otherwise(found)


def suffix_for(name: Column) -> Column:
    return reduce(lambda rest, k: F.when(name == k, SUFFIXES[k]).otherwise(rest), SUFFIXES, F.concat(F.lit("in "), name))


def anatomy_hint(name: Column) -> Column:
    return _first(F.coalesce(name, F.lit("")), ANATOMY)


def is_anatomy(curie: Column) -> Column:
    return F.coalesce(F.lower(F.substring_index(curie, ":", 1)).isin(*ANATOMY_PREFIXES), F.lit(False))


def is_gene_symbol(token: Column) -> Column:
    """Whether a word may be the symbol of a gene: its shape, and a digit or mostly capitals."""
    text = F.trim(F.coalesce(token, F.lit("")))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]", ""))
    shaped = F.length(text).between(2, 15) & ~F.lower(text).isin(*NOT_SYMBOLS) & text.rlike(SYMBOL)
    return shaped & (text.rlike("[0-9]") | (capitals >= F.greatest(F.lit(2), F.length(text) - 2)))


def is_strong_match(query: Column, matched_by: Column) -> Column:
    """Whether a match of a gene is sure enough to take its whole family in."""
    text = F.trim(F.coalesce(query, F.lit("")))
    return F.coalesce(matched_by == "symbol", F.lit(False)) | text.rlike("[0-9]") | (F.length(text) >= SHORT_ALIAS)


def stem(word: Column) -> Column:
    """A word without the first ending that fits, if enough of it stays."""
    return reduce(lambda rest, e: F.when(word.endswith(e) & (F.length(word) - len(e) >= LEAST_STEM), F.substring(word, 1, F.length(word) - len(e))).otherwise(rest), reversed(ENDINGS), word)


def by_length(terms: Column) -> Column:
    """Terms once each whatever their case, the longest first, of equally long ones the first in the list."""
    numbered = F.transform(F.filter(terms, lambda t: F.trim(t) != ""), lambda t, i: F.struct((-F.length(t)).alias("n"), i.alias("i"), F.trim(t).alias("t")))
    ordered = F.transform(F.sort_array(numbered), lambda s: s["t"])
    return F.filter(ordered, lambda t, i: ~F.exists(F.slice(ordered, 1, i), lambda u: F.lower(u) == F.lower(t)))


def in_order(terms: Column) -> Column:
    """Terms once each whatever their case, in the order of the list."""
    return F.filter(terms, lambda t, i: ~F.exists(F.slice(terms, 1, i), lambda u: F.lower(u) == F.lower(t)))


def parse_terms(text: Column) -> Column:
    """Terms parted by commas, semicolons or line ends, without surplus blanks, once each."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), "[,\n;]+"), lambda t: F.trim(F.regexp_replace(t, r"\s+", " ")))
    return in_order(F.filter(parts, lambda t: t != ""))


def sanitise_query(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), SYNTAX, " "), r"\s+", " "))


def without_asides(text: Column) -> Column:
    """A query without what stands in brackets."""
    return sanitise_query(F.regexp_replace(F.coalesce(text, F.lit("")), r"\([^)]*\)|\[[^\]]*\]", " "))


def iri_for(curie: Column) -> Column:
    """The address of an ontology's term; null where the identifier has no prefix or no local part."""
    text = F.trim(F.coalesce(curie, F.lit("")))
    prefix, local = F.substring_index(text, ":", 1), F.expr("NULL")
    local = F.regexp_extract(text, "^[^:]*:(.*)$", 1)
    return F.when((F.instr(text, ":") > 0) & (prefix != "") & (local != ""), F.concat(F.lit("http://purl.obolibrary.org/obo/"), F.upper(prefix), F.lit("_"), local))


def build_url(template: Column, curie: Column, iri: Column, label: Column) -> Column:
    """A provider's address of a term: the template with percent-encoded parts in the places of {curie}, {short_id}, {iri}, {label}."""
    quoted = lambda c: F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    short = F.when(F.instr(curie, ":") > 0, F.substring_index(curie, ":", -1)).otherwise(curie)
    for place, value in (("{curie}", curie), ("{short_id}", short), ("{iri}", iri), ("{label}", label)):
        template = F.replace(template, F.lit(place), quoted(value))
    return template


def coerce_enum(value: Column, allowed: tuple[str, ...], fallback: str | None) -> Column:
    """The allowed value that a text means, whatever its case, or the fallback."""
    text = F.lower(F.trim(F.coalesce(value.cast("string"), F.lit(""))))
    return reduce(lambda rest, v: F.when(text == v.lower(), v).otherwise(rest), reversed(allowed), F.lit(fallback).cast("string"))


def coerce_bool(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin("true", "1", "yes"), F.lit(False))


def norm_event(text: Column) -> Column:
    """An event's name in lower case with single blanks for all that isn't a letter or digit."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def says(text: Column) -> Column:
    return ~F.coalesce(F.lower(F.trim(text)).isin(*MISSING_WORDS), F.lit(True))
