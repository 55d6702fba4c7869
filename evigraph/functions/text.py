"""Column expressions over document text: headings, identifiers, quotations, vocabulary scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What PDF text has in place of plain characters, and the plain characters.
LOOKALIKES = {"­": "", "ﬁ": "fi", "ﬂ": "fl", "‐": "-", "‑": "-", "–": "-", "—": "-", "‘": "'", "’": "'", "“": '"', "”": '"'}

# Section kinds and the headings that open them; the first that fits counts.
HEADINGS = (
    ("abstract", r"(abstract|summary|graphical abstract)\b"),
    ("intro", r"(introduction|background)\b"),
    ("methods", r"((?:materials?\s+and\s+)?methods?|methodology|experimental(?:\s+(?:section|procedures?))?|materials)\b"),
    ("results", r"(results?(?:\s+and\s+discussion)?|findings)\b"),
    ("discussion", r"(discussion|general discussion)\b"),
    ("conclusion", r"(conclusions?|concluding remarks|perspectives?)\b"),
    ("references", r"(references|bibliography|works cited|literature cited)\b"),
    ("back", r"(acknowledge?ments?|funding|conflicts? of interest|author contributions?|supplementary|abbreviations|data availability|declaration)\b"),
)
HEADING_PREFIX = r"^\s*(?:\d+\.?\s*)?"
NUMBERED_HEADING = r"^\s*\d+(?:\.\d+)*\.?\s+[A-Z][^.!?]{2,70}$"
BACK_MATTER = ("references", "back")

# Weights of words that speak of causes, biology and quantities, and of sections.
CAUSAL = (
    (r"lead(?:s|ing)?\s+to", 3.0), (r"result(?:s|ed|ing)?\s+in", 2.5), (r"cause(?:s|d)?\b", 2.5), (r"induce(?:s|d)?\b", 2.5), (r"trigger(?:s|ed|ing)?\b", 2.5), (r"activat(?:e|es|ed|ion)\b", 2.0),
    (r"inhibit(?:s|ed|ion)?\b", 2.0), (r"suppress(?:es|ed|ion)?\b", 2.0), (r"upregulat|downregulat", 2.0), (r"mediat(?:e|es|ed|ing)\b", 2.0), (r"promot(?:e|es|ed|ing)\b", 1.5), (r"drives?\b", 1.5),
    (r"contribut(?:e|es|ed|ing)\s+to", 1.5), (r"associated\s+with", 1.0), (r"correlat(?:e|es|ed|ion)\b", 1.0), (r"dose[-\s]dependent", 2.5), (r"time[-\s]dependent", 1.5), (r"downstream\s+of", 2.0),
    (r"upstream\s+of", 2.0), (r"knock(?:out|down)\b", 3.0), (r"\bsiRNA\b|\bshRNA\b|\bCRISPR\b", 2.5), (r"antagonist|agonist|blocker|inhibitor", 2.0), (r"rescue(?:d|s)?\b", 2.0), (r"abolish(?:ed|es)?\b", 2.0),
    (r"attenuat(?:e|es|ed|ion)\b", 2.0), (r"mechanis(?:m|tic)", 2.5), (r"pathway", 1.5), (r"signal(?:l?ing|ling)\b", 1.5), (r"adverse\s+outcome", 3.0), (r"key\s+event", 3.0), (r"mode\s+of\s+action", 3.0))
BIOLOGY = (
    (r"oxidative\s+stress|reactive\s+oxygen|\bROS\b", 2.0), (r"apoptosis|necrosis|pyroptosis|ferroptosis|cell\s+death", 2.0), (r"inflammation|inflammatory|cytokine|chemokine", 2.0), (r"DNA\s+damage|genotoxic|mutagen|adduct", 2.0),
    (r"mitochondri\w+", 2.0), (r"receptor\b|\bAhR\b|\bPPAR\b|\bER[αβ]?\b|nuclear\s+receptor", 2.0), (r"transcription|mRNA|gene\s+expression", 1.5), (r"protein\s+expression|phosphorylat\w+|enzyme\s+activity", 1.5),
    (r"steatosis|fibrosis|necroinflammation|hepatotox|nephrotox|neurotox|cardiotox", 2.5), (r"proliferation|differentiation|migration|senescence", 1.5), (r"barrier\s+(?:function|integrity)|permeability", 1.5),
    (r"lipid\s+peroxidation|glutathione|\bGSH\b|\bMDA\b|\bSOD\b", 2.0), (r"membrane\s+potential|calcium\s+influx|ion\s+channel", 1.5), (r"tumou?r|carcinogen|neoplas\w+", 2.0),
    (r"reproducti\w+|fecundity|fertility|population\s+decline", 2.0), (r"behavio\w*r|locomot\w+|cognit\w+", 1.5))
QUANTITY = (
    (r"\bp\s*[<=>]\s*0?\.\d+", 2.0), (r"\bEC\d{2}\b|\bIC\d{2}\b|\bLD\d{2}\b|\bLOAEL\b|\bNOAEL\b|\bBMD\b", 3.0), (r"\bfold[-\s]change\b|\d+\s*-\s*fold", 2.0), (r"\b95\s*%\s*CI\b|confidence\s+interval", 1.5),
    (r"\bµM\b|\bμM\b|\bnM\b|\bmM\b|mg\s*/\s*kg|µg\s*/\s*[mL]", 2.0), (r"\bR\s*2\b|\bR²\b|regression|correlation\s+coefficient", 1.0))
SECTION_PRIOR = {"abstract": 1.35, "intro": 1.05, "methods": 0.55, "results": 1.30, "discussion": 1.25, "conclusion": 1.20, "other": 1.0, "references": 0.0, "back": 0.1}
NOISE = (r"(?m)^\s*\[TABLE\]", r"(?i)supplementary\s+(?:table|figure|material)")
# Words that tell no passage from another.
TARGET_STOPWORDS = (
    "the", "of", "in", "a", "an", "and", "to", "on", "at", "for", "with", "by", "from", "into", "increased", "decreased", "altered", "impaired", "reduced", "elevated", "loss", "level", "levels", "activity", "expression", "cells", "cell",
    "response", "function")
# Identifiers and how lists of references look.
DOI = r"10\.\d{4,9}/[-._;()/:A-Za-z0-9]+"
DOI_TAIL = r"[.),;:\"'\]>]+$"
REFERENCE_HEADER = r"(?i)^\s*(references|bibliography|works cited|citations)\s*$"
CITATION_LINE, URL_LINE = r"^\s*(\[\d+\]|\d+\.)\s+", r"^\s*(https?://|10\.)"
#: Lines that precede those which may be taken for the first reference (fixed value).
REFERENCES_AFTER = 10


def plain(text: Column) -> Column:
    """The text with look-alike characters replaced, white space collapsed, in lower case: what quotations are compared by."""
    for seen, meant in LOOKALIKES.items():
        text = F.replace(text, F.lit(seen), F.lit(meant))
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def squashed(text: Column) -> Column:
    """``plain`` text without blanks, for PDFs that lost them."""
    return F.replace(plain(text), F.lit(" "), F.lit(""))


def heading_kind(line: Column) -> Column:
    """The kind of section that a line opens, ``other`` for headings of no known kind, null for lines that are none."""
    text = F.trim(line)
    letters = F.regexp_replace(text, r"[^\p{L}]", "")
    capitals = F.length(letters).between(3, 60) & (F.upper(letters) == letters) & (F.lower(letters) != letters)
    kind = F.when(text.rlike(NUMBERED_HEADING) | capitals, "other")
    for name, pattern in reversed(HEADINGS):
        kind = F.when(text.rlike(f"(?i){HEADING_PREFIX}{pattern}"), name).otherwise(kind)
    unfit = (text == "") | (F.length(text) > 90) | (text.rlike("[,;:]$") & (F.length(text) > 40))
    return F.when(~unfit, kind)


def find_doi(text: Column) -> Column:
    """The first DOI, one that is announced as such before others; in lower case, without closing punctuation."""
    announced = F.regexp_extract(text, rf"(?i)(?:https?://(?:dx\.)?doi\.org/|doi\s*[:=]\s*)({DOI})", 1)
    bare = F.regexp_extract(text, rf"(?i)\b({DOI})", 1)
    return F.nullif(F.lower(F.regexp_replace(F.coalesce(F.nullif(announced, F.lit("")), bare), DOI_TAIL, "")), F.lit(""))


def norm_doi(doi: Column) -> Column:
    """A DOI without resolver, announcement and closing full stops, in lower case; empty where there is none."""
    text = F.lower(F.regexp_replace(F.coalesce(doi, F.lit("")), r"^\s+|\s+$", ""))
    bare = F.regexp_replace(F.trim(F.regexp_replace(text, r"^(https?://(dx\.)?doi\.org/|doi:\s*)", "")), r"\.+$", "")
    return F.when(text.isin("", "nan", "none"), "").otherwise(bare)


def without_references(text: Column) -> Column:
    """The text up to a heading of references, or to the first later line that looks like a reference."""
    lines = F.split(text, "\n")
    opens = F.transform(lines, lambda line, i: line.rlike(REFERENCE_HEADER) | ((i > REFERENCES_AFTER) & (line.rlike(CITATION_LINE) | line.rlike(URL_LINE))))
    at = F.array_position(opens, True).cast("int")
    kept = F.regexp_replace(F.array_join(F.slice(lines, 1, F.greatest(at - 1, F.lit(0))), "\n"), r"^\s+|\s+$", "")
    return F.when(at > 0, kept).otherwise(text)


def weighted_hits(text: Column, terms: tuple[tuple[str, float], ...]) -> Column:
    """Sum of weights of the terms found, each repetition counting less than the one before."""
    total = F.lit(0.0)
    for pattern, weight in terms:
        n = F.regexp_count(text, F.lit(f"(?i){pattern}"))
        total = total + F.when(n > 0, F.lit(weight) * (1.0 + F.log(4.0, n))).otherwise(0.0)
    return total


def term_pattern(term: Column) -> Column:
    """A pattern that finds a term as a whole, with any blanks or hyphens between its words, and its plural."""
    text = F.lower(F.trim(term))
    escaped = F.regexp_replace(text, r"([^\p{L}\p{N}\s_-])", r"\\$1")
    joined = F.regexp_replace(F.regexp_replace(escaped, "-", r"[-‐-―\\s]"), " ", r"\\s+")
    return F.when(text != "", F.concat(F.lit("(?i)(?:^|[^A-Za-z0-9])("), joined, F.lit("s?)(?=[^A-Za-z0-9]|$)")))


def matches_term(text: Column, term: Column) -> Column:
    return F.coalesce(F.rlike(text, term_pattern(term)), F.lit(False))


def target_terms(label: Column) -> Column:
    """Words of a label that tell passages apart, the longest first."""
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce(label, F.lit(""))), "[^a-z0-9]+"), lambda w: (F.length(w) > 3) & ~w.isin(*TARGET_STOPWORDS)))
    return F.transform(F.sort_array(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda s: s["w"])


def coverage(text: Column, groups: list[Column]) -> Column:
    """How far a text speaks of each side: two different terms of a side are all that it can give; the mean of the sides."""
    low = F.lower(text)
    share = lambda terms: F.least(F.size(F.filter(terms, lambda t: matches_term(low, t))) / 2.0, F.lit(1.0))
    return reduce(lambda a, b: a + b, map(share, groups)) / len(groups)


def density(text: Column, kind: Column, groups: list[Column] | None = None) -> Column:
    """Weighted vocabulary per thousand characters, by section, and by how far the text speaks of what is looked for."""
    per_kb = F.greatest(F.lit(0.5), F.length(text) / 1000.0)
    score = (2.0 * weighted_hits(text, CAUSAL) + 1.5 * weighted_hits(text, BIOLOGY) + weighted_hits(text, QUANTITY)) / per_kb
    if groups:
        score = score * (0.15 + 1.85 * coverage(text, groups))
    noisy = reduce(lambda a, p: a | text.rlike(p), NOISE[1:], text.rlike(NOISE[0]))
    prior = F.lit(1.0)
    for name, weight in SECTION_PRIOR.items():
        prior = F.when(kind == name, weight).otherwise(prior)
    return score * F.when(noisy, 0.7).otherwise(1.0) * prior


# Fixed value: words that lead into a quotation's statement without being part of it.
LEAD_INS = (
    r"(?i)^(?:however|moreover|furthermore|additionally|in addition|notably|importantly|interestingly|therefore|thus|indeed|finally|overall|in contrast|by contrast|conversely|similarly|consistent with this)[,;:\s]+")


def clean_quote(quote: Column) -> Column:
    """A quotation without the marks around it, a chunk's header before it, and surplus blanks."""
    bare = F.regexp_replace(F.regexp_replace(quote, r"^\s+|\s+$", ""), '^["“”‘’]+|["“”‘’]+$', "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"^\s*\[[^\]]{0,60}\]\s*", ""), r"\s+", " "))


def quote_fingerprint(quote: Column) -> Column:
    """What quotations are told apart by: at most two lead-ins and punctuation don't count, nor what follows 160 characters."""
    text = F.regexp_replace(F.coalesce(quote, F.lit("")), r"^\s+|\s+$", "")
    for _ in range(2):
        text = F.regexp_replace(text, LEAD_INS, "")
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", " "), r"\s+", " ")), 1, 160)


def page_label(first: Column, last: Column) -> Column:
    """The pages of a passage as they are cited."""
    one = F.concat(F.lit("p. "), first.cast("string"))
    return F.when(first == last, one).otherwise(F.concat(F.lit("pp. "), first.cast("string"), F.lit("–"), last.cast("string")))
