"""Text shaping as column expressions; nothing here leaves the JVM. Nulls give nulls unless said otherwise."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and words of the result's definition.
STOP_HEADING = (
    r"(?i)^\s*(?:\d+(?:\.\d+)*[\s.)-]+)?(?:references|bibliography|works cited|acknowledg(?:e)?ments|funding|author contributions|"
    r"data availability|conflict of interest|supplement(?:ary|al)(?: material)?|appendix|appendices)\s*:?[\s.]*$"
)
PAGE_NUMBER = r"(?i)^(?:page\s+)?\d+(?:\s*(?:of|/|-)\s*\d+)?$"
BOILERPLATE = r"(?i)^(?:downloaded from|this content is|all rights reserved|copyright\s|©|licensed under|published by|available at\s+https?://)"
SECTION = (
    r"(?i)^\s*(?:\d+(?:\.\d+)*[\s.)-]+)?(abstract|introduction|background|related work|literature review|method|methods|methodology|"
    r"approach|materials and methods|experiments?|evaluation|results?|findings?|discussion|conclusion|limitations?)\s*:?[\s.]*$"
)
BROWSER_ERRORS = (
    "a required part of this site couldn't load", "a required part of this site could not load", "a required part of this site couldn",
    "this may be due to a browser", "enable javascript to continue", "please enable javascript", "access denied", "verify you are human",
    "checking your browser", "cf-chl-",
)
COMPARISON_STOPWORDS = (
    "about", "after", "against", "also", "been", "being", "between", "from", "have", "into", "more", "most", "only", "over", "paper", "propose",
    "proposed", "research", "shows", "that", "their", "there", "these", "they", "this", "using", "with", "which", "will",
)
AUTHORITY_DOMAINS = (
    "acm.org", "annualreviews.org", "aps.org", "arxiv.org", "britannica.com", "cambridge.org", "cern.ch", "doi.org", "ieee.org", "jstor.org",
    "nature.com", "ncbi.nlm.nih.gov", "nih.gov", "nasa.gov", "oup.com", "plos.org", "royalsocietypublishing.org", "science.org",
    "sciencedirect.com", "sciencemag.org", "springer.com", "wiley.com",
)
RELATIONSHIPS = (
    ("contradicts", r"\b(?:contradict|challenge|disagree|fails? to|cannot|worse than)\b"),
    ("extends", r"\b(?:extend|extends|build(?:s)? on|adapt(?:s)?|improve(?:s)? on)\b"),
    ("supports", r"\b(?:support(?:s)?|confirm(?:s)?|consistent with|agree(?:s)? with)\b"),
)
#: Where a text's lines end, and white space of any kind, as a class.
LINE_BREAK = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}]"
BLANKS = r"[\s\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
SUBJECT = r"(?i)\b(?:on|using|across|with)\s+(?:the\s+)?([^.;,:]+)"
SUBJECT_STOP = r"(?i)\s+(?:to|for|that|which|and|compared|versus|against)\s+.*$"
AFTER_CUE = r"\w*\b\s+(?:(?:a|an|the|our|this|their)\b)?\s*([^.;,:]+)"
PHRASE_STOP = r"(?i)\s+(?:to|for|on|across|from|that|which|while|using|with|and|compared|versus|against|relative)\s+.*$"
COMPARISON_WORD = r"([a-z][a-z0-9-]{3,})"
SEARCH_WORD = r"[a-z0-9][a-z0-9-]{2,}"
HREF = r"href=[\"'](https?://[^\"']+)[\"']"
ARTICLE = r"(?i)^(?:the|a|an)\s+"
YEAR = r"\b(?:19|20)\d{2}\b"
EVALUATION_CUES = ("evaluate", "experiment", "benchmark", "test", "measure")
METRIC_WORD = r"(?i)\b(?:accuracy|precision|recall|F1(?:-score)?|AUC|BLEU|ROUGE|score|error|loss|latency|runtime|reduction|improvement)\b"
METRIC_NUMBER = r"[+-]?\d+(?:\.\d+)?\s*(?:%|percent|percentage points)?"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold(c: Column) -> Column:
    """Lower case; the sharp s and Latin ligatures as letters."""
    for sign, letters in (("ß", "ss"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff")):
        c = F.replace(c, F.lit(sign), F.lit(letters))
    return F.lower(c)


def squeeze(c: Column) -> Column:
    """Each run of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, BLANKS + "+", " "))


def lines(text: Column) -> Column:
    """The lines of a text, whatever ends them."""
    return F.split(text, LINE_BREAK)


def compact(c: Column, limit: int = 280) -> Column:
    """Squeezed, and beyond ``limit`` cut before the last part of a word, with an ellipsis."""

    def short(clean: Column) -> Column:
        cut = F.regexp_replace(F.regexp_replace(F.substring(clean, 1, limit - 1), r" [^ ]*$", ""), r"[ ,;:]+$", "")
        return F.when(F.length(clean) <= limit, clean).otherwise(F.concat(cut, F.lit("…")))

    return let(squeeze(c), short)


def edge_key(line: Column) -> Column:
    """A line's key for repeated page edges: folded, its numbers masked."""
    return F.trim(F.regexp_replace(fold(line), r"\b\d+\b", "#"))


def is_meaningful(text: Column) -> Column:
    return (F.length(F.trim(text)) >= 240) | (F.length(F.regexp_replace(text, r"[^\p{L}]", "")) >= 120)


def is_browser_error(html: Column) -> Column:
    return fold(html).rlike("|".join(re.escape(m).replace(r"\ ", " ").replace(r"\'", "'") for m in BROWSER_ERRORS))


def sentences(line: Column) -> Column:
    """Sentences of a squeezed line: cut after a stop before a capital, a digit or a bracket."""
    return F.filter(F.transform(F.split(line, r"(?<=[.!?])\s+(?=[A-Z0-9(])"), lambda s: F.trim(s)), lambda s: F.length(s) > 0)


def title(text: Column, default: str = "Imported research paper") -> Column:
    """The first line of 4 to 140 characters, without blanks and marks around it."""
    found = F.transform(lines(text), lambda x: F.regexp_replace(x, r"^[ #\t]+|[ #\t]+$", ""))
    return F.coalesce(F.try_element_at(F.filter(found, lambda x: F.length(x).between(4, 140)), F.lit(1)), F.lit(default))


def year(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, YEAR, 0), F.lit("")).cast("int")


def comparison_terms(text: Column) -> Column:
    """Distinct words of four and more characters, without common ones."""
    words = F.regexp_extract_all(fold(text), F.lit(COMPARISON_WORD), F.lit(1))
    return F.array_except(F.array_distinct(words), F.array(*map(F.lit, COMPARISON_STOPWORDS)))


def relationship(text: Column) -> Column:
    """What a paper's own words say of its relation to earlier work; the first pattern decides."""
    out = F.lit("similar")
    for name, pattern in reversed(RELATIONSHIPS):
        out = F.when(fold(text).rlike(pattern), name).otherwise(out)
    return out


def for_match(text: Column) -> Column:
    return squeeze(F.replace(fold(text), F.lit("…"), F.lit("")))


def holds(within: Column, wanted: Column) -> Column:
    """Whether ``wanted``, or its first 180 characters less the last word, stands in ``within``; both are
    ``for_match`` of a text. Null and empty ones don't."""
    prefix = F.trim(F.regexp_replace(F.substring(wanted, 1, 180), r" [^ ]*$", ""))
    found = (F.length(wanted) > 0) & (F.contains(within, wanted) | ((F.length(prefix) >= 40) & F.contains(within, prefix)))
    return F.coalesce(found, F.lit(False))


def is_anchored(excerpt: Column, source: Column) -> Column:
    """Whether an excerpt, or its first 180 characters less the last word, stands in the source. Null and
    empty ones don't."""
    return holds(for_match(source), for_match(excerpt))


def is_web_address(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("PROTOCOL")).isin("http", "https") & (F.length(F.try_parse_url(url, F.lit("HOST"))) > 0), F.lit(False))


def source_type(source: Column) -> Column:
    return F.when(source.rlike(r"(?i)^https?://"), "url").otherwise("text")


def is_authority(url: Column) -> Column:
    """Academic and government hosts, and known publishers with their subdomains."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    known = reduce(lambda a, b: a | b, ((host == d) | host.endswith("." + d) for d in AUTHORITY_DOMAINS))
    return F.coalesce(host.rlike(r"\.(edu|gov|ac\.uk)$") | known, F.lit(False))


def clean_term(term: Column) -> Column:
    """A term without punctuation around it and without a leading article."""
    bare = F.regexp_replace(F.regexp_replace(term, r"\s+", " "), r"^[ \t\r\n,.;:()\[\]{}]+|[ \t\r\n,.;:()\[\]{}]+$", "")
    return F.regexp_replace(bare, ARTICLE, "")


def around(text: Column, start: Column, end: Column, before: int = 180, after: int = 220) -> Column:
    """The text around a span (from 0, end exclusive), squeezed."""
    first = F.greatest(start - before, F.lit(0))
    return squeeze(F.substring(text, first + 1, end + after - first))


def phrase_after(sentence: Column, cues: tuple[str, ...], limit: int = 64) -> Column:
    """What follows the first cue (a word's beginning) and an article, up to punctuation or a preposition;
    null below four characters. The article needs a word boundary."""
    match = rf"(?i)\b(?:{'|'.join(cues)}){AFTER_CUE}"
    phrase = F.regexp_replace(compact(F.regexp_replace(F.regexp_extract(sentence, match, 1), PHRASE_STOP, ""), limit), r"^[ .,]+|[ .,]+$", "")
    return let(phrase, lambda p: F.when(F.length(p) >= 4, p))


def capitalised(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), c.substr(F.lit(2), F.length(c)))


def label(sentence: Column, cues: tuple[str, ...], default: str) -> Column:
    """A short name: the phrase after a cue, else the first eight words, else the sentence."""
    whole = F.nullif(F.regexp_replace(sentence, r"\.+$", ""), F.lit(""))

    def first(words: Column) -> Column:
        head = F.concat(F.regexp_replace(compact(F.array_join(F.slice(words, 1, 8), " "), 58), r"[.,]+$", ""), F.lit("…"))
        return F.when(F.size(words) > 8, head).otherwise(whole)

    return F.coalesce(let(phrase_after(sentence, cues), capitalised), let(F.split(squeeze(sentence), " "), first), F.lit(default))


def metric_label(sentence: Column) -> Column:
    """The first measure named and the first number with its unit; null without a measure."""
    word = F.nullif(F.regexp_extract(sentence, METRIC_WORD, 0), F.lit(""))
    number = F.nullif(F.trim(F.regexp_extract(sentence, METRIC_NUMBER, 0)), F.lit(""))
    return let(word, lambda w: F.coalesce(F.concat(w, F.lit(" ("), number, F.lit(")")), w))


def experiment_label(sentence: Column) -> Column:
    """What a test was made on or with, else as ``label``."""
    subject = F.regexp_extract(sentence, SUBJECT, 1)
    subject = F.regexp_replace(subject, SUBJECT_STOP, "")
    subject = F.regexp_replace(compact(subject, 58), r"^[ .,]+|[ .,]+$", "")
    other = label(sentence, EVALUATION_CUES, "Evaluation described in the paper")
    return let(subject, lambda x: F.when(F.length(x) >= 4, capitalised(x)).otherwise(other))


def location(text: Column, excerpt: Column, section: Column) -> Column:
    """"Results section, line 4": the first line that holds the excerpt's first eight or four words."""
    words = F.split(fold(squeeze(excerpt)), " ")
    eight, four = F.array_join(F.slice(words, 1, 8), " "), F.array_join(F.slice(words, 1, 4), " ")
    found = F.transform(lines(text), lambda x: F.contains(fold(squeeze(x)), eight) | F.contains(fold(squeeze(x)), four))
    line = F.nullif(F.array_position(found, True), F.lit(0))
    where = F.coalesce(F.concat(F.lit(", line "), line.cast("string")), F.lit(", filtered paper text"))
    return F.concat(F.initcap(section), F.lit(" section"), where)


def offset_location(text: Column, offset: Column) -> Column:
    safe = F.greatest(F.lit(0), F.least(offset, F.length(text)))
    line = F.size(F.split(text.substr(F.lit(1), safe), r"\n", -1))
    return F.concat(F.lit("line "), line.cast("string"), F.lit(" (character "), safe.cast("string"), F.lit(")"))


def search(text: Column, query: str, before: int = 120, after: int = 240, most: int = 3) -> Column:
    """Up to three distinct excerpts: at the whole phrase, then at each of its words. A blank query finds nothing."""
    phrase = (query or "").strip().lower()
    terms = [phrase, *re.findall(SEARCH_WORD, phrase)] if phrase else []
    if not terms:
        return F.array().cast("array<string>")
    low = F.lower(text)

    def excerpt(term: str) -> Column:
        at = F.instr(low, term)
        first = F.greatest(at - 1 - before, F.lit(0))
        return F.when(at > 0, squeeze(text.substr(first + 1, at - 1 + after - first)))

    found = F.filter(F.array(*map(excerpt, terms)), lambda x: F.length(x) > 0)
    return F.slice(F.array_distinct(found), 1, most)


#: The entities that addresses in markup are written with.
ENTITIES = (("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&#x2F;", "/"), ("&#47;", "/"), ("&#38;", "&"), ("&#x26;", "&"), ("&amp;", "&"))


def hrefs(html: Column, most: int = 3) -> Column:
    """The first distinct links to authorities."""

    def plain(x: Column) -> Column:
        return reduce(lambda y, e: F.replace(y, F.lit(e[0]), F.lit(e[1])), ENTITIES, x)

    links = F.transform(F.regexp_extract_all(html, F.lit(HREF), F.lit(1)), plain)
    return F.slice(F.array_distinct(F.filter(links, is_authority)), 1, most)
