"""Named concepts: candidates from patterns and from tables of mentions, and their linking to knowledge-base tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Words that mark a concept, words that end its name, words too general to be one.
NOUNS = (
    "law|laws|theorem|theorems|principle|principles|theory|theories|hypothesis|hypotheses|model|models|equation|equations|algorithm|algorithms|"
    "effect|effects|phenomenon|phenomena|paradox|protocol|architecture|framework|method|methods|dataset|datasets|benchmark|benchmarks|"
    "database|databases|metric|metrics|measurement|measurements|software|technology|protein|gene|organism|material|materials|compound|compounds"
)
CUES = (
    "algorithm", "architecture", "benchmark", "database", "dataset", "effect", "equation", "framework", "hypothesis", "law", "method", "methods",
    "model", "models", "metric", "measurement", "organism", "paradox", "phenomenon", "principle", "protocol", "software", "technology", "theorem",
    "theorems", "theory", "theories",
)
# The classes of the knowledge base that a concept's item must be of, by id or by their label.
ALLOWED_TYPES = {
    "Q408891": "scientific law", "Q214070": "physical law", "Q1571031": "scientific principle", "Q3239681": "scientific theory", "Q65943": "theorem",
    "Q8366": "algorithm", "Q486902": "mathematical model", "Q11345": "equation", "Q1293220": "physical phenomenon", "Q46857": "scientific method",
}
ALLOWED_LABEL = (
    r"(?i)\b(?:scientific|physical|mathematical|programming|computational)\s+(?:law|principle|theory|model|equation|method|effect|phenomenon)\b"
    r"|\btheorem\b|\balgorithm\b|\b(?:software|system) architecture\b|\bprotocol\b|\b(?:dataset|benchmark|database|statistical method|measurement|metric)\b"
    r"|\b(?:scientific instrument|technology|software|programming language)\b|\b(?:biological process|protein|gene|organism|chemical compound|material)\b"
    r"|\b(?:scientist|researcher)\b"
)
#: The labels of named entities that may be concepts.
NER_LABELS = ("EVENT", "FAC", "GPE", "LAW", "LOC", "NORP", "ORG", "PERSON", "PRODUCT", "WORK_OF_ART", "LANGUAGE")
#: Characters of a text that are mined for concepts, and candidates that are looked up.
MOST_CHARS, MOST_CANDIDATES = 200_000, 24
STOPS = ("and", "can", "describes", "explains", "is", "provides", "shows", "states", "tests", "uses")
GENERIC = ("abstract", "article", "paper", "study", "the authors")
PREPOSITIONS = ("of", "in", "for", "on", "from")
WEIGHTS = {"pattern": 3, "ner": 2, "noun_phrase": 1}
_WORD = r"[A-Za-z0-9][A-Za-z0-9'’./-]*"


def _by_letter(words: str) -> str:
    """The alternatives grouped by first letter, in their order within it: the same matches with fewer trials."""
    groups: dict[str, list[str]] = {}
    for word in words.split("|"):
        groups.setdefault(word[0], []).append(word[1:])
    return "|".join(f"{letter}(?:{'|'.join(rest)})" for letter, rest in groups.items())


# a word before the concept word and the white space after it are taken whole, since no shorter part can match
PATTERN = (
    rf"(?i)\b((?:{_WORD}+\s++){{0,4}}(?:{_by_letter(NOUNS)})(?:\s+(?:of|in|for|on|from|the)\s+{_WORD}(?:\s+{_WORD}){{0,4}})?)\b"
)


def _bare(token: Column) -> Column:
    return F.regexp_replace(F.lower(token), r"^[.,;:()\[\]{}]+|[.,;:()\[\]{}]+$", "")


def is_cue(token: Column) -> Column:
    return _bare(token).isin(*CUES) | _bare(F.regexp_replace(F.lower(token), "s+$", "")).isin(*CUES)


def trim_term(term: Column) -> Column:
    """A pattern's match up to its last cue word, with a preposition and at most three words after it."""

    def cut(tokens: Column, last: Column) -> Column:
        rest = F.slice(tokens, last + 1, F.size(tokens))
        follows = F.coalesce(F.lower(F.try_element_at(rest, F.lit(1))).isin(*PREPOSITIONS), F.lit(False))
        after = F.slice(rest, 2, 3)
        stop = F.array_position(F.transform(after, lambda t: _bare(t).isin(*STOPS)), True)
        kept = F.when(stop > 0, F.slice(after, 1, (stop - 1).cast("int"))).otherwise(after)
        head = F.slice(tokens, 1, last)
        return F.when(last > 0, F.array_join(F.when(follows, F.concat(head, F.slice(rest, 1, 1), kept)).otherwise(head), " ")).otherwise(term)

    def last_cue(tokens: Column) -> Column:
        cues = F.reverse(F.transform(tokens, lambda t: F.coalesce(is_cue(t), F.lit(False))))
        return T.let(F.array_position(cues, True), lambda back: F.when(back > 0, F.size(tokens) - back + 1).otherwise(0).cast("int"))

    return T.let(F.split(T.squeeze(term), " "), lambda tokens: T.let(last_cue(tokens), lambda last: cut(tokens, last)))


def pattern_mentions(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, term, start_char, end_char, signal, entity_type: phrases that end in a concept word. Offsets of
    matches come from the lengths of the matches and of the texts between them."""
    # the matches are marked in one pass: the first part is a gap, each other one a match and the gap after it
    marked = F.regexp_replace(F.translate(F.col(text), "\x01\x02", "\x03\x03"), PATTERN, "\x01$1\x02")
    parts = docs.where(F.col(text).isNotNull()).select(doc, F.split(marked, "\x01", -1).alias("parts"))
    # the outer form keeps the optimiser from computing the matches once more for a filter of its own
    rows = parts.select(doc, "parts", F.posexplode_outer(F.slice("parts", 2, F.size("parts"))).alias("k", "part")).where("part is not null").select(
        doc, "k", F.substring_index("part", "\x02", 1).alias("match"),
        F.slice("parts", 1, F.col("k") + 1).alias("before"),
    )
    # each match before this one leaves one mark between it and its gap
    start = F.aggregate("before", F.lit(0), lambda n, x: n + F.length(x)) - F.col("k")
    term = F.filter(F.array(trim_term(F.col("match"))), lambda t: F.exists(F.split(t, r"\s+"), is_cue))
    return rows.select(doc, F.explode_outer(term).alias("term"), start.alias("start_char"), F.length("match").alias("size")).where("term is not null").select(
        doc, "term", "start_char", (F.col("start_char") + F.col("size")).alias("end_char"),
        F.lit("pattern").alias("signal"), F.lit("NAMED_CONCEPT").alias("entity_type"),
    )


def noun_phrases(phrases: DataFrame, docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc, term, start_char, end_char) of a table of noun phrases that may name a concept: two words
    or more, and repeated in the text, with an acronym, a hyphen or a cue word."""
    term = T.clean_term(F.col("term"))
    words = F.split(term, r"\s+")
    low = F.lower(term)
    times = (F.length(F.lower(F.col("__text"))) - F.length(F.replace(F.lower(F.col("__text")), low, F.lit("")))) / F.length(low)
    good = (times >= 2) | F.exists(words, lambda w: (F.length(w) >= 2) & (w == F.upper(w)) & w.rlike(r"\p{L}")) | term.rlike("[-–]") | F.exists(F.split(low, r"\s+"), lambda w: w.isin(*CUES))
    return (
        phrases.join(docs.select(doc, F.col(text).alias("__text")), doc)
        .where((F.size(words) >= 2) & good)
        .select(doc, term.alias("term"), "start_char", "end_char", F.lit("noun_phrase").alias("signal"), F.lit("NOUN_PHRASE").alias("entity_type"))
    )


def candidates(mentions: DataFrame, doc: str = "doc_id", top: int = 24) -> DataFrame:
    """The ``top`` ranked candidates of each document: doc, rank, term, entity_type, mentions, start_char, signals.

    Mentions of one folded term are one candidate; its form, type and place are of the first seen, named
    entities before noun phrases before patterns, then by place. Rank is by kinds of signal, then number of
    distinct spans, then place, then term.
    """
    clean = mentions.withColumn("term", T.clean_term(F.col("term"))).where(
        (F.length("term") >= 2) & F.col("term").rlike("[A-Za-z]") & ~F.lower("term").isin(*GENERIC)
    )
    seen = F.struct(F.when(F.col("signal") == "ner", 0).when(F.col("signal") == "noun_phrase", 1).otherwise(2), "start_char", "end_char")
    grouped = clean.groupBy(doc, F.lower("term").alias("key")).agg(
        F.min_by(F.struct("term", "entity_type", "start_char", "end_char"), seen).alias("first"),
        F.count_distinct(F.struct("start_char", "end_char")).alias("mentions"),
        F.array_sort(F.collect_set("signal")).alias("signals"),
    )
    weight = sum((F.when(F.array_contains("signals", s), w).otherwise(0) for s, w in WEIGHTS.items()), F.lit(0))
    rank = F.row_number().over(Window.partitionBy(doc).orderBy(weight.desc(), F.desc("mentions"), "first.start_char", "key"))
    return grouped.withColumn("rank", rank).where(F.col("rank") <= top).select(
        doc, "rank", F.col("first.term").alias("term"), F.col("first.entity_type").alias("entity_type"), "mentions",
        F.col("first.start_char").alias("start_char"), F.col("first.end_char").alias("end_char"), "signals",
    )


def link(cands: DataFrame, pages: DataFrame, items: DataFrame, refs: DataFrame | None = None, doc: str = "doc_id", most: int = 8) -> DataFrame:
    """Candidates linked to knowledge-base tables, the first ``most`` distinct items of each document.

    ``pages`` (term, rank, title, url, wikidata_id, description, is_disambiguation): the first page of a
    term, exact title first, then shared words, then given rank, that isn't a disambiguation and has an
    item; ``items`` (wikidata_id, label, description, concept_type, reference_urls); ``refs`` (title, url, and n, the
    place in the page, if known: links are taken in that order).
    Candidates without a page or an item are dropped. Equi-joins on folded term and on item.
    """
    term, name = F.split(F.lower("term"), " "), F.split(F.lower("title"), " ")
    ranked = pages.where("not coalesce(is_disambiguation, false) and wikidata_id is not null and length(url) > 0").withColumn(
        "k", F.row_number().over(Window.partitionBy(F.lower("term")).orderBy((F.lower("title") == F.lower("term")).desc(), F.size(F.array_intersect(term, name)).desc(), "rank", "title"))
    )
    hit = ranked.where("k = 1").select(F.lower("term").alias("key"), "title", "url", "wikidata_id", F.col("description").alias("page_description"))
    authority = None
    if refs is not None:
        at = refs if "n" in refs.columns else refs.withColumn("n", F.lit(0))
        authority = at.where(T.is_authority(F.col("url"))).groupBy("title").agg(F.array_sort(F.collect_list(F.struct("n", "url"))).alias("u"))
        authority = authority.select("title", F.slice(F.array_distinct(F.transform("u", lambda x: x["url"])), 1, 3).alias("authority_urls"))
    joined = cands.withColumn("key", F.lower("term")).join(hit, "key").join(items.withColumnRenamed("description", "item_description"), "wikidata_id")
    joined = joined.join(authority, "title", "left") if authority is not None else joined.withColumn("authority_urls", F.array().cast("array<string>"))
    sources = F.slice(F.array_distinct(F.concat(
        F.array("url"), F.array(F.concat(F.lit("https://www.wikidata.org/wiki/"), "wikidata_id")),
        F.coalesce("reference_urls", F.array().cast("array<string>")), F.coalesce("authority_urls", F.array().cast("array<string>")),
    )), 1, 6)
    strong = F.exists(sources, T.is_authority)
    once = F.row_number().over(Window.partitionBy(doc, "wikidata_id").orderBy("rank"))
    order = F.row_number().over(Window.partitionBy(doc).orderBy("rank"))
    return (
        joined.withColumn("once", once).where("once = 1").withColumn("n", order).where(F.col("n") <= most)
        .select(
            doc, F.col("n"), "term", "entity_type", "mentions", "start_char", "end_char", "concept_type", F.coalesce("item_description", "page_description").alias("description"),
            F.col("url").alias("wikipedia_url"), "wikidata_id", sources.alias("source_urls"),
            F.when(strong, "source_supported").otherwise("classified").alias("recognition_status"),
            F.least(F.lit(0.92), F.lit(0.72) + F.size("signals") * 0.05 + F.when(strong, 0.08).otherwise(0.0)).alias("confidence"),
        )
    )


_CLAIM = (
    "struct<mainsnak:struct<property:string,datavalue:struct<value:string>>,"
    "references:array<struct<snaks:map<string,array<struct<datavalue:struct<value:string>>>>>>>"
)


def _claims(entities: DataFrame, key: str, json: str) -> DataFrame:
    """key, property and claim of every claim in the JSON map of properties to lists of claims, in the map's order."""
    parsed = entities.select(key, F.explode(F.map_entries(F.from_json(json, f"map<string,array<{_CLAIM}>>"))).alias("e"))
    return parsed.select(key, F.col("e.key").alias("property"), F.posexplode("e.value").alias("n", "claim"))


def claim_items(entities: DataFrame, key: str = "wikidata_id", json: str = "claims") -> DataFrame:
    """key and item_id: what an item is an instance or a subclass of, from its JSON claims."""
    value = F.get_json_object(F.col("claim.mainsnak.datavalue.value"), "$.id")
    return _claims(entities, key, json).where(F.col("property").isin("P31", "P279")).select(key, value.alias("item_id")).where("item_id is not null").distinct()


def claim_references(entities: DataFrame, key: str = "wikidata_id", json: str = "claims", most: int = 3) -> DataFrame:
    """key and reference_urls: the first distinct addresses that an item's claims refer to, in the claims' order: the
    reference addresses (P854) of each claim, then its own DOI (P356). Items without any have no row."""
    parsed = entities.select(key, F.map_entries(F.from_json(json, f"map<string,array<{_CLAIM}>>")).alias("m"))
    none = F.array().cast("array<string>")

    def of_claim(c: Column) -> Column:
        snaks = F.flatten(F.transform(F.coalesce(c["references"], F.array().cast("array<struct<snaks:map<string,array<struct<datavalue:struct<value:string>>>>>>")), lambda r: F.coalesce(
            F.transform(F.try_element_at(r["snaks"], F.lit("P854")), lambda x: x["datavalue"]["value"]), none)))
        doi = F.when(c["mainsnak"]["property"] == "P356", F.array(F.concat(F.lit("https://doi.org/"), c["mainsnak"]["datavalue"]["value"])))
        return F.concat(F.filter(snaks, lambda u: u.startswith("http")), F.coalesce(doi, none))

    urls = F.flatten(F.transform("m", lambda e: F.flatten(F.transform(F.coalesce(e["value"], F.array().cast(f"array<{_CLAIM}>")), of_claim))))
    return parsed.select(key, F.slice(F.array_distinct(F.filter(urls, lambda u: u.isNotNull())), 1, most).alias("reference_urls")).where(F.size("reference_urls") > 0)


def typed_items(items: DataFrame, types: DataFrame, labels: DataFrame | None = None, key: str = "wikidata_id") -> DataFrame:
    """The items that are of an allowed class, with ``concept_type``: the label of the first such class by id.

    ``types`` (key, item_id) are the classes of each item, ``labels`` (item_id, label) the classes' names; a class
    is allowed by its id or by its label. Items of no allowed class are dropped."""
    known = F.create_map(*(F.lit(x) for kv in ALLOWED_TYPES.items() for x in kv))
    own = types.select(key, "item_id").distinct()
    named = own.join(labels.groupBy("item_id").agg(F.min("label").alias("label")), "item_id", "left") if labels is not None else own.withColumn("label", F.lit(None).cast("string"))
    named = named.withColumn("label", F.coalesce("label", F.try_element_at(known, F.col("item_id")), F.lit("")))
    good = named.where(F.col("item_id").isin(*ALLOWED_TYPES) | F.col("label").rlike(ALLOWED_LABEL))
    first = good.groupBy(key).agg(F.min_by(F.nullif("label", F.lit("")), "item_id").alias("concept_type"))
    return items.drop("concept_type").join(first.withColumn("concept_type", F.coalesce("concept_type", F.lit("scientific concept"))), key)


def named_entities(mentions: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Rows (doc, term, start_char, end_char, label) of a table of named entities whose label may be a concept's."""
    return mentions.where(F.col("label").isin(*NER_LABELS)).select(
        doc, "term", "start_char", "end_char", F.lit("ner").alias("signal"), F.col("label").alias("entity_type")
    )


def named_concepts(
    docs: DataFrame, pages: DataFrame, items: DataFrame, refs: DataFrame | None = None, ner: DataFrame | None = None, phrases: DataFrame | None = None,
    doc: str = "doc_id", text: str = "text", most: int = 8,
) -> DataFrame:
    """The named concepts of each document: candidates of its first ``MOST_CHARS`` characters, by patterns and, if
    given, from tables of named entities and noun phrases; the first ``MOST_CANDIDATES`` linked to the
    knowledge base (see ``link``), at most ``most`` distinct items, each with the excerpt around its first mention.
    Null and blank texts have none."""
    bounded = docs.select(doc, F.substring(text, 1, MOST_CHARS).alias("__text")).where(F.length(F.trim("__text")) > 0)
    mentions = pattern_mentions(bounded, doc, "__text")
    if phrases is not None:
        mentions = mentions.unionByName(noun_phrases(phrases, bounded, doc, "__text"))
    if ner is not None:
        mentions = mentions.unionByName(named_entities(ner, doc))
    linked = link(candidates(mentions, doc, MOST_CANDIDATES), pages, items, refs, doc, most)
    return linked.join(bounded, doc).withColumn("excerpt", T.around(F.col("__text"), F.col("start_char"), F.col("end_char"))).withColumn(
        "offset_location", T.offset_location(F.col("__text"), F.col("start_char"))
    ).drop("__text")
