"""Text functions as column expressions: all run in the JVM, inside generated code where Spark allows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are no search terms.
STOPWORDS = (
    "a an the in on at to for of with by from as and or but if then i you he she it we they this that is are was were be been being have has had do does did will would could should can "
    "not no yes so just also very more most some any each every both other such what which who how about into over after before between under again further once"
).split()
#: Fixed values of the sparse encoder, of token estimates and of embedding input.
TOKEN, SHORTEST, BUCKETS = "[a-zA-Z0-9]+", 2, 2147483647
TOKENS_PER_WORD, EMBEDDED_CHARS = 1.3, 25_000
#: Answers that mean that a passage says nothing on the question.
NOT_RELEVANT, NOT_RELEVANT_BELOW = "NOT_RELEVANT", 50
NOT_RELEVANT_PHRASES = ["no relevant", "not relevant", "none relevant", "nothing relevant", "no sentences", "none of the sentences", "couldn't find", "could not find", "no content", "cannot find", "unable to find"]
#: In names with these, case is left as it is.
FIRM_WORDS = ["LLC", "INC", "CORP", "LTD", "PLC", "CEO", "CFO", "CTO"]
#: The context prefixes and what stands for missing metadata.
MISSING = {"company": "Unknown Company", "ticker": "N/A", "fiscal_year": "N/A", "total_pages": "?", "section": "Unknown Section", "start_page": "?", "source_type": "document", "source_name": "Unknown Source", "publication_date": "Unknown Date"}

WHITE = r"\s+"


def stripped(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def blank(text: Column) -> Column:
    return text.isNull() | (stripped(text) == "")


def tokens(text: Column) -> Column:
    """Search terms in order of the text, repeats included."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) >= SHORTEST) & ~t.isin(*STOPWORDS))


def bucket(token: Column) -> Column:
    """The index of a term: the first four bytes of its MD5, modulo a prime."""
    return F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint") % BUCKETS


def token_count(text: Column) -> Column:
    """Model tokens that a text is estimated to have; at least one unless it is empty."""
    words = F.size(F.filter(F.split(text, WHITE), lambda w: w != ""))
    return F.when(text.isNull() | (text == ""), 0).otherwise(F.greatest(F.lit(1), F.floor(words * F.lit(TOKENS_PER_WORD)).cast("int")))


def embedding_text(text: Column) -> Column:
    """White space collapsed, cut to what is embedded."""
    return F.substring(stripped(F.regexp_replace(text, WHITE, " ")), 1, EMBEDDED_CHARS)


def cache_key(text: Column) -> Column:
    return F.sha2(text, 256)


def document_id(name: Column) -> Column:
    """From a file name: its stem with anything but letters, digits, ``_`` and ``-`` as ``_``."""
    return F.regexp_replace(F.regexp_replace(name, r"(?s)(?<=.)\.[^.]*$", ""), r"(?U)[^\w\-]", "_")


def document_type(name: Column) -> Column:
    return F.when(name.rlike("(?i)_10K_"), "10k").otherwise("reference")


def is_10k(doc_type: Column, document_type: Column) -> Column:
    return F.contains(F.lower(F.coalesce(F.nullif(doc_type, F.lit("")), document_type, F.lit(""))), F.lit("10k"))


def _found(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def ticker_of_filing(doc_id: Column) -> Column:
    """The loader's rule: letters before ``_10K_`` and a year."""
    return _found(doc_id, r"^([A-Z]{1,5})_10[Kk]_\d{4}")


def ticker_of_name(doc_id: Column) -> Column:
    """The extractor's rule: letters before the first underscore."""
    return _found(doc_id, r"^([A-Z]{1,5})_")


def ticker_of_parts(doc_id: Column) -> Column:
    """The indexer's rule: the first part, if the second is 10K in any case."""
    parts = F.split(doc_id, "_")
    return F.when((F.size(parts) >= 3) & (F.upper(F.get(parts, F.lit(1))) == "10K"), F.get(parts, F.lit(0)))


def ticker_of_upper(doc_id: Column) -> Column:
    """The graph's rule: the first part, if it has two to five characters, all its letters upper case."""
    first = F.get(F.split(doc_id, "_"), F.lit(0))
    return F.when(F.length(first).between(2, 5) & (first == F.upper(first)) & (first != F.lower(first)), first)


def safe_decimal(text: Column, kind: str = "decimal(15,2)") -> Column:
    """A number out of text with commas and dollar signs; null for words that mean none."""
    plain = stripped(F.regexp_replace(text, "[,$]", ""))
    return F.when(~F.lower(plain).isin("", "null", "none", "n/a", "-"), plain).try_cast(kind)


def safe_int(text: Column) -> Column:
    """Whole numbers, and decimal ones cut to whole."""
    return text.try_cast("double").try_cast("int")


def filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.when(c != "", c) for c in columns))


#: How a cover page names its company, on a line of its own within so many characters.
COMPANY_CHARS = 3_000
COMPANY = r"(?i)\n([A-Z][A-Z\s&,.]+(?:CORPORATION|CORP|INC|LLC|LTD|COMPANY|CO)\.?)\s*\n"


def titled(text: Column) -> Column:
    """Every run of letters with a capital first."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.substr(r, F.lit(2)))), "")


def titled_words(text: Column) -> Column:
    """Every word with a capital first, where words end at spaces only."""
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), " ")


def company_of(text: Column, title: Callable[[Column], Column] = titled) -> Column:
    """The company that a cover page names, in title case but for LLC; null if it names none."""
    found = _found(F.substring(text, 1, COMPANY_CHARS), COMPANY)
    return F.replace(title(stripped(found)), F.lit("Llc"), F.lit("LLC"))


def _or_missing(columns: dict[str, Column], *names: str) -> list[Column]:
    return [F.coalesce(columns[n].cast("string"), F.lit(MISSING[n])) for n in names]


def filing_prefix(**columns: Column) -> Column:
    """Context of a filing's chunk: ``company, ticker, fiscal_year, section, start_page, total_pages``."""
    return F.format_string("[10-K Filing] [%s (%s)] [FY%s] [%s] [Page %s of %s]\n\n", *_or_missing(columns, "company", "ticker", "fiscal_year", "section", "start_page", "total_pages"))


def reference_prefix(**columns: Column) -> Column:
    """Context of another document's chunk: ``source_type, source_name, publication_date, headline``."""
    head = F.format_string("[%s] [%s] [%s]", *_or_missing(columns, "source_type", "source_name", "publication_date"))
    title = filled(columns["headline"])
    return F.concat(head, F.coalesce(F.concat(F.lit(" ["), title, F.lit("]")), F.lit("")), F.lit("\n\n"))


def entity_text(text: Column, kind: Column, title: Callable[[Column], Column] = F.initcap) -> Column:
    """A mention as it is stored: acronyms stay, lower-case names of people and firms get capitals."""
    flat = F.regexp_replace(stripped(text), WHITE, " ")
    firm = F.exists(F.array(*map(F.lit, FIRM_WORDS)), lambda w: F.contains(F.upper(flat), w))
    first = F.substring(flat, 1, 1)
    capital = (first == F.upper(first)) & (first != F.lower(first))
    named = F.lower(kind).isin("person", "organization")
    return F.when(flat.rlike("^[A-Z]{2,5}$") | flat.rlike("^[A-Z/]{2,10}$"), flat).when(named & ~firm & ~capital, title(flat)).otherwise(flat)


def citation(ticker: Column, document_type: Column, section: Column, fiscal_year: Column, start_page: Column, end_page: Column, source_name: Column, headline: Column) -> Column:
    year, start, end = safe_int(fiscal_year), safe_int(start_page), safe_int(end_page)
    page = F.when(start.isNotNull() & end.isNotNull() & (start != end), F.concat_ws("-", start.cast("string"), end.cast("string"))).otherwise(F.coalesce(start.cast("string"), F.lit("?")))
    who, where = F.coalesce(ticker, F.lit("Unknown")), F.coalesce(section, F.lit("Unknown Section"))
    filing = F.concat(who, F.lit(" 10-K"), F.when(year.isNotNull() & (year != 0), F.concat(F.lit(" "), year.cast("string"))).otherwise(""))
    source = F.coalesce(source_name, who)
    other = F.when(filled(headline).isNotNull(), F.concat(source, F.lit(": "), headline)).otherwise(F.concat(source, F.lit(", "), where))
    return F.concat(F.when(F.upper(F.coalesce(document_type, F.lit("document"))) == "10K", F.concat(filing, F.lit(", "), where)).otherwise(other), F.lit(", Page "), page)


def relevance(relevance_score: Column, score: Column) -> Column:
    scaled = F.least(F.lit(10), F.greatest(F.lit(1), F.floor(score * 10).cast("int")))
    value = F.coalesce(relevance_score.cast("int"), F.when(score > 0, scaled))
    return F.concat(F.coalesce(value.cast("string"), F.lit("?")), F.lit("/10"))


def preview(text: Column, most: int = 100) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def parsed_score(answer: Column) -> Column:
    """The first number of an answer, held to 1 to 10; 5 if it has none."""
    number = F.regexp_extract(answer, r"\b(\d+(?:\.\d+)?)\b", 1).try_cast("double")
    return F.when(number.isNotNull(), F.greatest(F.lit(1.0), F.least(F.lit(10.0), number))).otherwise(5.0)


def not_relevant(answer: Column) -> Column:
    said = F.lower(answer)
    short = (F.length(answer) < NOT_RELEVANT_BELOW) & F.exists(F.array(*map(F.lit, NOT_RELEVANT_PHRASES)), lambda p: F.contains(said, p))
    return blank(answer) | F.contains(F.upper(answer), F.lit(NOT_RELEVANT)) | short


def thinking(text: Column) -> tuple[Column, Column]:
    """The first thinking part of an answer, and the answer without any."""
    marked = text.rlike("(?is)<thinking>.*?</thinking>")
    return (
        F.when(marked, stripped(F.regexp_extract(text, "(?is)<thinking>(.*?)</thinking>", 1))),
        F.when(marked, stripped(F.regexp_replace(text, "(?is)<thinking>.*?</thinking>", ""))).otherwise(text),
    )


def without_fence(text: Column) -> Column:
    """An answer without the marks of a code block around it."""
    return stripped(F.regexp_replace(stripped(text), r"(?i)^```[a-z]*\s*|\s*```$", ""))


def epoch_text(seconds: Column) -> Column:
    """ISO text of a moment; a year of more than four digits has no sign."""
    return F.ltrim(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'+00:00'"), F.lit("+"))


def ticker_list(text: Column) -> Column:
    """Symbols of a comma-separated list, upper case, blanks dropped."""
    return F.filter(F.transform(F.split(text, ","), lambda t: F.upper(F.trim(t))), lambda t: t != "")


def metadata_bytes(metadata: Column) -> Column:
    return F.octet_length(F.to_json(metadata))


#: Dollars for each page extracted.
PAGE_COST = {"10k": 0.04, "reference": 0.025}


def extraction_cost(doc_type: Column, pages: Column) -> Column:
    rate = F.when(doc_type == "10k", PAGE_COST["10k"]).otherwise(PAGE_COST["reference"])
    return F.round(pages * rate, 4)


#: What a user is told of each kind of error, in the order in which the kinds are looked for.
ERRORS = [
    ("rate limit", ["rate limit", "429"], "Too many requests just now. Wait a few seconds and try again."),
    ("timeout", ["timeout", "timed out"], "This took too long. Try a smaller or more exact question."),
    ("tool", ["tool", "execute"], "A tool failed. Try to put the question another way."),
    ("model", ["model", "fallback"], "The model failed to answer. Please try again."),
]


def error_kind(message: Column) -> Column:
    """Which kind of error a message tells of, ``other`` if none."""
    said, kind = F.lower(message), None
    for name, words, _ in ERRORS:
        has = F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(said, w))
        kind = F.when(has, name) if kind is None else kind.when(has, name)
    return kind.otherwise("other")


def friendly_error(message: Column) -> Column:
    kind = error_kind(message)
    return F.coalesce(*(F.when(kind == name, text) for name, _, text in ERRORS), F.lit("Something went wrong. Please try again."))
