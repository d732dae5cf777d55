"""Schemas of the five metrics tables, of extracted documents, and of derived rows."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY, PERCENT, EPS = "decimal(15,2)", "decimal(5,2)", "decimal(10,4)"
#: The metrics of a fiscal year, in column order.
MONEY_COLUMNS = ["revenue", "cost_of_revenue", "gross_profit", "operating_expenses", "operating_income", "net_income", "total_assets", "total_liabilities", "total_equity", "cash_and_equivalents", "long_term_debt"]
PERCENT_COLUMNS = ["gross_margin", "operating_margin", "net_margin"]
EPS_COLUMNS = ["earnings_per_share", "diluted_eps"]
METRIC_COLUMNS = MONEY_COLUMNS + PERCENT_COLUMNS + EPS_COLUMNS


def _metrics(kind: str | None = None) -> str:
    kinds = [(c, kind or MONEY) for c in MONEY_COLUMNS] + [(c, kind or PERCENT) for c in PERCENT_COLUMNS] + [(c, kind or EPS) for c in EPS_COLUMNS]
    return ", ".join(f"{c} {k}" for c, k in kinds)


def _shares(what: str) -> str:
    return f"id int NOT NULL, company_id int NOT NULL, fiscal_year int NOT NULL, {what} string NOT NULL, revenue {MONEY}, percentage_of_total {PERCENT}, yoy_growth {PERCENT}, created_at timestamp"


#: Schemas as DDL, which needs no session to be read.
TABLES: dict[str, str] = {
    "companies": "id int NOT NULL, ticker string NOT NULL, name string NOT NULL, sector string, fiscal_year_end date, filing_date date, document_id string, created_at timestamp, updated_at timestamp",
    "financial_metrics": f"id int NOT NULL, company_id int NOT NULL, fiscal_year int NOT NULL, {_metrics()}, currency string NOT NULL, created_at timestamp",
    "segment_revenue": _shares("segment_name"),
    "geographic_revenue": _shares("region"),
    "risk_factors": "id int NOT NULL, company_id int NOT NULL, fiscal_year int NOT NULL, category string, title string, summary string, severity string, page_number int, created_at timestamp",
}
COLUMNS = {name: [part.split()[0] for part in re.split(r",\s*(?![^(]*\))", ddl)] for name, ddl in TABLES.items()}

_PAGE_METRICS = ", ".join(f"{c}: double" for c in METRIC_COLUMNS)
_SHARE = "revenue: double, fiscal_year: int, percentage_of_total: double"
_RISK = "category: string, title: string, summary: string, severity: string"
#: One extracted document; keys that an extraction left out are null.
DOCUMENT = (
    "document_id string, document_type string, filename string, extraction_date string, total_pages int, pages_processed int, estimated_cost_usd double,"
    " errors array<struct<page_number: int, error: string, error_type: string>>,"
    " metadata struct<ticker: string, company: string, sector: string, fiscal_year: int, document_type: string, headline: string, publication_date: string, source: string, source_type: string, entities_mentioned: array<string>>,"
    " pages array<struct<page_number: int, section: string, content_type: string, text: string,"
    " tables: array<struct<table_name: string, table_type: string, headers: array<string>, rows: array<struct<label: string, `values`: map<string, string>>>>>,"
    f" financial_metrics: struct<fiscal_year: int, {_PAGE_METRICS}, currency: string>,"
    f" segment_data: array<struct<segment_name: string, {_SHARE}>>, geographic_data: array<struct<region: string, {_SHARE}>>, risk_factors: array<struct<{_RISK}>>,"
    " cross_references: array<string>, document_type: string, headline: string, publication_date: string, source: string,"
    " key_claims: array<struct<claim: string, entities: array<string>>>, entities_mentioned: array<string>>>"
)
MANIFEST = (
    "doc_id string, source_file string, file_hash string, file_size_bytes bigint, extracted_at timestamp, page_count int, pages_processed int, extraction_cost_usd double, doc_type string,"
    " indexed boolean, indexed_at timestamp, chunk_count int, parent_count int, index_schema_version string, error_count int"
)

#: The kinds of entities and relations, and which kind a recogniser's label means.
ENTITY_TYPES = ["Document", "Organization", "Person", "Location", "Regulation", "Concept", "Product", "Date", "Money", "Percent"]
RELATION_TYPES = ["MENTIONS", "DEFINES", "GOVERNED_BY", "LOCATED_IN", "RELATED_TO", "WORKS_FOR", "COMPETES_WITH"]
LABELS = {
    "ORG": "Organization",
    "PERSON": "Person",
    "GPE": "Location",
    "DATE": "Date",
    "MONEY": "Money",
    "PERCENT": "Percent",
    "LAW": "Regulation",
    "PRODUCT": "Product",
    "LOC": "Location",
    "NORP": "Organization",
    "FAC": "Location",
    "EVENT": "Concept",
    "WORK_OF_ART": "Concept",
    "CARDINAL": "Concept",
    "ORDINAL": "Concept",
    "QUANTITY": "Concept",
    "TIME": "Date",
    "LANGUAGE": "Concept",
    "REGULATION": "Regulation",
    "CONCEPT": "Concept",
}


def entity_type(label: Column) -> Column:
    """The kind a recogniser's label means, null for unknown labels."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair)), F.upper(label))


def is_entity_type(name: str) -> bool:
    return name.title() in ENTITY_TYPES


def is_relation_type(name: str) -> bool:
    return name.upper() in RELATION_TYPES
