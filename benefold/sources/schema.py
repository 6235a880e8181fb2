"""Types of the published tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

LINKS = "array<struct<title: string, uri: string>>"
# Columns of the seven small tables, and those of ``benefits`` that aren't text.
TABLES = {
    "statuses": {"status_id": "string", "name": "string", "type": "string", "min_age_months": "bigint", "max_age_months": "bigint", "code": "string"},
    "documents": {"doc_id": "string", "doc_name": "string", "original_name": "string", "is_probable_document": "boolean", "doc_url": "string"},
    "schemes": {"scheme_id": "string", "scheme_name": "string", "municipality_count": "bigint", "benefit_count": "bigint", "min_age_months": "bigint", "max_age_months": "bigint"},
    "benefit_in_scheme": {"benefit_id": "string", "scheme_id": "string"},
    "benefit_leads_to": {"from_benefit_id": "string", "to_benefit_id": "string", "relation": "string", "reason": "string"},
    "benefit_requires_status": {"benefit_id": "string", "status_id": "string"},
    "benefit_requires_doc": {"benefit_id": "string", "doc_id": "string"},
}
BENEFITS = {
    "bigint": "record_seq min_age_months max_age_months inferred_min_age_months inferred_max_age_months effective_min_age_months effective_max_age_months income_max_yen institution_type class_code",
    "date": "update_date od_update_date implementation_period_from_date implementation_period_to_date procedure_period_from_date procedure_period_to_date",
    "boolean": "income_max_inclusive has_free_text_conditions is_free electronic_submission use_consideration_flag is_prenatal requires_non_taxable requires_taxable requires_welfare excludes_welfare",
    "array<string>": "category_codes target_codes content_codes category_code_labels target_code_labels content_code_labels",
    LINKS: "related_links form_links embedded_links",
}
#: Ends of edges: table, its column, the table and column of the nodes.
EDGES = (
    ("benefit_requires_status", "benefit_id", "benefits", "benefit_id"), ("benefit_requires_status", "status_id", "statuses", "status_id"),
    ("benefit_requires_doc", "benefit_id", "benefits", "benefit_id"), ("benefit_requires_doc", "doc_id", "documents", "doc_id"),
    ("benefit_in_scheme", "benefit_id", "benefits", "benefit_id"), ("benefit_in_scheme", "scheme_id", "schemes", "scheme_id"),
    ("benefit_leads_to", "from_benefit_id", "benefits", "benefit_id"), ("benefit_leads_to", "to_benefit_id", "benefits", "benefit_id"),
)
#: Keys: table and columns that together name a row.
KEYS = (
    ("benefits", ("benefit_id",)), ("statuses", ("status_id",)), ("documents", ("doc_id",)), ("schemes", ("scheme_id",)), ("benefit_requires_status", ("benefit_id", "status_id")),
    ("benefit_requires_doc", ("benefit_id", "doc_id")), ("benefit_in_scheme", ("benefit_id", "scheme_id")), ("benefit_leads_to", ("from_benefit_id", "to_benefit_id", "relation")),
)


def typed(name: str, df: DataFrame) -> DataFrame:
    """``df`` with the columns and types of the published table of this name; an error names columns that are missing.

    Of ``benefits`` all columns are kept in their order, text unless listed; of the others those listed, where a documents' address may be missing. Other tables stay as they are.
    """
    if name not in TABLES and name != "benefits":
        return df
    if name == "benefits":
        kinds = {c: kind for kind, cols in BENEFITS.items() for c in cols.split()}
        return df.select(*(F.col(c).cast(kinds.get(c, "string")).alias(c) for c in df.columns))
    lost = [c for c in TABLES[name] if c not in df.columns and c != "doc_url"]
    if lost:
        raise ValueError(f"{name} lacks {', '.join(lost)}")
    return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in TABLES[name].items()))
