"""Row shapes and fixed values shared by every operator.

The tuples and maps below are fixed values of the data format: enum members, column
orders, code tables. They are stated as data so that results stay comparable.
"""
from __future__ import annotations

from pyspark.sql import types as T

GRAPH_SCHEMA_VERSION = "deal_graph_v2"
CLAIM_SCHEMA_VERSION = "deal_graph_claims_v1"
RUN_SCHEMA_VERSION = "audit_run_v3"
LATEST_SCHEMA_VERSION = "audit_v3"
RAW_RESPONSE_SCHEMA_VERSION = "raw_response_v3"
VALIDATION_SCHEMA_VERSION = "validation_v1"
PROOF_SCHEMA_VERSION = "target_gate_proof_v3"
PROGRESS_SCHEMA_VERSION = "v1"

TRUSTED_STATUSES = ("passed_clean", "needs_review", "high_burden")
FAILURE_STATUSES = ("failed_system", "stale_after_failure")
ALL_STATUSES = TRUSTED_STATUSES + FAILURE_STATUSES
SUPPORTED_DISPOSITIONS = ("supported", "merged_duplicate")
HISTORY_CAP = 10

# ---- enums of the claim payload ------------------------------------------------------
CONFIDENCE = ("high", "medium", "low")
ACTOR_KIND = ("organization", "person", "group", "vehicle", "cohort", "committee")
OBSERVABILITY = ("named", "anonymous_handle", "count_only")
EVENT_TYPE = ("process", "bid", "transaction")
EVENT_SUBTYPE = (
    "contact_initial", "nda_signed", "consortium_ca_signed", "ioi_submitted", "first_round_bid",
    "final_round_bid", "exclusivity_grant", "merger_agreement_executed", "withdrawn_by_bidder",
    "excluded_by_target", "non_responsive", "cohort_closure", "advancement_admitted",
    "advancement_declined", "rollover_executed", "financing_committed", "go_shop_started",
    "go_shop_ended",
)
BID_STAGE = ("initial", "revised", "final", "unspecified")
BID_VALUE_UNIT = ("per_share", "enterprise_value", "equity_value", "unspecified")
CONSIDERATION_TYPE = ("cash", "stock", "mixed", "other", "unspecified")
PROCESS_STAGE = ("contacted", "nda_signed", "ioi_submitted", "first_round", "final_round", "exclusivity")
ACTOR_CLASS = ("financial", "strategic", "mixed", "unknown")
COUNT_QUALIFIER = ("exact", "at_least", "at_most", "range", "approximate")
RELATION_TYPE = (
    "member_of", "joins_group", "exits_group", "affiliate_of", "controls", "acquisition_vehicle_of",
    "advises", "finances", "supports", "voting_support_for", "rollover_holder_for",
)
# Fields the engine owns; a payload that carries one is rejected.
FORBIDDEN_FIELDS = (
    "coverage_results", "BidderID", "T", "bI", "bF", "admitted", "dropout_outcome", "projection_rows",
    "canonical_id", "actor_id", "event_id", "relation_id", "source_offset", "char_start", "char_end",
    "bidder_class", "formal_boundary",
)

# ---- claim families: field -> rule ---------------------------------------------------
# Rule: (json types, allowed values or None). Order of families is the claim order.
_COMMON = {
    "coverage_obligation_id": (("string",), None),
    "confidence": (("string",), CONFIDENCE),
    "evidence_refs": (("array",), None),
}
CLAIM_FAMILIES: dict[str, dict] = {
    "actor_claims": {
        "claim_type": "actor",
        "fields": {
            "claim_type": (("string",), ("actor",)),
            "actor_label": (("string",), None),
            "actor_kind": (("string",), ACTOR_KIND),
            "observability": (("string",), OBSERVABILITY),
            "actor_class": (("string",), ACTOR_CLASS),
            **_COMMON,
        },
    },
    "actor_relation_claims": {
        "claim_type": "actor_relation",
        "fields": {
            "claim_type": (("string",), ("actor_relation",)),
            "subject_label": (("string",), None),
            "object_label": (("string",), None),
            "relation_type": (("string",), RELATION_TYPE),
            "role_detail": (("string", "null"), None),
            "effective_date_first": (("string", "null"), None),
            **_COMMON,
        },
    },
    "event_claims": {
        "claim_type": "event",
        "fields": {
            "claim_type": (("string",), ("event",)),
            "event_type": (("string",), EVENT_TYPE),
            "event_subtype": (("string",), EVENT_SUBTYPE),
            "event_date": (("string", "null"), None),
            "description": (("string",), None),
            "actor_label": (("string", "null"), None),
            "actor_role": (("string", "null"), None),
            **_COMMON,
        },
    },
    "bid_claims": {
        "claim_type": "bid",
        "fields": {
            "claim_type": (("string",), ("bid",)),
            "bidder_label": (("string",), None),
            "bid_date": (("string", "null"), None),
            "bid_value": (("number", "null"), None),
            "bid_value_lower": (("number", "null"), None),
            "bid_value_upper": (("number", "null"), None),
            "bid_value_unit": (("string", "null"), BID_VALUE_UNIT),
            "consideration_type": (("string", "null"), CONSIDERATION_TYPE),
            "bid_stage": (("string",), BID_STAGE),
            **_COMMON,
        },
    },
    "participation_count_claims": {
        "claim_type": "participation_count",
        "fields": {
            "claim_type": (("string",), ("participation_count",)),
            "process_stage": (("string",), PROCESS_STAGE),
            "actor_class": (("string",), ACTOR_CLASS),
            "count_min": (("integer",), None),
            "count_max": (("integer", "null"), None),
            "count_qualifier": (("string",), COUNT_QUALIFIER),
            **_COMMON,
        },
    },
}
FAMILY_BY_TYPE = {spec["claim_type"]: family for family, spec in CLAIM_FAMILIES.items()}
MAX_QUOTE_CHARS = 1500

EVIDENCE_REF = T.StructType([
    T.StructField("citation_unit_id", T.StringType()),
    T.StructField("quote_text", T.StringType()),
])
_FIELD_TYPES = {
    "bid_value": T.DoubleType(), "bid_value_lower": T.DoubleType(), "bid_value_upper": T.DoubleType(),
    "count_min": T.IntegerType(), "count_max": T.IntegerType(),
    "evidence_refs": T.ArrayType(EVIDENCE_REF),
}


def family_struct(family: str) -> T.StructType:
    """The Spark struct of one claim of a family; fields in name order, as in stable JSON."""
    names = sorted(CLAIM_FAMILIES[family]["fields"])
    return T.StructType([T.StructField(n, _FIELD_TYPES.get(n, T.StringType())) for n in names])


PAYLOAD = T.StructType([
    T.StructField(family, T.ArrayType(family_struct(family))) for family in CLAIM_FAMILIES
])
# Every field any family may carry, once: the wide claim row.
CLAIM_FIELDS: dict[str, T.DataType] = {}
for _family in CLAIM_FAMILIES:
    for _f in family_struct(_family):
        CLAIM_FIELDS.setdefault(_f.name, _f.dataType)
CLAIM_FIELDS.pop("claim_type")
# Optional fields that a hand-made claim row may carry in addition.
CLAIM_EXTRA_FIELDS = {"effective_date_last": T.StringType()}

# ---- ledger code tables --------------------------------------------------------------
# subtype -> (family, code, stage, formality, dropout side)
EVENT_CODES = {
    "contact_initial": ("contact", "initial_contact", "pre_bid", None, None),
    "nda_signed": ("process", "nda_signed", "nda", None, None),
    "consortium_ca_signed": ("consortium", "consortium_ca_signed", "nda", None, None),
    "ioi_submitted": ("bid", "ioi_submitted", "initial", "informal", None),
    "first_round_bid": ("bid", "bid_submitted", "initial", "informal", None),
    "final_round_bid": ("bid", "bid_submitted", "final_round", "formal", None),
    "exclusivity_grant": ("agreement", "exclusivity_granted", "exclusivity", None, None),
    "merger_agreement_executed": ("agreement", "merger_agreement_executed", "execution", None, None),
    "withdrawn_by_bidder": ("dropout", "bidder_withdrew", "dropout", None, "bidder"),
    "excluded_by_target": ("dropout", "target_excluded", "dropout", None, "target"),
    "non_responsive": ("dropout", "no_response", "dropout", None, "no_response"),
    "cohort_closure": ("dropout", "cohort_closed", "dropout", None, "mixed_or_unknown"),
    "advancement_admitted": ("advancement", "advanced", "advancement", None, None),
    "advancement_declined": ("advancement", "not_advanced", "advancement", None, None),
    "rollover_executed": ("support", "rollover_executed", "support", None, None),
    "financing_committed": ("financing", "financing_committed", "financing", None, None),
    "go_shop_started": ("go_shop", "go_shop_started", "go_shop", None, None),
    "go_shop_ended": ("go_shop", "go_shop_ended", "go_shop", None, None),
}
# relation type -> (family, code, stage); other relation types do not reach the ledger
RELATION_CODES = {
    "advises": ("advisor", "advisor_retained", "process_setup"),
    "finances": ("financing", "financing_relation", "financing"),
    "supports": ("support", "support_agreement", "support"),
    "voting_support_for": ("support", "voting_support", "support"),
    "rollover_holder_for": ("support", "rollover_support", "support"),
    "joins_group": ("consortium", "joined_group", "consortium"),
    "exits_group": ("consortium", "exited_group", "consortium"),
}
CODE_PRIORITY = {
    "advisor_retained": 10, "initial_contact": 20, "nda_signed": 30, "ioi_submitted": 40,
    "bid_submitted": 50, "advanced": 60, "not_advanced": 65, "target_excluded": 70,
    "bidder_withdrew": 75, "no_response": 80, "exclusivity_granted": 90,
    "financing_committed": 100, "merger_agreement_executed": 120, "participation_count": 900,
}
DEFAULT_PRIORITY = 500
RELATION_MARKERS = {
    "member_of": ("member", "together", "refer to as", "part of"),
    "joins_group": ("join", "joined", "became part", "together"),
    "exits_group": ("exit", "withdrew", "left"),
    "affiliate_of": ("affiliate", "affiliated"),
    "controls": ("control", "controls", "controlled"),
    "acquisition_vehicle_of": ("vehicle", "acquisition vehicle"),
    "advises": ("advise", "advisor", "advised"),
    "finances": ("finance", "financing", "capital"),
    "supports": ("support", "supported"),
    "voting_support_for": ("voting support", "support agreement", "vote"),
    "rollover_holder_for": ("rollover", "rolled", "contribute", "retain"),
}
STRATEGIC_TOKENS = ("strategic", "operating", "corporate", "portfolio company")
FINANCIAL_TOKENS = ("financial", "sponsor", "private equity", "financing", "capital")
SIGNAL_RELATIONS = ("member_of", "joins_group", "finances", "affiliate_of")
MEMBER_RELATIONS = ("member_of", "joins_group")
GROUP_RELATIONS = ("member_of", "joins_group", "exits_group")
GROUP_TOKENS = ("group", "/", "consortium", "club")
COHORT_TOKENS = ("parties", "bidders", "buyers", "sponsors", "companies", "remaining")

# ---- projections to users ------------------------------------------------------------
REVIEW_FIELDS = (
    "deal_slug", "run_id", "review_status", "event_id", "event_date", "event_type", "event_subtype",
    "actor_id", "actor_label", "actor_kind", "actor_role", "bid_value", "bid_value_lower",
    "bid_value_upper", "bid_value_unit", "consideration_type", "bid_stage", "cycle_id", "relation_id",
    "relation_type", "subject_actor_id", "subject_actor_label", "object_actor_id",
    "object_actor_label", "participation_count_id", "process_stage", "actor_class", "count_min",
    "count_max", "count_qualifier", "claim_id", "claim_type", "claim_summary", "confidence",
    "citation_unit_id", "supplied_quote", "bound_source_quote", "bound_source_page", "issue_codes",
    "issue_reasons", "suggested_action", "evidence_ref_index", "review_resolution", "reviewed_by",
    "reviewed_at", "resolution_reason", "corrected_citation_unit_id", "corrected_quote_text",
)
REVIEW_NUMERIC = {
    "bid_value": "double", "bid_value_lower": "double", "bid_value_upper": "double",
    "count_min": "int", "count_max": "int",
}
LEDGER_FIELDS = (
    "deal_slug", "TargetName", "Acquirer", "DateAnnounced", "event_order", "event_date",
    "date_precision", "row_unit", "party_name", "bidder_class", "initiated_by", "event_family",
    "event_code", "stage", "formality", "dropout_side", "dropout_reason", "bid_value",
    "bid_value_lower", "bid_value_upper", "bid_value_unit", "consideration_type", "review_label",
    "evidence_page", "evidence_quote_full", "confidence", "needs_human_attention",
    "source_claim_ids",
)

# ---- sources -------------------------------------------------------------------------
PAGES_JSON = T.StructType([
    T.StructField("number", T.IntegerType()),
    T.StructField("tokens", T.IntegerType()),
    T.StructField("element_count", T.IntegerType()),
    T.StructField("content", T.StringType()),
])
MANIFEST_JSON = T.StructType([
    T.StructField("slug", T.StringType()),
    T.StructField("target_name", T.StringType()),
    T.StructField("acquirer", T.StringType()),
    T.StructField("date_announced", T.StringType()),
    T.StructField("is_reference", T.BooleanType()),
    T.StructField("source", T.StructType([
        T.StructField(n, T.StringType()) for n in (
            "seed_url", "index_url", "cik", "accession", "primary_document_url",
            "primary_document_name", "form_type")])),
    T.StructField("artifacts", T.StructType([
        T.StructField("raw_htm_bytes", T.LongType()),
        T.StructField("raw_md_bytes", T.LongType()),
        T.StructField("pages_count", T.IntegerType())])),
    T.StructField("fetch", T.StructType([
        T.StructField(n, T.StringType()) for n in ("user_agent", "fetched_at", "sec2md_version")])),
])
SEEDS_CSV = T.StructType([
    T.StructField(n, T.StringType()) for n in (
        "deal_slug", "target_name", "acquirer", "date_announced", "primary_url", "is_reference")])
CALL_JSON = T.StructType([
    T.StructField("ts", T.StringType()),
    T.StructField("phase", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("prompt_hash", T.StringType()),
    T.StructField("attempts", T.IntegerType()),
    T.StructField("input_tokens", T.LongType()),
    T.StructField("output_tokens", T.LongType()),
    T.StructField("reasoning_tokens", T.LongType()),
    T.StructField("latency_seconds", T.DoubleType()),
    T.StructField("watchdog", T.StructType([
        T.StructField("warnings", T.IntegerType()),
        T.StructField("max_idle_seconds", T.DoubleType())])),
    T.StructField("outcome", T.StringType()),
])
RUN_MANIFEST_JSON = T.StructType([
    *[T.StructField(n, T.StringType()) for n in (
        "schema_version", "slug", "run_id", "started_at", "finished_at", "outcome")],
    T.StructField("stability_eligible", T.BooleanType()),
    T.StructField("models", T.StructType([T.StructField("extract", T.StringType())])),
    T.StructField("reasoning_efforts", T.StructType([T.StructField("extract", T.StringType())])),
    *[T.StructField(n, T.StringType()) for n in (
        "api_endpoint", "prompt_hash", "schema_hash", "rulebook_version",
        "extractor_contract_version")],
])
VALIDATION_FLAG = T.StructType([
    T.StructField(n, T.StringType()) for n in (
        "flag_id", "severity", "code", "reason", "row_table", "row_id", "claim_id", "claim_type",
        "event_id", "actor_id", "coverage_obligation_id", "citation_unit_id", "row_index")])
PROGRESS_DEAL = T.StructType([
    T.StructField("is_reference", T.BooleanType()),
    T.StructField("status", T.StringType()),
    T.StructField("flag_count", T.IntegerType()),
    *[T.StructField(n, T.StringType()) for n in (
        "last_run", "last_run_id", "last_verified_by", "last_verified_at", "last_verified_run_id")],
    T.StructField("verified", T.BooleanType()),
    *[T.StructField(n, T.StringType()) for n in (
        "verification_report", "notes", "rulebook_version", "target_name", "acquirer",
        "date_announced")],
    T.StructField("rulebook_version_history", T.ArrayType(T.StructType([
        T.StructField(n, T.StringType()) for n in ("ts", "run_id", "version")]))),
])
PROGRESS_JSON = T.StructType([
    T.StructField("schema_version", T.StringType()),
    T.StructField("rulebook_version", T.StringType()),
    T.StructField("updated", T.StringType()),
    T.StructField("deals", T.MapType(T.StringType(), PROGRESS_DEAL)),
])


# Columns of the stored tables (fixed values); working columns are not stored.
STORED_COLUMNS = {
    "spans": ("evidence_id", "filing_id", "paragraph_id", "span_basis", "span_kind", "parent_evidence_id", "created_by_stage",
        "char_start", "char_end", "quote_text", "quote_text_hash", "evidence_fingerprint", "run_id", "deal_slug", "source_page"),
    "claims": ("claim_id", "run_id", "filing_id", "deal_slug", "region_id", "provider_source_stage", "claim_type", "confidence",
        "raw_value", "normalized_value", "quote_text", "quote_text_hash", "status", "claim_sequence", "coverage_obligation_id"),
    "claim_coverage_links": ("claim_id", "obligation_id", "run_id", "deal_slug", "claim_type", "current"),
    "claim_evidence": ("claim_id", "evidence_id", "ordinal"),
    "claim_dispositions": ("disposition_id", "claim_id", "run_id", "disposition", "reason_code", "reason", "current"),
    "coverage_results": ("coverage_result_id", "run_id", "obligation_id", "result", "reason_code", "reason", "claim_count", "current"),
    "deals": ("deal_id", "run_id", "deal_slug", "target_actor_id", "target_name", "announcement_date", "effective_date", "all_cash"),
    "process_cycles": ("cycle_id", "run_id", "deal_id", "cycle_sequence", "cycle_label", "start_date", "end_date"),
    "actors": ("actor_id", "run_id", "deal_id", "actor_label", "actor_kind", "observability", "bidder_class", "lead_arranger_label",
        "member_count_known", "has_strategic_member", "has_financial_member", "has_sovereign_wealth_member"),
    "actor_relations": ("relation_id", "run_id", "deal_id", "subject_actor_id", "object_actor_id", "relation_type", "subject_actor_label",
        "object_actor_label", "role_detail", "cycle_id_first_observed", "cycle_id_last_observed", "effective_date_first",
        "effective_date_last", "confidence"),
    "events": ("event_id", "run_id", "deal_id", "cycle_id", "event_type", "event_subtype", "event_date", "description", "bid_value",
        "bid_value_lower", "bid_value_upper", "bid_value_unit", "consideration_type", "bid_stage"),
    "event_actor_links": ("link_id", "run_id", "event_id", "actor_id", "actor_label", "role", "role_detail"),
    "participation_counts": ("participation_count_id", "run_id", "deal_id", "cycle_id", "process_stage", "actor_class", "count_min",
        "count_max", "count_qualifier"),
    "row_evidence": ("row_table", "row_id", "evidence_id", "ordinal"),
    "review_flags": ("flag_id", "run_id", "deal_id", "severity", "code", "reason", "row_table", "row_id", "status", "metadata", "current"),
    "review_rows": ("review_row_id", *REVIEW_FIELDS),
}
