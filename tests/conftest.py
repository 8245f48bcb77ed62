from __future__ import annotations

import json
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tracewell.session import local_session  # noqa: E402

FAMILIES = ("actor_claims", "actor_relation_claims", "event_claims", "bid_claims", "participation_count_claims")


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=4, shuffle_partitions=4, app="tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def payload_of(**families) -> str:
    return json.dumps({f: families.get(f, []) for f in FAMILIES})


def refs(*quotes, unit="page_1_paragraph_1"):
    return [{"citation_unit_id": unit, "quote_text": q} for q in quotes]


def claim(kind: str, quote=None, evidence=None, obligation=None, confidence="high", **fields) -> dict:
    defaults = {
        "actor": dict(actor_label="Party A", actor_kind="organization", observability="named", actor_class="unknown"),
        "actor_relation": dict(subject_label="S", object_label="O", relation_type="advises", role_detail=None, effective_date_first=None),
        "event": dict(event_type="process", event_subtype="nda_signed", event_date=None, description="d", actor_label=None, actor_role=None),
        "bid": dict(bidder_label="Party A", bid_date=None, bid_value=None, bid_value_lower=None, bid_value_upper=None,
                    bid_value_unit=None, consideration_type=None, bid_stage="initial"),
        "participation_count": dict(process_stage="contacted", actor_class="unknown", count_min=1, count_max=None, count_qualifier="exact"),
    }[kind]
    return {"claim_type": kind, "coverage_obligation_id": obligation or f"obl_{kind}", "confidence": confidence, **defaults, **fields,
            "evidence_refs": evidence if evidence is not None else refs(quote)}


def run_deals(spark, deals: dict, run_id="run-1", **options):
    """One pipeline run over many deals: slug -> dict(payload, pages, target?, metadata?)."""
    from tracewell.plans.pipeline import finalize
    pages = [(slug, i, i + 1, text) for slug, d in deals.items() for i, text in enumerate(d["pages"])]
    page_df = spark.createDataFrame(pages, "deal_slug string, page_pos int, number int, content string")
    payloads = spark.createDataFrame([(s, run_id, d["payload"]) for s, d in deals.items()], "deal_slug string, run_id string, payload string")
    targets = spark.createDataFrame([(s, d.get("target")) for s, d in deals.items()], "deal_slug string, target_name string")
    meta = spark.createDataFrame(
        [(s, *d["metadata"]) for s, d in deals.items() if d.get("metadata")],
        "deal_slug string, TargetName string, Acquirer string, DateAnnounced string")
    return finalize(page_df, payloads, targets, meta, **options)
