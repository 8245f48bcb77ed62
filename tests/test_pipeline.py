"""Whole-pipeline cases: payload and pages in, ledger and review out."""
import pytest
from conftest import claim, payload_of, refs, run_deals

from tracewell.schemas import LEDGER_FIELDS, REVIEW_FIELDS

QUOTES = dict(
    actor="Party A was one of the parties contacted",
    nda="Party A signed a confidentiality agreement",
    drop="Party A withdrew because value was below its prior indication",
    bid="Party A submitted an indication of interest of $10 to $12 per share",
    advisor="Sample Target retained Banker as financial advisor",
    member="Director A served on the strategic committee",
    count="Five financial sponsors were contacted",
)


def sample_payload():
    return payload_of(
        actor_claims=[claim("actor", QUOTES["actor"], observability="anonymous_handle", actor_class="financial")],
        event_claims=[
            claim("event", QUOTES["nda"], event_date="2014-01-03", actor_label="Party A", actor_role="potential bidder"),
            claim("event", QUOTES["drop"], event_subtype="withdrawn_by_bidder", event_date="2014-02-10", actor_label="Party A",
                  actor_role="bidder", confidence="medium"),
        ],
        bid_claims=[claim("bid", QUOTES["bid"], bid_date="2014-02-01", bid_value_lower=10.0, bid_value_upper=12.0,
                          bid_value_unit="per_share", consideration_type="cash")],
        actor_relation_claims=[
            claim("actor_relation", QUOTES["advisor"], subject_label="Banker", object_label="Sample Target",
                  role_detail="financial advisor", effective_date_first="2014-01-01"),
            claim("actor_relation", QUOTES["member"], subject_label="Director A", object_label="strategic committee", relation_type="member_of"),
        ],
        participation_count_claims=[claim("participation_count", QUOTES["count"], actor_class="financial", count_min=5, count_max=5)],
    )


def one_event(evidence):
    return payload_of(event_claims=[claim("event", evidence=evidence, actor_label="Party A")])


STITCHED = "On January 3, Party A signed\n\na confidentiality agreement with the Company."
TOGETHER = "North and South, who together we call North/South"


def relation(s, o, t, role=None):
    return claim("actor_relation", TOGETHER, subject_label=s, object_label=o, relation_type=t, role_detail=role)


DEALS = {
    "sample": dict(payload=sample_payload(), pages=[" ".join(QUOTES.values())], metadata=("Sample Target", "Sample Acquirer", "2014-03-01")),
    "rejected": dict(payload=one_event(refs("Party A signed a confidentiality agreement.")), pages=["The process started in January."]),
    "stitched": dict(payload=one_event(refs(STITCHED)), pages=[STITCHED]),
    "elsewhere": dict(
        payload=one_event(refs("Party A signed a confidentiality agreement.")),
        pages=["The process started in January.\n\nParty A signed a confidentiality agreement."]),
    "unknown": dict(payload=one_event(refs("started", unit="page_9_paragraph_1")), pages=["The process started in January."]),
    "partial": dict(
        payload=payload_of(actor_relation_claims=[claim(
            "actor_relation", subject_label="Holder One", object_label="Buyer Group", relation_type="supports",
            evidence=refs("Holder One met with the Buyer Group.") + refs("Holder One signed a cleaned-up receipt.", unit="page_1_paragraph_2"))]),
        pages=["Holder One met with the Buyer Group.\n\nHolder One signed a voting agreement."]),
    "group": dict(
        payload=payload_of(
            actor_claims=[claim("actor", TOGETHER, actor_label="North/South", actor_kind="group")],
            actor_relation_claims=[
                relation("North", "North/South", "member_of"), relation("South", "North/South", "member_of"),
                relation("North", "South", "affiliate_of", "portfolio company"),
                relation("South", "North/South", "finances", "committed financing capital")],
            bid_claims=[claim("bid", TOGETHER, bidder_label="North/South", bid_stage="final", bid_value=21.0)]),
        pages=[TOGETHER], target="TARGET CORP"),
    "locked": dict(
        payload=payload_of(
            actor_claims=[claim("actor", TOGETHER, actor_label="Party A", actor_class="strategic"),
                          claim("actor", TOGETHER, actor_label="Buyer Group", actor_class="mixed", actor_kind="group")],
            actor_relation_claims=[relation("Party A", "Buyer Group", "finances", "financial sponsor"),
                                   relation("Party A", "Buyer Group", "member_of", "strategic buyer"),
                                   relation("Party A", "Buyer Group", "member_of", "second detail")]),
        pages=[TOGETHER]),
    "invalid": dict(payload='{"actor_claims": []}', pages=["text"]),
}


@pytest.fixture(scope="module")
def out(spark):
    return {k: v.toPandas() if k != "review_flags" else v.collect() for k, v in run_deals(spark, DEALS).items()}


def of(out, table, slug):
    rows = out[table]
    if isinstance(rows, list):
        return [r for r in rows if r.deal_slug == slug]
    return [r for r in rows[rows.deal_slug == slug].itertuples(index=False)]


def test_ledger_of_a_sample_deal(out):
    rows = sorted(of(out, "ledger", "sample"), key=lambda r: r.event_order)
    assert list(out["ledger"].columns) == [*LEDGER_FIELDS, "run_id"]
    assert [r.event_order for r in rows] == [10, 20, 30, 40, 50]
    assert [r.event_code for r in rows] == ["advisor_retained", "nda_signed", "bid_submitted", "bidder_withdrew", "participation_count"]
    assert {r.event_family for r in rows} == {"advisor", "process", "bid", "dropout"}
    bid = rows[2]
    assert (bid.bidder_class, bid.formality, bid.bid_value_lower, bid.bid_value_upper) == ("financial", "informal", 10.0, 12.0)
    assert (bid.bid_value_unit, bid.consideration_type) == ("per_share", "cash")
    assert bid.evidence_quote_full == QUOTES["bid"]
    assert bid.review_label == "Party A submitted initial bid (10.0-12.0)"
    assert (rows[3].dropout_side, rows[3].dropout_reason, rows[3].needs_human_attention) == ("bidder", "below_prior_bid", 0)
    count = rows[4]
    assert (count.party_name, count.stage, count.consideration_type, count.row_unit) == (
        "5 financial parties", "contacted", "not_applicable", "cohort")
    assert (rows[0].bidder_class, rows[0].initiated_by) == ("not_applicable", "not_applicable")
    assert rows[0].review_label == "Advisor Retained: Banker / Sample Target"
    assert {r.Acquirer for r in rows} == {"Sample Acquirer"}
    assert out["validation_flags"].empty
    (status,) = of(out, "status", "sample")
    assert (status.status, status.flag_count) == ("passed_clean", 0)


def test_review_rows_are_ordered_and_numbered(out):
    review = sorted(of(out, "review_rows", "sample"), key=lambda r: r.position)
    assert list(out["review_rows"].columns[:48]) == list(REVIEW_FIELDS)
    assert [r.position for r in review] == list(range(1, len(review) + 1))
    labels = [r.actor_label for r in review if r.actor_class and not r.participation_count_id]
    assert labels == sorted(labels) and len(labels) == 5
    assert len({r.review_row_id for r in review}) == len(review)
    assert {r.review_status for r in review} == {"clean"}


def test_rejected_claim_makes_one_review_row(out):
    (row,) = of(out, "review_rows", "rejected")
    assert row.review_status == "rejected_claim" and row.claim_type == "event_claim"
    assert row.citation_unit_id == "page_1_paragraph_1" and row.bound_source_quote == ""
    assert row.issue_codes == "evidence_ref_binding_failed" and row.evidence_ref_index == "0"
    (flag,) = of(out, "review_flags", "rejected")
    assert flag.severity == "blocking" and flag.metadata.diagnostic_subcode is None
    assert flag.reason == "MissingQuoteError: quote_text is not an exact substring of citation_unit_id 'page_1_paragraph_1'"
    assert not of(out, "actors", "rejected") and not of(out, "events", "rejected")
    (status,) = of(out, "status", "rejected")
    assert (status.status, status.flag_count) == ("needs_review", 1)


def test_unknown_unit(out):
    (flag,) = of(out, "review_flags", "unknown")
    assert flag.reason == "UnknownCitationUnitError: unknown citation_unit_id 'page_9_paragraph_1'"
    assert flag.metadata.diagnostic_subcode == "quote_matches_different_citation_unit"


def test_stitched_quote_is_diagnosed(out):
    (flag,) = of(out, "review_flags", "stitched")
    assert flag.metadata.diagnostic_subcode == "cross_unit_quote_stitching"
    assert flag.metadata.stitched_citation_unit_ids == ["page_1_paragraph_1", "page_1_paragraph_2"]
    assert of(out, "review_rows", "stitched")[0].issue_codes == "evidence_ref_binding_failed; cross_unit_quote_stitching"


def test_quote_of_another_unit_is_diagnosed(out):
    (flag,) = of(out, "review_flags", "elsewhere")
    assert flag.metadata.diagnostic_subcode == "quote_matches_different_citation_unit"
    assert [c.asDict() for c in flag.metadata.candidate_units] == [
        {"citation_unit_id": "page_1_paragraph_2", "page_number": 1, "paragraph_index": 2, "match_count": 1}]


def test_one_good_reference_supports_the_claim(out):
    assert of(out, "claim_dispositions", "partial")[0].disposition == "supported"
    (flag,) = of(out, "review_flags", "partial")
    assert flag.severity == "soft" and flag.metadata.evidence_ref_index == 1
    assert len(flag.metadata.supplied_evidence_refs) == 2
    rows = [r for r in of(out, "review_rows", "partial") if r.relation_id]
    assert len(rows) == 1 and rows[0].review_status == "needs_review" and rows[0].evidence_ref_index == "1"
    assert rows[0].bound_source_quote == "Holder One met with the Buyer Group."
    assert len(of(out, "evidence", "partial")) == 1


def test_group_relations_and_shared_quotes(out):
    actors = {r.actor_label: r for r in of(out, "actors", "group")}
    assert actors["North"].bidder_class == "strategic"
    assert actors["North/South"].actor_kind == "group" and actors["North/South"].bidder_class == "strategic"
    assert actors["North/South"].has_strategic_member and actors["North/South"].has_financial_member
    assert of(out, "deals", "group")[0].target_actor_id.startswith("actor_")
    review = of(out, "review_rows", "group")
    assert len({r.claim_id for r in review}) == 1  # one shared span: every row cites the first claim
    group = next(r for r in review if r.actor_label == "North/South" and not r.relation_id and not r.event_id)
    assert group.bound_source_page == " | ".join(["1"] * 5)
    bid = next(r for r in of(out, "ledger", "group") if r.event_code == "bid_submitted")
    assert (bid.formality, bid.stage, bid.review_label) == ("formal", "final_round", "North/South submitted final bid (21.0)")


def test_stated_class_is_locked_and_role_detail_splits_relations(out):
    actors = {r.actor_label: r for r in of(out, "actors", "locked")}
    assert actors["Party A"].bidder_class == "strategic" and actors["Buyer Group"].bidder_class == "mixed"
    assert actors["Buyer Group"].has_strategic_member and actors["Buyer Group"].has_financial_member
    assert len({r.relation_id for r in of(out, "actor_relations", "locked")}) == 3


def test_invalid_payload_is_an_issue_not_a_crash(out):
    assert any("missing actor_relation_claims" in r.reason for r in of(out, "issues", "invalid"))
    assert not of(out, "claims", "invalid")
