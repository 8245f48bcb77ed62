"""The 28-column event ledger."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracewell.functions.ranking import ordinal
from tracewell.functions.text import bidder_class_or_unknown, cell, contains_any, humanize, looks_cohort
from tracewell.operators.review import review_source
from tracewell.schemas import CODE_PRIORITY, DEFAULT_PRIORITY, EVENT_CODES, LEDGER_FIELDS, RELATION_CODES, TRUSTED_STATUSES

NA = "not_applicable"


def code_map(table: dict[str, tuple], place: int) -> Column:
    """One column of a code table as a map literal (a few dozen fixed entries)."""
    pairs = [F.lit(x) for key, row in table.items() if row[place] is not None for x in (key, row[place])]
    return F.create_map(*pairs)


def _empty(value: Column) -> Column:
    return value.isNull() | (value == "")


def _or(value: Column, *others) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v if isinstance(v, Column) else F.lit(v), F.lit("")) for v in (value, *others)])


def date_precision(date: Column) -> Column:
    """F10."""
    return (
        F.when(_empty(date), "unknown").when(date.rlike(r"(?U)^\d{4}-\d{2}-\d{2}\z"), "exact")
        .when(date.rlike(r"(?U)^\d{4}-\d{2}\z"), "month").when(date.rlike(r"(?U)^\d{4}\z"), "year").otherwise("rough"))


# Phrases of the two classifiers (fixed values).
BIDDER_VERBS = ("unsolicited", "submitted", "delivered", "made a proposal", "made an offer", "offered")
BIDDER_APPROACH = ("approached", "unsolicited")
BIDDER_CONTACT = ("contacted the company", "contacted representatives of the company")
INSTRUCTIONS = ("authorized", "instructed", "directed")
OUTREACH = ("contact", "solicit")
TARGET_CONTACT = (
    "the company contacted", "company contacted", "the board contacted", "board contacted", "committee contacted",
    "management contacted", "representatives of the company contacted", "reached out to",
)


def initiated_by(evidence: Column, family: Column, subtype: Column) -> Column:
    """who started it, by the first rule that fits."""
    text = F.lower(F.coalesce(evidence, F.lit("")))
    contact = (
        F.when(contains_any(text, BIDDER_APPROACH) | contains_any(text, BIDDER_CONTACT), "bidder")
        .when(contains_any(text, INSTRUCTIONS) & contains_any(text, OUTREACH), "target")
        .when(contains_any(text, TARGET_CONTACT), "target")
        .when(text.contains("contacted") & text.contains("representatives"), "advisor").otherwise("unknown"))
    return (
        F.when(text.contains("activist"), "activist_shareholder")
        .when(family == "bid", F.when(contains_any(text, BIDDER_VERBS), "bidder").otherwise("unknown"))
        .when(subtype == "contact_initial", contact).otherwise(NA))


def dropout_reason(evidence: Column, side: Column) -> Column:
    """why a party left, by the first rule that fits."""
    text = F.lower(F.coalesce(evidence, F.lit("")))
    return (
        F.when(side == NA, NA)
        .when(text.contains("below") & contains_any(text, ("prior", "earlier", "indication")), "below_prior_bid")
        .when(contains_any(text, ("market value", "market price")), "below_market")
        .when(text.contains("strategic fit"), "strategic_fit").when(text.contains("financ"), "financing")
        .when(contains_any(text, ("valuation", "price", "premium")), "valuation")
        .when(contains_any(text, ("confidential", "leak")), "confidentiality").otherwise("unknown"))


def float_text(value: Column) -> Column:
    """A float as its shortest decimal form, without an exponent between 1e-4 and 1e16."""
    plain = value.cast("string")
    size = F.abs(value)
    wide = F.regexp_replace(value.cast("decimal(38,18)").cast("string"), r"(\.\d+?)0+$", "$1")
    return F.when(((size >= 1e7) & (size < 1e16)) | ((size >= 1e-4) & (size < 1e-3)), wide).otherwise(plain)


def _nonzero_text(value: Column, text: Column) -> Column:
    return F.when(value.isNull() | (value == 0), "").otherwise(text)


def bid_value_label(value: Column, lower: Column, upper: Column) -> Column:
    """F19. A bound of zero is a bound: it is written like any other."""
    span = F.concat(cell(float_text(lower)), F.lit("-"), cell(float_text(upper)))
    return (
        F.when(value.isNotNull(), F.concat(F.lit(" ("), float_text(value), F.lit(")")))
        .when(lower.isNotNull() | upper.isNotNull(), F.concat(F.lit(" ("), span, F.lit(")"))).otherwise(""))


def count_party_name(low: Column, high: Column, actor_class: Column) -> Column:
    """F19."""
    text = lambda v: _nonzero_text(v, v.cast("string"))
    count = (
        F.when(low.isNotNull() & low.eqNullSafe(high), low.cast("string"))
        .when(low.isNotNull() | high.isNotNull(), F.concat(text(low), F.lit("-"), text(high))).otherwise("unknown number of"))
    return F.concat_ws(" ", count, actor_class, F.lit("parties"))


def review_label(code: Column, party: Column, stage: Column, value_label: Column) -> Column:
    """the label of an event row."""
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return (
        F.when(code == "bid_submitted", say(party, " submitted ", _or(stage, "unspecified"), " bid", value_label))
        .when(code == "ioi_submitted", say(party, " submitted indication of interest"))
        .when(code == "nda_signed", say(party, " signed NDA"))
        .when(code == "bidder_withdrew", say(party, " withdrew from process"))
        .when(code == "target_excluded", say("Target excluded ", party))
        .when(code == "no_response", say(party, " did not respond or proceed"))
        .otherwise(say(humanize(code), ": ", party)))


def needs_attention(status: Column, confidence: Column, bound: Column, supplied: Column) -> Column:
    """F23."""
    return F.when((status != "clean") & (status != ""), 1).when(confidence == "low", 1).when(_empty(bound) & _empty(supplied), 1).otherwise(0)


COUNT_CODE = "participation_count"


def event_code(subtype: Column) -> Column:
    return F.coalesce(code_map(EVENT_CODES, 1)[subtype], _or(subtype, "event"))


def ledger_codes(graph: dict[str, DataFrame]) -> DataFrame:
    """(event_code): the codes of the ledger's rows, off the tables the rows come from; no quote, flag or actor has a part in them."""
    relations = graph["actor_relations"].filter(F.col("relation_type").isin(*RELATION_CODES))
    return graph["events"].select(event_code(cell(F.col("event_subtype"))).alias("event_code")).unionByName(
        relations.select(code_map(RELATION_CODES, 1)[F.col("relation_type")].alias("event_code"))).unionByName(
        graph["participation_counts"].select(F.lit(COUNT_CODE).alias("event_code")))


def ledger_source(review: DataFrame, deals: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """Ledger rows without their order number.

    One pass over the review rows; actors and unmapped relations fall out. `metadata`
    (deal_slug, TargetName, Acquirer, DateAnnounced) overrides what the graph says of a deal. `deals` holds every run of the review;
    what is known of a deal is put together first, so that the rows meet it once.
    """
    run = ["deal_slug", "run_id"]
    event = F.col("row_table") == "events"
    relation = F.col("row_table") == "actor_relations"
    count = F.col("row_table") == "participation_counts"
    rows = review.filter(event | count | (relation & F.col("relation_type").isin(*RELATION_CODES)))
    known = deals.select(*run, "target_name", "announcement_date").dropDuplicates(run)
    if metadata is not None:
        m = metadata.select("deal_slug", *[F.col(c).alias(f"_{c}") for c in ("TargetName", "Acquirer", "DateAnnounced")], F.lit(True).alias("_m"))
        known = known.join(m, "deal_slug", "left")
        pick = lambda name, own: F.when(F.col("_m"), cell(F.col(f"_{name}"))).otherwise(own)
    else:
        pick = lambda name, own: own
    rows = rows.join(known, run, "left")
    rows = rows.select(
        *rows.columns, pick("TargetName", cell(F.col("target_name"))).alias("TargetName"), pick("Acquirer", F.lit("")).alias("Acquirer"),
        pick("DateAnnounced", cell(F.col("announcement_date"))).alias("DateAnnounced"))

    subtype, kind, target = F.col("event_subtype"), F.col("relation_type"), F.col("TargetName")
    of = lambda table, place, key: code_map(table, place)[key]
    family = F.when(event, F.coalesce(of(EVENT_CODES, 0, subtype), F.lit("process"))).when(relation, of(RELATION_CODES, 0, kind)).otherwise("process")
    code = F.when(event, event_code(subtype)).when(relation, of(RELATION_CODES, 1, kind)).otherwise(COUNT_CODE)
    evidence = _or(F.col("bound_source_quote"), F.col("supplied_quote"), F.lit(None).cast("string"))
    rows = rows.withColumns({"event_family": family, "event_code": code, "_text": F.coalesce(evidence, F.lit(""))})

    stage_of_event = F.when(F.col("bid_stage") == "final", "final_round").otherwise(
        _or(F.col("bid_stage"), of(EVENT_CODES, 2, subtype), "unknown"))
    stage = F.when(event, stage_of_event).when(relation, of(RELATION_CODES, 2, kind)).otherwise(_or(F.col("process_stage"), "unknown"))
    formality = F.when(event, F.coalesce(of(EVENT_CODES, 3, subtype), F.when(F.col("bid_stage") == "final", "formal"))).otherwise(None)
    side = F.coalesce(F.when(event, of(EVENT_CODES, 4, subtype)), F.lit(NA))
    party = (
        F.when(event, _or(F.col("actor_label"), target, "Deal process"))
        .when(relation, _or(F.col("subject_actor_label"), F.col("actor_label"), "Related party"))
        .otherwise(count_party_name(F.col("count_min"), F.col("count_max"), _or(F.col("actor_class"), "unknown"))))
    unit_of_event = (
        F.when((F.col("actor_kind") == "cohort") | looks_cohort(F.col("actor_label")), "cohort")
        .when(~_empty(F.col("actor_label")), "bidder").otherwise("deal"))
    unit = F.when(event, unit_of_event).when(relation, F.when(kind.isin("joins_group", "exits_group"), "cohort").otherwise("bidder")).otherwise("cohort")
    rows = rows.withColumns({"_party": party, "row_unit": unit, "dropout_side": side, "_stage": stage})

    known_class = bidder_class_or_unknown(F.col("_bidder_class"))
    bidder = (
        F.when(event, F.when(F.col("row_unit") == "deal", NA).otherwise(known_class))
        .when(relation, F.when(kind == "advises", NA).otherwise(known_class)).otherwise(_or(F.col("actor_class"), "unknown")))
    relation_party = _or(F.col("object_actor_label"), target, "deal party")
    label = (
        F.when(event, review_label(F.col("event_code"), F.col("_party"), F.col("bid_stage"), bid_value_label(
            F.col("bid_value"), F.col("bid_value_lower"), F.col("bid_value_upper"))))
        .when(relation, F.concat(humanize(F.col("event_code")), F.lit(": "), F.col("_party"), F.lit(" / "), relation_party))
        .otherwise(F.concat(humanize(_or(F.col("process_stage"), "process")), F.lit(" count: "), F.col("_party"))))
    date = F.when(relation, cell(F.col("_relation_date"))).otherwise(cell(F.col("event_date")))
    has_value = F.col("bid_value").isNotNull() | F.col("bid_value_lower").isNotNull() | F.col("bid_value_upper").isNotNull()
    in_bid = F.col("event_family") == "bid"
    return rows.select(
        *run, "TargetName", "Acquirer", "DateAnnounced", date.alias("event_date"), date_precision(date).alias("date_precision"), "row_unit",
        F.col("_party").alias("party_name"), bidder.alias("bidder_class"),
        F.when(event, initiated_by(F.col("_text"), F.col("event_family"), subtype)).otherwise(NA).alias("initiated_by"),
        "event_family", "event_code", F.col("_stage").alias("stage"), F.coalesce(formality, F.lit(NA)).alias("formality"), "dropout_side",
        dropout_reason(F.col("_text"), F.col("dropout_side")).alias("dropout_reason"), "bid_value", "bid_value_lower", "bid_value_upper",
        F.when(in_bid & has_value, _or(F.col("bid_value_unit"), "unspecified")).otherwise(NA).alias("bid_value_unit"),
        F.when(in_bid, _or(F.col("consideration_type"), "unspecified")).otherwise(NA).alias("consideration_type"),
        label.alias("review_label"), F.col("bound_source_page").alias("evidence_page"), F.col("_text").alias("evidence_quote_full"),
        "confidence", needs_attention(F.col("review_status"), F.col("confidence"), F.col("bound_source_quote"), F.col("supplied_quote")).alias("needs_human_attention"),
        F.col("claim_id").alias("source_claim_ids"), F.concat_ws("\u0001", "_l1", "_l2", "_l3").alias("_review_order"))


def code_priority(code: Column) -> Column:
    pairs = [F.lit(x) for item in CODE_PRIORITY.items() for x in item]
    return F.coalesce(F.create_map(*pairs)[code], F.lit(DEFAULT_PRIORITY))


def number_ledger(rows: DataFrame) -> DataFrame:
    """Order numbers 10, 20, ... per run: undated last, then date, code priority, party, claim."""
    date = F.col("event_date")
    rows = rows.withColumn("_day", F.concat(F.when(date == "", "1").otherwise("0"), date)).withColumn(
        "_group", F.concat(F.lpad(code_priority(F.col("event_code")).cast("string"), 4, "0"), F.col("party_name")))
    rows = ordinal(rows, ["deal_slug", "run_id"], ["_day", "_group"], [F.col("source_claim_ids"), F.col("_review_order")], "_rank")
    return rows.withColumn("event_order", (F.col("_rank") * 10).cast("int"))


def ledger(graph: dict[str, DataFrame], metadata: DataFrame | None = None, review: DataFrame | None = None) -> DataFrame:
    """The ledger of every run of every deal. Extra column run_id; `LEDGER_FIELDS` is the export."""
    rows = ledger_source(review_source(graph) if review is None else review, graph["deals"], metadata)
    return number_ledger(rows).select(*LEDGER_FIELDS, "run_id")


def trusted_rows(ledger_rows: DataFrame, progress: DataFrame) -> DataFrame:
    """The ledger rows of the latest run of deals in a trusted status."""
    trusted = progress.filter(F.col("status").isin(*TRUSTED_STATUSES)).select("deal_slug", F.col("last_run_id").alias("run_id"))
    return ledger_rows.join(trusted, ["deal_slug", "run_id"], "left_semi")


def export_ledger(ledger_rows: DataFrame, progress: DataFrame) -> DataFrame:
    """Only the latest run of deals in a trusted status, in deal and ledger order."""
    return trusted_rows(ledger_rows, progress).select(*LEDGER_FIELDS)


def untrusted_selection(progress: DataFrame) -> DataFrame:
    """P12's guard: selected deals whose status does not allow an export."""
    return progress.filter(~F.coalesce(F.col("status").isin(*TRUSTED_STATUSES), F.lit(False))).select(
        "deal_slug", F.concat(F.col("deal_slug"), F.lit(" has status="), F.coalesce("status", F.lit("None")), F.lit("; export only trusted graph outputs")).alias("reason"))
