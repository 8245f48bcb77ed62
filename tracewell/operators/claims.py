"""Claim payloads: shape checks and one row per claim."""
from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tracewell.functions.hashing import make_id, stable_id, stable_json
from tracewell.functions.text import let, strict_json
from tracewell.schemas import (
    CLAIM_EXTRA_FIELDS, CLAIM_FAMILIES, CLAIM_FIELDS, CLAIM_SCHEMA_VERSION, FAMILY_BY_TYPE, FORBIDDEN_FIELDS,
    MAX_QUOTE_CHARS, PAYLOAD, RELATION_MARKERS,
)

FAMILIES = tuple(CLAIM_FAMILIES)
_VARIANT_NAMES = {"STRING": "str", "BIGINT": "int", "DOUBLE": "float", "FLOAT": "float", "BOOLEAN": "bool", "VOID": "NoneType"}


# ---- shape checks --------------------------------------------------------------------
def _kind(value: str) -> str:
    """SQL: JSON kind of a variant."""
    name = f"schema_of_variant({value})"
    return (
        f"CASE WHEN {value} IS NULL OR {name} = 'VOID' THEN 'null' WHEN {name} = 'STRING' THEN 'string' "
        f"WHEN {name} = 'BOOLEAN' THEN 'boolean' WHEN {name} = 'BIGINT' THEN 'integer' WHEN {name} LIKE 'ARRAY%' THEN 'array' "
        f"WHEN {name} LIKE 'OBJECT%' THEN 'object' ELSE 'number' END")


_SHOWN = "element_at(map('string','str','integer','int','number','float','boolean','bool','null','NoneType','array','list','object','dict'), {})"


def _strings(values) -> str:
    return "array(" + ",".join(f"'{v}'" for v in values) + ")"


def _rules(spark) -> DataFrame:
    """The field rules as a table: a fixed few dozen rows."""
    rows = [(family, name, list(kinds), list(allowed) if allowed else None)
            for family, spec in CLAIM_FAMILIES.items() for name, (kinds, allowed) in spec["fields"].items()]
    return spark.createDataFrame(rows, "family string, field string, kinds array<string>, allowed array<string>")


_NONE = "cast(array() as array<struct<path:string,message:string>>)"


def _check(condition: str, path: str, message: str) -> str:
    return f"CASE WHEN {condition} THEN struct({path} AS path, {message} AS message) END"


def _found(*checks: str) -> str:
    return "array_compact(array(" + ", ".join(checks) + "))"


def _each(items: str, at: str, message: str) -> str:
    """One problem per element x of an array of field names."""
    return f"coalesce(transform({items}, x -> struct(concat({at}, '.', x) AS path, {message} AS message)), {_NONE})"


def _descend(df: DataFrame, value: str, keep: list[str], key: str, out: str) -> DataFrame:
    """One level down: a row per member of an object or array variant, or one row without any.

    `problems` of the upper level stay with the first member only, so each is reported once.
    """
    members = df.sparkSession.tvf.variant_explode_outer(F.col(value).outer()).toDF("pos", key, out)
    rows = df.lateralJoin(members)
    return rows.select(*keep, "pos", key, out, F.expr(f"CASE WHEN pos IS NULL OR pos = 0 THEN problems ELSE {_NONE} END").alias("problems"))


def _claim_fits(family: str, claim: Column) -> Column:
    """A typed claim keeps every rule of its family."""
    checks = [claim.isNotNull()]
    for name, (kinds, allowed) in CLAIM_FAMILIES[family]["fields"].items():
        value = claim[name]
        if name == "evidence_refs":
            checks += [F.size(value) > 0, F.forall(value, lambda r: (r["citation_unit_id"] != "") & (
                F.length(r["quote_text"]) <= MAX_QUOTE_CHARS) & r["quote_text"].rlike("(?U)[^\\s\\x1c-\\x1f]"))]
        elif allowed:
            checks.append(value.isin(*allowed) if "null" not in kinds else value.isNull() | value.isin(*allowed))
        elif kinds == ("string",):
            checks.append(value != "")
        elif "null" not in kinds:
            checks.append(value.isNotNull())
        if name in ("count_min", "count_max"):
            checks.append(F.coalesce(value >= 0, F.lit(True)))
    for low, high in (("bid_value_lower", "bid_value_upper"), ("count_min", "count_max")):
        if low in CLAIM_FAMILIES[family]["fields"]:
            checks.append(F.coalesce(claim[low] <= claim[high], F.lit(True)))
    return reduce(lambda a, b: a & b, checks)


def _fitting(family: str) -> Callable[[Column], Column]:
    return lambda claim: F.coalesce(_claim_fits(family, claim), F.lit(False))


def plainly_valid(payload: Column) -> Column:
    """Payloads that are all right at a glance: their typed reading is all that is in them, and its values keep the rules.

    Sufficient, not necessary: a payload that fails may still be valid (a number spelled in another way), so it is taken apart.
    """
    def fits(body: Column) -> Column:
        whole = F.to_json(F.struct(*[body[f].alias(f) for f in sorted(FAMILIES)]), {"ignoreNullFields": "false"})
        claims = [F.forall(body[f], _fitting(f)) for f in FAMILIES]
        return reduce(lambda a, b: a & b, claims, whole == F.to_json(strict_json(payload)))

    return F.coalesce(let(F.from_json(payload, PAYLOAD), fits), F.lit(False))


def payload_violations(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Every shape violation of every payload, with its path. No row = valid payload.

    payloads(deal_slug, run_id, payload). What is plainly valid is left out; else the document is taken apart level by level (families,
    claims, fields, references, their fields) in one pass without any shuffle; each level is
    checked against the rule table, so the work spreads over fields, however large one payload is.
    """
    keys = ["deal_slug", "run_id"]
    families, forbidden = _strings(FAMILIES), _strings(FORBIDDEN_FIELDS)
    names = "coalesce(json_object_keys(text), array())"
    taken = f"array_sort(array_intersect({names}, {forbidden}))"
    root = payloads.filter(~plainly_valid(F.col(payload))).select(*keys, F.col(payload).alias("text"), strict_json(F.col(payload)).alias("v"))
    root = root.withColumn("k", F.expr(_kind("v"))).select(*keys, "v", "k", F.expr(_found(
        _check("v IS NULL", "'$'", "'malformed JSON'"),
        _check("v IS NOT NULL AND k <> 'object'", "'$'", "'expected JSON object'"),
        _check(f"k = 'object' AND size(array_except({families}, {names})) > 0", "'$'",
               f"concat('expected claim object; missing ', array_join(array_except({families}, {names}), ', '))"),
        _check(f"size({taken}) > 0", "'$'", f"concat('includes engine-owned fields: ', array_join({taken}, ', '))"),
        _check(f"get_json_object(text, '$.schema_version') <> '{CLAIM_SCHEMA_VERSION}'", "'$'",
               "'claim payload must not be a canonical output snapshot'"))).alias("problems"))
    root = root.withColumn("v", F.when(F.col("k") == "object", F.col("v")))

    top = _descend(root, "v", keys, "family", "fv").withColumn("k", F.expr(_kind("fv")))
    known = f"array_contains({families}, family)"
    own = _found(
        _check(f"pos IS NOT NULL AND NOT {known}", "concat('$.', family)", "concat('unexpected field ', family)"),
        _check(f"pos IS NOT NULL AND {known} AND k <> 'array'", "concat('$.', family)", "concat('expected array; got ', " + _SHOWN.format("k") + ")"))
    top = top.select(*keys, "family", F.expr(f"CASE WHEN {known} AND k = 'array' THEN fv END").alias("fv"), F.expr(f"concat(problems, {own})").alias("problems"))

    claims = _descend(top, "fv", keys + ["family"], "_key", "cv").withColumn("k", F.expr(_kind("cv")))
    claims = claims.select(
        *keys, "family", "pos", "cv", "k", "problems", F.expr("concat('$.', family, '[', pos, ']')").alias("at"),
        F.expr("CASE WHEN k = 'object' THEN json_object_keys(to_json(cv)) END").alias("names"))
    required = "CASE family " + " ".join(f"WHEN '{f}' THEN {_strings(spec['fields'])}" for f, spec in CLAIM_FAMILIES.items()) + " END"
    number = lambda n: f"try_variant_get(cv, '$.{n}', 'double')"
    owned = f"array_sort(array_intersect(names, {forbidden}))"
    own = _found(
        _check("pos IS NOT NULL AND k <> 'object'", "at", "concat('expected object; got ', " + _SHOWN.format("k") + ")"),
        _check(f"size({owned}) > 0", "at", f"concat('includes engine-owned fields: ', array_join({owned}, ', '))"),
        _check(f"family = 'bid_claims' AND k = 'object' AND {number('bid_value_lower')} > {number('bid_value_upper')}", "at",
               "'bid_value_lower cannot exceed bid_value_upper'"),
        _check(f"family = 'participation_count_claims' AND k = 'object' AND {number('count_min')} > {number('count_max')}", "at",
               "'count_min cannot exceed count_max'"))
    missing = _each(f"array_except({required}, names)", "at", "'missing required field'")
    claims = claims.select(
        *keys, "family", "at", F.when(F.col("k") == "object", F.col("cv")).alias("cv"), F.expr(f"concat(problems, {own}, {missing})").alias("problems"))

    fields = _descend(claims, "cv", keys + ["family", "at"], "field", "v")
    fields = fields.join(F.broadcast(_rules(payloads.sparkSession)), ["family", "field"], "left")  # fixed size
    fields = fields.select(
        *keys, "pos", "field", "kinds", "allowed", "v", "problems", F.expr("concat(at, '.', field)").alias("at"), F.expr(_kind("v")).alias("k"),
        F.expr("try_variant_get(v, '$', 'string')").alias("value"))
    fits = "(array_contains(kinds, k) OR (k = 'integer' AND array_contains(kinds, 'number')))"
    own = _found(
        _check("pos IS NOT NULL AND kinds IS NULL", "at", "concat('unexpected field ', field)"),
        _check(f"pos IS NOT NULL AND NOT {fits}", "at", "concat('expected ', array_join(kinds, '|'), '; got ', " + _SHOWN.format("k") + ")"),
        _check(f"{fits} AND k <> 'null' AND NOT array_contains(allowed, value)", "at", "concat('value \\'', value, '\\' not in allowed enum')"),
        _check(f"{fits} AND allowed IS NULL AND kinds = array('string') AND value = ''", "at", "'must not be empty'"),
        _check(f"{fits} AND field IN ('count_min', 'count_max') AND cast(value AS double) < 0", "at", "'must not be negative'"),
        _check("field = 'evidence_refs' AND k = 'array' AND to_json(v) = '[]'", "at", "'array length 0 below minItems 1'"))
    fields = fields.select(
        *keys, "at", F.expr("CASE WHEN field = 'evidence_refs' AND k = 'array' THEN v END").alias("v"), F.expr(f"concat(problems, {own})").alias("problems"))

    refs = _descend(fields, "v", keys + ["at"], "_key", "rv").withColumn("k", F.expr(_kind("rv")))
    refs = refs.select(*keys, "pos", "rv", "k", "problems", F.expr("concat(at, '[', pos, ']')").alias("at"))
    parts = _strings(("citation_unit_id", "quote_text"))
    own = _found(_check("pos IS NOT NULL AND k <> 'object'", "at", "concat('expected object; got ', " + _SHOWN.format("k") + ")"))
    missing = _each(f"CASE WHEN k = 'object' THEN array_except({parts}, json_object_keys(to_json(rv))) END", "at", "'missing required field'")
    refs = refs.select(*keys, "at", F.when(F.col("k") == "object", F.col("rv")).alias("rv"), F.expr(f"concat(problems, {own}, {missing})").alias("problems"))

    cells = _descend(refs, "rv", keys + ["at"], "field", "v").select(
        *keys, "pos", "field", "problems", F.expr("concat(at, '.', field)").alias("at"), F.expr(_kind("v")).alias("k"), F.expr("try_variant_get(v, '$', 'string')").alias("value"))
    named = f"array_contains({parts}, field)"
    text = f"{named} AND k = 'string'"
    own = _found(
        _check(f"pos IS NOT NULL AND NOT {named}", "at", "concat('unexpected field ', field)"),
        _check(f"{named} AND k <> 'string'", "at", "concat('expected string; got ', " + _SHOWN.format("k") + ")"),
        _check(f"{text} AND value = ''", "at", "'must not be empty'"),
        _check(f"{text} AND field = 'quote_text' AND length(value) > {MAX_QUOTE_CHARS}", "at",
               f"concat('string length ', length(value), ' exceeds maxLength {MAX_QUOTE_CHARS}')"),
        _check(f"{text} AND field = 'quote_text' AND value <> '' AND NOT rlike(value, '(?U)[^\\\\s\\\\x1c-\\\\x1f]')", "at", "'must not be blank'"))
    found = cells.select(*keys, F.explode(F.expr(f"concat(problems, {own})")).alias("_p"))
    return found.select(*keys, "_p.path", "_p.message")


def is_claim_payload(payload: Column) -> Column:
    """V8: all five families are arrays."""
    variant = strict_json(payload)
    ok = F.lit(True)
    for family in FAMILIES:
        ok = ok & F.schema_of_variant(F.try_variant_get(variant, f"$.{family}", "variant")).startswith("ARRAY")
    return F.coalesce(ok, F.lit(False))


def valid_payloads(payloads: DataFrame) -> DataFrame:
    """Payloads without any violation."""
    return payloads.join(payload_violations(payloads).select("deal_slug", "run_id").distinct(), ["deal_slug", "run_id"], "left_anti")


# ---- one row per claim ---------------------------------------------------------------
def wide_claim(family: str, claim: Column) -> list[Column]:
    own = CLAIM_FAMILIES[family]["fields"]
    return [(claim[n] if n in own else F.lit(None).cast(t)).alias(n) for n, t in CLAIM_FIELDS.items()]


def _row_maker(family: str, offset: Column):
    def row(c: Column, i: Column) -> Column:
        return F.struct(
            F.lit(family).alias("family"), F.lit(CLAIM_FAMILIES[family]["claim_type"]).alias("claim_type"),
            i.alias("claim_index"), (offset + i + 1).alias("claim_sequence"), stable_json(c).alias("raw_value"),
            *wide_claim(family, c))
    return row


def explode_claims(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """One wide row per claim, numbered in family order, then array order.

    The number comes from array positions and sizes inside the payload row: no window.
    """
    body = payloads.withColumn("_b", F.from_json(payload, PAYLOAD))
    offset, parts = F.lit(0), []
    for family in FAMILIES:
        claims = F.coalesce(F.col(f"_b.{family}"), F.array().cast(PAYLOAD[family].dataType))

        parts.append(F.transform(claims, _row_maker(family, offset)))
        offset = offset + F.size(claims)
    rows = body.select("deal_slug", "run_id", F.explode(F.concat(*parts)).alias("_c")).select("deal_slug", "run_id", "_c.*")
    return identify_claims(rows)


def identify_claims(rows: DataFrame) -> DataFrame:
    """Adds filing_id and claim_id to wide claim rows; optional columns are filled."""
    for name, kind in {**CLAIM_FIELDS, **CLAIM_EXTRA_FIELDS}.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    return rows.select(
        "*",
        make_id("filing", F.col("deal_slug"), F.col("run_id")).alias("filing_id"),
        stable_id("claim", F.col("deal_slug"), F.col("claim_type"), F.col("claim_sequence"), F.col("raw_value")).alias("claim_id"))


def primary_quote(refs: Column) -> Column:
    """quote of the first reference, else ''."""
    return F.coalesce(F.get(refs, 0)["quote_text"], F.lit(""))


def normalized_value(df_columns: list[str]) -> Column:
    """the identifying fields of a claim as JSON, by claim type."""
    def fields(*names: str) -> Column:
        return stable_json(F.struct(*sorted(names)))

    return (
        F.when(F.col("claim_type") == "actor", fields("actor_label"))
        .when(F.col("claim_type") == "actor_relation", fields("subject_label", "object_label", "relation_type"))
        .when(F.col("claim_type") == "bid", fields("bidder_label", "bid_date", "bid_value", "bid_stage"))
        .otherwise(F.col("raw_value"))
    )


def typed_claims(claims: DataFrame, claim_type: str) -> DataFrame:
    """The columns of one family only."""
    own = [n for n in CLAIM_FAMILIES[FAMILY_BY_TYPE[claim_type]]["fields"] if n in CLAIM_FIELDS and n not in (
        "coverage_obligation_id", "confidence", "evidence_refs")]
    return claims.filter(F.col("claim_type") == claim_type).select("deal_slug", "run_id", "claim_id", *own)


def relation_support(claims: DataFrame) -> DataFrame:
    """V7: what a relation claim's quotes fail to mention (labels, relation marker); empty = supported.

    claims(..., subject_label, object_label, relation_type, evidence_refs).
    """
    quotes = F.lower(F.array_join(F.transform("evidence_refs", lambda r: F.coalesce(r["quote_text"], F.lit(""))), " "))
    markers = F.lit(None).cast("array<string>")
    for relation, words in RELATION_MARKERS.items():
        markers = F.when(F.col("relation_type") == relation, F.array(*[F.lit(w) for w in words])).otherwise(markers)
    rows = claims.filter("relation_type is not null").withColumn("_q", quotes).withColumn("_m", markers)
    missing = F.array_compact(F.array(
        F.when(~F.col("_q").contains(F.lower("subject_label")), F.col("subject_label")),
        F.when(~F.col("_q").contains(F.lower("object_label")), F.col("object_label")),
        F.when(~F.exists("_m", lambda m: F.col("_q").contains(m)), F.col("relation_type")),
    ))
    return rows.withColumn("unsupported", missing).drop("_q", "_m")
