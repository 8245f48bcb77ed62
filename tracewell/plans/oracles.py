"""The same answers in ANSI SQL over the given tables, written independently of the Spark plans."""
from __future__ import annotations

from tracewell.operators.ledger import (
    BIDDER_APPROACH, BIDDER_CONTACT, BIDDER_VERBS, INSTRUCTIONS, OUTREACH, TARGET_CONTACT)
from tracewell.plans.feeds import GROUPS, PHRASES, SUBJECTS
from tracewell.schemas import (
    ACTOR_CLASS, CODE_PRIORITY, COUNT_QUALIFIER, EVENT_CODES, EVENT_SUBTYPE, FINANCIAL_TOKENS, GROUP_RELATIONS, MEMBER_RELATIONS, PROCESS_STAGE,
    RELATION_CODES, RELATION_MARKERS, RELATION_TYPE, SIGNAL_RELATIONS, STRATEGIC_TOKENS)

U = "chr(31)"


def pick(values, index: str) -> str:
    return "(CASE " + index + " " + " ".join(f"WHEN {i} THEN {'NULL' if v is None else chr(39) + v + chr(39)}" for i, v in enumerate(values)) + " END)"


def text_in(values) -> str:
    return "(" + ",".join(f"'{v}'" for v in values) + ")"


def any_of(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def made(prefix: str, *parts: str, n: int = 24) -> str:
    body = " || ".join(f"coalesce(CAST({p} AS VARCHAR), 'null') || {U}" for p in parts)
    return f"'{prefix}_' || left(sha256({body}), {n})"


def stable(prefix: str, *parts: str) -> str:
    body = " || '|' || ".join(f"coalesce(CAST({p} AS VARCHAR), 'None')" for p in parts)
    return f"'{prefix}_' || left(sha256({body}), 16)"


E = f"""e AS (
  SELECT event_id, ts, user_id, event_type, value, k, 'deal_' || user_id AS deal_slug, strftime(ts, '%Y-%m-%d') AS day,
    {pick(SUBJECTS, 'event_id % 6')} AS label, {pick(GROUPS, 'event_id % 2')} AS group_label, {pick(PHRASES, 'k % 10')} AS phrase
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events))"""

UNITS = f"""pg AS (SELECT *, 'Entry ' || event_id || ': ' || phrase || '.' AS t1, 'The filing notes ' || event_type || ' activity of ' || label || '.' AS t2 FROM e),
pg2 AS (SELECT *, coalesce(sum(length(t1) + length(t2) + 3) OVER w, 0) AS base, 2 * (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) AS seq0
  FROM pg WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
units AS (
  SELECT deal_slug, event_id, 1 AS i, 'page_' || event_id || '_paragraph_1' AS unit_id, seq0 AS seq, CAST(base AS BIGINT) AS a, t1 AS text FROM pg2 UNION ALL
  SELECT deal_slug, event_id, 2, 'page_' || event_id || '_paragraph_2', seq0 + 1, CAST(base + length(t1) + 2 AS BIGINT), t2 FROM pg2)"""

FEED = f"""fc AS (
  SELECT e.*, kind, CASE kind WHEN 'actor' THEN 0 WHEN 'actor_relation' THEN 1 WHEN 'event' THEN 2 WHEN 'bid' THEN 3 ELSE 4 END * 1000000000000 + event_id AS seq,
    'page_' || event_id || CASE WHEN k % 20 = 9 THEN '_paragraph_9' ELSE '_paragraph_1' END AS u0,
    CASE k % 20 WHEN 19 THEN 'not in the text of entry ' || event_id WHEN 3 THEN 'Entry ' || event_id || ': ' || phrase || '.' || chr(10) || chr(10) || 'The filing notes'
      WHEN 17 THEN 'The filing notes ' || event_type || ' activity of' ELSE phrase END AS q0,
    CASE WHEN k % 4 = 0 OR k % 20 = 19 THEN 'page_' || event_id || '_paragraph_2' END AS u1,
    CASE WHEN k % 4 = 0 OR k % 20 = 19 THEN 'The filing notes ' || event_type || ' activity of' END AS q1,
    {pick(("high", "high", "medium", "low"), 'event_id % 4')} AS confidence, 'obl_' || (k % 7) AS obl,
    CASE WHEN kind = 'actor' OR (kind = 'event' AND k % 4 <> 3) THEN label END AS actor_label,
    {pick(("organization", "organization", "person", "cohort"), 'k % 4')} AS actor_kind, {pick(("named", "anonymous_handle"), 'k % 2')} AS observability,
    CASE WHEN kind = 'actor' THEN CASE WHEN k < 6 THEN {pick(("financial", "strategic", "mixed"), 'k % 3')} ELSE 'unknown' END
      WHEN kind = 'participation_count' THEN {pick(ACTOR_CLASS, 'k % 4')} END AS actor_class,
    {pick(RELATION_TYPE, 'k % 11')} AS rtype, {pick(("strategic buyer", "financial sponsor", None, "legal counsel"), 'event_id % 4')} AS role_detail,
    CASE k % 3 WHEN 0 THEN day WHEN 1 THEN left(day, 7) END AS rdate,
    CASE WHEN k >= 95 THEN 'board_meeting' ELSE {pick(EVENT_SUBTYPE, 'k % 18')} END AS subtype,
    CASE WHEN k % 5 <> 4 THEN day END AS edate, CASE WHEN k % 2 = 0 THEN 'potential buyer' END AS role,
    CASE WHEN k % 3 = 0 THEN value END AS bv, CASE WHEN k % 3 = 1 THEN value END AS bl, CASE WHEN k % 3 = 1 THEN value * 2 END AS bu,
    {pick(("per_share", "enterprise_value", None), 'k % 3')} AS bunit, {pick(("cash", "stock", "mixed", None), 'k % 4')} AS consideration,
    {pick(("initial", "revised", "final", "unspecified"), 'k % 4')} AS bstage, {pick(PROCESS_STAGE, 'k % 6')} AS pstage,
    k % 9 AS cmin, CASE k % 3 WHEN 1 THEN k % 9 WHEN 2 THEN k % 9 + 2 END AS cmax, {pick(COUNT_QUALIFIER, 'k % 5')} AS cq
  FROM e, (VALUES ('actor'), ('actor_relation'), ('event'), ('bid'), ('participation_count')) t(kind)
  WHERE CASE kind WHEN 'actor' THEN event_type = 'signup' WHEN 'actor_relation' THEN event_type = 'click'
    WHEN 'event' THEN event_type = 'view' OR (event_type = 'signup' AND k % 5 = 0) WHEN 'bid' THEN event_type = 'purchase' ELSE event_type = 'error' END),
rj AS (SELECT *, CASE WHEN u1 IS NULL THEN json_array(json_object('citation_unit_id', u0, 'quote_text', q0))
    ELSE json_array(json_object('citation_unit_id', u0, 'quote_text', q0), json_object('citation_unit_id', u1, 'quote_text', q1)) END AS refs FROM fc),
raw AS (SELECT *, CAST(CASE kind
    WHEN 'actor' THEN json_object('actor_class', actor_class, 'actor_kind', actor_kind, 'actor_label', actor_label, 'claim_type', kind, 'confidence', confidence,
      'coverage_obligation_id', obl, 'evidence_refs', refs, 'observability', observability)
    WHEN 'actor_relation' THEN json_object('claim_type', kind, 'confidence', confidence, 'coverage_obligation_id', obl, 'effective_date_first', rdate, 'evidence_refs', refs,
      'object_label', group_label, 'relation_type', rtype, 'role_detail', role_detail, 'subject_label', label)
    WHEN 'event' THEN json_object('actor_label', actor_label, 'actor_role', role, 'claim_type', kind, 'confidence', confidence, 'coverage_obligation_id', obl,
      'description', 'Entry ' || event_id, 'event_date', edate, 'event_subtype', subtype, 'event_type', 'process', 'evidence_refs', refs)
    WHEN 'bid' THEN json_object('bid_date', day, 'bid_stage', bstage, 'bid_value', bv, 'bid_value_lower', bl, 'bid_value_unit', bunit, 'bid_value_upper', bu,
      'bidder_label', label, 'claim_type', kind, 'confidence', confidence, 'consideration_type', consideration, 'coverage_obligation_id', obl, 'evidence_refs', refs)
    ELSE json_object('actor_class', actor_class, 'claim_type', kind, 'confidence', confidence, 'count_max', cmax, 'count_min', cmin, 'count_qualifier', cq,
      'coverage_obligation_id', obl, 'evidence_refs', refs, 'process_stage', pstage) END AS VARCHAR) AS raw_value FROM rj),
claims AS (SELECT *, {stable("claim", "deal_slug", "kind", "seq", "raw_value")} AS claim_id, {made("filing", "deal_slug", "'r1'")} AS filing_id FROM raw)"""

BOUND = f"""refs2 AS (SELECT *, 0 AS ri, u0 AS unit, q0 AS quote FROM claims UNION ALL SELECT *, 1, u1, q1 FROM claims WHERE u1 IS NOT NULL),
bound0 AS (SELECT r.*, u.text AS utext, u.a AS ua, u.event_id AS page,
    CASE WHEN u.text IS NULL THEN 'UnknownCitationUnitError: unknown citation_unit_id ''' || unit || ''''
      WHEN NOT contains(u.text, quote) THEN 'MissingQuoteError: quote_text is not an exact substring of citation_unit_id ''' || unit || '''' END AS error
  FROM refs2 r LEFT JOIN units u ON u.deal_slug = r.deal_slug AND u.unit_id = r.unit),
bound1 AS (SELECT *, CASE WHEN error IS NULL THEN ua + strpos(utext, quote) - 1 END AS s0, CASE WHEN error IS NULL THEN ua + strpos(utext, quote) - 1 + length(quote) END AS s1,
    count(*) FILTER (WHERE error IS NULL) OVER (PARTITION BY claim_id) AS n_bound,
    count(*) FILTER (WHERE error IS NULL) OVER (PARTITION BY claim_id ORDER BY ri ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ordinal FROM bound0),
bound AS (SELECT *, CASE WHEN error IS NULL THEN {made("ev", "filing_id", "s0", "s1", "sha256(quote)")} END AS evidence_id FROM bound1),
judged AS (SELECT c.*, n_bound = 0 AS rejected, err FROM claims c JOIN (SELECT claim_id, max(n_bound) AS n_bound, arg_min(error, ri) FILTER (WHERE error IS NOT NULL) AS err FROM bound GROUP BY 1) b USING (claim_id))"""

ACTORS = f"""good AS (SELECT * FROM judged WHERE NOT rejected),
mentions AS (
  SELECT claim_id, kind, deal_slug, seq, 0 AS part, actor_label AS label, actor_kind AS ak, observability AS obs, actor_class AS cls FROM good WHERE kind = 'actor' UNION ALL
  SELECT claim_id, kind, deal_slug, seq, 0, label, 'organization', 'named', NULL FROM good WHERE kind = 'actor_relation' UNION ALL
  SELECT claim_id, kind, deal_slug, seq, 1, group_label, CASE WHEN rtype IN {text_in(GROUP_RELATIONS)} THEN 'group' ELSE 'organization' END, 'named', NULL FROM good WHERE kind = 'actor_relation' UNION ALL
  SELECT claim_id, kind, deal_slug, seq, 0, actor_label, 'organization', 'named', NULL FROM good WHERE kind = 'event' AND actor_label IS NOT NULL UNION ALL
  SELECT claim_id, kind, deal_slug, seq, 0, label, 'organization', 'named', NULL FROM good WHERE kind = 'bid'),
keyed AS (SELECT *, lower(replace(label, '  ', ' ')) AS akey, seq * 2 + part AS ord FROM mentions),
merged AS (SELECT deal_slug, akey, arg_min(label, ord) AS actor_label, coalesce(arg_min(ak, ord) FILTER (WHERE ak <> 'organization'), 'organization') AS actor_kind,
    coalesce(arg_min(obs, ord) FILTER (WHERE obs <> 'named'), 'named') AS observability, arg_min(cls, ord) FILTER (WHERE cls IS NOT NULL AND cls <> 'unknown') AS stated
  FROM keyed GROUP BY 1, 2),
ided AS (SELECT *, {stable("actor", "deal_slug", "actor_label")} AS actor_id FROM merged),
rel AS (SELECT g.claim_id, g.deal_slug, g.seq, g.rtype, g.role_detail, g.rdate, g.confidence, s.actor_id AS sid, s.actor_label AS slabel, o.actor_id AS oid, o.actor_label AS olabel
  FROM good g JOIN ided s ON s.deal_slug = g.deal_slug AND s.akey = lower(replace(g.label, '  ', ' '))
  JOIN ided o ON o.deal_slug = g.deal_slug AND o.akey = lower(g.group_label) WHERE g.kind = 'actor_relation'),
relations AS (SELECT *, {stable("relation", "deal_slug", "sid", "oid", "rtype", "rdate", "role_detail")} AS relation_id FROM rel),
sigtext AS (SELECT *, lower(slabel || ' ' || coalesce(role_detail, '')) AS t FROM relations WHERE rtype IN {text_in(SIGNAL_RELATIONS)}),
sig AS (SELECT deal_slug, sid AS actor_id, seq, 1 AS phase FROM sigtext WHERE {any_of('t', STRATEGIC_TOKENS)} UNION ALL SELECT deal_slug, oid, seq, 2 FROM sigtext WHERE {any_of('t', STRATEGIC_TOKENS)}
  UNION ALL SELECT deal_slug, sid, seq, 3 FROM sigtext WHERE {any_of('t', FINANCIAL_TOKENS)} UNION ALL SELECT deal_slug, oid, seq, 4 FROM sigtext WHERE {any_of('t', FINANCIAL_TOKENS)}),
sagg AS (SELECT deal_slug, actor_id, bool_or(phase = 2) AS hs, bool_or(phase = 4) AS hf, arg_min(phase, seq * 10 + phase) AS fp FROM sig GROUP BY 1, 2),
actors0 AS (SELECT i.*, coalesce(hs, false) AS hs, coalesce(hf, false) AS hf, CASE WHEN stated IS NOT NULL THEN stated WHEN hs THEN 'strategic'
    WHEN hf THEN CASE WHEN fp = 1 THEN 'mixed' ELSE 'financial' END WHEN fp = 1 THEN 'strategic' WHEN fp = 3 THEN 'financial' ELSE 'unknown' END AS cls0
  FROM ided i LEFT JOIN sagg USING (deal_slug, actor_id)),
memb AS (SELECT r.deal_slug, r.oid AS actor_id, bool_or(m.cls0 = 'strategic') AS ms, bool_or(m.cls0 = 'financial') AS mf
  FROM relations r JOIN actors0 m ON m.deal_slug = r.deal_slug AND m.actor_id = r.sid WHERE r.rtype IN {text_in(MEMBER_RELATIONS)} GROUP BY 1, 2),
actors AS (SELECT a.deal_slug, a.actor_id, a.akey, a.actor_label, a.actor_kind, a.observability,
    CASE WHEN stated IS NOT NULL THEN cls0 WHEN ms THEN 'strategic' WHEN mf AND cls0 = 'unknown' THEN 'financial' ELSE cls0 END AS bidder_class,
    hs OR coalesce(ms, false) AS hs, hf OR coalesce(mf, false) AS hf FROM actors0 a LEFT JOIN memb USING (deal_slug, actor_id))"""

ROWS = f"""ev AS (SELECT *, {stable("event", "deal_slug", "kind", "seq", "raw_value")} AS event_key,
    CASE WHEN kind = 'bid' THEN CASE WHEN bstage = 'final' THEN 'final_round_bid' ELSE 'first_round_bid' END ELSE subtype END AS st,
    CASE WHEN kind = 'bid' THEN day ELSE edate END AS dt, CASE WHEN kind = 'bid' THEN label ELSE actor_label END AS lab FROM good WHERE kind IN ('event', 'bid')),
links AS (SELECT v.deal_slug, v.claim_id, v.seq, v.event_key, a.actor_id, {stable("link", "v.event_key", "a.actor_id", "CASE WHEN v.kind = 'bid' THEN 'bid_submitter' ELSE v.role END")} AS link_id,
    CASE WHEN v.kind = 'bid' THEN 'bid_submitter' ELSE coalesce(v.role, 'participant') END AS role
  FROM ev v JOIN ided a ON a.deal_slug = v.deal_slug AND a.akey = lower(replace(v.lab, '  ', ' ')) WHERE v.lab IS NOT NULL),
cnt AS (SELECT *, {stable("participation_count", "deal_slug", "seq", "raw_value")} AS count_id FROM good WHERE kind = 'participation_count'),
evid AS (SELECT deal_slug, claim_id, evidence_id, ordinal, quote, page FROM bound WHERE error IS NULL),
rowev AS (
  SELECT x.*, evidence_id, ordinal, quote, page FROM (
    SELECT m.deal_slug, m.claim_id, m.seq, m.part, 'actors' AS row_table, i.actor_id AS row_id FROM keyed m JOIN ided i USING (deal_slug, akey) UNION ALL
    SELECT deal_slug, claim_id, seq, 2, 'actor_relations', relation_id FROM relations UNION ALL
    SELECT deal_slug, claim_id, seq, 0, 'events', event_key FROM ev UNION ALL
    SELECT deal_slug, claim_id, seq, 0, 'participation_counts', count_id FROM cnt) x JOIN evid USING (deal_slug, claim_id)),
best AS (SELECT deal_slug, evidence_id, min(seq) AS seq FROM evid JOIN claims USING (deal_slug, claim_id) GROUP BY 1, 2),
src AS (SELECT r.deal_slug, r.row_table, r.row_id, min(b.seq) AS cseq, string_agg(r.quote, ' | ' ORDER BY r.ordinal, r.seq, r.part) AS bq,
    string_agg(CAST(r.page AS VARCHAR), ' | ' ORDER BY r.ordinal, r.seq, r.part) AS bp
  FROM rowev r JOIN best b USING (deal_slug, evidence_id) GROUP BY 1, 2, 3)"""

FLAGS = f"""upos AS (SELECT deal_slug, unit_id, seq, text, length(text) AS len, coalesce(sum(length(text) + 2) OVER (PARTITION BY deal_slug ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at FROM units),
failed AS (SELECT * FROM bound WHERE error IS NOT NULL),
cand0 AS (SELECT f.deal_slug, f.quote, u.unit_id, row_number() OVER (PARTITION BY f.deal_slug, f.quote ORDER BY u.seq) AS rn
  FROM (SELECT DISTINCT deal_slug, quote FROM failed) f JOIN units u ON u.deal_slug = f.deal_slug AND contains(u.text, f.quote)),
cand AS (SELECT deal_slug, quote, string_agg(unit_id, ',' ORDER BY rn) AS candidates, count(*) AS nc, min(unit_id) AS one FROM cand0 WHERE rn <= 8 GROUP BY 1, 2),
st0 AS (SELECT DISTINCT f.deal_slug, f.unit, f.quote, p.seq AS p, p.at + p.len AS pend FROM failed f JOIN upos p ON p.deal_slug = f.deal_slug AND p.unit_id = f.unit WHERE f.k % 20 = 3 AND f.ri = 0),
st1 AS (SELECT s.deal_slug, s.unit, s.quote, s.p, min(u.seq) AS lo FROM st0 s JOIN upos u ON u.deal_slug = s.deal_slug AND u.seq <= s.p AND (u.seq = s.p OR s.pend - u.at <= length(s.quote) + 1000) GROUP BY 1, 2, 3, 4),
st AS (SELECT s.deal_slug, s.unit, s.quote, string_agg(u.unit_id, ',' ORDER BY u.seq) AS stitched FROM st1 s JOIN upos u ON u.deal_slug = s.deal_slug AND u.seq BETWEEN s.lo AND s.p + 1 GROUP BY 1, 2, 3),
flags AS (SELECT f.*, {made("flag", "f.deal_slug", "'r1'", "claim_id", "'evidence_ref_binding_failed'", "ri")} AS flag_id, coalesce(candidates, '') AS candidates,
    CASE WHEN nc > 1 OR one <> f.unit THEN 'quote_matches_different_citation_unit' WHEN st.stitched IS NOT NULL THEN 'cross_unit_quote_stitching' END AS subcode,
    CASE WHEN nc > 1 OR one <> f.unit THEN 'Correct the citation unit to one where the supplied quote appears exactly, or reject the claim.'
      WHEN st.stitched IS NOT NULL THEN 'Split the quote into exact per-unit evidence refs, each with its own citation_unit_id, or reject the claim.'
      ELSE 'Choose the correct citation unit and exact quote, or reject the claim.' END AS action,
    CASE WHEN coalesce(nc, 0) = 0 THEN st.stitched END AS stitched
  FROM failed f LEFT JOIN cand USING (deal_slug, quote) LEFT JOIN st ON st.deal_slug = f.deal_slug AND st.unit = f.unit AND st.quote = f.quote)"""


def num(v: str) -> str:
    return f"CASE WHEN {v} = 0 THEN '' ELSE coalesce(CAST({v} AS VARCHAR), '') END"


CELLS = f"""cells AS (SELECT deal_slug, seq, claim_id, kind || '_claim' AS ctype, confidence, concat_ws(' | ', u0, u1) AS cu, concat_ws(' | ', q0, q1) AS sq,
    trim(CASE kind WHEN 'actor' THEN 'actor ' || actor_label || ' (' || actor_kind || ')' WHEN 'actor_relation' THEN label || ' ' || rtype || ' ' || group_label
      WHEN 'bid' THEN label || ' ' || bstage || ' bid ' || CASE WHEN bv IS NOT NULL THEN CAST(bv AS VARCHAR) WHEN bl IS NOT NULL THEN bl || '-' || bu ELSE 'value unspecified' END
      WHEN 'participation_count' THEN pstage || ' ' || actor_class || ' count ' || {num('cmin')} || '-' || {num('cmax')}
      ELSE coalesce(edate, 'undated') || ' ' || subtype || ' ' || coalesce(actor_label, '') END) AS summary FROM claims),
cflag AS (SELECT claim_id, 'evidence_ref_binding_failed' || coalesce('; ' || arg_min(subcode, ri), '') AS codes, arg_min(error, ri) AS reasons, arg_min(action, ri) AS action, CAST(min(ri) AS VARCHAR) AS ri
  FROM flags GROUP BY 1)"""

REVIEW = f"""canon AS (
  SELECT deal_slug, 0 AS br, 'actors' AS row_table, actor_id AS row_id, actor_label AS o1, actor_id AS o2, '' AS o3, actor_id AS f_actor_id, actor_label AS f_actor_label, actor_kind AS f_actor_kind, '' AS f_role, bidder_class AS f_class,
    '' AS f_date, '' AS f_etype, '' AS f_subtype, NULL::DOUBLE AS f_bv, NULL::DOUBLE AS f_bl, NULL::DOUBLE AS f_bu, '' AS f_unit, '' AS f_cons, '' AS f_stage, '' AS f_cycle, '' AS f_rtype, '' AS f_sid, '' AS f_slab, '' AS f_oid, '' AS f_olab,
    '' AS f_pstage, NULL::INTEGER AS f_cmin, NULL::INTEGER AS f_cmax, '' AS f_cq, NULL AS x_class, NULL AS x_date FROM actors UNION ALL
  SELECT r.deal_slug, 1, 'actor_relations', relation_id, relation_id, lpad(CAST(seq AS VARCHAR), 20, '0'), '', sid, slabel, '', rtype, '', '', '', '', NULL, NULL, NULL, '', '', '', {stable("cycle", "r.deal_slug", "1")}, rtype, sid, slabel, oid, olabel,
    '', NULL, NULL, '', a.bidder_class, rdate FROM relations r JOIN actors a ON a.deal_slug = r.deal_slug AND a.actor_id = r.sid UNION ALL
  SELECT v.deal_slug, 2, 'events', v.event_key, CASE WHEN dt IS NULL THEN '1' ELSE '0' END || coalesce(dt, ''), v.event_key, '', coalesce(l.actor_id, ''), coalesce(a.actor_label, ''), coalesce(a.actor_kind, ''), coalesce(l.role, ''), '',
    coalesce(dt, ''), CASE WHEN kind = 'bid' THEN 'bid' ELSE 'process' END, st, CASE WHEN kind = 'bid' THEN bv END, CASE WHEN kind = 'bid' THEN bl END, CASE WHEN kind = 'bid' THEN bu END, CASE WHEN kind = 'bid' THEN coalesce(bunit, '') ELSE '' END,
    CASE WHEN kind = 'bid' THEN coalesce(consideration, '') ELSE '' END, CASE WHEN kind = 'bid' THEN bstage ELSE '' END, {stable("cycle", "v.deal_slug", "1")}, '', '', '', '', '', '', NULL, NULL, '', a.bidder_class, NULL
    FROM ev v LEFT JOIN links l ON l.event_key = v.event_key AND l.deal_slug = v.deal_slug LEFT JOIN actors a ON a.deal_slug = v.deal_slug AND a.actor_id = l.actor_id UNION ALL
  SELECT deal_slug, 3, 'participation_counts', count_id, count_id, '', '', '', '', '', '', actor_class, '', '', '', NULL, NULL, NULL, '', '', '', {stable("cycle", "deal_slug", "1")}, '', '', '', '', '', pstage, cmin, cmax, cq, NULL, NULL FROM cnt),
review AS (SELECT n.*, c.claim_id, coalesce(c.ctype, '') AS ctype, coalesce(c.summary, '') AS summary, coalesce(c.confidence, '') AS confidence, coalesce(c.cu, '') AS cu, coalesce(c.sq, '') AS sq, coalesce(s.bq, '') AS bq, coalesce(s.bp, '') AS bp,
    CASE WHEN f.claim_id IS NULL THEN 'clean' ELSE 'needs_review' END AS status, coalesce(f.codes, '') AS codes, coalesce(f.reasons, '') AS reasons, coalesce(f.action, '') AS action, coalesce(f.ri, '') AS ri
  FROM canon n LEFT JOIN src s USING (deal_slug, row_table, row_id) LEFT JOIN cells c ON c.deal_slug = n.deal_slug AND c.seq = s.cseq LEFT JOIN cflag f ON f.claim_id = c.claim_id)"""


def lookup(table, key, place) -> str:
    return f"(CASE {key} " + " ".join(f"WHEN '{k}' THEN '{row[place]}'" for k, row in table.items() if row[place] is not None) + " END)"


def started(text: str, family: str, subtype: str) -> str:
    return f"""CASE WHEN contains({text}, 'activist') THEN 'activist_shareholder' WHEN {family} = 'bid' THEN CASE WHEN {any_of(text, BIDDER_VERBS)} THEN 'bidder' ELSE 'unknown' END
      WHEN {subtype} = 'contact_initial' THEN CASE WHEN {any_of(text, BIDDER_APPROACH)} OR {any_of(text, BIDDER_CONTACT)} THEN 'bidder' WHEN {any_of(text, INSTRUCTIONS)} AND {any_of(text, OUTREACH)} THEN 'target'
        WHEN {any_of(text, TARGET_CONTACT)} THEN 'target' WHEN contains({text}, 'contacted') AND contains({text}, 'representatives') THEN 'advisor' ELSE 'unknown' END ELSE 'not_applicable' END"""


def left_reason(text: str, side: str) -> str:
    return f"""CASE WHEN {side} = 'not_applicable' THEN 'not_applicable' WHEN contains({text}, 'below') AND {any_of(text, ('prior', 'earlier', 'indication'))} THEN 'below_prior_bid'
      WHEN {any_of(text, ('market value', 'market price'))} THEN 'below_market' WHEN contains({text}, 'strategic fit') THEN 'strategic_fit' WHEN contains({text}, 'financ') THEN 'financing'
      WHEN {any_of(text, ('valuation', 'price', 'premium'))} THEN 'valuation' WHEN {any_of(text, ('confidential', 'leak'))} THEN 'confidentiality' ELSE 'unknown' END"""


def title(code: str) -> str:
    return f"array_to_string(list_transform(string_split(replace({code}, '_', ' '), ' '), lambda w: upper(w[1:1]) || w[2:]), ' ')"


def precision(d: str) -> str:
    return (f"CASE WHEN {d} IS NULL OR {d} = '' THEN 'unknown' WHEN regexp_full_match({d}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN 'exact' "
            f"WHEN regexp_full_match({d}, '[0-9]{{4}}-[0-9]{{2}}') THEN 'month' WHEN regexp_full_match({d}, '[0-9]{{4}}') THEN 'year' ELSE 'rough' END")


LEDGER = f"""led0 AS (SELECT r.*, CAST(substring(r.deal_slug, 6) AS BIGINT) AS uid FROM review r WHERE br IN (2, 3) OR (br = 1 AND f_rtype IN {text_in(RELATION_CODES)})),
led1 AS (SELECT *, CASE WHEN uid % 2 = 0 THEN 'Name ' || uid WHEN uid % 3 = 0 THEN 'Target ' || uid ELSE '' END AS "TargetName",
    CASE WHEN uid % 2 = 0 AND uid % 4 <> 0 THEN 'Buyer' ELSE '' END AS "Acquirer", CASE WHEN uid % 2 = 0 THEN '2024-02-01' ELSE '' END AS "DateAnnounced",
    CASE br WHEN 2 THEN coalesce({lookup(EVENT_CODES, 'f_subtype', 0)}, 'process') WHEN 1 THEN {lookup(RELATION_CODES, 'f_rtype', 0)} ELSE 'process' END AS event_family,
    CASE br WHEN 2 THEN coalesce({lookup(EVENT_CODES, 'f_subtype', 1)}, f_subtype) WHEN 1 THEN {lookup(RELATION_CODES, 'f_rtype', 1)} ELSE 'participation_count' END AS event_code,
    CASE br WHEN 2 THEN CASE WHEN f_stage = 'final' THEN 'final_round' WHEN f_stage <> '' THEN f_stage ELSE coalesce({lookup(EVENT_CODES, 'f_subtype', 2)}, 'unknown') END
      WHEN 1 THEN {lookup(RELATION_CODES, 'f_rtype', 2)} ELSE f_pstage END AS stage,
    CASE WHEN br = 2 THEN coalesce({lookup(EVENT_CODES, 'f_subtype', 3)}, CASE WHEN f_stage = 'final' THEN 'formal' END, 'not_applicable') ELSE 'not_applicable' END AS formality,
    CASE WHEN br = 2 THEN coalesce({lookup(EVENT_CODES, 'f_subtype', 4)}, 'not_applicable') ELSE 'not_applicable' END AS dropout_side,
    CASE WHEN br = 1 THEN coalesce(x_date, '') ELSE f_date END AS event_date, CASE WHEN bq <> '' THEN bq ELSE sq END AS txt FROM led0),
led2 AS (SELECT *, lower(txt) AS lt, CASE br WHEN 2 THEN CASE WHEN f_actor_label <> '' THEN f_actor_label WHEN "TargetName" <> '' THEN "TargetName" ELSE 'Deal process' END WHEN 1 THEN f_slab
      ELSE CASE WHEN f_cmin = f_cmax THEN CAST(f_cmin AS VARCHAR) ELSE {num('f_cmin')} || '-' || {num('f_cmax')} END || ' ' || f_class || ' parties' END AS party_name,
    CASE br WHEN 2 THEN CASE WHEN f_actor_kind = 'cohort' OR contains(lower(f_actor_label), 'bidders') OR contains(lower(f_actor_label), 'remaining') THEN 'cohort' WHEN f_actor_label <> '' THEN 'bidder' ELSE 'deal' END
      WHEN 1 THEN CASE WHEN f_rtype IN ('joins_group', 'exits_group') THEN 'cohort' ELSE 'bidder' END ELSE 'cohort' END AS row_unit FROM led1),
ledger AS (SELECT deal_slug, "TargetName", "Acquirer", "DateAnnounced", event_date, {precision('event_date')} AS date_precision, row_unit, party_name,
    CASE br WHEN 2 THEN CASE WHEN row_unit = 'deal' THEN 'not_applicable' ELSE coalesce(x_class, 'unknown') END WHEN 1 THEN CASE WHEN f_rtype = 'advises' THEN 'not_applicable' ELSE coalesce(x_class, 'unknown') END ELSE f_class END AS bidder_class,
    CASE WHEN br = 2 THEN {started('lt', 'event_family', 'f_subtype')} ELSE 'not_applicable' END AS initiated_by, event_family, event_code, stage, formality, dropout_side,
    {left_reason('lt', 'dropout_side')} AS dropout_reason, f_bv AS bid_value, f_bl AS bid_value_lower, f_bu AS bid_value_upper,
    CASE WHEN event_family = 'bid' AND (f_bv IS NOT NULL OR f_bl IS NOT NULL OR f_bu IS NOT NULL) THEN CASE WHEN f_unit = '' THEN 'unspecified' ELSE f_unit END ELSE 'not_applicable' END AS bid_value_unit,
    CASE WHEN event_family = 'bid' THEN CASE WHEN f_cons = '' THEN 'unspecified' ELSE f_cons END ELSE 'not_applicable' END AS consideration_type,
    CASE br WHEN 2 THEN CASE event_code WHEN 'bid_submitted' THEN party_name || ' submitted ' || CASE WHEN f_stage = '' THEN 'unspecified' ELSE f_stage END || ' bid' ||
          CASE WHEN f_bv IS NOT NULL THEN ' (' || f_bv || ')' WHEN f_bl IS NOT NULL THEN ' (' || f_bl || '-' || f_bu || ')' ELSE '' END
        WHEN 'ioi_submitted' THEN party_name || ' submitted indication of interest' WHEN 'nda_signed' THEN party_name || ' signed NDA' WHEN 'bidder_withdrew' THEN party_name || ' withdrew from process'
        WHEN 'target_excluded' THEN 'Target excluded ' || party_name WHEN 'no_response' THEN party_name || ' did not respond or proceed' ELSE {title('event_code')} || ': ' || party_name END
      WHEN 1 THEN {title('event_code')} || ': ' || party_name || ' / ' || f_olab ELSE {title('f_pstage')} || ' count: ' || party_name END AS review_label,
    bp AS evidence_page, txt AS evidence_quote_full, confidence, CASE WHEN status <> 'clean' OR confidence = 'low' OR (bq = '' AND sq = '') THEN 1 ELSE 0 END AS needs_human_attention,
    coalesce(claim_id, '') AS source_claim_ids, br, o1, o2 FROM led2)"""

STEPS = {"E": E, "UNITS": UNITS, "FEED": FEED, "BOUND": BOUND, "ACTORS": ACTORS, "ROWS": ROWS, "FLAGS": FLAGS, "CELLS": CELLS, "REVIEW": REVIEW, "LEDGER": LEDGER}


def chain(upto: str, select: str) -> str:
    names = list(STEPS)
    return "WITH " + ",\n".join(STEPS[n] for n in names[: names.index(upto) + 1]) + "\n" + select


PRIORITY = "coalesce((CASE event_code " + " ".join(f"WHEN '{c}' THEN {p}" for c, p in CODE_PRIORITY.items()) + " END), 500)"

GRAPH_SQL: dict[str, str] = {
    "unit_offsets": chain("UNITS", f"""SELECT deal_slug, unit_id, seq AS sequence, a AS char_start, a + length(text) AS char_end,
      {made("para", made("filing", "deal_slug").join(("(", ")")), "unit_id", "seq", "a", "a + length(text)", "text")} AS paragraph_id FROM units"""),
    "bound_refs": chain("BOUND", "SELECT deal_slug, claim_id, ri AS ref_index, error, s0 AS span_start, s1 AS span_end, evidence_id, CASE WHEN error IS NULL THEN page END AS source_page, n_bound FROM bound"),
    "binding_flags": chain("FLAGS", """SELECT deal_slug, flag_id, CASE WHEN n_bound = 0 THEN 'blocking' ELSE 'soft' END AS severity, 'evidence_ref_binding_failed' AS code, error AS reason, claim_id AS row_id,
      ri AS ref_index, subcode, action, candidates, stitched FROM flags"""),
    "claim_rows": chain("BOUND", "SELECT deal_slug, claim_id, kind AS claim_type, seq AS claim_sequence, confidence, raw_value, sha256(q0) AS quote_text_hash FROM claims"),
    "claim_evidence": chain("BOUND", "SELECT deal_slug, claim_id, evidence_id, ordinal FROM bound WHERE error IS NULL"),
    "dispositions": chain("BOUND", f"""SELECT deal_slug, {stable("disposition", "'r1'", "claim_id")} AS disposition_id, claim_id, CASE WHEN rejected THEN 'rejected_unsupported' ELSE 'supported' END AS disposition,
      CASE WHEN rejected THEN 'evidence_ref_binding_failed' ELSE 'evidence_refs_bound' END AS reason_code, CASE WHEN rejected THEN err ELSE 'All evidence refs bound to citation units.' END AS reason FROM judged"""),
    "coverage_results": chain("BOUND", f"""SELECT deal_slug, {stable("coverage", "'r1'", "obl")} AS coverage_result_id, obl AS obligation_id, count(*) AS claim_count FROM judged WHERE NOT rejected GROUP BY deal_slug, obl"""),
    "canonical_actors": chain("ACTORS", "SELECT deal_slug, actor_id, actor_label, actor_kind, observability, bidder_class, hs AS has_strategic_member, hf AS has_financial_member FROM actors"),
    "class_signals": chain("ACTORS", "SELECT deal_slug, actor_id, coalesce(stated, 'unknown') AS stated_class, stated IS NOT NULL AS locked, cls0 AS bidder_class, hs AS has_strategic_member, hf AS has_financial_member FROM actors0"),
    "actor_relations": chain("ACTORS", "SELECT deal_slug, relation_id, sid AS subject_actor_id, oid AS object_actor_id, rtype AS relation_type, role_detail, rdate AS effective_date_first FROM relations"),
    "relation_support": chain("FEED", f"""SELECT claim_id, concat_ws(',', CASE WHEN NOT contains(t, lower(label)) THEN label END, CASE WHEN NOT contains(t, lower(group_label)) THEN group_label END,
      CASE WHEN NOT (CASE rtype {' '.join(f"WHEN '{r}' THEN {any_of('t', w)}" for r, w in RELATION_MARKERS.items())} END) THEN rtype END) AS unsupported
      FROM (SELECT *, lower(concat_ws(' ', q0, q1)) AS t FROM claims WHERE kind = 'actor_relation')"""),
    "events_table": chain("ROWS", """SELECT deal_slug, event_key AS event_id, CASE WHEN kind = 'bid' THEN 'bid' ELSE 'process' END AS event_type, st AS event_subtype, dt AS event_date,
      CASE WHEN kind = 'bid' THEN 'Bid submitted by ' || label ELSE 'Entry ' || event_id END AS description, CASE WHEN kind = 'bid' THEN bv END AS bid_value, CASE WHEN kind = 'bid' THEN bl END AS bid_value_lower,
      CASE WHEN kind = 'bid' THEN bu END AS bid_value_upper, CASE WHEN kind = 'bid' THEN bstage END AS bid_stage FROM ev"""),
    "event_links": chain("ROWS", "SELECT deal_slug, link_id, event_key AS event_id, actor_id, role FROM links"),
    "participation_counts": chain("ROWS", "SELECT deal_slug, count_id AS participation_count_id, pstage AS process_stage, actor_class, cmin AS count_min, cmax AS count_max FROM cnt"),
    "row_evidence": chain("ROWS", "SELECT deal_slug, row_table, row_id, evidence_id, ordinal FROM rowev"),
    "row_claim": chain("ROWS", "SELECT s.deal_slug, row_table, row_id, c.claim_id, bq AS bound_source_quote, bp AS bound_source_page FROM src s JOIN claims c ON c.deal_slug = s.deal_slug AND c.seq = s.cseq"),
    "issue_columns": chain("CELLS", """SELECT deal_slug, claim_id AS row_id, 'evidence_ref_binding_failed; extra' || coalesce('; ' || arg_min(subcode, ri), '') AS codes, arg_min(error, ri) AS reasons, CAST(min(ri) AS VARCHAR) AS ref_index
      FROM flags GROUP BY 1, 2"""),
    "rejected_rows": chain("CELLS", """SELECT j.deal_slug, j.claim_id, ctype AS claim_type, summary AS claim_summary, j.confidence, u0 AS citation_unit_id, q0 AS supplied_quote, codes AS issue_codes, reasons AS issue_reasons, action AS suggested_action,
      ri AS evidence_ref_index FROM judged j JOIN cells USING (claim_id) JOIN cflag USING (claim_id) WHERE rejected"""),
    "review_rows": chain("REVIEW", """SELECT deal_slug, 'r1' AS run_id, status AS review_status, CASE WHEN br = 2 THEN row_id ELSE '' END AS event_id, f_date AS event_date, f_etype AS event_type, f_subtype AS event_subtype, f_actor_id AS actor_id,
      f_actor_label AS actor_label, f_actor_kind AS actor_kind, f_role AS actor_role, f_bv AS bid_value, f_bl AS bid_value_lower, f_bu AS bid_value_upper, f_unit AS bid_value_unit, f_cons AS consideration_type, f_stage AS bid_stage, f_cycle AS cycle_id,
      CASE WHEN br = 1 THEN row_id ELSE '' END AS relation_id, f_rtype AS relation_type, f_sid AS subject_actor_id, f_slab AS subject_actor_label, f_oid AS object_actor_id, f_olab AS object_actor_label,
      CASE WHEN br = 3 THEN row_id ELSE '' END AS participation_count_id, f_pstage AS process_stage, f_class AS actor_class, f_cmin AS count_min, f_cmax AS count_max, f_cq AS count_qualifier, coalesce(claim_id, '') AS claim_id, ctype AS claim_type,
      summary AS claim_summary, confidence, cu AS citation_unit_id, sq AS supplied_quote, bq AS bound_source_quote, bp AS bound_source_page, codes AS issue_codes, reasons AS issue_reasons, action AS suggested_action, ri AS evidence_ref_index,
      row_number() OVER (PARTITION BY deal_slug ORDER BY br, o1, o2) AS position FROM review"""),
    "ledger_rows": chain("LEDGER", "SELECT * EXCLUDE (br, o1, o2) FROM ledger"),
    "ledger_order": chain("LEDGER", f"""SELECT deal_slug, 10 * row_number() OVER (PARTITION BY deal_slug ORDER BY event_date = '', event_date, {PRIORITY}, party_name, source_claim_ids, br, o1, o2) AS event_order, event_date, event_code, party_name,
      source_claim_ids FROM ledger"""),
    "ledger_export": chain("LEDGER", "SELECT event_code, count(*) AS rows FROM ledger WHERE CAST(substring(deal_slug, 6) AS BIGINT) % 3 <> 1 AND CAST(substring(deal_slug, 6) AS BIGINT) % 6 <> 5 GROUP BY event_code"),
    "analyst_sql": chain("ROWS", "SELECT v.deal_slug, st AS event_subtype, dt AS event_date, i.actor_label FROM ev v LEFT JOIN links l ON l.event_key = v.event_key LEFT JOIN ided i ON i.deal_slug = l.deal_slug AND i.actor_id = l.actor_id"),
    "analyst_unsupported": chain("BOUND", "SELECT deal_slug, claim_id, kind AS claim_type, 'rejected_unsupported' AS disposition, err AS reason FROM judged WHERE rejected"),
    "deals_table": "WITH " + E + f""" SELECT DISTINCT deal_slug, {stable("deal", "deal_slug")} AS deal_id, CASE WHEN user_id % 3 = 0 THEN {stable("actor", "deal_slug", "'Target ' || user_id")} END AS target_actor_id,
      CASE WHEN user_id % 3 = 0 THEN 'Target ' || user_id END AS target_name FROM e""",
}


# ---- tables --------------------------------------------------------------------------
LINES = """ln AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
off AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM ln),
para AS (SELECT doc_id, i, CAST(base + length(line) - length(ltrim(line)) AS BIGINT) AS a, trim(line) AS t FROM off
  WHERE trim(line) <> '' AND trim(line) <> 'Table of Contents' AND NOT regexp_full_match(trim(line), '[0-9]+') AND NOT starts_with(trim(line), 'ZEQ.=') AND NOT starts_with(trim(line), 'COMMAND=')),
un AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pi FROM para)"""

COUNT_IN = "CAST((length(d.text) - length(replace(d.text, q.quote, ''))) / length(q.quote) AS BIGINT)"

ORDER_PRINT = """op AS (SELECT o_orderkey, 'deal_' || o_custkey AS deal_slug, concat_ws(' | ', 'deal_' || o_custkey, 'review', lower(o_orderpriority), lower(o_orderstatus), strftime(o_orderdate, '%Y-%m-%d'),
    'party ' || lower(o_orderstatus), 'organization', '', format('{:g}', o_totalprice), format('{:g}', o_totalprice / 1000000), format('{:g}', o_totalprice * 10), 'per_share', '',
    CAST(o_orderkey % 50 AS VARCHAR), 'quote of ' || lower(o_orderpriority)) AS fp FROM orders)"""

LINK_ROWS = """hl AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a href="([^"]+)"[^>]*>([^<]+)</a>', 1)) AS href, unnest(regexp_extract_all(html, '(?i)<a href="([^"]+)"[^>]*>([^<]+)</a>', 2)) AS name,
    unnest(range(len(regexp_extract_all(html, '(?i)<a href="([^"]+)"[^>]*>([^<]+)</a>', 1)))) AS pos FROM pages)"""

STATE_VALUES = ("passed_clean", "needs_review", "high_burden", "failed_system", "stale_after_failure", "pending", None, "verified_old")
STATE = f"""st AS (SELECT 'deal_' || c_custkey AS deal_slug, c_custkey AS c, c_custkey % 5 = 0 AS is_ref, {pick(STATE_VALUES, 'c_custkey % 8')} AS status, c_custkey % 13 AS flag_count,
    CASE WHEN c_custkey % 6 <> 0 THEN '2024-01-01T00:00:00Z' END AS last_run, 'run_' || c_custkey AS last_run_id, c_custkey % 10 = 0 AS reviewed, c_custkey % 11 = 0 AS verified, c_mktsegment AS notes, 'rules_' || (c_custkey % 3) AS rules FROM customer)"""
TRUSTED = "('passed_clean', 'needs_review', 'high_burden')"
RUNS = """rn AS (SELECT 'deal_' || o_custkey AS deal_slug, 'run_' || o_orderkey AS run_id, o_orderkey AS k, o_custkey AS c, strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00Z' AS fin,
    CASE o_orderstatus WHEN 'F' THEN 'passed_clean' WHEN 'O' THEN 'needs_review' ELSE 'high_burden' END AS outcome, o_orderpriority <> '1-URGENT' AS elig,
    CASE WHEN o_custkey % 7 = 0 AND o_orderkey % 2 = 0 THEN 'model-b' ELSE 'model-a' END AS model, 'rules_' || (o_custkey % 3) AS rules FROM orders)"""
OUT = """ou AS (SELECT 'deal_' || c_custkey AS deal_slug, CASE WHEN c_custkey % 15 = 0 THEN 'old' ELSE 'deal_graph_v2' END AS schema, c_custkey % 16 <> 0 AS has_deal, CASE WHEN c_custkey % 17 = 0 THEN 'other' ELSE 'run_' || c_custkey END AS run_id,
    CASE WHEN c_custkey % 18 <> 0 THEN c_custkey % 13 END AS burden, c_custkey % 19 = 0 AS est, c_custkey % 20 <> 0 AS jsonl FROM customer WHERE c_custkey % 14 <> 3)"""
EV = "ek AS (SELECT *, 'deal_' || user_id AS deal_slug, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)"
FLAG_ROWS = EV + f""", fl AS (SELECT deal_slug, {pick(("hard", "soft", "info", None, "blocking"), 'k % 5')} AS severity, CASE WHEN k % 11 = 0 THEN '' ELSE 'code_' || (k % 11) END AS code,
    CASE WHEN k % 3 = 0 THEN CAST(event_id AS VARCHAR) END AS event_id, CASE WHEN k % 4 = 0 THEN {pick(SUBJECTS, 'event_id % 6')} ELSE '' END AS actor_id FROM ek WHERE event_type = 'error')"""
STABLE_RUNS = RUNS + f""", li AS (SELECT l_orderkey AS k, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS ri, count(*) FILTER (WHERE l_linestatus = 'O') AS an FROM lineitem GROUP BY 1),
me AS (SELECT rn.*, coalesce(n, 0) AS n, coalesce(ri, 0) AS ri, coalesce(an, 0) AS an, count(*) OVER (PARTITION BY deal_slug) AS tot, row_number() OVER (PARTITION BY deal_slug ORDER BY fin DESC, run_id DESC) AS rk FROM rn LEFT JOIN li USING (k) WHERE elig),
ag AS (SELECT deal_slug, count(DISTINCT model || '/' || rules) > 1 AS cfg, count(DISTINCT n) > 1 AS nch, count(DISTINCT an) > 1 AS ach, bool_or(outcome = 'high_burden') AS hi, bool_or(outcome = 'needs_review') AS nr,
    string_agg(run_id, ',' ORDER BY fin, run_id) AS sel FROM me WHERE rk <= 3 AND tot >= 3 GROUP BY 1),
cl AS (SELECT 'deal_' || c_custkey AS deal_slug, c_custkey AS c, coalesce(tot, 0) AS tot, cfg, nch, ach, hi, nr, sel FROM customer LEFT JOIN (SELECT DISTINCT deal_slug, tot FROM me) t ON t.deal_slug = 'deal_' || c_custkey LEFT JOIN ag ON ag.deal_slug = 'deal_' || c_custkey),
res AS (SELECT deal_slug, c, tot, sel, CASE WHEN tot < 3 THEN 'INSUFFICIENT_ARCHIVED_RUNS' WHEN cfg THEN 'UNSTABLE_RULE_OR_VALIDATOR_FIX_NEEDED' ELSE 'STABLE_FOR_REFERENCE_REVIEW' END AS classification,
    CASE WHEN tot < 3 THEN deal_slug || ' has ' || tot || ' eligible archived runs; need 3' WHEN cfg THEN 'model/reasoning/provider or prompt/schema/rulebook/extractor contract changed'
      ELSE CASE WHEN nch OR ach THEN 'metric variability observed: ' || concat_ws('; ', CASE WHEN nch THEN 'row counts changed' END, CASE WHEN ach THEN 'anonymous placeholder counts changed' END) || ' / ' ELSE '' END ||
        'selected archived runs passed live evidence, graph, and review contract checks' END AS reasons,
    CASE WHEN tot < 3 THEN 'insufficient_runs' WHEN hi THEN 'high_burden' WHEN nr THEN 'needs_review' ELSE 'passed_clean' END AS status FROM cl)"""

_R = lambda cond, code, msg, sev="error": f"SELECT deal_slug, '{sev}' AS severity, '{code}' AS code, {msg} AS message FROM {{src}} WHERE {cond}"


def issue_union(src: str, *rows: str) -> str:
    return " UNION ALL ".join(r.replace("{src}", src) for r in rows)


TABLE_SQL: dict[str, str] = {
    "citation_units": "WITH " + LINES + f""" SELECT 'doc_' || doc_id AS deal_slug, 'page_1_paragraph_' || pi AS unit_id, pi AS paragraph_index, a AS char_start, a + length(t) AS char_end, sha256(t) AS paragraph_hash,
      {made("para", "(" + made("filing", "'doc_' || doc_id") + ")", "'page_1_paragraph_' || pi", "pi - 1", "a", "a + length(t)", "t")} AS paragraph_id FROM un""",
    "stable_ids": f"""SELECT p_partkey, left(sha256(p_name || {U} || p_partkey || {U}), 24) AS hash24, {made("part", "p_name", "p_brand", "CASE WHEN p_partkey % 2 = 0 THEN p_brand END")} AS made,
      {stable("part", "p_name", "p_partkey", "CASE WHEN p_partkey % 2 = 0 THEN p_brand END")} AS stable, sha256(p_name) AS name_hash,
      sha256(p_name || {U} || p_partkey || {U} || (p_partkey + 5) || {U} || sha256(p_brand)) AS fingerprint, lower(p_name) AS name_key FROM part""",
    "row_fingerprints": "WITH " + ORDER_PRINT + " SELECT o_orderkey, fp AS fingerprint FROM op",
    "fingerprint_digest": "WITH " + ORDER_PRINT + """, h AS (SELECT deal_slug, sha256(fp) AS h, count(*) AS n FROM op GROUP BY 1, 2),
      b AS (SELECT deal_slug, left(h, 2) AS b, sha256(string_agg(h || '=' || n, chr(10) ORDER BY h || '=' || n)) AS d FROM h GROUP BY 1, 2)
      SELECT deal_slug, 'r1' AS run_id, left(sha256(string_agg(b || '=' || d, chr(10) ORDER BY b || '=' || d)), 12) AS row_fingerprints FROM b GROUP BY 1""",
    "section_pages": """WITH pg AS (SELECT 'set_' || (doc_id // 100) AS deal, doc_id % 100 AS pos, coalesce(text, '') AS text FROM documents),
      s0 AS (SELECT *, string_split_regex(text, '(?i)of the') AS parts FROM pg),
      s1 AS (SELECT deal, pos, text, CAST(list_sum(list_transform(parts[1:j], lambda p: length(p))) + 6 * (j - 1) AS BIGINT) AS s FROM (SELECT *, unnest(range(1, len(parts))) AS j FROM s0)),
      s2 AS (SELECT *, contains(right(bef, 24), '**') OR contains(left(aft, 24), '**') AS m FROM (SELECT *, substring(text, greatest(s - 120, 0) + 1, s - greatest(s - 120, 0)) AS bef, substring(text, s + 7, 700) AS aft,
          substring(text, greatest(s - 180, 0) + 1, s + 226 - greatest(s - 180, 0)) AS ar FROM s1)),
      s3 AS (SELECT deal, pos, s, CASE WHEN pos + 1 >= 15 THEN 6 ELSE 0 END + CASE WHEN m THEN 3 ELSE 0 END + CASE WHEN regexp_matches(aft, '(?i)with') THEN 3 ELSE 0 END
          - CASE WHEN NOT m AND regexp_matches(right(bef, 100), '(?i)and') THEN 8 ELSE 0 END - CASE WHEN NOT m AND length(ar) - length(replace(ar, '|', '')) >= 4 THEN 8 ELSE 0 END AS score FROM s2),
      b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY deal ORDER BY score DESC, pos, s) AS r FROM s3) WHERE r = 1),
      e0 AS (SELECT pg.deal, pg.pos, text, CASE WHEN pg.pos = b.pos THEN s + 1 ELSE 0 END AS f0 FROM pg JOIN b ON b.deal = pg.deal AND pg.pos >= b.pos AND pg.pos < b.pos + 35 WHERE score >= 5),
      e1 AS (SELECT *, unnest(range(1, len(parts))) AS j FROM (SELECT *, string_split_regex(substring(text, f0 + 1), '(?i)was the') AS parts FROM e0)),
      e2 AS (SELECT deal, pos, text, f0, CAST(f0 + list_sum(list_transform(parts[1:j], lambda p: length(p))) + 7 * (j - 1) AS BIGINT) AS f FROM e1),
      e3 AS (SELECT deal, pos, f FROM (SELECT *, substring(text, greatest(f0, f - 120) + 1, f - greatest(f0, f - 120)) AS bef, substring(text, greatest(f0, f - 200) + 1, f + 207 - greatest(f0, f - 200)) AS ar FROM e2)
        WHERE NOT regexp_matches(bef, '(?i)and') AND length(ar) - length(replace(ar, '|', '')) < 4),
      e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY deal ORDER BY pos, f) AS r FROM e3) WHERE r = 1),
      z AS (SELECT b.deal, CAST(sum(CASE WHEN pg.pos = e.pos THEN e.f ELSE length(text) END - CASE WHEN pg.pos = b.pos THEN s ELSE 0 END) AS BIGINT) AS chars, count(*) AS n FROM b JOIN e USING (deal) JOIN pg ON pg.deal = b.deal AND pg.pos BETWEEN b.pos AND e.pos GROUP BY 1)
      SELECT d.deal AS deal_slug, score, b.pos + 1 AS start_page, s AS start_index, e.pos + 1 AS end_page, f AS end_index, chars, n AS n_pages,
        CASE WHEN score IS NULL THEN 'Background section heading not found in filing pages' WHEN score < 5 THEN 'Background section heading candidates were only table-of-contents/cross-reference hits'
          WHEN f IS NULL THEN 'Background section end heading not found within 35 pages of start page ' || (b.pos + 1) END AS reason
      FROM (SELECT DISTINCT deal FROM pg) d LEFT JOIN b USING (deal) LEFT JOIN e USING (deal) LEFT JOIN z USING (deal)""",
    "section_slice": """WITH d AS (SELECT doc_id, text, string_split_regex(text, '(?i)of the') AS parts FROM documents),
      s0 AS (SELECT doc_id, text, unnest(range(1, len(parts))) AS j, parts FROM d),
      s1 AS (SELECT doc_id, text, CAST(list_sum(list_transform(parts[1:j], lambda p: length(p))) + 6 * (j - 1) AS BIGINT) AS s FROM s0),
      s2 AS (SELECT *, 6 + CASE WHEN regexp_matches(substring(text, s + 7, 700), '(?i)with') THEN 3 ELSE 0 END - CASE WHEN regexp_matches(right(substring(text, greatest(s - 120, 0) + 1, s - greatest(s - 120, 0)), 100), '(?i)and') AND NOT m THEN 8 ELSE 0 END
          + CASE WHEN m THEN 3 ELSE 0 END - CASE WHEN NOT m AND length(ar) - length(replace(ar, '|', '')) >= 4 THEN 8 ELSE 0 END AS score
        FROM (SELECT *, contains(right(substring(text, greatest(s - 120, 0) + 1, s - greatest(s - 120, 0)), 24), '**') OR contains(substring(text, s + 7, 24), '**') AS m,
          substring(text, greatest(s - 180, 0) + 1, s + 226 - greatest(s - 180, 0)) AS ar FROM s1)),
      b AS (SELECT doc_id, arg_min(s, -score * 1000000 + s) AS s, max(score) AS score FROM s2 GROUP BY 1),
      e0 AS (SELECT b.*, text, string_split_regex(substring(text, s + 2), '(?i)by the') AS parts FROM b JOIN documents USING (doc_id) WHERE score >= 5),
      e1 AS (SELECT doc_id, s, text, unnest(range(1, len(parts))) AS j, parts FROM e0),
      e2 AS (SELECT doc_id, s, text, CAST(s + 1 + list_sum(list_transform(parts[1:j], lambda p: length(p))) + 6 * (j - 1) AS BIGINT) AS f FROM e1),
      e3 AS (SELECT doc_id, min(f) AS f FROM (SELECT *, substring(text, greatest(s + 1, f - 120) + 1, f - greatest(s + 1, f - 120)) AS bef, substring(text, greatest(s + 1, f - 200) + 1, f + 206 - greatest(s + 1, f - 200)) AS ar FROM e2)
        WHERE NOT regexp_matches(bef, '(?i)and') AND length(ar) - length(replace(ar, '|', '')) < 4 GROUP BY 1)
      SELECT 'doc_' || d.doc_id AS deal_slug, score, s AS start_index, f AS end_index, f - s AS chars,
        CASE WHEN score IS NULL THEN 'Background section heading not found in filing pages' WHEN score < 5 THEN 'Background section heading candidates were only table-of-contents/cross-reference hits'
          WHEN f IS NULL THEN 'Background section end heading not found within 35 pages of start page 1' WHEN f - s < 100 THEN 'Background section extraction produced too little filing text: ' || (f - s) || ' chars from pages 1..1' END AS reason
      FROM documents d LEFT JOIN b USING (doc_id) LEFT JOIN e3 USING (doc_id)""",
    "url_parts": """WITH c AS (SELECT page_id, split_part(split_part(url, '#', 1), '?', 1) AS u FROM pages),
      p AS (SELECT page_id, coalesce(nullif(regexp_extract(u, '//([^/]+)/[a-z]+/([0-9\\-]+)$', 1), ''), nullif(regexp_extract(u, '//([^/]+)/([0-9]{3})', 1), '')) AS cik,
        replace(coalesce(nullif(regexp_extract(u, '//([^/]+)/[a-z]+/([0-9\\-]+)$', 2), ''), nullif(regexp_extract(u, '//([^/]+)/([0-9]{3})', 2), '')), '-', '') AS accession FROM c)
      SELECT page_id, cik, accession, 'https://www.sec.gov/Archives/edgar/data/' || cik || '/' || accession || '/' || left(accession, 10) || '-' || substring(accession, 11, 2) || '-' || substring(accession, 13) || '-index.htm' AS index_url FROM p""",
    "html_links": "WITH " + LINK_ROWS + " SELECT page_id, pos, href, name FROM hl",
    "pick_document": "WITH " + LINK_ROWS + f""", d AS (SELECT page_id, pos, trim(name) AS name, {pick(("DEFM14A", "EX-99", "SC TO-T", "425", "EX-99.(A)(1)(A)", "10-K", "ex-10"), '(page_id * 3 + pos) % 7')} AS form,
        CASE WHEN pos % 2 = 0 THEN pos * 100 END AS size_bytes, CASE WHEN starts_with(href, 'http') THEN href ELSE 'https://www.sec.gov' || href END AS url FROM hl),
      g AS (SELECT page_id, min(pos) FILTER (WHERE form IN ('DEFM14A', 'SC TO-T')) AS p1, min(pos) FILTER (WHERE NOT starts_with(upper(form), 'EX-')) AS p2, min(pos) FILTER (WHERE form = 'EX-99.(A)(1)(A)') AS po FROM d GROUP BY 1),
      c AS (SELECT g.page_id, po, form AS pf, coalesce(p1, p2) AS pp FROM g LEFT JOIN d ON d.page_id = g.page_id AND d.pos = coalesce(p1, p2)),
      i AS (SELECT *, CASE WHEN pp IS NULL THEN 'no primary document identifiable' WHEN pf = '425' THEN 'excluded form type 425' WHEN pf NOT IN ('DEFM14A', 'SC TO-T') THEN 'unknown substantive form type ' || pf END AS issue FROM c)
      SELECT i.page_id, issue, CASE WHEN issue IS NULL AND pf = 'SC TO-T' AND po IS NULL THEN 'cover form used; no offer exhibit found' END AS warning, d.name, d.form AS form_type, d.size_bytes, d.url
      FROM i LEFT JOIN d ON issue IS NULL AND d.page_id = i.page_id AND d.pos = CASE WHEN pf = 'SC TO-T' AND po IS NOT NULL THEN po ELSE pp END""",
    "bind_quotes": f"""WITH q AS (SELECT item_id, text AS quote FROM benchmark), hit AS (SELECT q.item_id, d.doc_id, d.text, {COUNT_IN} AS n FROM q JOIN documents d ON contains(d.text, q.quote)),
      s AS (SELECT item_id, CAST(sum(n) AS BIGINT) AS n, min(doc_id) AS doc_id FROM hit GROUP BY 1),
      j AS (SELECT q.*, coalesce(n, 0) AS n, CASE WHEN n = 1 THEN s.doc_id END AS doc_id FROM q LEFT JOIN s USING (item_id)), l AS (SELECT j.*, strpos(d.text, quote) - 1 AS a, {made("filing", "'doc_' || j.doc_id")} AS fid FROM j LEFT JOIN documents d ON d.doc_id = j.doc_id)
      SELECT item_id, CASE WHEN n = 0 THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'bound' END AS status, n AS occurrences, 'doc_' || doc_id AS deal_slug, CASE WHEN doc_id IS NOT NULL THEN 'page_1_paragraph_1' END AS unit_id, a AS span_start, a + length(quote) AS span_end,
        CASE WHEN doc_id IS NOT NULL THEN sha256(quote) END AS quote_text_hash, CASE WHEN doc_id IS NOT NULL THEN {made("ev", "fid", "a", "a + length(quote)", "sha256(quote)")} END AS evidence_id,
        CASE WHEN doc_id IS NOT NULL THEN sha256(fid || {U} || a || {U} || (a + length(quote)) || {U} || sha256(quote)) END AS evidence_fingerprint FROM l""",
    "unbound_quotes": f"""WITH q AS (SELECT conv_id, turn, text AS quote FROM conversations), s AS (SELECT conv_id, turn, CAST(sum({COUNT_IN}) AS BIGINT) AS n FROM q JOIN documents d ON contains(d.text, q.quote) GROUP BY 1, 2)
      SELECT q.conv_id, q.turn, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'bound' END AS status, coalesce(n, 0) AS occurrences FROM q LEFT JOIN s USING (conv_id, turn)""",
    "ambiguous_quotes": f"""WITH q AS (SELECT doc_id AS id, split_part(text, chr(10), 1) AS quote FROM documents), s AS (SELECT q.id, CAST(sum({COUNT_IN}) AS BIGINT) AS n FROM q JOIN documents d ON contains(d.text, q.quote) GROUP BY 1)
      SELECT id AS doc_id, n AS occurrences FROM s WHERE n > 1""",
    "quote_candidates": "WITH " + LINES + """, q AS (SELECT DISTINCT source, split_part(text, chr(10), 1) AS quote FROM documents), u AS (SELECT un.*, source FROM un JOIN documents USING (doc_id)),
      h AS (SELECT q.source, quote, doc_id, pi, CAST((length(t) - length(replace(t, quote, ''))) / length(quote) AS INTEGER) AS n, row_number() OVER (PARTITION BY q.source, quote ORDER BY doc_id, pi) AS r FROM q JOIN u ON u.source = q.source AND contains(t, quote))
      SELECT source AS deal_slug, sha256(quote) AS quote_hash, r AS rank, 'page_' || doc_id || '_paragraph_' || pi AS citation_unit_id, doc_id AS page_number, pi AS paragraph_index, n AS match_count FROM h WHERE r <= 8""",
    "stitched_quotes": """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) SELECT 'doc_' || doc_id AS deal_slug, sha256(right(l[1], 30) || chr(10) || left(l[2], 30)) AS quote_hash, 'page_1_paragraph_1,page_1_paragraph_2' AS stitched FROM l WHERE len(l) >= 2""",
    "stitched_anywhere": "WITH " + LINES + """, l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
      q AS (SELECT doc_id, right(l[len(l) // 2], 30) || chr(10) || left(l[len(l) // 2 + 1], 30) AS quote FROM l WHERE len(l) >= 2),
      u AS (SELECT doc_id, pi, t, coalesce(sum(length(t) + 2) OVER (PARTITION BY doc_id ORDER BY pi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM un),
      p AS (SELECT s.doc_id, s.pi AS s, e.pi AS e, e.t, quote FROM u s JOIN q USING (doc_id) JOIN u e ON e.doc_id = s.doc_id AND e.pi > s.pi AND (e.pi = s.pi + 1 OR e.a - 2 - s.a <= length(quote) + 1000)),
      j AS (SELECT p.doc_id, s, e, any_value(p.t) AS t, any_value(quote) AS quote, string_agg(u.t, chr(10) || chr(10) ORDER BY u.pi) AS head FROM p JOIN u ON u.doc_id = p.doc_id AND u.pi >= s AND u.pi < e GROUP BY ALL),
      h AS (SELECT doc_id, quote, arg_min(e, s * 1000000 + e) AS e, min(s) AS s FROM j WHERE contains(head || chr(10) || chr(10) || t, quote) OR contains(head || chr(10) || t, quote) OR contains(head || ' ' || t, quote) GROUP BY ALL)
      SELECT 'doc_' || doc_id AS deal_slug, sha256(quote) AS quote_hash, array_to_string(list_transform(range(s, e + 1), lambda i: 'page_1_paragraph_' || i), ',') AS stitched FROM h""",
    "flag_log_lines": """WITH r AS (SELECT event_id, user_id, event_type, CAST(event_id // 20000 AS INTEGER) AS log, event_id % 53 AS m FROM events),
      n AS (SELECT *, row_number() OVER (PARTITION BY log ORDER BY event_id) AS line FROM r)
      SELECT log, line, CASE WHEN m IN (9, 13) THEN NULL ELSE 'deal_' || user_id END AS deal_slug, CASE WHEN m IN (9, 13) THEN 'error' ELSE event_type END AS severity,
        CASE WHEN m NOT IN (9, 13) THEN CAST(event_id AS VARCHAR) END AS event,
        CASE m WHEN 9 THEN 'flag log line ' || line || ' is not a JSON object' WHEN 13 THEN 'flag log line ' || line || ' is not valid JSON' END AS message FROM n WHERE m <> 5""",
    "stream_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 120 SECONDS THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g WHERE ts IS NOT NULL)
      SELECT user_id, min(ts) AS started, max(ts) AS last_activity, count(*) AS activities FROM s GROUP BY user_id, session""",
    "integrity_flags": """WITH o AS (SELECT 'd' || (o_orderkey % 100) AS deal_slug, CAST(o_orderkey AS VARCHAR) AS id, o_orderkey AS k, 'obl_' || left(o_orderpriority, 1) AS obl, o_orderstatus AS s FROM orders),
      l AS (SELECT 'd' || (l_orderkey % 100) AS deal_slug, CAST(l_orderkey AS VARCHAR) AS id, 's' || l_suppkey AS a, l_suppkey AS sk, l_orderkey || '-' || l_linenumber AS link FROM lineitem), has AS (SELECT DISTINCT deal_slug, id FROM l),
      c AS (SELECT o.*, CASE WHEN k % 40 = 0 THEN 0 WHEN k % 50 = 1 THEN 2 ELSE 1 END AS nd, has.id IS NOT NULL AS ev FROM o LEFT JOIN has USING (deal_slug, id)),
      d AS (SELECT *, CASE WHEN nd = 1 THEN s <> 'P' END AS sup FROM c),
      f AS (SELECT deal_slug, 'DG_CLAIM_DISPOSITION_MISSING' AS code, 'claims' AS row_table, 'Every claim must have exactly one current disposition.' AS reason, id FROM d WHERE nd <> 1 UNION ALL
        SELECT deal_slug, 'DG_CLAIM_EVIDENCE_MISSING', 'claims', 'Every claim must link to source evidence.', id FROM d WHERE coalesce(sup, true) AND NOT ev UNION ALL
        SELECT deal_slug, 'DG_CLAIM_COVERAGE_LINK_MISSING', 'claims', 'Claims emitted for an obligation must link back to that obligation.', id FROM d WHERE coalesce(sup, true) AND k % 30 = 0 UNION ALL
        SELECT DISTINCT deal_slug, 'DG_COVERAGE_RESULT_MISSING', 'coverage_obligations', 'Every current applicable obligation must have exactly one current coverage result.', obl FROM d WHERE sup AND deal_slug = 'd7' UNION ALL
        SELECT deal_slug, 'DG_ROW_EVIDENCE_MISSING', 'events', 'Canonical events row must link to source evidence.', id FROM d WHERE NOT ev AND k % 60 <> 0 UNION ALL
        SELECT deal_slug, 'DG_ROW_EVIDENCE_MISSING', 'actor_relations', 'Canonical actor_relations row must link to source evidence.', id FROM d WHERE NOT ev AND k % 5 = 0 UNION ALL
        SELECT deal_slug, 'DG_ROW_EVIDENCE_MISSING', 'participation_counts', 'Canonical participation_counts row must link to source evidence.', id FROM d WHERE NOT ev AND k % 7 = 0 UNION ALL
        SELECT l.deal_slug, 'DG_EVENT_LINK_ORPHAN', 'event_actor_links', 'Event actor link references a missing event.', link FROM l WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.deal_slug = l.deal_slug AND o.id = l.id AND k % 60 <> 0) UNION ALL
        SELECT deal_slug, 'DG_EVENT_LINK_ORPHAN', 'event_actor_links', 'Event actor link references a missing actor.', link FROM l WHERE sk % 25 = 0)
      SELECT deal_slug, code, row_table, reason, count(*) AS flags, min(id) AS first_row FROM f GROUP BY 1, 2, 3, 4""",
    "date_precision": f"""WITH d AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN x WHEN 1 THEN left(x, 7) WHEN 2 THEN left(x, 4) WHEN 3 THEN 'early ' || left(x, 4) WHEN 4 THEN '' END AS v FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS x FROM orders))
      SELECT o_orderkey, {precision('v')} AS date_precision FROM d""",
    "initiator": "WITH " + E + f", t AS (SELECT event_id, lower(phrase || ' ' || label) AS t, {pick(EVENT_SUBTYPE, 'k % 18')} AS s FROM e), f AS (SELECT *, {lookup(EVENT_CODES, 's', 0)} AS fam FROM t) SELECT event_id, {started('t', 'fam', 's')} AS initiated_by FROM f",
    "dropout_reason": "WITH " + E + f", t AS (SELECT event_id, lower(phrase) AS t, {pick(('bidder', 'target', 'no_response', 'not_applicable'), 'k % 4')} AS side FROM e) SELECT event_id, {left_reason('t', 'side')} AS dropout_reason FROM t",
    "labels": f"""WITH p AS (SELECT *, lower(replace(p_name, ' ', '_')) AS code, CASE WHEN p_size % 3 > 0 THEN p_size % 9 END AS lo, CASE WHEN p_size % 2 > 0 THEN p_size % 9 END AS hi, CASE WHEN p_size % 5 > 1 THEN p_retailprice END AS v, CASE WHEN p_size % 5 = 1 THEN p_retailprice END AS l FROM part)
      SELECT p_partkey, {title('code')} AS title, CASE WHEN lo IS NOT NULL AND lo = hi THEN CAST(lo AS VARCHAR) WHEN lo IS NOT NULL OR hi IS NOT NULL THEN ({num('lo')}) || '-' || ({num('hi')}) ELSE 'unknown number of' END || ' ' || lower(p_type) || ' parties' AS count_party,
        CASE WHEN v IS NOT NULL THEN ' (' || v || ')' WHEN l IS NOT NULL THEN ' (' || l || '-)' ELSE '' END AS value_label,
        CASE p_partkey % 4 WHEN 0 THEN p_name || ' submitted ' || CASE WHEN p_size % 2 = 0 THEN 'revised' ELSE 'unspecified' END || ' bid' WHEN 1 THEN p_name || ' signed NDA' WHEN 2 THEN p_name || ' did not respond or proceed' ELSE 'Cohort Closed: ' || p_name END AS review_label,
        p_size % 4 = 0 OR {any_of('lower(p_name)', ('group', '/', 'consortium', 'club'))} AS is_group, p_size % 4 = 1 OR {any_of('lower(p_name)', ('parties', 'bidders', 'buyers', 'sponsors', 'companies', 'remaining'))} AS is_cohort FROM p""",
    "column_profile": """WITH v AS (SELECT CASE WHEN p_size % 7 = 0 THEN '∅ (empty)' ELSE p_brand END AS value FROM part), c AS (SELECT value, count(*) AS n FROM v GROUP BY 1)
      SELECT 'p_type' AS column_name, value, n, n / (SELECT count(*) FROM v)::DOUBLE AS share FROM c ORDER BY n DESC, value LIMIT 12""",
    "number_profile": """WITH v AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) AS r, count(*) OVER () AS n FROM lineitem)
      SELECT 'l_extendedprice' AS column_name, max(n) AS n, min(v) AS min, max(v) FILTER (WHERE r = n // 2 + 1) AS median, max(v) AS max FROM v""",
    "browse_filter": "SELECT c_custkey, c_name, c_mktsegment AS event_code, 'n' || c_nationkey AS deal_slug FROM customer WHERE c_mktsegment = 'BUILDING' AND contains(lower(c_name), 'r#0000001')",
    "burden_status": "WITH " + EV + """, b AS (SELECT deal_slug, count(*) FILTER (WHERE event_type = 'error' AND k < user_id) AS n, string_agg(DISTINCT 'DG_' || (event_id % 3), ', ' ORDER BY 'DG_' || (event_id % 3)) FILTER (WHERE event_type = 'click' AND k = 7) AS codes FROM ek GROUP BY 1)
      SELECT deal_slug, 'r1' AS run_id, CASE WHEN codes IS NOT NULL THEN 'failed_system' WHEN n = 0 THEN 'passed_clean' WHEN n <= 10 THEN 'needs_review' ELSE 'high_burden' END AS status, CASE WHEN codes IS NOT NULL THEN 0 ELSE n END AS flag_count,
        CASE WHEN codes IS NOT NULL THEN 'graph integrity validation failed: ' || codes ELSE 'review_burden=' || n END AS notes FROM b""",
    "flag_counts": "WITH " + FLAG_ROWS + """, d AS (SELECT DISTINCT deal_slug FROM ek) SELECT deal_slug, 'r1' AS run_id, count(*) FILTER (WHERE fl.deal_slug IS NOT NULL AND coalesce(severity, '') NOT IN ('soft', 'info')) AS hard,
      count(*) FILTER (WHERE severity = 'soft') AS soft, count(*) FILTER (WHERE severity = 'info') AS info FROM d LEFT JOIN fl USING (deal_slug) GROUP BY deal_slug""",
    "flag_matrix": "WITH " + FLAG_ROWS + """, u AS (SELECT DISTINCT deal_slug, severity, code, event_id, actor_id FROM fl) SELECT deal_slug, 'r1' AS run_id, severity, CASE WHEN code = '' THEN 'unknown' ELSE code END AS code, count(*) AS flags FROM u
      WHERE severity IN ('hard', 'soft') GROUP BY 1, 3, 4""",
    "hard_flag_ids": "WITH " + FLAG_ROWS + """ SELECT deal_slug, 'r1' AS run_id, coalesce(nullif(concat_ws('|', event_id, nullif(actor_id, '')), ''), 'graph') || ':' || CASE WHEN code = '' THEN 'unknown' ELSE code END AS identity, count(*) AS times
      FROM fl WHERE severity = 'hard' GROUP BY 1, 3""",
    "latest_runs": "WITH " + RUNS + """, x AS (SELECT *, count(*) OVER (PARTITION BY deal_slug) AS tot, row_number() OVER (PARTITION BY deal_slug ORDER BY fin DESC, run_id DESC) AS rk FROM rn WHERE elig)
      SELECT deal_slug, run_id, fin AS finished_at, rk AS recency, tot AS eligible_runs FROM x WHERE rk <= 3 AND tot >= 3""",
    "latest_pointer": "WITH " + RUNS + """, x AS (SELECT *, row_number() OVER (PARTITION BY deal_slug ORDER BY fin DESC, run_id DESC) AS rk FROM rn)
      SELECT 'audit_v3' AS schema_version, deal_slug AS slug, run_id, outcome, elig AS stability_eligible, 'runs/' || run_id || '/manifest.json' AS manifest_path, CASE WHEN k % 2 = 0 THEN 'runs/' || run_id || '/raw_response.json' END AS raw_response_path,
        'runs/' || run_id || '/validation.json' AS validation_path FROM x WHERE rk = 1""",
    "stability_class": "WITH " + STABLE_RUNS + " SELECT deal_slug, classification, reasons, tot AS eligible_runs, status, coalesce(CASE WHEN tot >= 3 THEN sel END, '') AS selected_runs FROM res",
    "stability_overall": "WITH " + STABLE_RUNS + """ SELECT CASE WHEN bool_or(classification LIKE 'INSUFF%') THEN 'INSUFFICIENT_ARCHIVED_RUNS' WHEN bool_or(classification LIKE 'UNSTABLE%') THEN 'UNSTABLE_RULE_OR_VALIDATOR_FIX_NEEDED' ELSE 'STABLE_FOR_REFERENCE_REVIEW' END AS classification,
      count(*) AS deals FROM res""",
    "release_gate": "WITH " + STABLE_RUNS + """, r AS (SELECT count(*) AS n, count(*) FILTER (WHERE c_custkey % 11 = 0 AND c_custkey % 10 = 0) AS v FROM customer WHERE c_custkey % 5 = 0),
      w AS (SELECT CASE WHEN bool_or(classification LIKE 'INSUFF%') THEN 'INSUFFICIENT_ARCHIVED_RUNS' WHEN bool_or(classification LIKE 'UNSTABLE%') THEN 'UNSTABLE_RULE_OR_VALIDATOR_FIX_NEEDED' ELSE 'STABLE_FOR_REFERENCE_REVIEW' END AS c FROM res WHERE c % 5 = 0),
      b AS (SELECT 'stability proof slug ' || deal_slug || ' classification=' || classification AS m FROM res WHERE c % 5 = 0 AND classification NOT LIKE 'STABLE%' ORDER BY deal_slug LIMIT 1),
      g AS (SELECT n, v, CASE WHEN w.c NOT LIKE 'STABLE%' THEN 'stability proof classification=' || w.c ELSE (SELECT m FROM b) END AS p FROM r, w)
      SELECT n AS references, v AS verified, coalesce(p, 'stability proof accepted') AS proof_reason, false AS is_open, concat_ws('; ', CASE WHEN n > v THEN 'all ' || n || ' reference deals must have verified=true reference metadata; missing ' || (SELECT string_agg(d, ', ' ORDER BY d) FROM (SELECT 'deal_' || c_custkey AS d FROM customer WHERE c_custkey % 5 = 0 AND NOT (c_custkey % 11 = 0 AND c_custkey % 10 = 0) ORDER BY d LIMIT 10)) || CASE WHEN n - v > 10 THEN ', ... (+' || (n - v - 10) || ' more)' ELSE '' END END, p, 'operator must pass --release-targets') AS blockers FROM g""",
    "call_summary": "WITH " + EV + """ SELECT deal_slug, 'r1' AS run_id, CAST(coalesce(sum(CASE WHEN k % 10 <> 0 THEN k % 4 END), 0) AS BIGINT) AS total_attempts, CAST(sum(k % 3) AS BIGINT) AS watchdog_warnings, arg_min('hash_' || k, event_id) FILTER (WHERE event_type = 'view' AND k % 9 <> 0) AS prompt_hash,
      CAST(sum(k * 10) AS BIGINT) AS total_input_tokens, CAST(sum(k) AS BIGINT) AS total_output_tokens, 0 AS total_reasoning_tokens FROM ek GROUP BY 1""",
    "pool_summary": "WITH " + STATE + f""" SELECT c % 10 AS pool, count(*) AS selected, count(*) FILTER (WHERE status IN {TRUSTED}) AS succeeded, count(*) FILTER (WHERE status IS NULL) AS skipped, count(*) FILTER (WHERE status IN ('failed_system', 'stale_after_failure')) AS failed,
      {', '.join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in STATE_VALUES[:5])} FROM st GROUP BY 1""",
    "skip_plan": "WITH " + STATE + f""" SELECT deal_slug, CASE WHEN status = 'verified_old' THEN 'blocked' WHEN status IN {TRUSTED} AND rules = 'rules_1' THEN 'skip' ELSE 'run' END AS action,
      CASE WHEN status = 'verified_old' THEN 'retired or unknown stored status=verified_old; rerun with --re-extract' WHEN status IN {TRUSTED} AND rules = 'rules_1' THEN 'status=' || status || ' rulebook unchanged' ELSE 'pending, failure status, or stale rulebook' END AS reason FROM st""",
    "deal_selection": "WITH " + STATE + " SELECT deal_slug, status FROM st WHERE status IS NULL OR status = 'pending'",
    "progress_upsert": "WITH " + STATE + ", " + RUNS + f""", x AS (SELECT *, row_number() OVER (PARTITION BY deal_slug ORDER BY fin DESC, run_id DESC) AS rk FROM rn), b AS (SELECT 'deal_' || (c + 10) AS deal_slug, outcome, k % 12 AS fc, rules AS br, fin, run_id FROM x WHERE rk = 1)
      SELECT coalesce(st.deal_slug, b.deal_slug) AS deal_slug, coalesce(is_ref, false) AS is_reference, CASE WHEN b.deal_slug IS NOT NULL THEN outcome ELSE status END AS status, CASE WHEN b.deal_slug IS NOT NULL THEN fc ELSE flag_count END AS flag_count,
        CASE WHEN b.deal_slug IS NOT NULL THEN fin ELSE last_run END AS last_run, CASE WHEN b.deal_slug IS NOT NULL THEN b.run_id ELSE last_run_id END AS last_run_id,
        CASE WHEN b.deal_slug IS NULL THEN notes WHEN is_ref AND reviewed THEN 'review_burden; prior filing-grounded verification metadata preserved' ELSE 'review_burden' END AS notes, CASE WHEN b.deal_slug IS NOT NULL THEN br ELSE rules END AS rulebook_version,
        CASE WHEN b.deal_slug IS NOT NULL AND is_ref AND reviewed THEN true ELSE verified END AS verified, CASE WHEN b.deal_slug IS NOT NULL THEN 1 ELSE 0 END AS history FROM st FULL JOIN b ON b.deal_slug = st.deal_slug""",
    "history_cap": "WITH " + RUNS + """, x AS (SELECT *, row_number() OVER (PARTITION BY deal_slug ORDER BY fin DESC, run_id DESC) AS rk FROM rn) SELECT deal_slug, string_agg(run_id, ',' ORDER BY fin, run_id) AS runs FROM x WHERE rk <= 10 GROUP BY 1""",
    "failure_status": "WITH " + STATE + f" SELECT 'deal_' || (s_suppkey * 17) AS deal_slug, CASE WHEN status IN {TRUSTED} THEN 'stale_after_failure' ELSE 'failed_system' END AS status FROM supplier LEFT JOIN st ON st.deal_slug = 'deal_' || (s_suppkey * 17)",
    "flag_multiset_diff": "WITH " + EV + """, a AS (SELECT deal_slug, '{"code":"' || event_type || '","k":' || (k % 10) || '}' AS flag, count(*) AS in_output, count(*) FILTER (WHERE event_id % 97 <> 0) AS in_log FROM ek GROUP BY 1, 2) SELECT * FROM a WHERE in_output <> in_log""",
    "quote_grounding": """SELECT a.doc_id AS ref, a.doc_id + a.doc_id % 2 AS page_number, coalesce(contains(b.text, split_part(a.text, chr(10), 1)), false) AS grounded FROM documents a LEFT JOIN documents b ON b.doc_id = a.doc_id + a.doc_id % 2""",
    "verify_eligibility": "WITH " + STATE + ", " + OUT + f""", r AS (SELECT st.deal_slug, CASE WHEN schema IS NULL THEN 'missing extraction' WHEN NOT is_ref THEN 'slug is not a reference deal' WHEN status IS NULL OR status NOT IN {TRUSTED} THEN 'status is not a trusted extraction status'
        WHEN ou.run_id <> last_run_id THEN 'extraction run_id does not match progress last_run_id' WHEN length(st.deal_slug) % 4 = 0 THEN 'hard flags: 2' WHEN schema <> 'deal_graph_v2' THEN 'extraction schema_version is not deal_graph_v2' END AS reason
      FROM st LEFT JOIN ou USING (deal_slug)) SELECT deal_slug, reason IS NULL AS eligible, reason FROM r""",
    "idle_gaps": """WITH g AS (SELECT user_id, ts, date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts), ts) / 1000000.0 AS gap FROM events)
      SELECT user_id, count(*) AS activities, max(gap) AS max_idle_seconds, count(*) FILTER (WHERE gap >= 90) AS warnings, count(*) FILTER (WHERE gap >= 120) > 0 AS stream_idle, date_diff('microsecond', min(ts), max(ts)) / 1000000.0 >= 600 AS total_exceeded FROM g GROUP BY 1""",
    "reconcile_issues": "WITH " + STATE + ", " + OUT + f""",
      j AS (SELECT st.*, ou.schema, ou.has_deal, ou.run_id AS o_run, ou.burden, ou.est, ou.jsonl, ou.deal_slug IS NOT NULL AS have, coalesce(status = 'failed_system', false) AS failed FROM st LEFT JOIN ou USING (deal_slug)),
      b AS (SELECT *, NOT failed AND have AND has_deal AS body, CASE WHEN schema = 'deal_graph_v2' AND burden IS NOT NULL THEN burden ELSE 0 END AS cnt,
        CASE WHEN schema = 'deal_graph_v2' AND burden IS NOT NULL THEN CASE WHEN burden = 0 THEN 'passed_clean' WHEN burden <= 10 THEN 'needs_review' ELSE 'high_burden' END ELSE 'failed_system' END AS exp FROM j),
      v AS (SELECT *, body AND coalesce(status = 'stale_after_failure', false) AS stale, body AND NOT coalesce(status = 'stale_after_failure', false) AS live FROM b),
      la AS (SELECT st.*, c % 12 <> 5 AS have, CASE WHEN c % 21 = 0 THEN 'run_x' ELSE last_run_id END AS l_run, c % 22 <> 0 AS l_elig, ou.run_id AS o_run FROM st LEFT JOIN ou USING (deal_slug) WHERE status IN ('passed_clean', 'needs_review', 'high_burden', 'failed_system', 'stale_after_failure')),
      rf AS (SELECT 'deal_' || c_custkey AS deal_slug, c_custkey % 5 = 0 AS is_ref FROM customer WHERE c_custkey % 9 = 0) """ + " UNION ALL ".join([
        issue_union("rf", _R("NOT is_ref", "reference_not_marked", "'reference slug ' || deal_slug || ' is not marked is_reference=true'")),
        issue_union("st", _R("NOT is_ref AND verified", "target_verified", "'target deals must not carry verified reference metadata'"),
                    _R("status IN ('pending', 'verified_old')", "status_taxonomy", "'stored status ' || status || ' is not in the live extraction taxonomy'")),
        issue_union("v", _R("failed AND have", "failure_output_present", "'failed_system must not leave a trusted latest extraction output'"),
                    _R("NOT failed AND NOT have", "missing_output", "'latest output is missing for status=' || coalesce(status, 'None')"),
                    _R("NOT failed AND have AND NOT has_deal", "output_deal_missing", "'output deal object is missing'"),
                    _R("body AND schema <> 'deal_graph_v2'", "output_schema", "'latest output schema_version must be deal_graph_v2'"),
                    _R("body AND est", "estimator_output_present", "'trusted extraction output must not contain estimation_bidder_rows'"),
                    _R("body AND burden IS NULL", "review_rows_missing", "'latest output must contain review_rows'"),
                    _R("stale AND o_run = last_run_id", "reference_artifact_stale", "'stale_after_failure must point progress at the failed run while output remains from a prior trusted run'"),
                    _R("stale AND o_run <> last_run_id", "reference_artifact_stale", "'latest trusted output is stale because the newest run failed'", "warning"),
                    _R("live AND o_run <> last_run_id", "run_id_mismatch", "'output last_run_id must match progress last_run_id'"),
                    _R("live AND last_run IS NULL", "last_run_mismatch", "'output last_run must match progress last_run'"),
                    _R("live AND cnt <> flag_count", "flag_count_mismatch", "'progress flag_count=' || flag_count || ' but output has ' || cnt"),
                    _R("live AND exp IS DISTINCT FROM status", "status_mismatch", "'progress status=' || coalesce(status, 'None') || ' but output flags imply ' || exp"),
                    _R("live AND NOT jsonl", "review_jsonl_missing", "'trusted status requires the review rows file'")),
        issue_union("la", _R("NOT have", "missing_latest_audit", "'latest audit pointer is missing or unreadable'"),
                    _R("have AND l_run <> last_run_id", "audit_latest_run_id_mismatch", "'latest audit run_id must match progress last_run_id'"),
                    _R(f"have AND status IN {TRUSTED} AND o_run IS NOT NULL AND l_run <> o_run", "audit_latest_run_id_mismatch", "'trusted latest audit run_id must match output last_run_id'"),
                    _R("have AND status = 'stale_after_failure' AND o_run = last_run_id", "reference_artifact_stale", "'stale_after_failure must leave a prior trusted output in place, not refresh it'"),
                    _R(f"have AND status NOT IN {TRUSTED} AND l_elig", "failed_stability_eligible", "'failure runs must have stability_eligible=false'"),
                    _R(f"have AND status IN {TRUSTED} AND NOT l_elig", "trusted_stability_ineligible", "'trusted extraction runs must have stability_eligible=true'"),
                    *[_R(f"have AND l_run <> last_run_id{x}", "audit_path_not_archived", f"'latest {k} must be runs/' || l_run || '/{n}'")
                      for k, n, x in (("manifest_path", "manifest.json", ""), ("raw_response_path", "raw_response.json", " AND c % 23 <> 0"), ("validation_path", "validation.json", ""))],
                    _R(f"have AND status IN {TRUSTED} AND c % 23 = 0", "audit_required_file_missing", "'finalized run latest must reference raw_response_path'"))]),
}


def hist(table: str, key: str, name: str, where: str = "true") -> str:
    """One run's histogram as `key=n, key=n` text."""
    return (f"{name} AS (SELECT deal_slug, string_agg(key || '=' || n, ', ' ORDER BY key) AS {name} FROM "
            f"(SELECT deal_slug, {key} AS key, count(*) AS n FROM {table} WHERE {where} GROUP BY 1, 2) GROUP BY 1)")


_TABLES = (("actor_relations", "relations"), ("actors", "actors"), ("claim_dispositions", "judged"), ("claims", "claims"),
           ("coverage_results", "(SELECT DISTINCT deal_slug, obl FROM good)"), ("event_actor_links", "links"), ("events", "ev"), ("participation_counts", "cnt"))
_ALIAS = "lower(f_actor_label)"
_METRICS = chain("REVIEW", "").rstrip() + f""",
rej AS (SELECT j.deal_slug, u0, q0 FROM judged j WHERE rejected),
rv AS (SELECT deal_slug, status, f_subtype, f_actor_label, f_date, f_bv, f_bl, f_bu, f_unit, f_cons, bq, bp FROM review UNION ALL
  SELECT deal_slug, 'rejected_claim', '', '', '', NULL, NULL, NULL, '', '', '', '' FROM rej),
tot AS (SELECT deal_slug, count(*) AS row_count, count(*) FILTER (WHERE status <> 'clean') AS review_item_count,
  count(*) FILTER (WHERE regexp_matches(replace({_ALIAS}, '  ', ' '), '^party [a-z0-9]+$|^bidder [a-z0-9]+$')) AS anonymous_placeholder_count,
  count(*) FILTER (WHERE regexp_matches(replace({_ALIAS}, '  ', ' '), '\\b(?:party|bidder|sponsor|strategic party|financial sponsor)\\s+[a-z0-9]+\\b')) AS cohort_like_placeholder_count FROM rv GROUP BY 1),
tc AS (SELECT deal_slug, string_agg(key || '=' || n, ', ' ORDER BY key) AS graph_table_counts FROM (
  {" UNION ALL ".join(f"SELECT deal_slug, '{n}' AS key, count(*) AS n FROM {t} GROUP BY 1" for n, t in _TABLES)}) GROUP BY 1),
{hist("rv", "CASE WHEN f_subtype = '' THEN 'null' ELSE f_subtype END", "event_subtype_counts")},
{hist("claims", "kind", "claim_type_counts")},
{hist("relations", "rtype", "relation_type_counts")},
{hist("rv", "CASE WHEN f_date = '' THEN 'undated' ELSE 'dated' END", "date_diagnostics")},
{hist("rv", "'review/' || CASE WHEN f_bv IS NULL THEN 'no_' ELSE '' END || 'value/' || CASE WHEN f_bl IS NULL THEN 'no_' ELSE '' END || 'lower/' || CASE WHEN f_bu IS NULL THEN 'no_' ELSE '' END || 'upper/unit:' || CASE WHEN f_unit = '' THEN 'null' ELSE f_unit END || '/consideration:' || CASE WHEN f_cons = '' THEN 'null' ELSE f_cons END", "bid_value_representation")},
{hist("(SELECT deal_slug, unnest([CASE WHEN bq = '' THEN 'missing_quote' END, CASE WHEN length(bq) > 1500 THEN 'overlength_quote' END, CASE WHEN bp = '' THEN 'missing_page' END]) AS key FROM rv)", "key", "quote_diagnostics", "key IS NOT NULL")},
{hist("flags", "CASE WHEN n_bound = 0 THEN 'blocking' ELSE 'soft' END || ':evidence_ref_binding_failed'", "flag_counts")}
SELECT deal_slug, row_count, review_item_count, 'no_hard_flags' AS graph_status, anonymous_placeholder_count, cohort_like_placeholder_count,
  {", ".join(f"coalesce({c}, '-') AS {c}" for c in ("graph_table_counts", "event_subtype_counts", "claim_type_counts", "relation_type_counts", "date_diagnostics", "bid_value_representation", "quote_diagnostics", "flag_counts"))}
FROM tot LEFT JOIN tc USING (deal_slug) LEFT JOIN event_subtype_counts USING (deal_slug) LEFT JOIN claim_type_counts USING (deal_slug) LEFT JOIN relation_type_counts USING (deal_slug) LEFT JOIN date_diagnostics USING (deal_slug)
LEFT JOIN bid_value_representation USING (deal_slug) LEFT JOIN quote_diagnostics USING (deal_slug) LEFT JOIN flag_counts USING (deal_slug)"""
GRAPH_SQL["run_metrics"] = _METRICS
TABLE_SQL["grounding_failures"] = "WITH " + E + """, pg AS (SELECT user_id, event_id AS page, 'Entry ' || event_id || ': ' || phrase || '.' || chr(10) || chr(10) || 'The filing notes ' || event_type || ' activity of ' || label || '.' AS body FROM e),
      probe AS (
        SELECT user_id, CASE WHEN k % 10 <> 7 THEN event_id END AS page, CASE WHEN k % 10 = 3 THEN 'not there' ELSE phrase END AS quote,
          'evidence_ref[' || event_id || CASE WHEN k % 10 = 7 THEN '] has invalid citation_unit_id' ELSE '] quote_text is not an exact substring of Filing page ' || event_id END AS message FROM e
        UNION ALL SELECT user_id, event_id + CASE WHEN k % 11 = 5 THEN 1 ELSE 0 END, phrase,
          'graph evidence ev_' || event_id || ' quote_text is not an exact substring of Filing page ' || (event_id + CASE WHEN k % 11 = 5 THEN 1 ELSE 0 END) FROM e
        UNION ALL SELECT user_id, CASE WHEN k % 6 NOT IN (3, 4) THEN event_id END, phrase, 'review row row_' || event_id || ' bound_source_quote is not an exact substring of its Filing page' FROM e WHERE NOT (k % 13 = 1 AND k % 2 = 0)
        UNION ALL SELECT user_id, CASE WHEN k % 6 = 2 THEN event_id + 1 WHEN k % 6 NOT IN (3, 4) THEN event_id END, 'The filing notes', 'review row row_' || event_id || ' bound_source_quote is not an exact substring of its Filing page' FROM e WHERE NOT (k % 13 = 1 AND k % 2 = 0)),
      u AS (SELECT DISTINCT user_id, CASE user_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'r0' ELSE 'r1' END AS last FROM e)
      SELECT DISTINCT 'deal_' || probe.user_id AS deal_slug, message FROM probe LEFT JOIN pg ON pg.user_id = probe.user_id AND pg.page = probe.page WHERE NOT coalesce(contains(body, quote), false)
      UNION ALL SELECT 'deal_' || user_id, CASE WHEN last IS NULL THEN 'progress last_run_id is missing' ELSE 'extraction run_id ' || CASE WHEN user_id % 7 = 0 THEN 'None' ELSE 'r1' END || ' does not match progress last_run_id ' || last END
      FROM u WHERE last IS NULL OR last <> 'r1' OR user_id % 7 = 0"""
_ARCHIVE = "WITH " + STATE + f""", tr AS (SELECT * FROM st WHERE status IN {TRUSTED}),
      archive AS (
        SELECT deal_slug, 'error' AS severity, 'graph_snapshot_missing' AS code, 'trusted run must contain deal_graph_v2.json' AS message FROM tr WHERE c % 9 = 0
        UNION ALL SELECT deal_slug, 'error', 'graph_database_missing', 'trusted run must contain deal_graph.duckdb' FROM tr WHERE c % 10 = 1
        UNION ALL SELECT deal_slug, 'error', 'unexpected_audit_root_entry', 'archive root may contain only latest.json and runs/: notes.txt' FROM st WHERE c % 12 = 0
        UNION ALL SELECT deal_slug, 'error', 'unexpected_audit_root_entry', 'archive root may contain only latest.json and runs/: old' FROM st WHERE c % 25 = 0),
      contract AS (
        SELECT deal_slug, 'error' AS severity, 'rulebook_version_mismatch' AS code, 'manifest rulebook_version must match progress' AS message FROM st WHERE c % 9 = 1
        UNION ALL SELECT deal_slug, 'error', 'audit_manifest_contract_missing', 'manifest missing required extractor_contract_version' FROM st WHERE c % 9 = 2
        UNION ALL SELECT deal_slug, 'error', 'audit_manifest_retired_field', 'manifest must not contain retired tool_calls_count' FROM st WHERE c % 9 = 3
        UNION ALL SELECT deal_slug, 'error', 'audit_manifest_retired_field', 'manifest models must not contain retired adjudicate entry' FROM st WHERE c % 9 = 4
        UNION ALL SELECT deal_slug, 'error', 'raw_response_shape', 'raw response must use the live claim-only payload' FROM st WHERE c % 7 = 1
        UNION ALL SELECT deal_slug, 'error', 'extractor_contract_version_mismatch', 'raw response extractor_contract_version must match manifest' FROM st WHERE c % 7 <> 0 AND c % 9 <> 0 AND (c % 7 = 2 OR c % 9 = 2)),
      log AS (SELECT deal_slug, 'error' AS severity, 'flags_jsonl_mismatch' AS code, 'flag log entries of the latest run must match output flags' AS message FROM st
        WHERE CASE WHEN status IN {TRUSTED} THEN c % 6 = 0 OR (c % 11 = 4 AND c % 4 >= 1) ELSE c % 6 <> 0 END)"""
TABLE_SQL["archive_issues"] = _ARCHIVE + " SELECT * FROM archive"
TABLE_SQL["contract_issues"] = _ARCHIVE + " SELECT * FROM contract"
TABLE_SQL["flag_log_issues"] = _ARCHIVE + " SELECT * FROM log"
TABLE_SQL["reconcile_summary"] = _ARCHIVE + """ SELECT false AS ok, count(*) AS error_count, CAST(0 AS BIGINT) AS warning_count, (SELECT count(*) FROM st) AS checked_slugs
      FROM (SELECT * FROM archive UNION ALL SELECT * FROM contract UNION ALL SELECT * FROM log)"""
GRAPH_SQL["analyst_actors"] = chain("ACTORS", "SELECT deal_slug, actor_label, actor_kind, bidder_class FROM actors")
GRAPH_SQL["analyst_counts"] = chain("ROWS", "SELECT deal_slug, pstage AS process_stage, actor_class, cmin AS count_min, cmax AS count_max, cq AS count_qualifier FROM cnt")
GRAPH_SQL["distinct_codes"] = chain("LEDGER", "SELECT DISTINCT event_code FROM ledger")
TABLE_SQL["sorted_browse"] = """WITH r AS (SELECT c_custkey AS c, 'seg_' || c_mktsegment AS deal, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey * 7 % 100003 END AS code, lower(c_name) AS name FROM customer),
      a AS (SELECT 'number up' AS sorted_by, c, row_number() OVER (ORDER BY code NULLS FIRST) AS i FROM r WHERE code IS NOT NULL OR c = 3
        UNION ALL SELECT 'number down', c, row_number() OVER (ORDER BY code DESC NULLS LAST) FROM r WHERE code IS NOT NULL OR c = 3
        UNION ALL SELECT 'text up', c, row_number() OVER (ORDER BY name) FROM r UNION ALL SELECT 'text down', c, row_number() OVER (ORDER BY name DESC) FROM r
        UNION ALL SELECT 'embed', c, row_number() OVER (ORDER BY deal, CASE WHEN c = 5 THEN NULL ELSE c END NULLS LAST) FROM r WHERE c % 5 <> 0 OR c = 5)
      SELECT sorted_by, string_agg(CAST(c AS VARCHAR), ',' ORDER BY i) AS keys FROM a WHERE i <= 50 GROUP BY 1"""
TABLE_SQL["validation_summary"] = "WITH b AS (" + TABLE_SQL["burden_status"] + "), " + FLAG_ROWS + """ SELECT 'validation_v1' AS schema_version, b.deal_slug, b.run_id, status AS final_status, flag_count,
      count(*) FILTER (severity = 'hard') AS hard_count, count(*) FILTER (severity = 'soft') AS soft_count, count(*) FILTER (severity = 'info') AS info_count FROM b LEFT JOIN fl USING (deal_slug) GROUP BY ALL"""
_RESULTS = "WITH " + STABLE_RUNS + ", cls AS (" + TABLE_SQL["stability_class"].split(STABLE_RUNS)[1].strip() + ")"
TABLE_SQL["gate_references"] = "SELECT 'deal_' || c_custkey AS deal_slug FROM customer WHERE c_custkey % 5 = 0 AND NOT (c_custkey % 11 = 0 AND c_custkey % 10 = 0)"
TABLE_SQL["stability_reasons"] = _RESULTS + """ SELECT deal_slug, CAST(i - 1 AS INTEGER) AS pos, deal_slug || ': ' || string_split(reasons, ' / ')[i] AS reason
      FROM (SELECT *, unnest(range(1, len(string_split(reasons, ' / ')) + 1)) AS i FROM cls WHERE reasons <> '')"""
TABLE_SQL["proof_record"] = _RESULTS + """ SELECT deal_slug AS slug, classification, status, eligible_runs AS eligible_archived_runs, 3 AS required_archived_runs, reasons, selected_runs,
      CASE WHEN selected_runs = '' THEN '' ELSE array_to_string(list_transform(string_split(selected_runs, ','), lambda r: 'output/audit/' || deal_slug || '/runs/' || r), ',') END AS selected_run_dirs FROM cls"""
TABLE_SQL["stability_report"] = _RESULTS + """ SELECT me.deal_slug, me.run_id, classification, outcome, CAST(n AS BIGINT) AS row_count, CAST(ri AS BIGINT) AS review_item_count, CAST(an AS BIGINT) AS anonymous_placeholder_count
      FROM me JOIN cls USING (deal_slug) WHERE list_contains(string_split(selected_runs, ','), me.run_id)"""
_EVENT_RUNS = """runs AS (SELECT deal_slug, 'rules_' || (user_id % 3) AS rules, user_id, date_trunc('second', min(ts)) AS t0, date_trunc('second', max(ts)) AS t1 FROM ek GROUP BY deal_slug, user_id)"""
TABLE_SQL["run_records"] = "WITH b AS (" + TABLE_SQL["burden_status"] + "), " + EV + ", " + _EVENT_RUNS + """,
      p AS (SELECT *, CASE WHEN k % 5 > 0 THEN sha256('rules' || chr(10) || '---' || chr(10) || CASE WHEN k % 3 > 0 THEN event_type || k ELSE '' END) END AS hash FROM ek WHERE event_type IN ('view', 'error') AND user_id % 7 <> 3),
      c AS (SELECT deal_slug, arg_min(hash, event_id) FILTER (event_type = 'view' AND hash IS NOT NULL) AS h, sum(k * 10) AS i, sum(k) AS o, sum(k % 4) AS a, sum(k % 3) AS w FROM p GROUP BY 1)
      SELECT 'audit_run_v3' AS schema_version, deal_slug AS slug, 'r1' AS run_id, strftime(t0, '%Y-%m-%dT%H:%M:%SZ') AS started_at, strftime(t1, '%Y-%m-%dT%H:%M:%SZ') AS finished_at,
        CASE WHEN user_id % 2 = 0 THEN 'run' ELSE 're-extract' END AS action, rules AS rulebook_version, 'contract_1' AS extractor_contract_version, sha256('claims') AS schema_hash, h AS prompt_hash,
        CASE WHEN h IS NULL THEN '{}' ELSE '{"extract":"' || h || '"}' END AS prompt_hashes, 'local' AS llm_backend, '{"extract":"model-' || (user_id % 2) || '"}' AS models, CAST(NULL AS VARCHAR) AS api_endpoint,
        '{"extract":"high"}' AS reasoning_efforts, CAST(coalesce(i, 0) AS BIGINT) AS total_input_tokens, CAST(coalesce(o, 0) AS BIGINT) AS total_output_tokens, CAST(0 AS BIGINT) AS total_reasoning_tokens,
        CAST(coalesce(a, 0) AS BIGINT) AS total_attempts, CAST(coalesce(w, 0) AS BIGINT) AS watchdog_warnings, date_diff('second', t0, t1) AS total_seconds,
        status AS outcome, status <> 'failed_system' AS stability_eligible, CASE WHEN status = 'failed_system' THEN notes END AS error
      FROM runs JOIN b USING (deal_slug) LEFT JOIN c USING (deal_slug)"""
TABLE_SQL["output_records"] = "WITH b AS (" + TABLE_SQL["burden_status"] + "), " + FLAG_ROWS + ", " + _EVENT_RUNS + """,
      n AS (SELECT deal_slug, code, CASE WHEN severity IN ('soft', 'info') THEN severity ELSE 'hard' END AS sev, count(*) AS n FROM fl GROUP BY ALL),
      l AS (SELECT deal_slug, string_agg(code || ' ' || sev || ' ' || n, '; ' ORDER BY code, sev) AS flags FROM n GROUP BY 1)
      SELECT 'deal_graph_v2' AS schema_version, deal_slug, run_id, strftime(t1, '%Y-%m-%dT%H:%M:%SZ') AS last_run, run_id AS last_run_id, rules AS rulebook_version, status, flag_count, notes, coalesce(flags, '') AS deal_flags
      FROM b JOIN runs USING (deal_slug) LEFT JOIN l USING (deal_slug) WHERE status <> 'failed_system'"""
TABLE_SQL["stored_progress"] = TABLE_SQL["progress_upsert"]
GRAPH_SQL["stream_intake"] = chain("BOUND", """SELECT deal_slug, run_id, CASE WHEN refused > 0 THEN 'refused' ELSE kind END AS claim_type,
      CAST(CASE WHEN refused > 0 THEN any_value(refused) ELSE count(*) END AS BIGINT) AS n, CASE WHEN refused = 0 THEN count(*) FILTER (NOT rejected) END AS n_supported,
      CASE WHEN refused = 0 THEN min(place) END AS first_sequence, CASE WHEN refused = 0 THEN max(place) END AS last_sequence
    FROM (SELECT deal AS deal_slug, 'r1' AS run_id, kind, rejected, row_number() OVER (PARTITION BY deal ORDER BY seq) AS place,
        count(*) FILTER (kind = 'event' AND subtype = 'board_meeting') OVER (PARTITION BY deal) AS refused
      FROM (SELECT *, deal_slug || '_' || (event_id // 1000) AS deal FROM judged))
    GROUP BY deal_slug, run_id, refused, CASE WHEN refused > 0 THEN 'refused' ELSE kind END""")

_FAMILY = "CASE kind WHEN 'actor' THEN 'actor_claims' WHEN 'actor_relation' THEN 'actor_relation_claims' WHEN 'event' THEN 'event_claims' WHEN 'bid' THEN 'bid_claims' ELSE 'participation_count_claims' END"
_BROKEN = {
    "m = 1 AND confidence = 'high'": (("'.confidence'", "'value ''sure'' not in allowed enum'"),),
    "m = 2": (("'.confidence'", "'missing required field'"), ("'.konfidence'", "'unexpected field konfidence'")),
    "m = 3": (("'.coverage_obligation_id'", "'expected string; got int'"), ("'.x'", "'unexpected field x'")),
    "m = 4": (("'.evidence_refs'", "'array length 0 below minItems 1'"),),
    "m = 5": (("'.evidence_refs[0].quote_text'", "'missing required field'"), ("'.evidence_refs[0].text'", "'unexpected field text'")),
    "m = 5 AND u1 IS NOT NULL": (("'.evidence_refs[1].quote_text'", "'missing required field'"), ("'.evidence_refs[1].text'", "'unexpected field text'")),
    "m = 6": (("''", "'includes engine-owned fields: event_id'"), ("'.event_id'", "'unexpected field event_id'")),
    "m NOT IN (7, 8) AND kind = 'event' AND subtype = 'board_meeting'": (("'.event_subtype'", "'value ''board_meeting'' not in allowed enum'"),),
}
GRAPH_SQL["payload_violations"] = chain("FEED", "").rstrip() + f""", c AS (SELECT deal_slug, CAST(seq AS VARCHAR) AS run_id, '$.' || {_FAMILY} || '[0]' AS spot, event_id % 12 AS m, kind, confidence, u1, subtype FROM claims)
""" + " UNION ALL ".join(
    [f"SELECT deal_slug, run_id, spot || {path} AS path, {message} AS message FROM c WHERE {cond}" for cond, rows in _BROKEN.items() for path, message in rows]
    + ["SELECT deal_slug, run_id, '$', 'expected JSON object' FROM c WHERE m = 7", "SELECT deal_slug, run_id, '$', 'malformed JSON' FROM c WHERE m = 8",
       "SELECT deal_slug, run_id, '$', 'includes engine-owned fields: T' FROM c WHERE m = 9", "SELECT deal_slug, run_id, '$.T', 'unexpected field T' FROM c WHERE m = 9"])

TABLE_SQL["member_propagation"] = """WITH s AS (SELECT s_suppkey AS k, s_nationkey AS n, s_suppkey * 2 AS t, CASE s_suppkey % 5 WHEN 0 THEN 'strategic' WHEN 1 THEN 'financial' ELSE 'unknown' END AS c FROM supplier),
i AS (SELECT n, min(t) FILTER (WHERE c = 'strategic') AS si, min(t) FILTER (WHERE c = 'financial') AS fi FROM s GROUP BY 1),
n AS (SELECT n_nationkey AS k, n_regionkey AS r, n_nationkey * 6 + 1 AS t, n_nationkey % 9 = 8 AS locked, si, fi FROM nation LEFT JOIN i ON i.n = n_nationkey),
m AS (SELECT *, CASE WHEN locked THEN 1e18 ELSE coalesce(si, 1e18) END AS sa, CASE WHEN NOT locked AND coalesce(fi, 1e18) < coalesce(si, 1e18) THEN coalesce(fi, 1e18) ELSE 1e18 END AS fa FROM n),
g AS (SELECT r, bool_or(sa < t) AS ss, bool_or(fa < t AND t <= sa) AS ff FROM m GROUP BY 1)
SELECT 's' || k AS actor_id, c AS bidder_class, false AS has_strategic_member, false AS has_financial_member FROM s UNION ALL
SELECT 'n' || k, CASE WHEN locked THEN 'mixed' WHEN si IS NOT NULL THEN 'strategic' WHEN fi IS NOT NULL THEN 'financial' ELSE 'unknown' END, si IS NOT NULL, fi IS NOT NULL FROM n UNION ALL
SELECT 'r' || r, CASE WHEN ss THEN 'strategic' WHEN ff THEN 'financial' ELSE 'unknown' END, ss, ff FROM g"""
