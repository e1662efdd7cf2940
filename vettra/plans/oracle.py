"""SQL building blocks for the counterparts of the registered queries.

Plain brute force on purpose: every name meets every entry that shares a block key, and all rules are CASE
expressions. Nothing here is used by the engine.
"""

from __future__ import annotations

from vettra.constants import COUNTRY_BY_NAME, COUNTRY_CODES
from vettra.plans import fixtures as fx


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _first(x: str) -> str:
    f = f"(({x} * 31) % 60)"
    return f"({_list(fx.FIRST_HEAD)}[{f} % 10 + 1] || {_list(fx.FIRST_TAIL)}[{f} // 10 + 1])"


def _last(x: str) -> str:
    n = f"(({x} * 17 + {x} // 60) % 60)"
    return f"({_list(fx.LAST_HEAD)}[{n} % 10 + 1] || {_list(fx.LAST_TAIL)}[{n} // 10 + 1])"


def _day(offset: str) -> str:
    return f"(DATE '{fx.EPOCH}' + (({offset}) % 20000)::INTEGER)"


def _sid(prefix: str, expression: str) -> str:
    return f"('{prefix}_' || substr(sha256({expression}), 1, 32))"


COUNTRY_ROWS = ", ".join(f"('{name}', '{code}')" for name, code in COUNTRY_BY_NAME.items())
CODES = ", ".join(f"'{c}'" for c in COUNTRY_CODES)
LIST_TYPE = "CASE {j} % 3 WHEN 0 THEN 'sanctions' WHEN 1 THEN 'pep' ELSE 'adverse_media' END"
PROVIDER = "CASE {j} % 3 WHEN 0 THEN 'world_check' WHEN 1 THEN 'dow_jones' ELSE 'comply_advantage' END"
KEYS = (
    "list_distinct(flatten(list_transform(list_filter(string_split(lower({n}), ' '), lambda t: t <> ''), "
    "lambda t: [substr(t, 1, 3), substr(t, 1, 1)])))"
)


def masks(a: str) -> str:
    return (
        f"list_transform(range(128), lambda code: coalesce(list_sum(list_transform(range(length({a})), lambda i: "
        f"CASE WHEN ascii({a}[i + 1]) = code THEN (1::BIGINT << i::INTEGER) ELSE 0::BIGINT END)), 0)::BIGINT)"
    )


def lcs(mask: str, length: str, b: str) -> str:
    full = f"((1::BIGINT << {length}::INTEGER) - 1)"
    return (
        f"({length} - bit_count(list_reduce(list_transform(string_split({b}, ''), lambda c: ascii(c)::BIGINT), "
        f"lambda v, c: ((v + (v & {mask}[c + 1])) | (v - (v & {mask}[c + 1]))) & {full}, {full})))"
    )


def lcs_plain(a: str, b: str) -> str:
    """The textbook programme, row by row: no bit tricks, so that it can vouch for them."""
    hits = f"list_transform(string_split({b}, ''), lambda c: list_transform(string_split({a}, ''), lambda x: (x = c)::INTEGER))"
    cell = "greatest(row[i], coalesce(row[i - 1], 0) + hit[i])"
    row = f"list_transform(range(1, len(hit) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda i: {cell})))"
    return f"list_reduce({hits}, lambda row, hit: {row}, list_transform(string_split({a}, ''), lambda x: 0))[-1]"


def _country(text: str) -> str:
    return (
        f"CASE WHEN length(trim({text})) = 2 AND upper(trim({text})) IN ({CODES}) THEN upper(trim({text})) ELSE "
        f"(SELECT any_value(code) FROM country c WHERE c.cname = "
        f"trim(trim(regexp_replace(replace(lower({text}), 'ü', 'u'), ' +', ' ', 'g')), '.')) END"
    )


def _scored(source: str) -> str:
    """Best-scoring name per person and entry of ``source`` (name, entry_id), at or over the threshold."""
    return f"""
  SELECT * FROM (
    SELECT p.k, p.client_id, p.screening_id, s.entry_id, s.provider_id, s.list_type, s.raw AS matched_name, s.pep_tier,
           s.media_confidence, p.dob = s.dob AS same_dob,
           round_even(CASE WHEN p.dob IS NULL OR s.dob IS NULL THEN s.base
                           WHEN p.dob = s.dob THEN least(1.0::DOUBLE, s.base + 0.03::DOUBLE)
                           ELSE least(s.base, 0.75::DOUBLE) END, 4)::DOUBLE AS score,
           row_number() OVER (PARTITION BY p.k, s.entry_id ORDER BY
             round_even(CASE WHEN p.dob IS NULL OR s.dob IS NULL THEN s.base
                             WHEN p.dob = s.dob THEN least(1.0::DOUBLE, s.base + 0.03::DOUBLE)
                             ELSE least(s.base, 0.75::DOUBLE) END, 4)::DOUBLE DESC, s.pos) AS place
    FROM person p JOIN {source} s ON p.name = s.name)
  WHERE place = 1 AND score >= 0.82"""


def _decided(match: str) -> str:
    return f"""
  SELECT p.k, p.client_id, p.trace_id, p.screening_id, {_sid('dec', 'p.screening_id')} AS decision_id,
         coalesce(t.outcome, 'CLEAR') AS outcome, coalesce(t.codes, 'NO_MATCH') AS reason_codes, t.top_match_id
  FROM person p LEFT JOIN (
    SELECT k, CASE max(sev) WHEN 3 THEN 'ESCALATE' ELSE 'FLAG' END AS outcome,
           array_to_string(list_sort(list_distinct(list(rule))), ',') AS codes,
           arg_min(match_id, (-sev, -score, rule_ord, list_ord, entry_id)) AS top_match_id
    FROM {match} GROUP BY k) t ON p.k = t.k"""


def _trace(match: str) -> str:
    return f"""
  SELECT m.*, {_sid('mat', "m.screening_id || '|' || m.entry_id")} AS match_id, r.rule, r.rule_ord, r.sev,
         CASE m.list_type WHEN 'sanctions' THEN 1 WHEN 'pep' THEN 2 ELSE 3 END AS list_ord
  FROM {match} m JOIN (VALUES ('SANCTIONS_MATCH', 0, 3), ('PEP_TIER_1_2', 1, 3), ('PEP_TIER_3_4', 2, 2),
                              ('ADVERSE_MEDIA', 3, 2)) r(rule, rule_ord, sev)
    ON (r.rule = 'SANCTIONS_MATCH' AND m.list_type = 'sanctions')
    OR (r.rule = 'PEP_TIER_1_2' AND m.list_type = 'pep' AND m.pep_tier IN (1, 2))
    OR (r.rule = 'PEP_TIER_3_4' AND m.list_type = 'pep' AND m.pep_tier IN (3, 4))
    OR (r.rule = 'ADVERSE_MEDIA' AND m.list_type = 'adverse_media')"""


def _cand(entry: str, provider_filter: str = "") -> str:
    return f"""
  SELECT q.name, e.*, row_number() OVER (PARTITION BY q.name, e.provider_id ORDER BY e.entry_id) AS rn,
         count(*) OVER (PARTITION BY q.name, e.provider_id) AS total
  FROM (SELECT DISTINCT name, {KEYS.format(n='name')} AS keys FROM person) q
  JOIN {entry} e ON list_has_any(q.keys, e.keys) {provider_filter}"""


def _names(entry: str) -> str:
    return f"""
  SELECT entry_id, pos, raw, lower(raw) AS cname, array_to_string(list_sort(string_split(lower(raw), ' ')), ' ') AS sname,
         length(raw) AS len, {masks('lower(raw)')} AS m1,
         {masks("array_to_string(list_sort(string_split(lower(raw), ' ')), ' ')")} AS m2
  FROM (SELECT entry_id, unnest(range(len(all_names))) AS pos, unnest(all_names) AS raw
        FROM (SELECT entry_id, list_concat([entity_name], aliases) AS all_names FROM {entry}))"""


def _sim(cand: str, names: str) -> str:
    swapped = "array_to_string(list_sort(string_split(c.name, ' ')), ' ')"
    return f"""
  SELECT c.name, c.entry_id, c.provider_id, c.list_type, c.dob, c.pep_tier, c.media_confidence, c.rn, n.pos, n.raw,
         2.0::DOUBLE * greatest({lcs('n.m1', 'n.len', 'c.name')}, {lcs('n.m2', 'n.len', swapped)})
           / (n.len + length(c.name)) AS base
  FROM {cand} c JOIN {names} n ON c.entry_id = n.entry_id"""


CTES: dict[str, str] = {
    "country": f"SELECT * FROM (VALUES {COUNTRY_ROWS}) t(cname, code)",
    "base": f"""
  SELECT k, nation, CASE WHEN r <= 2 THEN
           CASE WHEN r <> 1 THEN {_first('j')} || ' ' || {_last('j')}
                WHEN j % 3 = 0 THEN {_last('j')} || ' ' || {_first('j')}
                WHEN j % 3 = 1 THEN {_first('j')} || ' ' || left({_last('j')}, length({_last('j')}) - 1)
                ELSE {_first('j')} || ' ' || {_last('j')} || 'a' END
           ELSE {_first('(k * 7 + 3)')} || ' ' || {_last('(k * 7 + 3)')} END AS name,
         CASE WHEN r <= 1 THEN {_day('j * 37')} WHEN r = 2 THEN {_day('j * 37')} + 1
              ELSE {_day('k * 53 + 11')} END AS dob
  FROM (SELECT c_custkey AS k, c_nationkey AS nation, c_custkey // 15 AS j, c_custkey % 15 AS r FROM customer)""",
    "person": f"""
  SELECT *, {_sid('scr', "client_id || '|' || profile_hash")} AS screening_id FROM (
    SELECT *, sha256(name || '|' || dob::VARCHAR || '|' || coalesce(nat, '')) AS profile_hash FROM (
      SELECT b.k, b.name, b.dob, 'cli_' || b.k AS client_id, 'trc_' || b.k AS trace_id,
             n.iso AS nat, CASE WHEN b.k % 5 <> 0 THEN r.iso END AS res
      FROM base b LEFT JOIN nat_iso n ON b.nation = n.i LEFT JOIN nat_iso r ON b.k % 25 = r.i))""",
    "nat_iso": f"""
  SELECT i, {_country('txt')} AS iso
  FROM (SELECT unnest(range(25)) AS i, unnest({_list(fx.NATIONALITIES)}) AS txt)""",
    "entry": f"""
  SELECT j, 'wl_' || {LIST_TYPE.format(j='j')} || '_' || printf('%04d', j) AS entry_id,
         {PROVIDER.format(j='j')} AS provider_id, {LIST_TYPE.format(j='j')} AS list_type,
         first || ' ' || last AS entity_name,
         CASE WHEN last LIKE '%v' THEN [last || ' ' || first, first || ' ' || left(last, length(last) - 1) || 'ff']
              ELSE [last || ' ' || first] END AS aliases,
         CASE WHEN j % 20 <> 0 THEN {_day('j * 37')} END AS dob,
         {_list(fx.COUNTRIES)}[j % {len(fx.COUNTRIES)} + 1] AS country_iso2,
         CASE WHEN j % 3 = 0 THEN {_list(fx.PROGRAMS)}[j % {len(fx.PROGRAMS)} + 1] END AS program,
         CASE WHEN j % 3 = 1 THEN 1 + (j // 3) % 4 END::INTEGER AS pep_tier,
         CASE WHEN j % 3 = 2 THEN (30 + j % 70) / 100.0::DOUBLE END AS media_confidence,
         list_distinct(flatten([{KEYS.format(n="first || ' ' || last")},
           CASE WHEN last LIKE '%v' THEN {KEYS.format(n="left(last, length(last) - 1) || 'ff'")} ELSE [] END])) AS keys
  FROM (SELECT s_suppkey AS j, {_first('s_suppkey')} AS first, {_last('s_suppkey')} AS last FROM supplier)""",
    "upd": f"""
  SELECT *, {_first('x')} || ' ' || {_last('x')} AS added_name FROM (
    SELECT s_suppkey AS j, {PROVIDER.format(j='s_suppkey')} AS provider_id, {LIST_TYPE.format(j='s_suppkey')} AS list_type,
           (['add', 'remove', 'version_bump'])[(s_suppkey // 3) % 3 + 1] AS change,
           s_suppkey * 15 + 3 + s_suppkey % 12 AS ck, (s_suppkey * 15 + 3 + s_suppkey % 12) * 7 + 3 AS x
    FROM supplier)""",
    "entry2": f"""
  SELECT e.entry_id, e.provider_id, e.list_type, e.entity_name, e.aliases, e.dob, e.pep_tier, e.media_confidence, e.keys
  FROM entry e JOIN upd u ON e.j = u.j WHERE u.change <> 'remove'
  UNION ALL
  SELECT 'wl_' || list_type || '_u' || printf('%04d', j), provider_id, list_type, added_name, []::VARCHAR[],
         {_day('ck * 53 + 11')}, CASE WHEN j % 3 = 1 THEN 1 + (j // 3) % 4 END::INTEGER,
         CASE WHEN j % 3 = 2 THEN (30 + j % 70) / 100.0::DOUBLE END, {KEYS.format(n='added_name')}
  FROM upd WHERE change = 'add'""",
    "cand": _cand("entry"),
    "ename": _names("entry"),
    "sim": _sim("cand", "ename"),
    "sim50": "SELECT * FROM sim WHERE rn <= 50",
    "sim10": "SELECT * FROM sim WHERE rn <= 10",
    "sim_degraded": "SELECT * FROM sim WHERE provider_id <> 'dow_jones'",
    "match": _scored("sim"),
    "match50": _scored("sim50"),
    "match10": _scored("sim10"),
    "match_degraded": _scored("sim_degraded"),
    "trace": _trace("match"),
    "trace50": _trace("match50"),
    "decision": _decided("trace"),
    "decision50": _decided("trace50"),
    **{
        key: expression
        for mark, lists in (("_s", "'sanctions'"), ("_p", "'sanctions', 'pep'"))
        for key, expression in {
            f"entry{mark}": "SELECT entry_id, provider_id, list_type, entity_name, aliases, dob, pep_tier, media_confidence, keys "
            f"FROM entry WHERE list_type NOT IN ({lists}) UNION ALL SELECT * FROM entry2 WHERE list_type IN ({lists})",
            f"cand{mark}": _cand(f"entry{mark}"),
            f"ename{mark}": _names(f"entry{mark}"),
            f"sim{mark}": _sim(f"cand{mark}", f"ename{mark}"),
            f"match{mark}": _scored(f"sim{mark}"),
            f"trace{mark}": _trace(f"match{mark}"),
            f"decision{mark}": _decided(f"trace{mark}"),
        }.items()
    },
    "cand2": _cand("entry2"),
    "ename2": _names("entry2"),
    "sim2": _sim("cand2", "ename2"),
    "match2": _scored("sim2"),
    "trace2": _trace("match2"),
    "decision2": _decided("trace2"),
}
NEEDS = {
    "nat_iso": ["country"],
    "person": ["base", "nat_iso"],
    "entry2": ["entry", "upd"],
    "cand": ["person", "entry"],
    "ename": ["entry"],
    "sim": ["cand", "ename"],
    "sim50": ["sim"],
    "sim10": ["sim"],
    "sim_degraded": ["sim"],
    "match": ["person", "sim"],
    "match50": ["person", "sim50"],
    "match10": ["person", "sim10"],
    "match_degraded": ["person", "sim_degraded"],
    "trace": ["match"],
    "trace50": ["match50"],
    "decision": ["person", "trace"],
    "decision50": ["person", "trace50"],
    **{
        key: needs
        for mark in ("_s", "_p")
        for key, needs in {
            f"entry{mark}": ["entry", "entry2"],
            f"cand{mark}": ["person", f"entry{mark}"],
            f"ename{mark}": [f"entry{mark}"],
            f"sim{mark}": [f"cand{mark}", f"ename{mark}"],
            f"match{mark}": ["person", f"sim{mark}"],
            f"trace{mark}": [f"match{mark}"],
            f"decision{mark}": ["person", f"trace{mark}"],
        }.items()
    },
    "cand2": ["person", "entry2"],
    "ename2": ["entry2"],
    "sim2": ["cand2", "ename2"],
    "match2": ["person", "sim2"],
    "trace2": ["match2"],
    "decision2": ["person", "trace2"],
}


def with_ctes(body: str, *names: str, **extra: str) -> str:
    """``body`` behind the named building blocks and all they need, in order; ``extra`` come last."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in NEEDS.get(name, []):
            visit(need)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    parts = [f"{n} AS MATERIALIZED ({CTES[n]})" for n in order] + [f"{n} AS ({sql})" for n, sql in extra.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body
