"""SQL that the queries of the table-cleaning operators are held against, written from the task's statement alone: it takes
nothing from the operators, so that a wrong pattern or column cannot be wrong on both sides."""

from __future__ import annotations

# The code points of white space, as Unicode lists them, with the four separators from 28 to 31.
_WHITE = [*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
_WS = "||".join(f"chr({c})" for c in _WHITE)
_TRIM = lambda c: f"trim({c}, {_WS})"
_DATE = lambda c: f"(regexp_full_match({c}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') and {c} not like '0000%' and try_cast({c} as date) is not null)"


# The two lists as TESTDATA.md states them, apart from the operator's formats: name:kind, ! for a value that must be there.
LICENCES = (
    "ezb_id:whole! titel:text! ampelfarbe:whole verlag:text fach:text e_issn:issns p_issn:issns zdb_nummer:zdb frontdoor_url:text typ:text"
    " preistyp:text zugangsbedingung:text link_zur_zeitschrift:text anchor:text erstes_jahr:year erstes_volume:text erstes_issue:text"
    " letztes_jahr:year letztes_volume:text letztes_issue:text moving_wall:text verfuegbar:text"
).split()
REPORT = (
    "ebl_id:whole! title:text! publisher:text pubdate:date eisbn:isbn isbn:isbn category:text dewey:text lcc:text visible:flag owned:flag"
    " fund_code:text copies:whole purchase_type:text purchase_price:decimal lending_model:text date_purchased:date renewal_date:date"
    " owned_loans:whole total_owned_loan_days:whole current_loan_days_remaining:whole unowned_loans:whole"
    " browse_sessions:whole total_browse_time:time read_online_sessions:whole total_read_online_time:time"
    " total_downloads:whole total_days_downloaded:whole avg_download_length:whole total_turnaways:whole"
    " total_pages_printed:whole total_pages_copied:whole total_unique_users:whole ebook_status:flag"
).split()
_IS = {
    "text": "true",
    "whole": "regexp_full_match({c}, '[+-]?[0-9]+')",
    "decimal": "regexp_full_match({c}, '[+-]?[0-9]+([.][0-9]+)?')",
    "isbn": "regexp_full_match({c}, '[0-9]{{13}}')",
    "flag": "lower({c}) in ('true', 'false')",
    "issns": "len(list_filter(string_split({c}, ';'), lambda i: not regexp_full_match(trim(i, ' '), '[0-9]{{4}}-[0-9]{{3}}[0-9Xx]'))) = 0",
    "zdb": "regexp_full_match({c}, '[0-9]+-[0-9Xx]')",
    "year": "regexp_full_match({c}, '[0-9]{{4}}')",
    "time": "regexp_full_match({c}, '[0-9]+:[0-5][0-9]:[0-5][0-9]')",
}


def _check(columns: list[str], v: str) -> str:
    """SQL condition: each of the list's stripped values is allowed."""
    out = []
    for k, column in enumerate(columns):
        c, kind = f"{v}[{k + 1}]", column.split(":")[1].rstrip("!")
        one = _DATE(c) if kind == "date" else _IS[kind].format(c=c)
        out.append(f"({c} <> '' and {one})" if column.endswith("!") else f"({c} = '' or {one})")
    return " and ".join(out)


def _cells(columns: list[str], v: str) -> str:
    out, unheld = [], []
    for k, column in enumerate(columns):
        name, kind = column.rstrip("!").split(":")
        c = f"nullif({v}[{k + 1}], '')"
        if kind == "whole":
            cell, lost = f"try_cast({c} as bigint)", f"try_cast({c} as bigint) is null"
        elif kind == "decimal":
            exact = f"(regexp_full_match({c}, '[+-]?[0-9]+([.][0-9]{{1,4}}0*)?') and try_cast({c} as decimal(18,4)) is not null)"
            cell, lost = f"case when {exact} then try_cast({c} as decimal(18,4)) end", f"not {exact}"
        else:
            cell = {"flag": f"lower({c}) = 'true'", "date": f"try_cast({c} as date)", "year": f"try_cast({c} as integer)"}.get(kind, c)
            lost = None
        out.append(f"{cell} as {name}")
        if lost:
            unheld.append(f"case when {c} is not null and {lost} then '{name}=' || {c} end")
    return ", ".join(out) + f", nullif(concat_ws(chr(10), {', '.join(unheld)}), '') as unheld"


_FREE, _QUOTED = '[^",]*', '"(?:[^"]|"")*"'
_SPLIT = f"""
lic as (select line_id, c0 as t, list_transform(string_split(c0, chr(9)), lambda x: trim(x, ' ' || chr(13))) as v
  from lic_dmp_v1 where line_no >= 6 or line_no is null),
lic2 as (select line_id, v, case when t is null or len(v) <> 22 then 'columns' when not ({_check(LICENCES, "v")}) then 'value' end as reason from lic),
rep as (select line_id, raw_line as t, regexp_full_match(raw_line, '(?:{_FREE}|{_QUOTED})(?:,(?:{_FREE}|{_QUOTED}))*') as sound,
  regexp_extract_all(',' || raw_line, ',({_QUOTED}|{_FREE})', 1) as q from title_report_01 where line_no >= 2 or line_no is null),
rep1 as (select *, list_transform(q, lambda x: trim(case when x like '"%' then replace(x[2:-2], '""', '"') else x end, ' ')) as v from rep),
rep2 as (select line_id, v, case when not sound then 'quoting' when t is null or len(v) <> 34 then 'columns'
  when not ({_check(REPORT, "v")}) then 'value' end as reason from rep1)
"""


def _history_sql(where: str) -> str:
    t = _TRIM
    return f"""
with u as (select {t("ebl_id")} as i, op, effective_date as e, received_at as r, update_id as s, lower({t("owned")}) as o, {t("renewal_date")} as d from title_update {where}),
v as (select try_cast(i as bigint) as ebl_id, op, e, r, s,
    case when o in ('true', '1') then 'true' when o in ('false', '0') then 'false' when o = '' then '' end as o,
    case when d = '' then '' when regexp_full_match(d, '[0-9]{{2}}\\.[0-9]{{2}}\\.[0-9]{{4}}') then d[7:10] || '-' || d[4:5] || '-' || d[1:2]
      when regexp_full_match(d, '[0-9]{{8}}') then d[1:4] || '-' || d[5:6] || '-' || d[7:8] else d end as d
  from u where regexp_full_match(i, '[+-]?[0-9]+') and e is not null and op in ('U', 'D')),
w as (select ebl_id, op, e, r, s, o, case when d = '' or {_DATE("d")} then d end as d,
    sum(case when op = 'D' then 1 else 0 end) over (partition by ebl_id order by e, r nulls first, s rows unbounded preceding) as life from v where ebl_id is not null),
x as (select ebl_id, e, op, row_number() over (partition by ebl_id, e order by r desc nulls last, s desc) as late,
    last_value(case when op = 'U' then o end ignore nulls) over f as o, last_value(case when op = 'U' then d end ignore nulls) over f as d
  from w window f as (partition by ebl_id, life order by e, r nulls first, s rows unbounded preceding)),
y as (select ebl_id, e, case when op = 'U' then coalesce(o, '') || '|' || coalesce(d, '') end as st from x where late = 1),
z as (select *, lag(st) over (partition by ebl_id order by e) as before from y),
c as (select ebl_id, st, e, lead(e) over (partition by ebl_id order by e) as n from z where st is distinct from before)
select ebl_id, /*cols*/ cast(e as varchar) as valid_from, coalesce(cast(n as varchar), '9999-12-31') as valid_to from c where st is not null"""


_STATE = "nullif(split_part(st, '|', 1), '') as owned, nullif(split_part(st, '|', 2), '') as renewal_date,"
_TITLE = f"coalesce(nfc_normalize(regexp_replace({_TRIM('title')}, '[' || {_WS} || ']+', ' ', 'g')), '')"

_CELLS = f"""
with s as (select *, row_number() over (partition by coalesce(nullif(lower(uuid), ''), 'row ' || row_id) order by loaded_at desc nulls last, row_id desc) as k from gdm_statement),
t as (select record_id, regexp_extract(predicate, '([^#/:]*)$', 1) as p, coalesce(ord, 1) as o, row_id, {_TRIM("object_value")} as v
  from s where k = 1 and subject_kind = 'RESOURCE' and subject_id = record_id and object_kind = 'LITERAL'),
a as (select record_id, nullif(trim(regexp_replace(lower(case when contains(p, '%') then url_decode(replace(p, '+', ' ')) else replace(p, '+', ' ') end), '[^a-z0-9]+', '_', 'g'), '_'), '') as attr, o, row_id, v from t),
r as (select * from a where attr is not null and v <> '' and case when attr in ('ebl_id', 'ezb_id', 'copies', 'ampelfarbe', 'erstes_jahr') then regexp_full_match(v, '[+-]?[0-9]+')
  when attr = 'purchase_price' then regexp_full_match(v, '[+-]?[0-9]+(\\.[0-9]+)?') when attr in ('owned', 'visible') then lower(v) in ('true', 'false')
  when attr in ('renewal_date', 'pubdate') then {_DATE("v")} else true end),
f as (select * from (select *, row_number() over (partition by record_id, attr order by o, row_id) as c from r) where c = 1)
"""

ORACLE: dict[str, str] = {
    "p1_found": f"with {_SPLIT} select 'lic_dmp_v1' as src, line_id, reason from lic2 where reason is not null union all select 'title_report_01', line_id, reason from rep2 where reason is not null",
    "p1_licences": f"with {_SPLIT} select line_id, {_cells(LICENCES, 'v')} from lic2 where reason is null",
    "p1_report": f"with {_SPLIT} select line_id, {_cells(REPORT, 'v')} from rep2 where reason is null",
    "p2_found": _history_sql(""),
    "p2_history": _history_sql("").replace("/*cols*/", _STATE),
    "p2_as_of": _history_sql("where received_at is null or received_at <= timestamp '2021-07-01 00:00:00'").replace("/*cols*/", _STATE),
    "p3_found": f"""
with e as (select snap_no, try_cast({_TRIM("ebl_id")} as bigint) as ebl_id, {_TITLE} as title,
    case when regexp_full_match({_TRIM("copies")}, '[+-]?[0-9]+') then try_cast({_TRIM("copies")} as bigint) end as copies,
    row_number() over (partition by snap_no, try_cast({_TRIM("ebl_id")} as bigint) order by loaded_at desc nulls last, row_id desc) as k
  from title_snapshot where regexp_full_match({_TRIM("ebl_id")}, '[+-]?[0-9]+')),
f as (select * from e where k = 1 and ebl_id is not null)
select cast(coalesce(n.snap_no, o.snap_no + 1) as integer) as snap_no, coalesce(n.ebl_id, o.ebl_id) as ebl_id,
  case when o.ebl_id is null then 'added' when n.ebl_id is null then 'removed' else 'changed' end as change_kind
from f n full join f o on n.snap_no = o.snap_no + 1 and n.ebl_id = o.ebl_id
where coalesce(n.snap_no, o.snap_no + 1) between 2 and (select max(snap_no) from title_snapshot)
  and (o.ebl_id is null or n.ebl_id is null or n.title <> o.title or n.copies is distinct from o.copies)""",
    "p5_found": """
with o as (select feed_no, file_no, report_date, delivered_at, case when json_valid(payload) and json_type(payload) = 'OBJECT' then payload end as o from title_feed),
g as (select feed_no, file_no, report_date, max(delivered_at) as late from o where report_date is not null group by all),
h as (select *, row_number() over (partition by feed_no, report_date order by late desc nulls last, file_no desc) as k from g),
f as (select *, row_number() over (partition by feed_no order by report_date) as seq from h where k = 1),
n as (select feed_no, file_no, o, unnest(json_keys(o)) as name from o where o is not null),
t as (select n.feed_no, n.file_no, name, json_type(o, '$."' || name || '"') as t, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') as k from n),
d as (select name_key, min(field_key) as field_key from field_names where field_key is not null group by 1),
x as (select t.feed_no, t.file_no, f.seq, coalesce(d.field_key, t.k) as field_key, min(name) as name,
    bool_or(t = 'BOOLEAN') as b, bool_or(t in ('BIGINT', 'UBIGINT', 'HUGEINT')) as i, bool_or(t = 'DOUBLE') as c, bool_or(t not in ('BOOLEAN', 'BIGINT', 'UBIGINT', 'HUGEINT', 'DOUBLE', 'NULL')) as s
  from t join f using (feed_no, file_no) left join d on d.name_key = t.k group by all),
y as (select *, case when s or (b and (i or c)) then 'string' when b then 'boolean' when c then 'decimal' when i then 'integer' end as kind from x),
z as (select *, lag(seq) over w as held, lag(name) over w as was, lead(seq) over w as nxt, last_value(kind ignore nulls) over (w rows between unbounded preceding and 1 preceding) as before
  from y window w as (partition by feed_no, field_key order by seq))
select feed_no, file_no, field_key, 'added' as change_kind from z where seq > 1 and held is distinct from seq - 1
union all select feed_no, file_no, field_key, 'renamed' from z where held = seq - 1 and was <> name
union all select feed_no, file_no, field_key, 'retyped' from z where kind <> before
union all select z.feed_no, f.file_no, field_key, 'removed' from z join f on f.feed_no = z.feed_no and f.seq = z.seq + 1 where nxt is distinct from z.seq + 1""",
    "p4_found": _CELLS + "select record_id, attr, row_id from f",
    "p4_wide": _CELLS + f"""
, h as (select *, case when attr in ('ebl_id', 'ezb_id', 'copies') then try_cast(v as bigint) is not null
    when attr = 'purchase_price' then regexp_full_match(v, '[+-]?[0-9]+([.][0-9]{{1,4}}0*)?') and try_cast(v as decimal(18,4)) is not null
    else attr in ('title', 'owned', 'renewal_date', 'category', 'publisher', 'pubdate', 'titel') end as held from f)
select record_id, max(v) filter (attr = 'title') as title, max(try_cast(v as bigint)) filter (attr = 'ebl_id') as ebl_id, max(try_cast(v as bigint)) filter (attr = 'copies') as copies,
  bool_or(lower(v) = 'true') filter (attr = 'owned') as owned, max(try_cast(v as date)) filter (attr = 'renewal_date') as renewal_date,
  max(try_cast(v as decimal(18,4))) filter (attr = 'purchase_price' and held) as purchase_price, max(v) filter (attr = 'category') as category,
  max(v) filter (attr = 'publisher') as publisher, max(try_cast(v as date)) filter (attr = 'pubdate') as pubdate,
  max(try_cast(v as bigint)) filter (attr = 'ezb_id') as ezb_id, max(v) filter (attr = 'titel') as titel,
  coalesce(string_agg(attr || '=' || v, chr(10) order by attr) filter (not held), '') as others
from h group by record_id""",
}
