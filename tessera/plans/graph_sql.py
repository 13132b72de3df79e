"""SQL that the queries on statements are held against. It is written over the relational tables, apart from the operators:
what a delta is, for one, comes out of comparing orders and lines, not of following statements."""

from __future__ import annotations

V = "http://shop.example/vocab#"
B = "http://shop.example/"
TYPE = "http://vocab.libhub.example/syntax#type"
OPEN = 2147483647
ORDER_LINES = "partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, cast(l_quantity as bigint), cast(round(l_extendedprice * 100) as bigint), cast(l_shipdate as date), l_returnflag, l_linestatus"

# The deliveries as relations: base numbers all lines of an order; o1, o2 are orders, l1, l2 lines.
SHOP = f"""
base as (select l_orderkey as k, l_orderkey + row_number() over ({ORDER_LINES}) as z, row_number() over ({ORDER_LINES}) as n,
  l_partkey as part, cast(l_quantity as bigint) as qty, l_returnflag as flag, l_linestatus as ls, cast(l_shipdate as date) as day from lineitem),
o1 as (select o_orderkey as k, o_orderstatus as status, o_orderpriority as prio, cast(round(o_totalprice * 100) as bigint) as total, o_custkey as c, cast(null as varchar) as note from orders where o_orderkey % 17 <> 0),
o2 as (select o_orderkey as k, case when o_orderkey % 7 = 0 then 'X' else o_orderstatus end as status, case when o_orderkey % 11 <> 0 then o_orderpriority end as prio,
  cast(round(o_totalprice * 100) as bigint) as total, o_custkey as c, case when o_orderkey % 5 = 0 then 'note ' || o_orderkey end as note from orders where o_orderkey % 13 <> 0),
l1 as (select k, row_number() over (partition by k order by n) as o, part, qty, flag, ls, day from base where z % 12 <> 0 and k in (select k from o1)),
l2 as (select k, row_number() over (partition by k order by n) as o, case when z % 15 = 0 then part + 1 else part end as part, case when z % 9 = 0 then qty + 1 else qty end as qty, flag, ls,
  case when z % 8 = 0 then cast(day + interval 1 day as date) else day end as day from base where z % 10 <> 0 and k in (select k from o2))"""


def _statements(v: int) -> str:
    """Raw statements of a delivery (model, record_id, pos, sk, sid, p, ok, oid, val, ord, t), t for types."""
    o, l = f"o{v}", f"l{v}"
    order = f"'{B}order/' || k"
    m = "'m' || (k % 4)"
    lit, res, bno, no = "'LITERAL'", "'RESOURCE'", "'BNODE'", "cast(null as varchar)"
    rdf_type = "'http://www.w3.org/1999/02/22-rdf-syntax-ns#type'"
    n = "cast(null as bigint)"
    row = lambda frm, model, rec, pos, sk, sid, p, ok, oid, val, o_="cast(null as bigint)", where="": f"select {model}, {rec}, {pos}, '{sk}', {sid}, {p}, {ok}, {oid}, {val}, {o_} from {frm} {where}"
    p = lambda x: f"'{V}{x}'"
    head = lambda pos, name, ok, oid, val, where="": row(o, m, order, pos, "RESOURCE", order, name, ok, oid, val, n, where)
    label, terms = "k || '-' || o", "k || '-' || o || '-t'"
    item = lambda j, sid, sk, name, ok, oid, val, o_=n: row(l, m, order, f"o * 10 + {j}", sk, sid, name, ok, oid, val, o_)
    who = f"'{B}customer/' || c_custkey"
    cust = lambda pos, name, ok, oid, val: row("customer", "'m' || (c_custkey % 4)", who, pos, "RESOURCE", who, name, ok, oid, val)
    rows = [
        head(1, rdf_type, res, p("Order"), no), head(2, p("status"), lit, no, "status"), head(3, p("priority"), lit, no, "prio", "where prio is not null"),
        head(4, p("total"), lit, no, "cast(total as varchar)"), head(5, p("customer"), res, f"'{B}customer/' || c", no), head(6, p("note"), lit, no, "note", "where note is not null"),
        item(0, order, "RESOURCE", p("item"), bno, label, no, "o"), item(1, label, "BNODE", rdf_type, res, p("Item"), no), item(2, label, "BNODE", p("flag"), lit, no, "flag"),
        item(3, label, "BNODE", p("qty"), lit, no, "cast(qty as varchar)"), item(4, label, "BNODE", p("part"), res, f"'{B}part/' || part", no), item(5, label, "BNODE", p("terms"), bno, terms, no),
        item(6, terms, "BNODE", p("shipdate"), lit, no, "cast(day as varchar)"), item(7, terms, "BNODE", p("linestatus"), lit, no, "ls"),
        cust(1, rdf_type, res, p("Customer"), no), cust(2, p("name"), lit, no, "c_name"), cust(3, p("segment"), lit, no, "c_mktsegment"), cust(4, p("nation"), res, f"'{B}nation/' || c_nationkey", no),
    ]
    return f"raw{v}(model, record_id, pos, sk, sid, p, ok, oid, val, ord) as (" + "\n union all ".join(rows) + ")"


_KEY = "sha256(concat_ws(chr(1), model, sk || ':' || sid, p, ok || ':' || coalesce(val, oid)))"
_NOT_TYPE = "p <> 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type'"


def _edges(v: int, load: str = "shop") -> str:
    """Statements without types, blank nodes with their surrogates."""
    return f"""e{v} as (select model, record_id, pos, sk, case when sk = 'BNODE' then sha256('{load}|' || sid) else sid end as sid, p, ok, case when ok = 'BNODE' then sha256('{load}|' || oid) else oid end as oid, val, ord
  from raw{v} where {_NOT_TYPE})"""


ONE = f"with {SHOP},\n{_statements(1)},\n{_edges(1)}"
BOTH = f"{ONE},\n{_statements(2)},\n{_edges(2)}"
HISTORY = f"""{BOTH},
k1 as (select *, {_KEY} as key from e1), k2 as (select *, {_KEY} as key from e2),
h as (select k1.*, 1 as valid_from, case when k1.record_id in (select record_id from k2) and k1.key not in (select key from k2) then 2 else {OPEN} end as valid_to from k1
  union all select k2.*, 2, {OPEN} from k2 where key not in (select key from k1))"""


def _digest(frm: str) -> str:
    line = "concat_ws('|', p, coalesce(ord, 0), sid, coalesce(val, oid))"
    return f"select model, record_id, count(*) as n, md5(string_agg({line}, ',' order by {line})) as digest from {frm} group by all"


# Rows of gdm_statement as valid statements, one per key.
GDM = f"""
with f as (select row_id, coalesce(model, '') as model, record_id, subject_kind as sk, subject_id as sid, predicate as p, object_kind as ok, object_id as oid, object_value as val, ord,
    case when coalesce(subject_kind, '') not in ('RESOURCE', 'BNODE') or coalesce(subject_id, '') = '' then 'subject' when coalesce(predicate, '') = '' then 'predicate'
      when object_kind = 'LITERAL' and object_value is not null then null when object_kind in ('RESOURCE', 'BNODE') and coalesce(object_id, '') <> '' then null else 'object' end as fault from gdm_statement),
g as (select row_id, model, record_id, sk, case when sk = 'BNODE' then sha256('gdm|' || sid) else sid end as sid, p, ok, case when ok = 'BNODE' then sha256('gdm|' || oid) else oid end as oid, val, ord from f where fault is null),
s as (select *, {_KEY} as stmt_key from g where not (p = '{TYPE}' and ok <> 'LITERAL')),
d as (select stmt_key, min(row_id) as idx, any_value(model) as model, any_value(sk) as sk, any_value(sid) as sid, any_value(p) as p, any_value(ok) as ok, any_value(oid) as oid, any_value(val) as val from s group by stmt_key)"""

# Entities of both sides with the number among equal flags, and what they meet on the other side.
DELTA = f"""with {SHOP},
shared as (select k from o1 intersect select k from o2),
i1 as (select *, row_number() over (partition by k, flag order by o) as e from l1 where k in (select k from shared)),
i2 as (select *, row_number() over (partition by k, flag order by o) as e from l2 where k in (select k from shared)),
i as (select coalesce(a.k, b.k) as k, coalesce(a.flag, b.flag) as flag, coalesce(a.e, b.e) as e, a.k is not null as was, b.k is not null as "is", a.o as o1, b.o as o2, a.qty as q1, b.qty as q2,
    a.part as p1, b.part as p2, a.day as d1, b.day as d2, a.ls as s1, b.ls as s2 from i1 a full join i2 b on a.k = b.k and a.flag = b.flag and a.e = b.e),
heads as (select a.k, x.p, x.v1, x.v2 from o1 a join o2 b on a.k = b.k, lateral (values ('status', a.status, b.status), ('priority', a.prio, b.prio), ('total', cast(a.total as varchar), cast(b.total as varchar)),
    ('customer', '{B}customer/' || a.c, '{B}customer/' || b.c), ('note', a.note, b.note)) as x(p, v1, v2) where v1 is not null or v2 is not null),
parts as (
  select k, p, case when v1 = v2 then 'flat_exact' else 'flat_modified' end as step, v1, v2, cast(null as bigint) as o1, cast(null as bigint) as o2, v1 is not null as was, v2 is not null as "is" from heads
  union all select c_custkey, x.p, 'flat_exact', v, v, null, null, true, true from customer, lateral (values ('name', c_name), ('segment', c_mktsegment), ('nation', '{B}nation/' || c_nationkey)) as x(p, v)
  union all select k, 'item', 'edge', case when was then 'b' end, case when "is" then 'b' end, o1, o2, was, "is" from i
  union all select k, 'flag', 'key', case when was then flag end, case when "is" then flag end, null, null, was, "is" from i
  union all select k, 'qty', case when was and "is" and q1 = q2 then 'value_exact' else 'value_modified' end, cast(q1 as varchar), cast(q2 as varchar), null, null, was, "is" from i
  union all select k, 'part', case when was and "is" and p1 = p2 then 'leaf_exact' else 'leaf_modified' end, '{B}part/' || p1, '{B}part/' || p2, null, null, was, "is" from i
  union all select k, 'terms', 'edge', case when was then 'b' end, case when "is" then 'b' end, null, null, was, "is" from i
  union all select k, x.p, case when not (was and "is") or v1 <> v2 then 'leaf_modified' when d1 = d2 and s1 = s2 then 'subgraph_exact' else 'leaf_exact' end, v1, v2, null, null, was, "is"
    from i, lateral (values ('shipdate', cast(d1 as varchar), cast(d2 as varchar)), ('linestatus', s1, s2)) as x(p, v1, v2)),
c as (select 'm' || (k % 4) as model, '{B}' || case when p in ('name', 'segment', 'nation') then 'customer/' else 'order/' end || k as record_id, '{V}' || p as predicate, step, v1, v2, o1, o2,
    case when not was then 'ADDITION' when not "is" then 'DELETION' when v1 = v2 then 'EXACT_MATCH' else 'MODIFICATION' end as state from parts)"""


def _changed(step: str) -> str:
    return f"{DELTA} select record_id, predicate, state as delta_state, v1 as old_value, v2 as new_value, count(*) as n from c where step = '{step}' group by all"


def _leaf_lines(v: str) -> str:
    """Leaves of all records of a delivery (k, kind, line)."""
    o, l = f"o{v}", f"l{v}"
    return f"""select 'order/' || k as r, '{V}' || x.p || '~1=' || x.v as line from {o}, lateral (values ('status', status), ('priority', prio), ('total', cast(total as varchar)), ('customer', '{B}customer/' || c), ('note', note)) as x(p, v) where x.v is not null
  union all select 'order/' || k, '{V}item~' || o || '/' || x.p || '=' || x.v from {l}, lateral (values ('{V}flag~1', flag), ('{V}qty~1', cast(qty as varchar)), ('{V}part~1', '{B}part/' || part), ('{V}terms~1/{V}shipdate~1', cast(day as varchar)), ('{V}terms~1/{V}linestatus~1', ls)) as x(p, v)
  union all select 'customer/' || c_custkey, '{V}' || x.p || '~1=' || x.v from customer, lateral (values ('name', c_name), ('segment', c_mktsegment), ('nation', '{B}nation/' || c_nationkey)) as x(p, v)"""


_RANGES = "r as (select l_suppkey, l_linenumber, cast(l_quantity as bigint) as a, cast(l_quantity as bigint) + cast(round(l_discount * 100) as bigint) + 1 as b from lineitem)"
_STATIC = "values ('mabxml', 'http://www.ddb.de/professionell/mabxml/mabxml-1.xsd#'), ('oaipmh', 'http://www.openarchives.org/OAI/2.0/'), ('rdf', 'http://www.w3.org/1999/02/22-rdf-syntax-ns#'), ('rdfs', 'http://www.w3.org/2000/01/rdf-schema#')"
_PREFIXES = f"""with known as (select prefix, namespace from ns_prefix union all ({_STATIC})),
fresh as (select distinct regexp_extract(predicate, '^(.*[#/])[^#/]*$', 1, 's') as namespace from gdm_statement where predicate is not null),
start as (select coalesce(max(case when regexp_full_match(prefix, 'ns[0-9]+') then try_cast(prefix[3:] as bigint) end) + 1, 0) as n from known),
pre as (select prefix, namespace from known union all select 'ns' || (row_number() over (order by namespace) - 1 + (select n from start)), namespace from fresh where namespace <> '' and namespace not in (select namespace from known))"""
_PATHS = "with t as (select p_partkey, string_split(p_type || ' ' || p_brand, ' ') as a, string_split(p_type || ' ' || p_name, ' ') as b, string_split(p_type, ' ') as c from part)"
_ESC = "replace(replace(replace(replace(replace(val, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't')"
_SUBJECT = "case when sk = 'BNODE' then '_:b' || sid else '<' || sid || '>' end"
_OBJECT = f"case ok when 'LITERAL' then '\"' || {_ESC} || '\"' when 'BNODE' then '_:b' || oid else '<' || oid || '>' end"
_BLOCK = f"select {{cols}} from (select model, {_SUBJECT} as s, string_agg(distinct '<' || p || '> ' || {_OBJECT}, ' ;' || chr(10) || '  ' order by '<' || p || '> ' || {_OBJECT}) as x from e1 group by all)"


ORACLE: dict[str, str] = {
    "triplify_statements": f"with {SHOP},\n{_statements(1)} select model, record_id, pos, sk as subject_kind, sid as subject_id, p as predicate, ok as object_kind, oid as object_id, val as object_value, ord from raw1",
    "reject_invalid": f"{GDM} select row_id, fault from f where fault is not null",
    "node_types": f"""{ONE}, t as (select model, case when sk = 'BNODE' then sha256('shop|' || sid) else sid end as node, sk, oid from raw1 where not ({_NOT_TYPE})),
seen as (select model, sid as node, case sk when 'RESOURCE' then 3 else 4 end as r from e1 union all select model, oid, case ok when 'RESOURCE' then 3 else 4 end from e1 where ok <> 'LITERAL'
  union all select model, node, case sk when 'RESOURCE' then 3 else 4 end from t union all select model, oid, 1 from t)
select model, case min(r) when 1 then 'TYPE_RESOURCE' when 3 then 'RESOURCE' else 'BNODE' end as kind, count(*) as n from (select model, node, min(r) as r from seen group by all) group by model, r""",
    "type_label_first": f"{GDM} select model, sid as node_id, arg_min(oid, (row_id, oid)) as type_uri from g where p = '{TYPE}' and ok <> 'LITERAL' group by all",
    "promoted_kinds": f"select predicate, case when predicate = '{TYPE}' and object_kind in ('RESOURCE', 'BNODE') then 'TYPE_' || object_kind else object_kind end as kind, count(*) as n from gdm_statement group by all",
    "stmt_key_dedup": f"{GDM} select stmt_key, idx from d",
    "put_idempotent": f"{GDM} select cast(t.x as integer) as put_no, (select count(*) from d) as stored from (values (1), (2)) as t(x)",
    "statement_index": f"with {SHOP},\n{_statements(1)} select model, record_id, max(i) as last, cast(sum(i * pos) as bigint) as weighted from (select *, row_number() over (partition by model, record_id order by pos) as i from raw1) group by all",
    "node_upsert": f"""{BOTH}, t1 as (select model, sid as node, sk, oid from raw1 where not ({_NOT_TYPE})), t2 as (select model, sid as node, sk, oid from raw2 where not ({_NOT_TYPE})),
n1 as (select model, sid as node from e1 union select model, oid from e1 where ok <> 'LITERAL' union select model, oid from t1),
n2 as (select model, sid as node, case sk when 'RESOURCE' then 3 else 4 end as r from e2 union select model, oid, case ok when 'RESOURCE' then 3 else 4 end from e2 where ok <> 'LITERAL' union select model, oid, 1 from t2)
select model, case r when 1 then 'TYPE_RESOURCE' when 3 then 'RESOURCE' else 'BNODE' end as kind, count(*) as n from (select model, node, min(r) as r from n2 where (model, node) not in (select (model, node) from n1) group by all) group by model, r""",
    "record_owners": f"{ONE} select model, record_id, count(*) as n from e1 group by all",
    "version_allocate": f"with {SHOP} select 'm' || x as model, cast(2 as integer) as version, cast(1 as integer) as unversioned from (select distinct k % 4 as x from o1 union select distinct c_custkey % 4 from customer)",
    "version_publish": f"{HISTORY} select model, cast(max(case when valid_from = 2 or valid_to = 2 then 2 else 1 end) as integer) as latest_version from h group by all",
    "validity_stamp": f"{HISTORY} select model, valid_from, valid_to, count(*) as n from h group by all",
    "as_of_v1": f"{HISTORY} {_digest('(select * from h where valid_from <= 1 and 1 < valid_to)')}",
    "as_of_latest": f"{HISTORY} {_digest('(select * from h where valid_from <= 2 and 2 < valid_to)')}",
    "all_versions": f"{HISTORY} {_digest('h')}",
    "default_version": f"{HISTORY} select model, valid_from, count(*) as n from h, lateral (select case when model = 'm3' then 1 else 2 end as v) where valid_from <= v and v < valid_to group by all",
    "range_compact": f"""with {_RANGES}, q as (select *, max(b) over (partition by l_suppkey order by a, b rows between unbounded preceding and 1 preceding) as far from (select distinct l_suppkey, a, b from r)),
i as (select *, sum(case when far is null or a > far then 1 else 0 end) over (partition by l_suppkey order by a, b rows unbounded preceding) as g from q) select l_suppkey, min(a) as start, max(b) as "end" from i group by l_suppkey, g""",
    "range_intersect": f"""with {_RANGES}, q as (select a, b, cast(l_linenumber as bigint) * 5 as c, cast(l_linenumber as bigint) * 5 + 10 as d from r)
select a <= c and c < b as holds, a <= d and c <= b as meets, case when a <= d and c <= b then greatest(a, c) end as from_both, case when a <= d and c <= b then least(b, d) end as to_both,
  case when a <= d and c <= b then least(a, c) end as from_any, case when a <= d and c <= b then greatest(b, d) end as to_any, count(*) as n from q group by all""",
    "cbd_by_record": f"{ONE} {_digest('(select * from e1 where record_id in (select record_id from raw1 where oid = ' + repr(V + 'Order') + '))')}",
    "cbd_recursive": f"""with recursive {ONE.strip()[5:]}, walk as (select model, record_id as root, sid as node, 0 as level from e1 where sk = 'RESOURCE' and record_id like '{B}order/%' group by all
  union all select w.model, w.root, e.oid, w.level + 1 from walk w join e1 e on e.model = w.model and e.sid = w.node where e.ok = 'BNODE')
select w.model, w.root as record_id, count(*) as n, cast(max(w.level) as bigint) as deepest from walk w join e1 e on e.model = w.model and e.sid = w.node group by all""",
    "cbd_at_most": f"{ONE}, ten as (select distinct record_id from raw1 where model = 'm1' and oid = '{V}Order' order by record_id limit 10) {_digest('(select * from e1 where record_id in (select record_id from ten))')}",
    "record_class": f"select 'm' || (c_custkey % 4) as model, '{B}customer/' || c_custkey as record_id from customer",
    "model_resources": f"with {SHOP} select model, count(*) as n from (select 'm' || (k % 4) as model from o1 union all select 'm' || (c_custkey % 4) from customer) group by all",
    "read_with_types": f"""with {SHOP} select 'm' || (k % 4) as model, '{B}order/' || k as record_id, count(o) * 8 + 5 as n, count(o) + 1 as types, cast(2 * 3 + coalesce(sum(o * 10 * 3 + 2), 0) as bigint) as places
from o1 left join l1 using (k) group by all""",
    "resource_paths": f"""{ONE}, x as (select model, record_id, ok, case when pos < 10 or pos % 10 = 0 then 1 when pos % 10 < 6 then 2 else 3 end as level,
  case when pos < 10 or pos % 10 = 0 then p when pos % 10 < 6 then '{V}item ' || p else '{V}item {V}terms ' || p end as path from e1)
select model, cast(level as bigint) as level, path, ok as object_kind, count(*) as n, count(distinct record_id) as records from x group by all""",
    "entity_paths": f"with {SHOP} select '{B}order/' || k as record_id, count(*) as n, cast(min(day) as varchar) as first, cast(max(day) as varchar) as last from l1 group by all",
    "entity_leaves": f"{ONE} select record_id, count(*) as n, md5(string_agg(coalesce(val, oid), ',' order by coalesce(val, oid))) as digest from e1 where ok <> 'BNODE' group by all",
    "level_nodes": f"{ONE} select record_id, ok as object_kind, count(*) as n, min(coalesce(val, oid)) as first from e1 where pos >= 10 and pos % 10 between 2 and 5 group by all",
    "unmatched_paths": f"""{BOTH}, k1 as (select *, {_KEY} as key from e1), k2 as (select *, {_KEY} as key from e2)
select cast(case when pos < 10 or pos % 10 = 0 then 1 when pos % 10 < 6 then 2 else 3 end as bigint) as level, p as predicate, count(*) as n from k1 where key not in (select key from k2) group by all""",
    "record_identifier": f"with {SHOP} select 'm' || (k % 4) as model, '{B}order/' || k as record_id, cast(arg_min(day, o) as varchar) as identifier from l1 group by all",
    "record_uri_by_id": f"select c_name as value, 'm' || (c_custkey % 4) as model, '{B}customer/' || c_custkey as record_id from customer",
    "search_records": f"{HISTORY}, now as (select * from h where valid_to > 2) select model, record_id, count(*) as n from now where record_id in (select record_id from now where p = '{V}flag' and val = 'R') group by all",
    "record_by_uri": f"{ONE} {_digest('(select * from e1 where record_id = ' + repr(B + 'order/7') + ')')}",
    "record_by_legacy_id": f"""with {SHOP}, ids as (select k % 4 as m, total, min('{B}order/' || k) as stored_id from o1 group by all) select 'm' || m as model, '{B}order/' || k as record_id, stored_id from o2 join ids on k % 4 = m and o2.total = ids.total""",
    "statement_by_uuid": f"{BOTH}, k1 as (select {_KEY} as key from e1), k2 as (select *, {_KEY} as key from e2) select model, p as predicate, count(*) as n from k2 where key in (select key from k1) group by all",
    "delta_states": f"{DELTA} select model, predicate, step as match_step, state as delta_state, count(*) as n from c group by all",
    "changeset": f"""{DELTA}, x as (select model, record_id, concat_ws('|', predicate, state, concat_ws('>', coalesce(v1, ''), coalesce(v2, ''))) as line from c where state <> 'EXACT_MATCH' and predicate not in ('{V}item', '{V}terms'))
select model, record_id, count(*) as n, md5(string_agg(line, ',' order by line)) as digest from x group by all""",
    "changeset_counts": f"{DELTA} select case when state = 'EXACT_MATCH' and o1 is distinct from o2 then 'moved' else lower(state) end as kind, count(*) as n from c group by all",
    "delta_complete": f"""{DELTA} select 'old' as side, count(*) filter (state <> 'ADDITION') as statements, cast(0 as bigint) as wrong from c union all select 'new', count(*) filter (state <> 'DELETION'), 0 from c""",
    "flat_values_exact": f"{DELTA} select record_id, predicate, v1 as value from c where step = 'flat_exact'",
    "flat_values_modified": f"{DELTA} select record_id, predicate, state as delta_state, v1 as old_value, v2 as new_value from c where step = 'flat_modified'",
    "new_records": f"{BOTH} select model, record_id, count(*) as n from e2 where record_id not in (select record_id from e1) group by all",
    "delta_apply": f"""with {SHOP}, x as (select 1 as version, * from ({_leaf_lines("1")}) union all select 2, * from ({_leaf_lines("2")})
  union all select 2, * from ({_leaf_lines("1")}) where r like 'order/%' and cast(r[7:] as bigint) not in (select k from o2))
select cast(version as integer) as version, '{B}' || r as record_id, count(*) as n, md5(string_agg(line, ',' order by line)) as digest from x group by all""",
    "cs_entities": f"""{DELTA}, x as (select 0 as side, k, flag || '#' || e || '#' || qty as line from i1 union all select 1, k, flag || '#' || e || '#' || qty from i2)
select cast(side as integer) as side, '{B}order/' || k as record_id, count(*) as n, md5(string_agg(line, ',' order by line)) as digest from x group by all""",
    "cs_entity_order": f"{DELTA} select cast(side as integer) as side, flag as key, e as ent_ord, count(*) as n from (select 0 as side, flag, e from i1 union all select 1, flag, e from i2) group by all",
    "cs_exact": f"{DELTA} select '{B}order/' || k as record_id, count(*) as n from i where q1 = q2 group by all",
    "cs_value_exact": f"{DELTA} select record_id, v1 as value, count(*) as n from c where step = 'value_exact' group by all",
    "cs_value_modified": f"{DELTA} select record_id, state as delta_state, v1 as old_value, v2 as new_value, count(*) as n from c where step = 'value_modified' group by all",
    "subgraph_hash": f"""with {SHOP}, t as (select k, o, flag, qty, part, sha256('{V}linestatus|1|LITERAL|' || ls || ',' || '{V}shipdate|1|LITERAL|' || day) as th from l1),
x as (select k, sha256(concat_ws(',', '{V}flag|1|LITERAL|' || flag, '{V}part|1|RESOURCE|{B}part/' || part, '{V}qty|1|LITERAL|' || qty, '{V}terms|1|BNODE|' || th)) as hash from t)
select '{B}order/' || k as record_id, sha256(string_agg(hash, ',' order by hash)) as hash from x group by all""",
    "subgraph_exact": f"{DELTA} select record_id, predicate, count(*) as n from c where step = 'subgraph_exact' group by all",
    "leaf_path_exact": f"{DELTA} select record_id, predicate, count(*) as n from c where step = 'leaf_exact' group by all",
    "leaf_path_modified": _changed("leaf_modified"),
    "deprecate_statement": f"""{ONE} select p as predicate, cast(1 as integer) as valid_from, cast(case when p = '{V}total' then 2 else {OPEN} end as integer) as valid_to, count(*) as n from e1 group by all
union all select p, 3, {OPEN}, count(*) from e1 where p = '{V}total' group by all""",
    "deprecate_model": f"{HISTORY} select model, valid_from, cast(case when model = 'm2' and valid_to = {OPEN} then 3 else valid_to end as integer) as valid_to, count(*) as n from h group by 1, 2, 3",
    "deprecate_records": f"""{HISTORY}, own as (select '{B}order/' || o_orderkey as r from orders join customer on o_custkey = c_custkey where c_nationkey = 3)
select model, valid_from, cast(case when record_id in (select r from own) and valid_to = {OPEN} then 3 else valid_to end as integer) as valid_to, count(*) as n from h group by 1, 2, 3""",
    "deprecate_missing": f"{HISTORY} select model, record_id, count(*) as n from h where valid_from = 1 and (valid_to = 2 or (record_id like '{B}order/%' and record_id not in (select record_id from e2))) group by all",
    "deprecate_twice_zero": f"{HISTORY} select count(*) filter (model = 'm1' and valid_to = {OPEN}) as deprecated, cast(1 as integer) as turn from h union all select 0, 2",
    "write_counters": f"""{ONE}, nodes as (select model, sid as x from e1 union select model, oid from e1 where ok <> 'LITERAL' union select model, oid from raw1 where not ({_NOT_TYPE}) union select model, case when sk = 'BNODE' then sha256('shop|' || sid) else sid end from raw1 where not ({_NOT_TYPE}))
select (select count(*) from raw1) as statements, (select count(*) from e1) as relationships, (select count(*) from e1 where ok = 'LITERAL') as literals, (select count(*) from nodes) + (select count(*) from e1 where ok = 'LITERAL') as nodes""",
    "read_counters": f"{HISTORY} select count(distinct (model, record_id)) as records, count(*) as statements from h where valid_to > 2",
    "export_counters": f"{HISTORY} select count(*) as processed, count(distinct (model, sid, p, ok, coalesce(val, oid))) as successful from h",
    "delete_row_count": f"{ONE} select (select count(*) * 2 from e1) + (select count(distinct oid) from raw1 where not ({_NOT_TYPE})) + (select count(*) from ns_prefix) as deleted",
    "prefix_dictionary": f"{_PREFIXES} select prefix, namespace from pre",
    "static_prefixes": f"select * from ({_STATIC}) as t(prefix, namespace)",
    "prefix_counter": f"{_PREFIXES} select coalesce(max(case when regexp_full_match(prefix, 'ns[0-9]+') then try_cast(prefix[3:] as bigint) end) + 1, 0) as next_number from pre",
    "shorten_uri": f"""{_PREFIXES}, u as (select distinct predicate, regexp_extract(predicate, '^(.*[#/])[^#/]*$', 1, 's') as ns from gdm_statement where predicate is not null), o as (select namespace, min(prefix) as prefix from pre group by all)
select predicate, case when prefix is null then predicate else prefix || ':' || predicate[length(ns) + 1:] end as short from u left join o on ns = namespace""",
    "expand_uri": f"""{_PREFIXES}, u as (select distinct predicate, regexp_extract(predicate, '^(.*[#/])[^#/]*$', 1, 's') as ns from gdm_statement where predicate is not null), o as (select prefix, min(namespace) as namespace from pre group by all)
select predicate, case when prefix is null then predicate else namespace || predicate[length(prefix) + 2:] end as full from u left join o on ns = '' and contains(predicate, ':') and prefix = split_part(predicate, ':', 1)""",
    "uri_parts": "select distinct record_id as uri, regexp_extract(record_id, '^(.*[#/])[^#/]*$', 1, 's') as namespace, regexp_extract(record_id, '([^#/]*)$', 1, 's') as local from gdm_statement",
    "path_parse": f"{_PATHS} select p_partkey, len(a) as n, array_to_string(a, '/') as path from t",
    "path_relative": f"{_PATHS} select p_partkey, array_to_string(a[len(c) + 1:], '/') as path from t",
    "path_common": f"{_PATHS} select p_partkey, array_to_string(a[1:coalesce(list_position(list_transform(range(1, least(len(a), len(b)) + 1), lambda i: a[i] = b[i]), false), least(len(a), len(b)) + 1) - 1], '/') as path from t",
    "compared_values": "select object_kind, case object_kind when 'RESOURCE' then object_id || coalesce(model, '') when 'LITERAL' then object_value end as value, count(*) as n from gdm_statement group by all",
    "flat_groups": f"{ONE} select record_id, p as predicate, string_agg(coalesce(val, oid), ',' order by coalesce(val, oid)) as \"all\" from e1 where sid = record_id and ok <> 'BNODE' group by all",
    "export_ntriples": f"{GDM} select {_SUBJECT} || ' <' || p || '> ' || {_OBJECT} || ' .' as value from d",
    "export_nquads": f"{GDM} select {_SUBJECT} || ' <' || p || '> ' || {_OBJECT} || case when model <> '' then ' <' || model || '>' else '' end || ' .' as value from d",
    "export_turtle": f"{ONE} " + _BLOCK.format(cols="s || ' ' || x || ' .' as value"),
    "export_trig": f"{ONE} " + _BLOCK.format(cols="'<' || model || '> {' || chr(10) || s || ' ' || x || ' .' || chr(10) || '}' as value"),
    "export_rdf_xml": f"""{ONE}, y as (select model, case when sk = 'BNODE' then 'rdf:nodeID="b' || sid || '"' else 'rdf:about="' || sid || '"' end as s, '<p:' || split_part(p, '#', 2) || ' xmlns:p="{V}"' || case ok
    when 'LITERAL' then '>' || replace(replace(replace(replace(val, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</p:' || split_part(p, '#', 2) || '>' when 'BNODE' then ' rdf:nodeID="b' || oid || '"/>' else ' rdf:resource="' || oid || '"/>' end as v from e1)
select '<rdf:Description ' || s || '>' || string_agg(distinct v, '' order by v) || '</rdf:Description>' as value from y group by model, s""",
    "export_model": f"{ONE} select {_SUBJECT} || ' <' || p || '> ' || {_OBJECT} || ' <m1> .' as value from e1 where model = 'm1'",
    "export_page": f"{ONE}, k as (select *, {_KEY} as stmt_key from e1 where model = 'm1') select stmt_key, p as predicate from k order by cast('0x' || stmt_key[1:15] as bigint), stmt_key limit 1000 offset 2000",
    "export_formats": "select * from (values ('', 'n-quads'), ('n-quads', 'n-quads'), ('application/trig', 'trig'), ('text/turtle; charset=utf-8', 'turtle'), ('text/n3', 'n3'), ('application/rdf+xml', 'rdf-xml'), ('text/html', '406'), ('nonsense', '406')) as t(asked, answer)",
    "record_json": f"""with {SHOP},\n{_statements(1)}, q as (select record_id, case when sk = 'BNODE' then '{{"id":"' || sha256('shop|' || sid) || '"}}' else '{{"uri":"' || sid || '"}}' end as s, p,
  case ok when 'LITERAL' then '{{"v":"' || val || '"}}' when 'BNODE' then '{{"id":"' || sha256('shop|' || oid) || '"}}' else '{{"uri":"' || oid || '"}}' end as o, ord,
  case when {_NOT_TYPE} then pos * 10 + 1 when pos = 1 then 20 else (pos - 1) * 10 + 2 end as place from raw1)
select record_id, '{{"' || record_id || '":[' || string_agg('{{"s":' || s || ',"p":"' || p || '","o":' || o || case when ord is not null then ',"order":' || ord else '' end || '}}', ',' order by place) || ']}}' as value from q group by record_id""",
    "json_round_trip": f"{ONE} select record_id, p as predicate, ok as object_kind, oid as object_id, val as object_value, count(*) as n from e1 where ok <> 'BNODE' and sk <> 'BNODE' group by all",
    "ntriples_round_trip": f"{ONE} select sk as subject_kind, p as predicate, ok as object_kind, val as object_value, count(*) as n from e1 group by all",
    "xml_flat_record": f"select '{B}customer/' || c_custkey as record_id, '<Customer xmlns=\"{V}\"><name xmlns=\"{V}\"><![CDATA[' || c_name || ']]></name><segment xmlns=\"{V}\"><![CDATA[' || c_mktsegment || ']]></segment></Customer>' as value from customer",
    "xml_nested_record": f"""with {SHOP}, x as (select k, string_agg('<item xmlns="{V}"><flag xmlns="{V}"><![CDATA[' || flag || ']]></flag><qty xmlns="{V}"><![CDATA[' || qty || ']]></qty><terms xmlns="{V}"><shipdate xmlns="{V}"><![CDATA[' || day
  || ']]></shipdate><linestatus xmlns="{V}"><![CDATA[' || ls || ']]></linestatus></terms></item>', '' order by o) as items from l1 group by all)
select '{B}order/' || k as record_id, '<Order xmlns="{V}"><status xmlns="{V}"><![CDATA[' || status || ']]></status><priority xmlns="{V}"><![CDATA[' || prio || ']]></priority><total xmlns="{V}"><![CDATA[' || total || ']]></total>' || coalesce(items, '') || '</Order>' as value
from o1 left join x using (k)""",
    "xml_attributes": f"""with {SHOP}, x as (select k, string_agg('<item xmlns="{V}" flag="' || flag || '" qty="' || qty || '"><terms xmlns="{V}" shipdate="' || day || '" linestatus="' || ls || '"></terms></item>', '' order by o) as items from l1 group by all)
select '{B}order/' || k as record_id, '<Order xmlns="{V}" status="' || status || '" priority="' || prio || '" total="' || total || '">' || coalesce(items, '') || '</Order>' as value from o1 left join x using (k)""",
    "deterministic_ids": f"{ONE} select record_id, cast(sum(cast(cast('0x' || {_KEY}[1:15] as bigint) as hugeint)) as varchar) as total from e1 group by all",
    "store_put": f"""{DELTA}, w as (select model, 1 as a, case when state in ('DELETION', 'MODIFICATION') or (state = 'EXACT_MATCH' and o1 is distinct from o2) then 2 else {OPEN} end as b from c where state <> 'ADDITION'
  union all select model, 2, {OPEN} from c where state in ('ADDITION', 'MODIFICATION') or (state = 'EXACT_MATCH' and o1 is distinct from o2)
  union all select 'm' || (k % 4), 1, 2 from o1, lateral (select unnest(range(4 + 0)) as z) where k not in (select k from o2)
  union all select 'm' || (k % 4), 1, 2 from l1, lateral (select unnest(range(7)) as z) where k not in (select k from o2)
  union all select 'm' || (k % 4), 2, {OPEN} from o2, lateral (select unnest(range(2 + case when prio is null then 0 else 1 end + case when note is null then 0 else 1 end + 1)) as z) where k not in (select k from o1)
  union all select 'm' || (k % 4), 2, {OPEN} from l2, lateral (select unnest(range(7)) as z) where k not in (select k from o1))
select model, cast(a as integer) as valid_from, cast(b as integer) as valid_to, count(*) as n, cast(2 as integer) as latest_version from w group by all""",
    "store_wipe": f"""{GDM.replace("coalesce(model, '') as model", "'g' || (row_id % 2) as model")}, t as (select distinct oid from g where p = '{TYPE}' and ok <> 'LITERAL'),
ns as (select distinct regexp_extract(p, '^(.*[#/])[^#/]*$', 1, 's') as n from s), x as (select (select count(*) from d) as d, (select count(*) from d where model = 'g1') as d1, (select count(*) from t) as t,
  (select count(*) from ns where n <> '' and n not in (select column1 from ({_STATIC}) as k(column0, column1))) + 4 as p)
select 'deprecated' as what, d1 as n from x union all select 'deprecated again', 0 union all select 'deleted', d * 2 + t + p from x union all select 'left', 0 union all select 'folders freed', 3""",
    "stream_upsert": f"{GDM.replace(chr(39) + chr(39) + ') as model', chr(39) + chr(39) + ') as old_model').replace('select row_id, coalesce', 'select row_id, ' + repr('stream') + ' as model, coalesce', 1)} select p as predicate, cast(1 as integer) as valid_from, cast({OPEN} as integer) as valid_to, count(*) as n from d group by all",
    "health": "select 'pong' as answer",
}
