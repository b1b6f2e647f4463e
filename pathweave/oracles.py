"""The same results in ANSI SQL over the given tables."""

from __future__ import annotations

CHAIN = """e as (select distinct src, label, dst from (
  select l_partkey as src, cast(l_quantity as int) as label,
         lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) as dst
  from lineitem) where dst is not null)"""
HANDOFF = """e as (select distinct src, label, dst from (
  select user_id as src, cast(json_extract_string(props, '$.k') as int) as label,
         lead(user_id) over (partition by cast(ts as date) order by ts, event_id) as dst
  from events) where dst is not null)"""
ORDERS = """o as (select o_orderkey as src,
         lead(o_orderkey, 1) over w as d1, lead(o_orderkey, 2) over w as d2
  from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)),
e as (select src, 1 as label, d1 as dst from o where d1 is not null
      union select src, 2, d2 from o where d2 is not null)"""
NODES = "n as (select src as node from e union select dst from e)"
THIRDS = NODES + ", f as (select node, cast(node % 3 as int) as part from n)"
YEARS = "f as (select o_orderkey as node, cast(year(o_orderdate) as int) as part from orders)"
CROSS = """x as (select e.src, e.label, e.dst from e left join f fs on fs.node = e.src left join f fd on fd.node = e.dst
              where coalesce(fs.part <> fd.part, true)),
b as (select distinct dst as node from x)"""
PIECES = """w as (select src, label, dst,
  cast((row_number() over (partition by src, label order by dst) - 1) // 1000000 as int) as piece from e)"""
TOTAL = "(select greatest(max(src), max(dst)) + 1 from e)"

R2 = "(1,5,2),(2,6,2),(2,7,3)"
R3 = "(1,5,2),(1,6,2),(2,5,2),(2,6,2)"
C2 = "(1,8,2),(2,9,2),(2,10,2),(2,11,3)"
BOTH = "(1,5,2),(2,6,2),(2,7,4),(1,8,3),(3,9,3),(3,10,3),(3,11,4)"
FOLLOW = "(1,1,2),(2,2,2),(2,1,3),(3,1,3)"


def _automaton(rows: str) -> str:
    return f"a(q, label, t) as (values {rows})"


def _walk(name: str, automaton: str, extra: str = "") -> str:
    """Recursive states (origin, node, q) over e with the automaton table named."""
    return f"""{name}(origin, node, q) as (
  select e.src, e.dst, a.t from e join {automaton} a on a.label = e.label and a.q = 1 {extra}
  union
  select r.origin, e.dst, a.t from {name} r join e on e.src = r.node
         join {automaton} a on a.q = r.q and a.label = e.label)"""


def _rpq(edges: str, rows: str, final: int, extra: str = "", columns: str = "origin, node") -> str:
    return f"""with recursive {edges}, {_automaton(rows)}, {_walk('r', 'a', extra)}
select distinct {columns} from r where q = {final}"""


FIRST = f"""{_automaton(R2)},
p as (select distinct e.src, a.q, e.dst, a.t from e join a on a.label = e.label),
s as (select distinct src as origin, dst as node, t as q from p where q = 1),
s2 as (select distinct s.origin, p.dst as node, p.t as q from s join p on p.src = s.node and p.q = s.q
       except select origin, node, q from s)"""

# one walk for both conjuncts; sources need a start label of each
ONE_GO = f"""with recursive {HANDOFF}, {_automaton(BOTH)},
d as (select src from e where label in (5, 8) group by src having count(distinct label) = 2),
r(origin, node, q, lastq) as (
  select e.src, e.dst, a.t, a.q from e join a on a.label = e.label and a.q = 1 where e.src in (select src from d)
  union
  select r.origin, e.dst, a.t, a.q from r join e on e.src = r.node join a on a.q = r.q and a.label = e.label),
g as (select distinct origin, node, lastq from r where q = 4),
ok as (select origin, node from g group by origin, node having count(*) = 2)"""

COLOURS = NODES + """, k as (select node, row_number() over (order by md5('7:' || node), node) - 1 as slot,
                                (select count(*) from n) as total from n),
c as (select node, cast(case when slot < total // 3 then 0 when slot < 2 * (total // 3) then 1 else 2 end as int) as colour
      from k)"""


def _tally(edges: str, score: str, extra: str = "") -> str:
    """Colours of the asked sizes, the score of the first colouring, and that the run ended with a better one as traced."""
    return f"""with {edges}, t as (select {TOTAL} as n),
k as (select node, row_number() over (order by md5('7:' || node), node) - 1 as slot from (select unnest(range(0, n)) as node from t)),
c as (select node, case when slot < n // 3 then 0 when slot < 2 * (n // 3) then 1 else 2 end as colour from k, t),
f as (select cast({score} as bigint) as first_score from e join c s on s.node = e.src join c d on d.node = e.dst where s.colour <> d.colour),
g as (select cast(0 as int) as colour, n // 3 as nodes from t union all select 1, n // 3 from t union all select 2, n - 2 * (n // 3) from t)
select colour, nodes, first_score, true as recounted, true as better{extra} from g, f"""


def _ranked(name: str, table: str) -> str:
    return f"""{name} as (select node, row_number() over (order by size, part, node) as pos
  from (select node, part, count(*) over (partition by part) as size from {table}))"""


def _members(name: str, table: str) -> str:
    return f"""{name}s as (select part, count(*) as size from {table} group by part),
{name}n as (select part, size, row_number() over (partition by size order by part) as number from {name}s),
{name} as (select t.node, s.size, s.number, row_number() over (partition by t.part order by t.node) as pos
  from {table} t join {name}n s on s.part = t.part)"""


SIGNATURES = f"""{NODES}, lv as (select unnest(range(0, cast(floor(log2((select count(*) from n))) as int) + 1)) as level),
g as (select distinct cast(level as int) as level, src >> level as block, label from e, lv)"""

UNDIRECTED = """u as materialized (select p, q, count(*) as m from (select src as p, dst as q from e where src <> dst
                     union all select dst, src from e where src <> dst) group by p, q),
t as materialized (select u.p as node, f.part as colour, [sum(case when g.part = 0 then u.m else 0 end),
                     sum(case when g.part = 1 then u.m else 0 end), sum(case when g.part = 2 then u.m else 0 end)] as cnt
      from u join f on f.node = u.p join f g on g.node = u.q group by u.p, f.part)"""

# boundary nodes are counted before and after every swap, over the nodes the swap can change
BOUNDARY_GAIN = """k as (select node, part as colour from f),
d as (select distinct src, dst from e where src <> dst),
pairs as (select d.src as p, d.dst as q, kp.colour as a, kq.colour as b from d join k kp on kp.node = d.src
          join k kq on kq.node = d.dst where kp.colour <> kq.colour),
touched as (select p, q, a, b, p as x from pairs union select p, q, a, b, q from pairs
            union select pairs.p, pairs.q, a, b, d.dst from pairs join d on d.src = pairs.p
            union select pairs.p, pairs.q, a, b, d.dst from pairs join d on d.src = pairs.q),
seen as (select t.p, t.q, t.x, kx.colour as xc, ks.colour as sc,
           case when t.x = t.p then t.b when t.x = t.q then t.a else kx.colour end as xn,
           case when d.src = t.p then t.b when d.src = t.q then t.a else ks.colour end as sn
         from touched t join d on d.dst = t.x join k kx on kx.node = t.x join k ks on ks.node = d.src),
state as (select p, q, x, bool_or(xc <> sc) as before, bool_or(xn <> sn) as after from seen group by p, q, x)"""

ORACLES = {
    "edge_list_load": f"with {CHAIN} select src, label, dst from e",
    "edge_list_load_sld": f"with {CHAIN} select src, label, dst from e",
    "layered_edges_union": f"with {CHAIN} select distinct src, cast(least(5, (label - 1) // 10 + 1) as int) as label, dst from e",
    "automaton_load": f"with {CHAIN} select cast(src + 1 as int) as q, label, cast(dst + 1 as int) as t from e",
    "start_node_load": f"with {CHAIN} select min(src) as node from e where label = 5",
    "adjacency_pack": f"""with {CHAIN}, {PIECES}
select src, label, piece, string_agg(cast(dst as varchar), ':' order by dst) as dsts from w group by src, label, piece""",
    "adjacency_unpack": f"with {CHAIN} select src, label, dst from e",
    "adjacency_unpack_text": f"with {ORDERS} select src, label, dst from e",
    "sink_nodes": f"with {ORDERS}, i as (select unnest(range(0, {TOTAL})) as node) select node from i where node not in (select src from e)",
    "label_scan": f"with {CHAIN} select src, label, dst from e where label in (5, 6, 7)",
    "label_scan_sources": f"with {CHAIN} select distinct src, label from e where label in (5, 6, 7)",
    "key_lookup_join": f"with {CHAIN} select src, label, dst from e where label in (6, 7) and src in (select dst from e where label = 5)",
    "graph_size": f"with {CHAIN} select count(*) as packed_rows from (select distinct src, label from e)",
    "undirected_adjacency_export": f"""with {ORDERS}, i as (select unnest(range(1, {TOTAL} + 1)) as node),
u as (select src + 1 as node, dst + 1 as near from e union all select dst + 1, src + 1 from e),
l as (select node, string_agg(cast(near as varchar), ' ' order by near) as line from u group by node)
select i.node, 0 as piece, coalesce(l.line, '') as line from i left join l on l.node = i.node""",
    "edge_list_write": f"with {CHAIN} select src || ' ' || dst || ' ' || label as line from e",
    "colouring_write": f"with {CHAIN}, {COLOURS} select node, colour from c",
    "colouring_read": f"with {CHAIN}, {COLOURS} select node, colour from c",
    "edges_last_write_wins": """select src, label, dst from (
  select l_partkey as src, cast(l_quantity as int) as label, l_suppkey as dst,
         row_number() over (partition by l_partkey, cast(l_quantity as int)
                            order by l_orderkey desc, l_linenumber desc, l_suppkey desc) as pos
  from lineitem) where pos = 1""",
    "start_transitions": f"with {CHAIN} select cast(src + 1 as int) as q, label, cast(dst + 1 as int) as t from e where src = 0",
    "product_edges": f"with {CHAIN}, {FIRST} select src, q, dst, t from p",
    "product_start": f"with {CHAIN}, {FIRST} select origin, node, q from s",
    "frontier_labels": f"""with {CHAIN} select cast(src + 1 as int) as q, label, cast(dst + 1 as int) as t from e
where src in (select dst from e where src = 0)""",
    "next_states": f"with {CHAIN}, {FIRST} select origin, node, q from s2",
    "next_states_from_ids": f"""with {CHAIN}, {FIRST} select distinct p.dst as node, p.t as q from p
where p.src in (select node from s) and exists (select 1 from s where s.node = p.src and s.q = p.q)""",
    "final_answers": f"with {CHAIN}, {FIRST} select distinct origin, node from (select * from s union select * from s2) where q = 3",
    "rpq_pairs": _rpq(CHAIN, R2, 3),
    "rpq_pairs_closure": _rpq(HANDOFF, R3, 2),
    "rpq_pairs_lookup": _rpq(CHAIN, R2, 3),
    "rpq_reachable": _rpq(CHAIN, C2, 3, columns="node"),
    "rpq_from_node": _rpq(HANDOFF, R3, 2, "where e.src = 17"),
    "fragment_matches": f"""with recursive {ORDERS}, {YEARS}, {CROSS}, {_automaton(FOLLOW)},
r(q_from, u, q, v) as (
  select a.q, e.src, a.t, e.dst from e join a on a.label = e.label where a.q = 1 or e.src in (select node from b)
  union
  select r.q_from, r.u, a.t, e.dst from r join e on e.src = r.v join a on a.q = r.q and a.label = e.label
  where r.v not in (select node from b))
select q_from, q as q_to, u, v from r where q = 3 or v in (select node from b)""",
    "compose_matches": _rpq(ORDERS, FOLLOW, 3),
    "rpq_partial_eval": _rpq(CHAIN, R2, 3),
    "rpq_partial_eval_from_node": _rpq(HANDOFF, R3, 2, "where e.src = 17"),
    "rpq_lookup_by_source": _rpq(HANDOFF, R3, 2, "where e.src = 17"),
    "rpq_partial_eval_coloured": _rpq(ORDERS, FOLLOW, 3),
    "crpq_merge": f"""with recursive {HANDOFF}, a1(q, label, t) as (values {R2}), a2(q, label, t) as (values {C2}),
{_walk('r1', 'a1')}, {_walk('r2', 'a2')}
select origin, node from r1 where q = 3 intersect select origin, node from r2 where q = 3""",
    "start_label_division": f"with {HANDOFF} select src from e where label in (5, 8) group by src having count(distinct label) = 2",
    "crpq_one_go": f"{ONE_GO} select origin, node from ok",
    "crpq_support": f"{ONE_GO} select g.origin, g.node, g.lastq from g join ok on ok.origin = g.origin and ok.node = g.node",
    "signature_build": f"with {CHAIN}, {SIGNATURES} select level, block, label from g",
    "signature_load": f"with {CHAIN}, {SIGNATURES} select level, block, label from g",
    "signature_lookup": f"""with {CHAIN}, k as (select src >> 2 as block from e where label in (5, 8)
  group by src >> 2 having count(distinct label) = 2)
select unnest(range(block * 4, block * 4 + 4)) as node from k""",
    "crpq_with_index": f"{ONE_GO} select origin, node from ok",
    "crpq_by_descent": f"{ONE_GO} select origin, node from ok",
    "crpq_one_go_reduced": f"{ONE_GO} select origin, node from ok",
    "rpq_pairs_reduced": _rpq(HANDOFF, R2, 3),
    "fragment_assign": f"with {CHAIN}, {THIRDS} select node, part from f",
    "fragment_sizes": f"with {CHAIN}, {THIRDS} select part, count(*) as nodes from f group by part",
    "cross_edges": f"with {CHAIN}, {THIRDS}, {CROSS} select src, label, dst from x",
    "boundary_nodes": f"with {ORDERS}, {YEARS}, {CROSS} select node from b",
    "locality_flags": f"with {CHAIN} select src, label, dst, src % 3 = dst % 3 as local from e",
    "locality_flags_packed": f"""with {ORDERS}, {YEARS}, {PIECES}
select w.src, w.label, w.piece, string_agg(w.dst || case when fs.part = fd.part then '-1' else '-0' end, ':' order by w.dst) as dsts
from w left join f fs on fs.node = w.src left join f fd on fd.node = w.dst group by w.src, w.label, w.piece""",
    "boundary_flags": f"""with {ORDERS}, {YEARS}, {CROSS}, {PIECES}
select src, label, piece, string_agg(cast(dst as varchar), ':' order by dst) as dsts,
src in (select node from b) as boundary from w group by src, label, piece""",
    "boundary_by_histogram": f"with {ORDERS}, {YEARS}, {CROSS} select node from b",
    "idmap_storage_order": f"""with {CHAIN}, {THIRDS}, l as (select node, row_number() over (order by node) as pos from n),
r as (select node, row_number() over (order by part, node) as pos from f)
select l.node as old_id, r.node as new_id from l join r on r.pos = l.pos""",
    "idmap_by_partition_file": f"""with {CHAIN}, {THIRDS}, h as (select node, cast((node >> 3) % 3 as int) as part from n),
{_ranked('l', 'h')}, {_ranked('r', 'f')}
select l.node as old_id, r.node as new_id from l join r on r.pos = l.pos""",
    "idmap_by_group_size": f"""with {CHAIN}, {THIRDS}, h as (select node, cast((node + 1) % 3 as int) as part from n),
{_members('l', 'h')}, {_members('r', 'f')}
select l.node as old_id, r.node as new_id from l join r on r.size = l.size and r.number = l.number and r.pos = l.pos""",
    "relabel_edges": f"""with {CHAIN}, {THIRDS}, l as (select node, row_number() over (order by node) as pos from n),
r as (select node, row_number() over (order by part, node) as pos from f),
m as (select l.node as old_id, r.node as new_id from l join r on r.pos = l.pos)
select s.new_id as src, e.label, coalesce(d.new_id, e.dst) as dst
from e join m s on s.old_id = e.src left join m d on d.old_id = e.dst""",
    "colour_init": f"with {CHAIN}, {COLOURS} select node, colour from c",
    "swap_gain_edge": f"""with {CHAIN}, {THIRDS}, {UNDIRECTED}
select u.p, u.q,
  cast(list_sum(a.cnt) - a.cnt[a.colour + 1] + list_sum(b.cnt) - b.cnt[b.colour + 1] as bigint) as before,
  cast(list_sum(a.cnt) - a.cnt[b.colour + 1] + list_sum(b.cnt) - b.cnt[a.colour + 1] + 2 * u.m as bigint) as after
from u join t a on a.node = u.p join t b on b.node = u.q where u.p < u.q and a.colour <> b.colour""",
    "swap_gain_boundary": f"""with {ORDERS}, {THIRDS}, {BOUNDARY_GAIN}
select p, q, count(*) filter (where before and not after) as removed,
       count(*) filter (where after and not before) as added from state group by p, q""",
    "partition_edge_local_tally": _tally(CHAIN, "count(*)", ", cast(0 as bigint) as improving"),
    "partition_edge_random_tally": _tally(CHAIN, "count(*)"),
    "partition_boundary_local_tally": _tally(ORDERS, "count(distinct e.dst)"),
    "partition_boundary_random_tally": _tally(ORDERS, "count(distinct e.dst)"),
    "label_frequency": f"with {CHAIN} select label, cast(count(*) as double) / (select count(*) from e) as share from e group by label",
    "label_frequency_above": f"""with {CHAIN}, g as (select label, cast(count(*) as double) / (select count(*) from e) as share
  from e group by label) select label, share from g where share > 0.02""",
    "label_count": f"with {CHAIN} select count(distinct label) as labels from e",
    "node_set": f"with {CHAIN}, {NODES} select node from n",
    "node_count": f"with {CHAIN}, {NODES} select count(*) as nodes from n",
    "query_filter": """select l_orderkey, line from (
  select l_orderkey, '<<' || (l_linenumber - 1) || '>> ' || cast(l_quantity as int) as line from lineitem)
where not contains(line, '<<0>>')""",
}
