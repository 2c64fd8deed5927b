"""SQL for the operators that it can express, in DuckDB's dialect."""

from __future__ import annotations

#: All strings of 50 bytes (as 100 hex digits), the least document of each, runs of covered bytes, and what is left between them.
SUFFIX_DEDUP = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
p as (select doc_id, i, substr(h, 2 * i + 1, 100) as w from (select doc_id, h, unnest(range(0, greatest(length(h) // 2 - 49, 0))) as i from d)),
m as (select w, min(doc_id) as low from p group by w having count(distinct doc_id) > 1),
s as (select doc_id, i, coalesce(i - lag(i) over (partition by doc_id order by i) > 50, true) as fresh from p join m using (w) where low < doc_id),
g as (select doc_id, i, sum(fresh::int) over (partition by doc_id order by i) as run from s),
r as (select doc_id, run, min(i) as start, max(i) + 50 as stop from g group by all),
k as (select doc_id, start, stop, coalesce(lag(stop) over (partition by doc_id order by start), 0) as was from r),
c as (select k.doc_id, sum(stop - start) as n, count(*) as spans, string_agg(substr(h, 2 * was + 1, 2 * (start - was)), '' order by start) as head, max(stop) as last from k join d using (doc_id) group by k.doc_id)
select doc_id, length(h) // 2 as n_bytes, cast(coalesce(n, 0) as bigint) as n_removed, coalesce(spans, 0) as n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) as kept_sha256
from d left join c using (doc_id)
"""

#: Cosines of all pairs of a label, and what the links reach.
EMBEDDING_NEAR_DEDUP = """
with recursive v as (
  select vec_id, label, embedding::double[] as e from embeddings
  where embedding is not null and label is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), l as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.93
), reach(vec_id, other) as (
  select vec_id, vec_id from embeddings union select r.vec_id, l.b from reach r join l on r.other = l.a
), n as (select a as vec_id, count(*) as n from l group by a), c as (select vec_id, min(other) as component_id from reach group by vec_id)
select e.vec_id, coalesce(n, 0) as n_links, component_id, e.vec_id = component_id as kept from embeddings e join c using (vec_id) left join n using (vec_id)
"""


def mixing(weights: dict[str, int], block_chars: int) -> str:
    """Running sums to blocks; phases in which the same sources are left; one cycle of each phase slot by slot, earliest deadline first. Whole weights."""
    rows = ", ".join(f"('{s}', {int(w)}::bigint)" for s, w in weights.items())
    names = ", ".join(f"'{s}'" for s in weights if s != "other")
    return f"""
with recursive w(src, w) as (values {rows}),
doc as (select doc_id, source, length(text) as n_chars, coalesce(length(text), 0) as n, case when source in ({names}) then source else 'other' end as src, md5(cast(doc_id as varchar)) as o from documents),
st as (select *, cast(coalesce(sum(n) over (partition by src order by o, n rows between unbounded preceding and 1 preceding), 0) as bigint) as start from doc),
blk as (select src, cast(greatest(1, (sum(n) + {block_chars - 1}) // {block_chars}) + (sum(n) > 0 and sum(n) % {block_chars} = 0)::int as bigint) as blocks from doc group by src),
ph(phase, src, w, lft, first, slot, share, size, run, base) as (
  select 0, src, w, blocks, 0::bigint, 0::bigint, 0::bigint, 0::bigint, 0::bigint, 0::bigint from blk join w using (src)
  union all
  select phase + 1, src, w, lft1 - took, first + share * whole + took, slot + size * (whole + alive::int), share, size, share * whole + took, slot from (
    select *, case when alive then least(lft1, share) else 0 end as took from (
      select *, min(lft1) over () > 0 as alive from (
        select *, lft - share * whole as lft1 from (
          select *, min(lft // share) over () as whole from (
            select *, w // part as share, cast(sum(w) over () // part as bigint) as size from (
              select phase, src, w, lft, first, slot, list_reduce(list(w) over (), lambda a, b: gcd(a, b)) as part from ph where lft > 0))))))
),
cyc(phase, src, share, size, t, done, hit) as (
  select phase, src, share, size, -1, 0::bigint, false from ph where phase > 0
  union all
  select phase, src, share, size, t + 1, done + now::int, now from (
    select *, ok and row_number() over (partition by phase order by ok desc, ((done + 1) * size + share - 1) // share, src) = 1 as now from (
      select *, done < share and done * size // share <= t + 1 as ok from cyc where t < size - 1))
)
select st.doc_id, st.source, st.n_chars, st.src as mix_source, start // {block_chars} as mix_block,
  cast(base + ((start // {block_chars} - (ph.first - run)) // ph.share) * ph.size + c.t as bigint) as mix_slot, start as mix_start
from st join ph on ph.src = st.src and phase > 0 and start // {block_chars} >= ph.first - run and start // {block_chars} < ph.first
join cyc c on c.phase = ph.phase and c.src = ph.src and c.hit and c.done - 1 = (start // {block_chars} - (ph.first - run)) % ph.share
"""
