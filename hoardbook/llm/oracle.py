"""DuckDB counterparts of the training-data queries that SQL can express."""

ORACLE_SQL = {
    "op3_vector_join": """
with recursive usable as (
    select vec_id, embedding::double[] as v from embeddings
    where embedding is not null and len(embedding) > 0
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
      and len(list_filter(embedding, lambda x: x <> 0)) > 0
), units as (
    select vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as u from usable
), links as (
    select a.vec_id as a, b.vec_id as b from units a join units b
    on a.vec_id <> b.vec_id and len(a.u) = len(b.u) and list_dot_product(a.u, b.u) >= 0.9
), reach as (
    select vec_id as a, vec_id as b from embeddings
    union
    select reach.a, links.b from reach join links on reach.b = links.a
), component as (select a as vec_id, min(b) as component_id from reach group by a),
counts as (select a as vec_id, count(*) as n from links group by a)
select e.vec_id, coalesce(n, 0) as n_links, component_id, e.vec_id = component_id as kept
from embeddings e join component using (vec_id) left join counts using (vec_id)
""",
    "op4_exact_dedup": """
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
       doc_id = max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
from documents window same as (partition by coalesce(text, ''))
""",
    "op9_mixing": r"""
with sized as (
    select doc_id, source,
           len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size
    from documents
), totals as (
    select source, sum(size)::bigint as source_size from sized group by source
), weighted as (
    select *, 2 * source_size as cap,
           [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight
    from totals
), levels as (
    select *, cap / weight::double as per_weight,
           (1.5::double * sum(source_size) over ()
            - coalesce(sum(cap) over (order by cap / weight::double, source nulls last
                                      rows between unbounded preceding and 1 preceding), 0))
           / (sum(weight) over ()
              - coalesce(sum(weight) over (order by cap / weight::double, source nulls last
                                           rows between unbounded preceding and 1 preceding), 0))
           as step
    from weighted
), targets as (
    select source, source_size,
           case when per_weight < max(step) over () then cap::double
                else weight * max(step) over () end as target
    from levels
), placed as (
    select s.*, t.source_size, t.target,
           case when t.source_size > 0 then floor(t.target / t.source_size) else 0 end::bigint as whole,
           coalesce(sum(size) over (
               partition by s.source order by md5('mix|' || coalesce(doc_id::varchar, '')), doc_id, size
               rows between unbounded preceding and 1 preceding), 0)::bigint as before
    from sized s join targets t on s.source is not distinct from t.source
)
select doc_id, size, source_size, target,
       (whole * size + greatest(0, least(size,
            floor(target)::bigint - whole * source_size - before)))::bigint as taken
from placed
""",
}
