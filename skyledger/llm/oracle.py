"""SQL for the queries that SQL can express."""

from __future__ import annotations

from skyledger.llm import licenses

ORACLE: dict[str, str] = {}

# Space, tab, line feed, vertical tab, form feed and carriage return.
_WORDS = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)"

ORACLE["op4_mixing"] = f"""
with sized as (
  select doc_id, source, {_WORDS} as size,
         md5('0:' || coalesce(cast(doc_id as varchar), 'null') || ':' || md5(coalesce(text, '')) || ':' ||
             row_number() over (partition by doc_id, source, coalesce(text, ''))) as at
  from documents
), sources as (
  select source, cast(sum(size) as bigint) as source_size from sized group by source
), weighed as (
  select *, case (row_number() over (order by source nulls last) - 1) % 3
              when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight,
         source_size * 2.0::double as cap
  from sources
), filling as (
  select *, cap / weight as fills_at,
         (cast(sum(source_size) over () as double) * 1.5::double
          - coalesce(sum(cap) over (order by cap / weight, source nulls last
              rows between unbounded preceding and 1 preceding), 0))
         / sum(weight) over (order by cap / weight, source nulls last
              rows between current row and unbounded following) as level
  from weighed
), opened as (
  select *, arg_min(level, fills_at) filter (where level < fills_at) over () as open_level
  from filling
), goals as (
  select source, source_size,
         case when open_level is null then cap else least(cap, open_level * weight) end as target
  from opened
), placed as (
  select s.doc_id, s.size, g.source_size, g.target,
         coalesce(sum(s.size) over (partition by s.source order by s.at, s.size
             rows between unbounded preceding and 1 preceding), 0) as starts
  from sized s join goals g on s.source is not distinct from g.source
), budgeted as (
  select *, case when source_size > 0 then floor(floor(target) / source_size) else 0 end as epochs
  from placed
)
select doc_id, cast(size as bigint) as size, source_size, target,
       cast(epochs * size
            + greatest(0, least(size, floor(target) - epochs * source_size - starts)) as bigint)
         as taken
from budgeted
"""


def _licenses() -> str:
    rows, seeds = [], []
    for t in licenses.parsed(licenses.TEMPLATES):
        listed = ", ".join(f"'{g}'" for g in t.bigrams)
        rows.append(f"('{t.name}', [{listed}], {len(t.bigrams)}, {len(t.pairs)}, {t.bounds[0]}, {t.bounds[1]})")
        seeds += [f"('{t.name}', '{g}', {at})" for g, at in t.seeds]
    return rf"""
with templates(license, own, n, span, least, most) as (values {", ".join(rows)}),
seeds(license, gram, stands) as (values {", ".join(seeds)}),
texts as (
  select row_number() over () as r, doc_id,
         string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') as w
  from documents
), grams as (
  select r, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) as grams from texts
), placed as (
  select r, unnest(range(len(grams))) as place, unnest(grams) as gram from grams
), laid as (
  select distinct r, license, greatest(place - stands, 0) as start from placed join seeds using (gram)
), windows as (
  select r, license, start, own, n, least, most, list_slice(grams, start + 1, start + span) as grams
  from laid join grams using (r) join templates using (license)
), held as (
  select *, list_filter(range(len(grams)), lambda j: list_contains(own, grams[j + 1])) as places from windows
), cut as (
  select r, license, n, own, least, most, start + places[1] as begins, start + places[-1] + 2 as ends,
         list_distinct(list_slice(grams, places[1] + 1, places[-1] + 1)) as passage
  from held where len(places) >= least
), matched as (
  select r, license, n, begins, ends,
         cast(floor(2000 * len(list_intersect(passage, own)) / (len(passage) + n)) as bigint) as dice
  from cut where len(passage) between least and most
), ranked as (
  select *, coalesce(begins >= max(ends) over (partition by r order by begins, ends, license
              rows between unbounded preceding and 1 preceding), true) as opens
  from matched where dice >= {licenses.LEAST_DICE}
), numbered as (
  select *, sum(cast(opens as int)) over (partition by r order by begins, ends, license
              rows between unbounded preceding and current row) as notice
  from ranked
), notices as (
  select r, notice, max(dice) as dice, arg_min(license, (-dice, -n, license)) as license
  from numbered group by r, notice
), counted as (
  select r, max(dice) as dice, arg_min(license, (-dice, license)) as license, count(*) as n_passages
  from notices group by r
)
select doc_id, license, dice, cast(coalesce(n_passages, 0) as bigint) as n_passages
from texts left join counted using (r)
"""


ORACLE["op9_licenses"] = _licenses()

ORACLE["op11_negatives"] = """
with given as (
  select vec_id as id, embedding,
         case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label
  from embeddings where vec_id is not null and label is not null and embedding is not null
), kept as (
  select id, label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
  from given
  where len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), held as (
  select *, row_number() over () as n from kept
), scored as (
  select a.n as an, a.id as anchor_id, b.n as bn, b.id as id, a.label = b.label as alike,
         cast(list_dot_product(a.v, b.v) as bigint) as score
  from held a join held b on a.n <> b.n where a.id % 100 = 0
), positives as (
  select an, anchor_id, bn, id as positive_id, score as positive_score
  from scored where alike
  qualify row_number() over (partition by an order by score desc, id) <= 5
), ranked as (
  select p.anchor_id, p.positive_id, s.id as negative_id, p.positive_score, s.score as negative_score,
         row_number() over (partition by p.an, p.bn order by s.score desc, s.id) as rank
  from positives p join scored s on s.an = p.an and not s.alike
   and 30 * p.positive_score <= 100 * s.score and 100 * s.score <= 90 * p.positive_score
)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score
from ranked where rank <= 10
"""
