"""The package's queries and the SQL that answers them, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dialoom.functions.normalize import INVISIBLE, UNSPACED
from dialoom.llm import leakage, mixing, overlap, packing, quality, repetition, sampling, sentences, splits
from dialoom.llm.mixing import SEED
from dialoom.llm.records import STAND_INS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": splits.p1_found,
    "p1_splits": splits.p1_splits,
    "p1_split_report": splits.p1_split_report,
    "p2_found": overlap.p2_found,
    "p2_report": overlap.p2_report,
    "p3_found": repetition.p3_found,
    "p3_shares": repetition.p3_shares,
    "p4_found": sentences.p4_found,
    "p4_sentences": sentences.p4_sentences,
    "p5_found": sampling.p5_found,
    "p5_report": sampling.p5_report,
    "p5_sample": sampling.p5_sample,
    "p6_found": leakage.p6_found,
    "p6_leaked_turns": leakage.p6_leaked_turns,
    "p6_turns": leakage.p6_turns,
    "p7_found": packing.p7_found,
    "p7_containers": packing.p7_containers,
    "p7_fill": packing.p7_fill,
    "p8_found": mixing.p8_found,
    "p8_mix": mixing.p8_mix,
    "p8_shares": mixing.p8_shares,
    "p9_found": quality.p9_found,
    "p9_quality": quality.p9_quality,
}

_SOURCE = "nullif(regexp_replace(lower(trim(source)), '[\\s_-]+', '_', 'g'), '')"

_SPLIT, _CATEGORY = (f"regexp_extract({{0}}, '^(.+)_([a-z]+)_(\\d+)$', {k})" for k in (1, 2))
# What differs under compatibility composition in these tables: full-width letters and digits, and one Thai vowel.
_WIDE = "".join(map(chr, (*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B))))
_PLAIN = "".join(chr(ord(c) - 0xFEE0) for c in _WIDE)
_FORM = f"nfc_normalize(replace(translate({{0}}, '{_WIDE}', '{_PLAIN}'), '\u0e33', '\u0e4d\u0e32'))"
_KEY = f"regexp_replace(lower({_FORM}), '[^\\p{{{{L}}}}\\p{{{{N}}}}\\p{{{{M}}}}]+', '', 'g')"
_QUESTIONS = "list_value(regexp_replace(core_question, '(?is)\\(\\s*secondary\\s*:.*$', ''), regexp_extract(core_question, '(?is)\\(\\s*secondary\\s*:(.*)\\)[^)]*$', 1))"
_MISSING = "'', " + ", ".join(f"'{x}'" for x in STAND_INS)
_HIDDEN = f"regexp_replace({{0}}, '[{INVISIBLE}]+', '', 'g')"
_WORDS = (
    f"regexp_extract_all(regexp_replace(lower({_FORM.format(_HIDDEN)}), '([{UNSPACED}]\\p{{{{M}}}}*)', ' \\1 ', 'g'), '[\\p{{{{L}}}}\\p{{{{N}}}}\\p{{{{M}}}}]+')"
)


def _passed_on(source: str, over: str, into: str, out: str) -> str:
    """Rows of source with what each takes over of the unmet rows of its group; what is left stays with the group's first row."""
    return f"""{out}a as (select *, sum(spare) over (partition by {over}) as s, sum(unmet) over (partition by {over}) as u,
        sum(spare) over (partition by {over} order by category) as r, row_number() over (partition by {over} order by category) as k from {source}),
      {out}b as (select *, case when s > 0 then floor(r * least(u, s) / s) else 0 end as upto from {out}a),
      {out} as (select * exclude (spare, unmet, s, u, r, k, upto), cast(upto - lag(upto, 1, 0) over (partition by {over} order by category) as bigint) as {into},
        spare - (upto - lag(upto, 1, 0) over (partition by {over} order by category)) as spare, case when k = 1 then u - least(u, s) else 0 end as unmet from {out}b)"""

_IDS5 = f"ids as (select distinct id, {_SPLIT.format('id')} as split, {_CATEGORY.format('id')} as category from convs where id is not null)"
_PLAN5 = f"""{_IDS5}, have as (select split, category, count(*) as n from ids group by 1, 2),
      w as (select t.split, t.category, coalesce(n, 0) as available, greatest(coalesce(min_rows, 0)::double, coalesce(target_share * sample_rows, 0)) as want,
        case when t.category in ('howto', 'factual', 'math') then 'task' when t.category in ('emotional', 'meta', 'smalltalk') then 'talk' else 'other' end as parent
        from category_targets t left join have h on h.split = t.split and h.category = t.category),
      o as (select *, least(available, cast(ceil(want) as bigint)) as own from w),
      x as (select *, cast(ceil(want) as bigint) - own as unmet, available - own as spare from o),
      {_passed_on('x', 'split, parent', 'from_siblings', 'y')}, {_passed_on('y', 'split', 'from_cousins', 'z')},
      plan as (select split, category, available, want, own, from_siblings, from_cousins, own + from_siblings + from_cousins as quota, available >= want as met from z)"""
# Copies by systematic sampling along the permutation of each source, and what they come to by mix and source.
_MIX8 = f"""d as (select doc_id, {_SOURCE} as s, coalesce(octet_length(encode(text)), 0) as tokens from documents),
      size as (select s, count(*) as n, sum(tokens) as total from d where s is not null group by s),
      p as (select mix_name, m.source as name, {_SOURCE.replace('source', 'm.source')} as s, target_share, total_tokens, max_repeats, coalesce(n, 0) as source_docs,
        cast(coalesce(total, 0) as bigint) as source_tokens, coalesce(target_share * total_tokens, 0.0) as wish, coalesce(max_repeats, 0) as most
        from mix_plan m left join size on size.s = {_SOURCE.replace('source', 'm.source')}),
      due as (select *, case when source_tokens > 0 then least(wish / source_tokens, most::double) else 0.0 end as due,
        cast('0x' || left(md5(mix_name || '|' || s || '|{SEED}'), 8) as bigint) / 4294967296.0::double as u from p),
      r as (select *, row_number() over (partition by s order by md5(doc_id::varchar || '{SEED}'), doc_id) as k from d where s is not null),
      mixed as (select mix_name, doc_id, s as source, tokens, cast(floor(k * due + u) - floor((k - 1) * due + u) as int) as copies from r join due using (s)),
      got as (select mix_name, source, sum(tokens * copies) as mixed_tokens, max(copies) as most_copies from mixed where copies > 0 group by 1, 2)"""

# The others are tested against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "p5_found": """with ids as (select distinct id, regexp_extract(id, '^(.+)_([a-z]+)_(\\d+)$', 1) as split,
        regexp_extract(id, '^(.+)_([a-z]+)_(\\d+)$', 2) as category from convs),
      have as (select split, category, count(*) as n from ids group by 1, 2)
      select distinct t.split, t.category from category_targets t left join have h on h.split = t.split and h.category = t.category
      where coalesce(h.n, 0) < greatest(coalesce(min_rows, 0)::double, coalesce(target_share * sample_rows, 0))""",
    # A record's splits go along its keys to other records until nothing is new.
    "p1_found": f"""with recursive r as (select id, topic, core_question from convs union select id, topic, core_question from blueprints),
      k as (select id, 't' as kind, topic as x from r union all select id, 'q', unnest({_QUESTIONS}) from r),
      e as (select distinct id, kind || ':' || {_KEY.format('x')} as key from k where {_KEY.format('x')} not in ({_MISSING})),
      reach(node, split) as (select id, {_SPLIT.format('id')} from e union select case when e.id = reach.node then e.key else e.id end, split
        from reach join e on e.id = reach.node or e.key = reach.node)
      select id from (select distinct id from e) i join reach on node = id group by id having count(distinct split) > 1""",
    "p5_report": f"with {_PLAN5} select * from plan",
    "p5_sample": f"""with {_PLAN5}, r as (select *, row_number() over (partition by split, category order by md5(id || '{sampling.SEED}'), id) as k from ids)
      select id, r.split, r.category from r join plan on plan.split = r.split and plan.category = r.category where k <= quota""",
    "p6_found": f"""with t as (select distinct id, {_WORDS.format('turn')} as w from (select id, unnest(turns) as turn from blueprints)),
      m as (select distinct id, {_WORDS.format('m.content')} as w from (select id, unnest(messages) as m from convs where {_SPLIT.format('id')} = 'train')),
      a as (select id, unnest(list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i : i + 9], ' '))) as run from t where len(w) >= 10),
      b as (select id, unnest(list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i : i + 9], ' '))) as run from m where len(w) >= 10)
      select distinct a.id as id_a, b.id as id_b from a join b using (run)""",
    "p7_found": """select distinct plan_name, doc_id from documents, pack_plan
      where coalesce(octet_length(encode(text)), 0) > capacity_tokens""",
    "p8_mix": f"with {_MIX8} select mix_name, doc_id, source, tokens, copies from mixed where copies > 0",
    "p8_shares": f"""with {_MIX8} select due.mix_name, name as source, target_share, total_tokens, source_tokens, cast(coalesce(mixed_tokens, 0) as bigint) as mixed_tokens,
      coalesce(mixed_tokens, 0) / total_tokens as share, coalesce(most_copies, 0) as most_copies, max_repeats, most * source_tokens >= wish as reachable
      from due left join got on got.mix_name = due.mix_name and got.source = due.s""",
    "p8_found": f"""with d as (select {_SOURCE} as s, sum(coalesce(octet_length(encode(text)), 0)) as n from documents group by 1)
      select distinct mix_name, source from mix_plan left join d on d.s = {_SOURCE}
      where coalesce(max_repeats, 0) * coalesce(n, 0) < coalesce(target_share * total_tokens, 0)""",
}
