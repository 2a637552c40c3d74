"""ANSI SQL for the queries, by name, as DuckDB runs it. Queries without an entry are tested against brute force."""

_ID = "regexp_extract({0}, '^(.+)_([a-z]+)_(\\d{{5,}})$', {1})"


def _id(column: str, part: int) -> str:
    return _ID.format(column, part)


_NORM = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
_CLEAN = "regexp_replace(lower(trim(category)), '[^a-z]', '', 'g')"
_PAYLOAD = "landed_at, judged_at, passed, syntax_pass, leak_pass, judge_error, category, reply, leak_reason"
_ORDER = ", ".join(f"{c} desc nulls last" for c in _PAYLOAD.split(", "))
_LATEST_RAW = f"""latest_raw as (
  select model_slug, scenario_id, turn, {_PAYLOAD} from (
    select *, row_number() over (partition by model_slug, scenario_id, turn order by {_ORDER}) as rn from verdicts) where rn = 1)"""
_LATEST = f"{_LATEST_RAW}, v as (select * replace ({_CLEAN} as category) from latest_raw)"
_IDS = f"ids as (select id, {_id('id', 1)} as split, {_id('id', 2)} as category, cast({_id('id', 3)} as bigint) as idx from (select distinct id from convs))"
_JUDGED = "(not coalesce(judge_error, false) and passed is not null)"
_TURNS = """turns as (
  select distinct id, pos, m.role as role, coalesce(m.content, '') as content from (
    select id, unnest(messages) as m, generate_subscripts(messages, 1) - 1 as pos from convs))"""


def _shuffled(source: str, seed: str, into: str = "p") -> str:
    return f"{into} as (select *, row_number() over (partition by category order by md5(id || '{seed}'), id) as rn from {source})"


def _one(*cols: str) -> str:
    """One row an id: the smallest landing time, then the smallest columns, nulls first."""
    order = ", ".join(f"{c} asc nulls first" for c in ("landed_at", *cols))
    return f"one as (select id, {', '.join(cols)} from (select *, row_number() over (partition by id order by {order}) as rn from convs) where rn = 1)"


def _targets(sizes: dict[str, int], headroom: dict[str, float], extra: int) -> str:
    s = ", ".join(f"('{k}', {n}, {headroom[k]}::double)" for k, n in sizes.items())
    m = "('howto', 0.3::double), ('factual', 0.2::double), ('emotional', 0.15::double), ('meta', 0.15::double), ('math', 0.1::double), ('smalltalk', 0.1::double)"
    return (
        f"select split, category, cast(ceil(ceil(n * f) * h) + {extra} as int) as target "
        f"from (values {s}) a(split, n, h), (values {m}) b(category, f)"
    )


_SIZES = {"train": 2000, "test": 100, "eval_dev": 120, "eval_final": 80}
_CATS = ("howto", "factual", "emotional", "meta", "math", "smalltalk")
_OUT = f"""scen as (select model_slug, scenario_id, bool_and(coalesce(passed, false)) as all_passed,
  bool_or(coalesce(judge_error, false) or passed is null) as any_error, count(*) filter (not coalesce(passed, true)) as n_failed
  from v group by model_slug, scenario_id)"""
_ESC = r"regexp_replace(lower(trim(a)), '([^\p{L}\p{N}\s])', '\\\1', 'g')"

SQL: dict[str, str] = {
    "summary_by_model_category": f"""with {_LATEST} select model_slug, category, count(*) as n_rows,
      count(*) filter ({_JUDGED}) as n_judged, count(*) filter ({_JUDGED} and passed) as n_passed, count(*) filter (not {_JUDGED}) as n_errors,
      count(*) filter ({_JUDGED} and not syntax_pass) as n_syntax, count(*) filter ({_JUDGED} and syntax_pass and not leak_pass) as n_leak,
      count(*) filter ({_JUDGED} and passed) / greatest(1, count(*) filter ({_JUDGED})) as adherence
      from v group by grouping sets ((model_slug, category), (model_slug), (category), ())""",
    "robustness_by_model": f"""with {_LATEST}, {_OUT} select model_slug, count(*) as n_scenarios, count(*) filter (not any_error) as n_clean,
      count(*) filter (not any_error and all_passed) as n_robust,
      count(*) filter (not any_error and all_passed) / greatest(1, count(*) filter (not any_error)) as robustness from scen group by model_slug""",
    "failure_pivot": f"with {_LATEST} select model_slug, "
    + ", ".join(f"avg(case when category = '{c}' then 1.0::double - cast(passed as int)::double end) as {c}" for c in _CATS)
    + " from v where passed is not null group by model_slug",
    "mean_and_count": f"""with {_LATEST} select model_slug, avg(cast(passed as int)::double) as mean_passed, count(passed) as n_passed_known,
      count(*) filter (judge_error) as n_judge_error from v group by model_slug""",
    "per_turn_failure": f"""with {_LATEST} select turn, count(*) as n, count(*) filter (not passed) as n_failed,
      count(*) filter (not passed) / count(*) as failed_share from v where passed is not null group by turn""",
    "bad_turn_histogram": f"with {_LATEST}, {_OUT} select n_failed, count(*) as n_scenarios from scen group by n_failed",
    "running_best_regression": f"""with {_LATEST}, daily as (select strftime(judged_at at time zone 'UTC', '%Y-%m-%d') as day,
      count(*) filter (passed) / count(*) as clean_share from v where passed is not null and judged_at is not null group by 1),
      b as (select *, max(clean_share) over (order by day rows between unbounded preceding and 1 preceding) as best_before from daily)
      select *, clean_share < best_before - 0.2::double as regressed from b""",
    "latest_verdicts": f"with {_LATEST_RAW} select model_slug, scenario_id, turn, passed, judge_error, leak_reason from latest_raw",
    "model_grid_missing": """with m as (select distinct model_slug from verdicts where model_slug is not null),
      k as (select distinct model_slug, scenario_id from verdicts)
      select m.model_slug, count(*) as n_scenarios, count(*) filter (k.scenario_id is null) as n_missing
      from m cross join scenarios s left join k on k.model_slug = m.model_slug and k.scenario_id = s.id group by m.model_slug""",
    "verdicts_with_blueprint": f"""with ids as (select id from blueprints union select id from scenarios)
      select {_id('id', 1)} as split, {_id('id', 2)} as category, count(*) as n_replies, count(distinct scenario_id) as n_scenarios,
      count(*) filter (passed) as n_passed from verdicts join ids on id = scenario_id group by 1, 2""",
    "unknown_scenarios": """select scenario_id, count(*) as n from verdicts v
      where not exists (select 1 from (select id from blueprints union select id from scenarios) i where i.id = v.scenario_id) group by scenario_id""",
    "reply_size_by_model": """select model_slug, count(*) as n_replies, cast(sum(length(reply)) as bigint) as n_chars,
      cast(sum(octet_length(encode(reply))) as bigint) as n_bytes from verdicts group by model_slug""",
    "turn_facts": f"with {_TURNS} select id, pos, cast(pos // 2 + 1 as bigint) as turn, length(content) as n_chars from turns where role = 'assistant'",
    "history_prefix": f"""with {_TURNS} select id, pos,
      cast(coalesce(sum(length(content)) over (w rows between unbounded preceding and 1 preceding), 0) as bigint) as chars_before,
      count(*) over (w rows between unbounded preceding and 1 preceding) as messages_before,
      md5(coalesce(lag(content, 2) over w, '') || '|' || coalesce(lag(content, 1) over w, '')) as context_md5
      from turns window w as (partition by id order by pos, role nulls first, content)""",
    "message_counts": f"with {_one('messages')} select coalesce(len(messages), 0) as n_messages, count(*) as n_convs from one group by 1",
    "structural_issues": f"""with {_one('messages')}, x as (select id, messages, coalesce(len(messages), 0) as n,
      list_transform(messages, lambda m, i: coalesce(m.role <> (case when i % 2 = 1 then 'user' else 'assistant' end), true)) as bad,
      list_transform(messages, lambda m: trim(coalesce(m.content, '')) = '') as blank from one),
      i as (select unnest(list_filter([case when n = 0 then 'no messages' end, case when n % 2 = 1 then 'odd length' end,
        case when list_contains(bad, true) then 'roles do not alternate' end, case when list_contains(blank, true) then 'empty content' end,
        case when n > 0 and messages[n].role = 'user' then 'unanswered' end], lambda y: y is not null)) as issue from x)
      select issue, count(*) as n_convs from i group by issue""",
    "chat_text_hash": f"""with {_one('messages')} select id, left(sha256(array_to_string(list_transform(coalesce(messages, []),
      lambda m: '<|im_start|>' || coalesce(m.role, '') || chr(10) || coalesce(m.content, '') || '<|im_end|>' || chr(10)), '')), 16) as sha from one""",
    "sft_projection": f"""with {_one('messages', 'status')} select id, {_id('id', 2)} as category, coalesce(len(messages), 0) as n_messages
      from one where status = 'ok'""",
    "merged_answers": f"""with {_one('expected_answers', 'persona')}, x as (
      select id, list_concat(coalesce(expected_answers, []), coalesce(string_split(persona, '; '), [])) as a from one)
      select id, array_to_string(a, '|') as merged, len(a) as n from x""",
    "shift_summary": f"""with {_one('answer_summary', 'drop_reason')} select id,
      nullif(trim(coalesce(answer_summary, '') || '; after the topic shift: ' || coalesce(drop_reason, ''), '; '), '') as summary from one""",
    "first_turn_dedup": f"""with b as (select distinct id, {_NORM.format('turns[1]')} as t from blueprints),
      c as (select id, left(sha256(t), 16) as sha from b where t is not null)
      select sha, min(id) as first_id, count(*) as n from c group by sha having count(*) > 1""",
    "leak_hits": f"""with {_one('expected_answers', 'messages')}, m as (
      select id, expected_answers, unnest(messages) as m, generate_subscripts(messages, 1) - 1 as pos from one),
      h as (select id, pos, list_filter(expected_answers, lambda a: trim(a) <> '' and
        regexp_matches(lower(coalesce(m.content, '')), '(^|[^a-z0-9])' || {_ESC} || '($|[^a-z0-9])'))[1] as hit from m where m.role = 'assistant')
      select * from h where hit is not null""",
    "weak_variants": """select answer, count(*) as n, regexp_full_match(trim(answer), '\\d+') or length(trim(answer)) < 4 as weak
      from (select unnest(expected_answers) as answer from convs) where answer is not null group by answer""",
    "parsed_verdicts": """select leak_pass, case when leak_pass is null then null else not leak_pass end as leak, count(*) as n
      from verdicts where turn is not null group by 1, 2""",
    "category_counts": f"with {_IDS} select split, category, count(*) as n from ids group by 1, 2",
    "shortage": f"""with {_IDS}, h as (select split, category, count(*) as have from ids group by 1, 2)
      select t.split, t.category, min_rows, coalesce(have, 0) as have, min_rows - coalesce(have, 0) as short
      from category_targets t left join h using (split, category) where coalesce(have, 0) < min_rows""",
    "regens_and_drops": f"""with {_one('regens', 'status', 'drop_reason')} select status, count(*) as n,
      cast(sum(coalesce(regens, 0)) as bigint) as regens, count(drop_reason) as n_reasons from one group by status""",
    "duplicate_ids_ci": "select lower(id) as id, count(*) as n from convs group by 1 having count(*) > 1",
    "tickets_latest": """select t.id, max(coalesce(attempts, 0)) as attempts, count(distinct raw_sha) as n_versions,
      t.id in (select id from convs) as known from tickets t where t.id is not null group by t.id""",
    "pending_ids": """select distinct id from tickets t where not exists (select 1 from convs c where c.status = 'ok' and c.id = t.id)
      and not exists (select 1 from tombstones b where b.id = t.id)""",
    "ticketed_convs": f"with {_IDS} select category, count(*) as n from ids where id in (select id from tickets) group by category",
    "source_counts": " union all ".join(
        f"select '{n}' as source, count(*) as n_rows, count(distinct id) as n_ids from {n}" for n in ("convs", "blueprints", "tickets", "tombstones", "scenarios")
    ),
    "topic_overlap": f"""with t as (select {_id('id', 1)} as split, {_NORM.format('topic')} as topic from
      (select id, topic from convs union all select id, topic from blueprints))
      select topic, count(distinct split) as n_splits, count(*) as n from t where topic <> '' group by topic having count(distinct split) > 1""",
    "mix_difference": f"""with a as (select distinct {_CLEAN} as category from convs where {_CLEAN} <> ''), b as (select distinct {_id('id', 2)} as category from convs)
      select category, 'field' as side from a where category not in (select category from b)
      union all select category, 'id' as side from b where category not in (select category from a)""",
    "id_grammar": f"""with {_IDS} select split, category, count(*) filter (id = split || '_' || category || '_' || lpad(idx::varchar, cast(greatest(5, length(idx::varchar)) as int), '0')) as n_same,
      max(idx) as max_idx, min(length(id)) as min_length from ids group by 1, 2""",
    "distinct_categories": f"with {_IDS} select distinct category from ids order by category",
    "topic_targets": _targets(_SIZES, {"train": 1.3, "test": 1.3, "eval_dev": 1.15, "eval_final": 1.15}, 2),
    "blueprint_targets": _targets(_SIZES, {"train": 1.15, "test": 1.15, "eval_dev": 1.05, "eval_final": 1.05}, 0),
    "shuffled_order": f"with {_IDS}, {_shuffled('ids', '42')} select id, category, rn from p",
    "ladder_rungs": f"""with {_IDS}, t as (select * from ids where split = 'train'), {_shuffled('t', '44')},
      mix as (select * from (values ('howto', 0.3::double, 1), ('factual', 0.2::double, 2), ('emotional', 0.15::double, 3), ('meta', 0.15::double, 4), ('math', 0.1::double, 5), ('smalltalk', 0.1::double, 6)) x(category, f, k)),
      rungs as (select * from (values (10), (20), (40), (125), (250), (500), (1000), (2000), (2500), (5000)) r(rung)),
      want as (select rung, category, k, cast(ceil(rung * f) as bigint) as want from rungs, mix),
      have as (select category, count(*) as have from p group by category),
      can as (select rung from want left join have using (category) group by rung having bool_and(coalesce(have, 0) >= want)),
      cum as (select rung, category, k, want, sum(want) over (partition by rung order by k) - want as before from want where rung in (select rung from can)),
      kept as (select rung, category, least(want, greatest(0, rung - before)) as kept from cum)
      select rung, p.category as category, count(*) as n, min(id) as first_id from p join kept on kept.category = p.category and rn <= kept group by 1, 2""",
    "extension_ids": f"""with {_IDS}, x as (select category, greatest(90000, max(idx) + 1) as first_free from ids where split = 'train' group by category)
      select category, first_free, 'train_' || category || '_' || lpad(first_free::varchar, 5, '0') as first_id from x""",
    "shift_partner": f"""with {_IDS}, {_shuffled('ids', '777')}, h as (select *, cast('0x' || left(md5(id), 6) as bigint) as h from p),
      q as (select *, 1 + (h // 2) % (rn - 1) as partner_rn from h where h % 2 = 0 and rn > 1)
      select q.id, p.id as partner_id from q join p on p.category = q.category and p.rn = q.partner_rn""",
    "round_robin": f"with {_IDS}, {_shuffled('ids', '42')} select category, cast((rn - 1) % 8 as bigint) as slot, count(*) as n from p group by 1, 2",
    "avoid_list": f"""with {_IDS}, {_shuffled('ids', '42')} select id,
      max(idx) over (w rows between 80 preceding and 1 preceding) as max_before, count(*) over (w rows between 80 preceding and 1 preceding) as n_before
      from p window w as (partition by category order by rn)""",
    "batch_sizes": """with n as (select count(distinct id) as n from convs)
      select 8 as size, n // 8 as n_batches from n where n >= 8 union all select n % 8, 1 from n where n % 8 > 0""",
    "ordered_limit": "select distinct id from convs order by id limit 100",
    "checkpoint_order": """select distinct model_slug as name, coalesce(try_cast(regexp_extract(model_slug, '(\\d+)$', 1) as bigint), -1) as step
      from verdicts where model_slug is not null""",
    "events_last_by_user": """select user_id, event_id, event_type from (
      select *, row_number() over (partition by user_id order by event_id desc, event_type desc) as rn from events where user_id is not null) where rn = 1""",
    "quality_by_source": """select source, count(*) as n, count(text) as n_text, cast(sum(length(text)) as bigint) as n_chars, max(length(text)) as longest
      from documents group by source""",
    "stale_sizes": "select doc_id, n_chars, length(text) as real_chars from documents where n_chars <> length(text)",
    "revenue_by_nation": """select n_name, round(sum(l_extendedprice * (1 - l_discount)), 0) as revenue, count(*) as n from lineitem
      join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey group by n_name""",
}

from dialoom.plans import oracle_dialogues  # noqa: E402

SQL |= oracle_dialogues.SQL
