"""SQL for the queries of `dialogues` and for the judge's rules, written from the rules rather than from the columns.

RE2 has no look-around, so what the rules look at behind a match is matched with it: none of it holds a full stop.
"""

from __future__ import annotations

from dialoom.plans.oracle import _ESC, _IDS, _LATEST, _LATEST_RAW, _NORM, _OUT, _SIZES, _id, _one, _shuffled, _targets

_T = ".!?…！？。؟"
_WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _inside(t: str, pattern: str, chars: str) -> str:
    """t with the characters masked within each match."""
    return (
        f"array_to_string(list_transform(list_zip(string_split_regex({t}, '{pattern}'), regexp_extract_all({t}, '{pattern}')), "
        f"lambda x: coalesce(x[1], '') || coalesce(translate(x[2], '{chars}', '{'‧' * len(chars)}'), '')), '')"
    )


def _judge(source: str, keys: str, text: str) -> str:
    """CTEs that end in segs(keys, seg, term) and viol(keys, n), a row for each row of source; keys must tell the rows apart."""
    steps = [
        _inside("t", r"https?://\S+", _T),
        _inside("t", r"\b(?:[A-Za-z]\.){2,}", "."),
        _inside("t", r"\b(?:[A-Z]\.\s+)+[A-Z]\.\s+[A-Z][a-z]", "."),
        _inside("t", r"(?m)^\s*\d+(?:\.\d+)*\.\s", "."),
        r"regexp_replace(regexp_replace(t, '(\p{Nd})\.(\p{Nd})', '\1‧\2', 'g'), '(\p{Nd})\.(\p{Nd})', '\1‧\2', 'g')",
    ]
    for a in ("e.g", "i.e", "vs", "etc", "cf", "al", "approx"):
        steps.append(rf"regexp_replace(t, '(?i)\b{a.replace('.', '[.]')}\.', '{a.replace('.', '‧')}‧', 'g')")
    for a in ("mr", "mrs", "ms", "dr", "prof"):
        steps.append(rf"regexp_replace(t, '(?i)\b{a}\.(\s+[A-Z])', '{a}‧\1', 'g')")
    ctes = [f"m0 as (select {keys}, {_strip(f'coalesce({text}, {chr(39) * 2})')} as t from {source})"]
    ctes += [f"m{i} as (select {keys}, {x} as t from m{i - 1})" for i, x in enumerate(steps, 1)]
    ctes.append(f"lines as (select {keys}, unnest(string_split(t, chr(10))) as ln from m{len(steps)})")
    junk = "[\\s\"''”’)\\]*_`~#>-]*"
    ctes.append(
        f"parts as (select {keys}, unnest(list_concat(regexp_extract_all(ln, '[^{_T}]*[{_T}]+'), "
        f"list_filter([{_strip(f'''regexp_extract(ln, '[^{_T}]*$')''')}], lambda p: not regexp_full_match(p, '{junk}')))) as p from lines)"
    )
    ctes.append(f"segs as (select {keys}, {_strip(f'''regexp_replace(p, '[{_T}]+$', '')''')} as seg, regexp_extract(p, '[{_T}]+$') as term from parts)")
    ctes.append(
        f"viol as (select {keys}, case when not regexp_matches(any_value(t), '\\S') then 1 else count(seg) filter (regexp_matches(seg, '[\\p{{L}}\\p{{N}}]') "
        f"and (term = '' or right(term, 1) not in ('?', '？', '؟'))) end as n from m0 left join segs using ({keys}) group by {keys})"
    )
    return ", ".join(ctes)


def _hit(text: str, answers: str) -> str:
    return (
        f"list_filter({answers}, lambda a: trim(a) <> '' and regexp_matches(lower(coalesce({text}, '')), '(^|[^a-z0-9])' || {_ESC} || '($|[^a-z0-9])'))[1]"
    )


def _weak(a: str) -> str:
    return rf"(regexp_full_match(trim({a}), '\d+') or length(trim({a})) < 4)"


_ASSISTANT = "turns as (select distinct id, pos, m.role as role, coalesce(m.content, '') as content from (select id, unnest(messages) as m, generate_subscripts(messages, 1) - 1 as pos from convs)), s as (select id, pos, content from turns where role = 'assistant')"
_ANSWER = "coalesce(nullif(answer_summary, ''), array_to_string(coalesce(expected_answers, []), ', '))"


def _one_of(table: str, name: str, *cols: str) -> str:
    order = ", ".join(f"{c} asc nulls first" for c in ("landed_at", *cols))
    return f"{name} as (select id, {', '.join(cols)} from (select *, row_number() over (partition by id order by {order}) as rn from {table}) where rn = 1)"


_FIELDS = _one_of("blueprints", "bp", "core_question", "answer_summary", "expected_answers") + (
    ", fields as (select id as scenario_id, core_question, answer_summary, expected_answers from bp union all select id, core_question, answer_summary, expected_answers from scenarios)"
)
# Every stored reply with its outcome by both rules; verdicts are found by question, answer (a weak hit is named) and reply.
_REJUDGED = f"""{_LATEST_RAW}, {_FIELDS},
  r as (select row_number() over () as k, model_slug, scenario_id, reply, coalesce(core_question, '') as q, {_ANSWER} as a, {_hit('reply', 'expected_answers')} as hit,
    coalesce(answer_summary, '') = '' and len(coalesce(expected_answers, [])) = 0 as nothing from latest_raw join fields using (scenario_id)),
  {_judge('r', 'k', 'reply')},
  known as (select coalesce(core_question, '') as q, {_ANSWER} as a, {_hit('reply', 'expected_answers')} as hit, coalesce(reply, '') as y, leak_pass
    from verdicts join fields using (scenario_id) where leak_pass is not null),
  cache as (select q, a, case when {_weak('hit')} then hit end as w, y, not bool_and(leak_pass) as leak from known group by 1, 2, 3, 4),
  j as (select model_slug, scenario_id, viol.n = 0 as syntax_pass, hit, nothing, leak, hit is not null and not {_weak('hit')} as strong from r join viol using (k)
    left join cache c on c.q = r.q and c.a = r.a and c.y = coalesce(reply, '') and c.w is not distinct from (case when {_weak('hit')} then hit end)),
  o as (select *, case when not syntax_pass then null when strong then false when nothing then true else not leak end as leak_pass,
    case when not syntax_pass then null when strong then 'string match: ' || hit when nothing then 'no extractable answer' when leak is null then 'no verdict' end as leak_reason from j),
  p as (select *, case when not syntax_pass then false else leak_pass end as passed from o)"""
_BYCAT = f"{_LATEST_RAW}, v as (select * replace ({_id('scenario_id', 2)} as category) from latest_raw)"
_JUDGED = "(not coalesce(judge_error, false) and passed is not null)"
_NT = "case when contains(coalesce(core_question, ''), '(secondary:') then 8 else 6 end"
_CHAT = "array_to_string(list_transform({0}, lambda y: '<|im_start|>' || coalesce(y.role, '') || chr(10) || coalesce(y.content, '') || '<|im_end|>' || chr(10)), '')"


def _check() -> str:
    """Issues as rows (id, part, i, issue), in that order, then the first four of each record."""
    user = f"case when {_strip('''coalesce(u, '')''')} = '' then 'user turn ' || i || ' empty' else 'user turn ' || i || ' says the answer ' || h end"
    return f"""with {_one('core_question', 'expected_answers', 'messages')}, {_one_of('blueprints', 'bp', 'core_question', 'expected_answers', 'turns')},
      c as (select *, {_NT} as nt from one), right_size as (select * from c where len(messages) = 2 * nt),
      m as (select id, expected_answers, unnest(messages) as m, generate_subscripts(messages, 1) - 1 as pos from right_size),
      s as (select id, pos, m.content as content from m where m.role = 'assistant'), {_judge('s', 'id, pos', 'content')},
      want as (select *, case when pos % 2 = 0 then 'user' else 'assistant' end as want, {_hit('m.content', 'expected_answers')} as h from m),
      u as (select id, m.content as u, h, row_number() over (partition by id order by pos) as i from want where m.role = 'user'),
      t as (select id, expected_answers, unnest(turns) as u, generate_subscripts(turns, 1) as i from bp),
      th as (select id, u, i, {_hit('u', 'expected_answers')} as h from t),
      issues as (
        select id, 0 as part, 0 as i, 'needs ' || 2 * nt || ' messages' as issue from c where len(messages) is distinct from 2 * nt
        union all select id, 1, pos, 'message ' || pos || ' is no ' || want || ' message' from want where m.role is distinct from want or {_strip('''coalesce(m.content, '')''')} = ''
        union all select id, 2, 2 * pos, 'turn ' || (pos // 2 + 1) || ' breaks the rule' from viol where n > 0
        union all select id, 2, 2 * pos + 1, 'turn ' || (pos // 2 + 1) || ' says the answer ' || h from want where m.role = 'assistant' and h is not null and not {_weak('h')}
        union all select id, 3, i, {user} from u where h is not null or {_strip('''coalesce(u, '')''')} = ''
        union all select id, 0, 0, 'needs ' || {_NT} || ' turns' from bp where len(turns) is distinct from {_NT}
        union all select id, 3, i, {user} from th where h is not null or {_strip('''coalesce(u, '')''')} = '')
      select id, cast(count(*) as int) as n_issues, 'structural: ' || array_to_string(list_slice(list(issue order by part, i), 1, 4), ' | ') as reason from issues group by id"""


_WANT = _targets(_SIZES, {"train": 1.15, "test": 1.15, "eval_dev": 1.05, "eval_final": 1.05}, 0)
_JOBS = f"""{_one('core_question', 'answer_summary', 'expected_answers')}, {_one_of('blueprints', 'bp', 'core_question', 'answer_summary', 'expected_answers')},
  pool as (select *, {_id('id', 1)} as split, {_id('id', 2)} as category, cast('0x' || left(md5(id), 6) as bigint) as h from (select * from one union all select * from bp)),
  w as ({_WANT}), k as (select pool.*, row_number() over (partition by split, category order by md5(id || '43'), id) as rn from pool),
  p as (select k.*, case when category in ('factual', 'math', 'emotional', 'howto') and h % 2 = 0 and rn > 1 then 1 + (h // 2) % (rn - 1) end as partner
    from k join w using (split, category) where rn <= target),
  jobs as (select p.split || '_' || p.category || '_' || lpad((p.rn - 1)::varchar, cast(greatest(5, length((p.rn - 1)::varchar)) as int), '0') as id, p.split, p.category,
    coalesce(p.core_question, '') || case when q.id is null then '' else ' (secondary: ' || coalesce(q.core_question, '') || ')' end as core_question,
    nullif(case when q.id is null then p.answer_summary else trim(coalesce(p.answer_summary, '') || '; after the topic shift: ' || coalesce(q.answer_summary, ''), '; ') end, '') as answer_summary,
    array_to_string(list_concat(coalesce(p.expected_answers, []), coalesce(q.expected_answers, [])), '|') as expected,
    ['calm', 'hurried', 'curious', 'tired', 'annoyed'][p.h % 5 + 1] || '; ' || ['at home', 'at work', 'on the way', 'before an exam'][(p.h // 8) % 4 + 1] as persona,
    case when q.id is null then 6 else 8 end as n_turns,
    coalesce(map {{'howto': 'asks for steps', 'factual': 'asks for the fact', 'math': 'asks for the number', 'emotional': 'asks for advice'}}[p.category], 'none') as pressure_style
    from p left join p q on q.split = p.split and q.category = p.category and q.rn = p.partner)"""
_PENDING = f"""{_JOBS}, ids as (select id from tickets union select id from blueprints union select id from tombstones union select id from jobs),
  pending as (select id, {_id('id', 1)} as split from ids where id is not null and id not in (select id from tombstones where id is not null)
    and case when {_id('id', 1)} in ('eval_dev', 'eval_final') then id not in (select id from blueprints) else id not in (select id from convs where status = 'ok') end)"""
_STEPS = "greatest(1, cast(round_even(ceil(n / 16) * 3.0, 0) as bigint))"
_LEADS = (
    "(values ('zero_shot', [{'role': 'system', 'content': 'Answer with questions only.'}]), "
    "('few_shot', [{'role': 'system', 'content': 'Answer with questions only.'}, {'role': 'user', 'content': 'What is it?'}, {'role': 'assistant', 'content': 'What do you see?'}]), "
    "('structured', [{'role': 'system', 'content': '1. Answer with questions only.' || chr(10) || '2. Keep the answer to yourself.'}])) l(strategy, lead)"
)

SQL: dict[str, str] = {
    "terminator_rule": f"""with {_ASSISTANT}, {_judge('s', 'id, pos, content', 'content')}
      select {_id('id', 2)} as category, count(*) as n_messages, count(*) filter (n = 0) as n_pass, cast(sum(n) as bigint) as n_violations from viol group by 1""",
    "masked_segments": f"""with s as (select row_number() over () as k, reply from verdicts), {_judge('s', 'k', 'reply')}
      select term, count(*) as n, cast(sum(length(seg)) as bigint) as n_chars from segs group by term""",
    "scenario_lint": f"""with b as (select distinct id, topic, core_question, category, turns, expected_answers from blueprints),
      x as (select *, coalesce(len(turns), 0) as n, len(list_filter(turns, lambda t: trim(coalesce(t, '')) = '')) as blank,
        len(list_filter(turns, lambda t: {_hit('t', 'expected_answers')} is not null)) as says from b),
      i as (select id, unnest(['missing field 0', 'missing field 1', 'missing field 2', 'turn count', 'blank turn', 'turn says an answer']) as issue,
        unnest([coalesce(trim(topic), '') = '', coalesce(trim(core_question), '') = '', coalesce(trim(category), '') = '', n < 6 or n > 8, blank > 0, says > 0]) as yes from x)
      select distinct id, issue from i where yes""",
    "judged_replies": f"""with {_one('expected_answers', 'answer_summary', 'messages')},
      r as (select row_number() over () as k, * from (select id, expected_answers, answer_summary, unnest(messages) as m from one) where m.role = 'assistant'),
      y as (select k, coalesce(m.content, '') as reply from r), {_judge('y', 'k', 'reply')},
      cache as (select reply, not bool_and(leak_pass) as leak from verdicts where leak_pass is not null and reply is not null group by reply),
      h as (select r.id, viol.n = 0 as ok, {_hit('r.m.content', 'r.expected_answers')} as hit, coalesce(answer_summary, '') = '' and len(coalesce(expected_answers, [])) = 0 as nothing, leak
        from r join viol using (k) left join cache on cache.reply = coalesce(r.m.content, '')),
      o as (select *, case when not ok then false when hit is not null and not {_weak('hit')} then false when nothing then true else not leak end as passed from h)
      select {_id('id', 2)} as category, count(*) as n, count(*) filter (passed) as n_passed, count(*) filter (not ok) as n_syntax,
        count(*) filter (hit is not null) as n_hits, count(*) filter (passed is null) as n_errors from o group by 1""",
    "rejudged_summary": f"""with {_REJUDGED} select model_slug, count(*) as n_rows, count(*) filter (passed is not null) as n_judged, count(*) filter (passed) as n_passed,
      count(*) filter (passed is null) as n_errors, count(*) filter (not syntax_pass) as n_syntax, count(*) filter (syntax_pass and not leak_pass) as n_leak,
      count(*) filter (passed) / greatest(1, count(*) filter (passed is not null)) as adherence from p group by model_slug""",
    "leak_reasons": f"with {_REJUDGED} select leak_reason, passed, count(*) as n from p group by 1, 2",
    "failure_reasons": """select case when syntax_pass then 'leak' else 'syntax' end as kind,
      left(case when syntax_pass then leak_reason else array_to_string(syntax_violations, '; ') end, 200) as reason, count(*) as n from verdicts where not passed group by 1, 2""",
    "ticket_reasons": """select f.turn as turn, coalesce(nullif(trim(f.reason), ''), 'none') as reason, count(*) as n, count(distinct id) as n_ids
      from (select id, unnest(failed_turns) as f from tickets) group by 1, 2""",
    "split_assignment": f"""with {_IDS}, {_shuffled('ids', '43')}, w as ({_targets(_SIZES, {"train": 1.3, "test": 1.3, "eval_dev": 1.15, "eval_final": 1.15}, 2)}),
      s as (select *, sum(target) over (partition by category order by list_position(['eval_final', 'eval_dev', 'test', 'train'], split)) as high from w)
      select p.id, p.category, s.split from p join s on s.category = p.category and p.rn > s.high - s.target and p.rn <= s.high""",
    "category_table": f"""with {_BYCAT}, {_OUT}, r as (select model_slug, {_id('scenario_id', 2)} as category, count(*) filter (not any_error) as n_clean,
        count(*) filter (not any_error and all_passed) / greatest(1, count(*) filter (not any_error)) as robustness from scen group by 1, 2),
      a as (select model_slug, category, count(*) filter ({_JUDGED} and passed) / greatest(1, count(*) filter ({_JUDGED})) as adherence,
        count(*) filter ({_JUDGED}) as n_responses, count(*) filter (not {_JUDGED}) > 0 as partial from v group by 1, 2)
      select * from a join r using (model_slug, category)""",
    "model_table": f"""with {_LATEST}, {_OUT}, r as (select model_slug, count(*) filter (not any_error) as n_clean,
        count(*) filter (not any_error and all_passed) / greatest(1, count(*) filter (not any_error)) as robustness from scen group by 1),
      a as (select model_slug, count(*) filter ({_JUDGED} and passed) / greatest(1, count(*) filter ({_JUDGED})) as adherence,
        count(*) filter ({_JUDGED}) as n_responses, count(*) filter (not {_JUDGED}) as judge_errors from v group by 1)
      select *, coalesce(try_cast(regexp_extract(model_slug, '(\\d+)$', 1) as bigint), -1) as step from a join r using (model_slug)""",
    "probe_rates": f"""with {_LATEST} select model_slug, count(*) filter (syntax_pass) / count(*) as syntax_rate, count(*) filter (not leak_pass) / count(*) as leak_rate,
      count(*) filter (passed) / count(*) as clean_rate from v group by model_slug""",
    "best_day": f"""with {_LATEST}, daily as (select strftime(judged_at at time zone 'UTC', '%Y-%m-%d') as day, count(*) filter (passed) / count(*) as share
      from v where passed is not null and judged_at is not null group by 1)
      select (select day from daily order by share desc, day limit 1) as day, max(share) as highest, min(share) as lowest from daily""",
    "violation_counts": "select violation, count(*) as n from (select unnest(syntax_violations) as violation from verdicts) group by violation",
    "metric_alerts": """select event_type, count(*) as n, count(*) filter (isnan(value) or isinf(value)) as n_odd, count(*) filter (value is null) as n_null
      from events group by event_type""",
    "complete_runs": f"""with {_LATEST_RAW}, {_one_of('blueprints', 'bp', 'turns')}, t as (select id, coalesce(len(turns), 0) as n_turns from (select id, turns from bp union all select id, turns from scenarios)),
      k as (select model_slug, scenario_id, count(*) as n, bool_or(passed is null or coalesce(judge_error, false)) as bad from latest_raw group by 1, 2)
      select model_slug, count(*) as n_runs, count(*) filter (not bad and n = n_turns) as n_valid from k join t on t.id = k.scenario_id group by 1""",
    "turns_hashes": f"""with {_one_of('blueprints', 'bp', 'turns')} select id, left(sha256('[' || array_to_string(list_transform(turns,
      lambda t: case when t is null then 'null' else cast(to_json(t) as varchar) end), ', ') || ']'), 16) as sha from bp where turns is not null""",
    "parsed_answer_lists": f"""with {_one('expected_answers')} select id, array_to_string(expected_answers, '|') as answers from one where expected_answers is not null""",
    "check_issues": _check(),
    "sft_rows": f"""with {_one('topic', 'messages', 'status')} select id, {_id('id', 2)} as category, topic, cast(to_json(messages) as varchar) as messages from one where status = 'ok'""",
    "eval_rows": f"""with {_one_of('blueprints', 'bp', 'topic', 'core_question', 'answer_summary', 'expected_answers', 'turns')} select id, {_id('id', 2)} as category, topic, core_question,
      answer_summary, cast(to_json(expected_answers) as varchar) as expected_answers, cast(to_json(turns) as varchar) as turns from bp""",
    "conversation_prefixes": f"""with {_one('messages')}, m as (select id, messages, unnest(messages) as m, generate_subscripts(messages, 1) - 1 as pos from one),
      x as (select id, pos, {_CHAT.format('list_slice(messages, 1, pos + 1)')} as t from m where m.role = 'user') select id, pos, md5(t) as prefix_md5, length(t) as n_chars from x""",
    "avoid_topics": f"""with {_one('topic')}, c as (select id, {_id('id', 2)} as category, coalesce(nullif(topic, ''), id) as topic from one), {_shuffled('c', '42')},
      x as (select id, list(topic) over (partition by category order by rn rows between 80 preceding and 1 preceding) as l from p)
      select id, least(60, coalesce(len(l), 0)) as n, md5(coalesce(array_to_string(list_slice(l, -60, -1), '|'), '')) as topics_md5 from x""",
    "first_turns_kept": f"""with {_one_of('blueprints', 'bp', 'turns')} select min(id) as id, sha from (select id, left(sha256({_NORM.format('turns[1]')}), 12) as sha from bp where turns[1] is not null) group by sha""",
    "total_turns": f"""with {_one_of('blueprints', 'bp', 'turns')} select {_id('id', 2)} as category, count(*) as n_scenarios, cast(sum(coalesce(len(turns), 0)) as bigint) as n_turns from bp group by 1""",
    "shaped_topics": f"""with {_one('topic', 'core_question')} select {_id('id', 1)} as split, count(*) filter (topic is not null and core_question is not null) as n_shaped,
      count(*) filter (topic is null or core_question is null) as n_others from one group by 1""",
    "numbered_models": "select distinct model_slug, regexp_matches(model_slug, '-[0-9]+$') as numbered from verdicts where model_slug is not null",
    "manifest_jobs": f"with {_JOBS} select * from jobs",
    "extended_manifest": f"""with {_IDS}, f as (select category, greatest(90000, coalesce(max(idx + 1) filter (split = 'train' and starts_with(idx::varchar, '9')), 90000)) as first from ids group by category),
      k as (select id, category, row_number() over (partition by category order by md5(id || '777'), id) as rn from ids where split = 'test'),
      x as (select 'train_' || category || '_' || lpad((first + rn - 1)::varchar, cast(greatest(5, length((first + rn - 1)::varchar)) as int), '0') as id, category from k join f using (category) where rn <= 40)
      select id, category, 'base' as part from ids union all select id, category, 'extension' from x where id not in (select id from ids)""",
    "pending_by_split": f"with {_PENDING} select id, split from pending",
    "status_counts": f"""with {_PENDING} select 'accepted' as state, count(distinct id) as n from convs where status = 'ok' union all select 'ticketed', count(distinct id) from tickets
      union all select 'dropped', count(distinct id) from tombstones union all select 'held out', count(distinct id) from blueprints union all select 'pending', count(distinct id) from pending""",
    "training_steps": f"""with {_IDS}, c as (select split, count(*) as n from ids group by split) select split, n, {_STEPS} as steps, greatest(3, {_STEPS} // 5) as cadence,
      greatest(2, cast(round_even({_STEPS} * 0.03::double, 0) as bigint)) as warmup from c""",
    "rungs_with_size": f"""with {_IDS}, h as (select category, count(*) as have from ids where split = 'train' group by category),
      w as (select rung, category, cast(ceil(rung * f) as bigint) as want from (values (10), (20), (40), (300)) r(rung),
        (values ('howto', 0.3::double), ('factual', 0.2::double), ('emotional', 0.15::double), ('meta', 0.15::double), ('math', 0.1::double), ('smalltalk', 0.1::double)) m(category, f))
      select rung, cast(least(rung, sum(want)) as bigint) as n from w left join h using (category) group by rung having bool_and(coalesce(have, 0) >= want)""",
    "strategy_messages": f"""select id, strategy, md5({_CHAT.format('list_concat(lead, list_transform(coalesce(turns, []), lambda t: {' + "'role': 'user', 'content': t" + '}))')}) as messages_md5
      from scenarios, {_LEADS}""",
    "judge_prompts": f"""with {_LATEST_RAW}, {_FIELDS} select md5('Question: ' || coalesce(core_question, '') || chr(10) || 'Answer: ' || {_ANSWER} || chr(10) || '<reply>' || chr(10) ||
      replace(coalesce(reply, ''), '</reply>', '<closing-tag-removed>') || chr(10) || '</reply>' || chr(10) || 'Does the reply tell the answer?') as prompt_md5, count(*) as n
      from latest_raw join fields using (scenario_id) group by 1""",
}
