"""Further queries by name: the judge over stored replies, checks of records, manifests, projections, prefixes and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.functions import judge_text as jt
from dialoom.operators import assemble, judge, metrics, validate
from dialoom.operators.scale import salted_join
from dialoom.plans.registry import SIZES, category_of, conv_ids, one_conv, query, split_of, verdict_rows
from dialoom.sources.readers import checkpoints, table

# Small dimensions of the queries below: parameters, not data.
SHIFTING = ("factual", "math", "emotional", "howto")
MOODS = ("calm", "hurried", "curious", "tired", "annoyed")
CONTEXTS = ("at home", "at work", "on the way", "before an exam")
PRESSURE = {"howto": "asks for steps", "factual": "asks for the fact", "math": "asks for the number", "emotional": "asks for advice"}
STRATEGIES = {
    "zero_shot": (("system", "Answer with questions only."),),
    "few_shot": (("system", "Answer with questions only."), ("user", "What is it?"), ("assistant", "What do you see?")),
    "structured": (("system", "1. Answer with questions only.\n2. Keep the answer to yourself."),),
}
PROMPT = "Question: {question}\nAnswer: {answer}\n<reply>\n{reply}\n</reply>\nDoes the reply tell the answer?"


def blueprint_of(s: SparkSession, d: str, *cols: str) -> DataFrame:
    """One row an id of blueprints, with the given columns; rows of one id are one record."""
    return assemble.first_wins(table(s, d, "blueprints").select("id", F.col("landed_at").alias("__at"), *cols), "id", "__at").drop("__at")


def scenario_fields(s: SparkSession, d: str) -> DataFrame:
    """(scenario_id, core_question, answer_summary, expected_answers) of blueprints and scenarios."""
    cols = ["core_question", "answer_summary", "expected_answers"]
    both = blueprint_of(s, d, *cols).select("id", *cols).unionByName(table(s, d, "scenarios").select("id", *cols))
    return both.withColumnRenamed("id", "scenario_id")


def rejudged(s: SparkSession, d: str) -> DataFrame:
    """The latest replies judged anew, with all stored verdicts as cache; a verdict that once told a leak tells it."""
    fields = scenario_fields(s, d)
    mine = metrics.latest(table(s, d, "verdicts")).select("model_slug", "scenario_id", "turn", "reply")
    replies = judge.keyed(salted_join(mine, fields, "scenario_id"))
    stored = table(s, d, "verdicts").filter("leak_pass is not null").select("scenario_id", "reply", "leak_pass")
    stored = judge.keyed(salted_join(stored, fields, "scenario_id"))
    cache = stored.groupBy("verdict_key").agg((~F.bool_and("leak_pass")).alias("leak"))
    return judge.judged(replies, cache).withColumn("category", category_of(F.col("scenario_id")))


@query
def rejudged_summary(s, d):
    """All stored replies judged anew by both rules, with the verdicts found by key, summed up by model."""
    return metrics.adherence(rejudged(s, d), [["model_slug"]])


@query
def leak_reasons(s, d):
    """Replies by what decided on the leak rule; a string match names the answer."""
    return rejudged(s, d).groupBy("leak_reason", "passed").agg(F.count("*").alias("n"))


@query
def category_table(s, d):
    """Adherence and robustness of each model and category (by id), and whether judging is complete."""
    rows = verdict_rows(s, d).withColumn("category", category_of(F.col("scenario_id")))
    by = ["model_slug", "category"]
    a = metrics.adherence(rows, [by]).select(*by, "adherence", F.col("n_judged").alias("n_responses"), (F.col("n_errors") > 0).alias("partial"))
    # A row a model and category on both sides.
    return a.join(metrics.robustness(rows, by).select(*by, "robustness", "n_clean"), by)


@query
def model_table(s, d):
    """Adherence and robustness of each model, by the trailing number of its name, which is the step."""
    rows = verdict_rows(s, d)
    a = metrics.adherence(rows, [["model_slug"]]).select("model_slug", "adherence", F.col("n_judged").alias("n_responses"), F.col("n_errors").alias("judge_errors"))
    j = a.join(metrics.robustness(rows, ["model_slug"]).select("model_slug", "robustness", "n_clean"), "model_slug")
    return checkpoints(j, "model_slug")


@query
def probe_rates(s, d):
    """Shares of replies that keep the form, leak, and are clean, by model."""
    n = F.greatest(F.lit(1), F.count("*"))
    return verdict_rows(s, d).groupBy("model_slug").agg(
        (F.count_if("syntax_pass") / n).alias("syntax_rate"), (F.count_if(~F.col("leak_pass")) / n).alias("leak_rate"), (F.count_if("passed") / n).alias("clean_rate")
    )


@query
def best_day(s, d):
    """The first of the days with the highest clean share, that share, and the lowest."""
    v = verdict_rows(s, d).filter("passed is not null and judged_at is not null")
    daily = v.groupBy(F.date_format("judged_at", "yyyy-MM-dd").alias("day")).agg((F.count_if("passed") / F.count("*")).alias("share"))
    best = F.max(F.struct("share", (-F.unix_date(F.to_date("day"))).alias("k"), "day"))
    return daily.agg(best.alias("b"), F.min("share").alias("lowest")).select(F.col("b.day").alias("day"), F.col("b.share").alias("highest"), "lowest")


@query
def violation_counts(s, d):
    """The violations of all replies as one list, counted by text."""
    return table(s, d, "verdicts").select(F.explode("syntax_violations").alias("violation")).groupBy("violation").agg(F.count("*").alias("n"))


@query
def metric_alerts(s, d):
    """F16: metric values that are no finite numbers, by kind of event."""
    v = F.col("value")
    odd = v.isNotNull() & (F.isnan(v) | (F.abs(v) == float("inf")))
    return table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(odd).alias("n_odd"), F.count_if(v.isNull()).alias("n_null"))


@query
def complete_runs(s, d):
    """Runs of a model over a scenario that are valid as they stand: every turn has a verdict, none is an error."""
    v = verdict_rows(s, d).groupBy("model_slug", "scenario_id").agg(F.count("*").alias("n"), F.bool_or(F.col("passed").isNull() | F.coalesce("judge_error", F.lit(False))).alias("bad"))
    size = F.coalesce(F.size(F.coalesce("turns", F.array().cast("array<string>"))), F.lit(0))
    turns = blueprint_of(s, d, "turns").select("id", "turns").unionByName(table(s, d, "scenarios").select("id", "turns"))
    j = salted_join(v, turns.select(F.col("id").alias("scenario_id"), size.alias("n_turns")), "scenario_id")
    return j.groupBy("model_slug").agg(F.count("*").alias("n_runs"), F.count_if(~F.col("bad") & (F.col("n") == F.col("n_turns"))).alias("n_valid"))


@query
def turns_hashes(s, d):
    """Each blueprint's turns as a hash of their JSON list, sixteen digits."""
    return blueprint_of(s, d, "turns").filter("turns is not null").select("id", jt.sha_prefix(jt.json_list(F.col("turns")), 16).alias("sha"))


@query
def parsed_answer_lists(s, d):
    """Lists of expected answers, written as a reply would write them, read back."""
    c = one_conv(s, d, "expected_answers").filter("expected_answers is not null")
    text = F.when(F.length("id") % 2 == 0, F.concat(F.lit("```json\n"), F.to_json("expected_answers"), F.lit("\n```"))).otherwise(
        F.concat(F.lit("Here: "), F.to_json("expected_answers"), F.lit(" ok")))
    return c.select("id", F.array_join(jt.parsed_array(text), "|").alias("answers"))


# --- records


@query
def check_issues(s, d):
    """Records that fail the check, the number of issues and the first four.

    A record with a secondary question has eight turns, any other six. A dialogue of another length has that issue only.
    """
    n = F.when(F.coalesce("core_question", F.lit("")).contains("(secondary:"), 8).otherwise(6)
    c = one_conv(s, d, "core_question", "expected_answers", "messages").select("id", validate.dialogue_issues(F.col("messages"), F.col("expected_answers"), n).alias("i"))
    b = blueprint_of(s, d, "core_question", "expected_answers", "turns").select("id", validate.turn_list_issues(F.col("turns"), F.col("expected_answers"), n).alias("i"))
    bad = c.unionByName(b).filter(F.size("i") > 0)
    return bad.select("id", F.size("i").alias("n_issues"), F.concat(F.lit("structural: "), F.array_join(F.slice("i", 1, 4), " | ")).alias("reason"))


@query
def sft_rows(s, d):
    """Kept conversations as id, category, topic and messages (as JSON)."""
    c = one_conv(s, d, "topic", "messages", "status").filter("status = 'ok'")
    return c.select("id", category_of(F.col("id")).alias("category"), "topic", F.to_json("messages", {"ignoreNullFields": "false"}).alias("messages"))


@query
def eval_rows(s, d):
    """Blueprints without split and persona, arrays as JSON."""
    b = blueprint_of(s, d, "topic", "core_question", "answer_summary", "expected_answers", "turns")
    return b.select("id", category_of(F.col("id")).alias("category"), "topic", "core_question", "answer_summary",
                    F.to_json("expected_answers").alias("expected_answers"), F.to_json("turns").alias("turns"))


@query
def conversation_prefixes(s, d):
    """For each user message everything said up to it, as text with role markers, by hash and length."""
    c = one_conv(s, d, "messages").select("id", "messages", F.posexplode("messages").alias("pos", "m")).filter("m.role = 'user'")
    text = jt.chat_text(F.slice("messages", F.lit(1), F.col("pos") + 1))
    return c.select("id", "pos", text.alias("t")).select("id", "pos", F.md5("t").alias("prefix_md5"), F.length("t").alias("n_chars"))


@query
def avoid_topics(s, d):
    """For each record the last sixty of the eighty topics before it in its category, by number and hash."""
    c = one_conv(s, d, "topic").select("id", category_of(F.col("id")).alias("category"), F.coalesce(F.nullif("topic", F.lit("")), "id").alias("topic"))
    p = assemble.preceding_list(assemble.shuffled(c, ["category"], "id", "42"), "category", "topic", 80, 60)
    return p.select("id", F.size("before").alias("n"), F.md5(F.array_join("before", "|")).alias("topics_md5"))


@query
def first_turns_kept(s, d):
    """Blueprints that stay when of those with the same normalised first turn only the first by id does."""
    b = blueprint_of(s, d, "turns").select("id", jt.sha_prefix(jt.norm(F.get("turns", F.lit(0))), 12).alias("sha")).filter("sha is not null")
    return assemble.first_wins(b, "sha", "id").select("id", "sha")


@query
def total_turns(s, d):
    """Blueprints and turns by category."""
    n = F.coalesce(F.size(F.coalesce("turns", F.array().cast("array<string>"))), F.lit(0))
    return blueprint_of(s, d, "turns").groupBy(category_of(F.col("id")).alias("category")).agg(F.count("*").alias("n_scenarios"), F.sum(n).alias("n_turns"))


@query
def shaped_topics(s, d):
    """records with topic and core question, and without, by split."""
    c = one_conv(s, d, "topic", "core_question")
    ok = F.col("topic").isNotNull() & F.col("core_question").isNotNull()
    return c.groupBy(split_of(F.col("id")).alias("split")).agg(F.count_if(ok).alias("n_shaped"), F.count_if(~ok).alias("n_others"))


@query
def numbered_models(s, d):
    """names that end with a hyphen and a number, and those that do not."""
    m = table(s, d, "verdicts").select("model_slug").filter("model_slug is not null").distinct()
    return m.select("model_slug", F.col("model_slug").rlike("-[0-9]+$").alias("numbered"))


# --- jobs


def jobs_of(s: SparkSession, d: str) -> DataFrame:
    """Jobs from the topic pools of each split and category: numbered along a permutation, up to the wanted number.

    In categories that shift, every second job by hash also takes an earlier topic of its pool. Columns: id, split,
    category, core_question, answer_summary, expected (joined), persona, n_turns, pressure_style.
    """
    cols = ["core_question", "answer_summary", "expected_answers"]
    r = one_conv(s, d, *cols).unionByName(blueprint_of(s, d, *cols))
    r = r.withColumns({"split": split_of(F.col("id")), "category": category_of(F.col("id"))})
    p = assemble.shuffled(r, ["split", "category"], "id", "43")
    # A row a split and category.
    want = F.broadcast(assemble.targets(s, SIZES, {"train": 1.15, "test": 1.15, "eval_dev": 1.05, "eval_final": 1.05}, 0))
    p = p.join(want, ["split", "category"]).filter("rn <= target")
    h = F.conv(F.substring(F.md5("id"), 1, 6), 16, 10).cast("bigint")
    p = p.withColumn("h", h).withColumn("partner", F.when(F.col("category").isin(*SHIFTING) & (h % 2 == 0) & (F.col("rn") > 1), 1 + F.floor(h / 2) % (F.col("rn") - 1)))
    q = p.select("split", "category", F.col("rn").alias("partner"), *[F.col(c).alias(f"second_{c}") for c in cols], F.lit(True).alias("shift"))
    j = p.join(q, ["split", "category", "partner"], "left")
    text = lambda c: F.coalesce(c, F.lit(""))
    none = F.array().cast("array<string>")
    pick = lambda names, x: F.element_at(F.array(*[F.lit(n) for n in names]), (x % len(names) + 1).cast("int"))
    both = F.trim(F.concat(text("answer_summary"), F.lit("; after the topic shift: "), text("second_answer_summary")), F.lit("; "))
    style = F.create_map(*[F.lit(x) for kv in PRESSURE.items() for x in kv])
    return j.select(
        F.format_string("%s_%s_%05d", "split", "category", F.col("rn") - 1).alias("id"), "split", "category",
        F.concat(text("core_question"), F.when(F.col("shift"), F.concat(F.lit(" (secondary: "), text("second_core_question"), F.lit(")"))).otherwise("")).alias("core_question"),
        F.nullif(F.when(F.col("shift"), both).otherwise(F.col("answer_summary")), F.lit("")).alias("answer_summary"),
        F.array_join(F.concat(F.coalesce("expected_answers", none), F.coalesce("second_expected_answers", none)), "|").alias("expected"),
        F.concat_ws("; ", pick(MOODS, F.col("h")), pick(CONTEXTS, F.floor(F.col("h") / 8))).alias("persona"),
        F.when(F.col("shift"), 8).otherwise(6).alias("n_turns"), F.coalesce(F.try_element_at(style, F.col("category")), F.lit("none")).alias("pressure_style"),
    )


@query
def manifest_jobs(s, d):
    """The manifest built from the topic pools."""
    return jobs_of(s, d)


@query
def extended_manifest(s, d):
    """Base ids, and forty new ones a category from the test topics, behind its last id of the range from 90000."""
    base = conv_ids(s, d)
    inside = F.col("idx").cast("string").startswith("9") & (F.col("split") == "train") & (F.length("id") > 0)
    at = base.groupBy("category").agg(F.max(F.when(inside, F.col("idx") + 1)).alias("next")).select("category", F.greatest(F.coalesce("next", F.lit(90000)), F.lit(90000)).alias("first"))
    pool = assemble.shuffled(base.filter("split = 'test'").select("id", "category"), ["category"], "id", "777").filter("rn <= 40")
    # A row a category.
    new = pool.join(F.broadcast(at), "category").select(F.format_string("train_%s_%05d", "category", F.col("first") + F.col("rn") - 1).alias("id"), "category", F.lit("extension").alias("part"))
    new = new.join(base.select("id"), "id", "left_anti")
    return base.select("id", "category", F.lit("base").alias("part")).unionByName(new)


@query
def pending_by_split(s, d):
    """Jobs without accepted record or tombstone; what counts as accepted depends on the job's split."""
    ids = lambda n: table(s, d, n).select("id").filter("id is not null")
    jobs = ids("tickets").unionAll(ids("blueprints")).unionAll(ids("tombstones")).unionAll(jobs_of(s, d).select("id")).distinct()
    jobs = jobs.withColumn("held_out", split_of(F.col("id")).isin("eval_dev", "eval_final"))
    done = ids("blueprints").withColumn("held_out", F.lit(True)).unionByName(table(s, d, "convs").filter("status = 'ok'").select("id", F.lit(False).alias("held_out")))
    left = jobs.join(done, ["id", "held_out"], "left_anti").join(ids("tombstones"), "id", "left_anti")
    return left.select("id", split_of(F.col("id")).alias("split"))


@query
def status_counts(s, d):
    """Records in each state."""
    n = lambda df, name: df.agg(F.countDistinct("id").alias("n")).select(F.lit(name).alias("state"), "n")
    out = n(table(s, d, "convs").filter("status = 'ok'"), "accepted")
    for df, name in ((table(s, d, "tickets"), "ticketed"), (table(s, d, "tombstones"), "dropped"), (table(s, d, "blueprints"), "held out")):
        out = out.unionByName(n(df, name))
    return out.unionByName(n(pending_by_split(s, d), "pending"))


@query
def training_steps(s, d):
    """Steps for three epochs in batches of sixteen, and how often to save and warm up, by size of the split."""
    n = conv_ids(s, d).groupBy("split").agg(F.count("*").alias("n"))
    steps = F.greatest(F.lit(1), F.bround(F.ceil(F.col("n") / 16) * F.lit(3.0), 0).cast("bigint"))
    out = n.withColumn("steps", steps)
    return out.select("split", "n", "steps", F.greatest(F.lit(3), F.floor(F.col("steps") / 5)).alias("cadence"), F.greatest(F.lit(2), F.bround(F.col("steps") * F.lit(0.03), 0).cast("bigint")).alias("warmup"))


@query
def rungs_with_size(s, d):
    """The nested rungs with a size of its own, 300, appended to the ladder."""
    pool = assemble.shuffled(conv_ids(s, d).filter("split = 'train'").select("id", "category"), ["category"], "id", "44")
    return assemble.ladder(pool, assemble.with_size(300, (10, 20, 40))).groupBy("rung").agg(F.count("*").alias("n"))


@query
def strategy_messages(s, d):
    """Each scenario's turns behind the messages of each strategy, by hash."""
    sc = table(s, d, "scenarios").select("id", F.coalesce("turns", F.array().cast("array<string>")).alias("turns"))
    say = lambda r, t: F.struct(r.alias("role"), t.alias("content"))
    own = F.transform("turns", lambda t: say(F.lit("user"), t))
    lead = [F.struct(F.lit(k).alias("strategy"), F.array(*[say(F.lit(r), F.lit(t)) for r, t in v]).alias("lead")) for k, v in STRATEGIES.items()]
    x = sc.select("id", own.alias("own"), F.inline(F.array(*[F.struct(y["strategy"], y["lead"]) for y in lead])))
    return x.select("id", "strategy", F.md5(jt.chat_text(F.concat("lead", "own"))).alias("messages_md5"))


def _fill(template: str, **parts: Column) -> Column:
    """The template with its {fields}; text put in is not looked at again."""
    import re

    out = [parts[x[1:-1]] if re.fullmatch(r"\{\w+\}", x) else F.lit(x) for x in re.split(r"(\{\w+\})", template) if x]
    return F.concat(*out)


@query
def judge_prompts(s, d):
    """The prompt for each judged reply, closing tags in the reply taken out, by hash."""
    m = salted_join(metrics.latest(table(s, d, "verdicts")), scenario_fields(s, d), "scenario_id")
    safe = F.replace(F.coalesce("reply", F.lit("")), F.lit("</reply>"), F.lit("<closing-tag-removed>"))
    text = _fill(PROMPT, question=F.coalesce("core_question", F.lit("")), answer=jt.answer_text(F.col("answer_summary"), F.col("expected_answers")), reply=safe)
    return m.groupBy(F.md5(text).alias("prompt_md5")).agg(F.count("*").alias("n"))


@query
def topic_fold(s, d):
    """Records that an ordered pass accepts, which drops a record whose topic or answer an accepted one before it has.

    In the order of ids, within a category. No SQL: the outcome depends on what was accepted before; tested by a loop.
    """
    c = one_conv(s, d, "topic", "core_question", "answer_summary").filter("topic is not null and core_question is not null")
    keys = F.array_compact(F.array(jt.norm(F.col("topic")), F.nullif(jt.norm(F.coalesce("answer_summary", F.lit(""))), F.lit(""))))
    cat = category_of(F.col("id"))
    k = c.select("id", F.explode(keys).alias("key"), cat.alias("category"))
    return assemble.ordered_fold(k.select("id", F.concat_ws(":", "category", "key").alias("key"))).select("id")
