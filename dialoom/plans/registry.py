"""Queries by name; each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from dialoom.functions import judge_text as jt
from dialoom.operators import assemble, judge, metrics, validate
from dialoom.operators.scale import salted_join
from dialoom.sources.readers import checkpoints, last_wins, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ID = r"^(.+)_([a-z]+)_(\d{5,})$"
#: Records wanted of each split.
SIZES = {"train": 2000, "test": 100, "eval_dev": 120, "eval_final": 80}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def split_of(c):
    return F.regexp_extract(c, ID, 1)


def category_of(c):
    return F.regexp_extract(c, ID, 2)


def index_of(c):
    return F.regexp_extract(c, ID, 3).cast("bigint")


def verdict_rows(s: SparkSession, d: str) -> DataFrame:
    return metrics.latest(table(s, d, "verdicts")).withColumn("category", metrics.clean_category(F.col("category")))


def conv_ids(s: SparkSession, d: str) -> DataFrame:
    ids = table(s, d, "convs").select("id").distinct()
    return ids.withColumns({"split": split_of(F.col("id")), "category": category_of(F.col("id")), "idx": index_of(F.col("id"))})


def one_conv(s: SparkSession, d: str, *cols: str) -> DataFrame:
    """One row an id, with the given columns; rows of one id are one record."""
    return assemble.first_wins(table(s, d, "convs").select("id", F.col("landed_at").alias("__at"), *cols), "id", "__at").drop("__at")


def turns(s: SparkSession, d: str, **derived: Column) -> DataFrame:
    """(id, pos, role, and what is derived from content) of each message; messages delivered again count once.

    They are told apart by a hash of the text, so that texts need not be shuffled.
    """
    c = table(s, d, "convs").select("id", F.posexplode("messages").alias("pos", "m"))
    c = c.select("id", "pos", F.col("m.role").alias("role"), F.coalesce("m.content", F.lit("")).alias("content"))
    return c.select("id", "pos", "role", F.xxhash64("content").alias("__h"), *[v.alias(k) for k, v in derived.items()]).distinct().drop("__h")


# --- metrics


@query
def summary_by_model_category(s, d):
    """Adherence and failure split by model, by category and overall, in one pass."""
    return metrics.adherence(verdict_rows(s, d), [["model_slug", "category"], ["model_slug"], ["category"], []])


@query
def robustness_by_model(s, d):
    """Share of fully judged scenarios without a failing reply."""
    return metrics.robustness(verdict_rows(s, d), ["model_slug"])


@query
def failure_pivot(s, d):
    """Failing share by model and category, as columns."""
    return metrics.failure_pivot(verdict_rows(s, d), "model_slug")


@query
def mean_and_count(s, d):
    """Mean of verdicts as numbers, nulls left out, with counts."""
    v = verdict_rows(s, d)
    return v.groupBy("model_slug").agg(
        F.avg(F.col("passed").cast("double")).alias("mean_passed"), F.count("passed").alias("n_passed_known"), F.count_if("judge_error").alias("n_judge_error")
    )


@query
def per_turn_failure(s, d):
    """Failing share by turn."""
    v = verdict_rows(s, d).filter("passed is not null")
    return v.groupBy("turn").agg(F.count("*").alias("n"), F.count_if(~F.col("passed")).alias("n_failed"), (F.count_if(~F.col("passed")) / F.count("*")).alias("failed_share"))


@query
def bad_turn_histogram(s, d):
    """Scenarios by their number of failing replies."""
    return metrics.scenario_outcomes(verdict_rows(s, d), ["model_slug"]).groupBy("n_failed").agg(F.count("*").alias("n_scenarios"))


@query
def failure_reasons(s, d):
    """Failing replies by reason, the violations or the leak's reason, cut to 200 characters."""
    v = table(s, d, "verdicts").filter(~F.col("passed"))
    reason = F.when(~F.col("syntax_pass"), F.left(F.array_join("syntax_violations", "; "), F.lit(200))).otherwise(F.left("leak_reason", F.lit(200)))
    return v.groupBy(F.when(~F.col("syntax_pass"), "syntax").otherwise("leak").alias("kind"), reason.alias("reason")).agg(F.count("*").alias("n"))


@query
def running_best_regression(s, d):
    """Clean share by day of judgement against the best day before."""
    v = verdict_rows(s, d).filter("passed is not null and judged_at is not null")
    day = F.date_format("judged_at", "yyyy-MM-dd").alias("day")
    daily = v.groupBy(day).agg((F.count_if("passed") / F.count("*")).alias("clean_share"))
    return metrics.running_best(daily, "day", "clean_share", 0.2)


@query
def latest_verdicts(s, d):
    """S3: last delivery of each key wins."""
    return metrics.latest(table(s, d, "verdicts")).select("model_slug", "scenario_id", "turn", "passed", "judge_error", "leak_reason")


@query
def model_grid_missing(s, d):
    """Models x scenarios, and how many scenarios of each model have no verdict."""
    v = table(s, d, "verdicts").select("model_slug", "scenario_id").distinct()
    # Both sides of the grid are dimension tables: scenarios does not grow, models are few.
    models = v.select("model_slug").filter("model_slug is not null").distinct()
    grid = models.crossJoin(F.broadcast(table(s, d, "scenarios").select(F.col("id").alias("scenario_id"))))
    j = grid.join(v.withColumn("seen", F.lit(True)), ["model_slug", "scenario_id"], "left")
    return j.groupBy("model_slug").agg(F.count("*").alias("n_scenarios"), F.count_if(F.col("seen").isNull()).alias("n_missing"))


@query
def verdicts_with_blueprint(s, d):
    """Replies joined to the scenario they answer, counted by its split and category."""
    v = table(s, d, "verdicts").select("scenario_id", "turn", "passed")
    ids = table(s, d, "blueprints").select("id").unionAll(table(s, d, "scenarios").select("id")).distinct()
    dims = ids.select(F.col("id").alias("scenario_id"), split_of(F.col("id")).alias("split"), category_of(F.col("id")).alias("category"))
    j = salted_join(v, dims, "scenario_id")
    return j.groupBy("split", "category").agg(F.count("*").alias("n_replies"), F.countDistinct("scenario_id").alias("n_scenarios"), F.count_if("passed").alias("n_passed"))


@query
def unknown_scenarios(s, d):
    """Verdicts whose scenario is nowhere."""
    v = table(s, d, "verdicts").groupBy("scenario_id").agg(F.count("*").alias("n"))
    ids = table(s, d, "blueprints").select("id").unionAll(table(s, d, "scenarios").select("id")).select(F.col("id").alias("scenario_id")).distinct()
    return v.join(ids, "scenario_id", "left_anti")


@query
def reply_size_by_model(s, d):
    """Replies by model, their characters and tokens of a byte-level tokenizer (bytes)."""
    v = table(s, d, "verdicts")
    return v.groupBy("model_slug").agg(
        F.count("*").alias("n_replies"), F.sum(F.length("reply")).alias("n_chars"), F.sum(F.octet_length("reply")).alias("n_bytes")
    )


# --- dialogues


@query
def turn_facts(s, d):
    """Assistant turns with their number."""
    t = turns(s, d, n_chars=F.length("content")).filter("role = 'assistant'")
    return t.select("id", "pos", (F.floor(F.col("pos") / 2) + 1).alias("turn"), "n_chars")


@query
def history_prefix(s, d):
    """What was said before each turn, as counts and a hash of the last two messages."""
    w = W.partitionBy("id").orderBy("pos", "role", "content")
    t = turns(s, d, content=F.col("content"))
    before = w.rowsBetween(W.unboundedPreceding, -1)
    return t.select(
        "id", "pos", F.coalesce(F.sum(F.length("content")).over(before), F.lit(0)).alias("chars_before"), F.count("*").over(before).alias("messages_before"),
        F.md5(F.concat(F.coalesce(F.lag("content", 2).over(w), F.lit("")), F.lit("|"), F.coalesce(F.lag("content", 1).over(w), F.lit("")))).alias("context_md5"),
    )


@query
def structural_issues(s, d):
    """Conversations by structural issue."""
    c = one_conv(s, d, "messages").select(F.explode(validate.conversation_issues(F.col("messages"))).alias("issue"))
    return c.groupBy("issue").agg(F.count("*").alias("n_convs"))


@query
def message_counts(s, d):
    """Conversations by number of messages."""
    n = F.when(F.col("messages").isNull(), 0).otherwise(F.size("messages"))
    return one_conv(s, d, "messages").groupBy(n.alias("n_messages")).agg(F.count("*").alias("n_convs"))


@query
def scenario_lint(s, d):
    """Blueprints and the issues they have."""
    b = table(s, d, "blueprints").select("id", "topic", "core_question", "category", "turns", "expected_answers").distinct()
    issues = validate.scenario_issues(F.col("turns"), F.col("expected_answers"), [F.col("topic"), F.col("core_question"), F.col("category")], 6, 8)
    return b.select("id", F.explode(issues).alias("issue")).distinct()


@query
def chat_text_hash(s, d):
    """Rendered dialogues by hash."""
    return one_conv(s, d, "messages").select("id", jt.sha_prefix(jt.chat_text(F.coalesce("messages", F.array())), 16).alias("sha"))


@query
def sft_projection(s, d):
    """kept conversations as id, category and size; dropped ones are left out."""
    c = one_conv(s, d, "messages", "status").filter("status = 'ok'")
    return c.select("id", category_of(F.col("id")).alias("category"), F.coalesce(F.size(F.coalesce("messages", F.array())), F.lit(0)).alias("n_messages"))


@query
def merged_answers(s, d):
    """Expected answers and persona parts in one array, duplicates kept."""
    c = one_conv(s, d, "expected_answers", "persona")
    arr = F.concat(F.coalesce("expected_answers", F.array()), F.coalesce(F.split("persona", "; "), F.array()))
    return c.select("id", F.array_join(arr, "|").alias("merged"), F.size(arr).alias("n"))


@query
def shift_summary(s, d):
    """Answer summary and reason joined, without separators at its ends, null when empty."""
    c = one_conv(s, d, "answer_summary", "drop_reason")
    text = F.concat(F.coalesce("answer_summary", F.lit("")), F.lit("; after the topic shift: "), F.coalesce("drop_reason", F.lit("")))
    return c.select("id", F.nullif(F.trim(text, F.lit("; ")), F.lit("")).alias("summary"))


@query
def first_turn_dedup(s, d):
    """Blueprints whose normalised first turn came before under another id."""
    b = table(s, d, "blueprints").select("id", jt.norm(F.get("turns", F.lit(0))).alias("t")).filter("t is not null").distinct()
    b = b.select("id", jt.sha_prefix(F.col("t"), 16).alias("sha"))
    first = b.groupBy("sha").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))
    return first.filter("n > 1")


@query
def leak_hits(s, d):
    """Assistant messages in which an expected answer of their conversation stands, and the first that does."""
    c = one_conv(s, d, "expected_answers", "messages")
    m = c.select("id", "expected_answers", F.posexplode("messages").alias("pos", "m")).filter("m.role = 'assistant'")
    hit = jt.string_hit(F.col("m.content"), F.col("expected_answers"))
    return m.select("id", "pos", hit.alias("hit")).filter("hit is not null")


@query
def weak_variants(s, d):
    """Expected answers too short or numeric to prove a leak."""
    a = table(s, d, "convs").select(F.explode("expected_answers").alias("answer")).filter("answer is not null")
    return a.groupBy("answer").agg(F.count("*").alias("n")).withColumn("weak", jt.weak(F.col("answer")))


@query
def terminator_rule(s, d):
    """Assistant messages by how they keep the rule that everything said ends as a question."""
    v = turns(s, d, n=F.size(jt.violations(F.col("content")))).filter("role = 'assistant'")
    return v.groupBy(category_of(F.col("id")).alias("category")).agg(
        F.count("*").alias("n_messages"), F.count_if(F.col("n") == 0).alias("n_pass"), F.sum("n").alias("n_violations")
    )


@query
def masked_segments(s, d):
    """Segments of the verdicts' replies by closing terminator."""
    r = table(s, d, "verdicts").select(F.explode(jt.segments(F.coalesce("reply", F.lit("")))).alias("s"))
    return r.groupBy(F.col("s.term").alias("term")).agg(F.count("*").alias("n"), F.sum(F.length("s.seg")).alias("n_chars"))


@query
def judged_replies(s, d):
    """Rule 1 and 2: the judge over all assistant messages, with the verdict table's answers by reply."""
    c = one_conv(s, d, "expected_answers", "answer_summary", "messages")
    m = c.select("id", "expected_answers", "answer_summary", F.explode("messages").alias("m")).filter("m.role = 'assistant'")
    m = m.withColumn("reply", F.coalesce("m.content", F.lit(""))).withColumn("verdict_key", F.sha2("reply", 256)).drop("m")
    known = table(s, d, "verdicts").filter("leak_pass is not null and reply is not null").groupBy(F.sha2("reply", 256).alias("verdict_key"))
    cache = known.agg((~F.bool_and("leak_pass")).alias("leak"))
    j = judge.judged(m, cache)
    return j.groupBy(category_of(F.col("id")).alias("category")).agg(
        F.count("*").alias("n"), F.count_if("passed").alias("n_passed"), F.count_if(~F.col("syntax_pass")).alias("n_syntax"),
        F.count_if(F.col("hit").isNotNull()).alias("n_hits"), F.count_if("judge_error").alias("n_errors"),
    )


@query
def parsed_verdicts(s, d):
    """Verdict texts of several shapes read back."""
    leak = F.when(F.col("leak_pass").isNull(), "null").when(F.col("leak_pass"), "false").otherwise('"TRUE"')
    text = F.concat(F.when(F.col("turn") % 2 == 0, "```json\n").otherwise("Sure: "), F.lit('{"leak": '), leak, F.lit("}"), F.when(F.col("turn") % 2 == 0, "\n```").otherwise(" ok"))
    v = table(s, d, "verdicts").filter("turn is not null").select(F.col("leak_pass"), jt.parsed_verdict(text).alias("leak"))
    return v.groupBy("leak_pass", "leak").agg(F.count("*").alias("n"))


# --- sets, joins and counts


@query
def category_counts(s, d):
    """Records by split and category."""
    return conv_ids(s, d).groupBy("split", "category").agg(F.count("*").alias("n"))


@query
def shortage(s, d):
    """Cells with fewer ids than their minimum."""
    have = conv_ids(s, d).groupBy("split", "category").agg(F.count("*").alias("have"))
    t = table(s, d, "category_targets").join(have, ["split", "category"], "left").withColumn("have", F.coalesce("have", F.lit(0).cast("bigint")))
    return t.filter("have < min_rows").select("split", "category", "min_rows", "have", (F.col("min_rows") - F.col("have")).alias("short"))


@query
def regens_and_drops(s, d):
    """Regenerations and dropped records by status."""
    c = one_conv(s, d, "regens", "status", "drop_reason")
    return c.groupBy("status").agg(F.count("*").alias("n"), F.sum(F.coalesce("regens", F.lit(0))).alias("regens"), F.count("drop_reason").alias("n_reasons"))


@query
def duplicate_ids_ci(s, d):
    """A10: ids delivered more than once, in any case."""
    c = table(s, d, "convs").groupBy(F.lower("id").alias("id")).agg(F.count("*").alias("n"))
    return c.filter("n > 1")


@query
def tickets_latest(s, d):
    """The ticket with the most attempts of each id, with the state of its conversation."""
    t = table(s, d, "tickets").filter("id is not null")
    best = t.groupBy("id").agg(F.max(F.coalesce("attempts", F.lit(0))).alias("attempts"), F.countDistinct("raw_sha").alias("n_versions"))
    return best.join(conv_ids(s, d).select("id", F.lit(True).alias("k")), "id", "left").select("id", "attempts", "n_versions", F.coalesce("k", F.lit(False)).alias("known"))


@query
def ticket_reasons(s, d):
    """Ticket reasons by turn; empty and null reasons are one."""
    t = table(s, d, "tickets").select("id", F.explode("failed_turns").alias("f"))
    reason = F.coalesce(F.nullif(F.trim("f.reason"), F.lit("")), F.lit("none"))
    return t.groupBy(F.col("f.turn").alias("turn"), reason.alias("reason")).agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_ids"))


@query
def pending_ids(s, d):
    """Ticketed ids that are neither accepted nor dropped for good."""
    done = table(s, d, "convs").filter("status = 'ok'").select("id").unionByName(table(s, d, "tombstones").select("id")).distinct()
    return table(s, d, "tickets").select("id").distinct().join(done, "id", "left_anti")


@query
def ticketed_convs(s, d):
    """Conversations with a ticket."""
    return conv_ids(s, d).join(table(s, d, "tickets").select("id"), "id", "left_semi").groupBy("category").agg(F.count("*").alias("n"))


@query
def source_counts(s, d):
    """Rows and ids of each source."""
    one = lambda n: table(s, d, n).agg(F.count("*").alias("n_rows"), F.countDistinct("id").alias("n_ids")).select(F.lit(n).alias("source"), "n_rows", "n_ids")
    return one("convs").unionByName(one("blueprints")).unionByName(one("tickets")).unionByName(one("tombstones")).unionByName(one("scenarios"))


@query
def topic_overlap(s, d):
    """Topics, normalised, that stand in more than one split."""
    t = table(s, d, "convs").select("id", "topic").unionAll(table(s, d, "blueprints").select("id", "topic"))
    t = t.select(split_of(F.col("id")).alias("split"), jt.norm(F.col("topic")).alias("topic")).filter("topic <> ''")
    return t.groupBy("topic").agg(F.countDistinct("split").alias("n_splits"), F.count("*").alias("n")).filter("n_splits > 1")


@query
def mix_difference(s, d):
    """Categories in the fields but not in the ids, and the other way round."""
    c = table(s, d, "convs")
    field, own = c.select(metrics.clean_category(F.col("category")).alias("category")), c.select(category_of(F.col("id")).alias("category"))
    a = field.filter("category <> ''").distinct().exceptAll(own.distinct()).withColumn("side", F.lit("field"))
    return a.unionByName(own.distinct().exceptAll(field.filter("category <> ''").distinct()).withColumn("side", F.lit("id")))


@query
def id_grammar(s, d):
    """Parts of the ids, put together again."""
    i = conv_ids(s, d)
    again = F.format_string("%s_%s_%05d", "split", "category", "idx")
    return i.groupBy("split", "category").agg(F.count_if(again == F.col("id")).alias("n_same"), F.max("idx").alias("max_idx"), F.min(F.length("id")).alias("min_length"))


@query
def distinct_categories(s, d):
    """O3: categories in order."""
    return conv_ids(s, d).select("category").distinct().orderBy("category")


# --- assembly


@query
def topic_targets(s, d):
    """Topics wanted for each split and category."""
    return assemble.targets(s, SIZES, {"train": 1.30, "test": 1.30, "eval_dev": 1.15, "eval_final": 1.15}, 2)


@query
def blueprint_targets(s, d):
    """Records wanted for each split and category."""
    return assemble.targets(s, SIZES, {"train": 1.15, "test": 1.15, "eval_dev": 1.05, "eval_final": 1.05}, 0)


@query
def shuffled_order(s, d):
    """Rank of each conversation in its category along a seeded permutation."""
    return assemble.shuffled(conv_ids(s, d).select("id", "category"), ["category"], "id", "42")


@query
def split_assignment(s, d):
    """Consecutive ranges of the permutation, given to the splits by their topic targets; a pool may be short."""
    pool = assemble.shuffled(conv_ids(s, d).select("id", "category"), ["category"], "id", "43")
    return assemble.range_allocation(pool, topic_targets(s, d), ["eval_final", "eval_dev", "test", "train"]).select("id", "category", "split")


@query
def ladder_rungs(s, d):
    """Rows of each nested rung that every category can fill."""
    pool = assemble.shuffled(conv_ids(s, d).filter("split = 'train'").select("id", "category"), ["category"], "id", "44")
    return assemble.ladder(pool, (10, 20, 40, *assemble.LADDER)).groupBy("rung", "category").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query
def extension_ids(s, d):
    """First free index of each category, in the range for extensions."""
    i = conv_ids(s, d).filter("split = 'train'").groupBy("category").agg(F.greatest(F.lit(90000), F.max("idx") + 1).alias("first_free"))
    return i.select("category", "first_free", F.format_string("train_%s_%05d", "category", "first_free").alias("first_id"))


@query
def shift_partner(s, d):
    """An earlier record of the same category for every second record, by hash."""
    p = assemble.shuffled(conv_ids(s, d).select("id", "category"), ["category"], "id", "777")
    h = F.conv(F.substring(F.md5("id"), 1, 6), 16, 10).cast("bigint")
    p = p.withColumn("partner_rn", F.when((h % 2 == 0) & (F.col("rn") > 1), 1 + F.floor(h / 2) % (F.col("rn") - 1)))
    q = p.select(F.col("id").alias("partner_id"), "category", F.col("rn").alias("partner_rn"))
    return p.join(q, ["category", "partner_rn"]).select("id", "partner_id")


@query
def round_robin(s, d):
    """Personas dealt to records in turn."""
    p = assemble.shuffled(conv_ids(s, d).select("id", "category"), ["category"], "id", "42")
    return p.groupBy("category", F.pmod(F.col("rn") - 1, F.lit(8)).alias("slot")).agg(F.count("*").alias("n"))


@query
def avoid_list(s, d):
    """The largest index among the last eighty records before each in its category, and their number."""
    p = assemble.shuffled(conv_ids(s, d).select("id", "category", "idx"), ["category"], "id", "42")
    return assemble.preceding(p, "category", 80).select("id", "max_before", "n_before")


@query
def batch_sizes(s, d):
    """Records in batches of eight, by batch size."""
    b = assemble.batches(conv_ids(s, d).select("id"), "id", 8)
    return b.groupBy("batch").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n_batches"))


@query
def ordered_limit(s, d):
    """The first hundred ids in order."""
    return conv_ids(s, d).select("id").orderBy("id").limit(100)


@query
def checkpoint_order(s, d):
    """Model names in the order of their trailing number, as rank."""
    names = table(s, d, "verdicts").select(F.col("model_slug").alias("name")).filter("name is not null").distinct()
    return checkpoints(names).select("name", "step")


@query
def events_last_by_user(s, d):
    """S3: the last event of each user."""
    e = table(s, d, "events").filter("user_id is not null").select("user_id", "event_id", "event_type")
    return last_wins(e, "user_id", "event_id")


@query
def quality_by_source(s, d):
    """Documents by source as written, with size figures."""
    doc = table(s, d, "documents")
    return doc.groupBy("source").agg(F.count("*").alias("n"), F.count("text").alias("n_text"), F.sum(F.length("text")).alias("n_chars"), F.max(F.length("text")).alias("longest"))


@query
def stale_sizes(s, d):
    """Documents whose stored size is not that of the text."""
    doc = table(s, d, "documents")
    return doc.filter("n_chars <> length(text)").select("doc_id", "n_chars", F.length("text").alias("real_chars"))


@query
def revenue_by_nation(s, d):
    """Joins over the star schema: revenue of each customer nation."""
    li = table(s, d, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    c = table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    n = table(s, d, "nation").select("n_nationkey", "n_name")
    return li.join(o, "l_orderkey").join(c, "o_custkey").join(n, "n_nationkey").groupBy("n_name").agg(F.round(F.sum("r"), 0).alias("revenue"), F.count("*").alias("n"))


from dialoom.plans import dialogues  # noqa: E402, F401  adds its queries to QUERIES
