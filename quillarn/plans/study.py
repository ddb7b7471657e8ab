"""Queries over policies, resampling, retrieval for training, normalised sources, checks and timing."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillarn.functions import arrays as A
from quillarn.functions import text as X
from quillarn.operators import bm25, bootstrap, checks, normalise, policy, prompts, scoring, sequence, timing
from quillarn.plans import corpus, qa
from quillarn.plans.corpus import FEATURES, INDEX, TERMS
from quillarn.plans.qa import SCORED, sql_keys, sql_squeeze
from quillarn.plans.roster import query
from quillarn.sources import sinks
from quillarn.sources.tables import table

DATASETS = ["hotpotqa", "nq", "popqa", "triviaqa", "webq"]

# Policies ---------------------------------------------------------------------------------------------------------------

POLICIES = {
    "fixed_res": ("control", {"kind": "constant", "value": 1}),
    "base": ("control", {"kind": "constant", "value": 0}),
    "entropy-3.5": ("entropy", policy.threshold("entropy", 3.5)),
    "entropy-3.9": ("entropy", policy.threshold("entropy", 3.9)),
    "margin": ("margin", {"kind": "all", "rules": [policy.threshold("entropy", 3.5), policy.threshold("margin", 0.1, "le")]}),
    "guard": ("stop_guard", {"kind": "stop_guard", "threshold": 3.8, "otherwise": policy.threshold("pmax", 0.03)}),
    "place": ("position_entropy", {"kind": "position", "first": policy.threshold("entropy", 3.7), "later": policy.threshold("entropy", 3.9)}),
}
CHOICES = {
    "fixed_res": "TRUE", "base": "FALSE", "entropy-3.5": "entropy >= 3.5", "entropy-3.9": "entropy >= 3.9", "margin": "entropy >= 3.5 AND margin <= 0.1",
    "guard": "CASE WHEN vec_id % 3 = 0 AND vec_id % 2 = 0 THEN entropy >= 3.8 ELSE pmax >= 0.03 END", "place": "CASE WHEN vec_id % 4 = 1 THEN entropy >= 3.7 ELSE entropy >= 3.9 END",
}
ROWS = FEATURES + """, g AS (SELECT vec_id, 'd' || (vec_id % 5) AS dataset, CASE WHEN vec_id % 3 = 0 THEN 1.0::DOUBLE ELSE 0 END AS base_em, CASE WHEN vec_id % 7 < 3 THEN 1.0::DOUBLE ELSE 0 END AS res_em, b <> c AS differs, entropy, exp(list_max(p)) AS pmax, list_reverse_sort(x)[1] - list_reverse_sort(x)[2] AS margin FROM h)"""
BOARD = ROWS + ", w AS (" + " UNION ALL ".join(f"SELECT '{n}' AS name, dataset, base_em, res_em, differs, CASE WHEN differs THEN {c} ELSE TRUE END AS second FROM g" for n, c in CHOICES.items()) + "), board AS (SELECT name, dataset, count(*) AS n, round(avg(CASE WHEN second THEN res_em ELSE base_em END) * 100, 6) AS em, round(avg(CASE WHEN second THEN res_em ELSE base_em END) * 50, 6) AS f1, count_if(NOT second AND base_em > res_em)::BIGINT AS avoided_harm, count_if(NOT second AND base_em < res_em)::BIGINT AS lost_help, count_if(NOT second AND differs)::BIGINT AS gate_off FROM w GROUP BY ALL)"
LEADERS = BOARD + ", meta(name, family, complexity) AS (VALUES " + ", ".join(f"('{n}', '{f}', {policy.complexity(s)}::BIGINT)" for n, (f, s) in POLICIES.items()) + "), leaders AS (SELECT row_number() OVER (ORDER BY macro_em DESC, macro_f1 DESC, complexity, name)::INTEGER AS rank, * FROM (SELECT name, family, round(avg(em), 6) AS macro_em, round(avg(f1), 6) AS macro_f1, any_value(complexity) AS complexity FROM board JOIN meta USING (name) GROUP BY name, family))"


def decisions(spark: SparkSession, data: str) -> DataFrame:
    """Vectors as decisions: base logits and memory, with outcomes and a place in a text that follow from the id."""
    v = corpus.logits(spark, data)
    f = A.decision_features(F.col("x"), F.col("y"), 0.5)
    i = F.col("vec_id")
    return v.select(
        "vec_id", F.concat(F.lit("d"), (i % 5).cast("string")).alias("dataset"), (i % 3 == 0).cast("double").alias("base_em"), (i % 7 < 3).cast("double").alias("res_em"),
        ((i % 3 == 0).cast("double") / 2).alias("base_f1"), ((i % 7 < 3).cast("double") / 2).alias("res_f1"), *[c.alias(k) for k, c in f.items()], f["disagreement"].alias("differs"),
        (i % 4).alias("position"), (i % 2 == 0).cast("double").alias("base_stop"), (i % 3 == 0).cast("double").alias("prefix_nonempty"),
        *[F.lit(0.0).alias(k) for k in ("lambda", "first_entropy", "res_stop", "prefix_words", "prefix_chars", "prefix_numeric", "question_words")],
    )


def board(spark: SparkSession, data: str) -> DataFrame:
    return scoring.scoreboard(decisions(spark, data), {n: policy.one_shot(s, F.col("differs")) for n, (_, s) in POLICIES.items()})


@query(BOARD + " SELECT * FROM board")
def policy_scoreboard(spark: SparkSession, data: str) -> DataFrame:
    return board(spark, data)


def leaders(spark: SparkSession, data: str) -> DataFrame:
    meta = spark.createDataFrame([(n, f, policy.complexity(s)) for n, (f, s) in POLICIES.items()], "name string, family string, complexity bigint")
    return scoring.leaderboard(board(spark, data), meta)


@query(LEADERS + " SELECT * FROM leaders")
def leaderboard(spark: SparkSession, data: str) -> DataFrame:
    return leaders(spark, data)


@query(LEADERS + " SELECT family, arg_min(name, rank) AS name, min(rank) AS rank FROM leaders GROUP BY family")
def family_best(spark: SparkSession, data: str) -> DataFrame:
    return scoring.family_best(leaders(spark, data))


@query()
def policy_candidates(spark: SparkSession, data: str) -> DataFrame:
    """The rule policies of a search, with cuts at quantiles of the decisions' features."""
    fit = decisions(spark, data).where("differs")
    return spark.createDataFrame([(k, c["family"], policy.complexity(c["spec"])) for k, c in policy.candidates(fit).items()], "name string, family string, complexity bigint")


@query()
def logistic_fit(spark: SparkSession, data: str) -> DataFrame:
    """A logistic policy fitted on the decisions whose outcomes differ, each dataset of equal weight."""
    rows = decisions(spark, data).where("base_em <> res_em")
    sizes = rows.groupBy("dataset").agg((1 / F.count("*")).alias("weight"))
    m = policy.fit_logistic(rows.join(sizes, "dataset"), "basic", 0.1)
    return spark.createDataFrame([(i, round(c, 6), round(mu, 6), round(sd, 6)) for i, (c, mu, sd) in enumerate(zip(m["coef"], m["mean"], m["scale"]))], "feature int, coef double, mean double, scale double")


EVENTS = """WITH e AS (SELECT ordinal, 'd' || (ordinal % 5) AS dataset, (ordinal % 3 = 0)::INT AS em, (ordinal % 4 = 0)::INT AS base_em, (ordinal % 5 < 2)::INT AS res_em, unnest(output_ids) AS t, unnest(range(len(output_ids))) AS i FROM predictions WHERE method = 'resmem' AND output_ids IS NOT NULL),
v AS (SELECT *, t % 4 = 0 AS disagreement, t % 8 = 0 AS intervened, t % 24 = 0 AS third_token, t % 3 = 0 AS stop, (t % 100) / 25.0::DOUBLE AS entropy, (t % 10) / 10.0::DOUBLE AS weight FROM e),
r AS (SELECT ordinal, 'd' || (ordinal % 5) AS dataset, (ordinal % 3 = 0)::INT AS em, (ordinal % 4 = 0)::INT AS base_em, (ordinal % 5 < 2)::INT AS res_em FROM predictions WHERE method = 'resmem' AND output_ids IS NOT NULL)"""


def events(spark: SparkSession, data: str) -> DataFrame:
    """Answers with one event for each token, made from the ids."""
    p, o = table(spark, data, "predictions").where("method = 'resmem' and output_ids is not null"), F.col("ordinal")
    e = F.transform("output_ids", lambda t: F.struct((t % 4 == 0).alias("disagreement"), (t % 8 == 0).alias("intervened"), (t % 24 == 0).alias("third_token"), (t % 3 == 0).alias("stop"), ((t % 100) / F.lit(25.0)).alias("entropy"), ((t % 10) / F.lit(10.0)).alias("weight")))
    flag = lambda c: c.cast("int")
    return p.select("ordinal", F.concat(F.lit("d"), (o % 5).cast("string")).alias("dataset"), flag(o % 3 == 0).alias("em"), (flag(o % 3 == 0) / 2).alias("f1"), flag(o % 4 == 0).alias("base_em"), flag(o % 5 < 2).alias("res_em"), e.alias("gate_events"))


@query(EVENTS + """, x AS (SELECT dataset, count(*) AS active_steps, count_if(disagreement)::BIGINT AS disagreements, count_if(intervened)::BIGINT AS interventions, count_if(third_token)::BIGINT AS third_token_steps, count_if(intervened AND stop)::BIGINT AS stop_interventions FROM v GROUP BY dataset),
y AS (SELECT dataset, count(*) AS n, round(avg(em) * 100, 6) AS em, round(avg(em / 2) * 100, 6) AS f1, count_if(em > res_em)::BIGINT AS gains, count_if(em < res_em)::BIGINT AS losses, count_if(base_em = 1 AND em = 0)::BIGINT AS base_correct_now_wrong, count_if(base_em = 0 AND em = 1)::BIGINT AS base_wrong_now_correct FROM r GROUP BY dataset)
SELECT y.*, active_steps, disagreements, interventions, third_token_steps, stop_interventions, round(coalesce(interventions / nullif(disagreements, 0), 0), 6) AS acceptance_rate FROM y JOIN x USING (dataset)""")
def rollout_summary(spark: SparkSession, data: str) -> DataFrame:
    return scoring.rollout(events(spark, data))


@query(EVENTS + " SELECT count_if(base_em = 1 AND res_em = 0 AND em = 1)::BIGINT AS prevented_harm, count_if(base_em = 0 AND res_em = 1 AND em = 0)::BIGINT AS lost_corrections, count_if(base_em = 0 AND res_em = 0 AND em = 1)::BIGINT AS both_wrong_gate_correct, count_if(base_em = 1 AND res_em = 1 AND em = 0)::BIGINT AS both_correct_gate_wrong FROM r")
def mechanisms(spark: SparkSession, data: str) -> DataFrame:
    return scoring.mechanisms(events(spark, data))


@query(EVENTS + " SELECT count_if(intervened AND i = 0)::BIGINT AS first_token, count_if(intervened AND i > 0)::BIGINT AS later_token, count_if(disagreement AND NOT intervened)::BIGINT AS blocked, list_transform(quantile_cont(entropy, [0.1, 0.5, 0.9]) FILTER (intervened), lambda q: round(q, 6)) AS entropy_quantiles, list_transform(quantile_cont(weight, [0.1, 0.5, 0.9]) FILTER (intervened), lambda q: round(q, 6)) AS weight_quantiles FROM v")
def intervention_timing(spark: SparkSession, data: str) -> DataFrame:
    return scoring.interventions(events(spark, data))


@query(EVENTS + " SELECT ordinal, CASE WHEN em > res_em THEN 'gain' ELSE 'loss' END AS effect FROM r WHERE em <> res_em")
def error_transitions(spark: SparkSession, data: str) -> DataFrame:
    return scoring.changed(events(spark, data)).select("ordinal", "effect")


# Resampling -------------------------------------------------------------------------------------------------------------


def arms(spark: SparkSession, data: str) -> DataFrame:
    """Questions with the scores and losses of the base and of one other arm, and their clusters."""
    s = qa.tally(spark, data)
    n = qa.nll_rows(spark, data)

    def arm(name: str, where: str) -> DataFrame:
        scores = s.where(where).groupBy("stable_id").agg(F.min("dataset").alias(f"{name}_dataset"), F.max("em").alias(f"{name}_em"), F.max("f1").alias(f"{name}_f1"))
        loss = n.where(where).groupBy("stable_id").agg(F.min("s").alias(f"{name}_nll"), F.min(F.col("k").cast("double")).alias(f"{name}_tokens"))
        return scores.join(loss, "stable_id")

    both = arm("base", "method = 'base'").join(arm("mem", "method = 'resmem'"), "stable_id")
    keys = qa.references(spark, data).select("stable_id", X.weak_key(F.col("question")).alias("cluster"))
    return both.join(keys, "stable_id").withColumn("dataset", F.col("base_dataset"))


@query()
def contrast_intervals(spark: SparkSession, data: str) -> DataFrame:
    """EM, F1 and NLL of an arm less the base, by dataset and over datasets of equal weight."""
    cols = lambda a: {k: F.col(f"{a}_{k}") for k in ("em", "f1", "nll", "tokens")}
    return bootstrap.contrasts(arms(spark, data), "cluster", {"mem": cols("mem"), "base": cols("base")}, [("mem", "base")], DATASETS, draws=500)


@query()
def repair_intervals(spark: SparkSession, data: str) -> DataFrame:
    r = arms(spark, data).select("cluster", "dataset", "base_em", "base_f1", F.col("mem_em").alias("em"), F.col("mem_f1").alias("f1"))
    return bootstrap.repair_intervals(r, "cluster", DATASETS, draws=500)


@query()
def curve_intervals(spark: SparkSession, data: str) -> DataFrame:
    r = arms(spark, data)
    return bootstrap.curve_intervals(r, "cluster", {"resmem": F.col("mem_em")}, F.col("base_em"), draws=500)


@query()
def crossed_intervals(spark: SparkSession, data: str) -> DataFrame:
    """A difference in F1 that four runs measure, over questions, runs and both; the runs are the arm's F1 weighed by hashes."""
    runs = [(F.col("mem_f1") - F.col("base_f1")) * (F.pmod(F.xxhash64("stable_id", F.lit(i)), F.lit(5)) / 4) for i in range(4)]
    return bootstrap.crossed_intervals(arms(spark, data), "cluster", runs, DATASETS, draws=500)


@query()
def ternary_intervals(spark: SparkSession, data: str) -> DataFrame:
    return bootstrap.ternary_intervals(arms(spark, data).select("dataset", (F.col("mem_em") - F.col("base_em")).alias("delta")), draws=2000)


@query()
def mean_intervals(spark: SparkSession, data: str) -> DataFrame:
    return bootstrap.mean_intervals(qa.scores(spark, data), "method", "em")


# Retrieval, prompts and training records --------------------------------------------------------------------------------

@query(f"""{INDEX}, q AS (SELECT item_id AS query_id, term, count(*) AS n FROM (SELECT item_id, unnest({TERMS.format('substr(question, 1, 600)')}) AS term FROM eval_item) GROUP BY ALL),
h AS (SELECT query_id, doc_id, round(sum(score * n), 6) AS score FROM q JOIN p USING (term) GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM h WHERE score > 0),
o AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INTEGER AS place FROM k JOIN documents USING (doc_id) WHERE rank <= 64 AND title IS DISTINCT FROM 'Nobody')
SELECT query_id, place, doc_id FROM o WHERE place <= 5 AND query_id IN (SELECT query_id FROM o WHERE place = 5)""")
def bm25_other_title(spark: SparkSession, data: str) -> DataFrame:
    """Of the 64 best documents the first five that aren't of the question's own page."""
    docs, q = table(spark, data, "documents"), corpus.asked(spark, data)
    own = q.select("query_id", F.lit("Nobody").alias("title"))
    return bm25.other_titles(corpus.retrieved(spark, data, 64), docs, own).select("query_id", "place", "doc_id")


@query()
def teacher_contexts(spark: SparkSession, data: str) -> DataFrame:
    return bm25.contexts(table(spark, data, "documents").select("doc_id", "text"), corpus.asked(spark, data))


def prepared(spark: SparkSession, data: str) -> DataFrame:
    e = table(spark, data, "eval_item").select(F.col("item_id").alias("query_id"), "dataset", "question", "aliases")
    hits = bm25.texts(corpus.retrieved(spark, data, 5), table(spark, data, "documents"), "text")
    p = prompts.pack(prompts.gathered(hits, e), budget=400, each=64)
    return p.withColumns({"visible_answer": prompts.visible_hit(F.col("aliases"), F.col("visible_documents")), "complete_top5": prompts.complete(F.col("documents"), F.col("visible_documents"))})


@query()
def prepare_prompts(spark: SparkSession, data: str) -> DataFrame:
    """Prompts with evidence within 400 words, of at most 64 words each."""
    return prepared(spark, data).select("query_id", "prompt", "prompt_tokens", "prompt_truncated", "visible_answer", "complete_top5")


@query()
def prompt_stats(spark: SparkSession, data: str) -> DataFrame:
    return prompts.prompt_stats(prepared(spark, data), "dataset")


FILL = """WITH c AS (SELECT stable_id, coalesce(source_title, stable_id) AS title, len(aliases) > 1 AS eligible, row_number() OVER (ORDER BY sha256('42:p0c:' || stable_id)) AS rank FROM calibration),
e AS (SELECT *, row_number() OVER (ORDER BY rank) AS k FROM c WHERE eligible), t AS (SELECT * FROM e WHERE k <= 60),
v AS (SELECT *, row_number() OVER (ORDER BY rank) AS j FROM e WHERE k > 60 AND title NOT IN (SELECT title FROM t)),
x AS (SELECT max(rank) AS stop FROM v WHERE j <= 15), l AS (SELECT max(rank) AS last FROM t)"""


@query(FILL + """ SELECT stable_id, CASE WHEN rank > (SELECT last FROM l) AND title IN (SELECT title FROM t) THEN 'title' WHEN NOT eligible THEN 'short' WHEN rank <= (SELECT last FROM l) THEN 'training' ELSE 'validation' END AS role FROM c WHERE rank <= (SELECT stop FROM x)""")
def train_valid_fill(spark: SparkSession, data: str) -> DataFrame:
    """The first 60 rows with several aliases train, the next 15 from other pages validate."""
    c = table(spark, data, "calibration")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit("42:p0c:"), F.col("stable_id")), 256), 1, 15), 16, 10).cast("bigint")
    r = sequence.ranked(c.select("stable_id", F.coalesce("source_title", "stable_id").alias("title"), F.coalesce(F.size("aliases") > 1, F.lit(False)).alias("eligible"), h.alias("h")), "h", to="rank")
    return sequence.fill(r.drop("h"), 60, 15).select("stable_id", "role")


@query("WITH s AS (SELECT ordinal, output_ids, unnest(range(0, len(output_ids), 6)) AS start FROM predictions WHERE len(output_ids) > 0) SELECT ordinal, (start // 6)::INTEGER AS span, start::INTEGER AS start, output_ids[start + 1 : start + 6] AS span_ids FROM s")
def token_spans(spark: SparkSession, data: str) -> DataFrame:
    return sequence.spans(table(spark, data, "predictions").select("ordinal", "output_ids"), "output_ids", 6).select("ordinal", "span", "start", "span_ids")


@query(f"SELECT ordinal, 'Answer these questions:' || chr(10) || 'Question: ' || regexp_replace(regexp_replace(question, '^{qa.SP}', ''), '{qa.SP}$', '') || chr(10) || 'Answer:' AS prompt FROM qa_ref WHERE trim(question) <> ''")
def build_prompts(spark: SparkSession, data: str) -> DataFrame:
    return table(spark, data, "qa_ref").where(F.trim("question") != "").select("ordinal", normalise.prompt(F.col("question")).alias("prompt"))


# Normalised sources -----------------------------------------------------------------------------------------------------


@query("""SELECT ordinal, 'popqa:' || json_extract_string(metadata, '$.source_id') AS stable_id, CASE WHEN list_contains(aliases, answer) THEN aliases ELSE list_prepend(answer, aliases) END AS aliases, CAST(json_extract_string(metadata, '$.subject_popularity') AS BIGINT) AS pop
FROM (SELECT ordinal, metadata, trim(json_extract_string(metadata, '$.object')) AS answer, list_transform(list_filter(list_zip(l, range(1, len(l) + 1)), lambda z: list_position(l, z[1]) = z[2]), lambda z: z[1]) AS aliases FROM (SELECT ordinal, metadata, list_filter(list_transform(aliases, lambda a: regexp_replace(regexp_replace(a, '^""" + qa.SP + """', ''), '""" + qa.SP + """$', '')), lambda a: a <> '') AS l FROM qa_ref WHERE json_extract_string(metadata, '$.property') IS NOT NULL AND json_extract_string(metadata, '$.object') IS NOT NULL AND json_extract_string(metadata, '$.source_id') IS NOT NULL AND json_extract_string(metadata, '$.subject_popularity') IS NOT NULL AND json_extract_string(metadata, '$.object_popularity') IS NOT NULL AND aliases IS NOT NULL AND len(aliases) > 0 AND trim(question) <> ''))""")
def normalise_popqa(spark: SparkSession, data: str) -> DataFrame:
    """References written out as the raw table they could have come from, and normalised again."""
    m = lambda k: F.get_json_object("metadata", f"$.{k}")
    there = [m(k).isNotNull() for k in ("property", "object", "source_id", "subject_popularity", "object_popularity")]
    q = table(spark, data, "qa_ref").where(there[0] & there[1] & there[2] & there[3] & there[4] & (F.size("aliases") > 0) & (F.trim("question") != ""))
    raw = q.select("ordinal", m("source_id").alias("id"), "question", m("property").alias("prop"), m("object").alias("obj"), m("subject").alias("subj"), F.lit(None).cast("string").alias("s_wiki_title"), F.to_json("aliases").alias("possible_answers"), m("subject_popularity").alias("s_pop"), m("object_popularity").alias("o_pop"))
    return normalise.popqa(raw).select("ordinal", "stable_id", "aliases", F.get_json_object("metadata", "$.subject_popularity").cast("bigint").alias("pop"))


@query("SELECT ordinal, format('nq:dev:{:06d}', ordinal) AS stable_id, list_distinct(list_transform(aliases, lambda a: a)) IS NOT NULL AS listed FROM qa_ref WHERE aliases IS NOT NULL AND len(aliases) > 0 AND len(list_filter(aliases, lambda a: a IS NULL OR trim(a) = '')) = 0 AND trim(question) <> ''")
def normalise_dpr(spark: SparkSession, data: str) -> DataFrame:
    """Aliases written as a Python list and read again."""
    q = table(spark, data, "qa_ref").where((F.size("aliases") > 0) & ~F.exists("aliases", lambda a: a.isNull() | (F.trim(a) == "")) & (F.trim("question") != ""))
    quoted = F.transform("aliases", lambda a: F.concat(F.lit("'"), F.replace(F.replace(F.replace(a, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("\n"), F.lit("\\n")), F.lit("'")))
    raw = q.select("ordinal", "question", F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]")).alias("answers"), F.col("aliases").alias("original"))
    made = normalise.dpr(raw, "nq", "dev").select("ordinal", "stable_id", "aliases")
    return made.join(q.select("ordinal", F.col("aliases").alias("original")), "ordinal").select("ordinal", "stable_id", (F.col("aliases") == X.clean_list(F.col("original"))).alias("listed"))


@query("""SELECT stable_id, 'answer' AS reason FROM qa_ref WHERE answer IS NULL OR trim(answer) = '' UNION ALL SELECT stable_id, 'question' FROM qa_ref WHERE question IS NULL OR trim(question) = '' UNION ALL SELECT stable_id, 'aliases' FROM qa_ref WHERE aliases IS NULL
UNION ALL SELECT stable_id, 'metadata' FROM qa_ref WHERE metadata IS NULL OR ltrim(metadata)[1] <> '{' UNION ALL SELECT stable_id, 'dataset' FROM qa_ref WHERE dataset IS NULL OR trim(dataset) = ''
UNION ALL SELECT stable_id, 'answer contract' FROM qa_ref WHERE (aliases IS NULL OR len(list_filter(aliases, lambda a: trim(a) <> '')) = 0) AND json_extract_string(metadata, '$.answer_regex') IS NULL""")
def contract_violations(spark: SparkSession, data: str) -> DataFrame:
    return normalise.violations(table(spark, data, "qa_ref"))


# Checks -----------------------------------------------------------------------------------------------------------------


@query(f"WITH {sql_keys('calibration')}, c AS (SELECT stable_id, split, {sql_squeeze('k')} AS key FROM calibration JOIN fq ON question = q) SELECT stable_id FROM c WHERE split = 'dev' AND key IN (SELECT key FROM c WHERE split = 'audit')")
def not_disjoint(spark: SparkSession, data: str) -> DataFrame:
    """Development questions that stand in the audit split too."""
    c = table(spark, data, "calibration").select("stable_id", "split", X.weak_key(F.col("question")).alias("key"))
    return c.where("split = 'dev'").join(c.where("split = 'audit'").select("key"), "key", "left_semi").select("stable_id")


@query("SELECT coalesce(q.ordinal, p.ordinal) AS ordinal, CASE WHEN q.ordinal IS NULL OR p.ordinal IS NULL THEN 'length' ELSE 'differs' END AS problem FROM qa_ref AS q FULL JOIN predictions AS p ON q.ordinal = p.ordinal WHERE q.ordinal IS NULL OR p.ordinal IS NULL OR q.stable_id IS DISTINCT FROM p.stable_id OR q.dataset IS DISTINCT FROM p.dataset")
def positional_problems(spark: SparkSession, data: str) -> DataFrame:
    return checks.positional(table(spark, data, "qa_ref"), table(spark, data, "predictions"), ["stable_id", "dataset"])


@query("WITH a AS (SELECT stable_id, arg_min(dataset, ordinal) AS d, arg_min(prediction, ordinal) AS p FROM predictions WHERE method = 'base' AND prediction IS NOT NULL GROUP BY 1), b AS (SELECT stable_id, arg_min(dataset, ordinal) AS d, arg_min(prediction, ordinal) AS p FROM predictions WHERE method = 'lora' AND prediction IS NOT NULL GROUP BY 1) SELECT coalesce(a.stable_id, b.stable_id) AS stable_id, unnest(CASE WHEN a.stable_id IS NULL OR b.stable_id IS NULL THEN ['stable_id'] ELSE list_filter([CASE WHEN a.d IS DISTINCT FROM b.d THEN 'dataset' END, CASE WHEN a.p IS DISTINCT FROM b.p THEN 'prediction' END], lambda x: x IS NOT NULL) END) AS \"column\" FROM a FULL JOIN b ON a.stable_id = b.stable_id")
def parity_check(spark: SparkSession, data: str) -> DataFrame:
    p = table(spark, data, "predictions").where("prediction is not null")
    first = lambda m: p.where(F.col("method") == m).groupBy("stable_id").agg(F.min_by("dataset", "ordinal").alias("dataset"), F.min_by("prediction", "ordinal").alias("prediction"))
    return checks.differing(first("base"), first("lora"), "stable_id", ["dataset", "prediction"])


@query("SELECT dataset AS value, count(*) AS n FROM qa_ref WHERE dataset IS NULL OR dataset NOT IN ('nq', 'triviaqa', 'webq', 'hotpotqa', 'popqa') GROUP BY dataset")
def unknown_datasets(spark: SparkSession, data: str) -> DataFrame:
    return checks.outside(table(spark, data, "qa_ref"), "dataset", DATASETS)


@query("SELECT step FROM (SELECT DISTINCT step FROM telemetry WHERE step IS NOT NULL) WHERE step - 1 NOT IN (SELECT step FROM telemetry WHERE step IS NOT NULL) AND step > (SELECT min(step) FROM telemetry)")
def steps_skipped(spark: SparkSession, data: str) -> DataFrame:
    return sequence.not_following(table(spark, data, "telemetry").where("step is not null").select("step").distinct(), "step")


@query("SELECT stable_id, method, coefficient, count(*) AS n FROM predictions GROUP BY ALL HAVING count(*) > 1")
def repeated_predictions(spark: SparkSession, data: str) -> DataFrame:
    return checks.repeated(table(spark, data, "predictions"), "stable_id", "method", "coefficient")


# Sequences, timing and files --------------------------------------------------------------------------------------------

TWO = """WITH b AS (SELECT stable_id, arg_min(output_ids, ordinal) AS x FROM predictions WHERE method = 'base' AND output_ids IS NOT NULL GROUP BY 1), l AS (SELECT stable_id, arg_min(output_ids, ordinal) AS y FROM predictions WHERE method = 'lora' AND output_ids IS NOT NULL GROUP BY 1),
p AS (SELECT stable_id, x, y, list_transform(range(1, least(len(x), len(y)) + 1), lambda i: x[i] = y[i]) AS same FROM b JOIN l USING (stable_id)), c AS (SELECT *, coalesce(list_position(same, FALSE) - 1, len(same)) AS prefix FROM p)"""


@query(TWO + " SELECT stable_id, x = y AS identical, prefix::BIGINT AS common_prefix, CASE WHEN x <> y THEN prefix::BIGINT END AS first_difference, len(list_filter(same, lambda s: s))::INTEGER AS agreed, greatest(len(x), len(y))::INTEGER AS longest, (len(y) - len(x))::INTEGER AS length_delta FROM c")
def sequence_drift(spark: SparkSession, data: str) -> DataFrame:
    p = table(spark, data, "predictions").where("output_ids is not null")
    first = lambda m, c: p.where(F.col("method") == m).groupBy("stable_id").agg(F.min_by("output_ids", "ordinal").alias(c))
    d = A.sequence_drift(F.col("x"), F.col("y"))
    return first("base", "x").join(first("lora", "y"), "stable_id").select("stable_id", *[c.alias(k) for k, c in d.items()])


TIMES = """WITH t AS (SELECT l_shipmode AS arm, l_returnflag AS condition, l_quantity AS q FROM lineitem)""".replace("l_shipmode", "l_linestatus")


@query(TIMES + """, m AS (SELECT arm, condition, quantile_cont(q, 0.5) AS total_ms, quantile_cont(q, 0.75) AS peak_gib FROM t GROUP BY ALL), b AS (SELECT condition, total_ms AS t, peak_gib AS p FROM m WHERE arm = 'F')
SELECT arm, condition, round(total_ms, 6) AS total_ms, round(100 * (total_ms / t - 1), 6) AS overhead_pct, round(peak_gib - p, 6) AS peak_over_base_gib FROM m LEFT JOIN b USING (condition)""")
def timing_overhead(spark: SparkSession, data: str) -> DataFrame:
    """Quantities as times: medians of each arm and condition beside those of the base arm."""
    t = table(spark, data, "lineitem").select(F.col("l_linestatus").alias("arm"), F.col("l_returnflag").alias("condition"), F.col("l_quantity").alias("q"))
    m = timing.exact_quantiles(t, ["arm", "condition"], "q", (0.5, 0.75)).select("arm", "condition", F.col("q")[0].alias("total_ms"), F.col("q")[1].alias("peak_gib"))
    return timing.overhead(m, "F").select("arm", "condition", F.round("total_ms", 6).alias("total_ms"), F.round("overhead_pct", 6).alias("overhead_pct"), F.round("peak_over_base_gib", 6).alias("peak_over_base_gib"))


@query("SELECT stable_id, method, round(loss, 6) AS loss, k::BIGINT AS tokens FROM (SELECT stable_id, method, coefficient, avg(s / k) AS loss, max(k) AS k FROM (SELECT stable_id, method, coefficient, list_sum(token_nll) AS s, len(token_nll) AS k FROM (SELECT DISTINCT stable_id, dataset, method, coefficient, token_nll FROM nll) WHERE token_nll IS NOT NULL AND len(token_nll) > 0 AND len(list_filter(token_nll, lambda x: x IS NULL)) = 0) GROUP BY ALL) WHERE coefficient IS NULL")
def losses_by_question(spark: SparkSession, data: str) -> DataFrame:
    n = qa.nll_rows(spark, data).where("coefficient is null")
    return n.groupBy("stable_id", "method").agg(F.round(F.avg(F.col("s") / F.col("k")), 6).alias("loss"), F.max("k").cast("bigint").alias("tokens"))


@query(SCORED + ", d AS (SELECT dataset, method, coefficient, avg(em) AS em, avg(f1) AS f1 FROM s WHERE coefficient IS NOT NULL GROUP BY ALL), m AS (SELECT method, coefficient, avg(em) AS em, avg(f1) AS f1 FROM d GROUP BY ALL) SELECT method, count(*) AS runs, round(avg(em), 6) AS em_mean, round(stddev_samp(em), 6) AS em_sd, round(avg(f1), 6) AS f1_mean, round(stddev_samp(f1), 6) AS f1_sd FROM m GROUP BY method")
def run_summary(spark: SparkSession, data: str) -> DataFrame:
    """Means over datasets of each setting, then mean and deviation over a method's settings, taken as runs."""
    each = qa.cells(spark, data, "dataset", "method", "coefficient").where("coefficient is not null")
    macro = each.groupBy("method", "coefficient").agg(F.avg("em").alias("em"), F.avg("f1").alias("f1"))
    return scoring.over_runs(macro, ["em", "f1"], "coefficient", "method")


@query("SELECT ordinal, sha256(unhex(list_aggregate(list_transform(output_ids, lambda t: substr(hex4, 7, 2) || substr(hex4, 5, 2) || substr(hex4, 3, 2) || substr(hex4, 1, 2)), 'string_agg', ''))) AS digest FROM predictions".replace("hex4", "lpad(hex(t::BIGINT), 8, '0')") + " WHERE len(output_ids) > 0")
def token_digests(spark: SparkSession, data: str) -> DataFrame:
    return table(spark, data, "predictions").where(F.size("output_ids") > 0).select("ordinal", X.token_digest(F.col("output_ids")).alias("digest"))


@query("SELECT 'qa_ref' AS dataset, count(*) AS row_count, 'v1' AS schema_version FROM qa_ref")
def manifest(spark: SparkSession, data: str) -> DataFrame:
    """The manifest of a table, but for its digest, which has no counterpart in SQL."""
    m = sinks.manifest(table(spark, data, "qa_ref"), "v1", "qa_ref", "test", {"qa_ref": "-"})
    return m.where(F.length("digest") == 64).select("dataset", "row_count", "schema_version")


