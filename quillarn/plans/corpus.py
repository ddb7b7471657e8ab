"""Queries over the corpus, splits, retrieval, plans and vectors."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillarn.functions import arrays as A
from quillarn.functions import text as X
from quillarn.operators import bm25, checks, policy, prompts, sequence, timing
from quillarn.plans.qa import SP, sql_answer, sql_keys, sql_plain, sql_squeeze
from quillarn.plans.roster import query
from quillarn.sources import sinks
from quillarn.sources.tables import table


@query(f"WITH {sql_keys('calibration')} SELECT stable_id, CASE WHEN b < 60 THEN 'fit' WHEN b < 85 THEN 'dev' ELSE 'audit' END AS split FROM (SELECT stable_id, ('0x' || substr(sha256('gate-partition-v1:' || {sql_plain('k')}), 1, 8))::BIGINT % 100 AS b FROM calibration JOIN fq ON question = q)")
def hash_split(spark: SparkSession, data: str) -> DataFrame:
    b = X.bucket(X.strong_key(F.col("question")), "gate-partition-v1:")
    return table(spark, data, "calibration").where("question is not null").select("stable_id", F.when(b < 60, "fit").when(b < 85, "dev").otherwise("audit").alias("split"))


@query("SELECT dataset, stable_id FROM (SELECT dataset, stable_id, row_number() OVER (PARTITION BY dataset ORDER BY sha256('sample|' || dataset || '|' || stable_id), stable_id) AS k FROM qa_ref WHERE dataset IS NOT NULL) WHERE k <= 50")
def hash_sample(spark: SparkSession, data: str) -> DataFrame:
    """The 50 least by hash of each dataset; ranks of groups are pruned before the shuffle."""
    h = F.sha2(F.concat_ws("|", F.lit("sample"), "dataset", "stable_id"), 256)
    w = Window.partitionBy("dataset").orderBy("h", "stable_id")
    return table(spark, data, "qa_ref").where("dataset is not null").select("dataset", "stable_id", h.alias("h")).withColumn("k", F.row_number().over(w)).where("k <= 50").select("dataset", "stable_id")


@query("SELECT dataset, count_if(split = 'fit')::BIGINT AS fit, count_if(split = 'dev')::BIGINT AS dev, count_if(split = 'audit')::BIGINT AS audit, count(*) AS n FROM calibration GROUP BY dataset")
def split_pivot(spark: SparkSession, data: str) -> DataFrame:
    return table(spark, data, "calibration").groupBy("dataset").agg(*[F.count_if(F.col("split") == s).alias(s) for s in ("fit", "dev", "audit")], F.count("*").alias("n"))


ELIGIBLE = f"""WITH {sql_keys('qa_ref', 'eval_item')}, t AS (SELECT DISTINCT {sql_plain('k')} AS key FROM eval_item JOIN fq ON question = q),
c AS (SELECT ordinal, dataset, coalesce({sql_plain('k')}, '') AS key, aliases FROM qa_ref LEFT JOIN fq ON question = q),
s AS (SELECT ordinal, dataset, key, CASE WHEN key = '' OR aliases IS NULL OR len(aliases) = 0 THEN 'empty' WHEN key IN (SELECT key FROM t) THEN 'test_overlap' END AS reason FROM c),
d AS (SELECT ordinal, dataset, coalesce(reason, CASE WHEN row_number() OVER (PARTITION BY dataset, key, reason IS NULL ORDER BY ordinal) = 1 THEN 'eligible' ELSE 'duplicate' END) AS reason FROM s)"""


def eligibility(spark: SparkSession, data: str) -> DataFrame:
    """Why each row may or may not be used: empty, in the test, a duplicate of an earlier row, or eligible. First rows are
    found by a partial minimum of ordinals, so copies of one question are no hot group."""
    key = X.strong_key(F.col("question"))
    rows = table(spark, data, "qa_ref").select("ordinal", "dataset", F.coalesce(key, F.lit("")).alias("key"), F.coalesce(F.size("aliases"), F.lit(0)).alias("n"))
    test = table(spark, data, "eval_item").select(key.alias("key")).distinct().withColumn("in_test", F.lit(True))
    empty = (F.col("key") == "") | (F.col("n") <= 0)
    marked = rows.join(test, "key", "left").withColumn("reason", F.when(empty, "empty").when(F.col("in_test"), "test_overlap"))
    first = marked.where("reason is null").groupBy("dataset", "key").agg(F.min("ordinal").alias("first"))
    joined = marked.join(first, ["dataset", "key"], "left")
    return joined.select("ordinal", "dataset", F.coalesce("reason", F.when(F.col("ordinal") == F.col("first"), "eligible").otherwise("duplicate")).alias("reason"))


@query(ELIGIBLE + " SELECT dataset, reason, count(*) AS n FROM d GROUP BY ALL")
def eligibility_counters(spark: SparkSession, data: str) -> DataFrame:
    return eligibility(spark, data).groupBy("dataset", "reason").agg(F.count("*").alias("n"))


@query(ELIGIBLE + " SELECT ordinal FROM d WHERE reason = 'eligible'")
def dedup_first_wins(spark: SparkSession, data: str) -> DataFrame:
    return eligibility(spark, data).where("reason = 'eligible'").select("ordinal")


@query(f"""WITH {sql_keys('qa_ref', 'calibration')}, r AS (SELECT k FROM qa_ref JOIN fq ON question = q), c AS (SELECT k FROM calibration JOIN fq ON question = q)
SELECT 'weak' AS key, count(*) AS n FROM c WHERE {sql_squeeze('k')} IN (SELECT {sql_squeeze('k')} FROM r) UNION ALL SELECT 'strong', count(*) FROM c WHERE {sql_plain('k')} IN (SELECT {sql_plain('k')} FROM r)""")
def overlap_check(spark: SparkSession, data: str) -> DataFrame:
    c, q = table(spark, data, "calibration"), table(spark, data, "qa_ref")
    part = lambda name, f: c.select(f(F.col("question")).alias("k")).join(q.select(f(F.col("question")).alias("k")), "k", "left_semi").agg(F.lit(name).alias("key"), F.count("*").alias("n"))
    return part("weak", X.weak_key).union(part("strong", X.strong_key))


WORDS = f"list_filter(string_split(regexp_replace(coalesce(text, ''), '{SP}', ' ', 'g'), ' '), lambda w: w <> '')"
PASSAGES = f"""WITH d AS (SELECT doc_id AS id, coalesce(nullif(regexp_replace(regexp_replace(title, '^{SP}', ''), '{SP}$', ''), ''), 'untitled') AS title, text, n_chars IS NOT NULL AND n_chars > 5000 AS gap FROM documents WHERE source IS NOT NULL),
r AS (SELECT id, title, {WORDS} AS w, CASE WHEN lag(id) OVER o = id - 1 AND lag(title) OVER o = title AND NOT lag(gap) OVER o THEN NULL ELSE id END AS start FROM d WINDOW o AS (ORDER BY id)),
a AS (SELECT id, title, w, max(start) OVER (ORDER BY id) AS article FROM r),
u AS (SELECT article, title, id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM a),
n AS (SELECT article, title, word, row_number() OVER (PARTITION BY article ORDER BY id, i) - 1 AS n FROM u),
g AS (SELECT article, any_value(title) AS title, n // 100 AS part, string_agg(word, ' ' ORDER BY n) AS passage FROM n GROUP BY article, n // 100)
"""


def corpus(spark: SparkSession, data: str) -> DataFrame:
    """Documents as source records: those without a source were dropped, and what was longer than 5,000 characters as far as
    is known has a gap behind it."""
    d = table(spark, data, "documents")
    return d.select(F.col("doc_id").alias("id"), F.coalesce(X.stripped(F.col("title")), F.lit("untitled")).alias("title"), "text", F.col("source").isNotNull().alias("keep"), F.coalesce(F.col("n_chars") > 5000, F.lit(False)).alias("gap_after"))


@query(PASSAGES + "SELECT (row_number() OVER (ORDER BY article, part) - 1)::VARCHAR AS id, article, title, passage, title || chr(10) || passage AS text FROM g")
def chunk_passages(spark: SparkSession, data: str) -> DataFrame:
    return sequence.passages(corpus(spark, data))


STOP = ", ".join(f"'{w}'" for w in bm25.STOPWORDS)
TERMS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"
INDEX = f"""WITH t AS (SELECT doc_id, list_filter({TERMS.format('text')}, lambda x: x NOT IN ({STOP})) AS t FROM documents),
s AS (SELECT count(*)::DOUBLE AS docs, avg(coalesce(len(t), 0)) AS mean FROM t),
f AS (SELECT term, doc_id, count(*)::DOUBLE AS tf, any_value(l) AS l FROM (SELECT doc_id, len(t) AS l, unnest(t) AS term FROM t) GROUP BY ALL),
d AS (SELECT term, count(*)::DOUBLE AS df FROM f GROUP BY term),
p AS (SELECT term, doc_id, df, ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * l / mean)) AS score FROM f JOIN d USING (term), s)"""
TOP = INDEX + f""", q AS (SELECT item_id AS query_id, term, count(*) AS n FROM (SELECT item_id, unnest({TERMS.format('substr(question, 1, 600)')}) AS term FROM eval_item) GROUP BY ALL),
h AS (SELECT query_id, doc_id, round(sum(score * n), 6) AS score FROM q JOIN p USING (term) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM h WHERE score > 0)"""


def asked(spark: SparkSession, data: str) -> DataFrame:
    return table(spark, data, "eval_item").select(F.col("item_id").alias("query_id"), F.col("question").alias("text"))


def retrieved(spark: SparkSession, data: str, k: int = 20) -> DataFrame:
    return bm25.search_once(table(spark, data, "documents").select("doc_id", "text"), asked(spark, data), k)


@query(INDEX + " SELECT term, count(*) AS df, round(sum(score), 4) AS mass FROM p GROUP BY term")
def bm25_index_stats(spark: SparkSession, data: str) -> DataFrame:
    return bm25.postings(table(spark, data, "documents")).groupBy("term").agg(F.count("*").alias("df"), F.round(F.sum("score"), 4).alias("mass"))


@query(TOP + " SELECT query_id, doc_id, rank FROM k WHERE rank <= 20")
def bm25_topk(spark: SparkSession, data: str) -> DataFrame:
    return retrieved(spark, data).select("query_id", "doc_id", "rank")


@query(TOP + f""", v AS (SELECT k.query_id, k.rank, list_filter(list_transform(e.aliases, lambda a: {sql_answer('a')}), lambda a: a <> '') AS golds, {sql_answer('d.text')} AS text FROM k JOIN eval_item AS e ON e.item_id = k.query_id JOIN documents AS d USING (doc_id) WHERE rank <= 5)
SELECT query_id, max(CASE WHEN len(list_filter(golds, lambda g: contains(text, g))) > 0 THEN 1 ELSE 0 END)::INTEGER AS hit FROM v GROUP BY query_id""")
def answer_hit(spark: SparkSession, data: str) -> DataFrame:
    """Whether one of the five best documents shows an answer."""
    e = table(spark, data, "eval_item").select(F.col("item_id").alias("query_id"), F.filter(F.transform("aliases", X.answer_text), lambda a: a != "").alias("golds"))
    seen = bm25.texts(retrieved(spark, data, 5), table(spark, data, "documents"), "text").join(e, "query_id")
    return seen.groupBy("query_id").agg(F.max(F.exists("golds", lambda g: F.contains(X.answer_text(F.col("text")), g)).cast("int")).alias("hit"))


PACK = TOP + f""", l AS (SELECT query_id, rank, len({WORDS.replace('coalesce(text', "coalesce('[' || rank || '] ' || text")}) AS n FROM k JOIN documents USING (doc_id) WHERE rank <= 5),
c AS (SELECT query_id, rank, n, coalesce(sum(n) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l)"""


@query(PACK + " SELECT query_id, rank, least(n, 400 - before)::BIGINT AS words, n > 400 - before AS trimmed FROM c WHERE before < 400")
def pack_prompt(spark: SparkSession, data: str) -> DataFrame:
    """Documents in the order of rank until 400 words are full; the one that passes them is trimmed and is the last."""
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("text", F.lit("")))
    rows = bm25.texts(retrieved(spark, data, 5), table(spark, data, "documents"), "text").select("query_id", "rank", F.size(X.words(line)).cast("bigint").alias("n"))
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    packed = rows.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).where("before < 400")
    return packed.select("query_id", "rank", F.least("n", 400 - F.col("before")).alias("words"), (F.col("n") > 400 - F.col("before")).alias("trimmed"))


RUNS = """WITH o AS (SELECT row_number() OVER (ORDER BY ordinal) - 1 AS k, ordinal, dataset FROM qa_ref),
r AS (SELECT *, sum(new) OVER (ORDER BY k) AS run FROM (SELECT *, CASE WHEN dataset IS NOT DISTINCT FROM lag(dataset) OVER (ORDER BY k) AND k > 0 THEN 0 ELSE 1 END AS new FROM o)),
b AS (SELECT *, (row_number() OVER (PARTITION BY run ORDER BY k) - 1) // 16 AS part FROM r)"""


@query(RUNS + " SELECT ordinal, dataset, (dense_rank() OVER (ORDER BY run, part) - 1)::BIGINT AS batch, ((dense_rank() OVER (ORDER BY run, part) - 1) % 4)::BIGINT AS worker FROM b")
def batch_plan(spark: SparkSession, data: str) -> DataFrame:
    """Batches of 16 rows of a run of one dataset, dealt to four workers."""
    r = sequence.ranked(table(spark, data, "qa_ref").select("ordinal", "dataset"), "ordinal", to="k")
    return sequence.consecutive_batches(r, "k", "dataset", 16).select("ordinal", "dataset", "batch", F.pmod("batch", F.lit(4)).alias("worker"))


@query("SELECT dataset, format('{:s}-{:06d}', dataset, (k // 256) * 256) AS job, (k // 256) * 256 AS start, count(*) AS rows FROM (SELECT dataset, row_number() OVER (PARTITION BY dataset ORDER BY ordinal) - 1 AS k FROM predictions) GROUP BY dataset, k // 256")
def block_jobs(spark: SparkSession, data: str) -> DataFrame:
    return sequence.jobs(table(spark, data, "predictions"), "dataset", 256)


@query("SELECT ordinal, ordinal % 8 AS slot, (ordinal // 16) % 3 AS worker FROM qa_ref")
def round_robin(spark: SparkSession, data: str) -> DataFrame:
    """Slots in turn, and blocks of 16 in turn."""
    q = table(spark, data, "qa_ref")
    return q.select("ordinal", F.pmod("ordinal", F.lit(8)).cast("bigint").alias("slot"), F.pmod(F.floor(F.col("ordinal") / 16), F.lit(3)).cast("bigint").alias("worker"))


STEPS = """WITH g AS (SELECT ordinal % 4 AS rank, ordinal AS segment, len(output_ids)::BIGINT AS n FROM predictions WHERE output_ids IS NOT NULL),
c AS (SELECT *, sum(n) OVER (PARTITION BY rank ORDER BY segment) - n AS before FROM g), k AS (SELECT min(t) AS steps FROM (SELECT sum(n) // 256 AS t FROM g GROUP BY rank))"""


@query(STEPS + """ SELECT step, rank, segment, (greatest(before, step * 256) - before)::BIGINT AS start, (least(before + n, (step + 1) * 256) - before)::BIGINT AS end FROM (SELECT rank, segment, n, before, unnest(range((before // 256)::BIGINT, (least((before + n - 1) // 256, steps - 1) + 1)::BIGINT)) AS step FROM c, k WHERE n > 0)""")
def step_plan(spark: SparkSession, data: str) -> DataFrame:
    """Answers dealt to four ranks, each rank's tokens cut into steps of 256 that all ranks can fill."""
    return sequence.step_plan(_segments(spark, data), 256)


@query(STEPS + " SELECT rank, segment, (1000 - before)::BIGINT AS offset FROM c WHERE before <= 1000 AND before + n > 1000")
def resume_cursor(spark: SparkSession, data: str) -> DataFrame:
    return sequence.cursor(_segments(spark, data), 1000)


def _segments(spark: SparkSession, data: str) -> DataFrame:
    p = table(spark, data, "predictions").where("output_ids is not null")
    return p.select((F.col("ordinal") % 4).alias("rank"), F.col("ordinal").alias("segment"), F.size("output_ids").cast("bigint").alias("n"))


@query("SELECT ordinal, coalesce(sum(len(output_ids)) OVER (ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset_ids FROM predictions WHERE output_ids IS NOT NULL")
def offsets_bounds(spark: SparkSession, data: str) -> DataFrame:
    p = table(spark, data, "predictions").where("output_ids is not null").select("ordinal", F.size("output_ids").cast("bigint").alias("n"))
    return sequence.running(p, F.col("n"), "ordinal", "offset_ids").select("ordinal", "offset_ids")


@query("SELECT rank, sum(n)::BIGINT AS tokens, (min(sum(n)) OVER () // 256)::BIGINT AS steps FROM (SELECT ordinal % 4 AS rank, len(output_ids) AS n FROM predictions WHERE output_ids IS NOT NULL) GROUP BY rank")
def steps_per_epoch(spark: SparkSession, data: str) -> DataFrame:
    """The tokens of each rank, and the steps that the one with the fewest can fill."""
    n = _segments(spark, data).groupBy("rank").agg(F.sum("n").alias("tokens"))
    least = n.agg(F.floor(F.min("tokens") / 256).alias("steps"))
    return n.crossJoin(F.broadcast(least)).select("rank", "tokens", "steps")


@query("SELECT DISTINCT step, round(CASE WHEN step <= 32 THEN 5e-4 * step / 32 WHEN step >= 20000 THEN 5e-5 ELSE 5e-4 + (5e-5 - 5e-4) * (step - 32) / (20000 - 32) END, 12) AS lr FROM telemetry WHERE step IS NOT NULL")
def lr_schedule(spark: SparkSession, data: str) -> DataFrame:
    t = table(spark, data, "telemetry").where("step is not null").select("step").distinct()
    return t.select("step", F.round(sequence.learning_rate(F.col("step"), 20000), 12).alias("lr"))


LOG = "(SELECT DISTINCT step, attempt_id, logged_at, loss, ce, seen_tokens, wall_seconds, world_size, tokens_per_s FROM telemetry WHERE step IS NOT NULL)"


@query(f"SELECT attempt_id, count(*) AS rows, min(step) AS first_step, max(step) AS last_step, round(avg(loss), 6) AS loss, round(max(wall_seconds) * max(world_size) / 3600, 6) AS gpu_hours FROM {LOG} GROUP BY attempt_id")
def attempt_summary(spark: SparkSession, data: str) -> DataFrame:
    t = table(spark, data, "telemetry").where("step is not null").select("step", "attempt_id", "logged_at", "loss", "ce", "seen_tokens", "wall_seconds", "world_size", "tokens_per_s").distinct()
    return t.groupBy("attempt_id").agg(F.count("*").alias("rows"), F.min("step").alias("first_step"), F.max("step").alias("last_step"), F.round(F.avg("loss"), 6).alias("loss"), F.round(F.max("wall_seconds") * F.max("world_size") / 3600, 6).alias("gpu_hours"))


@query(f"""WITH l AS (SELECT step, arg_max(loss, logged_at) AS loss, arg_max(ce, logged_at) AS ce, arg_max(tokens_per_s, logged_at) AS rate FROM {LOG} WHERE loss IS NOT NULL AND ce IS NOT NULL AND tokens_per_s IS NOT NULL AND logged_at IS NOT NULL GROUP BY step)
SELECT step // 1000 AS interval, count(*) AS steps, round(avg(loss), 6) AS loss, round(avg(ce), 6) AS ce, round(avg(rate), 4) AS tokens_per_s FROM l GROUP BY ALL""")
def interval_telemetry(spark: SparkSession, data: str) -> DataFrame:
    """Steps run again after a resume count as run last."""
    t = table(spark, data, "telemetry").where("step is not null and loss is not null and ce is not null and tokens_per_s is not null and logged_at is not null")
    last = t.groupBy("step").agg(*[F.max_by(c, "logged_at").alias(c) for c in ("loss", "ce", "tokens_per_s")])
    return last.groupBy(F.floor(F.col("step") / 1000).alias("interval")).agg(F.count("*").alias("steps"), F.round(F.avg("loss"), 6).alias("loss"), F.round(F.avg("ce"), 6).alias("ce"), F.round(F.avg("tokens_per_s"), 4).alias("tokens_per_s"))


@query("""WITH t AS (SELECT world_size, tokens_per_s AS x FROM telemetry WHERE tokens_per_s IS NOT NULL), m AS (SELECT world_size, quantile_cont(x, 0.5) AS median FROM t GROUP BY 1)
SELECT t.world_size, count(*) AS n, round(any_value(median), 6) AS median, round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.75), 6) AS q75, round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 6) AS iqr, round(quantile_cont(abs(x - median), 0.5), 6) AS mad, round(min(x), 6) AS low, round(max(x), 6) AS high FROM t JOIN m ON t.world_size IS NOT DISTINCT FROM m.world_size GROUP BY t.world_size""")
def timing_summary(spark: SparkSession, data: str) -> DataFrame:
    """Exact quantiles from counts of values, with no group in one task's memory."""
    d = timing.described(table(spark, data, "telemetry"), "tokens_per_s", "world_size")
    return d.select("world_size", "n", *[F.round(c, 6).alias(c) for c in ("median", "q25", "q75", "iqr", "mad", "low", "high")])


@query("""WITH t AS (SELECT DISTINCT step, attempt_id, logged_at, loss FROM telemetry WHERE step IS NOT NULL AND logged_at IS NOT NULL), w AS (SELECT time_bucket(INTERVAL 1 HOUR, logged_at) AS s, count(*) AS rows, round(avg(loss), 6) AS loss, max(step) AS last_step FROM t GROUP BY ALL)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, rows, loss, last_step FROM w WHERE s + INTERVAL 1 HOUR <= (SELECT max(logged_at) FROM telemetry) - INTERVAL 1 HOUR""")
def telemetry_stream(spark: SparkSession, data: str) -> DataFrame:
    """The log as a stream of files: hours that are closed an hour after the last row, appended to a table."""
    import uuid

    from quillarn.session import shared_dir
    from quillarn.streaming import metrics

    schema = table(spark, data, "telemetry").schema
    log = metrics.read_log(spark, f"{data}/telemetry.parque[t]", schema).withColumn("logged_at", F.col("logged_at").cast("timestamp"))
    root = f"{shared_dir(spark)}/quillarn/stream-{uuid.uuid4().hex}"
    closed = metrics.windows(log, "1 hour", "1 hour")
    metrics.append(closed, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.schema(closed.schema).parquet(f"{root}/out").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "rows", "loss", "last_step")


LOGITS = "WITH b AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings), m AS (SELECT vec_id - 1 AS vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS y FROM embeddings), v AS (SELECT vec_id, label, x, y FROM b JOIN m USING (vec_id)), "
SOFT = "list_transform({0}, lambda q: q - list_max({0}) - ln(list_sum(list_transform({0}, lambda p: exp(p - list_max({0}))))))"


def logits(spark: SparkSession, data: str) -> DataFrame:
    e = table(spark, data, "embeddings")
    return e.select("vec_id", "label", A.doubles(F.col("embedding")).alias("x")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), A.doubles(F.col("embedding")).alias("y")), "vec_id")


@query(LOGITS + f"s AS (SELECT vec_id, label, {SOFT.format('x')} AS p FROM v) SELECT vec_id, round(-list_sum(list_transform(p, lambda z: exp(z) * z)), 6) AS entropy, round(exp(list_max(p)), 6) AS pmax, round(-p[label + 1], 6) AS nll, len(list_filter(p, lambda z: z > p[label + 1])) + 1 AS rank FROM s")
def softmax_entropy(spark: SparkSession, data: str) -> DataFrame:
    v = logits(spark, data).withColumn("p", A.log_softmax(F.col("x"))).withColumn("gold", F.element_at("p", F.col("label") + 1))
    return v.select("vec_id", F.round(A.entropy(F.col("p")), 6).alias("entropy"), F.round(F.exp(F.array_max("p")), 6).alias("pmax"), F.round(-F.col("gold"), 6).alias("nll"), (F.size(F.filter("p", lambda z: z > F.col("gold"))) + 1).cast("bigint").alias("rank"))


@query(LOGITS + f"z AS (SELECT vec_id, label, list_transform(list_zip(x, y), lambda q: q[1] + 0.5::DOUBLE * q[2]) AS f FROM v), s AS (SELECT vec_id, label, {SOFT.format('f')} AS p FROM z) SELECT vec_id, round(-p[label + 1], 6) AS nll FROM s")
def fuse_additive(spark: SparkSession, data: str) -> DataFrame:
    v = logits(spark, data).withColumn("p", A.log_softmax(F.zip_with("x", "y", lambda a, b: a + 0.5 * b)))
    return v.select("vec_id", F.round(-F.element_at("p", F.col("label") + 1), 6).alias("nll"))


@query(LOGITS + f"s AS (SELECT vec_id, label, {SOFT.format('x')} AS p, {SOFT.format('y')} AS q FROM v) SELECT vec_id, round(-ln(0.7 * exp(p[label + 1]) + 0.3 * exp(q[label + 1])), 6) AS nll, round(list_sum(list_transform(list_zip(p, q), lambda z: exp(z[1]) * (z[1] - z[2]))), 6) AS kl FROM s")
def fuse_mixture(spark: SparkSession, data: str) -> DataFrame:
    v = logits(spark, data).select("vec_id", "label", A.log_softmax(F.col("x")).alias("p"), A.log_softmax(F.col("y")).alias("q")).withColumn("m", A.mixture(F.col("p"), F.col("q"), 0.3))
    kl = A.total(F.zip_with("p", "q", lambda a, b: F.exp(a) * (a - b)))
    return v.select("vec_id", F.round(-F.element_at("m", F.col("label") + 1), 6).alias("nll"), F.round(kl, 6).alias("kl"))


@query(LOGITS + f"s AS (SELECT vec_id, {SOFT.format('x')} AS p FROM v), r AS (SELECT vec_id, unnest(p) AS lp, unnest(range(len(p))) AS id FROM s), t AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY lp DESC, id) AS k FROM r QUALIFY k <= 16), mm AS (SELECT *, exp(lp) / sum(exp(lp)) OVER (PARTITION BY vec_id) AS q FROM t) SELECT vec_id, list(id::INTEGER ORDER BY k) AS ids, round(max(q), 6) AS first, round(sum(q), 6) AS mass FROM mm GROUP BY vec_id")
def topk_renorm(spark: SparkSession, data: str) -> DataFrame:
    """The 16 most likely ids, their probabilities made to sum to 1."""
    t = logits(spark, data).select("vec_id", A.top_distribution(F.col("x"), 16).alias("t"))
    return t.select("vec_id", F.transform("t", lambda e: e["id"]).alias("ids"), F.round(F.element_at("t", 1)["p"], 6).alias("first"), F.round(A.total(F.transform("t", lambda e: e["p"])), 6).alias("mass"))


@query(LOGITS + f"s AS (SELECT vec_id, label, {SOFT.format('x')} AS p, {SOFT.format('y')} AS q FROM v), k AS (SELECT vec_id, label, p, [0, 1, 2] AS ids, [0.5::DOUBLE, 0.3, 0.2] AS w FROM s), o AS (SELECT vec_id, -p[label + 1] AS ce, list_sum(list_transform(ids, lambda i: w[i + 1] * (ln(w[i + 1]) - p[i + 1]))) AS kl FROM k) SELECT vec_id, round(0.25 * kl + 0.75 * ce, 6) AS loss, round(kl, 6) AS kl, round(ce, 6) AS ce FROM o")
def kl_ce(spark: SparkSession, data: str) -> DataFrame:
    v = logits(spark, data)
    loss, kl, ce = A.sparse_objective(F.col("x"), F.array(*map(F.lit, (0, 1, 2))), F.array(*map(F.lit, (0.5, 0.3, 0.2))), F.col("label"), 0.25)
    return v.select("vec_id", F.round(loss, 6).alias("loss"), F.round(kl, 6).alias("kl"), F.round(ce, 6).alias("ce"))


@query(LOGITS + f"s AS (SELECT x, y, {SOFT.format('x')} AS p, {SOFT.format('y')} AS q FROM v), d AS (SELECT list_max(list_transform(list_zip(x, y), lambda z: abs(z[2] - z[1]))) AS a, list_sum(list_transform(list_zip(x, y), lambda z: (z[2] - z[1]) * (z[2] - z[1]))) AS d2, list_sum(list_transform(x, lambda z: z * z)) AS x2, list_sum(list_transform(list_zip(p, q), lambda z: exp(z[1]) * (z[1] - z[2]))) AS kl, list_position(x, list_max(x)) = list_position(y, list_max(y)) AS e FROM s) SELECT count(*) AS positions, round(max(a), 6) AS max_abs, round(sqrt(sum(d2)) / greatest(sqrt(sum(x2)), 1e-30), 6) AS relative_l2, round(avg(kl), 6) AS mean_kl, round(max(kl), 6) AS max_kl, count_if(e)::BIGINT AS top1_equal FROM d")
def logit_drift(spark: SparkSession, data: str) -> DataFrame:
    d = A.logit_drift(F.col("x"), F.col("y"))
    r = logits(spark, data).select(*[c.alias(k) for k, c in d.items()])
    l2 = F.sqrt(F.sum("d2")) / F.greatest(F.sqrt(F.sum("a2")), F.lit(1e-30))
    return r.agg(F.count("*").alias("positions"), F.round(F.max("max_abs"), 6).alias("max_abs"), F.round(l2, 6).alias("relative_l2"), F.round(F.avg("kl"), 6).alias("mean_kl"), F.round(F.max("kl"), 6).alias("max_kl"), F.count_if("top1_equal").alias("top1_equal"))


FEATURES = LOGITS + f"""z AS (SELECT vec_id, x, y, list_transform(list_zip(x, y), lambda q: q[1] + 0.5::DOUBLE * q[2]) AS f FROM v),
s AS (SELECT vec_id, x, y, f, {SOFT.format('x')} AS p, {SOFT.format('f')} AS q, list_position(x, list_max(x)) AS b, list_position(f, list_max(f)) AS c FROM z),
h AS (SELECT *, x[b] - x[c] AS gap, 0.5 * (y[c] - y[b]) AS adv, -list_sum(list_transform(p, lambda t: exp(t) * t)) AS entropy, -list_sum(list_transform(q, lambda t: exp(t) * t)) AS fused_entropy FROM s)"""


@query(FEATURES + " SELECT vec_id, round(entropy, 6) AS entropy, round(exp(list_max(p)), 6) AS pmax, round(list_reverse_sort(x)[1] - list_reverse_sort(x)[2], 6) AS margin, round(fused_entropy, 6) AS fused_entropy, round(gap, 6) AS gap, round(adv, 6) AS advantage, round((adv - gap) / (gap + 0.25), 5) AS overshoot, round(ln(1 + len(list_filter(x, lambda t: t > x[c]))), 6) AS logrank, round(list_stddev_samp(y) * 0.5, 6) AS spread, b <> c AS disagreement FROM h")
def gate_features(spark: SparkSession, data: str) -> DataFrame:
    f = A.decision_features(F.col("x"), F.col("y"), 0.5)
    names = {"entropy": "entropy", "pmax": "pmax", "margin": "margin", "fused_entropy": "fused_entropy", "candidate_base_gap": "gap", "residual_advantage": "advantage", "candidate_logrank": "logrank", "residual_std": "spread"}
    return logits(spark, data).select("vec_id", *[F.round(f[k], 6).alias(n) for k, n in names.items()], F.round(f["overshoot"], 5).alias("overshoot"), f["disagreement"].alias("disagreement"))


GATE = {"kind": "any", "rules": [{"kind": "threshold", "field": "entropy", "op": "ge", "threshold": 4.0}, {"kind": "all", "rules": [{"kind": "threshold", "field": "margin", "op": "le", "threshold": 0.05}, {"kind": "soft_entropy", "threshold": 3.5, "temperature": 0.5, "floor": 0.1}]}]}


@query(LOGITS + f"s AS (SELECT vec_id, {SOFT.format('x')} AS p FROM v), f AS (SELECT vec_id, -list_sum(list_transform(p, lambda z: exp(z) * z)) AS entropy, list_reverse_sort(p)[1] - list_reverse_sort(p)[2] AS margin FROM s) SELECT vec_id, round(greatest(CASE WHEN entropy >= 4.0 THEN 1.0::DOUBLE ELSE 0 END, least(CASE WHEN margin <= 0.05 THEN 1.0::DOUBLE ELSE 0 END, 0.1 + 0.9 / (1 + exp(-(entropy - 3.5) / 0.5)))), 6) AS weight FROM f")
def gate_eval(spark: SparkSession, data: str) -> DataFrame:
    p = logits(spark, data).withColumn("p", A.log_softmax(F.col("x")))
    f = p.select("vec_id", A.entropy(F.col("p")).alias("entropy"), F.sort_array("p", asc=False).alias("o")).withColumn("margin", F.element_at("o", 1) - F.element_at("o", 2))
    return f.select("vec_id", F.round(policy.compile_policy(GATE), 6).alias("weight"))


@query("""WITH k AS (SELECT DISTINCT stable_id FROM predictions), m AS (SELECT DISTINCT method, coefficient FROM predictions),
h AS (SELECT stable_id, method, coefficient, count(*) AS n FROM predictions GROUP BY ALL)
SELECT m.method, m.coefficient, count(*) AS expected, count(h.n) AS present, count_if(h.n > 1)::BIGINT AS repeated FROM k, m LEFT JOIN h ON h.stable_id = k.stable_id AND h.method = m.method AND h.coefficient IS NOT DISTINCT FROM m.coefficient GROUP BY ALL""")
def completeness_grid(spark: SparkSession, data: str) -> DataFrame:
    """How much of the grid of questions and settings is there: counted by setting, without making the grid."""
    p = table(spark, data, "predictions")
    cells = p.groupBy("stable_id", "method", "coefficient").agg(F.count("*").alias("n"))
    keys = p.select("stable_id").distinct().agg(F.count("*").alias("expected"))
    return cells.groupBy("method", "coefficient").agg(F.count("*").alias("present"), F.count_if(F.col("n") > 1).alias("repeated")).crossJoin(F.broadcast(keys)).select("method", "coefficient", "expected", "present", "repeated")


@query("SELECT stable_id, 'predictions' AS missing_in FROM (SELECT DISTINCT stable_id FROM nll EXCEPT SELECT stable_id FROM predictions) UNION ALL SELECT stable_id, 'nll' FROM (SELECT stable_id FROM predictions EXCEPT SELECT stable_id FROM nll)")
def key_diff(spark: SparkSession, data: str) -> DataFrame:
    a, b = table(spark, data, "nll").select("stable_id").distinct(), table(spark, data, "predictions").select("stable_id").distinct()
    return a.join(b, "stable_id", "left_anti").withColumn("missing_in", F.lit("predictions")).union(b.join(a, "stable_id", "left_anti").withColumn("missing_in", F.lit("nll")))


@query("""WITH k AS (SELECT DISTINCT stable_id FROM predictions WHERE method = 'resmem'), e AS (SELECT stable_id, 'base' AS method, 0.0::DOUBLE AS coefficient FROM k UNION ALL SELECT stable_id, 'resmem', unnest([0.1::DOUBLE, 0.3]) FROM k),
h AS (SELECT stable_id, method, coalesce(coefficient, 0.0) AS coefficient, count(*) AS n FROM predictions WHERE method IN ('base', 'resmem') GROUP BY ALL)
SELECT coalesce(h.stable_id, e.stable_id) AS stable_id, coalesce(h.method, e.method) AS method, coalesce(h.coefficient, e.coefficient) AS coefficient, CASE WHEN h.n IS NULL THEN 'missing' WHEN e.stable_id IS NULL THEN 'extra' ELSE 'repeated' END AS problem
FROM h FULL JOIN e ON h.stable_id = e.stable_id AND h.method = e.method AND h.coefficient = e.coefficient WHERE h.n IS NULL OR e.stable_id IS NULL OR h.n > 1""")
def grid_problems(spark: SparkSession, data: str) -> DataFrame:
    """Answers that a grid of settings needs and hasn't, has without need, or has more than once."""
    p = table(spark, data, "predictions").where(F.col("method").isin("base", "resmem")).select("stable_id", "method", F.coalesce("coefficient", F.lit(0.0)).alias("coefficient"))
    ids = p.where("method = 'resmem'").select("stable_id").distinct()
    return checks.key_difference(p, checks.prediction_grid(ids, ["resmem"], [0.0, 0.1, 0.3]), "stable_id", "method", "coefficient")


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark: SparkSession, data: str) -> DataFrame:
    li = table(spark, data, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query()
def table_digest(spark: SparkSession, data: str) -> DataFrame:
    return sinks.digest(table(spark, data, "qa_ref"), "dataset")
