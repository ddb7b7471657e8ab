"""Queries over questions, references and predictions."""
from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillarn.functions import text as X
from quillarn.operators import scoring as S
from quillarn.operators import sequence
from quillarn.plans.roster import query
from quillarn.sources.tables import table

# SQL counterparts of the text functions
SP = r"[\s\p{Z}\x85\x0b\x1c-\x1f]+"
PUNCT = X.ASCII_PUNCTUATION.replace("'", "''")
# What NFKC and case folding make of single characters, as far as the test tables' scripts go.
FOLDED = ", ".join(f"('{c}', '{f}')" for c in map(chr, [*range(0x80, 0x3100), *range(0xFF00, 0xFFF0)]) for f in [unicodedata.normalize("NFKC", c).casefold().replace("'", "''")] if f != c.lower())


def sql_squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SP}', ' ', 'g'), ' ')"


def sql_keys(*tables: str) -> str:
    """A CTE ``fq``: each question of some tables (q) with its folded form (k)."""
    asked = " UNION ".join(f"SELECT question AS q FROM {t}" for t in tables)
    chars = "regexp_extract_all(nfc_normalize(q), '(?s).')"
    return f"""nf(c, r) AS (VALUES {FOLDED}), qs AS (SELECT DISTINCT q FROM ({asked}) WHERE q IS NOT NULL),
ch AS (SELECT q, unnest({chars}) AS c, unnest(range(len({chars}))) AS i FROM qs),
fq AS (SELECT q, nfc_normalize(coalesce(string_agg(coalesce(r, lower(c)), '' ORDER BY i), '')) AS k FROM qs LEFT JOIN ch USING (q) LEFT JOIN nf USING (c) GROUP BY q)"""


def sql_plain(x: str) -> str:
    once = "regexp_replace({}, '(^|[^\\p{{L}}\\p{{N}}_])(a|an|the)($|[^\\p{{L}}\\p{{N}}_])', '\\1 \\3', 'g')"
    return sql_squeeze(once.format(once.format(f"translate({x}, '{PUNCT}', '')")))


def sql_answer(x: str) -> str:
    return sql_plain(f"lower({x})")


def sql_line(x: str) -> str:
    line = f"regexp_split_to_array(regexp_replace(regexp_replace({x}, '^{SP}', ''), '{SP}$', ''), '[\\n\\r]')[1]"
    return f"regexp_replace(regexp_replace({line}, '(?is)\\s*[;,:-]?\\s*question\\s*:.*$', ''), '[;\\s\\p{{Z}}\\x85\\x0b\\x1c-\\x1f]+$', '')"


REFS = "(SELECT stable_id, question, answer, aliases FROM qa_ref UNION ALL SELECT stable_id, question, answer, aliases FROM eval_item)"
SCORED = f"""
WITH r AS (SELECT stable_id, list_filter(list_transform(aliases, lambda a: {sql_answer('a')}), lambda a: a <> '') AS golds FROM {REFS}),
p AS (SELECT ordinal, stable_id, dataset, method, coefficient, {sql_answer(sql_line("coalesce(prediction, '')"))} AS answer FROM predictions),
b AS (SELECT p.*, golds, list_filter(string_split(answer, ' '), lambda w: w <> '') AS t FROM p JOIN r USING (stable_id)),
s AS (SELECT ordinal, stable_id, dataset, method, coefficient,
  CASE WHEN list_contains(golds, answer) THEN 1.0::DOUBLE ELSE 0 END AS em,
  coalesce(list_max(list_transform(golds, lambda g: CASE WHEN len(t) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * coalesce(list_sum(list_transform(list_distinct(list_filter(t, lambda w: list_contains(string_split(g, ' '), w))),
    lambda w: least(len(list_filter(t, lambda v: v = w)), len(list_filter(string_split(g, ' '), lambda v: v = w))))), 0) / (len(t) + len(string_split(g, ' '))) END)), 0.0::DOUBLE) AS f1,
  CASE WHEN len(list_filter(golds, lambda g: contains(answer, g))) > 0 THEN 1.0::DOUBLE ELSE 0 END AS containment FROM b)
"""


def references(spark: SparkSession, data: str) -> DataFrame:
    cols = ["stable_id", "question", "answer", "aliases"]
    return table(spark, data, "qa_ref").select(*cols).union(table(spark, data, "eval_item").select(*cols))


def scores(spark: SparkSession, data: str) -> DataFrame:
    return S.scored(table(spark, data, "predictions"), references(spark, data))


def tally(spark: SparkSession, data: str) -> DataFrame:
    """Scores of distinct answers with how often each was given; all tables of means are made from it."""
    return S.tallied(table(spark, data, "predictions"), references(spark, data))


def cells(spark: SparkSession, data: str, *by: str) -> DataFrame:
    """Unrounded means."""
    return tally(spark, data).groupBy(*by).agg(F.sum("n").alias("n"), *[S.weighted(m).alias(m) for m in S.METRICS])


@query(SCORED + "SELECT ordinal, em, round(f1, 6) AS f1, containment FROM s")
def qa_scores(spark: SparkSession, data: str) -> DataFrame:
    return scores(spark, data).select("ordinal", "em", F.round("f1", 6).alias("f1"), "containment")


@query(SCORED + "SELECT dataset, method, coefficient, count(*) AS n, round(avg(em), 6) AS em, round(avg(f1), 6) AS f1, round(avg(containment), 6) AS containment FROM s GROUP BY ALL")
def qa_score_table(spark: SparkSession, data: str) -> DataFrame:
    return S.means(tally(spark, data), "dataset", "method", "coefficient")


OPEN, MULTI = ["nq", "webq", "triviaqa", "popqa"], ["hotpotqa"]


@query(SCORED + """, d AS (SELECT dataset, method, coefficient, avg(em) AS em, avg(f1) AS f1 FROM s GROUP BY ALL),
g(category, dataset, members) AS (VALUES ('open_domain', 'nq', 4), ('open_domain', 'webq', 4), ('open_domain', 'triviaqa', 4), ('open_domain', 'popqa', 4), ('multi_hop', 'hotpotqa', 1), ('mean', 'nq', 5), ('mean', 'webq', 5), ('mean', 'triviaqa', 5), ('mean', 'popqa', 5), ('mean', 'hotpotqa', 5))
SELECT method, coefficient, category, CASE WHEN count(em) = any_value(members) THEN round(avg(em), 6) END AS em, CASE WHEN count(f1) = any_value(members) THEN round(avg(f1), 6) END AS f1 FROM d JOIN g USING (dataset) GROUP BY ALL""")
def qa_category_means(spark: SparkSession, data: str) -> DataFrame:
    """Open-domain, multi-hop and all five datasets; a mean needs all its members."""
    return S.categories(cells(spark, data, "dataset", "method", "coefficient"), {"open_domain": OPEN, "multi_hop": MULTI, "mean": OPEN + MULTI}, ["em", "f1"], "method", "coefficient")


@query(SCORED + """SELECT coalesce(dataset, 'pooled') AS dataset, method, coefficient, count(*) AS n, round(avg(em), 6) AS em, round(avg(f1), 6) AS f1
FROM s GROUP BY GROUPING SETS ((dataset, method, coefficient), (method, coefficient))""")
def curves_cube(spark: SparkSession, data: str) -> DataFrame:
    """Each dataset and all of them pooled, by expansion before one partial aggregation."""
    t = tally(spark, data).select(F.explode(F.array("dataset", F.lit("pooled"))).alias("dataset"), "method", "coefficient", "n", *S.METRICS)
    return S.means(t, "dataset", "method", "coefficient").drop("containment")


@query(SCORED + """SELECT dataset, method, coefficient FROM (SELECT dataset, method, coefficient, row_number() OVER (PARTITION BY dataset, method ORDER BY round(avg(em), 12) DESC, round(avg(f1), 12) DESC, coefficient) AS k
FROM s WHERE coefficient IS NOT NULL GROUP BY dataset, method, coefficient) WHERE k = 1""")
def select_coefficient(spark: SparkSession, data: str) -> DataFrame:
    """The best coefficient of each dataset and method: greatest EM, then F1, then least coefficient."""
    return S.best_coefficient(cells(spark, data, "dataset", "method", "coefficient").where("coefficient is not null"), "dataset", "method")


@query(SCORED + """, d AS (SELECT dataset, method, coefficient, avg(em) AS em, avg(f1) AS f1 FROM s WHERE coefficient IS NOT NULL GROUP BY ALL)
SELECT method, coefficient FROM (SELECT method, coefficient, row_number() OVER (PARTITION BY method ORDER BY round(avg(em), 6) DESC, round(avg(f1), 6) DESC, coefficient) AS k FROM d GROUP BY method, coefficient) WHERE k = 1""")
def select_macro_coefficient(spark: SparkSession, data: str) -> DataFrame:
    """One coefficient for each method, by means in which every dataset has equal weight."""
    each = cells(spark, data, "dataset", "method", "coefficient").where("coefficient is not null")
    return S.best_coefficient(S.equal_means(each, ["em", "f1"], "method", "coefficient"), "method")


@query(SCORED + """, g AS (SELECT dataset, method, coefficient AS c, avg(em) AS em, avg(f1) AS f1 FROM s WHERE coefficient IS NOT NULL GROUP BY ALL),
n AS (SELECT *, lag(c) OVER w AS low, lead(c) OVER w AS high, row_number() OVER (PARTITION BY dataset, method ORDER BY round(em, 12) DESC, round(f1, 12) DESC, c) AS k FROM g WINDOW w AS (PARTITION BY dataset, method ORDER BY c))
SELECT dataset, method, m AS coefficient FROM (SELECT dataset, method, unnest([round((low + c) / 2, 10), round((c + high) / 2, 10)]) AS m FROM n WHERE k = 1) AS x WHERE m IS NOT NULL AND m NOT IN (SELECT c FROM g WHERE g.dataset = x.dataset AND g.method = x.method)""")
def refine_midpoints(spark: SparkSession, data: str) -> DataFrame:
    """Half-way between the best coefficient and its neighbours."""
    return S.midpoints(cells(spark, data, "dataset", "method", "coefficient").where("coefficient is not null"), "dataset", "method")


PAIRED = SCORED + """, pair AS (SELECT f.dataset, f.method, f.coefficient, f.stable_id, b.em AS base, f.em AS final, b.f1 AS base_f1, f.f1 AS final_f1
FROM (SELECT dataset, method, coefficient, stable_id, max(em) AS em, max(f1) AS f1 FROM s WHERE coefficient IS NOT NULL GROUP BY ALL) AS f
JOIN (SELECT stable_id, max(em) AS em, max(f1) AS f1 FROM s WHERE method = 'base' GROUP BY ALL) AS b USING (stable_id))
"""


def paired(spark: SparkSession, data: str) -> DataFrame:
    """The base system beside every other with a coefficient, by question; of answers sent again the best counts."""
    s = tally(spark, data)
    f = s.where("coefficient is not null").groupBy("dataset", "method", "coefficient", "stable_id").agg(F.max("em").alias("final"), F.max("f1").alias("final_f1"))
    b = s.where("method = 'base'").groupBy("stable_id").agg(F.max("em").alias("base"), F.max("f1").alias("base_f1"))
    return f.join(b, "stable_id")


TRANSITIONS = """count_if(base = 0 AND final = 1)::BIGINT AS correction, count_if(base = 1 AND final = 0)::BIGINT AS harm, count_if(base = 1 AND final = 1)::BIGINT AS preserved, count_if(base = 0 AND final = 0)::BIGINT AS still_wrong"""


RATES = """round(correction / nullif(correction + still_wrong, 0), 6) AS correction_rate, round(harm / nullif(harm + preserved, 0), 6) AS harm_rate, round(preserved / nullif(harm + preserved, 0), 6) AS preservation_rate,
round(correction / n, 6) AS correction_contribution, round(harm / n, 6) AS harm_contribution, round((correction - harm) / n, 6) AS net_em, round((harm + preserved) / n, 6) AS base_em, round((correction + preserved) / n, 6) AS final_em"""


@query(PAIRED + f"""SELECT dataset, method, coefficient, correction, harm, preserved, still_wrong, {RATES} FROM (SELECT dataset, method, coefficient, count(*) AS n, {TRANSITIONS} FROM pair GROUP BY ALL)""")
def transitions(spark: SparkSession, data: str) -> DataFrame:
    return S.transitions(paired(spark, data), "dataset", "method", "coefficient")


@query(PAIRED + f""", t AS (SELECT dataset, method, coefficient, count(*) AS n, {TRANSITIONS}, avg(final_f1 - base_f1) AS d_f1 FROM pair GROUP BY ALL), rr AS (SELECT dataset, method, coefficient, d_f1, {RATES} FROM t),
m AS (SELECT method, coefficient, count(*) AS datasets, count(correction_rate) AS a, count(harm_rate) AS b, avg(correction_rate) AS c, avg(harm_rate) AS h, avg(preservation_rate) AS p, avg(net_em) AS e, avg(d_f1) AS f FROM rr GROUP BY ALL)
SELECT method, coefficient, datasets, CASE WHEN a = datasets THEN round(c, 6) END AS repair_rate, CASE WHEN b = datasets THEN round(h, 6) END AS harm_rate, CASE WHEN b = datasets THEN round(p, 6) END AS preservation_rate, round(e, 6) AS delta_em, round(f, 6) AS delta_f1 FROM m""")
def repair_summary(spark: SparkSession, data: str) -> DataFrame:
    """Means over datasets of repair, harm and preservation rates; a rate that one dataset hasn't got is null."""
    p = paired(spark, data)
    t = S.transitions(p, "dataset", "method", "coefficient")
    f = p.groupBy(*[F.col(c).alias(f"_{c}") for c in S.CELL]).agg(F.avg(F.col("final_f1") - F.col("base_f1")).alias("delta_f1"))
    both = t.join(f, (F.col("dataset") == F.col("_dataset")) & (F.col("method") == F.col("_method")) & (F.col("coefficient") == F.col("_coefficient")))
    named = both.select("method", "coefficient", F.col("correction_rate").alias("repair_rate"), "harm_rate", "preservation_rate", F.col("net_em").alias("delta_em"), "delta_f1")
    return S.equal_means(named, ["repair_rate", "harm_rate", "preservation_rate", "delta_em", "delta_f1"], "method", "coefficient")


@query(PAIRED + """SELECT method, coefficient, round(avg(d_em), 6) AS delta_em, round(avg(d_f1), 6) AS delta_f1, count(*) AS datasets FROM
(SELECT dataset, method, coefficient, avg(final - base) AS d_em, avg(final_f1 - base_f1) AS d_f1 FROM pair GROUP BY ALL) GROUP BY ALL""")
def equal_dataset_macro(spark: SparkSession, data: str) -> DataFrame:
    cells = paired(spark, data).groupBy("dataset", "method", "coefficient").agg(F.avg(F.col("final") - F.col("base")).alias("e"), F.avg(F.col("final_f1") - F.col("base_f1")).alias("f"))
    return cells.groupBy("method", "coefficient").agg(F.round(F.avg("e"), 6).alias("delta_em"), F.round(F.avg("f"), 6).alias("delta_f1"), F.count("*").alias("datasets"))


@query(PAIRED + """, c AS (SELECT method, coefficient, round(avg(final), 9) AS em FROM pair GROUP BY ALL)
SELECT a.method AS method_a, b.method AS method_b, a.coefficient, round(b.em - a.em, 6) AS difference FROM c AS a JOIN c AS b USING (coefficient) WHERE a.method < b.method""")
def pair_differences(spark: SparkSession, data: str) -> DataFrame:
    c = paired(spark, data).groupBy("method", "coefficient").agg(F.round(F.avg("final"), 9).alias("em"))
    a, b = c.select(F.col("method").alias("method_a"), "coefficient", F.col("em").alias("x")), c.select(F.col("method").alias("method_b"), "coefficient", F.col("em").alias("y"))
    return a.join(b, "coefficient").where("method_a < method_b").select("method_a", "method_b", "coefficient", F.round(F.col("y") - F.col("x"), 6).alias("difference"))


@query(f"""SELECT stable_id, 'missing' AS what FROM (SELECT DISTINCT stable_id FROM {REFS}) WHERE stable_id NOT IN (SELECT stable_id FROM predictions WHERE stable_id IS NOT NULL)
UNION ALL SELECT stable_id, 'extra' FROM (SELECT DISTINCT stable_id FROM predictions) WHERE stable_id NOT IN (SELECT stable_id FROM {REFS})""")
def prediction_coverage(spark: SparkSession, data: str) -> DataFrame:
    return S.missing_and_extra(table(spark, data, "predictions"), references(spark, data))


@query(SCORED + f"SELECT method, coefficient, count(DISTINCT stable_id) AS scored, (SELECT count(*) FROM {REFS}) AS total, round(count(DISTINCT stable_id) / (SELECT count(*) FROM {REFS}), 6) AS fraction FROM s GROUP BY ALL")
def scored_fraction(spark: SparkSession, data: str) -> DataFrame:
    return S.coverage(tally(spark, data), references(spark, data))


PROPERTY = "(SELECT stable_id, json_extract_string(metadata, '$.property') AS relation FROM qa_ref WHERE json_extract_string(metadata, '$.property') IS NOT NULL)"


@query(SCORED + f"SELECT relation, method, count(*) AS n, round(avg(em), 6) AS em, round(avg(f1), 6) AS f1, round(avg(containment), 6) AS containment FROM s JOIN {PROPERTY} USING (stable_id) GROUP BY ALL")
def relation_slices(spark: SparkSession, data: str) -> DataFrame:
    r = table(spark, data, "qa_ref").select("stable_id", F.get_json_object("metadata", "$.property").alias("relation")).where("relation is not null")
    return S.means(tally(spark, data).join(r, "stable_id"), "relation", "method")


@query(f"SELECT ordinal, list_transform(list_filter(list_zip(l, range(1, len(l) + 1)), lambda z: list_position(l, z[1]) = z[2]), lambda z: z[1]) AS aliases FROM (SELECT ordinal, list_filter(list_transform(aliases, lambda a: regexp_replace(regexp_replace(a, '^{SP}', ''), '{SP}$', '')), lambda a: a <> '') AS l FROM qa_ref)")
def alias_normalize(spark: SparkSession, data: str) -> DataFrame:
    return table(spark, data, "qa_ref").select("ordinal", X.clean_list(F.col("aliases")).alias("aliases"))


@query(f"WITH {sql_keys('qa_ref')} SELECT ordinal, {sql_answer('answer')} AS answer_text, {sql_squeeze('k')} AS weak_key, {sql_plain('k')} AS strong_key FROM qa_ref LEFT JOIN fq ON question = q")
def normalize_keys(spark: SparkSession, data: str) -> DataFrame:
    return table(spark, data, "qa_ref").select("ordinal", X.answer_text(F.col("answer")).alias("answer_text"), X.weak_key(F.col("question")).alias("weak_key"), X.strong_key(F.col("question")).alias("strong_key"))


@query(f"SELECT ordinal, {sql_line('prediction')} AS answer, trim(CASE WHEN contains(prediction, chr(10) || 'Question:') THEN split_part(prediction, chr(10) || 'Question:', 1) ELSE split_part(prediction, chr(10), 1) END, ' ') AS first_line FROM predictions")
def sanitize_prediction(spark: SparkSession, data: str) -> DataFrame:
    return table(spark, data, "predictions").select("ordinal", X.first_line_answer(F.col("prediction")).alias("answer"), X.before_question(F.col("prediction")).alias("first_line"))


POP = """WITH m AS (SELECT stable_id, CAST(json_extract_string(metadata, '$.subject_popularity') AS BIGINT) AS pop FROM qa_ref),
q AS (SELECT stable_id, pop, least(3, (row_number() OVER (ORDER BY pop, stable_id) - 1) * 4 // count(*) OVER ()) AS quartile FROM m WHERE pop IS NOT NULL)"""


@query(POP + " SELECT quartile, count(*) AS n, min(pop) AS low, max(pop) AS high FROM q GROUP BY quartile")
def popularity_quartiles(spark: SparkSession, data: str) -> DataFrame:
    return quartiles(spark, data).groupBy("quartile").agg(F.count("*").alias("n"), F.min("pop").alias("low"), F.max("pop").alias("high"))


def quartiles(spark: SparkSession, data: str) -> DataFrame:
    """(stable_id, pop, quartile): four equal parts by popularity, ties by id. Popularities are counted, and the counts summed
    in order by two levels; only the rows of the at most three popularities that a border cuts are ranked by id."""
    pop = F.get_json_object("metadata", "$.subject_popularity").cast("bigint")
    rows = table(spark, data, "qa_ref").select("stable_id", pop.alias("pop")).where("pop is not null")
    at = sequence.running(rows.groupBy("pop").agg(F.count("*").alias("k")), F.col("k"), "pop", "before")
    total = rows.agg(F.count("*").alias("total"))
    part = lambda i: F.least(F.lit(3), F.floor(i * 4 / F.col("total"))).cast("bigint")
    marked = at.crossJoin(F.broadcast(total)).select("pop", "before", "total", part(F.col("before")).alias("first"), part(F.col("before") + F.col("k") - 1).alias("last"))
    both = rows.join(marked, "pop")
    inside = both.where("first = last").select("stable_id", "pop", F.col("first").alias("quartile"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("pop").orderBy("stable_id")) - 1
    return inside.union(both.where("first < last").withColumn("rank", rank).select("stable_id", "pop", part(F.col("rank"))))


@query(SCORED + ", " + POP[5:] + " SELECT quartile, method, count(*) AS n, round(avg(em), 6) AS em, round(avg(f1), 6) AS f1, round(avg(containment), 6) AS containment FROM q JOIN s USING (stable_id) GROUP BY ALL")
def quartile_scores(spark: SparkSession, data: str) -> DataFrame:
    """Quartiles of all references, scores of those answered."""
    return S.means(tally(spark, data).join(quartiles(spark, data).select("stable_id", "quartile"), "stable_id"), "quartile", "method")


@query(f"SELECT method, count(*) AS n, count_if(regexp_matches(a, '^yes($|[^\\p{{L}}\\p{{N}}_])'))::BIGINT AS yes, count_if(regexp_matches(a, '^no($|[^\\p{{L}}\\p{{N}}_])'))::BIGINT AS no FROM (SELECT method, {sql_answer('prediction')} AS a FROM predictions) GROUP BY method")
def binary_prefixes(spark: SparkSession, data: str) -> DataFrame:
    first = X.yes_no_prefix(F.col("prediction"))
    return table(spark, data, "predictions").groupBy("method").agg(F.count("*").alias("n"), F.count_if(first == "yes").alias("yes"), F.count_if(first == "no").alias("no"))


NLL = "WITH n AS (SELECT dataset, method, coefficient, list_sum(token_nll) AS s, len(token_nll) AS k FROM (SELECT DISTINCT stable_id, dataset, method, coefficient, token_nll FROM nll) WHERE token_nll IS NOT NULL AND len(token_nll) > 0 AND len(list_filter(token_nll, lambda x: x IS NULL)) = 0)"


def nll_rows(spark: SparkSession, data: str) -> DataFrame:
    """Rows sent again count once; rows with null arrays or elements don't count."""
    n = table(spark, data, "nll").select("stable_id", "dataset", "method", "coefficient", "token_nll").distinct()
    n = n.where(F.col("token_nll").isNotNull() & (F.size("token_nll") > 0) & ~F.exists("token_nll", lambda x: x.isNull()))
    return n.withColumn("s", F.aggregate("token_nll", F.lit(0.0), lambda a, x: a + x)).withColumn("k", F.size("token_nll"))


@query(NLL + " SELECT dataset, method, coefficient, count(*) AS n, round(exp(sum(s) / sum(k)), 6) AS perplexity FROM n GROUP BY ALL")
def perplexity_by_dataset(spark: SparkSession, data: str) -> DataFrame:
    return nll_rows(spark, data).groupBy("dataset", "method", "coefficient").agg(F.count("*").alias("n"), F.round(F.exp(F.sum("s") / F.sum("k")), 6).alias("perplexity"))


@query(NLL + """ SELECT method, coefficient, round(avg(exp(l)), 6) AS mean_perplexity, round(exp(avg(l)), 6) AS macro_perplexity, round(exp(sum(s) / sum(k)), 6) AS pooled_perplexity
FROM (SELECT dataset, method, coefficient, sum(s) / sum(k) AS l, sum(s) AS s, sum(k) AS k FROM n GROUP BY ALL) GROUP BY ALL""")
def macro_pooled_summary(spark: SparkSession, data: str) -> DataFrame:
    cells = nll_rows(spark, data).groupBy("dataset", "method", "coefficient").agg(F.sum("s").alias("s"), F.sum("k").alias("k")).withColumn("l", F.col("s") / F.col("k"))
    return cells.groupBy("method", "coefficient").agg(F.round(F.avg(F.exp("l")), 6).alias("mean_perplexity"), F.round(F.exp(F.avg("l")), 6).alias("macro_perplexity"), F.round(F.exp(F.sum("s") / F.sum("k")), 6).alias("pooled_perplexity"))


ARMS = NLL.replace("SELECT dataset, method", "SELECT stable_id, token_nll, dataset, method") + f""", {sql_keys('qa_ref')},
b AS (SELECT stable_id, min(dataset) AS dataset, min(token_nll) AS b FROM n WHERE method = 'base' GROUP BY stable_id), a AS (SELECT stable_id, min(token_nll) AS a FROM n WHERE method = 'lora' GROUP BY stable_id),
t AS (SELECT stable_id, dataset, unnest(b) AS b, unnest(a) AS a FROM b JOIN a USING (stable_id) WHERE len(a) = len(b)), g AS (SELECT stable_id, {sql_squeeze('k')} AS cluster FROM qa_ref JOIN fq ON question = q),
u AS (SELECT *, exp(-b) AS p FROM t JOIN g USING (stable_id))"""


@query(ARMS + """ SELECT dataset, (p >= 0.01)::INT + (p >= 0.1)::INT + (p >= 0.5)::INT + (p >= 0.9)::INT AS bin, count(*) AS tokens, count(DISTINCT stable_id) AS rows, count(DISTINCT cluster) AS clusters, round(sum(b), 4) AS base_nll, round(sum(a), 4) AS arm_nll, count_if(a < b)::BIGINT AS improved, count_if(a > b)::BIGINT AS worsened FROM u GROUP BY ALL""")
def token_bins(spark: SparkSession, data: str) -> DataFrame:
    """Tokens by the base's probability: where another arm improves and worsens."""
    n = nll_rows(spark, data)
    one = lambda m, c: n.where(F.col("method") == m).groupBy("stable_id").agg(F.min("token_nll").alias(c), F.min("dataset").alias(f"{c}_dataset"))
    both = one("base", "b").join(one("lora", "a"), "stable_id").where(F.size("a") == F.size("b"))
    keys = table(spark, data, "qa_ref").select("stable_id", X.weak_key(F.col("question")).alias("cluster"))
    t = both.join(keys, "stable_id").select("stable_id", F.col("b_dataset").alias("dataset"), "cluster", F.explode(F.arrays_zip("b", "a")).alias("x")).select("stable_id", "dataset", "cluster", "x.b", "x.a")
    edge = sum(((F.exp(-F.col("b")) >= e).cast("int") for e in (0.01, 0.1, 0.5, 0.9)), F.lit(0))
    return t.groupBy("dataset", edge.alias("bin")).agg(F.count("*").alias("tokens"), F.countDistinct("stable_id").alias("rows"), F.countDistinct("cluster").alias("clusters"), F.round(F.sum("b"), 4).alias("base_nll"), F.round(F.sum("a"), 4).alias("arm_nll"), F.count_if(F.col("a") < F.col("b")).alias("improved"), F.count_if(F.col("a") > F.col("b")).alias("worsened"))


@query("SELECT dataset, method, coefficient, count(*) AS rows, count_if(token_nll IS NULL)::BIGINT AS no_array, count_if(len(list_filter(token_nll, lambda x: x IS NULL OR x < 0)) > 0)::BIGINT AS bad_element, count_if(len(token_nll) <> token_count)::BIGINT AS wrong_count FROM nll GROUP BY ALL")
def nll_validity(spark: SparkSession, data: str) -> DataFrame:
    t = F.col("token_nll")
    return table(spark, data, "nll").groupBy("dataset", "method", "coefficient").agg(F.count("*").alias("rows"), F.count_if(t.isNull()).alias("no_array"), F.count_if(F.coalesce(F.exists(t, lambda x: x.isNull() | (x < 0)), F.lit(False))).alias("bad_element"), F.count_if(F.size(t) != F.col("token_count")).alias("wrong_count"))


DRIFT = """WITH b AS (SELECT stable_id, min_by(output_ids, ordinal) AS x FROM predictions WHERE method = 'base' AND output_ids IS NOT NULL GROUP BY 1),
l AS (SELECT stable_id, min_by(output_ids, ordinal) AS y FROM predictions WHERE method = 'lora' AND output_ids IS NOT NULL GROUP BY 1),
d AS (SELECT coalesce((SELECT min(i) FROM unnest(range(0, greatest(len(x), len(y)))) AS r(i) WHERE x[i + 1] IS DISTINCT FROM y[i + 1])::VARCHAR, 'identical') AS first_difference FROM b JOIN l USING (stable_id))"""


@query(DRIFT + " SELECT first_difference, count(*) AS n FROM d GROUP BY ALL")
def drift(spark: SparkSession, data: str) -> DataFrame:
    from quillarn.functions.arrays import first_difference

    p = table(spark, data, "predictions").where("output_ids is not null")
    first = lambda m, c: p.where(F.col("method") == m).groupBy("stable_id").agg(F.min_by("output_ids", "ordinal").alias(c))
    d = first("base", "x").join(first("lora", "y"), "stable_id")
    return d.groupBy(F.coalesce(first_difference(F.col("x"), F.col("y")).cast("string"), F.lit("identical")).alias("first_difference")).agg(F.count("*").alias("n"))


@query(f"WITH {sql_keys('qa_ref')} SELECT key, list_sort(list_distinct(list(dataset))) AS datasets, count(*) AS rows FROM (SELECT dataset, {sql_squeeze('k')} AS key FROM qa_ref JOIN fq ON question = q) WHERE key <> '' GROUP BY key HAVING count(*) > 1")
def question_clusters(spark: SparkSession, data: str) -> DataFrame:
    q = table(spark, data, "qa_ref").select("dataset", X.weak_key(F.col("question")).alias("key")).where("key <> ''")
    return q.groupBy("key").agg(F.array_sort(F.collect_set("dataset")).alias("datasets"), F.count("*").alias("rows")).where("rows > 1")


@query()
def cluster_bootstrap(spark: SparkSession, data: str) -> DataFrame:
    """The mean EM of each method with its interval over question clusters: questions that agree in ``weak_key``. A blank
    question is a cluster by its id."""
    from quillarn.operators.bootstrap import cluster_bootstrap as boot

    key = F.coalesce(F.nullif(X.weak_key(F.col("question")), F.lit("")), F.concat(F.lit("\n"), "stable_id"))
    keys = references(spark, data).select("stable_id", key.alias("cluster")).groupBy("stable_id").agg(F.min("cluster").alias("cluster"))
    return boot(scores(spark, data).select("stable_id", "method", "em").join(keys, "stable_id"), "method", "cluster", "em", draws=2000)
