"""The registry of the subpackage's queries and SQL."""
from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillarn.llm import defects as _defects
from quillarn.llm import duplicates as _duplicates
from quillarn.llm import encode as _encode
from quillarn.llm import groups as _groups
from quillarn.llm import leaks as _leaks
from quillarn.llm import lookalike as _lookalike
from quillarn.llm import mix as _mix
from quillarn.llm import mojibake as _mojibake
from quillarn.llm import overlap as _overlap
from quillarn.llm import split as _split
from quillarn.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query()
def p8_ids(spark: SparkSession, data: str) -> DataFrame:
    return _encode.encode(table(spark, data, "documents"))


@query("SELECT doc_id, coalesce(text, '') AS text FROM documents")
def p8_decoded(spark: SparkSession, data: str) -> DataFrame:
    """Each text as its ids give it back."""
    return _encode.decode(_encode.encode(table(spark, data, "documents")))


_WORDS = r"""list_filter(regexp_split_to_array(replace(lower(regexp_replace({}, '</?[A-Za-z][^<>]*>|<\|[^<>|]*\|>|&#?\w{{1,8}};|\]\([^()\s]*\)', ' ', 'g')), 'ß', 'ss'), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"""


@query(f"""
WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents WHERE doc_id IS NOT NULL),
dw AS (SELECT doc_id, w[i : i + 11] AS g FROM d, unnest(range(1, len(w) - 10)) AS r(i)),
e AS (SELECT item_id, {_WORDS.format('question')} AS w FROM eval_item UNION ALL SELECT item_id, {_WORDS.format('context')} FROM eval_item),
ew AS (SELECT DISTINCT item_id, w[i : i + 11] AS g FROM e, unnest(range(1, len(w) - 10)) AS r(i))
SELECT DISTINCT doc_id, item_id FROM dw JOIN ew USING (g)
""")
def p1_found(spark: SparkSession, data: str) -> DataFrame:
    return _leaks.leaks(table(spark, data, "documents"), table(spark, data, "eval_item"))


@query()
def p1_near(spark: SparkSession, data: str) -> DataFrame:
    """Also windows of 16 words with one word changed."""
    return _leaks.leaks(table(spark, data, "documents"), table(spark, data, "eval_item"), words=16, edits=1)


@query("SELECT doc_id FROM documents WHERE length(text) > 2000")
def p2_found(spark: SparkSession, data: str) -> DataFrame:
    return _split.pieces(table(spark, data, "documents")).where("piece = 0").select("doc_id")


@query()
def p2_pieces(spark: SparkSession, data: str) -> DataFrame:
    return _split.pieces(table(spark, data, "documents"))


@query("SELECT doc_id, text FROM documents WHERE length(text) > 2000")
def p2_rebuilt(spark: SparkSession, data: str) -> DataFrame:
    """Each long text from its pieces without their overlaps: nothing is lost and nothing doubled."""
    new = F.struct("piece", F.expr("substring(text, fresh - start + 1, length(text))").alias("new"))
    parts = _split.pieces(table(spark, data, "documents")).groupBy("doc_id").agg(F.array_sort(F.collect_list(new)).alias("p"))
    return parts.select("doc_id", F.array_join(F.col("p.new"), "").alias("text"))


_FOLD = "replace(replace(lower({}), 'ß', 'ss'), 'ς', 'σ')"
_BARE = f"regexp_replace({_FOLD}, '[\\p{{{{P}}}}$+<=>^`|~\\s\\p{{{{Z}}}}\\x85]+', '', 'g')"
_NAME = f"nullif(regexp_replace({_FOLD}, '[_\\s\\p{{{{Z}}}}\\x85]+', '', 'g'), '')"
_GROUPS = f"""
WITH RECURSIVE k AS (
  SELECT stable_id, split, 't' || {_NAME.format('source_title')} AS t, 's' || {_NAME.format('subject')} AS s, 'q' || nullif({_BARE.format('question')}, '') AS q FROM calibration),
n AS (SELECT stable_id, split, unnest(list_filter([t, s, q], lambda x: x IS NOT NULL)) AS key, coalesce(t, s, q) AS head FROM k),
e AS (SELECT DISTINCT head AS a, key AS b FROM n),
l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(a, b) AS (SELECT a, a FROM l UNION SELECT r.a, l.b FROM reach AS r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS comp FROM reach GROUP BY a),
g AS (SELECT DISTINCT n.stable_id, n.split, c.comp FROM n JOIN c ON n.head = c.a)
"""


@query(_GROUPS + """
SELECT stable_id FROM g WHERE comp IN (SELECT comp FROM g GROUP BY comp HAVING count(DISTINCT split) > 1)
""")
def p3_found(spark: SparkSession, data: str) -> DataFrame:
    return _groups.torn(_groups.grouped(table(spark, data, "calibration"))).select("stable_id")


@query()
def p3_assignment(spark: SparkSession, data: str) -> DataFrame:
    return _groups.assign(_groups.grouped(table(spark, data, "calibration")))


@query()
def p3_shares(spark: SparkSession, data: str) -> DataFrame:
    return _groups.shares_of(_groups.assign(_groups.grouped(table(spark, data, "calibration"))))


_CANON = f"""
WITH m AS (SELECT ordinal, list_sort(list_transform(json_keys(metadata), lambda j: {_BARE.format('j')} || chr(2) || coalesce({_BARE.format("json_extract_string(metadata, '$." + chr(34) + "' || j || '" + chr(34) + "')")}, chr(1)))) AS f FROM qa_ref),
c AS (SELECT q.ordinal, struct_pack(d := {_BARE.format('dataset')}, q := {_BARE.format('question')}, a := {_BARE.format('answer')},
  l := list_transform(aliases, lambda x: {_BARE.format('x')}), f := m.f) AS key FROM qa_ref AS q JOIN m USING (ordinal))
"""


@query(_CANON + """
SELECT least AS ordinal_a, ordinal AS ordinal_b FROM (SELECT ordinal, min(ordinal) OVER (PARTITION BY key) AS least FROM c) WHERE ordinal > least
""")
def p4_found(spark: SparkSession, data: str) -> DataFrame:
    return _duplicates.pairs(table(spark, data, "qa_ref"))


@query(_CANON + "SELECT min(ordinal) AS ordinal, count(*) AS copies FROM c GROUP BY key")
def p4_copies(spark: SparkSession, data: str) -> DataFrame:
    return _duplicates.groups(table(spark, data, "qa_ref"))


@query(_CANON + "SELECT q.*, g.copies FROM qa_ref AS q JOIN (SELECT min(ordinal) AS ordinal, count(*) AS copies FROM c GROUP BY key) AS g ON q.ordinal = g.ordinal")
def p4_records(spark: SparkSession, data: str) -> DataFrame:
    return _duplicates.collapsed(table(spark, data, "qa_ref"))


@query()
def p10_found(spark: SparkSession, data: str) -> DataFrame:
    return _mojibake.restored(table(spark, data, "documents")).select("doc_id")


@query()
def p10_restored(spark: SparkSession, data: str) -> DataFrame:
    return _mojibake.restored(table(spark, data, "documents"))


def _forms() -> str:
    """What single characters of the test tables' scripts are in the one form, as rows of SQL."""
    latin = {c: x for x, others in _lookalike.LOOKS.items() for c in others}
    rows = []
    for c in map(chr, [*range(0x80, 0x3100), *range(0xFF00, 0xFFF0)]):
        parts = unicodedata.normalize("NFD", "".join(_lookalike._open(x) for x in unicodedata.normalize("NFD", c)))
        form = unicodedata.normalize("NFC", "".join(latin.get(x, x) for x in parts))
        if form != c:
            rows.append("('{}', '{}')".format(c, form.replace("'", "''")))
    return ", ".join(rows)


_READ = rf"""WITH fm(c, r) AS (VALUES {_forms()}), refs AS (SELECT stable_id, aliases FROM qa_ref UNION ALL SELECT stable_id, aliases FROM eval_item),
texts AS (SELECT DISTINCT t FROM (SELECT prediction AS t FROM predictions UNION ALL SELECT unnest(aliases) FROM refs) WHERE t IS NOT NULL),
seen AS (SELECT t, nfc_normalize(regexp_replace(t, '[\p{{Cf}}\x{{34f}}\x{{115f}}\x{{1160}}\x{{17b4}}\x{{17b5}}\x{{3164}}\x{{ffa0}}\x{{fe00}}-\x{{fe0f}}\x{{e0100}}-\x{{e01ef}}]', '', 'g')) AS u FROM texts),
ch AS (SELECT t, unnest(regexp_extract_all(u, '(?s).')) AS c, unnest(range(len(regexp_extract_all(u, '(?s).')))) AS i FROM seen),
forms AS (SELECT t, trim(regexp_replace(nfc_normalize(string_agg(coalesce(r, c), '' ORDER BY i)), '[\s\p{{Z}}]+', ' ', 'g'), ' ') AS f FROM ch LEFT JOIN fm USING (c) GROUP BY t),
known AS (SELECT DISTINCT stable_id, a, f FROM (SELECT stable_id, unnest(aliases) AS a FROM refs) JOIN forms ON a = t)
SELECT ordinal FROM predictions AS p JOIN forms ON prediction = t WHERE f <> '' AND EXISTS (SELECT 1 FROM known AS k WHERE k.stable_id = p.stable_id AND k.f = forms.f) AND NOT EXISTS (SELECT 1 FROM known AS k WHERE k.stable_id = p.stable_id AND k.a = p.prediction)"""


@query(_READ)
def p5_found(spark: SparkSession, data: str) -> DataFrame:
    return _lookalike.same_reading(table(spark, data, "predictions"), [table(spark, data, "qa_ref"), table(spark, data, "eval_item")])


@query()
def p5_predictions(spark: SparkSession, data: str) -> DataFrame:
    return _lookalike.found(table(spark, data, "predictions"), [table(spark, data, "qa_ref"), table(spark, data, "eval_item")])[0]


@query()
def p5_aliases(spark: SparkSession, data: str) -> DataFrame:
    return _lookalike.found(table(spark, data, "predictions"), [table(spark, data, "qa_ref"), table(spark, data, "eval_item")])[1]


def _refs(spark: SparkSession, data: str) -> list[DataFrame]:
    return [table(spark, data, "qa_ref"), table(spark, data, "eval_item")]


@query()
def p6_found(spark: SparkSession, data: str) -> DataFrame:
    return _defects.defects(table(spark, data, "predictions"), _refs(spark, data), table(spark, data, "documents"))


@query()
def p7_found(spark: SparkSession, data: str) -> DataFrame:
    found = _overlap.overlaps(table(spark, data, "calibration"))
    return found.select(F.least("train_id", "eval_id").alias("stable_id_a"), F.greatest("train_id", "eval_id").alias("stable_id_b")).distinct()


@query()
def p7_coverage(spark: SparkSession, data: str) -> DataFrame:
    """The coverage of each overlap by record."""
    found = _overlap.overlaps(table(spark, data, "calibration"))
    return found.groupBy("train_id", "eval_id", "eval_split", "eval_dataset").agg(F.round(F.max("coverage"), 4).alias("coverage"))


@query()
def p7_report(spark: SparkSession, data: str) -> DataFrame:
    rows = table(spark, data, "calibration")
    return _overlap.report(_overlap.overlaps(rows), rows)


@query()
def p9_mix(spark: SparkSession, data: str) -> DataFrame:
    return _mix.mix(table(spark, data, "documents"), table(spark, data, "mix_target"))[0]


@query()
def p9_shares(spark: SparkSession, data: str) -> DataFrame:
    return _mix.mix(table(spark, data, "documents"), table(spark, data, "mix_target"))[1]
