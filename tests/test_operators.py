"""Golden examples and edge cases of the core operators."""
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillarn.functions import arrays as A
from quillarn.functions import text as X
from quillarn.operators import bm25, bootstrap, checks, models, normalise, policy, prompts, scope, scoring, sequence, skew, timing


def one(spark, col, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(col).first()[0]


# Texts


def test_strong_key(spark):
    assert one(spark, X.strong_key(F.col("x")), x=" Ｔhe,  A! Museum? ") == "museum"


@pytest.mark.parametrize("x", ["Straße", "ΌΣΟΣ", "ﬁne  Ⅳ", "İstanbul", "A B c", "é", "plain"])
def test_weak_key_is_nfkc_and_casefold(spark, x):
    import unicodedata

    assert one(spark, X.weak_key(F.col("x")), x=x) == " ".join(unicodedata.normalize("NFKC", x).casefold().split())


def test_weak_keys_of_questions_agree(spark):
    """A development question that stands in the test in other letter case and spacing is found."""
    df = spark.createDataFrame([("  WHO IS X? ", "dev"), ("who is x?", "test")], "q string, s string").select(X.weak_key(F.col("q")).alias("k"), "s")
    shared = df.where("s = 'dev'").join(df.where("s = 'test'").select("k"), "k", "left_semi")
    with pytest.raises(ValueError, match="overlap"):
        checks.insist(shared, "overlap")


def test_answers_of_generated_text(spark):
    assert one(spark, X.first_line_answer(F.col("x")), x="  Paris ; Question: who?\nmore") == "Paris"
    assert one(spark, X.before_question(F.col("x")), x="a\nb\nQuestion: c") == "a\nb"
    for x, y in (("a; question: b", "a"), ("\n x \nQUESTION : y", "x"), ("question: x", ""), ("a question: b", "a question: b"), ("a\nb", "a")):
        assert one(spark, X.decoder_answer(F.col("x")), x=x) == y


def test_yes_and_no(spark):
    for x, y in (("Yes, it is", "yes"), ("Norway", None), ("the NO.", "no"), ("yesterday", None), ("", None)):
        assert one(spark, X.yes_no_prefix(F.col("x")), x=x) == y
    assert one(spark, X.yes_no(F.col("x")), x="Yes!") == "yes" and one(spark, X.yes_no(F.col("x")), x="yes it is") is None


def test_regex_search(spark):
    df = spark.createDataFrame([("in 1999", r"(?:19|20)\d\d$"), ("PARIS", "^paris"), ("x", None), (None, "x"), ("x", "")], "t string, p string")
    assert [r[0] for r in df.select(X.regex_search(F.col("t"), F.col("p"))).collect()] == [True, True, False, False, False]


def test_labels(spark):
    for x, y in ((0.125, "pass0p125"), (0.5, "pass0p5"), (0.0078125, "pass0p0078125")):
        assert one(spark, X.pass_label(F.col("x")), x=x) == y
    with pytest.raises(Exception, match="fraction"):
        one(spark, X.pass_label(F.col("x")), x=1.0)
    assert [one(spark, X.coefficient_key(F.col("x")), x=x) for x in (0.0, 0.75, 1e-9, 1 / 3)] == ["0", "0.75", "1e-09", "0.33333333"]


def test_prefix_features(spark):
    f = X.prefix_features(F.col("x"))
    row = lambda x: [one(spark, c, x=x) for c in f.values()]
    assert row(" 1999 ") == [1, 1, 4, 1, 1] and row("  ") == [0, 0, 0, 0, 0] and row("a b") == [1, 2, 3, 0, 0]


def test_token_digest(spark):
    import hashlib

    ids = [1, 300, 70000]
    assert one(spark, X.token_digest(F.array(*map(F.lit, ids)))) == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_bucket(spark):
    assert one(spark, X.bucket(F.col("x"), "gate-partition-v1:"), x="abc") == 84


def test_clean_list(spark):
    df = spark.createDataFrame([(["a ", " ", "b", "a", None, " b\t"],), (None,)], "x array<string>")
    assert [r[0] for r in df.select(X.clean_list(F.col("x"))).collect()] == [["a", "b"], None]


# Arrays


def test_token_f1(spark):
    f = A.token_f1(F.split("p", " "), F.split("g", " "))
    assert one(spark, f, p="b b", g="b b c") == pytest.approx(0.8)


@pytest.mark.parametrize("a, b, at", [([1, 2], [1, 2], None), ([1, 2], [1, 3], 1), ([1], [1, 2], 1), ([], [], None)])
def test_first_difference(spark, a, b, at):
    df = spark.createDataFrame([(a, b)], "a array<int>, b array<int>")
    assert df.select(A.first_difference(F.col("a"), F.col("b"))).first()[0] == at
    d = A.sequence_drift(F.col("a"), F.col("b"))
    assert df.select(d["first_difference"]).first()[0] == at and df.select(d["longest"]).first()[0] == max(len(a), len(b))


def test_additive_fusion(spark):
    df = spark.createDataFrame([([1.0, 2.0], [0.25, -0.5])], "b array<double>, s array<double>")
    assert df.select(F.zip_with("b", "s", lambda x, y: x + y)).first()[0] == [1.25, 1.5]


def test_bf16(spark):
    values = np.array([0.0, 1.0, -2.5, 3e-39, 1e30], np.float32)
    bits = (values.view(np.uint32) >> 16).astype(int).tolist()
    df = spark.createDataFrame([(bits,), ([0x7F80],), ([0xFFC0],)], "b array<int>")
    got = df.select(A.bf16_values(F.col("b")).alias("v"), A.bf16_finite(F.col("b")).alias("f")).collect()
    expect = (np.array(bits, np.uint32) << 16).view(np.float32)
    assert np.allclose(got[0].v, expect, rtol=1e-12, atol=0) and [r.f for r in got] == [True, False, False]
    assert got[1].v == [math.inf] and math.isnan(got[2].v[0])


def test_indices_and_padding(spark):
    n = 10
    assert one(spark, A.even_indices(4, F.lit(n))) == [i * (n - 1) // 3 for i in range(4)]
    assert one(spark, A.even_indices(64, F.lit(3))) == [0, 1, 2]
    assert one(spark, A.cyclic(F.array(*map(F.lit, (5, 6, 7))), 8, 1)) == [1, 5, 6, 7, 5, 6, 7, 5]
    ids, mask = A.padded(F.array(F.lit(4), F.lit(5)), F.lit(4))
    assert one(spark, ids) == [0, 0, 4, 5] and one(spark, mask) == [0, 0, 1, 1]


def test_prompt_and_answer(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5], [8, 9]), ([7, 2, 3, 4, 5], [8, 9]), ([1], [8])], "p array<int>, a array<int>")
    made = A.prompt_and_answer(F.col("p"), F.col("a"), 5, 1)
    got = df.select(*[c.alias(k) for k, c in made.items()]).collect()
    assert [r.input_ids for r in got] == [[1, 4, 5, 8, 9], [3, 4, 5, 8, 9], [1, 8]] and [r.positions for r in got] == [[2, 3], [2, 3], [0]]
    with pytest.raises(Exception, match="room"):
        df.select(A.prompt_and_answer(F.col("p"), F.col("a"), 2, 1)["input_ids"]).collect()


def test_parameter_count():
    assert A.parameter_count(8, 4096, 14336, 32768) == 1_543_540_736


# Orders


def test_passages(spark):
    rows = [(0, "A", "a b c", True), (1, "A", "d e", True), (2, "A", "HIDDEN", False), (3, "A", "f g", True), (4, "B", "h i", True)]
    df = spark.createDataFrame(rows, "id bigint, title string, text string, keep boolean")
    got = sorted(sequence.passages(df, 4).collect(), key=lambda r: int(r.id))
    assert [(r.title, r.passage) for r in got] == [("A", "a b c d"), ("A", "e"), ("A", "f g"), ("B", "h i")]
    assert got[0].text == "A\na b c d" and [r.id for r in got] == ["0", "1", "2", "3"]
    with pytest.raises(ValueError, match="order"):
        sequence.passages(df.union(df))
    with pytest.raises(Exception, match="no title"):
        sequence.passages(df.withColumn("title", F.lit(" "))).collect()


def test_passages_after_a_gap(spark):
    df = spark.createDataFrame([(0, "A", "a b", True, True), (1, "A", "c d", True, False)], "id bigint, title string, text string, keep boolean, gap_after boolean")
    assert sorted(r.passage for r in sequence.passages(df, 4).collect()) == ["a b", "c d"]


def test_a_title_with_blanks_breaks_articles(spark):
    df = spark.createDataFrame([(0, "A ", "a", True), (1, "A ", "b", True)], "id bigint, title string, text string, keep boolean")
    assert sorted((r.title, r.passage) for r in sequence.passages(df, 4).collect()) == [("A", "a"), ("A", "b")]


def test_passages_over_ranges(spark):
    n = sequence.RANGE
    df = spark.range(n - 3, n + 3).select("id", F.lit("t").alias("title"), F.col("id").cast("string").alias("text"), F.lit(True).alias("keep"))
    assert sequence.passages(df, 100).first().passage == " ".join(map(str, range(n - 3, n + 3)))


def test_running_over_sparse_orders(spark, monkeypatch):
    """Hashed orders are cut into ranges by quantiles, not one for each row."""
    monkeypatch.setattr(sequence, "RANGE", 50)
    df = spark.range(1000).select(F.xxhash64("id").alias("o"), (F.col("id") % 7).alias("v"))
    assert df.select(sequence.ranges(df, "o")(F.col("o")).alias("r")).distinct().count() in range(10, 41)
    got = {r.o: r.s for r in sequence.running(df, F.col("v"), "o", "s").collect()}
    total = 0
    for r in sorted(df.collect()):
        assert got[r.o] == total
        total += r.v


def test_consecutive_batches(spark):
    ds = ["a"] * 5 + ["b"] * 2 + ["a"] * 3
    df = spark.createDataFrame([(i, d, f"s{i}") for i, d in enumerate(ds)], "ordinal bigint, dataset string, stable_id string")
    b = sequence.consecutive_batches(df, "ordinal", "dataset", 2)
    assert [r.batch for r in b.orderBy("ordinal").collect()] == [0, 0, 1, 1, 2, 3, 3, 4, 4, 5]
    g = sequence.batch_geometry(b.withColumn("n", F.lit(3)), 4, {"longest": "n"}).orderBy("batch").collect()
    assert [r["keys"] for r in g][:2] == [["s0", "s1"], ["s2", "s3"]] and [r.rank for r in g] == [0, 1, 2, 3, 0, 1] and len({r.digest for r in g}) == 6
    with pytest.raises(ValueError):
        sequence.block_cyclic(10, 4, 2)


def test_step_plan_against_a_walk(spark):
    rng = np.random.default_rng(1)
    segments = [(r, s, int(n)) for r in range(3) for s, n in enumerate(rng.integers(0, 9, 20))]
    df = spark.createDataFrame(segments, "rank int, segment int, n bigint")
    steps, expect = min(sum(n for r, _, n in segments if r == k) // 10 for k in range(3)), set()
    for k in range(3):
        tokens = [(s, i) for r, s, n in segments if r == k for i in range(n)]
        for step in range(steps):
            part = tokens[step * 10 : step * 10 + 10]
            for s in {s for s, _ in part}:
                mine = [i for t, i in part if t == s]
                expect.add((step, k, s, min(mine), max(mine) + 1))
    assert {tuple(r) for r in sequence.step_plan(df, 10).collect()} == expect
    where = {r["rank"]: (r["segment"], r["offset"]) for r in sequence.cursor(df, 25).collect()}
    assert where == {k: [(s, i) for r, s, n in segments if r == k for i in range(n)][25] for k in range(3)}


def test_positions():
    at = {"file_index": 3, "token_chunk_offset": 7, "rank_seen_tokens": 99}
    assert sequence.normal_position(1, 5, True, at) == {"start_epoch": 2, "epoch_step": 0, "cursor": {"file_index": 0, "token_chunk_offset": 0, "rank_seen_tokens": 99}}
    assert sequence.normal_position(1, 5, False, at) == {"start_epoch": 1, "epoch_step": 5, "cursor": at}


def test_resume(spark):
    df = spark.range(10, 15).withColumnRenamed("id", "row_ix")
    assert [r.row_ix for r in sequence.resume(df, 10, 2).orderBy("row_ix").collect()] == [12, 13, 14]
    with pytest.raises(Exception, match="pointer"):
        sequence.resume(df, 9, 2).collect()


def test_fill(spark):
    rows = [(0, "A", True), (1, "B", False), (2, "B", True), (3, "A", True), (4, "C", False), (5, "C", True), (6, "D", True), (7, "E", True)]
    df = spark.createDataFrame(rows, "rank bigint, title string, eligible boolean")
    got = {r["rank"]: r.role for r in sequence.fill(df, 2, 2).collect()}
    assert got == {0: "training", 1: "short", 2: "training", 3: "title", 4: "short", 5: "validation", 6: "validation"}
    with pytest.raises(Exception, match="too few"):
        sequence.fill(df, 2, 9).collect()


def test_schedules(spark):
    assert sequence.milestones([0.001, 0.002, 1.0], 100) == [(1, 0.002), (100, 1.0)]
    assert sequence.parse_fractions("0.5, 0.25,,0.5") == [0.25, 0.5] and sequence.FRACTIONS[0] == 1 / 128
    for bad in ("0", "1.5", "-1,1"):
        with pytest.raises(ValueError):
            sequence.parse_fractions(bad)
    lr = lambda s: one(spark, sequence.learning_rate(F.lit(s), 100))
    assert lr(1) == pytest.approx(5e-4 / 32) and lr(32) == pytest.approx(5e-4) and lr(100) == 5e-5
    assert [r.ordinal for r in sequence.permutation(spark, 20, 43).orderBy("position").collect()] == np.random.default_rng(43).permutation(20).tolist()
    assert sequence.held_out(1001).tolist() == np.random.default_rng(42).permutation(1001)[:3].tolist()


def test_boundaries_and_gaps(spark):
    df = spark.createDataFrame([(0,), (5,), (6,)], "s bigint")
    assert [(r.s, r.end) for r in sequence.boundaries(df, "s", 9).orderBy("s").collect()] == [(0, 5), (5, 6), (6, 9)]
    assert [r.s for r in sequence.not_following(df, "s").collect()] == [5]
    assert sequence.grid(a=[1, 2], b=["x"]) == [{"a": 1, "b": "x"}, {"a": 2, "b": "x"}]


# Source scope

ROWS = [[1, 10, 11], [1, 20, 21], [1, 30, 31], [1, 40, 41], [1, 50], [1, 60, 61], [1, 70, 71]]


def scoped(spark, rows, batches, block=4):
    r = spark.createDataFrame(list(enumerate(rows)), "ordinal bigint, tokens array<int>")
    b = spark.createDataFrame(list(enumerate(batches)), "batch int, tokens array<int>")
    return [x.keep for x in scope.align(r, b, block).orderBy("ordinal").collect()]


def test_scope(spark):
    flat = lambda a, b: sum(ROWS[a:b], [])
    assert scoped(spark, ROWS, [flat(0, 3)[:8], flat(3, 5)[:4], flat(5, 7)[:4]]) == [3, 3, 2, 3, 1, 3, 1]
    with pytest.raises(ValueError, match="token"):
        scoped(spark, ROWS[:2], [[1, 10, 99, 1]])


def test_scope_against_what_was_kept(spark):
    rng = np.random.default_rng(3)
    rows = [[1, *rng.integers(2, 9, rng.integers(1, 30)).tolist()] for _ in range(60)]
    batches, expect, at = [], [], 0
    while at < 60:
        stop = min(60, at + int(rng.integers(2, 9)))
        tokens = sum(rows[at:stop], [])
        k = len(tokens) // 16 * 16 or len(tokens)
        batches.append(tokens[:k])
        left = k
        for r in rows[at:stop]:
            expect.append(min(len(r), left))
            left -= expect[-1]
        at = stop
    assert scoped(spark, rows, batches, 16) == expect
    s = scope.scope_statistics(spark.createDataFrame([(len(r), k) for r, k in zip(rows, expect)], "n int, keep int")).first()
    assert s.retained == sum(expect) and s.dropped_records == expect.count(0)


# Scores


def test_transitions(spark):
    df = spark.createDataFrame(list(zip([0, 0, 1, 1, 0, 0], [1, 1, 0, 1, 0, 0])), "base int, final int")
    r = scoring.transitions(df.withColumn("g", F.lit(1)), "g").first()
    assert (r.correction, r.harm, r.preserved, r.still_wrong, r.correction_rate, r.harm_rate) == (2, 1, 1, 2, 0.5, 0.5)
    assert r.net_em == pytest.approx(1 / 6, abs=1e-6) and r.correction_contribution == pytest.approx(1 / 3, abs=1e-6)
    assert scoring.transitions(df.where("base = 0").withColumn("g", F.lit(1)), "g").first().harm_rate is None


def test_coefficient_of_equal_datasets(spark):
    """Datasets count alike, not their rows; of equal coefficients the least is taken."""
    scores = {0.1: [(1, 1)] * 3 + [(0, 0)], 0.2: [(1, 1), (0, 0), (0, 0), (1, 1)], 0.0: [(0, 0)] * 4}

    def select(s):
        rows = [(d, c, float(e), float(f)) for c, xs in s.items() for d, (e, f) in zip(["nq"] * 3 + ["triviaqa"], xs)]
        each = spark.createDataFrame(rows, "dataset string, coefficient double, em double, f1 double").groupBy("dataset", "coefficient").agg(F.avg("em").alias("em"), F.avg("f1").alias("f1"))
        return scoring.best_coefficient(scoring.equal_means(each, ["em", "f1"], "coefficient")).first().coefficient

    assert select(scores) == 0.2 and select(scores | {0.3: scores[0.2]}) == 0.2


def test_references_come_once(spark):
    p = spark.createDataFrame([(1, "a", "d", "m", 0.1, "x"), (2, "a", "d", "m", 0.1, "x"), (3, "b", "d", "m", None, None)], "ordinal bigint, stable_id string, dataset string, method string, coefficient double, prediction string")
    r = spark.createDataFrame([("a", ["X", "the"]), ("b", None)], "stable_id string, aliases array<string>")
    assert {x.ordinal: x.em for x in scoring.scored(p, r).collect()} == {1: 1.0, 2: 1.0, 3: 0.0}
    assert {x.n for x in scoring.tallied(p, r).collect()} == {2, 1}
    with pytest.raises(Exception, match="comes twice"):
        scoring.scored(p, r.union(r)).collect()


def test_slices(spark):
    p = spark.createDataFrame([(1, "a", "d", "m", 0.1, "in 1999"), (2, "b", "d", "m", 0.1, "Yes, sure"), (3, "c", "d", "m", 0.1, "No"), (4, "d", "d", "m", 0.1, "maybe")], "ordinal bigint, stable_id string, dataset string, method string, coefficient double, prediction string")
    refs = [("a", "1999", ["1999"], r"19\d\d", "when"), ("b", "yes", ["yes"], "^x", "bool"), ("c", "no", [], "no", "bool"), ("d", "No.", ["no"], None, "bool")]
    r = spark.createDataFrame(refs, "stable_id string, answer string, aliases array<string>, answer_regex string, kind string")
    got = {x.kind: x for x in scoring.pattern_slices(p, r, "kind").collect()}
    assert (got["when"].regex_em, got["when"].literal_em, got["bool"].n, got["bool"].literal_count) == (1.0, 0.0, 3, 2)
    assert got["bool"].regex_em == pytest.approx(1 / 3, abs=1e-6)
    b = scoring.binary_slices(p, r.withColumn("aliases", F.array("answer"))).first()
    assert (b.n, b.yes, b.no, b.accuracy, b.covered, b.overgenerated) == (3, 1, 2, round(2 / 3, 6), round(2 / 3, 6), round(1 / 3, 6))
    m = spark.createDataFrame([({"r@1": 1.0, "mrr": 0.5},), ({"r@1": 0.0},)], "retrieval map<string,double>")
    assert {x.metric: (x.n, x["mean"]) for x in scoring.retrieval_means(m).collect()} == {"r@1": (2, 0.5), "mrr": (1, 0.5)}


def test_improved_everywhere(spark):
    board = spark.createDataFrame([("g", "a", 2.0), ("g", "b", 2.0), ("f", "a", 1.0), ("f", "b", 2.0)], "name string, dataset string, em double")
    assert tuple(scoring.improved_everywhere(board, "g", "f").first()) == (True, False)
    assert tuple(scoring.wins(board, "em", "name", "dataset", "g", "f").first()) == (2, 1)


# Policies

FEATURES = dict.fromkeys(policy.FEATURES + policy.EXTRA, 0.0) | {"entropy": 1.0, "pmax": 0.7, "margin": 2.0, "base_stop": 1.0, "prefix_nonempty": 1.0}


def gate(spark, spec, **more):
    f = FEATURES | more
    return one(spark, policy.compile_policy(spec, lambda k: F.lit(f[k])))


def test_policies(spark):
    rules = [policy.threshold("entropy", 2), policy.threshold("margin", 3, "le")]
    assert gate(spark, {"kind": "all", "rules": rules}) == 0 and gate(spark, {"kind": "any", "rules": rules}) == 1
    assert [gate(spark, {"kind": "constant", "value": v}) for v in (0, 1)] == [0, 1]
    guard = {"kind": "stop_guard", "threshold": 2, "otherwise": {"kind": "constant", "value": 1}}
    assert gate(spark, guard) == 0 and gate(spark, guard, prefix_nonempty=0.0) == 1
    soft = {"kind": "soft_entropy", "threshold": 2, "temperature": 0.5, "floor": 0.1}
    low, high = gate(spark, soft), gate(spark, soft, entropy=4.0)
    assert 0.1 <= low < high <= 1
    n = len(policy.BASIC)
    flat = {"kind": "logistic", "feature_set": "basic", "coef": [0] * n, "mean": [0] * n, "scale": [1] * n, "intercept": 0, "threshold": 0.5}
    assert gate(spark, flat) == 1
    place = {"kind": "position", "first": {"kind": "constant", "value": 0}, "later": {"kind": "constant", "value": 1}}
    assert gate(spark, place, position=1.0) == 0 and gate(spark, place, position=2.0) == 1
    for bad in (flat | {"coef": [0]}, flat | {"scale": [0] * n}, {"kind": "constant", "value": 1.2}, soft | {"temperature": 0}, {"kind": "other"}, {"kind": "all", "rules": []}, {"kind": "position", "first": place["first"]}, {"kind": "threshold", "field": "label", "threshold": 1, "op": "ge"}):
        with pytest.raises(ValueError):
            policy.validate(bad)


def test_features_see_no_labels(spark):
    for s, n in policy.SIZES.items():
        cols = policy.feature_columns(s, lambda k: F.lit(FEATURES[k]))
        assert len(cols) == n and one(spark, F.array(*cols)) == one(spark, F.array(*policy.feature_columns(s, lambda k: F.lit((FEATURES | {"label": 1, "future": 2})[k]))))


def test_hybrid_policies(spark):
    spec = {"kind": "hybrid", "route": policy.threshold("entropy", 2), "guard": {"kind": "soft_entropy", "threshold": 2, "temperature": 1, "floor": 0}}
    kind = "array<struct<entropy:double,disagreement:boolean,active:boolean>>"
    df = spark.createDataFrame([([(1.0, False, True), (3.0, True, True), (0.0, True, True)],), ([(1.0, True, True), (9.0, True, True)],)], f"events {kind}")
    a, b = (r[0] for r in df.select(policy.hybrid_weights(spec, F.col("events"))).collect())
    s = lambda x: 1 / (1 + math.exp(2 - x))
    assert a == pytest.approx([s(1), s(3), s(0)]) and b == [0, 0]


def test_logistic_fit(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, len(policy.BASIC)))
    y = (x @ rng.normal(size=x.shape[1]) + rng.normal(size=300) > 0).astype(float)
    rows = [dict(FEATURES) | dict(zip(policy.BASIC, map(float, r))) | {"res_em": float(t), "weight": 1.0} for r, t in zip(x, y)]
    m = policy.fit_logistic(spark.createDataFrame(rows), "basic", 0.1)
    z = (x - x.mean(0)) / x.std(0)
    beta = np.zeros(x.shape[1] + 1)
    zz = np.column_stack([z, np.ones(300)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-zz @ beta))
        ridge = np.diag([0.1] * x.shape[1] + [0])
        beta -= np.linalg.solve(zz.T @ (zz * (p * (1 - p))[:, None]) / 300 + ridge, zz.T @ (p - y) / 300 + ridge @ beta)
    assert np.allclose([*m["coef"], m["intercept"]], beta, atol=1e-5)


# Resampling


def test_bootstrap_is_repeatable(spark):
    df = spark.range(200).select(F.lit("g").alias("g"), (F.col("id") % 40).alias("c"), (F.col("id") % 3 == 0).cast("double").alias("v"))
    a, b = (bootstrap.cluster_bootstrap(df.repartition(n), "g", "c", "v", draws=200).first() for n in (1, 7))
    assert a == b and a.low <= a.mean <= a.high


def drawn(s, n, k, draws, seed=20260921):
    w = np.random.default_rng(seed).multinomial(sum(k), np.array(k) / sum(k), size=draws)
    return tuple(np.quantile((w @ np.array(s)) / (w @ np.array(n)), [0.025, 0.975]))


def test_bootstrap_keeps_clusters_apart(spark):
    """However many there are, no two clusters are drawn as one."""
    df = spark.range(30_000).select(F.lit("g").alias("g"), F.col("id").alias("c"), (F.col("id") % 3 == 0).cast("double").alias("v"))
    r = bootstrap.cluster_bootstrap(df, "g", "c", "v", draws=100).first()
    assert (r.low, r.high) == pytest.approx(drawn([0, 1], [1, 1], [20_000, 10_000], 100), abs=1e-12)


def test_bootstrap_over_questions(spark, tmp_path):
    """Copies of a question in another letter case or spacing are drawn together; blank questions are not one."""
    from quillarn.plans import qa

    ref = "stable_id string, question string, answer string, aliases array<string>"
    rows = [(f"{s}{i}", f"Who built  TOWER {i}? " if s == "a" else f"who built tower {i}?", "x", ["x"]) for i in range(40) for s in "ab"] + [(f"n{i}", (None, " ")[i], "x", ["x"]) for i in (0, 1)]
    spark.createDataFrame(rows, ref).write.parquet(f"{tmp_path}/qa_ref.parquet")
    spark.createDataFrame([], ref).write.parquet(f"{tmp_path}/eval_item.parquet")
    preds = [(k, r[0], "d", "m", 0.5, "x" if r[0][1:] < "2" else "y") for k, r in enumerate(rows)]
    spark.createDataFrame(preds, "ordinal bigint, stable_id string, dataset string, method string, coefficient double, prediction string").write.parquet(f"{tmp_path}/predictions.parquet")
    r = qa.cluster_bootstrap(spark, str(tmp_path)).first()
    right = sum(f"{i}" < "2" for i in range(40))
    assert (r.low, r.high) == pytest.approx(drawn([0, 1, 2], [2, 1, 2], [40 - right, 2, right], 2000), abs=1e-12)


def clustered(spark, n=600):
    rng = np.random.default_rng(2)
    rows = [(f"c{i // 2}", "ab"[(i // 2) % 5 == 0 and i % 2], float(rng.integers(0, 2)), float(rng.integers(0, 2)), float(rng.random()), float(rng.random())) for i in range(n)]
    return rows, spark.createDataFrame(rows, "cluster string, dataset string, em double, base_em double, f1 double, base_f1 double")


def test_block_draws_are_multinomial(spark, monkeypatch):
    """Drawn by blocks, every draw keeps its number of clusters in each stratum, and weights have a multinomial's spread."""
    monkeypatch.setattr(bootstrap, "BLOCK", 30)
    c = spark.range(200).select(F.when(F.col("id") < 50, "s").otherwise("t").alias("stratum"), F.col("id").cast("string").alias("cluster"), F.array(F.lit(1.0), (F.col("id") < 50).cast("double"), (F.col("id") == 7).cast("double"), (F.col("id") == 120).cast("double")).alias("sums"))
    s = np.array([r.s for r in bootstrap.resample(c, 3000).collect()])
    assert len(s) == 3000 and (s[:, 0] == 200).all() and (s[:, 1] == 50).all()
    assert abs(s[:, 2:].mean(0) - 1).max() < 0.08 and abs(s[:, 2:].var(0) - (1 - np.array([1 / 50, 1 / 150]))).max() < 0.12
    again = np.array([r.s for r in bootstrap.resample(c.repartition(5), 3000).orderBy("draw").collect()])
    assert (again == np.array([r.s for r in bootstrap.resample(c, 3000).orderBy("draw").collect()])).all()


def test_contrasts(spark):
    rows, df = clustered(spark)
    arm = lambda e, f: {"em": F.col(e), "f1": F.col(f), "nll": F.col(f) * 3, "tokens": F.lit(3.0)}
    got = {r.name: r for r in bootstrap.contrasts(df, "cluster", {"m": arm("em", "f1"), "b": arm("base_em", "base_f1")}, [("m", "b")], ["a", "b"], draws=400).collect()}
    by = {d: [r for r in rows if r[1] == d] for d in "ab"}
    d_em = {d: np.mean([r[2] - r[3] for r in x]) for d, x in by.items()}
    assert got["m-b:em:a"].estimate == pytest.approx(d_em["a"]) and got["m-b:em:macro"].estimate == pytest.approx((d_em["a"] + d_em["b"]) / 2)
    assert got["m-b:nll:a"].estimate == pytest.approx(np.mean([r[4] - r[5] for r in by["a"]]))
    a = got["m-b:em:a"]
    clusters = {}
    for r in by["a"]:
        clusters.setdefault(r[0], []).append(r[2] - r[3])
    v = np.array([(sum(x), len(x)) for x in clusters.values()])
    w = np.random.default_rng(0).multinomial(len(v), np.full(len(v), 1 / len(v)), size=4000) @ v
    low, high = np.quantile(w[:, 0] / w[:, 1], [0.025, 0.975])
    assert abs(a.low - low) < 0.02 and abs(a.high - high) < 0.02 and a.invalid == 0


def test_intervals_without_a_denominator(spark):
    df = spark.createDataFrame([("x", "a", 1.0, 1.0, 1.0, 1.0), ("y", "a", 0.0, 0.0, 1.0, 0.0)], "cluster string, dataset string, em double, base_em double, f1 double, base_f1 double")
    got = {r.name: r for r in bootstrap.repair_intervals(df, "cluster", ["a"], draws=200).collect()}
    assert got["repair_rate:a"].low is None and got["repair_rate:a"].invalid > 0 and got["delta_em:a"].low == 0
    crossed = {r.name: r for r in bootstrap.crossed_intervals(df, "cluster", [F.col("f1") - F.col("base_f1"), F.col("f1")], ["a"], draws=200).collect()}
    assert crossed["joint"].estimate == pytest.approx(0.75) and crossed["paired_run"].low >= 0.5


def test_binned_and_ternary_intervals(spark):
    c = spark.createDataFrame([(f"c{i}", [1.0, float(i % 3 == 0)]) for i in range(90)], "cluster string, sums array<double>")
    r = bootstrap.binned_intervals(c, {"rate": bootstrap.ratio(1, 0)}, draws=300).first()
    w = np.random.default_rng(20260920).multinomial(90, [60 / 90, 30 / 90], size=300)
    assert (r.low, r.high) == pytest.approx(tuple(np.quantile(w[:, 1] / 90, [0.025, 0.975]))) and r.estimate == pytest.approx(1 / 3)
    t = spark.createDataFrame([("a", d) for d in (1.0, 1.0, -1.0, 0.0)], "dataset string, delta double")
    got = {x.dataset: x for x in bootstrap.ternary_intervals(t, 500).collect()}
    assert got["a"].delta == got["macro"].delta == 25


def test_point_differences_and_reproduction(spark):
    d = spark.createDataFrame([(m, i, i * f) for i in range(101) for m, f in (("a", 1.0), ("b", 3.0))], "method string, draw int, v double")
    r = bootstrap.point_differences(d, "v").first()
    assert (r.method_a, r.method_b, r.low, r.high) == ("a", "b", 5.0, 195.0)
    mine = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "k string, v double")
    assert bootstrap.reproduced(mine, mine.withColumn("v", F.col("v") + 1e-12), ["k"], ["v"]).count() == 0
    assert [x.k for x in bootstrap.reproduced(mine, mine.withColumn("v", F.col("v") + F.when(F.col("k") == "y", 1e-6).otherwise(0)), ["k"], ["v"]).collect()] == ["y"]


def test_mean_intervals(spark):
    df = spark.createDataFrame([("g", float(i % 4 == 0)) for i in range(80)], "g string, v double")
    r = bootstrap.mean_intervals(df, "g", "v").first()
    assert r["mean"] == 0.25 and 0.1 < r.low < 0.25 < r.high < 0.4


# Normalisers


def test_literal_aliases():
    for p, y in (("Paris|London", ["Paris", "London"]), ("(?i)^(Paris|New York)$", ["Paris", "New York"]), ("(?:a|b)", ["a", "b"]), (r"\d+", []), ("a.*b", []), ("(a|b)c", []), ("(a|b)|(c)", []), ("a|a", ["a"]), ("", []), ("(a", []), ("U.S.", ["U.S."]), ("a||b", [])):
        assert normalise.literals(p) == y, p


def test_normalisers(spark):
    raw = spark.createDataFrame([(0, " 7 ", " Who? ", "job", "clerk", None, "Page", '["Clerk", "clerk", " "]', "12", " 3 ")], "ordinal bigint, id string, question string, prop string, obj string, subj string, s_wiki_title string, possible_answers string, s_pop string, o_pop string")
    r = normalise.popqa(raw).first()
    assert (r.stable_id, r.question, r.answer, r.aliases) == ("popqa:7", "Who?", "clerk", ["Clerk", "clerk"]) and json.loads(r.metadata)["subject"] == "Page" and json.loads(r.metadata)["object_popularity"] == 3
    assert normalise.popqa(raw.withColumn("obj", F.lit("other"))).first().aliases == ["other", "Clerk", "clerk"]
    for bad in ({"s_pop": "x"}, {"question": " "}, {"possible_answers": "[]"}):
        with pytest.raises(Exception):
            normalise.popqa(raw.withColumns({k: F.lit(v) for k, v in bad.items()})).collect()
    trec = spark.createDataFrame([(0, "1", "num", "How many?", r"\d+"), (1, "2", "loc", "Where?", "Rome|Roma")], "ordinal bigint, source_id string, question_type string, question string, answer_regex string")
    a, b = normalise.curated_trec(trec).orderBy("ordinal").collect()
    assert (a.answer, a.aliases, json.loads(a.metadata)["has_literal_aliases"]) == (r"\d+", [], False) and (b.answer, b.aliases) == ("Rome", ["Rome", "Roma"])
    dpr = spark.createDataFrame([(3, "q", "['a ', \"b\", 'a']")], "ordinal bigint, question string, answers string")
    d = normalise.dpr(dpr, "nq", "dev").first()
    assert (d.stable_id, d.answer, d.aliases) == ("nq:dev:000003", "a", ["a", "b"])
    for bad in ("['']", "[]", "{", "[1]"):
        with pytest.raises(Exception, match="answers"):
            normalise.dpr(dpr.withColumn("answers", F.lit(bad)), "nq", "dev").collect()
    hot = spark.createDataFrame([(0, "x1", "q", "yes", "bridge", " ")], "ordinal bigint, _id string, question string, answer string, type string, level string")
    h = normalise.hotpotqa(hot, "train", rekey=True).first()
    assert h.stable_id == "hotpotqa:train:x1" and json.loads(h.metadata) == {"question_type": "bridge", "source_id": "x1", "source_split": "train"}
    web = spark.createDataFrame([(0, "q", []), (1, "q", ["a"])], "ordinal bigint, question string, answers array<string>")
    assert [r.stable_id for r in normalise.webq_dev(web).collect()] == ["webq:dev:000001"]
    assert [r.stable_id for r in normalise.entity_questions(web.withColumn("relation", F.lit("P17"))).collect()] == ["entityquestions:dev:P17:000001"]


def test_alias_maps(spark):
    lines = [(0, json.dumps({"Q_id": "Q1", "aliases": ["a"], "demonyms": "b"})), (1, json.dumps({"id": "Q1", "name": ["c", "c"]})), (2, json.dumps({"Q2": ["x"], "Q3": {"values": ["y"], "aliases": ["z"]}, "Q4": "w"}))]
    got = {r.qid: r.aliases for r in normalise.alias_map(spark.createDataFrame(lines, "ordinal bigint, value string")).collect()}
    assert got == {"Q1": ["c"], "Q2": ["x"], "Q3": ["z", "y"], "Q4": ["w"]}
    rows = spark.createDataFrame([(0, "i", "q", "y", "bridge-comparison", "Q3"), (1, "j", "q", "n", "comparison", None)], "ordinal bigint, _id string, question string, answer string, type string, answer_id string")
    made = normalise.two_wiki(rows, spark.createDataFrame(list(got.items()), "qid string, aliases array<string>")).orderBy("ordinal").collect()
    assert [r.aliases for r in made] == [["z", "y"], ["n"]] and json.loads(made[0].metadata)["question_type"] == "bridge_comparison"
    with pytest.raises(Exception, match="type"):
        normalise.two_wiki(rows.withColumn("type", F.lit("x")), normalise.alias_map(spark.createDataFrame(lines, "ordinal bigint, value string"))).collect()


def test_contract(spark):
    rows = [("a", "d", "q", "x", ["x"], "{}"), ("a", "d", "q", "x", ["x"], "{}"), ("b", "d", " ", "x", [], "{}"), ("c", "d", "q", "x", [], '{"answer_regex": "x"}'), ("e", "d", "q", "x", None, "[]")]
    df = spark.createDataFrame(rows, "stable_id string, dataset string, question string, answer string, aliases array<string>, metadata string")
    got = {tuple(r) for r in normalise.violations(df).collect()}
    assert got == {("a", "again"), ("b", "question"), ("b", "answer contract"), ("e", "aliases"), ("e", "metadata"), ("e", "answer contract")}


# Retrieval and prompts


def test_stored_index(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i % 7} other{i % 3} mill") for i in range(60)] + [(60, None)], "doc_id bigint, text string")
    q = spark.createDataFrame([(1, "word3 word3 mill"), (2, "nothing here"), (3, None)], "query_id bigint, text string")
    bm25.build(docs, str(tmp_path / "index"))
    a, b, c = ({tuple(r) for r in x.select("query_id", "rank", "doc_id", "score").collect()} for x in (bm25.search_stored(spark, str(tmp_path / "index"), q, 4), bm25.search(bm25.postings(docs), q, 4), bm25.search_once(docs, q, 4)))
    assert a == b == c and {r[2] for r in a} == {3, 10, 17, 24}
    with pytest.raises(ValueError):
        bm25.search(bm25.postings(docs), q, 0)
    got = {r.query_id: r.passages for r in bm25.contexts(docs, q, 2, 5).collect()}
    assert got == {1: ["word3", "word3"], 2: [], 3: []}


def test_other_titles(spark):
    docs = spark.createDataFrame([(i, "own" if i < 2 else f"t{i}") for i in range(8)], "doc_id bigint, title string")
    hits = spark.createDataFrame([(1, i + 1, i, 9.0 - i) for i in range(8)] + [(2, 1, 0, 1.0)], "query_id bigint, rank int, doc_id bigint, score double")
    src = spark.createDataFrame([(1, "own"), (2, "x")], "query_id bigint, title string")
    assert [(r.query_id, r.doc_id) for r in bm25.other_titles(hits, docs, src).orderBy("place").collect()] == [(1, i) for i in range(2, 7)]
    with pytest.raises(Exception, match="twice"):
        bm25.other_titles(hits.union(hits), docs, src).collect()


def test_packing():
    p = prompts.Packer(prompts.count_words(), 60, 3, 5)
    base = len(prompts.rendered("q", []).split())
    full = prompts.Packer(prompts.count_words(), base + 8, 3, 5)
    docs = [("a", " one  two "), ("b", "x " * 9), ("c", "z")]
    r = full.pack("q", docs)
    assert [d["text"] for d in r["visible_documents"]] == ["one two", "x x x x"] and r["prompt_truncated"] and r["prompt_tokens"] == base + 8
    r = p.pack("q", docs)
    assert [d["text"] for d in r["visible_documents"]] == ["one two", "x x x x x", "z"] and r["prompt_truncated"]
    assert [d["doc_id"] for d in p.pack("q", [("a", " "), ("b", "x")])["visible_documents"]] == []
    assert prompts.NO_EVIDENCE in p.pack("q", [])["prompt"] and not p.pack("q", [])["prompt_truncated"]
    assert prompts.NO_EVIDENCE not in prompts.Packer(prompts.count_words(), base, 3, 5).pack("q", [])["prompt"]
    with pytest.raises(ValueError, match="budget"):
        prompts.Packer(prompts.count_words(), base - 1, 3, 5).pack("q", [])
    with pytest.raises(ValueError, match="blank"):
        p.pack(" ", [])


def test_prompt_tables(spark):
    doc = "array<struct<doc_id:string,text:string>>"
    five = [(str(i), f"t  {i}") for i in range(5)]
    df = spark.createDataFrame([(five, [(a, b.replace("  ", " ")) for a, b in five], ["T, 3!"]), (five, five[:4], []), (five, five[:4] + [("4", "u")], None)], f"s {doc}, v {doc}, a array<string>")
    got = df.select(prompts.complete(F.col("s"), F.col("v")).alias("c"), prompts.visible_hit(F.col("a"), F.col("v")).alias("h")).collect()
    assert [(r.c, r.h) for r in got] == [(True, 1.0), (False, 0.0), (False, 0.0)]
    p = spark.createDataFrame([("d", n, 1.0, n > 1) for n in (4, 1, 3, 2)], "dataset string, prompt_tokens int, visible_answer double, complete_top5 boolean")
    r = prompts.prompt_stats(p, "dataset").first()
    assert (r.rows, r.least, r.most, r.median, r.complete, r.truncated) == (4, 1, 4, 3, 3, 1)


def test_teacher_records(spark):
    df = spark.createDataFrame([(1, "A", list(range(100, 200)), [7] * 600, ["x"]), (2, "A", [1], [], [])], "doc_id bigint, title string, tokens array<int>, evidence array<int>, documents array<string>")
    rows = prompts.teacher_records(df, 1, [5, 5], [6], 64, 32, 512).collect()
    assert len(rows) == 1 and len(rows[0].student_ids) == 97 and rows[0].teacher_ids[-96:] == rows[0].student_ids[-96:] and len(rows[0].teacher_ids) == 1 + 2 + 512 + 1 + 96
    r = prompts.teacher_records(df, 1, [5, 5], [6], 64, 32, 512)
    assert r.select(prompts.causal(F.col("student_ids"), F.col("student_positions"), F.col("target_ids")), prompts.causal(F.col("teacher_ids"), F.col("teacher_positions"), F.col("target_ids")), prompts.causal(F.col("student_ids"), F.col("teacher_positions"), F.col("target_ids"))).first()[:] == (True, True, False)


def test_labelled_tokens(spark):
    w = 8
    rows = [(0, list(range(w)), [0, 1, 2] + [-100] * 5), (1, list(range(w)), [-100] * 4 + [4, 5, -100, -100]), (2, list(range(w)), [-100, 1] + [-100] * 6), (3, list(range(w)), [9] + [-100] * 7), (4, list(range(w)), [-100] * w)]
    got = prompts.label_layout(spark.createDataFrame(rows, "row int, input_ids array<int>, labels array<int>"), w).orderBy("row").collect()
    assert [r.problem for r in got] == [None, None, "layout", "labels differ", "length"] and got[1].tokens == [4, 5] and [r.reset for r in got][:2] == [True, False]
    d = prompts.detokenised(spark.createDataFrame([(r, i, lab) for r, i, lab in rows], "doc_id int, input_ids array<int>, labels array<int>"), lambda: lambda xs: [" a\n".join(map(str, x)) for x in xs], least=3, short=3)
    assert [tuple(r) for r in d.collect()] == [(0, "0 a 1 a 2")]
    assert prompts.clip(["abcdef"], [2], lambda t: [ord(t[i]) for i in range(0, len(t), 2)]) == ["abcd"]


# Checks


def test_grids(spark):
    ids = spark.createDataFrame([("a",)], "stable_id string")
    keys = spark.createDataFrame([("a", "base", 0.0)], "stable_id string, method string, coefficient double")
    with pytest.raises(ValueError, match="incomplete"):
        checks.insist(checks.key_difference(keys, checks.prediction_grid(ids, ["m"], [0.0, 0.5]), "stable_id", "method", "coefficient"), "incomplete grid")
    full = keys.union(spark.createDataFrame([("a", "m", 0.5)], keys.schema))
    assert checks.key_difference(full, checks.prediction_grid(ids, ["m"], [0.0, 0.5]), "stable_id", "method", "coefficient").count() == 0
    bad = full.union(full.where("method = 'm'")).union(spark.createDataFrame([("z", "m", 0.5)], keys.schema))
    assert {r.problem for r in checks.key_difference(bad, full, "stable_id", "method", "coefficient").collect()} == {"repeated", "extra"}
    filled = checks.filled_grid(full.withColumn("em", F.lit(1)), ["m", "n"], "em")
    assert {tuple(r)[:3] for r in filled.collect()} == {("a", "m", 0.0), ("a", "n", 0.0), ("a", "m", 0.5)}


def test_comparisons(spark):
    a = spark.createDataFrame([(0, "x"), (1, "y"), (1, "y")], "ordinal int, v string")
    assert checks.exactly_equal(a, a.repartition(3)).count() == 0
    assert {r.side for r in checks.exactly_equal(a, a.distinct()).collect()} == {"left"}
    with pytest.raises(ValueError, match="differ"):
        checks.exactly_equal(a, a.withColumn("ordinal", F.col("ordinal").cast("long")))
    b = spark.createDataFrame([(0, "x"), (1, "z"), (2, "w")], "ordinal int, v string")
    assert {tuple(r) for r in checks.positional(a.distinct(), b, ["v"]).collect()} == {(1, "differs"), (2, "length")}
    assert {tuple(r) for r in checks.differing(a.distinct(), b, "ordinal", ["v"]).collect()} == {(1, "v"), (2, "ordinal")}
    assert [r.ordinal for r in checks.prefix_differs(a.distinct(), b).collect()] == [1]
    assert checks.not_subset(a, b).count() == 2 and checks.dense(b).count() == 0 and checks.dense(a).count() == 1
    with pytest.raises(ValueError, match="whole"):
        checks.merged_shards([b, b])
    assert {r.value for r in checks.counts_off(b, "v", {"x": 1, "q": 2}).collect()} == {"z", "w", "q"}
    plan = spark.createDataFrame([(0, 0, "x"), (1, 1, "y"), (2, 0, "z")], "ordinal bigint, rank int, v string")
    mine = spark.createDataFrame([(0, "x"), (1, "q")], "place bigint, v string")
    assert [tuple(r) for r in checks.off_plan(mine, plan, 0, ["v"]).collect()] == [(1, "differs")]


def test_row_checks(spark):
    df = spark.createDataFrame([([1, 2], [0.4, 0.6]), ([1, 1], [0.5, 0.5]), ([1, 9], [0.5, 0.5]), ([1, 2], [0.5, 0.4]), ([1, 2], [1.5, -0.5])], "i array<int>, p array<double>")
    assert [r[0] for r in df.select(checks.distribution_problems(df, "i", "p", 5)).collect()] == [None, "support", "support", "sum", "probability"]
    t = [(s, s * 256, 5e-4 * s / 32 if s <= 32 else 5e-5, 1.0, 1.0, 1.0, False) for s in range(1, 34)]
    trace = spark.createDataFrame(t[:32] + [(33, 33 * 256, 5e-5, 1.0, 1.0, float("nan"), False)], "step bigint, positions_seen bigint, lr double, loss double, kl double, ce double, sampled boolean")
    assert [tuple(r) for r in checks.trace_problems(trace, 33).collect()] == [(33, "figures")]
    assert ("missing") in {r.problem for r in checks.trace_problems(trace, 34).collect()}
    fd = "struct<position:int,base_token:int,res_token:int,prefix_ids:array<int>>"
    pairs = [("a", [1, 2], [1, 3], (2, 2, 3, [1])), ("b", [1], [1], None), ("c", [1], [2], None), ("d", [1], [1, 4], (2, 0, 4, [1])), ("e", [1], [1, 4], (1, 1, 4, []))]
    p = spark.createDataFrame(pairs, f"stable_id string, base_ids array<int>, res_ids array<int>, first_difference {fd}")
    assert {tuple(r) for r in checks.first_difference_problems(p, 0).collect()} == {("c", "unmarked"), ("e", "mismatch")}
    o = p.withColumn("output_ids", F.col("res_ids"))
    assert {r.stable_id for r in checks.one_shot_mismatches(o, F.col("stable_id") != "a").collect()} == {"a"}
    s = spark.createDataFrame([("a", 1.0, 1.0, 1.0, 1.0, [0.1], 1), ("b", 1.0, 0.0, 1.0, 0.0, [0.1], 1), ("c", 1.0, 1.0, 1.0, 1.0, [0.1], 2), ("d", 1.0, 1.0, 1.0, 1.0, [-0.1], 1)], "stable_id string, em double, fresh_em double, f1 double, fresh_f1 double, token_nll array<double>, gold_count int")
    assert {tuple(r) for r in checks.bundle_problems(s).collect()} == {("b", "score"), ("c", "length"), ("d", "loss")}
    assert [checks.unsafe(x) for x in ("a/b", "../a", "/a", "a/../b", "a//b", "")] == [False, True, True, True, True, True]


# Timing


def test_requests(spark):
    df = spark.createDataFrame([(0.5, 2.0, [1, 5], 4), (0.5, 0.0, [1], 0), (0.0, 0.0, [1], 0), (0.5, 1.0, [1], 0), (0.5, 1.0, [], 0)], "ttft_seconds double, decode_seconds double, generated_lengths array<int>, decode_steps int")
    assert [r[0] for r in df.select(timing.request_problems()).collect()] == [None, None, "time", "steps", "lengths"]
    a, b = timing.request_metrics(df.limit(2)).collect()
    assert (a.generated_tokens, a.decode_generated_tokens, a.e2e_tokens_per_second) == (6, 4, 2.4) and b.decode_tokens_per_second is None
    assert timing.pooled(timing.request_metrics(df.limit(2))).first().pooled_decode_tokens_per_second == 2.0


def test_exact_quantiles(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.exponential(size=2000), 3)
    df = spark.createDataFrame([("ab"[i % 3 == 0], float(v)) for i, v in enumerate(x)] + [("a", None)], "g string, v double")
    for r in timing.described(df, "v", "g").collect():
        mine = x[np.arange(2000) % 3 == (0 if r.g == "b" else 1)] if r.g == "b" else x[np.arange(2000) % 3 != 0]
        assert [r.median, r.q25, r.q75] == pytest.approx(np.quantile(mine, [0.5, 0.25, 0.75])) and r.mad == pytest.approx(np.median(abs(mine - np.median(mine)))) and r.n == len(mine)
    assert timing.described(df.where("v is null"), "v").count() == 0


# Models


def test_model_seam(spark):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(40)], "id bigint, prompt string")

    def factory():
        import pandas as pd

        return lambda b: pd.DataFrame({"prediction": b["prompt"] + "!", "output_ids": [[len(b)]] * len(b)})

    got = models.generated(df.coalesce(1), factory, 16).collect()
    assert {r.prediction for r in got} == {f"p{i}!" for i in range(40)} and max(r.output_ids[0] for r in got) == 16
    with pytest.raises(ValueError, match="already"):
        models.generated(df.withColumn("prediction", F.lit("")), factory)
    rng = np.random.default_rng(0)
    w = {"norm.weight": np.ones(4), "lm_head.weight": rng.normal(size=(6, 4)), "layers.0.input_layernorm.weight": np.ones(4), "layers.0.mlp.gate_proj.weight": rng.normal(size=(5, 4)), "layers.0.mlp.up_proj.weight": rng.normal(size=(5, 4)), "layers.0.mlp.down_proj.weight": rng.normal(size=(4, 5))}
    h = rng.normal(size=(3, 4))
    out = models.memory_logits(spark.createDataFrame([(x.tolist(),) for x in h], "hidden array<double>").coalesce(1), lambda: w, 1).collect()
    n = lambda x: x / np.sqrt((x**2).mean(-1, keepdims=True) + 1e-5)
    g = n(h) @ w["layers.0.mlp.gate_proj.weight"].T
    y = n(h + (g / (1 + np.exp(-g)) * (n(h) @ w["layers.0.mlp.up_proj.weight"].T)) @ w["layers.0.mlp.down_proj.weight"].T) @ w["lm_head.weight"].T
    assert np.allclose(sorted(r.memory[0] for r in out), sorted(y[:, 0]), atol=1e-4)
    assert (models.initial_tensor("norm.weight", (2,), 1, "s") == 1).all() and models.initial_tensor("a", (9,), 1, "s").std() < 0.1
    inv = models.inventory(spark.createDataFrame([("a", "f4", 3, 12), ("b", "f2", 2, 4), ("c", "f4", 1, 4)], "name string, dtype string, numel bigint, bytes bigint"))
    assert {(r.dtype, r.parameters, r.bytes) for r in inv.collect()} == {("f4", 4, 16), ("f2", 2, 4), (None, 6, 20)}


def test_populations(spark):
    df = spark.createDataFrame([("nq", "a", " Ｗho? ", "x y"), ("nq", "b", "who?", "z")], "dataset string, stable_id string, question string, answer string")
    got = {r.stable_id: r for r in prompts.population(df, lambda: lambda texts: [[len(w) for w in t.split()] for t in texts], 20).collect()}
    assert got["a"].gold_ids == [1, 1] and got["a"].question_group == got["b"].question_group and got["a"].problem is None and got["a"].input_sha256 != got["b"].input_sha256
    assert prompts.population(df, lambda: lambda texts: [[99] for _ in texts], 20).first().problem == "ids"


def test_runs_and_bindings(spark):
    assert sequence.parse_seeds("7, 3", [3, 5, 7]) == [3, 7] and sequence.parse_seeds("", [3, 5]) == [3, 5]
    for bad in ("3,3", "4"):
        with pytest.raises(ValueError):
            sequence.parse_seeds(bad, [3, 5])
    assert [sequence.checkpoint_label(*x) for x in ((0, 0.0, False), (1, 0.0, False), (1, 0.5, True), (0, 0.125, False))] == ["pass0", "ep1", "ep2", "pass0p125"]
    with pytest.raises(ValueError):
        sequence.checkpoint_label(0, 1.5, False)
    f = {"candidate": "c", "freeze_sha256": "1", "lr": 2, "frozen_at": 5}
    assert checks.binding_problems(f, f | {"started_at": 5, "completed_at": 6}, ["lr"]) == []
    assert checks.binding_problems(f, f | {"lr": 3, "started_at": 4, "completed_at": 6}, ["lr"]) == ["lr", "order"]
    rows = spark.createDataFrame([(0, 0), (1, 0), (1, 1)], "index bigint, slot int")
    want = spark.range(3).withColumnRenamed("id", "index")
    assert {tuple(r) for r in checks.slot_problems(rows, want, 2).collect()} == {(1, "repeated"), (2, "missing"), (1, "foreign")}


def test_selected_and_extracted(spark):
    c = spark.createDataFrame([("a", 0.1, 1), ("a", 0.2, 2), ("b", 0.1, 3)], "method string, coefficient double, v int")
    assert {r.v for r in scoring.at_selected(c, c.where("v in (2, 3)")).collect()} == {2, 3}
    p = spark.createDataFrame([("memory_decoder", 0.5, "x", "y\nz"), ("memory_decoder", 0.0, "x", "y"), ("base", None, "x", "y")], "method string, coefficient double, prediction string, decoded string")
    assert [r.prediction for r in scoring.reextracted(p, "decoded").collect()] == ["y", "x", "x"]


def test_index_of_other_documents(spark, tmp_path):
    docs = spark.createDataFrame([(1, "old mill"), (2, "the"), (3, None)], "doc_id bigint, text string")
    bm25.build(docs, str(tmp_path / "i"))
    bm25.validate(spark, str(tmp_path / "i"), docs)
    with pytest.raises(ValueError, match="other"):
        bm25.validate(spark, str(tmp_path / "i"), docs.limit(2))


def test_salted_joins(spark):
    """Hot keys and rows without a key are spread; nothing is lost or doubled."""
    big = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, None).otherwise(F.concat(F.lit("k"), (F.col("id") % 1500).cast("string"))).alias("k"))
    small = spark.createDataFrame([("hot", 1), ("k5", 2), ("k8", 3), ("z", 4)], "k string, v int")
    assert [r.k for r in skew.hot_keys(big.where("k is not null"), "k").collect()] == ["hot"]
    for how in ("inner", "left"):
        a, b = ({tuple(r) for r in x.select("id", "k", "v").collect()} for x in (skew.salted_join(big, small, ["k"], F.col("id"), how=how), big.join(small, "k", how)))
        assert a == b and len(a) == skew.salted_join(big, small, ["k"], F.col("id"), how=how).count()
    assert skew.salted_join(big.limit(0), small, ["k"], F.col("id")).count() == 0
