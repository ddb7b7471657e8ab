"""The training-data operators against brute force, library results and edge cases."""
import random
import re
import unicodedata
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillarn.llm import defects, duplicates, encode, groups, leaks, lookalike, mix, mojibake, overlap, split

VOCABULARY = Path(encode.VOCABULARY)
DOC = "doc_id bigint, text string, source string, item_id string"
QA = "stable_id string, dataset string, question string, answer string, aliases array<string>, metadata string, ordinal bigint"
CAL = "stable_id string, dataset string, question string, aliases array<string>, split string, source_title string, subject string"
PRED = "ordinal bigint, stable_id string, prediction string, output_ids array<int>"


# 1: leaks


def words(t):
    t = re.sub(leaks.MARKUP, " ", t)
    return re.findall(r"[^\W_]+", t.lower())


def test_leaks_against_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([5, 12, 30]))), None if i == 3 else " ".join(rng.choices(vocabulary, k=20))) for i in range(8)]
    docs = [(None, "x", "s", "c"), (0, None, "s", "c"), (1, "", "s", "c")]
    for k in range(60):
        w = rng.choices(vocabulary, k=40)
        i = rng.choice(items)
        src = i[1].split()
        n = rng.choice([10, 11, 12, 14])
        docs.append((k + 2, " ".join(w[:9]) + " <b>" + ", ".join(src[:n]).upper() + "</b>\n\n" + " ".join(w[9:]), "s", "clash"))
    expect = set()
    for d, text, *_ in docs:
        w = words(text or "")
        grams = {tuple(w[k : k + 12]) for k in range(len(w) - 11)}
        for i, *fields in items:
            for f in fields:
                v = words(f or "")
                if any(tuple(v[k : k + 12]) in grams for k in range(len(v) - 11)) and d is not None:
                    expect.add((d, i))
    d = spark.createDataFrame(docs + docs[3:6], DOC)
    e = spark.createDataFrame(items, "item_id bigint, question string, context string")
    assert {tuple(r) for r in leaks.leaks(d, e).collect()} == expect and expect
    assert leaks.leaks(d.limit(0), e).count() == 0 and leaks.leaks(d, e.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["other", "more", "less"])
def test_leaks_with_edits(spark, kind):
    """Windows with a word exchanged, added or left out are found at the target recall, each kind by itself."""
    rng = random.Random(2)
    words_ = [f"v{i}" for i in range(5000)]
    items = [(i, " ".join(rng.choices(words_, k=17)), "") for i in range(300)]
    docs = []
    for i, q, _ in items:
        w = q.split()
        at = rng.randrange(1, 15)
        w[at : at + (kind != "more")] = ["changed"] if kind != "less" else []
        docs.append((i, " ".join(rng.choices(words_, k=30) + w + rng.choices(words_, k=30)), "s", "c"))
    got = {tuple(r) for r in leaks.leaks(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id bigint, question string, context string"), words=16, edits=1).collect()}
    assert all(d == i for d, i in got) and len(got) >= 0.95 * len(items)


def test_edit_band():
    def distance(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            p, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
        return d[-1]

    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 2, 3000), rng.integers(0, 2, 3000)
    for e in (0, 1, 2):
        at, start, n = rng.integers(0, 2900, 500), rng.integers(0, 2900, 500), rng.integers(6 - e, 7 + e, 500)
        expect = [distance(x[a : a + 6], y[s : s + k]) <= e for a, s, k in zip(at, start, n)]
        assert leaks._within(x, at, 6, y, start, n, e).tolist() == expect


def test_boilerplate_of_all_items(spark, monkeypatch):
    """A passage that all items share is expanded a part at a time, and no pair is lost."""
    monkeypatch.setattr(leaks, "CANDIDATES", 50)
    shared = " ".join(f"b{i}" for i in range(14))
    items = spark.createDataFrame([(i, f"own{i} {shared}", "") for i in range(70)], "item_id bigint, question string, context string")
    docs = spark.createDataFrame([(i, f"x {shared} y{i}", "s", "c") for i in range(3)], DOC)
    index = leaks.leaks(docs.coalesce(1), items)
    assert index.count() == 210


# 2: pieces


@pytest.mark.parametrize("text", ["# A\n\n" + "One two. Three four! " * 300, "x" * 9000, "é" * 5000, "日本語の文。" * 900, "é" * 4000, "word " * 1500, "* item\n" * 800, "<p>" + "a b c. " * 400 + "</p>" * 3 + "tail " * 300])
def test_pieces_cover_the_text(text):
    parts = split.pieces_of(text)
    assert "".join(text[f:e] for _, f, e in parts) == text
    assert all(0 < e - s <= 2000 and s <= f < e for s, f, e in parts)
    assert all(120 <= f - s <= 200 or i == 0 for i, (s, f, _) in enumerate(parts) if parts[i - 1][2] - parts[i - 1][0] > 200)
    assert not any(unicodedata.combining(text[s]) for s, _, _ in parts)


def test_pieces_end_at_sentences():
    text = " ".join(f"This is sentence number {i} of the text." for i in range(200))
    assert all(text[:e].rstrip().endswith(".") for _, _, e in split.pieces_of(text))


def test_pieces_follow_the_tree():
    """Sections nest by their headings and items by their indentation; only an oversized node is opened, and what is left
    of it isn't merged with its neighbour."""
    t = "# A\n\nintro\n\n## B\n\n" + "word one. " * 30 + "\n\n## C\n\nshort\n\n# D\n\n- one\n  - two " + "x " * 80 + "\n  - three\n- four\n"
    got = [t[f:e] for _, f, e in split.pieces_of(t, 130, 10)]
    assert "".join(got) == t and all(len(g) <= 120 for g in got)
    assert got[0] == "# A\n\nintro\n\n" and got[1].startswith("## B\n\nword one.")
    assert "## C\n\nshort\n\n" in got and "  - three\n" in got and "- four\n" in got and got[-5].startswith("# D\n\n- one\n")
    deep = "".join(" " * i + "- item\n" for i in range(400))
    assert "".join(deep[f:e] for _, f, e in split.pieces_of(deep, 200, 20)) == deep


def test_pieces_of_short_rows(spark):
    df = spark.createDataFrame([(1, None, "s", "c"), (2, "", "s", "c"), (3, "a" * 2000, "s", "c"), (4, "a" * 2001, "s", "c")], DOC)
    assert {r.doc_id for r in split.pieces(df).collect()} == {4}
    with pytest.raises(ValueError):
        split.pieces(df, 100, 100)


# 3: groups


def test_groups_against_union_find(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        title = "Hot_Page" if i % 3 == 0 else rng.choice([None, "", " ", f"T {rng.randrange(150)}", f"t_{rng.randrange(150)}"])
        rows.append((f"r{i}", "d", rng.choice([None, "", f"Q {rng.randrange(300)}?"]), None, rng.choice(["fit", "dev", "audit", None]), title, rng.choice([None, " ", f"S{rng.randrange(200)}"])))
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    def clean(x, pattern):
        x = re.sub(pattern, "", (x or "").lower())
        return x or None

    for s, _, q, _, _, t, u in rows:
        for k in (("t", clean(t, r"[_\s]")), ("s", clean(u, r"[_\s]")), ("q", clean(q, r"[\W_]"))):
            if k[1]:
                parent[find(k)] = find(s)
    comp = {r[0]: find(r[0]) for r in rows}
    g = groups.grouped(spark.createDataFrame(rows, CAL))
    got = {r.stable_id: r.group_id for r in g.collect()}
    assert len(set(got.values())) == len(set(comp.values())) == len({(got[s], comp[s]) for s in got})
    splits = {}
    for r in rows:
        splits.setdefault(comp[r[0]], set()).add(r[4])
    assert {r.stable_id for r in groups.torn(g).collect()} == {s for s, c in comp.items() if len(splits[c] - {None}) > 1}
    a = groups.assign(g)
    assert a.groupBy("group_id").agg(F.countDistinct("new_split").alias("n")).where("n > 1").count() == 0
    shares = {r.split: r.share for r in groups.shares_of(a).collect()}
    assert all(abs(shares[s] - w) < 0.08 for s, w in groups.SHARES.items())
    assert groups.torn(groups.grouped(spark.createDataFrame([], CAL))).count() == 0


def test_long_chain(spark):
    n = 60
    edges = spark.createDataFrame([((i * 37) % n, ((i + 1) * 37) % n) for i in range(n - 1)], "a bigint, b bigint")
    assert {r.component for r in groups.components(edges).collect()} == {0}


# 4: duplicates


def test_duplicates(spark):
    a = ("x", "NQ", "Wer ist Größe?", "A b", ["a", "b"], '{"k": 1, "l": "V\\u00e9"}')
    same = ("y", "n.q", "wer  IST GRÖSSE", "a-B.", ["A", " b"], '{"l":"vé" , "k":1}')
    rows = [(*a, 1), (*same, 2), (*a[:4], ["b", "a"], a[5], 3), (*a[:3], None, *a[4:], 4), ("z", "nq", "Wer ist Grösse?", "A b", ["a", "b"], '{"k": 1, "l": "Ve"}', 5), (None, None, None, None, None, None, 6), (None, None, None, None, None, None, 7), ("q", "nq", "x", "y", None, "no json", 8)]
    df = spark.createDataFrame(rows, QA).withColumn("copies", F.lit(1)).withColumn("key", F.lit("clash"))
    assert {tuple(r) for r in duplicates.pairs(df).collect()} == {(1, 2), (6, 7)}
    assert {tuple(r) for r in duplicates.groups(df).collect()} == {(1, 2), (3, 1), (4, 1), (5, 1), (6, 2), (8, 1)}
    assert duplicates.collapsed(df).count() == 6
    assert duplicates.pairs(df.limit(0)).count() == 0


def test_hot_keys(spark):
    rows = [(str(i), "d", "hot" if i % 3 == 0 else f"q{i}", "a", ["x"], "{}", i) for i in range(6000)]
    df = spark.createDataFrame(rows, QA).repartition(7)
    keyed = df.select("ordinal", duplicates.canonical(df).alias("key"))
    assert [r.n for r in duplicates.hot_keys(keyed).collect()] == [2000]
    assert {tuple(r) for r in duplicates.pairs(df).collect()} == {(0, i) for i in range(3, 6000, 3)}


# 5: look-alikes


def test_one_form(spark):
    table = lookalike.rewriting(dict.fromkeys("MasternxonS", 20) | {"a": 50, "o": 50, "e": 9, "é": 5, "ö": 5, "е": 1, "ӧ": 1, " ": 9} | dict.fromkeys("МаＭａｓｔｅｒ　Ｓ\xa0", 1))
    r = lookalike.Rewriter(table)
    for odd in ("Маstеr Sӧn", "Ｍａｓｔｅｒ　Ｓön", "M​as­ter  Sön ", "Master Sо​̈n"):
        assert r.rewrite(odd) == "Master Sön", odd
    assert r.rewrite("Son") == "Son" and r.rewrite("MASTER") == "MASTER" and r.rewrite(None) is None and r.rewrite("​") == ""
    assert r.rewrite("x" * 100_000) == "x" * 100_000


def test_same_reading(spark):
    refs = spark.createDataFrame([("a", ["Sön", None]), ("b", []), ("c", None), ("a", ["Sön"])], "stable_id string, aliases array<string>")
    preds = spark.createDataFrame([(1, "a", "Sön", None), (2, "a", "Sön", None), (3, "a", "sön", None), (4, "a", "Son", None), (5, "b", "x", None), (6, "c", None, None), (7, "d", "Sön", None), (8, "a", " Ｓön", None)], PRED)
    assert {r.ordinal for r in lookalike.same_reading(preds, [refs]).collect()} == {2, 8}
    assert lookalike.same_reading(preds.limit(0), [refs]).count() == 0
    with pytest.raises(ValueError):
        lookalike.rewritten(preds, "prediction", {}, "ordinal")


# 6: defects


def test_defects(spark):
    en = "The old mill by the river was sold to the council in the year when the market was opened and people there said that it was the best of all. "
    fr = "Le vieux moulin près de la rivière a été vendu après la guerre et les habitants disent que la ville était plus belle avant cette année. "
    docs = spark.createDataFrame([(i, [en, fr][i % 2] * 3, ["en", "fr"][i % 2]) for i in range(40)], "doc_id bigint, text string, lang string")
    q = "What was the name of the town where the mill stood?"
    names = [f"{a}{b}{c}" for a in ("Bra", "Kle", "Sto") for b in ("du", "mi", "ra") for c in ("ck", "nd", "rk")]
    refs = spark.createDataFrame([("a", q, ["Grol Vadurk", "1823"]), ("n", "x?", [f"{x} {y}" for x in names for y in names])], "stable_id string, question string, aliases array<string>")
    cases = {1: (None, "empty"), 2: (" …", "empty"), 3: ("I cannot answer this question.", "refusal"), 4: ("What was the name of the town", "copy"), 5: (q + " " + q[:20], "copy"), 6: ("Les habitants disent que la ville était Stoduck.", "language"), 7: ("Grol Vad", "truncated"), 8: ("Grol Vadurk, and the", "truncated"), 9: ("Grol Vadurk", None), 10: ("Kledurk Stomick", None), 11: ("It was Stoduck, as people said.", None), 12: (q + " Stoduck", None), 13: ("1900", None), 14: ("I Cannot Answer the Bells at Stoduck", None)}
    preds = spark.createDataFrame([(k, "a", p, None) for k, (p, _) in cases.items()] + [(99, "none", "", [1])], PRED)
    got = {r.ordinal: r.defect for r in defects.defects(preds, [refs], docs).collect()}
    assert got == {k: d for k, (_, d) in cases.items() if d} | {99: "empty"}


def test_refusals_and_copies_that_look_like_names():
    """What only capitals make look like a name is no answer."""
    judge = defects.Judge(defects.Languages([]), defects.Ends(np.ones(defects.SLOTS, int), np.ones(defects.SLOTS, int)))
    q = "What was the name of the town where the mill stood?"
    for form in ("Keine Antwort", "Keine Angaben", "Désolé", "Lamento", "NO IDEA", "I DO NOT KNOW", "I CANNOT ANSWER THAT"):
        assert judge.judge(form, q, []) == "refusal"
    assert judge.judge("Q WHAT WAS THE NAME OF THE TOWN", q, []) == "copy"
    assert judge.judge("Площадь", q, []) == "language"
    assert judge.judge("Grol Vadurk", q, []) is None and judge.judge("I Cannot Answer the Bells at Stoduck", q, []) is None


def test_language_of_small_letters():
    en = "the old mill by the river was sold to the council in the year when the market was opened and people there said that it was the best of all"
    es = "el viejo molino fue vendido y la respuesta es que la ciudad era más bella según la crónica"
    de = "nach der chronik wurde die alte mühle verkauft und die stadt war schöner als im jahr zuvor es heißt so"
    judge = defects.Judge(defects.Languages([(k, t) for k, t in (("en", en), ("es", es), ("de", de)) for _ in range(9)]), defects.Ends(np.ones(defects.SLOTS, int), np.ones(defects.SLOTS, int)))
    q = "What was the name of the town where the mill stood?"
    assert judge.judge("la respuesta es molinero", q, []) == judge.judge("nach der chronik war es weber", q, []) == "language"
    for form in ("the best mill", "grol vadurk", "de la cruz", "molinero", "zorvad kleminth of el broduck", "it was the miller"):
        assert judge.judge(form, q, []) != "language"
    assert judge.judge("la respuesta es", q, ["La respuesta es molinero"]) != "language"
    assert judge.judge("la respuesta es molinero", "¿Cuál es el nombre de la ciudad?", []) is None


# 7: overlaps


def test_overlaps(spark):
    rows = [("f1", "d", "Who founded the old harbour at Klazom Briros?", ["X"], "fit", None, None), ("e1", "d", "Please say who fonuded the harbour at KLAZOM  BRIROS!", ["X", "Y"], "dev", None, None), ("e2", "d", "Who founded the old harbour at Dolim Stegan?", ["X"], "dev", None, None), ("e3", "d", "Who founded the old harbour at Klazom Briros?", ["Z"], "audit", None, None), ("e4", "d", "who founded the old harbour at klazom briros", ["X"], "audit", None, None), ("n1", "d", None, ["X"], "dev", None, None), ("n2", "d", " ", ["X"], "dev", None, None), ("n3", "d", "Who founded the old harbour at Klazom Briros?", None, "dev", None, None), ("n4", "d", "Who founded the old harbour at Klazom Briros?", ["X"], None, None, None)]
    rows += [(f"t{i}", "d", f"Who founded the old harbour at N{i}a M{i}b?", [f"A{i}"], "fit", None, None) for i in range(300)]
    df = spark.createDataFrame(rows + rows[:2], CAL)
    found = overlap.overlaps(df)
    assert {(r.train_id, r.eval_id) for r in found.collect()} == {("f1", "e1"), ("f1", "e4")}
    assert {r.split: r.overlapping for r in overlap.report(found, df).collect()} == {"dev": 1, "audit": 1}
    assert overlap.overlaps(df.limit(0)).count() == 0


def test_popular_answers_find_all(spark):
    """A turn of phrase and an answer that thousands share must not hide a pair."""
    rows = [(f"{s}{i}", "d", f"What did Name{i}x Other{i}y do for a living{' exactly' if s == 'e' else ''}?", ["clerk"], "fit" if s == "f" else "dev", None, None) for i in range(250) for s in "fe"]
    got = {(r.train_id, r.eval_id) for r in overlap.overlaps(spark.createDataFrame(rows, CAL)).collect()}
    assert got == {(f"f{i}", f"e{i}") for i in range(250)}


def test_popular_subject_in_other_words(spark):
    """Of a subject and an answer in many questions, two that are worded differently are found."""
    rows = [(f"{s}{i}", "d", f"What did Name{i}{s}x Other{i}{s}y do for a living?", ["clerk"], "fit" if s == "f" else "dev", None, None) for i in range(250) for s in "fe"]
    rows += [(f"y{i}", "d", f"Why did Zorvad Kleminth do for a living {1000 + i} things?", ["clerk"], ("fit", "dev")[i % 2], None, None) for i in range(60)]
    rows += [("f", "d", "Please tell me what did Zorvad Kleminth do for a living", ["clerk"], "fit", None, None), ("e", "d", "What exactly did Zorvad Kleminth do for a living originally?", ["clerk"], "dev", None, None)]
    assert {(r.train_id, r.eval_id) for r in overlap.overlaps(spark.createDataFrame(rows, CAL)).collect()} == {("f", "e")}


def test_overlaps_against_brute_force(spark):
    """Misspelt names, other words around them, few fingerprints in common: all pairs of enough coverage are found."""
    rng = random.Random(7)
    names = ["".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(4)) for _ in range(25)]

    def spelt(w):
        i = rng.randrange(len(w) - 1)
        return rng.choice([w, w, w[:i] + w[i + 1 :], w[:i] + "x" + w[i:], w[:i] + "x" + w[i + 1 :], w[:i] + w[i + 1] + w[i] + w[i + 2 :]])

    turns = ["what did {} {} do for a living", "when did {} {} open the old mill", "who taught {} {} to play the organ", "please tell me what {} {} did for a living", "which {} of {} stood by the long river"]
    rows = [(f"{k}", "d", rng.choice(turns).format(spelt(rng.choice(names)), spelt(rng.choice(names))) + rng.choice(["", " originally", " then"]), [rng.choice("AB")], ("fit", "dev")[k % 2], None, None) for k in range(500)]
    classes = {r[2] for r in rows}
    n = {}
    for q in classes:
        for w in set(q.split(" ")):
            n[w] = n.get(w, 0) + 1
    usual = {w for w in n if n[w] > overlap.RARE * len(classes)}
    assert not usual.issuperset(n)
    expect = {(a[0], b[0]) for a in rows for b in rows if a[4] == "fit" and b[4] == "dev" and a[3] == b[3] and (a[2] == b[2] or overlap.coverage(a[2], b[2], usual) >= overlap.COVERAGE)}
    assert {(r.train_id, r.eval_id) for r in overlap.overlaps(spark.createDataFrame(rows, CAL)).collect()} == expect and expect


def test_a_name_near_a_misspelt_usual_word(spark):
    """A name that aligns with what may be a usual word misspelt (``wuld``) is a name in common."""
    rows = [("f", "d", "what was the trade of wuld before the great flood", ["clerk"], "fit", None, None), ("e", "d", "what was the trade of wule before the great flood", ["clerk"], "dev", None, None)]
    rows += [("g", "d", "what was the trade of hidrour wuld before the great flood", ["mason"], "dev", None, None), ("h", "d", "what was the trade of wule draberk before the great flood", ["mason"], "fit", None, None)]
    rows += [(f"t{i}", "d", f"what was the trade of n{i}a m{i}b before the great flood", [f"A{i}"], "fit", None, None) for i in range(300)]
    assert {(r.train_id, r.eval_id) for r in overlap.overlaps(spark.createDataFrame(rows, CAL)).collect()} == {("f", "e"), ("h", "g")}


def test_candidates_lose_no_pair():
    """Whatever is misspelt, questions of enough coverage have a name that may align or frames that may fit."""
    rng = random.Random(13)
    words_ = "what did the for living when was old mill come taught play organ winter orchard town built founded".split()
    usual, near = set(words_), 0
    frames = overlap.Frames(usual)

    def spelt(w):
        i = rng.randrange(len(w) - 1)
        return rng.choice([w[:i] + w[i + 1 :], w[:i] + "x" + w[i:], w[:i] + "o" + w[i + 1 :], w[:i] + w[i + 1] + w[i] + w[i + 2 :]])

    for _ in range(4000):
        x = [rng.choice(words_) for _ in range(rng.randrange(3, 11))]
        for _ in range(rng.randrange(3)):
            x[rng.randrange(len(x))] = rng.choice(["zorvad", "lome", "42", spelt(spelt(rng.choice(words_)) + "e")])
        y = [rng.choice([w, w, w, spelt(w) if len(w) > 2 else w, rng.choice(words_)]) for w in x]
        y[rng.randrange(len(y)) :][: rng.randrange(2)] = []
        y.insert(rng.randrange(len(y) + 1), rng.choice(["please", "lome", "kleminth"]))
        a, b = " ".join(x), " ".join(y)
        (fa, na, la), (fb, nb, lb) = frames.frame(a), frames.frame(b)
        if overlap.coverage(a, b, usual) >= overlap.COVERAGE:
            near += 1
            assert {*na} & {*nb, *lb} or {*la} & {*nb} or overlap.reach(fa, fb.replace("*", "+"), usual) >= overlap.COVERAGE
    assert near > 500


def test_chains_of_seeds():
    """Selected n-grams of equal stretches are shared, chains grow in both, anchors are equal words, and the coverage is that
    of a full alignment."""
    rng = random.Random(11)
    words_ = ["what", "did", "the", "old", "harbour", "zorvadiel", "kleminthor", "for", "living", "river"]
    usual = set(words_) - {"zorvadiel", "kleminthor"}
    for _ in range(300):
        x = [rng.choice(words_) for _ in range(rng.randrange(1, 14))]
        y = list(x)
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(y) + 1)
            y[k : k + rng.randrange(2)] = [rng.choice(words_)] * rng.randrange(2)
        a, b = " ".join(x), " ".join(y)
        if not b:
            continue
        run = max((n for i in range(len(a)) for n in range(1, len(a) - i + 1) if a[i : i + n] in b), default=0)
        if run >= overlap.GRAM + overlap.WINDOW - 1:
            assert overlap.prints(a).keys() & overlap.prints(b).keys()
        c = overlap.chain(a, b)
        assert all(i < k and j < m for (i, j), (k, m) in zip(c, c[1:]))
        w = overlap.anchors(a, b)
        assert all(x[i] == y[j] for i, j in w) and all(i < k and j < m for (i, j), (k, m) in zip(w, w[1:]))
        full = overlap.settled(*overlap.between_ends(x, y), len(x) + len(y), usual)
        assert overlap.coverage(a, b, usual) >= overlap.COVERAGE or full < overlap.COVERAGE
        assert overlap.coverage(a, b, usual) <= 2 * overlap.align(x, y)[0] / (len(x) + len(y)) + 1e-9


def test_a_name_near_a_usual_word():
    """A name that resembles a word of the other side doesn't make two questions one."""
    a, b = "when did the first edition of the winter of sapea kepeck come out", "when did the first edition of the orchard of lome fapaim come out"
    usual = set(a.split()) - {"sapea", "kepeck"} | {"orchard"}
    assert overlap.coverage(a, b, usual) == overlap.coverage(b, a, usual) == 0


def test_coverage_by_record(spark, tmp_path):
    from quillarn.llm import queries

    rows = [("f", "d", "who built the tower of a b", ["X"], "fit", None, None), ("e", "d", "who built the tower of a b then", ["X"], "dev", None, None)]
    spark.createDataFrame(rows * 2, CAL).write.parquet(f"{tmp_path}/calibration.parquet")
    assert [tuple(r) for r in queries.p7_coverage(spark, str(tmp_path)).collect()] == [("f", "e", "dev", "d", 0.9333)]


def test_report_has_every_source(spark):
    q = "who built the tower of a b"
    rows = [("f", "d", q, ["X"], "fit", None, None), ("e", None, q, ["X"], "dev", None, None), ("g", "d", "what else", ["X"], "dev", None, None), ("h", "z", q, None, "audit", None, None)]
    df = spark.createDataFrame(rows, CAL)
    got = {tuple(r) for r in overlap.report(overlap.overlaps(df), df).collect()}
    assert got == {("dev", None, 1, 1, 1, 1.0), ("dev", "d", 1, 0, 0, None), ("audit", "z", 1, 0, 0, None)}


# 8: ids


@pytest.mark.skipif(not VOCABULARY.exists(), reason="no tokenizers")
def test_ids_equal_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(VOCABULARY))
    t.encode_special_tokens = True
    rng = random.Random(8)
    texts = ["", None, "a", "<|endoftext|> x", "  two  blanks \n\n\ttab nbsp　wide line\x1c\x85", "don't we'll I'M 12345 ½ ٣٤٥", "日本語 👩‍👩‍👧 é \U0001fae9 Ᲊ", "x" * 50_000, " " * 3000]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x500), rng.randrange(0x2000, 0x2070), 32, 10])) for _ in range(200)) for _ in range(30)]
    df = spark.createDataFrame([(i, x, "s", "c") for i, x in enumerate(texts)], DOC).repartition(3)
    got = {r.doc_id: r.ids for r in encode.encode(df).collect()}
    for i, x in enumerate(texts):
        assert got[i] == t.encode(x or "", add_special_tokens=False).ids, repr(x)[:80]
    assert encode.encode(df.limit(0)).count() == 0
    assert {r.doc_id: r.text for r in encode.decode(encode.encode(df)).collect()} == {i: x or "" for i, x in enumerate(texts)}
    assert encode.decode(df.select("doc_id", F.lit(None).cast("array<int>").alias("ids")).limit(1)).first().text is None


@pytest.mark.skipif(not VOCABULARY.exists(), reason="no tokenizers")
def test_words_of_any_length_equal_the_library(monkeypatch):
    """Rounds that go on after a query's end, and pairs that overlap, give the library's ids."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    monkeypatch.setattr(encode, "ROUNDS", 3)
    t = Tokenizer.from_file(str(VOCABULARY))
    m = encode.Merger(str(VOCABULARY))
    rng = random.Random(4)
    texts = ["x" * 5000, "ab" * 700, "日本" * 200, "", "a"] + ["".join(rng.choices("abxe", k=rng.randrange(1, 300))) for _ in range(100)]
    texts = list(dict.fromkeys(texts))
    ids, sizes = m.merge(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [t.encode(x).ids for x in texts]


# 9: mixes


def test_quotas():
    q = mix.quotas([("a", 0.5, 1), ("b", 0.3, 10), ("c", 0.2, 10), ("none", 0.0, 1)], {"a": 10, "b": 100, "c": 100}, 210)
    assert q["a"] == 10 and q["b"] == pytest.approx(120) and q["c"] == pytest.approx(80) and q["none"] == 0
    assert mix.quotas([("a", 1.0, 2)], {"a": 10}, 100) == {"a": 20.0}


@pytest.mark.skipif(not VOCABULARY.exists(), reason="no tokenizers")
def test_mix(spark):
    rng = random.Random(9)
    docs = [(i, " ".join("word" for _ in range(rng.randrange(1, 60))), rng.choice(["a", "a", "b", "c", None, "unwanted"]), "c") for i in range(900)] + [(900, None, "a", "c"), (901, "", "b", "c")]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 3), ("c", 0.05, 2), ("missing", 0.05, 2)], "source string, target_share double, max_repeat int")
    df = spark.createDataFrame(docs, DOC)
    mixed, shares = mix.mix(df, targets, block=256)
    rows = mixed.collect()
    uses = {}
    for r in rows:
        assert r.source in {"a", "b", "c"}
        uses.setdefault((r.source, r.doc_id), []).append(r.use)
    assert all(len(set(u)) == len(u) <= {"a": 1, "b": 3, "c": 2}[s] for (s, _), u in uses.items())
    whole = sum(len((t or "").split()) for _, t, _, _ in docs)
    assert abs(sum(r.n_tokens for r in rows) - whole) < 0.02 * whole
    got = {r.source: r for r in shares.collect()}
    assert got["missing"].tokens == 0 and got["b"].most_uses == max(len(u) for (s, _), u in uses.items() if s == "b")
    assert sum(r.actual_share for r in got.values()) == pytest.approx(1)
    tokens = {s: sum(len((t or "").split()) for _, t, x, _ in docs if x == s) for s in "abc"}
    quota = mix.quotas([("a", 0.5, 1), ("b", 0.4, 3), ("c", 0.05, 2), ("missing", 0.05, 2)], tokens, whole)
    assert all(abs(got[s].tokens - quota[s]) < 60 for s in "abc")


# 10: encodings


def test_chains_undo_what_they_do():
    for c in mojibake.chains():
        for text in ("é", "über Größe", "ñandú", "łódź"):
            wrong = c.garble(text)
            if wrong != text:
                assert all(c.undo(r) == text for r in [wrong]) or c.right in {"shift_jis", "euc_jp", "gbk"} or c.right == "utf-8" and c.undo(wrong) != wrong


def test_second_reading_may_be_another():
    """Text read wrongly twice, by two encodings, is among the candidates."""
    by = {c.wrong: c for c in mojibake.chains() if c.right == "utf-8"}
    for first, second in (("cp1252", "mac_roman"), ("latin-1", "cp1252"), ("cp437", "cp1251"), ("cp1252", "cp1252")):
        wrong = by[second].garble(by[first].garble("é"))
        assert ("é", False) in mojibake._repairs(wrong), (first, second)


def test_margins_count_every_run():
    """Neither the length of a text nor the number of its runs keeps one of them from the margins."""
    m = mojibake.Model(np.zeros(mojibake.SLOTS))

    def tally(*texts):
        return m.tally([(w, 1) for t in texts for w in mojibake.windows_of(t)])

    texts = ["é" + " ordinary words" * 500 + " später" * 70, "naïve é ü " * 300]
    runs = [len(mojibake.RUN.findall(t)) for t in texts]
    assert (tally(*texts) == tally(texts[0]) + tally(texts[1])).all()
    one = tally("x é y")[:, 0].sum()
    assert tally(" é" * 71)[:, 0].sum() == 71 * one and one and runs[0] == 71
    assert (m.tally([("x é y"[:3] + " y", 71)]) == 71 * m.tally([("x é y"[:3] + " y", 1)])).all()
    assert tally(" é x" * 200)[:, 1].sum() > 100


def test_margins_are_cross_fitted(spark, monkeypatch):
    """A run is scored by the half that its record, and a copy of it, isn't in."""
    docs = spark.createDataFrame([(i, "Größe der Brücke", "s", "x") for i in range(40)], DOC)
    calls = []
    monkeypatch.setattr(mojibake.Model, "settle", lambda self, t: calls.append(t.sum()))
    mojibake.train(docs)
    assert calls[0] > 0


def test_long_texts_set_the_margins(spark):
    text = "Le café près de la forêt était fermé, où l'élève à côté rêvait déjà. "
    docs = spark.createDataFrame([(i, text * 80 + f"Numéro {i}", "s", "x") for i in range(20)], DOC)
    assert mojibake.train(docs).margin != mojibake.Model(np.zeros(mojibake.SLOTS)).margin


def test_restored(spark):
    rng = random.Random(10)
    names = ["Gréfor", "Jömil", "Hélas", "Köder", "Brénd", "Zésar", "Pöland", "Tédal"]
    clean = [" ".join(f"The mill of {rng.choice(names)} was sold in 1{rng.randrange(100, 999)}." for _ in range(8)) for _ in range(300)]
    garbled = {300: clean[0].encode().decode("cp1252"), 301: clean[1].encode().decode("mac_roman"), 302: clean[2].encode("cp1252").decode("cp437"), 303: clean[3][:60] + "caf�", 304: clean[4].encode("latin-1").decode("cp1251")}
    docs = [(i, t, "s", "c") for i, t in enumerate(clean)] + [(i, t, "s", "c") for i, t in garbled.items()] + [(400, None, "s", "c"), (401, "", "s", "c"), (402, "plain text", "s", "c"), (403, "naïve Ñandú — “quoted” 📘 слово", "s", "c")]
    got = {r.doc_id: r for r in mojibake.restored(spark.createDataFrame(docs, DOC)).collect()}
    assert set(got) == set(garbled)
    assert [got[300 + k].text for k in (0, 1, 2, 4)] == [clean[k] for k in (0, 1, 2, 4)]
    assert got[303].lost == 1


def test_scores_are_finite():
    m = mojibake.Model(np.zeros(mojibake.SLOTS))
    assert np.isfinite(m.logp("abc é")).all() and len(m.logp("a")) == 1
