"""Rules, shards, language, quality, near duplicates, lines and the pipeline on small tables."""

import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm.conftest import AWKWARD
from pyspark.sql import functions as F

from outings.llm import language, lines, near_dups, quality, rules, shards
from outings.llm.common import connected

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measured(text):
    words = WORD.findall(text or "")
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = {g for g, n in Counter(grams).items() if n > 1}
    covered = {i + o for i, g in enumerate(grams) if g in often for o in range(3)}
    rows = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(rows) - len(set(rows)), len(covered))


def test_ledger(spark, awkward, nothing):
    rnd = random.Random(1)
    extra = [(100 + i, "".join(rnd.choice(["a ", "b ", "c ", "a b c ", "\n", "#", "|", "X"]) for _ in range(rnd.randint(0, 80)))) for i in range(60)]
    df = awkward.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    texts = {i: t for i, t, _ in AWKWARD} | dict(extra)
    got = rules.rule_rows(df).collect()
    assert len(got) == len(AWKWARD) + len(extra)
    for r in got:
        n = measured(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n, r.doc_id
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and not (r.base_failed and r.kept)
    assert rules.rule_rows(nothing).count() == 0 and rules.rule_rows(awkward).count() == len(AWKWARD)


def test_policies_and_ablations(prose):
    entries = rules.ledger(prose).cache()
    rows = rules.apply_policies(entries).collect()
    policy = rules.POLICIES[-1]
    hard, soft = rules.mask_of(policy.any_of), rules.mask_of(policy.counted)

    def kept(bits):
        return not bits & hard and bin(bits & soft).count("1") <= policy.at_most

    assert all(r.kept_v2 == kept(r.rule_bits) for r in rows)
    for a in rules.ablations(entries).collect():
        bit = rules.bit_of(a.rule)
        assert a.n_failed == sum(bool(r.rule_bits & bit) for r in rows)
        assert a.n_failed_alone == sum(r.rule_bits == bit for r in rows)
        assert a.n_kept_without == sum(kept(r.rule_bits & ~bit) for r in rows)
    assert {r.n_failed for r in rules.ablations(entries.limit(0)).collect()} == {0}


@pytest.mark.parametrize("size", [1, 2, 3, 5, 24, 100, 1000, 4097])
def test_permutation(size):
    at = shards.permute(np.arange(size), size)
    assert sorted(at) == list(range(size))
    assert (shards.permute(at, size, back=True) == np.arange(size)).all()
    shard, slot = shards.place(np.arange(size), size, 24)
    assert (shards.row_at(shard, slot, size, 24) == np.arange(size)).all()


def test_shards(spark, awkward, nothing, prose, tmp_path):
    got = shards.shard_rows(awkward).collect()
    texts = {i: t for i, t, _ in AWKWARD}
    assert len(got) == len(AWKWARD) and {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    for r in got:
        t = texts[r.doc_id]
        assert (r.size, r.text_crc32) == (len((t or "").encode()) + 8, None if t is None else zlib.crc32(t.encode()))
    one, two = (sorted(map(tuple, shards.shard_rows(prose.repartition(n)).collect())) for n in (1, 7))
    assert one == two
    sizes = Counter(r[5] for r in one)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r[6] for r in one if r[5] == s) == list(range(n)) for s, n in sizes.items())
    assert shards.shard_rows(nothing).count() == 0
    shards.write_shards(prose, str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.row.doc_id for r in back.select("row").collect()) == sorted(r.doc_id for r in prose.collect())


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    net = language.Network(3, 4, 1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    data, lengths, labels = rng.integers(0, 256, (5, 9)), np.array([9, 9, 4, 1, 7]), np.array([0, 1, 2, 0, 1])
    _, grads = net.gradients(data, lengths, labels)
    for name in ("fE", "fU", "fc", "fW", "bE", "bU", "bc", "bW", "o"):
        flat = net.p[name].reshape(-1)
        at = int(np.abs(grads[name]).reshape(-1).argmax())
        keep = flat[at]
        flat[at] = keep + 1e-3
        up, _ = net.gradients(data, lengths, labels)
        flat[at] = keep - 1e-3
        down, _ = net.gradients(data, lengths, labels)
        flat[at] = keep
        assert abs((up - down) / 2e-3 - grads[name].reshape(-1)[at]) < 2e-4, name


def test_language(spark, awkward, nothing, prose):
    model = language.fit(prose)
    rows = language.predict(prose, model).join(prose.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    assert sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)
    odd = language.predict(awkward, model).collect()
    assert len(odd) == len(AWKWARD)
    for r in odd:
        text = next(t for i, t, _ in AWKWARD if i == r.doc_id)
        assert (r.lang_pred == "und") == (text is None or not language.LETTER.search(text))
    assert language.predict(nothing, model).count() == 0
    blank = language.fit(awkward.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in language.predict(awkward, blank).collect()} == {"und"}
    spans = language.spans_by_language(prose, model).groupBy("doc_id").agg(F.sum("length").alias("n"))
    sizes = {r.doc_id: r.n for r in spans.collect()}
    assert all(sizes.get(r.doc_id, 0) == len(r.text.encode()) for r in prose.collect())
    kept = language.keep_identified(awkward, model, least=0.0)
    assert kept.columns == awkward.columns and kept.where("doc_id in (0, 1, 2, 9)").count() == 0
    assert kept.count() == sum(language.LETTER.search(t or "") is not None for _, t, _ in AWKWARD)


def test_language_ignores_held_out_rows(prose):
    fold = language.held_out(F.col("doc_id"))
    changed = prose.withColumn("lang", F.when(fold, F.lit("zz")).otherwise(F.col("lang")))
    a, b = language.fit(prose), language.fit(changed)
    assert a.languages == b.languages and all((a.network.p[k] == b.network.p[k]).all() for k in a.network.p)


def test_quality(spark, awkward, nothing, prose):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = quality.fit(docs, quality.graded(labels))
    assert model.grades == [0, 1, 2] and (np.diff(model.thresholds) > 0).all()
    got = quality.grade_documents(docs, model).where("held_out").join(labels, "doc_id").collect()

    def share(q, t):
        own = [r.kept for r in got if (r.quality, r.toxic) == (q, t)]
        return sum(own) / len(own)

    assert share(1, 0) > 0.97 and share(0, 0) < 0.15 and share(0, 1) < 0.15 and share(1, 1) < 0.5
    assert all(0 <= r.expected_grade <= 2 and 0 <= r.tail_probability <= 1 for r in got)
    assert quality.grade_documents(awkward, model).count() == len(AWKWARD)
    assert quality.grade_documents(nothing, model).count() == 0
    assert quality.fit(docs, quality.graded(labels).limit(0)) is None
    assert all(r.kept and r.expected_grade is None for r in quality.grade_documents(awkward, None).collect())
    assert quality.keep_good(awkward, model).columns == awkward.columns


def shingles(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def brute_components(rows):
    rows = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for n, (_, s) in enumerate(rows):
        for g in s:
            holders[g].append(n)
    shared = Counter()
    for own in holders.values():
        shared.update((a, b) for i, a in enumerate(own) for b in own[i + 1:])
    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(rows[a][1]) + len(rows[b][1]) - n):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for n, (i, _) in enumerate(rows):
        least[root(n)] = min(i, least.get(root(n), i))
    return sorted((i, len(s), least[root(n)]) for n, (i, s) in enumerate(rows))


def as_rows(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def test_near_duplicates(prose):
    assert as_rows(near_dups.near_duplicates(prose)) == brute_components([(r.doc_id, r.text) for r in prose.collect()])


def test_near_duplicates_awkward(awkward, nothing):
    got = near_dups.near_duplicates(awkward)
    assert as_rows(got.where("doc_id is not null")) == brute_components([(i, t) for i, t, _ in AWKWARD if i is not None])
    rest = got.where("doc_id is null").collect()
    assert [(r.n_shingles, r.component_id, r.kept) for r in rest] == [(1, None, True)]
    assert near_dups.near_duplicates(nothing).count() == 0
    assert near_dups.keep_one(awkward).columns == awkward.columns


def test_copies_that_meet_only_in_the_original(spark):
    """Many copies, each similar enough to the original but not to most of the others, and a passage that all texts share."""
    rnd = random.Random(2)
    base = [f"w{i}" for i in range(300)]
    rows = [(0, " ".join(base))]
    for i in range(1, 260):
        own = list(base)
        for at in rnd.sample(range(300), 8):
            own[at] = f"x{i}-{at}"
        rows.append((i, " ".join(own)))
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(1000 + i, passage + " " + " ".join(f"q{i}-{j}" for j in range(rnd.randint(5, 90)))) for i in range(250)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert as_rows(near_dups.near_duplicates(df)) == brute_components(rows)


def test_least_equal_minima():
    """The chance that a pair at the threshold is dropped before its whole sets are compared."""
    plan = near_dups.Forest()
    p = plan.percent / 100
    assert sum(math.comb(plan.hashes, k) * p**k * (1 - p)**(plan.hashes - k) for k in range(plan.least)) < 2e-7


def test_connected(spark):
    rnd = random.Random(3)
    links = [(i, i + 1) for i in range(300)] + [(1000 + rnd.randrange(200), 1000 + rnd.randrange(200)) for _ in range(120)]
    df = spark.createDataFrame(links, "a long, b long").repartition(5)
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    expected = {(x, root(x)) for link in links if link[0] != link[1] for x in link}
    for contract in (False, True):
        assert {tuple(r) for r in connected(df, contract).collect()} == expected
    assert connected(df.limit(0)).count() == 0


def normal(line):
    return re.sub(r"\d", "0", re.sub(r"[^\w]+|_", " ", line.lower())).strip()


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        before, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, before + (x != y))
    return row[-1]


def test_lines(spark):
    """Against brute force over the edit distances of all pairs of lines; the operator's blocks play no part."""
    rnd = random.Random(6)
    vocabulary = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(3, 8))) for _ in range(200)]
    base = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(8, 30))) for _ in range(40)]
    rows = []
    for i in range(120):
        own = []
        for _ in range(rnd.randint(0, 5)):
            words = rnd.choice(base).split()
            if rnd.random() < 0.6:
                words[rnd.randrange(len(words))] += rnd.choice(["!", "s", "", " extra", "7"])
            own.append(rnd.choice(["  ", ""]) + " ".join(words))
        rows.append((i, "\n".join(own) if own else rnd.choice([None, "", "\n", "short\nshort"])))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS gone", "2 AS pos", "'x' AS of").repartition(3)
    places = defaultdict(list)
    for i, t in rows:
        for pos, line in enumerate((t or "").split("\n")):
            if normal(line):
                places[normal(line)].append((i, pos))
    names = sorted(places)
    parent = {n: n for n in names}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [(a, b) for i, a in enumerate(names) for b in names[i + 1:] if min(len(a), len(b)) >= 40 and abs(len(a) - len(b)) <= 30
             and edit_distance(a, b) <= max(len(a), len(b)) // 10]
    assert len(links) > 20
    for a, b in links:
        parent[root(a)] = root(b)
    groups = defaultdict(list)
    for n in names:
        groups[root(n)] += places[n]
    gone = {p for own in groups.values() for p in sorted(own)[1:]}
    report = {r.doc_id: r for r in lines.dedup_report(df).collect()}
    assert {(i, p) for i, r in report.items() for p in r.gone} == gone and len(report) == len(rows)
    assert all(report[i].n_lines == (len(t.split("\n")) if t else 0) for i, t in rows)
    out = lines.without_repeats(df)
    assert out.columns == df.columns
    left = {r.doc_id: r.text for r in out.collect()}
    for i, t in rows:
        own = [x for p, x in enumerate((t or "").split("\n")) if (i, p) not in gone]
        if t is None or not report[i].n_removed:
            assert left[i] == t
        elif any(x.strip() for x in own):
            assert left[i] == "\n".join(own)
        else:
            assert i not in left


def test_rows_that_share_an_id_keep_their_own_lines(spark):
    rows = [(1, "first line\nsame line here"), (5, "other\nsame line here"), (5, "unique opening\nunique second line"), (5, "other\nsame line here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(r.text for r in lines.without_repeats(df).collect()) == Counter(
        {"first line\nsame line here": 1, "other": 2, "unique opening\nunique second line": 1})


@pytest.mark.parametrize("n", [200, 800])
def test_template_lines_give_pairs_in_proportion(spark, n):
    """Lines that differ in one name: one group, from a number of pairs that does not grow with the square."""
    rnd = random.Random(n)

    def word():
        return "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))

    rows = [(i, f"the visitor {word()} has signed the book of the old museum at the gate on the morning of a cold and rainy day in the spring") for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    plan = lines.Lines(crowd=64)
    found = lines.occurrences(df, plan, "doc_id", "text")
    assert lines.candidate_pairs(found, plan).count() <= 30 * n
    kept = lines.without_repeats(df, plan).count()
    assert kept == 1


def test_lines_awkward(awkward, nothing):
    assert lines.dedup_report(awkward).count() == len(AWKWARD)
    assert lines.dedup_report(nothing).count() == 0
    out = lines.without_repeats(awkward)
    assert out.columns == awkward.columns and out.where("doc_id in (0, 1, 2, 3)").count() == 4


def test_lines_are_native(spark, prose):
    plan = lines.dedup_report(prose)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    plan = rules.rule_rows(prose)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


def test_stages_against_plain_python(spark):
    """Every stage of the pipeline on some documents, judged again one by one or pair by pair."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 900 or text is null").limit(70)
    rows = [r.asDict() for r in docs.collect()]
    extra = [dict(rows[0], doc_id=10 ** 6), dict(rows[1], doc_id=10 ** 6 + 1, text=(rows[1]["text"] or "") + " and one more"),
             dict(rows[2], doc_id=10 ** 6 + 2, text=None), dict(rows[2], doc_id=None, text="no id"), dict(rows[3], doc_id=rows[3]["doc_id"])]
    docs = spark.createDataFrame(rows + extra, docs.schema).repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    model = language.fit(docs)

    def known(text):
        if text is None or not language.LETTER.search(text):
            return False
        return model.score([text.encode()])[0].max() >= 0.3

    def count(found):
        return Counter((r["doc_id"], r["text"]) for r in found)

    every = [r.asDict() for r in docs.collect()]
    kept = stages["language"](spark, docs, sf).collect()
    assert count(kept) == count(r for r in every if known(r["text"]))
    graded = quality.fit(docs, quality.graded(spark.read.parquet(f"{sf}/labels.parquet")))
    kept = stages["quality"](spark, docs, sf).collect()
    assert count(kept) == count(r for r in every if graded is None or graded.tails([(r["text"] or "").encode()])[0, -1] >= 0.5)
    kept = stages["near_duplicates"](spark, docs, sf).collect()
    gone = {(i, t) for (i, t), (_, _, c) in zip([(r["doc_id"], r["text"]) for r in every if r["doc_id"] is not None], sorted_components(every)) if i != c}
    assert count(kept) == count(r for r in every if (r["doc_id"], r["text"]) not in gone)
    pieces = stages["packing"](spark, docs, sf).collect()
    assert Counter(r.doc_id for r in pieces if r.start == 0) == Counter(r["doc_id"] for r in every)


def sorted_components(rows):
    """(id, size, component) of the rows with an id, in their order, by brute force."""
    with_id = [(r["doc_id"], r["text"]) for r in rows if r["doc_id"] is not None]
    found = defaultdict(list)
    for i, n, c in brute_components(with_id):
        found[i, n].append((i, n, c))
    sizes = [(i, len(shingles(t or ""))) for i, t in with_id]
    return [found[key][0] for key in sizes]


def test_stages_take_any_table(spark, awkward, nothing):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    for df in (nothing, awkward):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, sf)
            assert name == "packing" or out.columns == df.columns
            assert out.count() >= (0 if df is nothing else 1), name


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept, before = docs, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, sf).toArrow())
        assert kept.columns == docs.columns and 0 < kept.count() <= before, name
        before = kept.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, sf)
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in kept.collect()}


def test_one_document_of_each_group_and_no_other_text_of_its_id(spark):
    a, b, c = ("".join(f"{x}{i} " for i in range(30)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (6, c), (None, c), (7, None), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS verdict", "2 AS cls")
    out = near_dups.keep_one(df)
    assert out.columns == df.columns and Counter((r.doc_id, r.text) for r in out.collect()) == Counter(r for r in rows if r != (5, a))


def test_no_languages_no_judgement(spark, nothing):
    df = spark.createDataFrame([(1, "some text", None), (2, None, None)], "doc_id long, text string, lang string")
    model = language.fit(df)
    assert model.languages == [] and language.keep_identified(df, model).count() == 2
    assert language.keep_identified(nothing, language.fit(nothing)).count() == 0


def test_texts_of_no_learned_language_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    foreign = ["Быстрая коричневая лиса прыгает через ленивую собаку и бежит в лес за зайцем.", "日本語の文章はここにあります。とても長い文章です。",
               "한국어 문장을 여기에 적어 봅니다. 아주 긴 문장입니다.", "asdkfj qwpoe zxmcnv qpwoei zmxncb alskdj fhgut qwxz pqzmx vbnqk",
               "Szybki brązowy lis przeskakuje nad leniwym psem i biegnie do lasu za zającem.", "1234 5678 --- !!!"]
    extra = spark.createDataFrame([(10 ** 6 + i, t) for i, t in enumerate(foreign)], "doc_id long, text string")
    model = language.fit(docs)
    kept = language.keep_identified(docs.unionByName(extra, allowMissingColumns=True), model)
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    lost = docs.where("text is not null and length(text) > 200").where(~F.col("doc_id").isin(list(ids))).count()
    assert not any(i >= 10 ** 6 for i in ids) and lost == 0 and len(ids) >= 0.99 * docs.count()


def test_samples_are_bounded(spark, prose):
    """Rows that share an id, or are the same row, do not add to the sample, and no text is shuffled."""
    one, two = [i for i in range(1, 50) if zlib.crc32(str(i).encode()) % 3 != 1][:2]
    same = spark.range(20000).selectExpr(f"{one}L AS doc_id", "concat('text of some length number ', id, repeat(' and so on', 60)) AS text", "'en' AS lang")
    copies = spark.range(5000).selectExpr(f"{two}L AS doc_id", "repeat('the very same text again ', 40) AS text", "'de' AS lang")
    plan = language.Plan()
    windows = language.sample_windows(same.unionByName(copies), plan, "doc_id", "text", "lang")
    counts = {r.lang: r["count"] for r in windows.groupBy("lang").count().collect()}
    assert counts["en"] <= plan.per_language * plan.per_document and counts["de"] <= plan.per_document
    explained = windows._jdf.queryExecution().executedPlan().toString()
    assert all("text" not in line for line in explained.splitlines() if "Exchange" in line)
    labels = spark.createDataFrame([(one, 1, 0), (two, 0, 1)], "doc_id long, quality int, toxic int")
    seen = []
    whole = quality.fit_arrays
    quality.fit_arrays = lambda ends, buckets, grade, plan: seen.append(len(grade)) or whole(ends, buckets, grade, plan)
    try:
        quality.fit(same.unionByName(copies), quality.graded(labels))
    finally:
        quality.fit_arrays = whole
    assert seen == [2]


@pytest.mark.parametrize("crowd", [60, 600])
def test_pairs_in_a_crowd(spark, crowd):
    """Texts that share most of a passage and are just not similar; pairs of them are, by rare words they share or by the passage alone."""
    rnd = random.Random(crowd)
    passage = " ".join(f"p{i}" for i in range(254))
    rows, planted = [], []
    for i in range(crowd):
        rows.append((i, passage + " " + " ".join(f"q{i}-{j}" for j in range(46))))
    for i in range(0, 40, 2):
        own = [f"z{i}-{j}" for j in range(46)]
        for side in (0, 1):
            at = 10000 + i + side
            rows.append((at, passage + " " + " ".join(own[:12] + [f"y{at}-{j}" for j in range(34)])))
    # Shorter ones that the passage alone makes similar to each other, not to the rest.
    rows += [(20000 + i, " ".join(passage.split()[i:]) + " " + " ".join(f"v{i}-{j}" for j in range(39))) for i in range(3)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    expected = brute_components(rows)
    joined = sum(i != c for i, _, c in expected)
    assert joined == 22
    # Without rounds that look far, so the crowd alone has to find them.
    for forest in (near_dups.Forest(), near_dups.Forest(reach=2)):
        assert as_rows(near_dups.near_duplicates(df, forest)) == expected


def test_copies_of_lines_of_any_length(spark):
    """Short lines, lines without letters and lines of a script without spaces: one occurrence of each stays, blank lines stay."""
    rnd = random.Random(8)
    han = ["".join(chr(0x4E00 + rnd.randrange(3000)) for _ in range(60)) for _ in range(3)]
    rows = [(1, f"Read more\n{han[0]}\n---\n\n  \nfoo"), (2, f"read more!\n---\nbar\n\n{han[0]}"), (3, f"***\nfoo\nFOO\n{han[1]}"),
            (4, f"{han[1][:30]}一{han[1][31:]}\n{han[2]}\nread\n \t")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    report = {r.doc_id: r.gone for r in lines.dedup_report(df).collect()}
    assert report == {1: [], 2: [0, 1, 4], 3: [1, 2], 4: [0]}
    left = {r.doc_id: r.text for r in lines.without_repeats(df).collect()}
    assert left == {1: rows[0][1], 2: "bar\n", 3: f"***\n{han[1]}", 4: f"{han[2]}\nread\n \t"}
    plan = lines.dedup_report(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_recall_of_lines_alike(spark):
    """Lines with one word put for another, or with letters changed, against the edit distance; the operator's hashes play no part."""
    rnd = random.Random(9)

    def word():
        return "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(3, 9)))

    rows, kinds = [], {}
    for kind in ("word", "letters_3", "letters_6", "letters_10"):
        for n in (10, 20, 30, 50):
            for _ in range(25):
                words = [word() for _ in range(n)]
                own = " ".join(words)
                if kind == "word":
                    words[rnd.randrange(n)] = word()
                    other = " ".join(words)
                else:
                    letters = list(own)
                    for at in rnd.sample([i for i, c in enumerate(own) if c != " "], len(own) * int(kind.split("_")[1]) // 100):
                        letters[at] = rnd.choice("abcdefghijklmnopqrstuvwxyz")
                    other = "".join(letters)
                if own != other and len(own) >= 40 and len(other) >= 40 and edit_distance(own, other) <= max(len(own), len(other)) // 10:
                    kinds[len(rows) + 1] = kind, n
                    rows += [(len(rows), own), (len(rows) + 1, other)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    gone = {r.doc_id for r in lines.dedup_report(df).where("n_removed > 0").collect()}
    assert gone <= set(kinds)
    found, total = Counter(kinds[i][0] for i in gone), Counter(k for k, _ in kinds.values())
    assert found["word"] >= 0.98 * total["word"] and found["letters_3"] >= 0.98 * total["letters_3"]
    assert found["letters_6"] >= 0.95 * total["letters_6"] and found["letters_10"] >= 0.8 * total["letters_10"]


@pytest.mark.parametrize("crowd", [16, 4096])
def test_partners_far_apart_in_a_crowded_key_are_met(spark, crowd):
    """Lines of a small vocabulary share their keys with many others; partners that do not stand next to each other are linked all the same."""
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(16)]
    rows = []
    for _ in range(30):
        words = [rnd.choice(vocabulary) for _ in range(14)]
        other = list(words)
        other[rnd.randrange(14)] = rnd.choice(vocabulary)[:rnd.choice((3, 5, 7))]
        rows += [(0, " ".join(words)), (0, " ".join(other))]
    rnd.shuffle(rows)
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string").repartition(2)

    def groups(plan):
        found = defaultdict(set)
        for r in lines.line_groups(df, plan).collect():
            found[r.grp].add((r.doc_id, r.pos))
        return {frozenset(g) for g in found.values()}

    whole = groups(lines.Lines(near=len(rows)))
    assert len(whole) > 15 and groups(lines.Lines(near=1, crowd=crowd)) == whole


def test_unlike_lines_of_a_crowded_key_give_no_pairs(spark, monkeypatch):
    """Lines of a small vocabulary that share their keys and are not alike: texts are compared for few of their pairs, planted partners are still linked."""
    rnd, n = random.Random(4), 300
    vocabulary = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(40)]
    texts = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(6, 12))) for _ in range(n)]
    planted = {}
    for i in range(0, n, 15):
        letters = list(texts[i])
        for at in rnd.sample(range(len(letters)), len(letters) // 20):
            letters[at] = "z" if letters[at] != " " else " "
        planted[len(texts)] = i
        texts.append("".join(letters))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    seen, whole = [], lines.confirmed
    monkeypatch.setattr(lines, "confirmed", lambda some, *rest: seen.append(some.count()) or whole(some, *rest))
    group = {r.doc_id: r.grp for r in lines.line_groups(df, lines.Lines(near=1)).collect()}
    assert len(seen) == 3 and seen[2] <= n // 10
    assert all(copy in group and group[copy] == group[i] for copy, i in planted.items())


def test_grams_of_lines_alike_differ_in_few_bits(spark):
    """Lines at the whole edit distance that alike ones may have, in every size, pass the test of grams; unlike ones do not."""
    rnd = random.Random(12)
    rows, pairs = [], []
    for size in (40, 60, 100, 200, 300, 400, 600, 900, 1500, 4900, 6000):
        for _ in range(12):
            one = "".join(rnd.choice("etaoinshr ") for _ in range(size - 2)).join("ab")
            other = list(one)
            for at in rnd.sample(range(size), size // 10):
                other[at] = rnd.choice("xyzwvu")
            pairs.append((size, len(rows), len(rows) + 1))
            rows += [(len(rows), one), (len(rows) + 1, "".join(other))]
    found = {r.f1: r for r in lines.grams_sketched(spark.createDataFrame(rows, "f1 long, norm string"), lines.Lines()).collect()}

    def differ(a, b):
        return sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip([found[a][f"g{i}"] for i in range(8)], [found[b][f"g{i}"] for i in range(8)]))

    assert len(found) == len(rows) and all(differ(a, b) <= found[a].most for _, a, b in pairs)
    unlike = [(x, y) for x, y in zip(pairs, pairs[1:]) if x[0] == y[0] <= 300]
    assert len(unlike) > 40 and sum(differ(x[1], y[1]) <= found[x[1]].most for x, y in unlike) <= 1


def test_features_are_made_in_small_slices():
    """What the quality and shingle steps hold at a time is bounded by slices of a megabyte."""
    import tracemalloc

    import pyarrow as pa

    from outings.llm.common import SMALL_SLICE_BYTES, slices

    batch = pa.RecordBatch.from_pydict({"text": pa.array([(b"%d word and another one " % i) * 400 for i in range(600)], pa.binary())})
    tracemalloc.start()
    for part in slices(batch, budget=SMALL_SLICE_BYTES):
        quality.features(part.column("text").to_pylist(), 17)
    assert tracemalloc.get_traced_memory()[1] < 110 << 20
    tracemalloc.stop()


def left_behind(spark, run, *purposes):
    """Intermediate folders for ``purposes`` that are there after ``run`` and were not before."""
    base = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")

    def there():
        return {name for name in os.listdir(base) if name.startswith(tuple(f"{p}-" for p in purposes))}

    before = there()
    run()
    return there() - before


def test_parts_of_lines_go_when_a_step_ends(spark):
    df = spark.createDataFrame([(i, f"the old bridge over the river is closed for repairs on day number{'abcdefgh'[i]} of this cold winter") for i in range(8)],
                               "doc_id long, text string")
    kept = []
    gone = ("line-pass", "line-texts", "line-ends", "line-rest", "line-crowds", "line-first")
    assert not left_behind(spark, lambda: kept.append(lines.without_repeats(df).count()), *gone)
    assert kept == [1] and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "true"


def test_lines_meet_in_any_number_of_passes(spark, prose):
    found = []
    for passes in (1, 3):
        plan = lines.Lines(passes=passes, crowd=64)
        names = lines.occurrences(prose.limit(60), plan, "doc_id", "text").dropDuplicates(["f1"])
        found.append({tuple(r) for r in lines.neighbours(names, plan).collect()})
    assert found[0] == found[1] and found[0]


def test_rows_of_crowded_keys_meet_the_bitmap_before_they_are_dealt(spark, monkeypatch):
    """Rows of other keys are not shuffled to be joined with the crowded ones; many crowded keys are looked up in passes, with the same rows."""
    rows = [(i, 100 + i, 0, [1, 2 + i % 2, 100 + i, 10_000 + i]) for i in range(300)]
    distinct = spark.createDataFrame(rows, "f1 long, size int, sketch long, blocks array<long>")
    keys = lines.line_keys(distinct, lines.Lines(), "f1").groupBy("key").count().where("count > 1").select("key")
    comps = spark.createDataFrame([(0, 0), (2, 0)], "node long, root long")
    plans, write = [], lines.materialized
    monkeypatch.setattr(lines, "materialized", lambda df, purpose: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, purpose))
    found = [{(r.f1, r.key, r.root, r.top) for r in lines.crowd_rows(distinct, keys, comps, plan).collect()} for plan in (lines.Lines(), lines.Lines(scarce=0))]
    assert found[0] == found[1] and len(found[0]) == 300 and {r[0] for r in found[0]} == set(range(300))
    assert len(plans) == 2 + lines.Lines().passes + 1
    for plan in [plans[0], *plans[2:-1]]:
        joins = re.findall(r"Join (\w+), .*", plan)
        assert "LeftSemi" not in joins and "key#" in re.search(r"Join \w+, .*", plan)[0]


def test_pairs_are_confirmed_in_passes_by_their_number(spark, monkeypatch):
    """Words are counted once per line, repeated ones too; many pairs of few texts take more passes, and give what the edit distance says."""
    base = "the old bridge over the river is closed for repairs on this cold winter day the the"
    norms = [base, base.replace("old", "odd"), base.replace("cold winter", "warm summer"), base + " the", " ".join(reversed(base.split())),
             "the the the the the the the the the the the the"]
    split = [n.split(" ") for n in norms]
    docs = spark.createDataFrame([(i, n) for i, n in enumerate(norms)], "doc_id long, text string")
    names = lines.occurrences(docs, lines.Lines(), "doc_id", "text")
    distinct = names.select("f1", F.struct("doc_id", "of", "pos").alias("at"))
    texts = lines.texts_of(distinct.select("f1"), distinct, docs, "doc_id", "text")
    known = {r.norm: r for r in texts.collect()}
    assert {n: (r.words, r.distinct) for n, r in known.items()} == {n: (len(w), len(set(w))) for n, w in zip(norms, split)}
    pairs = [(known[x].f1, known[y].f1) for i, x in enumerate(norms) for y in norms[:i]]
    some = spark.createDataFrame(pairs, "a long, b long")
    writes, write = [], lines.materialized
    monkeypatch.setattr(lines, "materialized", lambda df, purpose: writes.append(purpose) or write(df, purpose))
    found = {tuple(r) for r in lines.confirmed(some, texts, lines.Lines(passes=1)).collect()}
    assert writes == ["line-links"] * 2
    text = {r.f1: r.norm for r in known.values()}
    assert found == {(a, b) for a, b in pairs if edit_distance(text[a], text[b]) * 10 <= max(len(text[a]), len(text[b]))} and 3 <= len(found) < len(pairs)


def test_sets_go_when_pairs_are_confirmed(spark):
    words = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
    df = spark.createDataFrame([(i, " ".join(words * 2 + [f"end{i}"])) for i in range(4)], "doc_id long, text string")
    kept = []
    assert not left_behind(spark, lambda: kept.append(near_dups.keep_one(df).count()), "sets", "used", "neighbours", "split-pairs", "crowd-shingles")
    assert kept == [1]


def test_a_pair_is_looked_at_once(spark, monkeypatch):
    """Rounds meet the same pairs again; their minima and sets are not compared again."""
    rnd = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(200))
    rows = [(i, passage + " " + " ".join(f"q{i}-{j}" for j in range(rnd.choice((20, 28, 36))))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    seen = {}
    for name in ("promising", "confirmed"):
        def noted(pairs, *rest, name=name, whole=getattr(near_dups, name)):
            seen.setdefault(name, Counter()).update((r.a, r.b) for r in pairs.select("a", "b").collect())
            return whole(pairs, *rest)

        monkeypatch.setattr(near_dups, name, noted)
    assert as_rows(near_dups.near_duplicates(df)) == brute_components(rows)
    assert all(max(n.values()) == 1 and len(n) > 60 for n in seen.values()) and len(seen) == 2
