"""Collocations, ranked search and mixing against plain Python."""

import math
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from outings.llm.collocations import Automaton, Phrases, collocations, shard_counts
from outings.llm.mixing import Mix, mixed, subset_counts, take_mix
from outings.llm.ranked_search import Search, ranked


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def plain_collocations(rows, least, top, inside=50):
    counts = {}
    for lang, text in rows:
        own = counts.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            own.update(tuple(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        n = sum(v for k, v in f.items() if len(k) == 1)
        cand = {k: v for k, v in f.items() if len(k) > 1 and v >= least}
        rows = []
        for k, a in cand.items():
            if any(len(x) > len(k) and 100 * v >= inside * a and any(x[i:i + len(k)] == k for i in range(len(x) - len(k) + 1)) for x, v in cand.items()):
                continue
            score, _, left, right = min((10 ** 6 * a * a // (f[k[:j]] * f[k[j:]]), j, f[k[:j]], f[k[j:]]) for j in range(1, len(k)))
            rows.append((-score, -a, " ".join(k).encode(), left, right))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -s))
    return sorted(out)


def test_automaton_holds_its_paths():
    rng = np.random.default_rng(3)
    paths = rng.integers(1, 9, (400, 3)).astype(np.uint64) << np.uint64(58)
    for row, n in enumerate(rng.integers(1, 4, 400)):
        paths[row, n:] = 0
    paths = np.unique(paths, axis=0)
    weights = rng.integers(1, 5, len(paths))
    automaton = Automaton.unpack(Automaton.build(paths, weights).pack())
    known = dict(zip(map(tuple, paths.tolist()), weights.tolist()))
    own, counts = automaton.paths(3)
    assert dict(zip(map(tuple, own.tolist()), counts.tolist())) == known
    # Equal futures are one state.
    assert len(automaton.first) - 1 < 1 + len({p[:1] for p in known}) + len({p[:2] for p in known})
    asked = np.concatenate((paths, paths + (np.uint64(1) << np.uint64(62))))
    assert automaton.follow(asked).tolist() == [known.get(tuple(p), 0) for p in asked.tolist()]
    empty = Automaton.unpack(Automaton.build(paths[:0], weights[:0]).pack())
    assert not len(empty.paths(3)[0]) and not empty.follow(paths).any()


def test_shard_counts_of_pieces():
    paths, weights, _, spelling = shard_counts(b"a b, a b c\nA b", 3)
    assert sorted(spelling) == [b"a", b"b", b"c"]
    assert sorted(weights.tolist()) == [1, 1, 1, 3, 3, 3] and len(paths) == 6


@pytest.mark.parametrize("shard", [1 << 22, 4000])
def test_collocations(spark, shard):
    rng = np.random.default_rng(5)
    vocabulary = ["The", "of", "new", "york", "City", "état", "x" * 300, "a-b", "c#", "das"]
    rows = [(i, ["en", "de", None][i % 3], " ".join(rng.choice(vocabulary, rng.integers(0, 60), p=[.2, .2, .1, .1, .1, .1, .05, .05, .05, .05])
                                                    ) .replace("c#", rng.choice(["c#", "c#,", "c\x0b"])) + " new york City." * int(i % 4 == 0)) for i in range(300)]
    rows += [(300, "en", None), (301, None, ""), (302, "en", "... ,, \n"), (303, "und", "new york " * 3000), (303, "und", "new york " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").selectExpr("*", "1 AS rank", "'x' AS words").repartition(5)
    got = collocations(docs, Phrases(least=10, top=40, shard=shard, span=shard))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain_collocations([r[1:] for r in rows], 10, 40)


def test_collocations_of_nothing(spark, awkward, nothing):
    assert collocations(nothing).count() == 0
    rows = [(r["lang"], r["text"]) for r in awkward.collect()]
    assert sorted(map(tuple, collocations(awkward).collect())) == plain_collocations(rows, 10, 2000)


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def plain_ranking(docs, items, k):
    terms = [(i, Counter(re.findall(TERM, lower(t)))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in terms), sum(c.total() for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    out = []
    for item, text in items.items():
        rows = []
        for doc, c in terms:
            m = 75 + 25 * c.total() * n_docs // max(1, total)
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 12 * m))
                        for t, times in Counter(re.findall(TERM, lower(text))).items() if c[t])
            if score > 0:
                rows.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if none else doc, -s) for rank, (s, none, doc) in enumerate(sorted(rows)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("search", [Search(), Search(k=3, postings=3000, terms=10, bits=8, fall=0.9)])
def test_ranked(spark, awkward, search):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(40)] + ["Élan", "ß", "x1"]
    p = 1 / np.arange(1, len(words) + 1)
    docs = [(i, " ".join(rng.choice(words, rng.integers(1, 80), p=p / p.sum()))) for i in range(400)]
    docs += [(i, docs[0][1]) for i in range(400, 440)] + [(7, docs[1][1]), (None, docs[0][1])]
    docs += [(r["doc_id"], r["text"]) for r in awkward.collect()]
    items = {1: "w1 W1 w5 élan, w30", 2: "w0", 3: "nothing known", 4: "", 5: None, 6: docs[0][1], 7: "word same text ＡＢＣ", 8: "ß.x1.w2"}
    table = spark.createDataFrame([*items.items(), (2, "w0")], "item_id int, text string").selectExpr("*", "2 AS doc_id", "'y' AS term")
    corpus = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'z' AS item_id", "0 AS score").repartition(4)
    got = ranked(corpus, table, search)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_ranking(docs, items, search.k)


def test_ranked_nothing(spark, nothing, awkward):
    items = spark.createDataFrame([(1, "word")], "item_id long, text string")
    assert ranked(nothing, items).count() == 0 and ranked(awkward, items.limit(0)).count() == 0


def test_subset_counts_are_nearest():
    rng = np.random.default_rng(4)
    for _ in range(300):
        sizes = np.unique(rng.integers(0, 40, rng.integers(1, 8)))
        left, budget = rng.integers(0, 4, len(sizes)), int(rng.integers(0, 150))
        sums = {0}
        for size, n in zip(sizes.tolist(), left.tolist()):
            sums = {s + size * j for s in sums for j in range(n + 1)}
        taken = subset_counts(sizes, left, budget)
        assert (taken >= 0).all() and (taken <= left).all()
        assert abs(int((taken * sizes).sum()) - budget) == min(abs(s - budget) for s in sums)


def plain_targets(sizes, weights, most):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(most * sizes[s] for s in fixed)
        target = {s: most * sizes[s] if s in fixed else Fraction(rest * weight[s], sum(weight[f] for f in free)) for s in names}
        above = {s for s in free if target[s] > most * sizes[s]}
        if not above:
            return target
        fixed |= above


def mix_rows():
    rng = np.random.default_rng(6)
    names = ["b", "a", "Z", "é", None, "tiny", "zero"]
    share = [.35, .3, .1, .1, .1, .03, .02]
    rows = []
    for i in range(2000):
        source = names[int(rng.choice(7, p=share))]
        n = {"zero": 0, "tiny": 1}.get(source, int(rng.integers(1, 60)) if i % 50 else 4000)
        rows.append((i, source, " \n".join(["w"] * n)))
    rows += [(5000, "b", "one and the same row " * 3)] * 500 + [(None, "a", "x y z")] * 20 + [(6000, "a", None), (6001, None, "")]
    return rows


def test_mixed(spark):
    rows = mix_rows()
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 AS size", "2 AS copies")
    got = mixed(docs.repartition(7)).collect()
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter(
        (i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, s, t in rows)
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
    target = plain_targets(sizes, (5, 2, 1), 3)
    assert len(sizes) == 7 and taken["tiny"] == 3 * sizes["tiny"]
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - float(target[r["source"]])) < 1e-6
    for source, size in sizes.items():
        assert abs(taken[source] - target[source]) <= 1, source
    # Another layout of the table gives the same mix.
    again = mixed(docs.repartition(3, "text"))
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, got))
    other = mixed(docs, Mix(seed=30)).collect()
    assert Counter(map(tuple, other)) != Counter(map(tuple, got))


def test_take_mix(spark):
    docs = spark.createDataFrame(mix_rows(), "doc_id long, source string, text string").selectExpr("*", "doc_id % 3 AS row")
    copies = Counter()
    for r in mixed(docs).collect():
        copies[r["doc_id"], r["source"], r["size"]] += r["copies"]
    found = take_mix(docs)
    assert found.columns == docs.columns
    got = Counter((r["doc_id"], r["source"], len((r["text"] or "").split())) for r in found.collect())
    assert got == Counter({k: v for k, v in copies.items() if v})


def test_mix_of_awkward_rows(spark, awkward, nothing):
    source = awkward.withColumnRenamed("lang", "source")
    assert mixed(source).count() == awkward.count() and mixed(nothing, source_col="lang").count() == 0
    empty = source.where("text is null or text = ''")
    assert {(r["target"], r["taken"]) for r in mixed(empty).collect()} == {(0.0, 0)}
