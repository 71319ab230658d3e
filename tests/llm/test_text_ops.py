"""Text operators against brute force: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

ODD = [(3, None), (4, ""), (5, " \n\t "), (None, "a lost row of words without any id at all"), (6, "one"), (7, "two words"),
       (8, "é à ü ß"), (9, "\n\nblank lines\n\n"), (10, "a" * 70000), (11, "Same line here\nSame line here\nother"),
       (12, "same LINE here"), (13, "x " * 3000), (13, "another text of the same number"), (14, "x " * 3000)]


def corpus(n=60, seed=3):
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(40)]
    rows = list(ODD)
    for i in range(20, 20 + n):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        if rows and i % 4 == 0:  # a near copy of an earlier text
            w = (rng.choice(rows)[1] or "").split()[:200]
            if w:
                w[rng.randrange(len(w))] = "edited"
        rows.append((i, "".join(x + rng.choice([" ", " ", " ", "\n"]) for x in w)))
    rows += rows[-3:]  # repeated rows
    return rows


def docs(spark, rows):
    """With other columns whose names clash with those that operators add."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", *(F.lit("clash").alias(c) for c in ("tid", "score", "component", "piece", "key", "lang", "source")),
                     F.length("text").cast("long").alias("n_chars"))


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def table(spark, rows):
    from spanlake.llm.queries import SETTINGS
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    return docs(spark, rows).repartition(4)


@pytest.fixture(scope="module")
def empty(spark):
    return docs(spark, [])


def test_simhash(table, rows, empty):
    from spanlake.llm.op10_simhash import keep_one, simhash_groups
    got = simhash_groups(table).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id")
    want = brute.simhash(rows)
    assert rows_of(got) == want
    kept = {i for i, _, c in want if i == c}
    assert rows_of(keep_one(table).select("doc_id")) == sorted(((i,) for i, _ in rows if i is None or i in kept), key=str)
    assert simhash_groups(empty).count() == 0


def test_links_at_every_distance(spark):
    from spanlake.llm.op10_simhash import link_fingerprints
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(4)] + [0, (1 << 64) - 1]
    points = {}
    for b in base:
        for k in range(12):
            flip = b
            for bit in rng.sample(range(64), k % 4):
                flip ^= 1 << bit
            points.setdefault(flip, len(points))
    df = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for p, i in points.items()], "rep long, fp long")
    for bits in (0, 1, 2):
        want = sorted((i, j) for p, i in points.items() for q, j in points.items() if i < j and bin(p ^ q).count("1") <= bits)
        want.sort(key=str)
        assert rows_of(link_fingerprints(df, bits)) == want
    with pytest.raises(ValueError):
        link_fingerprints(df, 3)


def test_link_join_is_no_broadcast(spark):
    """A point visits 33 cells, which the planner's sizes leave out: small points must not send all visits to the driver."""
    from spanlake.llm.op10_simhash import link_fingerprints
    points = spark.createDataFrame([(i, i << 8) for i in range(50)], "rep long, fp long")
    plan = link_fingerprints(points)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("window", [3, 7, 50])
def test_substring(table, rows, empty, window):
    from spanlake.llm.op2_substring import remove_repeats
    got = rows_of(remove_repeats(table, window).drop("kept"))
    assert got == brute.substring(rows, window)
    assert remove_repeats(empty, window).count() == 0


def test_substring_runs_and_periods(spark):
    from spanlake.llm.op2_substring import remove_repeats
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice("ab" if i % 3 else "abcdef") for _ in range(rng.randint(0, 50)))) for i in range(60)]
    rows += [(100 + i, "a " * i) for i in range(0, 30, 3)] + [(200 + i, "x y " * i) for i in range(0, 20, 3)]
    for window in (4, 9):
        assert rows_of(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window).drop("kept")) == brute.substring(rows, window)


def test_lines(spark, rows, empty):
    from spanlake.llm.op3_lines import drop_lines
    own = list({r[0]: r for r in rows if r[0] is not None}.values())
    df = drop_lines(docs(spark, own), others=("lang",))
    assert {r.doc_id: r.text for r in df.collect()} == brute.line_dedup(own)
    assert {r.lang for r in df.collect()} == {"clash"}
    assert drop_lines(empty).count() == 0
    nulls = drop_lines(docs(spark, [(None, "a b\na b"), (None, None), (1, "a b"), (1, "a b")]))
    assert rows_of(nulls.select("doc_id", "text", "n_removed")) == sorted(
        [(None, "a b\na b", 0), (None, None, 0), (1, "a b", 0), (1, "a b", 0)], key=str)


def test_lines_of_all_similarities(spark):
    from spanlake.llm.op3_lines import drop_lines
    rng = random.Random(8)
    rows = []
    for i in range(80):
        base = ["v%d" % rng.randrange(30) for _ in range(rng.randint(1, 12))]
        for _ in range(3):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = "e%d" % rng.randrange(6)
            rows.append((len(rows), " ".join(rng.sample(w, len(w)))))
    got = {r.doc_id: r.text for r in drop_lines(spark.createDataFrame(rows, "doc_id long, text string"), 0.8).collect()}
    assert got == brute.line_dedup(rows)


def test_lines_where_a_third_are_near_copies(spark, monkeypatch):
    """Their word lists are cut into many blocks; similarities lie on both sides of the threshold."""
    from spanlake.llm import op3_lines
    monkeypatch.setattr(op3_lines, "LONG", 8)
    rng = random.Random(9)
    base = ["c%d" % i for i in range(24)]
    rows = []
    for i in range(120):
        w = list(base) if i % 3 == 0 else ["r%d" % rng.randrange(400) for _ in range(rng.randint(4, 20))]
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = "e%d" % rng.randrange(40)
        rows.append((i, " ".join(w) + ("\n" + " ".join(w[:-1]) if i % 7 == 0 else "")))
    got = {r.doc_id: r.text for r in op3_lines.drop_lines(spark.createDataFrame(rows, "doc_id long, text string"), 0.8).collect()}
    assert got == brute.line_dedup(rows)


def test_decontamination(spark, table, empty):
    from spanlake.llm.op4_decontaminate import contamination
    rng = random.Random(4)
    vocab = ["q%d" % i for i in range(300)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(8, 40)))) for i in range(12)] + [(50, None), (51, ""), (None, "no id"), (52, "hi")]
    rows = []
    for i in range(80):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 80))]
        if i % 2:
            own = items[i % 12][1].split()
            for _ in range(rng.randint(0, len(own) // 3)):
                k = rng.randrange(len(own))
                own[k:k + 1] = rng.choice([[], ["new"], [own[k], "more"]])
            w[5:5] = [x.upper() + rng.choice(["", ",", "!"]) for x in own]
        rows.append((i, " ".join(w)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.contaminated, r.item_id, r.score) for r in contamination(docs(spark, rows + [(None, rows[1][1]), (900, None)]), bench).collect()}
    own = [(i, brute.bare_words(t)) for i, t in items if i is not None and len(brute.bare_words(t)) >= 3]
    for i, t in rows:
        text = brute.bare_words(t)
        best = max((brute.smith_waterman(w, text), -k) for k, w in own)
        assert got[i] == (False, None, None) if best[0] < 0.65 else got[i][:2] == (True, -best[1]) and math.isclose(got[i][2], best[0])
    assert not got[None][0] and not got[900][0]
    assert contamination(empty, bench).count() == 0
    assert not any(r.contaminated for r in contamination(table, bench.limit(0)).collect())


def test_decontamination_finds_every_copy_at_the_threshold(spark):
    """Insertion-heavy, cut and mixed copies of items from 3 to 300 words, few kinds of words, items that share an id."""
    from spanlake.llm.op4_decontaminate import contamination
    rng = random.Random(11)
    vocab = ["z%d" % i for i in range(60)]
    sizes = [3, 3, 4, 5, 7, 8, 10, 14, 24, 24, 40, 300]
    items = [(i % 10, " ".join(rng.choice(vocab) for _ in range(n))) for i, n in enumerate(sizes)]
    rows = []
    for i in range(96):
        own = items[i % 12][1].split()
        if i // 12 % 4 == 0:  # a filler after every 2nd word: 0.77 for 24 words
            w = [x for k, y in enumerate(own) for x in ([y, "uh"] if k % 2 else [y])]
        elif i // 12 % 4 == 1:
            w = own[len(own) // 6:]
            w[len(w) // 2:len(w) // 2] = ["er%d" % k for k in range(len(own) // 4)]
        else:
            w = list(own)
            for _ in range(int(len(own) * rng.uniform(0.1, 0.5))):
                k = rng.randrange(len(w))
                w[k:k + 1] = rng.choice([[], ["new"], [w[k], "more"], [w[k], "more"]]) or w[k:k + 1][:rng.randrange(2)]
        around = [rng.choice(vocab) for _ in range(rng.choice([0, 30, 700]))]
        rows.append((i, " ".join(around + w + around[:20])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.contaminated, r.item_id, r.score) for r in contamination(docs(spark, rows), bench).collect()}
    own, found = [(i, brute.bare_words(t)) for i, t in items], 0
    for i, t in rows:
        text = brute.bare_words(t)
        best = max((brute.smith_waterman(w, text), -k) for k, w in own)
        found += best[0] >= 0.65
        assert got[i] == (False, None, None) if best[0] < 0.65 - 1e-12 else got[i][:2] == (True, -best[1]) and math.isclose(got[i][2], best[0]), (i, best, got[i])
    assert found > 40
    filler = spark.createDataFrame([(1, items[9][1])], "item_id long, text string")
    one = " ".join(x for k, y in enumerate(items[9][1].split()) for x in ([y, "uh"] if k % 2 else [y]))
    assert contamination(docs(spark, [(1, one)]), filler).first().score == 37 / 48


def test_quality_on_held_out_labels(spark, empty):
    from conftest import MEDIUM
    from spanlake.llm.op5_quality import quality, scored, fit
    d, labels = spark.read.parquet(f"{MEDIUM}/documents.parquet"), spark.read.parquet(f"{MEDIUM}/labels.parquet")
    out = quality(d, labels).select("doc_id", "held_out", "score", "predicted")
    told = out.join(labels, "doc_id").where("held_out").toPandas()
    assert len(told) > 50 and (told.predicted == told.quality).mean() >= 0.97
    rows = out.collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == brute.held(r.doc_id, 0) for r in rows)
    model = fit(d, labels)
    again = scored(docs(spark, [(1, None), (1, ""), (None, "a"), (1, "a" * 100000)]), model).collect()
    assert len(again) == 4 and len({r.score for r in again if not r.text}) == 1
    assert scored(empty, model).count() == 0
    none = quality(docs(spark, [(1, "a"), (2, None)]), labels.limit(0)).collect()
    assert all(math.isclose(r.score, 0.3) and r.predicted == 1 for r in none)


def test_quality_ranker_against_plain_gradient_descent():
    """The same pairs, one weight at a time: the optimum of the ridge logistic loss, then the most accurate threshold."""
    import numpy as np
    from spanlake.llm.op5_quality import Ranker
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 3)) * [1, 5, 0.1] + [0, 2, 7]
    good = x @ [1.0, 0.1, -6] + rng.normal(size=80) > -41.5
    model = Ranker(x, good, pairs=400, ridge=0.01)
    draw = np.random.default_rng(7)
    z = [[min(max((r[c] - x[:, c].mean()) / (x[:, c].std() + 1e-9), -8), 8) for c in range(3)] for r in x]
    first, second = draw.choice(np.flatnonzero(good), 400), draw.choice(np.flatnonzero(~good), 400)
    diffs = [[z[a][c] - z[b][c] for c in range(3)] for a, b in zip(first, second)]
    v = [0.0] * 3
    for _ in range(1500):
        slope = [0.01 * w for w in v]
        for d in diffs:
            miss = 1 / (1 + math.exp(sum(p * q for p, q in zip(d, v))))
            slope = [g - q * miss / len(diffs) for g, q in zip(slope, d)]
        v = [w - 0.5 * g for w, g in zip(v, slope)]
    assert all(math.isclose(p, q, abs_tol=1e-3) for p, q in zip(model.weights, v)), (model.weights, v)
    s = [sum(p * q for p, q in zip(r, model.weights)) for r in z]

    def accuracy(cut):
        return sum((p >= cut) == q for p, q in zip(s, good)) / len(s)
    assert accuracy(model.threshold) >= max(accuracy(c) for c in s) - 1 / len(s)
    for p, row, told in zip(s, x, model.score(x, 0.3)):
        assert (told >= 0.3) == (p >= model.threshold)
        assert math.isclose(told, 1 / (1 + math.exp(-(p - model.threshold)) * 0.7 / 0.3), rel_tol=1e-9)


def test_ppm(spark, rows):
    from spanlake.llm.op9_ppm import scores
    rows = [r for r in rows if r[1] is None or len(r[1]) < 400] + [(77, "Ünseen ÿ"), (78, "THE end")]
    got = scores(docs(spark, rows), order=3, fold=1).collect()
    train = [t for i, t in rows if not brute.held(i, 1)]
    model = brute.ppm(train, 3)
    count = Counter(w for t in train for w in brute.words(t, True))
    total, kinds = sum(count.values()) + len(train), len(count) + 1
    assert len(got) == len(rows) and {r.train_tokens for r in got} == {total}
    figures = {}
    for i, t in rows:
        w = brute.words(t, True)
        base = sum(math.log10((c + 0.5) / (total + 0.5 * (kinds + 1))) for c in [*(count[x] for x in w), len(train)])
        figures.setdefault(i, []).append((len(w) + 1, sum(x in count for x in w) + 1, base, model(t)))
    for r in got:
        assert r.held_out == brute.held(r.doc_id, 1)
        assert any((r.n_tokens, r.n_known) == f[:2] and math.isclose(r.base_score, f[2], rel_tol=1e-9) and math.isclose(r.score, f[3], rel_tol=1e-3)
                   for f in figures[r.doc_id])


def test_ppm_without_training_rows(spark, empty):
    from spanlake.llm.op9_ppm import scores
    one = next(i for i in range(100) if brute.held(i, 1))
    r = scores(docs(spark, [(one, "ab c")]), order=3, fold=1).first()
    assert r.n_tokens == 3 and r.n_known == 0 and r.train_tokens == 0 and math.isclose(r.score, -5 * math.log10(256))
    assert scores(empty).count() == 0


def test_line_hash_is_of_kept_text(spark):
    from spanlake.llm.op2_substring import remove_repeats
    r = remove_repeats(spark.createDataFrame([(1, " A\tb\n c ")], "doc_id long, text string")).first()
    assert r.kept == "A b c" and r.kept_sha256 == hashlib.sha256(b"A b c").hexdigest()


def test_lines_under_the_threshold_cost_one_row_each(spark, monkeypatch):
    from spanlake.llm import op3_lines
    rng = random.Random(5)
    base, pool = [f"base{k}" for k in range(40)], [f"pool{k}" for k in range(30)]
    lines = [" ".join(base + rng.sample(pool, 10)) for _ in range(150)]
    told, plain = {}, op3_lines.save

    def counted(df, name, *more):
        out = plain(df, name, *more)
        told[name] = out.count()
        return out

    monkeypatch.setattr(op3_lines, "save", counted)
    got = {r.doc_id: r.text for r in op3_lines.drop_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), 0.8).collect()}
    sets = [set(x.split()) for x in lines]
    want = {i: "" if any(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in range(i)) else x for i, x in enumerate(lines)}
    assert got == want and 0 < sum(x == "" for x in want.values()) < 150
    assert told["lines-open"] <= 150


def test_line_words_are_those_of_each_line():
    from spanlake.llm.op3_lines import line_ids, line_words
    texts = [None, "", "\n", "A b\n\nc", "x\n", " tab\tbed ", "é Ünder\x0bflow", "longer-than-eight-bytes LONGER-THAN-EIGHT-BYTES", "longer-than-eight-bytez", "c"]
    row, number, h, first = line_words(pa.array(texts, pa.string()))
    lines = [(i, k, x) for i, t in enumerate(texts) for k, x in enumerate((t or "").split("\n"))]
    assert [(i, k) for i, k, _ in lines] == list(zip(row.tolist(), number.tolist()))
    words = [re.findall(r"[^\x20\x09-\x0D]+", x) for _, _, x in lines]
    words = [["".join(c.lower() if c.isascii() else c for c in w) for w in x] for x in words]
    assert [len(x) for x in words] == np.diff(first).tolist()
    flat = [w for x in words for w in x]
    assert len(set(zip(flat, h.tolist()))) == len(set(flat)) == len(set(h.tolist()))
    ids = line_ids(h, first).tolist()
    assert len({*zip(map(tuple, words), ids)}) == len({*map(tuple, words)}) == len({*ids})


def test_sets_travel_as_places_among_their_words():
    from spanlake.llm.op3_lines import Sets, _told
    rng = np.random.default_rng(3)
    pool = np.sort(rng.integers(1, 1 << 63, 3000).astype(np.uint64))
    held = [pool[np.sort(rng.choice(3000, rng.integers(1, 90), replace=False))] for _ in range(2000)]
    line = rng.permutation(1 << 20)[:2000].astype(np.int64) * 7 - (1 << 21)
    first, is_open = np.append(0, np.cumsum([len(x) for x in held])), rng.random(2000) < 0.2
    names, place = np.unique(np.concatenate(held), return_inverse=True)
    rows = [_told(line, is_open, first, names, place, np.arange(a, b)) for a, b in ((0, 1200), (900, 2000), (5, 6))]
    assert 2 * sum(map(len, rows)) < 8 * len(place)  # 8 bytes a word before
    got = Sets(rows)
    again = Sets([got.some(line[:700]), got.some(line[500:])])
    for sets in (got, again):
        assert sets.line.tolist() == sorted(line.tolist())
        for i, at in enumerate(np.argsort(line)):
            assert (sets.names[sets.flat[sets.first[i]:sets.first[i + 1]]] == held[at]).all() and sets.open[i] == is_open[at]


def test_word_ranks_reach_the_driver_as_a_byte_a_bucket(spark):
    """The table of ranks is worked out where it is used; what the driver receives, holds and sends is its levels."""
    import pickle
    from spanlake.llm import op3_lines
    rows = [(i, 0, " ".join(["the"] * 40 + [f"w{i % 7}", f"rare{i}"])) for i in range(300)]
    told, twice = op3_lines.word_ranks(op3_lines.read_lines(spark.createDataFrame(rows, "doc_id long, tid long, text string")))
    assert len(pickle.dumps(told)) < op3_lines.BUCKETS + 1000 and len(twice) == op3_lines.MARK_BITS // 8
    _, _, h, _ = op3_lines.line_words(pa.array(["the w3 rare5"]))
    rank = told.table()[(h >> op3_lines.LOW).astype(np.int64)]
    assert rank[0] > rank[1] > rank[2] and (np.sort(told.table()) == np.arange(op3_lines.BUCKETS)).all()
    assert len(pickle.dumps(told)) < op3_lines.BUCKETS + 1000
