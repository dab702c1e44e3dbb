import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import overlap as O

SCHEMA = "rec_no long, record_id string, split_name string, source string, text string, fetched_at timestamp, key string"


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=30), st.lists(st.sampled_from("abcd"), max_size=30))
def test_the_bit_parallel_alignment_equals_the_table(a, b):
    assert O.lcs(a, b) == slow_lcs(a, b)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=20))
def test_chains_advance_in_both_texts_and_none_is_longer(seeds):
    c = O.chain(seeds)
    assert all(a < x and b < y for (a, b), (x, y) in zip(c, c[1:])) and set(c) <= set(seeds)
    best = {}
    for s in sorted(set(seeds)):
        best[s] = 1 + max((best[t] for t in best if t[0] < s[0] and t[1] < s[1]), default=0)
    assert len(c) == max(best.values(), default=0)


def test_what_is_left_aside_in_comparing():
    want = ["the", "cafe", "file", "1048", "a"]
    for t in ("The  café\tfile 1048 a", "THE, CAFÉ; ﬁle: 1048! A", "<p>The <b>café</b> file 1048&nbsp;a</p>", "T​he cafÃ© file 1048 a", "Ｔｈｅ ｃａｆé ｆｉｌｅ １０４８ ａ", "the &lt;i&gt;café&lt;/i&gt; file 1048 a"):
        assert O.words_of(t) == want
    assert O.words_of("Ã…re SÃ£o") == ["are", "sao"]
    assert O.words_of(None) == O.words_of("") == O.words_of(" ​ ") == []


def test_the_slack_covers_every_match():
    for n in range(5, 300):
        for m in range(n, 360):
            for common in range(n, -1, -1):
                if common < O.REPORTED * m:
                    break
                assert max(n, m) - common <= O.slack(n) and m - common <= O.slack(m) + 1
                assert abs(O.band_of(n) - O.band_of(m)) <= 1
                break


def vary(rng, words, kind, share):
    """A copy that differs in about the share of its words, each in the given way."""
    w, n = list(words), int(share * len(words))
    for i in sorted(rng.sample(range(len(w)), n), reverse=True):
        how = rng.choice(("swap", "drop", "add")) if kind == "mixed" else kind
        if how == "swap":
            w[i] = f"new{rng.randrange(10**6)}"
        elif how == "drop":
            del w[i]
        else:
            w.insert(i, f"new{rng.randrange(10**6)}")
    return w


@pytest.fixture(scope="module")
def records():
    rng = random.Random(7)
    boiler = ["most people still call the line by its older name and say it often".split(), "is the newer form of the same word in the whole valley today".split()]
    made, no = [], 0

    def add(split, words, source="s"):
        nonlocal no
        no += 1
        made.append((no, "id", split, source, " ".join(words), None, "x"))

    for i in range(420):
        n = rng.choice((6, 7, 8, 12, 13, 15, 17, 25, 60, 90, 300))
        words = []
        while len(words) < n:
            words += rng.choice(boiler) if rng.random() < 0.4 else [f"w{rng.randrange(3000)}" for _ in range(6)]
        words = words[:n]
        add(rng.choice(("indexed", "calibration ", " INDEXED")), words)
        if i % 2:
            add(rng.choice(("test", "Tuning")), vary(rng, words, rng.choice(("swap", "drop", "add", "mixed")), rng.choice((0, 0.05, 0.1, 0.14, 0.3))), None)
    return made


def brute(records):
    train = [(r[0], O.words_of(r[4])) for r in records if str(r[2]).strip().lower() in O.TRAINING]
    test = [(r[0], O.words_of(r[4])) for r in records if str(r[2]).strip().lower() in O.EVALUATION]
    out = {}
    for i, a in test:
        for j, b in train:
            if min(len(a), len(b)) >= 5 and (Counter(a) & Counter(b)).total() >= 0.8 * max(len(a), len(b)):
                share = slow_lcs(a, b) / max(len(a), len(b))
                if share >= O.REPORTED:
                    out[i, j] = share
    return out


def test_all_pairs_are_found_and_none_besides(spark, records):
    got = {(r.eval_rec, r.train_rec): r.coverage for r in O.overlaps(spark.createDataFrame(records, SCHEMA).repartition(5)).collect()}
    want = brute(records)
    assert set(got) == set(want)
    assert all(got[p] <= want[p] + 1e-12 for p in got) and len(want) > 100


def test_repeats_copies_nulls_short_and_very_long_texts(spark):
    text = "one two three four five six seven"
    long = " ".join(f"w{i}" for i in range(30_000))
    data = [(i, None, "indexed", "a", text, None, "x") for i in range(30)] + [(100, None, "test", None, text.upper(), None, "x")] * 3
    data += [(200, "r", "test", "b", long, None, "x"), (201, "r", "indexed", "b", long.replace("w15000 ", ""), None, "x")]
    data += [(300, "r", "test", "b", "n/a", None, "x"), (301, "r", "indexed", "b", "n/a", None, "x"), (302, None, None, None, text, None, "x"), (303, None, "other", None, text, None, "x"), (304, None, "test", None, None, None, "x"), (305, None, "test", None, "", None, "x"), (None, None, "test", None, text, None, "x")]
    df = spark.createDataFrame(data, SCHEMA)
    got = {(r.eval_rec, r.train_rec) for r in O.overlaps(df).collect()}
    assert got == {(100, i) for i in range(30)} | {(200, 201)}
    rep = {(r.split_name, r.source): (r.records, r.found_records, r.pairs) for r in O.report(df).collect()}
    assert rep[("test", None)] == (3, 1, 30) and rep[("test", "b")] == (2, 1, 1)
    assert O.overlaps(df.limit(0)).count() == 0
    assert O.overlaps(df.where("split_name = 'test'")).count() == 0


def test_selection_keeps_a_seed_of_every_long_run():
    rng = np.random.default_rng(1)
    for _ in range(50):
        seeds = rng.integers(0, 2**60, 60).astype(np.uint64)
        common = (rng.random(60) < 0.5).astype(np.uint8) * 5
        picked = set(O.winnow(seeds, common, 3, 61).tolist())
        assert all(picked & set(range(i, i + O.WIDE)) for i in range(60 - O.WIDE + 1))
        for i in range(58):
            window = range(i, i + 3)
            best = min(window, key=lambda p: (common[p], seeds[p]))
            assert common[best] or best in picked


def test_no_near_copy_of_common_phrases_is_missed(spark):
    rng = random.Random(11)
    base = [f"w{i}" for i in range(63)]
    short = [[f"v{j}x{i}" for i in range(n)] for j, n in enumerate((7, 8, 9, 13, 14))]
    data = []

    def add(split, words):
        data.append((len(data), "id", split, "s", " ".join(words), None, "x"))

    for i in range(300):  # every word in a row of the base is held by hundreds
        add("indexed", vary(rng, base, "mixed", rng.choice((0.05, 0.14, 0.25))) if i % 2 else base[: 31 + i % 3] + [f"own{i}x{j}" for j in range(30)])
        add("indexed", [f"own{i}y{j}" for j in range(30)] + base[31:])
        add("calibration", rng.choice(short) + [f"z{rng.randrange(3)}"])
    for i in range(30):
        for first in range(3):
            add("test", [w if (j + first) % 7 else f"new{i}x{j}" for j, w in enumerate(base)])  # runs of six
        add("tuning", vary(rng, base, "mixed", 0.14))
        words = list(rng.choice(short))
        words[rng.randrange(len(words))] = f"new{i}"
        add("test", words)
    # as many words added as dropped, at other places: runs of three are all that is left
    add("test", [x for j, w in enumerate(base) for x in ([w, f"more{j}"] if j % 7 == 3 else [] if j % 7 == 6 else [w])])
    add("indexed", base)
    got = {(r.eval_rec, r.train_rec): r.coverage for r in O.overlaps(spark.createDataFrame(data, SCHEMA).repartition(5)).collect()}
    want = brute(data)
    assert set(got) == set(want) and len(want) > 1000
    assert all(abs(got[p] - want[p]) < 1e-12 for p in got)


def test_boilerplate_makes_no_candidates(spark):
    """Ten thousand records that begin with the same thirty words: what they select are their own words."""
    shared = " ".join(f"common{i}" for i in range(30))
    data = [(i, "id", "test" if i % 2 else "indexed", "s", shared + " " + " ".join(f"own{i}x{j}" for j in range(12)), None, "x") for i in range(10_000)]
    data += [(10_000 + i, "id", "test", "s", data[2 * i][4].replace("common3 ", ""), None, "x") for i in range(50)]
    got = {(r.eval_rec, r.train_rec) for r in O.overlaps(spark.createDataFrame(data, SCHEMA).repartition(8)).collect()}
    assert got == {(10_000 + i, 2 * i) for i in range(50)}


def test_the_report_counts_as_the_pairs_do(spark, records):
    df = spark.createDataFrame(records, SCHEMA).repartition(3)
    pairs = O.overlaps(df).select("eval_rec", "train_rec").distinct().count()
    assert sum(r.pairs for r in O.report(df).collect()) == pairs


def test_texts_of_one_word_repeated_stay_few_rows():
    ids = O.word_ids(["buy", "now"] * 10_000)
    rows = list(O._fingerprints(type("B", (), {"value": np.zeros(1 << O.COMMON_BITS, np.uint8)}))(iter([pd.DataFrame({"key": ["k"], "n": [20_000], "words": ["buy now " * 9_999 + "buy now"], "evaluation": [True], "training": [True]})])))
    assert len(O.prefix(ids, np.zeros(20_000, np.uint8))) == 10_000 and len(rows[0]) < 100


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abcdefgh"), min_size=5, max_size=40), st.lists(st.tuples(st.integers(0, 39), st.sampled_from("abcxyz"), st.booleans()), max_size=6), st.lists(st.integers(0, 3), min_size=11, max_size=11))
def test_a_pair_to_be_reported_shares_a_place_of_its_selection(a, changes, levels):
    b = list(a)
    for at, word, drop in changes:
        if drop and b:
            b.pop(at % len(b))
        else:
            b.insert(at % (len(b) + 1), word)
    need = O.least(max(len(a), len(b)))
    if not b or slow_lcs(a, b) < need:
        return
    level = dict(zip("abcdefghxyz", levels))
    sides = []
    for words in (a, b):
        own = O.prefix(O.word_ids(words), np.array([level[w] for w in words], np.uint8))
        sides.append([(words[at], at) for at, before in own if before <= len(words) - need])
    reach = max(len(a), len(b)) - need
    assert any(x == y and abs(i - j) <= reach for x, i in sides[0] for y, j in sides[1])
    differing = sum(((x ^ y) & 2**64 - 1).bit_count() for x, y in zip(*(O.signature(O.word_ids(w)) for w in (a, b))))
    assert differing <= len(a) + len(b) - 2 * need


def test_markup_of_any_length_is_left_aside_and_comparisons_are_not():
    long = "style='" + "margin: 0 auto; " * 40 + "'"
    assert O.words_of(f"<P {long}>one <a href='x'>two</A>&lt;div {long}&gt; three<!-- four --></p>") == ["one", "two", "three"]
    assert O.words_of("a < b and c > d") == ["a", "b", "and", "c", "d"]
    assert O.words_of("<a" * 20_000) == ["a"] * 20_000
