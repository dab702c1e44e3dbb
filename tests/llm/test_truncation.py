import random

import numpy as np
import pytest

from quillon.llm import truncation as X

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bin int"
NOUNS = "index tile query segment codebook table reader kernel model vector".split()
VERBS = "covers hides repeats orders rejects widens limits explains".split()


def sentence(rng):
    return f"The {rng.choice(NOUNS)} behind the {rng.choice(NOUNS)} {rng.choice(VERBS)} the {rng.choice(NOUNS)} number {rng.randrange(999)}."


@pytest.fixture(scope="module")
def documents():
    """Prose that ends with a period and notes that end with a sign-off; some of both are cut, at a limit or anywhere."""
    rng, docs, truth, complete = random.Random(5), [], set(), set()
    for i in range(3000):
        source = "notes" if i % 3 else "prose"
        text = " ".join(sentence(rng) for _ in range(rng.randrange(2, 9)))
        if source == "notes":
            text += rng.choice(("\n\nThanks", "\n\nStatus: open", "\n\n-- Data team"))
        cut = 400 if source == "notes" and len(text) > 400 else rng.randrange(20, len(text) - 12) if rng.random() < 0.06 else None
        if cut:
            text = text[:cut]
            if not text.rstrip().endswith("."):
                truth.add(i)
            if cut != 400:
                text += rng.choice(("", "", "...", "   ", "\ufffd", "\\u00"))
        else:
            complete.add(i)
        docs.append((i, text, rng.choice(("en", None, "de")), source if i % 97 else None, len(text), 1))
    return docs, truth, complete


def test_cut_texts_are_told_from_complete_ones(spark, documents):
    docs, truth, complete = documents
    found = {r.doc_id: r for r in X.truncated(spark.createDataFrame(docs, SCHEMA).repartition(6)).collect()}
    cut = {i for i, r in found.items() if r.is_cut}
    assert len(found) == 3000
    assert len(cut & truth) >= 0.95 * len(truth)
    assert len(cut & complete) <= 0.01 * len(complete)
    assert "plain" not in {r.kind for r in found.values() if r.length == 400 and r.source == "notes"}


def test_results_do_not_depend_on_partitions(spark, documents):
    docs = documents[0][:600]
    a, b = ({(r.doc_id, round(r.log_odds, 9)) for r in X.truncated(spark.createDataFrame(docs, SCHEMA).repartition(n)).collect()} for n in (1, 5))
    assert a == b


def test_the_counts_are_those_of_all_positions(spark):
    texts = ["ab1 ab2.", "ab", "xab7", "ab " * 700]
    df = spark.createDataFrame([(i, t, None, "s", 0, 1) for i, t in enumerate(texts)], SCHEMA)
    ends = X._ends(iter([df.toPandas()[["doc_id", "source", "text"]]]))
    keys = next(ends)["keys"].tolist()
    two = X.CONTEXTS.index(("char", 2))

    class All:
        value = np.full(1 << 20, 255, np.uint8)

    counted = {}
    for part in X._counter(All)(iter([df.toPandas()[["source", "text"]]])):
        for k, n in zip(part["key"], part["n"]):
            counted[k] = counted.get(k, 0) + n
    assert counted[keys[1][two]] == 2 + 1 + 1 + 700  # "ab"
    assert counted[keys[2][two]] == 3  # "b" and a digit, whichever
    assert sum(1 for _ in counted) > 20


def test_cuts_at_a_limit_that_moves_back_to_a_word(spark):
    """Texts of up to 500 bytes, cut back to a whole word where they are longer, and complete ones padded to the limit."""
    rng, docs, truth = random.Random(11), [], set()
    for i in range(2500):
        text = " ".join(sentence(rng).replace("The", rng.choice(("The", "Thé"))) for _ in range(rng.randrange(3, 13)))
        if len(text.encode()) > 500:
            text = text.encode()[:500].decode(errors="ignore").rpartition(" ")[0]
            if not text.endswith("."):
                truth.add(i)
        elif i % 20 == 0:
            text += " See " + "".join(rng.choice("abcdefgh") for _ in range(max(1, 494 - len(text.encode())))) + "."
        docs.append((i, text, None, "prose", None, 1))
    found = {r.doc_id: r for r in X.truncated(spark.createDataFrame(docs, SCHEMA).repartition(6)).collect()}
    cut = {i for i, r in found.items() if r.is_cut}
    assert len(truth) > 300
    assert len(cut & truth) >= 0.97 * len(truth) and len(cut - truth) <= 0.03 * len(truth)
    assert sum(found[i].kind == "limit" for i in truth) >= 0.95 * len(truth)


def test_many_cuts_in_the_same_place_do_not_look_like_ends(spark):
    """All cuts fall on the ends of a few words. The share found does not fall as more texts are cut alike."""
    for n in (1500, 6000):
        rng, docs, truth = random.Random(n), [], set()
        for i in range(n):
            text = " ".join(sentence(rng) for _ in range(rng.randrange(2, 9)))
            if rng.random() < 0.05:
                text = text[: rng.randrange(30, len(text))].rpartition(" ")[0]
                if not text.endswith("."):
                    truth.add(i)
            docs.append((i, text, None, "prose", None, 1))
        cut = {r.doc_id for r in X.truncated(spark.createDataFrame(docs, SCHEMA)).where("is_cut").collect()}
        assert len(cut & truth) >= 0.95 * len(truth) and len(cut - truth) <= 0.05 * len(truth)


def test_debris_languages_and_hostile_ends():
    assert X.strip_debris("the cal��") == ("the cal", True)
    assert X.strip_debris("see it (more)") == ("see it", True)
    assert X.strip_debris("see it [...]") == ("see it", True)
    assert X.strip_debris("wait…  ") == ("wait", True)
    assert X.strip_debris("x &#8") == ("x", True)
    assert X.strip_debris("done.\n") == ("done.", False)
    assert X.strip_debris("done.   ") == ("done.", True)
    assert X.strip_debris("") == ("", False)
    assert X.strip_debris(" " * 100_000 + "a")[0].endswith("a")
    assert X.strip_debris("-" * 5000)[0] == ""
    assert [X.language(t) for t in ("the cat and the dog", "der Hund und die Katze", "el perro que para los", "le chat pour les", "这是中文")] == ["en", "de", "es", "fr", "zh"]


def test_nulls_empty_long_and_repeated_texts(spark):
    data = [(1, None, None, "s", 0, 1), (2, "", None, "s", 0, 1), (3, "   ", None, "s", 0, 1), (4, "One. " * 60_000, None, "s", 0, 1), (5, "a\x00b.", None, None, 0, 1), (None, "x.", None, "s", 0, 1)] + [(10 + i, "Same text.", None, "s", 0, 1) for i in range(50)]
    got = {r.doc_id: r.is_cut for r in X.truncated(spark.createDataFrame(data, SCHEMA)).collect()}
    assert set(got) == {4, 5} | set(range(10, 60)) and not any(got[i] for i in range(10, 60))
    assert X.truncated(spark.createDataFrame(data, SCHEMA).limit(0)).count() == 0
    report = {r.source: (r.texts, r.cut_texts) for r in X.rates(X.truncated(spark.createDataFrame(data, SCHEMA))).collect()}
    assert report["s"][0] == 51 and report[None] == (1, 0)
