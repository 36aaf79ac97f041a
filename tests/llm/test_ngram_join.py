import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.llm.ngram_join import ngram_jaccard_components
from loomgraph.llm.shingles import shingle_sets

SCHEMA = "doc_id long, text string, n_shingles string"


def shingles(text, words):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = [x for x in "".join(" " if c in " \t\n\x0b\f\r" else c for c in (text or "").translate(table)).split(" ") if x]
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} - {()}


def brute(rows, words, percent):
    sets = {i: shingles(t, words) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), find(i)) for i in ids}


def corpus(seed):
    g = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [g.choice(words) for _ in range(30)]
    rows = []
    for base in range(12):
        text = [g.choice(words) for _ in range(g.choice([3, 5, 9, 40, 120]))]
        for _ in range(g.choice([1, 2, 9])):
            copy = list(text)
            for _ in range(g.randint(0, 4)):
                if g.random() < 0.5:
                    copy[g.randrange(len(copy))] = g.choice(words)
                else:
                    copy = copy[:-1] or copy
            rows.append(" ".join(copy + (passage if base % 3 == 0 else [])))
    rows += [None, "", " \t\n", "One", "one", "É é", "a b c d", "A B\tC\nD"]
    g.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("seed", "words", "percent"), [(1, 4, 85), (2, 5, 80), (3, 2, 50)])
def test_equals_brute_force(spark, seed, words, percent):
    rows = corpus(seed)
    frame = spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA)
    assert {tuple(r) for r in ngram_jaccard_components(frame, words=words, percent=percent).collect()} == brute(rows, words, percent)


def test_edges(spark):
    text = " ".join(f"x{i}" for i in range(30))
    rows = [(None, text, ""), (7, text, ""), (7, text, ""), (9, text, ""), (9, "other words here entirely now", ""), (3, None, "")]
    got = ngram_jaccard_components(spark.createDataFrame(rows, SCHEMA), words=4, percent=85).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == [("3", 0, "3"), ("7", 27, "7"), ("7", 27, "7"), ("9", 2, "7"), ("9", 27, "7"), ("None", 27, "None")]
    assert ngram_jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ids_that_repeat_with_other_texts_lose_no_link(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(40)) for c in "xy")
    rows = [(1, one, ""), (2, one, ""), (2, two, ""), (3, two + " tail", ""), (4, "some other words of no group", ""), (5, two, ""), (5, two, "")]
    got = ngram_jaccard_components(spark.createDataFrame(rows, SCHEMA), words=4, percent=85).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 1)}


def test_different_long_words_are_different(spark):
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    rows = [(1, "".join("ab"[b] for b in bits), ""), (2, "".join("ba"[b] for b in bits), ""), (3, "a" * 64, ""), (4, "a" * 65, ""), (5, "abcdefgh", ""), (6, "abcdefg", ""), (7, "a", ""), (8, "a ", "")]
    got = ngram_jaccard_components(spark.createDataFrame(rows, SCHEMA), words=4, percent=85).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(i, min(i, 7)) for i in range(1, 9)}


def test_word_numbers_do_not_depend_on_the_block():
    g = random.Random(3)
    texts = ["".join(g.choice("aAbé \t\x0b-") for _ in range(g.randint(0, 300))) for _ in range(200)] + ["", "x" * 500, " ", None, "Ab" * 40 + " cd"]
    both = list(shingle_sets(pa.array(texts), 3))
    for text, found in zip(texts, both, strict=True):
        assert found.tolist() == next(shingle_sets(pa.array([text], pa.string()), 3)).tolist()
        assert len(found) == len(shingles(text, 3))


def test_a_hot_group_and_passages_equal_brute_force(spark):
    g = random.Random(9)
    line = [f"l{i}" for i in range(40)]
    base = [f"b{i}" for i in range(200)]
    texts = [" ".join([*base[:k], f"n{k}", *base[k + 1 :]]) for k in range(0, 200, 2)]  # near copies of one text
    texts += [" ".join([*line, *[f"u{g.randint(0, 300)}" for _ in range(g.randint(0, 30))]]) for _ in range(150)]  # one line, other ends
    texts += [" ".join(g.sample(line, 12)) for _ in range(30)]
    rows = list(enumerate(texts))
    for words, percent in ((4, 85), (5, 80), (1, 60)):
        frame = spark.createDataFrame([(i, t, "") for i, t in rows], SCHEMA)
        assert {tuple(r) for r in ngram_jaccard_components(frame, words=words, percent=percent).collect()} == brute(rows, words, percent)


def test_long_text(spark):
    long = " ".join(f"v{i % 5000}" for i in range(60_000))
    frame = spark.createDataFrame([(1, long, ""), (2, long + " end", "")], SCHEMA)
    assert {r.component_id for r in ngram_jaccard_components(frame).collect()} == {1}
    with pytest.raises(ValueError):
        ngram_jaccard_components(frame.withColumn("x", F.lit(1)), percent=0)
