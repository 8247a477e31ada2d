"""Words that a polynomial modulo a power of two cannot tell apart, and the hashes of words of every length."""

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import hashing, jaccard, mixing, substring


def thue_morse(n: int, flip: bool = False) -> str:
    """The word of 2**n letters, or its complement: equal under every polynomial modulo 2**64 with an odd base."""
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word.translate(str.maketrans("ab", "ba")) if flip else word


@pytest.fixture(scope="module")
def pair(spark):
    around = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join([*around[:10], thue_morse(10, flip), *around[10:]])) for i, flip in ((1, False), (2, True))]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_removes_only_windows_that_repeat(pair):
    out = {r.doc_id: r for r in substring.remove_repeats(pair).collect()}
    assert (out[1].n_words, out[1].n_removed) == (31, 0)
    assert (out[2].n_words, out[2].n_removed) == (31, 20)
    assert out[2].kept_text.split()[:10] == [f"w{i}" for i in range(10)] and out[2].kept_text.split()[10] == thue_morse(10, True)


def test_links_only_above_the_threshold(pair):
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(pair, k=3, num=9, den=10).collect()}
    assert out == {1: (29, 1), 2: (29, 2)}
    joined = jaccard.near_duplicates(pair, k=3, num=8, den=10).collect()
    assert {r.component_id for r in joined} == {1}


def test_topics_tell_the_words_apart():
    h, _ = hashing.words(pa.array([f"{thue_morse(10)} {thue_morse(10, True)} {thue_morse(5)} {thue_morse(5, True)}"]), hashing.LOWER)
    assert len({int(x) % mixing.BUCKETS for x in h}) == 4


@pytest.mark.parametrize("table, same", [(hashing.BYTES, False), (hashing.LOWER, True)])
def test_every_length_and_place(table, same):
    words = ["x" * n for n in range(1, 70)] + ["x" * (n - 1) + "y" for n in range(1, 70)] + ["X" * 9, "X" * 70, "ü" * 40]
    apart, first = hashing.two_words(pa.array(words), table)
    together, _ = hashing.two_words(pa.array([" \n" + "\t".join(words) + " ", None]), table)
    assert np.array_equal(apart, together) and first.tolist() == list(range(len(words) + 1))
    distinct = len({w.lower() if same else w for w in words})
    assert len(set(apart[0].tolist())) == len(set(apart[1].tolist())) == distinct
    assert not set(apart[0].tolist()) & set(apart[1].tolist())
