"""Leaks: the broadcast and the shuffled way, hot templates, keys of any type."""

import random

import numpy as np
import pyarrow as pa
import pytest

from terseforge.llm import leaks

WORDS = "market river engine paper window garden letter signal answer bridge cloud theory driver winter summer record member system worker artist doctor farmer museum".split()


def _passage(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(11)
    items = [f"Suppose {rng.choice(('Marlo', 'Tessa'))} holds {rng.randint(10, 999)} shelves and {_passage(rng, 7)} of Marlo before {rng.randint(1, 9)} km" for _ in range(40)] + ["", None, "short one"]
    items += [items[0], items[1] + " " + items[2]]
    docs = []
    for k in range(200):
        w = items[k % 40].split()
        said = " ".join(w[: rng.randint(8, len(w))])
        docs.append(_passage(rng, 30) + " " + (said.replace("Marlo", "Quinn") if k % 5 == 0 else said.upper() if k % 5 == 1 else said) + " " + _passage(rng, 5))
    docs += [None, "", items[3]]
    return spark.createDataFrame([(f"d{i}", t, 1) for i, t in enumerate(docs)], "doc string, text string, windows int"), spark.createDataFrame([(f"i{i}", t) for i, t in enumerate(items)], "item string, text string")


def test_broadcast_and_shuffle_give_the_same_rows(tables):
    docs, items = tables
    one, two = (sorted(tuple(r) for r in leaks.leaks(docs, items, "doc", "text", "item", "text", item_chars=n).collect()) for n in (10**6, 0))
    assert one == two and {k for _, _, k, _ in one} == {"verbatim", "reparameterised"} and len(one) > 100


def test_names_do_not_depend_on_how_items_are_split(spark, tables):
    docs, items = tables
    whole = sorted(tuple(r) for r in leaks.leaks(docs, items, "doc", "text", "item", "text", item_chars=0).collect())
    assert sorted(tuple(r) for r in leaks.leaks(docs, items.repartition(13), "doc", "text", "item", "text", item_chars=0).collect()) == whole


def test_empty_sides(tables):
    docs, items = tables
    for n in (0, 10**6):
        assert leaks.leaks(docs.limit(0), items, "doc", "text", "item", "text", item_chars=n).count() == 0
        assert leaks.leaks(docs, items.limit(0), "doc", "text", "item", "text", item_chars=n).count() == 0


def test_windows_of_numbers_are_no_hot_key():
    rng = random.Random(5)
    items = [" ".join(str(rng.randint(0, 99)) for _ in range(60)) for _ in range(300)]
    index = leaks.build_index(pa.array(range(300)), items)
    assert len(np.unique(index.templates)) == len(index.templates)
    coder = leaks.Coder(index.vocabulary)
    found = " ".join(str(rng.randint(0, 99)) for _ in range(400)) + " " + items[7]
    _, templates, _, _ = leaks._batch_windows(coder, [found], leaks.WINDOW)
    mine, theirs = index.hits(templates)
    assert len(mine) < 1000 and set(index.owners[theirs].tolist()) == {7}
