"""White-space cuts of oversized items against brute force over the whole text."""

import random

import pytest

from terseforge.llm import pieces

REACH = pieces.LIMIT - pieces.OVERLAP


def _farthest(t):
    """Cuts by the rule itself, read from the whole text."""
    found = pieces.Boundaries(t)
    levels = [found.cuts, found.inner, [k + 1 for k, c in enumerate(t) if c.isspace()]]
    at, out = 0, []
    while len(t) - at > REACH:
        within = [(max((p for p in places if at < p <= at + REACH), default=None), v) for places, v in zip(levels, pieces.LEVELS, strict=True)]
        at, level = next(((p, v) for p, v in within if p is not None), (at + REACH, "none"))
        out.append((at, level))
    return [*out, (len(t), "end")]


def _texts():
    rng = random.Random(5)
    words = lambda n: " ".join("w" * rng.randrange(1, 12) for _ in range(n))
    return [
        words(6000), "a " * 3000 + "y" * 9000 + " b" * 4000, "Go on. " * 300 + words(4000) + ". Then it ended. " + words(900), "Alpha beta.\n\n" * 200 + "x" * 5000 + " tail" * 1500,
        "q" * 5790 + " " * 40 + "r" * 7000 + " s", " ".join("z" * rng.randrange(1, 3000) for _ in range(40)), " " * 13_000 + "end",
    ]


@pytest.mark.parametrize("size", [200_000, 7_000, 1])
def test_farthest_white_space(spark, size):
    texts = _texts()
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    offsets = pieces.piece_offsets(pieces.item_places(df, ["id"], "text", size=size), ["id"])
    got: dict[int, list] = {}
    for r in offsets.orderBy("id", "piece_no").collect():
        got.setdefault(r["id"], []).append((r["end_pos"], r["cut_level"]))
    for i, t in enumerate(texts):
        assert got[i] == _farthest(t), i


def test_prose_keeps_few_places():
    t = "One two three four. " * 1000
    assert len(pieces.Boundaries(t).places(REACH)[2]) < 20
