"""Decontamination against a search of every alignment and every window."""

import random
import re
from math import ceil

from sparktn.llm import decontam


def equal_words(doc: list[str], item: list[str]) -> tuple[int, int] | None:
    """The most equal words of a window of the item at any place of the document, if enough, and the window's words."""
    w = min(len(item), decontam.WINDOW)
    need = w if w < decontam.EXACT else ceil(w * decontam.SHARE)
    windows = ((doc[i : i + w], item[j : j + w]) for i in range(len(doc) - w + 1) for j in range(len(item) - w + 1))
    most = max((sum(x == y for x, y in zip(*pair)) for pair in windows), default=0)
    return (most, w) if w and most >= need else None


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(7)
    some = lambda words, n: [rng.choice(words) for _ in range(n)]
    items = [(i, " ".join(some("abc" if i % 2 else "pqrstuvw", n))) for i, n in enumerate([0, 1, 3, 7, 8, 9, 10, 11, 12, 13, 14, 20, 30, 40, 13, 9])]
    items += [(100, items[12][1]), (101, None)]
    rows = [(0, None), (1, ""), (2, "?!")]
    for d in range(3, 90):
        words = some("abc" if d % 3 else "pqrstuvw", rng.randrange(60))
        if d % 2:  # an item's words, some of them changed, at any place, also cut by the text's end
            part = items[rng.randrange(1, 16)][1].split()
            for k in rng.sample(range(len(part)), min(len(part), rng.randrange(5))):
                part[k] = "other"
            at = rng.randrange(len(words) + 1)
            words = words[:at] + part[rng.randrange(2) :] + words[at:] * rng.randrange(2)
        rows.append((d, " ".join(words).upper() if d % 5 == 0 else ", ".join(words)))
    rows += [(50, rows[50][1]), (None, items[12][1]), (None, "nothing of it")]
    split = lambda t: re.findall(r"\w+", (t or "").lower())
    want = []
    for d, text in rows:
        found = {i: got for i, t in items if (got := equal_words(split(text), split(t)))}
        want.append((-1 if d is None else d, bool(found), len(found), sorted(found), max((e / n for e, n in found.values()), default=0.0)))
    docs, bench = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = [(-1 if r["doc_id"] is None else r["doc_id"], r["contaminated"], r["n_items"], list(r["item_ids"]), r["share"]) for r in decontam.contaminated(docs, bench).collect()]
    assert sorted(got) == sorted(want)
    assert 10 < sum(w[1] for w in want) and sum(not w[1] for w in want) > 3
