"""Masks leave no choice of allowed changed words unseen."""

from itertools import combinations
from math import ceil

import pytest

from sparktn.llm import decontam

ALLOWED = {n: n - ceil(n * decontam.SHARE) if n >= decontam.EXACT else 0 for n in range(1, decontam.WINDOW + 1)}


@pytest.mark.parametrize("n", ALLOWED)
def test_a_placement_is_left(n):
    for changed in combinations(range(n), ALLOWED[n]):
        assert any(not {at + o for o in m} & set(changed) for m in decontam.MASKS[n] for at in range(n - m[-1]))


def test_changed_items_are_found(spark):
    items, rows = [], []
    for n in range(8, 15):
        words = [f"i{n}x{k}" for k in range(n)]
        items.append((n, " ".join(words)))
        for changed in combinations(range(n), ALLOWED[min(n, decontam.WINDOW)]):
            rows.append((1000 * n + len(rows), "before it " + " ".join("other" if k in changed else w for k, w in enumerate(words)) + " and after"))
        rows.append((-n, "before it " + " ".join("other" if k < 3 else w for k, w in enumerate(words[:13])) + " and after"))
    docs, bench = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {r["doc_id"]: r["item_ids"] for r in decontam.contaminated(docs, bench).collect()}
    assert all(got[d] == ([] if d < 0 else [(d - i) // 1000]) for i, (d, _) in enumerate(rows))
