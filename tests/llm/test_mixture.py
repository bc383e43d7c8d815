"""Mixing against a plain loop: targets, caps, and words near the target."""

import random
from collections import defaultdict

from sieveframe.llm import mixture


def filled(sizes, weights, budget, most):
    """Targets by clamping the sources above their cap and sharing the rest again."""
    clamped = set()
    while True:
        left = budget - sum(most * sizes[s] for s in clamped)
        share = sum(weights[s] for s in sizes if s not in clamped)
        targets = {s: most * sizes[s] if s in clamped else weights[s] * left / share for s in sizes}
        above = {s for s in sizes if s not in clamped and targets[s] > most * sizes[s]}
        if not above:
            return targets
        clamped |= above


def rows_of(seed=8, n=400):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        source = rng.choice(["a"] * 12 + ["b", "c", "Z", None, "é", "empty"])
        text = None if rng.random() < .05 else " ".join("w" * rng.randint(1, 4) for _ in range(rng.choice((0, 3, 20, 90))))
        rows.append((k, None if source == "empty" else text, source))
    return rows + [(None, "one two", "b"), (5, "three", "a"), (5, "three", "a"), (7, "\x0b x \x1c y", "only")]


def test_equals_plain_filling(spark):
    rows = rows_of()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'x' as src", "0 as taken")
    found = mixture.mixture(df, mixture.cycled_weights(df, (3, 1, 2)), 1.5).collect()
    assert len(found) == len(rows)
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len((text or "").replace("\x1c", "_").split())
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    targets = filled(sizes, weights, 1.5 * sum(sizes.values()), 2)
    taken = defaultdict(int)
    for r in found:
        assert abs(r.target - targets[r.source]) < 1e-6 and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - targets[s]) <= 1 for s in sizes)


def test_same_seed_same_mix_on_any_layout(spark):
    df = spark.createDataFrame(rows_of(), "doc_id long, text string, source string")

    def mix(frame, seed):
        return sorted(map(str, mixture.mixture(frame, mixture.cycled_weights(frame, (3, 1, 2)), 1.5, seed).collect()))

    assert mix(df, "s") == mix(df.repartition(7), "s") != mix(df, "t")


def test_empty_table_and_rows_as_often_as_taken(spark):
    df = spark.createDataFrame(rows_of(), "doc_id long, text string, source string").selectExpr("*", "'k' as row_key")
    weights = mixture.cycled_weights(df, (3, 1, 2))
    assert mixture.mixture(df.limit(0), weights, 1.5).count() == 0
    out = mixture.mixed_rows(df, weights, 1.5)
    assert out.columns == df.columns
    times = defaultdict(int)
    for r in mixture.mixture(df, weights, 1.5).collect():
        if r.size:
            times[r.doc_id] += int(r.taken / r.size + 0.5)
    copies = defaultdict(int)
    for r in out.collect():
        copies[r.doc_id] += 1
    assert {k: v for k, v in times.items() if v} == copies
