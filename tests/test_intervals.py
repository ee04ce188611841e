"""Overlaps of ranges of any length: equal to the comparison of all pairs, with few copies."""

import random

from factloom.operators.intervals import overlaps

SCHEMA = "id long, file string, start_line long, end_line long"


def test_ranges_of_one_to_a_million_lines_equal_all_pairs(spark):
    rng = random.Random(3)

    def ranges(n):
        out = []
        for k in range(n):
            start = rng.randrange(-1000, 1_000_000)
            out.append((k, rng.choice(["f", "g", None]), start, start + int(10 ** rng.uniform(0, 6)) - 1))
        return [*out, (n, "f", 500, 490), (n + 1, "f", 500, 490), (n + 2, "f", None, 3), (n + 3, "g", 7, None), (n + 4, "f", 0, 0), (n + 4, "f", 0, 0), (n + 5, "f", -5, 5)]

    one, two = ranges(300), ranges(250)
    expected = sorted((a[0], b[0]) for a in one for b in two if a[1] is not None and a[1] == b[1] and None not in (*a[2:], *b[2:]) and a[2] <= b[3] and b[2] <= a[3])
    met = overlaps(spark.createDataFrame(one, SCHEMA), spark.createDataFrame(two, SCHEMA))
    assert sorted((r.left.id, r.right.id) for r in met.collect()) == expected and len(expected) > 1000
    assert overlaps(spark.createDataFrame(one, SCHEMA).limit(0), spark.createDataFrame(two, SCHEMA)).count() == 0
