"""Substring search by the pieces of names, against plain Python."""

import random

from wayframe.operators import naming


def test_long_names_and_all_lengths_of_queries(spark):
    rng = random.Random(4)
    names = ["".join(rng.choice("abcd ÉÜ") for _ in range(500)) for _ in range(6)] + ["Ab", "a", "", "abc", "ABCABC", "é"] + ["".join(rng.choice("ab") for _ in range(9)) for _ in range(60)]
    queries = [n[i : i + k] for n in names[:6] for i, k in ((3, 2), (10, 3), (100, 40), (200, 250))] + ["ab", "abc", "BCA", "zz", "abz", "a", "", "éü", "aaaa", "abcabc", names[0], names[0] + "x"]
    q, n = spark.createDataFrame([(x,) for x in queries], "query string"), spark.createDataFrame([(x,) for x in names], "name string")
    got = {tuple(r) for r in naming.substring_matches(q, n).collect()}
    want = {(x, y, y.lower().startswith(x.lower()), x.lower() == y.lower()) for x in set(queries) for y in set(names) if len(x) >= 2 and x.lower() in y.lower()}
    assert got == want and len(want) > 100
    one = {tuple(r)[:2] for r in naming.substring_matches(q, n, low=1).collect()}
    assert one == {(x, y) for x in set(queries) for y in set(names) if x and x.lower() in y.lower()}


def test_index_grows_with_the_names_not_with_the_queries(spark):
    names = spark.createDataFrame([("".join(chr(97 + (i * i + k) % 26) for i in range(500)),) for k in range(4)], "name string")
    sizes = spark.createDataFrame([(2,), (3,)], "size int")
    assert naming.gram_index(names, sizes).count() <= 4 * 2 * 500
    assert naming.gram_index(names, sizes.limit(0)).count() == 0
