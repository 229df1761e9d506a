import random

import numpy as np
from sensorloom.llm import near_duplicates as nd
from sensorloom.llm import shared

def test_pairs_across_components_of_a_large_group(spark):
    """All similar pairs with one end too far from the centre are found, without most of the others."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(300)]
    texts = {0: " ".join(base)}
    for k in range(1, 200):
        words, places = list(base), rng.sample(range(0, 300, 5), rng.randint(2, 14))
        if k % 20 < 2:  # these are neighbours of one before, beyond the centre's reach
            words, places = texts[k - 1].split(), rng.sample(range(300), 2)
        for i in places:
            words[i] = f"x{i}-{rng.randint(0, 2)}"
        texts[k] = " ".join(words)
    sets = {k: nd.shingle_set(t, 5) for k, t in texts.items()}
    a, b = nd.multipliers(288)
    known = spark.createDataFrame([(k, s.tobytes(), nd.registers(s, a, b).tobytes()) for k, s in sets.items()], "id long, s binary, r binary")
    buckets = spark.createDataFrame([(1, k, 0) for k in texts], "key long, id long, centre long")
    groups = spark.createDataFrame([(k, 0) for k in texts if k % 3 == 0], "id long, component_id long")

    def similar(x, y):
        common = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * common >= 80 * (len(x) + len(y) - common)

    component = {k: 0 if k % 3 == 0 else k for k in texts}
    far = {k for k in texts if not similar(sets[k], sets[0])}
    asked = [(i, j) for i in range(1, 200) for j in range(i + 1, 200) if component[i] != component[j] and (i in far or j in far)]
    want = {p for p in asked if similar(sets[p[0]], sets[p[1]])}
    tried = spark.createDataFrame([], "a long, b long")
    began = shared.mark()
    got = {tuple(r) for r in nd.across(buckets, groups, known, 80, tried).collect()}
    shared.drop(spark, began, shared.mark())
    assert len(far) > 50 and want and want <= got <= set(asked)
    assert len(got) < len(asked) / 6
