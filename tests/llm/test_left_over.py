"""What leaders leave over in the Jaccard join: no similar pair of a group is lost, none of other groups comes in."""

import random

from snapledger.llm import jaccard


def test_left_over_keeps_similar_pairs(spark):
    rng = random.Random(3)
    base = [f"w{k}" for k in range(80)]
    texts = []
    for _ in range(40):
        words = list(base)
        for k in rng.sample(range(80), rng.randrange(5)):
            words[k] = f"x{rng.randrange(40)}"
        texts.append(" ".join(words))
    texts = sorted(set(texts))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(76)} for t in texts]
    keyed = spark.createDataFrame(list(enumerate(texts)), "doc_key long, text string")
    nodes = keyed.selectExpr("doc_key AS node", "doc_key")
    # two groups, the last text in another one alone
    apart = keyed.selectExpr(f"CASE WHEN doc_key = {len(texts) - 1} THEN 9L ELSE doc_key % 2 END AS grp", "doc_key AS node", "doc_key AS root")
    found = {(r.a, r.b) for r in jaccard._left_over(apart, nodes, keyed).collect()}
    group = lambda k: 9 if k == len(texts) - 1 else k % 2
    inside = [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if group(a) == group(b)]
    similar = {(a, b) for a, b in inside if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert similar and similar <= found <= set(inside)
