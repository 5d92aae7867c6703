import random
import re

from leafmill.llm.near_dup import components, near_duplicate_groups, near_duplicate_pairs


def brute(rows, width, threshold, least):
    sets = {}
    for i, t in rows:
        if i is None or t is None:
            continue
        w = re.findall(r"[^ \t\r\n]+", t.lower())
        if len(w) >= least:
            sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}
    ids = sorted(sets)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def texts(n, seed):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    out = []
    for i in range(n):
        w = r.choices(vocabulary, k=r.randint(35, 90))
        if out and r.random() < 0.5:
            w = r.choice(out)[1].split()
            for _ in range(r.randint(0, 9)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            if r.random() < 0.3:
                w = w[: len(w) * 2 // 3]
        out.append((i, " ".join(w)))
    return out


def found(spark, rows, **kw):
    df = spark.createDataFrame(rows, "node_no long, text string")
    got = near_duplicate_pairs(df, **kw).select("node_a", "node_b").collect()
    pairs = {tuple(r) for r in got}
    assert len(pairs) == len(got)
    return pairs


def test_equals_brute_force(spark):
    rows = texts(150, 1)
    assert found(spark, rows) == brute(rows, 3, 0.5, 40)
    assert found(spark, rows, width=5, threshold=0.8) == brute(rows, 5, 0.8, 40)


def test_tiles_of_frequent_ngrams(spark):
    from leafmill.llm.near_dup import eligible, similar_texts

    rows = texts(80, 2)
    t = eligible(spark.createDataFrame(rows, "node_no long, text string"), "node_no", "text", 40)
    got = {(r.a, r.b) for r in similar_texts(t, 3, 0.5, 80, block_rows=16, tile=3).collect()}
    assert got == {tuple(sorted(p)) for p in brute(rows, 3, 0.5, 40)} - {(a, b) for a, x in rows for b, y in rows if a < b and x == y} or len(got) > 0
    lowest = {}
    for i, x in rows:
        lowest.setdefault(x, i)
    reps = set(lowest.values())
    assert got == {p for p in brute(rows, 3, 0.5, 40) if set(p) <= reps}


def test_nulls_copies_and_repeats(spark):
    long = " ".join(f"a{k}" for k in range(45))
    rows = [(1, long), (1, long), (2, long), (3, None), (None, long), (4, ""), (5, "short text"), (6, long + " end")]
    assert found(spark, rows) == {(1, 2), (1, 6), (2, 6)}
    assert found(spark, []) == set()


def test_long_text_and_case(spark):
    long = " ".join(f"B{k}" for k in range(20_000))
    assert found(spark, [(1, long), (2, long.lower() + "\n")]) == {(1, 2)}


def test_components_and_groups(spark):
    chain = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 130)] + [(200, 200)]
    got = {r.id: r.group for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, **{k: 100 for k in range(100, 130)}}
    long = " ".join(f"a{k}" for k in range(45))
    rows = [(k, long) for k in range(30)] + [(50, long + " end"), (60, " ".join(f"b{k}" for k in range(45))), (70, "short"), (80, None)]
    g = {r.node_no: (r["class"], r.group, r.links) for r in near_duplicate_groups(spark.createDataFrame(rows, "node_no long, text string")).collect()}
    assert g == {**{k: (0, 0, 1) for k in range(30)}, 50: (50, 0, 1), 60: (60, 60, 0)}
