from figmill.llm import leaks

COMMON = [f"c{i}" for i in range(15)]


def test_a_paraphrase_may_change_the_rare_words(spark):
    item = COMMON[:5] + ["NX1"] + COMMON[5:10] + ["NX2"] + COMMON[10:] + ["NX3"]
    changed = ["other" if x.startswith("NX") else x for x in item]
    less = ["other" if x.startswith("NX") or x == "c7" else x for x in item]
    docs = [(i, " ".join(COMMON[i % 7:] + COMMON[:i % 7][::-1])) for i in range(400)] + [(1000, " ".join(changed)), (1001, " ".join(less))]
    dd = spark.createDataFrame(docs, "doc_id long, text string")
    ii = spark.createDataFrame([(1, " ".join(item), None)], "item_id long, text string, answer string")
    got = {r.doc_id: (r.kind, r.shared) for r in leaks.leaks(dd, ii).collect() if r.doc_id >= 1000}
    assert got == {1000: ("paraphrase", 15 / 18)}


def test_every_alignment_of_a_passage(spark):
    item = [f"v{i}" for i in range(18)]
    changed = ["x" if i in (5, 11) else w for i, w in enumerate(item)]
    filler = [f"f{i}" for i in range(60)]
    docs = [(100 * n + at, " ".join(filler[:at] + (changed if n else item) + filler[at:])) for n in (0, 1) for at in range(25)]
    dd = spark.createDataFrame(docs, "doc_id long, text string")
    ii = spark.createDataFrame([(1, " ".join(item), None)], "item_id long, text string, answer string")
    got = {r.doc_id: (r.kind, r.shared) for r in leaks.leaks(dd, ii).collect()}
    assert got == {100 * n + at: (("verbatim", 1.0), ("paraphrase", 16 / 18))[n] for n in (0, 1) for at in range(25)}


def test_recall_of_planted_paraphrases(spark):
    import random

    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    draw = lambda n: [words[min(2999, int(rng.paretovariate(0.6)) - 1)] for _ in range(n)]
    items = [(k, draw(rng.randint(18, 60))) for k in range(60)]
    docs, planted = [], set()
    for d in range(600):
        k = rng.randrange(60)
        w = items[k][1]
        at = rng.randrange(0, len(w) - 17)
        at -= at % leaks.ITEM_STRIDE  # one of the item's passages
        part = list(w[at:at + 18])
        for i in rng.sample(range(18), rng.randint(1, 3)):
            part[i] = f"new{d}x{i}"
        docs.append((d, " ".join(draw(rng.randint(0, 40)) + part + draw(rng.randint(0, 40)))))
        planted.add((d, k))
    dd = spark.createDataFrame(docs, "doc_id long, text string")
    ii = spark.createDataFrame([(k, " ".join(w), None) for k, w in items], "item_id long, text string, answer string")
    got = {(r.doc_id, r.item_id) for r in leaks.leaks(dd, ii).collect()}
    assert len(planted & got) == len(planted)  # 15 of 18 words in order are 0.83 of the passage
