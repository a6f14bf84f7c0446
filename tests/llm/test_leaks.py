import random

from fathomgraph.llm import leaks as module
from fathomgraph.llm.leaks import RUN, STEP, Index, leaks, words


def brute(texts, passages):
    runs = [{tuple(w[k : k + RUN]) for k in range(len(w) - RUN + 1)} for w in map(words, passages)]
    return [[i for i, r in enumerate(runs) if any(tuple(w[k : k + RUN]) in r for k in range(len(w) - RUN + 1))] for w in map(words, texts)]


def test_finds_what_brute_force_finds():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)]
    passages = [" ".join(rng.choices(vocabulary, k=rng.randint(5, 60))) for _ in range(60)] + ["", None]
    passages += [passages[3], "same " * 30, " ".join(words(passages[0])[:20]) + " and a tail of other words here it goes on and on"]
    texts = ["", None, "same " * 12, "same " * 11]
    for _ in range(300):
        source = words(rng.choice(passages))
        a, n = rng.randint(0, max(0, len(source) - 5)), rng.randint(RUN - 2, RUN + 3)
        texts.append(" ".join(rng.choices(vocabulary, k=rng.randint(0, 2 * STEP)) + source[a : a + n] + rng.choices(vocabulary, k=rng.randint(0, 50))))
    index = Index(passages)
    assert [index.leaked(t) for t in texts] == brute(texts, passages)


def test_wand_returns_all_above_the_threshold():
    rng = random.Random(5)
    index = Index([" ".join(rng.choices("abcdefgh", k=40)) for _ in range(200)])
    for _ in range(100):
        terms = rng.sample(range(len(index.postings)), 12)
        score = {}
        for t in terms:
            for i, w in zip(index.postings[t].items, index.postings[t].weights):
                score[i] = score.get(i, 0) + w
        for threshold in (0.2, 0.5, 1.0):
            assert sorted(index.wand(terms, threshold)) == sorted(i for i, s in score.items() if s >= threshold)


def test_words():
    assert words("Ｆoo_BAR​baz ²x—Été") == ["foo", "barbaz", "2x", "été"]
    assert words(None) == words("") == []


def test_tables(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = spark.createDataFrame(
        [(1, passage.upper(), 1), (2, "zero " + passage.replace(" ", "\r\n"), 1), (3, passage.replace("six", "6"), 1), (4, None, 1), (5, "", 1), (1, passage + " The answer is BLUE.", 1)],
        "doc_id bigint, text string, item_id int",
    )
    items = spark.createDataFrame([("a", passage, "blue"), ("b", None, "x"), ("c", "short one", None), ("d", passage + " more", None)], "item_id string, passage string, answer string")
    got = sorted((r.doc_id, r.item_id, r.answer_found) for r in leaks(docs, items).collect())
    assert got == [(1, "a", False), (1, "a", True), (1, "d", None), (1, "d", None), (2, "a", False), (2, "d", None)]
    assert leaks(docs.limit(0), items).count() == 0 and leaks(docs, items.limit(0)).count() == 0


def test_many_items_need_one_read_and_none_is_lost(spark, monkeypatch):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(30)]
    passages = [" ".join(rng.choices(vocabulary, k=20)) for _ in range(60)]
    texts = [" ".join([*rng.choices(vocabulary, k=5), *words(p)[2:16], "end"]) for p in passages]
    items = spark.createDataFrame([("again", passages[0], None)] * 300 + [(f"i{k}", p, None) for k, p in enumerate(passages)], "item_id string, passage string, answer string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    expected = sorted((d, f"i{i}") for d, hits in enumerate(brute(texts, passages)) for i in hits)
    expected = sorted(expected + [(d, "again") for d, i in expected if i == "i0"])
    monkeypatch.setattr(module, "ITEMS_AN_INDEX", 10)
    found = leaks(docs, items)
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == expected
    assert found._jdf.queryExecution().toString().count("MapInArrow") == leaks(docs, items.limit(1))._jdf.queryExecution().toString().count("MapInArrow")
    monkeypatch.setattr(module, "BYTES_A_READ", 2_000)  # several reads
    assert sorted((r.doc_id, r.item_id) for r in leaks(docs, items).collect()) == expected
