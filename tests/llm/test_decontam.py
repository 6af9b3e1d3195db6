from collections import Counter

from tests.llm.conftest import make
from veldt.llm import decontam as D

ITEM = "Anna drives her old car 30 km to the red market and buys 12 apples and 5 pears for 7 dollars. How many fruits does Anna carry home?"
SAME = ITEM.replace("Anna", "Boris").replace("30", "44").replace("12", "9")
MIXED = ITEM.replace("Anna drives", "Boris drives").replace("does Anna", "does Clara")
LEAD = "some words of other text that stand before it "


def bench(spark, rows):
    return spark.createDataFrame([(*r, 1.0) for r in rows], "item_id long, text string, share double")


def verdicts(df, b):
    return Counter((r["doc_id"], r["contaminated"], r["item_id"], r["changed"]) for r in D.decontaminate(df, b).collect())


def test_copies_parameters_and_clean_texts(spark):
    half = " ".join(ITEM.split()[:16])
    docs = make(spark, [(1, LEAD + ITEM + " " + LEAD, "en", "a"), (2, LEAD + SAME, "en", "a"), (3, LEAD * 40, "en", "a"),
                        (4, LEAD + half + " " + LEAD, "en", "a"), (5, LEAD + " ".join(ITEM.split()[:8]), "en", "a"),
                        (None, ITEM, "en", "a"), (None, "clean", "en", "a"), (6, None, "en", "a"), (7, "", "en", "a"),
                        (8, ITEM.replace(" ", "\n\t| "), "en", "a"), (8, ITEM.replace(" ", "\n\t| "), "en", "a"),
                        (9, LEAD * 3000 + ITEM, "en", "a")])
    b = bench(spark, [(11, ITEM), (12, ITEM), (13, "too short"), (14, None), (15, "what is the name of it"), (None, None)])
    assert verdicts(docs, b) == Counter({
        (1, True, 11, False): 1, (2, True, 11, True): 1, (3, False, None, False): 1, (4, True, 11, False): 1, (5, False, None, False): 1,
        (None, True, 11, False): 1, (None, False, None, False): 1, (6, False, None, False): 1, (7, False, None, False): 1,
        (8, True, 11, False): 2, (9, True, 11, False): 1})
    left = D.drop_contaminated(docs, b)
    assert left.columns == docs.columns and Counter(r["doc_id"] for r in left.collect()) == Counter([3, 5, None, 6, 7])


def test_inconsistent_slots_do_not_count(spark):
    docs = make(spark, [(1, MIXED, "en", "a"), (2, SAME, "en", "a")])
    m = {r["doc_id"]: r for r in D.matches(docs, bench(spark, [(1, ITEM)])).collect()}
    assert m[2]["windows"] == m[2]["total"] and m[1]["windows"] < m[2]["windows"]


def test_case_does_not_matter(spark):
    docs = make(spark, [(1, LEAD + ITEM.upper(), "en", "a"), (2, LEAD + ITEM.lower(), "en", "a"), (3, ITEM.replace("30", "44").upper(), "en", "a"),
                        (4, ITEM.replace("30", "44").lower(), "en", "a"), (5, (LEAD * 4).upper(), "en", "a"), (6, MIXED.upper(), "en", "a")])
    b, old = bench(spark, [(1, ITEM)]), D.BROADCAST_WINDOWS
    want = {(1, True, 1, False): 1, (2, True, 1, False): 1, (3, True, 1, True): 1, (4, True, 1, True): 1, (5, False, None, False): 1}
    try:
        for most in (old, 0):
            D.BROADCAST_WINDOWS = most
            assert verdicts(docs.where("doc_id < 6"), b) == Counter(want)
    finally:
        D.BROADCAST_WINDOWS = old
    m = {r["doc_id"]: r for r in D.matches(docs, b).collect()}
    assert m[1]["windows"] == m[2]["windows"] == m[3]["windows"] == m[4]["windows"] == m[1]["total"] and m[6]["windows"] < m[6]["total"]


def test_copies_are_judged_one_by_one(spark):
    """A copy word for word beside a re-parameterised one, many copies, one split by more words, equal numbers that change apart."""
    tom = "Tom has 12 red marbles and 9 blue ones in his bag"
    zed, ann = tom.replace("Tom", "Zed").replace("12", "15").replace("9", "3"), tom.replace("Tom", "Ann").replace("12", "40").replace("9", "8")
    even = "Mia buys 6 large boxes of tea and 6 small boxes of salt for the long winter"
    docs = make(spark, [(1, LEAD + tom + " " + LEAD + zed, "en", "a"), (2, f"{LEAD} {zed} {LEAD} {ann} {LEAD} {zed} {LEAD} {ann}", "en", "a"),
                        (3, even.replace("6 large", "2 large").replace("6 small", "4 small"), "en", "a"),
                        (4, SAME.replace("red market", "red old market"), "en", "a"), (5, LEAD * 9, "en", "a")])
    b = bench(spark, [(1, tom), (2, even), (3, ITEM)])
    assert verdicts(docs, b) == Counter({(1, True, 1, False): 1, (2, True, 1, True): 1, (3, True, 2, True): 1, (4, True, 3, True): 1, (5, False, None, False): 1})
    m = {r["doc_id"]: r for r in D.matches(docs, b).collect()}
    assert all(m[i]["windows"] == m[i]["total"] for i in (1, 2, 3)) and m[4]["windows"] < m[4]["total"]


def test_short_items_match_as_one_window(spark):
    docs = make(spark, [(1, "so tell me who wrote the iliad in greek please", "en", "a"), (2, "who wrote it", "en", "a")])
    assert verdicts(docs, bench(spark, [(1, "who wrote the iliad in greek")])) == Counter({(1, True, 1, False): 1, (2, False, None, False): 1})


def test_every_window_counts(spark):
    """Word for word: items of numbers and names, of one template, shorter than five words, in scripts without spaces."""
    sums = "Solve 3 x + 5 y = 12 and 7 x - 2 y = 9."
    names = "Alice, Bob, Carl and Dora scored 12, 15, 18 and 21 points; Eve scored 30."
    one = "a farmer puts {} apples in each of his baskets and carries them to the old mill"
    han = "小明有三个苹果，小红有五个苹果，他们一共有几个苹果？"
    items = [sums, names, "Name two primes", han] + [one.format(i) for i in range(100, 130)]
    b = bench(spark, list(enumerate(items)))
    texts = [sums, names.upper(), "please name two primes now", "他说" + han + "好", one.format(117), one.format(999), one.format(5)[:40],
             "Solve 4 x + 6 y = 12 and 8 x - 3 y = 9.", "name three primes", "苹果很好吃", "the old mill " + LEAD]
    docs = make(spark, [(i, LEAD + t, "en", "a") for i, t in enumerate(texts)])
    old = D.BROADCAST_WINDOWS
    try:
        for most in (old, 0):
            D.BROADCAST_WINDOWS = most
            got = {r["doc_id"]: r["item_id"] for r in D.decontaminate(docs, b).where("contaminated").collect()}
            assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 4}
    finally:
        D.BROADCAST_WINDOWS = old


def test_shuffled_path_gives_the_same(spark):
    docs, b = make(spark, [(1, LEAD + SAME, "en", "a"), (2, LEAD, "en", "a"), (None, ITEM, "en", "a")]), bench(spark, [(1, ITEM)])
    want, old = verdicts(docs, b), D.BROADCAST_WINDOWS
    D.BROADCAST_WINDOWS = 0
    try:
        assert verdicts(docs, b) == want
    finally:
        D.BROADCAST_WINDOWS = old


def test_empty(spark, empty, messy):
    b = bench(spark, [(1, ITEM)])
    assert D.decontaminate(empty, b).count() == 0
    assert not any(r["contaminated"] for r in D.decontaminate(messy, bench(spark, [])).collect())
