import random

from tessera.llm import decontamination as D

rng = random.Random(5)


def least(item, text):
    """Least distance of the item to any part of the text ending at each place (plain dynamic programming)."""
    column, out = list(range(len(item) + 1)), []
    for c in text:
        new = [0]
        for i, p in enumerate(item):
            new.append(min(column[i] + (p != c), column[i + 1] + 1, new[i] + 1))
        column = new
        out.append(column[-1])
    return out


def test_myers_equals_dynamic_programming():
    for _ in range(300):
        item = "".join(rng.choice("ab c") for _ in range(rng.randint(1, 30)))
        text = "".join(rng.choice("ab c") for _ in range(rng.randint(0, 80)))
        k = rng.randint(0, len(item))
        assert list(D.ends(item, text, k)) == [(j + 1, d) for j, d in enumerate(least(item, text)) if d <= k]


def edited(text, k):
    t = list(text)
    for _ in range(k):
        i = rng.randrange(len(t))
        rng.choice([lambda: t.__setitem__(i, "q"), lambda: t.insert(i, "z"), lambda: t.pop(i)])()
    return "".join(t)


def test_finds_every_place_brute_force_finds():
    words = ["the", "of", "heand", "onti", "thor", "qui", "éau", "x"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, say(rng.randint(3, 30))) for i in range(30)]
    finder = D.Finder(items, 0.1)
    for _ in range(150):
        text = say(20)
        for i, t in rng.sample(items, 2):
            text += "  \n" + edited(t, rng.randint(0, D.budget(t, 0.1) + 2)).upper() + " " + say(8)
        got = {m[0] for m in finder.find(text)}
        assert got == {i for i, t in items if min(least(D.plain(t), D.plain(text))) <= D.budget(D.plain(t), 0.1)}
        for i, a, b, d in finder.find(text):
            t = D.plain(dict(items)[i])
            ends = text[a].isspace() + text[b - 1].isspace()  # plain() takes white space at the ends of the part away
            assert d <= least(t, D.plain(text[a:b]))[-1] <= d + ends


def test_edges(spark):
    item = "a passage of the benchmark that is long enough to allow for two or three edits"
    docs = spark.createDataFrame([(1, "x " + item.upper() + " y", 0), (2, None, 0), (3, "", 0), (4, "clean words", 0), (None, edited(item, 2), 0), (1, "x " + item.upper() + " y", 0), (5, "w " * 100_000 + item.replace(" ", "\n\t") + " w" * 1000, 0), (6, item + " " + item, 0), (7, "İ " + item, 0)], "doc_id long, text string, N_leaks int")
    items = spark.createDataFrame([(10, item, 1), (11, None, 1), (12, "  ", 1), (None, item, 1)], "item_id long, text string, doc_id int")
    rows = D.leaks(docs, items).collect()
    assert sorted(((r.doc_id, r.item_id) for r in rows), key=str) == sorted([(d, i) for d in (1, 1, None, 5, 6, 6, 7) for i in (10, None)], key=str)
    one = next(r for r in rows if r.doc_id == 1)
    assert (one.start, one.end, one.distance) == (2, 2 + len(item), 0)
    seven = next(r for r in rows if r.doc_id == 7)
    assert ("İ " + item)[seven.start : seven.end] == item
    assert sorted((tuple(r) for r in D.leaks(docs, items, block_chars=60).collect()), key=str) == sorted((tuple(r) for r in rows), key=str)
    kept = D.clean(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
    assert D.clean(docs, items.limit(0)).count() == 9 and D.leaks(docs.limit(0), items).count() == 0 and D.leaks(docs, items.limit(0)).count() == 0


def test_repeated_items_and_ids_of_any_type(spark):
    import datetime
    import decimal

    item = "a passage of the benchmark that is long enough to allow for two or three edits"
    day = datetime.date(2024, 1, 2)
    items = spark.createDataFrame([(day, item)] * 2000 + [(day, item.upper())], "item_id date, text string")
    docs = spark.createDataFrame([(decimal.Decimal("1.50"), "x " + item), (None, "clean")], "doc_id decimal(4,2), text string")
    blocks = list(D.blocks_of(items, "text", 100))
    assert sum(map(len, blocks)) == 1
    rows = D.leaks(docs, items, block_chars=100).collect()
    assert len(rows) == 2001 and {(r.doc_id, r.item_id) for r in rows} == {(decimal.Decimal("1.50"), day)}
    assert [r.doc_id for r in D.clean(docs, items).collect()] == [None]


def test_table(spark):
    sf = "/root/testdata/sf0.01"
    got = {(r.doc_id, r.item_id) for r in D.op9(spark, sf).collect()}
    items = [(r.item_id, D.plain(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    exact = {(r.doc_id, i) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() for i, t in items if t in D.plain(r.text)}
    assert exact and exact <= got
