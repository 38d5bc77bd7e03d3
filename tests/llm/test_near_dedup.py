"""Near-duplicate groups against all pairs on small tables."""

import random
import re

import pytest

from panelkit.llm import near_dedup, stages


def shingles(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def brute(rows, words):
    """component of every (id, text): smallest id reachable."""
    sets = [(i, shingles(t, words)) for i, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, (i, a) in enumerate(sets):
        for y, (j, b) in enumerate(sets[:x]):
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(sets):
        if i is not None:
            least[find(x)] = min(least.get(find(x), i), i)
    return [least[find(x)] if i is not None else None for x, (i, _) in enumerate(sets)]


def corpus():
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(4000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows, common = [], text(60)
    original = text(150)
    rows.append(original)
    for _ in range(150):  # copies of one text, often further from one another than from it
        copy = list(original)
        for _ in range(rng.randrange(1, 12)):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        rows.append(copy)
    for _ in range(120):  # a passage that many texts share
        rows.append(text(rng.randrange(20, 90)) + common)
    chain = text(120)
    for i in range(12):  # each is near the one before, the ends are not near
        chain = list(chain)
        for k in range(5):
            chain[(i * 10 + k) % 120] = f"c{i}{k}"
        rows.append(chain)
    rows += [text(rng.randrange(1, 40)) for _ in range(150)]
    texts = [" ".join(r) for r in rows]
    texts += [texts[5]] * 60 + [texts[5].upper(), texts[5].replace(" ", "\n\n"), "one", "one", "One", "two words", None, None, "", " \t"]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return [*zip(ids, texts), (None, texts[0]), (None, "lonely"), (ids[7], texts[7]), (ids[8], "another text under an id that was used")]


@pytest.mark.parametrize("words, part", [(2, near_dedup.BUCKET_PART), (5, near_dedup.BUCKET_PART), (5, 3)])
def test_components(spark, monkeypatch, words, part):
    monkeypatch.setattr(near_dedup, "BUCKET_PART", part)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id long, text string, n int, cls string").repartition(5)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.classify(docs, words).collect()), key=str)
    want = sorted(((i, len(shingles(t, words)), c, c == i) for (i, t), c in zip(rows, brute(rows, words))), key=str)
    assert got == want


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.classify(docs).count() == 0
    assert near_dedup.keep_single(docs).count() == 0


def test_star_components(spark):
    links = [(9, 1), (9, 2), (2, 3), (20, 21), (21, 22), (22, 23), (23, 24), (30, 30)]
    got = {(r["node"], r["root"]) for r in near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (9, 1), *[(i, 20) for i in range(20, 25)]}


def test_stage_keeps_one_row_of_each_group(spark):
    rows = corpus()
    common = " ".join(f"k{i}" for i in range(60))
    rows += [(9000, common)] * 5 + [(9000, common + " more")] * 2 + [(9001, common)] + [(None, "no id " + common)] * 3
    rows += [(None, " ".join(f"z{i}" for i in range(40)))] * 4
    docs = spark.createDataFrame([(i, t, n, "c") for n, (i, t) in enumerate(rows)], "doc_id long, text string, n int, row_key string").repartition(5)
    kept = stages.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    group = brute([(n, t) for n, (_, t) in enumerate(rows)], 5)
    got = [group[r["n"]] for r in kept.collect()]
    assert sorted(got) == sorted(set(group))
    best = {}
    for (i, _), g in zip(rows, group):
        best[g] = min(best.get(g, (True, 0)), (i is None, i or 0))
    assert all((r["doc_id"] is None, r["doc_id"] or 0) == best[group[r["n"]]] for r in kept.collect())


def test_recall_of_near_copies(spark):
    """Copies of 120 texts near the threshold, searched for every id divisible by 20 among all rows: all links are found."""
    rng = random.Random(11)
    rows = []
    for k in range(120):
        first = [f"r{k}w{rng.randrange(3000)}" for _ in range(160)]
        for changes in (0, 1, 2, 3, 4):
            copy = list(first)
            for at in rng.sample(range(160), changes):
                copy[at] = f"new{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    component = {r["doc_id"]: r["component_id"] for r in near_dedup.classify(docs, 5).collect()}
    sets = {i: shingles(t, 5) for i, t in rows}
    links = [(i, j) for i in range(0, len(rows), 20) for j in sets if j != i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert len(links) > 60 and all(component[i] == component[j] for i, j in links)


def test_plans_stay_small(spark, monkeypatch):
    """Rounds and the last step read stored rows, so the driver plans few joins at a time."""
    joins = []
    stored = near_dedup.pin

    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")

    monkeypatch.setattr(near_dedup, "pin", lambda df: joins.append(plan(df)) or stored(df))
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base[:57 - i % 8], *(f"x{i % 8}{j}" for j in range(3 + i % 8))])) for i in range(16)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = near_dedup.classify(docs, words=2)
    assert max([*joins, plan(out)]) <= 4, joins
    assert [r["component_id"] for r in out.orderBy("doc_id").collect()] == brute(rows, 2)
