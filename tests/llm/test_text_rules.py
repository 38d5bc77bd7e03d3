"""Quality rules, licence scans, decontamination and chat repair against brute force."""

import collections
import hashlib
import itertools
import re

import pytest

from panelkit.llm import chat, decontaminate, licences, quality

DOC = "doc_id long, text string, n_words string, kept string, item string"
LONG = " ".join(f"w{i % 700}" for i in range(30_000))
TEXTS = [
    None, "", "   \n\t ", "one", "a b c a b c", "x\nx\n x\ny\n\n\n", LONG, "the cat sat " * 40,
    "Überall ist es schön und gut, so wie es war.\nÜberall ist es schön und gut, so wie es war.", "a | b | c %%% ###",
    "Released under the MIT License.\nmore text here", "licensed  under CC-BY-NC 4.0", "a\x00b \x1c c",
]


def frame(spark, texts):
    rows = [(i, t, "x", "y", "z") for i, t in enumerate(texts)] + [(0, None, "x", "y", "z"), (None, "dup dup", None, None, None)]
    return spark.createDataFrame(rows, DOC)


def base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    times, hit = collections.Counter(grams), set()
    for i, g in enumerate(grams):
        if times[g] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_quality(spark):
    docs = frame(spark, TEXTS)
    labels = spark.createDataFrame([(4, 1, 0), (8, 1, 0), (9, 0, 0), (None, 1, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    weights = quality.fit_ratio(docs, quality.trusted_ids(labels))
    assert len(weights.first()["weights"]) == quality.BUCKETS
    out = quality.annotate(docs, weights, "quality").select("text", "quality.*").collect()
    assert len(out) == len(TEXTS) + 2
    for r in out:
        n, chars, symbols, dup, repeat = base(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeat)
        assert r["base_failed"] == (n < 50 or 100 * repeat > 50 * n)
        assert r["kept"] == (not r["base_failed"] and r["score"] >= quality.THRESHOLD)


def test_quality_score_is_the_mean_ratio(spark):
    docs = spark.createDataFrame([(1, "good words here"), (2, "bad % % %")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    weights = quality.fit_ratio(docs, quality.trusted_ids(labels))
    w = weights.first()["weights"]
    hashes = docs.select("doc_id", quality.ngram_hashes(docs["text"]).alias("h")).collect()
    want = {r["doc_id"]: sum(w[h % quality.BUCKETS] for h in r["h"]) / len(r["h"]) for r in hashes}
    got = {r["doc_id"]: r["quality"]["score"] for r in quality.annotate(docs, weights, "quality").collect()}
    assert all(abs(want[k] - got[k]) < 1e-9 for k in want) and want[1] > 0 > want[2]


def test_quality_without_trusted_or_rows(spark):
    docs = frame(spark, TEXTS)
    none = spark.createDataFrame([], "doc_id long, quality int")
    weights = quality.fit_ratio(docs, quality.trusted_ids(none))
    assert {r["quality"]["score"] for r in quality.annotate(docs, weights, "quality").collect()} == {0.0}
    empty = docs.limit(0)
    assert quality.annotate(empty, quality.fit_ratio(empty, quality.trusted_ids(none)), "quality").count() == 0


def dice_brute(text):
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\W_]", x)]
    found = []
    for u in lines + ([text] if len(lines) > 1 else []):
        w = re.sub(r"[^\w]|_", " ", u.lower()).split()
        g = set(zip(w, w[1:]))
        for name, t in licences.TEMPLATES:
            x = re.sub(r"[^\w]|_", " ", t.lower()).split()
            b = set(zip(x, x[1:]))
            if g and 2 * len(g & b) / (len(g) + len(b)) >= licences.DICE:
                found.append((-2 * len(g & b) / (len(g) + len(b)), name))
    return sorted(found)


def test_licences(spark):
    texts = TEXTS + [t for _, t in licences.TEMPLATES] + [t.upper() + "\n" + t for _, t in licences.TEMPLATES]
    for r in licences.scan(frame(spark, texts)).collect():
        text = None if r["doc_id"] is None or (r["doc_id"] == 0) else texts[r["doc_id"]]
        want = dice_brute(text if r["doc_id"] is not None else "dup dup")
        assert r["n_matches"] == len(want)
        assert r["licence"] == (want[0][1] if want else None)
        assert r["licences"] == ",".join(sorted({n for _, n in want}))
    assert licences.scan(frame(spark, TEXTS).limit(0)).count() == 0


def test_licence_spans(spark):
    filler = [f"w{i % 90} x{i % 7}" for i in range(600)]
    long = lambda x: " ".join(filler) + x + " ".join(filler)
    header = licences.TEMPLATES[1][1].split()
    cases = [(long(" text. Released under the MIT License. text "), "MIT"),
             (long("\n# " + "\n# ".join(" ".join(header[i:i + 6]) for i in range(0, len(header), 6)) + "\n"), "Apache-2.0"),
             (long("\nLicensed under\nCC BY-SA 4.0.\n"), "CC-BY-SA-4.0"), (long(" under the public general "), None)]
    cases += [(long("\n" + t + "\n"), name) for name, t in licences.full_texts()]
    out = {r["doc_id"]: r for r in licences.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")).collect()}
    for i, (_, name) in enumerate(cases):
        assert (name in out[i]["licences"].split(",") and out[i]["dice"] >= licences.DICE) if name else out[i]["n_matches"] == 0, (name, out[i])
    assert out[0]["licence"] == "MIT" and out[0]["dice"] == 1.0


def contaminated_brute(text, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = cut(text), set(), set()
    for item, t in items:
        x = cut(t)
        for win in [x[i:i + 13] for i in range(max(1, len(x) - 12))] if x else []:
            for s in range(len(w) - len(win) + 1):
                if w[s:s + len(win)] == win:
                    hit.update(range(s, s + len(win)))
                    if item is not None:
                        found.add(str(item))
    names = ",".join(sorted(found))
    return len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("block", [200_000, 3])
def test_decontamination(spark, block):
    passage = " ".join(f"p{i}" for i in range(30))
    items = [(1, passage), (10, "Short item"), (2, "one"), (3, None), (4, ""), (None, "only null here"), (1, passage),
             (5, "a a a a a a a a a a a a a a a"), (6, " ".join(f"p{i}" for i in range(5, 25)))]
    texts = TEXTS[:6] + [passage, passage.upper().replace(" ", ", "), "x " * 400 + passage, "short-item and only null here one",
                         " ".join(f"p{i}" for i in range(12)), " ".join(f"p{i}" for i in range(13)), "a " * 60, "SHORT  ITEM é"]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, texts)
    got = decontaminate.find(docs, benchmark, block_windows=block).collect()
    assert len(got) == len(texts) + 2
    want = collections.Counter((i, *contaminated_brute(t, items)) for i, t in [*enumerate(texts), (0, None), (None, "dup dup")])
    assert collections.Counter(tuple(r) for r in got) == want
    kept = decontaminate.keep_clean(docs.withColumn("row", docs["doc_id"]), benchmark, block_windows=block)
    assert kept.columns == [*docs.columns, "row"]
    clean = collections.Counter((i, t) for i, t in [*enumerate(texts), (0, None), (None, "dup dup")] if not contaminated_brute(t, items)[4])
    assert collections.Counter((r["doc_id"], r["text"]) for r in kept.collect()) == clean
    nothing = decontaminate.find(docs, benchmark.limit(0), block_windows=block).collect()
    assert all(r["n_hit"] == 0 and not r["contaminated"] for r in nothing)


def cheapest(roles):
    """Least cost over every choice of roles and insertions."""
    best = None
    for given in itertools.product((1, 2, 3), repeat=len(roles)):
        cost, state = 0, 0
        for role, new in zip(roles, given):
            cost += 0 if role == new else chat.RELABEL
            if state == new:
                cost += chat.MERGE
            elif new == 1:
                cost += 0 if state == 0 else 10**6
            elif new == 2:
                cost += 0
            else:
                cost += 0 if state == 2 else chat.INSERT
            state = new
        cost += {0: 0, 1: 2 * chat.INSERT, 2: chat.INSERT, 3: 0}[state]
        best = cost if best is None else min(best, cost)
    return best


def cost_of(rows):
    return sum((3 if "relabel" in r["action"] else 0) + ("merge" in r["action"]) + 2 * r["n_inserted"] for r in rows)


def legal(text):
    heads = re.findall(r"<\|(system|user|assistant)\|>", text)
    if heads[:1] == ["system"]:
        heads = heads[1:]
    return heads and len(heads) % 2 == 0 and all(h == ("user", "assistant")[i % 2] for i, h in enumerate(heads))


def test_chat(spark):
    names = [None, "tool", "system", "user", "assistant"]
    convs = list(itertools.product(names, repeat=4)) + [(a,) for a in names]
    rows = [(c, t, r, f"t{c}.{t}", "x") for c, conv in enumerate(convs) for t, r in enumerate(conv)]
    # One conversation over many partitions.
    rows += [(10_000, t, names[(t * t + t // 7) % 5], None if t % 5 == 0 else f"h{t}", "x") for t in range(3000)]
    out = chat.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece string").repartition(7))
    got = collections.defaultdict(list)
    for r in out.collect():
        got[r["conv_id"]].append(r)
    assert sum(map(len, got.values())) == len(rows)
    for c, conv in enumerate(convs):
        mine = sorted(got[c], key=lambda r: r["turn"])
        assert cost_of(mine) == cheapest([{"system": 1, "user": 2, "assistant": 3}.get(r, 0) for r in conv])
        text = "".join(r["piece"] for r in mine)
        assert legal(text) and all(f"t{c}.{t}" in text for t in range(len(conv)))
    hot = sorted(got[10_000], key=lambda r: r["turn"])
    codes = [{"system": 1, "user": 2, "assistant": 3}.get(r["role"], 0) for r in hot]
    states = chat.chain([chat.run_matrix(codes)])
    assert [r["role_out"] for r in hot] == [chat.ROLES[g - 1] for g in chat.solve(codes, 0, states[-1])]
    assert legal("".join(r["piece"] for r in hot))


def test_chat_edges(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert chat.repair(spark.createDataFrame([], schema)).count() == 0
    odd = chat.repair(spark.createDataFrame([(None, None, None, None), (None, 1, "user", None), (3, 1, "user", "a"), (3, 1, "user", "a")], schema))
    assert odd.count() == 4


def test_the_quality_stage_keeps_what_the_operator_keeps_without_a_filter_on_words(spark):
    good = "the quick brown fox jumps over a lazy dog and runs home again today " * 2
    texts = [good + " ".join(f"w{i}x{j}" for j in range(60)) for i in range(3)] + [None, "", "short", "same same same " * 40]
    docs = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(texts)], "doc_id long, text string, quality string")
    weights = quality.fit_ratio(docs, spark.createDataFrame([(0,), (1,)], "doc_id long"))
    kept = quality.keep_good(docs, weights)
    assert kept.columns == docs.columns
    want = quality.annotate(docs, weights, "q").where("q.kept").select("doc_id")
    ids = [sorted(r.doc_id for r in df.select("doc_id").collect()) for df in (kept, want)]
    assert ids[0] == ids[1] and ids[0]
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.split("\n") if "Filter" in line.split("(")[0] and "split" in line]


def test_the_quality_stage_keeps_columns_named_like_its_own(spark):
    text = "the quick brown fox jumps over a lazy dog and runs home again today " + " ".join(f"w{j}" for j in range(60))
    docs = spark.createDataFrame([(0, text, "a", "b", "c", "d")],
                                 "doc_id long, text string, __quality_text string, __quality_w string, __quality_g string, quality string")
    kept = quality.keep_good(docs, quality.fit_ratio(docs, spark.createDataFrame([(0,)], "doc_id long")))
    assert kept.columns == docs.columns and tuple(kept.first()) == (0, text, "a", "b", "c", "d")


@pytest.mark.parametrize("most", [1, 50, 2000, 9000])
def test_trusted_ids_are_the_lowest_hashes(spark, most):
    labels = spark.range(6000).selectExpr("id as doc_id", "1 as quality").union(spark.range(6000, 6100).selectExpr("id", "0"))
    got = [r["doc_id"] for r in quality.trusted_ids(labels.union(labels), most).collect()]
    want = [r["doc_id"] for r in labels.where("quality = 1").selectExpr("doc_id", "xxhash64(doc_id) as h").orderBy("h").limit(most).collect()]
    assert sorted(got) == sorted(want) and len(got) == min(most, 6000)


def test_chat_pieces_in_order_of_place_are_the_text(spark):
    """Equal and null turns and repeated rows: place alone gives the order, over several partitions too."""
    rows = [(1, t % 3 if t % 4 else None, ["user", "assistant", "tool", None][t * 7 % 4], f"x{t % 50}") for t in range(900)]
    rows += [(2, None, "user", "same")] * 5 + [(3, 7, "assistant", "b"), (3, 7, "assistant", "a"), (3, 7, "user", "c")]
    out = chat.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)).collect()
    assert len({r["place"] for r in out}) == len(out) == len(rows)
    for cid in (1, 2, 3):
        mine = sorted((r for r in out if r["conv_id"] == cid), key=lambda r: r["place"])
        given = [(-1 if r["turn"] is None else r["turn"], r["role"] or "") for r in mine]
        assert given == sorted(given)
        assert legal("".join(r["piece"] for r in mine))


def test_words_of_a_line_are_made_once(spark):
    """The whole text's words are those of its lines, so only lines are normalised, and the result is as before."""
    plan = licences.scan(frame(spark, TEXTS))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 1
    text = "Über uns\n--\nReleased under the\nMIT License. ΣΑΣ\nend"
    row = licences.scan(frame(spark, [text])).first()
    assert row.n_units == 5 and row.licences == "MIT"


def test_least_words_of_a_match():
    """No set of fewer template words holds as many bigrams as a match needs."""
    from itertools import combinations

    for _, bigrams in [*licences.template_bigrams(), ("x", ["a a", "a b", "b a", "a c", "c d", "d a"])]:
        words = sorted({w for b in bigrams for w in b.split()})
        least = licences._least_words(bigrams, licences.DICE)
        assert 1 <= least <= len(words)
        if len(words) <= 14:
            for some in combinations(words, least - 1):
                assert sum(set(b.split()) <= set(some) for b in bigrams) < licences._needed(len(bigrams), licences.DICE)


def test_a_licence_is_found_among_many_words(spark):
    """Words that no template has are left out before any span is compared; the spans come out as before."""
    noise = " ".join(f"w{i}" for i in range(400))
    texts = [f"{noise} Released under the MIT License. {noise}", f"{noise} released license under mit the {noise}", noise, None]
    out = licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r["n_matches"], r["licences"]) for r in out] == [(1, "MIT"), (0, ""), (0, ""), (0, "")]
