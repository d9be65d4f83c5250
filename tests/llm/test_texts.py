import gc
import hashlib
import random
import weakref
from collections import Counter

import brute
import pytest
from awkward_rows import awkward, empty  # noqa: F401
from raterscope.llm import decontamination, licenses, merkle, near_duplicates


# --- decontamination -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def contaminated(spark):
    random.seed(11)
    vocabulary = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(random.choice(vocabulary) for _ in range(random.randint(1, 30)))) for i in range(30)]
    items += [(100, "Two Words"), (100, "other text of the same item"), (101, None), (102, ""), (None, "a row without an id, that has enough")]
    docs = []
    for i in range(300):
        parts = [" ".join(random.choice(vocabulary) for _ in range(random.randint(0, 30))) for _ in range(3)]
        if random.random() < 0.5:
            words = random.choice(items)[1] or ""
            parts.insert(1, words.replace(" ", random.choice([" ", ", ", "\n"])).upper())
        docs.append((1000 + i, " oov ".join(parts)))
    return docs, items


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_contamination(spark, awkward, contaminated, block_bytes):
    rows, items = contaminated
    docs = awkward.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.judge(decontamination.find_matches(docs, benchmark, block_bytes=block_bytes))
    named = [(i, t) for i, t in items if i is not None]
    texts = {}
    for r in docs.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"])
    expected = Counter()
    for doc, own in texts.items():
        for text in own:
            n, hit, _, _, bad = brute.contamination(text, items)
            _, _, n_items, sha, _ = brute.contamination(text, named)
            expected[(doc, n, hit, n_items, sha, bad)] += 1
    assert Counter(map(tuple, found.collect())) == expected
    kept = decontamination.remove_contaminated(docs, benchmark, block_bytes=block_bytes)
    assert kept.columns == docs.columns
    assert kept.count() == sum(c for row, c in expected.items() if not row[-1])


def test_longest_matches(spark):
    docs = spark.createDataFrame([(1, "x " + " ".join(f"a{i}" for i in range(20)) + " y")], "doc_id long, text string")
    benchmark = spark.createDataFrame([("q", " ".join(f"a{i}" for i in range(2, 40)))], "item_id string, text string")
    matches = decontamination.find_matches(docs, benchmark).first()["matches"]
    assert [tuple(m) for m in matches] == [("q", 3, 21, 0)]


def test_nothing_to_match(spark, awkward, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.judge(decontamination.find_matches(awkward, none)).filter("contaminated").count() == 0
    assert decontamination.remove_contaminated(awkward, none).count() == awkward.count()
    assert decontamination.remove_contaminated(empty, none).count() == 0


# --- near duplicates -----------------------------------------------------------------------


def near_copies():
    random.seed(5)
    vocabulary = [f"w{i}" for i in range(300)]
    seed = [random.choice(vocabulary) for _ in range(120)]
    rows = []
    for i in range(400):
        words = list(seed)
        for _ in range(random.choice([0, 1, 2, 3, 4, 8, 12])):
            words[random.randrange(len(words))] = random.choice(vocabulary)
        rows.append((i, " ".join(words[: random.randint(90, 120)])))
    rows += [(1000 + i, " ".join(random.choice(vocabulary[:6]) for _ in range(random.randint(0, 9)))) for i in range(200)]
    shared = " ".join(random.choice(vocabulary) for _ in range(60))
    return rows + [(2000 + i, f"{shared} {i} " + " ".join(random.choice(vocabulary) for _ in range(40))) for i in range(150)]


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_components(spark, width, percent):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {tuple(r) for r in near_duplicates.components(docs, width, percent).collect()}
    assert got == brute.components(rows, width, percent)


def test_small_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK", 8)
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in near_duplicates.components(docs, 3, 90).collect()}
    assert got == brute.components(rows, 3, 90)


@pytest.mark.parametrize("sent_rows", [500_000, 0])
def test_links_over_rows_without_an_id(spark, monkeypatch, sent_rows):
    """1 and 3 are linked over the middle only, whose id is null; both ways of fetching texts see it."""
    monkeypatch.setattr(near_duplicates, "SENT_ROWS", sent_rows)
    words = [f"w{i}" for i in range(200)]
    chain = [words[:], words[:], words[:]]
    chain[1][:3] = ["x1", "x2", "x3"]
    chain[2][:3] = ["x1", "x2", "x3"]
    chain[2][-4:] = ["y1", "y2", "y3", "y4"]
    rows = [(i, " ".join(w)) for i, w in zip((1, None, 3), chain)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    direct = brute.components([(1, rows[0][1]), (3, rows[2][1])], 3, 94)
    assert {c for _, _, c in direct} == {1, 3}
    assert {(r["doc_id"], r["component_id"]) for r in near_duplicates.components(docs, 3, 94).collect()} == {(1, 1), (None, 1), (3, 1)}
    more = docs.unionByName(spark.createDataFrame([(i, t) for i, t in near_copies()], docs.schema))
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_duplicates.components(more, 3, 94).filter("doc_id > 3").collect()}
    assert got == {r for r in brute.components(near_copies(), 3, 94) if r[0] > 3}


def test_one_id_with_a_third_of_all_rows(spark):
    near = [(i, t) for i, t in near_copies() if i > 3]
    rows = near + [(7, t) for _, t in near[:: 2]] + [(8, near[0][1])] * 300
    got = near_duplicates.components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    assert len(got) == len(rows)
    # Every row apart, to know which are linked; then each group goes by its smallest id.
    apart = {i: c for i, _, c in brute.components([(10_000 + i, t) for i, (_, t) in enumerate(rows)], 3, 90)}
    least = {}
    for place, (own, _) in enumerate(rows):
        group = apart[10_000 + place]
        least[group] = min(own, least.get(group, own))
    wanted = Counter((own, least[apart[10_000 + place]]) for place, (own, _) in enumerate(rows))
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == wanted


def test_popular_openings_lose_no_link(spark, monkeypatch):
    """All n-grams of the opening are popular, so some prefixes consist of them."""
    monkeypatch.setattr(near_duplicates, "SAMPLE_ROWS", 500)
    random.seed(4)
    opening = " ".join(f"o{i}" for i in range(60))
    rows = [(i, opening + " " + " ".join(random.choice("abcdefgh") * 3 for _ in range(random.choice([0, 2, 4])))) for i in range(400)]
    rows += [(500 + i, f"{opening} " + " ".join(f"u{i} v{j}" for j in range(30))) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in near_duplicates.components(docs, 3, 90).collect()} == brute.components(rows, 3, 90)


def test_awkward_components(awkward, empty):
    rows = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_duplicates.components(awkward, 3, 90).collect()}
    assert {(2, 0, 2), (3, 0, 3), (10, 0, 10), (8, 1, 8), (None, 0, None)} <= rows
    assert {c for i, _, c in rows if i in (4, 5)} == {4}
    kept = near_duplicates.keep_one_of_each(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 7, 8, 9, 10]
    assert near_duplicates.components(empty).count() == 0


def test_rows_are_removed_by_id_and_text(spark):
    copied = "a passage of enough words that stands under several ids of the table as it is"
    clean = "quite another text that nobody else has and that must therefore stay in the table"
    rows = [(1, copied), (2, copied), (2, clean), (3, clean + " alone three"), (3, clean + " alone three"), (4, ""), (4, ""), (None, copied)]
    rows += [(5, "one more lonely text that is repeated under its id"), (5, "one more lonely text that is repeated under its id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = Counter(tuple(r) for r in near_duplicates.keep_one_of_each(docs, 5, 90).collect())
    assert kept == Counter([(1, copied), (2, clean), (3, clean + " alone three"), (4, ""), (4, ""), (None, copied), rows[-1]])


# --- fingerprints --------------------------------------------------------------------------


def test_fingerprints_against_the_sorted_list(spark):
    random.seed(2)
    rows = [(i, "".join(random.choice("ab .,\n é😀") for _ in range(random.randint(0, 400)))) for i in range(300)]
    rows[7] = (7, None)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r["doc_id"]: r for r in merkle.fingerprints_with_next(docs, range_bytes=3000).collect()}
    ordered = [(i, t or "") for i, t in sorted(rows, reverse=True)]
    assert len(got) == len(rows)
    for (i, text), (_, following) in zip(ordered, ordered[1:] + ordered[:1]):
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        r = got[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == merkle.fingerprint(text) and r["edited_fingerprint"] == merkle.fingerprint(edited)
        assert r["near_edited"] == merkle.likeness(merkle.fingerprint(text), merkle.fingerprint(edited))
        assert r["near_next"] == merkle.likeness(merkle.fingerprint(text), merkle.fingerprint(following))


def test_trees_are_lossless_and_locate_edits():
    text = "One. Two, three.\nFour five.\n\n" + "Six seven. " * 40 + "\nEight.\n"
    changed = text.replace("Four five", "Four 5")
    one, other = merkle.fingerprint(text), merkle.fingerprint(changed)
    (section, start, end), = merkle.differences(one, other)
    assert text[start:end].startswith("Four five") and section == 0
    assert merkle.differences(one, one) == [] and merkle.likeness(one, one) == 1
    assert 0.9 < merkle.likeness(one, other) < 1
    assert merkle.likeness(merkle.fingerprint(""), merkle.fingerprint("")) == 1
    assert merkle.likeness(one, merkle.fingerprint("")) == 0
    total = sum(int(leaf.partition("+")[2]) * n for leaf, n in merkle._weights(one).items())
    assert total == len(text)


def test_awkward_fingerprints(awkward, empty):
    rows = merkle.fingerprints_with_next(awkward, range_bytes=2000).collect()
    assert len(rows) == awkward.count()
    prints = [r["fingerprint"] for r in rows if r["doc_id"] in (4, 5)]
    assert len(set(prints)) == 1
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    single = awkward.filter("doc_id = 9")
    assert merkle.fingerprints_with_next(single).first()["near_next"] == 1
    assert merkle.fingerprints_with_next(empty).count() == 0
    assert merkle.fingerprints(awkward).count() == awkward.count()


def test_benchmark_blocks_are_searched_one_after_the_other(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"oov a{i} b{i} c{i} oov") for i in range(40)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(i, f"a{i} b{i} c{i}") for i in range(40)], "item_id long, text string")
    built, held = [], []

    def watched(*args, plain=decontamination.benchmark_blocks):
        for block in plain(*args):
            built.append(weakref.ref(block))
            gc.collect()
            held.append(sum(r() is not None for r in built))
            yield block
            del block

    monkeypatch.setattr(decontamination, "benchmark_blocks", watched)
    found = decontamination.find_matches(docs, benchmark, block_bytes=100)
    assert len(built) > 3 and max(held) <= 2
    assert {r["doc_id"]: [m["item"] for m in r["matches"]] for r in found.collect()} == {i: [str(i)] for i in range(40)}


# --- licenses ------------------------------------------------------------------------------


def test_base_phrases(spark, awkward, empty):
    random.seed(4)
    parts = ["CC BY", "cc", "by", "General Public License", "general", "public", "license", "All rights reserved.", "all", "rights", "x", "é", "\n", "-"]
    rows = [(100 + i, " ".join(random.choice(parts) for _ in range(random.randint(0, 30)))) for i in range(500)]
    docs = awkward.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    got = Counter(tuple(r)[1:6] for r in licenses.scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect())
    assert got == Counter(brute.license_places(r["text"]) for r in docs.collect())
    assert licenses.scan(empty).count() == 0


def test_templates(spark):
    noise = " ".join(f"n{i}" for i in range(50))
    texts = {
        1: f"{noise} Licensed under the Apache License, Version 2.0. {noise}",
        2: f"{noise} Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal without limits",
        3: f"{noise} This work is licensed under the GNU General Public License, version 3. {noise}",
        4: f"licensed {noise} under the version apache 2 0 license {noise}",
        5: f"{noise} Licensed under CC BY-NC 4.0.",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    labels = {i: set(r["labels"].split(",")) for i, r in got.items()}
    assert "apache-2.0" in labels[1] and "gpl-3.0" in labels[3] and "cc-by-nc" in labels[5]
    assert labels[2] == {""} and labels[4] == {""} and "cc-by-4.0" not in labels[5]
    place, = [p for p in got[1]["places"] if p["label"] == "apache-2.0"]
    assert place["start"] == 50 and 0.5 <= place["coverage"] <= 1


def test_every_template_of_a_text_with_many_notices(spark):
    long = {t.label: t.text for t in licenses.TEMPLATES if t.label in ("mit", "bsd") and len(t.text) > 60}
    short = ["Licensed under the Apache License, Version 2.0", "Licensed under CC BY 4.0", "Licensed under the GNU Lesser General Public License"]
    texts = {
        1: " oov ".join([*long.values(), *short]),
        2: " oov ".join(t.text for t in licenses.TEMPLATES),
        3: " oov ".join(t.text for t in reversed(licenses.TEMPLATES)),
    }
    # The words of the short notices are frequent elsewhere.
    texts |= {i: "licensed under the version of cc by apache gnu license, lesser 2 0 general 4 public" for i in range(4, 40)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert {"mit", "bsd", "apache-2.0", "cc-by-4.0", "lgpl"} <= set(got[1]["labels"].split(","))
    everything = {t.label for t in licenses.TEMPLATES}
    for i in (2, 3):
        assert everything <= set(got[i]["labels"].split(","))
        assert all(p["coverage"] == pytest.approx(1) for p in got[i]["places"]) and len(got[i]["places"]) == len(everything)


def test_templates_at_every_start(spark):
    """Labels, coverages and places against every template tried at every start; some templates have no key phrase."""
    import math

    random.seed(12)
    templates = licenses.TEMPLATES + (
        licenses.Template("keyless", "the quick brown fox of this license jumps over the copyright notice", ()),
        licenses.Template("short", "license notice", ()),
        licenses.Template("clash", "general public license notice", ("general", "license")),
    )
    texts = [""]
    for _ in range(120):
        parts = []
        for _ in range(random.randint(1, 4)):
            cut = brute.words(random.choice(templates).text)
            a, b = sorted((random.randint(0, len(cut)), random.randint(0, len(cut)))) if random.random() < 0.5 else (0, len(cut))
            piece = [w if random.random() > random.choice([0, 0, 0.05, 0.4]) else random.choice(["oov", "license", "the", "of"]) for w in cut[a:b]]
            parts.append(" ".join(piece))
        texts.append(random.choice([" ", " license the ", " "]).join(parts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = Counter(w for t in texts for w in set(brute.words(t)))
    idf = {w: math.log((1 + len(texts)) / (1 + held[w])) for t in templates for w in brute.words(t.text)}
    found = 0
    for r in licenses.scan(docs, templates=templates).collect():
        expected = brute.license_templates(texts[r["doc_id"]], templates, idf)
        got = {p["label"]: (p["coverage"], p["start"], p["end"]) for p in r["places"]}
        assert {k: v[1:] for k, v in got.items()} == {k: v[1:] for k, v in expected.items()}
        assert all(got[k][0] == pytest.approx(expected[k][0]) for k in got)
        assert set(r["labels"].split(",")) - {""} == got.keys() | (set(r["base_labels"].split(",")) - {""})
        assert r["score"] == pytest.approx(1.0 if r["n_base"] else max((c for c, _, _ in got.values()), default=0.0))
        found += len(got)
    assert found > 100


def test_rounds_and_one_task_give_the_same_components(spark, monkeypatch):
    from raterscope.llm import components

    random.seed(1)
    edges = [(i, i + 1) for i in range(60)] + [(random.randrange(200, 400), random.randrange(200, 400)) for _ in range(120)]
    df = spark.createDataFrame(edges + [(7, 7), (-5, 500)], "a long, b long")
    at_once = {tuple(r) for r in components.connected_components(df).collect()}
    monkeypatch.setattr(components, "TASK_EDGES", 0)
    assert {tuple(r) for r in components.connected_components(df).collect()} == at_once
    assert (60, 0) in at_once and (500, -5) in at_once
