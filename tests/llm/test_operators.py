"""The training-data operators against plain loops, and on empty, NULL and repeated rows."""

import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.llm import cross_parse, flat_graph, ftrl_quality, nb_toxicity, pareto_mix
from parley.llm import quality_ledger, secret_scan, simhash_grid, tool_links
from parley.llm.common import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, failed_bits string"


@pytest.fixture(scope="module")
def docs(spark):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    texts = [None, "", " \n", base, base, base.upper(), base + " x", f"{base}\n{base}\n{base}", "a " * 40]
    texts += ["token = 'abcdef123456' and " + base, "long " * 3000 + base, "AKIA" + "Z" * 20 + " " + "0f" * 15]
    rows = [(i, t, "en" if i % 2 else None, None if i == 3 else f"s{i % 3}", "x") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[4], (None, base, "de", "s1", "y")], DOCS)


def test_ledger_against_loops(docs):
    for row in quality_ledger.ledger(docs.drop("failed_bits")).collect():
        words = WORD.findall(row["text"] or "")
        windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in (row["text"] or "").split("\n") if WORD.search(x)]
        assert row["n_words"] == len(words) and row["word_chars"] == sum(map(len, words))
        assert row["n_repeat_words"] == len(covered) and row["n_dup_lines"] == len(lines) - len(set(lines))


def test_ablation_counts(docs):
    rows = quality_ledger.ledger(docs)
    bits = [r["failed_bits"] for r in rows.collect()]
    for r in quality_ledger.ablation(rows).collect():
        mask = quality_ledger.mask(r["policy"])
        bit = 1 << [x.name for x in quality_ledger.RULES].index(r["rule"])
        assert r["rejected"] == sum(b & mask != 0 for b in bits) and r["failed"] == sum(b & bit != 0 for b in bits)
        assert r["only_this"] == sum(b & mask == bit for b in bits)


@pytest.mark.parametrize("dense", [4096, 1])
def test_simhash_against_all_pairs(spark, docs, dense):
    chance = np.random.default_rng(4)
    words = [f"w{i}" for i in range(50)]
    texts = [" ".join(chance.choice(words, 60)) for _ in range(25)]
    texts += [" ".join([*t.split(), "more"]) for t in texts] + [t + " more still" for t in texts[:9]]
    rows = docs.select("doc_id", "text").unionByName(
        spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    )
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fingerprint"], r["component_id"])
                 for r in simhash_grid.near_duplicates(rows, dense=dense).collect())
    plain = [(r["doc_id"], simhash_grid.fingerprint(r["text"]) & (1 << 64) - 1) for r in rows.collect()]
    group = list(range(len(plain)))
    for _ in plain:
        for i, (_, a) in enumerate(plain):
            for j, (_, b) in enumerate(plain):
                if (a ^ b).bit_count() <= 4:
                    group[i] = group[j] = min(group[i], group[j])
    least = {}
    for (key, _), g in zip(plain, group):
        if key is not None:
            least[g] = min(least.get(g, key), key)
    want = sorted((k is None, k or 0, f"{f:016x}", least.get(g)) for (k, f), g in zip(plain, group))
    assert got == want


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}


def test_secrets(docs):
    rows = secret_scan.judged(docs).collect()
    assert len(rows) == docs.count()
    found = {r["key"]: [(f["kind"], f["start"], f["end"]) for f in r["found"]] for r in rows}
    assert found[9] == [("assign", 0, 21)] and found[11] == [("access", 0, 24), ("hex", 25, 55)] and found[0] == []
    hidden = {r["doc_id"]: r["text"] for r in secret_scan.redacted(docs).collect()}
    assert hidden[9].startswith("[SECRET]' and one") and hidden[0] is None


def test_secret_shared_by_many_owners_is_an_example(spark):
    rows = [(i, "password=swordfish77", f"o{i}") for i in range(4)] + [(9, "password=only4me99", "o9")]
    found = spark.createDataFrame(rows, "doc_id long, text string, source string")
    told = {r["doc_id"]: r["text"] for r in secret_scan.redacted(found).collect()}
    assert told[0] == "password=swordfish77" and told[9] == "[SECRET]"


def test_mix_reaches_targets(spark, docs):
    chance = np.random.default_rng(5)
    rows = [(i, "w " * int(chance.integers(1, 60)), f"s{i % 4}" if i % 9 else None) for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = {r["key"]: r for r in pareto_mix.mix(frame).collect()}
    again = {r["key"]: r["copies"] for r in pareto_mix.mix(frame.repartition(5)).collect()}
    assert {k: r["copies"] for k, r in first.items()} == again and max(again.values()) <= 3
    taken, target = collections.Counter(), {}
    for r in first.values():
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 60 for s in target)
    assert abs(sum(target.values()) - sum(r["size"] for r in first.values())) < 1e-6
    assert pareto_mix.mix(docs).count() == docs.count() and pareto_mix.mix(docs.limit(0)).count() == 0


def test_classifiers_tell_marked_texts(spark, docs):
    chance = np.random.default_rng(6)
    words = [f"word{i}" for i in range(40)]
    texts = [" ".join(chance.choice(words, 30)) + (" scoundrel knave" if i % 3 == 0 else "") for i in range(600)]
    labels = np.array([i % 3 == 0 for i in range(600)], dtype=float)
    for model, y in ((nb_toxicity, labels), (ftrl_quality, 1 - labels)):
        fitted = model.fit(texts[:450], y[:450])
        told = model.score(fitted, texts[450:]) >= model.THRESHOLD
        assert (told == (y[450:] == 1)).mean() > 0.95
        empty = model.score(model.fit([], np.empty(0)), ["", "x"])
        assert np.allclose(empty, 0.5)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = nb_toxicity.toxicity(docs, none).collect()
    assert len(rows) == docs.count() and {r["score"] for r in rows} == {0.5}


def test_automaton_knows_exactly_the_substrings():
    text = "abcabxabcd"
    codes = [ord(c) - 96 for c in text]
    ways = cross_parse.Automaton(codes).ways
    for probe in ("abcab", "xabc", "bd", "abcd", "ca", "cc", "dabc"):
        state = 0
        for c in probe:
            state = ways[state].get(ord(c) - 96) if state is not None else None
        assert (state is not None) == (probe in text)


def test_phrases_against_plain_search():
    chance = np.random.default_rng(2)
    samples = {"x": "the cat sat on the mat", "y": "ein hund und eine katze", "z": "天地玄黄宇宙洪荒日月盈昃"}
    texts = ["the hund sat", "", "xq the cat, eine 天地 katze! 日月", "qqqq", " ".join(chance.choice(list("thecaund "), 400))]
    model = cross_parse.learned(samples)
    for text, counts in zip(texts, cross_parse.phrases(model, texts).tolist()):
        even = "".join(c if c.isalpha() else " " for c in text.lower())
        while "  " in even:
            even = even.replace("  ", " ")
        for name, count in zip(model["languages"], counts):
            n, at = int(even[:1] not in samples[name]), 0
            while at < len(even):
                end = at + 1
                first = at if even[at] in samples[name] else end
                while end < len(even) and samples[name].find(even[first : end + 1]) >= 0:
                    end += 1
                n, at = n + 1, end
            assert count == n, (text, name)


def test_automata_of_large_alphabets_stay_small():
    chance = np.random.default_rng(5)
    samples = {f"s{i}": " ".join("".join(chance.choice(list("abcdefghij"), 5)) for _ in range(4000)) for i in range(3)}
    samples["large"] = "".join(map(chr, chance.integers(0x4E00, 0x4E00 + 2400, 24_000)))
    model = cross_parse.learned(samples)
    assert sum(x.nbytes for x in model.values() if isinstance(x, np.ndarray)) < 10_000_000


def test_language(spark, docs):
    rows = [(i, "der die das und nicht mit" if i % 2 else "the of and not with this", "de" if i % 2 else "en") for i in range(60)]
    frame = spark.createDataFrame([*rows, (99, "123 !", None), (100, None, "en")], "doc_id long, text string, lang string")
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in cross_parse.language(frame).collect()}
    assert found[99] == ("und", 0.0) and found[100] == ("und", 0.0)
    assert all(found[i][0] == ("de" if i % 2 else "en") for i in range(60))
    assert {r["lang_pred"] for r in cross_parse.language(frame.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}


def test_flat_graph_against_all_pairs(spark):
    chance = np.random.default_rng(7)
    base = chance.normal(size=(900, 16))
    base[300:420] = base[300] + 0.02 * chance.normal(size=(120, 16))
    base[500] = base[501]
    rows = [(i, v.astype(np.float32).tolist(), int(i % 2)) for i, v in enumerate(base)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, rows[0][1], None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in flat_graph.near_duplicates(frame).collect()}
    unit = flat_graph.matrix([r[1] for r in rows[:900]])
    near = (unit @ unit.T >= 0.98) & (np.arange(900)[:, None] % 2 == np.arange(900) % 2)
    np.fill_diagonal(near, False)
    assert len(got) == 904 and all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(900, 904))
    assert sum(min(got[i]["n_links"], near[i].sum()) for i in range(900)) >= 0.9 * near.sum()
    assert all(got[i]["n_links"] <= near[i].sum() for i in range(900))


SCHEMAS = {"f": {"a": ("integer", True), "b": ("string", False)}}


def test_tool_links(spark):
    calls = spark.createDataFrame(
        [
            (1, "x", 1, "f", '{"b": "t", "a": 1}', ["y"]),
            (1, "y", 2, "f", '{"a": "1"}', []),
            (1, "y", 9, "f", "later repeats lose", []),
            (1, "p", 3, "f", "no json", ["q"]),
            (1, "q", 4, "g", '{"a": 1}', ["p"]),
            (2, "x", 1, "f", "{}", None),
            (None, "x", 1, "f", '{"a": 2, "c": 3}', None),
        ],
        "conv long, id string, at long, tool string, arguments string, needs array<string>",
    )
    results = spark.createDataFrame(
        [(1, "x", 5, "ok"), (1, "z", 6, "who"), (2, "x", 2, None)], "conv long, id string, at long, content string"
    )
    rows = {(r["conv"], r["id"]): r for r in tool_links.linked(calls, results, SCHEMAS).collect()}
    assert len(rows) == 7
    told = {k: (r["place"], r["state"], r["problems"]) for k, r in rows.items()}
    assert told[1, "y"] == (1, "unanswered", ["type:a"]) and told[1, "x"] == (2, "linked", [])
    assert told[1, "p"] == (3, "cycle", ["not json"]) and told[1, "q"] == (4, "cycle", ["unknown tool"])
    assert told[1, "z"] == (5, "orphan", None) and told[2, "x"] == (1, "linked", ["missing:a"])
    assert told[None, "x"][1:] == ("unanswered", ["unknown:c"])
    assert rows[1, "x"]["message"] == '{"arguments":{"a":1,"b":"t"},"content":"ok","id":"x","state":"linked","tool":"f"}'


def test_levels_of_chains_diamonds_and_cycles(spark):
    needs = [(1, f"c{i}", f"c{i + 1}") for i in range(70)]  # a chain of 71
    needs += [(1, "top", "c0"), (1, "top", "c30"), (1, "top", "leaf"), (1, "above", "top"), (1, "high", "above")]
    needs += [(1, "high", "top"), (1, "roof", "high"), (1, "self", "self"), (1, "a", "b"), (1, "b", "a")]
    needs += [(1, "behind", "a"), (1, "both", "a"), (1, "both", "leaf"), (1, "late", "both"), (1, "free", "nobody")]
    needs += [(2, "c0", "c1"), (1, "top", "leaf")]
    known = {(c, x) for c, a, b in needs for x in (a, b)} - {(1, "nobody")}
    above = {k: {(c, b) for c, a, b in needs if (c, a) == k and (c, b) in known} for k in known}
    want = dict.fromkeys(known)
    for _ in known:
        for k in known:
            if want[k] is None and all(want[n] is not None for n in above[k]):
                want[k] = max((want[n] + 1 for n in above[k]), default=0)
    calls = spark.createDataFrame(sorted(known), "conv long, id string")
    found = tool_links.levels(calls, spark.createDataFrame(needs, "conv long, id string, needed string"))
    assert {(r["conv"], r["id"]): r["level"] for r in found.collect()} == want and found.count() == len(known)


def group_in_label(size, total, noise, seed=3):
    """Unit vectors of 64 components, of which the first ``size`` are near one another, and their links."""
    chance = np.random.default_rng(seed)
    base = chance.normal(size=(total, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    base[:size] = base[0] + noise * chance.normal(size=(size, 64))
    rows = [(i, v.astype(np.float32).tolist(), 1) for i, v in enumerate(base)]
    unit = flat_graph.matrix([r[1] for r in rows])
    return rows, (unit @ unit.T >= 0.98).sum(axis=1) - 1


def test_pairs_of_visitors_are_counted(spark, monkeypatch):
    monkeypatch.setattr(flat_graph, "TARGET", 100)
    monkeypatch.setattr(flat_graph, "MOST", 150)
    rows, near = group_in_label(375, 750, 0.0125)
    nodes = spark.createDataFrame(rows, "node long, vec array<float>, grp string").selectExpr("*", "1L copies")
    found = flat_graph.linked(nodes, 2, 24).groupBy("node").sum("links").collect()
    links = np.zeros(750, dtype=int)
    links[[r[0] for r in found]] = [r[1] for r in found]
    assert (links <= near).all() and links.sum() >= 0.97 * near.sum(), links.sum() / near.sum()


def test_overlap_is_raised_at_every_split(spark, monkeypatch):
    monkeypatch.setattr(flat_graph, "TARGET", 40)
    monkeypatch.setattr(flat_graph, "MOST", 60)
    monkeypatch.setattr(flat_graph, "FANOUT", 4)
    rows, _ = group_in_label(1, 600, 0.0)
    nodes = spark.createDataFrame(rows, "node long, vec array<float>, grp string")
    visits = [flat_graph.shards(nodes, overlap).filter("not home").count() for overlap in (1, 3)]
    assert visits[1] > 2.5 * visits[0]


def test_audit_asks_the_largest_components(spark):
    rows, near = group_in_label(40, 400, 0.0125)
    nodes = spark.createDataFrame(rows, "node long, vec array<float>, grp string").selectExpr("*", "1L copies")
    joined = spark.createDataFrame([(i, 0) for i in range(40)], "node long, component long")
    for share in (1, 2):
        links = spark.createDataFrame([(i, int(near[i]) // share) for i in range(40)], "node long, links long")
        told = flat_graph.audit(nodes, links, joined, sample=0)
        assert abs(told - 1 / share) < 0.02


def test_large_group_is_counted_whole(spark):
    rows, near = group_in_label(1500, 3000, 0.0125)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in flat_graph.near_duplicates(frame).collect()}
    links = np.array([got[i]["n_links"] for i in range(3000)])
    assert (links <= near).all() and links.sum() >= 0.99 * near.sum()
    assert {got[i]["component_id"] for i in range(1500)} == {0}


def test_multiples_of_one_vector(spark):
    rows, _ = group_in_label(1, 2000, 0.0)
    rows = [(i, (np.array(rows[0][1]) * (1 + i / 7)).tolist() if i < 1000 else v, 1) for i, v, _ in rows]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r["n_links"] for r in flat_graph.near_duplicates(frame).collect()}
    assert all(got[i] == 999 for i in range(1000)) and all(got[i] == 0 for i in range(1000, 2000))
    exact = [(i, [float(x * (i + 1)) for x in (3, -5, 7)], 1) for i in range(800)]
    nodes = spark.createDataFrame(exact, "id long, v array<double>, l int").select(flat_graph.direction(F.col("v")).alias("v"))
    assert nodes.distinct().count() == 1


def test_vectors_stay_double(spark):
    rows = [(0, [1.0, 2.0, 3.0]), (1, [1.0, 2.0, 3.0 + 1e-12]), (2, [1e200, 2e200, 3e200]), (3, [1e-200, 2e-200, 3.1e-200])]
    nodes = spark.createDataFrame(rows, "id long, v array<double>").select("id", flat_graph.direction(F.col("v")).alias("v"))
    assert nodes.select("v").distinct().count() == 4 - 1  # 0 and 2 are multiples of each other
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, label int")
    assert {r["vec_id"]: r["n_links"] for r in flat_graph.near_duplicates(frame).collect()} == dict.fromkeys(range(4), 3)
