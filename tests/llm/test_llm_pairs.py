"""Similarity join, decontamination, nearest neighbours and the pipeline against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
import tables
from pyspark.sql import functions as F

import corpus_pipeline
from sleepsignal.llm import ann, decontaminate, jaccard
from sleepsignal.llm.components import connected_components


def shingle_set(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i: i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_links(texts):
    """Links and root place of each text."""
    sets = [shingle_set(t) for t in texts]
    near = [[j for j, b in enumerate(sets) if j != i and a and b and 5 * len(a & b) >= 4 * len(a | b)] for i, a in enumerate(sets)]
    root = list(range(len(texts)))
    for _ in texts:
        root = [min([root[i], *(root[j] for j in near[i])]) for i in range(len(texts))]
    return [len(n) for n in near], root


def grown():
    """Awkward rows, and a chain of texts each near the next only, and a large group of near copies."""
    rng = random.Random(8)
    out = tables.rows()
    w = tables.words(rng, "en", 60)
    for k in range(8):
        w[7 * k] = f"link{k}"
        out.append((300 + k, " ".join(w), "en", *out[0][3:]))
    base = tables.words(rng, "es", 80)
    for k in range(90):
        w = list(base)
        w[rng.randrange(80)] = f"other{k}"
        out.append((400 + k, " ".join(w), "es", *out[0][3:]))
    return out


@pytest.mark.parametrize("small,block", [(64, 1024), (3, 17)])
def test_similarity_join_against_brute_force(spark, monkeypatch, small, block):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "BLOCK_NODES", block)
    data = grown()
    links, root = brute_links([r[1] for r in data])
    ids = {}
    for r, k in zip(data, root):
        if r[0] is not None:
            ids[k] = min(ids.get(k, r[0]), r[0])
    want = Counter((r[0], ids.get(k, r[0]) if n else r[0], n) for r, k, n in zip(data, root, links))
    got = jaccard.similarity_join(tables.docs(spark, data).repartition(5)).collect()
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == want


def test_keep_one_keeps_one_of_each_class(spark):
    data = grown()
    links, root = brute_links([r[1] for r in data])
    docs = tables.docs(spark, data)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    place = {}
    for r, k, n in zip(data, root, links):
        place.setdefault((r[0], r[1]), (k if n else None))
    rows = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    classes = Counter(place[r] for r in rows.elements() if place[r] is not None)
    assert set(classes) == {k for k, n in zip(root, links) if n} and set(classes.values()) == {1}
    assert sum(rows.values()) - len(classes) == sum(1 for n in links if not n)


def test_join_and_keep_of_no_rows(none):
    assert jaccard.similarity_join(none).collect() == []
    assert jaccard.keep_one(none).collect() == []


def test_prefixes_are_shortened_to_the_target():
    assert jaccard.depth_for(0.9999, 0.8, 20, 6) == 4
    assert jaccard.depth_for(0.9, 0.8, 20, 6) == 6
    with pytest.raises(ValueError):
        jaccard.depth_for(0.9999, 0.2, 2, 6)


def test_components_against_union(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(k, k + 1) for k in range(100, 140)]
    root = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in got} == root


def benchmark(spark):
    rng = random.Random(6)
    items = [(k, " ".join(tables.words(rng, "en", n)).capitalize() + ".", "x", 1) for k, n in enumerate([40, 20, 13, 9, 5, 4, 60])]
    items += [(50, items[0][1], "x", 1), (51, None, None, None), (52, "", "", 1), (None, "only an item without a number of its own here", "x", 1)]
    return items, spark.createDataFrame(items, "item_id long, text string, hash string, salt int")


def replaced(text, every, start=3):
    w = text.split()
    w[start::every] = ["changed"] * len(w[start::every])
    return " ".join(w)


def leaks(items, data):
    rng = random.Random(9)
    text = lambda n: " ".join(tables.words(rng, "de", n))
    cases = [
        (f"{text(50)} {items[0][1]} {text(20)}", 1), (replaced(items[0][1], 8), 1), (f"{text(5)} {items[1][1].upper()}", 1), (f"{text(3)}\n{items[2][1]}", 1),
        (f"{text(30)} {items[3][1]} {text(30)}", 1), (f"{text(9)} ({items[4][1]})", 1), (items[5][1], 0), (f"{text(20)} {' '.join(items[6][1].split()[20:38])} {text(9)}", 1),
        (f"{text(20)} {' '.join(items[6][1].split()[:9])} {text(9)}", 0), (replaced(items[6][1], 2), 0), (f"{text(4000)} {items[6][1]} {text(3000)}", 1), (text(200), 0),
    ]
    rows = [(700 + k, t, "en", *data[0][3:]) for k, (t, _) in enumerate(cases)]
    rows += [rows[0], (None, rows[0][1], *rows[0][2:])]
    return rows, {700 + k for k, (_, y) in enumerate(cases) if y}


def test_decontamination_finds_planted_items_only(spark):
    data = tables.rows()
    items, bench = benchmark(spark)
    rows, want = leaks(items, data)
    docs = tables.docs(spark, data + rows).repartition(4)
    got = decontaminate.contamination(docs, bench).collect()
    assert len(got) == len(data) + len(rows)
    assert {r["doc_id"] for r in got if r["contaminated"]} == want | {None}
    assert all(r["first_item"] == 0 for r in got if r["doc_id"] == 700)
    kept = decontaminate.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter((r[0], r[1]) for r in data + rows if r[0] not in want and r[1] != rows[0][1])


def test_a_full_bitmap_changes_nothing(spark):
    data = tables.rows()
    items, bench = benchmark(spark)
    rows, want = leaks(items, data)
    got = decontaminate.contamination(tables.docs(spark, data + rows), bench, bits=64).collect()
    assert {r["doc_id"] for r in got if r["contaminated"]} == want | {None}


def test_extra_columns_of_any_name(spark):
    data = tables.rows()
    items, bench = benchmark(spark)
    rows, want = leaks(items, data)
    docs = tables.docs(spark, data[:12] + rows)
    names = ["_j", "_J1", "_j2", "_l1", "_L2", "_k1", "_h", "root", "salt"]
    more = docs.withColumns({n: F.concat(F.lit("x"), F.col("doc_id").cast("string")) for n in names})
    for keep in (jaccard.keep_one, lambda x: decontaminate.remove_contaminated(x, bench)):
        got = keep(more)
        assert got.columns == more.columns
        assert Counter(r["doc_id"] for r in got.collect()) == Counter(r["doc_id"] for r in keep(docs).collect())


def test_decontamination_without_rows(spark, docs, none):
    _, bench = benchmark(spark)
    assert decontaminate.contamination(none, bench).collect() == []
    assert not any(r["contaminated"] for r in decontaminate.contamination(docs, bench.limit(0)).collect())


def vectors(spark, n=700, d=12, scale=False):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, d)).astype(np.float32)
    if scale:
        x *= rng.uniform(0.5, 2, (n, 1)).astype(np.float32)
    rows = [(int(i), [float(a) for a in v], 1, 0.5) for i, v in enumerate(x)]
    rows += [(n + k, rows[40][1], 1, 0.5) for k in range(40)] + [rows[40], rows[3]]
    bad = [(900 * 20, None), (901 * 20, []), (902 * 20, [0.0] * d), (903 * 20, [float("nan")] * d), (904 * 20, [float("inf")] + [1.0] * (d - 1)), (905 * 20, [None] + [1.0] * (d - 1)), (906 * 20, [1.0] * 3), (None, [1.0] * d)]
    return rows + [(i, v, 2, None) for i, v in bad], {r[0]: np.array(r[1]) for r in rows}


@pytest.mark.parametrize("scale", [False, True])
def test_neighbours_against_brute_force(spark, scale):
    rows, good = vectors(spark, scale=scale)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, node int, score double").repartition(5)
    got = {}
    for r in ann.nearest(table, ann.F.col("vec_id") % 20 == 0, 20).collect():
        got.setdefault(r["query_id"], []).append(r)
    assert set(got) == {i for i in good if i % 20 == 0}
    ids = np.array(sorted(good))
    x = np.array([good[i] for i in ids])
    hits = 0
    for q, found in got.items():
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 21)) and q not in {r["vec_id"] for r in found}
        assert all(r["score"] == pytest.approx(float(good[q] @ good[r["vec_id"]]), rel=1e-12) for r in found)
        assert [(-r["score"], r["vec_id"]) for r in found] == sorted((-r["score"], r["vec_id"]) for r in found)
        s = np.array([round(v, 9) for v in x @ good[q]])
        s[ids == q] = -np.inf
        hits += len({int(i) for i in ids[np.lexsort((ids, -s))[:20]]} & {r["vec_id"] for r in found})
    assert hits >= 0.95 * 20 * len(got)


def test_few_and_no_vectors(spark):
    kind = "vec_id long, embedding array<float>"
    assert ann.nearest(spark.createDataFrame([], kind), ann.F.col("vec_id") % 20 == 0).collect() == []
    three = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.0]), (20, None)], kind)
    got = ann.nearest(three, ann.F.col("vec_id") % 20 == 0).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 2, 1.0), (0, 2, 1, 0.5)]


def test_pipeline_stages(spark, tmp_path):
    """Stages in order over one folder; each keeps the columns, and its decisions are those of its operator."""
    data = tables.rows()
    items, bench = benchmark(spark)
    rows, want = leaks(items, data)
    rude = [(800 + k, f"{data[k][1]} grumbish {k} vile grumbish", "en", *data[0][3:]) for k in range(30)]
    docs = tables.docs(spark, data + rows + rude)
    labels = [(r[0], 1, int(r[0] >= 800)) for r in data + rude if r[0] is not None]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language ID", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing"]
    at, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, str(tmp_path))
        out.write.parquet(f"{tmp_path}/stage{k}")
        new = spark.read.parquet(f"{tmp_path}/stage{k}")
        if k < 4:
            assert new.columns == at.columns
        seen[name] = (at.collect(), new.collect())
        at = new
    ids = lambda rs: {r["doc_id"] for r in rs}
    before, after = seen["toxicity"]
    assert len(ids(before) & set(range(800, 830)) - ids(after)) >= 27 and len(ids(after) & set(range(60))) >= 58
    before, after = seen["language ID"]
    assert ids(before) & set(range(60)) <= ids(after) and all(any(c.isalpha() for c in r["text"]) for r in after)
    assert all(len(r["text"] or "") < 120 for r in before if r["doc_id"] not in ids(after))
    before, after = seen["n-gram Jaccard join"]
    _, root = brute_links([r["text"] for r in before])
    assert len(after) == len(set(root))
    before, after = seen["benchmark decontamination"]
    assert ids(before) - ids(after) == (want | {None}) & ids(before) - ids(after) and not want & ids(after)
    before, after = seen["best-fit packing"]
    assert ids(after) == ids(before) and sum(1 for r in after if r["piece"] == 0) == len(before)
    result = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in result) == Counter((r["doc_id"], r["ids_crc32"]) for r in after)


def test_language_stage_keeps_short_texts_and_drops_unknown_scripts(spark):
    data = tables.rows()
    short = [(900 + k, t, None, *data[0][3:]) for k, t in enumerate(("The.", "and", "THE and the 5", "of"))]
    odd = [(950 + k, t, None, *data[0][3:]) for k, t in enumerate(("ქართული ენა", "ភាសាខ្មែរ", "12 %", "", None, "ꙮꙮꙮ " * 2000))]
    got = corpus_pipeline.keep_known_languages(spark, tables.docs(spark, data + short + odd), "")
    ids = {r["doc_id"] for r in got.collect()}
    assert {900, 901, 902, 903} <= ids and not ids & set(range(950, 956))


def test_pipeline_of_empty_tables(spark, none, tmp_path):
    none.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
