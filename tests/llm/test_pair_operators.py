"""The Jaccard join and decontamination against brute force and on odd tables."""

import random
import re

import cases
import numpy as np
import pytest

from veilframe.llm import common, decontaminate, jaccard, queries
from veilframe.llm.components import components


@pytest.fixture(scope="module")
def odd(spark):
    return cases.odd_documents(spark).cache()


def near_copies(seed: int = 5) -> list[tuple]:
    """Groups of near copies about the threshold, chains of them, shared passages, and short texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    passage = [word() for _ in range(60)]
    rows = []
    for g in range(6):
        base = [word() for _ in range(rng.choice([12, 40, 90, 200]))]
        for _ in range(25):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                text[rng.randrange(len(text))] = word()
            rows.append(" ".join(text))
    chain = [word() for _ in range(100)]
    for _ in range(20):
        chain[rng.randrange(100)] = word()
        chain[rng.randrange(100)] = word()
        rows.append(" ".join(chain))
    rows += [" ".join([word() for _ in range(20)] + passage + [word() for _ in range(15)]) for _ in range(40)]
    rows += ["a b c d e f g h i", "a b c d e f g h", "A b c d e f g h", "a b c", "a b c", "a b", "", "  ", *[rows[3]] * 5]
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(i * 3 + 1, rows[k]) for i, k in enumerate(order)]


@pytest.mark.parametrize(("small", "block", "hot"), [(32, 4096, 512), (2, 7, 512), (2, 7, 2)])
def test_near_duplicates(spark, monkeypatch, small, block, hot):
    monkeypatch.setattr(jaccard, "HOT_SHINGLE", hot)
    monkeypatch.setattr(jaccard, "SMALL_TILE", small)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()}
    assert found == cases.components(rows)


def test_near_duplicates_of_all_documents(spark):
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op2_jaccard_join(spark, cases.SF).collect()}
    assert found == cases.components(cases.table("documents", ["doc_id", "text"]))


def test_near_duplicates_of_odd_documents(spark, odd):
    rows = jaccard.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    want = cases.components(list(enumerate(cases.odd_texts())))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id is not None} == want
    assert jaccard.near_duplicates(cases.empty_documents(spark)).count() == 0


def test_sets_that_share_a_class_and_keys_of_many_rows(spark, odd, monkeypatch):
    monkeypatch.setattr(common, "HOT", 1)
    rows = [(i, f"{'a b c d e f g h i j k l m n o p q r s t u v ' * 4} {i % 7} end {i}") for i in range(60)] + [(100 + i, f"w{i} x{i} y z{i} q") for i in range(30)] + [(200, None), (201, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = cases.components(rows)
    for bits in (64, 3):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs, class_bits=bits).collect()}
        assert got == want
    assert jaccard.near_duplicates(odd).count() == odd.count()


def test_spread_join_equals_a_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 4)
    left = spark.createDataFrame([(None if i % 11 == 0 else i % 3, i) for i in range(80)], "k long, i long")
    right = spark.createDataFrame([(0, "x"), (1, "y"), (5, "z")], "k long, v string")
    for how in ("inner", "left"):
        assert sorted(map(str, common.spread_join(left, right, ["k"], ["i"], how=how).collect())) == sorted(map(str, left.join(right, ["k"], how).collect()))


def test_class_links_are_all_links(spark):
    rows = near_copies(9)[:120]
    links, members = jaccard.class_links(spark.createDataFrame(rows, "doc_id long, text string"))
    cls = {r.cls: r.doc_id for r in members.orderBy("doc_id").collect()}
    sets = {i: cases.shingles(t) for i, t in rows}
    found = {frozenset((sets[cls[r.a]], sets[cls[r.b]])) for r in links.collect()}
    distinct = [s for s in set(sets.values()) if s]
    want = {frozenset((a, b)) for a in distinct for b in distinct if a != b and 100 * len(a & b) >= 80 * len(a | b)}
    assert found == want


def test_bounds_are_never_too_low():
    assert jaccard.shingle_set("A b\x0bc".encode()).tolist() == jaccard.shingle_set(b"a B c").tolist()
    rng = np.random.default_rng(3)
    for _ in range(200):
        n, m = rng.integers(1, 300, 2)
        pool = rng.integers(0, 2**63, 400).astype(np.uint64)
        a, b = np.unique(rng.choice(pool, n)), np.unique(rng.choice(pool, m))
        exact = len(np.intersect1d(a, b))
        assert jaccard.overlap(a, b) == exact
        assert jaccard.overlap_bound(jaccard.bit_map(a), jaccard.bit_map(b), len(a), len(b)) >= exact


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(200, 200 + i) for i in range(50)] + [(7, 7)]
    label = {x: x for link in links for x in link}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert found == {x: label[x] for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def benchmark_cases(spark):
    items = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho"), (2, "short item here"), (3, "two words"), (4, "solo"), (5, None), (6, "..."), (None, "null id item with some words"), (2, "short item here"), (7, "Ünïcode Wörds! déjà-vu 漢字")]
    return items, spark.createDataFrame(items, "item_id long, text string")


def contaminated(text: str | None, items: list[tuple]) -> tuple:
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    doc, hit, names = words(text), set(), set()
    for key, item in items:
        own = words(item)
        n = min(13, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if own else set()
        for i in range(len(doc) - n + 1):
            if tuple(doc[i : i + n]) in windows:
                hit.update(range(i, i + n))
                names.add("" if key is None else str(key))
    return len(doc), len(hit), sorted(names), bool(hit) and 20 * len(hit) >= len(doc)


@pytest.mark.parametrize("block_bytes", [8 << 20, 40])
def test_decontamination(spark, odd, block_bytes):
    items, benchmark = benchmark_cases(spark)
    long_item = items[0][1]
    texts = [*cases.odd_texts(), long_item, "x " + long_item.upper() + " y", " ".join(long_item.split()[2:15]), " ".join(long_item.split()[2:14]), "a short, item: here solo two words", "solo " * 30, "solo " + "w " * 30, "null id item with some words", "ünïcode Wörds DéJà vu 漢字", " ".join(long_item.split()[:13] * 3)]
    texts = [t if t is None or len(t) < 20000 else t[:5000] for t in texts]
    docs = spark.createDataFrame([*enumerate(texts), (0, None), (19, texts[19])], "doc_id long, text string").repartition(3)
    rows = decontaminate.contamination(docs, benchmark, block_bytes=block_bytes).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.n_words, r.n_hit, list(r["items"]), r.contaminated) == contaminated(texts[r.doc_id], items), r.doc_id
        assert sum(b - a for a, b in zip(r.starts, r.ends, strict=True)) == r.n_hit
    assert decontaminate.contamination(cases.empty_documents(spark), benchmark).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(odd, benchmark.limit(0)).collect())


def test_decontamination_of_all_documents(spark):
    items = cases.table("benchmark", ["item_id", "text"])
    texts = dict(cases.table("documents", ["doc_id", "text"]))
    rows = queries.op7_decontamination(spark, cases.SF).collect()
    assert {r.doc_id for r in rows} == {*texts}
    for r in rows:
        n_words, n_hit, names, bad = contaminated(texts[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n_words, n_hit, len(names), cases.sha(",".join(names)), bad)


def test_repeated_items_make_no_block_of_their_own(spark):
    words = [f"w{i}" for i in range(14)]
    items = [(1, " ".join(words))] * 50 + [(2, " ".join(reversed(words))), (None, "x y z"), (4, None)]
    docs = spark.createDataFrame([(1, " ".join(["a", *words, "b"])), (2, "x y z"), (3, "none")], "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(str, decontaminate.contamination(docs, benchmark).collect()))
    assert sorted(map(str, decontaminate.contamination(docs, benchmark, block_bytes=60).collect())) == whole
    assert len(decontaminate._indexes(benchmark, "item_id", "text", 13, 60)) <= 3
