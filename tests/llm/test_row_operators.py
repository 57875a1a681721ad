"""Sharding, secrets, fingerprints, BPE, language ID and personal data against brute force and on odd tables."""

import base64
import collections
import hashlib
import itertools
import math

import cases
import numpy as np
import pytest

from veilframe.llm import bpe, fingerprint, langid, pii, queries, secret_scan, sharding

public_tokenizers = pytest.importorskip("public_tokenizers")
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def odd(spark):
    return cases.odd_documents(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return cases.empty_documents(spark)


def test_jump_hash_is_the_published_loop():
    def plain(key, n):
        b, j = -1, 0
        while j < n:
            b, key = j, (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
        return b

    keys = np.array([0, 1, 42, 2**63, 2**64 - 1, *range(1000, 1200)], np.uint64)
    for n in (1, 2, 40, 41):
        assert sharding.jump_hash(keys, n).tolist() == [plain(int(k), n) for k in keys]
    with pytest.raises(ValueError, match="at least 1"):
        sharding.jump_hash(keys, 0)


def test_sharding(spark, odd, empty):
    rows = sharding.assign_shards(odd, 4, chunks=3).collect()
    assert len(rows) == odd.count()
    for k in range(4):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    assert all(r.grown_shard in (r.shard, 4) and r.law == "key" for r in rows)
    texts = dict(enumerate(cases.odd_texts()))
    for r in rows:
        if r.doc_id is not None:
            body = (texts[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32) == (len(body) + 16, cases.crc(texts[r.doc_id]))
    assert sharding.assign_shards(empty, 4).count() == 0


def test_shards_are_even_and_move_little(spark):
    many = spark.range(40000).selectExpr("id AS doc_id", "'t' AS text")
    rows = sharding.assign_shards(many, 40).groupBy("shard").count().collect()
    assert len(rows) == 40
    assert max(r["count"] for r in rows) < 1200
    moved = sharding.assign_shards(many, 40).where("shard <> grown_shard").collect()
    assert {r.grown_shard for r in moved} == {40}
    assert 700 < len(moved) < 1300


def test_shards_of_many_rows_have_more_chunks(spark, odd):
    rows = sharding.assign_shards(spark.range(5000).selectExpr("id AS doc_id", "'x' AS text"), 4, chunks=1, chunk_rows=100).collect()
    for k in range(4):
        mine = sorted(r.slot for r in rows if r.shard == k)
        assert mine == list(range(len(mine)))
    assert len(rows) == 5000


def test_written_shards_hold_all_rows(spark, odd, tmp_path):
    sharding.write_shards(odd, str(tmp_path / "s"), 5)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == odd.count()


def test_secrets(spark, odd, empty):
    rows = secret_scan.digest(secret_scan.secrets(odd)).collect()
    assert len(rows) == odd.count()
    texts = dict(enumerate(cases.odd_texts()))
    for r in rows:
        want = cases.secrets(texts[r.doc_id] if r.doc_id is not None else None)
        assert ((r.n_assign, r.n_access, r.n_hex), r.base_sha256) == (want["counts"], cases.sha(want["base"]))
        assert [x for x in r.spans.split(",") if x and not x.startswith("live")] == [x for x in want["base"].split(",") if x]
    assert any("live" in r.spans for r in rows)
    assert secret_scan.secrets(empty).count() == 0


def test_secrets_of_all_documents(spark):
    rows = queries.op4_secret_scan(spark, cases.SF).collect()
    texts = dict(cases.table("documents", ["doc_id", "text"]))
    assert {r.doc_id for r in rows} == {*texts}
    for r in rows:
        want = cases.secrets(texts[r.doc_id])
        assert ((r.n_assign, r.n_access, r.n_hex), r.base_sha256) == (want["counts"], cases.sha(want["base"]))


def test_copied_examples_are_told_from_live_values(spark):
    copied, own = "0123456789abcdef" * 2, "fedcba9876543210" * 2
    rows = [(i, f"key {copied}", f"s{i}") for i in range(4)] + [(9, f"{own} and {copied} {own}", "s9")]
    found = {r.doc_id: (r.n_live, r.n_example) for r in secret_scan.secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert found == {0: (0, 1), 1: (0, 1), 2: (0, 1), 3: (0, 1), 9: (1, 1)}


def test_personal_data(spark, odd, empty):
    rows = pii.digest(pii.find(odd)).collect()
    assert len(rows) == odd.count()
    texts = dict(enumerate(cases.odd_texts()))
    for r in rows:
        if r.doc_id is not None:
            want = cases.personal(texts[r.doc_id])
            assert ((r.n_email, r.n_ip, r.n_card, r.n_phone), r.base_sha256) == (want["counts"], cases.sha(want["base"])), r.doc_id
    assert pii.find(empty).count() == 0


def test_personal_data_of_all_documents(spark):
    rows = queries.op10_pii(spark, cases.SF).collect()
    texts = dict(cases.table("documents", ["doc_id", "text"]))
    assert {r.doc_id for r in rows} == {*texts}
    for r in rows:
        want = cases.personal(texts[r.doc_id])
        assert ((r.n_email, r.n_ip, r.n_card, r.n_phone), r.base_sha256) == (want["counts"], cases.sha(want["base"]))
        assert [x for x in r.spans.split(",") if x and not x.startswith("term")] == [x for x in want["base"].split(",") if x]


def test_sanitising(spark, odd, empty):
    rows = [(i, f"the quxorian desk, mail boss@corp.example the day {i}", "keep") for i in range(3)]
    rows += [(i, "the day is the day", "keep") for i in range(3, 9)] + [(9, None, "keep")]
    out = {r.doc_id: r for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert out[0].text == "the  ,  [EMAIL] the day 0"
    assert out[0].text.count("quxorian") == 0
    assert out[4].text == "the day is the day"
    assert out[9].text is None
    assert all(r.lang == "keep" for r in out.values())
    assert pii.sanitise(odd).count() == odd.count()
    assert pii.sanitise(empty).count() == 0
    assert not any("@" in (r.text or "") for r in pii.sanitise(odd).collect() if r.doc_id in (8, 13))


def test_words_of_many_pairs_are_counted_without_being_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"ask {name} Quill of harbour lane at {name}@mail.test today") for i, name in enumerate(["anna", "berta", "anna", "berta", "anna"])] + [(9, "harbour lane today")], "doc_id int, text string")
    several = sorted(map(str, pii.find(docs).drop("key").collect()))
    monkeypatch.setattr(pii, "BROADCAST_BYTES", 0)
    assert sorted(map(str, pii.find(docs).drop("key").collect())) == several and "term" in "".join(several)


def test_words_reveal_an_entity_of_one_document(spark):
    rows = [(0, "the quxorian desk, mail boss@corp.example the day")] + [(i, f"the day and the mail at the desk, only{'abcdefghijklmnopqrstuvwxyz'[i]} here") for i in range(1, 20)]
    out = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0] == "the [TERM] desk, mail [EMAIL] the day"
    assert all(out[i] == t for i, t in rows[1:])


def test_words_reveal_an_entity_from_anywhere_in_its_document(spark):
    filler = "the day and the mail at the desk " * 5
    rows = [(0, f"quxorian {filler}boss@corp.example {filler}the Quxorian")] + [(i, f"{filler}only{'abcdefghijklmnopqrstuvwxyz'[i]}") for i in range(1, 20)]
    rows += [(20, "+1 quxoria 2345678 me@here.example")]
    out = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0] == f"[TERM] {filler}[EMAIL] {filler}the [TERM]"
    assert all(out[i] == t for i, t in rows[1:20])
    assert out[20] == "+1 [TERM] 2345678 [EMAIL]"
    both = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string"), remove=0.7).collect()}
    assert both[0] == f" {filler}[EMAIL] {filler}the "
    assert both[20] == "+1 [TERM] 2345678 [EMAIL]"


def test_terms_of_whole_texts_stand_anywhere(spark):
    filler = "the day 12 and the mail at the desk " * 5
    text = f"Quxorian {filler}boss@corp.example {filler}the quxorian"
    rows = [(0, text), (1, text + " day")] + [(i, f"{filler}only") for i in range(2, 20)] + [(20, None), (None, text), (0, text)]
    out = pii.digest(pii.find(spark.createDataFrame(rows, "doc_id long, text string"), whole=True)).collect()
    mail, last = text.index("boss"), text.index("quxorian")
    want = f"email:{mail}:{mail + 17},term:0:8,term:{last}:{last + 8}"
    assert sorted((str(r.doc_id), r.spans) for r in out) == sorted((str(i), want if t and "boss" in t else "") for i, t in rows)


@pytest.mark.parametrize(("support", "prior"), [(2, 0.0), (1, 0.5)])
def test_terms_of_whole_texts_against_brute_force(spark, support, prior):
    texts = {k: t or "" for k, t in cases.table("documents", ["doc_id", "text"])}
    base = {k: [(int(x.split(":")[1]), int(x.split(":")[2])) for x in cases.personal(t)["base"].split(",") if x] for k, t in texts.items()}
    words = {k: [(m[0][0], m[-1][0] + 1) for a, g in itertools.groupby(enumerate(t), lambda c: c[1].isalpha()) if a and len(m := [*g]) > 2] for k, t in texts.items()}
    inside = {k: {t[s:e].lower() for s, e in words[k]} for k, t in texts.items()}
    n_t, n_v, n_both = collections.Counter(w for x in inside.values() for w in x), collections.Counter(), collections.Counter()
    held = {k: {t[s:e] for s, e in base[k]} for k, t in texts.items()}
    for k, vs in held.items():
        n_v.update(vs)
        n_both.update((v, w) for v in vs for w in inside[k])

    def reveals(v, w):
        p, bits = n_v[v] / len(texts), math.log2(len(texts) / n_v[v])
        return n_both[v, w] >= support and math.log2((n_both[v, w] + prior * p) / (n_t[w] + prior)) + bits >= 0.7 * bits

    told = {k: {w for w in inside[k] if any(reveals(v, w) for v in vs)} for k, vs in held.items()}
    want = {k: [(s, e) for s, e in words[k] if t[s:e].lower() in told[k] and not any(b < e and s < f for b, f in base[k])] for k, t in texts.items()}
    assert any(want.values())
    for r in pii.find(spark.read.parquet(f"{cases.SF}/documents.parquet"), support=support, prior=prior, whole=True).collect():
        assert [(x.s, x.e) for x in r.spans if x.kind == "term"] == want[r.doc_id]
        assert [(x.s, x.e) for x in r.spans if x.kind != "term"] == base[r.doc_id]


def test_fingerprints_with_edits(spark, odd):
    docs = spark.read.parquet(f"{cases.SF}/documents.parquet").repartition(5)
    rows = {r.doc_id: r for r in fingerprint.with_edits(docs).collect()}
    texts = sorted(cases.table("documents", ["doc_id", "text"]), reverse=True)
    assert len(rows) == len(texts)
    for i, (key, text) in enumerate(texts):
        after = texts[(i + 1) % len(texts)][1]
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        r, canon = rows[key], fingerprint.canonical(text)
        assert (r.n_chars, r.edited_sha256, r.fingerprint) == (len(text), hashlib.sha256(edited.encode()).hexdigest(), fingerprint.digest(canon))
        assert r.edited_fingerprint == fingerprint.digest(fingerprint.canonical(edited))
        assert (r.near_edited, r.near_next) == (float(fingerprint.canonical(edited) == canon), float(fingerprint.canonical(after) == canon))


def test_fingerprints_of_odd_documents(spark, odd, empty):
    rows = fingerprint.with_edits(odd).collect()
    assert len(rows) == odd.count()
    prints = {r.doc_id: r.fingerprint for r in rows}
    assert prints[0] == prints[1] == prints[2]
    assert prints[6] == prints[7]
    assert prints[14] == prints[15]
    assert prints[3] == prints[4] != prints[5]
    assert fingerprint.with_edits(empty).count() == 0
    assert fingerprint.fingerprints(empty).count() == 0
    assert {(r.doc_id, r.fingerprint) for r in fingerprint.fingerprints(odd).collect()} == {(r.doc_id, r.fingerprint) for r in rows}
    assert fingerprint.groups(fingerprint.fingerprints(odd)).agg({"n": "sum"}).first()[0] == odd.count()


def test_edits_of_an_id_of_many_rows(spark, monkeypatch):
    """An id, or none, of a third of all rows is cut into ranges by its texts; rows equal in both are kept."""
    import xxhash

    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 10)
    rows = [(i, f"text {i} of its own") for i in range(100)] + [(50, f"text {i} of one id") for i in range(150)] + [(None, f"text {i} of none") for i in range(150)] + [(None, None)] * 30 + [(7, "again and again")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    tie = lambda t: xxhash.xxh3_64_intdigest((t or "").encode()) >> 1
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), tie(r[1])))
    want = []
    for (key, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        text, k = text or "", len(text or "") // 3
        want.append((str(key), hashlib.sha256((text[: len(text) - k] + (after or "")[:k]).encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.edited_sha256) for r in fingerprint.with_edits(docs).collect()) == sorted(want)


def test_ranges_keep_the_order_of_rows():
    ranges = fingerprint._Ranges(np.array([-3, 5, 5, 5, 9, 9]))
    rows = sorted(((k, t) for k in range(-6, 12) for t in range(0, 1 << 63, 1 << 59)), key=lambda r: (-r[0], r[1]))
    found = ranges.of(np.array([k for k, _ in rows]), np.array([t for _, t in rows])).tolist()
    assert found == sorted(found) and set(found) == set(range(ranges.n))
    assert len({b for (k, _), b in zip(rows, found, strict=True) if k == 5}) == 4
    assert fingerprint._Ranges(np.empty(0, np.int64)).of(np.array([1, 2]), np.array([0, 5])).tolist() == [0, 0]


def test_edits_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 3)
    rows = {r.doc_id: r.edited_sha256 for r in fingerprint.with_edits(spark.range(50).selectExpr("id * 7 AS doc_id", "concat('text number ', id) AS text")).collect()}
    text = lambda i: f"text number {i % 50}"
    for i in range(50):
        k = len(text(i)) // 3
        assert rows[i * 7] == cases.sha(text(i)[: len(text(i)) - k] + text(i - 1 + 50)[:k])


def test_texts_that_share_a_digest_are_told_apart(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('t ', id % 1500) AS text")
    rows = fingerprint.fingerprints(docs, bits=12).collect()
    names = {}
    for r in rows:
        names.setdefault(r.doc_id % 1500, set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in names.values())
    assert len({f for x in names.values() for f in x}) == 1500


def test_bpe_equals_tiktoken_and_decodes(spark, odd, empty):
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = odd.select("doc_id", "text").unionByName(spark.read.parquet(f"{cases.SF}/documents.parquet").select("doc_id", "text"))
    coded = bpe.encode(docs, RANKS, PATTERN, decoded=True)
    rows = coded.join(docs.select("doc_id", "text").distinct().groupBy("doc_id").agg({"text": "collect_set"}), "doc_id").collect()
    for r in rows:
        assert any(r.ids == own.encode_ordinary(t) and bytes(r.decoded) == t.encode() for t in [*r["collect_set(text)"], ""]), r.doc_id
    back = bpe.decode(coded, RANKS, PATTERN, ids_col="ids").collect()
    assert sorted((r.text for r in back)) == sorted(r.text or "" for r in docs.collect())
    assert bpe.encode(empty, RANKS, PATTERN).count() == 0
    query = {r.doc_id: r for r in queries.op6_bpe(spark, cases.SF).collect()}
    for key, text in cases.table("documents", ["doc_id", "text"]):
        ids = own.encode_ordinary(text)
        assert (query[key].n_tokens, query[key].ids_sha256, query[key].decoded_sha256) == (len(ids), cases.sha(" ".join(map(str, ids))), cases.sha(text))


def test_bpe_offsets_and_split_characters(spark):
    text = "a é漢\U0001f600 don't  stop"
    row = bpe.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), RANKS, PATTERN, offsets=True).first()
    assert len(row.ids) == len(row.starts) == len(row.ends)
    assert row.ends[-1] == len(text)
    assert "".join(bpe.decode_stream(row.ids, RANKS, PATTERN)) == text
    assert sum(not p for p in bpe.decode_stream(row.ids, RANKS, PATTERN)) >= 2  # bytes that wait for the rest
    assert len(bpe.byte_alphabet()) == 256


def test_language_network_on_held_out_documents(spark, odd, empty):
    rows = queries.op9_language_id(spark, "/root/testdata/sf0.01").collect()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert {r.doc_id for r in rows} == {*truth}
    assert all(r.held_out == (cases.crc(str(r.doc_id)) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    known = [r for r in rows if r.held_out and r.lang_pred != "und"]
    assert sum(r.lang_pred == truth[r.doc_id] for r in known) / len(known) > 0.97
    network = langid.fit(docs)
    found = {r.doc_id: r for r in langid.predict(odd, network).collect() if r.doc_id is not None}
    assert found[0].lang_pred == found[1].lang_pred == found[2].lang_pred == "und"
    assert found[12].lang_pred in network.langs
    assert langid.predict(odd, network).count() == odd.count()
    assert langid.predict(empty, network).count() == 0
    assert langid.fit(empty) is None
    assert {r.lang_pred for r in langid.predict(odd, None).collect()} == {"und"}


def test_sharding_query_against_brute_force(spark):
    def jump(key, n):
        b, j = -1, 0
        while j < n:
            b, key = j, (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
        return b

    texts = dict(cases.table("documents", ["doc_id", "text"]))
    keys = {r.doc_id: r.k for r in spark.createDataFrame([(i,) for i in texts], "doc_id long").selectExpr("doc_id", "xxhash64(doc_id) AS k").collect()}
    rows = queries.op3_sharding(spark, cases.SF).collect()
    assert {r.doc_id for r in rows} == {*texts}
    slots = {}
    for r in rows:
        body = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(body) + 16, cases.crc(texts[r.doc_id]), "key")
        assert (r.shard, r.grown_shard) == (jump(keys[r.doc_id] % 2**64, 40), jump(keys[r.doc_id] % 2**64, 41))
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == [*range(len(s))] for s in slots.values())


def test_network_against_a_plain_convolution():
    rng = np.random.default_rng(1)
    f = [rng.normal(size=(w, langid.SYMBOLS, langid.FILTERS)).astype(np.float32) for w in langid.WIDTHS]
    total = len(f) * langid.FILTERS
    net = langid.Network(["a", "b", "c"], f, rng.normal(size=total).astype(np.float32), rng.normal(size=(total, 3)).astype(np.float32), np.zeros(3, np.float32))
    texts = ["short é", "a longer text " * 40]
    x, owner, size = langid.windows_of([t.encode() for t in texts])
    want = []
    for row in x:
        best = [max(sum(f[k][j][row[at + j], c] for j in range(w)) for at in range(len(row) - w + 1)) for k, w in enumerate(langid.WIDTHS) for c in range(langid.FILTERS)]
        z = np.maximum(np.array(best) + net.bias, 0) @ net.dense
        want.append(np.exp(z - z.max()) / np.exp(z - z.max()).sum())
    assert np.allclose(net.probabilities(x), want, atol=1e-4)
    langs, scores = langid.classify([*texts, None, "123"], net)
    for i in range(2):
        p = sum(w * s for w, s, o in zip(want, size, owner, strict=True) if o == i) / size[owner == i].sum()
        assert (langs[i], scores[i]) == (net.langs[int(p.argmax())], pytest.approx(p.max(), abs=1e-4))
    assert langs[2:] == ["und", "und"]


def test_all_of_a_text_is_learned_from_and_columns_stay(spark):
    rows = [(i, ("filler words here " * 30 if i % 2 else "other stuff there ") + " zzqq" * 60 * (i % 2) + " end", "xx" if i % 2 else "yy", "mine") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, told string")
    network = langid.fit(docs)
    assert langid.classify(["zzqq " * 20], network)[0] == ["xx"]
    kept = langid.annotate(docs, network)
    assert kept.columns == [*docs.columns, "lang_pred", "score"]
    assert {r.told for r in kept.collect()} == {"mine"}


def test_long_chunks_are_encoded_and_not_remembered():
    texts = ["two  spaces " * 500, "x" * 5000, "plain words again " + "y" * 100 + " end", "", "a\n\nb " * 300]
    coder = bpe.Encoder(RANKS, PATTERN)
    plain = coder.tokenizer.encode_batch(texts, add_special_tokens=False)
    for _ in range(2):
        assert [i.tolist() for i in coder.encode(texts)] == [e.ids for e in plain]
    assert max(map(len, coder.ids)) <= coder.LONGEST


def test_secrets_of_many_repositories_are_examples(spark):
    value = "Ab1" * 9
    docs = spark.createDataFrame([(i, f"x {value} y", "one") for i in range(4)] + [(9, f"z {'Cd2' * 9}", "one")], "doc_id long, text string, source string")
    few = {r.doc_id: (r.n_live, r.n_example, len(r.spans)) for r in secret_scan.secrets(docs).collect()}
    assert few == {**dict.fromkeys(range(4), (1, 0, 1)), 9: (1, 0, 1)}
    many = {r.doc_id: (r.n_live, r.n_example, len(r.spans)) for r in secret_scan.secrets(docs, example_repositories=4).collect()}
    assert many[9] == (1, 0, 1)
    assert all(many[i][0] == 0 and many[i][2] == 0 for i in range(4))
