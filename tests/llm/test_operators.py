"""Each operator against a plain version, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quern.llm import ann, bpe, fingerprints, licenses, mixing, ngram_join, pii, quality, queries, sharding, toxicity
from tests.compare import assert_same, database

LONG = "Long words repeat. " * 3000
TEXTS = [
    None, "", " \t\n", "one", "one two three", "Released under the MIT License.", "a b c d e f g h", "A b c d e f g h",
    LONG, "x@y.example, 10.0.0.1, 4111 1111 1111 1111 and +1 (555) 123-4567", "ÄÖ ß é 日本語 emoji 😀 end", "a b c d e f g h i",
    'token = "0123456789abcdef0123456789abcdef"', "tie tie tie", "tie tie tie", "|" * 50, "GNU General Public License, version 3",
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, each with extra columns named like outputs; some numbers are null or repeated."""
    ids = [*range(len(TEXTS)), None, 3]
    texts = [*TEXTS, "no number", "one"]
    rows = [(i, t, ("a", "b", None)[k % 3], k, "x") for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score int, SHARD string")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def empty(df):
    return df.where("false")


def folder_of(spark, tmp_path_factory, **tables):
    path = str(tmp_path_factory.mktemp("tables"))
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.fixture(scope="module")
def odd_folder(spark, odd, tmp_path_factory):
    labels = spark.createDataFrame([(i, i % 2, (i // 2) % 2) for i in range(12)] + [(None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    vectors = spark.createDataFrame(
        [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (50, [1.0, 1.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [1.0]), (None, [1.0, 2.0])],
        "vec_id long, embedding array<float>",
    )
    return folder_of(spark, tmp_path_factory, documents=odd, labels=labels, embeddings=vectors)


@pytest.fixture(scope="module")
def empty_folder(spark, odd, tmp_path_factory):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    return folder_of(spark, tmp_path_factory, documents=empty(odd), labels=labels, embeddings=spark.createDataFrame([], "vec_id long, embedding array<float>"))


@pytest.mark.parametrize("name", [n for n in queries.queries() if n != "op6_projection_forest"])
def test_odd_and_empty_tables(spark, odd_folder, empty_folder, name):
    query = queries.queries()[name]
    assert query(spark, odd_folder).count() == len(TEXTS) + 2
    assert query(spark, empty_folder).count() == 0


def test_pipeline_on_odd_and_empty_tables(spark, odd_folder, empty_folder):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, empty_folder).count() == 0
    assert corpus_pipeline.run(spark, odd_folder).columns[0] == "doc_id"


def test_curriculum_against_sql(spark, sf, odd_folder):
    assert_same(database(sf), queries.op9_curriculum_mix(spark, sf), queries.OP9_SQL)
    rows = queries.op9_curriculum_mix(spark, odd_folder).collect()
    assert all(r.taken <= 3 * r.size for r in rows) and sum(r.taken for r in rows) > 0


def test_demand_is_inverted(spark):
    for shape in mixing.SCHEDULES:
        segments = mixing._segments([shape])[0]
        times = spark.range(11).select(mixing.invert_demand(segments, F.col("id") / 10).alias("t")).collect()
        at = [r.t for r in times]
        knots, weights = zip(*shape)
        fine = np.linspace(0, 1, 20001)
        share = np.cumsum(np.interp(fine, knots, weights)) / np.interp(fine, knots, weights).sum()
        assert at == sorted(at) and np.allclose(np.interp(at, fine, share), np.arange(11) / 10, atol=1e-3)


def test_positions_are_sorted_and_whole(spark, docs):
    sized = docs.withColumn("size", mixing.word_count(F.col("text")))
    rows = mixing.training_rows(mixing.mix_curriculum(sized), 4).collect()
    assert [r.position for r in rows] == sorted(r.position for r in rows)
    assert {r.text for r in rows} <= {r.text for r in docs.collect()}


def test_shards(spark, docs):
    by = ["doc_id", "text"]
    got = sharding.shard_rows(docs, by, 7, block_rows=23).select("doc_id", "shard", "slot").collect()
    again = sharding.shard_rows(docs.repartition(5), by, 7, block_rows=23).select("doc_id", "shard", "slot").collect()
    assert sorted(got) == sorted(again)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_communication_matrix():
    blocks, room = [50, 0, 30, 41], sharding.capacities(121, 6)
    sums = np.zeros((4, 6))
    for seed in range(300):
        m = sharding.communication_matrix(blocks, room, seed)
        assert m.sum(axis=1).tolist() == blocks and m.sum(axis=0).tolist() == room
        sums += m
    assert np.allclose(sums / 300, np.outer(blocks, room) / 121, atol=0.8)
    rng = np.random.default_rng(0)
    draws = [sharding.hypergeometric(rng, 3 * 10**9, 7 * 10**9, 1000) for _ in range(300)]
    assert abs(np.mean(draws) - 300) < 4 and 9 < np.std(draws) < 20


def test_bpe_round_trip_and_ids(spark, odd, docs):
    path = public_tokenizers.path(queries.RANKS)
    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    for table in (odd, docs):
        for r in bpe.encode(table, path, public_tokenizers.PATTERN, decoded="decoded", keep_text=True).collect():
            text = r.text or ""
            assert bytes(r.decoded) == text.encode()
            assert list(r.ids) == other.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a" * 70_000, " " * 9000, "x" + " \n" * 9000 + "y", ("word  " * 9000) + "\t" * 5000 + "z", "ab1" * 20_000 + " é" * 20_000])
def test_long_texts_are_split_safely(text):
    codec = bpe.Codec(public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN)
    assert codec.encode(text).tolist() == codec._encoding.encode_ordinary(text)
    assert "".join(p for _, p in bpe.pieces(text)) == text
    assert codec.decode(codec.encode(text).tolist()) == text.encode()


def test_blank_runs_beyond_the_library():
    codec = bpe.Codec(public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN)
    text = "a" + " " * 2_000_000 + "b"
    ids = codec.encode(text).tolist()
    assert codec.decode(ids) == text.encode() and ids[-1] == codec.encode(" b")[0]


def _words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def test_license_places(spark, docs, odd, sf):
    got = {r.doc_id: r for r in queries.op1_license_templates(spark, sf).collect()}
    phrases = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}
    for r in docs.collect():
        w = _words(r.text)
        at = {(i, k) for k, p in phrases.items() for i in range(len(w)) if w[i : i + len(p)] == p}
        g = got[r.doc_id]
        assert (g.n_words, g.n_base) == (len(w), len(at))
        assert g.base_labels == ",".join(sorted({k for _, k in at}))
        assert (g.first_word, g.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert set(filter(None, g.base_labels.split(","))) <= set(g.labels.split(","))


def test_templates_need_their_exact_wording():
    t = (licenses.Template("t", "start <<optional>>maybe this<</optional>> <<words:1-2>> then <<any:one|two three>> end"),)
    a = licenses.Automaton(t)
    found = lambda s: [(x, y) for _, x, y in a.matches(licenses.words_of(s))]
    assert found("so start maybe this X then two three end.") == [(1, 9)]
    assert found("start X Y then one end") == [(0, 6)]
    assert not found("start maybe X Y then one end") and not found("start X then two end") and not found("start then one end")


def test_fingerprints(spark, docs, odd, sf):
    rows = {r.doc_id: r for r in queries.op3_edit_embedding(spark, sf).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    order, walk = sorted(texts), fingerprints.Embedding()
    for i, n in zip(order, [*order[1:], order[0]]):
        text, after, cut = texts[i], texts[n], len(texts[i]) // 4
        edited = text[: len(text) - cut] + after[:cut]
        assert rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert rows[i].fingerprint == walk.fingerprint(text).hex() and rows[i].edited_fingerprint == walk.fingerprint(edited).hex()
    near, far = np.mean([r.near_edited for r in rows.values()]), np.mean([r.near_next for r in rows.values()])
    assert near > 0.7 and far < 0.3
    small = fingerprints.compare_with_next(docs, range_rows=17).collect()
    assert sorted(small) == sorted(rows.values())


def test_near_pairs_of_fingerprints(spark):
    rng = np.random.default_rng(0)
    base = ["".join(map(chr, rng.integers(97, 123, 3000))) for _ in range(6)]
    texts = [*base, base[0][:1500] + "X" + base[0][1500:], base[1], base[2][:2980]]
    walk = fingerprints.Embedding()
    marks = spark.createDataFrame([(i, walk.fingerprint(t).hex()) for i, t in enumerate(texts)] + [(None, "00"), (99, None)], "doc_id long, fingerprint string")
    pairs = {(r.doc_id, r.like_id) for r in fingerprints.near_pairs(marks, like=0.5).collect()}
    assert pairs >= {(7, 1), (8, 2)} and pairs <= {(6, 0), (7, 1), (8, 2)}


def test_jaccard_against_all_pairs(spark, sf):
    rng = np.random.default_rng(4)
    docs = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    more = []
    for t in docs[:30]:
        for rate in (0.01, 0.03, 0.05, 0.08):
            w = t.split()[:400]
            more.append(" ".join(x if rng.random() > rate else f"w{rng.integers(10**6)}" for x in w))
    texts = [*TEXTS, *docs, *more, *more[:10]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df).collect()}

    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = [shingles(t) for t in texts]
    of = list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = of[i], of[j]
                of = [min(a, b) if x in (a, b) else x for x in of]
    assert got == {i: (len(s), of[i]) for i, s in enumerate(sets)}


def test_prefixes_keep_every_link():
    rng = np.random.default_rng(5)
    hot = np.sort(rng.integers(0, 4000, 100).astype(np.uint64))
    for _ in range(400):
        n = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 4000, n).astype(np.uint64))
        b = np.unique(np.concatenate([rng.choice(a, max(1, int(len(a) * 0.85)), replace=False), rng.integers(0, 4000, n // 8).astype(np.uint64)]))
        a, b = sorted((a, b), key=len)
        if 4 * len(np.intersect1d(a, b)) >= 3 * len(np.union1d(a, b)):
            (p, small), (q, _) = ngram_join.prefix(a, np.unique(hot)), ngram_join.prefix(b, np.unique(hot))
            assert np.isin(p[:small], q).any()
            assert ngram_join.most_overlap(len(a), ngram_join.bitmap(a), len(b), ngram_join.bitmap(b)) >= len(np.intersect1d(a, b))


def test_forest_arrays_and_held_out_quality(spark):
    rng = np.random.default_rng(6)
    x = rng.random((3000, quality.N_STATISTICS))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    forest = quality.grow(x[:2000], y[:2000])
    assert (((forest.score(x[2000:]) >= 0.5) == y[2000:]).mean()) > 0.95

    def walk(row):
        total = forest.base
        for t in range(len(forest.leaf)):
            node = 0
            while node < forest.feature.shape[1]:
                node = 2 * node + 1 + (row[forest.feature[t, node]] > forest.threshold[t, node])
            total += forest.leaf[t, node - forest.feature.shape[1]]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(forest.score(x[:50]), [walk(r) for r in x[:50]])
    rows = queries.op5_boosted_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_held_out_toxicity(spark):
    rows = queries.op8_compression_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").collect()
    toxic = [r.predicted for r in rows if r.toxic == 1]
    clean = [r.predicted for r in rows if r.toxic == 0]
    assert np.mean(toxic) > 0.6 and np.mean(clean) < 0.03


def test_nearest_recall(spark, sf, odd_folder, empty_folder):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = vectors.collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    got = collections.defaultdict(list)
    for r in ann.nearest(vectors, F.col("vec_id") % 50 == 0, search_rows=1500, search_share=0.1).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits = 0
    for q in np.flatnonzero(ids % 50 == 0):
        c = ann.cosine(np.repeat(x[q : q + 1], len(x), 0), x)
        c[q] = -2
        best = np.lexsort((ids, -c))[:5]
        hits += len(set(ids[best]) & {v for v, _ in got[ids[q]]})
        assert all(s == c[list(ids).index(v)] for v, s in got[ids[q]])
        assert [s for _, s in got[ids[q]]] == sorted((s for _, s in got[ids[q]]), reverse=True)
    assert hits >= 0.9 * 5 * len(got)
    odd = queries.op6_projection_forest(spark, odd_folder).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in odd] == [(0, 1, 1), (0, 2, 50), (50, 1, 0), (50, 2, 1)]
    assert queries.op6_projection_forest(spark, empty_folder).count() == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _fits(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        double = [int(c) * 2 - 9 * (int(c) > 4) if i % 2 else int(c) for i, c in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(double) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def test_personal_data(spark, docs):
    rng = np.random.default_rng(7)
    parts = ["a@b.c", "d@", ".", "%x", "1.2.3.4", "999.1.1.1", "01.002.3.4.5", "4111-1111 1111 1111", "411111111111111", "+1 2", "+49 (30) 1234-5678", "+", " ", "é", "@", "_", "a@b.c%d@e.f", "1" * 30, "\n", "+1+2345678901"]
    texts = ["".join(parts[i] for i in rng.integers(0, len(parts), rng.integers(1, 12))) for _ in range(300)] + TEXTS
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(docs.select((F.col("doc_id") + 10000).alias("doc_id"), "text"))
    for r in pii.find_pii(df).collect():
        text = r.text or ""
        want = [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if _fits(k, m[0])]
        assert [(s.kind, s.start, s.stop) for s in r.pii_spans if s.base] == want
        further = [s for s in r.pii_spans if not s.base]
        assert all(s.stop <= b or e <= s.start for s in further for _, b, e in want)


def test_patterns_discover_unseen_identifiers(spark):
    rows = [f'say key: "{hashlib.md5(str(i).encode()).hexdigest()}" end {i}.0' for i in range(20)]
    unseen = ['say key: "zq-77123-xy" end', "some zq-77123-yy else", "plain words only"]
    df = spark.createDataFrame(list(enumerate(rows + unseen)), "doc_id long, text string")
    assert pii.learn_patterns(df) == {'key: "': "secret"}
    spans = {r.doc_id: [(s.kind, r.text[s.start : s.stop]) for s in r.pii_spans] for r in pii.find_pii(df).collect()}
    assert spans[20] == [("learned_secret", "zq-77123-xy")] and not spans[21] and not spans[22]
    redacted = {r.doc_id: r.text for r in pii.redact(pii.find_pii(df)).collect()}
    assert redacted[20] == 'say key: "[LEARNED_SECRET]" end' and redacted[22] == "plain words only"


def test_pipeline_stages(spark, tmp_path_factory, sf):
    """Each stage against a plain version of its decision on the same input."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality"](spark, docs, sf)
    forest = quality.fit_quality(docs, spark.read.parquet(f"{sf}/labels.parquet").where(~queries.held_out(4, 2)))
    want = {r.doc_id for r in docs.collect() if forest.score(quality.statistics(r.text)[None])[0] >= 0.7}
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == docs.columns
    single = stages["near_duplicates"](spark, kept, sf)
    found = ngram_join.jaccard_components(kept).collect()
    assert {r.doc_id for r in single.collect()} == {r.doc_id for r in found if r.doc_id == r.component_id}
    clean = stages["personal_data"](spark, single, sf)
    assert all(r.n_chars == len(r.text) for r in clean.collect()) and clean.count() == single.count()
    assert not [s for r in pii.find_pii(clean).collect() for s in r.pii_spans if s.base]
    mixed = stages["mixture"](spark, clean, sf)
    assert mixed.columns == docs.columns and {r.text for r in mixed.collect()} <= {r.text for r in clean.collect()}
    assert stages["tokens"](spark, mixed, sf).count() == mixed.count()


def test_odd_rows_by_operator(odd):
    assert quality.with_statistics(odd).where("statistics[0] is null").isEmpty()
    scored = quality.score_quality(odd, quality.grow(np.zeros((0, quality.N_STATISTICS)), np.zeros(0)))
    assert {r.score for r in scored.collect()} == {0.5}
    same = toxicity.score_toxicity(odd, toxicity.fit_texts([], []))
    assert {r.score for r in same.collect()} == {0.5} and "SHARD" in same.columns
    assert "shard" in sharding.shard_rows(odd, ["doc_id", "text"], 3).columns
