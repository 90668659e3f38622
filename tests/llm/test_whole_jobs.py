"""Operators do the whole job: nothing cut, capped or left out."""

import hashlib
import re
import time

import numpy as np
import pytest

from pyspark.sql import functions as F

from quern.llm import fingerprints, licenses, mixing, ngram_join, pii, queries, sharding


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: [(s.kind, r.text[s.start : s.stop]) for s in r.pii_spans] for r in pii.find_pii(df).collect()}


def test_seeds_of_all_base_kinds_teach_patterns(spark):
    names = ["anna.smith", "bob.jones", "carl.roe", "dora.poe", "emil.low", "fay.moss"]
    cards = ["4111 1111 1111 1111", "5500 0000 0000 0004", "4012 8888 8888 1881", "5555 5555 5555 4444"]
    texts = [f"x tel: +49 30 {1234567 + i} y mail: {n}@example.com z" for i, n in enumerate(names)] + [f"x visa: {c} y" for c in cards]
    n = len(texts)
    got = found(spark, [*texts, "x tel: 0301234599 y", "x mail: gus77-internal z", "x visa: zz-411122 z", "no such: 0301234599 y"])
    assert got[n] == [("learned_phone", "0301234599")] and got[n + 1] == [("learned_email", "gus77-internal")]
    assert got[n + 2] == [("learned_card", "zz-411122")] and not got[n + 3]


def test_patterns_without_a_cap(spark):
    n = 10_100
    word = lambda i: "k" + "".join(chr(97 + int(c)) for c in str(i))
    secret = lambda i: hashlib.md5(str(i).encode()).hexdigest()
    texts = [" ".join([*(f"{word(i)}: {secret(10 * i + j)}" for j in range(3)), f"{word(i)}: zq-77{i:06d}-x"]) for i in range(n)]
    got = found(spark, texts)
    missed = [i for i in range(n) if ("learned_secret", f"zq-77{i:06d}-x") not in got[i]]
    assert not missed


def linked(spark, marks, **options):
    frame = spark.createDataFrame([(i, bytes(m).hex()) for i, m in enumerate(marks)], "doc_id long, fingerprint string")
    return {(r.doc_id, r.like_id) for r in fingerprints.near_pairs(frame, **options).collect()}


def changed(mark, places):
    return [x ^ 1 if i in places else x for i, x in enumerate(mark)]


def test_chains_of_fingerprints(spark, monkeypatch):
    base = list(np.random.default_rng(1).integers(0, 256, 128))
    # Neighbours are alike in 118 of 128 places, others less; all share the first two bands only.
    step = lambda k: set(range(16 + 10 * k, 26 + 10 * k))
    chain = [base]
    for k in range(9):
        chain.append(changed(chain[-1], step(k)))
    # Of 0, 1 and 2 the middle one comes last.
    assert linked(spark, [chain[0], chain[2], chain[1]]) == {(2, 0), (2, 1)}
    want = {(i + 1, i) for i in range(9)}
    assert linked(spark, chain) == want
    monkeypatch.setattr(fingerprints, "BLOCK", 2)
    assert linked(spark, chain) == want


def test_one_character_edit_is_found(spark):
    rng = np.random.default_rng(0)
    base = ["".join(map(chr, rng.integers(97, 123, 3000))) for _ in range(6)]
    texts = [*base, base[0][:1500] + "X" + base[0][1500:], base[1], base[2][:2980]]
    walk = fingerprints.Embedding()
    assert linked(spark, [walk.fingerprint(t) for t in texts], like=0.5) == {(6, 0), (7, 1), (8, 2)}


def test_op3_gives_groups(spark, sf):
    rows = {r.doc_id: r for r in queries.op3_edit_embedding(spark, sf).collect()}
    assert all(r.near_id <= i for i, r in rows.items()) and any(r.near_id < i for i, r in rows.items())
    same = {}
    for i, r in sorted(rows.items()):
        assert r.near_id == rows[same.setdefault(r.fingerprint, i)].near_id


def all_pairs(texts):
    """The least place that links lead to, of each text, by comparing all pairs; None of texts without words."""

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
    return of


def family(rng, n, words=60, rate=0.03, at=0):
    """Near copies of one text, some nearer than others."""
    base = [f"w{at}x{i}" for i in range(words)]
    return [" ".join(w if rng.random() > rate * rng.random() * 2 else f"n{rng.integers(10**6)}" for w in base) for _ in range(n)]


@pytest.mark.parametrize("part", [4, 1024])
def test_families_in_parts_keep_every_link(spark, monkeypatch, part):
    rng = np.random.default_rng(11)
    texts = [*family(rng, 60), *family(rng, 30, 25, 0.02, 1), *family(rng, 20, 200, 0.06, 2), *family(rng, 12, 40, 0.1, 3)]
    common = " ".join(f"c{i}" for i in range(12))
    texts += [common + " " + " ".join(f"q{k}y{i}" for i in range(k % 7)) for k in range(40)]
    order = rng.permutation(len(texts))
    texts = [texts[i] for i in order]
    monkeypatch.setattr(ngram_join, "PART_SETS", part)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(df).collect()}
    assert [got[i] for i in range(len(texts))] == all_pairs(texts)


def test_repeated_numbers_keep_their_links(spark):
    x, y = (" ".join(f"{c}{i}" for i in range(40)) for c in "xy")
    rows = [(3, x), (3, y), (7, y + " tail"), (9, x + " end"), (None, x), (None, "only here and nowhere else at all")]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, ((r.doc_id, r.component_id) for r in got))) == sorted(map(str, [(3, 3), (3, 3), (7, 3), (9, 3), (None, 3), (None, None)]))


def test_one_row_of_each_component_stays(spark):
    x, y = (" ".join(f"{c}{i}" for i in range(40)) for c in "xy")
    rows = [(1, x, "a"), (1, x, "a"), (2, x + " end", "b"), (None, y, "c"), (None, y, "c"), (5, None, "d"), (6, "", "e"), (6, " ", "e")]
    got = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, gone_id string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, x, "a"), (None, y, "c"), (5, None, "d"), (6, "", "e"), (6, " ", "e")]))


def test_accepted_tokens_teach_further_patterns(spark):
    secret = lambda i: hashlib.md5(str(i).encode()).hexdigest()
    token = lambda i: f"zq-77{i:04d}-x"
    first = [f"a key: {secret(i)} b" for i in range(30)] + [f"a key: {token(i)} b" for i in range(4)]
    second = [f"c ref# {token(i)} d" for i in range(4)]
    third = ["c ref# uu-88123-y d", "e uu-88123-y f", "g no: 77-ab-12 h"]
    got = found(spark, first + second + third)
    n = len(first + second)
    assert got[n] == [("learned_secret", "uu-88123-y")] and not got[n + 1] and not got[n + 2]


def redacted_plainly(text, spans):
    out, at = [], 0
    for start, stop, kind in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, stop)
    return "".join(out) + text[at:]


def test_redaction_of_many_and_overlapping_spans(spark):
    rng = np.random.default_rng(3)
    parts = ["+49 (30) 1234-5678", "10.0.0.1", "4111-1111 1111 1111", "a@b.c", "é", " ", "w ", "+1 10.0.0.1 22", "key: zq-771-x ", "1.2.3.4.5.6.7.8"]
    texts = ["".join(parts[i] for i in rng.integers(0, len(parts), n)) for n in [1, 3, 10, 40, 400, 3000] * 4]
    df = spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id long, text string")
    rows = pii.find_pii(df, {"key: ": "secret"}).cache()
    spans = {r.doc_id: [(s.start, s.stop, s.kind) for s in r.pii_spans] for r in rows.collect()}
    for r in pii.redact(rows).collect():
        assert r.text == (redacted_plainly(texts[r.doc_id], spans[r.doc_id]) if r.doc_id < 99 else None)


def test_time_grows_with_the_matches(spark):
    texts = ["x@y.zz " * 100_000, "1." * 400_000, "+1 555 123 4567 key: ab1234567 10.0.0.1; " * 10_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    start = time.time()
    sizes = {r.doc_id: r.n for r in pii.redact(pii.find_pii(df)).selectExpr("doc_id", "length(text) as n").collect()}
    assert sizes[0] == 800_000 and time.time() - start < 120


def test_templates_of_alternatives_alone(spark):
    t = licenses.Template("free", "<<any:public domain|unlicense>>")
    for templates in ((t,), (*licenses.BASE, t)):
        df = spark.createDataFrame([(1, "released to the public domain now"), (2, "The Unlicense."), (3, "domain public")], "doc_id long, text string")
        got = {r.doc_id: [(s.label, s.start, s.stop) for s in r.license_spans] for r in licenses.scan_licenses(df, templates=templates).collect()}
        assert got == {1: [("free", 3, 5)], 2: [("free", 1, 2)], 3: []}


def expression(wording):
    """A template as a regular expression over words joined by blanks, a blank before each word."""
    out = []
    for i, part in enumerate(re.split(r"<<(optional|/optional|words:\d+-\d+|any:[^<>]+)>>", wording)):
        plain = lambda s: "".join(" " + w.decode() for w in licenses.words_of(s))
        if i % 2 == 0:
            out.append(re.escape(plain(part)))
        elif part == "optional":
            out.append("(?:")
        elif part == "/optional":
            out.append(")?")
        elif part.startswith("words:"):
            out.append(r"(?: [^ ]+){%s,%s}" % tuple(part[6:].split("-")))
        else:
            out.append("(?:" + "|".join(re.escape(plain(x)) for x in part[4:].split("|")) + ")")
    return re.compile("".join(out) + r"(?= |$)")


def test_labels_and_scores_against_expressions(spark, sf, tmp_path):
    rng = np.random.default_rng(9)
    words = sorted({w for t in licenses.TEMPLATES for w in re.findall(r"[a-z0-9.]+", re.sub(r"<<(?!any)[^>]*>>|<<any:|>>|\|", " ", t.wording))})
    texts = []
    for t in licenses.TEMPLATES * 6:
        text = re.sub(r"<<any:([^<>]+)>>", lambda m: m[1].split("|")[rng.integers(m[1].count("|") + 1)], t.wording)
        text = re.sub(r"<<optional>>(.*?)<</optional>>", lambda m: m[1] if rng.random() < 0.5 else "", text)
        text = re.sub(r"<<words:(\d+)-(\d+)>>", lambda m: " any" * int(rng.integers(int(m[1]), int(m[2]) + 1)), text).split()
        if rng.random() < 0.3:
            text[rng.integers(len(text))] = str(rng.choice(words))
        texts.append("It is: " + ", ".join(text).title() + " - so")
    docs = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs = docs.unionByName(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    mandatory = dict(zip([t.label for t in licenses.TEMPLATES], licenses.Automaton(licenses.TEMPLATES).mandatory))
    rows = {r.doc_id: r.text for r in docs.collect()}
    labels = set()
    for r in queries.op1_license_templates(spark, str(tmp_path)).collect():
        joined = "".join(" " + w.decode() for w in licenses.words_of(rows[r.doc_id] or ""))
        want = {t.label for t in licenses.TEMPLATES if expression(t.wording).search(joined)}
        most = max((mandatory[x] for x in want), default=0)
        assert (r.labels, r.score) == (",".join(sorted(want)), most / (most + 2))
        labels |= want
    assert labels == set(mandatory)


def test_shards_of_equal_rows_and_written_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "GROUP_BLOCKS", 3)
    rows = spark.range(500).select((F.col("id") % 3).alias("doc_id")).unionByName(spark.createDataFrame([(None,)] * 300, "doc_id long"))
    got = sharding.shard_rows(rows, ["doc_id"], 7, block_rows=20)
    again = sharding.shard_rows(rows.repartition(3), ["doc_id"], 7, block_rows=20)
    assert sorted(map(str, got.collect())) == sorted(map(str, again.collect()))
    slots = {}
    for r in got.collect():
        slots.setdefault(r.shard, []).append(r.slot)
    assert sorted(map(len, slots.values())) == [114, 114, 114, 114, 114, 115, 115] and all(sorted(s) == list(range(len(s))) for s in slots.values())
    sharding.write_shards(got, f"{tmp_path}/shards", 9)
    read = spark.read.parquet(f"{tmp_path}/shards")
    assert sorted(map(str, read.select("doc_id", "shard", "slot").collect())) == sorted(map(str, got.collect()))
    files = read.groupBy(F.input_file_name().alias("f"), "shard").agg(F.count(F.lit(1)).alias("n"), F.min("slot").alias("a"), F.max("slot").alias("b")).collect()
    assert len(files) > 7 and all(r.b - r.a + 1 == r.n for r in files)
    sharding.write_shards(got.where("false"), f"{tmp_path}/none")


def test_equal_steps_of_position_hold_equal_words(spark):
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 4).cast("string")).alias("source"), F.lit(100).alias("size"), F.lit("x").alias("position"), F.lit(1).alias("taken"))
    mixed = mixing.training_rows(mixing.mix_curriculum(docs))
    at = np.array([r.position for r in mixed.collect()])
    assert mixed.columns == ["doc_id", "source", "size", "position"]
    assert abs(np.histogram(at, 10, (0, 1))[0] / len(at) - 0.1).max() < 0.005


def test_quoted_passages_come_last(spark):
    """Shingles of a passage of a few texts leave their prefixes, so that they make no lists of them."""
    own = lambda k: [f"w{k}x{i}" for i in range(60)]
    passage = [f"q{i}" for i in range(14)]
    texts = [" ".join(own(k) + (passage if k % 30 == 0 else [])) for k in range(200)]
    hot = ngram_join.hot_shingles(spark.createDataFrame([(t,) for t in texts], "text string"), "text")
    quoted = set(ngram_join.shingles(" ".join(passage)).tolist())
    shared = lambda hot: sum(len(set(ngram_join.prefix(ngram_join.shingles(t), hot)[0].tolist()) & quoted) for t in texts)
    assert shared(hot) * 2 < shared(hot[:0])


def test_frequent_keys_are_counted_without_the_others(spark):
    """Rows beside the frequent keys aren't expanded, and their counts are whole."""
    keys = [[k * 10 + i for i in range(5)] + [-7] * (k % 2) for k in range(4000)]
    sets = spark.createDataFrame([(k,) for k in keys], "keys array<long>").cache()
    assert [tuple(r) for r in ngram_join._wide(sets).collect()] == [(-7, 2000)]
    among = ngram_join._keys_among(sets, np.array([-7, 10, 39_994]))
    assert sorted(r.key for r in among.collect()) == [-7] * 2000 + [10, 39_994]
    assert not ngram_join._keys_among(sets, np.zeros(0, np.int64)).take(1)
