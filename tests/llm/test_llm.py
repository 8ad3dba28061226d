"""The training-data operators against brute force, on tables with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quadrille.llm import bytebpe, embedding_dedup, exact_dedup, langid, lm_score, ngram_join, packing, quality, substring_dedup, wavelet
from quadrille.llm import common as C

P = pytest.importorskip("public_tokenizers")
R = random.Random(5)
WORDS = ["alpha", "Beta", "gamma,", "delta.", "été", "x7", "don't", "ζήτα", "omega"]
LONG = " ".join(R.choice(WORDS) + str(R.randint(0, 999)) * (i % 7 == 0) for i in range(14_000))
BASE = " ".join(R.choice(WORDS) + str(i) for i in range(60))
NEAR = BASE + " tail"
ROWS = [(1, BASE), (2, BASE.replace(" ", "\n")), (3, NEAR), (4, None), (5, ""), (6, " \t\n"), (7, "one two"), (8, "one two"), (9, LONG), (10, "12 34 --"), (11, BASE.upper()), (None, "null id text here now"), (12, "twice the same row"), (12, "twice the same row"), (13, "X " + BASE)]
CLASH = ", ".join(f"{c} string" for c in ("bucket", "th", "row", "kind", "part", "place", "digit", "node", "rest", "dedup2"))
UNIQUE = {d: t for d, t in ROWS if d is not None}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, *["z"] * 9, None) for d, t in ROWS], f"doc_id long, text string, {CLASH}").repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], f"doc_id long, text string, {CLASH}")


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


def word_ids(text, end):
    from tokenizers import Tokenizer

    tok = word_ids.__dict__.setdefault("tok", Tokenizer.from_file(P.path("word_bpe_49k.json")))
    return np.array(tok.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def test_wavelet(docs, empty):
    for most in (wavelet.SHARD_IDS, 40):  # the small bound parts a shard into several files
        files = wavelet.write_shards(docs, P.path("word_bpe_49k.json"), 1, most=most)
        assert (files.where("part > 0").count() > 0) == (most == 40)
        for block in (1024, 1):
            starts = sorted((r.shard, r.part, r.before) for r in wavelet.starts_of(files, block).collect())
            sizes = {(r.shard, r.part): r.n_ids for r in files.collect()}
            assert [x[:2] for x in starts] == sorted(sizes) and [x[2] for x in starts] == [sum(n for k, n in sizes.items() if k < (a, b)) for a, b, _ in starts]
        got = sorted(wavelet.read_documents(files).collect(), key=lambda r: r.start)
        assert [r.doc_id for r in got][:1] == [None] and [r.doc_id for r in got][1:] == sorted(d for d, _ in ROWS if d)
        at = 0
        for r in got:
            ids = word_ids(UNIQUE.get(r.doc_id, "null id text here now"), 1)
            assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
            at += len(ids)
    assert wavelet.read_documents(wavelet.write_shards(empty, P.path("word_bpe_49k.json"), 1)).count() == 0


def test_wavelet_queries():
    ids = np.random.default_rng(1).integers(0, 300, 5000).astype(np.uint16)
    w = wavelet.Wavelet(wavelet.build(ids, 9, [1], np.array([5000])))
    assert (w.decode() == ids).all() and [w.access(i) for i in range(0, 5000, 501)] == ids[::501].tolist()
    at = np.flatnonzero(ids == 17)
    assert w.count(17) == len(at) and [w.select(17, k) for k in range(len(at))] == at.tolist() and w.select(17, len(at)) == -1
    assert w.count(17, 100, 900) == ((at >= 100) & (at < 900)).sum() and w.count(1 << 12) == 0


def test_exact_dedup(docs, empty):
    norm = lambda t: (t or "").encode().translate(None, C.SPACES)
    for heavy in (exact_dedup.HEAVY, 300):  # the small bound deals every digit anew
        got = exact_dedup.classes(docs, heavy).collect()
        groups: dict = {}
        for d, t in ROWS:
            groups.setdefault(norm(t), []).append((d, t or ""))
        assert len(got) == len(ROWS) and sum(r.kept for r in got) == len(groups)
        for r in got:
            own = groups[norm(UNIQUE.get(r.doc_id, "null id text here now"))]
            best = min(own, key=lambda x: (-len(x[1]), x[0] if x[0] is not None else 1 << 63))
            assert (r.keep_id, r.group_size) == (best[0], len(own))
            assert r.text_sha256 == hashlib.sha256(norm(own[0][1])).hexdigest()
        stay = sorted((r.doc_id is None, r.doc_id or 0) for r in exact_dedup.survivors(docs, heavy).collect())
        assert stay == sorted((r.doc_id is None, r.doc_id or 0) for r in got if r.kept)
    assert exact_dedup.classes(empty).count() == exact_dedup.survivors(empty).count() == 0


def test_byte_bpe(docs, empty, monkeypatch):
    coder = bytebpe.ByteBPE(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    got = by_id(bytebpe.encode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN))
    for d, t in UNIQUE.items():
        ids = np.array(coder.core.encode_ordinary(t or ""), "<u4")
        for r in got[d]:
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert bytebpe.encode(empty, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
    monkeypatch.setattr(bytebpe, "CHUNK", 40)
    for _ in range(300):
        s = "".join(R.choice(["a", "b'll", " ", "   ", "\n", "'s", "12", "é", "...", "'re", "e", "x" * 30, " " * 20]) for _ in range(60))
        k = range(max(1, -(-(len(s) - 10) // 40)))
        chunks = [(i * 40, i * 40 + bytebpe.boundaries(coder, s[i * 40 : i * 40 + 50], i * 40 + 50 >= len(s))) for i in k]
        assert bytebpe.stitch(coder, s, chunks) == coder.find(s)


def test_substring_dedup(docs, empty):
    got = by_id(substring_dedup.remove_repeats(docs))
    want = substring_dedup.removed_by_definition(UNIQUE)
    for d in UNIQUE:
        for r in got[d]:
            assert (r.dedup.n_words, r.dedup.n_removed, hashlib.sha256(r.dedup.kept_words.encode()).hexdigest()) == want[d]
            assert r.kind == "z" and r.dedup.kept.split() == r.dedup.kept_words.split() if r.text else True
    assert substring_dedup.remove_repeats(empty).count() == 0
    for more in (1, 4):  # bytes of the second hash that larger tables need
        wide = by_id(substring_dedup.remove_repeats(docs, more=more))
        assert {d: [r.dedup for r in x] for d, x in wide.items()} == {d: [r.dedup for r in x] for d, x in got.items()}


def test_second_hash_follows_the_size():
    assert [substring_dedup.second_bytes(size, max(64, size // (8 << 20) + 1)) for size in (0, 1 << 29, 30 << 30, 100 << 40)] == [0, 0, 1, 4]
    h, g = np.array([5, 7, 5, 5], np.uint64), np.array([1, 1, 2, 1], np.uint64)
    assert [substring_dedup._sorted(h, x)[1].sum() for x in (None, g)] == [2, 1]  # equal by the first hash alone is not equal


def test_ngram_join(docs, empty):
    for k, percent in ((4, 85), (5, 80)):
        got = by_id(ngram_join.near_duplicates(docs, k, percent))
        want = ngram_join.components_by_definition(UNIQUE, k, percent)
        assert {d: {(r.n_shingles, r.component_id) for r in got[d]} for d in UNIQUE} == {d: {x} for d, x in want.items()}
        assert got[None][0].component_id is None
    assert ngram_join.near_duplicates(empty).count() == 0


def test_ngram_join_however_links_are_found(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").repartition(3)
    texts = {r.doc_id: r.text for r in d.collect()}
    base = " ".join(f"w{i}" for i in range(300)).split()
    for k in range(60):  # a family that shares its least shingle, of which only neighbours link
        texts[10_000 + k] = " ".join(base[2 * k : 2 * k + 40] + ["w0 w1 w2 w3 w4"])
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    want = ngram_join.components_by_definition(texts)
    for how in ({}, {"stars": 0}, {"salted": 1, "few": 0}):
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(d, **how).collect()} == want


def test_packing(docs, empty):
    got = packing.pack(docs, P.path("word_bpe_49k.json"), 2).collect()
    seqs: dict = {}
    for r in got:
        ids = word_ids(UNIQUE.get(r.doc_id, "null id text here now"), 2)
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in seqs.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert sum(r.length for r in got) == sum(len(word_ids(t, 2)) for _, t in ROWS)
    assert packing.pack(empty, P.path("word_bpe_49k.json"), 2).count() == 0
    sizes = [R.randint(1, 512) for _ in range(700)]
    groups = packing.balanced(sizes, 4096)
    assert sorted(i for g in groups for i in g) == list(range(700)) and max(sum(sizes[i] for i in g) for g in groups) <= 4096
    assert len(groups) <= -(-sum(sizes) // 4096) + 1


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((60, 16)).astype(np.float32)
    x[30:50] = x[:20] + 0.15 * rng.standard_normal((20, 16)).astype(np.float32)
    x[50:55] = x[0]
    rows = [(i, [float(v) for v in e], "z") for i, e in enumerate(x)] + [(100, None, "z"), (101, [], "z"), (102, [0.0] * 16, "z"), (103, [None, 1.0], "z"), (104, [float("nan")] * 16, "z"), (105, [1.0, 2.0], "z"), (None, [1.0, 2.0], "z")]
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, leaf string")).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    union = ngram_join.Union(60)
    for i, j in zip(*np.nonzero(near)):
        union.join(int(i), int(j))
    for i in range(60):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (near[i].sum() - 1, union.find(i), union.find(i) == i)
    assert all((got[i].n_links, got[i].component_id) == (0, i) for i in range(100, 106)) and got[None].component_id is None
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def planted_pairs(rng, n, pairs, wide=64, cosine=0.905):
    """n unit vectors, the last `pairs` of them at that cosine to the first."""
    x = rng.standard_normal((n, wide))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((pairs, wide))
    y -= (y * x[:pairs]).sum(1, keepdims=True) * x[:pairs]
    x[n - pairs :] = cosine * x[:pairs] + np.sqrt(1 - cosine**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    return x


def test_embeddings_with_splits(spark):
    assert embedding_dedup.trees_for(60, 640) == 10 <= embedding_dedup.trees_for(50_000, 256) < embedding_dedup.trees_for(1_000_000, 256)
    x = planted_pairs(np.random.default_rng(8), 2400, 1200)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    assert (x @ x.T >= 0.9).sum() == 4800
    for more in ({}, {"sample": 100}):  # the small sample makes leaves that are split again
        got = embedding_dedup.near_vectors(rows, leaf=8, **more).toPandas().sort_values("vec_id")
        links, component = got.n_links.to_numpy(), got.component_id.to_numpy()
        assert links.max() == 1 and links.sum() >= 0.997 * 2400
        assert (component == np.where(links == 1, np.arange(2400) % 1200, np.arange(2400))).all()


def test_embeddings_of_a_dense_cluster(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((1500, 32))
    x[:900] = x[0] + 0.3 * rng.standard_normal((900, 32))  # different vectors, most pairs of which link
    x[900:1000] = x[:100]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    near = u @ u.T >= 0.9
    assert near[:900, :900].mean() > 0.6
    for wide in (100, 10_000):  # in pairs of groups, and in one task
        got = embedding_dedup.near_vectors(rows, leaf=32, sample=700, wide=wide).toPandas().sort_values("vec_id")
        assert (got.n_links <= near.sum(1) - 1).all() and got.n_links.sum() >= 0.99 * (near.sum() - 1500)


def test_embeddings_of_repeated_ids(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [1.0, 0.01, 0.0]), (3, [0.0, 1.0, 0.01]), (4, [0.0, 0.0, 1.0]), (4, [0.0, 0.0, 1.0])]
    got = sorted(tuple(r) for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 1, 4, True), (4, 1, 4, True)]


def test_quality(spark, docs, empty):
    texts = [(i, " ".join(R.choice(["good", "fine", "well"] if i % 2 else ["bad", "poor", "junk"]) for _ in range(9))) for i in range(200)]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(150)] + [(None, 1), (3, None), (9999, 0)], "doc_id long, quality int")
    model = quality.train(d, labels)
    got = {r.doc_id: r.score for r in quality.score(d, model).collect()}
    assert np.mean([(got[i] >= 0.5) == i % 2 for i in range(150, 200)]) > 0.95
    scores = [r.score for r in quality.score(docs, model).collect()]
    assert len(scores) == len(ROWS) and all(0 <= s <= 1 for s in scores)
    assert quality.score(empty, quality.train(empty, labels)).count() == 0


def test_quality_descent_reaches_the_margin():
    flat, at, y = np.array([0, 1, 0, 2], np.int32), np.array([0, 2, 4]), np.array([1.0, -1.0])
    w = quality.descend(flat, at, y, np.ones(1 << quality.BITS), cost=100.0, epochs=200)
    m = quality.margins(flat, at, w, np.ones(1 << quality.BITS))
    assert m[0] == pytest.approx(1, abs=1e-3) and m[1] == pytest.approx(-1, abs=1e-3)


def test_langid_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in langid.new_network(3, rng).items()}
    x, y = rng.integers(97, 123, (5, 4)).astype(np.uint8), np.array([0, 1, 2, 0])
    _, g = langid.gradients(p, x, y)
    for name in p:
        i = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        e = 1e-3
        p[name][i] += e
        up, _ = langid.gradients(p, x, y)
        p[name][i] -= 2 * e
        down, _ = langid.gradients(p, x, y)
        p[name][i] += e
        assert (up - down) / (2 * e) == pytest.approx(g[name][i], rel=0.05, abs=1e-4)


def test_langid_learns_from_all_of_a_text():
    own = b" " + " ".join(f"w{i:03}" for i in range(400)).encode() + b" "
    got = langid.doc_pieces(own[1:-1].decode())
    assert len(got) == langid.DOC_PIECES and all(len(x) == langid.PIECE for x in got) and got[0] == own[: langid.PIECE] and got[-1] == own[-langid.PIECE :]
    assert b"".join(langid.doc_pieces("A\tb" * 32)) == (b" " + b"a b" * 32 + b" ")[: langid.PIECE] + (b" " + b"a b" * 32 + b" ")[-langid.PIECE :]
    assert langid.doc_pieces("Eis") == [(b" eis " * 64)[: langid.PIECE]] and langid.doc_pieces("") == [b" " * langid.PIECE]


def test_langid_blocks_read_as_the_whole_text():
    """Labels do not follow what other texts stand beside a text, and hardly where its blocks are cut."""
    rng = np.random.default_rng(4)
    kinds = [b"abcdefgh ", b"stuvwxyz "]
    take = lambda k, n: bytes(rng.choice(list(kinds[k]), n).astype(np.uint8)).decode()
    y = np.arange(600) % 2
    p = langid.fit(np.frombuffer("".join(take(k, langid.PIECE) for k in y).encode(), np.uint8).reshape(-1, langid.PIECE), y, 2, steps=120)
    many = [take(i % 2, n) for i, n in enumerate([1, 446, 447, 448, 449, 900, 5000, 20_000])] + ["", None, take(0, 700) + take(1, 2100)]
    got = langid.label_texts(p, pa.array(many, pa.string()))
    assert (got[8:10] == 0).all() and (got[:8].argmax(1) == np.arange(8) % 2).all() and got[10].argmax() == 1
    assert got[10][0] == pytest.approx(0.25, abs=0.02)  # every position counts, where the languages change too
    for text, x in zip(many, got):
        if text:
            assert langid.label_texts(p, pa.array([text]))[0] == pytest.approx(x, abs=1e-5)
            seq = np.frombuffer(f" {text} ".encode(), np.uint8)[:, None]
            assert langid.forward(p, seq)[0].mean(0)[:, 0] == pytest.approx(x, abs=0.01)


def test_langid(spark, docs, empty):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    held = C.crc_mod(d.doc_id, 3) == 1
    langs, network = langid.train(d.where(~held))
    got = langid.identify(d.where(held), langs, network).select("lang", "langid.*").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.98
    out = by_id(langid.identify(docs, langs, network))
    assert all(out[i][0].langid.lang_pred == "und" and out[i][0].langid.score == 0 for i in (4, 5, 6, 10)) and out[9][0].langid.lang_pred in langs and out[1][0].row == "z"
    assert langid.identify(empty, langs, network).count() == 0
    from pyspark.sql import functions as F

    assert langid.train(empty.withColumn("lang", F.lit(None).cast("string")))[0] == []


def lm_by_definition(rows, a, b):
    """The model read literally on exact counts, each quantised as the filter does: doc_id and text -> log10 probability."""
    lower = {c: c + 32 for c in range(65, 91)}
    tokens = lambda t: ["<", *(t or "").translate(lower).encode().split(), ">"]
    counts: Counter = Counter()
    for d, t in rows:
        if d is None or zlib.crc32(str(d).encode()) % 7 != 2:
            w = tokens(t)
            for k in (1, 2, 3):
                counts.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    n = sum(c for k, c in counts.items() if len(k) == 1 and k != ("<",))
    v = sum(len(k) == 1 and k != ("<",) for k in counts)
    docs = counts[("<",)]

    def level_mean(*k):
        c = docs if k in (("<",), (">",)) else counts[k]
        return c if k in (("<",), (">",)) else 1.5 * 2 ** (c.bit_length() - 1) - 0.5 if c else 0

    out = {}
    for d, t in rows:
        w, total = tokens(t), 0.0
        for i in range(1, len(w)):
            p = (level_mean(w[i]) + 1) / (n + v + 1)
            h = level_mean(w[i - 1])
            p = (min(level_mean(*w[i - 1 : i + 1]), h) + a * p) / (h + a)
            if i > 1:
                h = level_mean(*w[i - 2 : i])
                p = (min(level_mean(*w[i - 2 : i + 1]), h) + b * p) / (h + b)
            total += np.log10(p)
        out[d, t] = total
    return out


def test_lm(docs, empty):
    from pyspark.sql import functions as F

    train = C.crc_mod(F.col("doc_id"), 7) != 2
    got = by_id(lm_score.score_documents(docs, train, 400, (50.0, 2.0)))  # so many bits that no absent n-gram seems stored
    want = lm_by_definition(ROWS, 50.0, 2.0)
    tokens = lambda t: (t or "").translate({c: c + 32 for c in range(65, 91)}).encode().split() + [None]
    counts: Counter = Counter()
    for d, t in ROWS:
        if d is None or zlib.crc32(str(d).encode()) % 7 != 2:
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    assert len(sum(got.values(), [])) == len(ROWS)
    for d, t in ROWS:
        w = tokens(t)
        base = sum(np.log10((counts[x] + 1) / (n + v + 1)) for x in w)
        for r in got[d]:
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(counts[x] > 0 for x in w), n)
            assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(want[d, t], rel=1e-9)
    usual = by_id(lm_score.score_documents(docs, train, strengths=(50.0, 2.0)))
    for d, t in ROWS:  # with the bits in use: false positives of the filter move few tokens
        assert all(abs(r.score - want[d, t]) <= 0.02 * r.n_tokens + 2 for r in usual[d])
    assert lm_score.score_documents(empty, train).count() == 0


def test_lm_strengths_are_those_of_the_likeliest(spark):
    from pyspark.sql import functions as F

    rows = [(i, " ".join(f"w{R.randint(0, 9)}" for _ in range(40))) for i in range(60)]  # words tell nothing of their neighbours
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("train", F.lit(True))
    chunks = lm_score.chunks_of(d)
    told = lm_score.answers(chunks, 4, 400)
    assert lm_score.fit_strengths(chunks, told, 4, 60 * 41 + 12, *lm_score.some_chunks(chunks))[1] == 25.0
    same = d.withColumn("text", F.lit("a b c d e f g"))  # and here everything
    chunks = lm_score.chunks_of(same)
    assert lm_score.fit_strengths(chunks, lm_score.answers(chunks, 4, 400), 4, 60 * 8 + 9, *lm_score.some_chunks(chunks)) == (100.0, 0.5)


def test_lm_strengths_follow_every_chunk(spark):
    from pyspark.sql import functions as F

    for heavy in range(5):  # most of the text is in one chunk of twelve, wherever that is
        rows = [(i, heavy, " ".join(f"w{R.randint(0, 9)}" for _ in range(40))) for i in range(60)] + [(100 + p, p, "a b c d e f g") for p in range(12) if p != heavy]
        d = spark.createDataFrame(rows, "doc_id long, part int, text string").repartitionById(12, "part").withColumn("train", F.lit(True))
        chunks = lm_score.chunks_of(d)
        assert chunks.count() == 12
        assert lm_score.fit_strengths(chunks, lm_score.answers(chunks, 4, 400), 4, 60 * 41 + 11 * 8 + 19, *lm_score.some_chunks(chunks))[1] == 25.0


def test_lm_buckets_are_answered_in_little_memory():
    import tracemalloc

    def peak(f):
        tracemalloc.start()
        out = f()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out, most

    n = 1 << 20
    codes, counts = C.mix(np.arange(n, dtype=np.uint64)), np.ones(n, np.int64)
    f, most = peak(lambda: lm_score.CountFilter(codes, counts))
    assert most < 40 * n
    level, most = peak(lambda: f.levels(codes))
    assert most < 20 * n and (level >= 1).all()
    codes.sort()
    own = [a for _ in range(3) for a in (lm_score._put(codes, 0, 1, 64), *lm_score._small(counts))]
    (told, tokens, words), most = peak(lambda: lm_score._told([own, own], 10))  # six million entries
    assert most < 60 * 6 * n and (tokens, words) == (2 * n, n)
    assert all((a[0] == 2).all() and not len(a[1]) and (np.array(a[2:]) >= 2).all() for a in told)


def test_lm_on_held_out_rows(spark):
    x = lm_score.op8_lm_score(spark, "/root/testdata/sf0.01").toPandas()
    held = x[x.held_out]
    assert list(x.columns) == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"] and len(x) == 1000
    assert (x.held_out == [zlib.crc32(str(i).encode()) % 7 == 2 for i in x.doc_id]).all()
    assert held.score.sum() / held.n_tokens.sum() > -3.4 and held.base_score.sum() / held.n_tokens.sum() < -4


def test_lm_codes_keep_what_tells_a_buckets_apart():
    codes = np.unique(np.random.default_rng(3).integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2))
    for n in (1, 7, 64, 3000):
        bucket = C.bucket_of(codes, n)
        for b in set(bucket[:50].tolist()):
            own = codes[bucket == b]
            whole = lm_score._get(lm_score._put(own, b, n, 64))
            assert (whole + np.uint64(lm_score._first_of(b, n)) == own).all()
            assert len(np.unique(lm_score._get(lm_score._put(own, b, n, 40)))) == len(own)
    assert len(lm_score._get(lm_score._put(codes[:0], 0, 1, 40))) == 0


def test_count_filter():
    rng = np.random.default_rng(4)
    codes = np.unique(rng.integers(0, 1 << 32, 20_000).astype(np.uint64)) & ~np.uint64(1)
    counts = rng.integers(1, 900, len(codes))
    f = lm_score.CountFilter(codes, counts)
    assert (f.levels(codes) >= 1 + np.floor(np.log2(counts))).all()  # never below what is stored
    assert (f.levels(rng.integers(0, 1 << 32, 20_000).astype(np.uint64) | np.uint64(1)) > 0).mean() < 0.05
    assert f.mean(np.arange(4)).tolist() == [0, 1, 2.5, 5.5]


def test_count_filter_reads_large_and_single_counts():
    codes = np.arange(2, 42, 2).astype(np.uint64)
    counts = np.array([1 << k for k in range(20, 40)])
    got = lm_score.CountFilter(codes, counts)
    assert (got.levels(codes) >= 21 + np.arange(20)).all() and np.median(got.levels(codes) - np.arange(20)) == 21
    rng = np.random.default_rng(6)
    codes = np.unique(rng.integers(0, 1 << 32, 200_000).astype(np.uint64))
    part = lm_score.CountFilter(codes, np.ones(len(codes), np.int64))
    assert 8 * len(part.data) >= 10 * len(codes) and (part.levels(codes) > 0).all()


def test_pipeline(spark):
    import corpus_pipeline as cp
    from quadrille.llm.common import materialise

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sf = "/root/testdata/sf0.001"
    assert [n for n, _ in cp.STAGES] == ["language_id", "exact_dedup", "near_dedup", "substring_dedup", "packing"]
    before = {r.doc_id: r.text for r in docs.collect()}
    lang = materialise(cp.language_id(spark, docs, sf), "t")
    assert lang.columns == docs.columns
    kept = {r.doc_id: r.text for r in lang.collect()}
    assert len(kept) > 0.95 * len(before)
    exact = materialise(cp.exact(spark, lang, sf), "t")
    groups: dict = {}
    for d, t in kept.items():
        groups.setdefault((t or "").encode().translate(None, C.SPACES), []).append((-len(t or ""), d))
    assert {r.doc_id for r in exact.collect()} == {min(g)[1] for g in groups.values()}
    near = materialise(cp.near(spark, exact, sf), "t")
    left = {r.doc_id: r.text for r in exact.collect()}
    assert {r.doc_id for r in near.collect()} == {c for _, c in ngram_join.components_by_definition(left, 5, 80).values()}
    cut = materialise(cp.substrings(spark, near, sf), "t")
    want = substring_dedup.removed_by_definition({r.doc_id: r.text for r in near.collect()})
    assert all((len((r.text or "").split()), r.n_chars) == (want[r.doc_id][0] - want[r.doc_id][1], len(r.text)) for r in cut.collect() if want[r.doc_id][1])
    packed = cp.pack(spark, cut, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in cut.collect()}


def test_pipeline_stages_on_odd_rows(spark):
    """Nulls in any column, empty and long texts, repeats, an empty table, and columns that clash with names used inside."""
    import corpus_pipeline as cp
    from quadrille.llm.common import materialise

    odd = ("langid", "dedup", "DEDUP_", "row", "_id", "th", "part", "a b")
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in odd)
    rows = [(d, t, None if i % 4 == 0 else "en", None, None if t is None else len(t), *["z"] * len(odd)) for i, (d, t) in enumerate([*ROWS, (14, "same id"), (14, "same  id")])]
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema)
        for i, (name, stage) in enumerate(cp.STAGES):
            out = stage(spark, docs, "")  # each stage on the raw rows
            alone = out.collect()
            if i < 4:
                assert out.columns == docs.columns
                assert all(r["langid"] == r["DEDUP_"] == r["a b"] == "z" for r in alone)
            if not given:
                assert alone == []
            elif name == "language_id":
                assert {r.doc_id for r in alone} <= {1, 2, 3, 7, 8, 9, 11, 12, 13, 14, None} and len(alone) == 13
            elif name == "exact_dedup":
                assert sorted(r.doc_id for r in alone if r.doc_id is not None) == [1, 3, 6, 7, 9, 10, 11, 12, 13, 14] and len(alone) == 11
                assert [r.text for r in alone if r.doc_id == 14] == ["same  id"]
            elif name == "near_dedup":
                assert {r.doc_id for r in alone} == {None, *(c for _, c in ngram_join.components_by_definition({**UNIQUE, 14: "same id"}, 5, 80).values())}
            elif name == "substring_dedup":
                assert len(alone) == len(rows) and all((r.text is None) == (r.doc_id == 4) for r in alone)
        out = docs
        for _, stage in cp.STAGES:
            out = materialise(stage(spark, out, ""), "t")
        assert (out.count() > 0) == bool(given)


def test_buckets_follow_measured_size_without_statistics(spark):
    wide = spark.createDataFrame([(1, "x", *["z"] * 10)], f"doc_id long, text string, {CLASH}")
    assert C.buckets_for(wide.select("text")) == C.buckets_for(wide) == C.buckets_for(wide.join(wide, "doc_id")) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_clashing_struct_is_replaced(spark):
    docs = spark.createDataFrame([(1, "one two", "z", "z")], "doc_id long, text string, dedup string, `Langid` string")
    assert substring_dedup.remove_repeats(docs).collect()[0].dedup.n_words == 2
    out = langid.identify(docs, *langid.train(docs.limit(0).selectExpr("doc_id", "text", "dedup AS lang")))
    assert out.columns == ["doc_id", "text", "dedup", "langid"] and out.collect()[0].langid.lang_pred == "und"


def test_vectors_of_words():
    texts = pa.array(["", None, " a  bc\n", "x" * 40, "  é"])
    data, at = C.text_bytes(texts)
    starts, ends, words_at = C.word_spans(data, at)
    assert [data[a:z].tobytes() for a, z in zip(starts, ends)] == [w for t in texts.to_pylist() for w in (t or "").encode().split()]
    assert np.diff(words_at).tolist() == [0, 0, 2, 1, 2]
