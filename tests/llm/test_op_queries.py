"""Every registered query of the subpackage on whole tables: its columns, and its rows against SQL, libraries or plain re-computation."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from quadrille.llm import bytebpe, langid, quality, registry
from quadrille.llm import common as C
from quadrille.llm.wordbpe import encoder

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
FIRST = {  # the contracts' columns
    "op1_wavelet": "doc_id start n_tokens ids_crc32", "op2_exact_dedup": "doc_id keep_id group_size kept text_sha256", "op3_quality": "doc_id held_out score predicted",
    "op4_byte_bpe": "doc_id n_tokens ids_sha256 decoded_sha256", "op5_substring_dedup": "doc_id n_words n_removed kept_sha256", "op6_embedding_dedup": "vec_id n_links component_id kept",
    "op7_langid": "doc_id held_out lang_pred score", "op8_lm_score": "doc_id held_out n_tokens n_known train_tokens base_score score", "op9_ngram_join": "doc_id n_shingles component_id",
    "op10_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
}


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def results(spark):
    return {name: run(spark, SF).toPandas() for name, run in registry.QUERIES.items()}


def test_columns(results):
    assert set(results) == set(FIRST)
    for name, x in results.items():
        assert list(x.columns)[: len(FIRST[name].split())] == FIRST[name].split(), name


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(results, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(registry.SQL[name]).df()
    got = results[name][want.columns]
    key = list(want.columns)
    assert sorted(map(tuple, got.to_numpy().tolist())) == sorted(map(tuple, want[key].to_numpy().tolist()))


def test_wavelet_and_packing_against_the_library(results, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = {d: np.array(tok.encode(t or "", add_special_tokens=False).ids, "<u4") for d, t in texts.items()}
    at = 0
    for r in results["op1_wavelet"].sort_values("doc_id").itertuples():
        own = np.append(ids[r.doc_id], np.array([1], "<u4"))
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(own), zlib.crc32(own.tobytes()))
        at += len(own)
    pieces = results["op10_packing"].sort_values(["doc_id", "start"])
    assert set(pieces.doc_id) == set(texts)
    for d, rows in pieces.groupby("doc_id"):
        own, at = np.append(ids[d], np.array([2], "<u4")), 0
        for r in rows.itertuples():
            assert (r.start, r.ids_crc32, r.doc_tokens) == (at, zlib.crc32(own[at : at + r.length].tobytes()), len(own))
            at += r.length
        assert at == len(own)
    whole = pieces.groupby("sequence_id").length.sum()
    assert whole.max() <= 4096 and (whole == pieces.assign(end=pieces.offset + pieces.length).groupby("sequence_id").end.max()).all()


def test_byte_bpe_against_the_library(results, texts):
    coder = bytebpe.ByteBPE(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for r in results["op4_byte_bpe"].itertuples():
        t = texts[r.doc_id] or ""
        ids = np.array(coder.core.encode_ordinary(t), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_encoders_on_odd_strings():
    from tokenizers import Tokenizer

    rng = random.Random(12)
    parts = [" ", "  ", "\n", "\t", " ", "a", "The", "'s", "'LL", "don't", "123", "45", "é", "é", "ß", "ζ", "中文", "🙂", "👩‍👩‍👧", "​", "...", "--", "_", "#", "\x00", "\x7f", "İ", "ǅ", "x" * 40, "0" * 9, "</s>", "<|endoftext|>"]
    odd = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(2500)]
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids, at = encoder(P.path("word_bpe_49k.json")).encode(pa.array([*odd, None]), 2)
    for t, a, z in zip([*odd, ""], at[:-1], at[1:]):
        assert ids[a:z].tolist() == [*tok.encode(t, add_special_tokens=False).ids, 2], repr(t)


def test_quality_by_definition(spark, results, texts):
    """Scores again from the fitted model, feature by feature, and the descent's result by a plain loop."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    m = quality.train(docs, labels.where(C.crc_mod(labels.doc_id, 5) != 0))
    x = results["op3_quality"].set_index("doc_id")
    mask = (1 << 64) - 1

    def mix(v):
        return int(C.mix(np.array([v & mask], np.uint64))[0])

    def word(w):
        return int(C.word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0])

    def by_hand(text):
        seq = f" {text} ".encode().translate(bytes(c + 32 if 65 <= c < 91 else 32 if 9 <= c < 14 else c for c in range(256)))
        total = np.zeros(len(langs))
        for a in range(0, len(seq), langid.CORE):
            low, own = max(0, a - langid.CONTEXT), seq[max(0, a - langid.CONTEXT) : a + langid.CORE + langid.CONTEXT]
            logit = (np.concatenate([states("f", own), states("b", own)], 1) @ p["o"] + p["ob"])[a - low : a - low + langid.CORE]
            e = np.exp(logit - logit.max(1, keepdims=True))
            total += (e / e.sum(1, keepdims=True)).sum(0)
        return total / len(seq)

    x = results["op7_langid"].set_index("doc_id")
    assert (x.held_out == [zlib.crc32(str(d).encode()) % 3 == 1 for d in x.index]).all()
    for d in [d for d, t in texts.items() if 0 < len((t or "").split()) < 150][:12]:
        if any(c.isalpha() for c in texts[d]):
            want = by_hand(texts[d])
            assert x.lang_pred[d] == langs[int(want.argmax())] and x.score[d] == pytest.approx(want.max(), abs=1e-4)
    lang = {r.doc_id: r.lang for r in docs.collect()}
    held = x[x.held_out & (x.lang_pred != "und")]
    assert np.mean([lang[d] == k for d, k in held.lang_pred.items()]) > 0.95
