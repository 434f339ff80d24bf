"""Operators 1 and 4 against the libraries."""

import hashlib
import random
import sys
import tracemalloc
from pathlib import Path

import public_tokenizers
import pytest
import tiktoken
from pyspark import cloudpickle
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
import corpora  # noqa: E402

from rillstone.llm import bpe, catalog, token_counts  # noqa: E402

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SINGLE = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN
IDS = bpe.ranks(MULTI)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=IDS, special_tokens={})


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(SINGLE)


def random_texts(n: int):
    rnd = random.Random(5)
    parts = ["a", "the", "   ", "\n", "é", "ß", "日本", "한국", "🙂", "x" * 50, "ab" * 30, "12345", "'s", "!!!", "\xa0", "²", "<|endoftext|>", "ﬀ"]
    spans = [(32, 127), (128, 0x180), (0x250, 0x600), (0x3000, 0xD7FF), (0x10000, 0x1FFFF)]
    for _ in range(n):
        yield "".join(rnd.choice(parts) if rnd.random() < 0.7 else chr(rnd.randrange(*rnd.choice(spans))) for _ in range(rnd.randrange(30)))


def test_random_texts_are_encoded_as_by_the_library(library):
    encoder, bytes_of = bpe.encoder(MULTI, PATTERN)
    for text in random_texts(1500):
        tokens = [t for part in encoder.stream(text, batch=4) for t in part]
        assert tokens == library.encode_ordinary(text), repr(text)
        stream = bpe.Utf8Stream(bytes_of)
        assert "".join(stream.push([t]) for t in tokens) + stream.end() == text


def test_a_full_table_of_states_changes_nothing(library):
    transducer = bpe.Transducer(bpe.Vocabulary(IDS), max_states=20)
    for word in ["tokenization", " straßenbahn", "aaaaaaaaaaaaaaaaaaaaaaab", " 日本語テキスト", "-" * 41]:
        assert transducer.encode(word.encode()) == library.encode_ordinary(word)


def test_the_table_is_emptied_within_a_piece(library):
    rnd = random.Random(8)
    transducer = bpe.Transducer(bpe.Vocabulary(IDS), max_states=50)
    for _ in range(20):
        piece = "".join(rnd.choice("etaoinshrdluäé日本") for _ in range(300))
        assert transducer.encode(piece.encode()) == library._encode_single_piece(piece)
        assert len(transducer.states) <= 50


def test_states_and_steps_take_little_memory(library):
    """A worker has a table of its own, and keeps it."""
    rnd, vocabulary = random.Random(9), bpe.Vocabulary(IDS)
    tracemalloc.start()
    transducer = bpe.Transducer(vocabulary, max_states=100_000)
    while len(transducer.states) < 90_000:
        transducer.encode(bytes(rnd.choice(b"etaoinshrdlucmfwyp") for _ in range(12)))
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 350 * len(transducer.states)
    assert transducer.encode(b" tokenization") == library.encode_ordinary(" tokenization")


def test_emission_does_not_wait_for_the_end():
    """What waits for agreement stays short on a long piece."""
    transducer = bpe.Transducer(bpe.Vocabulary(IDS))
    state, longest = 0, 0
    for byte in b"antidisestablishmentarianism" * 200:
        state, _ = transducer.steps.get(state << 8 | byte) or transducer._step(state, byte)
        longest = max(longest, *(len(w) for w, _ in transducer.states[state][0]))
    assert longest <= 8


def test_decoding_of_any_tokens(library):
    rnd = random.Random(3)
    for _ in range(500):
        tokens = [rnd.randrange(50_256) for _ in range(rnd.randrange(12))]
        stream = bpe.Utf8Stream(bpe.encoder(MULTI, PATTERN)[1])
        assert "".join(stream.push([t]) for t in tokens) + stream.end() == library.decode(tokens)


def expected_digests(library, text):
    ids = library.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_query_matches_the_library(spark, tiny, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    rows = catalog.op1_byte_bpe(spark, tiny).collect()
    assert len(rows) == len(texts)
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected_digests(library, texts[r.doc_id]) for r in rows)


def test_odd_rows(spark, library):
    want = sorted((expected_digests(library, r[1]) for r in corpora.odd_rows()))
    got = bpe.digests(corpora.odd(spark), MULTI, PATTERN).collect()
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert bpe.digests(corpora.empty(spark), MULTI, PATTERN).count() == 0


def test_tasks_of_a_process_share_the_encoder():
    """Each task gets the functions anew, by value; what they have learned of the vocabulary stays."""
    first, second = (cloudpickle.loads(cloudpickle.dumps(bpe.encoder)) for _ in range(2))
    assert first is not second
    assert first(MULTI, PATTERN)[0] is second(MULTI, PATTERN)[0]


def test_a_changed_vocabulary_is_read_again(tmp_path):
    path = tmp_path / "own.tiktoken"
    path.write_text("YQ== 0\nYg== 1\n")
    assert list(bpe.encoder(str(path), PATTERN)[0].stream("ab")) == [[0, 1]]
    path.write_text("YQ== 0\nYg== 1\nYWI= 2\n")
    assert list(bpe.encoder(str(path), PATTERN)[0].stream("ab")) == [[2]]


def test_runs_are_cut_anywhere(spark, library):
    """Whatever is written and decoded together, and wherever a long text is cut."""
    rows = [(k, text) for k, text in enumerate([None, "", "a", " zwei Wörter 日本 " * 9000, "", "🙂 " * 40_000, None, "end"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = {k: expected_digests(library, text) for k, text in rows}
    for most in (1, 4, 100_000, 1 << 20):
        got = bpe.digests(docs, MULTI, PATTERN, most=most).collect()
        assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want
        got = bpe.encode(docs, MULTI, PATTERN, most=most).collect()
        assert [(r.doc_id, r.tokens) for r in got] == [(k, library.encode_ordinary(text or "")) for k, text in rows]


def test_operator_round_trip(spark):
    tokens = bpe.encode(corpora.odd(spark), MULTI, PATTERN)
    back = tokens.select(bpe.decode(tokens, MULTI).alias("text"))
    assert sorted(r.text for r in back.collect()) == sorted(r[1] or "" for r in corpora.odd_rows())


def test_piece_counts_equal_whole_texts(tokenizer):
    counter = token_counts.Counter(SINGLE, PATTERN)
    assert counter.by_piece
    for text in random_texts(1500):
        assert counter.count(text) == len(tokenizer.encode(text, add_special_tokens=False)), repr(text)


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    counter = token_counts.Counter(path, PATTERN)
    assert not counter.by_piece
    assert counter.count("Two words") == len(Tokenizer.from_file(path).encode("Two words", add_special_tokens=False))


def count(spark, docs, cache):
    return token_counts.count_tokens(docs, SINGLE, PATTERN, cache)


def test_counts_of_odd_rows(spark, tokenizer, tmp_path):
    want = sorted((len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False))) for _, t, *_ in corpora.odd_rows())
    rows = count(spark, corpora.odd(spark), str(tmp_path / "cache")).collect()
    assert sorted((r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in rows)
    assert count(spark, corpora.empty(spark), str(tmp_path / "other")).count() == 0


def test_only_misses_are_encoded_and_appended(spark, tmp_path):
    cache = str(tmp_path / "cache")
    docs = corpora.odd(spark)
    first = count(spark, docs.filter("doc_id < 10"), cache).count()
    assert first == docs.filter("doc_id < 10").count()
    before = spark.read.parquet(cache)
    n = before.count()
    assert n == before.select("digest").distinct().count()
    spark.read.parquet(cache).withColumn("n_tokens", F.lit(777).cast("long")).write.parquet(str(tmp_path / "marked"))
    marked = str(tmp_path / "marked")
    rows = {(r.doc_id, r.n_bytes): r.n_tokens for r in count(spark, docs, marked).collect()}
    known = {(r.doc_id, r.n_bytes) for r in count(spark, docs.filter("doc_id < 10"), cache).collect()}
    assert all(rows[k] == 777 for k in known), "stored counts answer"
    after = spark.read.parquet(marked)
    assert after.count() == docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert after.count() == after.select("digest").distinct().count()
    assert token_counts.stored(spark, marked, "another version").count() == 0


def test_texts_that_stand_only_under_null_ids_are_counted(spark, tokenizer, tmp_path):
    """Once as misses, once as hits, and with a hit of another text beside them."""
    texts = [(None, "only without an id"), (None, "only without an id"), (None, "also without one"), (None, None), (1, "with an id"), (None, "with an id")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    want = sorted((str(i), len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False))) for i, t in texts)
    cache = str(tmp_path / "cache")
    count(spark, docs.filter("text = 'also without one'"), cache)
    for _ in range(2):
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in count(spark, docs, cache).collect()) == want
        assert spark.read.parquet(cache).count() == 4


def test_query_has_hits_and_misses(spark, tiny, monkeypatch):
    known, encoded, stored, counted = [], [], token_counts.stored, token_counts.counted
    monkeypatch.setattr(token_counts, "stored", lambda *a: known.append(stored(*a)) or known[-1])
    monkeypatch.setattr(token_counts, "counted", lambda texts, *a: encoded.append(texts.select("digest").distinct().count()) or counted(texts, *a))
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    assert catalog.op4_digest_cache(spark, tiny).count() == docs.count()
    even, every = docs.filter("doc_id % 2 = 0").select("text").distinct().count(), docs.select("text").distinct().count()
    assert encoded == [even, every - even] and 0 < even < every
    assert known[0].count() == 0
