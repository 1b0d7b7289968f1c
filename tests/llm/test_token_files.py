import zlib

import numpy as np
import pytest
from brute import traced
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrylib.llm import range_coder as rc
from quarrylib.llm import token_files as tf

END = 1


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tf.vocabulary())


@pytest.fixture(scope="module")
def both():
    return tf.Encoder(tf.vocabulary()), library()


def same(both, texts):
    encoder, lib = both
    ids, sizes = encoder.encode([t.encode("utf-8", "surrogatepass") for t in texts], END)
    want = [[*lib.encode(t, add_special_tokens=False).ids, END] for t in texts]
    assert sizes.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def test_ids_are_those_of_the_whole_text(both):
    same(both, [
        "", " ", "Hello, World!", "don't DON'T we'll 'tis o'clock's", "a\tb\x0bc\x1cd\x85e\xa0f g", "<|endoftext|>x <|startoftext|>",
        "É́ é J̌ Ḱx. été. Ünï,, ÇA?! straße's", "123 4a5b ½ ² ٣", "a... b!! ***x*** $$$", "日本語。テスト", "💥💥 ok.",
        "l'été. d'Été's ñ. ́x İ. ſ. K. ǅ.", "x‍y z　w", "\x00\x01 \x7f.", "a" * 5000, "é." * 300,
    ])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("abzAZ09 .,'!sS<|>\n\téÉ́̌")), max_size=60), max_size=5))
def test_ids_of_any_text(both, texts):
    same(both, texts)


LATIN_1 = st.sampled_from("abzAZ09éÉçßÿÀÞ×÷ªºµİſ .,=>'&\n\u0301\u0338\u200d")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(LATIN_1, max_size=30), max_size=5))
def test_ids_of_latin_letters(both, texts):
    same(both, texts)


def test_words_of_letters_go_to_the_model_straight(both, monkeypatch):
    encoder, asked = tf.Encoder(tf.vocabulary()), []
    ask = encoder.ask
    monkeypatch.setattr(encoder, "ask", lambda texts: asked.extend(texts) or ask(texts))
    texts = ["Straße, Été. naïvement Éloigné zzqx", "a×b don't x9 ¿qué? 日本 él", "ÀÖØÞ àöøþ éé&&& ×."]
    same((encoder, both[1]), texts)
    assert set(asked) == {w.encode() for w in ["a×b", "don't", "x9", "¿qué", "日本", "×.", ",", ".", "?", "&&&"]}
    assert encoder.words.keys() >= {"Été".encode(), "éé".encode()}
    encoder.ends_word[:] = False  # as of a model that doesn't mark the ends of words
    asked.clear()
    same((encoder, both[1]), ["otherwise Élan"])
    assert asked == [b"otherwise", "Élan".encode()]


def test_words_that_come_up_again_are_remembered(both, monkeypatch):
    monkeypatch.setattr(tf, "MEMORY", 60)
    encoder, learnt = tf.Encoder(tf.vocabulary()), []
    learn = encoder.learn
    monkeypatch.setattr(encoder, "learn", lambda fresh: learnt.extend(fresh) or learn(fresh))
    texts = [f"the common words and {'x' * i} once{i} été" for i in range(200)]
    for i in range(0, 200, 20):
        same((encoder, both[1]), texts[i : i + 20])
        assert len(encoder.words) <= tf.MEMORY + 45
    assert len(learnt) == len(set(learnt))
    monkeypatch.setattr(tf, "MEMORY", 0)
    for t in texts[:5]:
        same((encoder, both[1]), [t, t])


def test_ids_of_documents(spark, both):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    same(both, texts)
    whole = tf.Encoder(tf.vocabulary(), word_split=False)
    a, b = whole.encode([t.encode() for t in texts[:20]], END), both[0].encode([t.encode() for t in texts[:20]], END)
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, (1 << 17) - 1), st.integers(0, (1 << 32) - 1)), max_size=600), st.binary(max_size=50))
def test_round_trip_of_any_ids(ids, attached):
    got, more = rc.decode(rc.encode(np.array(ids, np.int64), attached))
    assert got.tolist() == ids and more == attached


@pytest.mark.parametrize("n", [0, 1, 2, 191, 192, 193, 5000, 60_000, 900_001])
def test_round_trip_of_many_ids(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 49_409, n), rng.integers(0, 200_000, n) << 14, rng.integers(0, 260_000, n), np.zeros(n, np.int64), rng.pareto(0.5, n).astype(np.int64) % 49_409, np.arange(n) % 97):
        assert (rc.decode(rc.encode(ids))[0] == ids).all()


def test_coding_takes_few_bytes_an_id():
    ids = (np.random.default_rng(0).zipf(1.3, 1 << 21) % 49_000).astype(np.uint32)
    assert traced(lambda: rc.encode(ids)) < 19 * len(ids)
    block = rc.encode(ids)
    assert block == rc.encode(ids.astype(np.int64))
    assert traced(lambda: rc.decode(block)) < 18.5 * len(ids)


def test_predictions_save_room_and_damage_is_noticed():
    ids = np.tile(np.random.default_rng(0).integers(0, 40_000, 500), 200)
    block = rc.encode(ids, b"attached")
    assert len(block) < len(ids) * 0.6
    for at in (0, 10, block.index(b"attached"), len(block) // 2, len(block) - 1):
        with pytest.raises(rc.Corrupt):
            rc.decode(block[:at] + bytes([block[at] ^ 1]) + block[at + 1 :])
    with pytest.raises(rc.Corrupt):
        rc.decode(block[:-7])
    with pytest.raises(ValueError):
        rc.encode(np.array([1 << 32]))


def test_probabilities_are_the_sum_of_the_orders():
    """Each id's part is what three predictions give it, and all parts of a lane fill at most the whole."""
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 6, (40, 300)).astype(np.int32)
    m = rc.Model(6, 8)
    one = two_back = np.zeros(300, np.int32)
    for now in ids:
        slot = m.slots(one, two_back)
        entry2, entry1, two, first, state = m.predict(one, slot)
        parts = np.array([m.w0[state] * m.freq[s] + m.w1[state] * (first == s) + m.w2[state] * (two == s) for s in range(6)])
        begins = np.array([m.w0[state] * m.cum[s] + m.w1[state] * (first < s) + m.w2[state] * (two < s) for s in range(6)])
        assert (parts > 0).all() and (np.cumsum(parts, 0)[:-1] == begins[1:]).all() and (parts.sum(0) <= 1 << rc.BITS).all()
        m.learn(now, one, slot, entry2, entry1, state, two == now, first == now)
        two_back, one = one, now


def test_only_a_tokenizer_that_says_so_is_asked_word_by_word():
    import public_tokenizers

    assert tf.Encoder(tf.vocabulary()).word_split
    other = tf.Encoder(str(public_tokenizers.path("byte_bpe_50k.json")))
    assert not other.word_split
    texts = ["Hello, World!  two  spaces", "", "Ab aB\n\n x"]
    ids, sizes = other.encode([t.encode() for t in texts], END)
    want = [[*e.ids, END] for e in other.library.encode_batch(texts, add_special_tokens=False)]
    assert ids.tolist() == sum(want, []) and sizes.tolist() == list(map(len, want))


def test_rows_of_one_id_spread(spark):
    docs = [(None if i % 2 else 7, f"text number {i}") for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    blocks = tf.write_token_files(df, tf.vocabulary(), partitions=8)
    held = [r["count"] for r in blocks.groupBy("part").count().collect()]
    assert len(held) == 8 and tf.read_token_files(blocks).count() == 3000


def expected(docs):
    lib, out, start = library(), [], 0
    for d, t in docs:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, END]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_documents_in_order(spark, monkeypatch):
    monkeypatch.setattr(tf, "BLOCK_IDS", 3000)
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect())
    df = spark.createDataFrame(docs[::-1], "doc_id long, text string")
    blocks = tf.write_token_files(df, tf.vocabulary(), partitions=5)
    assert blocks.select("part").distinct().count() == 5 and blocks.count() > 10
    got = [tuple(r) for r in tf.read_token_files(blocks).orderBy("doc_id").collect()]
    assert got == expected(docs)
    lib = library()
    ids = {r.doc_id: r.ids for r in tf.token_ids(blocks).collect()}
    assert ids == {d: [*lib.encode(t, add_special_tokens=False).ids, END] for d, t in docs}


def test_odd_tables(spark):
    docs = [(None, "x"), (3, None), (3, None), (4, ""), (9, "long " * 60_000), (10, "the end")]
    df = spark.createDataFrame([(*d, 1, "a") for d in docs[::-1]], "doc_id long, text string, part int, data string")
    got = sorted((tuple(r) for r in tf.read_token_files(tf.write_token_files(df, tf.vocabulary())).collect()), key=lambda r: r[1])
    assert got == expected(docs)
    assert tf.read_token_files(tf.write_token_files(df.limit(0), tf.vocabulary())).count() == 0
