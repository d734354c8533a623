import array
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from recordspark.llm import packing, token_files
from recordspark.llm.tokens import Encoder, encoder

NAMES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
FULL = {n: Tokenizer.from_file(public_tokenizers.path(n)) for n in NAMES}
WORDS = st.sampled_from(["the", "The", "it's", "don't", "word.", "end...", ",", "9a", "<|endoftext|>", "<|ENDOFTEXT|>", "é", "É", "Σας", "ΣΑΣ", "ﬁ", "J̌", "'s", "x_y", "ß", "\xb2", "😀", "a.b,c", ".,a"])
BLANKS = st.sampled_from([" ", " ", " ", "\n", "  ", "\n\n", " \n", "\t", "\x1c", "\x85", "\xa0", " ", "\r\n", ""])


def ids(name, text):
    return FULL[name].encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=300, deadline=None)
@given(parts=st.lists(st.tuples(BLANKS, WORDS), max_size=12), end=BLANKS)
def test_same_ids_as_the_library(name, parts, end):
    text = "".join(a + b for a, b in parts) + end
    own = encoder(public_tokenizers.path(name))
    assert array.array(own.code, own.encode([text, None, text])[2]).tolist() == ids(name, text)


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=200, deadline=None)
@given(text=st.text(max_size=60))
def test_same_ids_on_any_text(name, text):
    own = encoder(public_tokenizers.path(name))
    assert array.array(own.code, own.encode([text])[0]).tolist() == ids(name, text)


def test_token_files_round_trip(spark, odd_docs):
    name = NAMES[0]
    manifest = token_files.write_tokens(odd_docs, public_tokenizers.path(name), 2, partitions=3)
    rows = sorted(token_files.read_tokens(manifest).collect(), key=lambda r: r.start)
    assert len(rows) == odd_docs.count()
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in odd_docs.collect()), key=lambda x: (x is not None, x))
    start = 0
    expected = {r.doc_id: [*ids(name, r.text or ""), 2] for r in odd_docs.collect()}
    for r in rows:
        own = expected[r.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        start += len(own)
    for m in manifest.collect():
        f = token_files.TokenFile(m.file, m.width)
        assert isinstance(f._ids, np.memmap) and f.offsets[-1] == m.n_tokens == len(f._ids)


def test_no_documents(spark, no_docs):
    path = public_tokenizers.path(NAMES[0])
    assert token_files.read_tokens(token_files.write_tokens(no_docs, path, 2)).count() == 0
    assert packing.pack_documents(no_docs, path, 1).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=60))
def test_pack_covers_all(lengths):
    plan = packing.pack(np.array(lengths), 16)
    for d, n in enumerate(lengths):
        at = 0
        for _, start, length, _, _ in sorted(x for x in plan if x[0] == d):
            assert start == at and length > 0
            at += length
        assert at == n
    filled = {}
    for _, _, length, s, offset in plan:
        assert filled.get(s, 0) == offset
        filled[s] = offset + length
    assert all(x <= 16 for x in filled.values())
    assert len(filled) * 16 - sum(lengths) < 16 * (1 + sum(1 for n in lengths if False))
    assert sorted(filled) == list(range(len(filled)))


def test_pack_balances_cost():
    lengths = np.random.default_rng(0).integers(1, 2000, 500)
    cost = {}
    for _, _, n, s, _ in packing.pack(lengths, 2048):
        cost[s] = cost.get(s, 0) + packing.LINEAR * n + packing.QUADRATIC * n * n
    assert max(cost.values()) < 1.6 * np.mean(list(cost.values()))


def test_pack_documents(spark, odd_docs):
    name = NAMES[1]
    rows = packing.pack_documents(odd_docs, public_tokenizers.path(name), 1, capacity=64, block_tokens=200, with_ids=True).collect()
    expected = {r.doc_id: [*ids(name, r.text or ""), 1] for r in odd_docs.collect()}
    assert sum(r.length for r in rows) == sum(len(expected[r.doc_id]) for r in odd_docs.collect())
    filled = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        own = expected[r.doc_id][r.start : r.start + r.length]
        assert np.frombuffer(r.ids, "<u4").tolist() == own and r.ids_crc32 == zlib.crc32(r.ids) and r.doc_tokens == len(expected[r.doc_id])
        assert filled.get(r.sequence_id, 0) == r.offset
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 64


@pytest.mark.parametrize("name", NAMES)
def test_words_are_learnt_once_for_all_their_stops(name, monkeypatch):
    own, learnt = Encoder(public_tokenizers.path(name)), []
    learn = own._learn
    monkeypatch.setattr(own, "_learn", lambda pieces: learnt.extend(pieces) or learn(pieces))
    texts = ["x and and, and. then and..", "x café, É and, naïve. Ünï, 中文, and", "x  runs \n\n of, blanks "]
    for _ in range(2):
        assert [array.array(own.code, x).tolist() for x in own.encode(texts)] == [ids(name, t) for t in texts]
    assert learnt.count("and") == 1 and not {"and,", "and.", "and.."} & {*learnt}


@pytest.mark.parametrize("name", NAMES)
def test_the_cache_is_bounded(name):
    own = Encoder(public_tokenizers.path(name))
    own.LIMIT = 20
    for k in range(6):
        text = "x " + " ".join(f"{chr(97 + k)}{chr(97 + i)}word often" for i in range(26)) + f" new{k} twice{k} twice{k}"
        assert array.array(own.code, own.encode([text, None, text[2:]])[0]).tolist() == ids(name, text)
        assert len(own.known) <= 10
    one = "x once again again"
    own.encode([one])
    assert "once" not in own.known and "again" in own.known | own.before


@pytest.mark.parametrize("name", NAMES)
def test_words_of_letters_need_no_folding_by_the_library(name, monkeypatch):
    own, asked = Encoder(public_tokenizers.path(name)), []
    of = own._ids
    monkeypatch.setattr(own, "_ids", lambda by, texts: asked.append((by is own.full, texts)) or of(by, texts))
    texts = ["x Plain words, of. Letters and it's", "x plain CAFÉ, Óð., ßü ªº µm aª é1 \xd7", None, ""]
    assert [array.array(own.code, x).tolist() for x in own.encode(texts)] == [ids(name, t or "") for t in texts]
    fully = " ".join(t for full, group in asked if full for t in group).split()
    plain = {"plain", "words", "of", "letters", "Letters", "and"} | ({"café", "óð", "ßü"} if own.word_ends else set())
    assert not plain & {*fully} and "it's" in fully
