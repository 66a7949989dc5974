import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from cairn.llm import token_output as to

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [2]


def test_pack_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1001):
        v = (2 ** rng.uniform(0, 32, n)).astype(np.uint32)
        control, data = to.pack(v)
        assert np.array_equal(to.unpack(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n), v)
        assert len(control) == -(-n // 4)


def test_pieces_encode_as_the_tokenizer_does(plain, monkeypatch):
    odd = [None, "a <|endoftext|> b", "<|endoftext|>", "x\ny z\nq", "x\n\ny", "\nx y", "x y\n", "x\n\n\ny", "x\t\ny", "x\xa0\ny\n\u3000z", "a b", " a  b   c ", "x \n y\n\n  z", "<|endoftext|> a", "", " ", "é ü q\x85 r \x1c s", "it's 1 !b \t\tk", "日本 語", "　 a ​ b", "a" * 3000]
    rng = random.Random(2)
    alphabet = " \n\n\t\x85\xa0a1!'sé語\U0001f600"
    odd += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(600)]
    monkeypatch.setattr(to, "WORD_BYTES", 20_000)
    encoder = to.PieceEncoder(PATH)
    for end, part in ((2, odd), (None, odd), (2, odd[3:4]), (2, ["a b", "c"]), (2, [])):
        ids, sizes = encoder.encode(pa.array(part, pa.string()), end)
        assert len(sizes) == len(part) and sizes.sum() == len(ids)
        for text, upto, n in zip(part, np.cumsum(sizes), sizes, strict=True):
            assert ids[upto - n : upto].tolist() == (plain(text) if end else plain(text)[:-1]), repr(text)
    assert encoder.held <= 30_000
    encoder.forget()
    assert not encoder.words


def test_pieces_are_remembered_from_task_to_task(plain, monkeypatch):
    encoder = to.PieceEncoder(PATH)
    texts = pa.array(["a rare.\nword, zzyzx 12 qué!", "a " + "b" * 100 + " rare. zzyzx"])
    first = encoder.encode(texts, 2)
    encoder.forget()
    asked, ids_of = [], encoder._ids
    monkeypatch.setattr(encoder, "_ids", lambda letters: asked.append(letters) or ids_of(letters))
    again = encoder.encode(texts, 2)
    # Only what starts a text, and a piece too long to be remembered, is put to the model again.
    assert [len(x) for x in asked] == [1, 101]
    assert all(np.array_equal(x, y) for x, y in zip(first, again, strict=True))
    monkeypatch.setattr(to, "PIECE_BYTES", 0)
    held = len(encoder.pieces)
    assert encoder.encode(pa.array(["x unseen rare."]), 2)[0].tolist() == plain("x unseen rare.") and len(encoder.pieces) == held


def test_slices_cover_all_rows():
    column = pa.array(["a" * n for n in (5, 0, 200, 3, 3, 3)] + [None, "b"])
    got = list(to.slices(column, 10))
    assert [i for at, n in got for i in range(at, at + n)] == list(range(8)) and all(n for _, n in got)


def _expected(rows, plain):
    at, out = 0, []
    for r in rows:
        ids = plain(r[1])
        out.append((r[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("shard_tokens", [200, 1 << 24])
def test_files_hold_all_ids_in_order(docs, corpus, plain, monkeypatch, shard_tokens):
    monkeypatch.setattr(to, "SHARD_TOKENS", shard_tokens)
    got = [tuple(r)[:4] for r in to.token_output(docs, PATH).collect()]
    # Ties of ids are equal texts here; the null id comes first.
    want = _expected(sorted(corpus, key=lambda r: (r[0] is not None, r[0] or 0)), plain)
    assert sorted(got, key=lambda r: r[1]) == want


def test_a_shard_is_decoded_in_pieces(tmp_path, monkeypatch):
    monkeypatch.setattr(to, "CHUNK_TOKENS", 8)
    values = np.arange(0, 4000, 37, dtype=np.uint32)
    to.write_shard(f"{tmp_path}/s.bin", [5, None], [10, len(values) - 10], values)
    got = list(to.read_shard(f"{tmp_path}/s.bin", np.arange(5000, dtype=np.uint32)))
    assert [g[0] for g in got] == [5, None]
    assert np.array_equal(np.concatenate([g[1] for g in got]), values)


def test_empty_table_and_clashing_names(empty, clash, docs):
    assert to.token_output(empty, PATH).count() == 0
    key = lambda df: sorted((tuple(r)[:4] for r in to.token_output(df, PATH).collect()), key=repr)
    assert key(clash) == key(docs)
