"""Token files against the tokenizers library and plain arrays."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from riskweave.llm import token_files
from riskweave.session import scratch_path
from tests.llm.cases import edge_rows, empty, frame, sentence

PATH = public_tokenizers.path("byte_bpe_50k.json")


def streams():
    rng = np.random.default_rng(5)
    yield np.zeros(0, np.uint64)
    yield np.array([7], np.uint64)
    yield np.zeros(1025, np.uint64)
    yield rng.integers(0, 50_257, 5000).astype(np.uint64)
    yield np.array([0, (1 << 64) - 1] * 700 + [5], np.uint64)
    yield (rng.zipf(1.3, 4096) % (1 << 40)).astype(np.uint64)
    few = np.full(3000, 1 << 33, np.uint64)
    few[::400] += np.uint64(1 << 20)
    yield few


@pytest.mark.parametrize("percentile", [0.0, 0.5, 0.95, 1.0])
def test_blocks_round_trip(percentile):
    for values in streams():
        blocks = list(token_files.encode_blocks(values, percentile))
        starts = np.cumsum([0, *map(len, blocks)])[:-1].tolist()
        assert token_files.decode_blocks(b"".join(blocks), starts).tolist() == values.tolist()


def test_outliers_do_not_widen_a_block():
    values = np.arange(1024, dtype=np.uint64) % np.uint64(16)
    values[[5, 900]] = 1 << 40
    block = next(token_files.encode_blocks(values))
    count, width, size, odd, _, base = token_files._HEAD.unpack_from(block)
    assert (count, width, size, odd, base) == (1024, 4, 8, 2, 0)
    assert len(block) == token_files._HEAD.size + 1024 * 4 // 8 + 2 * (2 + 8)


def test_encoder_equals_the_library():
    code, plain = token_files.Encoder(PATH), Tokenizer.from_file(PATH)
    assert code.in_chunks
    rng = random.Random(2)
    letters = list(" \t\n\r\x0b\x0c\x85\xa0   　\x1c\x1f​ab'st1!é日▁🙂") + [
        "<|endoftext|>", "  ", "'ll", " a", "\n\n", "12 3"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 16))) for _ in range(4000)]
    texts += [t for _, t in edge_rows(rng) if t]
    texts += ["don't,<|endoftext|>x; a!! b--c d'll e's", "x<|endoftext", " naïve!é", "\nWord, \n\nWord \n Word\tx", "\nÉté!\n!", "a²b a_b ١a!٢"]
    for text, got in zip(texts, code.encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_known_chunks_are_forgotten_in_time(monkeypatch):
    monkeypatch.setattr(token_files, "CACHE", 40)
    code, plain = token_files.Encoder(PATH), Tokenizer.from_file(PATH)
    rng = random.Random(7)
    for _ in range(60):
        texts = [" ".join(rng.choice("ab")*rng.randint(1, 9) + rng.choice(["", ",", "'s"])
                          for _ in range(rng.randint(0, 12))) for _ in range(3)]
        for text, got in zip(texts, code.encode(texts)):
            assert np.frombuffer(got, "<u4").tolist() == plain.encode(
                text, add_special_tokens=False).ids
    assert len(code._known) < 200


def test_other_tokenizers_get_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    code, plain = token_files.Encoder(path), Tokenizer.from_file(path)
    assert not code.in_chunks
    texts = ["A b  c", "", "don't <|endoftext|> x"]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(b, "<u4").tolist() for b in code.encode(texts)] == want


def expected(rows):
    """(doc_id, start, n_tokens, crc) in order; equal doc_ids only by what holds for any order."""
    plain, out, at = Tokenizer.from_file(PATH), [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_files_hold_every_document(spark):
    rng = random.Random(8)
    rows = edge_rows(rng) + [(1000 + k, sentence(rng, rng.randint(0, 60))) for k in range(300)]
    rng.shuffle(rows)
    got = token_files.round_trip(frame(spark, rows), PATH).collect()
    want = expected(rows)
    bag = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    single = {d for d, *_ in want if sum(w[0] == d for w in want) == 1}
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got if r.doc_id in single),
                  key=bag) == sorted((w for w in want if w[0] in single), key=bag)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted(
        (d is None, d or 0, n, c) for d, _, n, c in want)
    ends = sorted((r.start, r.start + r.n_tokens) for r in got)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == [w[0] for w in want]


def test_small_files_slices_and_damage(spark):
    rows = [(k, sentence(random.Random(k), 30)) for k in range(200)] + [(None, "a")] * 3
    path = scratch_path(spark, "tokens")
    token_files.write(frame(spark, rows), path, PATH, 2, file_ids=500)
    files = [bytes(r.content) for r in spark.read.format("binaryFile").load(path).collect() if r.length]
    assert len(files) > 10
    files = sorted(files, key=lambda f: token_files.TokenFile(f).number)
    whole = np.concatenate([f.ids(0, f.n_ids) for f in map(token_files.TokenFile, files)])
    plain = Tokenizer.from_file(PATH)
    want = [i for _, t in [(None, "a")] * 3 + rows[:200]
            for i in [*plain.encode(t, add_special_tokens=False).ids, 2]]
    assert whole.tolist() == want
    file = token_files.TokenFile(files[-1])
    every = file.ids(0, file.n_ids)
    for start, stop in [(0, 1), (3, 3), (5, 400), (file.n_ids - 1, file.n_ids + 9), (-4, 2)]:
        assert file.ids(start, stop).tolist() == every[max(start, 0):max(stop, 0)].tolist()
    table = token_files.read(spark, path, with_ids=True)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in table.collect())
    broken = bytearray(files[0])
    broken[20] ^= 1
    with pytest.raises(ValueError):
        token_files.TokenFile(bytes(broken))
    with pytest.raises(ValueError):
        token_files.TokenFile(files[0][:-30])


def test_one_doc_id_for_many_rows_and_empty_table(spark):
    rows = [(1, sentence(random.Random(k % 40), 12)) for k in range(400)]
    got = token_files.round_trip(frame(spark, rows), PATH).collect()
    ends = sorted((r.start, r.start + r.n_tokens) for r in got)
    assert len(got) == 400 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    assert token_files.round_trip(empty(spark), PATH).count() == 0
