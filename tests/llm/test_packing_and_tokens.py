import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from palimpsest.llm import packing, token_store
from palimpsest.llm.tokens import Encoder

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def library(path):
    t = Tokenizer.from_file(path)
    return lambda x: np.array(t.encode(x or "", add_special_tokens=False).ids, "<u4")


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_cached_encoder_equals_the_library(path, texts):
    want, enc = library(path), Encoder(path)
    odd = ["", None, " ", "  a", "a ", "a\n b", "it's we'LL  x\t\ty", "ÀÉÎ straße ß", "x²y ½ µ ª", "日本 語", "a b", "\r\nx", "<|endoftext|> a", "a<|endoftext|>", "x <|ENDOFTEXT|> y", "<|startoftext|>b <|endoftext|>", "<|im_start|>", "<|", "é<|endoftext|>é", "١٢٣", "é"]
    draw = random.Random(1)
    odd += ["".join(draw.choice(" \n\t'aAéÉ1!s.,…") for _ in range(30)) for _ in range(300)]
    for t in odd + list(texts.values()):
        assert enc.encode(t) == want(t).tobytes(), t


def test_best_fit_never_overfills_and_is_tight():
    draw = random.Random(2)
    sizes = [draw.randint(1, 100) for _ in range(500)]
    bins, at = packing.best_fit(sizes, 100)
    fill = defaultdict(list)
    for s, b, a in zip(sizes, bins, at):
        fill[b].append((a, s))
    for items in fill.values():
        end = 0
        for a, s in sorted(items):
            assert a == end
            end += s
        assert end <= 100
    assert len(fill) <= -(-sum(sizes) // 100) * 11 / 9 + 1


def tokens_of(texts):
    want = library(WORD)
    return sum(len(want(t)) + 1 for t in texts.values())


def check_packed(rows, docs, capacity=2048):
    want = library(WORD)
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        seqs[r.sequence_id].append((r.offset, r.length))
    expected = defaultdict(list)
    for d, t in docs:
        ids = np.append(want(t), np.uint32(0)).astype("<u4")
        expected[d] += [(k // capacity, k, len(ids[k : k + capacity]), zlib.crc32(ids[k : k + capacity].tobytes())) for k in range(0, len(ids), capacity)]
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in expected.items()}
    for v in seqs.values():
        end = 0
        for o, n in sorted(v):
            assert o == end
            end += n
        assert end <= capacity
    return len(seqs)


def test_packing(docs, texts):
    n = check_packed(packing.pack(docs, WORD).collect(), texts.items())
    total = tokens_of(texts)
    assert n <= -(-total // 2048) * 1.02 + 1


def test_packing_in_several_rounds(docs, texts):
    rows = packing.pack(docs.repartition(7), WORD, group=10, local=5, keep_ids=True).collect()
    n = check_packed(rows, texts.items())
    assert n <= -(-tokens_of(texts) // 2048) * 1.12 + 1  # tiny groups leave gaps
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in rows)


def test_best_fit_against_the_optimum_of_small_cases():
    def fewest(sizes, capacity, bins=()):
        if not sizes:
            return len(bins)
        best = 99
        for room in {b for b in bins if b + sizes[0] <= capacity} | {0}:
            rest = list(bins)
            if room:
                rest.remove(room)
            best = min(best, fewest(sizes[1:], capacity, (*rest, room + sizes[0])))
        return best

    draw = random.Random(6)
    for _ in range(60):
        sizes = [draw.randint(1, 20) for _ in range(7)]
        got = max(packing.best_fit(sizes, 20)[0]) + 1
        assert fewest(sizes, 20) <= got <= -(-11 * fewest(sizes, 20) // 9) + 1


def test_packing_awkward(awkward, nothing):
    check_packed(packing.pack(awkward, WORD).collect(), [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()])
    assert packing.pack(nothing, WORD).count() == 0


def test_token_store_round_trip(spark, docs, texts, tmp_path):
    folder, want = f"file://{tmp_path}", library(BYTE)
    manifest = token_store.write(docs, BYTE, folder, shard_mb=0.01)
    assert len(manifest["shards"]) > 8
    got = {r.doc_id: r for r in token_store.read(spark, folder, manifest, keep_ids=True).collect()}
    start = 0
    for d in sorted(texts):
        ids = np.append(want(texts[d]), 2).astype("<u4")
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32, bytes(got[d].ids)) == (start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        start += len(ids)
    some = sorted(texts)[17]
    assert token_store.read_document(folder, manifest, some).tobytes() == bytes(got[some].ids)
    assert all(token_store.read_document(folder, manifest, d).tobytes() == bytes(got[d].ids) for d in (min(texts), max(texts)))
    assert token_store.read_document(folder, manifest, -5) is None and token_store.read_document(folder, manifest, 10**9) is None


def test_token_store_awkward(spark, awkward, nothing, tmp_path):
    folder = f"file://{tmp_path}"
    rows = token_store.read(spark, folder, token_store.write(awkward, BYTE, folder)).orderBy("start").collect()
    ids = [r.doc_id for r in rows]
    assert ids == [None, None, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9]
    assert sum(r.n_tokens for r in rows) == rows[-1].start + rows[-1].n_tokens
    assert token_store.read(spark, folder, token_store.write(nothing, BYTE, folder)).count() == 0


def test_a_shard_of_another_dictionary_is_refused(spark, docs, tmp_path):
    import glob

    folder = f"file://{tmp_path}"
    token_store.write(docs.filter(F.col("doc_id") < 50), BYTE, folder)
    shard = open(glob.glob(f"{tmp_path}/*.tok")[0], "rb").read()
    with pytest.raises(ValueError, match="another dictionary"):
        list(token_store.parse(shard, b"x"))
