import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from evidencelake.llm import bpe, packing

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PACK = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_codec_equals_library_on_odd_strings():
    enc, own, rng = reference(), bpe.codec(PATH, public_tokenizers.PATTERN), random.Random(1)
    for _ in range(1500):
        s = "".join(rng.choice(["a", " ", "\n", "  ", "é", "1", "!", "'s", "\t", "\x85", "日", "aa", " \n "]) for _ in range(rng.randint(0, 30)))
        assert own.encode(s) == enc.encode_ordinary(s)
        assert own.decode(own.encode(s)) == s.encode()
    long = "abc" * 50_000
    assert own.encode(long) == enc.encode_ordinary(long)


def test_codec_keeps_what_is_in_use(monkeypatch):
    """Words that come up again and again are merged once, however many others come between; the ids stay right."""
    monkeypatch.setattr(bpe, "GENERATION", 3000)
    enc, own, merged = reference(), bpe.Codec(PATH, public_tokenizers.PATTERN), Counter()
    plain = own.merge
    monkeypatch.setattr(own, "merge", lambda pieces: (merged.update(pieces), plain(pieces))[1])
    for i in range(200):
        text = "qzxvwk jjkzqy, " + " ".join(f"w{chr(97 + k)}qz{chr(97 + i % 26)}xk{chr(97 + i // 26)}" for k in range(20)) + " a  b " + "y" * 70
        assert own.encode(text) == enc.encode_ordinary(text)
        assert sum(map(len, own.pieces)) + sum(map(len, own.chunks)) <= 3000
    assert merged[b" jjkzqy"] == 1 and len(merged) > 3000


def test_encode_documents(docs, texts, empty):
    enc = reference()
    found = bpe.encode_documents(docs.union(docs.limit(1)), PATH, public_tokenizers.PATTERN).collect()
    assert len(found) == len(texts) + 1
    want = dict(texts)
    for r in found:
        ids = enc.encode_ordinary(want[r["doc_id"]] or "")
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((want[r["doc_id"]] or "").encode()).hexdigest()
    assert bpe.encode_documents(empty, PATH, public_tokenizers.PATTERN).count() == 0


def test_hilbert_visits_neighbours():
    side = 8
    points = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    keys = packing.hilbert(points, 3)
    assert sorted(keys) == list(range(side**3))
    path = points[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_pack_is_whole_and_gapless(docs, texts, empty):
    tokenizer = Tokenizer.from_file(PACK[0])
    pieces = packing.pack(docs, *PACK, length=64, keep_ids=True).collect()
    parts, sequences = defaultdict(list), defaultdict(list)
    for r in pieces:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        parts[r["doc_id"]].append((r["start"], r["ids"], r["doc_tokens"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text in texts:
        own = [x for _, ids, _ in sorted(parts[i]) for x in ids]
        assert own == tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        assert {n for _, _, n in parts[i]} == {len(own)}
    for s, held in sequences.items():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at == 64 or s == max(sequences)
    assert sorted(sequences) == list(range(len(sequences)))
    assert packing.pack(empty, *PACK).count() == 0
