import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tessella.llm import packing, words


def bin_by_bin(sizes, capacity):
    """The bins of best-two-fit, one after the other."""
    left, bins = sorted(sizes, reverse=True), []
    while left:
        own, gap, rest = [], capacity, []
        for s in left:
            if s <= gap:
                own.append(s)
                gap -= s
            else:
                rest.append(s)
        while gap and own:
            least = min(own)
            pairs = [(rest[i] + rest[j], rest[i], i, j) for i in range(len(rest)) for j in range(i + 1, len(rest)) if least < rest[i] + rest[j] <= least + gap]
            if not pairs:
                break
            total = max(p[0] for p in pairs)
            a, b = max((rest[i], rest[j]) for t, _, i, j in pairs if t == total)
            own.remove(least)
            own += [a, b]
            rest.remove(a)
            rest.remove(b)
            rest = sorted([*rest, least], reverse=True)
            gap += least - total
        bins.append(sorted(own))
        left = rest
    return bins


def spread(plan):
    return sorted(sorted(s for s, k in taken.items() for _ in range(k)) for bins, taken in plan for _ in range(bins))


def test_runs_of_bins_are_those_of_bin_by_bin():
    draw = random.Random(5)
    for capacity, top, n in [(30, 30, 60), (30, 12, 90), (100, 60, 80), (64, 64, 150), (50, 7, 120)]:
        for _ in range(12):
            sizes = [draw.randint(1, top) for _ in range(n)] + [draw.choice([top, top // 2 or 1])] * draw.randint(0, 40)
            counts = {s: sizes.count(s) for s in set(sizes)}
            assert spread(packing.best_two_fit(counts, capacity)) == sorted(bin_by_bin(sizes, capacity)), (capacity, sizes)
    assert packing.best_two_fit({}, 10) == []
    assert len(packing.best_two_fit({7: 10**12, 3: 10**12 + 5}, 10)) <= 3


WHOLE = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
WHOLE.encode_special_tokens = True


def tokens(text):
    return [*WHOLE.encode(text or "", add_special_tokens=False).ids, 2]


ODD = [
    None, "", " ", "  ", "a  b", "a   b ", " a", "a \n b\n\n  c", "x   y  z", "　 é  ê\t ü", "don't  we'll", "1 22  333", "<|endoftext|> a <|endoftext|>", "日本語 テキスト", "a\x1c b \x85 c",
    "été " * 700, "word " * 5000, "nospaceatall" * 900, "a  " * 2000,
]


def test_pieces_are_the_tokens_of_whole_texts():
    draw = random.Random(3)
    alphabet = [" ", " ", "  ", "\n", "\t", " ", "é", "a", "b", "'s", "1", "!", " ", "語", "\x1f"]
    texts = ODD + ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 60))) for _ in range(400)]
    encode = packing.encoder(public_tokenizers.path(packing.VOCABULARY))
    data, begins = words.bytes_of(packing.pa.array(texts))
    want = [tokens(t) for t in texts]
    for step in (16, 100, 1 << 20):
        got = {}
        for part, starts, rows in words.pieces(data, begins, packing._opens, step):
            ids, at = packing._encoded(encode, part, starts)
            for i, row in enumerate(rows):
                got.setdefault(int(row), []).extend(ids[at[i] : at[i + 1]].tolist())
        assert [[*got.get(i, []), 2] for i in range(len(texts))] == want


def test_other_vocabularies_are_left_to_their_library():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    encode = packing.encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert [encode(x) for x in ODD[1:16]] == [t.encode(x, add_special_tokens=False).ids for x in ODD[1:16]]


def test_places_and_sequences(spark):
    texts = ODD + ["same short text"] * 500 + ["word " * n for n in range(0, 1500, 7)]
    docs = spark.createDataFrame([(i if i % 11 else None, t, 1, "z") for i, t in enumerate(texts)], "doc_id long, text string, offset int, part string").repartition(5)
    packed = packing.pack(docs)
    rows = packed.collect()
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]
    want = sorted((i if i % 11 else -1, tuple(tokens(t))) for i, t in enumerate(texts))
    for i, ids in want:
        if i >= 0:
            own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
            assert [r.piece for r in own] == list(range(len(own))) and all(r.length == 1024 for r in own[1:])
            assert b"".join(r.ids for r in own) == np.array(ids, "<u4").tobytes()
            assert [r.start for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
    assert sum(r.length for r in rows) == sum(len(ids) for _, ids in want)
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    sizes = [r.length for r in rows]
    assert len(held) == len(bin_by_bin(sizes, 1024)) <= -(-sum(sizes) // 1024) + 2
    whole = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    assert len(whole) == len(held) and all(len(r.ids) == 4 * r.length == 4 * sum(n for _, n in held[k]) for k, r in whole.items())
    assert packing.pack(docs.limit(0)).count() == 0


def test_query(spark):
    rows = packing.op12_packing(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        ids = tokens(texts[r.doc_id])[r.start : r.start + r.length]
        assert len(ids) == r.length and zlib.crc32(np.array(ids, "<u4").tobytes()) == r.ids_crc32
