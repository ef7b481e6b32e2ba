import zlib
from itertools import pairwise

import numpy as np
import pytest

from askledger.llm import bpe, packing

WINDOW = 64


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_vocabulary())
    t.encode_special_tokens = True
    return t


def test_ids_are_those_of_the_vocabulary_file(tokenizer, prose, odd_rows):
    texts = [t for _, t in odd_rows if t] + [" ", "a  b", "x \n \n y", "it's 3.5 \t<|endoftext|> don't\r\n", " 　  x", prose(500, 9), "l'été ça   va?  "]
    ids = bpe.Encoder().ids
    assert [ids(t) for t in texts] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def check(pieces, texts, tokenizer, window):
    """Every id in exactly one piece, pieces gapless in sequences, order kept."""
    whole = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts}
    for i, ids in whole.items():
        mine = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start)
        assert mine[0].start == 0 and all(a.start + a.length == b.start for a, b in pairwise(mine)) and mine[-1].start + mine[-1].length == len(ids)
        for p in mine:
            assert p.length > 0 and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
        assert [(p.sequence_id, p.offset) for p in mine] == sorted((p.sequence_id, p.offset) for p in mine)
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append(p)
    for parts in sequences.values():
        parts.sort(key=lambda p: p.offset)
        assert parts[0].offset == 0 and all(a.offset + a.length == b.offset for a, b in pairwise(parts)) and sum(p.length for p in parts) <= window
    return [sum(p.length for p in parts) for parts in sequences.values()]


def test_round_trip_and_padding(documents, prose, tokenizer):
    rows = [(k, ". ".join(prose(9, 100 * k + j) for j in range(k % 13)) if k else None) for k in range(60)] + [(99, prose(4000, 5)), (98, "")]
    for block in (100, 1 << 19):
        pieces = packing.pack(documents(rows), window=WINDOW, inside_cost=4, inside_step=8, block=block).collect()
        sizes = check(pieces, rows, tokenizer, WINDOW)
        assert sum(WINDOW - s for s in sizes if s & (s - 1)) < 0.08 * sum(sizes)


def test_odd_rows(documents, odd_rows):
    pieces = packing.pack(documents(odd_rows)).collect()
    by = lambda i: sum(p.length for p in pieces if p.doc_id == i)
    assert by(3) == by(4) == 1 and by(2) == 2 * by(1) and by(None) > 1
    assert packing.pack(documents([])).collect() == []


def test_cuts_are_optimal():
    rng = np.random.default_rng(4)
    for _ in range(40):
        n = int(rng.integers(2, 40))
        pos = np.unique(rng.integers(1, 9, n).cumsum())
        cost = rng.choice([0.0, 1.0, 5.0], len(pos))
        window = 10

        best = {0: 0.0}
        for p, c in zip(pos.tolist(), cost.tolist(), strict=True):
            best[p] = c + min(best[q] + window - (p - q) for q in best if p - q <= window)
        ends = packing.best_cuts(pos, cost, window)
        paid = sum(window - (b - a) for a, b in pairwise([0, *ends])) + sum(cost[list(pos).index(e)] for e in ends)
        assert ends[-1] == pos[-1] and paid == best[int(pos[-1])]


def test_a_last_stretch_is_split_where_that_is_cheaper():
    assert packing.tail_cuts(100, 100 + 1024, 2048, 12.0) == [100 + 1024]
    assert packing.tail_cuts(0, 1024 + 256 + 1, 2048, 12.0) == [1024, 1280, 1281]
    assert packing.tail_cuts(0, 2047, 2048, 12.0) == [2047]


def test_added_tokens_become_their_own_ids(documents, prose):
    from tokenizers import Tokenizer

    default = Tokenizer.from_file(bpe.default_vocabulary())
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>x  <|endoftext|>\n", "<|endoftext|", prose(50, 3), ""]
    whole = [default.encode(t, add_special_tokens=False).ids for t in texts]
    assert whole[0] == [64, 220, 50256, 275] and [bpe.Encoder().ids_with_added(t) for t in texts] == whole
    check(packing.pack(documents(list(enumerate(texts))), window=WINDOW).collect(), list(enumerate(texts)), default, WINDOW)
