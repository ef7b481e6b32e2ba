import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from askledger.llm import alignment, bpe


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(bpe.default_vocabulary())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=alignment.default_pieces())


def groups_of(text, tokenizers):
    """Groups and links of the whole text, walking both lists side by side."""
    a, b = tokenizers
    if not text:
        return None
    of = bpe._byte_of_symbol()
    a_ids, b_ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    a_bytes = [bytes(of[c] for c in a.id_to_token(k)) for k in a_ids]
    b_bytes = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in b_ids]
    if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
        return None
    out, i, j, x, y = [], 0, 0, 0, 0
    held = ([], [])
    while i < len(a_ids) or j < len(b_ids):
        if x <= y:
            held[0].append(a_ids[i])
            x += len(a_bytes[i])
            i += 1
        else:
            held[1].append(b_ids[j])
            y += len(b_bytes[j])
            j += 1
        if x == y:
            out.append(held)
            held = ([], [])
    return out


def written(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def brute_force(rows, tokenizers):
    groups = [groups_of(t, tokenizers) for _, t in rows]
    n = Counter((g[0][-1], g[1][-1]) for found in groups if found for g in found)
    most = Counter()
    for (_, b), c in n.items():
        most[b] = max(most[b], c)
    out = []
    for (i, _), found in zip(rows, groups, strict=True):
        if not found:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(g[0][-1], g[1][-1]) for g in found]
        text = written(found)
        out.append((i, sum(len(g[0]) for g in found), sum(len(g[1]) for g in found), len(found), len(links), sum(n[p] == most[p[1]] for p in links), sum(n[p] for p in links), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD = [
    "  two  spaces  ", " ", "\n", "a \n\n b\n", "trailing ", "tab\tand wide　spaces  x", "special <|endoftext|> <s> </s> <unk> <0x41>", "a▁b", "▁", "ﬁne é café", "\x00 \x1c \x1c",
    "don't we'll 3.14159 12345 x=y==z", "中文分词 日本語", "\U0001f600\U0001f468‍\U0001f469 ok", "!!!??? ...", "word", "x" * 300, " lead", "�",
]


def random_texts(n, seed):
    r = random.Random(seed)
    bits = ["the", "token", "isation", " ", "  ", "\n", ".", ",", "'s", "été", "42", "▁" if seed % 2 else "-", "中", "HTTP", "_", "\t", "\U0001f600"]
    return ["".join(r.choice(bits) + (" " if r.random() < 0.4 else "") for _ in range(r.randint(1, 60))) for _ in range(n)]


def test_against_whole_texts(documents, odd_rows, tokenizers):
    rows = odd_rows + [(200 + k, t) for k, t in enumerate(ODD + random_texts(150, 2) + random_texts(10, 3))]
    wanted = brute_force(rows, tokenizers)
    for most in (alignment.BROADCAST_PAIRS, 40, 0):
        found = alignment.alignment(documents(rows), most=most)
        assert sorted((tuple(r) for r in found.select(*COLUMNS).collect()), key=repr) == wanted
    assert alignment.alignment(documents([])).collect() == []


def test_whole_groups(documents, tokenizers):
    rows = [(k, t) for k, t in enumerate(ODD)]
    for r in alignment.alignment(documents(rows), whole=True).collect():
        wanted = groups_of(rows[r.doc_id][1], tokenizers)
        assert r.groups == (written(wanted) if wanted else "")


def test_slices_by_common_ends():
    common, a_before, b_before = alignment.slices([2, 3, 5], [1, 3, 5])
    assert common == [3, 5] and a_before.tolist() == [2, 3] and b_before.tolist() == [2, 3]
    names = np.array([f"{k}{m}" for m in ",|" for k in range(10)], object), np.array([f"{k}{m}" for m in ",;" for k in range(10)], object)
    assert "".join(alignment.written(np.array([1, 2, 3]), np.array([7, 8, 9]), a_before, b_before, *names)) == "1,2|7,8;3|9;"


def test_common_pairs_are_bounded(spark):
    pairs = spark.createDataFrame([(k, k % 50 + 1, True) for k in range(1000)], "pair long, links long, best boolean")
    for most in (0, 100, 333, 1000):
        common, rare = alignment.common_and_rare(pairs, most)
        assert common.count() <= most and common.count() + rare.count() == 1000
    assert common.count() == 1000
