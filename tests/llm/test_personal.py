import hashlib
import math
import random
import re

import pytest

from askledger.llm import personal

#: The contract's expressions as they stand.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute_force(text):
    out = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")), "card": 12 <= len(digits) <= 19 and plain_luhn(digits), "phone": 9 <= len(digits) <= 15}
            if good[kind]:
                out.append((m.start(), order, kind, m.end()))
    return sorted(out)


CASES = [
    "mail a.b+c@x-y.example.com, and @no.user or a@b or x@y.z@w.org", "é 10.0.0.255 256.1.1.1 1.2.3.4.5.6.7.8 001.002.003.004", "4111 1111 1111 1111 and 4111-1111-1111-1112, 0000000000000000",
    "+1 (234) 555-7713 +12 +1 2 3 ++49 (30) 123 456 78", "\U0001F600a@b.cc \U0001F600+1 234 567 890", "a@b.c..d@e.f", "1.1.1.1@1.1.1.1", "@@@@ a@b@c.d", "12 34", "", "9" * 40 + " 79927398713 0 0 0 0 0 0 0 0 0 0 0 0",
]


@pytest.mark.parametrize("text", CASES)
def test_patterns_match_the_plain_expressions(text):
    assert personal.base_spans(text) == brute_force(text)


def test_long_runs_take_linear_time():
    assert personal.base_spans("a" * 300_000 + " " + "1" * 300_000 + "." * 10) == []


def test_terms_that_give_an_entity_away(documents):
    rows = [(k, f"the quiet Zebulon wrote from z{k % 2}@mail.example today") for k in range(6)] + [(k, f"the quiet man number {'x' * k} wrote today") for k in range(10, 40)]
    rows += [(50, "a lone Hapaxo near once@mail.example")]
    found = {r.doc_id: r for r in personal.digest(personal.find(documents(rows))).collect()}
    assert len(found) == len(rows)
    for k in range(6):
        text = dict(rows)[k]
        base = ",".join(f"{n}:{a}:{z}" for a, _, n, z in brute_force(text))
        assert found[k].base_sha256 == hashlib.sha256(base.encode()).hexdigest() and found[k].n_email == 1
        kinds = {text[int(a) : int(z)]: n for n, a, z in (s.split(":") for s in found[k].spans.split(","))}
        assert kinds[f"z{k % 2}@mail.example"] == "email" and kinds["Zebulon"] in ("removed", "general") and "the" not in kinds and "wrote" not in kinds
    assert all(found[k].spans == "" for k in range(10, 40)) and found[50].spans.count(":") == 2


def brute_force_terms(rows):
    """Term spans of every document by the definitions, plainly."""
    seen, holds, words, near = {}, {}, {}, {}
    for i, text in rows:
        spans = brute_force(text)
        found = [(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"[^\W\d_]{3,}", text)]
        for w in {w for _, _, w in found}:
            words[w] = words.get(w, 0) + 1
        free = [w for w in found if not any(a < w[1] and w[0] < z for a, _, _, z in spans)]
        for a, _, kind, z in spans:
            value = text[a:z].lower() if kind == "email" else text[a:z] if kind == "ip" else re.sub("[^0-9]", "", text[a:z])
            holds.setdefault((kind, value), set()).add(i)
            before, after = [w for w in free if w[0] < a], [w for w in free if w[0] >= a]
            for start, end, w in before[-personal.REACH :] + after[: personal.REACH]:
                seen.setdefault(((kind, value), w), set()).add(i)
                near.setdefault(i, set()).add(((kind, value), w, start, end))
    out = {}
    for i, places in near.items():
        for e, w, start, end in places:
            n, together, alone = len(rows), len(seen[e, w]), len(holds[e])
            if together >= personal.SUPPORT and alone < n:
                told = math.log2(together * n / (alone * words[w])) / -math.log2(alone / n)
                kind = "removed" if told >= personal.REMOVE else "general" if told >= personal.GENERALISE else None
                if kind:
                    out.setdefault(i, {})[start, end] = max(kind, out.get(i, {}).get((start, end), ""))
    return out


def test_terms_match_brute_force(documents, prose):
    rng = random.Random(2)
    rows = []
    for k in range(80):
        words = prose(rng.randint(5, 60), k).split()
        for _ in range(k % 3):
            e = rng.choice(["a1@mail.example", "10.0.0.7", "+1 (234) 555-7713", "b2@mail.example"])
            at = rng.randrange(len(words))
            words[at:at] = [rng.choice(["Zeb", "the", "Quux"]), e, rng.choice(["Orla", "an"])]
        rows.append((k, " ".join(words)))
    found = {r.doc_id: r.spans for r in personal.digest(personal.find(documents(rows))).collect()}
    expected = brute_force_terms(rows)
    assert sum(map(len, expected.values())) > 20
    for i, spans in found.items():
        mine = {(int(a), int(z)): n for n, a, z in (s.split(":") for s in spans.split(",") if s) if n in ("removed", "general")}
        assert mine == expected.get(i, {})


def test_odd_rows_and_sanitised_text(documents, odd_rows):
    found = personal.digest(personal.find(documents(odd_rows))).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(r[0]) for r in odd_rows)
    none = hashlib.sha256(b"").hexdigest()
    assert {r.base_sha256 for r in found if r.doc_id in (3, 4, 5, 6)} == {none}
    docs = documents([(1, "é write a@b.cc or +1 234 567 890"), (2, None)])
    clean = personal.sanitise(docs, personal.find(docs))
    assert clean.columns == docs.columns and sorted(map(str, (r.text for r in clean.collect()))) == ["None", "é write [email] or [phone]"]
    assert personal.find(documents([])).collect() == []


def test_terms_far_from_the_entity_in_its_documents(documents, prose):
    rows = [(k, f"Farawayo {prose(300, k)} reach me at far@mail.example") for k in range(3)] + [(k, prose(100, k)) for k in range(10, 40)]
    found = {r.doc_id: r.spans for r in personal.digest(personal.find(documents(rows))).collect()}
    assert all({"removed:0:8", "general:0:8"} & set(found[k].split(",")) for k in range(3))
