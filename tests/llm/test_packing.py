"""Operator 9: ids against the tokenizers library, the plan against best-fit on documents, a round trip."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from carthouse.llm import packing, wordbpe

FILE = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, length int, rank string, piece int"

ODD = ["", "  ", "'s", "it's I'll 're x're !'s ''s 's's don't 'dog 'mm a'lly", "<|endoftext|> a", "a <|startoftext|>",
       "Ω ΣΑΣ İstanbul ǅ ß ﬁ", "é é 中文字 हिन्दी",
       "१२३ ½ ² Ⅷ a1b2", "a b\u0085c​d e\x1cf\x00g", "\U0001f600\U0001f44d\U0001f3fd z",
       "￾￿\U0003ffff q", "'", "'l", "'ll", "x'", "'ve'ved", "WORD word Word", "x" * 5000, "͸ unassigned"]


def ids(text):
    return Tokenizer.from_file(FILE).encode(text, add_special_tokens=False).ids


def test_ids_equal_the_library():
    e = wordbpe.Encoder(FILE)
    assert e.by_word
    assert [list(x) for x in e.encode(ODD)] == [ids(t) for t in ODD]
    points = [c for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    texts = ["".join("a" + chr(c) + "B " + chr(c) for c in points[i:i + 8]) for i in range(0, len(points), 8)]
    whole = Tokenizer.from_file(FILE).encode_batch(texts, add_special_tokens=False)
    assert all(list(x) == y.ids for x, y in zip(e.encode(texts), whole))


def test_words_beyond_what_is_kept(monkeypatch):
    monkeypatch.setattr(wordbpe, "KEEP", 40)
    e = wordbpe.Encoder(FILE)
    rnd = random.Random(0)
    texts = [" ".join("".join(rnd.choice("abcdef") for _ in range(4)) for _ in range(60)) for _ in range(20)]
    for t in texts:
        assert list(e.encode([t])[0]) == ids(t)


def test_plan_equals_best_fit_on_documents():
    rnd = random.Random(1)
    for _ in range(150):
        capacity = rnd.choice([5, 16, 64])
        counts = {rnd.randint(1, capacity): rnd.randint(1, 9) for _ in range(rnd.randint(1, 12))}
        plan, bins = sorted(packing.plan_slots(counts, capacity)), defaultdict(list)
        for length, n in counts.items():
            for rank in range(n):
                _, first, sequence, per, offset = [p for p in plan if p[0] == length and p[1] <= rank][-1]
                i = rank - first
                bins[sequence + i // per].append((offset + length * (i % per), length))
        room = []
        for length in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
            fit = min((r for r in room if r >= length), default=None)
            if fit is not None:
                room.remove(fit)
            room.append((capacity if fit is None else fit) - length)
        assert len(room) == len(bins)
        for b in bins.values():
            at = 0
            for offset, length in sorted(b):
                assert offset == at
                at += length
            assert at <= capacity
    assert packing.plan_slots({}) == []


def test_pieces_places_and_round_trip(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choice(["sea", "garden", "house", "1", "!"]) for _ in range(rnd.randint(0, 40))), 1, "r", 2)
            for i in range(120)]
    rows += [(500, None, None, None, None), (501, "", 1, "r", 1), (502, "sea " * 300, 1, "r", 1), (503, "sea " * 15, 1, "r", 1),
             (503, "sea " * 15, 1, "r", 1), (None, "no id", 1, "r", 1), (504, ODD[3], 1, "r", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    packed = packing.pack(df, FILE, capacity=16, keep_ids=True)
    got = packed.collect()
    want = []
    for doc, text, *_ in rows:
        full = ids(text or "") + [1]
        for k in range(0, len(full), 16):
            part = full[k:k + 16]
            want.append((str(doc), k // 16, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length, list(r.ids)))
    for p in places.values():
        at = 0
        for offset, length, _ in sorted(p):
            assert offset == at
            at += length
        assert at <= 16
    made = {r.sequence_id: list(r.ids) for r in packing.sequences(packed).collect()}
    assert made == {s: [x for p in sorted(v) for x in p[2]] for s, v in places.items()}


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), FILE).count() == 0
