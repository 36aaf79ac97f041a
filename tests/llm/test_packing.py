import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

from loomgraph.llm.packing import assign_sequences, pack_documents, pack_histogram, sequences
from loomgraph.llm.queries import tokenizer_path
from loomgraph.llm.tokens import WordTokenizer

ODD = ["It's WE'LL <|endoftext|>x a<|startoftext|>", "tab\there\x1cx  y z", "ΑΣ σς ΟΔΟΣ", "é x́ ́", "½²x١", "\x00\x7f ~!@#$%^&*()_+", "日本語 text", "'s't's don't I'M a'll  \r\n b", "ÇPA!! straße Ñandú's é9è ª µº", "", "   "]


def test_word_tokenizer_equals_the_plain_one():
    t = WordTokenizer(tokenizer_path())
    assert t.by_word and t.by_piece
    for text in ODD * 2:
        assert t.encode(text) == t.plain(text)


def check(histogram, capacity):
    seen = Counter()
    plan = pack_histogram(dict(histogram), capacity)
    for lengths, count in plan:
        assert sum(lengths) <= capacity and count > 0
        for n in lengths:
            seen[n] += count
    assert seen == Counter({k: v for k, v in histogram.items() if v})
    return sum(c for _, c in plan)


def test_plans_hold_everything_in_few_sequences():
    g = random.Random(4)
    for _ in range(30):
        check({g.randint(1, 64): g.randint(1, 50) for _ in range(g.randint(0, 30))}, 64)
    wide = Counter(min(2048, max(1, int(g.lognormvariate(5.5, 1)))) for _ in range(20_000))
    bound = -(-sum(k * v for k, v in wide.items()) // 2048)
    assert check(wide, 2048) <= bound * 1.01 + 1
    check({1: 5, 2048: 7, 1025: 3}, 2048)
    assert check({}, 2048) == 0


def test_documents_are_packed_whole(spark):
    texts = [*ODD, None, "word " * 5000, "word " * 2047, "a b c", "a b c"]
    frame = spark.createDataFrame([(None if t == "a b c" else i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, offset string")
    packed = pack_documents(frame, tokenizer_path()).collect()
    plain = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for i, text in enumerate(texts):
        ids = plain.encode(text or "", add_special_tokens=False).ids + [0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at : at + 2048], "<u4").tobytes()
            want[(None if text == "a b c" else i, piece, at, len(part) // 4, zlib.crc32(part))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    places = defaultdict(list)
    for r in packed:
        places[r.sequence_id].append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    joined = sequences(spark.createDataFrame(packed)).collect()
    assert sum(len(r.ids) // 4 for r in joined) == sum(r.length for r in packed)


def test_hot_length_and_empty(spark):
    frame = spark.range(5000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 700L ELSE 1 + id % 90 END AS length").repartition(7)
    got = assign_sequences(frame, 2048).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == 5000
    assert assign_sequences(frame.limit(0), 2048).count() == 0


def test_columns_with_names_of_helpers(spark):
    frame = spark.range(200).selectExpr("id AS doc_id", "1 + id % 90 AS length", "'f' AS first", "id AS rows", "'o' AS offset", "'s' AS sequence_id", "1 AS `a.b`", "2 AS _part")
    got = assign_sequences(frame, 128)
    assert set(got.columns) == {"doc_id", "length", "first", "rows", "a.b", "sequence_id", "offset"}
    rows = got.collect()
    assert all(r["first"] == "f" and r["rows"] == r.doc_id for r in rows) and len({(r.sequence_id, r.offset) for r in rows}) == 200
