import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import ann, language, media, warc


def test_nearest_has_recall_and_exact_scores(spark):
    g = np.random.default_rng(0)
    x = g.normal(size=(1500, 16))
    x[200:500] = x[200] + 1e-3 * g.normal(size=(300, 16))  # a group of near copies
    x[600:620] = x[600]  # and of exact ones
    rows = [(i, v.tolist(), "c") for i, v in enumerate(x)]
    odd = [(5000, None, "c"), (5050, [0.0] * 16, "c"), (5100, [float("nan")] + [1.0] * 15, "c"), (5150, [None] + [1.0] * 15, "c"), (5200, [1.0, 2.0], "c"), (None, [1.0] * 16, "c"), (5250, [float("inf")] * 16, "c")]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, score string")
    got = {}
    for r in ann.nearest(frame, F.col("vec_id") % 50 == 0, k=5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 1500, 50))
    hit = 0
    for q, found in got.items():
        exact = (x * x[q]).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((x[q] ** 2).sum()))
        order = [i for i in np.lexsort((np.arange(1500), -exact)) if i != q][:5]
        found.sort()
        assert [k for k, _, _ in found] == [1, 2, 3, 4, 5]
        assert all(score == exact[i] for _, i, score in found)
        hit += len({i for _, i, _ in found} & set(order))
    assert hit / (5 * len(got)) >= 0.9
    assert [i for _, i, _ in sorted(got[600])] == [601, 602, 603, 604, 605]  # ties by id


def test_nearest_of_many_queries(spark):
    """Recall of 600 queries, of which a third asks with one very common vector, and components that overflow when squared."""
    g = np.random.default_rng(2)
    x = g.normal(size=(12_000, 32))
    x *= 10.0 ** g.integers(-150, 200, (12_000, 1))
    x[3000:7000] = x[3000]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(frame, F.col("vec_id") % 20 == 0, k=5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert set(got) == set(range(0, 12_000, 20))
    unit = x / np.abs(x).max(axis=1, keepdims=True)
    unit /= np.sqrt((unit**2).sum(axis=1, keepdims=True))
    hit = 0
    for q, found in got.items():
        if 3000 <= q < 7000:
            assert [i for _, i in sorted(found)] == [i for i in range(3000, 3006) if i != q][:5]
        score = unit @ unit[q]
        score[q] = -2
        hit += len({i for _, i in found} & set(np.lexsort((np.arange(len(x)), -score))[:5].tolist())) if not 3000 <= q < 7000 else 5
    assert hit / (5 * len(got)) >= 0.9


def test_repeated_rows_and_queries(spark):
    rows = [(0, [1.0, 0.0])] * 3 + [(1, [2.0, 0.0])] * 8 + [(2, [0.0, 1.0]), (3, [1.0, 1.0]), (3, [1.0, -0.5]), (None, [1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id) for r in ann.nearest(frame, F.col("vec_id").isin(0, 1), k=5).collect())
    assert got == [(0, k, 1) for k in range(1, 6)] + [(1, 1, 0), (1, 2, 0), (1, 3, 0), (1, 4, 3), (1, 5, 3)]


def test_nearest_of_few_rows(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [3.0, 3.0])], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in ann.nearest(frame, F.col("vec_id") == 0, k=5).collect())
    assert [(r[1], r[2]) for r in got] == [(1, 2), (2, 1)]
    assert ann.nearest(frame.limit(0), F.col("vec_id") == 0).count() == 0


def test_anisotropic_loss_keeps_large_products_better():
    g = np.random.default_rng(1)
    x = g.normal(size=(3000, 32))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    books = ann.train(x)
    plain = ann.Codebooks(books.centroids, 1.0)
    error = {}
    for name, b in (("aware", books), ("plain", plain)):
        codes = b.encode(x)
        approx = b.centroids[np.arange(codes.shape[1]), codes].reshape(len(x), -1)
        error[name] = np.abs((x * (x - approx)).sum(1)).mean()
        assert np.allclose(ann.scan(b.tables(x[:5]), codes), x[:5] @ approx.T, atol=1e-5)
    assert error["aware"] < error["plain"]


PAGES = [(1, "http://a/x y", "same"), (5, None, "same"), (3, "http://b", "same"), (2, "http://c", "héé\r\n\r\nWARC/1.1\r\n"), (4, "u\r\nX: 1", None), (9, "", ""), (None, "http://n", "same"), (7, "http://l", "ab" * 400_000), (8, "d", "dup"), (8, "d", "dup"), (10, "e", "ends\r\n"), (11, "e", "\r\n\r\n\r"), (12, "e", "\r\n\r\n" * 3 + "WARC/1.1\r\nContent-Length: 3\r\n\r\n"), (13, "e", "\r"), (14, "e", "\n\r\n\r\n\r\n")]


def test_archives_read_back(spark, tmp_path):
    frame = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, payload_digest string").repartition(3)
    warc.write_archives(frame, str(tmp_path / "w"))
    got = sorted(warc.read_archives(spark, str(tmp_path / "w")).collect(), key=lambda r: str(r.page_id))
    assert len(got) == len(PAGES)
    html = {i: h or "" for i, _, h in PAGES}
    first = {}
    for i, _, h in PAGES:
        if i is not None:
            first[h or ""] = max(i, first.get(h or "", -1))
    for r in got:
        data = html[r.page_id].encode()
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        if r.page_id == first[html[r.page_id]]:
            assert (r.record_type, r.refers_to, bytes(r.payload)) == ("response", None, data)
        else:
            assert (r.record_type, r.refers_to, r.payload) == ("revisit", first[html[r.page_id]], None)
    warc.write_archives(frame.limit(0), str(tmp_path / "e"))
    assert warc.read_archives(spark, str(tmp_path / "e")).count() == 0
    warc.write_archives(frame, str(tmp_path / "m"), least_bytes=5)
    assert {r.record_type for r in warc.read_archives(spark, str(tmp_path / "m")).collect()} == {"response"}


def test_files_end_with_any_payload(spark, tmp_path):
    """Every payload is the last of a file, and most files follow another in one task."""
    payloads = ["a", "a\r\n", "\r\n", "\r", "\r\n\r\n", "\r\n\r", "\n", "", "é\r\n\r\n\r\n"]
    frame = spark.createDataFrame([(i, "u", p * k) for i, (p, k) in enumerate((p, k) for p in payloads for k in (1, 2))], "page_id long, url string, html string").repartition(18, "page_id")
    warc.write_archives(frame, str(tmp_path / "w"), least_bytes=1 << 30)
    got = {r.page_id: bytes(r.payload).decode() for r in warc.read_archives(spark, str(tmp_path / "w")).coalesce(2).collect()}
    assert got == {r.page_id: r.html for r in frame.collect()}


def test_broken_archives_are_refused():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    import gzip

    members = gzip.compress(record) + gzip.compress(record)
    assert [b for _, b in warc.records(members)] == [b"abcd", b"abcd"]
    for bad in (record[:-6], b"HTTP/1.1\r\n\r\n", record.replace(b"4\r\n\r\n", b"3\r\n\r\n"), record + record[:20]):
        with pytest.raises(ValueError):
            list(warc.records(gzip.compress(bad)))


def sentence(g, letters):
    return " ".join("".join(g.choice(letters) for _ in range(g.randint(2, 8))) for _ in range(g.randint(5, 60)))


def test_language_profiles(spark):
    g = random.Random(3)
    kinds = {"aa": "aeiou" * 2 + "bdgt", "bb": "xyzäö" * 2 + "aekl", "cc": "мнопр" * 2 + "аеи"}
    rows = [(i, sentence(g, kinds[lang]), lang, "x") for i, lang in enumerate(g.choice(sorted(kinds)) for _ in range(600))]
    odd = [(9001, None, "aa", "x"), (9002, "", "aa", "x"), (9003, "12 ! 3", None, "x"), (None, "bad aegi dot", "zz", "x"), (9004, "Ab" * 50_000, "aa", "x"), (9005, "漢字 かな", None, "x")]
    frame = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score string")
    profiles = language.fit_profiles(frame.where(~language.held_out()))
    assert profiles.languages == ("aa", "bb", "cc")  # a row without an id is never learned from
    got = {r.doc_id: r for r in language.predict_language(frame, profiles).collect()}
    wrong = [i for i, _, lang, _ in rows if got[i].lang_pred != lang and zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(wrong) <= 3
    assert {got[i].lang_pred for i in (9001, 9002, 9003)} == {"und"} and all(0 <= r.score <= 1 for r in got.values())
    kept = language.keep_identified(frame, profiles, 0.0)
    assert kept.columns == frame.columns and kept.count() == len(rows) + 3
    again = language.predict_language(frame, language.fit_profiles(frame.where(~language.held_out()).repartition(5))).collect()
    assert {r.doc_id: tuple(r) for r in again} == {i: tuple(r) for i, r in got.items()}
    nothing = language.fit_profiles(frame.limit(0))
    assert {r.lang_pred for r in language.predict_language(frame, nothing).collect()} == {"und"}
    assert language.predict_language(frame.limit(0), profiles).count() == 0


def test_bundles_equal_the_plain_definition():
    e = language.Encoder()
    text, d = "Ab c", language.DIMENSIONS
    got = e.vector(text)
    letters = {p: e.tables[2][e.rows[p]].astype(int) for p in map(ord, "abc ")}
    want = np.zeros(d)
    for x, y, z in zip(" ab c ", "ab c  ", "b c  ", strict=False):
        want += np.roll(letters[ord(x)], 2) * np.roll(letters[ord(y)], 1) * letters[ord(z)]
    assert (got == want).all() and e.vector("12 3") is None


def test_media_round_trip(spark):
    texts = [None, "", "é" * 400, "x" * 576, "y" * 577, "same", "same", "long " * 50_000]
    frame = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)] + [(None, "n", "c")], "doc_id long, text string, tile string")
    got = {r.doc_id: r for r in media.media_features(media.store_payloads(frame)).collect()}
    for i, text in enumerate(texts):
        data = (text or "").encode()
        padded = data + b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
        assert r.media_bytes > len(padded) and len(r.feature) == 16 and bytes(r.tile[:6]) == b"\x93NUMPY"
    assert tuple(got[5])[1:] == tuple(got[6])[1:]
    assert media.media_features(media.store_payloads(frame.limit(0))).count() == 0


def test_features_equal_brute_force(spark):
    texts = ["", "x" * 10, "".join(chr(32 + i * 7 % 90) for i in range(576)), "grey " * 700]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in media.media_features(media.store_payloads(frame)).collect():
        data = texts[r.doc_id].encode()
        data += b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))
        image = np.frombuffer(data, np.uint8).reshape(-1, 24).astype(float)
        fine = image.repeat(8, 0).repeat(9, 1)  # every box is a whole number of samples here
        small = np.round(fine.reshape(8, image.shape[0], 9, 24).mean(axis=(1, 3)), 6)
        bits = "".join("1" if a < b else "0" for row in small for a, b in zip(row, row[1:], strict=False))
        assert r.feature == f"{int(bits, 2):016x}"


def test_equal_cosines_go_to_the_first_language(spark):
    frame = spark.createDataFrame([(i, "same words here", lang) for i in range(60) for lang in ("bb", "aa")], "doc_id long, text string, lang string")
    profiles = language.fit_profiles(frame)
    assert profiles.languages == ("aa", "bb") and {r.lang_pred for r in language.predict_language(frame, profiles).collect()} == {"aa"}
    assert language.fit_profiles(frame.union(frame.where("lang = 'bb'")), most_languages=1).languages == ("bb",)


def test_new_letters_cost_the_same():
    e = language.Encoder()
    for low in range(0x4E00, 0x4E00 + 6000, 500):
        e.vector("".join(chr(c) for c in range(low, low + 500)))
    assert len(e.rows) == 6001 and len(e.tables[0]) <= 2 * 6001
    again = language.Encoder()
    assert (again.vector("丂七") == e.vector("丂七")).all()


def test_decoders_and_resizing():
    g = np.random.default_rng(2)
    grey, colour = g.integers(0, 256, (7, 13), np.uint8), g.integers(0, 256, (5, 6, 3), np.uint8)
    assert (media.decode(media.encode_pgm(grey)) == grey).all() and (media.decode(media.encode_pgm(colour)) == colour).all()
    assert (media.decode(media.encode_bmp(grey)) == grey).all()
    assert media.decode(b"P2 # c\n2 2\n255\n1 2\n3 4").tolist() == [[1, 2], [3, 4]]
    assert media.decode(b"P1\n3 1\n1 0 1").tolist() == [[0, 1, 0]]
    assert media.decode(b"P4\n10 1\n" + bytes([0b10000000, 0b01000000])).tolist() == [[0, 1, 1, 1, 1, 1, 1, 1, 1, 0]]
    for bad in (b"P5\n4 4\n255\nxx", b"GIF89a", b"P5\n4"):
        with pytest.raises(ValueError):
            media.decode(bad)
    for rows, columns in ((3, 5), (8, 9), (14, 26)):
        fine = grey.repeat(rows, 0).repeat(columns, 1).astype(float)
        want = fine.reshape(rows, 7, columns, 13).mean(axis=(1, 3))
        assert np.allclose(media.area_resize(grey, rows, columns), want)
