import random
from collections import defaultdict

import pytest

import __spark_entry__
import corpus_pipeline
from loomgraph.llm import language, pii


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    g = random.Random(8)
    words = {"en": ["the", "thing", "and", "other", "then", "when"], "de": ["über", "schön", "und", "zwölf", "grün", "straße"]}
    rows = []
    for i in range(160):
        lang = "en" if i % 3 else "de"
        rows.append((i, " ".join(g.choice(words[lang]) + g.choice(["", "er", "ing", "s"]) for _ in range(g.randint(20, 120))), lang, f"src{i % 5}"))
    rows += [(200, rows[3][1], "en", "src1"), (201, rows[3][1] + " more", "en", "src2"), (202, "1234 !", "en", "src1"), (203, None, "en", "src1"), (204, rows[9][1] + " mail me at jo@example.com now", "de", "src0")]
    path = tmp_path_factory.mktemp("tables")
    frame = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.repartition(3).write.parquet(str(path / "documents.parquet"))
    return str(path)


def test_stages_one_by_one(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").cache()
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tables)
        got = {r.doc_id: r for r in out.collect()} if name != "best-fit packing" else None
        seen.append(name)
        if name == "language ID":
            profiles = language.fit_profiles(docs.where(~language.held_out()))
            judged = {r.doc_id: r for r in language.predict_language(docs, profiles).collect()}
            assert set(got) == {i for i, r in judged.items() if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_SCORE}
            assert 202 not in got and 203 not in got and len(got) >= 160
        elif name == "n-gram Jaccard join":
            from .test_ngram_join import brute

            groups = defaultdict(list)
            for i, _, c in brute([(i, r.text) for i, r in before.items()], 5, 80):
                groups[c].append(i)
            assert set(got) == {min(g) for g in groups.values()} and 200 not in got and 201 not in got
        elif name == "PII":
            tagger = pii.default_tagger()
            for i, r in before.items():
                want = pii.redacted(r.text, pii.all_spans([r.text], tagger)[0])
                assert (got[i].text, got[i].n_chars) == (want, len(want))
        elif name == "mixing sources":
            words = lambda rows: sum(len(r.text.split()) for r in rows)
            assert set(got) <= set(before) and words(got.values()) <= words(before.values()) * 4 // 5
            assert all(got[i] == before[i] for i in got) and len(got) > 20
        else:
            pieces = out.collect()
            assert {r.doc_id for r in pieces} == set(before)
            assert sum(r.length for r in pieces if r.sequence_id is not None) == sum(r.length for r in pieces)
            break
        assert out.columns == columns
        docs = spark.createDataFrame(list(got.values()), docs.schema)
        before = got
    assert seen == ["language ID", "n-gram Jaccard join", "PII", "mixing sources", "best-fit packing"]


def test_run_equals_its_stages(spark, tables):
    rows = corpus_pipeline.run(spark, tables).collect()
    again = __spark_entry__.queries()["pipeline"](spark, tables).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, rows)) == sorted(map(key, again)) and len(rows) > 20


def test_short_clean_documents_stay(spark, tables):
    """Texts of a few n-grams have cosines near chance; only long foreign texts and those without letters go."""
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    short = ["A.", "Re.", "Die tz.", "Avec.", "Erö.", "Onhaha sh.", "BE!! SCUM!! TION!! A.!! " * 9]
    foreign = " ".join("".join(random.Random(i).sample("かきくけこさしすせそたちつてとなにぬねの", 6)) for i in range(60))
    rows = [(300 + i, t, "en", "src1", len(t)) for i, t in enumerate([*short, foreign, "12 !"])]
    profiles = language.fit_profiles(docs.where(~language.held_out()))
    more = spark.createDataFrame(rows, docs.schema)
    assert any(r.score < corpus_pipeline.LEAST_SCORE for r in language.predict_language(more, profiles).collect() if r.doc_id < 300 + len(short))
    kept = {r.doc_id for r in language.keep_identified(more, profiles, corpus_pipeline.LEAST_SCORE).collect()}
    assert kept == set(range(300, 300 + len(short)))
