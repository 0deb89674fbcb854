"""The pipeline's rows against plain versions of its stages."""

import re
from collections import Counter

import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from tableops.llm import langid, pieces, secrets
from tableops.llm.base import table
from tests.llm.test_decontam import plain as leaks
from tests.llm.test_simhash import plain_components, plain_print

SF_DIR = "/root/testdata/sf0.001"


def live(docs):
    def values(text):
        for kind in secrets.KINDS:
            for m in re.finditer(kind.pattern, text):
                value = m[kind.group]
                if len(value) >= kind.least and all(re.search(x, value) for x in kind.also):
                    yield m.span(), value, kind.base

    found = {d.doc_id: list(values(d.text)) for d in docs}
    owners, repositories = {}, {}
    for d in docs:
        for _, value, _ in found[d.doc_id]:
            owners.setdefault(value, set()).add(d.source)
            repositories.setdefault(value, set()).add((d.source, d.lang))
    out = set()
    for i, spans in found.items():
        base = [s for s, _, b in spans if b]
        for (a, z), value, is_base in spans:
            apart = is_base or not any(s < z and a < e for s, e in base)
            if apart and len(owners[value]) <= 2 and len(repositories[value]) <= 4:
                out.add(i)
    return out


def test_pipeline(spark):
    docs = sorted(table(spark, SF_DIR, "documents").collect(), key=lambda d: d.doc_id)
    items = [tuple(r) for r in table(spark, SF_DIR, "benchmark").collect()]
    told = langid.identify(table(spark, SF_DIR, "documents"), langid.train(table(spark, SF_DIR, "documents")), "doc_id")
    told = {r.doc_id for r in told.where("score > 0").collect()}
    stay = [d for d in docs if any(c.isalpha() for c in d.text or "") and d.doc_id in told]
    ids = [d.doc_id for d in stay]
    heads = plain_components(ids, [plain_print(d.text) for d in stay])
    stay = [d for d, head in zip(stay, heads, strict=True) if d.doc_id == head]
    stay = [d for d in stay if not leaks(d.text, items)]
    stay = [d for d in stay if d.doc_id not in live(stay)]
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_FILE)
    want = {d.doc_id: sp.encode(d.text) for d in stay}
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {r.doc_id: r.ids for r in rows} == want
    assert len(rows) == len(want)
    assert 0 < len(want) < len(docs)


def test_stages_take_odd_rows(spark, make_docs, tmp_path):
    words = " ".join(f"word{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, "12 34"), (4, words, "en", "a"), (4, words, "en", "a")]
    rows += [(None, words + " more", "en", "a"), (5, "token = abcdefgh12345678 is here", "en", "a")]
    rows += [(6, "tiny item here", "en", None), (7, "long " * 50_000, None, "b")]
    folder = str(tmp_path)
    make_docs(rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "tiny item here"), (2, None)], "item_id long, text string").write.parquet(
        f"{folder}/benchmark.parquet"
    )
    got = Counter(r.doc_id for r in corpus_pipeline.run(spark, folder).collect())
    assert got == Counter([4, 7])
    docs = table(spark, folder, "documents").withColumns({c: F.lit(1) for c in ("score", "lang_pred", "matches")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
        assert stage(spark, docs.where("false"), folder).collect() == []
    assert langid.train(docs.where("false")).langs == ()


def test_unseen_scripts_and_ties_are_rejected(spark, make_docs):
    rows = [(i, f"the quick brown fox number {i} jumps", "en") for i in range(20)]
    rows += [(50 + i, f"der schnelle braune fuchs nummer {i} springt", "de") for i in range(20)]
    rows += [(100, "Быстрая лиса прыгает", "en"), (101, "Быстрая лиса", None), (102, "語語語", None), (103, "12 34", None)]
    docs = make_docs([(*r, None) for r in rows])
    seen = docs.where("doc_id < 100")
    profiles = langid.train(seen)
    got = langid.identify(docs, profiles, "doc_id").where("score > 0 AND lang_pred != 'und'")
    assert {r.doc_id for r in got.collect()} == {r[0] for r in rows if r[0] < 100}
    kept = corpus_pipeline.language_id(spark, docs.where("doc_id != 100"), "")
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows if r[0] < 100}
