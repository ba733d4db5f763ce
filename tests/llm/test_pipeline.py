from collections import Counter

import public_tokenizers
import sentencepiece

import __spark_entry__ as entry
import corpus_pipeline
from stationloom.llm import queries
from stationloom.llm.common import stored


def test_every_operator_is_registered():
    names = set(queries.QUERIES)
    assert {int(n[2:].split("_")[0]) for n in names} == set(range(1, 11)) and len(names) == 10
    assert names | {"pipeline"} <= set(entry.queries()) and set(queries.ORACLE_SQL) <= names


def test_further_operators_are_registered():
    numbers = {int(n[2:].split("_")[0]) for n in entry.queries() if n.startswith("op") and n[2].isdigit()}
    assert numbers == set(range(1, 14)) and set(queries.FURTHER_SQL) <= set(queries.FURTHER) & set(entry.oracle_sql())


def test_stages(spark, given, folder):
    docs, columns = given, given.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, folder))
        assert docs.columns == columns
        assert set(docs.columns) == set(before.columns)
        n, m = before.count(), docs.count()
        if name != "mixing sources":
            assert 0 < m <= n
            assert not Counter(map(tuple, docs.collect())) - Counter(map(tuple, before.collect()))
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter((r.doc_id, len(library.encode(r.text, add_eos=True))) for r in docs.collect())
    found = Counter((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, folder).collect())
    assert found == want


def test_odd_rows(spark, odd, empty, folder):
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, folder))
        assert "ids_sha256" in docs.columns
