"""The corpus pipeline against its parts, and the registered queries."""

import os

import pandas as pd
import pytest

import corpus_pipeline
from loomtab.llm import registry
from tests.llm.test_operators import BPE, brute_contaminated, brute_texts

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_stages_take_effect(spark):
    import base64

    import public_tokenizers
    import tiktoken

    from loomtab.llm import quality_classifier, quality_rules

    documents, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r.text for r in documents.collect()}
    good = {r.doc_id for r in quality_classifier.classify(documents, labels).where("predicted = 1").collect()}
    model = quality_rules.fit(documents, labels)
    good = sorted(d for d in good if quality_rules.verdict(rows[d], model, quality_rules.THRESHOLD)[-1])
    groups = brute_texts([rows[d] for d in good])
    single = [good[g] for g in sorted(set(groups))]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    held = {d for d, _ in brute_contaminated([(d, rows[d]) for d in single], items)}
    with open(BPE, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, DATA).collect()}
    assert out == {d: len(encoding.encode_ordinary(rows[d])) for d in single if d not in held}


def test_registered():
    numbers = {name.split("_")[0] for name in registry.queries()}
    assert {f"op{n}" for n in range(1, 11)} <= numbers and "pipeline" in numbers and set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_agrees_with_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    ours, theirs = registry.queries()[name](spark, DATA).toPandas(), c.execute(registry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    plain = lambda df: sorted(tuple("~" if pd.isna(v) else str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert plain(ours) == plain(theirs)
