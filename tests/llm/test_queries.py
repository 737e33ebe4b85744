"""The registered training-data queries against SQL or a brute-force version, at the smallest scale."""

import zlib

import pandas as pd
import pytest

from tests.conftest import SF, same_rows
from tests.llm import brute
from voxelspark.llm import oracles, queries

SQL = oracles.oracle_sql()


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    same_rows(queries.queries()[name](spark, SF).toPandas(), duck.execute(SQL[name]).df())


def packs(rows, capacity=4096):
    for _, s in rows.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *s["length"].cumsum()[:-1]] and s["length"].sum() <= capacity


def test_op1(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    got = queries.op1_best_fit_packing(spark, SF).toPandas()
    expected = sorted(brute.token_pieces(docs[["doc_id", "text"]].itertuples(index=False), tok))
    assert sorted(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == expected
    packs(got)
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 4096) + 1


def test_op5(spark, docs):
    got = queries.op5_benchmark_decontamination(spark, SF).toPandas()
    items = pd.read_parquet(f"{SF}/benchmark.parquet")
    assert {(r.doc_id, r.item_id): r.distance for r in got.itertuples()} == brute.held(list(docs[["doc_id", "text"]].itertuples(index=False)), list(items.itertuples(index=False)))


def test_op8_held_out(spark, docs):
    got = queries.op8_language_id(spark, SF).toPandas().merge(docs[["doc_id", "lang"]], on="doc_id")
    assert len(got) == len(docs) and got["score"].between(0, 1).all()
    assert (got["held_out"] == got["doc_id"].map(lambda d: zlib.crc32(str(d).encode()) % 3 == 1)).all()
    held = got[got["held_out"] & got["lang"].notna()]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.95 and held["rejected"].mean() < 0.02


def test_op9_held_out(spark):
    sf = "/root/testdata/sf0.01"  # the smallest table has three labels of 0 held out
    got = queries.op9_quality_classifier(spark, sf).toPandas()
    assert len(got) == 1000 and got["score"].between(0, 1).all() and ((got["score"] >= 0.3) == (got["predicted"] == 1)).all()
    x = got[got["held_out"]].merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    good, bad = x[x["quality"] == 1]["score"].to_numpy(), x[x["quality"] == 0]["score"].to_numpy()
    assert (good[:, None] > bad).mean() > 0.9


def test_pipeline_against_brute_force(spark, docs):
    import corpus_pipeline as p

    d, kept = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, d, SF)
        assert out.columns == docs.columns.tolist()
        before = d.select("doc_id", "text").toPandas().itertuples(index=False, name=None)
        after = {r["doc_id"]: r["text"] for r in out.collect()}
        if name == "line_dedup":
            assert after == brute.dedup_lines(before)
        elif name == "ngram_jaccard_join":
            assert set(after) == {i for i, (_, c) in brute.groups(before).items() if i == c}
        elif name == "benchmark_decontamination":
            items = pd.read_parquet(f"{SF}/benchmark.parquet").itertuples(index=False)
            before = list(before)
            assert set(after) == {i for i, _ in before} - {i for i, _ in brute.held(before, items)}
        else:
            assert len(after) >= 0.97 * len(docs)
        kept[name], d = after, spark.createDataFrame(out.toPandas(), out.schema)
    packed = p.STAGES[-1][1](spark, d, SF).toPandas()
    assert set(packed["doc_id"]) == set(kept["benchmark_decontamination"])
    packs(packed)
