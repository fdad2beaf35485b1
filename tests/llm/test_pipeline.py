"""The pipeline's stages, each judged on its own input, and the registered names."""

import re

import __spark_entry__ as entry
import corpus_pipeline
import pytest

from larkspur.llm.common import read_documents, table
from tests.llm.test_jaccard import shingles, union

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """Input and output of every stage."""
    docs, out = read_documents(spark, SF), []
    for _, stage in corpus_pipeline.STAGES:
        after = table(stage(spark, docs, SF), "stage")
        out.append((docs, after))
        docs = after
    return out


def test_columns_and_order(kept):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near copies", "secret scan", "source mix", "packing"]
    columns = kept[0][0].columns
    assert all(after.columns == columns for _, after in kept[:-1])


def test_near_copies(kept):
    before, after = ([(r.doc_id, r.text) for r in df.collect()] for df in kept[1])
    sets = {d: shingles(t) for d, t in before}
    ids = sorted(sets)
    root = union(ids, [(a, b) for i, a in enumerate(ids) for b in ids[:i] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])
    assert sorted(d for d, _ in after) == sorted(set(root.values()))


def test_toxicity_only_drops(kept):
    before, after = ({r.doc_id: r.text for r in df.collect()} for df in kept[0])
    assert after.items() <= before.items() and len(after) > 0.7 * len(before)


def test_secrets_are_masked(kept):
    before, after = ({r.doc_id: r.text for r in df.collect()} for df in kept[2])
    assert before.keys() == after.keys()
    secret = re.compile(r"(?:password=|token = \")([0-9a-f]{18,40})|(AKIA[A-Z0-9]{16})")
    for d, t in before.items():
        assert not secret.search(after[d])
        assert secret.search(t) or after[d] == t or "<secret>" in after[d]


def test_mix_and_packing(kept):
    from collections import Counter
    before = {r.doc_id: r.text for r in kept[3][0].collect()}
    mixed = [(r.doc_id, r.text) for r in kept[3][1].collect()]
    assert all(before[d] == t for d, t in mixed) and max(Counter(d for d, _ in mixed).values()) <= 2
    words = sum(len((t or "").split()) for t in before.values())
    assert abs(sum(len((t or "").split()) for _, t in mixed) - 1.5 * words) < 0.25 * words
    pieces = kept[4][1].toPandas()
    whole = pieces.groupby("sequence_id").length.sum()
    assert (whole.drop(whole.index.max()) == 2048).all()
    starts = pieces[pieces.start == 0].doc_id.value_counts().to_dict()
    assert starts == dict(Counter(d for d, _ in mixed))


def test_nulls_repeats_clashing_names_and_no_rows(spark, tmp_path):
    """Every stage with odd rows, columns named as the stages' own, and with an empty table."""
    from pyspark.sql import functions as F
    docs = read_documents(spark, SF)
    odd = docs.limit(12).unionByName(docs.limit(3)).unionByName(docs.limit(2).withColumn("doc_id", F.lit(None).cast("bigint")))
    odd = odd.unionByName(docs.limit(1).withColumns({"doc_id": F.lit(900).cast("bigint"), "text": F.lit(None).cast("string")})).unionByName(
        docs.limit(1).withColumns({"doc_id": F.lit(901).cast("bigint"), "text": F.lit(""), "source": F.lit(None).cast("string"), "lang": F.lit(None).cast("string")}))
    names = ["copies", "row", "doc", "_row", "_score", "hits", "size", "id", "before", "_features"]
    odd = odd.withColumns({n: F.lit(7) for n in names})
    odd.write.parquet(str(tmp_path / "odd"))
    odd = spark.read.parquet(str(tmp_path / "odd"))
    for rows in (odd, odd.filter("false")):
        seen = rows
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, seen, SF)
            if i < 4:
                assert out.columns == odd.columns
                out.write.parquet(str(tmp_path / f"{i}-{rows is odd}"))
                seen = spark.read.schema(out.schema).parquet(str(tmp_path / f"{i}-{rows is odd}"))
                assert all(r[n] == 7 for r in seen.collect() for n in names)
                assert {900, 901} <= {r.doc_id for r in seen.collect()} or i == 3 or rows is not odd
            else:
                assert (out.count() > 0) == (rows is odd)


def test_registered():
    names = [n for n in entry.queries() if n == "pipeline" or re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline") == list(range(1, 14))
    assert set(entry.oracle_sql()) <= set(entry.queries())
