"""The pipeline's stages, each on its predecessor's rows, against brute force; and on odd rows and none."""

from __future__ import annotations

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from sedimenta.llm.queries import ORACLE_SQL, QUERIES
from sedimenta.llm.tables import staged, table
from tests.llm.test_operators import DOCS, ODD, SF, brute_cut, words

STAGES = dict(pipeline.STAGES)


@pytest.fixture(scope="module")
def steps(spark):
    """Rows in front of each stage, and what the last one returns."""
    out = [table(spark, SF, "documents")]
    for _, stage in pipeline.STAGES:
        out.append(staged(stage(spark, out[-1], SF)))
    return out


def test_stages_are_the_five_in_order(spark, steps):
    assert [n for n, _ in pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "substring dedup", "benchmark decontamination", "mixing sources to target weights"]
    for df in steps[:-1]:
        assert df.columns == steps[0].columns
    assert steps[-1].columns[: len(steps[0].columns)] == steps[0].columns
    sizes = [df.count() for df in steps]
    assert sizes == sorted(sizes, reverse=True)
    assert sizes[-1] > 0.5 * sizes[0]


def test_run_is_the_stages_one_after_another(spark, steps):
    assert sorted(map(tuple, pipeline.run(spark, SF).select("doc_id", "taken").collect())) == sorted(map(tuple, steps[-1].select("doc_id", "taken").collect()))


def test_quality_stage_keeps_what_the_labels_call_good(spark, steps):
    kept = {r.doc_id for r in steps[1].collect()}
    labels = table(spark, SF, "labels").collect()
    good = [r.doc_id for r in labels if r.quality == 1]
    assert sum(d in kept for d in good) >= 0.93 * len(good)


def test_near_dedup_stage_keeps_the_first_of_each_group(steps):
    before, after = ({r.doc_id: r.text for r in df.collect()} for df in steps[1:3])
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [words(t.lower())] for i in range(max(1, len(w) - 4))}
    sets = {d: shingles(t) for d, t in before.items()}
    jaccard = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    for d in before:
        if d not in after:
            assert any(jaccard(d, k) >= 0.8 for k in before if k != d)
    kept = sorted(after)
    assert sum(jaccard(a, b) >= 0.8 for i, a in enumerate(kept) for b in kept[:i]) <= 1
    assert len(set(after.values())) == len(after)


def test_substring_stage_cuts_what_repeats(steps):
    before, after = steps[2].orderBy("doc_id").collect(), {r.doc_id: r for r in steps[3].collect()}
    for r, (n, removed, _) in zip(before, brute_cut([r.text for r in before]), strict=True):
        if removed and removed == n:
            assert r.doc_id not in after
        else:
            assert len(words(after[r.doc_id].text)) == n - removed
            assert after[r.doc_id].text == r.text or removed
            assert after[r.doc_id].n_chars == len(after[r.doc_id].text)


def test_decontamination_stage_drops_what_holds_an_item(spark, steps):
    plain = lambda t: " ".join("".join(c.lower() if c.isalnum() else " " for c in t).split())
    items = [plain(r.text) for r in table(spark, SF, "benchmark").collect()]
    before, after = ({r.doc_id: plain(r.text) for r in df.collect()} for df in steps[3:5])
    leaking = {d for d, t in before.items() if any(i in t for i in items)}
    assert not leaking & set(after)
    assert len(before) - len(after) <= len(leaking) + 2


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_take_odd_rows_and_none(spark, name):
    extra = ["score", "_rid", "_row", "row", "_order", "_key", "_kept", "_n_words", "node", "_source", "taken"]
    odd = spark.createDataFrame(ODD, DOCS).withColumns({c: F.lit("clash") for c in extra})
    out = staged(STAGES[name](spark, odd, SF))
    same = [c for c in odd.columns if c != "taken"] if name.startswith("mixing") else odd.columns
    assert out.columns[: len(same)] == same
    assert out.count() <= len(ODD)
    assert {tuple(r) for r in out.select(*(c for c in extra if c in same)).distinct().collect()} <= {("clash",) * sum(c in same for c in extra)}
    assert STAGES[name](spark, odd.limit(0), SF).count() == 0


def test_stages_take_documents_from_elsewhere(spark, steps, tmp_path):
    for name in ("labels", "benchmark"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{SF}/{name}.parquet")
    docs = table(spark, SF, "documents")
    with pytest.raises(AnalysisException):
        pipeline.mix(spark, docs, str(tmp_path))
    for _, stage in pipeline.STAGES:
        docs = staged(stage(spark, docs, str(tmp_path)))
    assert sorted(map(tuple, docs.select("doc_id", "taken").collect())) == sorted(map(tuple, steps[-1].select("doc_id", "taken").collect()))


def test_one_query_for_each_operator():
    names = sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0]))
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11))
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_give_a_row_for_each_input_row(spark, name):
    got = QUERIES[name](spark, SF)
    source = {"op1": None, "op2": "pages", "op9": "pages", "op6": None}.get(name.split("_")[0], "documents")
    if source:
        assert got.count() == table(spark, SF, source).count()
    elif name.startswith("op1"):
        assert got.count() == table(spark, SF, "conversations").select("conv_id").distinct().count() + 1
    else:
        assert got.count() > 0


def test_mixing_equals_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    for name, sql in ORACLE_SQL.items():
        theirs = con.sql(sql)
        ours = QUERIES[name](spark, SF)
        assert sorted(ours.columns) == sorted(theirs.columns)
        assert sorted(map(tuple, ours.select(*theirs.columns).collect())) == sorted(theirs.fetchall())
