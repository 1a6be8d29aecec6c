"""Row-local work that is compiled, and codes that are made only for broken items."""

from pyspark.sql import functions as F

from evidencelens.catalog import records
from evidencelens.operators.schemas import columns, problems, table_problems
from tests.conftest import SMALL


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_records_are_typed_without_json_and_made_without_lambdas(spark):
    made = records.records(spark, SMALL, records.plan_fields("spark"))
    assert "sequence(" not in plan_of(made)
    docs = records.typed(made, records.PLAN)
    assert "json" not in plan_of(docs)
    parts = [c for c in made.columns if c != "row_id"]
    read = made.select("row_id", F.from_json(F.to_json(F.struct(*parts)), columns(records.PLAN)).alias("d")).select("row_id", "d.*")
    text = lambda df: {r["row_id"]: r["j"] for r in df.select("row_id", F.to_json(F.struct(*parts)).alias("j")).collect()}
    assert text(docs) == text(read)


def test_codes_of_an_array_are_made_behind_a_test(spark):
    docs = records.typed(records.records(spark, SMALL, records.episode_fields("spark")), records.EPISODE)
    text = docs.select(table_problems(records.EPISODE).alias("e"))._jdf.queryExecution().analyzed().toString()
    assert "CASE WHEN exists(" in text and " IN (" not in text
    one = spark.sql("SELECT array(named_struct('a', 'x', 'n', array('u', 'u')), NULL, named_struct('a', NULL, 'n', array(''))) AS v")
    spec = records.rc.Items(records.rc.Record({"a": records.Text(min_length=1, enum=("y", "z")), "n": records.rc.Items(records.Text(min_length=1), unique=True)}, ("a",)))
    box = records.rc.Record({"v": spec})
    assert one.select(problems(box, F.struct("v")).alias("e")).first()["e"] == ["v.0.a:enum", "v.0.n:uniqueItems", "v.1:type", "v.2.a:required", "v.2.n.0:minLength"]


def test_history_documents_are_evaluated_once(spark):
    from evidencelens.docs_view import documents
    from evidencelens.plans.history import history_feature_rows

    text = plan_of(history_feature_rows(documents(spark, SMALL)))
    assert "events.parquet" not in text and "human_actions" not in text and "objects" not in text.replace("n_objects", "")


def test_words_of_a_keyword_are_one_pattern(spark):
    from evidencelens.functions import keyword_category, keyword_flags

    rows = spark.sql("SELECT explode(array('Garden Gate', 'pet-contact', 'open  window', 'x', NULL, 'play meal')) AS t")
    text = rows.select(keyword_category("t").alias("c"))._jdf.queryExecution().analyzed().toString()
    assert text.count("lower(") == 4
    out = rows.select("t", keyword_category("t").alias("c"), keyword_flags("t")["door"].alias("door")).collect()
    assert [(r["c"], r["door"]) for r in out] == [("access", True), ("social", False), ("access", True), (None, False), (None, False), ("food", False)]


def test_made_arrays_are_columns_below_the_nested_form(spark):
    from evidencelens.catalog.history import nested_json
    from evidencelens.docs_view import sparse_documents

    text = plan_of(nested_json(sparse_documents(spark, SMALL)))
    assert "transform(observations#" in text and "transform(outcomes#" in text and "sequence(" not in text
