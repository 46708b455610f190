import pytest
from pyspark.sql import functions as F

from quillforge.functions import html, json_text
from quillforge.operators import calls

ROWS, BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def spark_defaults(spark):
    """The session with Spark's own bounds of Arrow batches."""
    before = {k: spark.conf.get(k) for k in (ROWS, BYTES)}
    for k in before:
        spark.conf.unset(k)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def _held(role, system, user, attempt):
    """Bytes that the worker holds as Arrow and as data frames; looked for by each 500th call."""
    import gc

    import pandas
    import pyarrow

    if attempt % 500:
        return "0"
    frames = sum(int(x.memory_usage(deep=True).sum()) for x in gc.get_objects() if type(x) is pandas.DataFrame)
    return str(pyarrow.total_allocated_bytes() + frames)


def _bounded(spark) -> bool:
    return int(spark.conf.get(ROWS)) <= 2000 and spark.conf.get(BYTES).rstrip("b") == str(8 << 20)


def test_a_task_that_asks_holds_no_more_of_its_rows_when_there_are_more(spark_defaults):
    held = {}
    for n in (1000, 4000):
        rows = spark_defaults.range(0, n, 1, 4).select(F.col("id").cast("int").alias("id"), F.repeat(F.lit("x"), 10_000).alias("prompt"))
        got = calls.ask(rows, calls.FunctionModels(_held), "r", "s", "prompt", "id", tasks=1).select("id", "reply.text").collect()
        assert sorted(r.id for r in got) == list(range(n))
        held[n] = max(int(r.text) for r in got)
    assert held[4000] < 20e6 and held[4000] < 1.5 * held[1000]


def test_other_columns_pass_a_call_as_they_are(spark):
    criteria = F.array(F.struct(F.lit("c").alias("criterion"), F.lit(2).alias("weight")))
    rows = spark.range(0, 300, 1, 3).select(
        "id", F.when(F.col("id") % 7 > 0, F.concat(F.lit("é "), F.col("id").cast("string"))).alias("user text"), criteria.alias("criteria"), F.when(F.col("id") % 5 == 0, F.array(F.lit(1.5), F.lit(None))).alias("x"),
        F.parse_json(F.concat(F.lit('{"a": '), F.col("id").cast("string"), F.lit("}"))).alias("v"), F.timestamp_seconds("id").alias("at"), F.create_map(F.lit("k"), "id").alias("m"), (F.col("id") % 3).alias("n"),
    )
    got = calls.ask(rows, calls.FunctionModels(lambda role, system, user, attempt: f"{user}/{attempt}"), "r", "s", "user text", "n", tasks=2)
    assert got.columns == [*rows.columns, "reply"]
    shown = lambda df: sorted(map(str, df.withColumn("v", F.to_json("v")).drop("reply").collect()))
    assert shown(got) == shown(rows)
    assert {r.id: r.text for r in got.select("id", "reply.text").collect()} == {i: f"{f'é {i}' if i % 7 else None}/{i % 3}" for i in range(300)}


@pytest.mark.parametrize("made", [
    lambda: json_text.extract_json(F.col("t")), lambda: json_text.prompt_json(F.array(F.struct(F.col("t").alias("criterion"), F.lit(1).alias("weight"), F.lit("positive").alias("category")))),
    lambda: json_text.fill_template("$t", ["t"], F.col("t")), lambda: html.html_to_markdown(F.col("t"), F.col("t"), ""),
])
def test_functions_on_texts_bound_their_batches(spark_defaults, made):
    assert not _bounded(spark_defaults)
    rows = spark_defaults.createDataFrame([("[1]",), ("<p>a</p>",)], "t string")
    assert rows.select(made().alias("x")).count() == 2 and _bounded(spark_defaults)


def test_pandas_functions_get_batches_within_the_bytes(spark_defaults):
    json_text.extract_json(F.col("t"))
    rows = spark_defaults.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("t"))

    @F.pandas_udf("long")
    def there(t):
        return t.map(lambda _: len(t))

    assert rows.select(F.max(there("t"))).first()[0] <= (9 << 20) // 10_000
