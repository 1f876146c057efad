"""The first row of a join found in ranges, and fields found in documents."""

import json
import random

from pyspark.sql import functions as F

from funnelworks.operators import listings
from funnelworks.operators.lookups import first_match, first_row


def test_first_match_equals_the_first_row_of_the_join(spark):
    rng = random.Random(1)
    ids = rng.sample(range(10_000), 900) + [7] * 40 + [None] * 5
    events = spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "id bigint, k int").repartition(4)
    for wanted in ([3], [899], [900, 12], [940], [944], [], list(range(0, 945, 100))):
        keys = spark.createDataFrame([(k,) for k in wanted], "k int")
        match = lambda rows, keys=keys: rows.join(keys, "k")
        got = [r.id for r in first_match(events, "id", match, block=8).collect()]
        assert got == [r.id for r in first_row(match(events), "id").collect()]


def test_few_rows_meet_the_join(spark, tmp_dir):
    spark.range(200_000).select(F.col("id"), (F.col("id") % 1000).alias("k")).write.parquet(f"{tmp_dir}/events")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    def match(rows):
        return rows.mapInArrow(count, rows.schema).where("k = 700")

    row = first_match(spark.read.parquet(f"{tmp_dir}/events"), "id", match).first()
    # 256 rows in vain, then those of the range that holds it, and those again for the result
    assert row.id == 700 and seen.value <= 256 + 2 * 4096 + 4096


def _responses(spark, elements):
    body = json.dumps({"content": {"results": {"organic": elements}}})
    return spark.createDataFrame([(1, body), (2, "{"), (3, json.dumps({"content": {"results": {"amazons_choices": elements[:1]}}}))], "response_id int, body string")


def test_fields_and_their_types_are_found(spark):
    elements = [
        {"asin": "a", "n": 1, "x": 1.5, "ok": True, "mixed": 3, "box": {"w": [1, None]}, "kind": "k", "odd.name": "o", "void": None},
        {"asin": "b", "n": 12345678901, "x": 2, "mixed": "three", "response_id": 9},
        7,
    ]
    responses = _responses(spark, elements)
    assert listings.found_fields(responses) == {
        "asin": "string", "box": "string", "kind": "string", "mixed": "string", "n": "bigint", "odd.name": "string",
        "ok": "boolean", "response_id": "bigint", "void": "string", "x": "double",
    }
    rows = {(r.response_id, r.asin): r for r in listings.flatten_found(responses).collect()}
    a, b = rows[1, "a"], rows[1, "b"]
    assert (a.n, a.x, a.ok, a.mixed, json.loads(a.box), a._kind, a["odd.name"], a.void) == (1, 1.5, True, "3", {"w": [1, None]}, "k", "o", None)
    assert (b.n, b.x, b.ok, b.mixed, b.box, b._response_id) == (12345678901, 2.0, None, "three", None, 9)
    assert a.kind == "organic" and rows[3, "a"].kind == "amazons_choices"
    assert listings.found_fields(_responses(spark, [1, 2])) == {}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_an_element_is_read_once_and_not_described(spark):
    """Telling objects apart looks at no value inside them, and a field is read as text in one go
    (before: the types of the whole element were named, and a text read in five ways)."""
    responses = _responses(spark, [{"asin": "a", "x": 1}])
    plans = _plan(listings.flatten_listings(responses)), _plan(listings.flatten_found(responses, fields={"asin": "string", "x": "bigint"}))
    assert "schemaOfVariant" not in plans[0] and plans[0].count("parseJson") == 1
    assert plans[1].count("parseJson") == 1 and "StructsToJson" not in plans[1]
    assert plans[1].count("$['asin'], StringType") == 1 and plans[1].count("schemaOfVariant") == 1


def test_shapes_of_results_and_texts_of_values(spark):
    values = {
        "null": None, '"null"': "null", '""': "", '"a\\"b"': 'a"b', "1.50": "1.5", "901.00": "901", "1e2": "100.0", "0.0000001": "0.0000001", "true": "true",
        "123456789012345678901234567890": "123456789012345678901234567890", "1e400": '"Infinity"', "-1e400": '"-Infinity"', '"Infinity"': "Infinity",
        "[1, null]": "[1,null]", '{"b": {}, "a": 1.0}': '{"a":1,"b":{}}', "{}": "{}",
    }
    for (text, wanted), row in zip(values.items(), _found_texts(spark, list(values)), strict=True):
        assert row == wanted, text
    shapes = {
        '{"organic":[{}],"amazons_choices":[{},{}]}': ["organic", "amazons_choices", "amazons_choices"],
        '{"organic":{"a":1},"amazons_choices":[{}]}': ["amazons_choices"], '{"organic":"x"}': [], '{"organic":null,"amazons_choices":[[],{},null]}': ["amazons_choices"],
        "{}": [], "[]": None, "7": None, "null": None, '"{}"': None, '{"organic":[null,{"asin":[1]}]}': ["organic"],
    }
    responses = spark.createDataFrame([(i, f'{{"content":{{"results":{r}}}}}') for i, r in enumerate(shapes)], "response_id int, body string")
    kinds, rejects = {}, {}
    for r in listings.flatten_listings(responses).collect():
        kinds.setdefault(r.response_id, []).append(r.kind)
    for r in listings.flatten_rejects(responses).collect():
        rejects.setdefault(r.response_id, []).append((r.reason, r.document))
    for i, (results, wanted) in enumerate(shapes.items()):
        assert kinds.get(i, []) == (wanted or []), results
        assert (rejects.get(i, [("", "")])[0][0] == "results_not_an_object") == (wanted is None), results
    assert sorted(rejects[3]) == [("element_not_an_object", "[]"), ("element_not_an_object", "null")]


def _found_texts(spark, values):
    bodies = [(i, f'{{"content":{{"results":{{"organic":[{{"f":{v}}}]}}}}}}') for i, v in enumerate(values)]
    rows = listings.flatten_found(spark.createDataFrame(bodies, "response_id int, body string"), fields={"f": "string"}).collect()
    return [r.f for r in sorted(rows, key=lambda r: r.response_id)]
