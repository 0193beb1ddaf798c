"""The cheap look at a text lets every entity through."""

import pytest
from pyspark.sql import functions as F

from notelake.llm import pii

ONE_EACH = {
    "EMAIL": ["a@b.co"],
    "IPV4": ["1.2.3.4", "10.20.30.40"],
    "CARD": ["4111 1111 1111 1111", "4111111111111111"],
    "PHONE": ["(12) 345-6789", "+1 (12) 345-6789", "+45 12 34 56 78", "+47 22 12 34 56", "+1.22.33", "+358-40-12-34-56", "+15551234567", "555-123-4567", "+33 1 23 45 67 89"],
    "SSN": ["123-45-6789"],
    "IBAN": ["DE021203000000", "GB82 WEST 1234 5698", "MT84MALT011000012345MTLCAST001S"],
    "NAME": ["Mr Bo", "Госпожа Анна", "Ms O'Brien"],
}


@pytest.mark.parametrize("name", sorted(ONE_EACH))
def test_an_entity_alone_is_seen(name, spark):
    df = spark.createDataFrame([(t,) for t in ONE_EACH[name]], "text string")
    df = df.select("text", F.col("text").rlike(getattr(pii, name)).alias("is"), pii.has_entity(F.col("text")).alias("seen"))
    assert all(r["is"] and r["seen"] for r in df.collect())


def test_a_number_in_pairs_is_replaced_alike_with_and_without_other_digits(spark):
    rows = [(0, "Ring +45 12 34 56 78 now"), (1, "Ring +45 12 34 56 78 now or a@b.co"), (2, "a + b")]
    got = {r["doc_id"]: r for r in pii.replace(spark.createDataFrame(rows, "doc_id long, text string"), count_col="n").collect()}
    assert [got[i]["n"] for i in range(3)] == [1, 2, 0] and got[2]["text"] == "a + b"
    assert "12 34 56 78" not in got[0]["text"] and got[1]["text"].startswith(got[0]["text"])
