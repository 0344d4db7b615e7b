"""Merged contacts are worked out once in each row."""

from pyspark.sql import functions as F

from entiform import schemas
from entiform.operators.merge import merge_contacts


def test_merged_contacts_are_bound_once(spark):
    def one(name, role):
        return F.array(F.struct(*[(F.lit(name) if n == "full_name" else F.lit(role) if n == "role" else F.lit(0.5) if n == "confidence" else F.lit(None).cast("string")).alias(n) for n in (
            "full_name", "role", "title_raw", "email_direct", "phone_direct", "linkedin_url", "confidence")])).cast(f"array<{schemas.CONTACT}>")

    marked = F.filter(one("Ann", "OWNER"), lambda c: F.rlike(c["full_name"], F.concat(F.lit("marked"), F.col("id").cast("string"))) | F.lit(True))
    df = spark.range(1).select(merge_contacts(one("ANN", ""), marked).alias("c"))
    assert df._jdf.queryExecution().analyzed().toString().count("marked") == 1
    got = df.first().c
    assert [(c.full_name, c.role) for c in got] == [("Ann", "OWNER")]
